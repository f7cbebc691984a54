import json

import pytest
from pyspark.sql import functions as F

from papergrid.operators import search
from papergrid.plans import pipeline
from papergrid.sources import files


def test_cache_and_references(spark, tmp_path):
    schema = "doi string, mesh_terms array<string>"
    (tmp_path / "cache.json").write_text(json.dumps({"Doe1": {"doi": "10.1/x", "mesh_terms": ["Bone"]}, "Roe2": {"doi": None}}), encoding="utf-8")
    rows = {r.key: (r.doi, r.mesh_terms) for r in files.read_cache(spark, str(tmp_path / "cache.json"), schema).collect()}
    assert rows == {"Doe1": ("10.1/x", ["Bone"]), "Roe2": (None, None)}
    assert files.read_cache(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "refs.json").write_text('[{"index": 2, "text": "a"}, {"index": 1}]', encoding="utf-8")
    assert [(r["index"], r["text"]) for r in files.read_references(spark, str(tmp_path / "refs.json"), "index int, text string").collect()] == [(2, "a"), (1, None)]
    with pytest.raises(FileNotFoundError):
        files.read_references(spark, str(tmp_path / "none.json"), "index int")


def test_table_if_there(spark, tmp_path):
    assert files.read_table_if_there(spark, str(tmp_path / "none"), "a int").count() == 0
    spark.range(3).selectExpr("cast(id as int) AS a").write.parquet(str(tmp_path / "t"))
    assert files.read_table_if_there(spark, str(tmp_path / "t"), "a int").count() == 3
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no table")
    with pytest.raises(Exception, match="(?i)parquet"):
        files.read_table_if_there(spark, str(tmp_path / "bad"), "a int").collect()


def test_fallback_and_answers(spark):
    df = spark.range(5)
    assert search.with_fallback(df, F.col("id") > 3).count() == 1
    assert search.with_fallback(df, F.col("id") > 9).count() == 5
    hits = spark.createDataFrame([(2, 0.5, "b", "second"), (1, 0.9, "a", "first")], "rank int, score double, title string, text string")
    row = pipeline.answered("why?", hits, lambda p: p[-4:]).first()
    assert row.answer == "why?" and "[1] first\n\n[2] second" in row.prompt and row.prompt.startswith(pipeline.INSTRUCTIONS)
    assert pipeline.answered("why?", hits.limit(0)).first().answer is None
    many = spark.range(1, 101).selectExpr("cast(id as int) AS rank", "0.5D AS score", "'t' AS title", "'x' AS text")
    assert pipeline.report_lines("q", many).count() == 401
