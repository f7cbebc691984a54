import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from papergrid.functions.keys import loose
from papergrid.operators import orphans
from papergrid.plans.training import literature_graph

T0 = datetime(2024, 1, 1)


def tables(spark, articles, records, citations):
    a = spark.createDataFrame(articles, "article_id bigint, citekey string, loaded_at timestamp, deleted_at timestamp, key0 string")
    r = spark.createDataFrame(records, "ref_id bigint, set_id string, ref_index int, citekey string, harvested_at timestamp")
    c = spark.createDataFrame(citations, "citation_id bigint, citekey string, set_id string, ref_index int, seen_at timestamp, since timestamp")
    return literature_graph(a, r, c)


def test_against_loops(spark):
    rng = random.Random(1)
    at = lambda: T0 + timedelta(hours=rng.randrange(4000))
    key = lambda: rng.choice(["Doe1", " doe1\t", "DOE1", "Röe", "Röe", "x", "", None, "y"])
    articles = [(i, key(), (t := at()), rng.choice([None, t + timedelta(hours=rng.randrange(-5, 900))]), "z") for i in range(60)]
    records = [(i, key(), rng.choice([1, 2, None]), key(), at()) for i in range(60)]
    citations = [(i, key(), key(), rng.choice([1, 2, 3, None]), rng.choice([at(), at(), None]), None) for i in range(200)]
    citations += citations[:20]
    import unicodedata

    fold = lambda k: unicodedata.normalize("NFC", k.strip().lower()) or None if k is not None else None
    alive = lambda k, t: t is not None and any(fold(a[1]) == k and a[2] <= t and (a[3] is None or t < a[3]) for a in articles)
    want = {("citations", c[0], "articles") for c in citations if fold(c[1]) and not alive(fold(c[1]), c[4])}
    want |= {
        ("citations", c[0], "reference_records") for c in citations
        if fold(c[2]) and c[3] is not None and not any(fold(r[1]) == fold(c[2]) and r[2] == c[3] and c[4] is not None and r[4] <= c[4] for r in records)
    }
    want |= {("reference_records", r[0], "articles") for r in records if fold(r[3]) and not alive(fold(r[3]), r[4])}
    found = orphans.orphans(*tables(spark, articles, records, citations))
    got = [(r.src_table, r.row_id, r.target_table) for r in found.where("kind = 'direct'").collect()]
    assert sorted(got) == sorted(want)
    lost = {r for r in records if ("reference_records", r[0], "articles") in want}
    inherited = {
        c[0] for c in citations if c[4] is not None and ("citations", c[0], "reference_records") not in want
        and any(fold(r[1]) == fold(c[2]) and fold(c[2]) and r[2] == c[3] and r[2] is not None and r[4] <= c[4] for r in lost)
    }
    assert {r.row_id for r in found.where("kind = 'inherited'").collect()} == inherited


def test_empty(spark):
    assert orphans.orphans(*tables(spark, [], [], [])).count() == 0


def test_cycle_ends(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "d", "gone"), (5, "e", "d"), (6, "f", "e")], "id int, k string, p string").withColumn("t", F.lit(T0))
    table = {"n": orphans.Table(rows, "id", "t")}
    refs = [orphans.Reference("n", "n", (loose(F.col("p")),), (loose(F.col("k")),), "t")]
    got = {(r.row_id, r.kind, r.level) for r in orphans.orphans(table, refs).collect()}
    assert got == {(4, "direct", 0), (5, "inherited", 1), (6, "inherited", 2)}


def _chain(spark, links):
    """Row 0 refers to nothing there is, each other row to the one before."""
    rows = spark.createDataFrame([(i, f"k{i}", f"k{i - 1}") for i in range(links + 1)], "id int, k string, p string").coalesce(1).withColumn("t", F.lit(T0))
    return {"n": orphans.Table(rows, "id", "t")}, [orphans.Reference("n", "n", (loose(F.col("p")),), (loose(F.col("k")),), "t")]


def test_too_few_rounds(spark):
    with pytest.raises(ValueError, match="after 2 rounds"):
        orphans.orphans(*_chain(spark, 4), most_rounds=2)
    assert orphans.orphans(*_chain(spark, 2), most_rounds=2).count() == 3


def test_deleted_target_passes_nothing_on(spark):
    """An orphaned row makes orphans of what refers to it only while it exists."""
    day = lambda n: T0 + timedelta(days=n)
    rows = spark.createDataFrame([(1, "a", "gone", day(0), day(5)), (2, "a", None, day(0), None)], "id int, k string, p string, since timestamp, until timestamp")
    children = spark.createDataFrame([(7, "a", day(1)), (8, "a", day(6)), (9, "b", day(1))], "id int, p string, at timestamp")
    table = {"n": orphans.Table(rows, "id", "since", "until"), "c": orphans.Table(children, "id")}
    refs = [orphans.Reference("n", "n", (F.col("p"),), (F.col("k"),), "since"), orphans.Reference("c", "n", (F.col("p"),), (F.col("k"),), "at")]
    got = {(r.src_table, r.row_id, r.kind) for r in orphans.orphans(table, refs).collect()}
    assert got == {("n", 1, "direct"), ("c", 9, "direct"), ("c", 7, "inherited")}
