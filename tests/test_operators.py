import pytest
from pyspark.sql import functions as F

from papergrid.operators import chunks as C
from papergrid.operators import enrich as E
from papergrid.operators import search as S
from papergrid.operators import stats as G
from papergrid.plans import pipeline as P
from papergrid.sources import files

SECTION = "array<struct<title:string,section_type:string,content:string,subsections:array<struct<title:string,content:string>>>>"
ARTICLE = f"article_id bigint, citekey string, title string, authors array<string>, published string, source string, volume string, issue string, doi string, pmid string, tags array<string>, is_review boolean, entrez_mesh_terms array<string>, entrez_keywords array<string>, sections {SECTION}"


def articles(spark):
    secs = [("Intro", "intro", "A\n\n see references \n\nB", [("S1", "C"), None, (None, "D\n\nE")]), None, ("Refs", "references", "x", []), ("Other", "other", "y", None)]
    rows = [(1, "k1", "t", ["Doe, J"], "2020", None, None, None, None, None, ["review"], False, None, None, secs), (2, "k2", None, None, None, None, None, None, None, None, ["review"], None, None, None, secs),
            (3, None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ARTICLE)


def test_chunks(spark):
    got = [(r.article_id, r.subsection, r.paragraph_index, r.total_paragraphs, r.text) for r in C.chunks(articles(spark)).orderBy("article_id", "subsection_no", "paragraph_index").collect()]
    assert got[:5] == [(1, "", 1, 2, "A"), (1, "", 2, 2, "B"), (1, "S1", 1, 1, "C"), (1, "Untitled", 1, 2, "D"), (1, "Untitled", 2, 2, "E")]
    assert got[5:] == [(2, "", i, 5, x) for i, x in enumerate("ABCDE", 1)]
    mac = C.chunks(articles(spark), "mac").where("article_id = 1 AND section = 'Intro' AND subsection = ''").orderBy("paragraph_index")
    assert [r.paragraph_index for r in mac.collect()] == [0, 1, 2]
    assert [r.chunk_index for r in C.numbered(C.chunks(articles(spark))).where("article_id = 2").orderBy("chunk_index").collect()] == [1, 2, 3, 4, 5]
    assert C.chunks(articles(spark).limit(0)).count() == 0


def test_search(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "a", [0.0, 2.0]), (4, "a", None), (5, "a", [0.0, 0.0]), (6, "b", [1.0])], "id int, kind string, embedding array<float>")
    assert [(r.id, r.rank) for r in S.search(v, [3.0, 0.0], 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert [r.id for r in S.search(v, [0.0, 1.0], 20, {"kind": ["a"]}).orderBy("rank").collect()] == [3, 1]
    assert S.search(v, [0.0, 0.0], 5).count() == 0
    assert [S.clamp_k(k) for k in (None, 0, 7, 99)] == [5, 1, 7, 20]
    assert S.query_flags("effect -r of x -m", ["Results", "Methods", "Materials"]) == ("effect  of x", ["Results", "Materials"])
    both = {"kind": ["a"], "id": [2]}
    assert S.search(v, [1.0, 0.0], 5, both).count() == 3 and S.search(v, [1.0, 0.0], 5, both, "and").count() == 0


def test_enrich(spark):
    notes = spark.createDataFrame([("Doe", 1), ("doe", 2), ("ROE", 3), (None, 4)], "citekey string, n int")
    records = spark.createDataFrame([("Doe", "old", 1), ("Doe", "new", 2), ("roe", "r1", 3), ("Roe", "r2", 4)], "citekey string, doi string, ord int")
    got = {r.n: (r.doi, r.match) for r in E.enrich(notes, records, ["doi"]).collect()}
    assert got == {1: ("new", "exact"), 2: ("new", "folded"), 3: ("r1", "folded"), 4: (None, None)}


def test_records(spark):
    pub = "struct<pmid:string,doi:string,title:string,abstract:string,authors:array<string>>"
    rows = [(1, "s", 1, "Text A", "", "10.1/X", "", None, None), (2, "s", 2, "Text B", "", "10.1/x", "", ("", "", "T", "Abs", ["A"]), None), (3, "s", 3, "", "/doi/suppl/1", "", "", None, None),
            (4, "s", None, "Skip to main content", "", "", "", None, None), (5, "s", 4, "Text C", "", "", "9", None, "e")]
    df = spark.createDataFrame(rows, f"ref_id int, set_id string, ref_index int, text string, href string, doi string, pmid string, pubmed {pub}, error_text string")
    assert [(r.ref_id, r.place) for r in E.best_records(df).orderBy("place").collect()] == [(2, 1), (5, 2)]


def test_stats(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["x", "[1] a", "b", "[2] c", "Figure", "d"])], "g int, i int, t string")
    got = G.continued(lines, "g", "i", "t", F.col("t").startswith("["), F.col("t") == "Figure").orderBy("item").collect()
    assert [r.text for r in got] == ["[1] a b", "[2] c"]
    counts = spark.createDataFrame([("A", 3), ("A > x", 1), ("A > y", 4), ("B", 2)], "header_path string, n int")
    assert {r.header_path: r.total for r in G.header_rollup(counts).collect()} == {"A": 5, "A > x": 1, "A > y": 4, "B": 2}


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ncitekey: doe\n---\n> [!Info]\n> **Title**: T\n\n# 4 Main Text\nLead\n\n## Methods\nx\n")
    (tmp_path / "b c.md").write_text("no main text")
    notes = files.read_notes(spark, str(tmp_path))
    arts = {r.filename: r for r in P.articles_from_notes(notes).collect()}
    assert arts["a.md"].citekey == "doe" and arts["a.md"].title == "T" and [s.title for s in arts["a.md"].sections] == ["Introduction", "Methods"]
    assert not arts["b c.md"].ok and arts["b c.md"].error == "no main text"
    assert files.find_notes(notes, "B", "prefix").first().stem == "b c" and files.find_notes(notes, "zz").count() == 0
    mhtml = 'MIME-Version: 1.0\nContent-Type: multipart/related; boundary="b"\n\n--b\nContent-Type: text/html; charset=utf-8\nContent-Location: u1\n\n<p>long page with many words</p>\n--b\nContent-Type: text/html\nContent-Location: u2\n\n<p>References</p>\n--b\nContent-Type: image/png\nContent-Transfer-Encoding: base64\nContent-Location: i\n\nAAAA\n--b--\n'
    (tmp_path / "p.mhtml").write_text(mhtml)
    parts = files.read_mhtml(spark, str(tmp_path))
    assert parts.count() == 3 and files.main_pages(parts).first().location == "u2"
    out = str(tmp_path / "ix")
    files.write_index(notes, out)
    with pytest.raises(Exception):
        files.write_index(notes, out)
    assert files.read_index(spark, out).count() == 2
    assert files.read_table_if_there(spark, str(tmp_path / "none"), "a int").count() == 0


def test_pipeline(spark):
    index = P.embed(C.chunks(articles(spark)))
    assert P.search_text(index, "A", 3).count() == 3
    assert P.embed_new(C.chunks(articles(spark)), index, ["article_id", "section_no", "subsection_no", "paragraph_index"]).count() == 0
    hits = P.search_text(index, "A", 2).select("rank", "score", F.col("section").alias("title"), "text")
    assert [r.line for r in P.report_lines("q", hits).collect()][:2] == ["# q", "## 1. Intro"]
    assert hits.agg(P.prompt_context(hits).alias("c")).first().c.startswith("[1] A")
    assert [x[1] for x in P.run_steps([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 1)])] == [True, False]
    text = "One two three. Four five six. Seven eight nine."
    windows = spark.range(1).select(C.sentences(F.lit(text), 6, 2).alias("w")).first().w
    assert windows[0] == "One two three. Four five six." and windows[1].endswith("Seven eight nine.")
