from papergrid.operators import chunks as C
from papergrid.streaming import incremental as I

SCHEMA = "article_id bigint, citekey string, title string, authors array<string>, published string, source string, volume string, issue string, doi string, pmid string, tags array<string>, is_review boolean, entrez_mesh_terms array<string>, entrez_keywords array<string>, sections array<struct<title:string,section_type:string,content:string,subsections:array<struct<title:string,content:string>>>>"


def test_index_grows_once(spark, tmp_path):
    rows = [(i, f"k{i}", "t", None, None, None, None, None, None, None, None, False, None, None, [("a", "intro", "A\n\nB", None)]) for i in range(3)]
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    for part in (rows[:2], rows[1:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        I.grow_index(I.chunk_stream(stream), index, str(tmp_path / "state")).awaitTermination()
    batch = C.chunks(spark.createDataFrame(rows, SCHEMA))
    got = spark.read.parquet(index)
    assert got.count() == batch.count() == 6 and got.select("article_id", "text").distinct().count() == 6


def test_arrivals(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 01:00:00"), (1, "a", "2024-01-01 02:00:00"), (2, "b", "2024-01-02 01:00:00"), (9, "z", "2024-06-01 00:00:00")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "id int, kind string, t string").selectExpr("id", "kind", "CAST(t AS TIMESTAMP) AS at").coalesce(1).write.parquet(source)

    def run(make, name):
        stream = spark.readStream.schema("id int, kind string, at timestamp").parquet(source)
        make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.id for r in run(lambda s: I.first_arrivals(s, ["id"], "at"), "once")) == [1, 2, 9]
    assert {(r.kind, r.n) for r in run(lambda s: I.arrivals_by_window(s, "at", "kind"), "windows")} == {("a", 2), ("b", 1)}


def test_notes(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("line one\nline two")
    query = I.note_stream(spark, str(folder)).writeStream.format("memory").queryName("notes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.stem, r.content) for r in spark.table("notes").collect()] == [("a", "line one\nline two")]
