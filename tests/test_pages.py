from pyspark.sql import functions as F

from papergrid.functions import html as H
from papergrid.functions import pages as G

PAGE = """<html><body><nav>menu</nav><article><div class="abstract author-highlights">No</div><div class="abstract author"><h2>Abstract</h2><p>True one.</p></div>
<section><h2>1. Introduction</h2><div><div>Leaf</div><p>Para</p></div><section><h3>Inner</h3><p>Deep</p></section><p>Para</p></section>
<section><h2>Keywords</h2><p>x</p></section><section><h2>References</h2><p>r</p></section><section><h2>Late</h2><p>z</p></section>
<figure id="fig1"><img src="https://x.org/a.JPG?x"><div class="captions"><span class="label">Fig. 1</span>. Bones</div></figure></article></body></html>"""


def test_rules():
    got = G.ruled_sections(PAGE)
    assert [(s["title"], s["type"], s["paragraphs"]) for s in got] == [("Abstract", "abstract", ["True one."]), ("1. Introduction", "intro", ["Leaf", "Para"]), ("Inner", "other", ["Deep"])]
    assert G.ruled_sections("") == []


def test_rules_as_column(spark):
    from papergrid.plans import catalog

    assert {"page_sections_by_rule", "page_figures"} <= set(catalog.QUERIES)
    pages = spark.createDataFrame([(1, PAGE, "s"), (2, None, "s"), (3, "", None)], "id int, text string, source string")
    rows = pages.select("id", F.explode(G.sections_by_rule({})(F.col("text"), F.col("source"))).alias("s")).collect()
    assert [(r.id, r.s.title, r.s.type) for r in rows] == [(1, s["title"], s["type"]) for s in G.ruled_sections(PAGE)]


def test_figures(spark):
    pages = spark.createDataFrame([("p", PAGE), ("q", None)], "path string, text string")
    parts = spark.createDataFrame([("p", "https://x.org/a.JPG?x", "image/jpeg"), ("p", "u", "text/html")], "path string, location string, content_type string")
    rows = G.figure_parts(pages, parts).collect()
    assert [(r.title, r.legend, r.file) for r in rows] == [("Figure 1", "Bones", "Figure_1.jpg")]
    sets = spark.createDataFrame([(1, PAGE), (2, "")], "id int, html string").select("id", H.article_of("html", F.lit("")).alias("a")).select("id", "a.sections")
    assert [(r.id, r.place) for r in G.collected_figures(sets, "id").collect()] == [(1, 1)]
    urls = "x https://cdn.ncbi.nlm.nih.gov/pmc/blobs/a/f1.jpg y https://cdn.ncbi.nlm.nih.gov/pmc/blobs/b/f1.jpg"
    assert spark.range(1).select(G.image_addresses(F.lit(urls)).alias("m")).first().m == {"f1.jpg": "https://cdn.ncbi.nlm.nih.gov/pmc/blobs/a/f1.jpg"}


def test_markdown_and_standard(spark):
    article = spark.createDataFrame([("<h2>Methods</h2><p>A</p><h3>Sub</h3><p>B</p>",)], "html string").select(H.article_of("html", F.lit("")).alias("a"))
    assert article.select(G.page_markdown(F.col("a.sections")).alias("m")).first().m == "## Methods\n\nA\n\n### Sub\n\nB"
    old = spark.createDataFrame([([("3. What", None, " a\n\nb ", None), (None, "intro", None, [("s", "c")])],), (None,)], "sections array<struct<title:string,type:string,content:string,subsections:array<struct<title:string,content:string>>>>")
    new = [r.s for r in old.select(G.standard_article(F.col("sections")).alias("s")).collect()]
    assert [(s.title, s.type, s.paragraphs) for s in new[0]] == [("3. What", "results", ["a", "b"]), ("Untitled", "intro", [])] and new[1] == []
    assert new[0][1].subsections[0].paragraphs == ["c"]
