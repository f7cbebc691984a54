from papergrid.functions import html as H
from papergrid.functions import xml as X

PAGE = """<html><head><title>T - ScienceDirect</title><meta name="citation_title" content="A &amp; B"><meta name="citation_author" content="Doe, J">
<meta name="citation_publication_date" content="2020/01/02"><meta name="citation_doi" content="10.1/AB"></head><body>
<section id="abstract"><h2>Abstract</h2><p>Short.</p></section>
<p>Lead text.</p><h2>Materials and Methods</h2><p>Use H<sub>2</sub>O<sup>3</sup>.</p><h3>Subjects:</h3><p>Ten.</p><h4>Age</h4><p>Old.</p>
<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>
<figure id="f1"><img src="u.png"><figcaption><b>Fig. 1.</b> Legend</figcaption></figure>
<h2>References</h2><ol><li>Doe. One. <a href="https://doi.org/10.1234/one">x</a></li><li>Roe. Two. <a href="https://pubmed.ncbi.nlm.nih.gov/12345/">PubMed</a></li></ol></body></html>"""


def test_entities_and_tags():
    assert H.decode_entities("&#x3b1; &lt; &unknown; &#99999999;") == "α < &unknown; &#99999999;"
    assert H.strip_tags("H<sub>2</sub>O<sup>3</sup> <script>x</script>a&nbsp;b") == "H₂O³ a b"
    assert H.strip_tags("x<sup>1</sup>", sup="drop") == "x"


def test_article():
    root = H.read(PAGE)
    assert H.title_of(root) == "A & B" and H.authors_of(root) == ["Doe, J"]
    assert H.meta_of(root, "")["doi"] == "10.1/ab" and H.meta_of(root, "")["year"] == "2020"
    sections = {s["title"]: s for s in H.sections_of_page(root)}
    assert set(list(sections)[:2]) == {"Abstract", "Introduction"} and sections["Abstract"]["paragraphs"][0] == "Short."
    methods = sections["Materials and Methods"]
    assert methods["paragraphs"] == ["Use H₂O ."] or methods["paragraphs"] == ["Use H₂O."]
    assert [u["title"] for u in methods["subsections"]] == ["Subjects", "Subjects > Age"]
    assert "| a | b |\n| --- | --- |\n| 1 | 2 |" in methods["subsections"][1]["paragraphs"]
    assert sections["Figure 1"]["content"].startswith("[Image URL: u.png]")
    assert "References" not in sections


def test_no_headings_and_junk():
    assert [s["title"] for s in H.sections_of_page(H.read("<p>One</p><p>Two"))] == ["Main Text"]
    assert H.sections_of_page(H.read("")) == []
    H.sections_of_page(H.read("<h2><p></div></h2><table><tr>"))


def test_references():
    found = H.references_of_page(PAGE, "https://x.org")
    assert [(r["doi"], r["pmid"]) for r in found] == [("10.1234/one", ""), ("", "12345")]
    sage = "".join(f'<div id="bibr{i}-1" class="citations"><div class="citation-content"><span class="label">{i}.</span>Text {i}</div><a href="https://pubmed.ncbi.nlm.nih.gov/10{i}">p</a></div>' for i in (1, 2))
    assert [(r["ref_index"], r["text"], r["pmid"]) for r in H.references_of_page(sage, "https://journals.sagepub.com/x")] == [(1, "Text 1", "101"), (2, "Text 2", "102")]
    plain = "<p><strong>References</strong></p><p>[1] Doe, A title of a paper.</p><p>continued</p><p>[2] Roe, Another title.</p><p>Figure 1</p>"
    assert [r["text"] for r in H.references_of_page(plain, "")] == ["[1] Doe, A title of a paper. continued", "[2] Roe, Another title."]
    metas = "".join(f'<meta name="citation_reference" content="Author {i}, a long enough reference text 10.1234/{i}">' for i in (1, 2))
    assert [r["doi"] for r in H.references_of_page(metas, "")] == ["10.1234/1", "10.1234/2"]
    assert H.references_of_page("", "") == []


def test_full_text_xml():
    xml = "<article><body><p>Lead</p><sec><title>Methods</title><p>Use <italic>x</italic> (a\nb)</p><sec><title>Funding</title><p>z</p></sec></sec></body><back><ref-list><ref><mixed-citation>Doe 2020</mixed-citation></ref></ref-list></back></article>"
    assert X.full_text_markdown(xml) == "## Introduction\n\nLead\n\n## Methods\n\nUse *x* (a b)\n\n## References\n\n1. Doe 2020"
    assert X.full_text_markdown("<broken") is None


def test_columns(spark):
    from pyspark.sql import functions as F

    from papergrid.plans import pipeline as P

    pages = spark.createDataFrame([(1, "https://x.org", PAGE), (2, "https://x.org", ""), (3, None, None)], "id int, source_url string, html string")
    rows = {r.id: r for r in P.import_pages(pages).collect()}
    assert rows[1].ok and rows[1].article_error is None and len(rows[1].records) == 2
    assert not rows[2].ok and not rows[3].ok
    part = spark.range(1).select(H.figure_parts(F.lit("[Image URL: u]\n\nLegend")).alias("x")).first().x
    assert (part.image_url, part.legend) == ("u", "Legend")


def test_very_deep_page():
    from papergrid.functions import html

    root = html.read("<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000 + "<p>after</p>")
    assert root.plain() == "deep after" and html.sections_of_page(root)
