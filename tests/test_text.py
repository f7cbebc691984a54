from pyspark.sql import functions as F

from papergrid.functions import markdown as M
from papergrid.functions import references as R
from papergrid.functions import text as T


def one(spark, column, **values):
    """The column over one row of literals."""
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_section_types(spark):
    titles = {"Patients and Methods": "materials|methods", "BACKGROUND": "intro", "Intro": "intro", "Introductory": "other", "Citing articles": "cited_by", "Keywords": "keywords", "": "other"}
    for title, kind in titles.items():
        assert one(spark, T.section_type(F.col("t")), t=title) == kind == M.type_of(title)
    assert one(spark, T.section_type(F.col("t"), "review"), t="Outlook") == "review"
    assert one(spark, T.section_type(F.col("t"), "html"), t="Discussion:") == "discussion"
    assert one(spark, T.section_type(F.col("t"), "numbered"), t="2. Study") == "methods"
    assert one(spark, T.section_type(F.lit(None).cast("string")), t="") == "other"


def test_keys_and_citations(spark):
    assert one(spark, T.capital_key(F.col("t")), t="  doeAB2020 ") == "DoeAB2020"
    assert one(spark, T.stem_year(F.col("t")), t="Abebe2012") == "2012"
    assert one(spark, T.stem_year(F.col("t")), t="Abebe") == "N/A"
    authors = F.array(F.lit("Doe, Jane"), F.lit("Roe, R"))
    assert one(spark, T.citation(authors, F.col("y"), F.lit("k")), y="2020") == "Doe 2020"
    assert one(spark, T.citation(F.array().cast("array<string>"), F.col("y"), F.lit("k")), y="") == "k"


def test_cleaning(spark):
    assert one(spark, T.without_urls_and_tags(F.col("t")), t="a (https://x.org/b) <i>c</i>") == "a  c"
    assert one(spark, T.unlinked(F.col("t")), t=r"x \[[6](https://a.b)\] [label](https://c.d)") == "x  label"
    assert one(spark, T.without_links(F.col("t")), t="x [label](https://c.d)  y") == "x y"
    assert one(spark, T.cleaned_note(F.col("t")), t="a ![f](u) b [[CrossRef](u)]") == "a b"
    assert one(spark, T.compact_legends(F.col("t")), t="**Figure 1**\n\n\nText") == "**Figure 1**\nText"
    text = "see [a](https://x.y/z) and [b](https://ars.x/y) https://q.r [Crossref](https://d.e)"
    assert one(spark, T.without_web_addresses(F.col("t")), t=text) == "see [a]() and [b](https://ars.x/y)  "
    note = "Body [PubMed](http://b)\n## References\n[^1]: A. [PubMed](http://a) \n\n\n\nB"
    assert one(spark, T.clean_reference_links(F.col("t")), t=note) == "Body [PubMed](http://b)\n## References\n[^1]: A.\nB"
    assert one(spark, T.clean_reference_links(F.col("t")), t="no list") == "no list"
    assert one(spark, T.newlines(F.col("t")), t="a\r\nb\rc") == "a\nb\nc"


def test_callouts(spark):
    note = "> [!Info]\n> **FirstAuthor**:: Doe, J\n> **Title**: A b\n> **Year**: 2020\n> **Journal**: *Some J*\n> **DOI**: 10.1/x\n\n> [!Abstract]\n> One.\n>\n> Two.\n\nrest"
    assert one(spark, T.info_field(F.col("t"), "FirstAuthor"), t=note) == "Doe, J"
    assert one(spark, T.info_field(F.col("t"), "Journal"), t=note) == "Some J"
    assert one(spark, T.info_field(F.col("t"), "Volume"), t=note) == ""
    assert one(spark, T.abstract_callout(F.col("t"), "strict"), t=note) == "One.\n>\nTwo."
    assert one(spark, T.abstract_callout(F.col("t")), t="nothing") == ""


def test_main_text_quirks(spark):
    body = lambda t: one(spark, T.main_text(F.col("t")), t=t)
    assert body("x\n# 4 Main Text\n\nA\n# 5 Notes\nB") == "A\n# 5 Notes\nB"  # a spaced heading doesn't end it
    assert body("# 4 main text\nA\n#tag\nB") == "A"
    assert body("nothing") is None


def test_sections():
    assert [s["title"] for s in M.sections_of("Lead\n\n## Methods\ntext\n\n### Sub\nx")] == ["Introduction", "Methods"]
    s = M.sections_of("Lead\n\n## Methods\ntext\n\n### Sub\nx\n### Other\ny")[1]
    assert s["content"] == "text" and [u["content"] for u in s["subsections"]] == ["x", "y"]
    twice = M.sections_of("## Abstract\nA\n\n## Results\nB")  # a body that starts with a heading
    assert [t["title"] for t in twice] == ["Introduction", "Abstract", "Results"]
    assert [t["title"] for t in M.sections_of("## Abstract\nA\n\n## Results\nB", profile="mac")] == ["Abstract", "Results"]
    assert M.sections_of("## A\n## B\nx")[1]["content"].startswith("## B")  # adjacent headings
    assert M.sections_of("#### Deep\nx")[0]["title"] == "Deep"
    assert [t["type"] for t in M.sections_of("p\n\n## Methods\nx\n\n## References\ny", review=True)] == ["review", "references"]


def test_front_matter(spark):
    note = "---\r\ncitekey: doe2020\r\ntags: [review, x]\r\nreview: false\r\nmesh_terms:\r\n- Bone\r\n- Muscle\r\n---\r\nBody"
    row = one(spark, M.front_matter(F.col("t")), t=note)
    assert (row.found, row.citekey, row.tags, row.review, row.mesh_terms, row.rest) == (True, "doe2020", ["review", "x"], False, ["Bone", "Muscle"], "Body")
    bad = one(spark, M.front_matter(F.col("t")), t="---\na: b: c: [\n---\nBody")
    assert not bad.found and bad.rest.startswith("---")
    assert one(spark, M.front_matter_map(F.col("t")), t="---\na: 'x'\nb: 2\n---\n") == {"a": "x", "b": "2"}
    assert M.as_front_matter({"a": ["x", "1"], "b": True, "c": None, "d": "x: y"}) == "a:\n- x\n- '1'\nb: true\nc: null\nd: 'x: y'\n"


def test_merge_headings(spark):
    text = r"#### One\.A" + "\n\n##### Two\n\nBody\n\n#### Lost"
    assert one(spark, M.merge_headings(F.col("t")), t=text) == "One.A\nTwo\nBody"
    assert one(spark, M.merge_headings(F.col("t")), t="") == ""


def test_tables_and_references(spark):
    ps = F.array(*map(F.lit, ["a", "**Table 1** t", "<table>", "legend", "b", "**Table 2**", "**Table 3**", "x", "y", "c"]))
    assert one(spark, M.without_tables(ps), t="") == ["a", "b", "c"]
    assert one(spark, M.without_tables(ps, keep=True), t="") == ["a", "<table>", "b", "c"]
    refs = "- 1\\. A\n- [2\\. B](https://x.y)\n[3] C\nno"
    assert one(spark, M.reference_items(F.col("t")), t=refs) == ["1\\. A", "2\\. B"]
    assert one(spark, M.reference_items(F.col("t"), bracketed=True), t=refs) == ["1\\. A", "2\\. B", "[3] C"]
    listed = one(spark, M.numbered_references(F.col("t")), t="x\n## References\n**Doe J** a **12** b **Roe** c\n# Next")
    assert listed == "x\n## References\n1. **Doe J** a **12** b\n2. **Roe** c\n\n# Next"


def test_note_edits():
    note = "# 4 Main Text\n---\nLead\n\n## Methods\nx\n## References\ny\n"
    changed, done = M.with_intro_heading(note)
    assert done and "## Introduction\n\nLead\n\n## Methods" in changed and M.with_intro_heading(changed) == (changed, False)
    words, added = M.with_keywords(changed, ["a", "b"])
    assert added and words.index("## Keywords") < words.index("## References") and M.with_keywords(words, ["a"]) == (words, False)
    assert M.with_keywords(note, []) == (note, False)


def test_nodes():
    note = "top\n## Results\nlead\n\n### First\nP1\n\n![i](u)P2\n## References\nx"
    v2 = M.split_nodes(note, "v2")
    assert [(n["header_path"], n["paragraph_number"], n["text"]) for n in v2] == [("## Results > ### First", 1, "### First\nP1"), ("## Results > ### First", 2, "P2")]
    assert [n["section_name"] for n in M.split_nodes(note, "v1")] == ["First", "First"]
    assert M.split_nodes(note, "v4")[0]["text"] == "lead"
    assert M.split_nodes("", "v2") == []


def test_identifiers(spark):
    assert one(spark, R.doi(F.col("t")), t="see https://doi.org/10.1234/AB%2Fc).") == "10.1234/AB/c"
    assert one(spark, R.doi(F.col("t")), t="100% wrong %zz 10.1234/x,") == "10.1234/x"
    assert one(spark, R.pmid(F.col("t")), t="PMID: 123456") == "123456"
    assert one(spark, R.pmid(F.col("t")), t="https://pubmed.ncbi.nlm.nih.gov/77/") == "77"
    assert one(spark, R.slug(F.col("t")), t="https://A.b/c d/") == "a-b-c-d"
    assert one(spark, R.slug(F.col("t")), t="!!!") == "reference-set"
    assert one(spark, R.supplementary(F.col("t")), t="/doi/suppl/10.1/x")


def test_citations(spark):
    assert one(spark, R.cited_numbers(F.col("t")), t="a [3, 5–7] b [1] [5] [900-1] c [1-999]") == [3, 5, 6, 7, 1, 900, 999]
    assert one(spark, R.author_year(F.col("t")), t="[1] Smith AB, Doe J. A title. J. 2019").author == "Smith A"
    assert one(spark, R.author_year(F.col("t")), t="R. Smith, Title (2001)").asDict() == {"author": "Smith R", "year": "2001"}
    assert one(spark, R.author_year(F.col("t")), t="no year") is None
    assert one(spark, R.citation_title(F.col("t")), t="1. A. Smith, B. C. Doe, Title here. Nature 1 (2020) 2.") == "Title here"
    label = R.citation_label(F.col("a"), F.col("y"), F.lit(4))
    assert one(spark, label, a="Núñez et al., X", y="c2019") == "Núñez2019"
    assert one(spark, label, a="", y="") == "Ref4n.d."
    assert one(spark, R.citation_base(F.col("a"), F.col("y"), F.lit("f")), a="Jane McDoe", y="2020") == "Doe2020"
    assert one(spark, T.highlighted(F.col("t"), ["bone"]), t="Bone and bone") == "**bone** and **bone**"
    both = "ANSWER: yes KEYWORDS: a, b"
    assert (one(spark, T.answer_part(F.col("t")), t=both), one(spark, T.keyword_part(F.col("t")), t=both)) == ("yes", "a, b")
