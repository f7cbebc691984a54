"""Queries of the parsers of whole notes and whole pages, on notes and pages that the query itself writes from the rows of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papergrid.functions import html as H
from papergrid.functions import markdown as M
from papergrid.functions import pages as G
from papergrid.functions import references as R
from papergrid.functions import text as T
from papergrid.functions import xml as X
from papergrid.operators import chunks as C
from papergrid.operators import enrich as E
from papergrid.plans import pipeline as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__], SQL[f.__name__] = run, sql
        return f

    return keep


def _plain(x: str) -> Column:
    """Letters and digits of a column, with single blanks between words."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(x), F.lit("")), r"[^A-Za-z0-9]+", " "))


#: The rows that pages and notes are written from, in both engines: id, title, journal, year and a DOI of its own.
_ROWS = """w AS (SELECT work_id, 'About ' || trim(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS title, 'J ' || trim(regexp_replace(coalesce(journal, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS journal,
    CAST(1990 + work_id % 30 AS VARCHAR) AS year, '10.5555/w' || work_id AS doi FROM works)"""


def _rows(t) -> DataFrame:
    return t("works").select(
        "work_id", F.concat(F.lit("About "), _plain("title")).alias("title"), F.concat(F.lit("J "), _plain("journal")).alias("journal"),
        (1990 + F.pmod("work_id", F.lit(30))).cast("string").alias("year"), F.concat(F.lit("10.5555/w"), F.col("work_id").cast("string")).alias("doi"),
    )


def _text(*parts: str | Column) -> Column:
    """Columns by '@name' and literals, joined."""
    return F.concat(*(F.col(p[1:]) if isinstance(p, str) and p[:1] == "@" else F.lit(p) if isinstance(p, str) else p for p in parts))


# --- pages ------------------------------------------------------------------------------------------------------------------------

_SECTION_ROWS = """SELECT work_id, 'Abstract' AS title, 'abstract' AS type, 'In short ' || title AS content, '' AS subs FROM w
    UNION ALL SELECT work_id, 'Introduction', 'intro', 'Known is ' || title || chr(10) || chr(10) || 'Open is CO₂ at 10 in ' || journal, '' FROM w
    UNION ALL SELECT work_id, 'Materials and Methods', 'materials|methods', 'We took ' || year, 'Subjects=' || title || ';Subjects > Age=It was ' || year FROM w
    UNION ALL SELECT work_id, 'Results', 'results', '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || title || ' | ' || year || ' |', '' FROM w"""


def _page(body: Column) -> Column:
    return _text(
        '<!DOCTYPE html><html><head><meta name="citation_title" content="', "@title", '"><meta name="citation_author" content="Doe, Jane"><meta name="citation_author" content="Roe &amp; Sons">'
        '<meta name="citation_journal_title" content="', "@journal", '"><meta name="citation_publication_date" content="', "@year", '/05/01"><meta name="citation_doi" content="', "@doi",
        '"><script>var x = "</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>', body, "</body></html>",
    )


_BODY = (
    '<section id="abstract"><h2>Abstract</h2><p>In short ', "@title", '</p></section><section id="bodymatter"><h2>Introduction</h2><p>Known is <b>', "@title",
    "</b></p><div><p>Open is CO<sub>2</sub> at 10<sup>&#x2212;3</sup> in ", "@journal", "</p></div><h2>Materials and Methods</h2><p>We took ", "@year", "<br></p><h3>Subjects</h3><p>", "@title",
    "</p><h4>Age</h4><p>It was ", "@year", "</p><h2>Results:</h2><table><tr><th>a</th><th>b</th></tr><tr><td>", "@title", "</td><td>", "@year",
    "</td></tr></table><h2>References</h2><p>[1] None of the sections</p></section>",
)


def _articles(t) -> DataFrame:
    return _rows(t).select("work_id", H.article_of(_page(_text(*_BODY)), F.lit("https://example.org/p")).alias("a"))


@_query(f"WITH {_ROWS} SELECT work_id, title, 'Doe, Jane|Roe & Sons' AS authors, journal, year, doi FROM w")
def page_article_meta(t):
    return _articles(t).select("work_id", "a.title", F.array_join("a.authors", "|").alias("authors"), "a.journal", "a.year", "a.doi")


@_query(f"""WITH {_ROWS} {_SECTION_ROWS}""")
def page_article_sections(t):
    s = _articles(t).select("work_id", F.explode("a.sections").alias("s"))
    subs = F.array_join(F.transform("s.subsections", lambda u: F.concat_ws("=", u["title"], u["content"])), ";")
    return s.select("work_id", F.regexp_replace("s.title", ":$", "").alias("title"), "s.type", "s.content", subs.alias("subs"))


@_query(f"""WITH {_ROWS} SELECT work_id, '/f/' || work_id || '.png' AS image_url, 'Shape of ' || title AS legend FROM w""")
def page_article_figures(t):
    figure = ("<h2>Results</h2><p>Seen in ", "@year", '</p><figure id="F1"><img src="/f/', F.col("work_id").cast("string"), '.png"><figcaption><b>Figure 1.</b> Shape of ', "@title", "</figcaption></figure>")
    a = _rows(t).select("work_id", H.article_of(_page(_text(*figure)), F.lit("https://example.org/p")).alias("a"))
    s = a.select("work_id", F.explode("a.sections").alias("s")).where("s.type LIKE '%figure%'")
    part = H.figure_parts(F.col("s.content"))
    return s.select("work_id", part["image_url"].alias("image_url"), F.regexp_replace(part["legend"], r"^(?:\*\*)?(?:Figure|Fig\.?) 1\.?(?:\*\*)?\.?\s*", "").alias("legend"))


_ENTRIES = ("First of ", "Second of ")
_FORMS = {
    "sage": ('<div id="bibr{n}-x" class="citations"><div class="citation-content">{n} ', '</div><a href="https://doi.org/{d}">Crossref</a></div>'),
    "wiley": ('<ul><li data-bib-id="jor-bib-{n}">', ' <a href="https://doi.org/{d}">Crossref</a></li></ul>'),
    "meta": ('<meta name="citation_reference" content="', ' doi:{d}">'),
    "numbered": ("{h}<p>[{n}] ", " doi:{d}</p>"),
    "list": ("<ol><li>", ' <a href="https://doi.org/{d}">link</a></li></ol>'),
}


def _references(form: str):
    before, after = _FORMS[form]
    # Words of services go from a text, 'doi' among them.
    rest = {"list": "|| ' link'", "meta": "|| ' :' || doi || '.{i}'", "numbered": "|| ' :' || doi || '.{i}'"}.get(form, "")
    number = "'[{i}] ' || " if form == "numbered" else ""
    sql = " UNION ALL ".join(
        f"SELECT work_id, {i} AS ref_index, {number}'{e}' || title || ' ' || year {rest} AS text, doi || '.{i}' AS doi, '' AS pmid FROM w".replace("{i}", str(i)) for i, e in enumerate(_ENTRIES, 1)
    )

    def query(t):
        parts: list[str | Column] = []
        for i, entry in enumerate(_ENTRIES, 1):
            for piece, last in ((before, False), (after, True)):
                piece = piece.replace("{n}", str(i)).replace("{h}", "<h2>References</h2>" if i == 1 else "")
                head, mark, end = piece.partition("{d}")
                parts += [head, "@doi", f".{i}{end}"] if mark else [head]
                if not last:
                    parts += [entry, "@title", " ", "@year"]
        page = _text("<html><body>", *parts, "</body></html>")
        r = _rows(t).select("work_id", F.explode(H.references_of(page, F.lit("https://example.org/p"))).alias("r"))
        return r.select("work_id", "r.ref_index", "r.text", "r.doi", "r.pmid")

    query.__name__ = f"page_references_{form}"
    _query(f"WITH {_ROWS} {sql}")(query)


for _form in _FORMS:
    _references(_form)


@_query(f"""WITH {_ROWS} SELECT work_id, 'Title & <b>' || title || '</b> é A' AS decoded, 'Title & ' || title || ' é A' AS stripped, 'https://example.org/a/' || work_id AS url FROM w""")
def page_texts(t):
    coded = _text("Title &amp; &lt;b&gt;", "@title", "&lt;/b&gt; &#233; &#x41;")
    r = _rows(t).withColumn("coded", coded)
    url = H.absolute_url(_text("../a/", F.col("work_id").cast("string")), F.lit("https://example.org/b/c"))
    return r.select("work_id", H.entities_decoded(F.col("coded")).alias("decoded"), H.tags_stripped(F.col("coded")).alias("stripped"), url.alias("url"))


# --- notes ------------------------------------------------------------------------------------------------------------------------


def _note(main: tuple[str | Column, ...]) -> Column:
    return _text(
        "---\ncitekey: w", F.col("work_id").cast("string"), "\ndoi: ", "@doi", "\ntags: [review, bone]\npmid: '", F.col("work_id").cast("string"), "'\n---\n> [!Info]\n> **FirstAuthor**:: Doe, J\n> **Author**:: Roe, K\n> **Title**: ",
        "@title", "\n> **Year**: ", "@year", "\n> **Journal**: *", "@journal", "*\n> **Volume**: 7\n> **Issue**: 2\n> **DOI**: ", "@doi", "\n\n> [!Abstract]\n> In short ", "@title", "\n\n# 4 Main Text\n\n", *main,
    )


_MAIN = ("Lead about ", "@title", "\n\n## Patients and Methods\n\nWe took ", "@year", "\n\n### Subjects\n\nFirst ", "@title", "\n\nSecond\n\n#### Deep\n\nThird\n\n## Results\n\nSeen in ", "@journal", "\n\n## References\n\n1. Entry ", "@doi", "\n\n#tag\nAfter")


def _notes(t, main: tuple[str | Column, ...] = _MAIN) -> DataFrame:
    return _rows(t).select("work_id", "title", "journal", "year", "doi", F.concat(F.col("work_id").cast("string"), F.lit(".md")).alias("path"), F.col("work_id").cast("string").alias("stem"), _note(main).alias("content"))


@_query(f"""WITH {_ROWS} SELECT CAST(work_id AS VARCHAR) || '.md' AS path, 'w' || work_id AS citekey, title, 'Doe, J|Roe, K' AS authors, year AS published, journal AS source, '7' AS volume, '2' AS issue, doi,
    'review|bone' AS tags, CAST(work_id AS VARCHAR) AS pmid, true AS is_review, true AS ok, work_id || '.md' AS filename FROM w""")
def note_articles(t):
    a = P.articles_from_notes(_notes(t))
    return a.select("path", "citekey", "title", F.array_join("authors", "|").alias("authors"), "published", "source", "volume", "issue", "doi", F.array_join("tags", "|").alias("tags"), "pmid", "is_review", "ok", "filename")


_NOTE_SECTIONS = """SELECT work_id, 'Introduction' AS title, 'intro' AS type, 'Lead about ' || title AS content, '' AS subs FROM w
    UNION ALL SELECT work_id, 'Patients and Methods', 'materials|methods', 'We took ' || year, 'Subjects=First ' || title || chr(10) || chr(10) || 'Second' || chr(10) || chr(10) || '#### Deep' || chr(10) || chr(10) || 'Third' FROM w
    UNION ALL SELECT work_id, 'Results', 'results', 'Seen in ' || journal, '' FROM w
    UNION ALL SELECT work_id, 'References', 'references', '1. Entry ' || doi, '' FROM w"""


@_query(f"WITH {_ROWS} {_NOTE_SECTIONS}")
def note_sections(t):
    main = T.main_text(F.col("content"))
    s = _notes(t).select("work_id", F.explode(M.sections(main, F.lit(False))).alias("s"))
    subs = F.array_join(F.transform("s.subsections", lambda u: F.concat_ws("=", u["title"], u["content"])), ";")
    return s.select("work_id", "s.title", "s.type", "s.content", subs.alias("subs"))


@_query(f"""WITH {_ROWS} SELECT work_id, 'Main' || chr(10) || 'Part 1.' || chr(10) || title || chr(10) || chr(10) || 'Other' || chr(10) || year AS merged FROM w""")
def note_merged_headings(t):
    text = _text("### Main\n\n#### Part 1\\.\n\n", "@title", "\n\n\n\n##### Other\n\n", "@year", "\n\n### Last\n")
    return _rows(t).select("work_id", M.merge_headings(text).alias("merged"))


def _node_query(form: str):
    how = M.NODE_FORMS[form]
    head = "'### Subjects' || chr(10) || chr(10) || " if how["heading"] else ""
    label = "Subjects" if how["level"] == 3 else "Methods"
    image = "' ![x](y.png)'" if how["images"] else "' '"
    rows = []
    n = 0
    if how["lead"]:
        n += 1
        rows.append(("Methods", "## Methods", "1", "'We took ' || year"))
    if how["heading"]:
        rows += [(label, "## Methods > ### Subjects", "1", "'### Subjects'"), (label, "## Methods > ### Subjects", "2", f"'First ' || title || {image}"), (label, "## Methods > ### Subjects", "3", "'Second'")]
    else:
        rows += [(label, "## Methods > ### Subjects", "1", f"'First ' || title || {image}"), (label, "## Methods > ### Subjects", "2", "'Second'")]
    rows.append(("Results", "## Results", "1", "'Seen in ' || journal"))
    sql = " UNION ALL ".join(f"SELECT work_id, '{a}' AS section_name, '{b}' AS header_path, {c} AS paragraph_number, {d} AS text FROM w" for a, b, c, d in rows)

    def query(t):
        note = _text("Before\n\n## Methods\n\nWe took ", "@year", "\n\n### Subjects\n\nFirst ", "@title", " ![x](y.png)\n\n\nSecond\n\n## Results\n\nSeen in ", "@journal", "\n\n## References\n\n1. None\n")
        n = _rows(t).select("work_id", F.explode(M.nodes(note, form)).alias("n"))
        return n.select("work_id", "n.section_name", "n.header_path", "n.paragraph_number", "n.text")

    query.__name__ = f"note_nodes_{form}"
    _query(f"WITH {_ROWS} {sql}")(query)


for _form in M.NODE_FORMS:
    _node_query(_form)


@_query(f"""WITH {_ROWS} SELECT work_id, '1\\. ' || title AS item FROM w UNION ALL SELECT work_id, '2. ' || journal FROM w UNION ALL SELECT work_id, '[3] ' || year FROM w""")
def note_reference_items(t):
    text = _text("## References\n- 1\\. ", "@title", "\r\n- [2. ", "@journal", "](https://example.org/", "@doi", ")\n[3] ", "@year", "\n- no entry\n")
    return _rows(t).select("work_id", F.explode(M.reference_items(text, bracketed=True)).alias("item"))


@_query(f"""WITH {_ROWS} SELECT work_id, 'Own ' || title AS paragraph FROM w UNION ALL SELECT work_id, 'Last ' || year FROM w""")
def note_paragraphs_without_tables(t):
    text = _text("Own ", "@title", "\n\n**Table 1** Shape\n\n<table>", "@year", "</table>\n\nLegend\n\nLast ", "@year")
    return _rows(t).select("work_id", F.explode(M.without_tables(T.paragraphs(text))).alias("paragraph"))


@_query(f"""WITH {_ROWS} SELECT work_id, '# 4 Main Text' || chr(10) || chr(10) || chr(10) || '## Introduction' || chr(10) || chr(10) || 'Lead ' || title || chr(10) || chr(10) || '## Results' || chr(10) || chr(10) || year || chr(10) || chr(10)
    || chr(10) || '## Keywords' || chr(10) || chr(10) || 'bone, ' || journal || chr(10) || chr(10) || '## References' || chr(10) AS note, true AS intro, true AS keywords FROM w""")
def note_updates(t):
    text = _text("# 4 Main Text\n\nLead ", "@title", "\n\n## Results\n\n", "@year", "\n\n## References\n")
    return _rows(t).select("work_id", M.updated_note(text, F.array(F.lit("bone"), F.col("journal"))).alias("u")).select("work_id", "u.note", "u.intro", "u.keywords")


@_query(f"""WITH {_ROWS} SELECT work_id, 'In short ' || title AS abstract, title AS main, title AS answer, 'bone, ' || year AS keywords, year || ' **' || title || '**' AS marked FROM w""")
def note_parts(t):
    n = _notes(t, ("@title",)).withColumn("reply", _text("ANSWER: ", "@title", "\nKEYWORDS: bone, ", "@year"))
    marked = F.replace(_text("@year", " ", "@title"), F.col("title"), F.concat(F.lit("**"), F.col("title"), F.lit("**")))
    return n.select("work_id", T.abstract_callout(F.col("content")).alias("abstract"), T.main_text(F.col("content")).alias("main"), T.answer_part(F.col("reply")).alias("answer"), T.keyword_part(F.col("reply")).alias("keywords"), marked.alias("marked"))


@_query(f"""WITH {_ROWS} SELECT work_id, 'w' || work_id AS citekey, doi, 'review|bone' AS tags FROM w""")
def note_front_matter(t):
    f = _notes(t).select("work_id", M.front_matter(F.col("content")).alias("f"))
    return f.select("work_id", "f.citekey", "f.doi", F.array_join("f.tags", "|").alias("tags"))


# --- references and services ------------------------------------------------------------------------------------------------------


@_query(f"""WITH {_ROWS} SELECT work_id, 'https://doi.org/' || doi AS href, '[' || (work_id % 9 + 1) || '] About ' || year AS label FROM w""")
def reference_link_kinds(t):
    r = _rows(t).select("work_id", "year", F.explode(F.array(_text("https://doi.org/", "@doi"), F.lit("https://example.org/doi/suppl/x.docx"))).alias("href"))
    kept = r.where(~R.supplementary(F.col("href")))
    return kept.select("work_id", "href", _text("[", (F.pmod("work_id", F.lit(9)) + 1).cast("string"), "] About ", "@year").alias("label"))


@_query("""SELECT article_id, coalesce(max_year, 0) AS newest, n FROM (SELECT a.article_id, max(TRY_CAST(w.pub_year AS INT)) AS max_year, count(w.work_id) AS n FROM articles a LEFT JOIN works w ON lower(w.doi) = lower(a.doi) GROUP BY 1)""")
def article_work_years(t):
    w = t("works").where("doi IS NOT NULL").select(F.lower("doi").alias("k"), F.col("pub_year").try_cast("int").alias("y"), "work_id")
    a = t("articles").select("article_id", F.lower("doi").alias("k")).join(w, "k", "left").groupBy("article_id")
    return a.agg(F.coalesce(F.max("y"), F.lit(0)).alias("newest"), F.count("work_id").alias("n"))


# --- smaller steps ----------------------------------------------------------------------------------------------------------------


@_query(f"""WITH {_ROWS}, p AS (SELECT work_id, unnest(['Own ' || title, 'Last ' || year]) AS paragraph, unnest([1, 3]) AS paragraph_index FROM w) SELECT work_id, paragraph, paragraph_index, 3 AS total_paragraphs FROM p""")
def paragraphs_past_tables(t):
    rows = _rows(t).select("work_id", _text("Own ", "@title", "\n\n<table><tr>", "@year", "</tr></table>\n\nLast ", "@year").alias("content"))
    return C.indexed_paragraphs(rows).select("work_id", "paragraph", "paragraph_index", "total_paragraphs")


_SECTIONS_SQL = "SELECT * FROM (SELECT article_id, unnest(sections) AS s, generate_subscripts(sections, 1) AS section_no FROM articles) WHERE s IS NOT NULL"


@_query(f"""SELECT article_id, CAST(section_no AS INT) AS section_no, s.section_type AS section_type FROM ({_SECTIONS_SQL})
    WHERE s.section_type IN ('intro', 'materials|methods', 'results', 'discussion', 'conclusion')""")
def target_sections(t):
    return C.target_sections(C.sections(t("articles"))).select("article_id", "section_no", "section_type")


@_query(f"""SELECT article_id, CAST(section_no AS INT) AS section_no FROM ({_SECTIONS_SQL}) QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY section_no) <= 2""")
def section_preview(t):
    return C.preview(C.sections(t("articles")), ["article_id"], ["section_no"], 2).select("article_id", "section_no")


@_query("SELECT ref_id, set_id FROM reference_records QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY ref_index NULLS FIRST, ref_id) <= 20")
def candidate_clamp(t):
    return E.clamped_candidates(t("reference_records"), 20, "set_id", ["ref_index", "ref_id"]).select("ref_id", "set_id")


@_query("SELECT work_id, coalesce(trim(publisher) = 'Springer Science and Business Media LLC', false) AS linked FROM works")
def publisher_gate(t):
    return t("works").select("work_id", R.of_linked_publisher(F.col("publisher")).alias("linked"))


@_query(f"""WITH {_ROWS} SELECT work_id, title AS name, 'a|1. ' || journal || '|[2] ' || year AS items FROM w""")
def note_section_names(t):
    part = _text("Lead\n\n##  ", "@title", " \n\ntext\n\n## References\n- 1. ", "@journal", "\n[2] ", "@year", "\n")
    return _rows(t).select("work_id", M.section_name(part).alias("name"), F.array_join(M.with_reference_items(F.array(F.lit("a")), part), "|").alias("items"))


@_query(f"""WITH {_ROWS} SELECT work_id, '{{"a":"x & <' || title || '","b":[{{"c":"é"}},1,null]}}' AS decoded FROM w""")
def decoded_json(t):
    text = _text('{"a": "x &amp; &lt;', "@title", '", "b": [{"c": "&#233;"}, 1, null]}')
    return _rows(t).select("work_id", H.json_decoded(text).alias("decoded"))


@_query(f"""WITH {_ROWS} SELECT work_id || '.md' AS filename, CASE WHEN work_id % 3 = 0 THEN '' ELSE 'w' || work_id END AS citekey, CASE WHEN work_id % 3 = 0 THEN '' ELSE doi END AS doi,
    'In short ' || title AS abstract, CASE WHEN work_id % 3 = 0 THEN 'no front matter in ' || work_id || '.md' END AS error FROM w""")
def abstract_export(t):
    n = _notes(t)
    bare = F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n", "")
    return P.abstract_export(n.withColumn("content", F.when(F.col("work_id") % 3 == 0, bare).otherwise(F.col("content"))))


@_query("""WITH a AS (SELECT article_id, citekey, filename, tags FROM articles), r AS (SELECT citekey, bool_or(is_review) AS f FROM articles WHERE article_id % 2 = 0 GROUP BY 1)
    SELECT article_id, coalesce(r.f, len(list_filter(tags, lambda x: lower(x) = 'review')) > 0, false) AS is_review FROM a LEFT JOIN r ON r.citekey = coalesce(nullif(a.citekey, ''), a.filename)""")
def review_flags(t):
    a = t("articles")
    return E.review_flags(a.select("article_id", "citekey", "filename", "tags"), a.where("article_id % 2 = 0").select("citekey", F.col("is_review").alias("review")), stem="filename").select("article_id", "is_review")


@_query("""WITH x AS (SELECT a.ref_id, b.work_id AS pmid, row_number() OVER (PARTITION BY a.ref_id ORDER BY b.work_id) AS rank FROM reference_records a JOIN works b ON lower(a.pubmed.title) = lower(b.title)),
    y AS (SELECT a.ref_id, b.work_id AS pmid FROM reference_records a JOIN works b ON a.pubmed.pub_year = b.pub_year AND lower(a.pubmed.title) = lower(b.title))
    SELECT ref_id, min_by(pmid, rank + CASE WHEN EXISTS (SELECT 1 FROM y WHERE y.ref_id = x.ref_id AND y.pmid = x.pmid) THEN 0 ELSE 1000000 END) AS pmid FROM x GROUP BY 1""")
def chosen_hits(t):
    from pyspark.sql import Window

    r = t("reference_records").select("ref_id", F.lower("pubmed.title").alias("k"), F.col("pubmed.pub_year").alias("y"))
    w = t("works").select(F.col("work_id").alias("pmid"), F.lower("title").alias("k"), "pub_year")
    both = r.join(w, "k")
    titles = both.select("ref_id", "pmid", F.row_number().over(Window.partitionBy("ref_id").orderBy("pmid")).alias("rank"))
    return E.chosen_hit(titles, both.where("y = pub_year").select("ref_id", "pmid"), ["ref_id"])


@_query("""WITH k AS (SELECT lower(doi) AS d, min(pmid) AS p FROM works WHERE pmid IS NOT NULL AND doi IS NOT NULL GROUP BY 1) SELECT ref_id, coalesce(nullif(pmid, ''), k.p, '') AS pmid FROM reference_records LEFT JOIN k ON k.d = lower(doi)""")
def looked_up_ids(t):
    return E.looked_up(t("reference_records").select("ref_id", "doi", "pmid"), t("works").select("doi", "pmid")).select("ref_id", F.coalesce("pmid", F.lit("")).alias("pmid"))


@_query("""WITH r AS (SELECT ref_id, pubmed, CASE WHEN ref_id % 2 = 0 THEN 'From the first ' || ref_id ELSE '' END AS c, 'From the second ' || ref_id AS e FROM reference_records)
    SELECT ref_id, CASE WHEN coalesce(pubmed.abstract, '') <> '' THEN pubmed.abstract WHEN c <> '' THEN c ELSE e END AS abstract,
    CASE WHEN coalesce(pubmed.abstract, '') <> '' THEN pubmed.source WHEN c <> '' THEN 'crossref' ELSE 'europepmc' END AS source FROM r""")
def decided_entries(t):
    r = t("reference_records")
    kind = r.schema["pubmed"].dataType
    entry = lambda source, abstract: F.from_json(F.to_json(F.struct(F.lit(source).alias("source"), abstract.alias("abstract"))), kind)
    number = F.col("ref_id").cast("string")
    first = entry("crossref", F.when(F.col("ref_id") % 2 == 0, F.concat(F.lit("From the first "), number)).otherwise(""))
    chosen = E.decided_pubmed(F.col("pubmed"), first, entry("europepmc", F.concat(F.lit("From the second "), number)))
    return r.select("ref_id", chosen.alias("p")).select("ref_id", "p.abstract", "p.source")


@_query("""WITH t AS (SELECT set_id, ref_index, ref_id, pubmed.title AS title, text FROM reference_records WHERE pubmed.title IS NOT NULL)
    SELECT ref_id, true AS chosen FROM (SELECT ref_id, len(list_filter(k, lambda w: contains(lower(text), w))) / nullif(len(k), 0) AS o FROM (SELECT *, {tokens} AS k FROM t)) WHERE o >= 0.6""".replace(
    "{tokens}", "list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in R.TITLE_STOPWORDS) + "], w))"))
def title_candidates(t):
    r = t("reference_records").where("pubmed.title IS NOT NULL").select("ref_id", "text", F.col("pubmed.title").alias("title"), F.lit(1).alias("o"))
    return E.title_candidate(r, ["ref_id"], "title", "text", "o").select("ref_id", F.lit(True).alias("chosen"))


@_query(f"""WITH {_ROWS} SELECT work_id, coalesce(nullif(CASE WHEN work_id % 2 = 0 THEN doi ELSE '' END, ''), 'note') AS doi, work_id % 2 = 0 AS review FROM w""")
def merged_note_fields(t):
    even = F.col("work_id") % 2 == 0
    m = E.merged_fields({"doi": F.lit("note")}, {"doi": F.when(even, F.col("doi")).otherwise(""), "review": F.when(even, True)})
    return _rows(t).select("work_id", *(c.alias(n) for n, c in m.items()))


@_query(f"""WITH {_ROWS} SELECT work_id, 'Results' AS title, 'results' AS type, 'Seen in ' || title || chr(10) || chr(10) || 'Also ' || year AS content FROM w
    UNION ALL SELECT work_id, 'Abstract', 'abstract', 'In short ' || journal FROM w""")
def ruled_page_sections(t):
    page = _text('<html><body><article><div class="abstract author">Abstract In short ', "@journal", '</div><section><h2>Highlights</h2><p>None</p></section><section><h2>Results</h2><p>Seen in ', "@title",
                 "</p><div><p>Also ", "@year", "</p></div><p>Seen in ", "@title", '</p></section><section><h2>References</h2><p>None</p></section></article></body></html>')
    r = _rows(t).select("work_id", F.explode(G.sections_by_rule({})(page, F.lit("any"))).alias("s"))
    return r.select("work_id", "s.title", "s.type", "s.content")


@_query(f"""WITH {_ROWS} SELECT work_id, 'Figure 2' AS title, 'Shape of ' || title AS legend, 'Figure_2.png' AS file FROM w""")
def page_figure_files(t):
    page = _text('<html><body><figure id="fig2"><img src="/a/b.png"><div class="captions"><span class="label">Fig. 2</span>. Shape of ', "@title", "</div></figure><figure><img src='x'></figure></body></html>")
    f = _rows(t).select("work_id", F.explode(G.page_figures(page)).alias("f")).select("work_id", "f.title", "f.legend", "f.src")
    return f.select("work_id", "title", F.regexp_replace("legend", r"^\.\s*", "").alias("legend"), G.figure_file(F.col("title"), F.col("src"), F.lit("")).alias("file"))


@_query(f"""WITH {_ROWS} SELECT work_id, 'Figure 1' AS title, 'u' || work_id AS image_url, title AS legend, 1 AS place FROM w""")
def distinct_figures(t):
    content = _text("[Image URL: u", F.col("work_id").cast("string"), "] ", "@title")
    one = F.struct(F.lit("Figure 1").alias("title"), F.lit("figure").alias("type"), content.alias("content"), F.array(F.struct(F.lit("Figure 1").alias("title"), content.alias("content"))).alias("subsections"))
    text = F.struct(F.lit("Results").alias("title"), F.lit("results").alias("type"), F.lit("x").alias("content"), F.array().cast("array<struct<title:string,content:string>>").alias("subsections"))
    return G.collected_figures(_rows(t).select("work_id", F.array(text, one, one).alias("sections")), "work_id")
