"""Queries of the literature operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papergrid.functions import html as H
from papergrid.functions import markdown as M
from papergrid.functions import pages as G_
from papergrid.functions import references as R
from papergrid.functions import text as T
from papergrid.functions import xml as X
from papergrid.operators import chunks as C
from papergrid.operators import enrich as E
from papergrid.operators import search as S
from papergrid.operators import stats as G
from papergrid.plans import pipeline as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: White space of Unicode in the oracle's regular expressions.
_WS = r"[\t-\r\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _gone(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, '{pattern}', {by}, 'g')"


def _parts(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10) || chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"


def _kept(x: str) -> str:
    return f"list_filter({_parts(x)}, lambda x: NOT contains(lower(x), 'references') AND NOT contains(lower(x), 'cited by'))"



def _type_case(title: str, rules: str) -> str:
    low = f"lower(coalesce({title}, ''))"
    if rules == "html":
        low = f"trim(regexp_replace({low}, ':$', ''))"
    test = lambda p: f"{low} = '{p[1:]}'" if p[0] == "=" else f"regexp_matches({low}, '{p}')" if p[0] == "^" else f"contains({low}, '{p}')"
    lines = " ".join(f"WHEN {' OR '.join(map(test, parts))} THEN '{name}'" for name, parts in T.SECTION_RULES[rules])
    return f"CASE {lines} ELSE '{'review' if rules == 'review' else 'other'}' END"


_SECTIONS = """s AS (SELECT * FROM (SELECT article_id, is_review, tags, unnest(sections) AS s, generate_subscripts(sections, 1) AS section_no FROM articles) WHERE s IS NOT NULL)"""


# --- search -----------------------------------------------------------------------------------------------------------------------


def _asked(vectors: DataFrame, key: str, vector: str) -> list[float]:
    """The query: the vector of the smallest key. One row reaches the driver."""
    return list(vectors.where(F.size(vector) > 0).orderBy(key).select(vector).first()[0])


_COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[]))"
_Q = "q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)"


@_query(f"""WITH {_Q}, t AS (SELECT vec_id, label, round({_COSINE}, 6) AS score FROM embeddings e, q),
    k AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM t)
    SELECT vec_id, label, score, CAST(rank AS INT) AS rank, d.lang FROM k LEFT JOIN documents d ON d.doc_id = vec_id WHERE rank <= 5""")
def topk_cosine(t):
    e = t("embeddings")
    scored = e.select("vec_id", "label", F.round(S.cosine(F.col("embedding"), _asked(e, "vec_id", "embedding")), 6).alias("score"))
    hits = S.top_k(scored, 5, ties="vec_id")
    # Five ids go to the documents, so neither these nor their shuffle grows; the left join is then small on both sides.
    known = t("documents").select(F.col("doc_id").alias("vec_id"), "lang").join(F.broadcast(hits.select("vec_id")), "vec_id", "left_semi")
    return hits.join(known, "vec_id", "left")


def _filtered(condition: str, sql: str):
    def query(t):
        e = t("embeddings").withColumn("parity", F.pmod("vec_id", F.lit(10)))
        hits = S.search(e, _asked(e, "vec_id", "embedding"), 20, {"label": [1, 2], "parity": [3, 4, 5]}, condition, ties="vec_id")
        return hits.select("vec_id", F.round("score", 6).alias("score"), "rank")

    query.__name__ = f"topk_filtered_{condition}"
    test = f"label IN (1, 2) {sql} vec_id % 10 IN (3, 4, 5)"
    _query(f"""WITH {_Q}, t AS (SELECT vec_id, {_COSINE} AS score FROM embeddings e, q WHERE {test})
        SELECT vec_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM t QUALIFY rank <= 20""")(query)


_filtered("or", "OR")
_filtered("and", "AND")


@_query(f"""WITH {_Q} SELECT label, round(max({_COSINE}), 6) AS score, CAST(row_number() OVER (ORDER BY max({_COSINE}) DESC, label) AS INT) AS rank
    FROM embeddings e, q GROUP BY label QUALIFY rank <= 5""")
def group_max_topk(t):
    e = t("embeddings")
    best = S.best_per_group(e.withColumn("score", S.cosine(F.col("embedding"), _asked(e, "vec_id", "embedding"))), "label")
    return S.top_k(best, 5, ties="label").withColumn("score", F.round("score", 6))


@_query("""WITH u AS (SELECT DISTINCT vec_id, set_id, ref_index, embedding FROM ref_chunks WHERE len(embedding) > 0),
    q AS (SELECT embedding AS v FROM u ORDER BY vec_id LIMIT 1),
    sc AS (SELECT set_id, ref_index, max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[]))) AS score FROM u, q
        WHERE len(embedding) = len(q.v) AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0
        GROUP BY 1, 2),
    known AS (SELECT * FROM reference_records WHERE length(trim(pubmed.abstract)) > 0),
    b AS (SELECT *, row_number() OVER (ORDER BY score DESC, set_id, ref_index) AS rank FROM sc
        WHERE EXISTS (SELECT 1 FROM known k WHERE k.set_id = sc.set_id AND k.ref_index = sc.ref_index))
    SELECT k.ref_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM b JOIN known k ON k.set_id = b.set_id AND k.ref_index = b.ref_index WHERE rank <= 20""")
def reference_search(t):
    c = t("ref_chunks").where("set_id IS NOT NULL AND ref_index IS NOT NULL")
    usable = c.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    hits = S.search_references(usable, t("reference_records"), _asked(c, "vec_id", "embedding"), 20)
    return hits.select("ref_id", F.round("score", 6).alias("score"), "rank")


@_query(f"""WITH {_Q}, t AS (SELECT vec_id, CASE WHEN label < 5 THEN 'main_article' ELSE 'reference' END AS scope, {_COSINE} AS score FROM embeddings e, q),
    k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, vec_id) AS r FROM t)
    SELECT vec_id, scope, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, scope, vec_id) AS INT) AS rank FROM k WHERE r <= 5""")
def integrated_rank(t):
    e = t("embeddings")
    scored = e.select("vec_id", "label", S.cosine(F.col("embedding"), _asked(e, "vec_id", "embedding")).alias("score"))
    side = lambda test: S.top_k(scored.where(test), 5, ties="vec_id").drop("rank", "label")
    return S.integrated(side("label < 5"), side("label >= 5"), 5, ties="vec_id").withColumn("score", F.round("score", 6))


@_query("""SELECT doc_id FROM documents WHERE section_type = 'results'""")
def section_filter(t):
    return S.with_fallback(t("documents").select("doc_id", "section_type"), F.col("section_type") == "results").select("doc_id")


@_query("""SELECT doc_id FROM documents""")
def section_filter_fallback(t):
    return S.with_fallback(t("documents").select("doc_id", "section_type"), F.col("section_type") == "no such section").select("doc_id")


# --- sections and chunks ----------------------------------------------------------------------------------------------------------


@_query(f"""WITH {_SECTIONS} SELECT article_id, section_no, {", ".join(f"{_type_case('s.title', r)} AS type_{r}" for r in T.SECTION_RULES)} FROM s""")
def section_classify(t):
    return C.sections(t("articles")).select("article_id", "section_no", *(T.section_type(F.col("title"), r).alias(f"type_{r}") for r in T.SECTION_RULES))


@_query(f"""WITH {_SECTIONS} SELECT article_id, section_no, s.title AS title,
    regexp_replace(regexp_replace(s.content, '\\(https?://[^)]+\\)', '', 'g'), '<[^>]+>', '', 'g') AS content FROM s
    WHERE s.section_type NOT IN ('references', 'acknowledgements', 'abstract', 'cited_by')""")
def convert_sections(t):
    kept = C.sections(t("articles")).where(~F.col("section_type").isin(*T.EXCLUDED["convert"]))
    return kept.select("article_id", "section_no", "title", T.without_urls_and_tags(F.col("content")).alias("content"))


_REVIEW = "coalesce(is_review, list_contains(tags, 'review'), false)"
_GROUPS = f"""{_SECTIONS},
    k AS (SELECT *, {_REVIEW} AS review FROM s WHERE coalesce(s.section_type, 'unknown') NOT IN ('references', 'acknowledgements', 'abbreviations', 'keywords', 'other')),
    u AS (SELECT article_id, section_no, review, s, unnest(s.subsections) AS u, generate_subscripts(s.subsections, 1) AS no FROM k),
    g AS (SELECT article_id, section_no, review, s, 0 AS no, '' AS subsection, {_kept("s.content")} AS ps FROM k
        UNION ALL SELECT article_id, section_no, review, s, no, coalesce(u.title, 'Untitled'), {_kept("u.content")} FROM u),
    m AS (SELECT article_id, section_no, review, s, no, subsection, ps FROM g WHERE NOT review
        UNION ALL SELECT article_id, section_no, true, any_value(s), 0, '', flatten(list(ps ORDER BY no)) FROM g WHERE review GROUP BY article_id, section_no),
    c AS (SELECT article_id, CASE WHEN review THEN 'review' ELSE 'regular' END AS article_type, section_no, coalesce(s.title, 'Untitled') AS section,
        coalesce(s.section_type, 'unknown') AS section_type, no AS subsection_no, subsection, unnest(ps) AS text, generate_subscripts(ps, 1) AS paragraph_index, len(ps) AS total_paragraphs FROM m)"""
_CHUNK = ("article_id", "article_type", "section_no", "section", "section_type", "subsection_no", "subsection", "paragraph_index", "total_paragraphs", "text")


@_query(f"WITH {_GROUPS} SELECT {', '.join(_CHUNK)} FROM c")
def chunk_paragraphs(t):
    return C.chunks(t("articles")).select(*_CHUNK)


@_query(f"""WITH {_GROUPS} SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY section_no, subsection_no, paragraph_index) AS chunk_index,
    length(text) AS char_count FROM c""")
def chunk_export(t):
    return C.numbered(C.chunks(t("articles"))).select("article_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("char_count").cast("bigint").alias("char_count"))


@_query(f"""WITH {_SECTIONS}, k AS (SELECT *, {_REVIEW} AS review FROM s WHERE coalesce(s.section_type, 'unknown') NOT IN ('references', 'acknowledgements')),
    u AS (SELECT article_id, section_no, review, s, unnest(s.subsections) AS u, generate_subscripts(s.subsections, 1) AS no FROM k),
    g AS (SELECT article_id, section_no, review, 0 AS no, {_parts("s.content")} AS ps FROM k
        UNION ALL SELECT article_id, section_no, review, no, {_parts("u.content")} FROM u),
    m AS (SELECT article_id, section_no, no, ps FROM g WHERE NOT review UNION ALL SELECT article_id, section_no, 0, flatten(list(ps ORDER BY no)) FROM g WHERE review GROUP BY 1, 2)
    SELECT article_id, section_no, no AS subsection_no, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS paragraph_index FROM m""")
def chunk_prefilter_index(t):
    return C.chunks(t("articles"), "mac").select("article_id", "section_no", "subsection_no", "text", "paragraph_index")


@_query("""SELECT article_id, CASE WHEN trim(a || ' ' || y) <> '' THEN trim(CASE WHEN a = '' OR y = '' THEN a || y ELSE a || ' ' || y END) ELSE coalesce(citekey, '') END AS citation,
    a AS first_author, coalesce(array_to_string(authors, ', '), '') AS authors, coalesce(array_to_string(entrez_mesh_terms, ', '), '') AS mesh_terms FROM (
    SELECT *, coalesce(trim(string_split(authors[1], ',')[1]), '') AS a, coalesce(published, '') AS y FROM articles)""")
def citation_strings(t):
    a = t("articles")
    return a.select("article_id", T.citation(F.col("authors"), F.col("published"), F.col("citekey")).alias("citation"), T.first_author(F.col("authors")).alias("first_author"),
                    T.joined(F.col("authors")).alias("authors"), T.joined(F.col("entrez_mesh_terms")).alias("mesh_terms"))


@_query()
def markdown_sections(t):
    d = t("documents").select("doc_id", F.explode(M.sections(T.newlines(F.col("text")), F.lit(False))).alias("s"))
    return d.select("doc_id", "s.title", "s.type", F.char_length("s.content").alias("n_chars"), F.size("s.subsections").alias("subsections"))


@_query()
def header_nodes(t):
    d = t("documents").select("doc_id", F.explode(M.nodes(T.newlines(F.col("text")), "v2")).alias("n"))
    return d.select("doc_id", "n.*")


@_query()
def merged_headings(t):
    return t("documents").select("doc_id", M.merge_headings(T.newlines(F.col("text"))).alias("text"))


@_query(r"""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS p, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) AS i FROM documents WHERE text IS NOT NULL),
    m AS (SELECT *, regexp_matches(p, '^\s*\*\*[Tt]able\s+\d+') AS title FROM p),
    c AS (SELECT *, bool_or(title) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cut FROM m)
    SELECT doc_id, i AS place, p AS text FROM c WHERE NOT cut""")
def table_blocks_dropped(t):
    parts = F.transform(F.split("text", r"\n\s*\n"), lambda p, i: F.struct((i + 1).alias("place"), p.alias("text")))
    # The places of the kept ones are read off after the cut by carrying them with the text.
    d = t("documents").where("text IS NOT NULL").select("doc_id", parts.alias("ps"))
    rows = d.select("doc_id", F.posexplode("ps").alias("i", "p")).select("doc_id", "p.place", "p.text")
    title = F.col("text").rlike(r"\A\s*\*\*[Tt]able\s+\d+")
    w = Window.partitionBy("doc_id").orderBy("place").rowsBetween(-2, 0)
    return rows.withColumn("_cut", F.max(title.cast("int")).over(w)).where("_cut = 0").select("doc_id", "place", "text")


@_query(f"""WITH {_SECTIONS}, f AS (SELECT article_id, s.section_type AS section_type, min(section_no) AS first FROM s WHERE s.section_type IS NOT NULL GROUP BY 1, 2)
    SELECT article_id, section_type, CAST(row_number() OVER (PARTITION BY article_id ORDER BY first, section_type) AS INT) AS place FROM f""")
def first_seen_sections(t):
    return G.first_seen(C.sections(t("articles")).where("section_type IS NOT NULL"), "article_id", "section_type", "section_no")


@_query(f"""WITH {_SECTIONS}, m AS (SELECT article_id, section_no, s.title AS title, max(CASE WHEN s.section_type IN ('references', 'acknowledgements') THEN 1 ELSE 0 END)
    OVER (PARTITION BY article_id ORDER BY section_no) AS over FROM s) SELECT article_id, section_no, title FROM m WHERE over = 0""")
def sections_before_end(t):
    w = Window.partitionBy("article_id").orderBy("section_no")
    s = C.sections(t("articles"))
    return s.withColumn("_o", F.max(F.coalesce(F.col("section_type").isin("references", "acknowledgements"), F.lit(False)).cast("int")).over(w)).where("_o = 0").select("article_id", "section_no", "title")


_LINES = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)"""


def _lines(t) -> DataFrame:
    d = t("documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return d.select("doc_id", (F.col("p") + 1).alias("i"), "line")


@_query(rf"""WITH {_LINES}, h AS (SELECT *, CASE WHEN starts_with(line, '## ') THEN substr(line, 4) END AS head FROM l)
    SELECT doc_id, i, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h""")
def carried_headings(t):
    head = F.when(F.col("line").startswith("## "), F.substring("line", 4, 2**30))
    return _lines(t).select("doc_id", "i", F.last(head, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("i")).alias("section"))


@_query(rf"""WITH {_LINES}, m AS (SELECT *, regexp_matches(line, '^\s*(\[\d{{1,4}}\]|\d{{1,4}}[.)])\s+\S') AS s,
        regexp_matches(line, '^(Acknowledg|Funding|Author Contributions|Conflict|Supplementary|Figure|Table)') AS e FROM l),
    n AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS item FROM m),
    k AS (SELECT *, max(CASE WHEN item > 0 AND NOT s AND e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS over FROM n)
    SELECT doc_id, CAST(item AS BIGINT) AS item, string_agg(line, ' ' ORDER BY i) AS text FROM k WHERE item > 0 AND over = 0 GROUP BY 1, 2""")
def continued_references(t):
    starts = F.col("line").rlike(r"\A\s*(\[\d{1,4}\]|\d{1,4}[.)])\s+\S")
    stops = F.col("line").rlike(r"\A(Acknowledg|Funding|Author Contributions|Conflict|Supplementary|Figure|Table)")
    return G.continued(_lines(t), "doc_id", "i", "line", starts, stops)


@_query(f"""WITH {_SECTIONS}, a AS (SELECT article_id, flatten(list({_parts("s.content")})) AS ps FROM s WHERE s.section_type = 'abstract' GROUP BY 1),
    b AS (SELECT s.article_id, section_no, {_parts("s.content")} AS ps FROM s WHERE coalesce(s.section_type, '') <> 'abstract')
    SELECT b.article_id, section_no, CAST(len(list_filter(b.ps, lambda x: NOT list_contains(coalesce(a.ps, []), x))) AS INT) AS kept, CAST(len(list_distinct(b.ps)) AS INT) AS different
    FROM b LEFT JOIN a ON a.article_id = b.article_id""")
def paragraph_difference(t):
    s = C.sections(t("articles")).select("article_id", "section_no", "section_type", T.paragraphs(F.col("content")).alias("ps"))
    abstract = s.where("section_type = 'abstract'").groupBy("article_id").agg(F.flatten(F.collect_list("ps")).alias("known"))
    body = s.where(F.coalesce("section_type", F.lit("")) != "abstract").join(abstract, "article_id", "left")
    known = F.coalesce("known", F.array().cast("array<string>"))
    return body.select("article_id", "section_no", F.size(F.filter("ps", lambda p: ~F.array_contains(known, p))).alias("kept"), F.size(F.array_distinct("ps")).alias("different"))


# --- counts -----------------------------------------------------------------------------------------------------------------------


@_query(f"WITH {_SECTIONS} SELECT s.section_type AS section_type, count(*) AS n FROM s GROUP BY 1")
def type_distribution(t):
    return G.type_distribution(C.sections(t("articles")))


@_query(f"WITH {_GROUPS} SELECT section_type, count(*) AS n FROM c GROUP BY 1")
def chunk_distribution(t):
    return G.type_distribution(C.chunks(t("articles")))


@_query("SELECT substr(published, 1, 4) AS year, count(*) AS n FROM articles WHERE regexp_matches(substr(published, 1, 4), '^[0-9]{4}$') GROUP BY 1")
def year_distribution(t):
    return G.year_distribution(t("articles"))


@_query(f"""SELECT count(*) AS articles, CAST(count_if({_REVIEW}) AS BIGINT) AS reviews, CAST(sum(coalesce(len(sections), 0)) AS BIGINT) AS sections, round(avg(coalesce(len(sections), 0)), 1) AS mean_sections FROM articles""")
def corpus_totals(t):
    return G.corpus_totals(t("articles"))


@_query("""SELECT set_id, count(*) AS total, CAST(count_if(coalesce(pubmed_found, false)) AS BIGINT) AS pubmed_found, CAST(count_if(length(trim(coalesce(pubmed.abstract, ''))) > 0) AS BIGINT) AS abstract_found
    FROM reference_records GROUP BY set_id""")
def record_counters(t):
    return G.record_counters(t("reference_records"))


_ANY_REVIEW = "len(list_filter(pubmed.publication_types, lambda x: contains(lower(x), 'review') OR contains(lower(x), 'meta-analysis'))) > 0"


@_query(f"SELECT count(*) AS total, CAST(count_if(coalesce(pubmed_found, false)) AS BIGINT) AS pubmed_found, CAST(count_if(coalesce({_ANY_REVIEW}, false)) AS BIGINT) AS review_count FROM reference_records")
def enrichment_counters(t):
    return G.enrichment_counters(t("reference_records"), R.is_review_type(F.col("pubmed.publication_types")))


@_query("""SELECT citekey, CAST(count_if(n > 0) AS BIGINT) AS with_abstract, CAST(count_if(n = 0) AS BIGINT) AS without_abstract, round(avg(CASE WHEN n > 0 THEN n END), 2) AS mean_length
    FROM (SELECT citekey, length(trim(coalesce(pubmed.abstract, ''))) AS n FROM reference_records) GROUP BY citekey""")
def abstract_coverage(t):
    return G.abstract_coverage(t("reference_records"), "citekey")


@_query(r"""SELECT doc_id, len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]*\)')) AS figure_urls, len(regexp_extract_all(text, '\[\[[^\]]+\]\([^)]*\)\]')) AS ref_links,
    len(regexp_extract_all(text, '\n## ')) AS headings FROM documents WHERE text IS NOT NULL""")
def cleanup_counters(t):
    d = t("documents").where("text IS NOT NULL").select("doc_id", T.cleanup_counts(F.col("text")).alias("c"), G.heading_count(F.col("text")).alias("headings"))
    return d.select("doc_id", F.col("c.figure_urls").cast("bigint").alias("figure_urls"), F.col("c.ref_links").cast("bigint").alias("ref_links"), F.col("headings").cast("bigint").alias("headings"))


@_query(f"""WITH {_GROUPS}, n AS (SELECT section, subsection, count(*) AS n FROM c WHERE article_type = 'regular' GROUP BY ALL),
    p AS (SELECT section AS header_path, sum(CASE WHEN subsection = '' THEN n ELSE 0 END) AS own, sum(CASE WHEN subsection <> '' THEN n END) AS below, bool_or(subsection = '') AS has FROM n GROUP BY 1)
    SELECT header_path, CAST(own AS BIGINT) AS n, CAST(coalesce(below, own) AS BIGINT) AS total FROM p WHERE has
    UNION ALL SELECT section || ' > ' || subsection, CAST(sum(n) AS BIGINT), CAST(sum(n) AS BIGINT) FROM n WHERE subsection <> '' GROUP BY 1""")
def header_rollup(t):
    path = F.when(F.col("subsection") == "", F.col("section")).otherwise(F.concat_ws(" > ", "section", "subsection"))
    counts = C.chunks(t("articles")).where("article_type = 'regular'").groupBy(path.alias("header_path")).agg(F.count("*").alias("n"))
    return G.header_rollup(counts)


@_query("""SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def largest_part(t):
    return G.largest(t("documents").select("source", "doc_id", "n_chars"), "source", F.coalesce("n_chars", F.lit(0)), "doc_id")


@_query("""WITH r AS (SELECT DISTINCT set_id, ref_index FROM reference_records WHERE ref_index IS NOT NULL)
    SELECT set_id, ref_index, CAST(least(coalesce(lead(ref_index) OVER (PARTITION BY set_id ORDER BY ref_index), ref_index + 8), 1000) AS INT) AS stop FROM r""")
def mark_blocks(t):
    r = t("reference_records").where("ref_index IS NOT NULL").select("set_id", "ref_index").distinct()
    return G.blocks(r, "set_id", "ref_index", F.lit(1000), 8)


# --- joins ------------------------------------------------------------------------------------------------------------------------


@_query("""WITH e AS (SELECT citekey, max_by({'doi': doi, 'publisher': publisher}, article_id) AS v FROM articles GROUP BY citekey),
    f AS (SELECT lower(citekey) AS low, min_by(v, first) AS v FROM (SELECT e.citekey, e.v, min(article_id) AS first FROM e JOIN articles a ON a.citekey = e.citekey GROUP BY ALL) GROUP BY 1)
    SELECT d.doc_id, coalesce(e.v, f.v).doi AS doi, coalesce(e.v, f.v).publisher AS publisher, CASE WHEN e.v IS NOT NULL THEN 'exact' WHEN f.v IS NOT NULL THEN 'folded' END AS match
    FROM documents d LEFT JOIN e ON e.citekey = d.citekey LEFT JOIN f ON f.low = lower(d.citekey)""")
def enrich_notes(t):
    records = t("articles").select("citekey", "doi", "publisher", F.col("article_id").alias("ord")).where("citekey IS NOT NULL")
    return E.enrich(t("documents").select("doc_id", "citekey"), records, ["doi", "publisher"]).drop("citekey")


@_query("""WITH c AS (SELECT citekey, doi AS known FROM articles QUALIFY row_number() OVER (PARTITION BY citekey ORDER BY article_id) = 1)
    SELECT a.article_id, coalesce(c.citekey IS NOT NULL AND a.doi IS NOT DISTINCT FROM c.known, false) AS cached FROM articles a LEFT JOIN c ON c.citekey = a.citekey""")
def cache_hit_miss(t):
    a = t("articles").select("article_id", "citekey", "doi")
    cache = a.groupBy("citekey").agg(F.min_by(F.struct("doi"), "article_id").alias("v")).select("citekey", "v.doi")
    return E.split_by_cache(a, cache).select("article_id", "cached")


@_query("""WITH w AS (SELECT lower(doi) AS k, min(publisher) AS p FROM works WHERE doi IS NOT NULL GROUP BY 1)
    SELECT article_id, coalesce(nullif(publisher, ''), nullif(p, ''), '') AS publisher FROM articles LEFT JOIN w ON k = lower(doi)""")
def publisher_backfill(t):
    source = t("works").where("doi IS NOT NULL").groupBy(F.lower("doi").alias("k")).agg(F.min("publisher").alias("publisher"))
    return E.backfill(t("articles").select("article_id", "publisher", F.lower("doi").alias("k")), source, "k", "publisher").select("article_id", "publisher")


@_query(r"""WITH l AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\[\[(.*?)\]\]', 1)) AS link FROM documents), k AS (SELECT DISTINCT citekey FROM articles WHERE citekey IS NOT NULL)
    SELECT doc_id, link, k.citekey IS NOT NULL AS found FROM l LEFT JOIN k ON k.citekey = link""")
def link_check(t):
    return E.resolve_links(t("documents").select(F.col("doc_id").alias("path"), "text"), t("articles").where("citekey IS NOT NULL"), "text", "citekey").withColumnRenamed("path", "doc_id")


@_query(r"""WITH s AS (SELECT set_id, max(harvested_at) AS created_at FROM reference_records WHERE set_id IS NOT NULL GROUP BY 1),
    b AS (SELECT regexp_replace(set_id, '-\d+$', '') AS base, max_by(set_id, {'a': created_at, 'b': set_id}) AS set_id FROM s GROUP BY 1)
    SELECT DISTINCT citekey, b.set_id FROM articles JOIN b ON b.base = regexp_replace(citekey, '-\d+$', '')""")
def newest_set_match(t):
    sets = t("reference_records").where("set_id IS NOT NULL").groupBy("set_id").agg(F.max("harvested_at").alias("created_at"))
    return E.newest_set(t("articles"), sets)


_RECORD_KEY = "coalesce(nullif(pmid, ''), nullif(lower(doi), ''), substr(lower(coalesce(text, '')), 1, 100))"


@_query(f"""WITH k AS (SELECT *, {_RECORD_KEY} AS k, {{'a': ref_index, 'b': ref_id}} AS o FROM reference_records),
    f AS (SELECT * FROM k WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY set_id, k ORDER BY ref_index NULLS FIRST, ref_id) = 1)
    SELECT ref_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY ref_index NULLS FIRST, ref_id) AS INT) AS place FROM f""")
def dedupe_first(t):
    r = t("reference_records").select("ref_id", "set_id", F.struct("ref_index", "ref_id").alias("o"), "pmid", "doi", "text")
    return E.first_per_key(r, R.record_key(F.col("pmid"), F.col("doi"), F.col("text")), ["set_id"], "o").select("ref_id", "place")


_SUPPL = r"(?i)/doi/suppl/|/suppl_file/|supplementary-materials|core-supplementary-material|\.docx?\b|\.xlsx?\b|\.pptx?\b|\.zip\b"
_SCORE = r"""(CASE WHEN coalesce(pubmed.abstract, '') <> '' THEN 100 ELSE 0 END + CASE WHEN coalesce(pubmed.title, '') <> '' THEN 20 ELSE 0 END
    + CASE WHEN len(pubmed.authors) > 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(text, '') <> '' AND NOT regexp_matches(text, '(?i)^https?://') THEN 8 ELSE 0 END
    + CASE WHEN regexp_matches(href, '(?i)pubmed') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(href, '(?i)doi\.org|/doi/') THEN 2 ELSE 0 END
    - CASE WHEN coalesce(error_text, '') <> '' THEN 20 ELSE 0 END)"""


@_query(rf"""WITH k AS (SELECT ref_id, set_id, ref_index, {_SCORE} AS score, lower(coalesce(nullif(pubmed.doi, ''), nullif(doi, ''), '')) AS d,
        coalesce(nullif(pubmed.pmid, ''), nullif(pmid, ''), '') AS p, text FROM reference_records
        WHERE NOT regexp_matches(concat_ws(' ', href, doi, text), '{_SUPPL}') AND coalesce(lower(trim(text)) NOT IN ('skip to main content', 'search this journal'), true)),
    t AS (SELECT *, CASE WHEN p <> '' THEN 'pmid:' || p WHEN d <> '' THEN 'doi:' || d ELSE 'text:' || substr(lower(coalesce(text, '')), 1, 120) END AS k FROM k),
    b AS (SELECT *, row_number() OVER (PARTITION BY set_id, k ORDER BY score DESC, ref_index NULLS FIRST, ref_id) AS r,
        first_value({{'o': coalesce(ref_index, -1), 't': ref_id}}) OVER (PARTITION BY set_id, k ORDER BY ref_index NULLS FIRST, ref_id) AS pos FROM t)
    SELECT ref_id, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY set_id ORDER BY pos.o, pos.t) AS INT) AS place FROM b WHERE r = 1""")
def dedupe_best(t):
    return E.best_records(t("reference_records")).select("ref_id", "score", "place")


@_query("""SELECT article_id, CASE WHEN n = 1 THEN citekey ELSE citekey || '-' || n END AS unique_id
    FROM (SELECT article_id, citekey, row_number() OVER (PARTITION BY citekey ORDER BY article_id) AS n FROM articles WHERE citekey IS NOT NULL)""")
def unique_names(t):
    from papergrid.sources.files import named_apart

    return named_apart(t("articles").where("citekey IS NOT NULL").select("article_id", "citekey"), "citekey", "article_id").select("article_id", "unique_id")


# --- texts ------------------------------------------------------------------------------------------------------------------------


def _text_query(name: str, column, sql: str | None, table: str = "documents", key: str = "doc_id", text: str = "text", out: str = "result"):
    def query(t):
        return t(table).select(key, column(F.col(text)).alias(out))

    query.__name__ = name
    _query(f"SELECT {key}, {sql} AS {out} FROM {table}" if sql else None)(query)


_text_query("html_strip_tags", H.strip_tags_column, _squeeze(_gone(_gone(_gone("text", "(?is)<script.*?</script>", "' '"), "(?is)<style.*?</style>", "' '"), "<[^>]+>", "' '")))
_text_query("without_images", T.without_images, _gone("text", r"!\[[^\]]*\]\([^)]*\)"))
_text_query("cleaned_notes", T.cleaned_note, _gone(_gone("text", r"!\[[^\]]*\]\([^)]*\)[ \t\n\x0B\f\r]*"), r"[ \t\n\x0B\f\r]*\[\[[^\]]+\]\([^)]*\)\]"))
_text_query("unlinked_texts", T.without_links, _squeeze(_gone("text", r"\[[^\]]*\]\(https?://[^\)]+\)")))
_text_query("plain_newlines", T.newlines, _gone("text", r"\r\n?", "chr(10)"))
_text_query("japanese_texts", T.is_japanese, r"coalesce(regexp_matches(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]'), false)")
#: Hosts that stay are marked first, as the oracle's patterns can't look ahead.
_URLS = "regexp_replace(text, '(https?)://ars\\.', '\\1' || chr(1) || 'ars.', 'g')"
_URLS = _gone(_gone(_gone(_URLS, r"\[([^\]]*)\]\(https?://[^\s\x0B)]+\)", r"'[\1]()'"), r"https?://[^\s\x0B)""''<>]+"), r"\t?\[(?:" + "|".join(T.SERVICE_LABELS) + r")\]\(\)")
_text_query("removed_urls", T.without_web_addresses, f"replace({_URLS}, chr(1), '://')")
_LEGENDS = "text"
for _mark in (r"\*\*Figure \d+\*\*", r"!\[Figure [^\]]*\]\([^)]+\)", r"\[Full size image\]\([^)]+\)"):
    _LEGENDS = _gone(_LEGENDS, rf"({_mark})\n+", r"'\1' || chr(10)")
_text_query("compacted_legends", T.compact_legends, _LEGENDS)
_text_query("cleaned_reference_links", T.clean_reference_links, None)
_text_query("numbered_reference_lists", M.numbered_references, None)
#: The text is cut at numbered entities, each piece begins with its number; named ones follow.
_NUMBER = "CASE WHEN lower(left(n, 1)) = 'x' THEN CAST('0x' || substr(n, 2) AS BIGINT) ELSE CAST(n AS BIGINT) END"
_PIECE = f"""CASE WHEN i = 1 OR n = '' THEN p ELSE coalesce(CASE WHEN ({_NUMBER}) BETWEEN 1 AND 55295 OR ({_NUMBER}) BETWEEN 57344 AND 1114111 THEN chr(CAST({_NUMBER} AS INT)) END, '&#' || n || ';') || substr(p, length(n) + 2) END"""
_ENTITY = f"""array_to_string(list_transform(list_transform(string_split(regexp_replace(text, '(?i)&#(x[0-9a-f]+|[0-9]+);', chr(2) || '\\1;', 'g'), chr(2)), lambda p, i: {{'p': p, 'i': i, 'n': regexp_extract(p, '(?i)^(x[0-9a-f]+|[0-9]+);', 1)}}),
    lambda s: {_PIECE.replace(" n ", " s.n ").replace("(n,", "(s.n,").replace("(n AS", "(s.n AS").replace("(n)", "(s.n)").replace("THEN p ", "THEN s.p ").replace("substr(p,", "substr(s.p,").replace("WHEN i =", "WHEN s.i =")}), '')"""
for _name, _char in (("nbsp", " "), ("quot", '"'), ("apos", "\'\'"), ("lt", "<"), ("gt", ">")):
    _ENTITY = _gone(_ENTITY, f"(?i)&{_name};", f"'{_char}'")
_ENTITY = _gone(_ENTITY, "(?i)&amp;", "'&'")
_text_query("entity_decoded", H.entities_decoded, _ENTITY)
_text_query("sentence_windows", lambda c: F.size(C.sentences(c)), None)
_text_query("natural_order_keys", lambda c: F.array_join(T.natural_key(c), "|"), r"""array_to_string(list_transform(regexp_extract_all(lower(filename), '[0-9]+|[^0-9]+'),
    lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(regexp_replace(x, '^0+([0-9])', '\1'), 20, '0') ELSE x END), '|')""", "articles", "article_id", "filename")
_text_query("capital_keys", T.capital_key, rf"upper(substr({_strip('citekey')}, 1, 1)) || substr({_strip('citekey')}, 2)", "articles", "article_id", "citekey")
_text_query("stem_years", lambda c: F.concat_ws("|", T.stem_author(c), T.stem_year(c)),
            "CASE WHEN regexp_matches(citekey, '[0-9]{4}$') THEN left(citekey, length(citekey) - 4) || '|' || right(citekey, 4) ELSE concat_ws('|', citekey, 'N/A') END",
            "articles", "article_id", "citekey")
_text_query("reference_slugs", R.slug, r"coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(lower(source_url), 'https?://', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), ''), 'reference-set')",
            "reference_records", "ref_id", "source_url")
_DOI_SQL = r"regexp_replace(regexp_extract(text, '(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)', 1), '[)\].,;]+$', '')"
_text_query("reference_dois", R.doi, _DOI_SQL, "reference_records", "ref_id", "text")
_text_query("reference_pmids", R.pmid, r"coalesce(nullif(regexp_extract(text, '(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d+)', 1), ''), nullif(regexp_extract(text, '(?i)ncbi\.nlm\.nih\.gov/pubmed/(\d+)', 1), ''), nullif(regexp_extract(text, '(?i)\bPMID[:\s]+(\d{5,})\b', 1), ''), '')",
            "reference_records", "ref_id", "text")
_CLEAN_SQL = _squeeze(_gone("text", r"(?i)\b(?:" + "|".join(R.SERVICE_WORDS) + r")\b", "' '"))
_text_query("cleaned_references", R.clean_reference, _CLEAN_SQL, "reference_records", "ref_id", "text")
_text_query("supplementary_links", R.supplementary, f"regexp_matches(text, '{_SUPPL}')", "reference_records", "ref_id", "text")


def _tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in R.TITLE_STOPWORDS)
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains([{stop}], w))"


_text_query("title_tokens", lambda c: F.array_join(R.title_tokens(c), " "), f"array_to_string({_tokens('title')}, ' ')", "works", "work_id", "title")


@_query(f"""SELECT ref_id, round(len(list_filter(t, lambda w: contains(lower(text), w))) / nullif(len(t), 0), 6) AS overlap
    FROM (SELECT ref_id, text, {_tokens("pubmed.title")} AS t FROM reference_records WHERE pubmed.title IS NOT NULL)""")
def title_overlap(t):
    r = t("reference_records").where("pubmed.title IS NOT NULL")
    return r.select("ref_id", F.round(R.overlap(R.title_tokens(F.col("pubmed.title")), F.col("text")), 6).alias("overlap"))


@_query()
def reference_authors(t):
    r = t("reference_records").select("ref_id", R.author_year(F.col("text")).alias("a"), R.citation_title(F.col("text")).alias("title"))
    return r.select("ref_id", "a.author", "a.year", "title")


@_query(r"""WITH r AS (SELECT *, string_split(regexp_replace(text, '^\[\d+\]\s*', ''), '.') AS parts FROM reference_records)
    SELECT ref_id, CASE WHEN pubmed IS NOT NULL THEN coalesce(pubmed.authors[1], '') ELSE substr(trim(string_split(trim(parts[1]), ',')[1]), 1, 50) END AS authors,
    CASE WHEN pubmed IS NOT NULL THEN coalesce(pubmed.pub_year, '') ELSE coalesce(nullif(regexp_extract(text, '\((\d{4})\)', 1), ''), nullif(regexp_extract(text, '(\d{4})', 1), ''), '') END AS year,
    CASE WHEN pubmed IS NOT NULL THEN coalesce(pubmed.journal, '') ELSE substr(trim(coalesce(parts[2], '')), 1, 100) END AS journal,
    CASE WHEN pubmed IS NOT NULL THEN coalesce(pubmed.title, '') ELSE substr(trim(parts[1]), 1, 150) END AS title FROM r""")
def citation_infos(t):
    return t("reference_records").select("ref_id", R.citation_info(F.col("text"), F.col("pubmed")).alias("c")).select("ref_id", "c.*")


@_query(rf"""SELECT ref_id, {_SCORE} AS score, CASE WHEN pubmed IS NULL THEN 'metadata was not available' WHEN coalesce(pubmed.abstract, '') = '' THEN 'Abstract not found' END AS error,
    CASE WHEN len(list_filter(pubmed.publication_types, lambda x: contains(lower(x), 'review'))) > 0 THEN 'review'
        WHEN len(list_filter(pubmed.publication_types, lambda x: contains(lower(x), 'journal article'))) > 0 THEN 'original' ELSE 'other' END AS article_type FROM reference_records""")
def record_scores(t):
    r = t("reference_records")
    return r.select("ref_id", R.record_score(F.col("text"), F.col("href"), F.col("pubmed"), F.col("error_text")).alias("score"), E.record_error(F.col("pubmed")).alias("error"),
                    R.article_type(F.col("pubmed.publication_types")).alias("article_type"))


@_query(r"""SELECT ref_id, coalesce(nullif(regexp_extract(trim(regexp_replace(regexp_replace(coalesce(nullif(trim(string_split(coalesce(array_to_string(pubmed.authors, ', '), ''), ',')[1]), ''), 'Ref' || coalesce(CAST(ref_index AS VARCHAR), '')),
    '(?i)\bet\s+al\.?$', ''), '[^\p{L}\p{N}\s-]', '', 'g')), '^(\S+)', 1), ''), 'Ref' || coalesce(CAST(ref_index AS VARCHAR), '')) || coalesce(nullif(regexp_extract(coalesce(pubmed.pub_year, ''), '(\d{4})', 1), ''), 'n.d.') AS citation_label,
    coalesce(nullif(pubmed.doi, ''), nullif(doi, ''), '') AS doi FROM reference_records""")
def reference_hits(t):
    r = t("reference_records").withColumn("score", F.lit(1.0))
    return r.select("ref_id", *E.hit_source()).select("ref_id", "citation_label", "doi")


@_query(r"""SELECT work_id, CASE WHEN b <> '' THEN b ELSE 'Article' END AS base FROM (SELECT work_id, upper(substr(n, 1, 1)) || substr(n, 2) || coalesce(pub_year, '') AS b
    FROM (SELECT work_id, pub_year, regexp_replace(coalesce(CASE WHEN contains(a, ',') THEN string_split(a, ',')[1] ELSE string_split_regex(a, '\s+')[-1] END, ''), '[^A-Za-z0-9-]', '', 'g') AS n
    FROM (SELECT work_id, pub_year, trim(regexp_replace(regexp_replace(authors[1], '([a-z])([A-Z])', '\1 \2', 'g'), '(?i)\b(?:MD|PhD|MSc|FRCS|MBA|DO|DDS|DVM)\b\.?', '', 'g')) AS a FROM works)))""")
def citation_bases(t):
    w = t("works")
    author = F.try_element_at("authors", F.lit(1))
    return w.select("work_id", R.citation_base(author, F.col("pub_year"), F.lit("")).alias("base"))


@_query(r"""WITH g AS (SELECT doc_id, generate_subscripts(g, 1) AS i, unnest(g) AS g FROM (SELECT doc_id, regexp_extract_all(text, '\[(\d{1,4}(?:\s*[,;–—-]\s*\d{1,4})*)\]', 1) AS g FROM documents)),
    p AS (SELECT doc_id, i, generate_subscripts(string_split_regex(g, '\s*[,;]\s*'), 1) AS j, unnest(string_split_regex(g, '\s*[,;]\s*')) AS p FROM g),
    e AS (SELECT doc_id, i, j, list_transform(string_split_regex(p, '\s*[–—-]\s*'), lambda x: CAST(x AS INT)) AS e FROM p),
    n AS (SELECT DISTINCT doc_id, unnest(CASE WHEN e[1] <= e[-1] AND e[-1] - e[1] <= 200 THEN range(e[1], e[-1] + 1) ELSE [CAST(e[1] AS BIGINT), CAST(e[-1] AS BIGINT)] END) AS number FROM e)
    SELECT doc_id, CAST(number AS INT) AS number FROM n""")
def cited_numbers(t):
    return t("documents").select("doc_id", F.explode(R.cited_numbers(F.col("text"))).alias("number"))


@_query(r"""WITH g AS (SELECT DISTINCT doc_id, citekey, CAST(x AS INT) AS number FROM (SELECT doc_id, citekey, unnest(regexp_extract_all(text, '\[(\d{1,4})\]', 1)) AS x FROM documents)
        UNION SELECT doc_id, citekey, CAST(x AS INT) FROM (SELECT doc_id, citekey, unnest(string_split_regex(g, '\s*[,;]\s*')) AS x FROM (SELECT doc_id, citekey, unnest(regexp_extract_all(text, '\[(\d{1,4}(?:\s*[,;]\s*\d{1,4})*)\]', 1)) AS g FROM documents))),
    k AS (SELECT DISTINCT citekey, ref_index FROM reference_records)
    SELECT doc_id, number, hit FROM (SELECT doc_id, number, k.citekey IS NOT NULL AS hit, bool_or(k.citekey IS NOT NULL) OVER (PARTITION BY doc_id) AS any_hit
        FROM g LEFT JOIN k ON k.citekey = g.citekey AND k.ref_index = g.number) WHERE any_hit""")
def citation_hits(t):
    return E.linked_citations(t("documents"), t("reference_records"), "text", ["doc_id", "citekey"]).select("doc_id", "number", "hit")


@_query(r"""SELECT doc_id, coalesce(regexp_extract(text, '\*\*FirstAuthor\*\*::\s*([^>\n]+)', 1), '') AS first_author, coalesce(regexp_extract(text, '>\s*\*\*Year\*\*:\s*(\d+)', 1), '') AS year
    FROM documents WHERE regexp_matches(text, '^---\s*\r?\n') AND contains(text, '[!Info]')""")
def info_callouts(t):
    d = t("documents").where(F.col("text").rlike(r"\A---\s*\r?\n") & F.col("text").contains("[!Info]"))
    return d.select("doc_id", T.info_field(F.col("text"), "FirstAuthor").alias("first_author"), T.info_field(F.col("text"), "Year").alias("year"))


@_query(r"""SELECT doc_id, true AS found, trim(regexp_extract(text, '(?m)^citekey:[ \t]*([^\r\n]*)', 1)) AS citekey FROM documents WHERE regexp_matches(text, '^---[ \t]*\r?\n(?s:.*?)\r?\n---\s*\r?\n')""")
def front_matters(t):
    d = t("documents").select("doc_id", M.front_matter(F.coalesce("text", F.lit(""))).alias("f"))
    return d.where("f.found").select("doc_id", "f.found", "f.citekey")


@_query()
def html_articles(t):
    a = t("documents").select("doc_id", H.article_of(F.col("text"), F.lit("")).alias("a"))
    return C.html_items(a.select("doc_id", "a.sections"), ("doc_id",))


@_query()
def html_references(t):
    return t("documents").select("doc_id", F.explode(H.references_of(F.col("text"), F.lit(""))).alias("r")).select("doc_id", "r.*")


@_query()
def page_notes(t):
    a = t("documents").select("doc_id", H.article_of(F.col("text"), F.lit("")).alias("a"))
    return a.select("doc_id", G_.page_markdown(F.col("a.sections")).alias("markdown"))


@_query()
def page_sections_by_rule(t):
    run = G_.sections_by_rule({})
    return t("documents").select("doc_id", F.explode(run(F.col("text"), F.col("source"))).alias("s")).select("doc_id", "s.title", "s.type", "s.content")


@_query()
def page_figures(t):
    a = t("documents").select("doc_id", H.article_of(F.col("text"), F.lit("")).alias("a")).select("doc_id", "a.sections")
    return G_.collected_figures(a, "doc_id")


# --- payloads of services ---------------------------------------------------------------------------------------------------------


@_query("""SELECT ref_id, coalesce(pubmed.pmid, '') AS pmid, trim(regexp_replace(coalesce(pubmed.title, ''), '\\s+', ' ', 'g')) AS title, coalesce(pubmed.journal, '') AS journal, coalesce(pubmed.pub_year, '') AS year,
    array_to_string(coalesce(pubmed.mesh_terms, []), '|') AS mesh_terms FROM reference_records WHERE pubmed IS NOT NULL""")
def pubmed_xml(t):
    """Records written as the service's XML and read again; text is compared with its white space squeezed."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), clean(c), F.lit(f"</{name.split(' ')[0]}>"))
    p = lambda f: F.col(f"pubmed.{f}")
    terms = F.array_join(F.transform(F.filter(F.coalesce(p("mesh_terms"), F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda m: F.concat(F.lit("<MeshHeading>"), tag("DescriptorName", m), F.lit("</MeshHeading>"))), "")
    doc = F.concat(F.lit("<r><MedlineCitation>"), tag("PMID", p("pmid")), F.lit("<Journal>"), tag("Title", p("journal")), F.lit("<PubDate>"), tag("Year", p("pub_year")), F.lit("</PubDate></Journal>"),
                   tag("ArticleTitle", p("title")), terms, F.lit("</MedlineCitation></r>"))
    r = t("reference_records").where("pubmed IS NOT NULL").select("ref_id", X.pubmed_record(doc).alias("x"))
    return r.select("ref_id", "x.pmid", F.trim(F.regexp_replace("x.title", r"\s+", " ")).alias("title"), "x.journal", "x.year", F.array_join("x.mesh_terms", "|").alias("mesh_terms"))


@_query("""SELECT work_id, coalesce(doi, '') AS doi, coalesce(title, '') AS title, coalesce(journal, '') AS journal, coalesce(CAST(TRY_CAST(pub_year AS INT) AS VARCHAR), '') AS year, coalesce(publisher, '') AS publisher FROM works""")
def crossref_json(t):
    """Works written as the service's JSON and read again."""
    year = F.array(F.array(F.col("pub_year").try_cast("int")))
    message = F.struct(F.col("doi").alias("DOI"), F.array("title").alias("title"), "publisher", F.array("journal").alias("container-title"), F.struct(year.alias("date-parts")).alias("issued"))
    w = t("works").select("work_id", X.crossref_meta(F.to_json(F.struct(message.alias("message")))).alias("c"))
    return w.select("work_id", "c.doi", "c.title", "c.journal", "c.year", "c.publisher")


# --- pipelines --------------------------------------------------------------------------------------------------------------------


@_query()
def embedded_search(t):
    index = P.embed(C.chunks(t("articles")), 64)
    return P.search_text(index, "loss of perfusion in the kidney", 10, {"section_type": ["results", "discussion"]}).select("article_id", "section", "paragraph_index", F.round("score", 6).alias("score"), "rank")


@_query(f"""WITH {_Q}, t AS (SELECT vec_id, {_COSINE} AS score FROM embeddings e, q), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM t QUALIFY rank <= 5)
    SELECT 0 AS line_no, '# nearest to the first vector' AS line
    UNION ALL SELECT CAST(rank * 4 - 4 + i AS INT), CASE i WHEN 1 THEN '## ' || rank || '. vector ' || vec_id WHEN 2 THEN 'score: ' || printf('%.4f', score) ELSE '' END FROM k, range(1, 5) r(i)""")
def search_report(t):
    e = t("embeddings")
    hits = S.search(e, _asked(e, "vec_id", "embedding"), 5, ties="vec_id")
    return P.report_lines("nearest to the first vector", hits.select("rank", "score", F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("title"), F.lit("").alias("text")))


@_query(f"""WITH {_GROUPS}, n AS (SELECT article_id, count(*) AS chunks FROM c GROUP BY 1)
    SELECT a.article_id, CAST(coalesce(n.chunks, 0) AS BIGINT) AS chunks, (a.sections IS NOT NULL AND len(a.sections) > 0) AS ok FROM articles a LEFT JOIN n USING (article_id)""")
def import_status(t):
    return P.import_status(t("articles"))
