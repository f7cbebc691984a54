"""Queries of the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papergrid.llm import cooccurrence, encoding, knn, leakage, linkage, quality, splitting

DIMENSION = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return knn.usable(_table(spark, d, "ref_chunks"), "vec_id", "embedding", DIMENSION).unionByName(
        knn.usable_nested(_table(spark, d, "article_index"), "para_ids", "embeddings", DIMENSION)
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.neighbour_pairs(_vectors(spark, d), 10)


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(_table(spark, d, "reference_records"), _table(spark, d, "works"), _table(spark, d, "journals"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_links(spark, d).select("ref_id", "work_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.literature_pieces(_table(spark, d, "articles"), _table(spark, d, "reference_records"))
    return cut.where("piece_no = 1").select("src_table", "row_id", "section_no", "subsection_no")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.literature_pieces(_table(spark, d, "articles"), _table(spark, d, "reference_records"))


def p3_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for the pieces of every text."""
    of = lambda k: F.when(F.col("src_table") == "articles", splitting.CONTENT[k]).otherwise(splitting.ABSTRACT[k])
    return splitting.checked(p3_pieces(spark, d), ["src_table", "row_id", "section_no", "subsection_no"], of(0), of(1))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.pairs(cooccurrence.baskets(_table(spark, d, "articles"), "citekey", "entrez_mesh_terms", "entrez_keywords"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("term_a", "term_b")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(_table(spark, d, "documents"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return encoding.decode(encoding.encode(_table(spark, d, "documents"), "doc_id", "text"), "doc_id", "ids")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p8_found(spark, d), _table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_structure(spark: SparkSession, d: str) -> DataFrame:
    return quality.structure(_table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_structure(spark, d).where("no_prose > 0.5").select("doc_id")


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.counts(_table(spark, d, "documents"), "doc_id", "text")


def p9_language_counts(spark: SparkSession, d: str) -> DataFrame:
    """p9_counts with the common words of all languages, not of English alone."""
    return quality.counts(_table(spark, d, "documents"), "doc_id", "text", None)


def p9_profiles(spark: SparkSession, d: str) -> DataFrame:
    return quality.language_profiles(_table(spark, d, "documents"), "text", "lang")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return quality.languages(_table(spark, d, "documents"), "doc_id", "text", "lang")


def p1_exact(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, against all, without loss."""
    n = knn.exact(_vectors(spark, d), F.col("id") % 50 == 0)
    return n.select("id", F.col("place").cast("int").alias("place"), F.round("similarity", 6).alias("similarity"))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """(n_true, n_found, enough): how many of the exact neighbours of the vectors whose ids are divisible by 50 the graphs find, and whether that is nine in ten."""
    vectors = _vectors(spark, d)
    true = knn.exact(vectors, F.col("id") % 50 == 0).select("id", "other")
    found = knn.nearest(vectors).where(F.col("id") % 50 == 0).select("id", "other", F.lit(1).alias("hit"))
    counted = true.join(found, ["id", "other"], "left").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    return counted.select("n_true", (F.col("n_found") >= 0.9 * F.col("n_true")).alias("enough"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_exact, p1_recall, p2_found, p2_links, p3_found, p3_pieces, p3_checked, p6_found, p6_pairs, p7_ids, p7_roundtrip, p8_found, p8_report, p9_found, p9_structure, p9_counts, p9_language_counts, p9_profiles, p9_languages)
}

_COMMON = ", ".join(f"'{w}'" for w in sorted(set(quality.FUNCTION_WORDS["en"].split())))
_ALL_COMMON = ", ".join(f"'{w}'" for w in sorted({w for ws in (*quality.FUNCTION_WORDS.values(), quality.JAPANESE_WORDS) for w in ws.split()}))
_PAIRS = r"""
    WITH a AS (
        SELECT nfc_normalize(lower(regexp_replace(citekey, '^\s+|\s+$', '', 'g'))) AS key,
            list_concat(coalesce(entrez_mesh_terms, []), coalesce(entrez_keywords, [])) AS terms FROM articles),
    keyed AS (SELECT * FROM a WHERE key IS NOT NULL AND key <> ''),
    t AS (SELECT key, trim(regexp_replace(lower(unnest(terms)), '\s+', ' ', 'g')) AS term FROM keyed),
    b AS (SELECT DISTINCT key, term FROM t WHERE term IS NOT NULL AND term <> ''),
    n AS (SELECT count(DISTINCT key) AS n FROM keyed),
    c AS (SELECT term, count(*) AS n FROM b GROUP BY term),
    p AS (SELECT x.term AS term_a, y.term AS term_b, count(*) AS n_ab FROM b x JOIN b y ON x.key = y.key AND x.term < y.term GROUP BY 1, 2),
    r AS (SELECT term_a, term_b, ca.n AS n_a, cb.n AS n_b, n_ab, n.n AS n_baskets, round(n_ab * CAST(n.n AS DOUBLE) / (ca.n * cb.n), 6) AS lift
        FROM p JOIN c ca ON ca.term = term_a JOIN c cb ON cb.term = term_b CROSS JOIN n
        WHERE n_ab >= 4 AND 1000 * n_ab >= n.n AND n_ab * n.n >= 3 * ca.n * cb.n)
"""

_FUNCTION_WORDS = ", ".join(f"('{name}', '{w}')" for name, words in quality.FUNCTION_WORDS.items() for w in sorted(set(words.split())))
_NEAREST = """
    WITH c AS (SELECT vec_id AS id, embedding AS v FROM ref_chunks UNION ALL
        SELECT unnest(para_ids[1:least(len(para_ids), len(embeddings))]), unnest(embeddings[1:least(len(para_ids), len(embeddings))]) FROM article_index),
    u AS (SELECT id, CAST(min(v) AS DOUBLE[]) AS v FROM c WHERE id IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY id),
    p AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.id % 50 = 0 AND a.id <> b.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS place FROM p QUALIFY place <= 10)
"""

#: Compatibility forms that the texts have, for the oracle, whose engine has no NFKC: full-width signs, ligatures, small figures.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE) + "0123456789" * 2
_COMPAT = r"translate(regexp_replace(text, '[\x{AD}\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '" + _WIDE + "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉', '" + _NARROW.replace("'", "''") + "')"
for _a, _b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
    _COMPAT = f"replace({_COMPAT}, '{_a}', '{_b}')"
_ITEM_WORDS = f"regexp_extract_all(lower(nfc_normalize({_COMPAT})), " + r"'[\p{L}\p{N}]+')"
_LEAKS = f"""
    WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
    g AS (SELECT DISTINCT item_id, least(len(w), 12) AS k, list_slice(w, CAST(p AS BIGINT), CAST(p + least(len(w), 12) - 1 AS BIGINT)) AS gram FROM i, unnest(range(1, len(w) - least(len(w), 12) + 2)) t(p) WHERE len(w) > 0),
    h AS (SELECT item_id, k, array_to_string(gram, ' ') AS gram, gram[1] AS first FROM g),
    m AS (SELECT doc_id, p, w FROM (SELECT doc_id, w, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) WHERE x IN (SELECT first FROM h)),
    f AS (SELECT DISTINCT doc_id, item_id FROM m JOIN h ON h.first = m.w[m.p] AND h.gram = array_to_string(list_slice(m.w, m.p, m.p + h.k - 1), ' '))
"""

SQL: dict[str, str] = {
    "p8_found": _LEAKS + "SELECT doc_id, item_id FROM f",
    "p8_report": _LEAKS + """SELECT i.item_id, i.task, count(DISTINCT d.doc_id) AS n_docs, count(DISTINCT d.source) AS n_sources FROM eval_items i LEFT JOIN f ON f.item_id = i.item_id
        LEFT JOIN documents d ON d.doc_id = f.doc_id GROUP BY 1, 2""",
    "p1_exact": _NEAREST + "SELECT id, CAST(place AS INT) AS place, round(s, 6) AS similarity FROM n",
    "p1_recall": _NEAREST + "SELECT count(*) AS n_true, true AS enough FROM n",
    "p9_profiles": rf"""
        WITH l(language, word) AS (VALUES {_FUNCTION_WORDS}), w AS (SELECT lang AS language, lower(unnest(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+'))) AS word FROM documents),
        c AS (SELECT language, word, count(*) AS n FROM w JOIN l USING (language, word) GROUP BY ALL)
        SELECT language, word, round(n / sum(n) OVER (PARTITION BY language), 6) AS share FROM c""",
    "p6_found": _PAIRS + "SELECT term_a, term_b FROM r",
    "p6_pairs": _PAIRS + "SELECT * FROM r",
    "p3_found": """
        WITH s AS (SELECT article_id, unnest(sections) AS sec, generate_subscripts(sections, 1) AS s FROM articles),
        u AS (SELECT article_id, s, unnest(sec.subsections) AS sub, generate_subscripts(sec.subsections, 1) AS u FROM s WHERE sec IS NOT NULL)
        SELECT 'articles' AS src_table, article_id AS row_id, CAST(s AS BIGINT) AS section_no, CAST(0 AS BIGINT) AS subsection_no
        FROM s WHERE length(sec.content) > 2000
        UNION ALL SELECT 'articles', article_id, CAST(s AS BIGINT), CAST(u AS BIGINT) FROM u WHERE length(sub.content) > 2000
        UNION ALL SELECT 'reference_records', ref_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM reference_records WHERE length(pubmed.abstract) > 1000
    """,
    "p3_checked": """
        WITH s AS (SELECT article_id, unnest(sections) AS sec, generate_subscripts(sections, 1) AS s FROM articles),
        u AS (SELECT article_id, s, unnest(sec.subsections) AS sub, generate_subscripts(sec.subsections, 1) AS u FROM s WHERE sec IS NOT NULL),
        t AS (SELECT 'articles' AS src_table, article_id AS row_id, CAST(s AS BIGINT) AS section_no, CAST(0 AS BIGINT) AS subsection_no, sec.content AS t
        FROM s WHERE length(sec.content) > 2000
        UNION ALL SELECT 'articles', article_id, CAST(s AS BIGINT), CAST(u AS BIGINT), sub.content FROM u WHERE length(sub.content) > 2000
        UNION ALL SELECT 'reference_records', ref_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), pubmed.abstract FROM reference_records WHERE length(pubmed.abstract) > 1000)
        SELECT src_table, row_id, section_no, subsection_no, md5(t) AS text_md5, true AS n_pieces_ok, true AS within_limit, true AS overlap_ok FROM t
    """,
    "p9_counts": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[\p{L}\p{N}]+') AS w,
            list_filter(string_split(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\f\r]')) AS l FROM t)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
            CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, '')) / len(w), 6) END AS mean_word_length,
            CASE WHEN length(t) > 0 THEN round(length(regexp_replace(t, '[\p{L}\p{N}\s]+', '', 'g')) / length(t), 6) END AS symbol_ratio,
            CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(rtrim(x), '[.!?。]$'))) / len(l), 6) END AS end_share,
            CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains([""" + _COMMON + """], lower(x)))) / len(w), 6) END AS common_share
        FROM w""",
    "p9_language_counts": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[\p{L}\p{N}]+') AS w,
            regexp_extract_all(regexp_replace(t, '([\p{Han}\p{Katakana}ー]+|\p{Hiragana}+)', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS c,
            list_filter(string_split(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\f\r]')) AS l FROM t)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
            CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, '')) / len(w), 6) END AS mean_word_length,
            CASE WHEN length(t) > 0 THEN round(length(regexp_replace(t, '[\p{L}\p{N}\s]+', '', 'g')) / length(t), 6) END AS symbol_ratio,
            CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(rtrim(x), '[.!?。]$'))) / len(l), 6) END AS end_share,
            CASE WHEN len(c) > 0 THEN round(len(list_filter(c, lambda x: list_contains([""" + _ALL_COMMON + """], lower(x)))) / len(c), 6) END AS common_share
        FROM w""",
    "p7_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
