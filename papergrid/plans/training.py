"""Queries of the general operators for training data: orphan references and nested payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papergrid.functions.keys import loose
from papergrid.operators import nested, orphans


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literature_graph(articles: DataFrame, records: DataFrame, citations: DataFrame) -> tuple[dict[str, orphans.Table], list[orphans.Reference]]:
    """The tables and references of the literature pipeline."""
    citekey, set_id, number = loose(F.col("citekey")), loose(F.col("set_id")), F.col("ref_index")
    tables = {
        "articles": orphans.Table(articles, "article_id", "loaded_at", "deleted_at"),
        "reference_records": orphans.Table(records, "ref_id", "harvested_at"),
        "citations": orphans.Table(citations, "citation_id"),
    }
    refs = [
        orphans.Reference("citations", "articles", (citekey,), (citekey,), "seen_at"),
        orphans.Reference("citations", "reference_records", (set_id, number), (set_id, number), "seen_at"),
        orphans.Reference("reference_records", "articles", (citekey,), (citekey,), "harvested_at"),
    ]
    return tables, refs


def _orphans(spark: SparkSession, d: str, staged: bool = False) -> DataFrame:
    return orphans.orphans(*literature_graph(*(_table(spark, d, t) for t in ("articles", "reference_records", "citations"))), staged=staged)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).where("kind = 'direct'").select("src_table", F.col("row_id").cast("bigint").alias("row_id"), "target_table").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d, staged=True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.payload_nodes(_table(spark, d, "raw_payloads")).select("payload_id", "node_kind", "node_path")


def _flat(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.flat_table(nested.payload_nodes(_table(spark, d, "raw_payloads"), with_json=True), kind)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, **{f"p5_{kind}s": _flat(kind) for kind in nested.FLAT},
}

_KEY = r"nullif(nfc_normalize(lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))), '')"
_ORPHANS = f"""
    WITH a AS (SELECT {_KEY.format("citekey")} AS k, loaded_at, deleted_at FROM articles),
    r AS (SELECT ref_id, {_KEY.format("citekey")} AS k, {_KEY.format("set_id")} AS s, ref_index, harvested_at FROM reference_records),
    c AS (SELECT DISTINCT citation_id, {_KEY.format("citekey")} AS k, {_KEY.format("set_id")} AS s, ref_index, seen_at FROM citations),
    direct AS (
        SELECT 'citations' AS src_table, citation_id AS row_id, 'articles' AS target_table, seen_at AS at_time FROM c
        WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.k = c.k AND loaded_at <= seen_at AND (deleted_at IS NULL OR seen_at < deleted_at))
        UNION ALL SELECT 'citations', citation_id, 'reference_records', seen_at FROM c
        WHERE s IS NOT NULL AND ref_index IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.s = c.s AND r.ref_index = c.ref_index AND harvested_at <= seen_at)
        UNION ALL SELECT 'reference_records', ref_id, 'articles', harvested_at FROM r
        WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.k = r.k AND loaded_at <= harvested_at AND (deleted_at IS NULL OR harvested_at < deleted_at))),
    lost AS (SELECT s, ref_index, min(harvested_at) AS since FROM r JOIN direct d ON d.src_table = 'reference_records' AND d.row_id = ref_id GROUP BY 1, 2),
    inherited AS (
        SELECT 'citations' AS src_table, citation_id AS row_id, 'reference_records' AS target_table, seen_at AS at_time FROM c
        WHERE EXISTS (SELECT 1 FROM lost WHERE lost.s = c.s AND lost.ref_index = c.ref_index AND since <= seen_at)
        AND citation_id NOT IN (SELECT row_id FROM direct WHERE src_table = 'citations' AND target_table = 'reference_records'))
"""

def _elements(h: str, real: str = "json_type(x.v) = 'OBJECT' AND len(json_keys(x.v)) > 0", lone: str = "'OBJECT'", keyed: bool = False) -> str:
    """The nodes of a list, or a lone one, with their places."""
    by_number = f"""WHEN json_type({h}) = 'OBJECT' AND len(list_filter(json_keys({h}), lambda k: NOT regexp_matches(k, '^[0-9]{{1,18}}$'))) = 0
        THEN list_transform(json_keys({h}), lambda k, i: {{'p': i, 'v': json_extract({h}, '$."' || k || '"')}})""" if keyed else ""
    return f"""list_filter(CASE WHEN json_type({h}) = 'ARRAY' THEN list_transform(range(1, CAST(json_array_length({h}) AS BIGINT) + 1), lambda i: {{'p': i, 'v': json_extract({h}, '$[' || (i - 1) || ']')}})
        {by_number} WHEN json_type({h}) IN ({lone}) THEN [{{'p': CAST(1 AS BIGINT), 'v': {h}}}] ELSE [] END, lambda x: {real})"""


_BOM = "trim(regexp_replace({}, '^\\x{{FEFF}}', ''), chr(32) || chr(9) || chr(10) || chr(13))"
_PAYLOADS = f"""
    WITH a AS (SELECT payload_id, payload_kind = 'reference_set' AS is_set, {_BOM.format("body")} AS b FROM raw_payloads WHERE body IS NOT NULL),
    s AS (SELECT payload_id, is_set, CASE WHEN json_valid(b) AND json_type(b) = 'VARCHAR' THEN {_BOM.format("json_extract_string(b, '$')")} ELSE b END AS b FROM a),
    j AS (SELECT payload_id, is_set, CAST(b AS JSON) AS j FROM s WHERE json_valid(b)),
    article AS (SELECT payload_id, CAST(x.p AS VARCHAR) AS path, x.v FROM (SELECT payload_id, unnest({_elements("h")}) AS x FROM
        (SELECT payload_id, CASE WHEN json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'articles') THEN json_extract(j, '$.articles') ELSE j END AS h FROM j WHERE NOT is_set))),
    section AS (SELECT payload_id, path || '/' || x.p AS path, x.v FROM (SELECT payload_id, path, unnest({_elements("h")}) AS x FROM (SELECT payload_id, path, json_extract(v, '$.sections') AS h FROM article))),
    subsection AS (SELECT payload_id, path || '/' || x.p AS path, x.v FROM (SELECT payload_id, path, unnest({_elements("h")}) AS x FROM (SELECT payload_id, path, json_extract(v, '$.subsections') AS h FROM section))),
    held AS (SELECT payload_id, CASE WHEN json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'set') THEN json_extract(j, '$.set') ELSE j END AS h FROM j WHERE is_set),
    record AS (SELECT payload_id, CAST(x.p AS VARCHAR) AS path, x.v FROM (SELECT payload_id, unnest({_elements("h", keyed=True)}) AS x FROM
        (SELECT payload_id, CASE WHEN json_type(h) = 'ARRAY' THEN h ELSE json_extract(h, '$.records') END AS h FROM held))),
    pubmed AS (SELECT payload_id, path || '/' || x.p AS path, x.v FROM (SELECT payload_id, path, unnest({_elements("h")}) AS x FROM (SELECT payload_id, path, json_extract(v, '$.pubmed') AS h FROM record))),
    author AS (SELECT payload_id, path || '/' || x.p AS path, x.v FROM (SELECT payload_id, path, unnest({_elements("h", "json_type(x.v) = 'VARCHAR' OR json_type(x.v) = 'OBJECT' AND len(json_keys(x.v)) > 0", "'OBJECT', 'VARCHAR'")}) AS x FROM
        (SELECT payload_id, path, json_extract(v, '$.authors') AS h FROM pubmed)))
"""


def _flat_sql(kind: str, fields: str) -> str:
    link = "payload_id, path AS node_path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent_path, CAST(regexp_extract(path, '[0-9]+$') AS BIGINT) AS place"
    return f"{_PAYLOADS} SELECT {link}, {fields} FROM {kind}"


def _strings(*names: str) -> str:
    return ", ".join(f"json_extract_string(v, '$.{n}') AS {n}" for n in names)


def _list(name: str, other: str | None = None) -> str:
    own = f"CASE WHEN json_type(v, '$.{name}') = 'ARRAY' THEN json_extract_string(v, '$.{name}[*]') END"
    return own if other is None else f"coalesce({own}, {_list(other)})"


SQL: dict[str, str] = {
    "p5_found": _PAYLOADS + " UNION ALL ".join(f"SELECT payload_id, '{k}' AS node_kind, path AS node_path FROM {k}" for k in nested.FLAT),
    "p5_articles": _flat_sql("article", _strings("citekey", "title", "published", "source", "volume", "issue", "doi") + f", {_list('authors')} AS authors"),
    "p5_sections": _flat_sql("section", _strings("title", "type", "content") + f", {_list('paragraphs')} AS paragraphs"),
    "p5_subsections": _flat_sql("subsection", _strings("title", "content")),
    "p5_records": _flat_sql("record", "CASE WHEN json_type(v, '$.index') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(v, '$.index') AS INT) END AS index, " + _strings("text", "doi", "pmid", "error")
        + ", coalesce(CASE WHEN json_type(v, '$.pubmed_found') = 'BOOLEAN' THEN CAST(json_extract(v, '$.pubmed_found') AS BOOLEAN) END, CASE WHEN json_type(v, '$.pubmedFound') = 'BOOLEAN' THEN CAST(json_extract(v, '$.pubmedFound') AS BOOLEAN) END) AS pubmed_found"),
    "p5_pubmeds": _flat_sql("pubmed", _strings("pmid", "doi", "title", "abstract", "journal", "year") + f", {_list('mesh_terms', 'meshTerms')} AS mesh_terms"),
    "p5_authors": _flat_sql("author", "CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE trim(concat_ws(' ', json_extract_string(v, '$.given'), json_extract_string(v, '$.family'))) END AS name"),
    "p4_found": _ORPHANS + "SELECT DISTINCT src_table, row_id, target_table FROM direct",
    "p4_report": _ORPHANS + """
        SELECT src_table, target_table, strftime(at_time, '%Y-%m') AS month, kind, count(DISTINCT row_id) AS orphans
        FROM (SELECT *, 'direct' AS kind FROM direct UNION ALL SELECT *, 'inherited' FROM inherited) GROUP BY ALL""",
}
