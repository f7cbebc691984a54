"""Similarity search: exact scores over filtered vectors, best per group, and merged rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds and default of the number of hits.
K_LEAST, K_MOST, K_DEFAULT = 1, 20, 5


def clamp_k(k: int | None) -> int:
    return K_DEFAULT if k is None else max(K_LEAST, min(K_MOST, int(k)))


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine in double; null for null, empty and all-zero vectors and for such of another length."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when((F.size(vector) == len(query)) & (norm > 0) & F.lit(length > 0), dot / (norm * F.lit(length or 1.0)))


def matching(filters: dict[str, list], condition: str = "or") -> Column:
    """Exact values of metadata fields. or: any value of any field; and: one of the values of every field. No filter lets all through."""
    if not filters:
        return F.lit(True)
    tests = [F.col(field).isin(*values) for field, values in filters.items()]
    return reduce((lambda a, b: a | b) if condition == "or" else (lambda a, b: a & b), tests)


def with_fallback(df: DataFrame, test: Column) -> DataFrame:
    """The rows that pass, or all rows if none does. Whether one does is looked up first, and the search for it ends at the first."""
    kept = df.where(test)
    return df if kept.isEmpty() else kept


def top_k(scored: DataFrame, k: int | None = None, score: str = "score", ties: str = "id") -> DataFrame:
    """The k best rows with their rank, by one take-ordered step; rows without a score are no hits."""
    best = scored.where(F.col(score).isNotNull()).orderBy(F.desc(score), ties).limit(clamp_k(k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), ties)))


def search(vectors: DataFrame, query: list[float], k: int | None = None, filters: dict[str, list] | None = None, condition: str = "or", vector: str = "embedding", ties: str = "id") -> DataFrame:
    """Filter, score, and keep the k most similar."""
    kept = vectors.where(matching(filters or {}, condition))
    return top_k(kept.withColumn("score", cosine(F.col(vector), query)).drop(vector), k, ties=ties)


def best_per_group(scored: DataFrame, *group: str, score: str = "score") -> DataFrame:
    """(group..., score): the best chunk of each reference; partial maxima before the shuffle."""
    return scored.where(F.col(score).isNotNull()).groupBy(*group).agg(F.max(score).alias(score))


def search_references(chunks: DataFrame, records: DataFrame, query: list[float], k: int | None = None, vector: str = "embedding") -> DataFrame:
    """The k references with the best chunk and their records; references without a record or an abstract are left out.

    chunks: set_id, ref_index, vector; records: set_id, ref_index, ... The k hits are found before the join."""
    best = best_per_group(chunks.withColumn("score", cosine(F.col(vector), query)), "set_id", "ref_index")
    known = records.where(F.length(F.trim(F.col("pubmed.abstract"))) > 0)
    hits = best.join(known.select("set_id", "ref_index").distinct(), ["set_id", "ref_index"], "left_semi")
    ranked = top_k(hits.withColumn("id", F.struct("set_id", "ref_index")), k).drop("id")
    return F.broadcast(ranked).join(known, ["set_id", "ref_index"])


def integrated(articles: DataFrame, references: DataFrame, k: int | None = None, score: str = "score", ties: str = "id") -> DataFrame:
    """Hits of both scopes in one ranking of at most 2k."""
    both = articles.withColumn("scope", F.lit("main_article")).unionByName(references.withColumn("scope", F.lit("reference")), allowMissingColumns=True)
    best = both.orderBy(F.desc(score), "scope", ties).limit(2 * clamp_k(k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "scope", ties)))


def query_flags(query: str, sections: list[str]) -> tuple[str, list[str]]:
    """Query without '-x' flags and the sections they name by first letter; of sections with one letter the last counts."""
    import re

    by_letter = {s[0].lower(): s for s in sections if s}
    return re.sub(r"-[a-z]+", "", query).strip(), [by_letter[f] for f in re.findall(r"-([a-z]+)", query) if f in by_letter]
