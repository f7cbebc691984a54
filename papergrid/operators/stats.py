"""Counts and distributions of a corpus; all are single aggregations with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papergrid.functions import text as T


def type_distribution(df: DataFrame, column: str = "section_type") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def year_distribution(articles: DataFrame, column: str = "published") -> DataFrame:
    """Articles by year, the first four characters of the date if they are digits."""
    year = F.substring(column, 1, 4)
    return articles.where(year.rlike(r"\A[0-9]{4}\z")).groupBy(year.alias("year")).agg(F.count("*").alias("n")).orderBy("year")


def corpus_totals(articles: DataFrame) -> DataFrame:
    """(articles, reviews, sections, mean_sections); null arrays have no sections."""
    n = F.coalesce(F.size("sections"), F.lit(0))
    n = F.when(F.col("sections").isNull(), 0).otherwise(n)
    review = T.is_review(F.col("is_review"), F.col("tags"))
    return articles.agg(F.count("*").alias("articles"), F.count_if(review).alias("reviews"), F.sum(n).alias("sections"), F.round(F.avg(n), 1).alias("mean_sections"))


def record_counters(records: DataFrame, by: str = "set_id") -> DataFrame:
    """(by, total, pubmed_found, abstract_found) of each set."""
    abstract = F.length(F.trim(F.coalesce(F.col("pubmed.abstract"), F.lit("")))) > 0
    found = F.coalesce(F.col("pubmed_found"), F.lit(False))
    return records.groupBy(by).agg(F.count("*").alias("total"), F.count_if(found).alias("pubmed_found"), F.count_if(abstract).alias("abstract_found"))


def enrichment_counters(records: DataFrame, review: Column) -> DataFrame:
    found = F.coalesce(F.col("pubmed_found"), F.lit(False))
    return records.agg(F.count("*").alias("total"), F.count_if(found).alias("pubmed_found"), F.count_if(F.coalesce(review, F.lit(False))).alias("review_count"))


def abstract_coverage(records: DataFrame, by: str) -> DataFrame:
    """(by, with_abstract, without_abstract, mean_length): lengths of the abstracts there are."""
    length = F.char_length(F.trim(F.coalesce(F.col("pubmed.abstract"), F.lit(""))))
    return records.groupBy(by).agg(
        F.count_if(length > 0).alias("with_abstract"), F.count_if(length == 0).alias("without_abstract"), F.round(F.avg(F.when(length > 0, length)), 2).alias("mean_length")
    )


def chunk_counts(sections: DataFrame, by: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Paragraphs of sections and subsections for each article set, without those of the skipped types."""
    own = F.coalesce(F.size("paragraphs"), F.lit(0)) + F.aggregate(F.coalesce("subsections", F.array()), F.lit(0), lambda s, u: s + F.size(u["paragraphs"]))
    kept = sections.where(~F.col("type").isin(*skip)) if skip else sections
    return kept.groupBy(by).agg(F.sum(own).alias("chunks"))


def header_rollup(counts: DataFrame, path: str = "header_path", n: str = "n", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of header paths, where a parent with children has the sum of theirs in place of its own."""
    parent = F.substring_index(path, " > ", 1)
    children = F.sum(F.when(F.col(path).contains(" > "), F.col(n))).over(Window.partitionBy(*keep, parent))
    is_parent = ~F.col(path).contains(" > ")
    return counts.withColumn("total", F.when(is_parent, F.coalesce(children, F.col(n))).otherwise(F.col(n)))


def heading_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("\n## ")), F.lit(0))


def first_seen(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Distinct values of each group in order of appearance, as place from 1."""
    seen = df.groupBy(group, value).agg(F.min(order).alias("_at"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_at", value))).drop("_at")


def largest(df: DataFrame, group: str, size: Column, tie: str) -> DataFrame:
    """The largest row of each group; ties go to the smaller tie value."""
    return df.groupBy(group).agg(F.max_by(F.struct(*(c for c in df.columns if c != group)), F.struct(size, -F.col(tie))).alias("_r")).select(group, "_r.*")


def continued(lines: DataFrame, group: str, order: str, text: str, starts: Column, stops: Column) -> DataFrame:
    """(group, item, text): lines appended to the last line that starts an item, up to the first stop after a start."""
    w = Window.partitionBy(group).orderBy(order)
    n = lines.withColumn("_s", F.coalesce(starts, F.lit(False))).withColumn("item", F.sum(F.col("_s").cast("int")).over(w))
    n = n.withColumn("_end", F.max(((F.col("item") > 0) & ~F.col("_s") & F.coalesce(stops, F.lit(False))).cast("int")).over(w)).where("item > 0 AND _end = 0")
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return n.groupBy(group, "item").agg(F.array_join(F.transform(parts, lambda p: p[text]), " ").alias("text"))


def blocks(marks: DataFrame, group: str, start: str, length: Column, most: int) -> DataFrame:
    """marks with stop: where the next mark of the group starts, for the last one most places on, within the length."""
    after = F.lead(start).over(Window.partitionBy(group).orderBy(start))
    return marks.withColumn("stop", F.least(F.coalesce(after, F.col(start) + most), length))
