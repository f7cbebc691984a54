"""Joining bibliographic records to notes and references, and keeping the best of repeated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papergrid.functions import references as R
from papergrid.functions import text as T


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last."""
    value = F.struct(*(c for c in df.columns if c != key))
    return df.groupBy(key).agg(F.max_by(value, order).alias("_v")).select(key, "_v.*")


def enrich(notes: DataFrame, records: DataFrame, fields: list[str], key: str = "citekey", order: str = "ord") -> DataFrame:
    """notes with the record of the same key (the last, if repeated), else of the first record whose key is equal but for case.

    Adds fields, null where nothing matches, and match: 'exact', 'folded' or null. One join each on the key and on its lower case,
    both against sides that are unique in the key."""
    value = F.struct(*fields)
    exact = records.groupBy(key).agg(F.max_by(value, order).alias("_e"))
    last = records.groupBy(key).agg(F.max_by(F.struct(F.col(order).alias("o"), value.alias("v")), order).alias("l"), F.min(order).alias("first"))
    folded = last.groupBy(F.lower(key).alias("_low")).agg(F.min_by(F.col("l.v"), "first").alias("_f"))
    out = notes.join(exact, key, "left").join(folded, F.lower(notes[key]) == folded["_low"], "left")
    chosen = F.coalesce("_e", "_f")
    match = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_f").isNotNull(), "folded")
    return out.select(*notes.columns, *(chosen[f].alias(f) for f in fields), match.alias("match"))


def merged_fields(note: dict[str, Column], record: dict[str, Column]) -> dict[str, Column]:
    """doi, pmid, publisher: the record's if not empty, else the note's; terms, keywords and review flag: always the record's."""
    either = {f: T.either(record[f], note[f]) for f in ("doi", "pmid", "publisher") if f in record}
    lists = {f: F.coalesce(record[f], F.array().cast("array<string>")) for f in ("mesh_terms", "keywords") if f in record}
    return either | lists | ({"review": F.coalesce(record["review"], F.lit(False))} if "review" in record else {})


def split_by_cache(notes: DataFrame, cache: DataFrame) -> DataFrame:
    """notes (citekey, doi) with cached: the key is in the cache with the same DOI (two nulls are the same)."""
    known = cache.select("citekey", F.col("doi").alias("_doi"), F.lit(True).alias("_in")).dropDuplicates(["citekey"])
    joined = notes.join(known, "citekey", "left")
    return joined.withColumn("cached", F.coalesce(F.col("_in") & F.col("doi").eqNullSafe(F.col("_doi")), F.lit(False))).drop("_doi", "_in")


def backfill(df: DataFrame, source: DataFrame, key: str, field: str) -> DataFrame:
    """df with empty values of the field taken from source (one row for each key)."""
    new = source.select(key, F.col(field).alias("_new"))
    return df.join(new, key, "left").withColumn(field, T.either(F.col(field), F.col("_new"))).drop("_new")


def resolve_links(notes: DataFrame, targets: DataFrame, text: str = "content", key: str = "stem") -> DataFrame:
    """(path, link, found): the distinct wikilinks of each note and whether a note of that name exists."""
    links = notes.select("path", F.explode(T.wikilinks(F.col(text))).alias("link"))
    known = targets.select(F.col(key).alias("link"), F.lit(True).alias("_in")).distinct()
    return links.join(known, "link", "left").select("path", "link", F.coalesce("_in", F.lit(False)).alias("found"))


def newest_set(articles: DataFrame, sets: DataFrame, key: str = "citekey", set_id: str = "set_id", created: str = "created_at") -> DataFrame:
    """(key, set_id): for each article the newest set whose id is its key but for a trailing number."""
    by_base = sets.groupBy(R.base_of_set(F.col(set_id)).alias("_base")).agg(F.max_by(F.col(set_id), F.struct(created, set_id)).alias(set_id))
    return articles.select(key, R.base_of_set(F.col(key)).alias("_base")).distinct().join(by_base, "_base").select(key, set_id)


def linked_citations(texts: DataFrame, records: DataFrame, text: str, keep: list[str], record_key: str = "ref_index") -> DataFrame:
    """(keep..., number, hit): numbers cited in each text, of texts of which at least one number has a record."""
    cited = texts.select(*keep, F.explode(R.cited_numbers(F.col(text))).alias("number"))
    known = records.select(*[k for k in keep if k in records.columns], F.col(record_key).alias("number"), F.lit(True).alias("_in")).distinct()
    on = [k for k in keep if k in records.columns] + ["number"]
    out = cited.join(known, on, "left").select(*keep, "number", F.coalesce("_in", F.lit(False)).alias("hit"))
    return out.withColumn("_any", F.bool_or("hit").over(Window.partitionBy(*keep))).where("_any").drop("_any")


def first_per_key(df: DataFrame, key: Column, group: list[str], order: str) -> DataFrame:
    """The first row of each non-empty key in its group, numbered from 1 in order as place."""
    keyed = df.withColumn("_k", key).where(F.coalesce("_k", F.lit("")) != "")
    first = keyed.groupBy(*group, "_k").agg(F.min_by(F.struct(*df.columns), order).alias("_r"))
    out = first.select("_r.*")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(order) if group else Window.orderBy(order)))


def best_records(records: DataFrame, group: str = "set_id", order: str = "ref_index", tie: str = "ref_id", own_doi: Column | None = None) -> DataFrame:
    """The best filled record of each PMID, else DOI, else text, in a set; ties go to the first; numbered in order of first appearance.

    Left out: the page's own DOI, supplementary links, navigation texts."""
    doi = F.lower(T.either(F.col("pubmed.doi"), F.col("doi")))
    pmid = T.either(F.col("pubmed.pmid"), F.col("pmid"))
    hay = F.concat_ws(" ", "href", "doi", "text")
    keep = ~R.supplementary(hay) & ~F.lower(F.trim("text")).isin("skip to main content", "search this journal")
    if own_doi is not None:
        keep &= ~((own_doi != "") & (doi == own_doi))
    score = R.record_score(F.col("text"), F.col("href"), F.col("pubmed"), F.col("error_text"))
    at = F.struct(F.col(order).alias("o"), F.col(tie).alias("t"))
    rows = records.where(F.coalesce(keep, F.lit(True))).withColumn("_k", R.record_key(pmid, doi, F.col("text"), 120, tagged=True)).withColumn("score", score)
    best = rows.groupBy(group, "_k").agg(F.min_by(F.struct(*records.columns, "score"), F.struct(-F.col("score"), at)).alias("_r"), F.min(at).alias("_at"))
    out = best.select("_r.*", "_at")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_at"))).drop("_at")


def decided_pubmed(pubmed: Column, crossref: Column, europepmc: Column) -> Column:
    """The pubmed entry; where it has no abstract, the first service's entry that has one, under the pubmed ids."""
    has = lambda c: F.coalesce(c["abstract"], F.lit("")) != ""
    other = F.when(has(crossref), crossref).when(has(europepmc), europepmc)
    return F.when(has(pubmed), pubmed).when(pubmed.isNotNull() & has(other), pubmed.withField("abstract", other["abstract"]).withField("source", other["source"])).otherwise(
        F.coalesce(pubmed, other)
    )


def record_error(pubmed: Column) -> Column:
    """Why a record isn't complete: no metadata, or no abstract; null if it is."""
    return F.when(pubmed.isNull(), "metadata was not available").when(F.coalesce(pubmed["abstract"], F.lit("")) == "", "Abstract not found")


def title_candidate(candidates: DataFrame, keep: list[str], title: str, text: str, order: str, least: float = 0.6) -> DataFrame:
    """For each row the candidate of whose title words the largest share stands in the text, if at least that share; ties to the first."""
    scored = candidates.withColumn("overlap", R.overlap(R.title_tokens(F.col(title)), F.col(text))).where(F.col("overlap") >= least)
    rest = [c for c in scored.columns if c not in keep]
    return scored.groupBy(*keep).agg(F.max_by(F.struct(*rest), F.struct("overlap", -F.col(order))).alias("_b")).select(*keep, "_b.*")


def hit_source(score: str = "score") -> list[Column]:
    """Flat fields of a reference hit; values of the pubmed entry go before the record's own."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    authors = T.joined(F.col("pubmed.authors"))
    return [
        F.col(score), F.col("ref_index"), text("pubmed.title").alias("title"), authors.alias("authors"), text("pubmed.journal").alias("journal"),
        text("pubmed.pub_year").alias("year"), T.either(F.col("pubmed.doi"), F.col("doi")).alias("doi"), T.either(F.col("pubmed.pmid"), F.col("pmid")).alias("pmid"),
        text("href").alias("href"), text("text").alias("reference_text"), F.trim(text("pubmed.abstract")).alias("abstract"),
        R.citation_label(authors, F.col("pubmed.pub_year"), F.col("ref_index")).alias("citation_label"),
    ]


def review_flags(notes: DataFrame, records: DataFrame, key: str = "citekey", stem: str = "stem", tags: str = "tags", flag: str = "review") -> DataFrame:
    """notes with is_review: the flag of the record of the key (the file's stem where a note has none); where that says nothing, by the tags."""
    known = records.groupBy(key).agg(F.max(flag).alias("_flag"))
    keyed = notes.withColumn("_key", T.either(F.col(key), F.col(stem)))
    by_tags = F.exists(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda x: F.lower(x) == "review")
    return keyed.join(known.withColumnRenamed(key, "_key"), "_key", "left").withColumn("is_review", F.coalesce("_flag", by_tags, F.lit(False))).drop("_key", "_flag")


def chosen_hit(title_hits: DataFrame, author_hits: DataFrame, keep: list[str], ident: str = "pmid", rank: str = "rank") -> DataFrame:
    """For each row the first title hit that is an author and year hit, too, else the first title hit."""
    both = author_hits.select(*keep, ident, F.lit(True).alias("_in")).distinct()
    marked = title_hits.join(both, [*keep, ident], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    return marked.groupBy(*keep).agg(F.min_by(ident, F.struct(~F.col("_in"), rank)).alias(ident))


def looked_up(records: DataFrame, table: DataFrame, key: str = "doi", field: str = "pmid") -> DataFrame:
    """records with an empty field filled by a table of the service's answers (key, field); keys are compared in lower case, the least answer counts."""
    answers = table.where(F.col(field).isNotNull()).groupBy(F.lower(key).alias("_k")).agg(F.min(field).alias("_v"))
    return records.join(answers, F.lower(records[key]) == F.col("_k"), "left").withColumn(field, T.either(F.col(field), F.col("_v"))).drop("_k", "_v")


#: Bounds of the number of reference candidates of one import.
CANDIDATES = (1, 200)


def clamped_candidates(records: DataFrame, most: int, by: str, order: list[str]) -> DataFrame:
    """The first candidates of each import, their number kept within CANDIDATES."""
    n = max(CANDIDATES[0], min(CANDIDATES[1], most))
    return records.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
