"""Articles into sections, paragraphs and chunks with their provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papergrid.functions import text as T

META = ("citekey", "title", "authors", "first_author", "published", "source", "volume", "issue", "doi", "pmid", "citation", "mesh_terms", "keywords")


def metadata(articles: DataFrame) -> list[Column]:
    """Flat metadata of an article's chunks; what is missing is an empty string."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [
        F.coalesce("citekey", F.lit("Unknown")).alias("citekey"), text("title").alias("title"), T.joined(F.col("authors")).alias("authors"),
        T.first_author(F.col("authors")).alias("first_author"), *(text(c).alias(c) for c in ("published", "source", "volume", "issue", "doi", "pmid")),
        T.citation(F.col("authors"), F.col("published"), F.col("citekey")).alias("citation"),
        T.joined(F.col("entrez_mesh_terms")).alias("mesh_terms"), T.joined(F.col("entrez_keywords")).alias("keywords"),
    ]


def sections(articles: DataFrame, keep: tuple[str, ...] = ("article_id",)) -> DataFrame:
    """(keep..., section_no, title, section_type, content, subsections); null sections keep their place and give no row."""
    return (
        articles.select(*keep, F.posexplode("sections").alias("p", "s")).where(F.col("s").isNotNull())
        .select(*keep, (F.col("p") + 1).alias("section_no"), "s.title", "s.section_type", "s.content", "s.subsections")
    )


def subsections(of: DataFrame, keep: tuple[str, ...] = ("article_id",)) -> DataFrame:
    """(keep..., section_no, section_type, section, subsection_no, subsection, content)."""
    return (
        of.select(*keep, "section_no", "section_type", F.col("title").alias("section"), F.posexplode("subsections").alias("p", "u")).where(F.col("u").isNotNull())
        .select(*keep, "section_no", "section_type", "section", (F.col("p") + 1).alias("subsection_no"), F.col("u.title").alias("subsection"), F.col("u.content").alias("content"))
    )


def chunks(articles: DataFrame, profile: str = "main", pattern: str = "\n\n") -> DataFrame:
    """One row for each paragraph to be indexed, with metadata, section, subsection, paragraph_index and total_paragraphs.

    main: excluded types and paragraphs go first, then paragraphs are counted; a review's index runs over a section and all its
    subsections. mac: only references and acknowledgements go, the index counts all paragraphs from 0 and there is no total.
    Indexes come from positions inside each section's array, so there is no shuffle."""
    review = T.is_review(F.col("is_review"), F.col("tags"))
    meta = metadata(articles)
    base = articles.select("article_id", F.when(review, "review").otherwise("regular").alias("article_type"), F.struct(*meta).alias("m"), F.posexplode("sections").alias("p", "s"))
    kind = F.coalesce("s.section_type", F.lit("unknown"))
    base = base.where(F.col("s").isNotNull() & ~kind.isin(*T.EXCLUDED["index" if profile == "main" else "index_mac"]))

    def paras(content: Column) -> Column:
        parts = T.paragraphs(content, pattern)
        return F.filter(parts, lambda x: ~T.excluded_paragraph(x)) if profile == "main" else parts

    own = F.struct(F.lit(0).alias("no"), F.lit("").alias("title"), paras(F.col("s.content")).alias("ps"))
    subs = F.transform(
        F.coalesce("s.subsections", F.array()),
        lambda u, i: F.struct((i + 1).alias("no"), F.coalesce(u["title"], F.lit("Untitled")).alias("title"), paras(u["content"]).alias("ps")),
    )
    merged = F.struct(F.lit(0).alias("no"), F.lit("").alias("title"), F.flatten(F.transform(F.concat(F.array(own), subs), lambda g: g["ps"])).alias("ps"))
    groups = F.when(F.col("article_type") == "review", F.array(merged)).otherwise(F.concat(F.array(own), subs))
    rows = base.select("article_id", "article_type", "m", (F.col("p") + 1).alias("section_no"), F.coalesce("s.title", F.lit("Untitled")).alias("section"),
                       kind.alias("section_type"), F.explode(groups).alias("g"))
    rows = rows.select("article_id", "article_type", "m", "section_no", "section", "section_type", F.col("g.no").alias("subsection_no"), F.col("g.title").alias("subsection"),
                       F.size("g.ps").alias("total_paragraphs"), F.posexplode("g.ps").alias("i", "text"))
    shift = 1 if profile == "main" else 0
    out = rows.select("article_id", "m.*", "article_type", "section_no", "section", "section_type", "subsection_no", "subsection",
                      (F.col("i") + shift).alias("paragraph_index"), "total_paragraphs", "text")
    return out if profile == "main" else out.drop("total_paragraphs")


def numbered(chunks_: DataFrame, by: str = "article_id") -> DataFrame:
    """chunks with chunk_index, from 1 in document order for each article, and char_count."""
    order = Window.partitionBy(by).orderBy("section_no", "subsection_no", "paragraph_index")
    return chunks_.withColumn("chunk_index", F.row_number().over(order)).withColumn("char_count", F.char_length("text"))


def html_items(article_sets: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Paragraphs of harvested article sets: positions before cleaning, paragraphs that are empty after it left out."""
    s = article_sets.select(*keep, F.posexplode("sections").alias("sp", "s"))
    own = F.struct(F.lit(-1).alias("no"), F.lit("").alias("title"), F.col("s.paragraphs").alias("ps"))
    subs = F.transform(F.coalesce("s.subsections", F.array()), lambda u, i: F.struct(i.alias("no"), u["title"].alias("title"), u["paragraphs"].alias("ps")))
    rows = s.select(*keep, "sp", F.col("s.title").alias("section"), F.col("s.type").alias("section_type"), F.explode(F.concat(F.array(own), subs)).alias("g"))
    rows = rows.select(*keep, "sp", "section", "section_type", F.col("g.no").alias("no"), F.col("g.title").alias("subsection"), F.size("g.ps").alias("total_paragraphs"),
                       F.posexplode("g.ps").alias("i", "raw"))
    return (
        rows.withColumn("text", T.without_links(F.col("raw"))).where(F.col("text") != "")
        .select(*keep, (F.col("sp") + 1).alias("section_no"), "section", "section_type", (F.col("no") + 1).alias("subsection_no"), "subsection",
                (F.col("i") + 1).alias("paragraph_index"), "total_paragraphs", "text")
    )


def embed_text(chunks_: DataFrame, with_metadata: bool = True) -> Column:
    """What an embedder sees: the text, ahead of it the metadata unless they are left out."""
    if not with_metadata:
        return F.col("text")
    known = [c for c in (*META, "section", "section_type", "subsection", "paragraph_index", "total_paragraphs") if c in chunks_.columns]
    return F.concat(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n")) for c in known), F.lit("\n"), F.col("text"))


def sentences(text: Column, size: int = 128, overlap: int = 24) -> Column:
    """Windows of sentences of about size words that share about overlap words; a longer sentence stands alone. Built-in fold."""
    parts = F.filter(F.split(text, r"(?<=[.!?。])\s+"), lambda s: F.trim(s) != "")
    n = lambda s: F.size(F.split(F.trim(s), r"\s+"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        fits = (acc["open"] == "") | (n(acc["open"]) + n(s) <= size)
        words = F.split(acc["open"], r"\s+")
        tail = F.array_join(F.slice(words, F.greatest(F.size(words) - overlap + 1, F.lit(1)), overlap), " ") if overlap else F.lit("")
        grown = F.when(acc["open"] == "", s).otherwise(F.concat_ws(" ", acc["open"], s))
        return F.when(fits, F.struct(acc["done"].alias("done"), grown.alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.concat_ws(" ", tail, s).alias("open"))
        )

    out = F.aggregate(parts, start, step)
    return F.when(out["open"] == "", out["done"]).otherwise(F.concat(out["done"], F.array(out["open"])))


def indexed_paragraphs(of: DataFrame, content: str = "content", tables: bool = False) -> DataFrame:
    """of's rows once for each paragraph, with paragraph_index and total_paragraphs. Paragraphs that begin with a table are left out unless tables
    is set, but count in both numbers."""
    ps = F.transform(T.paragraphs(F.col(content)), T.strip)
    rows = of.select("*", F.size(ps).alias("total_paragraphs"), F.posexplode(ps).alias("_i", "paragraph"))
    kept = rows if tables else rows.where(~F.col("paragraph").startswith("<table"))
    return kept.withColumn("paragraph_index", F.col("_i") + 1).drop("_i")


def target_sections(of: DataFrame, kind: str = "section_type") -> DataFrame:
    """The sections of the types that a search looks at."""
    return of.where(F.col(kind).isin(*T.EXCLUDED["search_targets"]))


def preview(rows: DataFrame, by: list[str], order: list[str], most: int = 5) -> DataFrame:
    """The first rows of each group, for a look at it."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
