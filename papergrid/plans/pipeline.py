"""Composed steps: notes to an index, search over it, reports, and imports with their errors."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papergrid.functions import html as H
from papergrid.functions import markdown as M
from papergrid.functions import text as T
from papergrid.operators import chunks as C
from papergrid.operators import search as S


def articles_from_notes(notes: DataFrame, profile: str = "main") -> DataFrame:
    """Articles of (path, stem, content) notes, with ok and error; a note without a main text has an error and no sections.

    Fields come from the Info callout, else from the front matter of the main text, else from that of the note."""
    parsed = notes.withColumn("_f", M.front_matter(F.col("content"))).withColumn("_m", T.main_text(T.newlines(F.col("_f.rest"))))
    parsed = parsed.withColumn("_i", M.front_matter(F.coalesce("_m", F.lit(""))))
    info = lambda name: T.info_field(T.newlines(F.col("content")), name)
    inner = lambda name: F.regexp_replace(F.coalesce(F.col("_i.extra")[name], F.lit("")), r'\A"|"\z', "")
    body = F.when(F.lit(profile == "mac"), F.col("_i.rest")).otherwise(F.col("_m"))
    review = T.is_review(F.col("_f.review"), F.col("_f.tags"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return parsed.select(
        "path", T.either(info("Citekey"), F.col("_f.citekey")).alias("citekey"), T.either(info("Title"), F.col("_i.title"), F.col("_f.title")).alias("title"),
        T.info_authors(T.newlines(F.col("content"))).alias("authors"), T.either(info("Year"), inner("published")).alias("published"),
        T.either(info("Journal"), inner("source")).alias("source"), info("Volume").alias("volume"), info("Issue").alias("issue"),
        T.either(info("DOI"), F.col("_f.doi")).alias("doi"), F.col("_f.tags").alias("tags"), text(F.col("_f.pmid")).alias("pmid"), text(F.col("_f.publisher")).alias("publisher"),
        F.coalesce(review, F.lit(False)).alias("is_review"), M.sections(body, review, profile).alias("sections"),
        F.col("_m").isNotNull().alias("ok"), F.when(F.col("_m").isNull(), F.lit("no main text")).alias("error"), F.concat_ws("", "stem", F.lit(".md")).alias("filename"),
    )


def cleaned(sections: Column) -> Column:
    """Sections without the types left out on conversion, contents freed of addresses and tags, headings merged into their texts."""
    clean = lambda c: M.merge_headings(T.without_urls_and_tags(c))
    kept = F.filter(sections, lambda s: ~s["type"].isin(*T.EXCLUDED["convert"]))
    inner = lambda u: F.struct(u["title"].alias("title"), clean(u["content"]).alias("content"))
    return F.transform(
        kept, lambda s: F.struct(s["title"].alias("title"), s["type"].alias("section_type"), clean(s["content"]).alias("content"), F.transform(s["subsections"], inner).alias("subsections"))
    )


def hashed_vector(text: str, dim: int) -> np.ndarray:
    """A deterministic stand-in for a model: signed counts of words and word pairs, of length 1 (all zero for no word)."""
    out = np.zeros(dim, np.float32)
    words = text.lower().split()
    for gram in [*words, *map(" ".join, zip(words, words[1:]))]:
        h = zlib.crc32(gram.encode())
        out[h % dim] += 1 if h >> 16 & 1 else -1
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def embed(chunks: DataFrame, dim: int = 64, embedder: Callable[[str, int], np.ndarray] = hashed_vector, with_metadata: bool = False) -> DataFrame:
    """chunks with an embedding, by an embedder that can be replaced. null texts have null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else embedder(x, dim).tolist())

    return chunks.withColumn("embedding", run(C.embed_text(chunks, with_metadata)))


def embed_new(chunks: DataFrame, index: DataFrame, key: list[str], dim: int = 64, embedder: Callable[[str, int], np.ndarray] = hashed_vector) -> DataFrame:
    """Only the chunks that the index doesn't hold yet, embedded: what an incremental run appends."""
    return embed(chunks.join(index.select(*key), key, "left_anti"), dim, embedder)


def search_text(index: DataFrame, query: str, k: int | None = None, filters: dict[str, list] | None = None, condition: str = "or", embedder: Callable[[str, int], np.ndarray] = hashed_vector, translate: Callable[[str], str] | None = None, dim: int = 64) -> DataFrame:
    """Search for a text; a Japanese one goes through translate first, if that is given."""
    if translate and any("぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" for c in query):
        query = translate(query)
    keyed = index.withColumn("id", F.struct("article_id", "section_no", "subsection_no", "paragraph_index"))
    return S.search(keyed, embedder(query, dim).tolist(), k, filters, condition).drop("id")


def prompt_context(hits: DataFrame) -> Column:
    """The passages of the hits, numbered, as the context of an answer."""
    row = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))).alias("t"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["t"]), "\n\n")


#: What an answer has to keep to, ahead of the passages.
INSTRUCTIONS = "Answer from the numbered passages only, and cite each one you use by its number."


def answered(question: str, hits: DataFrame, answerer: Callable[[str], str] | None = None) -> DataFrame:
    """(question, prompt, answer): the prompt of instructions, passages and question, and what answerer makes of it; null without one. One row."""
    prompt = F.concat(F.lit(f"{INSTRUCTIONS}\n\n"), F.coalesce(prompt_context(hits), F.lit("")), F.lit(f"\n\nQuestion: {question}"))
    asked = hits.agg(prompt.alias("prompt"))
    if answerer is None:
        return asked.select(F.lit(question).alias("question"), "prompt", F.lit(None).cast("string").alias("answer"))

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(answerer)

    return asked.select(F.lit(question).alias("question"), "prompt", run("prompt").alias("answer"))


def abstract_export(notes: DataFrame, isolate: bool = True) -> DataFrame:
    """(filename, citekey, doi, abstract, error): what is exported of each note. isolate: a note without front matter has an error; else it fails the export."""
    f = notes.select(F.concat_ws("", "stem", F.lit(".md")).alias("filename"), M.front_matter(F.col("content")).alias("f"), T.abstract_callout(F.col("content"), "strict").alias("abstract"))
    why = F.concat(F.lit("no front matter in "), F.col("filename"))
    error = F.when(~F.col("f.found"), why if isolate else F.raise_error(why).cast("string"))
    return f.select("filename", "f.citekey", "f.doi", F.coalesce("abstract", F.lit("")).alias("abstract"), error.alias("error"))


def report_lines(query: str, hits: DataFrame) -> DataFrame:
    """(line_no, line): a Markdown report of all hits (rank, score, title, text)."""
    body = F.array(
        F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("score: "), F.format_number("score", 4)), F.coalesce("text", F.lit("")), F.lit(""),
    )
    head = hits.sparkSession.range(1).select(F.lit(0).alias("line_no"), F.lit(f"# {query}").alias("line"))
    rows = hits.select("rank", F.posexplode(body).alias("p", "line"))
    return head.unionByName(rows.select(((F.col("rank") - 1) * 4 + F.col("p") + 1).cast("int").alias("line_no"), "line")).orderBy("line_no")


def session_lines(session_id: str, question: str, answer: str, hits: DataFrame) -> DataFrame:
    """(session_id, line_no, line): a question with its answer and sources, for append_session."""
    lines = report_lines(question, hits).withColumn("session_id", F.lit(session_id))
    top = hits.sparkSession.createDataFrame([(session_id, -2, f"Q: {question}"), (session_id, -1, answer)], "session_id string, line_no int, line string")
    return top.unionByName(lines.select("session_id", "line_no", "line"))


def import_pages(pages: DataFrame, url: str = "source_url", html: str = "html") -> DataFrame:
    """Article and references of each page; either may fail by itself: ok if one is there, with an error for each that isn't."""
    both = pages.withColumn("_page", H.page_of(F.col(html), F.col(url))).select("*", "_page.article", "_page.records").drop("_page")
    no_article, no_records = F.size("article.sections") == 0, F.size("records") == 0
    return both.withColumns({
        "article_error": F.when(no_article, "no section was found"), "reference_error": F.when(no_records, "no reference was found"), "ok": ~(no_article & no_records),
    })


def import_status(articles: DataFrame) -> DataFrame:
    """(article_id, chunks, ok): how many chunks each article gives, and whether it has sections."""
    counts = C.chunks(articles).groupBy("article_id").agg(F.count("*").alias("chunks"))
    own = articles.select("article_id", F.coalesce(F.size("sections") > 0, F.lit(False)).alias("ok"))
    return own.join(counts, "article_id", "left").select("article_id", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"), "ok")


def run_steps(steps: list[tuple[str, Callable[[], object]]]) -> list[tuple[str, bool, str]]:
    """Run named steps in order up to the first that fails: (name, ok, message) of each that ran."""
    done = []
    for name, step in steps:
        try:
            step()
        except Exception as error:  # noqa: BLE001
            return [*done, (name, False, str(error))]
        done.append((name, True, ""))
    return done
