"""Cutting texts that are too long into overlapping pieces at natural boundaries.

Boundaries are the places after a blank line, a line end, a sentence, a clause and a blank, each
with a penalty; where a stretch of a quarter of a piece has no boundary at all, places at even
distances stand in. Dynamic programming over the
places chooses the cuts of least penalty plus squared deviation of each piece from an even size.
A piece begins with the end of the one before: at the first word that begins within ``overlap`` code points
before the cut, or exactly there if none does.

Defined results: pieces have at most ``limit`` code points and cover the text; a text within the
limit is one piece; an empty text is one empty piece; a null text has none. overlap must be
less than half of limit.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of boundaries, coarse to fine: penalty and the pattern whose end is the place.
KINDS = (
    (0.0, re.compile(r"\n[^\S\n]*\n\s*")),
    (0.15, re.compile(r"\n\s*")),
    (0.3, re.compile(r"[.!?…]['\"”’)\]]*\s+|[。！？]+[」』）]*")),
    (0.7, re.compile(r"[;:,]\s+|[、，；：]")),
)
#: Penalties of a cut between words, and of one where there is no boundary.
WORD, FORCED = 1.0, 3.0
_BLANKS = re.compile(r"\s+")


def _places(text: str, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All boundaries inside the text, each with the penalty of its coarsest kind, and places at even distances where two lie further than gap apart;
    and the spans of white space."""
    n = len(text)
    blanks = np.array([m.span() for m in _BLANKS.finditer(text)], np.int64).reshape(-1, 2)
    found = [np.array([0, n])] + [np.fromiter((m.end() for m in pattern.finditer(text)), np.int64) for _, pattern in KINDS] + [blanks[:, 1]]
    cost = np.repeat([0.0, *(c for c, _ in KINDS), WORD], [len(f) for f in found])
    at, first = np.unique(np.concatenate(found), return_index=True)
    cost = cost[first]
    wide = np.flatnonzero(np.diff(at) > gap)
    if len(wide):
        new = np.concatenate([np.arange(at[a] + gap, at[a + 1], gap) for a in wide])
        at, cost = np.concatenate([at, new]), np.concatenate([cost, np.full(len(new), FORCED)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost, blanks


def _starts(at: np.ndarray, overlap: int, blanks: np.ndarray) -> np.ndarray:
    """Where the piece after each cut begins."""
    low = np.maximum(at - overlap, 0)
    if not overlap or not len(blanks):
        return low
    # Not in the middle of a word: where the next one begins, if that lies before the cut.
    word = np.append(blanks[:, 1], at[-1])[np.searchsorted(blanks[:, 1], low)]
    out = np.where((low > 0) & (word < at), word, low)
    return out


def cut(text: str | None, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    """Starts and stops, in code points, of the pieces."""
    if text is None:
        return None
    n = len(text)
    if n <= limit:
        return [(0, n)]
    at, cost, blanks = _places(text, max(1, (limit - overlap) // 4))
    start = _starts(at, overlap, blanks)
    even = n / -(-n // (limit - overlap)) + overlap
    # ((at_j - start_i - even) / limit)^2 = (s_i^2 - 2 a_j s_i + a_j^2) / limit^2 with s_i = start_i + even: the first part is kept with the least cost up to i.
    s, back = start + even, np.zeros(len(at), np.int64)
    so_far, twice = s * s / limit**2, s * (2 / limit**2)
    fixed = (at * at / limit**2 + cost + 0.05).tolist()
    low, places = np.searchsorted(start, at - limit).tolist(), at.tolist()
    for j in range(1, len(places)):
        lo = low[j]
        total = so_far[lo:j] - places[j] * twice[lo:j]
        i = total.argmin()
        back[j] = lo + i
        so_far[j] += total[i] + fixed[j]
    out, j = [], len(at) - 1
    while j:
        out.append((int(start[back[j]]), int(at[j])))
        j = back[j]
    return out[::-1]


def _cuts(limit: int, overlap: int):
    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (c := cut(t, limit, overlap)) is None else [{"start": a, "stop": b} for a, b in c] for t in texts], dtype=object)

    return run


def pieces(df: DataFrame, text: Column, limit: int, overlap: int) -> DataFrame:
    """df's rows whose text is over the limit, once for each piece, with piece_no (from 1), start, stop (code points) and piece."""
    if not 0 <= 2 * overlap < limit:
        raise ValueError("overlap must be less than half of limit")
    long = df.withColumn("_text", text).where(F.char_length("_text") > limit)
    return (
        long.withColumn("_cuts", _cuts(limit, overlap)("_text"))
        .select("*", F.posexplode("_cuts").alias("_no", "_c"))
        .withColumns({
            "piece_no": F.col("_no") + 1, "start": F.col("_c.start"), "stop": F.col("_c.stop"),
            "piece": F.substring("_text", F.col("_c.start") + 1, F.col("_c.stop") - F.col("_c.start")),
        })
        .drop("_text", "_cuts", "_no", "_c")
    )


def checked(cuts: DataFrame, keys: list[str], limit: Column, overlap: Column) -> DataFrame:
    """(keys, text_md5, n_pieces_ok, within_limit, overlap_ok) of each cut item: the text put together again from its pieces without their overlaps,
    whether pieces are numbered without gaps, and whether they keep the limit and begin in the piece before, at most overlap from its end."""
    before = F.lag("stop").over(Window.partitionBy(*keys).orderBy("piece_no"))
    rows = cuts.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("new", F.expr("substring(piece, before - start + 1)"))
    ordered = F.sort_array(F.collect_list(F.struct("piece_no", "new")))
    lap = F.when(F.col("piece_no") == 1, F.col("start") == 0).otherwise((F.col("start") <= F.col("before")) & (F.col("before") - F.col("start") <= overlap))
    return rows.groupBy(*keys).agg(
        F.md5(F.array_join(F.transform(ordered, lambda p: p["new"]), "")).alias("text_md5"), (F.max("piece_no") == F.count("*")).alias("n_pieces_ok"),
        F.bool_and((F.col("stop") - F.col("start") <= limit) & (F.char_length("piece") == F.col("stop") - F.col("start"))).alias("within_limit"), F.bool_and(lap).alias("overlap_ok"),
    )


#: Limits and overlaps, in code points, of contents and of abstracts.
CONTENT, ABSTRACT = (2000, 200), (1000, 120)


def literature_pieces(articles: DataFrame, records: DataFrame) -> DataFrame:
    """Pieces of long section contents, subsection contents and abstracts:
    (src_table, row_id, section_no, subsection_no, piece_no, start, stop, piece)."""
    sections = articles.select(F.col("article_id").cast("bigint").alias("row_id"), F.posexplode("sections").alias("s", "section"))
    inner = F.transform(
        F.coalesce("section.subsections", F.array()),
        lambda u, i: F.struct((i + 1).cast("bigint").alias("no"), u["content"].alias("content")),
    )
    own = F.array(F.struct(F.lit(0).cast("bigint").alias("no"), F.col("section.content").alias("content")))
    too_long = lambda x: F.char_length(x["content"]) > CONTENT[0]
    contents = sections.select(
        F.lit("articles").alias("src_table"), "row_id", (F.col("s") + 1).cast("bigint").alias("section_no"),
        F.explode(F.filter(F.concat(own, inner), too_long)).alias("item"),
    ).select("src_table", "row_id", "section_no", F.col("item.no").alias("subsection_no"), F.col("item.content").alias("content"))
    zero = F.lit(0).cast("bigint")
    abstracts = records.where(F.char_length("pubmed.abstract") > ABSTRACT[0]).select(
        F.lit("reference_records").alias("src_table"), F.col("ref_id").cast("bigint").alias("row_id"),
        zero.alias("section_no"), zero.alias("subsection_no"), F.col("pubmed.abstract").alias("content"),
    )
    return pieces(contents, F.col("content"), *CONTENT).drop("content").unionByName(pieces(abstracts, F.col("content"), *ABSTRACT).drop("content"))
