"""Pairs of terms that stand together in baskets, by heavy-light decomposition.

Only terms that reach the least support can be in a pair, so the vocabulary has at most
1 / share times the mean basket size terms, whatever the number of baskets. Terms in at least
``HEAVY`` of all baskets are heavy: their pairs are counted by popcounts of a dense bit matrix of
a block of baskets. A light and a heavy term are counted by probing the heavy rows at the light
term's list of baskets; two light terms by counting hashed pairs. Each task sums over its blocks
before the counts are shuffled, and a pair comes from exactly one of the three ways.

Defined results: a basket is the set of terms of all rows with a key; null or blank keys form
none, null or blank terms are dropped; a basket without terms counts in the number of baskets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papergrid.functions.keys import loose
from papergrid.workspace import stage

#: Least share of the baskets that makes a term heavy; baskets of a block; light pairs held before they are summed.
HEAVY, BLOCK, HELD = 0.01, 4096, 4_000_000
#: Most rows of the bit matrix; terms beyond count as light, with the same result.
HEAVY_MOST = 1024


def tidy(term: Column) -> Column:
    """Lower case, white space runs made one blank, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(term), r"(?U)\s+", " ")), F.lit(""))


def baskets(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, term), each once; a key without any term has one row with a null term."""
    terms = F.array_distinct(F.transform(F.concat(*(F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields)), tidy))
    rows = df.select(loose(F.col(key)).alias("key"), F.filter(terms, lambda t: t.isNotNull()).alias("terms")).where(F.col("key").isNotNull())
    return rows.select("key", F.explode_outer("terms").alias("term")).distinct()


def _count(heavy: int):
    """Term numbers run by falling frequency, so those under heavy are the heavy ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros((heavy, heavy), np.int64)
        mixed: dict[int, np.ndarray] = {}
        light = none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting: list[np.ndarray] = []

        def given(pairs: tuple[np.ndarray, np.ndarray]) -> Iterator[pd.DataFrame]:
            for at in range(0, len(pairs[0]), 500_000):
                keys, counts = pairs[0][at : at + 500_000], pairs[1][at : at + 500_000]
                yield pd.DataFrame({"a": (keys >> 32).astype(np.int32), "b": (keys & 0xFFFFFFFF).astype(np.int32), "n": counts})

        def settle() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = np.concatenate([light[0], *waiting]), np.concatenate([light[1], np.ones(sum(map(len, waiting)), np.int64)])
            waiting.clear()
            keys, where = np.unique(keys, return_inverse=True)
            return keys, np.bincount(where, weights=counts, minlength=len(keys)).astype(np.int64)

        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                lists = [np.sort(x) for x in pdf["terms"].iloc[at : at + BLOCK]]
                flat = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                big = flat < heavy
                bits = np.zeros((heavy, BLOCK), np.uint8)
                bits[flat[big], owner[big]] = 1
                words = np.packbits(bits, axis=1).view(np.uint64)
                used = np.flatnonzero(words.any(1))
                for i, a in enumerate(used):
                    dense[a, used[i + 1 :]] += np.bitwise_count(words[a] & words[used[i + 1 :]]).sum(1, dtype=np.int64)
                terms, lists_of = flat[~big], owner[~big]
                order = np.argsort(terms, kind="stable")
                terms, lists_of = terms[order], lists_of[order]
                distinct, start = np.unique(terms, return_index=True)
                stop = np.append(start[1:], len(terms))
                for t, a, b in zip(distinct, start, stop):
                    probed = bits[:, lists_of[a:b]].sum(1, dtype=np.int64)
                    mixed[t] = mixed[t] + probed if t in mixed else probed
                terms, lists_of = flat[~big], owner[~big]
                for step in range(1, len(terms)):
                    same = lists_of[step:] == lists_of[:-step]
                    if not same.any():
                        break
                    waiting.append((terms[:-step][same] << 32) | terms[step:][same])
                    if sum(map(len, waiting)) > HELD:
                        light = settle()
                        if len(light[0]) > HELD:  # they are summed after the shuffle
                            yield from given(light)
                            light = none
        light = settle()
        a, b = np.nonzero(dense)
        yield pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "n": dense[a, b]})
        for t, probed in mixed.items():
            h = np.flatnonzero(probed)
            yield pd.DataFrame({"a": h.astype(np.int32), "b": np.full(len(h), t, np.int32), "n": probed[h]})
        yield from given(light)

    return run


def pairs(held: DataFrame, least: int = 4, per_mille: int = 1, lift: float = 3.0) -> DataFrame:
    """(term_a, term_b, n_a, n_b, n_ab, n_baskets, lift) with n_ab >= least, 1000 n_ab >= per_mille N and n_ab N >= lift n_a n_b.

    held: distinct (key, term) rows as baskets() gives them; term_a < term_b by code points."""
    held = stage(held)
    total = held.select("key").distinct().count()
    support = max(least, -(-per_mille * total // 1000))
    counts = held.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    # At most (terms in all baskets) / support rows, that is 1000 / per_mille times the mean basket size.
    words = counts.toPandas().sort_values(["n", "term"], ascending=[False, True], ignore_index=True)
    words["tid"] = np.arange(len(words), dtype=np.int32)
    heavy = min(HEAVY_MOST, int((words["n"] >= max(1, HEAVY * total)).sum()))
    spark = held.sparkSession
    vocabulary = stage(spark.createDataFrame(words[["tid", "term", "n"]], "tid int, term string, n bigint"))
    lists = held.join(vocabulary, "term").groupBy("key").agg(F.collect_list("tid").alias("terms")).where(F.size("terms") > 1).select("terms")
    summed = lists.mapInPandas(_count(heavy), "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= support)
    side = lambda x: vocabulary.select(F.col("tid").alias(x), F.col("term").alias(f"t_{x}"), F.col("n").alias(f"m_{x}"))
    both = summed.join(side("a"), "a").join(side("b"), "b").where(F.col("n_ab") * total >= F.lit(lift) * F.col("m_a") * F.col("m_b"))
    ordered = F.col("t_a") < F.col("t_b")
    pick = lambda a, b: F.when(ordered, F.col(a)).otherwise(F.col(b))
    return both.select(
        pick("t_a", "t_b").alias("term_a"), pick("t_b", "t_a").alias("term_b"), pick("m_a", "m_b").alias("n_a"), pick("m_b", "m_a").alias("n_b"),
        "n_ab", F.lit(total).cast("bigint").alias("n_baskets"), F.round(F.col("n_ab") * F.lit(float(total)) / (F.col("m_a") * F.col("m_b")), 6).alias("lift"),
    )
