"""References to records that do not exist at the time, and what hangs on them.

Direct orphans come from a temporal anti-join against when each target key exists; children of
orphaned rows are inherited orphans, found by semi-joins down the foreign-key graph until no
table gains rows (a graph without cycles needs as many rounds as its longest path, so there
the whole plan stays lazy).

Existence is reduced first: open-ended rows to the earliest time of each key, closed ones to
disjoint intervals, per key and month before per key, so that a key with a third of all rows is
merged by many tasks and the probing side meets few intervals.

Defined results: a null or blank part of a key refers to nothing; a reference without a time, and
one to a target whose rows all lack a beginning, is an orphan; repeated rows are one case.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papergrid.workspace import stage


@dataclass(frozen=True)
class Table:
    """rows, the column of their id and the columns between whose times (included, excluded; open if null) they exist."""

    rows: DataFrame
    row_id: str
    since: str | None = None
    until: str | None = None


@dataclass(frozen=True)
class Reference:
    """Rows of child refer, at the time of the column at, to rows of target with an equal key."""

    child: str
    target: str
    child_key: tuple[Column, ...]
    target_key: tuple[Column, ...]
    at: str

    @property
    def keys(self) -> list[str]:
        return [f"key{i}" for i in range(len(self.child_key))]


def _islands(df: DataFrame, by: list[Column | str]) -> DataFrame:
    """Disjoint intervals (since, until) of the union of df's intervals in each group."""
    order = Window.partitionBy(*by).orderBy("since", "until")
    reach = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("new", F.coalesce((F.col("since") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("island")


def existence(target: Table, keys: list[str], key: tuple[Column, ...]) -> DataFrame:
    """(keys..., since, until): when rows with the key exist; until is null if open."""
    until = F.col(target.until) if target.until else F.lit(None).cast("timestamp")
    named = [k.alias(n) for n, k in zip(keys, key)]
    rows = target.rows.select(*named, F.col(target.since).alias("since"), until.alias("until"))
    rows = rows.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)) & F.col("since").isNotNull())
    open_ended = rows.where(F.col("until").isNull()).groupBy(*keys).agg(F.min("since").alias("since"), F.first("until").alias("until"))
    if not target.until:
        return open_ended
    closed = rows.where(F.col("until") > F.col("since")).withColumn("month", F.trunc("since", "month")).distinct()
    closed = _islands(_islands(closed, [*keys, "month"]).drop("month"), list(keys))
    return open_ended.unionByName(closed)


def _referring(tables: dict[str, Table], ref: Reference) -> DataFrame:
    child = tables[ref.child]
    named = [k.alias(n) for n, k in zip(ref.keys, ref.child_key)]
    rows = child.rows.select(F.col(child.row_id).alias("row_id"), *named, F.col(ref.at).alias("at"))
    return rows.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in ref.keys)))


def _rounds(refs: list[Reference]) -> int | None:
    """Length of the graph's longest path, None if it has a cycle."""
    above: dict[str, set[str]] = {}
    for r in refs:
        above.setdefault(r.child, set()).add(r.target)

    def depth(name: str, on: tuple[str, ...]) -> int:
        if name in on:
            raise RecursionError
        return max((1 + depth(t, (*on, name)) for t in above.get(name, ())), default=0)

    try:
        return max((depth(n, ()) for n in above), default=0)
    except RecursionError:
        return None


def direct_orphans(tables: dict[str, Table], refs: list[Reference]) -> DataFrame:
    """(src_table, row_id, target_table, at) of the references whose target did not exist at their time."""
    parts = []
    for ref in refs:
        there = existence(tables[ref.target], ref.keys, ref.target_key).select(*(F.col(k).alias(f"t_{k}") for k in ref.keys), "since", "until")
        same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"t_{k}") for k in ref.keys))
        covers = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
        missing = _referring(tables, ref).join(there, same & covers, "left_anti")
        parts.append(missing.select(F.lit(ref.child).alias("src_table"), "row_id", F.lit(ref.target).alias("target_table"), "at").distinct())
    return reduce(DataFrame.unionByName, parts)


def orphans(tables: dict[str, Table], refs: list[Reference], most_rounds: int | None = None, staged: bool = False) -> DataFrame:
    """(src_table, row_id, target_table, at, kind, level): direct orphans at level 0, inherited ones at the round that found them.

    A row is inherited by a reference if a target row that existed at its time is itself an orphan of either kind. staged: the direct orphans are
    written once, for callers that need all rows; without it a caller that asks for these alone pays for nothing else. With a cycle the rounds go on until one gains nothing, which comes as each gains other rows; rows gained after most_rounds are an error."""
    found = direct_orphans(tables, refs).withColumns({"kind": F.lit("direct"), "level": F.lit(0)})
    rounds = _rounds(refs)
    found = stage(found) if staged else found
    for level in count(1) if rounds is None else range(1, rounds):
        if rounds is None:
            found = stage(found)
        new = []
        for ref in refs:
            if not any(r.child == ref.target for r in refs):
                continue
            target = tables[ref.target]
            lost = found.where((F.col("src_table") == ref.target) & (F.col("level") == level - 1)).select(F.col("row_id").alias(target.row_id)).distinct()
            gone = existence(Table(target.rows.join(lost, target.row_id, "left_semi"), target.row_id, target.since, target.until), ref.keys, ref.target_key)
            gone = gone.select(*(F.col(k).alias(f"t_{k}") for k in ref.keys), "since", "until")
            same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"t_{k}") for k in ref.keys))
            then = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
            hit = _referring(tables, ref).join(gone, same & then, "left_semi")
            hit = hit.select(F.lit(ref.child).alias("src_table"), "row_id", F.lit(ref.target).alias("target_table"), "at").distinct()
            hit = hit.join(found.select("src_table", "row_id", "target_table"), ["src_table", "row_id", "target_table"], "left_anti")
            new.append(hit.withColumns({"kind": F.lit("inherited"), "level": F.lit(level)}))
        if not new:
            break
        gained = reduce(DataFrame.unionByName, new)
        if rounds is None:
            gained = stage(gained)
            if gained.isEmpty():
                break
            if most_rounds is not None and level > most_rounds:
                raise ValueError(f"rows are still gained after {most_rounds} rounds")
        found = found.unionByName(gained)
    return found


def orphan_report(found: DataFrame) -> DataFrame:
    """Their number per source table, target table, month and kind."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return found.groupBy("src_table", "target_table", month, "kind").agg(F.countDistinct("row_id").alias("orphans"))
