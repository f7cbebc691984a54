"""Most similar vectors for every vector, by pruned proximity graphs over shards.

Vectors are routed by pivots (k-means on a bounded sample). Each vector is indexed in the shard of
its nearest pivot and queried in the shards of the pivots that are nearly as near. A shard with more than
``SHARD_MOST`` vectors gets pivots of its own and is divided again, and its queries are routed among its parts in the same
way, until all shards are small: no table of pivots grows with the collection but for one of a row for each divided shard,
and the number of shards searched for a query grows with the depth only. A shard's graph is
built by :mod:`papergrid.llm.graph` and kept as one row of an index table; a shard's queries go in
chunks of ``CHUNK`` against copies of its row, so no task holds more than one graph and one chunk.
The home shard is searched first; from the others only what is nearer than the k-th found there comes back.
Equal vectors are indexed once and expanded to their ids at the end. :func:`exact` is the way without loss.

Defined results: an id with several rows counts once (least vector); null ids, null, empty,
wrongly sized, all-zero vectors and such with null, NaN or infinite elements are no members;
ties in similarity go to the smaller id; a collection of one vector, or none, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papergrid.llm import graph
from papergrid.workspace import stage, tasks

#: Mean rows of a shard, most pivots of one division, sample rows for a pivot; most rows of a graph and of a chunk of queries.
SHARD_ROWS, PIVOTS_MOST, SAMPLE_EACH, SHARD_MOST, CHUNK = 1500, 2048, 25, 6000, 2000
#: Shards searched for a query in a division: those whose pivot's cosine is at most MARGIN below the best one's, but no fewer and no more than these; beam width.
MARGIN, PROBES, BEAM = 0.25, (4, 24), 48
#: Most neighbours of a node and beam width while a shard's graph is built.
DEGREE, BUILD_BEAM = 32, 64
#: Vectors of a block, of queries and of the collection, in the exact search.
QUERY_BLOCK, BLOCK = 1000, 4000


def usable(df: DataFrame, ids: str, vectors: str, dim: int) -> DataFrame:
    """(id, vec) of the rows whose vector has dim finite elements, not all zero, and whose id is not null."""
    infinite = F.lit(float("inf"))
    v = F.col(vectors)
    return df.select(F.col(ids).cast("bigint").alias("id"), v.alias("vec")).where(
        F.col("id").isNotNull()
        & (F.size("vec") == dim)
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
        & F.exists("vec", lambda x: x != 0)
    )


def usable_nested(df: DataFrame, ids: str, vectors: str, dim: int) -> DataFrame:
    """As usable, for rows with an array of ids and an array of vectors; surplus elements of either are no members."""
    pairs = df.select(F.explode(F.arrays_zip(F.col(ids).alias("id"), F.col(vectors).alias("vec"))).alias("p")).select("p.id", "p.vec")
    return usable(pairs, "id", "vec", dim)


def _unit(blobs: pd.Series, rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs) if rows is None else rows, -1).astype(np.float64)
    raw /= np.abs(raw).max(1, keepdims=True)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    return unit, unit.astype(np.float32)


def _means(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on the sample."""
    rng = np.random.default_rng(11)
    centres = sample[rng.choice(len(sample), count, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 2048] @ centres.T).argmax(1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def _to_blob(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"cid": pdf["cid"], "n": pdf["n"], "vec": [np.asarray(v, np.float32).tobytes() for v in pdf["vec"]]})


def _probes(vectors: pd.Series, pivots: np.ndarray, margin: float, probes: tuple[int, int]) -> list[np.ndarray]:
    """Places of the pivots to be searched for each vector, the nearest first."""
    least, most = (min(p, len(pivots)) for p in probes)
    sims = _unit(vectors)[1] @ pivots.T
    top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    best = np.take_along_axis(sims, top, 1)
    order = np.argsort(-best, axis=1, kind="stable")
    top, best = np.take_along_axis(top, order, 1), np.take_along_axis(best, order, 1)
    count = np.maximum((best >= best[:, :1] - margin).sum(1), least)
    return [t[:n] for t, n in zip(top, count)]


_ROUTED = "cid bigint, vec binary, shard bigint, home boolean"


def _routed(pdf: pd.DataFrame, parent: int, pivots: np.ndarray, margin: float, probes: tuple[int, int]) -> pd.DataFrame:
    """Rows for the parts of a shard: the home of a row that is at home in the shard, and the parts to be searched for a query."""
    found = _probes(pdf["vec"], pivots, margin, probes)
    times = [len(f) for f in found]
    first = np.concatenate([[0], np.cumsum(times)[:-1]])
    home = np.zeros(sum(times), bool)
    home[first] = True
    out = pd.DataFrame({"cid": np.repeat(pdf["cid"].to_numpy(), times), "vec": np.repeat(pdf["vec"].to_numpy(), times), "shard": parent * 4096 + np.concatenate(found) + 1})
    out["home"] = home & np.repeat(pdf["home"].to_numpy(bool), times)
    out["vec"] = out["vec"].where(out["home"], None)
    return out


def _pivots_of(sample: pd.Series, count: int) -> np.ndarray:
    unit = _unit(sample)[1] if len(sample) else np.zeros((1, 1), np.float32)
    return _means(unit, max(1, min(count, len(unit))))


def _parts(rows: int) -> int:
    return max(1, min(PIVOTS_MOST, rows // SHARD_ROWS))


def _divide(pdf: pd.DataFrame) -> pd.DataFrame:
    sample = pdf.sort_values("cid")
    pivots = _pivots_of(sample["vec"], int(pdf["parts"].iloc[0]))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "pivots": [pivots.tobytes()]})


def _again(margin: float, probes: tuple[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, part in pdf.groupby("shard"):
                pivots = np.frombuffer(part["pivots"].iloc[0], np.float32).reshape(-1, len(part["vec"].iloc[0]) // 4)
                yield _routed(part, int(shard), pivots, margin, probes)

    return run


def _shares(by: Column, share: Column) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(1 << 20)) <= (share * (1 << 20)).cast("bigint")


def shards(classes: DataFrame, count: int, margin: float, probes: tuple[int, int], most_levels: int = 5) -> DataFrame:
    """(cid, vec, shard, home): every vector once at home, and once more, without the vector itself, for each other shard to be searched for it."""
    share = F.lit(min(1.0, SAMPLE_EACH * _parts(count) / max(count, 1)))
    sample = classes.where(_shares(F.col("cid"), share)).select("cid", "vec").toPandas().sort_values("cid")
    pivots = _pivots_of(sample["vec"], _parts(count))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield _routed(pdf.assign(home=True), 0, pivots, margin, probes)

    routed = stage(classes.repartition(tasks(classes.sparkSession)).mapInPandas(first, _ROUTED))
    done = None
    # Five levels of 2,048 parts are more than any collection needs; what is left over SHARD_MOST is searched as it is.
    for _ in range(most_levels):
        parts = F.least(F.lit(PIVOTS_MOST), F.greatest(F.lit(2), F.floor(F.col("rows") / SHARD_ROWS))).cast("int")
        big = stage(routed.where("home").groupBy("shard").agg(F.count("*").alias("rows")).where(F.col("rows") > SHARD_MOST).withColumn("parts", parts))
        if big.isEmpty():
            break
        drawn = routed.where("home").join(big, "shard").where(_shares(F.col("cid"), SAMPLE_EACH * F.col("parts") / F.col("rows")))
        divided = stage(drawn.groupBy("shard").applyInPandas(_divide, "shard bigint, pivots binary"))
        small = routed.join(big, "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        again = routed.drop("vec").join(divided, "shard").join(classes.select("cid", "vec"), "cid")
        routed = stage(again.mapInPandas(_again(margin, probes), _ROUTED))
    return routed if done is None else done.unionByName(routed)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cid")
    near, entries = graph.build(_unit(pdf["vec"])[1], DEGREE, BUILD_BEAM)
    return pd.DataFrame({
        "shard": [pdf["shard"].iloc[0]], "ids": [pdf["cid"].to_numpy(np.int64).tobytes()],
        "vecs": [b"".join(pdf["vec"])], "near": [near.tobytes()], "entries": [entries.tobytes()],
    })


def _search(k: int, beam: int):
    """The k nearest of the shard's vectors that the beam meets, by their exact cosines; with a column least only those that reach it."""

    def run(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"cid": pd.Series(dtype=np.int64), "sims": pd.Series(dtype=object), "others": pd.Series(dtype=object)})
        if not len(queries) or not len(index):
            return nothing
        row = index.iloc[0]
        ids = np.frombuffer(row["ids"], np.int64)
        width = len(row["vecs"]) // len(ids)
        exact, unit = _unit(pd.Series([row["vecs"][i : i + width] for i in range(0, len(row["vecs"]), width)]))
        near = np.frombuffer(row["near"], np.int32).reshape(len(ids), -1)
        own, query = _unit(queries["vec"])
        at, _ = graph.search(unit, near, np.frombuffer(row["entries"], np.int32), query, beam)
        sims = np.einsum("qd,qcd->qc", own, exact[np.maximum(at, 0)])
        cids = queries["cid"].to_numpy()
        other = ids[np.maximum(at, 0)]
        sims[(at < 0) | (other == cids[:, None])] = -np.inf
        order = np.lexsort((other, -sims), axis=1)[:, :k]
        sims, other = np.take_along_axis(sims, order, 1), np.take_along_axis(other, order, 1)
        least = queries["least"].to_numpy()[:, None] if "least" in queries else -2.0
        count = (sims >= least).sum(1)
        keep = np.flatnonzero(count)
        if not len(keep):
            return nothing
        return pd.DataFrame({"cid": cids[keep], "sims": [s[:n] for s, n in zip(sims[keep].tolist(), count[keep])], "others": [o[:n] for o, n in zip(other[keep].tolist(), count[keep])]})

    return run


_FOUND = "cid bigint, sims array<double>, others array<bigint>"


def nearest(vectors: DataFrame, k: int = 10, margin: float = MARGIN, probes: tuple[int, int] = PROBES, beam: int = BEAM) -> DataFrame:
    """(id, other, similarity, place): for each id of vectors (id, vec) its k most similar others, places 1 to k."""
    spark = vectors.sparkSession
    members, classes = _classes(vectors)
    count = classes.count()
    routed = shards(classes, count, margin, probes)
    parts = min(4096, max(tasks(spark), count // SHARD_ROWS))
    index = stage(
        routed.where("home").select("cid", "vec", "shard").repartition(parts, "shard").groupBy("shard")
        .applyInPandas(_build, "shard bigint, ids binary, vecs binary, near binary, entries binary")
    )

    def asked(queries: DataFrame) -> DataFrame:
        chunks = queries.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        keys = ("shard", "chunk")
        rows = queries.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("chunks")).cast("int")).drop("chunks")
        copies = index.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        return rows.repartition(parts, *keys).groupBy(*keys).cogroup(copies.repartition(parts, *keys).groupBy(*keys)).applyInPandas(_search(k, beam), _FOUND)

    at_home = stage(asked(routed.where("home").select("cid", "vec", "shard")))
    least = at_home.where(F.size("sims") >= k).select("cid", F.element_at("sims", k).alias("least"))
    # The shards of a query are a bounded list, so its vector meets them once and is copied only on its way to the shards.
    ways = routed.where(~F.col("home")).groupBy("cid").agg(F.collect_list("shard").alias("ways"))
    abroad = routed.where("home").select("cid", "vec").join(ways, "cid").join(least, "cid", "left").na.fill({"least": -2.0})
    abroad = abroad.select("cid", "vec", F.explode("ways").alias("shard"), "least")
    lists = at_home.unionByName(asked(abroad))
    found = F.transform(F.arrays_zip("sims", "others"), lambda x: F.struct((-x["sims"]).alias("neg"), x["others"].alias("id")))
    best = stage(lists.select("cid", found.alias("found")).groupBy("cid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found")))
    return _expand(members, classes, best, k)


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (id, cid) and (cid, n, vec): the ids of each distinct vector, under the least of them."""
    distinct = vectors.groupBy("id").agg(F.min("vec").alias("vec"))
    classes = stage(distinct.groupBy("vec").agg(F.min("id").alias("cid"), F.count("*").alias("n")).select("cid", "n", "vec"))
    many = classes.where("n > 1").select("vec", "cid")
    members = stage(distinct.join(many, "vec").select("id", "cid").unionByName(classes.where("n = 1").select(F.col("cid").alias("id"), "cid")))
    return members, classes.mapInPandas(_to_blob, "cid bigint, n bigint, vec binary")


def _expand(members: DataFrame, classes: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """From classes of equal vectors to ids. Only the k + 1 smallest ids of a class can be anyone's neighbours."""
    from pyspark.sql import Window

    many = classes.where("n > 1").select("cid")
    ranked = members.join(many, "cid").withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("r") <= k + 1)
    smallest = ranked.groupBy("cid").agg(F.collect_list("id").alias("ids"))
    pairs = best.select("cid", F.explode("found").alias("f")).select("cid", F.col("f.neg").alias("neg"), F.col("f.id").alias("other"))
    pairs = pairs.unionByName(many.select("cid", F.lit(-1.0).alias("neg"), F.col("cid").alias("other")))
    ids = pairs.join(smallest.withColumnRenamed("cid", "other"), "other", "left").select(
        "cid", "neg", F.explode(F.coalesce("ids", F.array("other"))).alias("id")
    )
    lists = ids.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("neg", "id"))), 1, k + 1).alias("found"))
    return (
        members.join(lists, "cid")
        .select("id", F.posexplode(F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)).alias("p", "f"))
        .select("id", F.col("f.id").alias("other"), (-F.col("f.neg")).alias("similarity"), (F.col("p") + 1).alias("place"))
    )


def _blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
    """(name, ids, vecs): blocks of about so many vectors, numbered."""
    count = max(1, -(-df.count() // rows))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        vecs = b"".join(np.asarray(v, np.float32).tobytes() for v in pdf["vec"])
        return pd.DataFrame({name: pdf[name].iloc[:1], f"{name}_ids": [pdf["id"].to_numpy(np.int64).tobytes()], f"{name}_vecs": [vecs]})

    numbered = df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return stage(numbered.groupBy(name).applyInPandas(pack, f"{name} int, {name}_ids binary, {name}_vecs binary"))


def _compared(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q_ids, q_vecs, c_ids, c_vecs in zip(pdf["q_ids"], pdf["q_vecs"], pdf["c_ids"], pdf["c_vecs"]):
                a, b = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                sims = _unit(pd.Series([q_vecs]).map(bytes), len(a))[0] @ _unit(pd.Series([c_vecs]).map(bytes), len(b))[0].T
                sims[a[:, None] == b[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(b, sims.shape), -sims), axis=1)[:, :k]
                found = np.take_along_axis(sims, order, 1)
                yield pd.DataFrame({"id": a, "found": [[{"neg": -s, "id": int(i)} for s, i in zip(r, b[o]) if np.isfinite(s)] for r, o in zip(found, order)]})

    return run


def exact(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(id, other, similarity, place) of the rows of vectors that queries selects, against all rows, without loss: blocks of queries meet blocks of the collection."""
    distinct = stage(vectors.groupBy("id").agg(F.min("vec").alias("vec")))
    asked, held = _blocks(distinct.where(queries), QUERY_BLOCK, "q"), _blocks(distinct, BLOCK, "c")
    n = max(1, -(-distinct.where(queries).count() // QUERY_BLOCK))
    pairs = held.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(tasks(vectors.sparkSession), "c", "q").join(asked, "q")
    found = pairs.select("q_ids", "q_vecs", "c_ids", "c_vecs").mapInPandas(_compared(k), "id bigint, found array<struct<neg: double, id: bigint>>")
    best = found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    return best.select("id", F.posexplode("found").alias("p", "f")).select("id", F.col("f.id").alias("other"), (-F.col("f.neg")).alias("similarity"), (F.col("p") + 1).alias("place"))


def neighbour_pairs(vectors: DataFrame, k: int = 10) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b, once for each pair of which one is among the other's k most similar."""
    n = nearest(vectors, k)
    return n.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()
