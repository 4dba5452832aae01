"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample gives reference points (pivots). Every vector is described by its ``NEAR``
nearest pivots, nearest first. The order says where a vector is posted: in the inverted lists
of the pairs that its first pivots form (``PAIRS``, by rank), so vectors that differ only in
what comes later meet, and those whose nearest pivots differ don't. What meets in a list and
shares ``SHARED`` or more of its pivots is a candidate, which the cosine in double precision
decides. A list longer than ``LONG`` is split without losing a candidate: its vectors are
posted under the lowest ``NEXT`` of their pivots beyond the pair, and two that share enough
pivots beyond the pair have one of these in common. Without pivots beyond the pair a list
stays whole.

Only numbers travel while lists are counted, split and cut; a vector is read again once its
lists are known and goes to them directly. Equal vectors (by two 64-bit hashes) are one
entry with a count, so a vector that a third of all rows hold is one. What is still long
after the split is cut into tiles of about ``TILE`` entries, and a pair of tiles is one unit
of work, so nothing is left out and a long list is spread over many tasks. A pair that meets
in several lists is counted in the one with the lowest key. A unit yields, for each of its
vectors, how many rows it links to and the smallest vector it reaches within the unit; never
the pairs themselves.

Cases: vectors that are null, zero or hold null or non-finite components link with nothing;
vectors of different lengths never link; equal rows link with each other; rows with one id
and several vectors count as one vertex; an empty table gives no rows; other columns are not
read.

The number of pivots grows with the root of the number of vectors, up to ``MOST``. Recall
against brute force is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.session import Scratch, table

THRESHOLD = 0.95
#: Vectors that the pivots are chosen from, of so many components in all at most.
SAMPLE, SAMPLE_COMPONENTS = 16_384, 4_000_000
#: Pivots of a length: the root of the number of its vectors, in bounds.
FEWEST, MOST = 16, 4096
#: No two pivots are closer than this.
APART = 0.8
SEED = "pivots-1"
#: Pivots of a vector's description, and how many of them a candidate pair shares.
NEAR, SHARED = 8, 4
#: Ranks of the pivots whose pairs are the lists that a vector is posted in.
PAIRS = ((0, 1), (0, 2), (1, 2), (0, 3))
#: Entries of a list that isn't split, and the most pivots beyond the pair that split it: sets
#: of NEAR - 2 with SHARED - 2 or more in common meet in their lowest NEAR - SHARED + 1.
LONG, NEXT = 2048, NEAR - SHARED + 1
TILE = 256
#: Bits of a pivot's number within a list's key: lower, higher, and the next pivot plus 1, or 0.
BITS = 21
DESCRIBED = "vec_id long, h1 long, h2 long, near array<int>"
FOUND = "vec long, linked long, root long"


def _usable() -> Column:
    """Whether a row has a finite, non-zero vector."""
    fine = """embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))
        AND exists(embedding, x -> x <> 0)"""
    return F.coalesce(F.expr(fine), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest part so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def pivots(vectors: DataFrame, size: int, total: int) -> np.ndarray:
    """Reference points from a bounded sample, each the farthest of eight from those before it."""
    some = max(FEWEST, min(SAMPLE, SAMPLE_COMPONENTS // size))
    rows = vectors.orderBy(F.md5(F.concat(F.lit(SEED), F.col("vec_id").cast("string"))), "vec_id").limit(some).select("embedding").collect()
    x = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64))
    want, rng = min(MOST, max(FEWEST, round(total**0.5))), np.random.default_rng(1)
    chosen, best = [0], x @ x[0]
    for _ in range(8 * want):
        if len(chosen) >= want:
            break
        some = rng.integers(0, len(x), 8)
        k = int(some[np.argmin(best[some])])
        if best[k] < APART:
            chosen.append(k)
            best = np.maximum(best, x @ x[k])
    return x[chosen]


def nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The numbers of each vector's nearest points, nearest first; of equally near ones the lower."""
    return np.argsort(-(_unit(x) @ points.T), axis=1, kind="stable")[:, :NEAR].astype(np.int32)


def describe(vectors: DataFrame, points: dict[int, np.ndarray]) -> DataFrame:
    """vectors: vec_id, embedding, h1, h2. Adds ``near`` in place of the vector.

    ``points`` holds the pivots of each length; they are numbered on from one length to the
    next, so that no list has vectors of two lengths.
    """
    first = dict(zip(points, np.cumsum([0, *map(len, points.values())]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(pc.list_value_length(batch.column("embedding")))
            for d in np.unique(sizes).tolist():
                some = batch if (sizes == d).all() else batch.filter(pa.array(sizes == d))
                near = nearest(_matrix(some.column("embedding")), points[d]) + np.int32(first[d])
                column = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in ("vec_id", "h1", "h2")), column], names=["vec_id", "h1", "h2", "near"])

    return vectors.select("vec_id", "embedding", "h1", "h2").mapInArrow(run, DESCRIBED)


def _lists(near: str) -> str:
    """SQL: the lists of a description, each a struct of its base key and the next pivots."""
    key = lambda i, j: f"shiftleft(shiftleft(CAST(least({near}[{i}], {near}[{j}]) AS BIGINT), {BITS}) + greatest({near}[{i}], {near}[{j}]), {BITS})"
    kept = f"size({near}) - least({SHARED}, size({near})) + 1"
    after = lambda i, j: f"slice(array_sort(array_except({near}, array({near}[{i}], {near}[{j}]))), 1, {kept})"
    one = lambda k, i, j: f"IF(size({near}) > {j}, struct({k} AS place, {key(i, j)} AS list, {after(i, j)} AS next), NULL)"
    alone = f"struct(0 AS place, shiftleft(shiftleft(CAST({near}[0] AS BIGINT), {BITS}) + {near}[0], {BITS}) AS list, CAST(array() AS ARRAY<INT>) AS next)"
    return f"IF(size({near}) = 1, array({alone}), array_compact(array({', '.join(one(k, i, j) for k, (i, j) in enumerate(PAIRS))})))"


def keys_of(near: np.ndarray, longs: np.ndarray) -> np.ndarray:
    """All keys that vectors are posted under, a row each; longs: bits of the lists that were split."""
    n, m = near.shape
    big = near.astype(np.int64)
    out = np.full((n, len(PAIRS) * NEXT), -1, np.int64)
    if m == 1:
        out[:, 0] = (big[:, 0] << 2 * BITS) + (big[:, 0] << BITS)
        return out
    for k, (i, j) in enumerate(PAIRS):
        if j >= m:
            continue
        base = (np.minimum(big[:, i], big[:, j]) << 2 * BITS) + (np.maximum(big[:, i], big[:, j]) << BITS)
        split = longs >> k & 1 == 1
        after = np.sort(np.delete(big, [i, j], axis=1), axis=1)[:, : m - min(SHARED, m) + 1]
        for t in range(after.shape[1]):
            out[:, k * NEXT + t] = np.where(split, base + after[:, t] + 1, -1)
        out[:, k * NEXT] = np.where(split, out[:, k * NEXT], base)
    return out


def posted(merged: DataFrame, scratch: Scratch) -> DataFrame:
    """Per entry (vec, h1, h2) its places: key, tile and number of tiles; and which lists were split."""
    own = ["vec", "h1", "h2"]
    lists = merged.select(*own, F.expr(f"inline({_lists('near')})"))
    counts = lists.groupBy("list").count().filter("count > 1").select("list", (F.col("count") > LONG).alias("long"))
    keyed = lists.join(counts, "list").withColumn("long", F.expr("long AND size(next) > 0"))
    keyed = keyed.withColumn("key", F.explode(F.expr("IF(long, transform(next, c -> list + c + 1), array(list))")))
    keyed = scratch.keep("keyed", keyed.select(*own, "key", F.expr("IF(long, shiftleft(1, place), 0)").alias("bit")))
    tiles = keyed.groupBy("key").count().filter("count > 1").select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    placed = keyed.join(tiles, "key").select(*own, "bit", F.struct("key", F.expr("CAST(pmod(xxhash64(vec, h1), tiles) AS INT) AS tile"), "tiles").alias("place"))
    return placed.groupBy(*own).agg(F.bit_or("bit").alias("longs"), F.collect_list("place").alias("places"))


def _roots(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex that each of n reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, label[cols])
        np.minimum.at(new, cols, label[rows])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unit_links(key: int, tile: np.ndarray, vec: np.ndarray, n: np.ndarray, longs: np.ndarray, near: np.ndarray, x: np.ndarray, same: bool) -> tuple | None:
    order = np.argsort(vec, kind="stable")
    tile, vec, n, longs, near, x = tile[order], vec[order], n[order], longs[order], near[order], _unit(x[order])
    names, number = np.unique(near, return_inverse=True)
    has = np.zeros((len(vec), len(names)), np.float32)
    has[np.arange(len(vec))[:, None], number.reshape(near.shape)] = 1
    # candidates by the number of pivots that both descriptions hold
    rows, cols = np.nonzero(has @ has.T >= min(SHARED, near.shape[1]))
    keep = (rows < cols) & (same | (tile[rows] != tile[cols]))
    rows, cols = rows[keep], cols[keep]
    own, posts = np.zeros(len(rows), bool), keys_of(near, longs)
    last = np.iinfo(np.int64).max
    for k in range(0, len(rows), 65536):
        i, j = rows[k : k + 65536], cols[k : k + 65536]
        close = np.flatnonzero((x[i] * x[j]).sum(axis=1) >= THRESHOLD)
        i, j = i[close], j[close]
        # the list that counts is the one with the lowest key that both are posted under
        a, b = posts[i], posts[j]
        common = np.where((a >= 0) & (a[:, :, None] == b[:, None, :]).any(axis=2), a, last)
        own[k + close] = common.min(axis=1, initial=last) == key
    rows, cols = rows[own], cols[own]
    if not len(rows):
        return None
    linked = np.bincount(rows, weights=n[cols], minlength=len(vec)) + np.bincount(cols, weights=n[rows], minlength=len(vec))
    touched = np.flatnonzero(linked > 0)
    return vec[touched], linked[touched].astype(np.int64), vec[_roots(rows, cols, len(vec))][touched]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units come sorted; the last of a batch is held until the next shows that it is whole."""
    names, held = [f.split()[0] for f in FOUND.split(", ")], None

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        t = t.combine_chunks()
        get = lambda name: t.column(name).combine_chunks() if t.column(name).num_chunks != 1 else t.column(name).chunk(0)
        key = [get(k).to_numpy(zero_copy_only=False) for k in ("key", "t1", "t2")]
        (tile, vec, n, longs), near, x = (get(k).to_numpy() for k in ("tile", "vec", "n", "longs")), get("near"), get("embedding")
        edges = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
        found = []
        for a, b in zip(edges, [*edges[1:], len(vec)], strict=True):
            if b - a > 1 and (one := _unit_links(int(key[0][a]), tile[a:b], vec[a:b], n[a:b], longs[a:b], _matrix(near.slice(a, b - a)).astype(np.int32), _matrix(x.slice(a, b - a)), key[1][a] == key[2][a])):
                found.append(one)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=names)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        key = [t.column(k).to_numpy() for k in ("key", "t1", "t2")]
        start = int(np.argmax(np.all([k == k[-1] for k in key], axis=0)))
        yield from links(t.slice(0, start))
        held = t.slice(start)
    if held is not None:
        yield from links(held)


def near_duplicates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    hashed = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(SEED), "embedding")})
    fine = hashed.filter(_usable())
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    totals = {r["d"]: r["count"] for r in fine.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()}
    if not totals:
        return alone(rows)
    points = {d: pivots(fine.filter(F.size("embedding") == d), d, total) for d, total in totals.items()}
    described = scratch.keep("described", describe(fine, points))
    merged = described.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec"), F.count("*").alias("n"), F.first("near").alias("near"))
    merged = scratch.keep("merged", merged)
    there = posted(merged.filter("vec IS NOT NULL"), scratch).join(merged.select("vec", "h1", "h2", "n", "near"), ["vec", "h1", "h2"])
    # one row of each entry is read again, now that its lists are known
    once = fine.dropDuplicates(["vec_id", "h1", "h2"]).withColumnRenamed("vec_id", "vec")
    units = once.join(there, ["vec", "h1", "h2"]).select("vec", "n", "longs", "near", "embedding", F.inline("places"))
    units = units.withColumn("other", F.expr("explode(sequence(0, tiles - 1))")).select("key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "vec", "n", "longs", "near", "embedding")
    # unit sizes are even, whatever the lists' lengths
    dealt = units.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    found = scratch.keep("found", dealt.mapInArrow(_verify, FOUND))
    linked = found.groupBy("vec").agg(F.sum("linked").alias("linked"))
    joined = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")), scratch)
    groups = merged.join(linked, "vec", "left").join(joined.select(F.col("a").alias("vec"), F.col("b").alias("least")), "vec", "left")
    groups = groups.select("h1", "h2", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("least", "vec").alias("least"))
    done = described.select("vec_id", "h1", "h2").join(groups, ["h1", "h2"])
    done = done.select("vec_id", F.col("links").cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")).withColumn("kept", F.expr("vec_id <=> component_id"))
    return done.unionByName(alone(rows.filter(~_usable())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "vectors"))
