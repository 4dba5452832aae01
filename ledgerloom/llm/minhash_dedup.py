"""Near-duplicate texts by DartMinHash signatures and banded joining.

A text is the multiset of its runs of ``SHINGLE`` words (a shorter text is one run), weighed
by their counts; two texts are near copies if the weighted Jaccard similarity, the sum of
minima over the sum of maxima, is ``THRESHOLD`` or more.

Signature: each unit of an element's weight is a region on which hashed darts fall at rate 1,
the same for every text that has the region. A text takes the darts in its regions up to a
rank that yields about ``K`` (ln K + 2) of them, deals them to ``K`` coordinates by hash, and
keeps the earliest of each; if a coordinate is still empty, the rank is doubled. Two texts
agree in a coordinate with the probability of their similarity, and short texts cost as
little as long ones. Runs of ``ROWS`` coordinates are hashed to ``BANDS`` band keys: at 0.8
a pair shares none of them with a probability of one in 20,000.

Joining: equal texts (word for word) are merged first; what is joined from then on are texts,
by a hash of their words, and not ids. In a band's bucket every text is compared with two of
the bucket's texts (those lowest by two hashes, found by an aggregate with map-side
combining), exactly, on whole texts. Only texts that some comparison needs are shuffled to
it, and a text that very many are compared with goes to several tasks. After components are formed, a bucket
that still holds several components is compared throughout: its texts are cut into tiles of
about ``TILE``, each pair of tiles is one unit of work that counts the shared shingles of all
its pairs by a matrix product and yields each text's smallest near copy reached in the unit,
never the pairs. So no pair that shares a bucket is left open, a large group of copies costs
a few comparisons a text, and a large group of lookalikes is spread over many tasks.

Cases: null texts and texts without words are near nothing; equal texts are one class; ties
don't matter, since a component's id is its smallest doc_id; rows that share an id and
differ in text are apart; an empty table gives no rows; columns of any name are carried as
they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.session import Scratch, table

SHINGLE = 5
#: The threshold as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
THRESHOLD = NUMERATOR / DENOMINATOR
BANDS, ROWS = 26, 5
K = BANDS * ROWS
DARTS = K * (math.log(K) + 2)
SIGNED = "doc_id long, h long, key long, n long, bands array<long>"
REMEMBERED = 500_000
#: Buckets with more texts than this, and than the MOST-th part of all, are broadcast to their texts: at most MOST.
HOT, MOST = 64, 8192
#: Comparisons with one text that a task may get.
SALT = 512
#: Texts of a tile, and cells of the matrix that a unit fills at a time.
TILE = 256
CELLS = 8_000_000

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BREAK = re.compile(r"[\x20\x09-\x0D]+")
_RARE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]").search


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of a text's words and shingles; words are remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        found = _BREAK.split(text.strip(" \t\n\x0b\x0c\r")) if _RARE(text) else text.split()
        if not found or found == [""]:
            return np.zeros(0, np.uint64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    @staticmethod
    def key(words: np.ndarray) -> int:
        return xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63)

    @staticmethod
    def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and their counts."""
        n = len(words)
        if not n:
            return words, np.zeros(0, np.int64)
        k = min(n, SHINGLE)
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = _mix(h * _STEP + words[i : n - k + 1 + i])
        return np.unique(h, return_counts=True)


def _regions(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash for each unit of each element's weight."""
    first = np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return _mix(np.repeat(elements, counts) + (np.arange(int(counts.sum())) - first).astype(np.uint64) * _STEP)


def signature(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The earliest dart of each coordinate, as a hash of the dart."""
    regions = _regions(elements, counts)
    weight, rank = len(regions), DARTS / len(regions)
    while True:
        own, at, done, found = regions, np.zeros(weight), 0, []
        while len(own):
            # darts of a region arrive on the rank axis one after the other
            steps = np.arange(done + 1, done + 2 + int(1.2 * (rank - at.min())), dtype=np.uint64)[: max(1, 200_000 // len(own))]
            darts = _mix(own[:, None] ^ (steps * _M2)[None, :])
            gaps = -np.log(((darts >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            ranks = at[:, None] + np.cumsum(gaps, axis=1)
            hit = ranks <= rank
            found.append((ranks[hit], darts[hit]))
            more = hit[:, -1]
            own, at, done = own[more], ranks[more, -1], done + len(steps)
        ranks, darts = (np.concatenate(c) for c in zip(*found, strict=True))
        names = _mix(darts + _STEP)
        order = np.lexsort((names, ranks))[::-1]
        out, filled = np.zeros(K, np.uint64), np.zeros(K, bool)
        spot = (names[order] % np.uint64(K)).astype(np.int64)
        out[spot], filled[spot] = names[order], True  # the last written is the earliest
        if filled.all():
            return out
        rank *= 2


def bands(signed: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * _STEP + signed.reshape(BANDS, ROWS)[:, k])
    return h.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, hashes of the text and of its words, the number of shingles, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            keys, sizes, out = [], [], []
            for text in batch.column(2):
                words = shingler.words(text.as_py() or "")
                elements, counts = shingler.shingles(words)
                keys.append(shingler.key(words))
                sizes.append(int(counts.sum()))
                out.append(bands(signature(elements, counts)) if len(words) else np.zeros(0, np.int64))
            column = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(b) for b in out])]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *out])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), column], names=["doc_id", "h", "key", "n", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, SIGNED)


def bodies(needed: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, text) of the classes in ``needed`` (key), with the class's key for an id."""
    rows = classes.join(needed, "key").select("key", F.col("id").alias("doc_id"), "h")
    # of equal rows one is read; they are combined before the shuffle
    once = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
    return once.join(rows, ["doc_id", "h"]).select(F.col("key").alias("doc_id"), "text")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are near copies; size: of the largest bucket that both are in."""
    parts = F.ceil(F.col("size") / SALT).cast("int")
    salted = pairs.withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int"))
    spread = pairs.groupBy("b").agg(F.max(parts).alias("parts"))
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")).join(spread, "b").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    # many pairs share b, a bucket's chosen text, and few share a
    joined = salted.join(one, "a").join(two.drop("parts"), ["b", "part"]).select("a", "a_text", "b", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, kept = Shingler(), (None, None)
        for batch in batches:
            near = []
            a, at, b, bt = batch.columns
            for k in range(len(batch)):
                if kept[0] != (other := b[k].as_py()):
                    kept = (other, shingler.shingles(shingler.words(bt[k].as_py())))
                (x, n), (y, m) = shingler.shingles(shingler.words(at[k].as_py())), kept[1]
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                shared = int(np.minimum(n[i], m[j]).sum())
                if shared * DENOMINATOR >= (int(n.sum() + m.sum()) - shared) * NUMERATOR:
                    near.append(k)
            if near:
                yield pa.RecordBatch.from_arrays([a.take(pa.array(near)), b.take(pa.array(near))], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _unit_roots(ids: list[int], texts: list[str], keys: list[int], shingler: Shingler) -> tuple[list[int], list[int]]:
    """Texts of a unit with a near copy in it, and the smallest id each reaches."""
    sets, own = [], []
    for i, text, key in zip(ids, texts, keys, strict=True):
        words = shingler.words(text or "")
        if shingler.key(words) == key:
            sets.append(_regions(*shingler.shingles(words)))
            own.append(i)
    if len(own) < 2:
        return [], []
    sizes = np.array([len(x) for x in sets])
    values, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(own)), sizes)
    # a shingle of one text is shared with none
    number = np.cumsum(seen > 1) - 1
    keep = seen[place] > 1
    doc, feature = doc[keep], number[place[keep]]
    shared, width = np.zeros((len(own), len(own)), np.float64), max(1, CELLS // len(own))
    for lo in range(0, int(feature.max(initial=-1)) + 1, width):
        some = (feature >= lo) & (feature < lo + width)
        m = np.zeros((len(own), min(width, int(feature.max()) + 1 - lo)), np.float32)
        m[doc[some], feature[some] - lo] = 1
        shared += m @ m.T
    near = shared * DENOMINATOR >= (sizes[:, None] + sizes[None, :] - shared) * NUMERATOR
    rows, cols = np.nonzero(np.triu(near, 1))
    if not len(rows):
        return [], []
    ids_ = np.array(own)
    label = ids_.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, rows, label[cols])
        np.minimum.at(new, cols, label[rows])
        if (new == label).all():
            break
        label = new
    return ids_[label != ids_].tolist(), label[label != ids_].tolist()


def _compare_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units come sorted; the rows of one are gathered until the next begins."""
    shingler, unit, ids, texts, keys = Shingler(), None, [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        a, b = _unit_roots(ids, texts, keys, shingler)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for band, t1, t2, i, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if unit != (band, t1, t2):
                yield from done()
                unit, ids, texts, keys = (band, t1, t2), [], [], []
            ids.append(i)
            texts.append(text)
            keys.append(key)
    yield from done()


def compare_throughout(there: DataFrame, texts: DataFrame) -> DataFrame:
    """there: band, id, key. Links (a, b) that join all near copies of each band."""
    tiles = there.groupBy("band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = there.join(tiles, "band").withColumn("tile", F.expr("CAST(pmod(xxhash64(id), tiles) AS INT)")).withColumn("other", F.expr("explode(sequence(0, tiles - 1))"))
    units = placed.select("band", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "id", "key")
    whole = units.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select("band", "t1", "t2", "id", "text", "key")
    return whole.repartition("band", "t1", "t2").sortWithinPartitions("band", "t1", "t2").mapInArrow(_compare_units, "a long, b long")


def _at_bands(rows: DataFrame, there: DataFrame, hot: DataFrame) -> DataFrame:
    """rows (band, ...) joined with ``there`` (band, ...); bands in ``hot`` by broadcast, so that their rows stay where they are."""
    few = F.broadcast(hot)
    cold = rows.join(few, "band", "left_anti").join(there.join(few, "band", "left_anti"), "band")
    return rows.join(F.broadcast(there.join(few, "band", "left_semi")), "band").unionByName(cold)


def grouped(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id long, text. What ``sign`` gives, and per class its key, id, h and its component's id and h.

    A class is what has words and an id; its own id is the smallest of its rows.
    """
    signed = scratch.keep("signed", sign(docs))
    classes = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.keep("classes", classes.select("key", F.col("r.doc_id").alias("id"), "r.h", "n", "bands"))
    banded = classes.select(F.explode("bands").alias("band"), "key", "n")
    lowest = lambda seed: F.min(F.struct(F.xxhash64(F.lit(seed), "key"), "key", "n"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("size"), lowest(1).alias("c1"), lowest(2).alias("c2")).filter("size > 1")
    close = lambda n, m: F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR
    buckets = scratch.keep("buckets", buckets)
    # so large that few can be: the sizes of all buckets add up to BANDS rows a class
    hot = buckets.filter(F.col("size") > max(HOT, classes.count() * BANDS // MOST)).select("band")
    met = _at_bands(banded, buckets, hot).select("key", "n", "size", F.explode(F.array("c1", "c2")).alias("c"))
    met = met.filter((F.col("key") != F.col("c.key")) & close(F.col("n"), F.col("c.n"))).select(F.col("key").alias("a"), F.col("c.key").alias("b"), "size")
    first = scratch.keep("first", met.groupBy("a", "b").agg(F.max("size").alias("size")))
    needed = first.select(F.col("a").alias("key")).unionByName(first.select(F.col("b").alias("key"))).distinct()
    texts = scratch.keep("texts1", bodies(needed, classes, docs))
    joined = components(scratch.keep("links", verify(first, texts)), scratch, "round1")
    # what shares a bucket and isn't in one component yet
    labelled = _at_bands(banded, buckets.select("band"), hot).join(joined.select(F.col("a").alias("key"), F.col("b").alias("least")), "key", "left").withColumn("least", F.coalesce("least", "key"))
    mixed = labelled.groupBy("band").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).filter("lo < hi").select("band")
    there = scratch.keep("open", _at_bands(labelled, mixed, hot).select("band", F.col("key").alias("id"), "key"))
    scratch.drop("first", "texts1", "links")
    if there.limit(1).count():
        texts = scratch.keep("texts2", bodies(there.select("key").distinct(), classes, docs))
        more = scratch.keep("more", compare_throughout(there, texts))
        joined = components(joined.unionByName(more), scratch, "round2")
        scratch.drop("texts2", "more")
    roots = classes.select("key", "id", "h").join(joined.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = roots.groupBy("root").agg(F.min(F.struct("id", "h")).alias("least"))
    return signed, roots.join(least, "root").select("key", "id", "h", F.col("least.id").alias("component_id"), F.col("least.h").alias("component_h"))


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, class_id (equal texts), component_id and kept for every row of (doc_id, text)."""
    signed, classes = grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch)
    out = signed.select("doc_id", "key", "n").join(classes.select("key", "id", "component_id"), "key", "left")
    own = F.expr("n > 0 AND doc_id IS NOT NULL")
    return out.select("doc_id", F.when(own, F.col("id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def one_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents, all columns, one of each component; rows without an id or without words stay."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed, classes = grouped(own, scratch)
    chosen = classes.filter("id = component_id AND h = component_h").select(F.col("id").alias("doc_id"), "h", F.lit(True).alias("one"))
    wordless = signed.filter("n = 0").select("doc_id", "h", F.lit(False).alias("one"))
    copies = signed.groupBy("doc_id", "h").count()
    keys = scratch.keep("keys", copies.join(chosen.unionByName(wordless.distinct()), ["doc_id", "h"]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    here = rows.join(keys, ["doc_id", "h"])
    single = here.filter("count = 1 OR NOT one").select("row")
    # of equal rows of a group's document the first by its other columns; combined before the shuffle
    rest = here.filter("count > 1 AND one").groupBy("doc_id", "h").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(rest).unionByName(rows.filter("doc_id IS NULL").select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "minhash"))
