"""Quality scores by compression against two dictionaries.

A zstandard dictionary is built from good labelled text and one from bad. Every text is cut
into blocks, each compressed by itself with either dictionary. The raw figure is the
difference of the compressed sizes, bad less good, over the plain size: once for the whole
text and once for its worst block. A logistic curve fitted on labelled rows that neither
dictionary has seen turns the two into a score; nothing else is an input of it. The plain
size is the norm, since a block that repeats itself shrinks to a few bytes under either
dictionary, and a ratio of two such sizes says nothing.

Fitting sees a bounded sample: ``PER_CLASS`` labelled rows of either class, lowest by a
seeded hash, half of them for the dictionaries and half for the curve. The driver gets at
most ``PARTS`` blocks of a text of the first half, and two figures of a text of the second.
Scoring covers every whole text and is one pass without a shuffle.

Cases: null and empty texts have the raw figure 0 and get the curve's value there; a
document without a label is scored like any other; a document with several labels trains
once for each; of rows that share an id the lowest text trains; repeated rows are scored
alike; an empty table gives no rows; columns of any name are carried as they are; if one
class has no rows to learn from, every score is the share of label 1 among the labelled
rows, or 0.5 without any. Labels, lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import Scratch, table

PER_CLASS = 1500
SEED = "quality-1"
DICTIONARY = 64 * 1024
#: Bytes of a block: the dictionaries matter most near a block's start.
BLOCK = 512
LEVEL = 3
#: Blocks of a training text that may go into a dictionary, chosen by hash from all of them.
PARTS = 16
#: What the raw figures are multiplied by, so that the curve's weights are near 1.
SCALE = 20


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        if not self.good:
            return lambda text: _logistic(self.weights[0])
        packers = self.packers()
        return lambda text: _logistic(float(np.dot(self.weights, (1.0, *differences(text, *packers)))))

    def packers(self) -> list:
        import zstandard

        found = []
        for raw in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=LEVEL)
            found.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return found


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _blocks(text: bytes) -> list[bytes]:
    return [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]


def differences(text: bytes, good, bad) -> tuple[float, float]:
    """The normalised size difference of the whole text and of its worst block.

    A block of less than half the usual size is judged only where there is no other.
    """
    if not text:
        return 0.0, 0.0
    found = [(len(bad(b)) - len(good(b)), len(b)) for b in _blocks(text)]
    full = [x for x in found if x[1] * 2 >= BLOCK] or found
    return SCALE * sum(d for d, _ in found) / len(text), SCALE * min(d / n for d, n in full)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, lightly held towards 0, classes weighed as they come."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(parts: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL, threads=1).as_bytes()
    except zstandard.ZstdError:  # too few distinct samples to choose from: the texts themselves serve
        return b"".join(parts)[:DICTIONARY] or b"\n" * 8


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label, id, half (0: for a dictionary, 1: for the curve) and text (t) of the rows to learn from."""
    own = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL")
    order = F.md5(F.concat(F.lit(SEED), F.col("id").cast("string")))
    chosen = None
    for k in (0, 1):
        part = own.filter(F.col("label") == k).orderBy(order, "id").limit(PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    half = (F.row_number().over(Window.partitionBy("label").orderBy("at", "id")) + 1) % 2  # over the bounded sample
    chosen = chosen.withColumn("at", order).withColumn("half", half)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")
    return texts.groupBy("id").agg(F.encode(F.min("t"), "UTF-8").alias("t")).join(F.broadcast(chosen), "id").select("label", "at", "id", "half", "t")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled documents; the sample is bounded, the class shares are counted over all."""
    counts = {r["quality"]: r["n"] for r in labels.filter("quality IN (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.keep("sample", sample(docs, labels))
    found = {(r["label"], r["half"]): r["count"] for r in rows.groupBy("label", "half").count().collect()}
    odds = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if min(found.get((k, h), 0) for k in (0, 1) for h in (0, 1)) < 10:
        scratch.drop("sample")
        return Model(b"", b"", (odds,))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, at, key, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                some = sorted((hashlib.md5(b).digest(), k, b) for k, b in enumerate(_blocks(text)) if len(b) >= 16)[:PARTS]
                out += [(label, at, key, k, b) for _, k, b in some]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["label", "at", "id", "k", "part"])

    told = lambda h: rows.filter(F.col("half") == h).select(F.col("label").cast("int").alias("label"), "at", F.col("id").cast("long").alias("id"), "t")
    blocks = sorted((r["label"], r["at"], r["id"], r["k"], bytes(r["part"])) for r in told(0).mapInArrow(parts, "label int, at string, id long, k int, part binary").collect())
    raw = Model(*(dictionary([b[4] for b in blocks if b[0] == k]) for k in (1, 0)), ())

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = raw.packers()
        for batch in batches:
            x = [differences(t, *packers) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *(pa.array([r[k] for r in x], pa.float64()) for k in (0, 1))], names=["label", "at", "id", "whole", "worst"])

    curve = sorted(map(tuple, told(1).mapInArrow(figures, "label int, at string, id long, whole double, worst double").collect()))
    scratch.drop("sample")
    x, y = np.array([(1.0, *r[3:]) for r in curve]), np.array([r[0] for r in curve], float)
    w = _fit(x, y)
    # the sample has the classes in other shares than the labelled rows
    w[0] += odds - math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    return Model(raw.good, raw.bad, tuple(map(float, w)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            found = [of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, all columns, that score ``least`` or more."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_buffer().to_pybytes() if t.is_valid else b"") >= least for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id"):
    return F.expr(f"crc32(CAST({column} AS STRING)) % 3 = 1")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.expr("CAST(score >= 0.5 AS INT)").alias("predicted"))
