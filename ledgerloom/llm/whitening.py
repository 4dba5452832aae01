"""Whitening of vectors by the covariance of exactly centred whole numbers.

An entry c becomes x = floor(1024 * c) + 100000. With the sums S over all n vectors of the
fit list, n * x - S is a whole number, so rows are centred without rounding; divided by n
they are the rows of a Spark MLlib ``RowMatrix``. ``computeGramianMatrix`` over n is the
covariance V, whose eigenvectors are found locally and broadcast; ``mapInPandas`` projects
every centred row on them, over the root of the eigenvalue. What comes out is centred and
multiplied once more by a RowMatrix, which tells how far its covariance is from the identity.

Scale: sums are one row a dimension, the Gramian one matrix a task, added in a tree; no row is
shuffled. The driver holds matrices of the vectors' length, at most ``WIDEST``.

Cases: a vector that is null, or has a null, non-finite or too large entry (beyond 2 ** 21)
has no rows. Vectors of different lengths have no common covariance: the commonest length
counts (of two, the longer), others have no rows. A component without variance (beyond
rounding) has null whitened values. Repeated rows and null ids are rows as any other; an
empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import Scratch, table

COMPONENTS = 8
WIDEST = 8192
SCALE, SHIFT, BOUND = 1024, 100_000, 2.0**21
#: An eigenvalue counts as none below this share of the largest, times the length.
ROUNDING = 1e-13


def _usable() -> str:
    """NaN is larger than any number; a null entry leaves the test without an answer."""
    return f"forall(embedding, c -> abs(cast(c AS double)) < {BOUND}D)"


def whole(rows: DataFrame) -> DataFrame:
    """(vec_id, x): usable vectors as arrays of whole numbers."""
    return rows.filter(_usable()).select("vec_id", F.expr(f"transform(embedding, c -> cast(floor({SCALE}D * cast(c AS double)) AS long) + {SHIFT}L)").alias("x"))


def _gramian(rows: DataFrame, name: str) -> np.ndarray:
    """Sums of products of the entries of an array column, by MLlib on executors."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(name).alias(name)), name)
    return RowMatrix(vectors).computeGramianMatrix().toArray()


class Fit:
    """The fit list's count, sums and components (columns), with their eigenvalues."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, most: int):
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:most]
        self.n, self.sums, self.values, self.components = n, sums, values[order], vectors[:, order]
        self.trace = float(np.trace(covariance))
        #: Components with variance.
        self.live = self.values > ROUNDING * len(sums) * max(float(values[-1]), 0.0)
        self.explained = np.where(self.live, self.values / self.trace if self.trace else 0.0, 0.0)


def fit(x: DataFrame, most: int = COMPONENTS) -> Fit | None:
    """Fit on every row of (vec_id, x), arrays of one length; None if there is none."""
    dims = x.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("k").collect()
    if not dims:
        return None
    n, sums = dims[0]["n"], [r["s"] for r in dims]
    centred = x.select(F.transform("x", lambda v, k: (F.lit(n) * v - F.get(F.lit(sums), k)).cast("double") / F.lit(float(n))).alias("c"))
    return Fit(n, sums, _gramian(centred, "c") / n, most)


def whiten(x: DataFrame, model: Fit) -> DataFrame:
    """(vec_id, deviation, w): the exact squared length of n * x - S, and the whitened values by component."""
    shared = x.sparkSession.sparkContext.broadcast((model.n, np.array(model.sums), model.components / np.sqrt(np.where(model.live, model.values, np.inf))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, into = shared.value
        for frame in frames:
            if not len(frame):
                continue
            d = n * np.stack(frame["x"].to_numpy()).astype(np.int64) - sums
            # squares may exceed 64 bits: upper and lower halves of 31 bits are multiplied apart
            a = np.abs(d)
            top, low = a >> 31, a & (2**31 - 1)
            squares = [sum(int(v) << s for v, s in zip(part, (62, 32, 0), strict=True)) for part in zip(_total(top, top), _total(top, low), _total(low, low), strict=True)]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": [Decimal(v) for v in squares], "w": list((d / n) @ into)})

    kind = x.schema["vec_id"].dataType.simpleString()
    return x.select("vec_id", "x").mapInPandas(run, f"vec_id {kind}, deviation decimal(38,0), w array<double>")


def _total(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Sums of products by row; products lie below 2 ** 62, their halves are added apart."""
    p = a * b
    return [(int(h) << 31) + int(r) for h, r in zip((p >> 31).sum(axis=1), (p & (2**31 - 1)).sum(axis=1), strict=True)]


def identity_error(whitened: DataFrame, model: Fit) -> float:
    """The largest entry of the whitened covariance minus the identity, over components with variance."""
    live = np.flatnonzero(model.live).tolist()
    if not live:
        return 0.0
    means = whitened.agg(*[F.avg(F.col("w")[k]).alias(f"m{k}") for k in live]).first()
    centred = whitened.select(F.array(*[F.col("w")[k] - F.lit(m) for k, m in zip(live, means, strict=True)]).alias("c"))
    return float(np.abs(_gramian(centred, "c") / model.n - np.eye(len(live))).max())


def whitened(rows: DataFrame, scratch: Scratch, most: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector of (vec_id, embedding) and component, numbered from 1."""
    x = whole(rows)
    lengths = x.groupBy(F.size("x").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is not None and lengths["d"] > WIDEST:
        raise ValueError(f"vectors of {lengths['d']} entries; the driver takes {WIDEST}")
    d = lengths["d"] if lengths is not None else -1
    x = scratch.keep("whole", x.filter(F.size("x") == d))
    model = fit(x, most)
    if model is None:
        model = Fit(1, [0], np.zeros((1, 1)), most)
    out = scratch.keep("whitened", whiten(x, model))
    error = identity_error(out, model)
    parts = F.posexplode(F.arrays_zip(F.col("w"), F.lit(model.live.tolist()).alias("live"), F.lit(model.explained.tolist()).alias("explained"))).alias("k", "p")
    return out.select("vec_id", "deviation", parts).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.when(F.col("p.live"), F.col("p.w")).alias("whitened"), F.col("p.explained").alias("explained"), F.lit(error).alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it exceeds a long, which needs some millions of vectors."""
    found = whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark, "whitening"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
