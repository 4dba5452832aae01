"""Structured Streaming twins: batch progress, and pressure with state kept by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators import documents, validation
from ledgerloom.operators.folds import next_level
from ledgerloom.sources import scrape


def counts(events: DataFrame) -> DataFrame:
    """Events by user and type, batch or stream alike."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("hundredths"))


def stream_progress(spark: SparkSession, path: str, name: str, checkpoint: str) -> DataFrame:
    """Reads what is there as a stream, in one go, and returns the counts it ended with.

    Each micro-batch writes the counts that changed under its number; the last of each key
    holds. The result stays in the shared store, and nothing of it in the driver.
    """
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(path)
    out = f"{checkpoint}-counts"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number:06d}")

    query = counts(events).writeStream.outputMode("update").queryName(name).option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    keys = ["user_id", "event_type"]
    schema = counts(spark.read.parquet(path)).withColumn("batch", F.lit(0)).schema
    return spark.read.schema(schema).parquet(f"{out}/*").groupBy(*keys).agg(F.max_by(F.struct("n", "hundredths"), "batch").alias("c")).select(*keys, "c.*")


def run_to_table(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there into a table in the shared store."""
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def gated(docs: DataFrame) -> DataFrame:
    """doc_id, text and the reason why the text can't be a document's, null if it can."""
    return docs.withColumn("reason", documents.text_gate(F.col("text"), F.lit(1)))


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, text and the answer that patterns alone give."""
    return docs.withColumn("answer", scrape.answer(F.col("text")))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id and the state that the report on an answer leads to."""
    told = docs.select("doc_id", "answer", "text", F.lit(False).alias("truncated"), F.lit(True).alias("ocr_ok"))
    return validation.validate(told).select("doc_id", F.col("disposition").alias("state"))


#: What each stage does; others of the same shape can stand in for any of them.
STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {"gate": gated, "extract": extracted, "validate": judged}


def through_stages(docs: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """doc_id, state and reason of documents (doc_id, text), batch or stream alike; ``stages`` replaces some of ``STAGES``."""
    does = STAGES | (stages or {})
    first = does["gate"](docs)
    fine = first.filter("reason IS NULL").drop("reason")
    told = does["validate"](does["extract"](fine)).select("doc_id", "state", F.lit(None).cast("string").alias("reason"))
    return told.unionByName(first.filter("reason IS NOT NULL").select("doc_id", F.lit("failed").alias("state"), "reason"))


def process_documents(spark: SparkSession, path: str, out: str, checkpoint: str, stages: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> None:
    """New documents (doc_id, text) through their stages, each micro-batch as one plan.

    A micro-batch that is run again after a failure overwrites what it wrote.
    """
    docs = spark.readStream.schema("doc_id long, text string").parquet(path)

    def run(batch: DataFrame, number: int) -> None:
        through_stages(batch, stages).write.mode("overwrite").parquet(f"{out}/batch={number}")

    docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tumbling hours with a bound on lateness (an extension of our own)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))


def _levels(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    level = state.get[0] if state.exists else "normal"
    for frame in frames:
        out = []
        for free in frame.sort_values(["ts", "id"])["free"]:
            level = next_level(free, level)
            out.append(level)
        yield frame.sort_values(["ts", "id"]).assign(level=out)[["source", "id", "level"]]
    state.update((level,))


def pressure_stream(samples: DataFrame) -> DataFrame:
    """samples: (source, id, ts, free), in order per source. The level after each."""
    return samples.groupBy("source").applyInPandasWithState(_levels, "source long, id long, level string", "level string", "append", GroupStateTimeout.NoTimeout)
