"""Documents through their stages as a stateful stream: claim, answer, retry, give up, timers.

An event is the answer to an attempt at a document's current stage. State, one row a
document, holds the stage, the attempts made at it and when the last answer came; Spark keeps
it in its state store and restores it from the checkpoint. A retryable failure leaves the
document where it is while attempts last; another one, or the last, fails it. A document
that no answer has come for in ``idle`` of event time is given back: a timer in event time
tells it as stalled, with the attempt returned. What a document has become is final once it
is processed or failed; later answers change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.rewrites import STAGES

#: Attempts after the first one.
LIMITS = {"ocr": 1, "extract": 1, "validate": 0, "translate": 1}
#: The order in which stages are done.
ORDER = ("ocr", "extract", "validate", "translate")
FINAL = ("processed", "failed")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "document long, stage string, attempts int, status string, reason string, seen_at timestamp"
assert set(ORDER) == set(STAGES)


def answer(state: tuple, ok: bool, retryable: bool, limits: dict[str, int]) -> tuple:
    """(stage, attempts, status, reason) after one more attempt's answer."""
    stage, attempts, status, reason = state
    if status in FINAL:
        return state
    attempts += 1
    if ok:
        k = ORDER.index(stage) + 1
        return (ORDER[k], 0, "pending", "") if k < len(ORDER) else (stage, attempts, "processed", "")
    if not retryable:
        return stage, attempts, "failed", f"{stage} can't succeed"
    if attempts > limits[stage]:
        return stage, attempts, "failed", f"{stage} gave up after {attempts} attempts"
    return stage, attempts, "retry", ""


class StageMachine(StatefulProcessor):
    """Rows: document, id, ts, ok, retryable. A row for each document that a micro-batch or a timer has moved."""

    def __init__(self, limits: dict[str, int], idle_ms: int):
        self.limits, self.idle = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "stage string, attempts int, status string, reason string, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "id"])  # a document's answers of one micro-batch
        *state, seen = self.at.get() if self.at.exists() else (ORDER[0], 0, "pending", "", 0)
        state = tuple(state)
        for ts, ok, retryable in zip(frame["ts"], frame["ok"], frame["retryable"], strict=True):
            if state[2] not in FINAL:
                seen = int(ts.value // 1_000_000)
            state = answer(state, bool(ok), bool(retryable), self.limits)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[2] not in FINAL:
            self.handle.registerTimer(seen + self.idle)
        self.at.update((*state, seen))
        yield self._row(key, state, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stage, attempts, status, reason, seen = self.at.get()
        if status not in FINAL:
            state = (stage, max(0, attempts - 1), "stalled", reason)
            self.at.update((*state, seen))
            yield self._row(key, state, seen)

    def close(self) -> None:
        """Nothing is held."""

    @staticmethod
    def _row(key, state: tuple, seen: int) -> pd.DataFrame:
        stage, attempts, status, reason = state
        return pd.DataFrame({"document": [key[0]], "stage": [stage], "attempts": pd.array([attempts], "int32"), "status": [status], "reason": [reason], "seen_at": [pd.Timestamp(seen, unit="ms")]})


def advance(answers: DataFrame, limits: dict[str, int] = LIMITS, idle_ms: int = 86_400_000, late: str = "0 seconds") -> DataFrame:
    """answers (a stream): document, id, ts, ok, retryable. Every change of a document's state; needs the RocksDB state store."""
    marked = answers.withWatermark("ts", late)
    return marked.groupBy("document").transformWithStateInPandas(StageMachine(limits, idle_ms), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def run(spark: SparkSession, answers: DataFrame, folder: str, limits: dict[str, int] = LIMITS, idle_ms: int = 86_400_000) -> DataFrame:
    """Runs what there is through and returns each document's last state.

    Micro-batches write their changes under their numbers, so one that is run again replaces
    its own; the last of a document holds.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/{number:09d}")

    try:
        advance(answers, limits, idle_ms).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    names = [f.split()[0] for f in OUT.split(", ")]
    changes = spark.read.schema(f"{OUT}, batch int").parquet(f"{folder}/changes/*")
    # a timer's row and a later answer's are of different micro-batches
    return changes.groupBy("document").agg(F.max_by(F.struct(*names[1:]), "batch").alias("s")).select("document", "s.*")
