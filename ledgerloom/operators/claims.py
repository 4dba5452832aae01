"""Claims and other changes of state that several workers make on one versioned table of documents.

A worker reads a version, chooses and marks what it takes, and commits on that version. One
that was overtaken chooses again from what is there by then, so that no document has two
owners. A change of some batches only rewrites the buckets these batches lie in, where the
table's key is ``batch_id``.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import batches, documents
from ledgerloom.operators.rewrites import cascade, release_running, upsert
from ledgerloom.sources.versions import VersionedTable


def take(docs: DataFrame, worker: str, stage: str, most_attempts: int | None = None, each: int = 1, batch: int | None = None) -> DataFrame:
    """All documents; in each batch the first ``each`` that the stage may be claimed for are running and the worker's."""
    ready = documents.ready(stage, most_attempts)
    ready = ready if batch is None else ready & (F.col("batch_id") == batch)
    free = docs.filter(ready)
    if each == 1:  # one row a batch, found with partial sums
        first = free.groupBy("batch_id").agg(F.min("id").alias("id")).select("id")
    else:
        first = free.withColumn("_k", F.row_number().over(Window.partitionBy("batch_id").orderBy("id"))).filter(F.col("_k") <= each).select("id")
    marked = docs.join(first.withColumn("_mine", F.lit(True)), "id", "left")
    new = {f"{stage}_state": F.when(F.col("_mine"), "running").otherwise(F.col(f"{stage}_state")), "claimed_by": F.when(F.col("_mine"), worker).otherwise(F.col("claimed_by"))}
    if f"{stage}_attempts" in docs.columns:
        new[f"{stage}_attempts"] = F.when(F.col("_mine"), F.col(f"{stage}_attempts") + 1).otherwise(F.col(f"{stage}_attempts"))
    return marked.withColumns(new).drop("_mine").select(*docs.columns)


def claim(table: VersionedTable, worker: str, stage: str, most_attempts: int | None = None, each: int = 1) -> int:
    """Claim the next documents of every batch for a worker; the version that holds the claim."""
    return table.update(lambda docs: take(docs, worker, stage, most_attempts, each), about=f"{worker} claims {stage}")


def settle(table: VersionedTable, worker: str, stage: str, outcomes: DataFrame) -> int:
    """outcomes: id, state, reason. Marks the worker's own running documents; others' stay as they are."""

    def change(docs: DataFrame) -> DataFrame:
        mine = docs.filter((F.col("claimed_by") == worker) & (F.col(f"{stage}_state") == "running")).select("id")
        marked = documents.mark_stage(docs, outcomes.join(mine, "id", "left_semi"), stage)
        return marked.join(mine.withColumn("_mine", F.lit(True)), "id", "left").withColumn("claimed_by",
            F.when(F.col("_mine") & (F.col(f"{stage}_state") != "running"), None).otherwise(F.col("claimed_by"))).select(*docs.columns)

    return table.update(change, about=f"{worker} settles {stage}")


def release(table: VersionedTable, worker: str) -> int:
    """A worker is gone: what it had running waits again, and the attempt is given back."""

    def change(docs: DataFrame) -> DataFrame:
        own = F.coalesce(F.col("claimed_by") == worker, F.lit(False))
        return docs.filter(~own).unionByName(release_running(docs.filter(own)).withColumn("claimed_by", F.lit(None).cast("string")))

    return table.update(change, about=f"{worker} released")


def replace(table: VersionedTable, rows: DataFrame, keys: list[str], order: list[str]) -> int:
    """Rows in place of those with their key, on whatever version is the last."""
    return table.update(lambda old: upsert(old, rows, keys, order), about="upsert")


def _without(rows: DataFrame, before: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows but those that went from ``before`` to ``kept``, by their ids; rows that came since stay."""
    gone = before.select("id").join(kept.select("id"), "id", "left_anti")
    return rows.join(gone, "id", "left_anti").select(*rows.columns)


class Busy(Exception):
    """A batch that is to go still has documents at work."""


def delete_batch(tables: dict[str, VersionedTable], links: list[tuple[str, str, str, str]], batch: int, force: bool = False, waits: int = 5, pause: float = 1.0) -> dict[str, int]:
    """Delete a batch and what depends on it; the new version of each table.

    A batch at work isn't deleted. Forced, it is stopped first, and so many times waited for
    its documents to come to rest; raises ``Busy`` if they don't. Children go before their
    parents, so a run that breaks off leaves no child without a parent and can be repeated.
    """
    def free() -> bool:
        batch_rows, docs = tables["batches"].read().filter(F.col("id") == batch), tables["documents"].read()
        row = batches.deletable(batch_rows, docs, force).first()
        return row is None or bool(row["deletable"])

    if force:
        tables["batches"].update(lambda rows: rows.withColumn("state",
            F.when((F.col("id") == batch) & F.col("state").isin("queued", "running"), "stopping").otherwise(F.col("state"))), about=f"stop {batch}")
    for k in range(waits + 1):
        if free():
            break
        if not force or k == waits:
            raise Busy(f"batch {batch} has documents at work")
        time.sleep(pause)
    held = {name: t.read() for name, t in tables.items()}
    gone = held["batches"].filter(F.col("id") == batch).select("id")
    kept, order = cascade(held, gone, links), [*reversed([child for _, _, child, _ in links]), "batches"]
    return {name: tables[name].update(lambda rows, name=name: _without(rows, held[name], kept[name]), about=f"delete batch {batch}") for name in dict.fromkeys(order)}
