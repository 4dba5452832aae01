"""What is kept, archived, verified and deleted, in an order that loses nothing unarchived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.rewrites import cascade, expire
from ledgerloom.sources.sinks import snapshot

#: parent, its key, child, the child's reference.
LINKS = [("batches", "id", "documents", "batch_id"), ("documents", "id", "pages", "document_id"), ("documents", "id", "persons", "document_id"), ("documents", "id", "failures", "document_id")]


def before_year(rows: DataFrame, column: str, year: int) -> DataFrame:
    """Rows from before the first of January of a year, UTC."""
    return rows.filter(F.col(column) < F.make_timestamp(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def run(spark: SparkSession, tables: dict[str, DataFrame], now: Column, page_days: int, log_days: int, year: int | None, archive: str | None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after retention, and a tally: pages and logs expire; batches from before a year are archived, verified, then deleted.

    The archive has every row that goes with a batch, a folder for each table: documents and
    their pages (as many as have not expired), persons and failures too. All folders are read
    back before a row is deleted. Without an archive no batch is deleted, and one that can't
    be verified raises first. Counts are actions: the verdict is needed before what follows.
    """
    out, tally = dict(tables), {}
    for name, days in (("pages", page_days), ("logs", log_days)):
        out[name] = expire(tables[name], "created_at", now, days)
        tally[name] = tables[name].count() - out[name].count()
    tally["batches"] = tally["documents"] = 0
    if year is not None and archive is not None:
        links = [a for a in LINKS if a[2] in out]
        gone = before_year(tables["batches"], "created_at", year)
        lost = {"batches": gone}
        for parent, key, child, reference in links:
            lost[child] = out[child].join(lost[parent].select(F.col(key).alias(reference)), reference, "left_semi").select(*out[child].columns)
        for name, rows in lost.items():
            archived = snapshot(spark, rows, f"{archive}/{name}")
            if name in ("batches", "documents"):
                tally[name] = archived
        kept = {n: spark.read.parquet(f"{archive}/{n}") for n in lost}
        out |= cascade({k: v for k, v in out.items() if k in lost}, kept["batches"].select("id"), links)
    return out, spark.createDataFrame([(k, int(v)) for k, v in tally.items()], "kind string, n long")
