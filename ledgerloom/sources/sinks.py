"""Writers: the report as one CSV file, a text file a document, and verified snapshots.

Rows are turned into lines and written on executors. One file of many parts is joined by the
file system: parts are named in the order of their ranges, and their bytes are appended one
after the other, by the store itself where it can, else as a stream; no row reaches Python
on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ledgerloom.sources.files import store_of
from ledgerloom.sources.versions import Store

MARK, LINE_END = "\ufeff", "\r\n"


def cell(value: Column) -> Column:
    """A CSV cell: quoted if it holds a comma, a quote or a line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*values: Column) -> Column:
    """Cells with commas between them; one empty cell alone is quoted, so that the line isn't blank."""
    line = F.concat_ws(",", *map(cell, values))
    return F.when(line == "", '""').otherwise(line) if len(values) == 1 else line


def join_parts(spark: SparkSession, folder: str, path: str, head: str) -> None:
    """One file of a head and the parts of a folder, under its name only once it is whole."""
    store, waiting = Store(spark, path), f"{path}.{uuid.uuid4().hex}"
    utils, out = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils, store.fs.create(store.path(waiting), True)
    try:
        out.write(bytearray(head, "utf-8"))
        for name in store.names(folder):
            if name.startswith("part-"):
                part = store.fs.open(store.path(f"{folder}/{name}"))
                try:
                    utils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
    finally:
        out.close()
    store.delete(path)
    if not store.fs.rename(store.path(waiting), store.path(path)):
        raise OSError(f"{path} could not be put in place")


def write_csv(report: DataFrame, columns: tuple[str, ...], path: str, order: list | None = None) -> int:
    """One file with a byte order mark, CRLF and minimal quoting; the number of its rows.

    With an order, rows are dealt by ranges of it and sorted within each, so that the parts,
    one after the other, are in order.
    """
    seen = Observation()
    ordered = report.repartitionByRange(*order).sortWithinPartitions(*order) if order else report
    lines = ordered.observe(seen, F.count(F.lit(1)).alias("n")).select(csv_line(*[F.col(f"`{c}`") for c in columns]).alias("value"))
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    lines.write.option("lineSep", LINE_END).text(folder)
    head = report.sparkSession.range(1).select(csv_line(*[F.lit(c) for c in columns]).alias("h")).first()["h"]
    join_parts(report.sparkSession, folder, path, f"{MARK}{head}{LINE_END}")
    Store(report.sparkSession, path).delete(folder)
    return seen.get["n"]


def write_parts(report: DataFrame, path: str) -> None:
    """The distributed form: a CSV part for each partition."""
    report.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def export_report(report: DataFrame, folder: str, name: str, now: datetime, failed_only: bool = False) -> dict:
    """Writes a batch's report as one file in the order of export; its path and rows, cells that hold no code, and untranslated ones.

    ``report`` is that of ``plans.export``.
    """
    from ledgerloom.operators.batches import export_name
    from ledgerloom.plans import export

    spark = report.sparkSession
    file = spark.range(1).select(export_name(F.lit(name), F.lit(now), failed_only).alias("n")).first()["n"]
    path = f"{folder}/{file}"
    count = write_csv(report, export.COLUMNS, path, export.order())
    told = export.violations(report).orderBy("deed", "ordinal", "column").limit(100).collect()
    untranslated = {r["column"]: r["value"] for r in export.untranslated(report).collect()}
    return {"path": path, "rows": count, "violations": [f"row {r['ordinal']}: {r['column']} = '{r['value']}'" for r in told], "untranslated": untranslated}


class TextFiles(DataSource):
    """Sink for rows of folder, name, text: a file ``<path>/<folder>/<name>.txt`` for each.

    Tasks write each file in a folder of their own beside the others and rename it, so a file
    is there whole or not at all, and a task that is run again writes the same; tasks that
    write to one folder meet there once a file. Stores are those that Arrow opens by the
    path's scheme; a path without one is a folder that all executors mount.
    """

    @classmethod
    def name(cls) -> str:
        return "ledger_texts"

    def schema(self) -> str:
        return "folder string, name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TextWriter(self.options["path"])


def safe_name(name: str) -> str:
    """A name without separators of folders and control signs; what is left empty is an underscore."""
    import re

    return re.sub(r"[\x00-\x1f/\\:]+", "_", name).strip(" .") or "_"


class _Files(WriterCommitMessage):
    def __init__(self, n: int):
        self.n = n


class _TextWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> _Files:
        store, root = store_of(self.path)
        own, made, n = f"{root}/.{uuid.uuid4().hex}", set(), 0
        store.create_dir(own, recursive=True)
        for row in rows:
            folder, name = f"{root}/{safe_name(row['folder'] or '')}", safe_name(row["name"] or "")
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            waiting = f"{own}/{n}"
            with store.open_output_stream(waiting) as out:
                out.write(row["text"].encode())
            store.move(waiting, f"{folder}/{name}.txt")
            n += 1
        store.delete_dir(own)
        return _Files(n)

    def commit(self, messages: list) -> None:
        """Every file is in its place when its task ends."""

    def abort(self, messages: list) -> None:
        """Files that are there are whole, and are written again."""


def write_texts(rows: DataFrame, path: str) -> None:
    """rows: folder, name, text. A text file each in its folder, those without text left out; of equal names the last text by order."""
    spark = rows.sparkSession
    spark.dataSource.register(TextFiles)
    once = rows.filter("text IS NOT NULL").groupBy("folder", "name").agg(F.max("text").alias("text"))
    once.write.format("ledger_texts").mode("append").save(path)


def failure_notes(rows: DataFrame, width: int = 5) -> DataFrame:
    """rows: folder, name, reason. Per folder a note that lists what failed and why, by name."""
    line = F.concat(F.rpad("name", F.greatest(F.length("name"), F.lit(width - 2)), F.lit(" ")), F.lit("  "), "reason")
    failed = rows.filter("reason IS NOT NULL").select("folder", F.struct("name", line.alias("line")).alias("l"))
    return failed.groupBy("folder").agg(F.array_join(F.sort_array(F.collect_list("l"))["line"], "\n").alias("note"))


def archive_faults(spark: SparkSession, path: str, columns: list[str], wanted: int) -> list[str]:
    """What speaks against an archive: it can't be read, has no bytes, other columns, or another number of rows; empty if nothing does."""
    store = Store(spark, path)
    sizes = [s.getLen() for s in store.fs.listStatus(store.path(path))] if store.fs.exists(store.path(path)) else []
    if not sum(sizes):
        return ["the archive is empty"]
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        return [f"the archive can't be read: {e.getCondition()}"]
    faults = [f"no column {c}" for c in columns if c not in found.columns]
    n = found.count()
    return faults + ([f"{n} rows of {wanted}"] if n != wanted else [])


def sound_archive(spark: SparkSession, path: str, wanted: int) -> bool:
    """Whether an archive can be read and has so many rows."""
    return not archive_faults(spark, path, [], wanted)


def snapshot(spark: SparkSession, frame: DataFrame, path: str) -> int:
    """Writes a table and reads it back; raises unless all columns and rows are there."""
    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    wanted = seen.get["n"]
    if faults := archive_faults(spark, path, frame.columns, wanted):
        raise OSError(f"{path}: {'; '.join(faults)}")
    return wanted
