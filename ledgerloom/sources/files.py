"""Readers: deliveries of files, page text, extraction answers, settings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import nested
from ledgerloom.operators import documents


HEADER, TRAILER = r"%PDF-\d\.\d", "%%EOF"


def verdict(content: Column) -> Column:
    """What a file's bytes say: a version within the first 1,024, and the trailer within the last 4,096."""
    text = lambda b: F.decode(b, "ISO-8859-1")
    head, tail = F.substring(content, 1, 1024), F.when(F.octet_length(content) > 4096, F.substring(content, -4096, 4096)).otherwise(content)
    return F.when(~text(head).rlike(HEADER), "INVALID_PDF").when(F.instr(text(tail), TRAILER) == 0, "INCOMPLETE_PDF").otherwise("VALID")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """PDF files by name, once each, with the verdict from their bytes; Spark's reader lists no file without bytes."""
    files = spark.read.format("binaryFile").load(path).dropDuplicates(["path"])
    return files.filter(F.lower("path").endswith(".pdf")).select("path", "length", "modificationTime", verdict(F.col("content")).alias("verdict"))


def selected(files: DataFrame) -> DataFrame:
    """files: path, length, verdict. One row: how many PDF files are chosen, and their bytes."""
    return files.filter("verdict <> 'INVALID_PDF'").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def settings(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Stored settings over defaults, as one row with a map."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    stored = rows.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    return stored.select(F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key("m", k)), "m").alias("settings"))


def precedence(defaults: DataFrame, stored: DataFrame, environment: DataFrame) -> DataFrame:
    """All: key, value. The environment's value of each setting, else the stored one, else the default."""
    side = lambda df, name: df.select("key", F.nullif(F.trim("value"), F.lit("")).alias(name))
    joined = side(defaults, "d").join(side(stored, "s"), "key", "full_outer").join(side(environment, "e"), "key", "full_outer")
    return joined.select("key", F.coalesce("e", "s", "d").alias("value"))


def as_boolean(value: Column) -> Column:
    """Whether a setting's word means yes."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(False))


def set_values(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Stored settings (key, value) after writing others."""
    return rows.join(values.select("key"), "key", "left_anti").unionByName(values)


def value_of(rows: DataFrame, key: str, default: str) -> str:
    """One setting, or its default."""
    found = rows.filter(F.col("key") == key).select("value").first()
    return default if found is None or found["value"] is None else found["value"]


def rule_settings(rules: dict[str, bool], thresholds: dict[str, str]) -> list[tuple[str, str]]:
    """Switches and bounds of rules as settings: ``rule_`` and the name, yes as ``true``."""
    return [(f"rule_{k}", "true" if v else "false") for k, v in rules.items()] + [(k, str(v)) for k, v in thresholds.items()]


def save_rules(stored: DataFrame, rules: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Stored settings (key, value) after saving rules (key, enabled) and thresholds (key, value); of equal keys the greatest value counts."""
    new = rules.select(F.concat(F.lit("rule_"), "key").alias("key"),
        F.when(F.col("enabled"), "true").otherwise("false").alias("value")).unionByName(thresholds.select("key",
        F.col("value").cast("string").alias("value")))
    return set_values(stored, new.groupBy("key").agg(F.max("value").alias("value")))


def same_header(spark: SparkSession, path: str, columns: tuple[str, ...]) -> list[tuple[int, str, str]]:
    """Places where a CSV file's header differs from the columns."""
    found = spark.read.option("header", True).csv(path).columns
    width = max(len(found), len(columns))
    pairs = zip([*found, *[""] * (width - len(found))], [*columns, *[""] * (width - len(columns))], strict=True)
    return [(k, a, b) for k, (a, b) in enumerate(pairs) if a != b]


def store_of(path: str):
    """The store that Arrow opens for a path, and the path within it; one without a scheme is a mounted folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def files_in_folders(spark: SparkSession, path: str) -> DataFrame:
    """folder, name and content of every file in the folders of a path; hidden ones are left out.

    Tasks list the folders, one a folder, and read the files, so that the driver holds no list
    of them and no task is opened for a few of them.
    """
    from pyarrow import fs

    def listed(batches: Iterator[pa.RecordBatch], folders: bool) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{root}/{folder}" if folder else root))
                names = [x.base_name for x in found if x.type == (fs.FileType.Directory if folders else fs.FileType.File) and x.base_name[0] != "."]
                for k in range(0, len(names), 10_000):
                    own = names[k : k + 10_000]
                    yield pa.RecordBatch.from_pydict({"folder": own} if folders else {"folder": [folder] * len(own), "name": own})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        rows: list[tuple[str, str, bytes]] = []
        size = 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["folder", "name", "content"])
        for batch in batches:
            for folder, name in zip(batch.column("folder").to_pylist(), batch.column("name").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{folder}/{name}", compression=None) as file:
                    rows.append((folder, name, file.read()))
                size += len(rows[-1][2])
                if size > 1 << 23 or len(rows) == 10_000:
                    yield made()
                    rows, size = [], 0
        yield made()

    top = spark.createDataFrame([("",)], "folder string").mapInArrow(lambda b: listed(b, True), "folder string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = top.repartition(tasks, "folder").mapInArrow(lambda b: listed(b, False), "folder string, name string")
    return names.repartition(tasks, "folder", "name").mapInArrow(read, "folder string, name string, content binary")


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split of a file: whether it turns open quotes into closed ones, and whether it has a line that begins closed if the first begins open."""
    odd: dict[int, bool] = {}
    begins: dict[int, bool] = {}
    for batch in batches:
        blocks, quotes = batch.column("block").to_numpy(), _quotes(batch.column("value"))
        edges = np.flatnonzero(np.diff(blocks, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(blocks)], strict=True):
            block = int(blocks[a])
            before = (odd.get(block, False) + np.cumsum(quotes[a:b]) - quotes[a:b]) % 2 == 1
            begins[block] = begins.get(block, False) or bool(before.any())
            odd[block] = bool((odd.get(block, False) + quotes[a:b].sum()) % 2)
    yield pa.RecordBatch.from_arrays([pa.array(list(odd), pa.int64()), pa.array(list(odd.values()), pa.bool_()), pa.array([begins[k] for k in odd], pa.bool_())], names=["block", "odd", "begins"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records after the head of one CSV file with CRLF, as text; its parts are read by as many tasks as it has splits.

    A cell may hold line ends, so a line begins a record only if an even number of quotes
    stands before it. A first pass tells that number's parity for each split (a row a split
    comes to the driver), a second one joins the lines of records. The few records that run
    over splits are joined from their pieces. The head is one line.
    """
    lines = spark.read.option("lineSep", "\r\n").text(path).select(F.col("_metadata.file_block_start").alias("block"), "value")
    starts: dict[int, tuple[bool, int]] = {}  # of each split: whether it begins within a record, and where that began
    inside, began = False, 0
    for block, odd, begins in sorted(map(tuple, lines.mapInArrow(_ends, "block long, odd boolean, begins boolean").collect())):
        starts[block] = inside, began
        began = block if not inside or begins else began
        inside ^= odd

    def made(found: list[tuple[int | None, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["began", "block", "record"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, inside, first = None, [], False, False

        def left() -> list[tuple[int | None, int, str]]:
            """What a split ends with: a piece of a record of this split, or of an earlier one."""
            return [(starts[at][1] if first else at, at, "\r\n".join(held))] if held else []

        for batch in batches:
            found: list[tuple[int | None, int, str]] = []
            for block, line, quotes in zip(batch.column("block").to_pylist(), batch.column("value").to_pylist(), _quotes(batch.column("value")).tolist(), strict=True):
                if block != at:
                    found += left()
                    at, held, (inside, _) = block, [], starts[block]
                    first = inside  # the piece belongs to a record that began before
                    if not block:
                        continue  # the head
                held.append(line)
                inside ^= bool(quotes % 2)
                if not inside:
                    found += left() if first else [(None, at, "\r\n".join(held))]
                    held, first = [], False
            yield made(found)
        yield made(left())

    told = lines.mapInArrow(joined, "began long, block long, record string")
    pieces = told.filter("began IS NOT NULL").groupBy("began").agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "record")))["record"], "\r\n").alias("record"))
    return told.filter("began IS NULL").select("record").unionByName(pieces.select("record")).filter("record <> ''")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of one CSV file with a head, CRLF and quotes doubled in quoted cells, read by many tasks."""
    options = {"escape": '"', "multiLine": "true"}
    return csv_records(spark, path).select(F.inline(F.array(F.from_csv("record", schema, options))))


def recognised(rows: DataFrame, raw: Column, pages: Column, least: int = documents.LEAST_CHARS) -> DataFrame:
    """rows with text, lines, bad_lines and reason of an engine's answer: malformed, without text, or with too little a page."""
    told = rows.withColumns({"_answer": nested.recognised(raw), "_pages": pages})
    reason = F.coalesce("_answer.reason", documents.text_gate(F.col("_answer.text"), F.col("_pages"), least))
    return told.select(*rows.columns, "_answer.text", "_answer.lines", "_answer.bad_lines", reason.alias("reason"))


def recognised_files(spark: SparkSession, path: str, least: int = documents.LEAST_CHARS) -> DataFrame:
    """Answers of a recognition engine, one JSON file each: document (the file's stem), text, lines, bad_lines and reason.

    A file that holds no usable answer is a row with the reason, not a lost file.
    """
    files = spark.read.text(path, wholetext=True).withColumn("document", F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)))
    return recognised(files, F.col("value"), F.lit(1), least).drop("value")
