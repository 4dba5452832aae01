"""Row-level writes as functions from an old table and changes to a new table.

Parquet has no update in place. Each function returns the whole new table; writing it beside
the old one and swapping folders makes the step atomic. Keys are compared null-safely where
a change may hold nulls, and every choice among rows has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("ocr", "extract", "translate", "validate")


def new_rows(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is not there yet, the first of those that share one."""
    first = Window.partitionBy(*keys).orderBy(*order)
    once = new.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    return once.join(old.select(*keys), keys, "left_anti")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The old rows and those new ones whose key is not there yet."""
    return old.unionByName(new_rows(old, new, keys, order))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Rows with their places from 1 among those that share the keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def serials(rows: DataFrame, order: list[str], given: str, scratch) -> DataFrame:
    """Adds ``serial``: a given number where there is one, else one more than that of the row before.

    One order over all rows: they are dealt by ranges of it and kept, each range is numbered
    by itself, and what a range ends with, one row of figures each, goes to the next.
    """
    kept = scratch.keep("serials", rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(*order)
    k = F.row_number().over(own)
    placed = kept.withColumn("_k", k).withColumn("_last", F.last(F.when(F.col(given).isNotNull(), F.struct(F.col(given).alias("value"), F.col("_k").alias("at"))), ignorenulls=True).over(own))
    ends = placed.groupBy("_part").agg(F.max("_k").alias("n"), F.max_by("_last", "_k").alias("last")).orderBy("_part").collect()  # a row a range
    carried, before = [], 0
    for end in ends:
        carried.append((end["_part"], before))
        before = end["last"]["value"] + end["n"] - end["last"]["at"] if end["last"] is not None else before + end["n"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(carried, "_part int, _before long"))
    return placed.join(starts, "_part").withColumn("serial", F.coalesce(F.col("_last.value") + F.col("_k") - F.col("_last.at"), F.col("_before") + F.col("_k"))).drop("_part", "_k", "_last", "_before")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows in place of old ones with their key; of new ones that share a key the last."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    once = new.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
    return old.join(once.select(*keys), keys, "left_anti").unionByName(once)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that ``new`` has rows for, replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def fill(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns that ``new`` has a non-empty value for, overwritten; ``written`` says where that changed one."""
    changes = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    value = {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)) for c in columns}
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~value[c].eqNullSafe(F.col(c))
    joined = old.join(changes, keys, "left").withColumn("written", changed)
    return joined.withColumns(value).drop(*[f"_{c}" for c in columns])


def cascade(tables: dict[str, DataFrame], gone: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Deletes rows and what depends on them.

    links: (parent table, its key, child table, the child's reference), parents first;
    ``gone`` holds the keys of the first link's parent that go.
    """
    out, lost = dict(tables), {links[0][0]: gone}
    first, key = links[0][0], links[0][1]
    out[first] = tables[first].join(gone.select(key), key, "left_anti")
    for parent, key, child, reference in links:
        keys = lost[parent].select(F.col(key).alias(reference))
        lost[child] = tables[child].join(keys, reference, "left_semi")
        out[child] = out[child].join(keys, reference, "left_anti")
    return out


def expire(rows: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows that are not older than so many days."""
    return rows.filter(F.col(column) >= now - F.make_interval(days=F.lit(days)))


def release_running(docs: DataFrame) -> DataFrame:
    """After a crash: running stages wait again, and the attempt they had is given back."""
    out = docs
    for s in STAGES:
        running = F.col(f"{s}_state") == "running"
        if f"{s}_attempts" in docs.columns:
            out = out.withColumn(f"{s}_attempts", F.when(running, F.greatest(F.col(f"{s}_attempts") - 1, F.lit(0))).otherwise(F.col(f"{s}_attempts")))
        out = out.withColumn(f"{s}_state", F.when(running, "pending").otherwise(F.col(f"{s}_state")))
    return out


def claim(docs: DataFrame, stage: str, most_attempts: int) -> DataFrame:
    """Claims every eligible row for a stage at once: pending, earlier stages done, attempts left."""
    ready = (F.col("overall_state") == "processing") & (F.col(f"{stage}_state") == "pending") & (F.col(f"{stage}_attempts") <= most_attempts)
    for s in STAGES[: STAGES.index(stage)]:
        ready = ready & (F.col(f"{s}_state") == "done")
    return docs.withColumns({f"{stage}_attempts": F.when(ready, F.col(f"{stage}_attempts") + 1).otherwise(F.col(f"{stage}_attempts")),
        f"{stage}_state": F.when(ready, "running").otherwise(F.col(f"{stage}_state")), "claimed": ready})


def next_batch_state(state: Column, in_flight: Column, asked: str) -> Column:
    """What a request to run, stop or settle makes of a batch; null where it is refused."""
    busy = in_flight > 0
    moves = {
        "run": F.when(state.isin("draft", "stopped"), "queued"),
        "stop": F.when(state == "queued", "stopped").when(state == "running", F.when(busy, "stopping").otherwise("stopped")),
        "settle": F.when((state == "stopping") & ~busy, "stopped").otherwise(state),
    }
    return moves[asked]


def expected_serial(stem: Column) -> Column:
    """The five-digit serial that a file's stem names, or an empty string."""
    digits = F.regexp_extract(stem, r"(\d{1,6})(?!.*\d)", 1)
    long = F.regexp_extract(stem, r"-\d-(\d{4,6})-\d{4}-\d{2}$", 1)
    found = F.when(long != "", long).otherwise(digits)
    return F.when(found == "", "").otherwise(F.lpad(F.right(F.ltrim(found, F.lit("0")), F.lit(5)), 5, "0"))


def flatten(extraction: Column, lists: dict[str, list[str]], structs: dict[str, list[str]]) -> Column:
    """A map from path to value over a nested record: ``buyer_details[1].name`` and the like."""

    def entry(name: str, field: str):
        return lambda x, i: F.struct(F.concat(F.lit(f"{name}["), (i + 1).cast("string"), F.lit(f"].{field}")).alias("key"), x[field].alias("value"))

    parts = []
    for name, fields in lists.items():
        none = F.array().cast(f"array<struct<{','.join(f'{x}:string' for x in fields)}>>")
        parts += [F.transform(F.coalesce(extraction[name], none), entry(name, f)) for f in fields]
    for name, fields in structs.items():
        parts.append(F.array(*[F.struct(F.lit(f"{name}.{f}").alias("key"), extraction[name][f].alias("value")) for f in fields]))
    return F.map_from_entries(F.concat(*parts))
