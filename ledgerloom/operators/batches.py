"""Batches: progress, the queue, and what may be done with a batch in its state.

Functions of DataFrames and parameters. ``docs`` has batch_id, the four stage states and
overall_state; ``batches`` has id, name, state, queue_position, user_key, total_bytes and,
where times are set, started_at and finished_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import values
from ledgerloom.operators.rewrites import STAGES, next_batch_state

OVERALL = ("processed", "failed", "needs_review")
WAITING, TERMINAL = ("queued", "running"), ("completed", "stopped", "failed")
# Files and bytes of a batch, and batches that wait at once.
MOST_FILES, MOST_BYTES, MOST_QUEUED = 1000, 25 * 1024**3, 4


def busy(docs: DataFrame) -> Column:
    """Some stage of a document that isn't finished is at work."""
    return (F.col("overall_state") == "processing") & F.array_contains(F.array(*[F.col(f"{s}_state") for s in STAGES]), "running")


def _counted(docs: DataFrame) -> DataFrame:
    figures = {f"{s}_{v}": F.col(f"{s}_state") == v for s in STAGES for v in ("done", "failed")} | {v: F.col("overall_state") == v for v in OVERALL}
    figures["processing"] = F.col("overall_state") == "processing"
    return docs.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(busy(docs)).alias("in_flight"), *[F.count_if(c).alias(k) for k, c in figures.items()])


def percent(part: Column, whole: Column) -> Column:
    """A share of a whole in percent; 0 of nothing."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def progress(docs: DataFrame, batches: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Per batch, empty ones too: documents in all, by stage and by outcome, and the two percentages."""
    wanted = batches.filter(F.col("id").isin(ids)) if ids is not None else batches
    joined = wanted.select(F.col("id").alias("batch_id")).join(_counted(docs), "batch_id", "left").na.fill(0)
    closed, settled = F.col("processed") + F.col("failed"), F.col("processed") + F.col("failed") + F.col("needs_review")
    return joined.withColumns({"percent_closed": percent(closed, F.col("total")), "percent_settled": percent(settled, F.col("total"))})


def stage_bars(progressed: DataFrame) -> DataFrame:
    """Per batch and stage how far it is: done and failed of all, in percent."""
    each = [F.struct(F.lit(k).alias("place"), F.lit(s).alias("stage"), F.col(f"{s}_done").alias("done"),
        F.col(f"{s}_failed").alias("failed"), percent(F.col(f"{s}_done") + F.col(f"{s}_failed"), F.col("total")).alias("percent")) for k,
        s in enumerate(STAGES, 1)]
    return progressed.select("batch_id", F.inline(F.array(*each)))


def finished(progressed: DataFrame) -> DataFrame:
    return progressed.select("batch_id", (F.col("processing") == 0).alias("finished"))


def queue_bounds(batches: DataFrame) -> DataFrame:
    """How many wait, the place after the last and the one before the first."""
    own = batches.filter(F.col("state").isin(*WAITING))
    return own.agg(F.count_if(F.col("state") == "queued").alias("queued"),
        (F.coalesce(F.max("queue_position"), F.lit(0)) + 1).alias("next_position"),
        (F.coalesce(F.min("queue_position"), F.lit(0)) - 1).alias("head_position"))


def next_queued(batches: DataFrame) -> DataFrame:
    return batches.filter("state = 'queued'").orderBy("queue_position", "id").limit(1)


def active(batches: DataFrame, start: str = "started_at") -> DataFrame:
    """The batch that runs, the one that began first."""
    return batches.filter("state = 'running'").orderBy(F.asc_nulls_last(start), "id").limit(1)


def choose(batches: DataFrame, docs: DataFrame) -> DataFrame:
    """What a scheduler does next: the running batch, or the first that waits, which then runs.

    Batches that are being stopped are settled before the choice.
    """
    settled = settle(batches, docs)
    run = active(settled, "queue_position").withColumn("started", F.lit(False))
    first = next_queued(settled).withColumn("started", F.lit(True))
    return run.unionByName(first).orderBy("started").limit(1).select("id", "state", "started")


def page(rows: DataFrame, number: int, size: int, order: list[Column]) -> tuple[DataFrame, int]:
    """One page of rows in order, numbered from 1, and how many rows there are."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size), rows.count()


def pager(pages: DataFrame, size: int, width: int = 5) -> DataFrame:
    """pages: page, total. The last page, the numbers shown around this one, and the rows on it."""
    last = F.greatest(F.lit(1), F.floor((F.col("total") + size - 1) / size).cast("bigint"))
    first = F.greatest(F.lit(1), F.least(F.col("page") - width // 2, last - (width - 1)))
    shown = pages.select("page", last.alias("pages"), first.alias("first_number"), "total").filter("page BETWEEN 1 AND pages")
    return shown.select("page", "pages", "first_number", F.least("pages", F.col("first_number") + (width - 1)).alias("last_number"),
        ((F.col("page") - 1) * size + 1).alias("from_row"), F.least(F.col("page") * size, F.col("total")).alias("to_row"))


def actions(batches: DataFrame, progressed: DataFrame) -> DataFrame:
    """What may be done with each batch, and how many of its documents are open."""
    both = batches.join(progressed, batches["id"] == progressed["batch_id"])
    one = lambda *states: F.col("state").isin(*states)
    open_ = F.col("total") - F.col("processed") - F.col("failed") - F.col("needs_review")
    return both.select("id", one("draft", "stopped").alias("can_run"), one("queued", "running").alias("can_stop"),
        one("running", "stopping").alias("needs_force"), open_.alias("pending"), F.bround("percent_settled", 1).alias("percent"))


def dashboard(batches: DataFrame, progressed: DataFrame, order: list[Column], live: int = 20, done: int = 5) -> DataFrame:
    """The first batches of each state that is shown, with their progress."""
    placed = batches.withColumn("place", F.row_number().over(Window.partitionBy("state").orderBy(*order)))
    shown = placed.filter((F.col("state").isin(*WAITING) & (F.col("place") <= live)) | ((F.col("state") == "completed") & (F.col("place") <= done)))
    return shown.join(progressed, F.col("id") == F.col("batch_id")).select("id", "name", "state", "total", "processed", "place")


def selection(files: DataFrame, by: list[str]) -> DataFrame:
    """Files and bytes of a selection, and whether it is over a limit."""
    found = files.groupBy(*by).agg(F.count("*").alias("files"), F.sum("total_bytes").cast("bigint").alias("bytes"))
    return found.withColumns({"too_many": F.col("files") > MOST_FILES, "too_large": F.coalesce(F.col("bytes") > MOST_BYTES, F.lit(False))})


def limit_messages(found: DataFrame, queued: int = 0) -> DataFrame:
    """What to tell about a selection that can't become a batch."""
    say = [
        F.when(F.col("too_many"), F.format_string(f"%d files are over the limit of {MOST_FILES}.", "files")),
        F.when(F.col("too_large"), F.concat(F.format_string("%.1f GB", F.col("bytes") / float(1024**3)), F.lit(f" are over the limit of {MOST_BYTES // 1024**3} GB."))),
        F.when(F.lit(queued >= MOST_QUEUED), f"{MOST_QUEUED} batches are waiting already."),
    ]
    return found.withColumn("messages", F.array_compact(F.array(*say)))


def upload_page(files: DataFrame, queued: int = 0, shown: int = 200) -> tuple[DataFrame, DataFrame]:
    """files: path, bytes. The summary of a selection (one row), and its first files with their places, by path."""
    total = files.select(F.col("bytes").alias("total_bytes")).groupBy().agg(F.count("*").alias("files"), F.coalesce(F.sum("total_bytes"), F.lit(0)).cast("bigint").alias("bytes"))
    limits = total.withColumns({"too_many": F.col("files") > MOST_FILES, "too_large": F.col("bytes") > MOST_BYTES})
    told = limit_messages(limits, queued).withColumns({
        "size": values.human_bytes(F.col("bytes")), "shown": F.least("files", F.lit(shown)), "truncated": F.col("files") > shown,
        "can_submit": (F.col("files") > 0) & (F.size("messages") == 0), "next_position": F.lit(queued + 1),
    })
    first = files.orderBy("path").limit(shown)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    listed = first.select(F.row_number().over(Window.orderBy("path")).alias("place"), name.alias("name"),
        F.regexp_replace(name, r"\.[^.]+$", "").alias("document_id"), values.human_bytes(F.col("bytes")).alias("size"))
    return told, listed


def processing_page(progressed: DataFrame) -> DataFrame:
    """Per batch: finished of all documents as a line and in whole percent, and how many are still to come."""
    done = F.col("processed") + F.col("failed") + F.col("needs_review")
    share = F.when(F.col("total") > 0, F.bround(F.lit(100.0) * done / F.col("total"), 1)).otherwise(0.0)  # halves to even
    return progressed.select("batch_id", "total", done.alias("finished"),
        values.whole_percent(done, F.col("total")).alias("overall_percent"),
        F.format_string("%d / %d (%.1f%%)", done, "total", share).alias("readout"), F.greatest(F.col("total") - done, F.lit(0)).alias("in_queue"))


def in_flight(docs: DataFrame) -> DataFrame:
    return docs.groupBy("batch_id").agg(F.count_if(busy(docs)).alias("in_flight"))


def _with_flight(batches: DataFrame, docs: DataFrame) -> DataFrame:
    flight = in_flight(docs).withColumnRenamed("batch_id", "_b")
    return batches.join(flight, F.col("id") == F.col("_b"), "left").drop("_b").withColumn("in_flight", F.coalesce("in_flight", F.lit(0)))


def request(batches: DataFrame, docs: DataFrame, asked: str) -> DataFrame:
    """Batches after a request to run or stop each of them; ``refused`` where it can't be met."""
    found = _with_flight(batches, docs).withColumn("_to", next_batch_state(F.col("state"), F.col("in_flight"), asked))
    return found.withColumn("refused", F.col("_to").isNull()).withColumn("state", F.coalesce("_to", "state")).drop("_to", "in_flight")


def settle(batches: DataFrame, docs: DataFrame) -> DataFrame:
    """Batches that were being stopped and have nothing at work any more are stopped."""
    return _with_flight(batches, docs).withColumn("state", next_batch_state(F.col("state"), F.col("in_flight"), "settle")).drop("in_flight")


def set_state(batches: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes: id, state. The first start stays, and an end is noted with a final state."""
    told = changes.select(F.col("id"), F.col("state").alias("_to"))
    found = batches.join(told, "id", "left")
    new = F.col("_to")
    return found.withColumns({
        "started_at": F.when(new == "running", F.coalesce("started_at", now)).otherwise(F.col("started_at")),
        "finished_at": F.when(new.isin(*TERMINAL), now).otherwise(F.col("finished_at")),
        "state": F.coalesce(new, F.col("state")),
    }).drop("_to")


def to_head(batches: DataFrame, ids: list[int], resume: bool = True) -> DataFrame:
    """The named batches wait before all others, the first named first; resumed ones have no end any more."""
    head = batches.filter(F.col("state").isin(*WAITING)).agg((F.coalesce(F.min("queue_position"), F.lit(1)) - len(ids)).alias("_head"))
    place = F.create_map(*[F.lit(x) for k, i in enumerate(ids) for x in (i, k)])
    found = batches.crossJoin(F.broadcast(head))  # one row
    mine = F.col("id").isin(*ids)
    new = {"queue_position": F.when(mine, F.col("_head") + F.try_element_at(place,
        F.col("id").cast("int"))).otherwise(F.col("queue_position")), "state": F.when(mine, "queued").otherwise(F.col("state"))}
    if resume and "finished_at" in batches.columns:
        new["finished_at"] = F.when(~mine, F.col("finished_at"))
    return found.withColumns(new).drop("_head")


def completed_edges(polls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """polls: key, order, finished. The polls at which something is finished that wasn't at the one before."""
    before = F.lag("finished").over(Window.partitionBy(key).orderBy(*order))
    return polls.withColumn("_before", before).filter("finished AND NOT _before").drop("_before")


def finalise(batches: DataFrame, progressed: DataFrame) -> DataFrame:
    """Running batches without an open document are completed."""
    done = progressed.filter("processing = 0").select(F.col("batch_id").alias("id"), F.lit(True).alias("_done"))
    return batches.join(done, "id", "left").withColumn("state", F.when((F.col("state") == "running") & F.col("_done"), "completed").otherwise(F.col("state"))).drop("_done")


def deletable(batches: DataFrame, docs: DataFrame, force: bool = False) -> DataFrame:
    """Whether a batch may be deleted: at rest, and nothing of it at work; forced, at work may only be what stops."""
    running = F.array_contains(F.array(*[F.col(f"{s}_state") for s in STAGES]), "running")
    work = docs.filter(running).select(F.col("batch_id").alias("_b")).distinct()
    at_rest = ~F.col("state").isin("running") if force else ~F.col("state").isin("running", "stopping")
    return batches.join(work, F.col("id") == F.col("_b"), "left").select("id", (at_rest & F.col("_b").isNull()).alias("deletable"))


def guard(batches: DataFrame, asked: str) -> DataFrame:
    """Why a batch can't be run or stopped; an empty message where it can."""
    may = F.col("state").isin(*(("draft", "stopped") if asked == "run" else ("queued", "running")))
    return batches.select("id", F.when(may, "").otherwise(F.concat(F.lit("A batch that is "), "state", F.lit(f" can't be {'started' if asked == 'run' else 'stopped'}."))).alias("message"))


def requeue_with_documents(batches: DataFrame, requeued: DataFrame) -> DataFrame:
    """Batches at rest of which documents wait again go back to the queue, behind the last, in order of id."""
    again = requeued.filter("requeued").select(F.col("batch_id").alias("id")).distinct().withColumn("_again", F.lit(True))
    last = batches.filter(F.col("state").isin(*WAITING)).agg((F.coalesce(F.max("queue_position"), F.lit(0)) + 1).alias("_place"))
    found = batches.join(again, "id", "left").crossJoin(F.broadcast(last))  # one row
    moves = F.coalesce(F.col("_again") & ~F.col("state").isin("queued", "running", "stopping"), F.lit(False))
    return found.withColumns({"queue_position": F.when(moves, F.col("_place")).otherwise(F.col("queue_position")), "state": F.when(moves, "queued").otherwise(F.col("state"))}).drop("_again", "_place")


def export_name(name: Column, now: Column, failed_only: bool = False) -> Column:
    """The file name of a batch's export: its own name in safe characters, what it is, and when."""
    safe = F.regexp_replace(F.coalesce(name, F.lit("batch")), r"[^\p{L}\p{N}_-]", "_")
    return F.concat(safe, F.lit("_failed_" if failed_only else "_"), F.date_format(now, "yyyyMMdd_HHmm"), F.lit(".csv"))


def moving_average(rows: DataFrame, value: str, order: list[str], scratch, width: int = 50) -> DataFrame:
    """The mean of the last so many values of all rows, in one total order, after each row.

    No task gets all rows: they are dealt by ranges of the order, kept, and each range is
    given the last rows before it.
    """
    kept = scratch.keep("ranged", rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = kept.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    bounds = sizes.select("_part", before.alias("_start"), (before + F.col("count")).alias("_end"))
    back = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.desc(c) for c in order]))
    tail = kept.withColumn("_back", back).filter(F.col("_back") < width).join(F.broadcast(bounds.select("_part", "_end")), "_part").withColumn("_place", F.col("_end") - F.col("_back"))
    later = F.broadcast(bounds.select(F.col("_part").alias("_to"), "_start"))
    handed = tail.join(later, (F.col("_to") > F.col("_part")) & (F.col("_place") > F.col("_start") - width)).drop("_part", "_back", "_end", "_place", "_start").withColumnRenamed("_to", "_part")
    both = kept.withColumn("_own", F.lit(True)).unionByName(handed.withColumn("_own", F.lit(False)))
    frame = Window.partitionBy("_part").orderBy(*order).rowsBetween(-(width - 1), 0)
    return both.withColumn("average", F.avg(value).over(frame)).filter("_own").drop("_part", "_own")


def seconds_per_document(rows: DataFrame, value: str, order: list[str], width: int = 50) -> DataFrame:
    """The mean of the last so many durations; 0 without any."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(width).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("seconds"))
