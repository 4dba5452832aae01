"""Documents: selection, search, claims, outcomes of stages, failures and recovery.

Functions of DataFrames and parameters. ``docs`` has id, batch_id, document_id, the stages'
states and attempts, overall_state, validation_status and is_retryable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import failures as codes
from ledgerloom.operators import batches as batch_ops
from ledgerloom.operators.rewrites import STAGES, release_running, upsert

# Verdicts on files.
CORRUPT = ("CORRUPTED_PDF", "INCOMPLETE_PDF", "EMPTY_PDF", "PASSWORD_PROTECTED", "INVALID_PDF", "UNREADABLE_PDF", "PDF_PARSE_ERROR", "PDF_RENDER_ERROR")
RETRYABLE = ("VALID", "PROCESSING_ERROR", "PARTIALLY_CORRUPTED", "UNKNOWN_FAILURE")
STATUSES = ("VALID", "PROCESSING_ERROR", "CORRUPTED_PDF", "PARTIALLY_CORRUPTED", "INCOMPLETE_PDF", "EMPTY_PDF", "PASSWORD_PROTECTED",
    "INVALID_PDF", "UNREADABLE_PDF", "PDF_PARSE_ERROR", "PDF_RENDER_ERROR", "UNKNOWN_FAILURE")
#: Stages with a count of attempts, and how often each is retried.
LIMITS = {"ocr": 1, "extract": 1}
CORRUPT_COLUMNS = ("Document", "Batch", "Source Filename", "PDF Status", "Reason", "Pages", "Corrupted Pages", "Error Code", "Retryable", "Validator", "Checked At")
LEAST_CHARS = 40


def _of(docs: DataFrame, batch: int | None) -> DataFrame:
    return docs if batch is None else docs.filter(F.col("batch_id") == batch)


def is_corrupt(status: Column) -> Column:
    return F.coalesce(status.isin(*CORRUPT), F.lit(False))


def may_retry(status: Column) -> Column:
    """Whether another attempt can help, going by the verdict on the file; so it may without one."""
    return F.coalesce(status.isin(*RETRYABLE), F.lit(True))


def status_histogram(docs: DataFrame) -> DataFrame:
    """Every verdict with how many files have it, none left out, and three totals."""
    found = docs.groupBy(F.col("validation_status").alias("status")).agg(F.count("*").alias("n"))
    names = docs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    each = F.broadcast(names).join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    s = F.col("validation_status")
    totals = docs.agg(F.count("validation_status").alias("TOTAL"), F.count_if(s.isin(*CORRUPT)).alias("CORRUPT"), F.count_if(s.isin(*RETRYABLE)).alias("RETRYABLE"))
    return each.unionByName(totals.unpivot([], ["TOTAL", "CORRUPT", "RETRYABLE"], "status", "n"))


def ocr_counts(docs: DataFrame) -> DataFrame:
    """Per batch the documents that wait for OCR, and those it failed for."""
    waits = (F.col("ocr_state") == "pending") & (F.col("overall_state") == "processing")
    return docs.groupBy("batch_id").agg(F.count_if(waits).alias("pending_ocr"), F.count_if(F.col("ocr_state") == "failed").alias("failed_ocr"))


def failed(docs: DataFrame, batch: int | None = None) -> DataFrame:
    return _of(docs, batch).filter("overall_state = 'failed'").orderBy("id")


def failed_ocr(docs: DataFrame, batch: int | None = None, page: int = 1, size: int = 25) -> tuple[DataFrame, int]:
    """Documents that OCR failed for, of the newest batch first: a page, and how many there are."""
    return batch_ops.page(_of(docs, batch).filter("ocr_state = 'failed'"), page, size, [F.desc("batch_id"), F.col("id")])


def corrupted(docs: DataFrame, batch: int | None = None) -> DataFrame:
    return _of(docs, batch).filter(F.col("validation_status").isin(*CORRUPT))


def search(docs: DataFrame, batch: int | None = None, states: tuple[str, ...] = (), text: str = "", page: int = 1, size: int = 25) -> tuple[DataFrame, int]:
    """Documents by state and by a part of their name in any case: a page in order of id, and how many there are."""
    found = _of(docs, batch)
    found = found.filter(F.col("overall_state").isin(*states)) if states else found
    found = found.filter(F.col("document_id").ilike(f"%{text}%")) if text else found
    return batch_ops.page(found, page, size, [F.col("id")])


def with_children(parents: DataFrame, children: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """Parents with their children as sorted lists of structs; children: table, reference, columns.

    Parents are paged before, so children never multiply them.
    """
    out = parents
    for name, (table, reference, columns) in children.items():
        keys = parents.select(F.col("id").alias(reference))
        lists = table.join(keys, reference, "left_semi").groupBy(reference).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(lists.withColumnRenamed(reference, "_ref"), F.col("id") == F.col("_ref"), "left").drop("_ref")
    return out


def retryable_failures(docs: DataFrame, ids: list[int] | None = None, force: bool = False) -> DataFrame:
    """Failed documents that may be run again: those not marked hopeless, or all if forced."""
    found = failed(docs) if ids is None else failed(docs).filter(F.col("id").isin(ids))
    return found if force else found.filter(~F.col("is_retryable").eqNullSafe(F.lit(False)))


def prepared_paths(docs: DataFrame, batch: int | None = None) -> DataFrame:
    return _of(docs, batch).filter(F.coalesce("cleaned_path", F.lit("")) != "").select("id", "cleaned_path")


def stranded(docs: DataFrame, limits: dict[str, int], batch: int | None = None) -> DataFrame:
    """Waiting for a stage that was tried more than its limit and once more, with the stage's name."""
    each = [F.struct(F.lit(s).alias("stage"), F.col(f"{s}_state").alias("state"), F.col(f"{s}_attempts").cast("bigint").alias("attempts"), F.lit(n).alias("most")) for s, n in limits.items()]
    rows = _of(docs, batch).filter("overall_state = 'processing'").select("id", "batch_id", F.inline(F.array(*each)))
    return rows.filter((F.col("state") == "pending") & (F.col("attempts") > F.col("most") + 1)).select("id", "batch_id", "stage", "attempts")


def ready(stage: str, most_attempts: int | None = None) -> Column:
    """A document that a stage may be claimed for: open, waiting, earlier stages done, attempts left."""
    found = (F.col("overall_state") == "processing") & (F.col(f"{stage}_state") == "pending")
    for s in STAGES[: STAGES.index(stage)]:
        found = found & (F.col(f"{s}_state") == "done")
    return found & (F.col(f"{stage}_attempts") <= most_attempts) if most_attempts is not None else found


def claim_next(docs: DataFrame, stage: str, most_attempts: int | None = None, batch: int | None = None) -> DataFrame:
    """In each batch the first document that a stage may be claimed for, as it is once claimed."""
    own = _of(docs, batch).filter(ready(stage, most_attempts))
    first = own.groupBy("batch_id").agg(F.min_by(F.struct("id", "document_id", *([f"{stage}_attempts"] if f"{stage}_attempts" in docs.columns else [])), "id").alias("_row"))
    claimed = first.select("batch_id", "_row.*").withColumn(f"{stage}_state", F.lit("running"))
    return claimed.withColumn(f"{stage}_attempts", F.col(f"{stage}_attempts") + 1) if f"{stage}_attempts" in claimed.columns else claimed


def claim_downstream(docs: DataFrame, batch: int | None = None) -> DataFrame:
    """In each batch the first document of the first stage after OCR that has one, in the order extract, validate, translate."""
    order = ("extract", "validate", "translate")
    each = F.array_compact(F.array(*[F.when(ready(s), F.struct(F.lit(k).alias("place"), F.col("id"), F.lit(s).alias("stage"))) for k, s in enumerate(order)]))
    own = _of(docs, batch).select("batch_id", F.array_min(each).alias("c")).filter("c IS NOT NULL")
    return own.groupBy("batch_id").agg(F.min("c").alias("c")).select("batch_id", "c.id", "c.stage")


def mark_stage(docs: DataFrame, changes: DataFrame, stage: str) -> DataFrame:
    """changes: id, state, reason. A failed stage fails the document, with the reason if there is one."""
    told = changes.select("id", F.col("state").alias("_to"), F.col("reason").alias("_why"))
    found, lost = docs.join(told, "id", "left"), F.col("_to") == "failed"
    return found.withColumns({
        "failure_reason": F.when(lost, F.coalesce(F.nullif("_why", F.lit("")), "failure_reason")).otherwise(F.col("failure_reason")),
        "overall_state": F.when(lost, "failed").otherwise(F.col("overall_state")), f"{stage}_state": F.coalesce("_to", f"{stage}_state"),
    }).drop("_to", "_why")


def mark_overall(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, state, reason. The reason stays where none is given."""
    told = changes.select("id", F.col("state").alias("_to"), F.col("reason").alias("_why"))
    found = docs.join(told, "id", "left")
    return found.withColumns({"overall_state": F.coalesce("_to", "overall_state"), "failure_reason": F.coalesce(F.nullif("_why", F.lit("")), "failure_reason")}).drop("_to", "_why")


def requeue(docs: DataFrame, which: Column) -> DataFrame:
    """All stages of the chosen documents wait again, with no attempt made; ``requeued`` says which."""
    which = F.coalesce(which, F.lit(False))
    new = {f"{s}_state": F.when(which, "pending").otherwise(F.col(f"{s}_state")) for s in STAGES}
    new |= {f"{s}_attempts": F.when(which, F.lit(0).cast(docs.schema[f"{s}_attempts"].dataType)).otherwise(F.col(f"{s}_attempts")) for s in STAGES if f"{s}_attempts" in docs.columns}
    return docs.withColumns(new | {"overall_state": F.when(which, "processing").otherwise(F.col("overall_state")), "requeued": which})


def requeue_failed(docs: DataFrame, batch: int | None = None) -> DataFrame:
    own = F.col("overall_state") == "failed"
    return requeue(docs, own if batch is None else own & (F.col("batch_id") == batch))


def requeue_ocr(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents among ``ids`` (id) that OCR failed for, waiting for it again."""
    named = docs.join(ids.select("id").distinct().withColumn("_named", F.lit(True)), "id", "left")
    return requeue(named, F.col("_named") & (F.col("ocr_state") == "failed")).drop("_named")


def fail_stranded(docs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Stranded documents fail, with the stage and the attempts for a reason."""
    lost = stranded(docs, limits).groupBy("id").agg(F.min(F.struct("stage", "attempts")).alias("s")).select("id",
        F.col("s.stage").alias("stage"), F.concat("s.stage", F.lit(" gave up after "), F.col("s.attempts").cast("string"),
        F.lit(" attempts")).alias("reason"))
    found = docs.join(lost.select("id", F.col("stage").alias("_stage"), F.col("reason").alias("_why")), "id", "left")
    new = {f"{s}_state": F.when(F.col("_stage").eqNullSafe(F.lit(s)), "failed").otherwise(F.col(f"{s}_state")) for s in STAGES}
    return found.withColumns(new | {"overall_state": F.when(F.col("_stage").isNotNull(), "failed").otherwise(F.col("overall_state")),
        "failure_reason": F.coalesce("_why", "failure_reason")}).drop("_stage", "_why")


def recover(docs: DataFrame, batches: DataFrame, limits: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """After a crash, in this order: what was at work waits again, stopping batches settle, what was tried too often fails."""
    released = release_running(docs)
    return fail_stranded(released, limits), batch_ops.settle(batches, released)


def ocr_outcome(state: Column, attempts: Column, retryable: Column, status: Column, limit: int) -> Column:
    """Read, to be tried again, or failed: once more while attempts last and the file isn't the problem."""
    again = ~retryable.eqNullSafe(F.lit(False)) & (attempts <= limit) & ~is_corrupt(status)
    return F.when(state != "failed", "OCR_P").when(again, "retry").otherwise("OCR_F")


def text_gate(text: Column, pages: Column, least: int = LEAST_CHARS) -> Column:
    """Why text can't be a document's: none, or fewer than so many characters a page; null if it can."""
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(size == 0, "OCR produced no text").when(size / F.greatest(pages, F.lit(1)) < least, F.format_string("only %d characters across %d pages: no usable text layer", size, pages))


def extraction_gate(parsed: Column, truncated: Column, coverage: Column, unmatched: Column, least: float = 0.6, most: int = 2) -> Column:
    return F.when(~parsed, "no_json").when(truncated, "truncated").when((coverage < least) & (unmatched >= most), "low_coverage").otherwise("accepted")


def extract_outcome(ok: Column, answered: Column, attempts: Column, limit: int) -> Column:
    """Done, tried again while attempts last, done for a person to look at if there was an answer, or failed."""
    return F.when(ok, "done").when(attempts <= limit, "retry").when(answered, "done_needs_review").otherwise("failed")


def translate_outcome(written: Column, asked: Column) -> Column:
    """Done if anything was asked for, else skipped; what was asked and not written doesn't fail it."""
    return F.when(asked > 0, "done").otherwise("skipped")


def final_state(disposition: Column, identity: Column) -> Column:
    return F.when((disposition == "accept") & (F.coalesce(identity, F.lit("")) != ""), "processed").otherwise("needs_review")


def attempts_of(failures: DataFrame) -> DataFrame:
    """Each failure with its number among those of its document and stage."""
    return failures.withColumn("attempt", F.row_number().over(Window.partitionBy("document_pk", "stage").orderBy("created_at", "id")))


def append_failures(failures: DataFrame, new: DataFrame, spark) -> DataFrame:
    """new: document_pk, batch_id, stage, technical, validation_status, created_at, id. Appended with code, message and attempt."""
    known = codes.explain(new, spark).select("id", "document_pk", "batch_id", "created_at", "stage", "technical", "validation_status", "code", "message", "retryable")
    return attempts_of(failures.unionByName(known, allowMissingColumns=True))


def last_failure(failures: DataFrame, keys: list[str]) -> DataFrame:
    """The last failure by each key, with all its columns."""
    rest = [c for c in failures.columns if c not in keys]
    return failures.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_row")).select(*keys, "_row.*")


def history(failures: DataFrame) -> DataFrame:
    """Per document its failures in order, a line each, and the last one's text."""
    line = F.concat(F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit("  "), "stage", F.lit(" #"), F.col("attempt").cast("string"),
        F.lit(": "), F.coalesce(F.nullif(F.trim("technical"), F.lit("")), F.lit("no detail")))
    lines = attempts_of(failures).select("document_pk", F.struct("created_at", "id", line.alias("line")).alias("l"))
    return lines.groupBy("document_pk").agg(F.sort_array(F.collect_list("l")).alias("l")).select("document_pk", F.array_join("l.line", "\n").alias("history"), F.size("l").alias("n"))


def failure_panel(failures: DataFrame, spark, shown: int = 25) -> DataFrame:
    """Per batch its first failures explained, how many are hidden, and whether any may be run again."""
    known = codes.explain(failures, spark)
    # the first of each batch are chosen before rows are dealt; totals are sums
    first = known.withColumn("k", F.row_number().over(Window.partitionBy("batch_id").orderBy("created_at", "id"))).filter(F.col("k") <= shown)
    totals = known.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("retryable").alias("can_rerun"))
    placed = first.join(totals.withColumnRenamed("batch_id", "_b"), F.col("batch_id").eqNullSafe(F.col("_b")))
    return placed.select("id", "batch_id", "code", "message", F.greatest(F.col("n") - shown, F.lit(0)).alias("hidden"), "can_rerun")


def record_verdicts(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts: id, status, page_count. The verdict is overwritten, the page count only where there is none.

    A file that is fine though its document failed says so: the fault lay in processing.
    """
    told = verdicts.select("id", F.col("status").alias("_status"), F.col("page_count").alias("_pages"))
    found = docs.join(told, "id", "left")
    status = F.when((F.col("_status") == "VALID") & (F.col("overall_state") == "failed"), "PROCESSING_ERROR").otherwise(F.col("_status"))
    return found.withColumns({"page_count": F.when(F.coalesce("page_count", F.lit(0)) == 0,
        F.coalesce("_pages", "page_count")).otherwise(F.col("page_count")),
        "validation_status": F.coalesce(status, "validation_status")}).drop("_status", "_pages")


def corrupted_report(docs: DataFrame, batches: DataFrame) -> DataFrame:
    """The eleven columns of the export of corrupt files."""
    named = with_batch_name(corrupted(docs), batches)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    given = {
        "Document": text(F.col("document_id")), "Batch": F.col("batch"), "Source Filename": text(F.col("source")), "PDF Status": F.col("validation_status"), "Reason": text(F.col("failure_reason")),
        "Pages": text(F.col("page_count")), "Corrupted Pages": F.coalesce(F.array_join(F.col("corrupted_pages").cast("array<string>"), ", "), F.lit("")), "Error Code": text(F.col("error_code")),
        "Retryable": F.when(may_retry(F.col("validation_status")), "yes").otherwise("no"), "Validator": text(F.col("validator_version")),
            "Checked At": F.coalesce(F.date_format("validated_at", "yyyy-MM-dd HH:mm"), F.lit("")),
    }
    return named.select(*[given[c].alias(c) for c in CORRUPT_COLUMNS])


def needing_translation(docs: DataFrame, persons: DataFrame, batch: int | None = None, most: int | None = None) -> DataFrame:
    """Documents with a person whose name has no translation, in order of id."""
    lacking = persons.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("name_translated", F.lit("")) == "")).select(F.col("document_id").alias("_d")).distinct()
    found = _of(docs, batch).join(lacking, F.col("id") == F.col("_d"), "left_semi").orderBy("id")
    return found if most is None else found.limit(most)


def seed(docs: DataFrame, after: int) -> DataFrame:
    """New documents from those whose text is read already: numbered after ``after``, they begin at extraction."""
    return docs.filter("ocr_state = 'done'").select((F.col("id") + after).alias("id"), "document_id", F.lit("done").alias("ocr_state"),
        *[F.lit("pending").alias(f"{s}_state") for s in STAGES[1:]], F.lit("processing").alias("overall_state"))


def with_batch_name(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows with the name of their batch, empty where it has none."""
    names = batches.select(F.col("id").alias("_b"), F.col("name").alias("_name"))
    return rows.join(names, F.col("batch_id") == F.col("_b"), "left").withColumn("batch", F.coalesce("_name", F.lit(""))).drop("_b", "_name")


def data_view(documents: DataFrame, persons: DataFrame, flags: DataFrame, page: int = 1, size: int = 100, key: str = "deed") -> DataFrame:
    """A page of documents, a row for each person of theirs (one at least), with its flags sorted without repeats."""
    shown = documents.orderBy(key).offset((max(1, page) - 1) * size).limit(size).select(key)
    own = [key, "relation", "ordinal"]
    lists = flags.join(F.broadcast(shown), key, "left_semi").groupBy(*own).agg(F.array_join(F.array_sort(F.collect_set("flag")), ", ").alias("flags"))
    people = persons.join(F.broadcast(shown), key, "left_semi").select(*own, "name").join(lists, own, "left")
    return shown.join(people, key, "left").withColumn("flags", F.coalesce("flags", F.lit("")))


def upsert_attempts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Extractions by document and attempt, the later answer in place of an earlier one."""
    return upsert(old, new, ["document_id", "attempt"], ["created_at", "id"])
