"""Queries of the operators over batches, documents, failures, deeds and parties.

Each query applies an operator with its parameters to adapter views of the driver's tables.
What it has to give is said apart from it, as SQL over the same views, in ``SQL``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import failures as failure_codes
from ledgerloom.functions import grounding, language, values
from ledgerloom.functions import watermark as marks
from ledgerloom.operators import batches as B
from ledgerloom.operators import documents as D
from ledgerloom.operators import folds, machine, reports, retention, rewrites
from ledgerloom.plans import export, textual
from ledgerloom.plans.adapters import INPUTS, VIEWS
from ledgerloom.session import Scratch, table
from ledgerloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Views:
    """The adapter views and input tables of a folder, as DataFrames by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return table(self.spark, self.sf_dir, name)
        for t in INPUTS:
            if re.search(rf"\bFROM {t}\b", VIEWS[name]):
                table(self.spark, self.sf_dir, t).createOrReplaceTempView(t)
        return self.spark.sql(VIEWS[name])


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


def _progress(v: Views) -> DataFrame:
    return B.progress(v.docs, v.batches)


@query
def batch_progress(v):
    return _progress(v).drop("processing", "in_flight")


@query
def stage_bars(v):
    return B.stage_bars(_progress(v)).drop("place")


@query
def batch_finished(v):
    return B.finished(_progress(v))


@query
def in_flight(v):
    return B.in_flight(v.docs)


@query
def pending_and_failed_ocr(v):
    return D.ocr_counts(v.docs)


@query
def table_counts(v):
    return reports.table_counts({t: getattr(v, t) for t in ("batches", "docs", "failures", "deeds", "parties", "customer", "supplier")})


@query
def pdf_status_histogram(v):
    return D.status_histogram(v.docs)


@query
def job_states(v):
    return v.batches.groupBy("state").agg(F.count("*").alias("n"))


@query
def queue_bounds(v):
    return B.queue_bounds(v.batches)


@query
def selection_totals(v):
    return B.selection(v.batches, ["user_key"]).select("user_key", "files", "bytes", (F.col("too_many") | F.col("too_large")).alias("over_limit"))


@query
def language_histogram(v):
    return reports.language_histogram(v.phrases)


@query
def identity_accuracy(v):
    found = textual.identified(v.documents)
    wanted = textual.numbered_documents(v.documents).select("doc_id", "wanted")
    return reports.identity_accuracy(found.join(wanted, "doc_id").select(F.col("doc_id").alias("id"), "identity", F.col("wanted").alias("want"), (F.col("doc_id") % 4).alias("part")), ["part"])


@query
def stranded_documents(v):
    return D.stranded(v.docs, {"ocr": 1, "extract": 0})


@query
def claim_next_per_batch(v):
    return D.claim_next(v.docs, "extract", 2)


@query
def claim_downstream(v):
    return D.claim_downstream(v.docs)


@query
def failed_page(v):
    return D.failed_ocr(v.docs, page=3, size=25)[0].select("id", "batch_id", "document_id")


@query
def failed_for_batch(v):
    return D.failed(v.docs).select("id", "batch_id", "document_id", "overall_state")


@query
def documents_page_search(v):
    rows, total = D.search(v.docs, states=("failed", "needs_review"), text="c-1", page=2)
    found = D.with_children(rows, {"own": (v.failures, "document_pk", ["created_at", "id"])})
    return found.select("id", "document_id", F.when(F.col("own").isNotNull(), F.size("own")).cast("bigint").alias("n_failures"), F.lit(total).cast("bigint").alias("total"))


@query
def corrupted_files(v):
    found = D.with_batch_name(D.corrupted(v.docs), v.batches)
    return found.select("id", "document_id", "batch", "validation_status", F.when(F.col("is_retryable").eqNullSafe(F.lit(True)), "yes").otherwise("no").alias("retryable"))


@query
def corrupted_report(v):
    docs = v.docs.withColumns({"source": F.concat(F.lit("/in/"), "document_id", F.lit(".pdf")),
        "failure_reason": F.lit(None).cast("string"), "page_count": F.col("ocr_attempts"), "corrupted_pages": F.array(F.lit(1), F.lit(3)),
        "error_code": F.col("validation_status"), "validator_version": F.lit("1"), "validated_at": F.col("created_at")})
    named = {c: re.sub(r"\W+", "_", c.lower()) for c in D.CORRUPT_COLUMNS}
    return D.corrupted_report(docs, v.batches).withColumnsRenamed(named)


@query
def needing_translation(v):
    persons = v.names.select(F.col("deed").alias("document_id"), "name", F.when(F.col("person") % 2 == 0, F.col("name")).alias("name_translated"))
    return D.needing_translation(v.deeds.select(F.col("deed").alias("id"), "batch_id"), persons).select("id")


@query
def batch_queue_head(v):
    return B.next_queued(v.batches).select("id", "queue_position")


@query
def active_batch(v):
    return B.active(v.batches, "queue_position").select("id", "state")


@query
def scheduler_choice(v):
    return B.choose(v.batches.filter("state <> 'running'"), v.docs)


@query
def cleaned_paths(v):
    return D.prepared_paths(v.docs)


@query
def retryable_failures(v):
    return D.retryable_failures(v.docs).select("id", "document_id")


@query
def batches_newest_page(v):
    return B.page(v.batches, 2, 20, [F.desc("total_bytes"), F.col("id")])[0].select("id", "name", "state")


@query
def pager(v):
    return B.pager(v.batches.select(F.col("id").alias("page"), F.lit(v.docs.count()).alias("total")), 25)


@query
def batch_actions(v):
    return B.actions(v.batches, _progress(v))


@query
def batch_detail(v):
    """The first documents of a batch's page as rows of the report, by what they are and sell for."""
    page, _ = B.page(v.deeds, 1, 10, [F.col("deed")])
    shown = page.select("deed", F.col("deed").alias("serial"), "deed_date", F.lit("").alias("identity"), "paise", "property_text",
        "address", F.lit("Karnataka").alias("state"), F.lit(None).cast("bigint").alias("stamp"))
    people = v.parties.join(F.broadcast(page.select("deed")), "deed", "left_semi")
    return export.rows(shown, people).select("deed", F.coalesce("ordinal", F.lit(0)).alias("ordinal"),
        F.col("Transaction Relation (PC)").alias("relation"), F.col("Property Type").alias("kind"), F.col("Person Name (PC)").alias("name"))


@query
def document_texts(v):
    """Each document's text put together again from its pages."""
    from ledgerloom.functions import cleanup

    return cleanup.full_text(cleanup.pages(v.documents.select("doc_id", cleanup.clean(F.col("text")).alias("text")))).select("doc_id", F.length("text").alias("n_chars"))


@query
def run_guards(v):
    return B.guard(v.batches, "run").join(B.guard(v.batches, "stop").withColumnRenamed("message", "stop_message"), "id")


@query
def year_cutoff(v):
    return retention.before_year(v.deeds, "deed_date", 1997).groupBy("batch_id").agg(F.count("*").alias("before_year"))


@query
def failure_attempts(v):
    return D.attempts_of(v.failures).select("id", "document_pk", "stage", "attempt")


@query
def failure_last(v):
    return D.last_failure(v.failures, ["document_pk"]).select("document_pk", "id", "stage", "technical")


@query
def latest_attempt(v):
    return D.last_failure(v.failures, ["document_pk", "stage"]).select("document_pk", "stage", "id")


@query
def failure_history(v):
    return D.history(v.failures).select("document_pk", F.md5("history").alias("digest"), F.col("n").cast("bigint").alias("n"))


@query
def append_failures(v):
    old = D.append_failures(v.failures.limit(0), v.failures.filter("stage <> 'ocr'"), v.spark).drop("attempt")
    return D.append_failures(old, v.failures.filter("stage = 'ocr'"), v.spark).select("id", "document_pk", "stage", "code", "retryable", "attempt")


@query
def moving_average_50(v):
    rows = v.docs.select("id", "created_at", F.round(F.col("value") * 100).cast("bigint").alias("hundredths"))
    return B.moving_average(rows, "hundredths", ["created_at", "id"], Scratch(v.spark, "average")).select("id", F.round("average", 4).alias("average"))


@query
def seconds_per_document(v):
    return B.seconds_per_document(v.docs.withColumn("hundredths", F.round(F.col("value") * 100).cast("bigint")), "hundredths", ["created_at", "id"]).select(F.round("seconds", 4).alias("seconds"))


@query
def completed_edge(v):
    open_now = F.sum(F.when(F.col("overall_state") == "processing", 1).otherwise(0)).over(Window.partitionBy("batch_id").orderBy("created_at", "id").rowsBetween(-4, 0))
    return B.completed_edges(v.docs.withColumn("finished", open_now == 0), "batch_id", ["created_at", "id"]).select("batch_id", "id", "created_at")


@query
def report_serials(v):
    deeds = v.deeds.select("deed", F.when(F.col("deed") % 5 == 0, F.col("deed")).alias("given"))
    return rewrites.serials(deeds, ["deed"], "given", Scratch(v.spark, "serials")).select("deed", "serial")


@query
def party_dedupe(v):
    return export.dedupe(v.parties).select("deed", "relation", "ordinal", "name")


@query
def consideration_split(v):
    return export.split(export.dedupe(v.parties).join(v.deeds.select("deed", "paise"), "deed")).select("deed", "relation", "ordinal", "share")


@query
def person_ordinals(v):
    return rewrites.numbered(v.parties.drop("ordinal"), ["deed", "relation"], ["person", "name"]).select("deed", "relation", "person", "ordinal")


@query
def identifier_difference(v):
    sides = v.parties.groupBy("deed").agg(F.collect_set(F.when(F.col("relation") == "S", F.col("person"))).alias("s"), F.collect_set(F.when(F.col("relation") == "B", F.col("person"))).alias("b"))
    return sides.select("deed", F.explode(F.array_sort(F.array_except("s", "b"))).alias("person"))


@query
def identifier_coverage(v):
    sides = v.parties.groupBy("deed").agg(F.collect_set("person").alias("source"), F.collect_set(F.when(F.col("relation") == "B", F.col("person"))).alias("claimed"))
    return sides.select("deed", F.size("source").cast("bigint").alias("in_source"), F.size("claimed").cast("bigint").alias("claimed"),
        F.bround(grounding.coverage(F.col("claimed"), F.col("source")), 3).alias("coverage"))


@query
def anti_insert(v):
    docs = v.docs.select("id", "document_id")
    old = docs.join(v.failures.select(F.col("document_pk").alias("id")).distinct(), "id", "left_semi")
    return rewrites.new_rows(old, docs.unionByName(docs.withColumn("id", F.col("id") + 1_000_000)), ["document_id"], ["id"])


def _runs(v: Views) -> tuple[DataFrame, DataFrame]:
    return v.first_run, v.second_run


@query
def run_diff(v):
    return reports.compare(*_runs(v)).select("document", "field", "verdict")


@query
def run_agreement(v):
    return reports.agreement(reports.compare(*_runs(v)))


@query
def run_faults(v):
    return reports.faults(reports.compare(*_runs(v))).select("document", "field", "verdict")


@query
def run_missing(v):
    return reports.missing_documents(*_runs(v))


@query
def apply_translations(v):
    new = v.parties.filter("ordinal = 1").select("deed", "relation", "ordinal", F.when(F.col("deed") % 2 == 0, F.concat(F.lit("EN "), "name")).otherwise("").alias("name"))
    return rewrites.fill(v.parties, new, ["deed", "relation", "ordinal"], ["name"]).select("deed", "relation", "ordinal", "name", "written")


@query
def batch_names(v):
    return D.with_batch_name(v.docs.filter("ocr_state = 'failed'"), v.batches).select("id", "batch")


@query
def export_names(v):
    return v.batches.select("id", B.export_name(F.concat("name", F.lit(" / ಮನೆ (1)")), F.to_timestamp(F.lit("2025-03-04 05:06:07")), True).alias("file"))


@query
def recover_running(v):
    return rewrites.release_running(v.docs).select("id", "ocr_state", "ocr_attempts", "extract_state", "extract_attempts", "translate_state", "validate_state")


@query
def recovery(v):
    docs, batches = D.recover(v.docs.withColumn("failure_reason", F.lit(None).cast("string")), v.batches, {"ocr": 1})
    states = docs.select(F.lit("document").alias("kind"), "id", F.concat_ws("/", "ocr_state", "extract_state", "overall_state", F.coalesce("failure_reason", F.lit(""))).alias("state"))
    return states.unionByName(batches.select(F.lit("batch").alias("kind"), "id", "state"))


@query
def requeue_failed(v):
    return D.requeue_failed(v.docs).select("id", "ocr_state", "ocr_attempts", "extract_state", "extract_attempts", "translate_state", "validate_state", "overall_state", "requeued")


@query
def requeue_batches(v):
    return B.requeue_with_documents(v.batches, D.requeue_failed(v.docs)).select("id", "state", "queue_position")


@query
def requeue_ocr(v):
    return D.requeue_ocr(v.docs, v.failures.filter("stage = 'ocr'").select(F.col("document_pk").alias("id"))).select("id", "ocr_state")


@query
def settle_stopping(v):
    return B.settle(v.batches, v.docs).select("id", "state")


@query
def request_stop(v):
    return B.request(v.batches, v.docs, "stop").select("id", "state", "refused")


@query
def request_run(v):
    return B.request(v.batches, v.docs, "run").select("id", "state", "refused")


def _timed(v: Views) -> DataFrame:
    return v.batches.withColumns({"started_at": F.when(F.col("id") % 2 == 0, F.to_timestamp(F.lit("2024-01-01"))),
        "finished_at": F.when(F.col("state") == "completed", F.to_timestamp(F.lit("2024-01-02")))})


@query
def set_states(v):
    asked = v.batches.filter("state IN ('queued', 'stopping')").select("id", F.when(F.col("state") == "queued", "running").otherwise("stopped").alias("state"))
    out = B.set_state(_timed(v), asked, F.to_timestamp(F.lit("2024-02-01")))
    return out.select("id", "state", F.date_format("started_at", "yyyy-MM-dd").alias("started"), F.date_format("finished_at", "yyyy-MM-dd").alias("finished"))


@query
def resume_to_head(v):
    return B.to_head(_timed(v), [9, 3, 15]).select("id", "state", F.col("queue_position").cast("bigint").alias("queue_position"), F.date_format("finished_at", "yyyy-MM-dd").alias("finished"))


def _lost(v: Views, stage: str) -> DataFrame:
    last = D.last_failure(v.failures.filter(F.col("stage") == stage), ["document_pk"])
    return last.select(F.col("document_pk").alias("id"), F.lit("failed").alias("state"), F.col("technical").alias("reason"))


@query
def mark_stage(v):
    docs = v.docs.withColumn("failure_reason", F.lit("before"))
    return D.mark_stage(docs, _lost(v, "extract"), "extract").select("id", "extract_state", "overall_state", "failure_reason")


@query
def mark_overall(v):
    docs = v.docs.withColumn("failure_reason", F.lit("before"))
    return D.mark_overall(docs, _lost(v, "ocr").withColumn("state", F.lit("needs_review"))).select("id", "overall_state", "failure_reason")


@query
def record_verdicts(v):
    docs = v.docs.withColumn("page_count", F.col("ocr_attempts"))
    told = v.docs.filter("validation_status IS NOT NULL").select("id", F.col("validation_status").alias("status"), F.lit(7).cast("bigint").alias("page_count"))
    return D.record_verdicts(docs, told).select("id", "validation_status", "page_count")


@query
def finalise_batches(v):
    return B.finalise(v.batches, _progress(v)).select("id", "state")


@query
def fail_stranded(v):
    docs = v.docs.withColumn("failure_reason", F.lit(None).cast("string"))
    return D.fail_stranded(docs, {"ocr": 1}).filter("failure_reason IS NOT NULL").select("id", F.col("failure_reason").alias("reason"), "overall_state")


@query
def purge_cascade(v):
    gone = v.deeds.filter("deed_date < DATE '1998-01-01'").select("deed")
    return rewrites.cascade({"deeds": v.deeds, "parties": v.parties}, gone, [("deeds", "deed", "parties", "deed")])["parties"].select("deed", "relation", "ordinal")


@query
def ttl_purge(v):
    return rewrites.expire(v.deeds, "deed_date", F.lit("1999-06-01").cast("date"), 30).select("deed")


@query
def upsert_latest(v):
    own = ["document_pk"]
    old = D.last_failure(v.failures.filter("id % 2 = 0"), own).select("document_pk", "id", "stage", "created_at")
    return rewrites.upsert(old, v.failures.filter("id % 2 <> 0").select("document_pk", "id", "stage", "created_at"), own, ["created_at", "id"]).select("document_pk", "id", "stage")


@query
def get_or_create_users(v):
    name = lambda df, c: df.select(F.trim(c).alias("name"))
    return rewrites.insert_new(name(v.supplier, "s_name").distinct(), name(v.customer, "c_name"), ["name"], ["name"])


@query
def delete_guard(v):
    return B.deletable(v.batches, v.docs)


@query
def seed_from_ocr(v):
    return D.seed(v.docs, 2_000_000).select("id", "document_id", "ocr_state", "extract_state", "overall_state")


@query
def ocr_outcomes(v):
    return v.docs.select("id", D.ocr_outcome(F.col("ocr_state"), F.col("ocr_attempts"), F.col("is_retryable"), F.col("validation_status"), 1).alias("outcome"))


@query
def extract_outcomes(v):
    return v.docs.filter("ocr_state = 'done'").select("id", D.extract_outcome(F.col("extract_state") == "done", F.col("value") >= 50, F.col("extract_attempts"), 1).alias("outcome"))


@query
def translate_outcomes(v):
    asked = v.names.groupBy("deed").agg(F.count_if(language.needs_translation(F.col("name"))).alias("asked"))
    return asked.select("deed", D.translate_outcome(F.lit(0), F.col("asked")).alias("outcome"))


@query
def text_gates(v):
    return v.documents.select("doc_id", D.text_gate(F.col("text"), F.col("doc_id") % 40 + 1).alias("reason"))


@query
def pending_translations(v):
    return language.pending(v.names, ["deed", "relation", "ordinal"], {"name": "transliterate", "father": "transliterate", "address": "translate"})


@query
def translation_tally(v):
    return reports.translation_tally(v.phrases, v.names.select(F.col("name").alias("text")))


@query
def untranslated_items(v):
    return reports.untranslated(v.phrases.withColumn("translated", F.when(F.col("id") % 3 == 0, "yes").when(F.col("id") % 3 == 1, ""))).select("id")


@query
def assigned_answers(v):
    told = v.phrases.select("id", F.when(F.col("id") % 3 == 1, F.concat(F.lit("EN "), F.col("id").cast("string"))).when(F.col("id") % 3 == 2, " ").alias("text"))
    return reports.assigned(v.phrases, told).select("id", "translated", "error")


@query
def capabilities(v):
    status = v.batches.select("id", (F.col("total_bytes") > 0).alias("database"), (F.col("user_key") > 5).alias("server"), (F.col("total_bytes") < 800_000).alias("disk"))
    return machine.capabilities(status)


@query
def status_snapshot(v):
    samples = v.docs.select(F.col("batch_id").alias("source"), "id", F.col("created_at").alias("ts"), F.round(F.col("value") * 100).cast("bigint").alias("hundredths"))
    return machine.latest(samples, "source").select("source", "id", "hundredths")


@query
def probe_results(v):
    b = v.batches
    found = machine.availability(F.col("total_bytes") > 0, F.col("state") == "running", F.col("user_key") > 5, F.col("state") == "queued", F.when(F.col("user_key") > 20, "error: no model"))
    return b.select("id", found.alias("availability"))


@query
def pressure_reasons(v):
    gib = 1024**3
    gauges = v.part.select("p_partkey", (F.col("p_size").cast("bigint") * gib).alias("ram_free"), F.lit(100 * gib).alias("ram_total"),
        (F.col("p_partkey").cast("bigint") % 7 * gib).alias("vram_free"), F.lit(16 * gib).alias("vram_total"),
        (F.col("p_partkey").cast("bigint") % 5 * gib).alias("disk_free"), F.when(F.col("p_partkey") % 2 == 0, "high").alias("pressure"))
    return gauges.select("p_partkey", machine.pressure_reason(gauges).alias("reason"))


@query
def dashboard(v):
    return B.dashboard(v.batches, _progress(v), [F.desc("total_bytes"), F.col("id")])


@query
def upload_summary(v):
    return B.limit_messages(B.selection(v.batches, []), queued=4).select("files", "bytes", "too_many", "too_large", F.array_join("messages", " ").alias("messages"))


@query
def failure_panel(v):
    return D.failure_panel(v.failures, v.spark)


@query
def data_view(v):
    flags = v.parties.select("deed", "relation", "ordinal", F.explode(F.array_compact(F.array(F.when(F.col("name") == "-", "NO_NAME"),
        F.when(F.col("aadhaar").isNull() & F.col("pan").isNull(), "NO_ID")))).alias("flag"))
    return D.data_view(v.deeds, v.parties, flags, page=2)


@query
def retention_tally(v):
    scratch = Scratch(v.spark, "retention")
    batches = v.deeds.groupBy(F.col("batch_id").alias("id")).agg(F.min("deed_date").cast("timestamp").alias("created_at"))
    tables = {"pages": v.deeds.select(F.col("deed").alias("id"), F.col("deed").alias("document_id"),
        F.col("deed_date").cast("timestamp").alias("created_at")), "logs": v.failures.select("id", "created_at"), "batches": batches,
        "documents": v.deeds.select(F.col("deed").alias("id"), "batch_id")}
    kept, tally = retention.run(v.spark, tables, F.to_timestamp(F.lit("1998-06-01")), 30, 30, 1993, scratch.path("archive"))
    left = [kept[t].agg(F.count("*").alias("n")).select(F.lit(f"{t} kept").alias("kind"), "n") for t in ("batches", "documents", "pages")]
    return tally.unionByName(left[0]).unionByName(left[1]).unionByName(left[2])


@query
def settings_merge(v):
    defaults = v.nation.select(F.col("n_name").alias("key"), F.lit("no").alias("value"))
    stored = v.nation.select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, " Yes ").otherwise("").alias("value"))
    environment = v.region.select(F.col("r_name").alias("key"), F.lit("1").alias("value"))
    return files.precedence(defaults, stored, environment).withColumn("on", files.as_boolean(F.col("value")))


@query
def overlays(v):
    spans = v.lineitem.select((F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_linenumber").alias("page"),
        F.concat(F.lit("For Government Purpose "), F.col("l_linestatus")).alias("text"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"),
        F.lit(0).alias("colour"), F.lit(9.0).alias("size"))
    faint = v.lineitem.select((F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_linenumber").alias("page"),
        F.concat(F.lit("ordinary wording "), F.col("l_returnflag")).alias("text"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"),
        F.when(F.col("l_returnflag") == "R", 0xCCCCCC).otherwise(0x101010).alias("colour"), F.lit(9.0).alias("size"))
    rows = spans.unionByName(faint)
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("page_count"))
    return marks.overlays(rows, pages).select("doc_id", "text", F.col("n_pages").cast("bigint").alias("n_pages"))


@query
def findings(v):
    rows = v.lineitem.select((F.col("l_orderkey") % 500).alias("doc_id"),
        F.when(F.col("l_returnflag") == "R", "raster").otherwise("annotation").alias("kind"),
        F.when(F.col("l_linestatus") == "O", "lossless").otherwise("lossy").alias("fidelity"),
        F.array(F.col("l_linenumber").cast("int")).alias("pages"))
    return marks.sorted_findings(rows).select("doc_id", "confirmed", "removable", F.array_join("scanned_pages", ",").alias("scanned_pages"))


@query
def card_profiles(v):
    cards = v.part.select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("bigint") * 268_435_456).alias("free_bytes"),
        F.lit(3_900_000_000).alias("parameters"), F.lit(5).cast("bigint").alias("full_layers"), F.lit(29).cast("bigint").alias("sliding_layers"),
        F.lit(1024).cast("bigint").alias("window"), F.lit(4).cast("bigint").alias("heads"), F.lit(256).cast("bigint").alias("head_size"))
    return machine.profiles(cards, 700 * machine.MIB, 64 * machine.MIB)


@query
def card_batches(v):
    memory = F.col("p_size").cast("bigint") * 268_435_456
    return v.part.select("p_partkey", machine.batch_sizes(memory).alias("b"),
        machine.offloaded_layers(F.lit(34), F.lit(150_000_000), memory, F.lit(1_000_000_000)).alias("layers")).select("p_partkey", "b.*", "layers")


@query
def stage_concurrency(v):
    level = F.when(F.col("p_size") > 40, "normal").when(F.col("p_size") > 20, "elevated").when(F.col("p_size") > 10, "high").otherwise("critical")
    return v.part.select("p_partkey", machine.workers(level, F.col("p_size") % 17, (F.col("p_size") * 40_000_000).cast("bigint"), "validate").cast("bigint").alias("slots"))


@query
def free_memory(v):
    total = F.lit(50.0)
    share = folds.free_fraction(F.col("p_size") / 2, F.col("p_partkey") % 30, total)
    return v.part.select("p_partkey", F.round(share, 6).alias("share"), folds.admits(F.when(F.col("p_size") < 10, "critical").otherwise("high"), share).alias("admits"))


@query
def line_boxes(v):
    lines = v.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), (F.col("l_quantity") * 2).alias("x1"),
        F.col("l_linenumber").cast("double").alias("y0"), (F.col("l_linenumber") * 1.5).cast("double").alias("y1"), F.lit(700.0).alias("w"),
        F.lit(0.0).alias("h"), "l_partkey", "l_suppkey", "l_extendedprice")
    return folds.normalised_boxes(lines, "w", "h").drop("w", "h")


@query
def retryable_verdicts(v):
    s = F.col("validation_status")
    return v.docs.select("id", D.is_corrupt(s).alias("corrupt"), D.may_retry(s).alias("retryable"))


@query
def tool_failures(v):
    """An explicit code wins over what the text says."""
    given = F.when(F.col("id") % 5 == 0, "OCR_TIMEOUT")
    return v.failures.select("id", F.coalesce(given, failure_codes.code(F.col("technical"), F.col("validation_status"))).alias("code"),
        failure_codes.failed_stage(*[F.when(F.col("stage") == s, "failed").otherwise("done") for s in ("ocr", "extract", "translate",
        "validate")]).alias("stage"))


_count = lambda cond: f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"
_states = ", ".join(f"{_count(f'{s}_state = {chr(39)}{v}{chr(39)}')} AS {s}_{v}" for s in ("ocr", "extract", "translate", "validate") for v in ("done", "failed"))
_overall = ", ".join(f"{_count(f'overall_state = {chr(39)}{v}{chr(39)}')} AS {v}" for v in ("processed", "failed", "needs_review"))
#: The codes and retry advice of each verdict on a file.
_CORRUPT = "('CORRUPTED_PDF', 'INVALID_PDF', 'PASSWORD_PROTECTED', 'EMPTY_PDF', 'INCOMPLETE_PDF', 'UNREADABLE_PDF', 'PDF_PARSE_ERROR', 'PDF_RENDER_ERROR')"
_PROGRESS = f"(SELECT batch_id, count(*) AS total, {_states}, {_overall}, {_count(chr(39) + 'processing' + chr(39) + ' = overall_state')} AS processing FROM docs GROUP BY batch_id)"
_ANY_RUNNING = "(ocr_state = 'running' OR extract_state = 'running' OR translate_state = 'running' OR validate_state = 'running')"
_PARTY_KEY = "CASE WHEN aadhaar IS NOT NULL AND length(aadhaar) = 12 THEN concat('a:', aadhaar) WHEN pan IS NOT NULL THEN concat('p:', upper(pan)) ELSE concat('n:', lower(name), ':', lower(father)) END"
_FIRST = f"(SELECT *, row_number() OVER (PARTITION BY deed, relation, {_PARTY_KEY} ORDER BY ordinal) AS copy FROM parties)"
_SHARES = f"""(SELECT p.deed, p.relation, p.ordinal, p.name, d.paise, count(*) OVER (PARTITION BY p.deed, p.relation) AS n, row_number() OVER (PARTITION BY p.deed, p.relation ORDER BY p.ordinal) AS i
    FROM {_FIRST} AS p JOIN deeds AS d ON p.deed = d.deed WHERE copy = 1 AND name <> '-')"""

_COMPARED = """(SELECT a.document, a.field, CASE WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'lost' WHEN regexp_replace(lower(a.v),
            '[^a-z0-9]', '', 'g') = regexp_replace(lower(b.v), '[^a-z0-9]', '', 'g') THEN 'same_text' ELSE 'changed' END AS verdict
    FROM (SELECT document, field, nullif(trim(value), '') AS v FROM first_run) AS a JOIN (SELECT document, field, nullif(trim(value),
            '') AS v FROM second_run) AS b ON a.document = b.document AND a.field = b.field)"""

SQL: dict[str, str] = {
    "batch_progress": f"""SELECT b.id AS batch_id, coalesce(total, 0) AS total, {", ".join(f"coalesce({c}, 0) AS {c}" for c in [*(f"{s}_{v}" for s in ("ocr", "extract", "translate", "validate") for v in ("done", "failed")), "processed", "failed", "needs_review"])},
        CASE WHEN total > 0 THEN 100.0E0 * (processed + failed) / total ELSE 0.0E0 END AS percent_closed,
        CASE WHEN total > 0 THEN 100.0E0 * (processed + failed + needs_review) / total ELSE 0.0E0 END AS percent_settled
        FROM batches AS b LEFT JOIN {_PROGRESS} AS p ON b.id = p.batch_id""",
    "batch_finished": f"SELECT b.id AS batch_id, coalesce(processing, 0) = 0 AS finished FROM batches AS b LEFT JOIN {_PROGRESS} AS p ON b.id = p.batch_id",
    "in_flight": f"SELECT batch_id, {_count(f'overall_state = {chr(39)}processing{chr(39)} AND {_ANY_RUNNING}')} AS in_flight FROM docs GROUP BY batch_id",
    "pending_and_failed_ocr": f"SELECT batch_id, {_count(chr(39) + 'pending' + chr(39) + ' = ocr_state AND overall_state = ' + chr(39) + 'processing' + chr(39))} AS pending_ocr, {_count(chr(39) + 'failed' + chr(39) + ' = ocr_state')} AS failed_ocr FROM docs GROUP BY batch_id",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("batches", "docs", "failures", "deeds", "parties", "customer", "supplier")),
    "pdf_status_histogram": f"""SELECT s.status, coalesce(n, 0) AS n FROM (SELECT unnest([{", ".join(f"'{s}'" for s in D.STATUSES)}]) AS status) AS s
            LEFT JOIN (SELECT validation_status, count(*) AS n FROM docs GROUP BY validation_status) AS c ON s.status = c.validation_status
        UNION ALL SELECT 'CORRUPT', {_count('validation_status IN ' + _CORRUPT)} FROM docs UNION ALL SELECT 'TOTAL', count(validation_status) FROM docs
        UNION ALL SELECT 'RETRYABLE', {_count("validation_status IN ('VALID', 'PROCESSING_ERROR', 'PARTIALLY_CORRUPTED', 'UNKNOWN_FAILURE')")} FROM docs""",
    "job_states": "SELECT state, count(*) AS n FROM batches GROUP BY state",
    "queue_bounds": f"SELECT {_count(chr(39) + 'queued' + chr(39) + ' = state')} AS queued, coalesce(max(queue_position), 0) + 1 AS next_position, coalesce(min(queue_position), 0) - 1 AS head_position FROM batches WHERE state IN ('queued', 'running')",
    "selection_totals": "SELECT user_key, count(*) AS files, CAST(sum(total_bytes) AS BIGINT) AS bytes, count(*) > 1000 OR sum(total_bytes) > 26843545600 AS over_limit FROM batches GROUP BY user_key",
    "language_histogram": "SELECT language, count(*) AS n FROM (SELECT CASE id % 8 WHEN 0 THEN 'kan_Knda' WHEN 1 THEN 'hin_Deva' WHEN 2 THEN 'tam_Taml' WHEN 3 THEN 'tel_Telu' WHEN 4 THEN 'ben_Beng' WHEN 5 THEN 'hin_Deva' WHEN 6 THEN 'eng_Latn' END AS language FROM phrases) AS l WHERE language IS NOT NULL GROUP BY language",
    "identity_accuracy": f"""SELECT doc_id % 4 AS part, count(*) AS total, {_count("identity <> ''")} AS found, {_count("identity = ''")} AS blank, {_count("identity <> '' AND identity = want")} AS agree, {_count("identity <> '' AND identity <> want")} AS disagree, {_count("identity <> '' AND want IS NULL")} AS unknown,
        round(100.0E0 * {_count("identity <> '' AND identity = want")} / nullif({_count("identity <> '' AND want IS NOT NULL")}, 0),
            1) AS percent, {_count("identity <> '' AND identity <> want")} = 0 AND {_count("identity <> ''")} * 10 >= count(*) * 9 AS passed
            FROM ({textual.IDENTITY_SQL}) AS i GROUP BY doc_id % 4""",
    "stranded_documents": """SELECT id, batch_id, 'ocr' AS stage, ocr_attempts AS attempts FROM docs WHERE overall_state = 'processing' AND ocr_state = 'pending' AND ocr_attempts > 2
        UNION ALL SELECT id, batch_id, 'extract', extract_attempts FROM docs WHERE overall_state = 'processing' AND extract_state = 'pending' AND extract_attempts > 1""",
    "claim_next_per_batch": """SELECT batch_id, id, document_id, 'running' AS extract_state, extract_attempts + 1 AS extract_attempts
            FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS k
        FROM docs WHERE overall_state = 'processing' AND ocr_state = 'done' AND extract_state = 'pending' AND extract_attempts <= 2) AS c WHERE k = 1""",
    "claim_downstream": """SELECT batch_id, id, stage FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY place, id) AS k FROM (
        SELECT batch_id, id, 1 AS place, 'extract' AS stage FROM docs WHERE overall_state = 'processing' AND ocr_state = 'done' AND extract_state = 'pending'
        UNION ALL SELECT batch_id, id, 2, 'validate' FROM docs WHERE overall_state = 'processing' AND ocr_state = 'done' AND extract_state = 'done' AND translate_state = 'done' AND validate_state = 'pending'
        UNION ALL SELECT batch_id, id, 3, 'translate' FROM docs WHERE overall_state = 'processing' AND ocr_state = 'done' AND extract_state = 'done' AND translate_state = 'pending') AS u) AS s
            WHERE k = 1""",
    "failed_page": "SELECT id, batch_id, document_id FROM docs WHERE ocr_state = 'failed' ORDER BY batch_id DESC, id LIMIT 25 OFFSET 50",
    "failed_for_batch": "SELECT id, batch_id, document_id, overall_state FROM docs WHERE overall_state = 'failed'",
    "documents_page_search": """SELECT p.id, p.document_id, c.n_failures, t.total FROM (SELECT id, document_id
            FROM docs WHERE document_id ILIKE '%c-1%' AND overall_state IN ('failed', 'needs_review')
            ORDER BY id LIMIT 25 OFFSET 25) AS p
        LEFT JOIN (SELECT document_pk, count(*) AS n_failures FROM failures GROUP BY document_pk) AS c ON p.id = c.document_pk
        CROSS JOIN (SELECT count(*) AS total FROM docs WHERE document_id ILIKE '%c-1%' AND overall_state IN ('failed', 'needs_review')) AS t""",
    "corrupted_files": f"SELECT d.id, d.document_id, coalesce(b.name, '') AS batch, d.validation_status, CASE WHEN d.is_retryable IS NOT DISTINCT FROM true THEN 'yes' ELSE 'no' END AS retryable FROM docs AS d LEFT JOIN batches AS b ON d.batch_id = b.id WHERE validation_status IN {_CORRUPT}",
    "needing_translation": "SELECT DISTINCT deed AS id FROM parties WHERE person % 2 <> 0 AND (person % 4 = 1 OR name <> '')",
    "batch_queue_head": "SELECT id, queue_position FROM batches WHERE state = 'queued' ORDER BY queue_position, id LIMIT 1",
    "active_batch": "SELECT id, state FROM batches WHERE state = 'running' ORDER BY queue_position NULLS LAST, id LIMIT 1",
    "cleaned_paths": "SELECT id, cleaned_path FROM docs WHERE cleaned_path IS NOT NULL AND cleaned_path <> ''",
    "retryable_failures": "SELECT id, document_id FROM docs WHERE overall_state = 'failed' AND is_retryable IS DISTINCT FROM false",
    "batches_newest_page": "SELECT id, name, state FROM batches ORDER BY total_bytes DESC, id LIMIT 20 OFFSET 20",
    "pager": """SELECT page, pages, greatest(1, least(page - 2, pages - 4)) AS first_number, least(pages, greatest(1, least(page - 2, pages - 4)) + 4) AS last_number, (page - 1) * 25 + 1 AS from_row, least(page * 25, total) AS to_row
        FROM (SELECT id AS page, greatest(1, (total + 24) // 25) AS pages, total FROM batches CROSS JOIN (SELECT count(*) AS total FROM docs) AS t) AS p WHERE page BETWEEN 1 AND pages""",
    "batch_actions": f"""SELECT b.id, b.state IN ('draft', 'stopped') AS can_run, b.state IN ('queued', 'running') AS can_stop, b.state IN ('running', 'stopping') AS needs_force, coalesce(p.total - p.processed - p.failed - p.needs_review, 0) AS pending,
        CASE WHEN p.total > 0 THEN round_even(100.0E0 * (p.processed + p.failed + p.needs_review) / p.total, 1) ELSE 0.0E0 END AS percent
            FROM batches AS b LEFT JOIN {_PROGRESS} AS p ON b.id = p.batch_id""",
    "year_cutoff": "SELECT batch_id, count(*) AS before_year FROM deeds WHERE year(deed_date) < 1997 GROUP BY batch_id",
    "failure_attempts": "SELECT id, document_pk, stage, row_number() OVER (PARTITION BY document_pk, stage ORDER BY created_at, id) AS attempt FROM failures",
    "failure_last": "SELECT document_pk, id, stage, technical FROM (SELECT *, row_number() OVER (PARTITION BY document_pk ORDER BY created_at DESC, id DESC) AS k FROM failures) AS f WHERE k = 1",
    "latest_attempt": "SELECT document_pk, stage, id FROM (SELECT *, row_number() OVER (PARTITION BY document_pk, stage ORDER BY created_at DESC, id DESC) AS k FROM failures) AS f WHERE k = 1",
    "moving_average_50": "SELECT id, round(avg(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY created_at, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 4) AS average FROM docs",
    "completed_edge": """SELECT batch_id, id, created_at FROM (SELECT *, lag(open_now) OVER (PARTITION BY batch_id ORDER BY created_at, id) AS open_before FROM (SELECT batch_id, id, created_at,
        sum(CASE WHEN overall_state = 'processing' THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY created_at, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS open_now
            FROM docs) AS p) AS e WHERE open_now = 0 AND open_before > 0""",
    "report_serials": """SELECT deed, coalesce(explicit, 0) + k - CASE WHEN grp = 0 THEN 0 ELSE 1 END AS serial
            FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY deed) AS k, max(given) OVER (PARTITION BY grp) AS explicit
        FROM (SELECT *, sum(CASE WHEN given IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY deed ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp
            FROM (SELECT deed, CASE WHEN deed % 5 = 0 THEN deed END AS given FROM deeds) AS g) AS s) AS n""",
    "party_dedupe": f"SELECT deed, relation, ordinal, name FROM {_FIRST} AS p WHERE copy = 1 AND name <> '-'",
    "consideration_split": f"""SELECT deed, relation, ordinal, CASE WHEN paise % (100 * n) = 0 THEN CAST(share // 100 AS VARCHAR) ELSE concat(CAST(share // 100 AS VARCHAR),
            '.', lpad(CAST(share % 100 AS VARCHAR), 2, '0')) END AS share
        FROM (SELECT *, paise // n + CASE WHEN i <= paise % n THEN 1 ELSE 0 END AS share FROM {_SHARES} AS s) AS t""",
    "person_ordinals": "SELECT deed, relation, person, row_number() OVER (PARTITION BY deed, relation ORDER BY person, name) AS ordinal FROM parties",
    "identifier_difference": "SELECT deed, person FROM (SELECT deed, person FROM parties WHERE relation = 'S' EXCEPT SELECT deed, person FROM parties WHERE relation = 'B') AS x",
    "identifier_coverage": "SELECT deed, count(DISTINCT person) AS in_source, count(DISTINCT CASE WHEN relation = 'B' THEN person END) AS claimed, round_even(CAST(count(DISTINCT CASE WHEN relation = 'B' THEN person END) AS DOUBLE) / count(DISTINCT person), 3) AS coverage FROM parties GROUP BY deed",
    "anti_insert": """SELECT id, document_id FROM (SELECT id, document_id, row_number() OVER (PARTITION BY document_id
            ORDER BY id) AS k FROM (SELECT id, document_id FROM docs UNION ALL SELECT id + 1000000, document_id
            FROM docs) AS c) AS n
        WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM failures AS f WHERE f.document_pk = n.id)""",
    "run_diff": f"SELECT document, field, verdict FROM {_COMPARED} AS c",
    "run_agreement": f"""SELECT field, count(*) AS compared, {_count("verdict = 'same'")} AS exact, {_count("verdict LIKE 'same%'")} AS by_text, round({_count("verdict = 'same'")} * 100.0E0 / count(*),
            2) AS exact_percent, round({_count("verdict LIKE 'same%'")} * 100.0E0 / count(*), 2) AS text_percent
            FROM {_COMPARED} AS c GROUP BY field""",
    "apply_translations": """SELECT p.deed, p.relation, p.ordinal, coalesce(NULLIF(t.name, ''), p.name) AS name, NOT (coalesce(NULLIF(t.name, ''), p.name) IS NOT DISTINCT FROM p.name) AS written
        FROM parties AS p LEFT JOIN (SELECT deed, relation, ordinal, CASE WHEN deed % 2 = 0 THEN concat('EN ', name) ELSE '' END AS name
            FROM parties WHERE ordinal = 1) AS t ON p.deed = t.deed AND p.relation = t.relation AND p.ordinal = t.ordinal""",
    "batch_names": "SELECT d.id, coalesce(b.name, '') AS batch FROM docs AS d LEFT JOIN batches AS b ON d.batch_id = b.id WHERE d.ocr_state = 'failed'",
    "recover_running": """SELECT id, CASE ocr_state WHEN 'running' THEN 'pending' ELSE ocr_state END AS ocr_state,
            CASE WHEN ocr_state = 'running' THEN greatest(ocr_attempts - 1, 0) ELSE ocr_attempts END AS ocr_attempts,
        CASE extract_state WHEN 'running' THEN 'pending' ELSE extract_state END AS extract_state, CASE WHEN extract_state = 'running' THEN greatest(extract_attempts - 1, 0) ELSE extract_attempts END AS extract_attempts,
        CASE translate_state WHEN 'running' THEN 'pending' ELSE translate_state END AS translate_state, CASE validate_state WHEN 'running' THEN 'pending' ELSE validate_state END AS validate_state
            FROM docs""",
    "requeue_failed": f"""SELECT id, {", ".join(f"CASE WHEN overall_state = 'failed' THEN 'pending' ELSE {s}_state END AS {s}_state" for s in ("ocr", "extract", "translate", "validate"))},
        {", ".join(f"CASE WHEN overall_state = 'failed' THEN 0 ELSE {s}_attempts END AS {s}_attempts" for s in ("ocr", "extract"))},
            CASE WHEN overall_state = 'failed' THEN 'processing' ELSE overall_state END AS overall_state, overall_state = 'failed' AS requeued
            FROM docs""",
    "requeue_ocr": "SELECT d.id, CASE WHEN f.document_pk IS NOT NULL AND d.ocr_state = 'failed' THEN 'pending' ELSE d.ocr_state END AS ocr_state FROM docs AS d LEFT JOIN (SELECT DISTINCT document_pk FROM failures WHERE stage = 'ocr') AS f ON d.id = f.document_pk",
    "settle_stopping": f"SELECT b.id, CASE WHEN b.state = 'stopping' AND r.batch_id IS NULL THEN 'stopped' ELSE b.state END AS state FROM batches AS b LEFT JOIN (SELECT DISTINCT batch_id FROM docs WHERE overall_state = 'processing' AND {_ANY_RUNNING}) AS r ON b.id = r.batch_id",
    "request_stop": f"""SELECT b.id, CASE b.state WHEN 'queued' THEN 'stopped' WHEN 'running' THEN CASE WHEN r.batch_id IS NULL THEN 'stopped' ELSE 'stopping' END ELSE b.state END AS state, b.state NOT IN ('queued', 'running') AS refused
        FROM batches AS b LEFT JOIN (SELECT DISTINCT batch_id FROM docs WHERE overall_state = 'processing' AND {_ANY_RUNNING}) AS r ON b.id = r.batch_id""",
    "resume_to_head": """SELECT id, CASE WHEN id IN (9, 3, 15) THEN 'queued' ELSE state END AS state, CASE id WHEN 9 THEN h WHEN 3 THEN h + 1 WHEN 15 THEN h + 2 ELSE queue_position END AS queue_position,
            CASE WHEN state = 'completed' AND id NOT IN (9, 3, 15) THEN '2024-01-02' END AS finished
        FROM batches, (SELECT coalesce(min(queue_position), 1) - 3 AS h FROM batches WHERE state IN ('queued', 'running')) AS q""",
    "mark_stage": """SELECT id, CASE WHEN why IS NOT NULL THEN 'failed' ELSE extract_state END AS extract_state,
            CASE WHEN why IS NOT NULL THEN 'failed' ELSE overall_state END AS overall_state, coalesce(nullif(why, ''),
            'before') AS failure_reason
        FROM docs LEFT JOIN (SELECT document_pk, arg_max(technical, (created_at, id)) AS why FROM failures WHERE stage = 'extract' GROUP BY document_pk) AS f ON id = document_pk""",
    "finalise_batches": f"SELECT b.id, CASE WHEN b.state = 'running' AND coalesce(p.processing, 0) = 0 THEN 'completed' ELSE b.state END AS state FROM batches AS b LEFT JOIN {_PROGRESS} AS p ON b.id = p.batch_id",
    "fail_stranded": "SELECT id, concat('ocr gave up after ', CAST(ocr_attempts AS VARCHAR(20)), ' attempts') AS reason, 'failed' AS overall_state FROM docs WHERE overall_state = 'processing' AND ocr_state = 'pending' AND ocr_attempts > 2",
    "purge_cascade": "SELECT p.deed, p.relation, p.ordinal FROM parties AS p WHERE NOT EXISTS (SELECT 1 FROM deeds AS d WHERE d.deed = p.deed AND d.deed_date < DATE '1998-01-01')",
    "ttl_purge": "SELECT deed FROM deeds WHERE deed_date >= DATE '1999-06-01' - INTERVAL 30 DAY",
    "upsert_latest": """SELECT document_pk, id, stage FROM (SELECT *, row_number() OVER (PARTITION BY document_pk
            ORDER BY newer DESC, created_at DESC, id DESC) AS k FROM (SELECT document_pk, id, stage, created_at, 0 AS newer
            FROM failures WHERE id % 2 = 0
        UNION ALL SELECT document_pk, id, stage, created_at, 1 FROM failures WHERE id % 2 <> 0) AS u) AS m WHERE k = 1""",
    "get_or_create_users": "SELECT name FROM (SELECT DISTINCT trim(s_name) AS name FROM supplier UNION SELECT DISTINCT trim(c_name) FROM customer) AS u",
    "delete_guard": f"SELECT b.id, b.state NOT IN ('running', 'stopping') AND r.batch_id IS NULL AS deletable FROM batches AS b LEFT JOIN (SELECT DISTINCT batch_id FROM docs WHERE {_ANY_RUNNING}) AS r ON b.id = r.batch_id",
    "seed_from_ocr": "SELECT id + 2000000 AS id, document_id, 'done' AS ocr_state, 'pending' AS extract_state, 'processing' AS overall_state FROM docs WHERE ocr_state = 'done'",
    "ocr_outcomes": f"""SELECT id, CASE WHEN ocr_state <> 'failed' THEN 'OCR_P' WHEN is_retryable IS DISTINCT
            FROM false AND ocr_attempts <= 1 AND (validation_status IS NULL OR validation_status NOT IN {_CORRUPT}) THEN 'retry' ELSE 'OCR_F' END AS outcome
            FROM docs""",
    "extract_outcomes": "SELECT id, CASE WHEN extract_state = 'done' THEN 'done' WHEN extract_attempts <= 1 THEN 'retry' WHEN value >= 50 THEN 'done_needs_review' ELSE 'failed' END AS outcome FROM docs WHERE ocr_state = 'done'",
    "pending_translations": """SELECT deed, relation, ordinal, 'name' AS field, 'transliterate' AS operation
            FROM names WHERE person % 4 IN (0, 1) UNION ALL SELECT deed, relation, ordinal, 'address', 'translate'
            FROM names WHERE person % 6 = 0""",
    "capabilities": """SELECT id, true AS browse, total_bytes > 0 AS export, total_bytes > 0 AND total_bytes < 800000 AS upload, total_bytes > 0 AND total_bytes < 800000 AND user_key > 5 AS process,
        CASE WHEN total_bytes <= 0 THEN 'database is down' WHEN total_bytes >= 800000 THEN 'disk is full' WHEN user_key <= 5 THEN 'server is down' ELSE '' END AS reason FROM batches""",
    "status_snapshot": "SELECT source, id, hundredths FROM (SELECT batch_id AS source, id, CAST(round(value * 100) AS BIGINT) AS hundredths, row_number() OVER (PARTITION BY batch_id ORDER BY created_at DESC, id DESC) AS k FROM docs) AS s WHERE k = 1",
    "dashboard": f"""SELECT b.id, b.name, b.state, coalesce(p.total, 0) AS total, coalesce(p.processed, 0) AS processed, k AS place
            FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY total_bytes DESC, id) AS k
            FROM batches) AS b
        LEFT JOIN {_PROGRESS} AS p ON b.id = p.batch_id WHERE (b.state IN ('queued', 'running') AND k <= 20) OR (b.state = 'completed' AND k <= 5)""",
    "upload_summary": """SELECT count(*) AS files, CAST(sum(total_bytes) AS BIGINT) AS bytes, count(*) > 1000 AS too_many, sum(total_bytes) > 26843545600 AS too_large,
        concat_ws(' ', CASE WHEN count(*) > 1000 THEN concat(CAST(count(*) AS VARCHAR), ' files are over the limit of 1000.') END,
            CASE WHEN sum(total_bytes) > 26843545600 THEN concat(format('{:.1f}', sum(total_bytes) / 1073741824.0E0),
            ' GB are over the limit of 25 GB.') END, '4 batches are waiting already.') AS messages FROM batches""",
    "failure_panel": f"""SELECT id, batch_id, f.code, message, greatest(n - 25, 0) AS hidden, can_rerun
            FROM (SELECT x.*, message, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, id) AS k, count(*) OVER (PARTITION BY batch_id) AS n, bool_or(retryable) OVER (PARTITION BY batch_id) AS can_rerun
        FROM (SELECT *, {textual.CODE_SQL} AS code FROM failures) AS x JOIN (VALUES {textual.CODES_SQL}) AS c(code, code_stage, message, retryable) ON x.code = c.code) AS f WHERE k <= 25""",
    "data_view": """SELECT d.deed, p.relation, p.ordinal, p.name, coalesce(concat_ws(', ', CASE WHEN p.deed IS NOT NULL AND aadhaar IS NULL AND pan IS NULL THEN 'NO_ID' END,
            CASE WHEN name = '-' THEN 'NO_NAME' END), '') AS flags
        FROM (SELECT deed FROM deeds ORDER BY deed LIMIT 100 OFFSET 100) AS d LEFT JOIN parties AS p ON d.deed = p.deed""",
    "settings_merge": """SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS value, n_nationkey % 2 = 0 AS "on"
            FROM nation UNION ALL SELECT r_name, '1', true FROM region""",
    "stage_concurrency": """SELECT p_partkey, CAST(greatest(1, floor(least(greatest(1, p_size % 17 - 1),
            floor(greatest(0, CAST(p_size * 40000000 AS BIGINT) - 536870912) / 50331648.0E0)) * CASE WHEN p_size > 40 THEN 1.0E0 WHEN p_size > 20 THEN 0.5E0 WHEN p_size > 10 THEN 0.25E0 ELSE 0.0E0 END)) AS BIGINT) AS slots
            FROM part""",
    "run_faults": f"SELECT document, field, verdict FROM {_COMPARED} AS c WHERE verdict NOT IN ('same', 'same_text') ORDER BY document, field LIMIT 40",
    "run_missing": "SELECT DISTINCT document FROM first_run WHERE document % 17 = 0",
    "requeue_batches": """SELECT b.id, CASE WHEN r.batch_id IS NOT NULL AND state IN ('stopped', 'completed', 'draft') THEN 'queued' ELSE state END AS state,
            CASE WHEN r.batch_id IS NOT NULL AND state IN ('stopped', 'completed', 'draft') THEN (SELECT max(queue_position) + 1
            FROM batches WHERE state IN ('queued', 'running')) ELSE queue_position END AS queue_position
        FROM batches AS b LEFT JOIN (SELECT DISTINCT batch_id FROM docs WHERE overall_state = 'failed') AS r ON b.id = r.batch_id""",
    "mark_overall": """SELECT id, CASE WHEN why IS NOT NULL THEN 'needs_review' ELSE overall_state END AS overall_state, coalesce(nullif(why, ''), 'before') AS failure_reason
        FROM docs LEFT JOIN (SELECT document_pk, arg_max(technical, (created_at, id)) AS why FROM failures WHERE stage = 'ocr' GROUP BY document_pk) AS f ON id = document_pk""",
    "stage_bars": " UNION ALL ".join(f"SELECT b.id AS batch_id, '{s}' AS stage, coalesce({s}_done, 0) AS done, coalesce({s}_failed, 0) AS failed, CASE WHEN total > 0 THEN 100.0E0 * ({s}_done + {s}_failed) / total ELSE 0.0E0 END AS percent FROM batches AS b LEFT JOIN {_PROGRESS} AS p ON b.id = p.batch_id" for s in ("ocr",
        "extract", "translate", "validate")),
    "corrupted_report": f"""SELECT document_id AS document, coalesce(b.name, '') AS batch, concat('/in/', document_id, '.pdf') AS source_filename, validation_status AS pdf_status, '' AS reason, CAST(ocr_attempts AS VARCHAR) AS pages, '1, 3' AS corrupted_pages, validation_status AS error_code, 'no' AS retryable, '1' AS validator, strftime(d.created_at, '%Y-%m-%d %H:%M') AS checked_at
        FROM docs AS d LEFT JOIN batches AS b ON d.batch_id = b.id WHERE validation_status IN {_CORRUPT}""",
    "scheduler_choice": "SELECT id, state, true AS started FROM batches WHERE state = 'queued' ORDER BY queue_position, id LIMIT 1",
    "batch_detail": f"""SELECT d.deed, coalesce(p.ordinal, 0) AS ordinal, coalesce(p.relation, '') AS relation, kind, coalesce(trim(string_split(name, '@')[1]), '') AS name
        FROM (SELECT deed, coalesce({textual.KIND_SQL('address')}, {textual.KIND_SQL('property_text')}, 'X') AS kind
            FROM deeds ORDER BY deed LIMIT 10) AS d LEFT JOIN (SELECT * FROM {_FIRST} AS c WHERE copy = 1 AND name <> '-') AS p ON d.deed = p.deed""",
    "document_texts": """SELECT doc_id, CAST(length(concat('===== PAGE 1 =====', chr(10), regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
            '[ \\t]+(\\n|$)', '\\1', 'g'), '(?i)</?[a-z][^<>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g'))) AS INTEGER) AS n_chars
            FROM documents""",
    "run_guards": """SELECT id, CASE WHEN state IN ('draft', 'stopped') THEN '' ELSE concat('A batch that is ', state, ' can''t be started.') END AS message,
            CASE WHEN state IN ('queued', 'running') THEN '' ELSE concat('A batch that is ', state, ' can''t be stopped.') END AS stop_message
            FROM batches""",
    "failure_history": """SELECT document_pk, md5(string_agg(concat(strftime(created_at, '%Y-%m-%d %H:%M'),
            '  ', stage, ' #', CAST(attempt AS VARCHAR), ': ', CASE WHEN trim(technical) = '' THEN 'no detail' ELSE technical END),
            chr(10) ORDER BY created_at, id)) AS digest, count(*) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY document_pk, stage ORDER BY created_at, id) AS attempt FROM failures) AS f GROUP BY document_pk""",
    "append_failures": f"""SELECT id, document_pk, stage, x.code, retryable, row_number() OVER (PARTITION BY document_pk, stage
            ORDER BY created_at, id) AS attempt FROM (SELECT *, {textual.CODE_SQL} AS code FROM failures) AS x
            JOIN (VALUES {textual.CODES_SQL}) AS c(code, code_stage, message, retryable) ON x.code = c.code""",
    "seconds_per_document": "SELECT round(avg(h), 4) AS seconds FROM (SELECT CAST(round(value * 100) AS BIGINT) AS h FROM docs ORDER BY created_at DESC, id DESC LIMIT 50) AS l",
    "export_names": "SELECT id, concat(regexp_replace(concat(name, ' / ಮನೆ (1)'), '[^\\p{L}\\p{N}_-]', '_', 'g'), '_failed_20250304_0506.csv') AS file FROM batches",
    "recovery": """SELECT 'document' AS kind, id, concat(CASE WHEN lost THEN 'failed' WHEN ocr_state = 'running' THEN 'pending' ELSE ocr_state END, '/', CASE extract_state WHEN 'running' THEN 'pending' ELSE extract_state END, '/',
            CASE WHEN lost THEN 'failed' ELSE overall_state END, '/', CASE WHEN lost THEN 'ocr gave up after 3 attempts' ELSE '' END) AS state
        FROM (SELECT *, overall_state = 'processing' AND ocr_state = 'pending' AND ocr_attempts = 3 AS lost
            FROM docs) AS d UNION ALL SELECT 'batch', id, CASE state WHEN 'stopping' THEN 'stopped' ELSE state END
            FROM batches""",
    "request_run": "SELECT id, CASE WHEN state IN ('draft', 'stopped') THEN 'queued' ELSE state END AS state, state NOT IN ('draft', 'stopped') AS refused FROM batches",
    "set_states": """SELECT id, CASE state WHEN 'queued' THEN 'running' WHEN 'stopping' THEN 'stopped' ELSE state END AS state,
            CASE WHEN id % 2 = 0 THEN '2024-01-01' WHEN state = 'queued' THEN '2024-02-01' END AS started, CASE state WHEN 'completed' THEN '2024-01-02' WHEN 'stopping' THEN '2024-02-01' END AS finished
            FROM batches""",
    "record_verdicts": "SELECT id, CASE WHEN validation_status = 'VALID' AND overall_state = 'failed' THEN 'PROCESSING_ERROR' ELSE validation_status END AS validation_status, CASE WHEN ocr_attempts = 0 AND validation_status IS NOT NULL THEN 7 ELSE ocr_attempts END AS page_count FROM docs",
    "translate_outcomes": "SELECT deed, CASE WHEN max(CASE WHEN person % 4 IN (0, 1) THEN 1 ELSE 0 END) = 1 THEN 'done' ELSE 'skipped' END AS outcome FROM names GROUP BY deed",
    "text_gates": """SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'OCR produced no text' WHEN length(trim(text)) < 40 * (doc_id % 40 + 1) THEN concat('only ', CAST(length(trim(text)) AS VARCHAR),
            ' characters across ', CAST(doc_id % 40 + 1 AS VARCHAR), ' pages: no usable text layer') END AS reason
            FROM documents""",
    "translation_tally": """SELECT language, 'script' AS reason, count(*) AS items, count(DISTINCT text) AS texts, count(DISTINCT
            CASE WHEN language = 'kan_Knda' AND (SELECT count(*) FROM names WHERE person % 4 = 0) > 0 THEN text END) AS hits, count(DISTINCT text) - count(DISTINCT
            CASE WHEN language = 'kan_Knda' AND (SELECT count(*) FROM names WHERE person % 4 = 0) > 0 THEN text END) AS misses
        FROM (SELECT text, CASE id % 8 WHEN 0 THEN 'kan_Knda' WHEN 1 THEN 'hin_Deva' WHEN 2 THEN 'tam_Taml' WHEN 3 THEN 'tel_Telu' WHEN 4 THEN 'ben_Beng' WHEN 5 THEN 'mar_Deva' END AS language
            FROM phrases) AS l WHERE language IS NOT NULL GROUP BY language""",
    "untranslated_items": "SELECT id FROM phrases WHERE id % 8 < 6 AND id % 3 <> 0",
    "assigned_answers": "SELECT id, CASE id % 3 WHEN 1 THEN concat('EN ', CAST(id AS VARCHAR)) WHEN 2 THEN ' ' END AS translated, CASE WHEN id % 3 <> 1 THEN 'the answer is empty' END AS error FROM phrases",
    "probe_results": """SELECT id, CASE WHEN total_bytes <= 0 THEN 'down' WHEN state = 'running' AND user_key > 5 THEN 'up' WHEN state IN ('running', 'queued') THEN 'degraded' WHEN user_key > 20 THEN 'down' ELSE 'loading' END AS availability
            FROM batches""",
    "pressure_reasons": """SELECT p_partkey, CASE WHEN p_size < 10 THEN concat('Not enough free memory: ', CAST(p_size AS VARCHAR),
            '.0 GB of 100.0 GB.') WHEN p_partkey % 7 < 2 THEN concat('Graphics memory is full: ', CAST(p_partkey % 7 AS VARCHAR),
            '.0 GB of 16.0 GB free.')
        WHEN p_partkey % 5 = 1 THEN 'Only 1.0 GB of disk space is free.' ELSE concat('The server isn''t accepting work (',
            CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'pressure' END, ').') END AS reason FROM part""",
    "retention_tally": """WITH b AS (SELECT batch_id, min(deed_date) AS first FROM deeds GROUP BY batch_id),
            g AS (SELECT batch_id FROM b WHERE first < DATE '1993-01-01'), old AS (SELECT deed FROM deeds
            WHERE deed_date < DATE '1998-05-02')
        SELECT 'pages' AS kind, count(*) AS n FROM old UNION ALL SELECT 'logs', count(*) FROM failures
            WHERE created_at < TIMESTAMP '1998-05-02' UNION ALL SELECT 'batches', count(*) FROM g UNION ALL
            SELECT 'documents', count(*) FROM deeds WHERE batch_id IN (SELECT batch_id FROM g)
        UNION ALL SELECT 'batches kept', count(*) FROM b WHERE batch_id NOT IN (SELECT batch_id FROM g)
            UNION ALL SELECT 'documents kept', count(*) FROM deeds WHERE batch_id NOT IN (SELECT batch_id
            FROM g)
        UNION ALL SELECT 'pages kept', count(*) FROM deeds WHERE batch_id NOT IN (SELECT batch_id FROM g) AND deed_date >= DATE '1998-05-02'""",
    "overlays": """SELECT s.doc_id, text, n AS n_pages FROM (SELECT doc_id, text, count(DISTINCT page) AS n
            FROM (SELECT l_orderkey % 1000 AS doc_id, l_linenumber AS page, concat('For Government Purpose ', l_linestatus) AS text
            FROM lineitem
        UNION ALL SELECT l_orderkey % 1000, l_linenumber, 'ordinary wording R' FROM lineitem WHERE l_returnflag = 'R') AS t GROUP BY doc_id, text) AS s
        JOIN (SELECT l_orderkey % 1000 AS doc_id, count(DISTINCT l_linenumber) AS pages FROM lineitem
            GROUP BY l_orderkey % 1000) AS p ON s.doc_id = p.doc_id WHERE n >= greatest(2, floor(pages * 0.6E0))""",
    "findings": """SELECT l_orderkey % 500 AS doc_id, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS confirmed, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS removable,
        coalesce(array_to_string(list_sort(list_distinct(list(l_linenumber) FILTER (WHERE l_returnflag = 'R'))), ','), '') AS scanned_pages FROM lineitem GROUP BY l_orderkey % 500""",
    "card_profiles": """WITH c AS (SELECT p_partkey AS id, floor(CAST(p_size AS BIGINT) * 268435456 * 0.92E0) * 0.95E0 AS budget
            FROM part), r AS (SELECT * FROM (VALUES (1, 24576), (2, 20480), (3, 16384)) AS a(i, context),
            (VALUES (1, 'f16', 2.0E0), (2, 'q8_0', 1.09E0)) AS b(j, cache, element), (VALUES (1, 'BF16', 16.0E0),
            (2, 'Q8_0', 8.5E0), (3, 'Q6_K', 6.6E0), (4, 'Q5_K_M', 5.8E0), (5, 'Q4_K_M', 5.1E0)) AS d(k, weights, bits)),
        n AS (SELECT i, j, k, context, cache, weights, s, floor((5 * context * s + 29 * least(context * s, 1024)) * 2 * 4 * 256 * element) + floor(3900000000 * bits / 8) + 734003200 + (s - 1) * 67108864 AS need
            FROM r, (VALUES (1), (2), (3), (4)) AS q(s)),
        f AS (SELECT c.id, i, j, k, context, cache, weights, max(s) AS slots, min(s) AS one FROM c JOIN n ON need <= budget GROUP BY c.id, i, j, k, context, cache, weights HAVING min(s) = 1),
        g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, j, k) AS place FROM f) SELECT c.id, context, cache, weights, slots FROM c LEFT JOIN g ON c.id = g.id AND place = 1""",
    "card_batches": """SELECT p_partkey, CASE WHEN p_size >= 40 THEN 32 WHEN p_size >= 24 THEN 16 ELSE 4 END AS detector,
            CASE WHEN p_size >= 40 THEN 256 WHEN p_size >= 24 THEN 64 ELSE 16 END AS recognition, CAST(greatest(0, least(34, floor((CAST(p_size AS BIGINT) * 268435456 - 1000000000) / 150000000.0E0))) AS INTEGER) AS layers
            FROM part""",
    "free_memory": """SELECT p_partkey, round(least(1.0E0, (p_size / 2.0E0 + p_partkey % 30) / 50.0E0),
            6) AS share, p_size >= 10 OR least(1.0E0, (p_size / 2.0E0 + p_partkey % 30) / 50.0E0) >= 0.08E0 AS admits
            FROM part""",
    "line_boxes": "SELECT l_orderkey, l_linenumber, round(l_quantity / 700.0E0, 5) AS x0, round(l_quantity * 2 / 700.0E0, 5) AS x1, CAST(l_linenumber AS DOUBLE) AS y0, round(l_linenumber * 1.5E0, 5) AS y1, l_partkey, l_suppkey, l_extendedprice FROM lineitem",
    "retryable_verdicts": f"SELECT id, coalesce(validation_status IN {_CORRUPT}, false) AS corrupt, coalesce(validation_status NOT IN {_CORRUPT}, true) AS retryable FROM docs",
    "tool_failures": f"SELECT id, CASE WHEN id % 5 = 0 THEN 'OCR_TIMEOUT' ELSE {textual.CODE_SQL_NO_STAGE} END AS code, stage FROM failures",
}

_NAME = re.compile(r"\b(" + "|".join([*VIEWS, *INPUTS]) + r")\b")


def duck_query(sql: str) -> str:
    """The SQL with the views it reads as common table expressions."""
    named = set(_NAME.findall(sql))
    with_ = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in named)
    if sql.startswith("WITH ") and with_:
        return f"WITH {with_}, {sql.removeprefix('WITH ')}"
    return (f"WITH {with_} " if with_ else "") + sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: duck_query(sql) for name, sql in SQL.items()}
