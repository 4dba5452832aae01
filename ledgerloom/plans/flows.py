"""Queries of what changes tables, goes in rounds, or reads nested and placed input, with SQL of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import classify, cleanup, grounding, identity, language, nested, values, watermark
from ledgerloom.operators import batches, claims, documents, layout, rewrites, translation
from ledgerloom.plans import export
from ledgerloom.plans.adapters import VIEWS
from ledgerloom.session import Scratch, table
from ledgerloom.sources import files, sinks
from ledgerloom.sources.versions import Conflict, VersionedTable
from ledgerloom.streaming import stages


def _view(spark: SparkSession, sf_dir: str, name: str, *sources: str) -> DataFrame:
    for t in sources:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def _documents(spark: SparkSession, sf_dir: str, scratch: Scratch) -> VersionedTable:
    """The documents of batches as a versioned table, none claimed."""
    docs = _view(spark, sf_dir, "docs", "events").withColumns({c: F.lit(None).cast("string") for c in ("failure_reason", "claimed_by")})
    return VersionedTable.create(spark, scratch.path("documents"), docs, ["batch_id"], 8)


def concurrent_claims(spark, sf_dir):
    """Two workers claim on the same version: one is refused, and claims again on what the other left."""
    held = _documents(spark, sf_dir, Scratch(spark, "claims"))
    base = held.version()
    first, second = (claims.take(held.read(base), w, "ocr") for w in "ab")
    held.commit(base, first)
    try:
        held.commit(base, second)
        refused = False
    except Conflict:
        refused = True
        claims.claim(held, "b", "ocr")
    return held.read().filter("claimed_by IS NOT NULL").select("batch_id", "id", "claimed_by", "ocr_state", "ocr_attempts", F.lit(refused).alias("refused"))


def settled_claims(spark, sf_dir):
    """A worker's claims of OCR settled: documents whose value has a fraction below a half are read, others fail; a second worker's are given back."""
    held = _documents(spark, sf_dir, Scratch(spark, "settled"))
    claims.claim(held, "a", "ocr")
    claims.claim(held, "b", "ocr")
    told = held.read().filter("claimed_by = 'a'").select("id", F.when(F.col("value") % 1 < 0.5, "done").otherwise("failed").alias("state"), F.lit("unreadable").alias("reason"))
    claims.settle(held, "a", "ocr", told)
    claims.release(held, "b")
    return held.read().groupBy("batch_id", "ocr_state").agg(F.count("*").alias("n"), F.sum("ocr_attempts").alias("attempts"),
        F.count("claimed_by").alias("claimed"), F.count_if(F.col("failure_reason") == "unreadable").alias("unreadable"))


def cached_translations(spark, sf_dir):
    """Names of parts into Hindi by a runner that answers some, in a second run over what the first has stored."""
    scratch = Scratch(spark, "cached")
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    known = translation.cache(spark, scratch.path("cache"), 8)
    runner = lambda asked: asked.filter("length(text) % 5 <> 0").select("id", F.upper("text").alias("text"))
    translation.translate(items, known, runner, Scratch(spark, "first"), "hin_Deva")
    return translation.translate(items, known, runner, Scratch(spark, "second"), "hin_Deva").select("id", "translated", "from_cache", "attempts", "error")


def answers_in_rounds(spark, sf_dir):
    """Addresses of customers asked in three rounds; a longer one needs more of them."""
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.lit("eng_Latn").alias("language"), "c_mktsegment")
    rounds = []

    def runner(asked: DataFrame) -> DataFrame:
        rounds.append(1)
        return asked.select("id", F.when(F.expr("length(text) + ascii(right(text, 1))") % 4 < len(rounds), F.reverse("text")).otherwise(" ").alias("text"))

    return translation.ask(items, runner, Scratch(spark, "rounds"), 3).select("id", "translated", "attempts", "error")


def repaired_names(spark, sf_dir):
    """Parties without a translated name get one; first of their side have one already."""
    people = _view(spark, sf_dir, "parties", "orders", "lineitem").select(F.col("deed").alias("document_id"), "relation",
        F.col("ordinal").cast("int").alias("ordinal"), "name", F.when(F.col("ordinal") == 1, "had").alias("name_translated"))
    docs = _view(spark, sf_dir, "deeds", "orders", "lineitem").select(F.col("deed").alias("id"), "batch_id")
    scratch = Scratch(spark, "repair")
    runner = lambda asked: asked.filter("text NOT LIKE '%1%'").select("id", F.lower("text").alias("text"))
    fixed = translation.repair(docs, people, translation.cache(spark, scratch.path("cache"), 8), runner, scratch, target="hin_Deva")
    return fixed.select(F.col("document_id").alias("deed"), "relation", "ordinal", "name_translated", "written")


def document_stages(spark, sf_dir):
    """The events of each user as answers to the attempts at one document, as a stream."""
    scratch = Scratch(spark, "stages")
    kept = scratch.keep("events", table(spark, sf_dir, "events"))
    events = spark.readStream.schema(kept.schema).parquet(scratch.path("events"))
    answers = events.select(F.col("user_id").alias("document"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("ok"), (F.col("value") < 50).alias("retryable"))
    return stages.run(spark, answers, scratch.path("run"), idle_ms=86_400_000).drop("seen_at")


def page_texts(spark, sf_dir):
    """Lines of documents in pieces of four words, placed on a page, set again as text with columns."""
    words = F.expr(r"regexp_extract_all(line, r'[^\x20\x09-\x0D]+', 0)")
    # pieces carry their line's length, not the line; a line without a word has one empty piece
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", F.length("line").alias("n"), words.alias("w"))
    pieces = lines.select("doc_id", "i", "n", F.posexplode(F.expr("transform(sequence(0, (size(w) - 1) div 4), k -> array_join(slice(w, k * 4 + 1, 4), ' '))")).alias("j", "text")).filter("text <> ''")
    top = F.col("i") * 20 + (F.col("n") + F.col("j")) % 3
    boxes = pieces.select("doc_id", F.lit(1200).alias("page_width"), (F.col("j") * 300).alias("x0"), top.alias("y0"), (F.col("j") * 300 + 200).alias("x1"), (top + 12).alias("y1"), "text")
    return layout.pages(boxes, ["doc_id"]).select("doc_id", F.md5("text").alias("digest"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_rows"))


def flattened_answers(spark, sf_dir):
    """Orders as nested answers, flattened without a list of their fields."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"),
        F.struct(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("mode")).alias("part")))).alias("items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    answer = F.to_json(F.struct(F.col("o_orderkey").alias("deed"),
        F.struct(F.col("o_orderstatus").alias("name"), F.lit(None).cast("string").alias("open")).alias("office"), "items"),
        {"ignoreNullFields": "false"})
    return nested.flatten(orders.select("o_orderkey", answer.alias("answer")), ["o_orderkey"], F.col("answer"))


def recognised_answers(spark, sf_dir):
    """Documents as a recognition engine would answer them, some cut off, read back with the reason why one is of no use."""
    word = F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0)
    line = lambda x, text: F.array(F.lit(x), F.lit("0.25"), F.lit("1"), F.lit("0.5"), text)
    whole = F.concat(F.lit("loading model\n"), F.to_json(F.struct("text", F.array(line("0.125", word), line("1.5", word), line("0", F.lit(" "))).alias("lines"))))
    raw = F.when(F.length("text") % 7 == 0, F.left(whole, F.length(whole) - 2)).otherwise(whole)
    told = files.recognised(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), F.col("raw"), F.lit(1))
    return told.select("doc_id", "reason", F.length("text").alias("n_chars"), "bad_lines", F.get("lines", 0)["text"].alias("first"))


def csv_lines(spark, sf_dir):
    """Pages as lines of a CSV file."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(sinks.csv_line(F.col("page_id"), F.col("url"), F.col("html"), F.lit(None))).alias("digest"))


def detected(spark, sf_dir):
    """The language of documents' beginnings whose vowels stand in Kannada."""
    t = F.translate(F.left(F.coalesce("text", F.lit("")), F.lit(200)), "aeiou", "ಅಎಇಒಉ")
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), language.detect(t).alias("d"))
    return d.select("doc_id", "d.language", "d.script", F.round("d.confidence", 6).alias("confidence"),
        F.round(F.try_element_at("d.shares", F.lit("kannada")), 6).alias("kannada"), "d.reason",
        language.wants(F.col("t"), "kan_Knda").alias("wanted"))


#: Letters of both scripts, and the names of the Latin ones in Kannada.
SOUNDS, DEVANAGARI, KANNADA = "kgmnrlvsiua", "कगमनरलवसिु", "ಕಗಮನರಲವಸಿು"
LETTERS = {"k": "ಕೆ", "g": "ಜಿ", "m": "ಎಂ", "n": "ಎನ್", "r": "ಆರ್", "l": "ಎಲ್", "v": "ವಿ", "s": "ಎಸ್"}


def names_from_text(spark, sf_dir):
    """Syllables of documents written in two scripts, with an initial in one of them, back in Latin letters."""
    parts = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[kgmnrlvs][aiu]"), F.lit(0)), 1, 4)
    d = table(spark, sf_dir, "documents").withColumn("w", F.array_join(parts, "")).filter("length(w) >= 4")
    initial = F.element_at(F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair]), F.left("w", F.lit(1)))
    return d.select("doc_id", language.transliterate(F.translate("w", SOUNDS, DEVANAGARI)).alias("devanagari"),
        language.transliterate(F.concat(initial, F.lit("."), F.translate("w", SOUNDS, KANNADA))).alias("kannada"))


def tidied_names(spark, sf_dir):
    """Names of parts as a translator frames them, and as a cell shows them."""
    p, n = table(spark, sf_dir, "part"), F.length("p_name") % 4
    framed = F.when(n == 0, F.concat(F.lit("What is "), "p_name", F.lit("?"))).when(n == 1,
        F.concat(F.lit("It is located at  "), "p_name", F.lit("."))).when(n == 2,
        F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "   "), F.lit("!"))).otherwise(F.concat(F.lit("THE "),
        F.regexp_replace("p_name", " .*", "")))
    return p.select("p_partkey", language.tidy(framed).alias("shown"))


def detected_languages(spark, sf_dir):
    """How many documents' beginnings are in which language, their vowels in Kannada."""
    return detected(spark, sf_dir).filter("script <> 'neutral'").groupBy("language").agg(F.count("*").alias("n"))


def normalised_texts(spark, sf_dir):
    """Documents with letters taken apart and invisible signs between words, in their usual form."""
    t = F.regexp_replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), " ", "\u200b \ufeff\t")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(language.normalised(t)).alias("digest"))


def human_values(spark, sf_dir):
    """Order totals as bytes and seconds, dates as a local time, and statuses as badges, as a page shows them."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    state = F.element_at(F.array(*map(F.lit, ("completed", "stopping", "needs_review", "failed", "draft"))), (F.length("o_orderpriority") % 5 + 1).cast("int"))
    return o.select("o_orderkey", values.human_bytes(cents * (F.col("o_custkey") % 3) * F.col("o_custkey")).alias("size"),
        values.human_duration(cents % 100_000 - 50).alias("took"), values.whole_percent(cents % 200, F.lit(200)).alias("percent"),
        values.local_time(F.col("o_orderdate").cast("timestamp")).alias("at"), values.badge(state).alias("badge"))


def cleanup_figures(spark, sf_dir):
    """What the clean-up of line ends would have to do to documents with other line ends, and how they would be told."""
    before = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\n"))
    told = table(spark, sf_dir, "documents").select("doc_id", cleanup.report(before, cleanup.page_markers(cleanup.line_ends(before))).alias("r"))
    return told.select("doc_id", *[F.col(f"r.{c}").cast("long").alias(c) for c in ("chars_before", "chars_after", "lines_before",
        "lines_after", "line_ends", "tags", "pages", "markers_inserted")],
        cleanup.summary(F.col("r")).startswith(F.format_string("%,d -> %,d chars (", "r.chars_before", "r.chars_after")).alias("told"))


def schedules(spark, sf_dir):
    """Documents with references to a schedule around the schedule itself."""
    t = F.concat(F.lit("Schedule one "), F.coalesce("text", F.lit("")), F.lit("\nSCHEDULE: "),
        F.right(F.coalesce("text", F.lit("")), F.lit(2500)), F.lit(" of the schedule "), F.left(F.coalesce("text", F.lit("")), F.lit(40)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(classify.schedule_section(t)).alias("digest"))


def excel_identifiers(spark, sf_dir):
    """Identifiers of parties as cells that a spreadsheet leaves alone."""
    return _view(spark, sf_dir, "parties", "orders", "lineitem").select("deed", "relation", "ordinal",
        values.identifier(F.col("aadhaar"), True).alias("aadhaar"), values.identifier(F.concat(F.lit("="), "pan")).alias("pan"))


def first_objects(spark, sf_dir):
    """The first object of answers around documents' first words: among braces that open nothing, before others, or broken."""
    word = F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0)
    n = F.length("text") % 4
    whole = F.to_json(F.struct(F.length("text").alias("n"), word.alias("word"), F.array(F.struct(word.alias("again"))).alias("list")))
    answer = F.when(n == 0, whole).when(n == 1, F.concat(F.lit("Here { it is: ```json"), whole, F.lit("``` {\"n\": 1}"))).when(n == 2,
        F.concat(whole, F.lit("} {"))).otherwise(F.left(whole, F.length(whole) - 1))
    found = F.try_parse_json(grounding.first_json(answer))
    get = lambda path, kind: F.try_variant_get(found, path, kind)
    return table(spark, sf_dir, "documents").select("doc_id", get("$.n", "long").alias("n"), get("$.word", "string").alias("word"),
        F.coalesce(get("$.list[0].again", "string"), get("$.again", "string")).alias("again"))


def stamped_orders(spark, sf_dir):
    """Texts that repeat over an order's lines as stamps do: some say so, some are set at an angle, faint or large."""
    i = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linestatus") == "O", "Certified TRUE Copy").otherwise(F.concat(F.lit("Registrar's hall "), "l_returnflag"))
    spans = i.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), text.alias("text"), F.lit(1.0).alias("dx"),
        F.when(F.col("l_discount") > 0.08, 0.2).otherwise(0.0).alias("dy"), F.when(F.col("l_quantity") > 45, 0xAAAAAA).otherwise(0).alias("colour"),
        F.when(F.col("l_tax") > 0.07, 20.0).otherwise(10.0).alias("size"))
    pages = i.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.countDistinct("l_linenumber").alias("page_count"))
    return watermark.overlays(spans, pages).select("doc_id", "text", F.col("n_pages").cast("long").alias("n_pages"), F.array_join("pages", ",").alias("pages"))


def upload_lists(spark, sf_dir):
    """The first files of a selection of parts, as the upload page lists them."""
    files_of = table(spark, sf_dir, "part").select(F.concat(F.lit("/in/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".v1.PDF")).alias("path"), (F.col("p_size") * 1000).alias("bytes"))
    return batches.upload_page(files_of)[1]


def upload_summaries(spark, sf_dir):
    files_of = table(spark, sf_dir, "part").select(F.concat(F.lit("/in/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") * 1_000_000).cast("bigint").alias("bytes"))
    told = batches.upload_page(files_of, 4)[0]
    return told.select("files", "bytes", "too_many", "too_large", F.size("messages").cast("long").alias("n_messages"), "size",
        F.col("shown").cast("long").alias("shown"), "truncated", "can_submit", "next_position")


def processing_pages(spark, sf_dir):
    """How far each batch is, as the processing page reads."""
    docs = _view(spark, sf_dir, "docs", "events")
    return batches.processing_page(batches.progress(docs, docs.select(F.col("batch_id").alias("id")).distinct()))


def saved_rules(spark, sf_dir):
    """Settings after rules named as nations and thresholds named as regions are saved over stored ones."""
    n = table(spark, sf_dir, "nation")
    stored = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("rule_"), "n_name")).otherwise(F.col("n_name")).alias("key"), F.lit("old").alias("value"))
    rules = n.select(F.col("n_name").alias("key"), (F.length("n_name") > 6).alias("enabled"))
    return files.save_rules(stored, rules, table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.length("r_name").alias("value")))


def chosen_files(spark, sf_dir):
    """Pages taken for files: with a version at the front or not, cut off or whole."""
    p = table(spark, sf_dir, "pages")
    n = F.length("html") % 5
    content = F.encode(F.concat(F.when(n == 0, "%PDF-x.4 ").when(n == 1, F.repeat(F.lit(" "), F.lit(2000))).otherwise("junk "),
        F.lit("%PDF-1.7\n"), F.coalesce("html", F.lit("")), F.when(n == 2, F.repeat(F.lit("x"), F.lit(5000))).otherwise(""),
        F.when(n == 3, "%%EO").otherwise("%%EOF"), F.when(n == 4, F.repeat(F.lit(" "), F.lit(4100))).otherwise("")), "UTF-8")
    return p.filter("html IS NOT NULL").select("page_id", files.verdict(content).alias("verdict"))


def failed_rows(spark, sf_dir):
    """The export of failed documents: every failure with its seven cells."""
    f = _view(spark, sf_dir, "failures", "events")
    rows = f.select(F.when(F.col("document_pk") % 3 == 0, F.concat(F.lit("=ABC-"), "document_pk")).alias("identity"),
        F.concat(F.lit("  d "), "document_pk", F.lit(".pdf ")).alias("source"), "stage", F.lit("FAILED").alias("status"),
        F.col("technical").alias("reason"), F.col("validation_status").alias("flags"),
        (F.col("attempt") / 3).alias("confidence") if "attempt" in f.columns else (F.col("id") % 4 / 3).alias("confidence"))
    told = export.failed_report(rows)
    return told.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(told.columns)])


def csv_read_back(spark, sf_dir):
    """Pages written as one ordered CSV file and read again."""
    path = Scratch(spark, "csv").path("pages.csv")
    sinks.write_csv(table(spark, sf_dir, "pages"), ("page_id", "url", "html"), path, [F.desc("url"), F.col("page_id")])
    back = files.read_csv(spark, path, "page_id long, url string, html string")
    return back.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))


def texts_read_back(spark, sf_dir):
    """Documents written as a text file each in their source's folder, and read again."""
    path = Scratch(spark, "texts").path("out")
    docs = table(spark, sf_dir, "documents")
    sinks.write_texts(docs.select(F.coalesce("source", F.lit("none")).alias("folder"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), "text"), path)
    back = files.files_in_folders(spark, path)
    return back.select("folder", F.regexp_extract("name", r"^doc (\d+)\.txt$", 1).cast("long").alias("doc_id"), F.md5("content").alias("digest"))


def replaced_children(spark, sf_dir):
    """Parties of every third deed replaced by their buyers in other words."""
    people = _view(spark, sf_dir, "parties", "orders", "lineitem").select("deed", "relation", "ordinal", "name")
    new = people.filter("deed % 3 = 0 AND relation = 'B'").withColumn("name", F.lower("name"))
    return rewrites.replace_children(people, new, "deed")


def upserted_attempts(spark, sf_dir):
    """Answers by document and attempt: a later event of the same user and kind takes the place of an earlier one."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.ascii("event_type").alias("attempt"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), "value")
    old, new = e.filter("id % 2 = 0"), e.filter("id % 2 = 1")
    first = documents.upsert_attempts(e.limit(0), old)
    return documents.upsert_attempts(first, new).select("document_id", "attempt", "id", "value")


def small_values(spark, sf_dir):
    """Numbers, serials, names and places of pages as single cells, from customers' names."""
    c = table(spark, sf_dir, "customer")
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    stem = F.concat(F.lit("ABC-1-"), F.lpad(key, 5, "0"), F.lit("-2024-25"))
    text = F.concat(F.lit("== PAGE 1 ==\n"), F.repeat(F.lit("x"), F.col("c_nationkey") * 3), F.lit("\n== PAGE 2 ==\n"), name)
    return c.select(
        "c_custkey", values.exact_digits(name, 9).alias("nine"), values.exact_digits(name, 8).alias("eight"),
            values.pan_or_null(F.concat(F.lit(" "), F.left(F.regexp_replace(name, "[^a-zA-Z]", ""), F.lit(5)), F.right(name, F.lit(4)),
            F.left("c_mktsegment", F.lit(1)))).alias("pan"),
        values.filled(F.when(F.col("c_nationkey") % 2 == 0, F.upper("c_name")), name).alias("shown"), rewrites.expected_serial(stem).alias("serial"), identity.page_of(text, F.lit(40)).alias("page"),
        language.title_case(F.lower(F.concat("c_mktsegment", F.lit(" of the "), F.col("c_mktsegment")))).alias("title"),
            cleanup.padding(F.concat("c_mktsegment", F.repeat(F.lit(" "), F.col("c_nationkey")), F.lit("|"))).alias("padded"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        concurrent_claims, settled_claims, cached_translations, answers_in_rounds, repaired_names, document_stages, page_texts,
            flattened_answers, recognised_answers, csv_lines, detected, names_from_text, tidied_names, detected_languages,
        normalised_texts, human_values, cleanup_figures, schedules, excel_identifiers, first_objects, stamped_orders, upload_lists, upload_summaries, processing_pages, saved_rules, chosen_files,
        failed_rows, csv_read_back, texts_read_back, replaced_children, upserted_attempts, small_values,
    )
}

_READY = "overall_state = 'processing' AND ocr_state = 'pending'"
_PLACED = f"WITH documents_of AS ({VIEWS['docs']}), ready AS (SELECT id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS k FROM documents_of WHERE {_READY})"
_WORDS = r"regexp_extract_all(line, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "concurrent_claims": _PLACED + """ SELECT d.batch_id, d.id, CASE k WHEN 1 THEN 'a' ELSE 'b' END AS claimed_by, 'running' AS ocr_state, ocr_attempts + 1 AS ocr_attempts, true AS refused
            FROM documents_of AS d JOIN ready AS r ON d.id = r.id WHERE k <= 2""",
    "settled_claims": _PLACED + """, done AS (SELECT d.batch_id, CASE WHEN k = 1 AND value % 1 < 0.5E0 THEN 'done' WHEN k = 1 THEN 'failed' ELSE ocr_state END AS ocr_state, ocr_attempts +
            CASE WHEN k = 1 THEN 1 ELSE 0 END AS tried, k = 1 AND value % 1 >= 0.5E0 AS lost FROM documents_of AS d
            LEFT JOIN ready AS r ON d.id = r.id)
        SELECT batch_id, ocr_state, count(*) AS n, CAST(sum(tried) AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS claimed, count(*) FILTER (WHERE lost) AS unreadable
            FROM done GROUP BY batch_id, ocr_state""",
    "cached_translations": "SELECT p_partkey AS id, CASE WHEN fine THEN upper(p_name) END AS translated, fine AS from_cache, CAST(CASE WHEN fine THEN 0 ELSE 2 END AS INTEGER) AS attempts, CASE WHEN NOT fine THEN 'the model returned nothing' END AS error FROM (SELECT *, length(p_name) % 5 <> 0 AS fine FROM part)",
    "answers_in_rounds": "SELECT c_custkey AS id, CASE WHEN k < 3 THEN reverse(c_name) END AS translated, CAST(least(k + 1, 3) AS INTEGER) AS attempts, CASE WHEN k = 3 THEN 'the model returned nothing' END AS error FROM (SELECT *, (length(c_name) + ascii(right(c_name, 1))) % 4 AS k FROM customer)",
    "repaired_names": f"WITH parties AS ({VIEWS['parties']}) SELECT deed, relation, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN ordinal = 1 THEN 'had' WHEN name NOT LIKE '%1%' THEN lower(name) END AS name_translated, ordinal <> 1 AND name NOT LIKE '%1%' AS written FROM parties",
    "document_stages": """WITH RECURSIVE e AS (SELECT user_id AS document, ts, event_type <> 'error' AS ok, value < 50 AS again, row_number() OVER (PARTITION BY user_id
            ORDER BY ts, event_id) AS k, max(ts) OVER () AS last FROM events),
        m AS (SELECT document, CAST(0 AS BIGINT) AS k, 1 AS stage, 0 AS attempts, 'pending' AS status, ts AS seen, last FROM e WHERE k = 1
            UNION ALL SELECT m.document, e.k, CASE WHEN ok AND stage < 4 THEN stage + 1 ELSE stage END, CASE WHEN ok AND stage < 4 THEN 0 ELSE attempts + 1 END,
                CASE WHEN ok AND stage = 4 THEN 'processed' WHEN ok THEN 'pending' WHEN NOT again THEN 'lost' WHEN attempts + 1 > CASE stage WHEN 3 THEN 0 ELSE 1 END THEN 'failed' ELSE 'retry' END, e.ts, m.last
            FROM m JOIN e ON e.document = m.document AND e.k = m.k + 1 WHERE status IN ('pending', 'retry')),
        f AS (SELECT *, ['ocr', 'extract', 'validate', 'translate'][stage] AS name FROM m QUALIFY row_number() OVER (PARTITION BY document ORDER BY k DESC) = 1)
        SELECT document, name AS stage, CAST(CASE WHEN status IN ('pending', 'retry') AND seen + INTERVAL 1 DAY <= last THEN greatest(0, attempts - 1) ELSE attempts END AS INTEGER) AS attempts,
            CASE WHEN status IN ('pending', 'retry') AND seen + INTERVAL 1 DAY <= last THEN 'stalled' WHEN status = 'lost' THEN 'failed' ELSE status END AS status,
            CASE status WHEN 'lost' THEN concat(name, ' can''t succeed') WHEN 'failed' THEN concat(name, ' gave up after ', attempts, ' attempts') ELSE '' END AS reason FROM f""",
    "page_texts": f"""WITH l AS (SELECT doc_id, i, {_WORDS} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),
            1) AS i FROM documents) WHERE len({_WORDS}) > 0),
        r AS (SELECT doc_id, i, list_reduce(list_transform(range(0, (len(w) - 1) // 4 + 1), lambda k: array_to_string(w[k * 4 + 1:k * 4 + 4], ' ')),
            lambda acc, x, n: concat(CASE WHEN length(acc) < 30 * (n - 1) THEN rpad(acc, CAST(30 * (n - 1) AS INTEGER),
            ' ') ELSE acc END, x)) AS line FROM l)
        SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest, count(*) AS n_rows FROM r GROUP BY doc_id""",
    "flattened_answers": """WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1 AS k
            FROM lineitem), o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
        SELECT o_orderkey, 'deed' AS path, CAST(o_orderkey AS VARCHAR) AS value FROM o UNION ALL SELECT o_orderkey, 'office.name', o_orderstatus
            FROM o UNION ALL SELECT o_orderkey, 'office.open', '' FROM o
        UNION ALL SELECT l_orderkey, concat('items[', k, '].line'), CAST(l_linenumber AS VARCHAR) FROM i
            UNION ALL SELECT l_orderkey, concat('items[', k, '].part.key'), CAST(l_partkey AS VARCHAR)
            FROM i UNION ALL SELECT l_orderkey, concat('items[', k, '].part.mode'), l_returnflag FROM i""",
    "recognised_answers": r"""SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN 'no JSON object in the answer' WHEN text IS NULL THEN 'no text in the answer' WHEN length(trim(text)) = 0 THEN 'OCR produced no text'
        WHEN length(trim(text)) < 40 THEN concat('only ', length(trim(text)), ' characters across 1 pages: no usable text layer') END AS reason, CAST(CASE WHEN length(text) % 7 <> 0 THEN length(text) END AS INTEGER) AS n_chars,
        CAST(CASE WHEN coalesce(length(text) % 7 = 0, false) THEN 0 WHEN regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 ELSE 3 END AS INTEGER) AS bad_lines,
        CASE WHEN length(text) % 7 <> 0 THEN nullif(regexp_extract(text, '[^\x20\x09-\x0D]+'), '') END AS first FROM documents""",
    "csv_lines": """WITH c AS (SELECT page_id, list_transform([CAST(page_id AS VARCHAR), coalesce(url, ''),
            coalesce(html, ''), ''], lambda x: CASE WHEN regexp_matches(x, '[",\\r\\n]') THEN concat('"', replace(x, '"', '""'),
            '"') ELSE x END) AS cells FROM pages) SELECT page_id, md5(array_to_string(cells, ',')) AS digest
            FROM c""",
    "names_from_text": """WITH w AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[kgmnrlvs][aiu]')[1:4], '') AS w
            FROM documents), c AS (SELECT *, concat(upper(left(w, 1)), substr(w, 2)) AS c FROM w WHERE length(w) >= 4)
        SELECT doc_id, CASE WHEN right(c, 1) = 'a' THEN left(c, length(c) - 1) ELSE c END AS devanagari, concat(left(c, 1), '. ', c) AS kannada FROM c""",
    "tidied_names": """SELECT p_partkey, CASE WHEN length(p_name) % 4 = 3 THEN concat(upper(left(w, 1)),
            substr(w, 2)) ELSE concat(upper(left(p_name, 1)), substr(p_name, 2)) END AS shown FROM (SELECT *, regexp_replace(p_name, ' .*', '') AS w
            FROM part)""",
    "normalised_texts": r"""SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS digest FROM documents""",
    "human_values": """WITH v AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
            b AS (SELECT *, CAST(cents * (o_custkey % 3) * o_custkey AS DOUBLE) AS n, cents % 100000 - 50 AS s
            FROM v)
        SELECT o_orderkey, CASE WHEN n >= 1024.0E0 ** 4 THEN format('{:,.1f} TB', n / 1024.0E0 ** 4) WHEN n >= 1024.0E0 ** 3 THEN format('{:,.1f} GB', n / 1024.0E0 ** 3) WHEN n >= 1024 * 1024 THEN format('{:,.1f} MB', n / (1024 * 1024)) WHEN n >= 1024 THEN format('{:,.1f} KB', n / 1024) ELSE format('{:,.0f} B', n) END AS size,
            CASE WHEN s >= 3600 THEN format('{}h {:02d}m', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN format('{}m {:02d}s', s // 60, s % 60) WHEN s > 0 THEN format('{}s', s) ELSE '-' END AS took,
            CAST(round_even((cents % 200) / 2.0E0, 0) AS INTEGER) AS percent, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 330 MINUTE, '%d-%m-%Y %H:%M') AS at, ['ok', 'accent', 'review', 'danger', ''][length(o_orderpriority) % 5 + 1] AS badge
            FROM b""",
    "cleanup_figures": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, length(t) - length(replace(t, chr(10), '')) AS lf FROM t)
        SELECT doc_id, length(t) + lf AS chars_before, length(t) + 19 AS chars_after, CASE WHEN t = '' THEN 0 ELSE lf + 1 END AS lines_before, lf + 2 AS lines_after, lf AS line_ends, CAST(len(regexp_extract_all(replace(t, chr(10),
            concat(chr(13), chr(10))), '(?i)</?[a-z][^<>]*>')) AS BIGINT) AS tags, CAST(1 AS BIGINT) AS pages, CAST(1 AS BIGINT) AS markers_inserted, true AS told
            FROM n""",
    "schedules": "SELECT doc_id, md5(left(concat('SCHEDULE: ', right(t, 2500), ' of the schedule ', left(t, 40)), 2000)) AS digest FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "excel_identifiers": f"""WITH parties AS ({VIEWS['parties']}) SELECT deed, relation, ordinal, CASE WHEN aadhaar IS NULL THEN '' ELSE concat('="', aadhaar, '"') END AS aadhaar,
            CASE WHEN pan IS NULL THEN '' ELSE concat(chr(39), '=', pan) END AS pan FROM parties""",
    "first_objects": r"""SELECT doc_id, CASE WHEN length(text) % 4 < 3 THEN length(text) END AS n, CASE WHEN length(text) % 4 < 3 THEN word END AS word, word AS again
            FROM (SELECT *, regexp_extract(text, '[^\x20\x09-\x0D]+') AS word FROM documents)""",
    "stamped_orders": """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, CASE WHEN l_linestatus = 'O' THEN 'Certified TRUE Copy' ELSE concat('Registrar''s hall ', l_returnflag) END AS text, l_discount > 0.08 OR l_quantity > 45 OR l_tax > 0.07 AS odd
            FROM lineitem),
        g AS (SELECT doc_id, text, list_sort(list_distinct(list(page))) AS pages, bool_or(odd) AS odd
            FROM s GROUP BY doc_id, text), n AS (SELECT doc_id, count(DISTINCT page) AS n FROM s GROUP BY doc_id)
        SELECT g.doc_id, text, CAST(len(pages) AS BIGINT) AS n_pages, array_to_string(pages, ',') AS pages
            FROM g JOIN n ON g.doc_id = n.doc_id WHERE len(pages) >= greatest(2, floor(n * 0.6)) AND (text LIKE 'Cert%' OR odd)""",
    "upload_lists": """SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS place, concat(lpad(CAST(p_partkey AS VARCHAR),
            9, '0'), '.v1.PDF') AS name, concat(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), '.v1') AS document_id,
        CASE WHEN p_size * 1000 >= 1024 THEN format('{:,.1f} KB', p_size * 1000 / 1024.0E0) ELSE format('{:,.0f} B', p_size * 1000.0E0) END AS size FROM part QUALIFY place <= 200""",
    "upload_summaries": """WITH t AS (SELECT count(*) AS files, CAST(sum(p_size) AS BIGINT) * 1000000 AS bytes
            FROM part) SELECT files, bytes, files > 1000 AS too_many, bytes > 26843545600 AS too_large, CAST(CASE WHEN files > 1000 THEN 1 ELSE 0 END +
            CASE WHEN bytes > 26843545600 THEN 1 ELSE 0 END + 1 AS BIGINT) AS n_messages,
        CASE WHEN bytes >= 1024.0E0 ** 4 THEN format('{:,.1f} TB', bytes / 1024.0E0 ** 4) WHEN bytes >= 1024.0E0 ** 3 THEN format('{:,.1f} GB', bytes / 1024.0E0 ** 3) ELSE format('{:,.1f} MB', bytes / 1024.0E0 ** 2) END AS size, least(files, 200) AS shown, files > 200 AS truncated, false AS can_submit, CAST(5 AS INTEGER) AS next_position
            FROM t""",
    "processing_pages": f"""WITH docs AS ({VIEWS['docs']}), c AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE overall_state <> 'processing') AS finished FROM docs GROUP BY batch_id)
        SELECT batch_id, total, finished, CAST(round_even(100.0E0 * finished / total, 0) AS INTEGER) AS overall_percent, format('{{}} / {{}} ({{:.1f}}%)', finished, total, 100.0E0 * finished / total) AS readout, total - finished AS in_queue
            FROM c""",
    "saved_rules": """WITH stored AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN concat('rule_', n_name) ELSE n_name END AS key, 'old' AS value
            FROM nation), new AS (SELECT concat('rule_', n_name) AS key, CASE WHEN length(n_name) > 6 THEN 'true' ELSE 'false' END AS value
            FROM nation UNION ALL SELECT r_name, CAST(length(r_name) AS VARCHAR) FROM region)
        SELECT * FROM new UNION ALL SELECT * FROM stored WHERE key NOT IN (SELECT key FROM new)""",
    "chosen_files": "SELECT page_id, CASE WHEN length(html) % 5 = 1 THEN 'INVALID_PDF' WHEN length(html) % 5 IN (3, 4) THEN 'INCOMPLETE_PDF' ELSE 'VALID' END AS verdict FROM pages WHERE html IS NOT NULL",
    "failed_rows": f"""WITH failures AS ({VIEWS['failures']}) SELECT CASE WHEN document_pk % 3 = 0 THEN concat(chr(39),
            '=ABC-', document_pk) ELSE '' END AS c0, concat('d ', document_pk, '.pdf') AS c1, stage AS c2, 'FAILED' AS c3, technical AS c4, coalesce(validation_status, '') AS c5, format('{{:.2f}}', (id % 4) / 3.0E0) AS c6
            FROM failures""",
    "csv_read_back": "SELECT page_id, url, md5(coalesce(html, '')) AS digest FROM pages",
    "texts_read_back": "SELECT coalesce(source, 'none') AS folder, doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
    "replaced_children": f"WITH parties AS ({VIEWS['parties']}), n AS (SELECT DISTINCT deed FROM parties WHERE deed % 3 = 0 AND relation = 'B') SELECT deed, relation, ordinal, name FROM parties WHERE deed NOT IN (SELECT deed FROM n) UNION ALL SELECT deed, relation, ordinal, lower(name) FROM parties WHERE deed % 3 = 0 AND relation = 'B'",
    "upserted_attempts": """WITH e AS (SELECT user_id AS document_id, CAST(ascii(event_type) AS INTEGER) AS attempt, ts, event_id AS id, value
            FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY document_id, attempt, id % 2
            ORDER BY ts DESC, id DESC) AS k FROM e)
        SELECT document_id, attempt, id, value FROM l WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY document_id, attempt ORDER BY id % 2 DESC) = 1""",
    "small_values": """SELECT c_custkey, right(c_name, 9) AS nine, NULL AS eight, upper(concat('Custo', right(c_name, 4),
            left(c_mktsegment, 1))) AS pan, CASE WHEN c_nationkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS shown, lpad(CAST(c_custkey AS VARCHAR),
            5, '0') AS serial,
        CAST(CASE WHEN 14 + 3 * c_nationkey + 11 <= 40 THEN 2 ELSE 1 END AS INTEGER) AS page, concat(upper(left(c_mktsegment, 1)),
            lower(substr(c_mktsegment, 2)), ' of the ', upper(left(c_mktsegment, 1)), lower(substr(c_mktsegment, 2))) AS title,
        concat(c_mktsegment, repeat(' ', CAST(CASE WHEN c_nationkey > 8 THEN 8 ELSE c_nationkey END AS INTEGER)), '|') AS padded FROM customer""",
    "detected": """WITH t AS (SELECT doc_id, left(coalesce(text, ''), 200) AS t FROM documents), n AS (SELECT *, len(regexp_extract_all(t, '[aeiou]')) AS k, len(regexp_extract_all(t, '[A-Za-zÀ-ɏ]')) - len(regexp_extract_all(t, '[aeiou]')) AS l, len(regexp_extract(t, '^[^aeiou]*')) AS k_at, len(regexp_extract(t, '^[^A-Zb-df-hj-np-tv-zÀ-ɏ]*')) AS l_at
            FROM t),
        s AS (SELECT *, CASE WHEN k + l = 0 THEN 'neutral' WHEN k > l OR k = l AND k_at < l_at THEN 'kannada' ELSE 'latin' END AS script FROM n)
        SELECT doc_id, CASE script WHEN 'kannada' THEN 'kan_Knda' ELSE 'eng_Latn' END AS language, script,
            CASE WHEN script = 'neutral' THEN CASE WHEN trim(t) = '' THEN 0.0E0 ELSE 1.0E0 END ELSE round(greatest(k, l) / CAST(k + l AS DOUBLE),
            6) END AS confidence,
            CASE WHEN k > 0 THEN round(k / CAST(k + l AS DOUBLE), 6) END AS kannada, '' AS reason, script <> 'neutral' AND (script <> 'kannada' OR k > 0) AS wanted FROM s""",
}

SQL["detected_languages"] = f"SELECT language, count(*) AS n FROM ({SQL['detected']}) WHERE script <> 'neutral' GROUP BY language"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
