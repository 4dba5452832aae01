"""Operators with parameters on literal rows; sources and sinks on real files."""

from __future__ import annotations

import csv
import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cleanup, failures, grounding, identity, language, values, watermark
from ledgerloom.operators import batches as B
from ledgerloom.operators import documents as D
from ledgerloom.operators import folds, machine, reports, retention, rewrites
from ledgerloom.operators import validation as V
from ledgerloom.plans import export
from ledgerloom.session import Scratch
from ledgerloom.sources import files, scrape, sinks
from ledgerloom.streaming import progress

TEXT = "Ramesh Kumar ABCPE1234K Aadhaar 1234 5678 9012 sold for Rs 15,00,000 registration fee: 15,000 on 04-03-2025"
PERSON = {"name": "RAMESH KUMAR", "pan_card_number": "ABCPE1234K", "aadhaar_number": "1234 5678 9012"}


def answer(person=None, prop=None, doc=None, **more):
    return json.dumps({"buyer_details": [PERSON | (person or {})], "seller_details": [], "property_details": {"sale_consideration": "1500000", "registration_fee": "15000", "paid_in_cash": "no"} | (prop or {}), "document_details": {"transaction_date": "2025-03-04"} | (doc or {})} | more)


def report(spark, told, text=TEXT, rules=None, truncated=False, ocr_ok=True):
    docs = spark.createDataFrame([(1, told, text, truncated, ocr_ok)], "doc_id long, answer string, text string, truncated boolean, ocr_ok boolean")
    return V.validate(docs, rules or V.Rules())


CASES = [
    ("fine", answer(), {}, "OCR_P", "PM", "accept", 7500),
    ("no json", "nothing", {}, "OCR_P", None, "retry", None),
    ("cut short", answer(), {"truncated": True}, "OCR_P TRC", "PM", "review", 7500),
    ("not read", answer(), {"ocr_ok": False}, "OCR_F", "PM", "accept", 7500),
    ("pan not there", answer({"pan_card_number": "ZZZPE1234K"}), {}, "OCR_P XPAN:ABCPE1234K", "HPAN", "review", 7500),
    ("pan malformed", answer({"pan_card_number": "ABC"}), {}, "OCR_P XPAN:ABCPE1234K", "HPAN", "review", 7500),
    ("aadhaar short", answer({"aadhaar_number": "12"}), {}, "OCR_P", "PM WAN", "review", 7500),
    ("name not there", answer({"name": "SOMEONE ELSE"}), {}, "OCR_P", "PM WNM", "accept", 7500),
    ("sale not there", answer(prop={"sale_consideration": "1600000"}), {}, "OCR_P WSC", "PM", "review", 7500),
    ("fee malformed", answer(prop={"registration_fee": "15,000"}), {}, "OCR_P WSV", "PM", "review", None),
    ("fee over sale", answer(prop={"sale_consideration": "15", "registration_fee": "1500000"}), {"text": TEXT + " 15 paid"}, "OCR_P SSV", "PM", "accept", 750000),
    ("no date", answer(doc={"transaction_date": None}), {}, "OCR_P WTD", "PM", "accept", None),
    ("impossible date", answer(doc={"transaction_date": "2025-13-04"}), {}, "OCR_P WTD", "PM", "accept", None),
    ("after the cutoff", answer(doc={"transaction_date": "2025-09-04"}), {}, "OCR_P", "PM", "accept", 15000),
    ("wrong shape", answer(seller_details={}), {}, "OCR_P SCH", "PM", "review", 7500),
    ("identifiers apart", answer(), {"text": "ABCPE1234K " + "filler " * 60 + " 1234 5678 9012 Ramesh Kumar Rs 15,00,000 and 15,000 on 04-03-2025"}, "OCR_P", "PM PAF", "review", 7500),
    ("stopped early", answer(), {"text": TEXT + " PPPPP1111P QQQQQ2222Q"}, "OCR_P XPAN:PPPPP1111P,QQQQQ2222Q", "PM", "retry", 7500),
    ("one witness", answer(), {"text": TEXT + " PPPPP1111P"}, "OCR_P XPAN:PPPPP1111P", "PM", "accept", 7500),
]


@pytest.mark.parametrize(("told", "more", "remarks", "person", "verdict", "stamp"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_reports(spark, told, more, remarks, person, verdict, stamp):
    r = report(spark, told, **more)
    assert V.remarks(r).first()["remarks"] == remarks
    people = V.person_remarks(r).collect()
    assert (people[0]["remarks"] if people else None) == person
    row = r.first()
    assert (row["disposition"], row["stamp_value"]) == (verdict, stamp)


def test_rules_switch_checks_off(spark):
    off = V.Rules(pan=False, aadhaar=False, registration_fee=False, sale_consideration=False, transaction_date=False, against_text=False, confidence=False)
    row = report(spark, answer({"pan_card_number": "bad", "aadhaar_number": "1"}), rules=off).first()
    assert row["document_flags"] == ["OCR_P"] and row["confidence"] == 1.0
    assert [c["field"] for c in row["persons"][0]["checks"]] == ["name"] and row["persons"][0]["flags"] == []


def test_paid_in_cash_is_yes_or_no(spark):
    fields = V.suspect_fields(report(spark, answer({"pan_card_number": "ZZZPE1234K"}, {"paid_in_cash": None}))).first()["fields"]
    assert fields == ["paid_in_cash", "B1.pan"]


def test_a_fee_that_the_text_names_otherwise_lowers_confidence(spark):
    told = answer(prop={"registration_fee": "1500000"})
    checks = {c["field"]: c["score"] for c in report(spark, told).first()["document_checks"]}
    assert checks["registration_fee"] == 0.7 and checks["sale_consideration"] == 1.0


def test_scraped_answers_are_accepted_by_the_report(spark):
    docs = spark.createDataFrame([(1, TEXT + " QQQPE2222Q 9999-8888-7777 on 5/4/2024")], "doc_id long, text string")
    rows = docs.select("doc_id", scrape.answer(F.col("text")).alias("answer"), "text", F.lit(False).alias("truncated"), F.lit(True).alias("ocr_ok"))
    told = json.loads(rows.first()["answer"])
    assert [p["pan_card_number"] for s in ("buyer_details", "seller_details") for p in told[s]] == ["ABCPE1234K", "QQQPE2222Q"]
    assert told["property_details"]["sale_consideration"] == "1500000" and told["document_details"]["transaction_date"] == "2025-03-04"
    assert told["buyer_details"][0]["name"].startswith("MOCK B1 ")
    assert V.validate(rows).first()["schema_ok"]
    empty = docs.select(scrape.scrape(F.lit(None).cast("string")).alias("x")).first()["x"]
    assert empty["buyer_details"] == empty["seller_details"] == [] and empty["property_details"]["sale_consideration"] is None


DOCS = "id long, batch_id long, document_id string, ocr_state string, ocr_attempts long, extract_state string, extract_attempts long, translate_state string, validate_state string, overall_state string, validation_status string, is_retryable boolean, failure_reason string"


def docs(spark, *rows):
    base = {"batch_id": 1, "document_id": "D", "ocr_state": "done", "ocr_attempts": 1, "extract_state": "pending", "extract_attempts": 0, "translate_state": "pending", "validate_state": "pending", "overall_state": "processing", "validation_status": None, "is_retryable": None, "failure_reason": None}
    names = [f.split()[0] for f in DOCS.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": k} | r)[n] for n in names) for k, r in enumerate(rows, 1)], DOCS)


def batches(spark, *rows):
    return spark.createDataFrame([(k, f"b {k}", s, p, 1, 10, None, None) for k, (s, p) in enumerate(rows, 1)], "id long, name string, state string, queue_position long, user_key long, total_bytes long, started_at timestamp, finished_at timestamp")


def test_one_batch_one_document(spark):
    d = docs(spark, {}, {"batch_id": 2}, {"batch_id": 2, "overall_state": "failed", "is_retryable": False}, {"batch_id": 2, "overall_state": "failed"})
    b = batches(spark, ("running", 1), ("queued", 2), ("draft", None))
    assert [r["total"] for r in B.progress(d, b, [2, 3]).orderBy("batch_id").collect()] == [3, 0]
    assert D.claim_next(d, "extract", 2, batch=2).first()["id"] == 2
    assert [r["id"] for r in D.retryable_failures(d).collect()] == [4]
    assert [r["id"] for r in D.retryable_failures(d, ids=[3], force=True).collect()] == [3]
    assert B.choose(b, d).first()["id"] == 1
    assert [r["id"] for r in D.failed(d, 2).collect()] == [3, 4]
    rows, total = D.search(d, batch=2, text="d", page=0, size=2)
    assert total == 3 and [r["id"] for r in rows.collect()] == [2, 3]


def test_recovery_goes_in_order(spark):
    d = docs(spark, {"ocr_state": "running", "ocr_attempts": 4}, {"ocr_state": "pending", "ocr_attempts": 3}, {"extract_state": "running", "extract_attempts": 1})
    b = batches(spark, ("stopping", None))
    after, settled = D.recover(d, b, {"ocr": 1})
    got = {r["id"]: (r["ocr_state"], r["overall_state"], r["failure_reason"]) for r in after.collect()}
    # what ran is given its attempt back first, and fails if it was tried too often even so
    assert got[1] == ("failed", "failed", "ocr gave up after 3 attempts") == got[2]
    assert got[3] == ("done", "processing", None) and settled.first()["state"] == "stopped"


def test_batches_change_state(spark):
    now = F.to_timestamp(F.lit("2025-01-01"))
    b = batches(spark, ("queued", 1), ("running", 2), ("completed", None))
    told = spark.createDataFrame([(1, "running"), (2, "completed")], "id long, state string")
    got = {r["id"]: r for r in B.set_state(b, told, now).collect()}
    assert got[1]["started_at"] == datetime.datetime(2025, 1, 1) and got[1]["finished_at"] is None and got[2]["finished_at"] == datetime.datetime(2025, 1, 1)
    again = B.set_state(B.set_state(b, told, now), told, F.to_timestamp(F.lit("2026-01-01")))
    assert {r["id"]: r["started_at"] for r in again.collect()}[1] == datetime.datetime(2025, 1, 1)
    head = {r["id"]: (r["state"], r["queue_position"]) for r in B.to_head(b, [3]).collect()}
    assert head[3] == ("queued", 0) and head[1] == ("queued", 1)
    assert {r["id"]: r["deletable"] for r in B.deletable(batches(spark, ("stopping", None)), docs(spark, {}), force=True).collect()} == {1: True}


def test_running_figures_do_not_depend_on_ranges(spark):
    rows = spark.createDataFrame([(k, float(k * 7 % 31), k if k % 40 == 3 else None) for k in range(500)], "id long, v double, given long").repartition(7)
    got = {r["id"]: (r["average"],) for r in B.moving_average(rows, "v", ["id"], Scratch(spark, "t"), 50).collect()}
    for k in range(500):
        own = [j * 7 % 31 for j in range(max(0, k - 49), k + 1)]
        assert abs(got[k][0] - sum(own) / len(own)) < 1e-9
    want, last = {}, 0
    for k in range(500):
        last = k if k % 40 == 3 else last + 1
        want[k] = last
    assert {r["id"]: r["serial"] for r in rewrites.serials(rows, ["id"], "given", Scratch(spark, "t")).collect()} == want


def test_verdicts_keep_page_counts(spark):
    d = docs(spark, {"overall_state": "failed"}, {}).withColumn("page_count", F.when(F.col("id") == 2, 5))
    told = spark.createDataFrame([(1, "VALID", 9), (2, "EMPTY_PDF", 9)], "id long, status string, page_count int")
    assert {r["id"]: (r["validation_status"], r["page_count"]) for r in D.record_verdicts(d, told).collect()} == {1: ("PROCESSING_ERROR", 9), 2: ("EMPTY_PDF", 5)}


def test_retention_needs_an_archive(spark, tmp_path):
    at = datetime.datetime
    tables = {
        "batches": spark.createDataFrame([(1, at(2019, 1, 1)), (2, at(2021, 1, 1))], "id long, created_at timestamp"),
        "documents": spark.createDataFrame([(10, 1), (20, 2)], "id long, batch_id long"),
        "pages": spark.createDataFrame([(100, 10, at(2021, 6, 1)), (200, 20, at(2021, 6, 1)), (201, 20, at(2020, 1, 1))], "id long, document_id long, created_at timestamp"),
        "logs": spark.createDataFrame([(1, at(2021, 5, 30)), (2, at(2020, 1, 1))], "id long, created_at timestamp"),
    }
    now = F.to_timestamp(F.lit("2021-06-02"))
    kept, tally = retention.run(spark, tables, now, 30, 30, 2020, None)
    assert {r["kind"]: r["n"] for r in tally.collect()} == {"pages": 1, "logs": 1, "batches": 0, "documents": 0} and kept["batches"].count() == 2
    kept, tally = retention.run(spark, tables, now, 30, 30, 2020, f"file://{tmp_path}/archive")
    assert {r["kind"]: r["n"] for r in tally.collect()} == {"pages": 1, "logs": 1, "batches": 1, "documents": 1}
    assert [kept[t].count() for t in ("batches", "documents", "pages")] == [1, 1, 1]
    assert spark.read.parquet(f"file://{tmp_path}/archive/batches").first()["id"] == 1


def test_all_that_is_purged_can_be_read_back(spark, tmp_path):
    at = datetime.datetime
    tables = {
        "batches": spark.createDataFrame([(1, at(2019, 1, 1)), (2, at(2021, 1, 1))], "id long, created_at timestamp"),
        "documents": spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "id long, batch_id long"),
        "pages": spark.createDataFrame([(100, 10, at(2021, 6, 1), "page"), (200, 20, at(2021, 6, 1), "other")], "id long, document_id long, created_at timestamp, body string"),
        "persons": spark.createDataFrame([(10, "asha"), (11, None), (20, "ravi")], "document_id long, name string"),
        "failures": spark.createDataFrame([(11, "no text"), (20, "x")], "document_id long, reason string"),
        "logs": spark.createDataFrame([], "id long, created_at timestamp"),
    }
    kept, _ = retention.run(spark, tables, F.to_timestamp(F.lit("2021-06-02")), 30, 30, 2020, f"file://{tmp_path}/archive")
    for name in ("batches", "documents", "pages", "persons", "failures"):
        back = spark.read.parquet(f"file://{tmp_path}/archive/{name}")
        both = sorted(map(tuple, back.unionByName(kept[name]).select(*tables[name].columns).collect()), key=str)
        assert both == sorted(map(tuple, tables[name].collect()), key=str) and back.count() and kept[name].count()
    assert spark.read.parquet(f"file://{tmp_path}/archive/pages").first()["body"] == "page"


def test_shares_beyond_the_whole_numbers_of_a_double(spark):
    row = spark.range(1).select(values.share(F.lit(9007199254740993), F.lit(1), F.lit(1)).alias("s"), values.share(F.lit(9007199254740995), F.lit(2), F.lit(1)).alias("h"), values.share_text(F.lit(900719925474099301), F.lit(False)).alias("t")).first()
    assert (row["s"], row["h"], row["t"]) == (9007199254740993, 4503599627370498, "9007199254740993.01")


REPORT = [("1", "=cmd", 'say "x"', "a,b"), ("2", "", None, "line\nbreak")]


def test_csv_has_a_mark_and_windows_line_ends(spark, tmp_path):
    df = spark.createDataFrame(REPORT, "a string, b string, c string, d string")
    n = sinks.write_csv(df, ("a", "b", "c", "d"), str(tmp_path / "r.csv"), order=["a"])
    raw = (tmp_path / "r.csv").read_bytes()
    assert n == 2 and raw.startswith(b"\xef\xbb\xbfa,b,c,d\r\n1,=cmd,") and raw.endswith(b"\r\n")
    with (tmp_path / "r.csv").open(encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f))[1:] == [["1", "=cmd", 'say "x"', "a,b"], ["2", "", "", "line\nbreak"]]
    assert files.same_header(spark, f"file://{tmp_path}/r.csv", ("a", "b", "x", "d", "e")) == [(2, "c", "x"), (4, "", "e")]
    sinks.write_parts(df.fillna(""), f"file://{tmp_path}/parts")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/parts").fillna("")
    assert sorted(map(tuple, back.collect())) == sorted(tuple(x or "" for x in r) for r in REPORT)


def test_one_file_of_many_ranges_equals_a_csv_writer(spark, data, tmp_path):
    source = spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"), F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderstatus", F.lit(' "x", y\r\n'))).alias("note"))
    n = sinks.write_csv(source.repartition(7), ("o_orderkey", "day", "note"), f"file://{tmp_path}/o.csv", [F.desc("day"), "o_orderkey"])
    rows = sorted(source.collect(), key=lambda r: (r["day"], -r["o_orderkey"]), reverse=True)
    with (tmp_path / "want.csv").open("w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows([("o_orderkey", "day", "note"), *rows])
    assert n == len(rows) and (tmp_path / "o.csv").read_bytes() == (tmp_path / "want.csv").read_bytes()
    assert not list(tmp_path.glob("*parts*"))
    none = spark.createDataFrame([], "a string")
    assert sinks.write_csv(none, ("a",), str(tmp_path / "none.csv"), ["a"]) == 0 and (tmp_path / "none.csv").read_bytes() == b"\xef\xbb\xbfa\r\n"
    assert sinks.write_csv(spark.createDataFrame([(None,)], "a string"), ("a",), str(tmp_path / "one.csv")) == 1 and (tmp_path / "one.csv").read_bytes().endswith(b'a\r\n""\r\n')


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    cells = ["plain", 'a "q"', "x,\r\n\r\ny", '"\r\n"', "\n", "", "\r\n" * 40, "é\r\n" * 3 + '"', "long " * 60, ' "\r\n,"\r\n ']
    want = [(k, cells[k % 10] or None, cells[k * 7 % 10 - 3] or None) for k in range(100)]
    frame = spark.createDataFrame(want, "k long, a string, b string")
    sinks.write_csv(frame, ("k", "a", "b"), f"file://{tmp_path}/c.csv", ["k"])
    sinks.write_csv(frame.limit(0), ("k", "a", "b"), f"file://{tmp_path}/none.csv", ["k"])
    size = (tmp_path / "c.csv").stat().st_size
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for most in (10_000_000, 2048, 300):  # one split, and some that end within records
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            got = files.read_csv(spark, f"file://{tmp_path}/c.csv", "k long, a string, b string")
            assert sorted(map(tuple, got.collect())) == want, most
            assert files.csv_records(spark, f"file://{tmp_path}/c.csv").rdd.getNumPartitions() > size // (2 * most), most
        assert files.read_csv(spark, f"file://{tmp_path}/none.csv", "k long, a string, b string").count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_exports_are_named_and_violations_told(spark, tmp_path):
    rows = [{c: "" for c in export.COLUMNS} | {"Transaction Type": "Q", "Property Type": "A", "Address Type (PC-L)": "1", "Property Address": "ಮನೆ"}]
    df = spark.createDataFrame([(1, 1, *rows[0].values())], "deed long, ordinal long, " + ", ".join(f"`{c}` string" for c in export.COLUMNS))
    told = sinks.export_report(df, str(tmp_path), "ಬ್ಯಾಚ್ 1/2", datetime.datetime(2025, 3, 4, 5, 6))
    assert told["rows"] == 1 and told["path"].endswith("_1_2_20250304_0506.csv") and (tmp_path / told["path"].rsplit("/", 1)[1]).exists()
    assert told["violations"] == ["row 1: Transaction Type = 'Q'"] and list(told["untranslated"]) == ["Property Address"]
    failed = spark.createDataFrame([("ABC-1", "a.pdf", "ocr", "FAILED", "=why", None, 0.5), ("", "b.pdf", "ocr", "FAILED", "x", "", None)], "identity string, source string, stage string, status string, reason string, flags string, confidence double")
    shown = export.failed_report(failed).collect()
    assert tuple(shown[0]) == ("ABC-1", "a.pdf", "ocr", "FAILED", "'=why", "", "0.50") and shown[1]["Confidence"] == "" and tuple(shown[0].asDict()) == export.FAILED_COLUMNS


def test_text_files_and_notes(spark, tmp_path):
    rows = spark.createDataFrame([("in/a", "one", "text one\nmore", None), ("in/a", "two", None, "no text"), ("in/b", "three", "t", None)], "folder string, name string, text string, reason string")
    sinks.write_texts(rows, f"file://{tmp_path}/out")
    found = spark.read.option("recursiveFileLookup", True).text(f"file://{tmp_path}/out", wholetext=True).collect()
    assert len(found) == 2 and any(r["value"].startswith("text one\nmore") for r in found)
    assert {r["folder"]: r["note"] for r in sinks.failure_notes(rows).collect()} == {"in/a": "two  no text"}
    assert (tmp_path / "out" / "in_a" / "one.txt").read_text() == "text one\nmore" and (tmp_path / "out" / "in_b" / "three.txt").read_text() == "t"
    again = spark.createDataFrame([("in/a", "one", "new"), ("", "../x", "y"), ("in/b", "three", "a"), ("in/b", "three", "b")], "folder string, name string, text string")
    sinks.write_texts(again, f"file://{tmp_path}/out")
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"in_a/one.txt": "new", "in_b/three.txt": "b", "_/_x.txt": "y"}


def test_tasks_list_and_read_files(spark, tmp_path):
    rows = [(f"f {k % 3}", f"d%20 {k}.gz", "é" * k) for k in range(60)]
    sinks.write_texts(spark.createDataFrame(rows, "folder string, name string, text string"), f"file://{tmp_path}/out")
    (tmp_path / "out" / "f 0" / ".hidden").write_text("x")
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]
    found = files.files_in_folders(spark, f"file://{tmp_path}/out")
    assert found.rdd.getNumPartitions() == 4  # 60 files of some bytes open no task each
    assert sorted(map(tuple, found.collect())) == sorted((a, f"{b}.txt", c.encode()) for a, b, c in rows)
    (tmp_path / "none").mkdir()
    assert files.files_in_folders(spark, f"{tmp_path}/none").count() == 0


def test_files_are_told_by_name_and_bytes(spark, tmp_path):
    (tmp_path / "g.pdf").write_bytes(b"%PDF-x.4 x %%EOF")
    for name, data in (("a.pdf", b"%PDF-1.4 x %%EOF"), ("b.PDF", b"%PDF-1.4 cut"), ("c.pdf", b"hello"), ("d.txt", b"%PDF-1.4 %%EOF"), ("e.pdf", b""), ("f.pdf", b"\n" * 2000 + b"%PDF-1.4 %%EOF")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in files.uploads(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.pdf": "VALID", "b.PDF": "INCOMPLETE_PDF", "c.pdf": "INVALID_PDF", "f.pdf": "INVALID_PDF", "g.pdf": "INVALID_PDF"}
    assert files.selected(files.uploads(spark, f"file://{tmp_path}")).first().asDict() == {"files": 2, "bytes": 28}


def test_settings(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "x")], "key string, value string")
    assert files.settings(rows, {"a": "0", "c": "d"}).first()["settings"] == {"a": "1", "b": "x", "c": "d"}
    new = spark.createDataFrame(files.rule_settings({"pan": True, "name": False}, {"near": "250", "a": "2"}), "key string, value string")
    kept = files.set_values(rows, new)
    assert files.value_of(kept, "a", "9") == "2" and files.value_of(kept, "rule_name", "") == "false" and files.value_of(kept, "none", "9") == "9"
    flags = spark.createDataFrame([("1",), ("TRUE ",), ("on",), ("0",), (None,)], "v string").select(files.as_boolean(F.col("v")).alias("b"))
    assert [r["b"] for r in flags.collect()] == [True, True, True, False, False]


def test_snapshots_are_read_back(spark, tmp_path):
    assert sinks.snapshot(spark, spark.range(10), f"file://{tmp_path}/s") == 10
    assert sinks.sound_archive(spark, f"file://{tmp_path}/s", 10) and not sinks.sound_archive(spark, f"file://{tmp_path}/s", 11) and not sinks.sound_archive(spark, f"file://{tmp_path}/none", 1)
    assert sinks.archive_faults(spark, f"file://{tmp_path}/s", ["id", "name"], 9) == ["no column name", "10 rows of 9"] and sinks.archive_faults(spark, f"file://{tmp_path}/none", [], 1) == ["the archive is empty"]
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "part-0.parquet").write_bytes(b"PAR1 torn")
    with pytest.raises(Exception):  # noqa: B017
        sinks.archive_faults(spark, f"file://{tmp_path}/torn", [], 1)


def values_of(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_small_functions(spark):
    lit = F.lit
    none = lit(None).cast("string")
    assert values_of(spark, values.yes_no(lit(True)), values.yes_no(lit(None).cast("boolean")), values.filled(lit(""), lit("raw")), values.pan_or_null(lit(" abcpe1234k")), values.pan_or_null(lit("abc"))) == ("yes", "", "raw", "ABCPE1234K", None)
    assert values_of(spark, values.exact_digits(lit("12 34"), 4), values.exact_digits(lit("1"), 4), values.date_plausible(lit("2025-02-31")), values.date_plausible(lit("1800-01-01")), values.persisted_date(lit(" 2025-02-03 ")), values.persisted_date(lit("2025-2-3"))) == ("1234", None, True, False, datetime.date(2025, 2, 3), None)
    assert values_of(spark, *[values.human_bytes(lit(n).cast("bigint")) for n in (12, 2048, 3 * 1024**3)], *[values.human_duration(lit(s)) for s in (5, 65, 3700)]) == ("12 B", "2.0 KB", "3.0 GB", "5s", "1m 05s", "1h 01m")
    assert values_of(spark, failures.failed_stage(lit("done"), lit("failed"), lit("failed"), lit("done")), failures.failed_stage(*[lit("done")] * 4)) == ("extract", "")
    assert values_of(spark, identity.page_of(lit("== PAGE 1 ==\nx\n== PAGE 2 ==\nABC"), lit(30)), identity.pages_to_read(lit(9)), identity.pages_to_read(lit(3)), identity.pages_to_read(lit(0))) == (2, [1, 2, 8, 9], [1, 2, 3], [])
    assert values_of(spark, language.title_case(lit("ravi VAN der")), language.has_indic(lit("x ಮ")), language.has_indic(none)) == ("Ravi van Der", True, False)
    assert values_of(spark, grounding.suspect(lit(None).cast("boolean"), lit(False)), grounding.check_score(lit(True), lit(None).cast("boolean")), grounding.confidence(F.array(F.struct(lit(True).alias("format_ok"), lit(True).alias("present"), lit(0.25).alias("score"))))) == (True, 0.6, 0.25)
    assert values_of(spark, *[D.text_gate(lit(t), lit(2)) for t in (" ", "x" * 79, "x" * 80)]) == ("OCR produced no text", "only 79 characters across 2 pages: no usable text layer", None)
    assert values_of(spark, D.translate_outcome(lit(0), lit(0)), D.final_state(lit("accept"), lit("")), D.may_retry(none), D.is_corrupt(lit("EMPTY_PDF"))) == ("skipped", "needs_review", True, True)
    clean = cleanup.report(lit("a\r\n<b>x</b>\n\n\n\n"), lit("a\nx\n"))
    told = values_of(spark, clean)[0].asDict()
    assert {k: told[k] for k in ("chars_before", "chars_after", "line_ends", "tags", "blank_runs")} == {"chars_before": 15, "chars_after": 4, "line_ends": 1, "tags": 2, "blank_runs": 1}
    assert (told["lines_before"], told["lines_after"], told["control"], told["rules"], told["masked"], told["pages"]) == (6, 3, 0, 0, 0, 0)
    page = cleanup.report(lit("-- Page 2 --\nx\x07XXXX XXXX 1234" + "=" * 0 + "\n" + "-" * 25), cleanup.page_markers(lit("-- Page 2 --\nx")))
    more = values_of(spark, page)[0]
    assert (more["control"], more["masked"], more["rules"], more["pages"]) == (1, 1, 1, 1) and more["markers_rewritten"] + more["markers_inserted"] == 1
    assert values_of(spark, cleanup.summary(clean))[0].startswith("15 -> 4 chars (+73.3%), 0 pages, 1 line ends") and values_of(spark, cleanup.summary(clean))[0].endswith(", 2 tags removed")
    assert values_of(spark, values.human_bytes(none.cast("long")), values.human_bytes(lit(3 * 1024**5)), values.human_duration(lit(0)), values.human_duration(lit(None).cast("int")), values.whole_percent(lit(1), lit(0)), values.whole_percent(lit(5), lit(1000)), values.local_time(none), values.badge(lit("x")), values.badge(none)) == ("0 B", "3,072.0 TB", "-", "-", 0, 0, "-", "", "")


def test_cleaning_of_masks_spaces_and_composition(spark):
    mask = [cleanup.masked_ids(F.lit(t)) for t in ("xxxx  xxxx 1234.", "AXXXX XXXX 12345", "XXXX-XXXX-1234")]
    assert values_of(spark, *mask) == (".", "AXXXX XXXX 12345", "")
    assert values_of(spark, cleanup.trailing_space(F.lit("a  \nb\t\n")), cleanup.composed(F.lit("é"))) == ("a\nb\n", "é")


def test_lines_that_recur_on_pages_go(spark):
    rows = [(1, p, f"  Office of the Registrar \nbody {p}\n") for p in range(4)] + [(1, 9, " ")] + [(2, p, "Office of the Registrar") for p in range(2)]
    got = cleanup.without_headers(spark.createDataFrame(rows, "doc_id long, page_number int, body string"))
    assert {(r["doc_id"], r["page_number"]): r["body"] for r in got.collect()} == {(1, p): f"body {p}\n" for p in range(4)} | {(1, 9): " "} | {(2, p): "Office of the Registrar" for p in range(2)}


def test_null_keys_are_computed_in_place(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "id long, k string")
    got = language.apply_once(rows, ["k"], lambda d: d.withColumn("v", F.coalesce("k", F.lit("none"))))
    assert {r["id"]: r["v"] for r in got.collect()} == {1: "a", 2: "none", 3: "a", 4: "none"}


def test_stamps_are_told_from_content(spark):
    said = [watermark.says_watermark(F.lit(t)) for t in ("For Government Purpose Only", "the house", "", "copy " * 30)]
    assert values_of(spark, *said) == (True, False, False, False)
    assert values_of(spark, watermark.is_rotated(F.lit(1.0), F.lit(0.0)), watermark.is_rotated(F.lit(0.7), F.lit(0.7)), watermark.is_faint(F.lit(0xCCCCCC)), watermark.is_faint(F.lit(0xCCCC00)), watermark.is_phrase(F.lit("the")), watermark.is_phrase(F.lit("1234 5678 9012"))) == (False, True, True, False, False, False)


def test_models_of_the_machine(spark):
    lit = lambda x: F.lit(x)
    assert values_of(spark, machine.kv_bytes(lit(2048), lit(5), lit(29), lit(1024), lit(4), lit(256), lit(2.0)))[0] == (5 * 2048 + 29 * 1024) * 2 * 4 * 256 * 2
    assert [tuple(x) for x in values_of(spark, machine.batch_sizes(lit(12 * machine.GIB)), machine.batch_sizes(lit(4 * machine.GIB)))] == [(32, 256), (4, 16)]
    assert values_of(spark, machine.workers(lit("normal"), lit(8), lit(4 * machine.GIB), "pdf_render"), machine.workers(lit("critical"), lit(8), lit(0), "export"), machine.offloaded_layers(lit(34), lit(100), lit(950), lit(200))) == (7, 1, 7)


def test_lines_of_boxes_become_rows(spark):
    rows = [(1, 1, 0.5, 0.10, 0.9, 0.12, "b"), (1, 1, 0.1, 0.09, 0.4, 0.13, "a"), (1, 1, 0.1, 0.5, 0.2, 0.6, "c")]
    got = folds.page_layout(spark.createDataFrame(rows, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")).orderBy("row").collect()
    assert [r["text"] for r in got] == ["a b", "c"]


def test_runs_are_compared_by_letters(spark):
    run = lambda *r: spark.createDataFrame(list(r), "document long, field string, value string")
    got = reports.compare(run((1, "a", "X y"), (1, "b", None), (1, "c", "z"), (9, "a", "q")), run((1, "a", "x-Y"), (1, "b", "new"), (1, "c", "")))
    assert {r["field"]: r["verdict"] for r in got.collect()} == {"a": "same_text", "b": "added", "c": "lost"}


def test_levels_over_a_stream_are_those_over_a_table(spark, tmp_path):
    rows = [(s, k, datetime.datetime(2024, 1, 1, 0, 0, k), (k * 37 + s) % 100 / 300) for s in range(3) for k in range(40)]
    samples = spark.createDataFrame(rows, "source long, id long, ts timestamp, free double")
    samples.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(samples.schema).parquet(f"{tmp_path}/in")
    progress.run_to_table(progress.pressure_stream(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").select("source", "id", "level").collect()))
    assert got == sorted((r["source"], r["id"], r["level"]) for r in folds.pressure(samples).collect())


def test_new_documents_go_through_their_stages_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, TEXT), (2, TEXT + " PPPPP1111P QQQQQ2222Q"), (3, "")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        progress.process_documents(spark, f"{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    got = {r["doc_id"]: r["state"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {1: "accept", 2: "accept", 3: "failed"} and spark.read.parquet(f"file://{tmp_path}/out").count() == 3


def test_hours_are_counted_with_a_watermark(spark):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, h, 5), "a") for h in (0, 0, 1)], "id long, ts timestamp, event_type string")
    assert sorted(r["n"] for r in progress.hourly(rows).collect()) == [1, 2]


def test_translators_get_texts_by_language(spark):
    rows = spark.createDataFrame([(k, f"t{k}", "kan_Knda" if k % 3 else "hin_Deva") for k in range(50)], "id long, text string, language string").repartition(3)
    got = {r["id"]: r["text"] for r in language.translated(rows, lambda name, texts: [f"{name}:{len(texts) <= 4}:{t}" for t in texts], chunk=4).collect()}
    assert got == {k: f"{'kan_Knda' if k % 3 else 'hin_Deva'}:True:t{k}" for k in range(50)}


def test_attempts_are_replaced_by_later_answers(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "document_id long, attempt int, id long, created_at timestamp, raw string")
    at = datetime.datetime(2024, 1, 1)
    got = D.upsert_attempts(rows((1, 1, 1, at, "a"), (1, 2, 2, at, "b")), rows((1, 2, 3, at, "c"), (1, 2, 4, at, "d"), (2, 1, 5, at, "e")))
    assert sorted((r["document_id"], r["attempt"], r["raw"]) for r in got.collect()) == [(1, 1, "a"), (1, 2, "d"), (2, 1, "e")]


def test_flags_take_one_pass_over_the_report(spark):
    from ledgerloom.operators import validation

    docs = spark.createDataFrame([(1, '{"buyer_details": [{"name": "A B", "pan_card_number": "ABCPE1234K"}]}', "A B", False, True), (2, "none", "", True, True)],
        "doc_id long, answer string, text string, truncated boolean, ocr_ok boolean")
    rows = validation.flag_rows(validation.validate(docs))
    assert {(r["doc_id"], r["relation"], r["ordinal"], r["flag"]) for r in rows.collect()} >= {(1, "B", 1, "HPAN"), (1, None, None, "SCH"), (2, None, None, "TRC")}
    assert "Union" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_cards_are_profiled_within_their_rows(spark):
    cards = spark.sql("SELECT id AS id, id * 1073741824 AS free_bytes, 3900000000L AS parameters, 5L AS full_layers, 29L AS sliding_layers, 1024L AS window, 4L AS heads, 256L AS head_size FROM range(40)")
    told = machine.profiles(cards, 700 * machine.MIB, 64 * machine.MIB)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    rows = {r["id"]: r for r in told.collect()}
    assert len(rows) == 40 and rows[0]["context"] is None and rows[0]["slots"] is None and rows[39]["weights"] == "BF16"


def test_runs_are_compared_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(reports, "PART", 10)
    first = spark.sql("SELECT id AS document, f AS field, CAST(id AS STRING) AS value FROM range(40) CROSS JOIN (SELECT explode(array('a', 'b', NULL)) AS f)")
    second = first.filter("document < 30 AND NOT (document = 1 AND field = 'b')").withColumn("value", F.expr("IF(document % 2 = 0, value, 'x')"))
    told = reports.compare(first.unionByName(first.filter("document = 3 AND field = 'a'")), second)
    assert "RepartitionByExpression [document" in told._jdf.queryExecution().optimizedPlan().toString() and told.rdd.getNumPartitions() >= 20
    n = {(r["field"], r["verdict"]): r["count"] for r in told.groupBy("field", "verdict").count().collect()}
    assert n == {("a", "same"): 15, ("a", "changed"): 16, ("b", "same"): 15, ("b", "changed"): 14, ("b", "lost"): 1, (None, "lost"): 30, (None, "added"): 29}


def test_untranslated_cells_are_found_in_one_pass(spark):
    row = {c: "" for c in export.COLUMNS}
    rows = [(2, 1, {**row, "Remarks": "ಮನೆ two", "City / Town": "é ٣"}), (1, None, {**row, "Remarks": "plain"}), (1, 1, {**row, "Remarks": "ಮನೆ one"})]
    report = spark.createDataFrame([(d, o, *r.values()) for d, o, r in rows], f"deed long, ordinal int, {', '.join(f'`{c}` string' for c in export.COLUMNS)}")
    told = export.untranslated(report)
    assert [tuple(r) for r in told.collect()] == [("Remarks", "ಮನೆ one")]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # cells aren't made rows before they are told


def _docs(spark, told, text):
    return spark.createDataFrame([(1, told, text, False, True), (2, "none", "", False, True)], "doc_id long, answer string, text string, truncated boolean, ocr_ok boolean")


def test_a_document_is_reported_without_the_checks_of_persons(spark):
    told = V.validate(_docs(spark, answer(), TEXT)).select("doc_id", "disposition", "confidence", "document_flags")
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "discarded_pan" not in plan  # one way to Python; what isn't asked for isn't built
    assert [(r["disposition"], r["confidence"]) for r in told.orderBy("doc_id").collect()] == [("accept", 1.0), ("retry", 0.0)]


def test_a_pan_is_no_pattern(spark):
    text = "A(B*C " + "filler " * 60 + "1234 5678 9012 Ramesh Kumar Rs 15,00,000 and 15,000 on 04-03-2025"
    assert report(spark, answer({"pan_card_number": "A(B*C"}), text).first()["persons"][0]["flags"] == ["HPAN", "PAF"]


def test_persons_by_row_are_those_of_reports(spark):
    docs = _docs(spark, answer({"name": "SOMEONE ELSE"}), TEXT)
    rows = V.persons(docs)
    assert [tuple(r) for r in V.person_remarks(rows).collect()] == [tuple(r) for r in V.person_remarks(V.validate(docs)).collect()]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1  # an inner explode would work the answers out a second time


def test_dates_are_real_and_written_in_ten_characters(spark):
    from ledgerloom.functions import values

    told = spark.createDataFrame([("2024-02-29",), ("2025-02-29",), ("0000-01-01",), ("2025-01-01\n",), ("2025-1-1",), (None,)], "d string")
    assert [str(r[0]) for r in told.select(values.calendar_date(F.col("d"))).collect()] == ["2024-02-29", *["None"] * 5]
