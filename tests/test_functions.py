"""Literal cases of the column functions."""

from __future__ import annotations

import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.util import PythonEvalType
from pyspark.sql import functions as F

from ledgerloom.functions import classify, cleanup, failures, grounding, identity, language, places, values
from ledgerloom.operators import folds
from ledgerloom.plans import export


def one(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, tuple) else F.lit(v[0]).cast(v[1]).alias(k) for k, v in given.items()]) if given else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("House 67, Karnataka - 562123", "562123"), ("BENGALURU-560 015", "560015"), ("560010 something 570001", "570001"), ("ref 012345 only", ""), ("1234567", ""), ("64.660488 square metres", ""), (None, "")],
)
def test_pin_code(spark, text, want):
    assert one(spark, values.pin_code(F.col("t")), t=(text, "string")) == want


@pytest.mark.parametrize(("text", "want"), [("1,50,000=00", 150000), ("200.00", 200), ("12,30,000.00", 1230000), ("", None), ("abc", None)])
def test_amount(spark, text, want):
    assert one(spark, values.amount(F.col("t")), t=text) == want


def test_two_readings_of_digits(spark):
    assert one(spark, values.all_digits(F.col("t")), t="200.00") == 20000


@pytest.mark.parametrize(("fee", "day", "want"), [(33000, "2025-08-30", 16500), (33000, "2025-08-31", 33000), (33001, "2025-01-01", 16501), (33000, None, None), (33000, "2025-13-45", None)])
def test_stamp_value(spark, fee, day, want):
    assert one(spark, values.stamp_value(F.col("f"), values.calendar_date(F.col("d"))), f=fee, d=(day, "string")) == want


def test_shares_add_up(spark):
    for total in (100000, 99999, 1, 0):
        for n in range(1, 13):
            got = [r["s"] for r in spark.range(1, n + 1).select(values.share(F.lit(total), F.lit(n), F.col("id")).alias("s")).collect()]
            assert sum(got) == total
            assert got == sorted(got, reverse=True)
            assert max(got) - min(got) <= 1


@pytest.mark.parametrize(("text", "want"), [("=cmd", "'=cmd"), ("  a   b ", "a b"), (None, ""), ("-5", "'-5")])
def test_cell(spark, text, want):
    assert one(spark, values.cell(F.col("t")), t=(text, "string")) == want


@pytest.mark.parametrize(
    ("address", "text", "want"),
    [("agricultural land of 2 acres", "", "A"), ("converted land", "", "N"), ("shop in a mall", "", "C"), ("residential site", "", "R"), ("industrial shed", "", "I"), ("temple", "", "Z"), ("", "", "X"), ("", "living in the schedule property at a house ... SCHEDULE: agricultural land", "A")],
)
def test_property_type(spark, address, text, want):
    assert one(spark, classify.property_type(F.col("a"), F.col("t")), a=address, t=text) == want


def test_cleanup_steps(spark):
    text = "a\r\nb‍  \n\n\n\n<b>c</b> 42\\frac{1}{2}\n=========================\nd<br>e"
    assert one(spark, cleanup.clean(F.col("t")), t=text) == "===== PAGE 1 =====\na\nb\n\nc 42 1/2\n\nd e\n"
    assert one(spark, cleanup.page_markers(F.col("t")), t="x\fy") == "===== PAGE 1 =====\nx\n===== PAGE 2 =====\ny"


def test_pages_round_trip(spark):
    docs = spark.createDataFrame([(1, "===== PAGE 1 =====\nx\n===== PAGE 2 =====\ny z")], "doc_id long, text string")
    rows = cleanup.pages(docs)
    assert [(r["page_number"], r["body"]) for r in rows.orderBy("page_number").collect()] == [(1, "x"), (2, "y z")]
    assert cleanup.full_text(rows).first()["text"] == docs.first()["text"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("exceeds the available context size (HTTP 400)", "AI_INPUT_TOO_LARGE"), ("connection refused", "AI_SERVER_UNAVAILABLE"), ("only 3 characters across 9 pages; no usable text layer", "OCR_NO_TEXT"), ("Failed to open '/in/truncated.pdf' for reading", "UNKNOWN_ERROR"), ("", "UNKNOWN_ERROR")],
)
def test_failure_code(spark, text, want):
    assert one(spark, failures.code(F.col("t"), F.lit(None).cast("string")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [('```json\n{"a": 1}\n``` done', '{"a": 1}'), ('{"a":"}{"} tail', '{"a": "}{"}'), ('{"a":1}{"b":2}', '{"a": 1}'), ('{"a": ', None), (None, None)])
def test_first_json(spark, text, want):
    found = one(spark, grounding.first_json(F.col("t")), t=(text, "string"))
    # objects are compared: Spark's parser writes them without spaces, Python's with
    assert (found and json.loads(found)) == (want and json.loads(want))


def test_grounding(spark):
    text = "paid 1,50,000=00 and 33,00,\n000; fee 200.00; Aadhaar 2413 9130\n5374 of ADPPN2284H, SELLER ONE on 09/04/2025"
    given = {"t": text}
    t, norm = F.col("t"), F.col("norm")
    assert one(spark, grounding.amount_in(F.lit("150000"), t), **given)
    assert not one(spark, grounding.amount_in(F.lit("1500000"), t), **given)
    assert one(spark, grounding.amount_in(F.lit("3300000"), t), **given)
    assert not one(spark, grounding.amount_in(F.lit("20000"), t), **given)
    form = {"t": text, "norm": one(spark, grounding.match_form(t), **given)}
    assert one(spark, grounding.aadhaar_in(F.lit("241391305374"), norm, t), **form)
    assert one(spark, grounding.name_in(F.lit("SELLER ONE"), norm), **form)
    assert one(spark, grounding.date_in(F.lit("2025-04-09"), norm), **form)
    assert one(spark, grounding.pans_in(t), **given) == ["ADPPN2284H"]
    assert one(spark, grounding.near(F.lit("ADPPN2284H"), F.lit("241391305374"), t), **given) is True
    assert one(spark, grounding.near(F.lit("ADPPN2284H"), F.lit("241391305374"), F.concat(F.lit("ADPPN2284H"), F.repeat(F.lit(" filler"), 200), F.lit(" 241391305374")))) is False
    assert one(spark, grounding.near(F.lit(None).cast("string"), F.lit("241391305374"), t), **given) is None


def test_identity_choice(spark):
    rows = [
        (1, "document number ABC-1-00001-2025-26", ""),
        (2, "vide doc ABC-1-00001-2019-20 ... document no DEF-1-00002-2025-26", ""),
        (3, "ABC-1-00001-2025-26 and DEF-1-00002-2025-26", ""),
        (4, "nothing", "/in/RMN-1-02264-2024-25.pdf"),
        (5, "nothing", "/in/275.pdf"),
        (6, None, None),
    ]
    got = {r["doc_id"]: r["identity"] for r in identity.choose(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: "ABC-1-00001-2025-26", 2: "DEF-1-00002-2025-26", 3: "", 4: "RMN-1-02264-2024-25", 5: "", 6: ""}


@pytest.mark.parametrize(("text", "want"), [("house", "eng_Latn"), ("ಮನೆ", "kan_Knda"), ("रमेश कुमार मुख्य रस्ता", "mar_Deva"), ("घर में है", "hin_Deva"), ("வீடு", "tam_Taml"), ("560001", "eng_Latn"), (None, "eng_Latn")])
def test_language(spark, text, want):
    assert one(spark, language.language(F.col("t")), t=(text, "string")) == want


def test_latin_names(spark):
    assert language.latin_name("रमेश") == "ramesh"
    assert language.latin_name("ಮಂಜುನಾಥ") == "manjunatha"
    assert one(spark, language.transliterate(F.col("t")), t="Sri ಮಂಜುನಾಥ 12") == "Sri Manjunatha 12"


def test_dedupe_goes_before_names(spark):
    rows = [(1, "S", 1, "-", "123456789012", None, None), (1, "S", 2, "GOOD", "123456789012", None, None), (1, "B", 1, "GOOD", "123456789012", None, None)]
    got = export.dedupe(spark.createDataFrame(rows, "deed long, relation string, ordinal long, name string, aadhaar string, pan string, father string")).collect()
    assert [(r["relation"], r["ordinal"]) for r in got] == [("B", 1)]


@pytest.mark.parametrize(
    ("address", "want"),
    [("Sy No 6, Hoskote Taluk, Bangalore District", "Hoskote"), ("Taluka & Dist: Belgaum", "Belgaum"), ("Koramangala, Bangalore - 560 034", "Bangalore"), ("Kasaba Hobli", ""), (None, "")],
)
def test_town(spark, address, want):
    assert one(spark, places.city_town(F.col("a")), a=(address, "string")) == want


def test_levels_fall_only_past_the_margin():
    level, seen = "normal", []
    for free in (0.5, 0.2, 0.07, 0.10, 0.14, 0.19, 0.5):
        level = folds.next_level(free, level)
        seen.append(level)
    assert seen == ["normal", "elevated", "critical", "critical", "high", "high", "normal"]


def test_entry_imports_without_llm(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 44


def test_own_number_is_no_pin_code(spark):
    given = {"t": "Hobli, 150000", "n": 150000}
    assert one(spark, values.pin_code(F.col("t"), own=F.col("n")), **given) == ""
    assert one(spark, values.pin_code(F.col("t")), **given) == "150000"
    assert one(spark, values.pin_code(F.lit("No. 150000, Mysuru - 560001"), own=F.lit(150000)), **given) == "560001"


def test_report_takes_no_deed_for_a_pin_code(spark):
    from ledgerloom.plans import export

    deeds = spark.sql("SELECT 150001L AS deed, 1 AS serial, DATE '2025-01-01' AS deed_date, '' AS identity, 100L AS paise, '' AS property_text, 'Hobli, 150001' AS address, '' AS state, 1L AS stamp")
    parties = spark.sql("SELECT 150001L AS deed, 'S' AS relation, 1 AS ordinal, 1L AS person, 'A' AS name, '' AS aadhaar, '' AS pan, '' AS gender, '' AS father, '' AS address")
    assert export.rows(deeds, parties).first()["Postal Code"] == ""


def test_long_serials_keep_their_digits(spark):
    rows = [(1, "document number ABC-1-100000-2025-26", ""), (2, "document number ABC-1-000123-2025-26", ""), (3, "none", "XYZ-1-1234567-2024-25.pdf"), (4, "ABC-1-100123-2025-26 ABC-1-00123-2025-26", "")]
    got = {r["doc_id"]: r["identity"] for r in identity.choose(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: "ABC-1-100000-2025-26", 2: "ABC-1-00123-2025-26", 3: "XYZ-1-1234567-2024-25", 4: ""}


def test_texts_are_taken_one_by_one():
    """The batch isn't turned into Python strings; what is held beside it is the result."""
    texts = pa.array(["é" * 200_000 + str(k) if k % 3 else None for k in range(60)] + ["", "x"])
    tracemalloc.start()
    got = cleanup.one_by_one(texts, lambda t: t.upper() if t != "x" else None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.type == pa.string() and got.to_pylist() == [t and t.upper() for t in texts.to_pylist()[:-1]] + [None]
    assert peak < 2.5 * texts.nbytes, (peak, texts.nbytes)  # a list of strings and their results would add two more
    assert cleanup.one_by_one(texts[:0], str.upper).to_pylist() == [] and cleanup.one_by_one(texts[58:61], str.lower).to_pylist() == texts.to_pylist()[58:61]


def test_python_functions_get_arrow_batches(spark):
    shown = spark.createDataFrame([("é",)], "t string").select(cleanup.composed(F.col("t")).alias("a"), grounding.composed(F.col("t")).alias("b"), grounding.first_json(F.col("t")).alias("c"))
    plan = shown._jdf.queryExecution().analyzed().toString()
    assert tuple(shown.first()) == ("é", "é", None)
    assert {x.evalType for x in (cleanup._nfc, grounding.nfkc, grounding._first_json_anywhere)} == {PythonEvalType.SQL_SCALAR_ARROW_UDF} and "_nfc" in plan
