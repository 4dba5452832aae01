"""Layout, nested answers, recognition answers, cached translation, stages as a stream, callbacks."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.functions import nested
from ledgerloom.operators import layout, translation
from ledgerloom.session import Scratch
from ledgerloom.sources import files
from ledgerloom.streaming import callbacks, stages


def plain_page(lines, page_width, width=120):
    rows = []
    for x0, y0, x1, y1, text in sorted(lines, key=lambda b: (b[1], b[0], b[4])):
        for row in rows:
            top, bottom = min(b[1] for b in row), max(b[3] for b in row)
            slack = max((bottom - top) * 0.35, 10.0)
            if top - slack <= (y0 + y1) / 2 <= bottom + slack:
                row.append((x0, y0, x1, y1, text))
                break
        else:
            rows.append([(x0, y0, x1, y1, text)])
    out = []
    for row in sorted(rows, key=lambda r: min(b[1] for b in r)):
        line = ""
        for b in sorted(row, key=lambda b: b[0]):
            at = int(b[0] * width / max(1, page_width))
            line += " " * (at - len(line)) + b[4]
        out.append(line.rstrip())
    return "\n".join(out)


def test_pages_keep_their_columns(spark):
    rng = random.Random(3)
    pages, rows = {}, []
    for doc in range(12):
        for page in range(3):
            own = []
            for _ in range(rng.randint(1, 40)):
                x, y = rng.randint(0, 900), rng.randint(0, 600) + rng.random()
                own.append((float(x), y, x + 50.0, y + rng.choice([8, 14, 40]), rng.choice(["ab", "ಮನೆ 12", "a longer text of a line "]) + str(len(own))))
            pages[doc, page] = plain_page(own, 1000)
            rows += [(doc, page, 1000, *b) for b in own]
    rows += [(99, 0, 1000, None, 1.0, 2.0, 3.0, "no box"), (99, 1, 0, 5.0, 1.0, 2.0, 3.0, "x")]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "doc_id long, page int, page_width int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(r["doc_id"], r["page"]): r["text"] for r in layout.pages(lines.repartition(3), ["doc_id", "page"]).collect()}
    assert got.pop((99, 1)) == " " * 600 + "x" and got == pages
    assert layout.pages(lines.filter(F.lit(False)), ["doc_id", "page"]).count() == 0


def test_rows_of_long_pages():
    """As the plain search over all rows so far; a page of many rows takes time in proportion to its lines."""
    rng = np.random.default_rng(7)
    for n, tall in ((1, 5), (60, 400), (300, 30), (300, 3000)):
        tops = np.sort(rng.integers(0, n * 9, n)).astype(float)
        bottoms = tops + rng.integers(-15, tall, n)  # some boxes stand upside down
        want, bands = [], []
        for top, bottom in zip(tops, bottoms, strict=True):
            fits = [k for k, (a, b) in enumerate(bands) if a - max((b - a) * 0.35, 10) <= (top + bottom) / 2 <= b + max((b - a) * 0.35, 10)]
            k = fits[0] if fits else len(bands)
            bands[k:k + 1] = [(min(bands[k][0], top), max(bands[k][1], bottom)) if fits else (top, bottom)]
            want.append(k)
        assert layout.rows_of(tops, bottoms).tolist() == want
    took = []
    for n in (20_000, 160_000):
        tops = np.arange(n) * 25.0
        began = time.process_time()
        assert layout.rows_of(tops, tops + 12)[-1] == n - 1
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.01)


def leaves(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from leaves(v, f"{path}[{k}]")
    else:
        yield path, "" if value is None else str(value).strip() if not isinstance(value, bool) else str(value).lower()


def test_any_answer_is_flattened(spark):
    answers = [
        {"seller_details": [{"name": " Asha ", "age": 41, "new": {"deep": [1, [2, None]]}}, {}], "unknown": True, "none": None, "x": 1.5},
        {"a": {"b": {"c": "ಮನೆ"}}, "list": []}, {}, {"path": "p", "value": "v"},
    ]
    rows = [(k, json.dumps(a)) for k, a in enumerate(answers)] + [(90, "no json"), (91, None), (92, "{broken")]
    got = nested.flatten(spark.createDataFrame(rows, "doc long, answer string"), ["doc"], F.col("answer"))
    want = {(k, p, v) for k, a in enumerate(answers) for p, v in leaves(a)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    other = spark.createDataFrame([(3, "path", "q"), (3, "more", "z")], "doc long, path string, value string")
    told = {(r["path"], r["a"], r["b"], r["same"]) for r in nested.differences(got.filter("doc = 3"), other, ["doc"]).collect()}
    assert told == {("path", "p", "q", False), ("value", "v", "", False), ("more", "", "z", False)}
    deep = spark.createDataFrame([(1, json.dumps({"a": {"b": {"c": 1}}}))], "doc long, answer string")
    assert [tuple(r) for r in nested.flatten(deep, ["doc"], F.col("answer"), 2).collect()] == [(1, "a.b", '{"c":1}')]


def test_leaves_are_read_once(spark):
    rows = [(1, json.dumps({"a": {"b": "{}", "c": {}, "d": [[], [None, "[]"]]}, "e": [{"f": 1e3, "g": True}], "": {"h": ""}, "i": {"": 2.50}})), (2, "null"), (3, "[1, [2]]"), (4, '"text"')]
    given = spark.createDataFrame(rows, "doc long, answer string")
    found = nested.flatten(given, ["doc"], F.col("answer"))
    assert sorted(map(tuple, found.collect())) == sorted([
        (1, "a.b", "{}"), (1, "a.d[1][0]", ""), (1, "a.d[1][1]", "[]"), (1, "e[0].f", "1000"), (1, "e[0].g", "true"), (1, "h", ""), (1, "i.", "2.5"), (3, "[0]", "1"), (3, "[1][0]", "2"),
    ])
    for depth, want in ((1, [(3, "[0]", "1"), (3, "[1]", "[2]")]), (2, [(3, "[0]", "1"), (3, "[1][0]", "2")])):
        assert sorted(map(tuple, nested.flatten(given.filter("doc = 3"), ["doc"], F.col("answer"), depth).collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "map<string,variant>" not in plan and "array<variant>" not in plan  # no child is built anew at every level


def test_answers_of_recognition(spark, tmp_path):
    text = "x" * 50
    given = {
        "good": json.dumps({"text": text, "lines": [[0, 0.5, 1, 0.75, " a "], [0, 0, 2, 1, "out"], [0, 0, 1, 1, " "], ["x", 0, 1, 1, "b"], [0, 0, 1]]}), "noise": f"loading {json.dumps({'text': text})}",
        "short": json.dumps({"text": "few"}), "torn": '{"text": "abc', "none": " ", "other": '{"pages": 3}', "with space": json.dumps({"text": text}),
    }
    for name, body in given.items():
        (tmp_path / f"{name}.json").write_text(body)
    got = {r["document"]: r for r in files.recognised_files(spark, f"file://{tmp_path}").collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "good": None, "noise": None, "with space": None, "short": "only 3 characters across 1 pages: no usable text layer", "torn": "no JSON object in the answer", "none": "no JSON object in the answer", "other": "no text in the answer",
    }
    assert [tuple(x) for x in got["good"]["lines"]] == [(0.0, 0.5, 1.0, 0.75, "a")] and got["good"]["bad_lines"] == 4 and got["noise"]["lines"] == []


def test_a_second_run_asks_for_nothing(spark, tmp_path):
    asked = []

    def runner(items):
        asked.append(sorted(r["text"] for r in items.collect()))
        return items.select("id", F.when(~F.col("text").contains("ಎ"), F.concat(F.lit(" EN "), F.col("text"))).alias("text"))

    rows = [(1, "ರಾಜು"), (2, "ರಾಜು"), (3, None), (4, ""), (5, "560001"), (6, "plain"), (7, "ಎ"), (8, "राम")]
    items = spark.createDataFrame(rows, "id long, text string")
    known = translation.cache(spark, f"file://{tmp_path}/cache", 4)
    first = {r["id"]: r for r in translation.translate(items, known, runner, Scratch(spark, "t")).collect()}
    assert asked == [["राम", "ಎ", "ರಾಜು"], ["ಎ"]]
    assert {k: (r["translated"], r["from_cache"], r["attempts"], r["error"]) for k, r in first.items()} == {
        1: ("EN ರಾಜು", False, 1, None), 2: ("EN ರಾಜು", False, 1, None), 3: (None, None, None, None), 4: (None, None, None, None), 5: (None, None, None, None), 6: (None, None, None, None),
        7: (None, False, 2, translation.NOTHING), 8: ("EN राम", False, 1, None),
    }
    asked.clear()
    known = translation.cache(spark, f"file://{tmp_path}/cache", 4)
    second = {r["id"]: r for r in translation.translate(items.filter("id <> 7"), known, runner, Scratch(spark, "t")).collect()}
    assert asked == [[]] and second[1]["from_cache"] and second[8]["translated"] == "EN राम" and second[3]["translated"] is None
    hindi = translation.translate(items.filter("id = 6"), known, runner, Scratch(spark, "t"), "hin_Deva").first()
    assert hindi["translated"] == "EN plain" and not hindi["from_cache"]


def test_repair_writes_what_is_lacking(spark, tmp_path):
    docs = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, batch_id long")
    people = spark.createDataFrame([(1, "B", 1, "ರಾಜು", None), (1, "S", 1, "Asha", ""), (2, "B", 1, "ರಾಜು", "had"), (3, "B", 1, "राम", None), (3, "B", 2, None, None)], "document_id long, relation string, ordinal int, name string, name_translated string")
    run = lambda items: items.select("id", F.concat(F.lit("EN "), "text").alias("text"))
    known = translation.cache(spark, f"file://{tmp_path}/cache", 4)
    got = {(r["document_id"], r["relation"], r["ordinal"]): (r["name_translated"], r["written"]) for r in translation.repair(docs, people, known, run, Scratch(spark, "t")).collect()}
    assert got == {(1, "B", 1): ("EN ರಾಜು", True), (1, "S", 1): ("Asha", True), (2, "B", 1): ("had", False), (3, "B", 1): ("EN राम", True), (3, "B", 2): (None, False)}


def test_repeated_texts_are_looked_at_once(spark, tmp_path):
    names = ["ರಾಜು", "राम", "-", "", "Asha", None]
    rows = [(k // 2, "BS"[k % 2], 1, names[k % 6], names[(k + 1) % 6], "had" if k % 5 == 0 else None, None) for k in range(120)]
    people = spark.createDataFrame(rows, "document_id long, relation string, ordinal int, name string, father string, name_translated string, father_translated string")
    docs = spark.createDataFrame([(k, k % 2) for k in range(60)], "id long, batch_id long")
    run = lambda items: items.filter("text <> 'राम'").select("id", F.concat(F.lit("EN "), "text").alias("text"))
    scratch = Scratch(spark, "t")
    fixed = translation.repair(docs, people, translation.cache(spark, f"file://{tmp_path}/cache", 4), run, scratch, 1, ("name", "father")).collect()
    assert spark.read.parquet(scratch.path("detected")).count() == 5  # of 200 cells
    shown = {"ರಾಜು": "EN ರಾಜು", "-": "-", "Asha": "Asha"}
    lacking = {d for d, _, _, name, _, had, _ in rows if name and not had and d % 2}
    want = {(d, r, o): (had or (d in lacking and shown.get(n)) or None, (d in lacking and shown.get(f)) or None) for d, r, o, n, f, had, _ in rows}
    assert {(r.document_id, r.relation, r.ordinal): (r.name_translated, r.father_translated) for r in fixed} == want and len(fixed) == len(rows)
    assert {(r.document_id, r.relation) for r in fixed if r.written} == {k[:2] for k, v in want.items() if v != (next(x[5] for x in rows if x[:3] == k), None)}


def fold(rows, limits, idle, last):
    out = {}
    for doc, _, ts, ok, retryable in sorted(rows, key=lambda r: (r[2], r[1])):
        state, seen = out.get(doc, (("ocr", 0, "pending", ""), None))
        if state[2] not in stages.FINAL:
            out[doc] = (stages.answer(state, ok, retryable, limits), ts)
    return {d: (s[0], max(0, s[1] - 1), "stalled", s[3]) if s[2] not in stages.FINAL and seen + idle <= last else s for d, (s, seen) in out.items()}


def test_stages_as_a_stream_equal_a_fold(spark, tmp_path):
    rng, begin = random.Random(5), datetime(2024, 1, 1)
    rows = [(rng.randint(1, 25), k, begin + timedelta(minutes=k), rng.random() < 0.7, rng.random() < 0.9) for k in range(200)]
    schema = "document long, id long, ts timestamp, ok boolean, retryable boolean"
    for k in range(0, 200, 70):  # three micro-batches
        spark.createDataFrame(rows[k : k + 70], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    listener = callbacks.Listener()
    spark.streams.addListener(listener)
    got = stages.run(spark, callbacks.observed(stream, "answers", {"n": lambda: F.count(F.lit(1)), "failed": lambda: F.count_if(~F.col("ok"))}), f"file://{tmp_path}/out", idle_ms=3_600_000)
    found = {r["document"]: (r["stage"], r["attempts"], r["status"], r["reason"]) for r in got.collect()}
    assert found == fold(rows, stages.LIMITS, timedelta(hours=1), rows[-1][2])
    assert {s[2] for s in found.values()} >= {"processed", "failed"}
    for _ in range(50):
        if sum(json.loads(v)["n"] for v in listener.rows.values()) >= 200:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    n = listener.write(spark, f"file://{tmp_path}/told")
    told = spark.read.parquet(f"file://{tmp_path}/told").collect()
    assert len(told) == n >= 3 and sum(json.loads(r["figures"])["n"] for r in told) == 200 and sum(json.loads(r["figures"])["failed"] for r in told) == sum(not r[3] for r in rows)


def test_a_batch_is_done_once(spark):
    frame = lambda rows: spark.createDataFrame(rows, "batch_id long, overall_state string")
    a = frame([(1, "processing"), (2, "processing"), (3, "processed")])
    b = frame([(1, "processed"), (2, "processing"), (3, "processed")])
    assert [r["batch_id"] for r in callbacks.newly_done(a, b).collect()] == [1] and callbacks.newly_done(b, b).count() == 0
    rows, seen = callbacks.measured(b.withColumnRenamed("overall_state", "status"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"documents": 3, "failed": 0, "processed": 2}


def test_stages_can_be_stood_in_for(spark, tmp_path):
    from ledgerloom.streaming import progress

    docs = spark.createDataFrame([(1, "x" * 50), (2, "short"), (3, None)], "doc_id long, text string")
    seen = {r["doc_id"]: (r["state"], r["reason"]) for r in progress.through_stages(docs, {"validate": lambda d: d.select("doc_id", F.lit("double").alias("state"))}).collect()}
    assert seen[1] == ("double", None) and seen[2][0] == seen[3][0] == "failed" and seen[3][1] == "OCR produced no text"
    docs.write.parquet(f"file://{tmp_path}/in")
    doubles = {"gate": lambda d: d.withColumn("reason", F.lit(None).cast("string")), "extract": lambda d: d, "validate": lambda d: d.select("doc_id", F.coalesce("text", F.lit("none")).alias("state"))}
    progress.process_documents(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check", doubles)
    assert {r["doc_id"]: r["state"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {1: "x" * 50, 2: "short", 3: "none"}
