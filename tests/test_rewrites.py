"""Table rewrites on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import rewrites


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_inserts_upserts_and_replacements(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    new = spark.createDataFrame([("b", 9), ("c", 5), ("c", 4)], "k string, v long")
    assert rows(rewrites.insert_new(old, new, ["k"], ["v"]), "k", "v") == [("a", 1), ("b", 2), ("c", 4)]
    assert rows(rewrites.upsert(old, new, ["k"], ["v"]), "k", "v") == [("a", 1), ("b", 9), ("c", 5)]
    assert rows(rewrites.replace_children(old, new, "k"), "k", "v") == [("a", 1), ("b", 9), ("c", 4), ("c", 5)]
    once = rewrites.upsert(old, new, ["k"], ["v"])
    assert rows(rewrites.upsert(once, new, ["k"], ["v"]), "k", "v") == rows(once, "k", "v")


def test_fill_keeps_what_has_no_translation(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, name string")
    new = spark.createDataFrame([(1, "X"), (2, "")], "k long, name string")
    assert rows(rewrites.fill(old, new, ["k"], ["name"]), "k", "name", "written") == [(1, "X", True), (2, "y", False), (3, None, False)]


def test_cascade_follows_the_links(spark):
    tables = {
        "batches": spark.createDataFrame([(1,), (2,)], "id long"),
        "documents": spark.createDataFrame([(10, 1), (20, 2)], "id long, batch_id long"),
        "pages": spark.createDataFrame([(100, 10), (200, 20)], "id long, document_id long"),
    }
    out = rewrites.cascade(tables, spark.createDataFrame([(1,)], "id long"), [("batches", "id", "documents", "batch_id"), ("documents", "id", "pages", "document_id")])
    assert rows(out["batches"], "id") == [(2,)] and rows(out["documents"], "id") == [(20,)] and rows(out["pages"], "id") == [(200,)]


def test_claims_and_recovery(spark):
    cols = "id long, overall_state string, ocr_state string, ocr_attempts long, extract_state string, extract_attempts long, translate_state string, validate_state string"
    docs = spark.createDataFrame(
        [(1, "processing", "done", 1, "pending", 0, "pending", "pending"), (2, "processing", "done", 1, "pending", 3, "pending", "pending"), (3, "processing", "pending", 0, "pending", 0, "pending", "pending"), (4, "failed", "done", 1, "pending", 0, "pending", "pending")], cols
    )
    claimed = rewrites.claim(docs, "extract", 2)
    assert rows(claimed.filter("claimed"), "id", "extract_state", "extract_attempts") == [(1, "running", 1)]
    back = rewrites.release_running(claimed.drop("claimed"))
    assert rows(back, *docs.columns) == rows(docs, *docs.columns)
    state = lambda s, n, asked: spark.range(1).select(rewrites.next_batch_state(F.lit(s), F.lit(n), asked).alias("x")).first()["x"]
    assert [state("queued", 0, "stop"), state("running", 2, "stop"), state("running", 0, "stop"), state("draft", 0, "stop"), state("stopping", 0, "settle"), state("stopped", 0, "run")] == ["stopped", "stopping", "stopped", None, "stopped", "queued"]


def test_paths_and_serials(spark):
    schema = "e struct<buyer_details:array<struct<name:string,pan:string>>,property_details:struct<state:string>>"
    df = spark.createDataFrame([(([("A", "P"), ("B", None)], ("KA",)),)], schema)
    got = df.select(rewrites.flatten(F.col("e"), {"buyer_details": ["name", "pan"]}, {"property_details": ["state"]}).alias("m")).first()["m"]
    assert got == {"buyer_details[1].name": "A", "buyer_details[2].name": "B", "buyer_details[1].pan": "P", "buyer_details[2].pan": None, "property_details.state": "KA"}
    names = spark.createDataFrame([("RMN-1-02264-2024-25",), ("deed 275",), ("none",)], "s string")
    assert [r["x"] for r in names.select(rewrites.expected_serial(F.col("s")).alias("x")).collect()] == ["02264", "00275", ""]
