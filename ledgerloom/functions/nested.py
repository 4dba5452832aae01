"""Nested answers of any shape as paths and values, and answers of recognition engines.

Paths are dotted, positions in lists count from 0: ``seller_details[0].name``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 8
LINE = "array<array<string>>"


def text_of(value: Column) -> Column:
    """A variant as text: JSON for objects and lists, empty for null; null for empty objects and lists, which have no leaf."""
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.when(~F.is_variant_null(value), F.to_json(value)), F.lit(""))
    return F.when(text.isin("{}", "[]") & F.to_json(value).isin("{}", "[]"), F.lit(None)).otherwise(text)


def flatten(rows: DataFrame, keys: list[str], answer: Column, depth: int = DEPTH) -> DataFrame:
    """keys, path and value (trimmed text; null is empty) for every leaf of a JSON text; names of fields needn't be known.

    Each level is one explode of the level before, so rows are neither shuffled nor read
    again; a leaf is read once and passes the levels below as its text. What lies deeper than
    ``depth`` levels is told as its JSON text; empty objects and lists, and texts that aren't
    JSON, have no leaf.
    """
    names, spark, c = [f"_{k}" for k in range(len(keys))], rows.sparkSession, F.col
    at = rows.select(*[c(k).alias(n) for k, n in zip(keys, names, strict=True)], F.lit("").alias("path"), F.try_parse_json(answer).alias("held"), F.lit(None).cast("string").alias("text")).filter("held IS NOT NULL")
    for _ in range(depth):
        children = at.lateralJoin(spark.tvf.variant_explode_outer(c("held").outer()))
        path = F.when(c("pos").isNull(), c("path")).when(c("key").isNull(), F.concat("path", F.lit("["), c("pos").cast("string"), F.lit("]"))).when(c("path") == "", c("key")).otherwise(F.concat("path", F.lit("."), "key"))
        read = F.when(c("pos").isNull() & c("held").isNotNull(), text_of(c("held"))).otherwise(c("text"))
        at = children.select(*names, path.alias("path"), c("value").alias("held"), read.alias("text"))
    told = at.withColumn("text", F.when(c("held").isNull(), c("text")).otherwise(text_of(c("held")))).filter("text IS NOT NULL AND path <> ''")
    return told.select(*[c(n).alias(k) for k, n in zip(keys, names, strict=True)], "path", F.trim("text").alias("value"))


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two flattened sets of answers: a row for each path of either, and whether they agree; a path that one lacks is empty there."""
    joined = left.withColumnRenamed("value", "a").join(right.withColumnRenamed("value", "b"), [*keys, "path"], "full_outer")
    return joined.fillna("", ["a", "b"]).withColumn("same", F.col("a") == F.col("b"))


def recognised(raw: Column) -> Column:
    """An engine's answer {text, lines}: its text, the boxes of its lines, and the reason why it can't be used, null if it can.

    A line is [x0, y0, x1, y1, text] with fractions of the page; lines that aren't are left
    out. Noise before the object, as engines print it, is skipped.
    """
    found = F.try_parse_json(F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*", 0), F.lit("")))
    text = F.try_variant_get(found, "$.text", "string")
    lines = F.coalesce(F.try_variant_get(found, "$.lines", LINE), F.array().cast(LINE))
    number = lambda x, k: F.get(x, k).try_cast("double")
    inside = lambda x, k: F.coalesce(number(x, k).between(0, 1), F.lit(False))
    fine = F.filter(lines, lambda x: (F.size(x) == 5) & inside(x, 0) & inside(x, 1) & inside(x, 2) & inside(x, 3) & (F.trim(F.coalesce(F.get(x, 4), F.lit(""))) != ""))
    boxes = F.transform(fine, lambda x: F.struct(*[number(x, k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))], F.trim(F.get(x, 4)).alias("text")))
    reason = F.when(found.isNull(), "no JSON object in the answer").when(text.isNull(), "no text in the answer")
    return F.struct(text.alias("text"), boxes.alias("lines"), (F.size(lines) - F.size(fine)).alias("bad_lines"), reason.alias("reason"))
