"""Registration numbers: candidates with their places, evidence, and the choice of one."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# The number's form, and words before it that speak for or against it.
CANONICAL = r"^[A-Z]{2,4}-\d-(?:\d{5}|[1-9]\d{5,8})-\d{4}-\d{2}$"
FORM = r"\b([A-Z0-9]{2,4})\s*[-–—.]\s*(\d)\s*[-–—.]\s*(\d{4,9})\s*[-–—.]\s*(\d{4})\s*[-–—.]\s*(\d{2})\b"
LABELS = ("ದಸ್ತಾವೇಜು ಸಂಖ್ಯೆ", "ದಸ್ತಾವೇಜು ಸಂ", "ನಂಬರ", "ದಸ್ತಾವೇಜು ಕ್ರಮಾಂಕ", "ಪುಸ್ತಕದ ದಸ್ತಾವೇಜು", "ನೋಂದಾಯಿಸಿ", "ನೋಂದಣಾಧಿಕಾರಿ", "document number", "document no", "doc number")
PRIOR = ("vide doc", "vide document", "registered as document", "registered as doc", "earlier document", "previous document", "vide no",
    "as per document", "mother deed", "parent document", "ಮೂಲ ದಸ್ತಾವೇಜು")
BEFORE = 90
CANDIDATE = ArrayType(StructType([StructField("value", StringType()), *(StructField(f, IntegerType()) for f in ("year", "position", "line"))]))


@F.pandas_udf(CANDIDATE)
def candidates(texts: pd.Series) -> pd.Series:
    """All candidates of a text in order, in canonical form, with place and line."""
    form, letters = re.compile(FORM), str.maketrans("0158", "OISB")

    def find(text: str | None) -> list[dict]:
        out = []
        for m in form.finditer(text or ""):
            office, series, serial, year, tail = m.groups()
            if any(c.isalpha() for c in office):
                number = str(int(serial)).zfill(5)  # significant digits stay, however many
                out.append({"value": f"{office.translate(letters)}-{series}-{number}-{year}-{tail}", "year": int(year), "position": m.start(), "line": text.count("\n", 0, m.start()) + 1})
        return out

    return texts.map(find)


def from_file_name(path: Column) -> Column:
    """The file's stem if it is a canonical number, else an empty string."""
    stem = F.trim(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]+?)(\.[^./\\]*)?$", 1))
    return F.when(stem.rlike(CANONICAL), stem).otherwise("")


def scored(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). A row per candidate with the evidence summed up."""
    rows = docs.select("doc_id", "text", F.inline(candidates("text")))
    of = Window.partitionBy("doc_id")
    before = F.lower(F.expr(f"substring(text, greatest(1, position - {BEFORE - 1}), least({BEFORE}, position))"))
    says = lambda words: F.coalesce(F.greatest(*[F.contains(before, F.lit(w)).cast("int") for w in words]), F.lit(0))
    same = F.count("*").over(Window.partitionBy("doc_id", "value"))
    last = F.greatest(F.max("position").over(of), F.lit(1))
    score = (
        F.when(F.col("year") == F.max("year").over(of), 5.0).otherwise(-3.0)
        + 4.0 * says(LABELS)
        - 5.0 * says(PRIOR)
        + F.when(same > 1, F.least(F.lit(2.0), 0.5 * same)).otherwise(0.0)
        + (1.0 - F.col("position") / last)
    )
    return rows.withColumn("score", score).drop("text")


def choose(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, source). The number, its confidence and why, for every document."""
    rows = scored(docs)
    best = rows.groupBy("doc_id").agg(F.max_by("value", F.struct("score", -F.col("position"))).alias("best"), F.max("score").alias("top"),
        F.countDistinct("value").alias("kinds"), F.collect_set("value").alias("all"))
    second = rows.join(best.select("doc_id", "best"), "doc_id").filter(F.col("value") != F.col("best")).groupBy("doc_id").agg(F.max("score").alias("next"))
    named = docs.select("doc_id", from_file_name(F.col("source")).alias("name"))
    found = named.join(best, "doc_id", "left").join(second, "doc_id", "left")
    lead = F.col("top") - F.col("next")
    confidence = (
        F.when(F.col("best").isNull(), F.when(F.col("name") != "", 0.6).otherwise(0.0))
        .when(F.col("kinds") == 1, 0.95).when(lead >= 5.0, 0.85).when(lead >= 2.0, 0.7)
        .when(F.array_contains("all", F.col("name")), 0.8).otherwise(0.0)
    )
    value = F.when(F.col("best").isNull(), F.col("name")).when(confidence == 0.8, F.col("name")).when(confidence > 0, F.col("best")).otherwise("")
    return found.select("doc_id", F.when(value.rlike(CANONICAL), value).otherwise("").alias("identity"),
        F.when(value.rlike(CANONICAL), confidence).otherwise(0.0).alias("confidence"), F.coalesce("kinds", F.lit(0)).alias("kinds"))


def page_of(text: Column, position: Column) -> Column:
    """The number of the last page marker before a place."""
    return F.try_element_at(F.regexp_extract_all(F.left(text, position), F.lit(r"(?i)=+\s*PAGE\s+(\d+)\s*=+"), F.lit(1)), F.lit(-1)).try_cast("int")


def pages_to_read(page_count: Column, depth: int = 2) -> Column:
    """The first and last pages, without repeats."""
    ends = F.concat(F.sequence(F.lit(1), F.lit(depth)), F.sequence(page_count - depth + 1, page_count))
    return F.when(page_count <= 0, F.array().cast("array<int>")).when(page_count <= 2 * depth, F.sequence(F.lit(1), F.greatest(page_count, F.lit(1)))).otherwise(ends)


def certificate_pages(pages: DataFrame, depth: int = 2) -> DataFrame:
    """pages: doc_id, page_number, body, page_count. The first and last pages, where certificates stand."""
    return pages.filter(F.array_contains(pages_to_read(F.col("page_count"), depth), F.col("page_number")))


def pages_without_text(pages: DataFrame, least: int = 40) -> DataFrame:
    """Pages with fewer characters than a page of text has."""
    return pages.filter(F.length(F.trim(F.coalesce("body", F.lit("")))) < least)


def second_chance(docs: DataFrame, pages: DataFrame, depth: int = 2) -> DataFrame:
    """docs as for ``choose``; a document without a number gets that of its certificate pages, read again in order."""
    body = F.array_join(F.sort_array(F.collect_list(F.struct("page_number", "body")))["body"], "\n")
    again = choose(certificate_pages(pages, depth).groupBy("doc_id").agg(body.alias("text")).withColumn("source", F.lit("")))
    first = choose(docs)
    both = first.join(again.select("doc_id", F.col("identity").alias("_identity"), F.col("confidence").alias("_confidence")), "doc_id", "left")
    none = (F.col("identity") == "") & F.col("_identity").isNotNull()
    return both.select("doc_id", F.when(none, F.col("_identity")).otherwise(F.col("identity")).alias("identity"),
        F.when(none, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        (none & (F.col("_identity") != "")).alias("from_pages"))
