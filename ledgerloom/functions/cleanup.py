"""Cleaning of page text, as one composed column expression."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Page markers.
PAGE_LINE = r"(?m)^===== PAGE (\d+) =====$"
BANNER = r"(?im)^[=\-]{5,}[ \t]*\n[ \t]*PAGE[ \t]+(\d+)[ \t]*\n[=\-]{5,}[ \t]*$"
LOOSE_PAGE = r"(?im)^[=\- \t]*PAGE[ \t]+(\d+)[=\- \t]*$"


@dataclass(frozen=True)
class Options:
    markup: bool = True
    mask_ids: bool = False
    padding: bool = False
    page_markers: bool = True
    compose: bool = False


def line_ends(t: Column) -> Column:
    return F.regexp_replace(t, r"\r\n?", "\n")


def control(t: Column) -> Column:
    """Without characters of the other categories, line feed, tab and form feed excepted."""
    return F.regexp_replace(t, r"[\p{C}&&[^\n\t\f]]", "")


def page_markers(t: Column) -> Column:
    """Banners and bare page lines in one form; form feeds start pages; else the text is page 1."""
    by_feed = F.array_join(F.transform(F.split(t, "\f"), lambda p, i: F.concat(F.lit("===== PAGE "), (i + 1).cast("string"), F.lit(" =====\n"), p)), "\n")
    return (
        F.when(t.rlike(BANNER), F.regexp_replace(t, BANNER, "===== PAGE $1 ====="))
        .when(t.rlike(LOOSE_PAGE), F.regexp_replace(t, LOOSE_PAGE, "===== PAGE $1 ====="))
        .when(F.instr(t, "\f") > 0, by_feed)
        .otherwise(F.concat(F.lit("===== PAGE 1 =====\n"), t))
    )


def rules(t: Column) -> Column:
    return F.regexp_replace(t, r"(?m)^[=\-]{20,}[ \t]*$", "")


def markup(t: Column) -> Column:
    """Tags go, line breaks become spaces, fractions become text."""
    for pattern, new in ((r"(?i)<br\s*/?>", " "), (r"(\d)\s*\\frac\{(\d+)\}\{(\d+)\}", "$1 $2/$3"), (r"\\frac\{(\d+)\}\{(\d+)\}", "$1/$2"), (r"(?i)</?math[^>]*>", ""), (r"(?i)</?[a-z][^<>]*>", "")):
        t = F.regexp_replace(t, pattern, new)
    return t


def masked_ids(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)\b[Xx]{4}[\s-]*[Xx]{4}[\s-]*\d{4}\b", "")


def trailing_space(t: Column) -> Column:
    return F.regexp_replace(t, r"(?Um)[\s&&[^\n]]+$", "")


def padding(t: Column) -> Column:
    return F.regexp_replace(t, " {9,}", " " * 8)


def blank_lines(t: Column) -> Column:
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def clean(t: Column, options: Options = Options()) -> Column:  # noqa: B008
    """All steps in their fixed order; ends in one line feed."""
    t = control(line_ends(F.coalesce(t, F.lit(""))))
    t = composed(t) if options.compose else t
    t = page_markers(t) if options.page_markers else t
    t = rules(t)
    t = markup(t) if options.markup else t
    t = masked_ids(t) if options.mask_ids else t
    t = trailing_space(t)
    t = padding(t) if options.padding else t
    return F.concat(F.regexp_replace(blank_lines(t), r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_number, body) of marked text."""
    numbers = F.regexp_extract_all(F.col(text), F.lit(PAGE_LINE), F.lit(1))
    bodies = F.slice(F.split(F.col(text), PAGE_LINE), 2, 1_000_000)
    return docs.select(key, F.inline(F.transform(F.arrays_zip(numbers.alias("n"), bodies.alias("b")),
        lambda x: F.struct(x["n"].cast("int").alias("page_number"), F.regexp_replace(x["b"], r"^\n|\n$", "").alias("body")))))


def full_text(page_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages joined again under their markers, in order."""
    piece = F.concat(F.lit("===== PAGE "), F.col("page_number").cast("string"), F.lit(" =====\n"), F.col("body"))
    rows = F.sort_array(F.collect_list(F.struct("page_number", piece.alias("t"))))
    return page_rows.groupBy(key).agg(rows.alias("r")).select(key, F.array_join("r.t", "\n").alias("text"))


def boilerplate(lines: DataFrame, least_pages: int = 3, least_chars: int = 12) -> DataFrame:
    """lines: (doc_id, page, line). Lines, without space around them, on six tenths of a document's pages or more.

    Pages without a word don't count.
    """
    stripped = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).filter("line <> ''")
    total = stripped.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    once = stripped.filter(F.length("line") >= least_chars).dropDuplicates(["doc_id", "page", "line"])
    seen = once.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return seen.join(total, "doc_id").filter(F.col("n") >= F.greatest(F.lit(least_pages), F.floor(F.col("pages") * 6 / 10))).select("doc_id", "line", "n")


def without_headers(page_rows: DataFrame, key: str = "doc_id", least_pages: int = 3) -> DataFrame:
    """(key, page_number, body) without the lines that recur on most pages of a document."""
    lines = page_rows.select(key, "page_number", F.explode(F.split("body", "\n")).alias("line"))
    common = boilerplate(lines.select(F.col(key).alias("doc_id"), F.col("page_number").alias("page"), "line"), least_pages)
    # a line of six tenths of the pages: a document has few more of them than a page has lines
    lists = common.groupBy(F.col("doc_id").alias("_key")).agg(F.collect_set("line").alias("_common"))
    none = F.array().cast("array<string>")
    kept = F.filter(F.split("body", "\n"), lambda x: ~F.array_contains(F.coalesce("_common", none), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    found = page_rows.join(lists, F.col(key) == F.col("_key"), "left")
    return found.select(key, "page_number", F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("body"))


def composed(t: Column) -> Column:
    """Canonical composition, which Spark has no function for; plain ASCII stays in the JVM."""
    return F.coalesce(_nfc(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return one_by_one(texts, lambda t: unicodedata.normalize("NFC", t))


def one_by_one(texts: pa.Array, use: Callable[[str], str | None]) -> pa.Array:
    """``use`` of each text, null for null; one text at a time is a Python string, the others lie in the batch or in the result as UTF-8."""
    made, ends, there = bytearray(), [0], []
    for text in texts:
        found = use(text.as_py()) if text.is_valid else None
        there.append(found is not None)
        if found is not None:
            made += found.encode()
        ends.append(len(made))
    valid = pa.array(there, pa.bool_()).buffers()[1] if there else None
    return pa.Array.from_buffers(pa.large_string(), len(there), [valid, pa.array(ends, pa.int64()).buffers()[1], pa.py_buffer(made)]).cast(pa.string())


def fit(t: Column, budget: int = 40_000, marker: str = "\n[...]\n") -> Column:
    """Head and tail of a long text, three to two, within a budget of characters."""
    room = budget - len(marker)
    head = room * 6 // 10
    return F.when(F.length(t) <= budget, t).otherwise(F.concat(F.left(t, F.lit(head)), F.lit(marker), F.right(t, F.lit(room - head))))


def report(before: Column, after: Column) -> Column:
    """What a clean-up changed: sizes before and after, and what each rule had to do."""
    lines = lambda t: F.when(t == "", 0).otherwise(F.regexp_count(t, F.lit("\n")) + 1)
    pages = F.regexp_count(after, F.lit(r"(?m)^===== PAGE \d+ =====$"))
    rewritten = F.when(before.rlike(BANNER), F.regexp_count(before, F.lit(BANNER))).otherwise(F.regexp_count(before, F.lit(LOOSE_PAGE)))
    return F.struct(
        F.length(before).alias("chars_before"), F.length(after).alias("chars_after"), lines(line_ends(before)).alias("lines_before"), lines(after).alias("lines_after"),
        F.regexp_count(before, F.lit(r"\r\n?")).alias("line_ends"), F.regexp_count(line_ends(before), F.lit(r"[\p{C}&&[^\n\t\f]]")).alias("control"),
        F.regexp_count(before, F.lit(r"(?i)</?[a-z][^<>]*>")).alias("tags"), F.regexp_count(before, F.lit(r"(?m)^[=\-]{20,}[ \t]*$")).alias("rules"),
        F.regexp_count(before, F.lit(r"\n{3,}")).alias("blank_runs"), F.regexp_count(before, F.lit(" {9,}")).alias("padding"),
        F.regexp_count(before, F.lit(r"(?U)\b[Xx]{4}[\s-]*[Xx]{4}[\s-]*\d{4}\b")).alias("masked"),
        pages.alias("pages"), F.least(rewritten, pages).alias("markers_rewritten"), F.greatest(pages - rewritten, F.lit(0)).alias("markers_inserted"),
        F.when(F.length(before) > 0, 100 * (F.length(before) - F.length(after)) / F.length(before)).otherwise(0.0).alias("percent"),
    )


def summary(told: Column) -> Column:
    """A report in a line."""
    line = F.format_string("%,d -> %,d chars (%+.1f%%), %d pages, %d line ends, %d markers rewritten, %d inserted", told["chars_before"],
        told["chars_after"], told["percent"], told["pages"], told["line_ends"], told["markers_rewritten"], told["markers_inserted"])
    return F.concat(line, F.when(told["tags"] > 0, F.format_string(", %d tags removed", told["tags"])).otherwise(""))
