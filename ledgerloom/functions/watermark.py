"""Whether a piece of text on a page is a stamp rather than content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stamps say.
WORDS = (
    "watermark", "draft", "copy", "specimen", "sample", "duplicate", "not for sale", "confidential", "preview", "demo", "trial",
    "unregistered", "evaluation", "e-stamp", "certified true copy", "government purpose", "government use", "official use",
    "official purpose", "purpose only", "not valid", "for reference", "office copy", "free of cost", "computer generated",
    "digitally signed", "ಸರ್ಕಾರಿ", "ಕಚೇರಿ ಪ್ರತಿ",
)
#: A stamp's text is at most so long; a phrase has so many characters and words; a stamp's share of pages, and its grey.
MOST_CHARS, LEAST_CHARS, LEAST_WORDS, SHARE, FAINT = 80, 12, 2, 0.6, 0x99
LARGE = 18.0


def says_watermark(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (t != "") & (F.length(t) <= MOST_CHARS) & F.exists(F.array(*[F.lit(w) for w in WORDS]), lambda w: F.contains(t, w))


def is_rotated(dx: Column, dy: Column) -> Column:
    """Set at an angle to the lines of the page."""
    return (F.abs(dy) > 0.05) | (dx < 0.95)


def is_faint(colour: Column) -> Column:
    """A light grey; colour is red, green and blue in one number."""
    parts = [F.shiftright(colour, k).bitwiseAND(255) for k in (16, 8, 0)]
    return F.coalesce((colour > 0) & (F.least(*parts) >= FAINT), F.lit(False))


def is_phrase(text: Column) -> Column:
    """Long enough to be a phrase, and no number."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) >= LEAST_CHARS) & (F.size(F.split(t, r"\s+")) >= LEAST_WORDS) & ~F.replace(t, F.lit(" "), F.lit("")).rlike(r"^\d+$")


def overlays(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """spans: doc_id, page, text, dx, dy, colour, size; pages: doc_id, page_count. Texts that repeat as stamps do.

    A text counts once a page. It is a finding if it is on enough pages and says so itself,
    or is a phrase that is set at an angle, faint or large.
    """
    odd = is_rotated(F.col("dx"), F.col("dy")) | is_faint(F.col("colour")) | (F.col("size") >= LARGE)
    t = F.trim("text")
    seen = spans.filter(t != "").groupBy("doc_id", t.alias("text")).agg(F.sort_array(F.collect_set("page")).alias("pages"), F.max(odd).alias("odd"))
    found = seen.join(pages, "doc_id").filter(F.size("pages") >= F.greatest(F.lit(2), F.floor(F.col("page_count") * SHARE)))
    return found.filter(says_watermark(F.col("text")) | (is_phrase(F.col("text")) & F.col("odd"))).select("doc_id", "text", F.size("pages").alias("n_pages"), "pages")


def sorted_findings(findings: DataFrame) -> DataFrame:
    """findings: doc_id, kind, fidelity, pages. Per document: confirmed, removable without loss, and pages that are only pictures."""
    return findings.groupBy("doc_id").agg(
        F.count_if(F.col("kind") != "raster").alias("confirmed"),
        F.count_if(F.col("fidelity") == "lossless").alias("removable"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == "raster", F.col("pages")))))).alias("scanned_pages"),
    )
