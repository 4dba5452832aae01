"""Checks of extracted values against their source text, and the verdict on a document."""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions import cleanup
from ledgerloom.functions.language import let
from ledgerloom.functions.values import ISO_DATE, PAN_ANYWHERE, aadhaar_valid, amount, digits, pan_valid

# Where a fee is named, and which flags mean that a value isn't grounded.
FEE_PATTERNS = (
    r"(?i)(?:registration|regn\.?)\s*(?:fee|fees|charges?)\s*[:\-]?\s*(?:rs\.?|₹|inr)?\s*([\d,.\-]+)",
    r"ನೋಂದಣಿ\s*ಶುಲ್ಕ\s*[:\-]?\s*(?:ರೂ\.?)?\s*([\d,.\-]+)",
    r"(?i)reg\.?\s*fee\s*(?:rs\.?|₹)?\s*([\d,.\-]+)",
)
GROUNDING_FLAGS = ("WRONG_CONSIDERATION", "WRONG_STAMP_VALUE", "WRONG_AADHAAR", "HALLUCINATED_PAN", "PAN_AADHAAR_FAR", "SCHEMA_INVALID", "TRUNCATED")
COVERAGE, UNMATCHED, NEAR, FEE_FROM, FEE_TO = 0.6, 2, 250, 100, 1_000_000


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility composition, which Spark has no function for."""
    return cleanup.one_by_one(texts, lambda t: unicodedata.normalize("NFKC", t))


def composed(text: Column) -> Column:
    """Compatibility composition; plain ASCII needs none, and only other text goes to Python."""
    t = F.coalesce(text, F.lit(""))
    return F.coalesce(nfkc(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)


def match_form(text: Column) -> Column:
    """Composed, in upper case, without white space and separators."""
    return bare_form(composed(text))


def bare_form(text: Column) -> Column:
    """A composed text in upper case, without white space and separators."""
    return F.upper(F.regexp_replace(text, r"(?U)[\s\-.,:;/\\|_()\[\]{}]+", ""))


@F.arrow_udf(StringType())
def _first_json_anywhere(texts: pa.Array) -> pa.Array:
    """The first complete JSON object within a model's answer, as text; null without one.

    Decoding is tried at each opening brace; one inside a failed object is tried in turn.
    """
    decode = json.JSONDecoder().raw_decode

    def find(t: str) -> str | None:
        at = t.find("{")
        while at >= 0:
            try:
                found, _ = decode(t, at)
                return json.dumps(found, ensure_ascii=False)
            except ValueError:
                at = t.find("{", at + 1)
        return None

    return cleanup.one_by_one(texts, find)


def object_at_brace(text: Column) -> Column:
    """The object (a variant) that begins at the first brace of an answer; null where none does."""
    return F.try_parse_json(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*", 0), F.lit("")))


def first_json(text: Column, found: Column | None = None) -> Column:
    """The first complete JSON object within a model's answer, as text; null without one.

    Spark's parser reads the object that begins at the first brace and stops at its end; only
    answers that have none there go to Python. ``found`` is ``object_at_brace`` of the text,
    where a column holds it.
    """
    found = object_at_brace(text) if found is None else found
    return F.coalesce(F.to_json(found), _first_json_anywhere(F.when(found.isNull(), text)))


def shape_problems(answer: Column) -> Column:
    """Which required parts of a parsed answer (a variant) are missing or of the wrong kind."""
    there = lambda k, kind: F.try_variant_get(answer, f"$.{k}", kind).isNotNull()
    wrong = [F.when(~there(k, kind), k) for k, kind in (("buyer_details", "array<variant>"), ("seller_details", "array<variant>"),
        ("property_details", "map<string,variant>"), ("document_details", "map<string,variant>"))]
    return words(wrong)


def words(given: list[Column]) -> Column:
    """Those of some words without spaces that aren't null, in order.

    ``array_compact`` is a function over arrays, in which each word's condition would be worked out
    uncompiled, and anew where another names it too.
    """
    joined = F.concat_ws(" ", *given)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def pans_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(PAN_ANYWHERE), F.lit(0)))


def aadhaar_in(value: Column, norm: Column, raw: Column) -> Column:
    d = digits(value)
    return (d != "") & (F.contains(norm, d) | F.contains(F.regexp_replace(raw, r"(?U)[\s\-.]", ""), d))


def amount_in(value: Column, raw: Column) -> Column:
    """As a whole number, with commas or white space between its digits and no digit beside it."""
    d = digits(value)
    pattern = F.concat(F.lit(r"(?<!\d)"), F.array_join(F.split(d, ""), r"[\s,]*"), F.lit(r"(?!\d)"))
    return (d != "") & F.regexp_like(raw, pattern)


def name_in(name: Column, norm: Column) -> Column:
    """The whole name, or two of its longer words, or its only longer word."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"(?U)\s+"), lambda w: F.length(w) >= 3)
    there = lambda w: let(bare_form(w), lambda b: (b != "") & F.contains(norm, b))
    hits = lambda ws: F.size(F.filter(ws, there))
    by_words = let(words, lambda ws: let(hits(ws), lambda n: (n >= 2) | ((F.size(ws) == 1) & (n == 1))))
    return there(F.coalesce(name, F.lit(""))) | by_words


def date_in(value: Column, norm: Column) -> Column:
    """Day, month, year in digits, with or without leading zeros."""
    y, m, d = (F.regexp_extract(value, ISO_DATE, k) for k in (1, 2, 3))
    return value.rlike(ISO_DATE) & (F.contains(norm, F.concat(d, m, y)) | F.contains(norm, F.concat(F.ltrim(d, F.lit("0")), F.ltrim(m, F.lit("0")), y)))


def near(pan: Column, aadhaar: Column, text: Column, window: int = NEAR) -> Column:
    """Whether some PAN and some Aadhaar stand within ``window`` characters; null if either is absent.

    Places are where the pieces of a split text end, so no match offsets are needed.
    """
    spaced = F.array_join(F.split(digits(aadhaar), ""), r"[\s\-.]*")
    upper = F.upper(text)

    def places(found: Column, parts: Column) -> Column:
        size = lambda k: F.length(F.get(parts, k)) + F.when(k > 0, F.length(F.get(found, k - 1))).otherwise(0)
        return F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0), lambda s, i: s + size(i)))

    def there(subject: Column, pattern: Column) -> Column:
        found = lambda parts: let(F.regexp_extract_all(subject, pattern, F.lit(0)), lambda f: places(f, parts))
        return let(F.split(subject, pattern), lambda parts: F.when(F.size(parts) > 1, found(parts)))

    literal = lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    usable = (F.coalesce(pan, F.lit("")) != "") & aadhaar_valid(aadhaar)
    close = lambda p: let(there(text, spaced), lambda a: F.exists(p, lambda x: F.exists(a, lambda y: F.abs(x - y) <= window)))
    return F.when(usable, let(there(upper, literal(F.upper(pan))), lambda p: F.when(p.isNotNull(), close(p))))


def fee_candidates(text: Column, least: int = FEE_FROM, most: int = FEE_TO) -> Column:
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in FEE_PATTERNS])
    return F.array_distinct(F.filter(F.transform(found, amount), lambda v: v.between(least, most)))


def coverage(claimed: Column, source: Column) -> Column:
    """The share of the source's identifiers that are claimed; 1 without any."""
    return F.when(F.size(source) == 0, 1.0).otherwise(F.size(F.array_intersect(claimed, source)) / F.greatest(F.size(source), F.lit(1)))


def check_points(format_ok: Column, present: Column) -> Column:
    """The score of a check in hundredths."""
    return F.when(format_ok.eqNullSafe(F.lit(False)), 0).when(present.eqNullSafe(F.lit(False)), 25).when(present.eqNullSafe(F.lit(True)), 100).otherwise(60)


def check_score(format_ok: Column, present: Column) -> Column:
    return check_points(format_ok, present) / F.lit(100.0)


def confidence(checks: Column) -> Column:
    """checks: array of (format_ok, present, score). The mean score of evaluated ones."""
    scored = F.filter(checks, lambda c: c["format_ok"].isNotNull() | c["present"].isNotNull())
    total = F.aggregate(scored, F.lit(0.0), lambda s, c: s + c["score"])
    return F.when(F.size(scored) == 0, 0.0).otherwise(F.bround(total / F.greatest(F.size(scored), F.lit(1)), 3))


def suspect(format_ok: Column, present: Column) -> Column:
    return format_ok.eqNullSafe(F.lit(False)) | present.eqNullSafe(F.lit(False))


def person_flags(pan: Column, aadhaar: Column, name: Column, text: Column, norm: Column) -> Column:
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    flags = [
        F.when(given(pan), F.when(pan_valid(pan) & F.contains(norm, F.upper(F.trim(pan))), "PAN_MATCHED").otherwise("HALLUCINATED_PAN")),
        F.when(given(aadhaar) & ~(aadhaar_valid(aadhaar) & aadhaar_in(aadhaar, norm, text)), "WRONG_AADHAAR"),
        F.when(given(name) & ~name_in(name, norm), "NAME_NOT_IN_OCR"),
        F.when(near(pan, aadhaar, text) == F.lit(False), "PAN_AADHAAR_FAR"),
    ]
    return F.array_compact(F.array(*flags))


def remarks(flags: Column) -> Column:
    return F.array_join(F.array_distinct(flags), " ")


def disposition(parsed: Column, schema_ok: Column, covered: Column, unmatched: Column, flags: Column) -> Column:
    """Retry what a second pass may mend, review what the source doesn't bear out, accept the rest."""
    bad = F.arrays_overlap(flags, F.array(*[F.lit(f) for f in GROUNDING_FLAGS]))
    return F.when(~parsed | ((covered < COVERAGE) & (unmatched >= UNMATCHED)), "retry").when(bad | ~schema_ok, "review").otherwise("accept")
