"""Extraction without a model: parties, amounts and the date that patterns find in a text.

The same text always gives the same answer, in the shape that a model's answer has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is looked for.
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
AADHAAR = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
AMOUNT = r"(?i)(?:rs\.?|₹|inr)\s*([\d,]+(?:\.\d+)?)"
DATE = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\b"
FEE = r"(?i)(?:registration|regn\.?)\s*(?:fee|fees)|ನೋಂದಣಿ\s*ಶುಲ್ಕ"
FEE_FROM, FEE_TO, STATE = 100, 1_000_000, "Karnataka"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def people(pans: Column, aadhaars: Column, side: str) -> Column:
    """Parties from two lists that may differ in length, named by what they hold."""
    none = F.lit(None).cast("string")

    def one(x: Column, i: Column) -> Column:
        shown = lambda v: F.coalesce(v, F.lit("None"))
        mark = F.upper(F.substring(F.sha2(F.concat(F.lit(side), shown(x["pan"]), shown(x["aadhaar"]), i.cast("string")), 256), 1, 6))
        return F.struct(F.concat(F.lit(f"MOCK {side}"), (i + 1).cast("string"), F.lit(" "), mark).alias("name"), none.alias("gender"),
            none.alias("father_name"), x["aadhaar"].alias("aadhaar_number"), x["pan"].alias("pan_card_number"), none.alias("address"),
            F.lit(STATE).alias("state"))

    return F.transform(F.arrays_zip(pans.alias("pan"), aadhaars.alias("aadhaar")), one)


def scrape(text: Column) -> Column:
    """An answer as a struct: identifiers shared out between the sides, the largest amount, a fee, the first date."""
    t = F.coalesce(text, F.lit(""))
    pans = F.array_distinct(_found(t, PAN))
    aadhaars = F.array_distinct(F.transform(_found(t, AADHAAR), lambda a: F.regexp_replace(a, r"[\s-]", "")))
    numbers = F.transform(_found(t, AMOUNT, 1), lambda a: F.substring_index(F.regexp_replace(a, ",", ""), ".", 1).try_cast("bigint"))
    amounts = F.sort_array(F.array_distinct(F.array_compact(numbers)), asc=False)
    half = F.when(F.size(pans) > 0, F.greatest(F.lit(1), F.floor(F.size(pans) / 2).cast("int"))).otherwise(F.lit(0))
    head, tail = lambda a: F.slice(a, F.lit(1), half), lambda a: F.slice(a, half + 1, F.greatest(F.size(a), F.lit(1)))
    fee = F.get(F.filter(amounts, lambda a: a.between(FEE_FROM, FEE_TO)), 0)
    part = lambda k: F.regexp_extract(t, DATE, k)
    date = F.when(part(3) != "", F.concat(part(3), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0")))
    none = F.lit(None).cast("string")
    return F.struct(
        people(head(pans), head(aadhaars), "B").alias("buyer_details"), people(tail(pans), tail(aadhaars), "S").alias("seller_details"),
        F.struct(none.alias("schedule_c_property_address"), F.lit(STATE).alias("state"), F.get(amounts, 0).cast("string").alias("sale_consideration"),
                 F.when(t.rlike(FEE) & (F.size(amounts) > 1), fee.cast("string")).alias("registration_fee"), F.lit("no").alias("paid_in_cash")).alias("property_details"),
        F.struct(date.alias("transaction_date"), none.alias("registration_office")).alias("document_details"),
    )


def answer(text: Column) -> Column:
    """The same as a model's text."""
    return F.to_json(scrape(text), {"ignoreNullFields": "false"})
