"""The report: one row of 42 text columns for each party of each deed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify, language, values
from ledgerloom.functions.places import city_town

# The report's columns, in order.
COLUMNS = (
    "Report Serial Number", "Original Report Serial Number", "Transaction Date", "Transaction Identity", "Transaction Type", "Transaction Amount",
    "Property Type", "Whether property is within municipal limits", "Property Address", "City / Town", "Postal Code", "State Code", "Country Code",
    "Stamp Value", "Remarks", "Transaction Relation (PC)", "Transaction Amount related to the person (PC)", "Person Name (PC)", "Person Type (PC)",
    "Gender (PC)", "Father's Name (PC)", "PAN (PC)", "Aadhaar Number (PC)", "Form 60 Acknowledgement (PC)", "Identification Type (PC)",
    "Identification Number (PC)", "Date of Birth/ Incorporation (PC)", "Nationality/Country of Incorporation (PC)", "Address Type (PC-L)",
    "Address (PC-L)", "City/Town (PC-L)", "Pin Code (PC-L)", "State (PC-L)", "Country (PC-L)", "Primary STD Code (PC)", "Primary Phone Number (PC)",
    "Primary Mobile Number (PC)", "Secondary STD Code (PC)", "Secondary Phone Number (PC)", "Secondary Mobile Number (PC)", "Email (PC)",
    "Person Details Remarks (PC)",
)
FAILED_COLUMNS = ("Transaction Identity", "Source Filename", "Failed Stage", "Processing Status", "Reason", "Flags", "Confidence")
COUNTRY = "IN"
DOMAINS = {
    "Transaction Type": ("S", "B", ""), "Transaction Relation (PC)": ("S", "B", ""), "Property Type": ("A", "N", "C", "R", "I", "Z", "X"),
    "Address Type (PC-L)": ("1", "2", "3", "4", "5"), "Identification Type (PC)": ("A", "B", "C", "D", "E", "G", "H", "Z", ""),
}


def dedupe(parties: DataFrame) -> DataFrame:
    """The first copy of each party of a side; copies go before nameless parties do."""
    key = values.party_key(F.col("relation"), F.col("aadhaar"), F.col("pan"), F.col("name"), F.col("father"))
    first = Window.partitionBy("deed", "relation", "_key").orderBy("ordinal")
    return parties.withColumn("_key", key).withColumn("_k", F.row_number().over(first)).filter((F.col("_k") == 1) & values.has_letter(F.col("name"))).drop("_k", "_key")


def split(parties: DataFrame) -> DataFrame:
    """parties with ``paise``: each side's equal shares, adding up to the whole, as text."""
    side = Window.partitionBy("deed", "relation")
    n, i = F.count("*").over(side), F.row_number().over(side.orderBy("ordinal"))
    whole = F.col("paise") % (100 * F.col("_n")) == 0
    return parties.withColumns({"_n": n, "_i": i}).withColumn("share", values.share_text(values.share(F.col("paise"), F.col("_n"), F.col("_i")), whole)).drop("_n", "_i")


def rows(deeds: DataFrame, parties: DataFrame) -> DataFrame:
    """deeds: deed, serial, deed_date, identity, paise, property_text, address, state, stamp. One row a party, one at least."""
    # dealt by deed once: both windows and both joins find their rows together
    sides = split(dedupe(parties.repartition("deed")).join(deeds.select("deed", "paise"), "deed"))
    person = sides.select("deed", "relation", "ordinal", "share", "name", "father", "gender", "pan", "aadhaar", F.col("address").alias("p_address"))
    c, e, none = F.col, lambda x: F.coalesce(x, F.lit("")), F.lit("")
    party = c("relation").isNotNull()
    amount = values.share_text(c("paise"), c("paise") % 100 == 0)
    # what the deed alone decides is decided once a deed, before its parties multiply it
    of_deed: dict[str, Column] = {
        "_serial": c("serial").cast("string"), "_date": values.day_first(c("deed_date").cast("string")),
            "_identity": values.cell(c("identity")), "_amount": values.cell(amount), "_kind": classify.property_type(c("address"), c("property_text")),
        "_limits": classify.municipal_limits(c("address"), c("property_text")), "_address": values.cell(c("address")),
            "_city": e(city_town(c("address"))), "_code": values.pin_code(c("address"), own=c("deed")), "_state": values.cell(c("state")),
            "_stamp": values.cell(c("stamp").cast("string")),
    }
    joined = deeds.select("deed", *[v.alias(k) for k, v in of_deed.items()]).join(person, "deed", "left")
    given: dict[str, Column] = {
        "Report Serial Number": c("_serial"), "Transaction Date": c("_date"), "Transaction Identity": c("_identity"),
            "Transaction Type": e(c("relation")), "Transaction Amount": c("_amount"), "Property Type": c("_kind"),
        "Whether property is within municipal limits": c("_limits"), "Property Address": c("_address"), "City / Town": c("_city"), "City/Town (PC-L)": F.when(party, c("_city")).otherwise(none),
        "Postal Code": c("_code"), "State Code": c("_state"), "Country Code": F.lit(COUNTRY), "Stamp Value": c("_stamp"),
        "Transaction Relation (PC)": e(c("relation")), "Transaction Amount related to the person (PC)": e(c("share")), "Person Name (PC)": values.cell(values.primary_name(c("name"))),
        "Person Type (PC)": F.when(party, classify.person_type(c("pan"), c("father"), c("gender"))).otherwise(none), "Gender (PC)": values.cell(c("gender")),
        "Father's Name (PC)": values.cell(values.primary_name(c("father"))), "PAN (PC)": values.identifier(c("pan")), "Aadhaar Number (PC)": values.identifier(c("aadhaar")),
        "Identification Type (PC)": classify.identification_type(c("pan"), c("aadhaar")), "Nationality/Country of Incorporation (PC)": F.when(party, COUNTRY).otherwise(none),
        "Address Type (PC-L)": classify.address_type(c("p_address"), c("pan")), "Address (PC-L)": values.cell(c("p_address")), "Pin Code (PC-L)": values.pin_code(c("p_address")),
        "Country (PC-L)": F.when(party, COUNTRY).otherwise(none),
    }
    return joined.select("deed", "ordinal", *[given.get(name, none).alias(name) for name in COLUMNS])


def order() -> list[Column]:
    """By deed, sellers before buyers, as they were listed."""
    return [F.col("deed"), F.col("`Transaction Relation (PC)`") == "B", F.col("ordinal")]


def violations(report: DataFrame) -> DataFrame:
    """Cells of coded columns that hold no code of theirs."""
    cells = report.select("deed", "ordinal", F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"`{k}`").alias("value"),
        F.array_contains(F.array(*[F.lit(x) for x in v]), F.col(f"`{k}`")).alias("fine")) for k, v in DOMAINS.items()])).alias("c"))
    return cells.filter(~F.col("c.fine")).select("deed", "ordinal", "c.column", "c.value")


#: Columns that deeds never fill, and why.
UNFILLED = {
    "Original Report Serial Number": "set only on a corrected report", "Remarks": "left empty on purpose", "Person Details Remarks (PC)": "left empty on purpose",
    "Form 60 Acknowledgement (PC)": "not in a deed", "Identification Number (PC)": "carried by the PAN and Aadhaar columns", "Date of Birth/ Incorporation (PC)": "rarely in a deed",
    "Primary STD Code (PC)": "not in a deed", "Primary Phone Number (PC)": "not in a deed", "Primary Mobile Number (PC)": "not in a deed", "Secondary STD Code (PC)": "not in a deed",
    "Secondary Phone Number (PC)": "not in a deed", "Secondary Mobile Number (PC)": "not in a deed", "Email (PC)": "rarely in a deed",
}


def untranslated(report: DataFrame) -> DataFrame:
    """Per column the first cell that holds letters of another script, in one pass that keeps a cell a column."""
    first = lambda k: F.min_by(F.col(f"`{k}`"), F.when(language.needs_translation(F.col(f"`{k}`")), F.struct("deed", "ordinal"))).alias(k)
    found = report.agg(*[first(k) for k in COLUMNS])
    cells = F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"`{k}`").alias("value")) for k in COLUMNS])
    return found.select(F.inline(cells)).filter("value IS NOT NULL")


def unpopulated(report: DataFrame) -> DataFrame:
    """Columns that are empty throughout, with the reason where one is known."""
    reasons = F.create_map(*[F.lit(x) for pair in UNFILLED.items() for x in pair])
    return population(report).filter("filled = 0").select("column", F.coalesce(F.try_element_at(reasons, F.col("column")), F.lit("not found in the deeds")).alias("reason"))


def failed_report(failed: DataFrame) -> DataFrame:
    """failed: identity, source, stage, status, reason, flags, confidence. The seven columns of the failed export."""
    cells = ("identity", "source", "stage", "status", "reason", "flags")
    shown = [values.cell(F.col(c)) for c in cells] + [F.when(F.col("confidence").isNotNull(), F.format_string("%.2f", F.col("confidence"))).otherwise("")]
    return failed.select(*[c.alias(name) for c, name in zip(shown, FAILED_COLUMNS, strict=True)])


def population(report: DataFrame) -> DataFrame:
    """Per column how many cells hold something, in one pass."""
    total = report.agg(F.count("*").alias("n"), *[F.count_if(F.trim(F.col(f"`{k}`")) != "").alias(k) for k in COLUMNS])
    return total.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("column"),
        F.col(f"`{k}`").alias("filled")) for k in COLUMNS])).alias("c")).select("c.column", "c.filled",
        F.round(100 * F.col("c.filled") / F.greatest("n", F.lit(1)), 2).alias("percent"))
