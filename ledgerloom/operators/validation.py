"""The report on an extraction: every value checked against its source, and what to do with it.

One row a document. Persons stay in arrays and are checked by functions over them, so the
source text is read where it is and never copied to a row for each person.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import grounding, values

# Remark codes.
FLAGS = {
    "PAN_MATCHED": "PM", "WRONG_AADHAAR": "WAN", "WRONG_CONSIDERATION": "WSC", "WRONG_STAMP_VALUE": "WSV", "STAMP_OVER_SALE": "SSV",
    "WRONG_TXN_DATE": "WTD", "OCR_PASSED": "OCR_P", "OCR_FAILED": "OCR_F", "HALLUCINATED_PAN": "HPAN", "EXTRA_OCR_PANS": "XPAN",
    "PAN_AADHAAR_FAR": "PAF", "NAME_NOT_IN_OCR": "WNM", "SCHEMA_INVALID": "SCH", "TRUNCATED": "TRC", "NO_TXN_IDENTITY": "WTI",
}
#: Flags that say that the source doesn't bear a value out: a person looks at it.
UNGROUNDED = tuple(FLAGS[f] for f in ("WRONG_CONSIDERATION", "WRONG_STAMP_VALUE", "WRONG_AADHAAR", "HALLUCINATED_PAN", "PAN_AADHAAR_FAR", "SCHEMA_INVALID", "TRUNCATED"))
PERSON = "struct<name:string,gender:string,father_name:string,aadhaar_number:string,pan_card_number:string,address:string,state:string>"
PROPERTY = "struct<schedule_c_property_address:string,state:string,sale_consideration:string,registration_fee:string,paid_in_cash:string>"
DOCUMENT = "struct<transaction_date:string,registration_office:string>"
ANSWER = f"struct<buyer_details:array<{PERSON}>,seller_details:array<{PERSON}>,property_details:{PROPERTY},document_details:{DOCUMENT}>"
PERSON_FIELDS = ("relation", "ordinal", "name", "pan", "discarded_pan", "checks", "flags", "confidence")
SIDES = (("B", "buyer_details"), ("S", "seller_details"))
#: In hundredths: the score of a fee that the text names otherwise is at most this; identifiers far apart score so.
OTHER_FEE, FAR = 70, 40


@dataclass(frozen=True)
class Rules:
    """Which checks run, and their bounds."""

    pan: bool = True
    aadhaar: bool = True
    registration_fee: bool = True
    sale_consideration: bool = True
    transaction_date: bool = True
    against_text: bool = True
    confidence: bool = True
    stamp_value: bool = True
    coverage: float = 0.6
    unmatched: int = 2
    near: int = 250
    fee_from: int = 100
    fee_to: int = 1_000_000
    cutoff: str = values.STAMP_CUTOFF
    multiplier: float = 1.0


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _given(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _check(field: str, value: Column, format_ok: Column, present: Column, points: Column | None = None) -> Column:
    score = grounding.check_score(format_ok, present) if points is None else points / F.lit(100.0)
    return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), format_ok.alias("format_ok"), present.alias("present"), score.alias("score"))


def _side(people: Column, relation: str) -> Column:
    """What is looked up of the persons of a side; numbers without white space around them, an empty text for none."""
    def given(x: Column, i: Column) -> Column:
        pan = F.upper(values.strip(F.coalesce(x["pan_card_number"], F.lit(""))))
        return F.struct(F.lit(relation).alias("relation"), (i + 1).alias("ordinal"), x["name"].alias("name"), pan.alias("pan"),
            x["aadhaar_number"].alias("aadhaar"), values.digits(x["aadhaar_number"]).alias("own"))

    return F.transform(people, given)


def _found(x: Column | dict[str, Column], rules: Rules) -> list[Column]:
    """What the source says of a person, beside what was given; ``x`` is an element of an array or a row.

    The text and its forms are columns of the row. A look that is dear comes after those that can spare it.
    """
    norm, text, bare = F.col("norm"), F.col("text"), F.regexp_replace("text", r"(?U)[\s\-.]", "")
    own_fine = F.length(x["own"]) == 12
    there = {
        "pan_there": F.contains(norm, x["pan"]),
        # what stands in an unchanged text without some separators stands there without all of them
        "own_there": F.when(own_fine, F.contains(norm, x["own"]) | (F.col("altered") & F.contains(bare, x["own"]))),
        "name_there": grounding.name_in(x["name"], norm),
    }
    # no two places of a text that isn't longer than the window are farther apart
    upper = F.upper(text)
    apart = (x["pan"] != "") & own_fine & (F.length(upper) > rules.near) & F.contains(upper, x["pan"])
    far = F.coalesce(F.when(apart, grounding.near(x["pan"], x["aadhaar"], text, rules.near) == F.lit(False)), F.lit(False))
    return [*[x[c].alias(c) for c in ("relation", "ordinal", "name", "pan", "aadhaar")], x["pan"].rlike(values.PAN).alias("pan_fine"), own_fine.alias("own_fine"),
        *[(c if rules.against_text else _none("boolean")).alias(k) for k, c in there.items()], far.alias("far")]


def _given_checks(x: Column | dict[str, Column], rules: Rules) -> list[tuple[str, Column, Column, Column, Column]]:
    """Of a person that was looked up: each check's name, whether it is made, its value, its form and its presence."""
    checks = []
    if rules.pan:
        checks.append(("pan", x["pan"] != "", x["pan"], x["pan_fine"], x["pan_there"]))
    if rules.aadhaar:
        checks.append(("aadhaar", _given(x["aadhaar"]), x["aadhaar"], x["own_fine"], x["own_there"]))
    return [*checks, ("name", _given(x["name"]), x["name"], F.lit(True), x["name_there"])]


def _points(x: Column | dict[str, Column], rules: Rules) -> Column:
    """The sum of a person's scores, in hundredths."""
    own = [F.when(made, grounding.check_points(fine, there)).otherwise(0) for _, made, _, fine, there in _given_checks(x, rules)]
    return sum(own, F.when(x["far"], FAR).otherwise(0))


def _checked(x: Column | dict[str, Column], rules: Rules) -> Column:
    """How many checks a person has."""
    return sum((made.cast("int") for _, made, *_ in _given_checks(x, rules)), x["far"].cast("int"))


def _doubted(x: Column | dict[str, Column], rules: Rules) -> Column:
    """Whether the source doesn't bear a person's numbers out."""
    doubts = [made & grounding.suspect(fine, there) for field, made, _, fine, there in _given_checks(x, rules) if field != "name"]
    return functools.reduce(lambda a, b: a | b, doubts, x["far"])


def _told(x: Column | dict[str, Column], rules: Rules) -> dict[str, Column]:
    """What a report says about a person that was looked up."""
    made = _given_checks(x, rules)
    checks = [F.when(given, _check(field, value, fine, there)) for field, given, value, fine, there in made]
    checks.append(F.when(x["far"], _check("pan_aadhaar_proximity", _none("string"), F.lit(True), F.lit(False), F.lit(FAR))))
    lost = ~x["pan_fine"] | x["pan_there"].eqNullSafe(F.lit(False))
    raised = {
        "pan": lambda given, _: F.when(given, F.when(lost, FLAGS["HALLUCINATED_PAN"]).otherwise(FLAGS["PAN_MATCHED"])),
        "aadhaar": lambda given, doubt: F.when(given & doubt, FLAGS["WRONG_AADHAAR"]), "name": lambda given, doubt: F.when(given & doubt, FLAGS["NAME_NOT_IN_OCR"]),
    }
    flags = [raised[field](given, grounding.suspect(fine, there)) for field, given, _, fine, there in made]
    flags.append(F.when(x["far"], FLAGS["PAN_AADHAAR_FAR"]))
    pan = lambda c: F.when((x["pan"] != "") & c, x["pan"]) if rules.pan else _none("string")
    return {
        "relation": x["relation"], "ordinal": x["ordinal"], "name": x["name"], "pan": pan(~lost), "discarded_pan": pan(lost),
        "checks": F.array_compact(F.array(*checks)), "flags": grounding.words(flags), "confidence": _mean(_points(x, rules), _checked(x, rules)),
    }


def _mean(points: Column, n: Column) -> Column:
    """The mean of so many scores, whose sum in hundredths is a whole number and the same in any order."""
    return F.when(n == 0, 0.0).otherwise(F.bround(points / F.lit(100.0) / F.greatest(n, F.lit(1)), 3))


def parsed(docs: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """docs: doc_id, answer, text. Adds the first object of the answer: as it is, in the known shape, and its faults.

    ``more`` are columns to add, which go to Python together with the answers.
    """
    found = docs.withColumn("first", grounding.object_at_brace(F.col("answer")))
    found = found.withColumns({"object": grounding.first_json(F.col("answer"), F.col("first"))} | (more or {}))
    whole = F.coalesce("first", F.try_parse_json("object"))
    return found.withColumns({"x": F.from_json("object", ANSWER), "problems": grounding.shape_problems(whole)}).drop("first")


def _read(docs: DataFrame) -> DataFrame:
    """The parsed answer, the persons it names, and the forms of the text that they are looked up in."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    known = parsed(docs.withColumn("text", clean), {"plain": grounding.composed(F.col("text"))})
    empty = F.array().cast(f"array<{PERSON}>")
    people = F.concat(*[_side(F.coalesce(F.col("x")[key], empty), side) for side, key in SIDES])
    return known.withColumns({"norm": grounding.bare_form(F.col("plain")), "altered": F.col("plain") != F.col("text"), "people": people})


def validate(docs: DataFrame, rules: Rules = Rules(), keep: tuple[str, ...] = (), person: tuple[str, ...] = PERSON_FIELDS) -> DataFrame:  # noqa: B008
    """docs: doc_id, answer, text, truncated, ocr_ok. A report for each, beside the columns to keep (``x`` is the parsed answer).

    ``person`` names what is wanted of the persons.
    """
    t = _read(docs).withColumn("seen", F.transform("people", lambda x: F.struct(*_found(x, rules))))
    text, norm, prop, date = F.col("text"), F.col("norm"), F.col("x.property_details"), F.col("x.document_details.transaction_date")
    there = lambda fine, found: F.when(fine, found) if rules.against_text else _none("boolean")
    digits_only = lambda v: F.coalesce(values.strip(v).rlike(r"^\d+$"), F.lit(False))
    number = lambda v: values.digits(v).try_cast("bigint")

    sale, fee = prop["sale_consideration"], prop["registration_fee"]
    # looked up once, as columns: what follows names them many times
    t = t.withColumns({"sale_there": there(digits_only(sale), grounding.amount_in(sale, text)), "fee_there": there(digits_only(fee), grounding.amount_in(fee, text)),
        "date_there": there(values.date_plausible(date), grounding.date_in(date, norm)),
        "fees": grounding.fee_candidates(text, rules.fee_from, rules.fee_to), "source": grounding.pans_in(F.col("plain"))})
    sale_fine, fee_fine, sale_there, fee_there = digits_only(sale), digits_only(fee), F.col("sale_there"), F.col("fee_there")
    other = fee_fine & (F.size("fees") > 0) & ~F.array_contains("fees", number(fee))
    date_given, date_fine = _given(date), values.date_plausible(date)
    date_there = F.col("date_there")
    paid = prop["paid_in_cash"]
    parsed_ok = F.col("object").isNotNull()
    schema_ok = parsed_ok & (F.size("problems") == 0)

    checks, points, made, flags = [], [], [], [F.when(F.col("ocr_ok"), FLAGS["OCR_PASSED"]).otherwise(FLAGS["OCR_FAILED"]),
        F.when(F.col("truncated"), FLAGS["TRUNCATED"]), F.when(parsed_ok & ~schema_ok, FLAGS["SCHEMA_INVALID"])]
    in_answer = lambda c: parsed_ok & c
    absent = lambda fine, found: ~fine | found.eqNullSafe(F.lit(False))

    def check(given: Column, field: str, value: Column, fine: Column, found: Column, most: Column | None = None) -> None:
        scored = grounding.check_points(fine, found)
        scored = scored if most is None else F.least(scored, most)
        checks.append(F.when(given, _check(field, value, fine, found, scored)))
        points.append(F.when(given, scored).otherwise(0))
        made.append(F.when(given, 1).otherwise(0))

    if rules.sale_consideration:
        check(in_answer(sale.isNotNull()), "sale_consideration", sale, sale_fine, sale_there)
        flags.append(F.when(in_answer(sale.isNotNull()) & absent(sale_fine, sale_there), FLAGS["WRONG_CONSIDERATION"]))
    if rules.registration_fee:
        check(in_answer(fee.isNotNull()), "registration_fee", fee, fee_fine, fee_there, F.when(other, OTHER_FEE))
        flags.append(F.when(in_answer(fee.isNotNull()) & absent(fee_fine, fee_there), FLAGS["WRONG_STAMP_VALUE"]))
    stamp = _none("bigint")
    if rules.registration_fee and rules.stamp_value:
        stamp = F.when(fee_fine, values.stamp_value(number(fee), values.calendar_date(date), rules.cutoff, rules.multiplier))
        flags.append(F.when(in_answer(sale_fine) & (stamp > number(sale)), FLAGS["STAMP_OVER_SALE"]))
    check(in_answer(~F.coalesce(paid.isin("yes", "no"), F.lit(False))), "paid_in_cash", paid, F.lit(False), _none("boolean"))
    if rules.transaction_date:
        check(parsed_ok, "transaction_date", F.when(date_given, date), date_given & date_fine, F.when(date_given, date_there))
        flags.append(F.when(parsed_ok & (~date_given | ~date_fine), FLAGS["WRONG_TXN_DATE"]))

    claimed = F.array_distinct(F.col("people.pan"))
    t = t.withColumn("claimed", claimed)
    # what stands in the source is well formed and there, so a party that claims it has it
    unclaimed = F.array_except("source", "claimed") if rules.pan else F.col("source")
    t = t.withColumn("extra_pans", F.when(parsed_ok, F.array_sort(unclaimed)).otherwise(F.array().cast("array<string>")))
    of_persons = lambda count: F.aggregate("seen", F.lit(0), lambda s, x: s + count(x, rules))
    t = t.withColumns({"document_checks": F.array_compact(F.array(*checks)), "document_flags": grounding.words(flags),
        "points": sum(points, of_persons(_points)), "made": sum(made, of_persons(_checked)), "doubted": F.exists("seen", lambda x: _doubted(x, rules)),
        "stamp_value": stamp, "pan_coverage": F.when(parsed_ok, F.bround(grounding.coverage(F.col("claimed"), F.col("source")), 3)).otherwise(0.0)})
    of_person = lambda x: F.struct(*[_told(x, rules)[k].alias(k) for k in person])
    sure = F.when(parsed_ok, _mean(F.col("points"), F.col("made")) if rules.confidence else F.lit(1.0)).otherwise(0.0)
    doubted = F.arrays_overlap("document_flags", F.array(*[F.lit(f) for f in UNGROUNDED])) | F.col("doubted")
    verdict = F.when(~parsed_ok | ((F.col("pan_coverage") < rules.coverage) & (F.size("extra_pans") >= rules.unmatched)), "retry").when(doubted | ~schema_ok, "review").otherwise("accept")
    return t.select("doc_id", parsed_ok.alias("parsed"), schema_ok.alias("schema_ok"), "document_flags", "document_checks",
        F.transform("seen", of_person).alias("persons"), "pan_coverage", "stamp_value", "extra_pans", F.col("fees").alias("fee_candidates"),
        sure.alias("confidence"), verdict.alias("disposition"), *keep)


def persons(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """docs as for ``validate``. What its reports say of persons, a row each; the documents' own values aren't worked out."""
    # an inner one would have all that comes before it worked out twice, to leave out who has no persons
    one = _read(docs).select("doc_id", "text", "norm", "altered", F.inline_outer("people")).filter("relation IS NOT NULL")
    seen = one.select("doc_id", *_found({c: F.col(c) for c in one.columns}, rules))
    return seen.select("doc_id", *[c.alias(k) for k, c in _told({c: F.col(c) for c in seen.columns}, rules).items()])


def remark_codes() -> Column:
    """Of a report's row: the document's codes in order without repeats, with the identifiers of no party."""
    extra = F.when(F.size("extra_pans") > 0, F.array(F.concat(F.lit(f"{FLAGS['EXTRA_OCR_PANS']}:"), F.array_join("extra_pans", ",")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array_distinct("document_flags"), extra), " ")


def remarks(report: DataFrame) -> DataFrame:
    """doc_id and the document's remark codes."""
    return report.select("doc_id", remark_codes().alias("remarks"))


def person_remarks(report: DataFrame) -> DataFrame:
    """A row a person: remark codes in order, without repeats, and the confidence; of a report, or of persons by row."""
    one = report.select("doc_id", F.inline("persons")) if "persons" in report.columns else report
    return one.select("doc_id", "relation", "ordinal", grounding.remarks(F.col("flags")).alias("remarks"), "confidence", "pan", "discarded_pan")


def suspect_fields(report: DataFrame) -> DataFrame:
    """doc_id and the names of doubtful fields: those of the document, then ``B1.pan`` and the like."""
    doubt = lambda cs: F.filter(cs, lambda c: grounding.suspect(c["format_ok"], c["present"]))
    of = lambda p: F.transform(doubt(p["checks"]), lambda c: F.concat(p["relation"], p["ordinal"].cast("string"), F.lit("."), c["field"]))
    own = F.transform(doubt(F.col("document_checks")), lambda c: c["field"])
    return report.select("doc_id", F.concat(own, F.flatten(F.transform("persons", of))).alias("fields"))


def field_at(path: Column, answer: Column) -> Column:
    """The value at a path such as ``b1.name``, ``property.state`` or ``document.transaction_date``; null without one."""
    side, place, field = F.regexp_extract(path, r"(?i)^([bs])(\d+)\.", 1), F.regexp_extract(path, r"(?i)^[bs](\d+)\.", 1).try_cast("int"), F.regexp_extract(path, r"\.(\w+)$", 1)
    plain = F.to_json(answer)
    root = F.when(F.upper(side) == "B", "buyer_details").when(F.upper(side) == "S", "seller_details").when(path.startswith("property."),
        "property_details").when(path.startswith("document."), "document_details")
    json_path = F.concat(F.lit("$."), root, F.when(side != "", F.concat(F.lit("["), (place - 1).cast("string"), F.lit("]"))).otherwise(""), F.lit("."), field)
    return F.when(root.isNotNull() & ((side == "") | (place >= 1)), F.try_variant_get(F.try_parse_json(plain), json_path, "string"))


def flag_rows(report: DataFrame) -> DataFrame:
    """A row a flag: the document's without a person, each person's with relation and ordinal; codes of 12 characters."""
    row = lambda relation, ordinal, flag: F.struct(relation.alias("relation"), ordinal.cast("int").alias("ordinal"), F.left(flag, F.lit(12)).alias("flag"))
    of_document = F.transform("document_flags", lambda f: row(_none("string"), _none("int"), f))
    of_persons = F.flatten(F.transform("persons", lambda p: F.transform(p["flags"], lambda f: row(p["relation"], p["ordinal"], f))))
    return report.select("doc_id", F.inline(F.concat(of_document, of_persons)))  # one pass: the report isn't worked out for each kind


def outcome(disposition: Column) -> tuple[Column, Column]:
    """ok and needs_review of a verdict: a review is no failure."""
    return (disposition != "retry").alias("ok"), disposition.eqNullSafe(F.lit("review")).alias("needs_review")


def stage_outcome(report: DataFrame) -> DataFrame:
    """Whether the stage failed, and the document's state to be."""
    return report.select("doc_id", *outcome(F.col("disposition")))


def persisted(report: DataFrame) -> dict[str, DataFrame]:
    """What a report that keeps ``x`` writes, in the order of writing: property, document, persons, flags."""
    x = report.select("doc_id", "x", "stamp_value")
    prop, people = F.col("x.property_details"), []
    for side, key in SIDES:
        people.append(x.select("doc_id", F.lit(side).alias("relation"), F.posexplode(F.col("x")[key]).alias("k", "p")).select("doc_id", "relation", (F.col("k") + 1).alias("ordinal"), "p.*"))
    whole = lambda v: values.digits(v).try_cast("decimal(15,0)")
    return {
        "properties": x.select("doc_id", prop["schedule_c_property_address"].alias("address"), prop["state"].alias("state"),
            whole(prop["sale_consideration"]).alias("consideration"), whole(prop["registration_fee"]).alias("fee"),
            F.col("stamp_value").cast("decimal(15,0)").alias("stamp_value"),
            F.when(prop["paid_in_cash"] == "yes", True).when(prop["paid_in_cash"] == "no", False).alias("paid_in_cash")),
        "documents": x.select("doc_id", values.persisted_date(F.col("x.document_details.transaction_date")).alias("transaction_date"),
            F.col("x.document_details.registration_office").alias("registration_office")),
        "persons": people[0].unionByName(people[1]),
        "flags": flag_rows(report),
    }
