"""Queries of the report on extractions, of extraction without a model, and of folds, with SQL of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import cleanup, identity, language, values
from ledgerloom.operators import documents as D
from ledgerloom.operators import reports
from ledgerloom.operators import validation as V
from ledgerloom.plans.adapters import VIEWS
from ledgerloom.session import Scratch, table
from ledgerloom.sources import scrape

SEPARATORS = r"[\s\-.,:;/\\|_()\[\]{}]+"


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, answer, text, truncated, ocr_ok for each deed: what its rows say, and a text that bears out most of it."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    table(spark, sf_dir, "lineitem").repartition("l_orderkey").createOrReplaceTempView("lineitem")  # once, for all that follows
    p, d = spark.sql(VIEWS["parties"]), spark.sql(VIEWS["deeds"])
    said = F.concat_ws(" ", F.when(F.col("person") % 5 != 0, F.col("name")).otherwise("SOMEBODY ELSE"),
        F.when(F.col("person") % 7 != 0, F.col("pan")), F.when(F.col("person") % 11 != 0, F.regexp_replace("aadhaar", r"(\d{4})(?=\d)", "$1 ")))
    person = F.struct("ordinal", "name", F.col("aadhaar").alias("aadhaar_number"), F.col("pan").alias("pan_card_number"))
    side = lambda r: F.sort_array(F.collect_list(F.when(F.col("relation") == r, person)))
    own = p.groupBy("deed").agg(F.sort_array(F.collect_list(F.struct("relation", "ordinal", said.alias("line")))).alias("lines"), side("B").alias("b"), side("S").alias("s"))
    rupees = F.floor(F.col("paise") / 100).cast("bigint")
    fee, date = F.floor(rupees / 100).cast("bigint"), F.col("deed_date").cast("string")
    j = d.join(own, "deed")
    text = F.concat_ws(
        "\n", F.array_join("lines.line", "\n"), F.concat(F.lit("sold for Rs. "), values.indian_grouping(F.when(F.col("deed") % 6 == 0, rupees + 1).otherwise(rupees).cast("string"))),
        F.when(F.col("deed") % 7 != 0, F.concat(F.lit("registration fee: "), fee.cast("string"))),
            F.concat(F.lit("on "), F.date_format("deed_date", "dd-MM-yyyy")), F.when(F.col("deed") % 10 == 0, "witness ZZZPE0000K and ZZZPE1111K"),
    )
    answer = F.struct(
        F.transform("b", lambda x: x.dropFields("ordinal")).alias("buyer_details"), F.transform("s", lambda x: x.dropFields("ordinal")).alias("seller_details"),
        F.struct(rupees.cast("string").alias("sale_consideration"), fee.cast("string").alias("registration_fee"),
            F.when(F.col("deed") % 4 != 0, "yes").alias("paid_in_cash")).alias("property_details"),
        F.struct(F.when(F.col("deed") % 9 != 0, date).alias("transaction_date")).alias("document_details"),
    )
    broken = F.when(F.col("deed") % 23 == 0, "no object here {").otherwise(F.concat(F.lit("Answer: ```json\n"), F.to_json(answer), F.lit("\n``` {")))
    return j.select(F.col("deed").alias("doc_id"), broken.alias("answer"), text.alias("text"), (F.col("deed") % 29 == 0).alias("truncated"), F.lit(True).alias("ocr_ok"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate(extractions(spark, sf_dir))


def validation_persons(spark, sf_dir):
    return V.person_remarks(V.persons(extractions(spark, sf_dir))).select(F.col("doc_id").alias("deed"), "relation", "ordinal", "remarks", "confidence", "pan", "discarded_pan")


def validation_documents(spark, sf_dir):
    r = _report(spark, sf_dir)
    return r.select(F.col("doc_id").alias("deed"), "parsed", V.remark_codes().alias("remarks"), "pan_coverage", "stamp_value",
        F.array_join(F.col("fee_candidates").cast("array<string>"), ",").alias("fees"), "confidence", "disposition")


def validation_suspects(spark, sf_dir):
    return V.suspect_fields(_report(spark, sf_dir)).select(F.col("doc_id").alias("deed"), F.array_join(F.array_sort("fields"), " ").alias("fields"))


def flag_rows(spark, sf_dir):
    return V.flag_rows(_report(spark, sf_dir)).withColumnRenamed("doc_id", "deed")


def extraction_gates(spark, sf_dir):
    r = V.validate(extractions(spark, sf_dir), keep=("truncated",))
    return r.select(F.col("doc_id").alias("deed"), D.extraction_gate(F.col("parsed"), F.col("truncated"), F.col("pan_coverage"), F.size("extra_pans")).alias("gate"))


def final_states(spark, sf_dir):
    identity = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("ABC-1-"), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0")))
    return _report(spark, sf_dir).select(F.col("doc_id").alias("deed"), *V.outcome(F.col("disposition")), D.final_state(F.col("disposition"), identity).alias("state"))


def persisted_rows(spark, sf_dir):
    """Every row that a report writes, as its table's name, its document and its values."""
    report = V.validate(extractions(spark, sf_dir), keep=("x",), person=("relation", "ordinal", "flags"))
    kept = Scratch(spark, "persisted").keep("report", report.select("doc_id", "x", "stamp_value", "document_flags", "persons"))
    parts = V.persisted(kept)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    shown = {
        "properties": ("consideration", "fee", "stamp_value", "paid_in_cash"), "documents": ("transaction_date",),
        "persons": ("relation", "ordinal", "name", "pan_card_number", "aadhaar_number"), "flags": ("relation", "ordinal", "flag"),
    }
    rows = [parts[t].select(F.lit(t).alias("kind"), F.col("doc_id").alias("deed"), F.concat_ws("|", *map(text, columns)).alias("row")) for t, columns in shown.items()]
    found = rows[0]
    for r in rows[1:]:
        found = found.unionByName(r)
    return found


def flattened_fields(spark, sf_dir):
    x = V.parsed(extractions(spark, sf_dir))
    return x.select(F.col("doc_id").alias("deed"), V.field_at(F.lit("b1.pan_card_number"), F.col("x")).alias("first_buyer"),
        V.field_at(F.lit("property.sale_consideration"), F.col("x")).alias("sale"), V.field_at(F.lit("s99.name"), F.col("x")).alias("none"))


def scraped(spark, sf_dir):
    """What patterns alone find in the texts of the deeds."""
    s = extractions(spark, sf_dir).select(F.col("doc_id").alias("deed"), scrape.scrape(F.col("text")).alias("x"))
    number = lambda side, f: F.array_join(F.transform(F.col(f"x.{side}_details"), lambda p: F.coalesce(p[f], F.lit("-"))), ",")
    return s.select("deed", number("buyer", "pan_card_number").alias("buyer_pans"),
        number("seller", "pan_card_number").alias("seller_pans"), number("buyer", "aadhaar_number").alias("buyer_aadhaars"),
        F.col("x.property_details.sale_consideration").alias("sale"), F.col("x.property_details.registration_fee").alias("fee"),
        F.col("x.document_details.transaction_date").alias("date"))


def identifier_recall(spark, sf_dir):
    rows = V.parsed(extractions(spark, sf_dir)).select(F.col("doc_id"), "text", F.col("x").alias("extraction"))
    return reports.identifier_recall(rows.filter("extraction IS NOT NULL")).select(F.col("doc_id").alias("deed"),
        F.col("in_text").cast("bigint").alias("in_text"), F.col("extracted").cast("bigint").alias("extracted"))


#: Values as a translator gives them, and as a cell shows them.
FRAGMENTS = (
    ("What is Venkatesh?", "Venkatesh"), ("It is located at 4th Cross Road.", "4th Cross Road"), ("The male", "Male"), ("the lady!", "Female"), ("The Old Bank", "The Old Bank"),
    ("the bank", "Bank"), ("a  big   house , here", "A big house, here"), ("???", "???"), ("this is a shop", "Shop"), ("", ""),
)


def tidied(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    t = F.element_at(F.array(*[F.lit(a) for a, _ in FRAGMENTS]), (F.col("doc_id") % len(FRAGMENTS) + 1).cast("int"))
    return docs.select("doc_id", language.tidy(t).alias("shown"))


#: Names in other scripts and in plain letters.
WRITTEN = (
    ("ಜಿ.ಕೆ. ರಾಜು", "G.K. Raju"), ("ಶಶಿಕುಮಾರ್.ಆರ್", "Shashikumar R."), ("ವಿಜಯ್ಕುಮಾರ್ ಕೆ. ಎಂ", "Vijaykumar K. M."), ("रमेश कुमार", "Ramesh Kumar"), ("महाराष्ट्र", "Maharashtra"), ("सुनीता", "Sunita"),
    ("ಗೌಡ", "Gowda"), ("एम. राम", "M. Ram"), ("Ravi ಮನೆ 12", "Ravi Mane 12"), ("ಚಂದ್ರ", "Chandra"),
)


def written_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    t = F.element_at(F.array(*[F.lit(a) for a, _ in WRITTEN]), (F.col("doc_id") % len(WRITTEN) + 1).cast("int"))
    return docs.select("doc_id", language.transliterate(t).alias("shown"))


def headerless_pages(spark, sf_dir):
    """Each document as pages of a book of its source, with a line that all of them carry."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    pages = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), F.concat(F.lit("  Office of the Registrar  \n"), F.regexp_replace("text", "\n", " ")).alias("body"))
    return cleanup.without_headers(pages).select(F.col("page_number").alias("page"), F.md5("body").alias("digest"))


def _pages(spark, sf_dir):
    """Documents as pages of lines, the number on the last page of some."""
    d = F.col("doc_id")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("page_count"), F.posexplode(lines).alias("k", "line"))
    number = F.concat(F.lit("document number ABC-1-"), (d + 10000).cast("string"), F.lit("-2025-26"))
    return docs.select("doc_id", "page_count", (F.col("k") + 1).alias("page_number"), F.when((d % 2 == 0) & (F.col("k") + 1 == F.col("page_count")), number).otherwise(F.col("line")).alias("body"))


def pages_without_text(spark, sf_dir):
    return identity.pages_without_text(_pages(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("page_number").alias("first"))


def certificate_pages(spark, sf_dir):
    return identity.certificate_pages(_pages(spark, sf_dir)).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("page_number")).cast("array<string>"), ",").alias("pages"))


def second_chances(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("none here").alias("text"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("XYZ-1-"), (F.col("doc_id") + 10000).cast("string"),
        F.lit("-2024-25.pdf"))).otherwise("").alias("source"))
    return identity.second_chance(docs, _pages(spark, sf_dir)).withColumn("confidence", F.col("confidence").cast("double"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (validation_persons, validation_documents,
    validation_suspects, flag_rows, extraction_gates, final_states, persisted_rows, flattened_fields, scraped, identifier_recall, tidied,
    written_names, headerless_pages, pages_without_text, certificate_pages, second_chances)}

_Q = "'"


def _bare(x: str) -> str:
    return f"upper(regexp_replace({x}, '{SEPARATORS}', '', 'g'))"


_GROUPED = "CASE WHEN length(r) <= 3 THEN r WHEN length(r) <= 5 THEN concat(left(r, length(r) - 3), ',', right(r, 3)) WHEN length(r) <= 7 THEN concat(left(r, length(r) - 5), ',', substr(r, length(r) - 4, 2), ',', right(r, 3)) ELSE concat(left(r, length(r) - 7), ',', substr(r, length(r) - 6, 2), ',', substr(r, length(r) - 4, 2), ',', right(r, 3)) END"
_AMOUNT = lambda d: f"regexp_matches(text, concat('(^|[^0-9])', array_to_string(string_split({d}, ''), '[\\s,]*'), '($|[^0-9])'))"
_NAME_THERE = f"({_bare('name')} <> '' AND contains(norm, {_bare('name')}) OR len(list_filter(words, lambda w: contains(norm, {_bare('w')}))) >= 2 OR len(words) = 1 AND len(list_filter(words, lambda w: contains(norm, {_bare('w')}))) = 1)"
#: The texts of the deeds, what each party's row claims, and how it holds against the text.
_WITH = f"""WITH parties AS ({VIEWS["parties"]}), deeds AS ({VIEWS["deeds"]}),
l AS (SELECT *, concat_ws(' ', CASE WHEN person % 5 <> 0 THEN name ELSE 'SOMEBODY ELSE' END, CASE WHEN person % 7 <> 0 THEN pan END,
            CASE WHEN person % 11 <> 0 THEN concat(left(aadhaar, 4), ' ', substr(aadhaar, 5, 4), ' ', right(aadhaar, 4)) END) AS line
            FROM parties),
a AS (SELECT deed, string_agg(line, chr(10) ORDER BY relation, ordinal) AS lines FROM l GROUP BY deed),
b AS (SELECT d.deed, d.deed_date, CAST(paise // 100 AS VARCHAR) AS sale, CAST(paise // 10000 AS VARCHAR) AS fee, CAST(CASE WHEN d.deed % 6 = 0 THEN paise // 100 + 1 ELSE paise // 100 END AS VARCHAR) AS r, lines
            FROM deeds AS d JOIN a ON d.deed = a.deed),
t AS (SELECT deed, deed_date, sale, fee, deed % 23 <> 0 AS parsed, concat_ws(chr(10), lines, concat('sold for Rs. ', {_GROUPED}),
            CASE WHEN deed % 7 <> 0 THEN concat('registration fee: ', fee) END, concat('on ', strftime(deed_date, '%d-%m-%Y')),
            CASE WHEN deed % 10 = 0 THEN 'witness ZZZPE0000K and ZZZPE1111K' END) AS text FROM b),
n AS (SELECT *, {_bare("text")} AS norm, list_distinct(regexp_extract_all(upper(text), '\\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\\b')) AS source FROM t),
c AS (SELECT p.*, text, norm, list_filter(string_split(name, ' '), lambda w: length(w) >= 3) AS words, contains(norm, pan) AS pan_there, contains(norm, aadhaar) OR contains(regexp_replace(text, '[\\s\\-.]', '', 'g'),
            aadhaar) AS aadhaar_there,
    list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 10) = pan) AS pan_at, list_filter(range(1, length(text) + 1),
            lambda i: substr(text, i, 14) = concat(left(aadhaar, 4), ' ', substr(aadhaar, 5, 4), ' ', right(aadhaar, 4))) AS aadhaar_at
            FROM parties AS p JOIN n ON p.deed = n.deed WHERE parsed),
f AS (SELECT *, {_NAME_THERE} AS name_there, len(pan_at) > 0 AND len(aadhaar_at) > 0 AND len(list_filter(pan_at, lambda i: len(list_filter(aadhaar_at, lambda j: abs(i - j) <= 250)) > 0)) = 0 AS far
            FROM c),
g AS (SELECT *, coalesce(CASE WHEN pan IS NOT NULL THEN CASE WHEN pan_there THEN 1.0E0 ELSE 0.25E0 END END, 0) + coalesce(CASE WHEN aadhaar IS NOT NULL THEN
            CASE WHEN aadhaar_there THEN 1.0E0 ELSE 0.25E0 END END, 0) + CASE WHEN name_there THEN 1.0E0 ELSE 0.25E0 END +
            CASE WHEN far THEN 0.4E0 ELSE 0 END AS points,
    CASE WHEN pan IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN aadhaar IS NOT NULL THEN 1 ELSE 0 END + 1 + CASE WHEN far THEN 1 ELSE 0 END AS checks,
    CASE WHEN pan IS NOT NULL AND NOT pan_there THEN 1 ELSE 0 END + CASE WHEN aadhaar IS NOT NULL AND NOT aadhaar_there THEN 1 ELSE 0 END +
            CASE WHEN name_there THEN 0 ELSE 1 END + CASE WHEN far THEN 1 ELSE 0 END AS doubts,
    list_filter([CASE WHEN pan IS NOT NULL THEN CASE WHEN pan_there THEN 'PM' ELSE 'HPAN' END END, CASE WHEN aadhaar IS NOT NULL AND NOT aadhaar_there THEN 'WAN' END,
            CASE WHEN NOT name_there THEN 'WNM' END, CASE WHEN far THEN 'PAF' END], lambda x: x IS NOT NULL) AS flags
            FROM f),
h AS (SELECT deed, sum(points) AS points, sum(checks) AS checks, sum(doubts) AS doubts, bool_or(list_has_any(flags, ['HPAN', 'WAN', 'PAF'])) AS bad, list_distinct(list(pan) FILTER (WHERE pan IS NOT NULL)) AS claimed, list_distinct(list(pan) FILTER (WHERE pan_there)) AS kept
            FROM g GROUP BY deed),
m AS (SELECT n.*, coalesce(points, 0) AS points, coalesce(checks, 0) AS checks, coalesce(doubts, 0) AS doubts, coalesce(bad, false) AS bad,
            CASE WHEN parsed THEN list_sort(list_filter(source, lambda s: NOT list_contains(coalesce(kept, []),
            s))) ELSE [] END AS extra,
    CASE WHEN NOT parsed THEN 0.0E0 WHEN len(source) = 0 THEN 1.0E0 ELSE round_even(CAST(len(list_filter(source, lambda s: list_contains(coalesce(claimed, []),
            s))) AS DOUBLE) / len(source), 3) END AS coverage,
    {_AMOUNT("sale")} AS sale_there, {_AMOUNT("fee")} AS fee_there, CASE WHEN n.deed % 7 <> 0 AND CAST(fee AS BIGINT) BETWEEN 100 AND 1000000 THEN fee ELSE '' END AS fees
            FROM n LEFT JOIN h ON n.deed = h.deed),
k AS (SELECT *, CASE WHEN sale_there THEN 1.0E0 ELSE 0.25E0 END + CASE WHEN fee_there THEN 1.0E0 ELSE 0.25E0 END +
            CASE WHEN deed % 9 <> 0 THEN 1.0E0 ELSE 0.0E0 END AS more, 3 + CASE WHEN deed % 4 = 0 THEN 1 ELSE 0 END AS more_checks,
    CASE WHEN sale_there THEN 0 ELSE 1 END + CASE WHEN fee_there THEN 0 ELSE 1 END + CASE WHEN deed % 9 = 0 THEN 1 ELSE 0 END + CASE WHEN deed % 4 = 0 THEN 1 ELSE 0 END AS more_doubts,
    list_filter(['OCR_P', CASE WHEN deed % 29 = 0 THEN 'TRC' END, CASE WHEN parsed AND NOT sale_there THEN 'WSC' END,
            CASE WHEN parsed AND NOT fee_there THEN 'WSV' END, CASE WHEN parsed AND deed % 9 = 0 THEN 'WTD' END], lambda x: x IS NOT NULL) AS flags
            FROM m),
v AS (SELECT *, CASE WHEN NOT parsed OR coverage < 0.6E0 AND len(extra) >= 2 THEN 'retry' WHEN bad OR list_has_any(flags, ['TRC', 'WSC', 'WSV']) THEN 'review' ELSE 'accept' END AS disposition FROM k)
"""

_PAGES = """WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
            p AS (SELECT doc_id, len(l) AS n, k, CASE WHEN doc_id % 2 = 0 AND k = len(l) THEN concat('document number ABC-1-', CAST(doc_id + 10000 AS VARCHAR),
            '-2025-26') ELSE l[k] END AS body
    FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM s) AS u) """

SQL: dict[str, str] = {
    "validation_persons": _WITH + "SELECT deed, relation, CAST(ordinal AS INTEGER) AS ordinal, array_to_string(flags, ' ') AS remarks, round_even(points / checks, 3) AS confidence, CASE WHEN pan_there THEN pan END AS pan, CASE WHEN NOT pan_there THEN pan END AS discarded_pan FROM g",
    "validation_documents": _WITH + """SELECT deed, parsed, concat(array_to_string(flags, ' '), CASE WHEN len(extra) > 0 THEN concat(' XPAN:', array_to_string(extra, ',')) ELSE '' END) AS remarks, coverage AS pan_coverage,
        CASE WHEN parsed AND deed % 9 <> 0 THEN CAST(floor(CAST(fee AS BIGINT) * 0.5E0 + 0.5E0) AS BIGINT) END AS stamp_value, fees,
            CASE WHEN parsed THEN round_even((points + more) / (checks + more_checks), 3) ELSE 0.0E0 END AS confidence, disposition
            FROM v""",
    "validation_suspects": _WITH + """, o AS (SELECT deed, flatten(list(list_filter([CASE WHEN pan IS NOT NULL AND NOT pan_there THEN concat(relation, ordinal, '.pan') END,
            CASE WHEN aadhaar IS NOT NULL AND NOT aadhaar_there THEN concat(relation, ordinal, '.aadhaar') END,
            CASE WHEN NOT name_there THEN concat(relation, ordinal, '.name') END, CASE WHEN far THEN concat(relation, ordinal, '.pan_aadhaar_proximity') END], lambda x: x IS NOT NULL))) AS own
            FROM g GROUP BY deed)
        SELECT v.deed, CASE WHEN parsed THEN array_to_string(list_sort(list_concat(coalesce(own, []),
            list_filter([CASE WHEN NOT sale_there THEN 'sale_consideration' END, CASE WHEN NOT fee_there THEN 'registration_fee' END,
            CASE WHEN v.deed % 9 = 0 THEN 'transaction_date' END, CASE WHEN v.deed % 4 = 0 THEN 'paid_in_cash' END], lambda x: x IS NOT NULL))),
            ' ') ELSE '' END AS fields FROM v LEFT JOIN o ON v.deed = o.deed""",
    "flag_rows": _WITH + "SELECT deed, relation, CAST(ordinal AS INTEGER) AS ordinal, unnest(flags) AS flag FROM g UNION ALL SELECT deed, NULL, NULL, unnest(flags) FROM v",
    "extraction_gates": _WITH + "SELECT deed, CASE WHEN NOT parsed THEN 'no_json' WHEN deed % 29 = 0 THEN 'truncated' WHEN coverage < 0.6E0 AND len(extra) >= 2 THEN 'low_coverage' ELSE 'accepted' END AS gate FROM v",
    "final_states": _WITH + "SELECT deed, disposition <> 'retry' AS ok, disposition = 'review' AS needs_review, CASE WHEN disposition = 'accept' AND deed % 3 <> 0 THEN 'processed' ELSE 'needs_review' END AS state FROM v",
    "persisted_rows": _WITH + """SELECT 'properties' AS kind, deed, CASE WHEN parsed THEN concat_ws('|', sale, fee,
            CASE WHEN deed % 9 <> 0 THEN CAST(CAST(floor(CAST(fee AS BIGINT) * 0.5E0 + 0.5E0) AS BIGINT) AS VARCHAR) ELSE '-' END,
            CASE WHEN deed % 4 <> 0 THEN 'true' ELSE '-' END) ELSE '-|-|-|-' END AS row FROM n
        UNION ALL SELECT 'documents', deed, CASE WHEN parsed AND deed % 9 <> 0 THEN strftime(deed_date, '%Y-%m-%d') ELSE '-' END FROM n
        UNION ALL SELECT 'persons', deed, concat_ws('|', relation, CAST(ordinal AS VARCHAR), name, coalesce(pan, '-'), coalesce(aadhaar, '-')) FROM g
        UNION ALL SELECT 'flags', deed, concat_ws('|', relation, CAST(ordinal AS VARCHAR), unnest(flags)) FROM g UNION ALL SELECT 'flags', deed, concat_ws('|', '-', '-', unnest(flags)) FROM v""",
    "flattened_fields": _WITH + "SELECT n.deed, p.pan AS first_buyer, CASE WHEN parsed THEN sale END AS sale, NULL AS none FROM n LEFT JOIN parties AS p ON n.deed = p.deed AND relation = 'B' AND ordinal = 1 AND parsed",
    "scraped": _WITH + """, s AS (SELECT deed, deed_date, sale, fee, r, text, p, q, greatest(CASE WHEN len(p) > 0 THEN 1 ELSE 0 END, len(p) // 2) AS half
            FROM (SELECT n.*, r, list_filter(regexp_extract_all(text, '\\b[A-Z]{5}[0-9]{4}[A-Z]\\b'),
            lambda x, i: list_position(regexp_extract_all(text, '\\b[A-Z]{5}[0-9]{4}[A-Z]\\b'), x) = i) AS p,
        list_filter(regexp_extract_all(text, '\\b\\d{4} \\d{4} \\d{4}\\b'), lambda x, i: list_position(regexp_extract_all(text, '\\b\\d{4} \\d{4} \\d{4}\\b'),
            x) = i) AS q FROM n JOIN b ON n.deed = b.deed) AS z),
        w AS (SELECT *, p[1:half] AS bp, p[half + 1:] AS sp, list_transform(q[1:half], lambda x: replace(x, ' ', '')) AS ba, q[half + 1:] AS sa FROM s)
        SELECT deed, array_to_string(list_transform(range(1, greatest(len(bp), len(ba)) + 1), lambda i: coalesce(bp[i], '-')),
            ',') AS buyer_pans, array_to_string(list_transform(range(1, greatest(len(sp), len(sa)) + 1),
            lambda i: coalesce(sp[i], '-')), ',') AS seller_pans,
        array_to_string(list_transform(range(1, greatest(len(bp), len(ba)) + 1), lambda i: coalesce(ba[i], '-')),
            ',') AS buyer_aadhaars, r AS sale, CAST(NULL AS VARCHAR) AS fee, strftime(deed_date, '%Y-%m-%d') AS date
            FROM w""",
    "identifier_recall": _WITH + """, i AS (SELECT n.deed, list_distinct(list_concat(source, list_transform(regexp_extract_all(text, '\\b\\d{4} \\d{4} \\d{4}\\b'),
            lambda x: replace(x, ' ', '')))) AS ids FROM n WHERE parsed), j AS (SELECT deed, list(pan) FILTER (WHERE pan IS NOT NULL) AS pans, list(aadhaar) FILTER (WHERE aadhaar IS NOT NULL) AS aadhaars
            FROM parties GROUP BY deed)
        SELECT i.deed, len(ids) AS in_text, len(list_filter(ids, lambda x: list_contains(coalesce(pans, []),
            x) OR list_contains(coalesce(aadhaars, []), x))) AS extracted FROM i JOIN j ON i.deed = j.deed""",
    "tidied": f"SELECT doc_id, CASE doc_id % {len(FRAGMENTS)} {' '.join(f'WHEN {k} THEN {_Q}{b}{_Q}' for k, (_, b) in enumerate(FRAGMENTS))} END AS shown FROM documents",
    "written_names": f"SELECT doc_id, CASE doc_id % {len(WRITTEN)} {' '.join(f'WHEN {k} THEN {_Q}{b}{_Q}' for k, (_, b) in enumerate(WRITTEN))} END AS shown FROM documents",
    "pages_without_text": _PAGES + "SELECT doc_id, count(*) AS n, CAST(min(k) AS INTEGER) AS first FROM p WHERE length(trim(body)) < 40 GROUP BY doc_id",
    "certificate_pages": _PAGES + "SELECT doc_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS pages FROM p WHERE k <= 2 OR k > n - 2 GROUP BY doc_id",
    "second_chances": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('XYZ-1-', CAST(doc_id + 10000 AS VARCHAR),
            '-2024-25') WHEN doc_id % 2 = 0 THEN concat('ABC-1-', CAST(doc_id + 10000 AS VARCHAR), '-2025-26') ELSE '' END AS identity,
        CASE WHEN doc_id % 4 = 0 THEN 0.6E0 WHEN doc_id % 2 = 0 THEN 0.95E0 ELSE 0.0E0 END AS confidence, doc_id % 4 = 2 AS from_pages FROM documents""",
    "headerless_pages": "SELECT doc_id AS page, md5(replace(text, chr(10), ' ')) AS digest FROM documents WHERE text IS NOT NULL",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
