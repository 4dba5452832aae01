"""Comparisons and tallies: run against run, identities, identifiers, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import language, values

#: Rows of a part when two runs are compared.
PART = 500_000


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, by name."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = each[0]
    for one in each[1:]:
        out = out.unionByName(one)
    return out


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Both: document, field, value. A row a field of documents that both runs have, with a verdict.

    Empty and null are one; values are compared as they are and folded. Both runs are dealt by
    document once, into so many parts that one holds about ``PART`` rows whatever the input.
    """
    side = lambda df, first: df.filter("document IS NOT NULL").select("document", "field", F.nullif(values.strip("value"), F.lit("")).alias("value"), F.lit(first).alias("first"))
    parts = max(1, -(-(baseline.count() + candidate.count()) // PART))
    dealt = side(baseline, True).unionByName(side(candidate, False)).repartition(parts, "document")
    of = lambda mine: F.collect_list(F.when(mine, F.struct("value")))
    fields = dealt.groupBy("document", "field").agg(of(F.col("first")).alias("a"), of(~F.col("first")).alias("b"))
    own = Window.partitionBy("document")
    both = fields.withColumns({"in_a": F.max(F.size("a") > 0).over(own), "in_b": F.max(F.size("b") > 0).over(own)}).filter("in_a AND in_b")
    pair = lambda a, b: F.struct(a["value"].alias("old"), b["value"].alias("new"))
    none = F.lit(None).cast(fields.schema["a"].dataType.elementType)
    left, right = F.transform("a", lambda a: pair(a, none)), F.transform("b", lambda b: pair(none, b))
    met = F.flatten(F.transform("a", lambda a: F.transform("b", lambda b: pair(a, b))))
    # a field without a name is no other's field
    pairs = F.when(F.col("field").isNull() | (F.size("a") == 0) | (F.size("b") == 0), F.concat(left, right)).otherwise(met)
    joined = both.select("document", "field", F.inline(pairs))
    old, new = F.col("old"), F.col("new")
    verdict = F.when(old.eqNullSafe(new), "same").when(old.isNull(), "added").when(new.isNull(), "lost").when(values.fold(old) == values.fold(new), "same_text").otherwise("changed")
    return joined.withColumn("verdict", verdict)


def missing_documents(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Documents that only the first run has."""
    return baseline.select("document").distinct().join(candidate.select("document").distinct(), "document", "left_anti")


def agreement(compared: DataFrame) -> DataFrame:
    """Per field: compared, equal, equal in letters and digits, and the share of either."""
    same, text = F.count_if(F.col("verdict") == "same"), F.count_if(F.col("verdict").isin("same", "same_text"))
    return compared.groupBy("field").agg(F.count("*").alias("compared"), same.alias("exact"),
        text.alias("by_text")).withColumns({"exact_percent": F.round(F.col("exact") * 100.0 / F.col("compared"), 2),
        "text_percent": F.round(F.col("by_text") * 100.0 / F.col("compared"), 2)})


def faults(compared: DataFrame, most: int = 40) -> DataFrame:
    """The first fields that differ."""
    return compared.filter(~F.col("verdict").isin("same", "same_text")).orderBy("document", "field").limit(most)


def identity_verdicts(documents: DataFrame) -> DataFrame:
    """documents: id, identity (found), want (null where unknown). A verdict each."""
    got, want = F.nullif("identity", F.lit("")), F.nullif("want", F.lit(""))
    return documents.withColumn("verdict", F.when(got.isNull(), "blank").when(want.isNull(), "unknown").when(got == want, "agree").otherwise("disagree"))


def identity_accuracy(documents: DataFrame, by: list[str]) -> DataFrame:
    """Counts of verdicts, agreement where it can be checked, and whether the run passes."""
    v = identity_verdicts(documents)
    n = lambda name: F.count_if(F.col("verdict") == name).alias(name)
    found = v.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("verdict") != "blank").alias("found"), n("blank"), n("agree"), n("disagree"), n("unknown"))
    checked = F.col("agree") + F.col("disagree")
    return found.withColumns({"percent": F.when(checked > 0, F.round(100.0 * F.col("agree") / checked, 1)), "passed": (F.col("disagree") == 0) & (F.col("found") * 10 >= F.col("total") * 9)})


def identifiers(text: Column) -> Column:
    """PANs and 12-digit numbers of a text, as they are once joined, without repeats."""
    own = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(values.PAN_ANYWHERE), F.lit(0))
    other = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)\d{4}[\s-]?\d{4}[\s-]?\d{4}(?!\d)"), F.lit(0)), values.digits)
    return F.array_distinct(F.concat(own, other))


def blob(extraction: Column) -> Column:
    """An extraction as one searchable text: upper case, without white space and hyphens."""
    return F.upper(F.regexp_replace(F.to_json(extraction), r"[\s\-]", ""))


def identifier_recall(rows: DataFrame) -> DataFrame:
    """rows: doc_id, text, extraction. Identifiers of the text, and how many the extraction has."""
    found = rows.select("doc_id", identifiers(F.col("text")).alias("ids"), blob(F.col("extraction")).alias("blob"))
    return found.select("doc_id", F.size("ids").alias("in_text"), F.size(F.filter("ids", lambda i: F.contains(F.col("blob"), i))).alias("extracted"))


def language_histogram(rows: DataFrame, text: str = "text", devanagari_as: str = "hin_Deva") -> DataFrame:
    """Texts per language, commonest first; what has no letters isn't counted."""
    t = F.col(text)
    told = rows.filter(language.script(t) != "neutral").groupBy(language.language(t, devanagari_as).alias("language")).agg(F.count("*").alias("n"))
    return told.orderBy(F.desc("n"), "language")


def translation_tally(items: DataFrame, cache: DataFrame) -> DataFrame:
    """items: id, text. Per language and reason: how many items ask for translation, distinct texts, and those the cache has."""
    t = F.col("text")
    reason = F.when(language.script(t) == "latin", "latin with other letters").otherwise("script")
    asked = items.filter(language.needs_translation(t)).withColumns({"language": language.language(t), "reason": reason})
    known = cache.select("text").distinct().withColumn("hit", F.lit(1))
    per_text = asked.groupBy("language", "reason", "text").agg(F.count("*").alias("n"))
    joined = per_text.join(known, "text", "left")
    return joined.groupBy("language", "reason").agg(F.sum("n").alias("items"), F.count("*").alias("texts"), F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("misses"))


def untranslated(items: DataFrame) -> DataFrame:
    """items: id, text, translated. Those that need a translation and have none."""
    return items.filter(language.needs_translation(F.col("text")) & (F.coalesce("translated", F.lit("")) == ""))


def assigned(items: DataFrame, answers: DataFrame) -> DataFrame:
    """items: id, text; answers: id, text. Each item's answer, or the error that there is none."""
    told = answers.select("id", F.col("text").alias("translated"))
    joined = items.join(told, "id", "left")
    return joined.withColumn("error", F.when(F.coalesce(F.trim("translated"), F.lit("")) == "", "the answer is empty"))
