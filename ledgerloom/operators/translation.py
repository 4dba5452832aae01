"""Translation of many fields: what a cache knows, the rest in rounds, and the repair of stored rows.

A runner is a function from a DataFrame (id, text, language) to one (id, text); an id that it
leaves out, or gives an empty text for, is asked again in the next round. The cache is a
versioned table bucketed by a hash of (text, language, target): a run joins its distinct texts
to it, asks for the misses only, and appends the answers, so that later runs, and others at
the same time, find them. Equal answers appended twice by two runs count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import language
from ledgerloom.operators.documents import needing_translation
from ledgerloom.session import Scratch
from ledgerloom.sources.versions import VersionedTable

NOTHING = "the model returned nothing"
ROUNDS = 2
KEY = ["hash", "text", "language", "target"]
CACHE = "hash long, text string, language string, target string, translated string"

Runner = Callable[[DataFrame], DataFrame]


def ask(items: DataFrame, runner: Runner, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """items: id, text, language, ids once each. Adds translated, attempts and error; each round asks for what has no answer yet.

    A round's answers are a table of their own, so that a lost executor costs one round and
    the next one begins from what is written; it ends early when nothing is open.
    """
    open_items, parts = scratch.keep("asked-0", items.select("id", "text", "language")), []
    for k in range(1, rounds + 1):
        told = runner(open_items).select("id", F.nullif(F.trim("text"), F.lit("")).alias("translated"))
        told = told.groupBy("id").agg(F.max("translated").alias("translated"))
        answered = scratch.keep(f"answers-{k}", open_items.join(told, "id", "left"))
        parts.append(answered.filter("translated IS NOT NULL").withColumn("attempts", F.lit(k)))
        left = answered.filter("translated IS NULL").drop("translated")
        if k == rounds or left.isEmpty():
            parts.append(left.withColumns({"translated": F.lit(None).cast("string"), "attempts": F.lit(k)}))
            break
        open_items = left
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.withColumn("error", F.when(F.col("translated").isNull(), NOTHING))


def cache(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTable:
    """The cache at a path, made if there is none."""
    found = VersionedTable(spark, path)
    return found if found.version() else VersionedTable.create(spark, path, spark.createDataFrame([], CACHE), ["hash"], buckets)


def translate(items: DataFrame, known: VersionedTable, runner: Runner, scratch: Scratch, target: str = "eng_Latn", rounds: int = ROUNDS) -> DataFrame:
    """items: id, text. Adds language, translated, from_cache, attempts and error to those that ask for a translation.

    Null and empty texts, those without letters, and those of the target language without
    another script's letters ask for none and come back with nulls.
    """
    told = translated_texts(items, known, runner, scratch, target, rounds)
    return items.join(told, "text", "left").withColumn("language", F.coalesce("language", language.language(F.lit(""))))


def translated_texts(items: DataFrame, known: VersionedTable, runner: Runner, scratch: Scratch, target: str = "eng_Latn", rounds: int = ROUNDS) -> DataFrame:
    """items: text. Each text once, nulls left out, with what ``translate`` adds; its language is told once, however many items have it."""
    texts = items.select("text").filter("text IS NOT NULL").distinct()
    told = scratch.keep("detected", texts.withColumns({"language": language.language(F.col("text")), "wanted": language.wants(F.col("text"), target)}))
    wanted = told.filter("wanted").select("text", "language").withColumns({"target": F.lit(target), "hash": F.xxhash64("text", "language", F.lit(target))})
    stored = known.read().filter(F.col("target") == target).groupBy(*KEY).agg(F.max("translated").alias("translated"))
    looked_up = scratch.keep("looked_up", wanted.join(stored, KEY, "left"))
    misses = looked_up.filter("translated IS NULL").select(F.col("hash").alias("id"), "text", "language")
    # equal hashes of different texts are told apart by their order under one hash
    misses = scratch.keep("misses", misses.withColumn("id", F.xxhash64("id", "text", "language")))
    answers = scratch.keep("answers", ask(misses, runner, scratch, rounds))
    fresh = answers.filter("translated IS NOT NULL")
    if not fresh.isEmpty():
        known.append(fresh.select(F.xxhash64("text", "language", F.lit(target)).alias("hash"), "text", "language", F.lit(target).alias("target"), "translated"), about="answers")
    hits = looked_up.filter("translated IS NOT NULL").select("text", "language", "translated", F.lit(True).alias("from_cache"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    done = hits.unionByName(answers.select("text", "language", "translated", F.lit(False).alias("from_cache"), "attempts", "error"))
    return done.unionByName(told.filter("NOT wanted").drop("wanted"), allowMissingColumns=True)


def repair(docs: DataFrame, persons: DataFrame, known: VersionedTable, runner: Runner, scratch: Scratch, batch: int | None = None,
    fields: tuple[str, ...] = ("name",), target: str = "eng_Latn") -> DataFrame:
    """Persons of documents that lack a translated name, with ``<field>_translated`` filled from the cache or the runner.

    Chooses the documents, translates their persons' fields, and writes what came back beside
    the originals; a field without an answer keeps what it had. ``written`` says which rows changed.
    Persons are computed once, and each distinct text is looked at once; rows then take its translation.
    """
    kept = scratch.keep("persons", persons)
    chosen = needing_translation(docs, kept, batch).select(F.col("id").alias("document_id"), F.lit(True).alias("_chosen"))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    asked = kept.join(chosen, "document_id", "left").withColumns({f"_{f}": F.when(F.col("_chosen") & empty(F.col(f"{f}_translated")), F.col(f)) for f in fields})
    told = translated_texts(asked.select(F.explode(F.array(*[f"_{f}" for f in fields])).alias("text")), known, runner, scratch, target)
    # what has no letters of another script is its own translation
    shown = told.select("text", F.coalesce("translated", F.when(~language.wants(F.col("text"), target), F.col("text"))).alias("_value"))
    shown = scratch.keep("shown", shown.filter("_value <> ''"))
    fixed = asked
    for f in fields:
        fixed = fixed.join(shown.select(F.col("text").alias(f"_{f}"), F.col("_value").alias(f"_new_{f}")), f"_{f}", "left")
    written = F.array_contains(F.array(*[F.col(f"_new_{f}").isNotNull() for f in fields]), True)
    values = {f"{f}_translated": F.coalesce(f"_new_{f}", f"{f}_translated") for f in fields}
    return fixed.select(*[values.get(c, F.col(c)).alias(c) for c in kept.columns], written.alias("written"))
