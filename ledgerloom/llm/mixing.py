"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

Each source's documents, in a seeded order, form one stream of words cut into equal blocks.
The words of the mix go to sources by highest quotients (weight over 2q + 1), and each
source's quota goes the same way to its shards, runs of blocks of equal length with a shorter
last one. In a shard, every word is read as often as its quota holds the shard; the rest is
filled block by block, in an order that a seeded permutation gives, and the last block is
cut where the quota ends. So a source of any size takes its quota to the word. A document's
share is the sum over the blocks it touches.

Nothing of a source's rows ever meets in one task: places in a stream come from sums over
hash buckets of a bounded number of documents and a running total over the buckets, and
all that a document needs of its source is one row of figures.

Cases: a null text has size 0 and is taken 0 times; a null source is a source, last in
order; documents with equal ids, and repeated rows, count each by itself; a source without
words has target 0; an empty table gives no rows. Columns other than those named are not
read. No word is taken more than twice, so no document exceeds twice its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import Scratch, table

WEIGHTS = (3, 1, 2)
#: The mix's size over that of all documents, and a source's most over its own.
SHARE, MOST = 1.5, 2
SEED = "mix-1"
#: Words of a block, at every size; and where blocks are to be read as passages.
BLOCK, PASSAGE = 32, 256
#: Blocks of a shard; more where a source would have over 1,048,576 shards.
SHARD, SHARDS = 1024, 1_048_576
#: Documents of a bucket, within which places are counted; at most 65,536 buckets a source.
BUCKET, BUCKETS = 128, 65_536
#: A prime above any number of blocks in a shard: j * PRIME mod n then permutes 0..n-1.
PRIME = 1_500_450_271
WORD = r"[^\x20\x09-\x0D]+"


def source_figures(sizes: DataFrame, spark: SparkSession, block: int = BLOCK) -> DataFrame:
    """One row a source: size, target, and the figures from which any block's count follows."""
    sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).createOrReplaceTempView("mix_sources")
    # windows without a partition see one row a source, never one a document
    return spark.sql(_figures("mix_sources", "least(65536, (n_docs + 127) div 128)".replace("65536", str(BUCKETS)).replace("128", str(BUCKET)).replace("127", str(BUCKET - 1)), "div", "get(filter(sequence({0}, {0} + 6), {1}), 0)", "q ->", "CAST(conv(substr(md5(concat('{0}:', coalesce(source, ''), ':', source IS NULL)), 1, 7), 16, 10) AS BIGINT)", block))


def _figures(sources: str, buckets: str, div: str, first: str, q: str, number: str, block: int = BLOCK) -> str:
    """SQL for the source figures; the dialects differ in the arguments only.

    Quotas begin at targets rounded to words; the difference ``d`` to the mix's size goes by
    quotients. If n sources aren't full and aim at ``open`` words together, a divisor near 1
    gives each of them at most target / open * (n + 1) / 2 + 1 words more or less, so so many
    offers of a source, doubled, are enough, and all offers are few times the sources.
    """
    weight = f"CASE (rank - 1) % {len(WEIGHTS)} " + " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS)) + " END"
    salt = number.replace("{0}", SEED)
    last = first.replace("{0}", "greatest(0, CAST(floor(CAST(quota AS DOUBLE) * n_last / source_size) AS BIGINT) - 2)").replace("{1}", f"{q} n_last * (2 * ((quota - q + whole - 1) {div} whole) - 1) <= shard * (2 * q + 1)")
    return f"""
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM {sources}),
weighed AS (SELECT *, CAST({weight} AS BIGINT) AS weight FROM ranked),
level AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights, {MOST} * source_size / CAST(weight AS DOUBLE) AS full_at FROM weighed),
poured AS (SELECT *, CAST({SHARE} AS DOUBLE) * total AS wanted, CAST((sum({MOST} * source_size) OVER w) - {MOST} * source_size AS BIGINT) AS below, CAST((sum(weight) OVER w) - weight AS BIGINT) AS gone, row_number() OVER w AS k FROM level
    WINDOW w AS (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
risen AS (SELECT *, CAST(wanted - below AS DOUBLE) / CAST(weights - gone AS DOUBLE) AS lambda0 FROM poured),
levelled AS (SELECT *, min(CASE WHEN lambda0 <= full_at THEN k END) OVER () AS k_free FROM risen),
aimed AS (SELECT *, CASE WHEN k_free IS NULL OR k < k_free THEN CAST({MOST} * source_size AS DOUBLE)
    ELSE max(CASE WHEN k = k_free THEN lambda0 END) OVER () * weight END AS target,
    CAST({block} AS BIGINT) AS block FROM levelled),
rounded AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS q0, sum(target) OVER () AS aim, sum(CASE WHEN target < {MOST} * source_size THEN target ELSE 0 END) OVER () AS open,
    CAST(count(*) OVER () AS BIGINT) AS n_sources FROM aimed),
off AS (SELECT *, CAST(floor(aim + 0.5) AS BIGINT) - CAST(sum(q0) OVER () AS BIGINT) AS d FROM rounded),
bound AS (SELECT *, CAST(least(abs(d), floor(target * (n_sources + 1) / greatest(open, 1)) + 2) AS INT) AS n_offers FROM off WHERE d <> 0),
offers AS (SELECT rank, d, row_number() OVER (ORDER BY CASE WHEN d > 0 THEN -(target / (2 * (q0 + i) + 1)) ELSE target / (2 * (q0 - i) - 1) END, CASE WHEN d > 0 THEN rank ELSE -rank END, i) AS place
    FROM (SELECT *, {{each}} AS i FROM bound) AS o WHERE d > 0 AND q0 + i + 1 <= {MOST} * source_size OR d < 0 AND q0 - i >= 1),
given AS (SELECT rank, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE -1 END) AS BIGINT) AS more FROM offers WHERE place <= abs(d) GROUP BY rank),
quotas AS (SELECT o.*, q0 + coalesce(more, 0) AS quota FROM off AS o LEFT JOIN given AS g ON o.rank = g.rank),
shards AS (SELECT *, block * greatest({SHARD}, ((source_size + block - 1) {div} block + {SHARDS - 1}) {div} {SHARDS}) AS shard FROM quotas),
cut AS (SELECT *, source_size {div} shard AS whole, source_size % shard AS n_last FROM shards),
ends AS (SELECT *, CASE WHEN n_last = 0 THEN 0 WHEN whole = 0 THEN quota ELSE {last} END AS q_last FROM cut)
SELECT source, rank, source_size, target, block, shard, whole, n_last, q_last, quota - q_last AS q_full, {buckets} AS buckets, {salt} AS salt FROM ends""".replace(
        "{each}", "explode(sequence(0, n_offers - 1))" if div == "div" else "unnest(range(0, n_offers))"
    )


def _read(b: str, div: str) -> tuple[str, str]:
    """SQL: how often the mix takes every word of block ``b`` of its source, and how many of its first words once more."""
    h = f"({b} * block {div} shard)"
    share = f"(q_full {div} greatest(whole, 1) + CASE WHEN ({h} * {PRIME} + salt) % greatest(whole, 1) < q_full % greatest(whole, 1) THEN 1 ELSE 0 END)"
    q = f"(CASE WHEN {h} >= whole THEN q_last ELSE {share} END)"
    n = f"(CASE WHEN {h} >= whole THEN n_last ELSE shard END)"
    j, whole_blocks = f"({b} % (shard {div} block))", f"({n} {div} block)"
    place = f"(CASE WHEN {j} >= {whole_blocks} THEN {whole_blocks} ELSE ({j} * {PRIME} + salt + {h}) % greatest({whole_blocks}, 1) END)"
    return f"({q} {div} {n})", f"greatest(0, least(block, {q} % {n} - {place} * block))"


def placed(docs: DataFrame, spark: SparkSession, scratch: Scratch, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Per document: size, its source's figures, ``start``, its place in the source's stream,
    and the struct ``_row`` of the columns in ``carry``."""
    size = F.coalesce(F.expr(f"CAST(regexp_count(text, r'{WORD}') AS BIGINT)"), F.lit(0)).alias("size")
    sizes = scratch.keep("sizes", docs.select("doc_id", "source", size))
    sources = scratch.keep("sources", source_figures(sizes, spark, block)).withColumnRenamed("source", "_source")

    def bucketed(rows: DataFrame) -> DataFrame:
        known = rows.join(sources, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
        hashed = known.withColumn("h", F.expr(f"md5(concat('{SEED}:', coalesce(CAST(doc_id AS STRING), '')))"))
        return hashed.withColumn("bucket", F.expr("CAST(conv(substr(h, 1, 7), 16, 10) AS BIGINT) * buckets div 268435456"))

    keyed = bucketed(docs.select("doc_id", "source", size, F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")) if carry else sizes)
    sums = bucketed(sizes).groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("rank", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    there = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return there.join(offsets, ["rank", "bucket"]).withColumn("start", F.expr("offset + within"))


def _taken(div: str) -> str:
    """SQL: words that the mix takes of the part of a document that lies in block ``b``."""
    times, more = _read("b", div)
    begin = "greatest(start, b * block)"
    return f"({times} * (least(start + size, (b + 1) * block) - {begin}) + greatest(0, least(start + size, b * block + {more}) - {begin}))"


def mix(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    at = placed(docs, spark, Scratch(spark, "mix"))
    total = f"CASE WHEN size = 0 THEN 0L ELSE aggregate(sequence(start div block, (start + size - 1) div block), 0L, (sum, b) -> sum + {_taken('div')}) END"
    return at.select("doc_id", "size", "source_size", "target", F.expr(total).alias("taken"))


def mixed(docs: DataFrame, spark: SparkSession, block: int = BLOCK) -> DataFrame:
    """The mix itself: the documents' columns, a row for each time that a document is read.

    A row is a whole passage: neighbouring words that are taken then, with the
    white space after them, so nothing is joined that didn't stand together; a document that
    is read with gaps gives several rows. n_chars is counted anew where there is such a
    column. Documents of which nothing is taken are not in the mix.
    """
    at = placed(docs, spark, Scratch(spark, "mix"), tuple(docs.columns), block).filter("size > 0")
    times, more = _read("b", "div")
    # each block in two pieces, the first of which may be read once more; places are those in the document
    place = lambda w: f"least(size, greatest(0L, {w} - start))"
    pieces = f"transform(sequence(start div block, (start + size - 1) div block), b -> array(struct({place('b * block')} AS a, {place(f'b * block + {more}')} AS b, {times} + 1 AS times), struct({place(f'b * block + {more}')} AS a, {place('(b + 1) * block')} AS b, {times} AS times)))"
    counted = at.withColumn("_pieces", F.expr(f"filter(flatten({pieces}), p -> p.a < p.b)"))
    words = counted.withColumn("_words", F.expr(f"regexp_extract_all(_row.text, r'{WORD}[\\x20\\x09-\\x0D]*', 0)")).withColumn("_turn", F.explode(F.expr("sequence(1L, array_max(_pieces.times), 1L)")))
    edge = lambda step: f"filter(sequence(0, size(_pieces) - 1), k -> _pieces[k].times >= _turn AND coalesce(get(_pieces, k + {step}).times, 0) < _turn)"
    runs = words.filter("array_max(_pieces.times) >= 1").withColumn("_run", F.explode(F.expr(f"zip_with({edge(-1)}, {edge(1)}, (a, b) -> struct(_pieces[a].a AS a, _pieces[b].b AS b))")))
    passage = "array_join(slice(_words, CAST(_run.a AS INT) + 1, CAST(_run.b - _run.a AS INT)), '')"
    texts = runs.select("_row", F.expr(f"IF(_run.a = 0 AND _run.b = size, _row.text, {passage})").alias("_text"))
    new = lambda c: F.col("_text") if c == "text" else F.length("_text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("_row")[c]
    return texts.select(*[new(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), spark)


def _sql() -> str:
    figures = _figures(
        "(SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sizes GROUP BY source)", "1", "//",
        "list_filter(range({0}, {0} + 7), {1})[1]", "lambda q:", "CAST('0x' || substr(md5(concat('{0}:', coalesce(source, ''), ':', CASE WHEN source IS NULL THEN 'true' ELSE 'false' END)), 1, 7) AS BIGINT)",
    )
    return f"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
figures AS ({figures}),
placed AS (SELECT s.doc_id, s.size, f.*, CAST(coalesce(sum(s.size) OVER (PARTITION BY rank ORDER BY md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''))), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sizes AS s JOIN figures AS f ON s.source IS NOT DISTINCT FROM f.source),
parts AS (SELECT *, unnest(CASE WHEN size = 0 THEN [0] ELSE range(start // block, (start + size - 1) // block + 1) END) AS b FROM placed)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN size = 0 THEN 0 ELSE {_taken('//')} END) AS BIGINT) AS taken
FROM parts GROUP BY doc_id, size, source_size, target, start"""


SQL = _sql()
