"""Models of the machine: memory of a model's cache, settings that fit a card, workers, and what is available."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GIB, MIB = 1024**3, 1024**2
# Settings in the order in which they are tried.
CONTEXTS = (24_576, 20_480, 16_384)
CACHES = (("f16", 2.0), ("q8_0", 1.09))
WEIGHTS = (("BF16", 16.0), ("Q8_0", 8.5), ("Q6_K", 6.6), ("Q5_K_M", 5.8), ("Q4_K_M", 5.1))
HEADROOM = 0.08
SLOTS = (4, 3, 2)
#: Card memory from which on a detector and a recognition batch of such sizes fit.
BATCHES = ((10 * GIB, 32, 256), (6 * GIB, 16, 64), (0, 4, 16))
STAGE_COST = {"pdf_render": 320 * MIB, "ocr_postprocess": 96 * MIB, "validate": 48 * MIB, "translate_post": 48 * MIB, "export": 64 * MIB}
SCALE = {"normal": 1.0, "elevated": 0.5, "high": 0.25, "critical": 0.0}
KEPT_RAM, LOW, LOW_DISK = 512 * MIB, 0.1, 2 * GIB


def kv_bytes(context: Column, full_layers: Column, sliding_layers: Column, window: Column, heads: Column, head_size: Column, element: Column) -> Column:
    """The cache of a context: some layers keep all of it, others only their window."""
    kept = full_layers * context + sliding_layers * F.least(context, window)
    return F.floor(kept * 2 * heads * head_size * element).cast("bigint")


def weight_bytes(parameters: Column, bits: Column) -> Column:
    return F.floor(parameters * bits / 8).cast("bigint")


def _rungs() -> Column:
    rows = [(context, cache, element, name, bits) for context in CONTEXTS for cache, element in CACHES for name, bits in WEIGHTS]
    return F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(row, ("context", "cache", "element", "weights", "bits"), strict=True)]) for row in rows])


def profiles(cards: DataFrame, overhead: int, per_slot: int, most_used: float = 0.95) -> DataFrame:
    """cards: id, free_bytes and the model's parameters, full_layers, sliding_layers, window, heads, head_size.

    For each card the first settings that fit, and how many sequences at once; null where none
    fits. The thirty settings are tried within the card's row, so nothing is joined or shuffled.
    """
    geometry = ("full_layers", "sliding_layers", "window", "heads", "head_size")
    budget = F.floor(F.col("free_bytes") * (1 - HEADROOM)) * most_used
    of = lambda r, n: kv_bytes(r["context"] * n, *[F.col(c) for c in geometry], r["element"]) + weight_bytes(F.col("parameters"), r["bits"]) + overhead + (n - 1) * per_slot
    told = cards.withColumn("p", F.get(F.filter(_rungs(), lambda r: of(r, 1) <= budget), 0))
    slots = F.coalesce(*[F.when(of(F.col("p"), n) <= budget, n) for n in SLOTS], F.when(F.col("p").isNotNull(), 1))
    return told.select("id", "p.context", "p.cache", "p.weights", slots.alias("slots"))


def offloaded_layers(layers: Column, layer_bytes: Column, free: Column, fixed: Column) -> Column:
    """How many layers fit on a card beside what is fixed; 0 if none do and the processor has to do."""
    return F.greatest(F.lit(0), F.least(layers, F.floor((free - fixed) / F.greatest(layer_bytes, F.lit(1))))).cast("int")


def batch_sizes(memory: Column) -> Column:
    """Detector and recognition batch for a card's memory: the first rung it reaches."""
    out = None
    for floor, detector, recognition in BATCHES:
        pair = F.struct(F.lit(detector).alias("detector"), F.lit(recognition).alias("recognition"))
        out = F.when(memory >= floor, pair) if out is None else out.when(memory >= floor, pair)
    return out


def workers(level: Column, cores: Column, available: Column, stage: str, least: int = 1) -> Column:
    """Workers of a stage: a core is left over, memory has to last, and pressure scales them down."""
    scale = F.element_at(F.create_map(*[F.lit(x) for pair in SCALE.items() for x in pair]), level)
    by_memory = F.floor(F.greatest(F.lit(0), available - KEPT_RAM) / STAGE_COST[stage])
    return F.greatest(F.lit(least), F.floor(F.least(F.greatest(F.lit(least), cores - 1), by_memory) * scale)).cast("int")


def pressure_reason(gauges: DataFrame) -> Column:
    """What to tell while no work is let in: the resource that is short, by name."""
    gb = lambda c: F.format_string("%.1f GB", F.col(c) / float(GIB))
    short = lambda free, total: (F.coalesce(F.col(total), F.lit(0)) > 0) & (F.col(free) / F.greatest(F.col(total), F.lit(1)) < LOW)
    return (
        F.when(short("ram_free", "ram_total"), F.concat(F.lit("Not enough free memory: "), gb("ram_free"), F.lit(" of "), gb("ram_total"), F.lit(".")))
        .when(short("vram_free", "vram_total"), F.concat(F.lit("Graphics memory is full: "), gb("vram_free"), F.lit(" of "), gb("vram_total"), F.lit(" free.")))
        .when((F.col("disk_free") > 0) & (F.col("disk_free") < LOW_DISK), F.concat(F.lit("Only "), gb("disk_free"), F.lit(" of disk space is free.")))
        .otherwise(F.concat(F.lit("The server isn't accepting work ("), F.coalesce("pressure", F.lit("pressure")), F.lit(").")))
    )


def availability(reached: Column, ready: Column, admits: Column, loaded: Column, detail: Column) -> Column:
    """What a probe of the server says: up, degraded, loading or down."""
    return (
        F.when(~reached, "down").when(ready, F.when(admits, "up").otherwise("degraded"))
        .when(loaded, "degraded").when(F.coalesce(detail, F.lit("")).startswith("error"), "down").otherwise("loading")
    )


def capabilities(status: DataFrame) -> DataFrame:
    """status: id, database, server, disk (each whether it is fine). What a user can do, and why not more."""
    db, ai, disk = F.col("database"), F.col("server"), F.col("disk")
    why = F.when(~db, "database is down").when(~disk, "disk is full").when(~ai, "server is down").otherwise("")
    return status.select("id", F.lit(True).alias("browse"), db.alias("export"), (db & disk).alias("upload"), (db & ai & disk).alias("process"), why.alias("reason"))


def latest(samples: DataFrame, key: str) -> DataFrame:
    """The last sample by key, in order of ts and id."""
    rest = [c for c in samples.columns if c != key]
    return samples.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "id")).alias("_row")).select(key, "_row.*")
