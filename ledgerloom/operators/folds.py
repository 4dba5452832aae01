"""Ordered folds with state: pressure with hysteresis, and circuit breakers.

Levels rise at once and fall only past a margin, so each row depends on the one before; a
fold in Arrow batches per key, in time order. The same fold runs over a stream with its
state kept by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Free fractions at or below which a level is entered, most severe first, and the margin to leave it.
LEVELS = ((0.08, "critical"), (0.15, "high"), (0.25, "elevated"))
MARGIN = 0.05
ORDER = {"normal": 0, "elevated": 1, "high": 2, "critical": 3}
FAILURES_TO_OPEN, OPEN_SECONDS = 2, 15.0


def next_level(free: float, before: str) -> str:
    """The level for a free fraction: up at once, down only with the margin to spare."""
    now = next((name for edge, name in LEVELS if free <= edge), "normal")
    if ORDER[now] >= ORDER[before]:
        return now
    eased = next((name for edge, name in LEVELS if free <= edge + MARGIN), "normal")
    return eased if ORDER[eased] < ORDER[before] else before


def _pressure(key, frame: pd.DataFrame) -> pd.DataFrame:
    frame, level, out = frame.sort_values(["ts", "id"]), "normal", []
    for free in frame["free"]:
        level = next_level(free, level)
        out.append(level)
    return frame.assign(level=out)[["source", "id", "ts", "free", "level"]]


def pressure(samples: DataFrame) -> DataFrame:
    """samples: (source, id, ts, free). Adds the level after each sample."""
    return samples.groupBy("source").applyInPandas(_pressure, "source long, id long, ts timestamp, free double, level string")


def _breaker(key, frame: pd.DataFrame) -> pd.DataFrame:
    frame, failures, opened, out = frame.sort_values(["ts", "id"]), 0, None, []
    for ts, ok in zip(frame["ts"], frame["ok"], strict=True):
        waited = opened is not None and (ts - opened).total_seconds() >= OPEN_SECONDS
        before = "closed" if opened is None else "half_open" if waited else "open"
        if before != "open":
            failures = 0 if ok else failures + 1
            opened = None if ok else ts if failures >= FAILURES_TO_OPEN else opened
        out.append(before)
    return frame.assign(state=out)[["source", "id", "ts", "ok", "state"]]


def breaker(calls: DataFrame) -> DataFrame:
    """calls: (source, id, ts, ok). Adds the breaker's state that each call met."""
    return calls.groupBy("source").applyInPandas(_breaker, "source long, id long, ts timestamp, ok boolean, state string")


def free_fraction(available, reclaimable, total):
    """Memory that is free or can be made so, as a share of all."""
    return F.least(F.lit(1.0), (available + reclaimable) / F.greatest(total, F.lit(1)))


def admits(level, fraction):
    """Work is let in unless pressure is critical and reclaiming wouldn't help."""
    return (level != "critical") | (fraction >= 0.08)


def _layout(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Line boxes to rows: a line joins the first row whose band holds its middle."""
    rows: list[list] = []
    for x0, y0, x1, y1, text in frame.sort_values(["y0", "x0"])[["x0", "y0", "x1", "y1", "text"]].itertuples(index=False):
        middle = (y0 + y1) / 2
        row = next((r for r in rows if r[0] <= middle <= r[1]), None)
        if row is None:
            rows.append([y0, y1, [(x0, text)]])
        else:
            row[2].append((x0, text))
    out = [(key[0], key[1], k, " ".join(t for _, t in sorted(r[2]))) for k, r in enumerate(rows)]
    return pd.DataFrame(out, columns=["doc_id", "page", "row", "text"])


def page_layout(lines: DataFrame) -> DataFrame:
    """lines: (doc_id, page, x0, y0, x1, y1, text). Rows of text in reading order."""
    return lines.groupBy("doc_id", "page").applyInPandas(_layout, "doc_id long, page int, row long, text string")


def normalised_boxes(lines: DataFrame, width: str, height: str) -> DataFrame:
    part = lambda c, n: F.round(F.col(c) / F.greatest(F.lit(1), F.col(n)), 5)
    return lines.withColumns({"x0": part("x0", width), "x1": part("x1", width), "y0": part("y0", height), "y1": part("y1", height)})
