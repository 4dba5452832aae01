"""Pages of recognised lines as text that keeps the page's columns.

Lines of one visual row rarely have equal boxes. A line joins the first row whose band, with
some tolerance, holds its middle; a row begins at its topmost line. Within a row each text is
set at the column that its left edge has on a page ``width`` characters wide, or right after
what stands before it. A page is bounded, so its lines meet in one group; pages are dealt by
their key and streamed as sorted Arrow batches, a page at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Columns of a page, and how far outside a row's band a middle may lie.
WIDTH, SHARE, LEAST = 120, 0.35, 10.0
BOX = ("x0", "y0", "x1", "y1")


def rows_of(tops: np.ndarray, bottoms: np.ndarray) -> np.ndarray:
    """The row of each line; lines come by their tops. Rows count from 0 as they begin."""
    middles = (tops + bottoms) / 2
    # a row whose band ends above all middles to come is never met again; few others are open at once
    least = np.minimum.accumulate(middles[::-1])[::-1].tolist()
    row, rows, most = [], 0, 16
    opened: list[list] = []  # number, begin, end, and the band with its tolerance
    for top, bottom, middle, coming in zip(tops.tolist(), bottoms.tolist(), middles.tolist(), least, strict=True):
        if opened and (opened[0][4] < coming or len(opened) > most):
            opened = [r for r in opened if r[4] >= coming]
            most = max(16, 2 * len(opened))
        for r in opened:
            if r[3] <= middle <= r[4]:
                if top < r[1] or bottom > r[2]:
                    r[1], r[2] = min(r[1], top), max(r[2], bottom)
                    slack = max((r[2] - r[1]) * SHARE, LEAST)
                    r[3], r[4] = r[1] - slack, r[2] + slack
                row.append(r[0])
                break
        else:
            slack = max((bottom - top) * SHARE, LEAST)
            opened.append([rows, top, bottom, top - slack, bottom + slack])
            row.append(rows)
            rows += 1
    return np.array(row, np.int64)


def set_line(columns: list[int], texts: list[str]) -> str:
    """Texts at their columns, none over another."""
    line = ""
    for column, text in zip(columns, texts, strict=True):
        line = line.ljust(column) + text
    return line.rstrip()


def _page(boxes: dict[str, np.ndarray], texts: list[str], page_width: float, width: int) -> str:
    row, scale = rows_of(boxes["y0"], boxes["y1"]), width / max(1.0, page_width)
    tops = np.full(len(texts), np.inf)
    np.minimum.at(tops, row, boxes["y0"])
    order = np.lexsort((np.arange(len(row)), boxes["x0"], row, tops[row]))
    columns = (boxes["x0"] * scale).astype(np.int64)
    edges = np.flatnonzero(np.diff(row[order], prepend=-1))
    parts = [order[a:b] for a, b in zip(edges, [*edges[1:], len(order)], strict=True)]
    return "\n".join(set_line(columns[p].tolist(), [texts[k] for k in p]) for p in parts)


def pages(lines: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """lines: keys, page_width, x0, y0, x1, y1, text. keys and the page's text; a line without a box or text is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not len(t):
                return
            key = [t.column(k).to_pylist() for k in keys]
            same = list(zip(*key, strict=True))
            edges = [0, *(k for k in range(1, len(same)) if same[k] != same[k - 1]), len(same)]
            boxes, texts, wide = {c: t.column(c).to_numpy() for c in BOX}, t.column("text").to_pylist(), t.column("page_width").to_numpy()
            shown = [_page({c: v[a:b] for c, v in boxes.items()}, texts[a:b], wide[a], width) for a, b in zip(edges, edges[1:], strict=False)]
            first = pa.array(edges[:-1])
            yield pa.RecordBatch.from_arrays([*[t.column(k).combine_chunks().take(first) for k in keys], pa.array(shown, pa.string())], names=[*keys, "text"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            last = [t.column(k)[-1].as_py() for k in keys]
            start = len(t)
            columns = [t.column(k) for k in keys]
            while start and [c[start - 1].as_py() for c in columns] == last:
                start -= 1
            yield from made(t.slice(0, start))
            held = t.slice(start)
        if held is not None:
            yield from made(held)

    fine = lines.dropna(subset=[*BOX, "text"]).select(*keys, *[lines[c].cast("double") for c in ("page_width", *BOX)], "text")
    dealt = fine.repartition(*keys).sortWithinPartitions(*keys, "y0", "x0", "text")
    return dealt.mapInArrow(run, T.StructType([*[fine.schema[k] for k in keys], T.StructField("text", T.StringType())]))
