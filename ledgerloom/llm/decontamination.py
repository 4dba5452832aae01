"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

Words are runs of letters a to z (A to Z in lower case), digits and characters beyond ASCII.
A window of an item is ``length`` of its consecutive words, or the share ``coverage`` of the
item where that is less; a document word inside any occurrence of a window is hit.

The automaton holds all strings of words of its items. Each state that stands for a window
carries the items that have it. A document's words are streamed through: at every word the
longest matching string that ends there is known, and the states on its suffix links tell
which windows end there too. A match breaks where two neighbouring words stand in no item,
so only runs without such a break, and long enough for the shortest window, are streamed
one word at a time; what lies between them can match nothing longer.

Scale: an automaton takes about ``BLOCK`` words of items and is built in a task; longer items
are cut so that neighbouring parts share all but one word of a window. Automata of at most
``PASS`` words together are broadcast, and documents are read once for each such set; what
the sets find is merged in the row. Documents are never shuffled.

Cases: a null or empty text has no words; an item without words has no window; an item
without an id hits words but is not counted among items; items with equal ids count once;
repeated rows are each treated by themselves; tables may be empty; columns of documents may
have any names. A text is taken a piece of ``CHUNK`` bytes at a time, cut between words.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import Scratch, table

LENGTH, COVERAGE = 10, 1.0
BLOCK, PASS = 100_000, 400_000
CHUNK = 4_000_000
#: Tasks that build automata.
BUILDERS = 8
#: Upper case to lower, whatever is neither letter nor digit nor beyond ASCII to a space.
SPELT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
FOUND = "struct<n_words:bigint,longest:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded piece of it at a time."""
    text, at = text.translate(SPELT), 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Automaton:
    """All strings of words of the items added, and the windows among them.

    ``step`` maps state * V + word to the next state, where V is the number of words and 1
    (words count from 1); ``link`` is the longest proper suffix in another state, ``longest``
    the length of a state's longest string.
    """

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.items: list[tuple[str | None, list[int], int]] = []
        self.size = 0

    def _state(self, step: dict[int, int], longest: int) -> int:
        self.step.append(step)
        self.link.append(0)
        self.longest.append(longest)
        return len(self.link) - 1

    def _shorter(self, p: int, w: int, q: int) -> int:
        """The state of p's longest string and w, split off q if q has longer strings too."""
        if self.longest[p] + 1 == self.longest[q]:
            return q
        part = self._state(dict(self.step[q]), self.longest[p] + 1)
        self.link[part], self.link[q] = self.link[q], part
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = part
            p = self.link[p]
        return part

    def add(self, item: str | None, found: list[bytes], window: int) -> None:
        ids = [self.number.setdefault(w, len(self.number) + 1) for w in found]
        self.items.append((item, ids, window))
        self.size += len(ids)
        last = 0
        for w in ids:
            if w in self.step[last]:
                last = self._shorter(last, w, self.step[last][w])
                continue
            new, p = self._state({}, self.longest[last] + 1), last
            while p >= 0 and w not in self.step[p]:
                self.step[p][w] = new
                p = self.link[p]
            self.link[new] = 0 if p < 0 else self._shorter(p, w, self.step[p][w])
            last = new

    def _windows(self) -> Iterator[tuple[int, int, int]]:
        """State, length and item of every window."""
        for k, (_, ids, window) in enumerate(self.items):
            s = 0
            for n, w in enumerate(ids, 1):
                s = self.step[s][w]
                while self.longest[self.link[s]] >= window:
                    s = self.link[s]
                if n >= window:
                    yield s, window, k

    def packed(self) -> bytes:
        base = len(self.number) + 1
        steps = [(s * base + w, t) for s, to in enumerate(self.step) for w, t in to.items()]
        pairs = sorted({a * base + b for _, ids, _ in self.items for a, b in zip(ids, ids[1:], strict=False)})
        return pickle.dumps({
            "number": self.number, "ids": [i for i, _, _ in self.items],
            "keys": np.array([k for k, _ in steps], np.int64), "to": np.array([t for _, t in steps], np.int32),
            "link": np.array(self.link, np.int32), "longest": np.array(self.longest, np.int32),
            "pairs": np.array(pairs, np.int64), "windows": np.array(sorted(set(self._windows())), np.int64).reshape(-1, 3),
        })


class Matcher:
    """Streams documents through one packed automaton."""

    def __init__(self, blob: bytes):
        found = pickle.loads(blob)
        self.number, self.ids, self.pairs = found["number"], found["ids"], found["pairs"]
        self.base = len(self.number) + 1
        self.step = dict(zip(found["keys"].tolist(), found["to"].tolist(), strict=True))
        self.link, self.longest = found["link"].tolist(), found["longest"].tolist()
        self.windows: dict[int, dict[int, list[int]]] = {}
        for s, w, k in found["windows"].tolist():
            self.windows.setdefault(s, {}).setdefault(w, []).append(k)
        self.shortest = int(found["windows"][:, 1].min()) if len(found["windows"]) else 0
        #: The nearest state with a window on the way along suffix links, itself included.
        self.near = [0] * len(self.link)
        for s in np.argsort(found["longest"], kind="stable").tolist():
            self.near[s] = s if s in self.windows else self.near[self.link[s]] if s else 0

    def _runs(self, ids: np.ndarray) -> np.ndarray:
        """(first, after) of the runs of words in which no two neighbours are strange to the items."""
        if self.shortest == 1:
            good = ids > 0
        else:
            good = (ids[:-1] > 0) & (ids[1:] > 0)
            at = np.flatnonzero(good)
            pair = ids[at].astype(np.int64) * self.base + ids[at + 1]
            place = np.searchsorted(self.pairs, pair)
            good[at] = self.pairs[np.minimum(place, len(self.pairs) - 1)] == pair
        edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).view(np.int8))).reshape(-1, 2)
        edges[:, 1] += self.shortest > 1
        return edges[edges[:, 1] - edges[:, 0] >= self.shortest]

    def match(self, ids: np.ndarray, hit: np.ndarray, items: set[str]) -> int:
        """Mark hit words and add the items found; the longest match that holds a window."""
        step, link, longest, base, most, seen = self.step, self.link, self.longest, self.base, 0, set()
        for a, b in self._runs(ids).tolist() if self.shortest else ():
            s = n = 0
            for p, w in enumerate(ids[a:b].tolist(), a):
                while s and s * base + w not in step:
                    s = link[s]
                    n = longest[s]
                s = step.get(s * base + w, 0)
                n = n + 1 if s else 0
                v = self.near[s]
                while v:
                    for window, owners in self.windows[v].items():
                        if window <= n:
                            hit[p - window + 1 : p + 1] = True
                            most = max(most, n)
                            if (v, window) not in seen:
                                seen.add((v, window))
                                items.update(self.ids[k] for k in owners if self.ids[k] is not None)
                    v = self.near[link[v]]
        return most


def automata(items: DataFrame, scratch: Scratch, length: int = LENGTH, coverage: float = COVERAGE) -> DataFrame:
    """(part, words, automaton): packed automata of about ``BLOCK`` words over (item_id, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, current = TaskContext.get().partitionId() << 32, 0, Automaton()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task + made]), pa.array([current.size]), pa.array([current.packed()], pa.binary())], names=["part", "words", "automaton"])

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = [w for piece in words(text.as_py() or b"") for w in piece]
                window = min(length, max(1, math.ceil(coverage * len(found))))
                for at in range(0, len(found), BLOCK):
                    if len(part := found[at : at + BLOCK + window - 1]) >= window:
                        current.add(item, part, window)
                    if current.size >= BLOCK:
                        yield done()
                        made, current = made + 1, Automaton()
        if current.size:
            yield done()

    known = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).coalesce(BUILDERS)
    return scratch.keep("automata", known.mapInArrow(build, "part long, words long, automaton binary"))


_loaded: dict[str, list[Matcher]] = {}


def _matchers(label: str, shared) -> list[Matcher]:
    """Matchers of a broadcast, kept under its label for the next task of this worker."""
    if label not in _loaded:
        _loaded.clear()
        _loaded[label] = [Matcher(blob) for blob in shared.value]
    return _loaded[label]


def _numbers(matcher: Matcher, text: bytes) -> np.ndarray:
    get, zero = matcher.number.get, 0
    parts = [np.array([get(w, zero) for w in piece], np.int64) for piece in words(text)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int64), *parts])


def _spans(hit: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).view(np.int8))).reshape(-1, 2)


def find(docs: DataFrame, items: DataFrame, scratch: Scratch, length: int = LENGTH, coverage: float = COVERAGE, text: str = "text", name: str = "found") -> DataFrame:
    """The columns of ``docs`` and the struct ``name``: n_words, the longest match that holds a window, merged spans (start and end in words) and ids of the items found."""
    spark = docs.sparkSession
    if name in docs.columns:
        raise ValueError(f"documents have a column {name}")
    made = automata(items, scratch, length, coverage)
    sets: list[list[int]] = [[]]
    free = PASS
    for r in made.select("part", "words").orderBy("part").toLocalIterator():
        if r["words"] > free and sets[-1]:
            sets.append([])
            free = PASS
        sets[-1].append(r["part"])
        free -= r["words"]
    found = docs.withColumn(name, F.lit(None).cast(FOUND))
    for k, parts in enumerate(sets):
        blobs = [bytes(r["automaton"]) for r in made.filter(F.col("part").isin(parts)).orderBy("part").collect()] if parts else []
        if k:
            found = scratch.keep(f"found-{k}", found)
        found = found.mapInArrow(_matching(f"{scratch.root}/{k}", spark.sparkContext.broadcast(blobs), found.columns.index(text)), found.schema)
    return found


def _matching(label: str, shared, at: int):
    """A function of record batches whose last column is what earlier sets found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = _matchers(label, shared)
        for batch in batches:
            out = []
            before = batch.column(batch.num_columns - 1)
            before = [None] * batch.num_rows if before.null_count == batch.num_rows else before.to_pylist()
            for value, old in zip(batch.column(at).cast(pa.binary()), before, strict=True):
                text, items = value.as_py() or b"", set(old["items"] if old else ())
                longest, n, hit = (old["longest"] if old else 0), -1, None
                for matcher in matchers:
                    ids = _numbers(matcher, text)
                    if hit is None:
                        n, hit = len(ids), np.zeros(len(ids), bool)
                    longest = max(longest, matcher.match(ids, hit, items))
                if n < 0:
                    n = sum(map(len, words(text)))
                    hit = np.zeros(n, bool)
                for s in old["spans"] if old else ():
                    hit[s["start"] : s["end"]] = True
                spans = [{"start": a, "end": b} for a, b in _spans(hit).tolist()]
                out.append({"n_words": n, "longest": longest, "spans": spans, "items": sorted(items)})
            kind = batch.schema.field(batch.num_columns - 1).type
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], schema=batch.schema)

    return run


def digest(found: DataFrame, key: str = "doc_id", name: str = "found") -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated by ``key``."""
    of = lambda part: F.col(f"{name}.{part}")
    n_hit = F.aggregate(of("spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        key, of("n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(of("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(of("items")), ","), 256).alias("items_sha256"), (F.size(of("spans")) > 0).alias("contaminated"),
    )


def _without(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    spelt = np.frombuffer(text.translate(SPELT), np.uint8) != 32
    edges = _spans(spelt)
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : edges[s["start"], 0]])
        at = int(edges[s["end"] - 1, 1])
    return b"".join([*kept, text[at:]])


def clean(docs: DataFrame, items: DataFrame, scratch: Scratch, length: int = LENGTH, coverage: float = COVERAGE, most: float = 1.0, text: str = "text") -> DataFrame:
    """Documents without the spans that are hit, and without those whose hit words exceed the share ``most``."""
    name = "found"
    while name in docs.columns:
        name += "_"
    found = find(docs, items, scratch, length, coverage, text, name)
    n_hit = F.aggregate(F.col(f"{name}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.filter(n_hit <= F.lit(most) * F.col(f"{name}.n_words"))
    at, names = docs.columns.index(text), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).field("spans")
            touched = pc.list_value_length(spans).to_numpy(zero_copy_only=False) > 0
            columns = batch.columns[:-1]
            if touched.any():
                texts = columns[at].to_pylist()
                for k in np.flatnonzero(touched).tolist():
                    texts[k] = _without(texts[k].encode(), spans[k].as_py()).decode()
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(cut, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontamination")))


SQL = r"""
WITH items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), sized AS (
    SELECT item, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM sized)
), docs AS (
    SELECT row_number() OVER () AS r, doc_id,
        coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), places AS (
    SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS s
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, (SELECT DISTINCT k FROM windows))
), hits AS (
    SELECT DISTINCT r, p, k, item FROM places JOIN windows USING (k, s)
), covered AS (
    SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r
), named AS (
    SELECT r, count(item) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
    sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered c USING (r) LEFT JOIN named i USING (r)
"""
