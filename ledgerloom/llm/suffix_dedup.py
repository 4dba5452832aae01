"""Removal of what also stands elsewhere: strings of ``LENGTH`` bytes, or passages of words.

A ``Rule`` says what a symbol is (a byte, or a word by its 64-bit hash), how many symbols in a row count as a
repeat, and whether only other documents count. Every symbol covered by such a string that
also starts elsewhere is a repeat; overlaps count, and strings are judged on the input.

Strings are ordered by column-wise construction: a collection's suffixes are extended by one
symbol per member each round, and the order of the extended suffixes and the common prefixes
of neighbours are updated from the round before. Columns go through a file that is written
once and read back in sequence, so memory holds an order and a prefix length for each
member, not the texts. Of the transform only the order is kept, since nothing else is asked.

Inserting a symbol of every document of the whole corpus each round would rewrite the order
as often as the longest text has symbols. So the collection is first cut into small ones that
can be built by themselves. Every string of a rule's length has an anchor, the first of its
``least``-symbol strings with the lowest hash; equal strings have equal anchors at equal
places. A window is a run of starts with one anchor, together with all their symbols; windows
with equal anchors are aligned there, and only they can share a string. Equal windows are
merged and counted, a window alone with its anchor is dropped, and an anchor with one
distinct window needs no order: all its starts repeat. For all others, starts are taken
``block`` at a time, the symbols common to all starts of a block (the core) part the windows
further, and members with one core form a collection whose columns are the symbols on either
side, right ones first. A start repeats if the run of neighbours that share its whole string
has another start (or one of another document), or if its member stands for several.

Aligned members extend in step, so the order after a round is the order before it, dealt
stably by the new symbols, and a common prefix is one more than the least in between.

A collection with more than ``LARGE`` members, such as a notice that very many documents
carry amid texts of their own, is not built in one task: its strings are hashed and counted
with map-side combining, to the same result.

Cases: a null text counts as empty; texts shorter than a string keep all; rows that share an
id are told apart by their text; equal rows repeat each other wholly under a rule that counts
every place, and are one document under a rule that counts other documents; matches never
cross documents, and the input alone decides; an empty table gives no rows; columns of any
name are carried as they are. No group of windows meets in one task before it is merged.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import Scratch, table


@dataclass(frozen=True)
class Rule:
    """What repeats: ``length`` symbols of ``width`` bytes each, anywhere or in other documents."""

    number: int
    length: int
    least: int
    block: int
    width: int
    across: bool

    @property
    def span(self) -> int:
        """Anchors that a string may have, and starts that a window may have.

        Less than a string's length, so the strings of one window's starts all overlap, and
        what its repeats cover is one run.
        """
        return self.length - self.least + 1


LENGTH = 400
BYTES = Rule(number=0, length=LENGTH, least=80, block=32, width=1, across=False)
#: Passages of over 50 words that another document has too; a word is its 64-bit hash.
WORDS = Rule(number=1, length=51, least=10, block=16, width=8, across=True)
RULES = {r.number: r for r in (BYTES, WORDS)}
#: Symbols of one round of window search; a power of two, since places share a word with hashes.
CHUNK = 1 << 18
#: Members of collections that are built together, in whole collections; and of one that isn't built in a task.
MEMBERS, LARGE = 20_000, 1000
#: At most so many collections are large: the bound rises with the number of members.
LARGE_KEYS = 10_000
#: Words of more bytes are hashed apart.
LONG_WORD = 4096
WINDOW = "key long, place long, anchor long, full long"
FINE = "rule int, anchor long, full long, rel int, core long, unit long, left binary, right binary, n long, lo long, hi long"
MASK = "anchor long, core long, unit long, low int, high int"
STRINGS = "rule int, anchor long, core long, unit long, t int, string long, n long, lo long, hi long"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, n_passages long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _RULE = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D
_BYTES = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 1, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _hashed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX1
    h = (h ^ (h >> np.uint64(32))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Symbols:
    """The symbols of texts under a rule, as bytes."""

    def __init__(self):
        self.up, self.down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))

    def of(self, texts: list[bytes], rule: Rule) -> list[bytes]:
        if rule.width == 1:
            return texts
        if len(texts) > 1 and sum(map(len, texts)) + len(texts) < CHUNK:
            joined = b" ".join(texts)
            hashes, starts = self._words(joined)
            edges = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
            return [hashes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [self._long(t) for t in texts]

    def _long(self, text: bytes) -> bytes:
        """Part by part, each to the end of a word."""
        out, at = [], 0
        while at < len(text):
            space = _SPACE_BYTE.search(text, at + CHUNK // 2)
            end = space.start() if space else len(text)
            out.append(self._words(text[at:end])[0].tobytes())
            at = end
        return b"".join(out)

    def _words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, from sums over bytes; and where they start."""
        data = np.frombuffer(text, np.uint8)
        inside = np.concatenate([[False], ~_SPACE[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        apart = np.flatnonzero(ends - starts > LONG_WORD)
        if len(data) > CHUNK:  # one word takes up all that is over
            out = np.array([xxhash.xxh3_64_intdigest(text[a:b]) if b - a > LONG_WORD else self._words(text[a:b])[0][0] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
            return out, starts
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=sums[1:])
        out = _hashed(((sums[ends] - sums[starts]) * self.down[starts]) ^ (ends - starts).astype(np.uint64))
        for k in apart.tolist():
            out[k] = xxhash.xxh3_64_intdigest(text[starts[k] : ends[k]])
        return out, starts


class Windows:
    """Finds the windows of texts, many short ones at a time or a long one in parts."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.up, self.down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))

    def find(self, values: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """values: hashed symbols; valid: whether a string may start there. (first, last start, anchor, its hash)."""
        n, least, span = len(values), self.rule.least, self.rule.span
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        h = (sums[least:] - sums[:-least]) * self.down[: n - least + 1]
        h = _hashed(h) ^ np.uint64(_RULE * self.rule.number)
        place = np.uint64(CHUNK - 1)
        v = (h & ~place) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(v) // span)
        grid = np.full(rows * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[: len(v)] = v
        grid = grid.reshape(rows, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - self.rule.length + 1
        at = (np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & place).astype(np.int64)
        at[~valid[:starts]] = -1
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([edge[1:], [starts]]) - 1
        keep = at[edge] >= 0
        first, last = edge[keep], last[keep]
        return first, last, at[first], h[at[first]].view(np.int64)


def windows(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """All windows of all texts; docs: key, text. place: the rule, p, p - s1 and s2 - s1 in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders, symbols = {r.number: Windows(r) for r in rules}, Symbols()

        def flush(rule: Rule, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            # parts: (key, place in the text, symbols)
            if not parts:
                return
            joined, width = b"".join(p[2] for p in parts), rule.width
            sizes = np.array([len(p[2]) // width for p in parts])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            valid = np.zeros(int(sizes.sum()), bool)
            for o, n in zip(offsets, sizes, strict=False):
                valid[o : o + n - rule.length + 1] = True
            values = _BYTES[np.frombuffer(joined, np.uint8)] if width == 1 else np.frombuffer(joined, np.uint64)
            first, last, at, anchor = finders[rule.number].find(values, valid)
            # one text may end and the next begin without a start in between that breaks the run
            owner = np.searchsorted(offsets, first, side="right") - 1
            view, hash64 = memoryview(joined), xxhash.xxh3_64_intdigest
            full = np.array([hash64(view[a * width : (b + rule.length) * width], p - a) for a, b, p in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)], np.uint64)
            keys = np.array([p[0] for p in parts], np.int64)[owner]
            shift = np.array([p[1] for p in parts], np.int64)[owner] - offsets[owner]
            place = (np.int64(rule.number) << 60) | ((at + shift) << 20) | ((at - first) << 10) | (last - first)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, place, anchor, full.view(np.int64))], names=[f.split()[0] for f in WINDOW.split(", ")])

        def found(keys: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            for rule in rules:
                parts, size = [], 0
                for key, data in zip(keys, symbols.of(texts, rule), strict=True):
                    n = len(data) // rule.width
                    for a in range(0, n - rule.length + 1, CHUNK // 2):
                        piece = data[a * rule.width : (a + CHUNK // 2 + rule.length - 1) * rule.width]
                        if size + len(piece) // rule.width > CHUNK:
                            yield from flush(rule, parts)
                            parts, size = [], 0
                        parts.append((key, a, piece))
                        size += len(piece) // rule.width
                yield from flush(rule, parts)

        keys, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                data = text.as_buffer().to_pybytes()
                if size + len(data) > CHUNK // 2:
                    yield from found(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(data)
                size += len(data)
        yield from found(keys, texts)

    return docs.select("key", "text").mapInArrow(run, WINDOW)


def fine_members(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Blocks of the chosen windows (one of each kind), with the symbols beside the cores."""
    lists = chosen.groupBy("key").agg(F.collect_list(F.struct("place", "anchor", "full", "n", "lo", "hi")).alias("w"))
    joined = docs.join(lists, "key").select("text", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash64, out, symbols = xxhash.xxh3_64_intdigest, [], Symbols()
        for batch in batches:
            for text, found in zip(batch.column(0), batch.column(1), strict=True):
                data = {}
                for w in found.as_py():
                    place = w["place"]
                    rule, p = RULES[place >> 60], place >> 20 & 0xFFFFFFFFFF
                    if rule.number not in data:
                        data[rule.number] = symbols.of([text.as_buffer().to_pybytes()], rule)[0]
                    own, width, block = data[rule.number], rule.width, rule.block
                    view, s1 = memoryview(own), p - (place >> 10 & 1023)
                    s2 = s1 + (place & 1023)
                    for j in range((p - s2) // block, (p - s1) // block + 1):
                        zero = p - j * block  # the start of the core; starts are zero - t, 0 <= t < block
                        end = zero - block + 1 + rule.length
                        lo, hi = max(s1, zero - block + 1), min(s2, zero)
                        left, right = own[lo * width : zero * width], own[end * width : (hi + rule.length) * width]
                        core = hash64(view[zero * width : end * width], j) - (1 << 63)
                        unit = hash64(left + b"\0" + right, len(left)) - (1 << 63)
                        out.append((rule.number, w["anchor"], w["full"], zero - s1, core, unit, left, right, w["n"], w["lo"], w["hi"]))
                if len(out) >= 20_000:
                    yield _batch(out, FINE)
                    out.clear()
        if out:
            yield _batch(out, FINE)

    return joined.mapInArrow(run, FINE)


def repeated_starts(group: np.ndarray, left: list[bytes], right: list[bytes], n: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None, rule: Rule = BYTES) -> np.ndarray:
    """Column-wise construction of collections given by ascending ``group`` numbers.

    n: the places that a member stands for; lo, hi: the lowest and highest of their documents.
    Bit t of a member's result: the string that starts t symbols left of its core repeats.
    """
    m, side = len(group), rule.block - 1
    kind = np.uint8 if rule.width == 1 else np.uint64
    flat = {place: np.frombuffer(b"".join(texts), kind) for place, texts in (("right", right), ("left", left))}
    lengths = {place: np.array([len(x) // rule.width for x in texts]) for place, texts in (("right", right), ("left", left))}
    if rule.width > 1:
        # words are numbered anew within what is built together
        names, number = np.unique(np.concatenate([flat["right"], flat["left"]]), return_inverse=True)
        flat = {"right": number[: len(flat["right"])], "left": number[len(flat["right"]) :]}
        kinds = len(names) + 2
    else:
        kinds = 512
    with tempfile.TemporaryFile() as file:
        # right columns from the last to the first, then left ones from the core outwards; 0: no symbol
        for place in ("right", "left"):
            grid, size = np.zeros((m, side), np.uint32), lengths[place]
            mask = np.arange(side)[None, :] < size[:, None]
            grid[mask] = flat[place].astype(np.uint32) + 1
            if place == "left":
                grid = np.where(mask, np.take_along_axis(grid, np.clip(size[:, None] - 1 - np.arange(side)[None, :], 0, side - 1), axis=1), 0).astype(np.uint32)
            np.ascontiguousarray(grid.T[::-1] if place == "right" else grid.T).tofile(file)
        file.seek(0)
        order, prefix = np.arange(m), np.zeros(m, np.int32)  # prefix[k]: shared by order[k - 1] and order[k]
        out = np.zeros(m, np.int64)
        base = group.astype(np.int64) * kinds

        def insert(symbols: np.ndarray, order: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = (base + symbols)[order]
            deal = np.argsort(key, kind="stable")
            now, sorted_key = order[deal], key[deal]
            # the least common prefix between two places of the order before, by doubling spans
            a, b = deal[:-1] + 1, deal[1:] + 1
            fresh = np.zeros(m, np.int32)
            same = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & (symbols[now[1:]] > 0))
            a, b = a[same], b[same]
            level, spans, width = np.frexp((b - a).astype(np.float64))[1] - 1, prefix, 1
            least = np.zeros(len(same), np.int32)
            for k in range(int(level.max(initial=-1)) + 1):
                own = level == k
                least[own] = np.minimum(spans[a[own]], spans[b[own] - width])
                spans = np.minimum(spans[: len(spans) - width], spans[width:]) if len(spans) > width else spans
                width *= 2
            fresh[same + 1] = least + 1
            return now, fresh

        def mark(t: int) -> None:
            alike = prefix >= rule.length
            if rule.across:
                starts = np.flatnonzero(~alike)
                several = np.minimum.reduceat(lo[order], starts) < np.maximum.reduceat(hi[order], starts)
                repeated = several[np.cumsum(~alike) - 1]
            else:
                there = np.append(alike, False)
                repeated = there[:m] | there[1:]
            out[order] |= repeated.astype(np.int64) << t

        for _ in range(side):
            order, prefix = insert(np.fromfile(file, np.uint32, m).astype(np.int64), order, prefix)
        # all members of a collection have its core: the order stays, prefixes grow by its length
        prefix = np.where(np.concatenate([[False], group[order][1:] == group[order][:-1]]), prefix + rule.length - side, 0).astype(np.int32)
        mark(0)
        for t in range(1, rule.block):
            order, prefix = insert(np.fromfile(file, np.uint32, m).astype(np.int64), order, prefix)
            mark(t)
    mine = _own_starts(lengths["left"], lengths["right"], rule)
    return np.where(lo < hi if rule.across else n > 1, mine, out & mine)


def _own_starts(left: np.ndarray, right: np.ndarray, rule: Rule) -> np.ndarray:
    """Bits of the starts whose whole strings a member with so many symbols on either side has."""
    return ((np.int64(1) << (left.astype(np.int64) + 1)) - 1) & ~((np.int64(1) << (rule.block - 1 - right.astype(np.int64))) - 1)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members come sorted by collection; collections are built once they are whole."""
    held: pa.Table | None = None

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        numbers = t.column("rule").to_numpy()
        for rule in RULES.values():
            own = t.filter(pa.array(numbers == rule.number))
            if len(own):
                key = np.stack([own.column(k).to_numpy() for k in ("anchor", "core")])
                group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
                got = repeated_starts(group, own.column("left").to_pylist(), own.column("right").to_pylist(), *(own.column(k).to_numpy() for k in ("n", "lo", "hi")), rule)
                some = np.flatnonzero(got)
                mask = got[some]
                bits = [np.log2(x).astype(np.int32) for x in (mask & -mask, mask)]
                yield pa.RecordBatch.from_arrays([*(pa.array(own.column(k).to_numpy()[some]) for k in ("anchor", "core", "unit")), *map(pa.array, bits)], names=[f.split()[0] for f in MASK.split(", ")])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if len(held) >= MEMBERS:
            a, c = held.column("anchor").to_numpy(), held.column("core").to_numpy()
            start = int(np.argmax((a == a[-1]) & (c == c[-1])))
            yield from done(held.slice(0, start))
            held = held.slice(start)
    if held is not None:
        yield from done(held)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For members of large collections: each start's string, hashed."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            rule = RULES[row["rule"]]
            w, left, right = rule.width, row["left"], row["right"]
            for t in range(rule.block - 1 - len(right) // w, len(left) // w + 1):
                string = xxhash.xxh3_64_intdigest(left[len(left) - t * w :] + right[: (rule.block - 1 - t) * w], t) - (1 << 63)
                out.append((rule.number, row["anchor"], row["core"], row["unit"], t, string, row["n"], row["lo"], row["hi"]))
        if out:
            yield _batch(out, STRINGS)


def _several(rule: str, n: str, lo: str, hi: str) -> str:
    """SQL: what is counted or bounded so is a repeat under its rule."""
    across = ", ".join(str(r.number) for r in RULES.values() if r.across)
    return f"IF({rule} IN ({across}), {lo} < {hi}, {n} > 1)"


def _masks(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(anchor, core, unit, low, high): the last and the first repeated start of members, counted leftwards; large collections by counting."""
    total = members.count()
    sizes = members.groupBy("anchor", "core").count().filter(F.col("count") > max(LARGE, total // LARGE_KEYS)).select("anchor", "core")
    large = scratch.keep("large", sizes)  # at most LARGE_KEYS rows
    if not large.limit(1).count():
        return members.repartition("anchor", "core").sortWithinPartitions("anchor", "core").mapInArrow(_build, MASK)
    rest = members.join(F.broadcast(large), ["anchor", "core"], "left_anti").select(*members.columns)
    built = rest.repartition("anchor", "core").sortWithinPartitions("anchor", "core").mapInArrow(_build, MASK)
    strings = members.join(F.broadcast(large), ["anchor", "core"], "left_semi").select(*members.columns)
    strings = scratch.keep("strings", strings.mapInArrow(_strings, STRINGS))
    keys = ["anchor", "core", "t", "string"]
    counted = strings.groupBy("rule", *keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    counted = counted.filter(_several("rule", "n", "lo", "hi")).select(*keys)
    hashed = strings.select("unit", *keys).join(counted, keys).groupBy("anchor", "core", "unit").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    return built.unionByName(hashed)


def repeats(docs: DataFrame, scratch: Scratch, rules: tuple[Rule, ...]) -> DataFrame:
    """docs: key, text. (key, w) of texts with repeats; w: rule, first symbol, and the first after it."""
    found = scratch.keep("windows", windows(docs, rules))
    rule = F.expr("CAST(shiftright(place, 60) AS INT)").alias("rule")
    # numbers only, so these aggregates hash and combine before the shuffle
    kinds = found.groupBy("anchor", "full").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min_by("place", "key").alias("place"))
    kinds = scratch.keep("kinds", kinds)
    shared = kinds.groupBy("anchor").agg(F.min(rule).alias("rule"), F.sum("n").alias("total"), F.count("*").alias("distinct"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    shared = shared.filter(_several("rule", "total", "least", "most")).select("anchor", "distinct")
    kinds = scratch.keep("shared", kinds.join(shared, "anchor").select(rule, "anchor", "full", "n", "lo", "hi", "distinct", "place"))
    scratch.drop("kinds")
    fine = scratch.keep("fine", fine_members(docs, kinds.filter("distinct > 1").select(F.col("lo").alias("key"), "place", "anchor", "full", "n", "lo", "hi")))
    members = fine.groupBy("anchor", "core", "unit").agg(F.min("rule").alias("rule"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("left").alias("left"), F.min("right").alias("right"))
    masks = scratch.keep("masks", _masks(scratch.keep("members", members), scratch))
    runs = fine.select("anchor", "full", "rel", "core", "unit").join(masks, ["anchor", "core", "unit"]).groupBy("anchor", "full").agg(F.min(F.expr("rel - high")).alias("from"), F.max(F.expr("rel - low")).alias("to"))
    several = _several("rule", "n", "lo", "hi")
    whole = kinds.filter(several).select("anchor", "full", F.lit(0).alias("from"), F.expr("CAST(place & 1023 AS INT)").alias("to"))
    part = kinds.filter(f"NOT {several} AND distinct > 1").select("anchor", "full").join(runs, ["anchor", "full"])
    length = f"CASE shiftright(place, 60) {' '.join(f'WHEN {r.number} THEN {r.length}' for r in RULES.values())} END"
    hit = found.join(whole.unionByName(part), ["anchor", "full"]).select("key", rule, F.expr("CAST((shiftright(place, 20) & 1099511627775) - (shiftright(place, 10) & 1023) AS INT)").alias("s1"), "from", F.expr(f"to + {length}").alias("end"))
    # a set: rows with equal ids and texts give each entry many times, combined before the shuffle
    out = hit.groupBy("key").agg(F.collect_set(F.struct("rule", F.expr("s1 + from AS a"), F.expr("s1 + end AS b"))).alias("w"))
    out = scratch.keep("hits", out)
    scratch.drop("windows", "shared", "fine", "members", "masks", "large", "strings")
    return out


def covered(n: int, found: list[dict] | None, rule: Rule) -> np.ndarray:
    """Which of a text's n symbols stand in a repeat."""
    delta = np.zeros(n + 1, np.int32)
    for w in found or []:
        if w["rule"] == rule.number:
            delta[w["a"]] += 1
            delta[w["b"]] -= 1
    return np.cumsum(delta[:-1]) > 0


def _runs(flags: np.ndarray) -> int:
    return int(np.count_nonzero(np.diff(flags.astype(np.int8), prepend=0) == 1))


def without(text: str, found: list[dict], rules: tuple[Rule, ...]) -> str:
    """A text less its repeats: bytes with the rest of their character, words with the space after them."""
    numbers = {w["rule"] for w in found}
    for rule in sorted((r for r in rules if r.number in numbers), key=lambda r: -r.width):
        if rule.width == 1:
            data = text.encode()
            gone = covered(len(data), found, rule)
            text = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        else:
            places = [m.start() for m in WORD.finditer(text)]
            gone = covered(len(places), found, rule)
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            kept, at = [], 0
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                kept.append(text[at : places[a]])
                at = places[b] if b < len(places) else len(text)
            text = "".join(kept) + text[at:]
    return text


def _key() -> Column:
    """Which document a row is: rows with equal ids and texts are one."""
    return F.xxhash64("doc_id", "text").alias("key")


def clean(docs: DataFrame, spark: SparkSession, rule: Rule = BYTES) -> DataFrame:
    """The documents, all columns, with what repeats under a rule removed from their texts.

    n_chars is counted anew where there is such a column.
    """
    found = repeats(docs.select(_key(), "text"), Scratch(spark, "suffix"), (rule,))
    rows = docs.select(_key(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.column(0).flatten()
            texts = [without(text.as_py(), w.as_py(), (rule,)) if w.is_valid and text.is_valid else text.as_py() for text, w in zip(cols[at], batch.column(1), strict=True)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = rows.join(found, "key", "left").select("row", "w").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """What of each text is repeated bytes, and (n_passage_words, n_passages) repeated passages of words."""
    found = repeats(docs.select(_key(), "text"), Scratch(spark, "suffix"), (BYTES, WORDS))
    own = docs.select(_key(), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, gone, words = data, np.zeros(0, bool), np.zeros(0, bool)
                if w.is_valid:
                    entries = w.as_py()
                    gone = covered(len(data), entries, BYTES)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    words = covered(max([0, *(x["b"] for x in entries if x["rule"] == WORDS.number)]), entries, WORDS)
                out.append((doc, len(data), int(gone.sum()), _runs(gone), hashlib.sha256(kept).hexdigest(), int(words.sum()), _runs(words)))
            if out:
                yield _batch(out, DIGEST)

    return own.join(found, "key", "left").select("doc_id", "text", "w").mapInArrow(run, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), spark)
