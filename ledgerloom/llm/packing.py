"""Hierarchical multi-length packing of tokenised documents.

A document's windows of the longest tier are cut off at once; what is left over is routed
to the shortest tier that holds it. Tiers are packed from the longest down: each sequence
starts with the longest waiting piece of its tier, its gap is filled from waiting pieces of
shorter tiers, largest first, and a last piece is cut to close it exactly. The tail of a
task is laid out over ever shorter powers of two, so that no sequence needs padding.
Sequences of a task are dealt to step groups of equal token counts, longest first to the
lightest group.

Packing needs only token counts and may happen anywhere, so each task packs what it reads:
there is no shuffle, no key and no group, and a lost task redoes its own part alike. Waiting
pieces are bounded by ``WAITING`` documents and ``WAITING_TOKENS`` tokens, and hold their own
ids only; full windows never wait.

Tokens: ids of the tokenizer, then ``END``. White space never joins two words, so each run of
other characters is encoded once and remembered (at most ``REMEMBERED`` of them); a text that
holds a special token's string, which the tokenizer reads in raw text, is encoded whole.

Cases: a null or empty text has the one id ``END``; equal ids or repeated rows are packed each
by itself; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import table

END = 2
LONGEST = 4096
TIERS = (256, 512, 1024, 2048, LONGEST)
WAITING, WAITING_TOKENS = 2048, 1_000_000
REMEMBERED = 300_000
#: Tokens of a step group: so many sequences of the longest tier.
STEP = 8 * LONGEST
#: Sequence ids: the task's number times this, and the sequence's number in the task.
TASK = 1 << 36
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
_length = itemgetter(2)
BREAK = re.compile(r"[\x20\x09-\x0D]+")
#: What str.split() also takes for white space.
RARE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
SIMPLE = re.compile(r"[!-~\u00c0-\u00ff]*").fullmatch


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Token ids as little-endian 32-bit bytes.

    Words are remembered, and so are the pieces the tokenizer's own pattern splits them into,
    in two generations: when the newer is full it becomes the older. A new piece goes to the
    tokenizer's model alone. Words with other characters than ASCII and Latin-1, where
    normalisation may matter, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex

        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        steps = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.piece: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.piece.get(piece)
        if found is None:
            if len(self.piece) >= REMEMBERED:
                self.piece.clear()
            spelt = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            found = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt))
            self.piece[piece] = found
        return found

    def _learn(self, words: set[str]) -> None:
        for w in words:
            found = self.older.get(w)
            if found is None:
                found = b"".join(map(self._piece, self.pieces(w.lower()))) if SIMPLE(w) else self._whole(w)
            self.known[w] = found

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        words = BREAK.split(text) if RARE(text) else text.split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {"": b""}
            self._learn(set(words).difference(self.known))
            return b"".join(map(self.known.__getitem__, words))


class Packer:
    """Packs the documents of one task; ``take`` and ``finish`` return finished pieces."""

    def __init__(self, task: int):
        self.task, self.sequences, self.done = task, 0, []
        self.waiting: dict[int, list] = {t: [] for t in TIERS}
        self.count = self.tokens = 0
        self.groups: list[tuple[int, int]] = []
        self.n_groups = 0

    def _emit(self, pieces: list, tier: int) -> None:
        used = sum(p[2] for p in pieces)
        if self.groups and self.groups[0][0] + used <= STEP:
            load, group = heapq.heappop(self.groups)
        else:
            load, group = 0, self.task * TASK + self.n_groups
            self.n_groups += 1
        if load + used < STEP:
            heapq.heappush(self.groups, (load + used, group))
        sequence, at = self.task * TASK + self.sequences, 0
        self.sequences += 1
        for doc, start, length, ids, total in pieces:  # ids: those of the piece
            self.done.append((doc, start, length, zlib.crc32(ids), total, sequence, at, tier, group))
            at += length

    def _wait(self, piece: tuple) -> None:
        if piece[2]:
            self.waiting[next(t for t in TIERS if piece[2] <= t)].append(piece)
            self.count += 1
            self.tokens += piece[2]

    def take(self, doc, ids: bytes) -> None:
        total, start, view = len(ids) // 4, 0, memoryview(ids)
        while total - start >= LONGEST:
            self._emit([(doc, start, LONGEST, view[4 * start : 4 * (start + LONGEST)], total)], LONGEST)
            start += LONGEST
        self._wait((doc, start, total - start, ids[4 * start :], total))
        if self.count >= WAITING or self.tokens >= WAITING_TOKENS:
            self.pack()

    def pack(self) -> None:
        """Fill sequences tier by tier; what cannot fill one of its tier goes on waiting."""
        pool = {t: sorted(self.waiting[t], key=_length) for t in TIERS}
        self.waiting, self.count, self.tokens = {t: [] for t in TIERS}, 0, 0
        for k in range(len(TIERS) - 1, -1, -1):
            tier = TIERS[k]
            while pool[tier]:
                pieces, gap = [], tier
                for t in reversed(TIERS[: k + 1]):
                    while fits := bisect_right(pool[t], gap, key=_length):
                        pieces.append(pool[t].pop(fits - 1))
                        gap -= pieces[-1][2]
                if gap:  # only pieces longer than the gap are left: one is cut to close it
                    t = next((t for t in TIERS[: k + 1] if pool[t]), None)
                    if t is None:
                        for p in pieces:
                            self._wait(p)
                        return
                    doc, start, length, ids, total = pool[t].pop(0)
                    pieces.append((doc, start, gap, ids[: 4 * gap], total))
                    rest = (doc, start + gap, length - gap, ids[4 * gap :], total)
                    insort(pool[next(x for x in TIERS if rest[2] <= x)], rest, key=_length)
                self._emit(pieces, tier)

    def finish(self) -> None:
        self.pack()
        rest = [p for t in TIERS for p in self.waiting[t]]
        left, size = sum(p[2] for p in rest), LONGEST
        while left:
            if left < size:
                size //= 2
                continue
            pieces, gap = [], size
            while gap:
                doc, start, length, ids, total = rest.pop()
                cut = min(gap, length)
                pieces.append((doc, start, cut, ids[: 4 * cut], total))
                gap -= cut
                if cut < length:
                    rest.append((doc, start + cut, length - cut, ids[4 * cut :], total))
            self._emit(pieces, size)
            left -= size

    def drain(self) -> pa.RecordBatch | None:
        rows, self.done = self.done, []
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents (doc_id, text), each with its sequence, tier and step group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer_path), Packer(TaskContext.get().partitionId())
        end = END.to_bytes(4, "little")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.take(doc, encoder.encode(text.as_py() or "") + end)
                if len(packer.done) >= 20_000:
                    yield packer.drain()
        packer.finish()
        last = packer.drain()
        if last is not None:
            yield last

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
