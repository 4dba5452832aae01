"""Alignment of two tokenizers over the same bytes, and counts of the ids they link.

A is the byte-level vocabulary over space and text, B the piece vocabulary, which adds the
space itself. Running sums of token lengths (``cumsum``) give each token's end; the ends that
both share (``intersect1d``) are the common cuts, and ``searchsorted`` labels tokens with the
group between two cuts. Tokens whose byte ranges overlap are linked: the first and last
partner of each A token follow from ``searchsorted``, and ``repeat`` expands them.

Both vocabularies cut where a space or a line feed follows a character that is no white
space, whatever stands around it: A's pattern never lets such a run go on, B has no piece
with a space but at its start and none with a line feed. What lies between two such places
is a unit. A task encodes and aligns each unit once, many at a time, and remembers it; a
document's figures are sums over its units.

Counting: a chunk is a stretch of a task's documents with up to ``UNITS`` different units. Its id
pairs are counted in the task (each pair once a chunk), then by pair and salt, then by pair.
Counts go back to the chunks that asked, one row a pair, and a chunk's documents follow in
the same sorted partition, so that no link or pair of a single document is ever shuffled.
The highest count of a B id is one row an id, bounded by the vocabulary.

Cases: a text that is null, empty, or not given back by the tokens' bytes has no tokens; very
long texts are held whole in their task, with their different units; repeated rows and ids are
rows of their own; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.packing import _byte_letters
from ledgerloom.session import Scratch, table

#: Different units of a chunk, units encoded together, characters of documents taken at a time.
UNITS, TOGETHER, TAKEN = 250_000, 512, 2_000_000
SALTS = 16
#: Stands before units that are encoded together, so that the first has a neighbour too.
ANCHOR = " x"
RUN = re.compile(r"\s[ \n]")
CUT = re.compile(r"(?<=\S)(?=[ \n])")
PAIR, UNIT, DOCUMENT = 0, 1, 2
LEAST = "chunk long, kind int, k int, pair long, times long, ends array<int>, pairs array<int>, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units array<int>"


@lru_cache(maxsize=2)
def _vocabularies(byte_path: str, piece_path: str):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
    a.encode_special_tokens = True
    back = {letter: byte for byte, letter in _byte_letters().items()}
    spelt_a = {i: bytes(back[c] for c in token) for token, i in json.loads(a.to_str())["model"]["vocab"].items()}
    spelt_b = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        spelt_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    return a, b, [spelt_a.get(i, b"") for i in range(max(spelt_a) + 1)], spelt_b


def split(text: str) -> list[str]:
    """Units of a space and the text."""
    text = f" {text}"
    if "\x1f" in text or RUN.search(text):
        return CUT.split(text)
    return text.replace(" ", "\x1f ").replace("\n", "\x1f\n").split("\x1f")[1:]


class Aligner:
    """Remembers units; ``learn`` aligns new ones, ``known`` numbers them from 0."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b, self.spelt_a, self.spelt_b = _vocabularies(byte_path, piece_path)
        self.length_a, self.length_b = (np.array([len(x) for x in spelt], np.int64) for spelt in (self.spelt_a, self.spelt_b))
        n_a, n_b = len(self.spelt_a), len(self.spelt_b)
        #: What a token writes: an A token not last or last in its group, then a B token.
        self.text = [f"{i}{end}" for end, n in ((",", n_a), ("|", n_a), (",", n_b), (";", n_b)) for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: By unit: tokens of A and B, groups, links; rows of negative figures have no tokens.
        self.figures: list[np.ndarray] = []
        self.groups: list[str] = []
        self.pairs: list[np.ndarray] = []
        self._all = None

    def all_figures(self) -> np.ndarray:
        if self._all is None or len(self._all) < len(self.known):
            self.figures = [np.concatenate([np.zeros((0, 4), np.int64), *self.figures])]
            self._all = self.figures[0]
        return self._all

    def learn(self, units: Iterable[str]) -> None:
        new = [u for u in units if u not in self.known]
        odd = [u for u in new if u[-1].isspace()]
        even = [u for u in new if not u[-1].isspace()]
        for k in range(0, len(even), TOGETHER):
            part = even[k : k + TOGETHER]
            if not self._align(part):
                odd += part
        for u in odd:
            if not self._align([u]):
                self._put([u], np.full((1, 4), -1, np.int64), [""], np.zeros(0, np.int64))

    def _put(self, units: list[str], figures: np.ndarray, groups: list[str], pairs: np.ndarray) -> None:
        for u in units:
            self.known[u] = len(self.known)
        self.figures.append(figures)
        self.groups += groups
        self.pairs.append(pairs)

    def _align(self, units: list[str]) -> bool:
        """Align units written one after the other; False if the tokens don't give them back."""
        joined = ANCHOR + "".join(units)
        ids_a = np.array(self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
        ids_b = np.array(self.b.encode(joined[1:], num_threads=1), np.int64)
        spelt = joined.encode()
        if any(b"".join(map(table.__getitem__, ids.tolist())) != spelt for table, ids in ((self.spelt_a, ids_a), (self.spelt_b, ids_b))):
            return False
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        edges = np.cumsum([len(ANCHOR), *(len(u.encode()) for u in units)])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # no token is empty, so ends rise
        if (cuts[np.minimum(np.searchsorted(cuts, edges), len(cuts) - 1)] != edges).any():
            return False
        keep_a, keep_b, cuts = ends_a > edges[0], ends_b > edges[0], cuts[cuts > edges[0]]
        ids_a, ids_b, ends_a, ends_b = ids_a[keep_a], ids_b[keep_b], ends_a[keep_a], ends_b[keep_b]
        starts_a, starts_b = ends_a - self.length_a[ids_a], ends_b - self.length_b[ids_b]
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        first = np.searchsorted(ends_b, starts_a, "right")
        partners = np.searchsorted(starts_b, ends_a, "left") - first
        linked_a = np.repeat(np.arange(len(ids_a)), partners)
        linked_b = np.arange(len(linked_a)) - np.repeat(np.cumsum(partners) - partners - first, partners)
        of = lambda ends: np.searchsorted(edges[1:], ends)
        unit_a, unit_b, n = of(ends_a), of(ends_b), len(units)
        count = lambda unit: np.bincount(unit, minlength=n)
        figures = np.stack([count(unit_a), count(unit_b), count(of(cuts)), count(unit_a[linked_a])], axis=1)
        # a group's A tokens are written before its B tokens
        n_a, n_b = len(self.spelt_a), len(self.spelt_b)
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = ids_a + n_a * (np.diff(group_a, append=len(cuts)) > 0)
        order[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * n_a + ids_b + n_b * (np.diff(group_b, append=len(cuts)) > 0)
        written = list(map(self.text.__getitem__, order.tolist()))
        ends = np.cumsum(figures[:, 0] + figures[:, 1]).tolist()
        groups = ["".join(written[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        self._put(units, figures, groups, ids_a[linked_a] * n_b + ids_b[linked_b])
        return True


def _documents(aligner: Aligner, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Units, figures and written groups of texts."""
    split_up = [split(t) if t else [] for t in texts]
    aligner.learn(dict.fromkeys(u for units in split_up for u in units))
    figures, groups = aligner.all_figures(), aligner.groups
    for units in split_up:
        numbers = np.fromiter(map(aligner.known.__getitem__, units), np.int32, len(units))
        own = figures[numbers]
        if len(own) and own[:, 0].min() >= 0:
            yield numbers, own.sum(axis=0), "".join(map(groups.__getitem__, numbers.tolist()))[:-1]
        else:
            yield numbers[:0], np.zeros(4, np.int64), ""


def _parts(texts: list[str | None]) -> Iterator[slice]:
    """Slices of about ``TAKEN`` characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= TAKEN or k == len(texts) - 1:
            yield slice(start, k + 1)
            start, size = k + 1, 0


def groups(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id and the alignment as written text: ``a1,a2|b1;a3|b2,b3`` is two groups of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path)
        for batch in batches:
            texts, written = batch.column(1).to_pylist(), []
            for part in _parts(texts):
                written += [w for _, _, w in _documents(aligner, texts[part])]
                if len(aligner.known) > UNITS:
                    aligner.forget()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(written, pa.string())], names=["doc_id", "groups"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("groups", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """By chunk: the counts of its id pairs, its units' pairs, and its documents as lists of units."""
    import hashlib

    schema = T.StructType([*T.StructType.fromDDL(LEAST), docs.schema["doc_id"]])

    def batch_of(n: int, doc_type: pa.DataType, **columns) -> pa.RecordBatch:
        kinds = {"chunk": pa.int64(), "kind": pa.int32(), "k": pa.int32(), "pair": pa.int64(), "times": pa.int64(), "ends": pa.list_(pa.int32()), "pairs": pa.list_(pa.int32()), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "units": pa.list_(pa.int32()), "doc_id": doc_type}
        arrays = [columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(arrays, kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, chunk, doc_type = Aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32, None
        seen = np.zeros(0, np.int64)  # how often the chunk's documents have each unit

        def finish() -> Iterator[pa.RecordBatch]:
            if not len(seen):
                return
            all_pairs = np.concatenate([np.zeros(0, np.int64), *aligner.pairs])
            links = np.maximum(aligner.all_figures()[:, 3], 0)
            pairs, at = np.unique(all_pairs, return_inverse=True)
            times = np.bincount(at, weights=np.repeat(seen, links), minlength=len(pairs)).astype(np.int64)
            used = np.flatnonzero(times)  # pairs of units that only texts without tokens have count nothing
            yield batch_of(1, doc_type, chunk=[chunk], kind=[UNIT], ends=pa.array([np.cumsum(links).astype(np.int32)]), pairs=pa.array([at.astype(np.int32)]))
            for k in range(0, len(used), 50_000):
                u = used[k : k + 50_000]
                yield batch_of(len(u), doc_type, chunk=np.full(len(u), chunk), kind=np.full(len(u), PAIR, np.int32), k=u.astype(np.int32), pair=pairs[u], times=times[u])

        for batch in batches:
            doc_type, texts = batch.column(0).type, batch.column(1).to_pylist()
            for part in _parts(texts):
                units, figures, shas = [], [], []
                for numbers, own, written in _documents(aligner, texts[part]):
                    units.append(numbers)
                    figures.append(own)
                    shas.append(hashlib.sha256(written.encode()).hexdigest() if written else "")
                n, own = len(units), np.stack(figures)
                seen = np.pad(seen, (0, len(aligner.known) - len(seen)))
                seen += np.bincount(np.concatenate(units), minlength=len(seen))
                yield batch_of(n, doc_type, chunk=np.full(n, chunk), kind=np.full(n, DOCUMENT, np.int32), doc_id=batch.column(0)[part], groups_sha256=shas, units=units, **{c: own[:, k] for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))})
                if len(seen) > UNITS:
                    yield from finish()
                    aligner.forget()
                    chunk, seen = chunk + 1, np.zeros(0, np.int64)
        yield from finish()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(chunks: DataFrame, n_b: int) -> DataFrame:
    """(pair, a, b, times): how many links of all documents hold each pair of ids."""
    salted = chunks.filter(F.col("kind") == PAIR).groupBy("pair", F.expr(f"pmod(xxhash64(chunk), {SALTS})").alias("salt")).agg(F.sum("times").alias("times"))
    pairs = salted.groupBy("pair").agg(F.sum("times").alias("times"))
    return pairs.select("pair", F.expr(f"pair div {n_b}").alias("a"), F.expr(f"pair % {n_b}").alias("b"), "times")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by chunk and kind: answers by pair, the units, then the documents."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    none = np.zeros((0, 2), np.int64)
    chunk, answers, by_unit = None, [], none
    for batch in batches:
        chunks, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero(np.diff(chunks, prepend=-1) | np.diff(kinds, prepend=-1))
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(kinds)], strict=True):
            part = batch.slice(s, e - s)
            if chunks[s] != chunk:
                chunk, answers, by_unit = chunks[s], [], none
            if kinds[s] == PAIR:
                answers.append(np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "count", "best")]))
            elif kinds[s] == UNIT:
                ends, pairs = (part.column(c)[0].values.to_numpy() for c in ("ends", "pairs"))
                k, count, best = np.concatenate([np.zeros((3, 0), np.int64), *answers], axis=1)
                table = np.zeros((pairs.max(initial=-1) + 1, 2), np.int64)
                table[k] = np.stack([best, count], axis=1)
                total = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(table[pairs], axis=0)])
                by_unit, answers = np.diff(total[np.concatenate([[0], ends])], axis=0), []
            else:
                units = part.column("units")
                flat = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(by_unit[units.flatten().to_numpy()], axis=0)])
                ends = np.cumsum(np.concatenate([[0], units.value_lengths().to_numpy()]))
                sums = flat[ends[1:]] - flat[ends[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(sums[:, names.index(c) - 5]) if c in ("n_best", "count_sum") else part.column(c) for c in names], names=names)


def align(docs: DataFrame, scratch: Scratch, byte_path: str, piece_path: str) -> DataFrame:
    """The figures of every document."""
    chunks = scratch.keep("aligned", aligned(docs, byte_path, piece_path))
    counts = scratch.keep("counts", pair_counts(chunks, len(_vocabularies(byte_path, piece_path)[3])))
    highest = counts.groupBy("b").agg(F.max("times").alias("most"))
    ranked = counts.join(F.broadcast(highest), "b").select("pair", F.col("times").alias("count"), (F.col("times") == F.col("most")).cast("int").alias("best"))
    asked = chunks.filter(F.col("kind") == PAIR).select("chunk", "kind", "k", "pair").join(ranked, "pair").drop("pair")
    there = chunks.filter(F.col("kind") != PAIR).drop("pair", "times")
    dealt = there.unionByName(asked, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")])
    return dealt.mapInArrow(_scored, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), Scratch(spark, "alignment"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
