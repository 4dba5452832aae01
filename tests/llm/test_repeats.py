"""Repeated passages of words, long texts, large collections and awkward columns."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import suffix_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, _w int, _key int, n_chars int"


def rows() -> list[tuple]:
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(500)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [some(n) for n in (50, 51, 52, 60, 80, 300)]
    out = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts += some(rng.randint(5, 120))
            if rng.random() < 0.6:
                parts += rng.choice(shared)
        text = "".join(w + rng.choice([" ", " ", "\n", "  "]) for w in parts)
        out.append((i, text))
    own = " ".join(some(70))
    out += [(100, own + " x " + own), (101, ""), (102, None), (None, out[3][1]), (None, " ".join(some(200))), (103, out[4][1]), (103, "other " + out[5][1]), out[6]]
    return [(i, t, "x", 1, 2, 0) for i, t in out]


def brute(found: list[tuple]) -> dict[tuple, np.ndarray]:
    """Per (id, text): which words stand in a string of 51 that another document has."""
    where = defaultdict(set)
    words = {(i, t): WORD.findall(t or "") for i, t, *_ in found}
    for doc, w in words.items():
        for k in range(len(w) - 50):
            where[tuple(w[k : k + 51])].add(doc)
    out = {}
    for doc, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 50):
            if len(where[tuple(w[k : k + 51])]) > 1:
                gone[k : k + 51] = True
        out[doc] = gone
    return out


def expected(found):
    out = []
    for i, t, *_ in found:
        gone, text = brute(found)[i, t], ""
        places = [(m.start(), m.group()) for m in WORD.finditer(t or "")]
        left = [w for (_, w), g in zip(places, gone, strict=True) if not g]
        out.append((i, left))
    return sorted(out, key=str)


@pytest.mark.parametrize("large", [50_000, 2])
def test_passages_of_words_go_as_brute_force_says(spark, monkeypatch, large):
    monkeypatch.setattr(sd, "LARGE", large)
    found = rows()
    docs = spark.createDataFrame(found, SCHEMA).repartition(4)
    got = sd.clean(docs, spark, sd.WORDS)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted([(r["doc_id"], WORD.findall(r["text"] or "")) for r in kept], key=str) == expected(found)
    assert all(r["n_chars"] == len(r["text"]) for r in kept if r["text"] is not None)
    assert {r["id"] for r in kept} == {"x"} and sum(r["text"] is None for r in kept) == 1
    marks = brute(found)
    digest = sd.digest(docs, spark).collect()
    want = sorted((str(i), int(marks[i, t].sum()), int(np.count_nonzero(np.diff(marks[i, t].astype(int), prepend=0) == 1))) for i, t, *_ in found)
    assert sorted((str(r["doc_id"]), r["n_passage_words"], r["n_passages"]) for r in digest) == want
    assert sum(n > 0 for _, n, _ in want) > 20


def test_large_collections_of_bytes_count_alike(spark, monkeypatch):
    rng = random.Random(1)
    notice = "".join(rng.choices("abcdefgh ", k=420))
    found = [(i, "".join(rng.choices("xyz", k=rng.randint(0, 60))) + notice[rng.randint(0, 5) :] + "".join(rng.choices("xyz", k=30)), "x", 0, 0, 0) for i in range(80)]
    docs = spark.createDataFrame(found, SCHEMA)
    want = sorted(map(tuple, sd.digest(docs, spark).collect()))
    monkeypatch.setattr(sd, "LARGE", 2)
    assert sorted(map(tuple, sd.digest(docs, spark).collect())) == want
    assert all(r[2] >= 400 for r in want)


def test_very_long_texts_and_empty_tables(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefghij ", k=1_300_000))
    piece = long[700_000:701_000]
    docs = spark.createDataFrame([(1, long, "", 0, 0, 0), (2, "start " + piece + " end", "", 0, 0, 0)], SCHEMA)
    got = {r["doc_id"]: r for r in sd.digest(docs, spark).collect()}
    assert got[2]["n_removed"] >= 1000 and got[1]["n_removed"] >= 1000 and got[1]["n_spans"] == got[2]["n_spans"] == 1
    assert got[1]["n_passage_words"] > 50
    none = docs.filter(F.lit(False))
    assert sd.digest(none, spark).count() == sd.clean(none, spark, sd.WORDS).count() == 0


def test_words_have_one_hash_wherever_they_stand(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcé漢", k=rng.randint(1, 9))).encode() for _ in range(300)] + [b"x" * 5000, b"y" * 4096]
    texts = [b"".join(rng.choice(words) + rng.choice([b" ", b"\n\t", b"  "]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [b"", b" ", b"a"]
    def read(texts):
        return [np.frombuffer(x, np.uint64).tolist() for x in sd.Symbols().of(texts, sd.WORDS)]
    found = read(texts)
    assert [len(x) for x in found] == [len(t.split()) for t in texts]
    names = {}
    for t, hashes in zip(texts, found, strict=True):
        for w, h in zip(t.split(), hashes, strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    assert found == [read([t])[0] for t in texts]
    monkeypatch.setattr(sd, "CHUNK", 1 << 13)
    joined = b" ".join(texts)
    assert read([joined])[0] == [h for hashes in found for h in hashes]
