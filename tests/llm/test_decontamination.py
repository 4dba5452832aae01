"""The suffix automaton against plain windows of words."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm import decontamination
from ledgerloom.session import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, length=10, coverage=1.0):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(length, max(1, -int(-coverage * len(w) // 1)))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(spark, seed, vocabulary=6):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["É", "Zz9"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", "\u007f"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 5, 9, 10, 11, 30, 60]))) for k in range(40)]
    items += [(3, items[3][1]), (77, items[5][1]), (78, items[5][1].upper()), (None, text(12)), (79, None), (80, ""), (81, " -- ")]
    docs = [(k, text(rng.randint(0, 120))) for k in range(120)]
    docs += [(200 + k, text(20) + items[k][1] + " " + text(20)) for k in range(40)]
    docs += [(1, None), (None, items[6][1]), (2, ""), (2, ""), (300, text(30_000)), (301, items[7][1].upper() * 3)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2)


def test_equals_plain_windows(spark):
    for seed, vocabulary in ((1, 3), (2, 40), (3, 400)):
        docs, items = tables(spark, seed, vocabulary)
        if vocabulary > 3:  # else every document has the items of one word
            items = [(i, t) for i, t in items if len(plain_words(t)) != 1]
        d, i = frames(spark, docs, items)
        got = decontamination.digest(decontamination.find(d, i, Scratch(spark, "t")))
        assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_small_automata_in_several_passes_find_the_same(spark, monkeypatch):
    docs, items = tables(spark, 4, 30)
    monkeypatch.setattr(decontamination, "BLOCK", 40)
    monkeypatch.setattr(decontamination, "PASS", 150)
    monkeypatch.setattr(decontamination, "CHUNK", 64)
    d, i = frames(spark, docs, items)
    got = decontamination.digest(decontamination.find(d, i, Scratch(spark, "t")))
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)
    got = decontamination.digest(decontamination.find(d, i, Scratch(spark, "t"), 4, 0.5))
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 4, 0.5)


def test_empty_tables(spark):
    docs, items = tables(spark, 5)
    d, i = frames(spark, docs, items)
    none = decontamination.digest(decontamination.find(d, i.filter(F.lit(False)), Scratch(spark, "t")))
    assert sorted(map(tuple, none.collect()), key=str) == plain(docs, [])
    assert decontamination.find(d.filter(F.lit(False)), i, Scratch(spark, "t")).count() == 0


def test_spans_are_cut_and_columns_kept(spark):
    passage = "One two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before. {passage.upper()}; after é", "x", 5), (2, passage, "x", 5), (3, None, "x", 5), (4, "clean text", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, n_words int")
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    out = decontamination.clean(docs, items, Scratch(spark, "t"))
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "Before. ; after é", 2: "", 3: None, 4: "clean text"}
    assert {r["doc_id"] for r in decontamination.clean(docs, items, Scratch(spark, "t"), most=0.9).collect()} == {1, 3, 4}


def test_longest_matches(spark):
    items = spark.createDataFrame([(1, " ".join(f"a{k}" for k in range(30)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(f"a{k}" for k in range(5, 22)) + " x " + " ".join(f"a{k}" for k in range(10)))], "doc_id long, text string")
    row = decontamination.find(docs, items, Scratch(spark, "t")).first()["found"]
    assert row["longest"] == 17 and [tuple(s) for s in row["spans"]] == [(1, 18), (19, 29)]
