"""The stages one by one on the smallest table, each against a plain version over its own input."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import packing, quality
from ledgerloom.session import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def good(spark, before, data):
    model = quality.fit(table(spark, data, "documents"), table(spark, data, "labels"))
    score = model.scorer()
    return Counter((r["doc_id"], r["text"]) for r in before if score((r["text"] or "").encode()) >= 0.5)


def one_of_each(before):
    bags = {}
    for r in before:
        w = words(r["text"])
        if w:
            bags[r["doc_id"]] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    up = {r["doc_id"]: r["doc_id"] for r in before}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sum((bags[a] & bags[b]).values()) * 5 >= sum((bags[a] | bags[b]).values()) * 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return Counter((r["doc_id"], r["text"]) for r in before if find(r["doc_id"]) == r["doc_id"])


def without_shared_passages(before):
    """Words that are left when each string of 51 words that another document has is gone."""
    where = defaultdict(set)
    for r in before:
        w = words(r["text"])
        for k in range(len(w) - 50):
            where[tuple(w[k : k + 51])].add(r["doc_id"])
    out = Counter()
    for r in before:
        w = words(r["text"])
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 50):
            if len(where[tuple(w[k : k + 51])]) > 1:
                gone[k : k + 51] = True
        out[r["doc_id"], tuple(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    return out


def targets(before):
    """Words a source should give: weights 3, 1, 2 by name, 150 % in all, none above twice its size."""
    size = Counter()
    for r in before:
        size[r["source"]] += len(words(r["text"]))
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight, left, open_ = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()), set(order)
    target = {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * size[s]}
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    return target


def test_every_stage_does_what_a_plain_version_does(spark, data):
    docs, kept, scratch = table(spark, data, "documents"), {}, Scratch(spark, "t")
    kept["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.keep(name, stage(spark, docs, data))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns == COLUMNS
    pairs = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    assert pairs(kept["quality"]) == good(spark, kept["documents"], data)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, data, "labels").collect()}
    left = {r["doc_id"] for r in kept["quality"]}
    fine = [d for d, q in labels.items() if q == 1]
    assert sum(d in left for d in fine) >= 0.95 * len(fine)
    assert pairs(kept["near_copies"]) == one_of_each(kept["quality"]) and len(kept["near_copies"]) < len(kept["quality"])
    assert Counter((r["doc_id"], tuple(words(r["text"]))) for r in kept["repeats"]) == without_shared_passages(kept["near_copies"])
    # each source gives its target to the word; a document no word that it hasn't, and none more than twice
    taken, own, has = Counter(), defaultdict(Counter), {r["doc_id"]: Counter(words(r["text"])) for r in kept["repeats"]}
    texts = {r["doc_id"]: r["text"] for r in kept["repeats"]}
    for r in kept["mixing"]:
        taken[r["source"]] += len(words(r["text"]))
        own[r["doc_id"]].update(words(r["text"]))
        assert r["text"] in texts[r["doc_id"]]
    assert all(abs(taken[s] - t) <= 1 for s, t in targets(kept["repeats"]).items())
    assert all(n <= 2 * has[d][w] for d, bag in own.items() for w, n in bag.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept["mixing"])
    got, loads = Counter(), Counter()
    for r in kept["packing"]:
        if r["start"] == 0:
            got[r["doc_tokens"]] += 1
        loads[r["sequence_id"]] += r["length"]
    assert got == want and sum(loads.values()) == sum(n * k for n, k in want.items())
    assert all(n <= packing.LONGEST and n & (n - 1) == 0 for n in loads.values())


def test_the_run_is_its_stages(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
