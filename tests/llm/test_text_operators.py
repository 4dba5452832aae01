"""Operators on documents against brute force, on small texts with awkward rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import line_cleaning, minhash_dedup, mixing, packing, quality, suffix_dedup, toxicity
from ledgerloom.session import Scratch, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed: int = 1, n: int = 120) -> list[tuple]:
    """Near copies, exact copies, shared passages, repeats, nulls, empties, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(40, 220))) + "." for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = rng.choice(base)
        if rng.random() < 0.6:
            w = t.split(" ")
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        if rng.random() < 0.2:
            t += "\n" + rng.choice(base)[:600]
        rows.append((i, t, "en", f"src{i % 3 * i % 5}", len(t)))
    odd = ["De " * 700, "ab" * 300, "a" * 1500, "", None, "one two", "é" * 500, "Home | About | Login\n" * 30]
    rows += [(1000 + k, t, "en", None if k % 2 else "src0", 0) for k, t in enumerate(odd)]
    return [*rows, rows[0], rows[-2]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_suffix_dedup_removes_what_brute_force_removes(spark, docs, empty):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = Counter(b[k : k + 400] for _, b in rows for k in range(len(b) - 399))
    want = []
    for doc, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((doc, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r)[:5] for r in suffix_dedup.digest(docs, spark).collect()) == sorted(want)
    assert suffix_dedup.digest(empty, spark).count() == 0
    cleaned = {r["doc_id"]: r for r in suffix_dedup.clean(docs, spark).collect()}
    sizes = {w[0]: w[1] - w[2] for w in want}
    assert all(len((r["text"] or "").encode()) <= sizes[d] and r["n_chars"] == len(r["text"] or "") for d, r in cleaned.items() if r["text"] is not None)


def test_column_wise_construction_of_one_collection():
    rng = random.Random(2)
    for _ in range(20):
        m = rng.randint(1, 30)
        left, right = [bytes(rng.choices(b"ab", k=rng.randint(0, 31))) for _ in range(m)], [bytes(rng.choices(b"ab", k=rng.choice([31, 31, 30, 5]))) for _ in range(m)]
        group, n = np.sort(np.array([rng.randint(0, 2) for _ in range(m)])), np.array([rng.choice([1, 1, 1, 2]) for _ in range(m)])
        got = suffix_dedup.repeated_starts(group, left, right, n)
        strings = Counter()
        for g, a, b, k in zip(group, left, right, n, strict=True):
            for t in range(len(a) + 1):
                if 31 - t <= len(b):
                    strings[g, t, a[len(a) - t :], b[: 31 - t]] += k
        want = [sum(1 << t for t in range(len(a) + 1) if 31 - t <= len(b) and strings[g, t, a[len(a) - t :], b[: 31 - t]] > 1) for g, a, b in zip(group, left, right, strict=True)]
        # starts to the right of a member's own ones belong to another block
        own = [w & ~((1 << (31 - len(b))) - 1) for w, b in zip(want, right, strict=True)]
        assert got.tolist() == own


def shingle_bags(rows):
    out = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        if w:
            out[doc] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    return out


def near_components(rows):
    bags, up = shingle_bags(rows), {d: d for d, _ in rows}

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
    return {d: find(d) for d, _ in rows}


def test_minhash_finds_all_components(spark, docs, empty):
    got = minhash_dedup.near_duplicates(docs, Scratch(spark, "t")).collect()
    want = near_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(got) == docs.count()
    assert minhash_dedup.near_duplicates(empty, Scratch(spark, "t")).count() == 0
    one = minhash_dedup.one_of_each(docs, Scratch(spark, "t"))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(want.values()))


def test_open_buckets_are_compared_throughout(spark):
    rng = random.Random(3)
    rows, text = [], [f"w{k}" for k in range(200)]
    for i in range(600):  # a chain: neighbours are near, ends are not
        text = text[:]
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shingler = minhash_dedup.Shingler()
    there = spark.createDataFrame([(7, i, shingler.key(shingler.words(t))) for i, t in rows], "band long, id long, key long")
    links = minhash_dedup.compare_throughout(there, docs)
    found = minhash_dedup.components(links, Scratch(spark, "t"))
    want = near_components(rows)
    got = {r["a"]: r["b"] for r in found.collect()}
    assert {d: got.get(d, d) for d, _ in rows} == want


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    for n in (3, 40, 600):
        hits, true = [], []
        for _ in range(40):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            b[: max(1, n // 9)] = rng.integers(0, 2**63, max(1, n // 9)).astype(np.uint64)
            counts = rng.integers(1, 4, n)
            hits.append((minhash_dedup.signature(a, counts) == minhash_dedup.signature(b, counts)).mean())
            shared, all_ = counts[max(1, n // 9) :].sum(), counts.sum()
            true.append(shared / (2 * all_ - shared))
        assert abs(np.mean(hits) - np.mean(true)) < 0.03


@pytest.mark.parametrize("module", [line_cleaning, mixing])
def test_sql_agrees(spark, data, module):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = module.query(spark, data)
    want = con.sql(module.SQL)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


def test_line_figures(docs, empty):
    got = {r["doc_id"]: r for r in line_cleaning.clean_lines(docs).collect()}
    for doc, text, *_ in texts():
        t = text or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = defaultdict(list)
        for k in range(len(words) - 7):
            grams[tuple(words[k : k + 8])].append(k)
        repeat = {k + j for ks in grams.values() if len(ks) > 1 for k in ks for j in range(8)}
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(repeat))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert not (r["kept"] and r["base_failed"])
    assert line_cleaning.clean_lines(empty).count() == 0
    assert not got[1007]["kept"]


def test_mix_meets_targets(spark, docs, empty):
    rows = [tuple(r) for r in mixing.mix(docs, spark).collect()]
    assert rows and sorted(rows) == sorted(tuple(r) for r in mixing.mix(docs, spark).collect())
    total = sum(r[1] for r in rows)
    by = defaultdict(lambda: [0, 0.0, 0])
    for (_, size, source_size, target, taken) in rows:
        assert taken <= 2 * size
        by[source_size, target][0] += taken
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6
    assert abs(sum(taken for taken, *_ in by.values()) - 1.5 * total) <= 0.5
    assert all(abs(taken - target) <= 1 and target <= 2 * size for (size, target), (taken, *_) in by.items())
    assert mixing.mix(empty, spark).count() == 0
    again = mixing.mixed(docs, spark)
    assert again.columns == docs.columns
    words = sum(len(WORD.findall(r["text"])) for r in again.collect())
    assert words == sum(r[4] for r in rows)


def test_small_and_many_sources_meet_their_targets(spark):
    rng = random.Random(9)
    few = [(k, "word " * n, f"t{k}") for k, n in enumerate((33, 10, 50, 5, 1, 0, 2000))]
    many = [(k, "w " * rng.randint(0, 110), f"s{k // 2:04d}") for k in range(2000)]
    for rows in (few, many):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
        by = defaultdict(lambda: [0, 0, 0.0])
        for r in mixing.mix(docs, spark).join(docs.select("doc_id", "source"), "doc_id").collect():
            assert 0 <= r["taken"] <= 2 * r["size"]
            by[r["source"]] = [by[r["source"]][0] + r["taken"], r["source_size"], r["target"]]
        assert all(abs(taken - target) <= max(1, 0.01 * target) for taken, _, target in by.values())
        assert abs(sum(taken for taken, *_ in by.values()) - 1.5 * sum(size for _, size, _ in by.values())) <= 0.5


def test_apportionment_goes_by_highest_quotients(spark):
    rng = random.Random(5)
    sizes = [(k, f"s{rng.randint(0, 6)}", rng.randint(0, 9_000)) for k in range(60)]
    got = mixing.source_figures(spark.createDataFrame(sizes, "doc_id long, source string, size long"), spark).collect()
    block = 1  # quotas are counted in words
    heap = [(-r["target"], r["source"], 0, r["target"]) for r in got]
    heapq.heapify(heap)
    quota = Counter()
    for _ in range(int(sum(r["target"] for r in got) / block + 0.5)):
        _, s, q, t = heapq.heappop(heap)
        quota[s] += 1
        heapq.heappush(heap, (-t / (2 * q + 3), s, q + 1, t))
    assert {r["source"]: r["q_full"] + r["q_last"] for r in got} == dict(quota)


def test_packing_covers_every_id_once(docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, path).collect()
    tokenizer = packing._tokenizer(path)
    want = Counter()
    for doc, text, *_ in texts():
        want[doc, np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4").tobytes()] += 1
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    for (doc, ids), copies in want.items():
        own = by_doc[doc]
        assert sum(p["length"] for p in own) == copies * len(ids) // 4
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("text", ["  a   b ", "x<|endoftext|>y", "İstanbul ΣΑΣ", "á e ́", "a b", "don't 'S we'Re 1234", "😀x 漢字 ½²", "a\x1cb\x85c d"])
def test_encoder_is_the_tokenizer(text):
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(text) == want == encoder.encode(text)


def test_quality_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    scored = quality.query(spark, sf)
    assert scored.count() == table(spark, sf, "documents").count()
    held = scored.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    toxic = toxicity.query(spark, sf)
    assert toxic.count() == scored.count()
    held = toxic.withColumnRenamed("toxic", "p").filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["is_toxic"] == (r["toxic"] == 1) for r in held]) > 0.88


def test_classifiers_take_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).filter("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality.score(empty, model).count() == 0
    chain = toxicity.fit(docs, labels)
    assert toxicity.score(docs, chain).count() == docs.count()
    wide = docs.withColumn("score", F.lit("clash"))
    assert quality.keep(wide, model).columns == wide.columns
