"""Alignment of whole texts, token by token, against the operator."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import alignment
from ledgerloom.session import Scratch

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NONE = (0, 0, 0, 0, 0, 0, "")


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain(docs):
    """doc_id and the contract's figures, from whole texts and loops over tokens."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    back, rows, counts = letters(), [], Counter()
    vocabulary = {i: bytes(back[c] for c in t) for t, i in json.loads(a.to_str())["model"]["vocab"].items()}
    spell = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    for doc, text in docs:
        if not text:
            rows.append((doc, None, None, None, None))
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelt = [[vocabulary[i] for i in ids[0]], [spell(i) for i in ids[1]]]
        if any(b"".join(s) != (" " + text).encode() for s in spelt):
            rows.append((doc, None, None, None, None))
            continue
        ranges = []
        for s in spelt:
            at, own = 0, []
            for x in s:
                own.append((at, at + len(x)))
                at += len(x)
            ranges.append(own)
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, at = [], [0, 0]
        for cut in cuts:
            sides = []
            for k in (0, 1):
                start = at[k]
                while at[k] < len(ids[k]) and ranges[k][at[k]][1] <= cut:
                    at[k] += 1
                sides.append(",".join(map(str, ids[k][start : at[k]])))
            groups.append("|".join(sides))
        links, j = [], 0
        for i, (s, e) in zip(ids[0], ranges[0], strict=True):
            while ranges[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ids[1]) and ranges[1][k][0] < e:
                links.append((i, ids[1][k]))
                k += 1
        counts.update(links)
        rows.append((doc, len(ids[0]), len(ids[1]), groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc, n_a, n_b, groups, links in rows:
        if n_a is None:
            out.append((doc, *NONE))
        else:
            out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    bits = ["the", "Straße", "naïve", "日本語", "नमस्ते", "1234", "!!", "don't", "<|endoftext|>", "</s>", "<0x41>", "\n", "\n\n", "  ", "\t", " ", "　", " ", "\x1f", "\x00", "😀", "é", "x", "y ", " z", "\r\n", "​", "﻿", "ﬁ", "Ａ"]
    join = lambda n: "".join(rng.choice(bits) + rng.choice([" ", " ", " ", "", "\n"]) for _ in range(n))
    return [(k, join(rng.randint(1, 60))) for k in range(150)]


def run(spark, docs, n=3):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(n)
    got = alignment.align(frame, Scratch(spark, "t"), BYTE, PIECE)
    return sorted((tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_equals_whole_texts(spark, data):
    docs = texts(1) + [(900, None), (901, ""), (None, "the x"), (5, "the x"), (5, "the x"), (902, "a▁b"), (903, "▁"), (904, " "), (905, "\n"), (906, " the "), (907, "word " * 20_000)]
    docs += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert run(spark, docs) == plain(docs)


def test_many_chunks_count_alike(spark, monkeypatch):
    monkeypatch.setattr(alignment, "UNITS", 30)
    monkeypatch.setattr(alignment, "TAKEN", 300)
    monkeypatch.setattr(alignment, "TOGETHER", 7)
    docs = texts(2) + [(900 + k, None) for k in range(30)]
    assert run(spark, docs, 2) == plain(docs)


def test_nothing_to_align(spark):
    assert run(spark, [(1, None), (2, ""), (3, "▁ ▁")]) == [(1, *NONE), (2, *NONE), (3, *NONE)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, Scratch(spark, "t"), BYTE, PIECE).count() == 0


def test_clashing_columns_and_written_groups(spark):
    docs = texts(3)[:20]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, chunk int, units string")
    assert alignment.align(frame, Scratch(spark, "t"), BYTE, PIECE).count() == 20
    written = {r["doc_id"]: r["groups"] for r in alignment.groups(frame, BYTE, PIECE).collect()}
    for doc, *_, sha in plain(docs):
        assert hashlib.sha256(written[doc].encode()).hexdigest() == sha if sha else written[doc] == ""
    counts = alignment.pair_counts(alignment.aligned(frame, BYTE, PIECE), 32_000)
    total = counts.agg(F.sum("times")).first()[0]
    assert total == sum(r[4] for r in plain(docs))
