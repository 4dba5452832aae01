"""Very long values, rows without ids, clashing names and empty tables, for the operators on records and sequences."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import chat, line_cleaning, mixing, packing, warc
from ledgerloom.session import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_waiting_pieces_hold_their_own_ids_only():
    packer, docs = packing.Packer(0), {}
    for k in range(300):
        ids = bytes(random.Random(k).randbytes(4 * (4096 * 3 + k % 100 + 1)))
        docs[k] = ids
        packer.take(k, ids)
        assert sum(len(p[3]) for ps in packer.waiting.values() for p in ps) == 4 * packer.tokens
    packer.finish()
    rows = packer.drain().to_pylist()
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]]
        at[r["doc_id"]] += r["length"]
        assert zlib.crc32(docs[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    assert all(at[k] == len(ids) // 4 for k, ids in docs.items())


def test_large_payloads_have_files_of_their_own_and_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 5000)
    monkeypatch.setattr(warc, "CHUNK", 100)
    rng = random.Random(1)
    html = lambda n: "".join(rng.choices("abc<>\r\n é", k=n))
    big = html(300_000)
    rows = [(k, None, html(rng.randint(0, 900)), 1, "x") for k in range(30)] + [(100 + k, "u", html(6000), 1, "x") for k in range(20)] + [(200, "u", big, 1, "x"), (201, "u", big, 1, "x"), (None, "u", big, 1, "x"), (None, "u", "tiny", 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int, original string").repartition(1)
    path = f"file://{tmp_path}/a"
    warc.write(pages, path)
    assert len(list((tmp_path / "a").glob("part-*.gz"))) >= 1 + 23 // warc.LARGE_PER_FILE
    got = sorted(map(tuple, warc.resolve(warc.read(spark, path)).collect()), key=str)
    want = []
    for page, _, h, *_ in rows:
        again = h == big and page != 201
        want.append((page, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if again else "response", 201 if again else None))
    assert got == sorted(want, key=str)
    none = pages.filter(F.lit(False))
    warc.write(none, f"file://{tmp_path}/b")
    assert warc.resolve(warc.read(spark, f"file://{tmp_path}/b")).count() == 0


def test_mixed_rows_are_passages_of_their_documents(spark):
    rng = random.Random(3)
    text = lambda n: "".join("".join(rng.choices("abcdef", k=4)) + rng.choice(" \n") for _ in range(n))
    rows = [(k, text(rng.randint(0, 400)), f"s{k % 4}", 1, 2, 3, 0) for k in range(80)] + [(200, text(200_000), "s0", 1, 2, 3, 0), (None, text(100), None, 1, 2, 3, 0), (None, None, None, 1, 2, 3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, start long, rank int, _row int, n_chars int").repartition(4)
    counts = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(docs, spark).collect()}
    out = mixing.mixed(docs, spark)
    assert out.columns == docs.columns
    texts, words = {r[0]: r[1] for r in rows if r[0] is not None}, defaultdict(int)
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        if r["doc_id"] is not None:
            assert r["text"] in texts[r["doc_id"]]
    assert all(words[d] == taken for (d, _), taken in counts.items() if d is not None)
    assert mixing.mixed(docs.filter(F.lit(False)), spark).count() == 0


def test_long_texts_and_names_in_the_rest(spark):
    import public_tokenizers

    long = "word " * 300_000
    docs = spark.createDataFrame([(1, long, 1, "k"), (None, "a b\n" * 30, 1, "k"), (2, None, 1, "k")], "doc_id long, text string, t int, key string")
    got = {r["doc_id"]: r for r in line_cleaning.clean_lines(docs).collect()}
    assert got[1]["n_words"] == 300_000 and got[1]["n_repeat_words"] == 300_000 and not got[1]["kept"] and got[2]["n_words"] == 0
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, path).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 1) == next(p["doc_tokens"] for p in pieces if p["doc_id"] == 1) > 300_000
    talk = spark.createDataFrame([(1, 0, "user", long, 5, "n"), (None, 0, None, "x", 5, "n"), (None, 1, "assistant", None, 5, "n")], "conv_id long, turn long, role string, text string, leaf int, node string")
    ids, leaves, tree = chat.format_all(talk, Scratch(spark, "t"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    back = {r["n_turns"]: r for r in chat.read_back(leaves, tree).collect()}
    assert back[1]["formatted_chars"] > len(long) and back[2]["loss_chars"] == 0
    none = talk.filter(F.lit(False))
    ids, leaves, tree = chat.format_all(none, Scratch(spark, "t"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert ids.count() == chat.read_back(leaves, tree).count() == 0
