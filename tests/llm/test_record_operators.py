"""Vectors, pages and conversations against brute force and round trips."""

from __future__ import annotations

import gzip
import hashlib

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import chat, components, embedding_dedup, warc
from ledgerloom.session import Scratch


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200)] + [(5, 300)]
    found = components.components(spark.createDataFrame(edges, "a long, b long").repartition(6), Scratch(spark, "t")).collect()
    got = {r["a"]: r["b"] for r in found}
    assert all(got[k] == 0 for k in range(1, 41)) and got[300] == 0
    assert all(got[k] == 100 for k in range(101, 160)) and got[201] == got[202] == 200
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_vector_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 400)] + 0.13 * rng.normal(size=(400, 16)), rng.normal(size=(200, 16))])
    x[50:60] = x[49]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0, 2.0]), (1005, [float("inf")] * 16), (1006, [])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), Scratch(spark, "t")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    found, want = sum(got[k]["n_links"] for k in range(600)), int(near.sum())
    assert all(got[k]["n_links"] <= near[k].sum() for k in range(600))
    assert found >= 0.98 * want > 1000
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k, _ in odd)
    assert all(got[k]["component_id"] == got[49]["component_id"] for k in range(50, 60))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>"), Scratch(spark, "t")).count() == 0


def test_archives_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a", big), (5, "http://b\n", big), (3, None, big), (4, "http://c", "short"), (6, "http://d", "short"), (7, "u", None), (8, "u", ""), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (5, "http://b", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write(pages, path)
    got = sorted(map(tuple, warc.resolve(warc.read(spark, path)).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = max(p for p, _, h in rows if (h or "") == (html or ""))
        again = len(data) >= 1000 and page != last
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    assert got == sorted(want, key=str)
    files = list((tmp_path / "a").glob("part-*.gz"))
    assert sum(gzip.decompress(f.read_bytes()).count(big.encode()) for f in files) == 2
    with pytest.raises(ValueError):
        list(warc.parse(gzip.decompress(files[0].read_bytes())[3:] or b"junk\r\n\r\n"))


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\<s>", "<\\s>", "[[INST]", "a\\", "\\\\[/INST]", "", "<s", "\n[/INST"])
def test_templates_are_reversible(text):
    said = [("user", text), ("assistant", text), ("we ird\n%", text)]
    whole = "".join(chat.format_turn(*x)[0] for x in said)
    assert [(r, t) for r, t, _ in chat.parse(whole)] == said
    start, length = chat.format_turn("assistant", text)[1:]
    assert chat.unescape(chat.format_turn("assistant", text)[0][start : start + length]) == text


def test_tree_shares_beginnings(spark):
    import public_tokenizers

    rows = [(c, 0, "system", "be kind") for c in range(6)] + [(c, 1, "user", f"q{c // 2}") for c in range(6)] + [(c, 2, "assistant", f"a{c}") for c in range(4)] + [(9, 0, None, None), (9, 0, None, None)]
    own = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ids, leaves, tree = chat.format_all(own, Scratch(spark, "t"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    nodes = {r["node"]: r for r in tree.collect()}
    assert len(nodes) == 1 + 3 + 4 + 2
    spans = sorted((n["offset"], n["offset"] + n["length"]) for n in nodes.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for n in nodes.values():
        above, chain = n["parent"], [(n["offset"], n["offset"] + n["length"])]
        while above:
            p = nodes[above]
            chain.append((p["offset"], p["offset"] + p["length"]))
            above = p["parent"]
        attended = {t for s in n["attends"] for t in range(s["start"], s["end"])}
        assert attended == {t for a, b in chain for t in range(a, b)}
        assert n["position"] == sum(b - a for a, b in chain[1:])
    assert ids.count() == 7
    assert chat.read_back(leaves, tree).count() == leaves.count() == 6


@pytest.mark.parametrize("module", [warc, chat])
def test_sql_agrees(spark, data, module):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = module.query(spark, data), con.sql(module.SQL)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(str(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())
