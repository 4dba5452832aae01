"""Conversations as a prefix tree in depth-first order.

A node is a turn together with all turns before it, named by a running hash, so conversations
that begin alike share nodes. Equal conversations are merged first. The others are sorted by
their nodes' names, which brings shared beginnings together: a node is new where it differs
from the conversation before, and the new nodes in that order are the tree depth first. A
node that two ranges of the sort both met is kept where it came first. A running total over
ranges and within them gives each node's place among all tokens; it attends to its ancestors'
intervals, joined where they touch, and its own; position ids count on from its parent's.

Every step handles each conversation's turns once, so neither a first turn that a third of
all conversations share nor a very deep conversation costs more than its rows.

Template: ``[INST]role\\ntext[/INST]`` for turns that are read, ``<s>assistant\\ntext</s>`` for
those that are learnt from. Inside texts a control string gets a backslash after its first
character and a backslash is doubled; roles are percent-encoded.

Cases: a null text counts as empty, a null role as the empty role; equal rows are turns of
their own; turns with equal numbers go by role and text; rows without conv_id form one
conversation; an empty table gives only the fixed conversation -1; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import Scratch, table

LEARNT = "assistant"
READ, LEARN = ("[INST]", "[/INST]"), ("<s>", "</s>")
CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
TURN = re.compile(r"\[INST\](.*?)\n(.*?)\[/INST\]|<s>(.*?)\n(.*?)</s>", re.S)
FIXED = "</s>[INST] ok [/INST]"
CONVERSATION = "conv_id long, leaf string, nodes array<string>, texts array<string>, starts array<int>, lengths array<int>"
NODE = "node string, parent string, owner string, text string, loss_start int, loss_length int, ids array<int>, part int, seq long"
PLACE = "node string, position long, attends array<struct<start:bigint,end:bigint>>"
OUT = "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's text, and where in it the learnt part starts and how long it is."""
    opened, closed = LEARN if role == LEARNT else READ
    head, body = f"{opened}{quote(role, safe='')}\n", escape(text)
    return head + body + closed, len(head), len(body) if role == LEARNT else 0


def parse(text: str) -> list[tuple[str, str, bool]]:
    """(role, text, learnt) of each turn of a formatted conversation."""
    found, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if m is None:
            raise ValueError("a turn is malformed")
        learnt = m[3] is not None
        found.append((unquote(m[3] if learnt else m[1]), unescape(m[4] if learnt else m[2]), learnt))
        at = m.end()
    return found


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
    "array<struct<start:bigint,end:bigint>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(maxsplit=1) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def named(conversations: DataFrame) -> DataFrame:
    """A row per conversation: its nodes' names, the last one's, and the formatted turns."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("conv_id", "rows.role", "rows.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, roles, texts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                said = [format_turn(role, text) for role, text in zip(roles, texts, strict=True)]
                nodes, parent = [], ""
                for text, _, _ in said:
                    parent = hashlib.blake2b(f"{parent}{text}".encode(), digest_size=16).hexdigest()
                    nodes.append(parent)
                out.append((conv, parent, nodes, *([x[k] for x in said] for k in range(3))))
            if out:
                yield _batch(out, CONVERSATION)

    return grouped.mapInArrow(run, CONVERSATION)


def laid_out(distinct: DataFrame, scratch: Scratch, vocabulary: str, pattern: str) -> DataFrame:
    """Nodes depth first, with token ids and their offset among all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, before = _encoder(vocabulary, pattern).encode_ordinary, TaskContext.get().partitionId(), 0, []
        for batch in batches:
            out = []
            for leaf, nodes, texts, starts, lengths in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                shared = next((k for k, (x, y) in enumerate(zip(nodes, before, strict=False)) if x != y), min(len(nodes), len(before)))
                for k in range(shared, len(nodes)):
                    out.append((nodes[k], nodes[k - 1] if k else "", leaf, texts[k], starts[k], lengths[k], encode(texts[k]), part, seq))
                    seq += 1
                before = nodes
            if out:
                yield _batch(out, NODE)

    key = F.concat_ws("", "nodes")
    sorted_ = distinct.select("leaf", "nodes", "texts", "starts", "lengths", key.alias("key")).repartitionByRange("key").sortWithinPartitions("key").drop("key")
    first = scratch.keep("first", sorted_.mapInArrow(run, NODE))
    rest = [c for c in first.columns if c not in ("node", "part", "seq")]
    once = first.groupBy("node").agg(F.min(F.struct("part", "seq", *rest)).alias("n")).select("node", "n.*")
    once = scratch.keep("once", once.withColumn("length", F.size("ids").cast("long")))
    sums = once.groupBy("part").agg(F.sum("length").alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("length").over(earlier.partitionBy("part").orderBy("seq")), F.lit(0))
    return scratch.keep("laid", once.withColumn("at", within).join(before, "part").withColumn("offset", F.col("at") + F.col("before")).drop("at", "before", "part", "seq"))


def paths(distinct: DataFrame, laid: DataFrame) -> DataFrame:
    """Per distinct conversation its nodes in order: name, owner, start and length."""
    steps = distinct.select("leaf", F.posexplode("nodes").alias("depth", "node"))
    known = steps.join(laid.select("node", "owner", "offset", "length"), "node")
    return known.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "offset", "length", "node", "owner"))).alias("path"))


def attention(found: DataFrame) -> DataFrame:
    """Per node its first position id and the intervals it attends to, its own included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for leaf, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans, position = [], 0
                for step in path:
                    start, end = step["offset"], step["offset"] + step["length"]
                    if spans and spans[-1]["end"] == start:
                        spans[-1] = {"start": spans[-1]["start"], "end": end}
                    else:
                        spans.append({"start": start, "end": end})
                    if step["owner"] == leaf:
                        out.append((step["node"], position, list(spans)))
                    position += step["length"]
            if out:
                yield _batch(out, PLACE)

    return found.mapInArrow(run, PLACE)


def read_back(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct conversations put together again from the tree, parsed, and digested."""
    spans = leaves.select("leaf", F.posexplode("starts").alias("depth", "offset"))
    texts = nodes.select("offset", "text", "loss_start", "loss_length")
    whole = spans.join(texts, "offset").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "text", "loss_start", "loss_length"))).alias("s"))
    whole = whole.select("leaf", "s.text", "s.loss_start", "s.loss_length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for leaf, texts, starts, lengths in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                text, at, learnt = "".join(texts), 0, []
                for t, a, n in zip(texts, starts, lengths, strict=True):
                    learnt.append(unescape(text[at + a : at + a + n]))
                    at += len(t)
                loss, told = "".join(learnt), parse(text)
                said = "".join(f"{role}\n{t}\n" for role, t, _ in told)
                out.append((leaf, len(told), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                yield _batch(out, OUT)

    return whole.mapInArrow(run, OUT)


def format_all(conversations: DataFrame, scratch: Scratch, vocabulary: str, pattern: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conv_id and leaf; per leaf the starts of its nodes; the tree)."""
    own = scratch.keep("named", named(conversations))
    distinct = own.groupBy("leaf").agg(F.first(F.struct("nodes", "texts", "starts", "lengths")).alias("c")).select("leaf", "c.*")
    laid = laid_out(distinct, scratch, vocabulary, pattern)
    found = scratch.keep("paths", paths(own.select("leaf", "nodes").dropDuplicates(["leaf"]), laid))
    tree = scratch.keep("tree", laid.join(attention(found), "node"))
    return own.select("conv_id", "leaf"), found.select("leaf", F.col("path.offset").alias("starts")), tree


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    fixed = spark.createDataFrame([(-1, 0, "user", FIXED), (-1, 1, "assistant", FIXED)], "conv_id long, turn long, role string, text string")
    ids, leaves, tree = format_all(own.unionByName(fixed), Scratch(spark, "chat"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.join(read_back(leaves, tree), "leaf").drop("leaf")


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{FIXED}' UNION ALL SELECT -1, 1, 'assistant', '{FIXED}'),
e AS (SELECT *, replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>'),
    '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = '{LEARNT}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = '{LEARNT}' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    CAST(sum(length(role) + 1 + length(escaped) + CASE WHEN role = '{LEARNT}' THEN 7 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
