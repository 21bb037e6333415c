"""Chat formatting as a prefix tree: turns that conversations share from the start are written once.

Every turn becomes ``### role:`` newline text ``</turn>`` newline, with control characters of role and text
escaped, so the markers occur nowhere else and formatting can be undone. A tree node is a turn
after a given history. Sorting distinct conversations by their histories' digests puts those with a
common beginning next to each other; a node belongs to the first conversation that has it, so reading
conversation by conversation, new turns only, is the tree depth first. Each node has its place in that
stream of tokens, the position its first token has in its conversations, and the stream intervals
it may attend to: its ancestors and itself. What a conversation's last turn may attend to is the
conversation, so it is read back from the stream by those intervals.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemeta.llm.bpe import tokenizer
from lakemeta.llm.common import numbered, running_total, saved
from lakemeta.llm.token_counts import BYTE_BPE

END = "</turn>\n"
_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
_ROLE_ESCAPES = _ESCAPES | {":": "\\c", "\n": "\\n"}
#: Tokens of the stream that are looked up together, and places that a much requested key is dealt over.
_BLOCK, _PLACES = 256, 64
_PLAIN = {v[1]: k for k, v in _ROLE_ESCAPES.items()}


def escaped(text: str, table: dict[str, str] = _ESCAPES) -> str:
    return "".join(table.get(c, c) for c in text) if any(c in text for c in table) else text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def opening(role: str) -> str:
    return f"### {escaped(role, _ROLE_ESCAPES)}:\n"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, text = turn.removeprefix("### ").split(":\n", 1)
        out.append((unescaped(role), unescaped(text)))
    return out



def histories(conversations: DataFrame) -> DataFrame:
    """(conv_id, leaf, order, turns): each conversation's turns in order, each with the digest of its history."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def each(batches):
        for batch in batches:
            leaf, order, turns = [], [], []
            for conversation in batch.column("turns").to_pylist():
                digest, path = b"", []
                for t in conversation:
                    head = len(t["role"].encode()).to_bytes(8, "little")
                    node = hashlib.blake2b(digest + head + t["role"].encode() + t["text"].encode(), digest_size=16).digest()
                    path.append({"node": node, "parent": digest, "role": t["role"], "text": t["text"]})
                    digest = node
                leaf.append(digest)
                order.append(b"".join(t["node"][:8] for t in path))
                turns.append(path)
            kind = pa.list_(pa.struct([("node", pa.binary()), ("parent", pa.binary()), ("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(leaf, pa.binary()), pa.array(order, pa.binary()),
                                              pa.array(turns, kind)], names=["conv_id", "leaf", "order", "turns"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    struct = "STRUCT<node: BINARY, parent: BINARY, role: STRING, text: STRING>"
    return rows.mapInArrow(each, f"conv_id {kind}, leaf BINARY, order BINARY, turns ARRAY<{struct}>")


def with_tokens(nodes: DataFrame, name: str) -> DataFrame:
    """Encodes each node once: opening, text and end apart, so that the loss covers exactly the text's tokens."""
    def each(batches):
        library = tokenizer(name)
        end = library.encode(END, add_special_tokens=False).ids
        for batch in batches:
            roles = batch.column("role").to_pylist()
            heads = [e.ids for e in library.encode_batch([opening(r) for r in roles], add_special_tokens=False)]
            texts = batch.column("text").to_pylist()
            bodies = [e.ids for e in library.encode_batch([escaped(t) for t in texts], add_special_tokens=False)]
            ids = [a + b + end for a, b in zip(heads, bodies, strict=True)]
            begin = [len(a) for a in heads]
            stop = [len(a) + len(b) if r == "assistant" else len(a) for a, b, r in zip(heads, bodies, roles, strict=True)]
            keep = ["node", "parent", "rank", "depth"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(begin, pa.int32()), pa.array(stop, pa.int32())],
                names=[*keep, "ids", "tokens", "loss_begin", "loss_end"])
    return nodes.mapInArrow(each, "node BINARY, parent BINARY, rank BIGINT, depth INT, ids ARRAY<INT>, tokens BIGINT, "
                                  "loss_begin INT, loss_end INT")


def lookup(asked: DataFrame, rows: DataFrame, key: str, by: str) -> DataFrame:
    """``asked`` joined with ``rows`` on ``key``. Requests are dealt over places by ``by``, and a row is copied
    to the places that ask for it only, so a turn that very many conversations share is no hot key and no
    row is copied more often than it is asked for."""
    asked = asked.withColumn("place", F.pmod(F.xxhash64(by), F.lit(_PLACES)))
    return asked.join(rows.join(asked.select(key, "place").distinct(), key), [key, "place"]).drop("place")


@dataclass
class ChatTree:
    """``nodes``: the token stream, one row per node (start, ids, loss range inside them, parent, depth, rank,
    position, visible); ``members``: (conv_id, leaf), each conversation's last node."""

    nodes: DataFrame
    members: DataFrame
    tokenizer: str


def chat_tree(conversations: DataFrame, name: str = BYTE_BPE) -> ChatTree:
    """The prefix tree of ``conversations`` (conv_id, turn, role, text; other columns are not read).

    Turns are ordered by number, then role, then text; null roles and texts are empty, repeated rows are turns
    of their own, rows without conv_id are one conversation. A loss covers the texts of role
    ``assistant``. Equal conversations share all nodes. No rows give an empty tree.
    """
    members = saved(histories(conversations), "histories")
    leaves = members.groupBy("leaf").agg(F.first("order").alias("order"), F.first("turns").alias("turns"))
    ranked = saved(numbered(leaves, [F.col("order")], "leaves").withColumnRenamed("place", "rank").drop("order"), "ranked")
    each = ranked.select("rank", F.posexplode("turns").alias("depth", "t")).select("rank", "depth", "t.*")
    nodes = each.groupBy("node").agg(F.min("rank").alias("rank"), *[F.first(c).alias(c) for c in ("depth", "parent", "role", "text")])
    encoded = saved(with_tokens(nodes, name), "encoded")
    places = running_total(encoded.select("node", "rank", "depth", "tokens"), ["rank", "depth"], "tokens", "stream")
    places = saved(places.withColumnRenamed("before", "start"), "places")
    seen = attention(ranked.select("leaf", "rank", F.posexplode("turns.node").alias("depth", "node")), places)
    where = places.select("node", "start").join(seen, "node")
    return ChatTree(saved(encoded.join(where, "node"), "nodes"), members.select("conv_id", "leaf"), name)


def attention(steps: DataFrame, places: DataFrame) -> DataFrame:
    """(node, position, visible): each node once, from the conversation that wrote it. ``position`` is its
    first token's position id; ``visible`` the stream intervals of its ancestors and itself, neighbours merged.

    ``steps`` are the (leaf, rank, depth, node) of every distinct conversation, ``places`` the (node, rank, start,
    tokens) of the stream; a node is written by the conversation of its own rank. No steps give no rows.
    """
    def each(batches):
        for batch in batches:
            nodes, positions, visible = [], [], []
            for rank, path in zip(batch.column("rank").to_pylist(), batch.column("path").to_pylist(), strict=True):
                position, seen = 0, []
                for step in path:
                    begin, end = step["start"], step["start"] + step["tokens"]
                    if seen and seen[-1][1] == begin:
                        seen[-1] = (seen[-1][0], end)
                    else:
                        seen.append((begin, end))
                    if step["first_rank"] == rank:
                        nodes.append(step["node"])
                        positions.append(position)
                        visible.append([{"begin": a, "end": b} for a, b in seen])
                    position += step["tokens"]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(positions, pa.int64()), pa.array(visible, kind)],
                                             names=["node", "position", "visible"])
    found = lookup(steps, places.select("node", F.col("rank").alias("first_rank"), "start", "tokens"), "node", "leaf")
    paths = found.groupBy("leaf", "rank").agg(F.array_sort(F.collect_list(F.struct(
        "depth", "node", "first_rank", "start", "tokens"))).alias("path"))
    return paths.select("rank", "path").mapInArrow(
        each, "node BINARY, position BIGINT, visible ARRAY<STRUCT<begin: BIGINT, end: BIGINT>>")


def read_back(tree: ChatTree) -> DataFrame:
    """(conv_id, formatted, turns, loss): every conversation again, from the tokens its last turn may attend to:
    the formatted text, its turns with escapes undone, and the texts under the loss mask joined together.

    Intervals meet the stream block by block; a node belongs to the block of its first token.
    """
    name = tree.tokenizer

    def each(batches):
        library = tokenizer(name)
        decode = lambda ids: library.decode(ids, skip_special_tokens=False) if ids else ""
        for batch in batches:
            formatted, turns, losses = [], [], []
            for path in batch.column("path").to_pylist():
                text = decode(np.concatenate([s["ids"] for s in path]).tolist() if path else [])
                formatted.append(text)
                turns.append([{"role": r, "text": t} for r, t in turns_of(text)])
                masked = (decode(s["ids"][s["loss_begin"]:s["loss_end"]]) for s in path)
                losses.append("".join(unescaped(m) for m in masked))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), pa.array(formatted, pa.string()), pa.array(turns, kind),
                                              pa.array(losses, pa.string())], names=["leaf", "formatted", "turns", "loss"])
    block = lambda c: F.expr(f"{c} div {_BLOCK}")
    leaves = tree.nodes.join(tree.members.select(F.col("leaf").alias("node")).distinct(), "node")
    spans = leaves.select(F.col("node").alias("leaf"), F.inline("visible"))
    asked = spans.withColumn("block", F.explode(F.sequence(block("begin"), block("(end - 1)"))))
    stream = tree.nodes.select(block("start").alias("block"), "start", "ids", "loss_begin", "loss_end")
    found = lookup(asked, stream, "block", "leaf").filter("start >= begin AND start < end")
    paths = found.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("start", "ids", "loss_begin", "loss_end"))).alias("path"))
    texts = saved(paths.mapInArrow(each, "leaf BINARY, formatted STRING, turns ARRAY<STRUCT<role: STRING, text: STRING>>, "
                                         "loss STRING"), "read-back")
    return tree.members.join(texts, "leaf").drop("leaf")


def with_check_conversation(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The contract's conversation -7, whose texts contain the usual control strings."""
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def op9_chat_tree(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = read_back(chat_tree(with_check_conversation(spark, conversations)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), sha(turns).alias("turns_sha256"),
                        F.length("loss").cast("bigint").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"),
                        F.length("formatted").cast("bigint").alias("formatted_chars"))


OP9_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
    SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS text_chars,
           length(role) + length(regexp_replace(role, '[^\\#<:\n]', '', 'g')) AS role_chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + role_chars + 2 + text_chars + 8)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
