"""Token counts with huge documents spread over tasks: overlapping chunks, resynchronised.

A document longer than a chunk is cut into overlapping chunks that are encoded apart. In an overlap, a
place where a pre-token ends in both encodings is where the encodings agree from then on: splitting only
looks ahead, and merges never leave a pre-token. Such a place, some way before the left chunk's end, is a
proven boundary; tokens left of it count in one chunk, the rest in the other. Where an overlap has none
(one very long word), that document is encoded again with overlaps four times as wide, until each has one.

Within a chunk, text is cut at lone spaces, which always begin a pre-token, and what lies between
is encoded once per worker while it is remembered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemeta.llm.bpe import tokenizer
from lakemeta.llm.common import documents, null_safe, saved, text_key

BYTE_BPE = "byte_bpe_50k.json"
#: Characters left of a chunk's end where a special token cut in two could mislead.
_MARGIN = 64
_REMEMBERED = 300_000
_memory: dict[str, dict[str, int]] = {}


def lone_space_pieces(text: str) -> list[str]:
    """Pieces whose tokenisations, in order, make up the text's: cut before single spaces between non-spaces."""
    parts = text.split(" ")
    pieces = [parts[0]]
    open_ = not parts[0] or parts[0][-1].isspace()
    for part in parts[1:]:
        if open_ or not part or part[0].isspace():
            pieces[-1] += " " + part
        else:
            pieces.append(" " + part)
        open_ = not part or part[-1].isspace()
    return pieces


def token_counts_of(texts: list[str], name: str) -> list[int]:
    """The number of tokens of each text."""
    known = _memory.setdefault(name, {})
    if len(known) > _REMEMBERED:
        known.clear()
    cut = [lone_space_pieces(t) for t in texts]
    new = list({p for pieces in cut for p in pieces if p not in known})
    for start in range(0, len(new), 20_000):
        part = new[start:start + 20_000]
        known.update(zip(part, map(len, tokenizer(name).encode_batch(part, add_special_tokens=False)), strict=True))
    return [sum(map(known.__getitem__, pieces)) for pieces in cut]


def boundaries(text: str, name: str, begin: int) -> tuple[list[int], list[int]]:
    """Where pre-tokens end in ``text``, from ``begin`` on, and how many tokens come before each such place."""
    encoding = tokenizer(name).encode(text, add_special_tokens=False)
    words, offsets = encoding.word_ids, encoding.offsets
    places, before = [], []
    for k in range(1, len(words)):
        if words[k] != words[k - 1] or words[k] is None:
            places.append(offsets[k][0] + begin)
            before.append(k)
    return places, before


def chunk_rows(batch, name: str, overlap: int):
    """Per chunk: its tokens, and the possible boundaries in its left and right overlap."""
    texts, starts = batch.column("text").to_pylist(), batch.column("start").to_pylist()
    lasts = batch.column("last").to_pylist()
    counts = token_counts_of(texts, name)
    left, left_before, right, right_before = [], [], [], []
    for text, start, last, count in zip(texts, starts, lasts, counts, strict=True):
        places, before = boundaries(text[:overlap], name, start) if start else ([], [])
        left.append(places)
        left_before.append(before)
        places, before = ([], [])
        if not last:
            # The overlap's own encoding may start inside a pre-token: keep what the whole chunk confirms.
            head = len(text) - overlap
            inner = _anchor(text, head)
            places, before = boundaries(text[inner:], name, start + inner)
            total = len(tokenizer(name).encode(text[inner:], add_special_tokens=False).ids)
            before = [count - total + b for b in before]
            keep = [(p, b) for p, b in zip(places, before, strict=True) if start + head <= p <= start + len(text) - _MARGIN]
            places, before = [p for p, _ in keep], [b for _, b in keep]
        right.append(places)
        right_before.append(before)
    integers = pa.list_(pa.int64())
    return [pa.array(counts, pa.int64()), *(pa.array(x, integers) for x in (left, left_before, right, right_before))]


def _anchor(text: str, at: int) -> int:
    """The last lone space before ``at``, where a pre-token certainly begins, or the text's start."""
    found = at
    while (found := text.rfind(" ", 0, found)) > 0:
        if not text[found - 1].isspace() and not text[found + 1].isspace():
            return found
    return 0


def _chunk_totals(huge: DataFrame, name: str, size: int, overlap: int) -> DataFrame:
    """(doc_id, key, n_tokens), null tokens where a seam has no proven boundary; repeated rows come out once."""
    step = size - overlap
    number = F.ceil((F.col("n_chars") - overlap) / F.lit(step)).cast("int")
    chunks = (huge.withColumn("chunks", F.greatest(number, F.lit(1)))
              .select("doc_id", "key", "text", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("number"))
              .select("doc_id", "key", "number", (F.col("number").cast("bigint") * step).alias("start"),
                      (F.col("number") == F.col("chunks") - 1).alias("last"),
                      F.substring("text", F.col("number") * step + 1, F.lit(size)).alias("text"))
              .repartition("key", "number"))

    def encode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keys = [part.column(c) for c in ("doc_id", "key", "number")]
                yield pa.RecordBatch.from_arrays([*keys, *chunk_rows(part, name, overlap)], names=[
                    "doc_id", "key", "number", "tokens", "left", "left_before", "right", "right_before"])

    kind = huge.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{c} ARRAY<BIGINT>" for c in ("left", "left_before", "right", "right_before"))
    parts = chunks.mapInArrow(encode, f"doc_id {kind}, key BIGINT, number INT, tokens BIGINT, {lists}")
    one = saved(parts.groupBy("doc_id", "key", "number").agg(*[F.first(c).alias(c) for c in (
        "tokens", "left", "left_before", "right", "right_before")]), "chunk-counts")
    following = one.select("doc_id", "key", (F.col("number") - 1).alias("number"), "left", "left_before")
    seams = null_safe(one.select("doc_id", "key", "number", "tokens", "right", "right_before"), following,
                      ["doc_id", "key", "number"], "inner")
    place = F.array_min(F.array_intersect("right", "left"))
    at = lambda values, places: F.element_at(values, F.array_position(places, F.col("place")).cast("int"))
    surplus = seams.withColumn("place", place).select("doc_id", "key", F.lit(None).cast("bigint").alias("tokens"), F.when(
        F.col("place").isNotNull(),
        F.col("tokens") - at("right_before", "right") + at("left_before", "left")).alias("surplus"), F.col("place").isNull().alias("lost"))
    rows = surplus.unionByName(one.select("doc_id", "key", "tokens", F.lit(None).cast("bigint").alias("surplus"), F.lit(False).alias("lost")))
    return saved(rows.groupBy("doc_id", "key").agg(F.when(~F.bool_or("lost"), F.sum("tokens") - F.coalesce(
        F.sum("surplus"), F.lit(0))).alias("n_tokens")), "huge-counts")


def token_counts(docs: DataFrame, name: str = BYTE_BPE, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = 1 << 16, overlap: int = 1 << 11) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): one row per row of ``docs``, in tokens as the library counts them.

    Null and empty texts have none. Texts of more than ``chunk`` characters are encoded in chunks by many
    tasks. Repeated rows are counted each; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(id_col), F.col(text_col)).alias("key"),
                         F.coalesce(text_col, F.lit("")).alias("text")).withColumn("n_chars", F.length("text"))
    huge = source.filter(F.col("n_chars") > chunk)
    size, width = chunk, overlap
    found = _chunk_totals(huge, name, size, width)
    rounds = [found.filter("n_tokens IS NOT NULL")]
    while (lost := found.filter("n_tokens IS NULL").select("doc_id", "key")).limit(1).count():
        width, size = width * 4, max(size, width * 16)
        found = _chunk_totals(null_safe(huge, lost, ["doc_id", "key"], "left_semi"), name, size, width)
        rounds.append(found.filter("n_tokens IS NOT NULL"))
    known = rounds[0]
    for more in rounds[1:]:
        known = known.unionByName(more)

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                counts = token_counts_of([t or "" for t in texts], name)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), part.column("n_bytes"),
                     pa.array([None if t is None else n for t, n in zip(texts, counts, strict=True)], pa.int64())],
                    names=["doc_id", "key", "n_bytes", "short_tokens"])

    kind = source.schema["doc_id"].dataType.simpleString()
    rows = source.select("doc_id", "key", F.octet_length("text").cast("bigint").alias("n_bytes"),
                         F.when(F.col("n_chars") <= chunk, F.col("text")).alias("text")).mapInArrow(
        count, f"doc_id {kind}, key BIGINT, n_bytes BIGINT, short_tokens BIGINT")
    return null_safe(rows, known, ["doc_id", "key"], "left").select(
        "doc_id", "n_bytes", F.coalesce("short_tokens", "n_tokens").alias("n_tokens"))


def op7_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 512)
