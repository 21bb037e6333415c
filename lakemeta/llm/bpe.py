"""BPE encoding and decoding by a table of distinct words.

Texts are split at ASCII white space; tokens never cross it, so a text's ids are its words' ids in
order. Runs of documents become chunks: each distinct word of a chunk gets a number (frequent ones
first) and the documents keep only these numbers. The chunks' words meet, by hash, in slices of
the global table of distinct words, where each word is encoded once; the ids return to the
chunk in the order the words were sent, and positions look them up. Ids become pieces through the
vocabulary's id-to-piece table, whose size the tokenizer file bounds.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lakemeta.llm.common import documents, saved, utf8

WORD_BPE = "word_bpe_49k.json"
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=9), zstandard.ZstdDecompressor()
_SLICE_BYTES, _MOST_SLICES = 1 << 25, 4096


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file of that name lies; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The library's tokenizer, without truncation or padding; one per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    loaded = Tokenizer.from_file(tokenizer_path(name))
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=4)
def pieces(name: str) -> list[str]:
    """The piece of each id: the rows of ``piece_table`` as a list."""
    loaded = tokenizer(name)
    return [loaded.id_to_token(i) or "" for i in range(loaded.get_vocab_size(with_added_tokens=True))]


def piece_table(spark, name: str = WORD_BPE) -> DataFrame:
    """(id, piece) of a tokenizer's vocabulary."""
    return spark.createDataFrame(list(enumerate(pieces(name))), "id INT, piece STRING")


def decode(encoded: DataFrame, name: str = WORD_BPE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of rows of token ids, as the library decodes without a decoder: pieces joined by spaces.

    Ids are exploded with their positions, joined with the piece table and gathered per row again. Null
    and empty lists decode to ''; unknown ids are dropped, as the library does. Rows with equal ids
    and equal lists come out once.
    """
    rows = encoded.select(F.col(id_col).alias("id_"), F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids_")).distinct()
    flat = rows.select("id_", F.xxhash64("ids_").alias("k"), F.posexplode_outer("ids_").alias("at", "token"))
    found = flat.join(piece_table(encoded.sparkSession, name).withColumnRenamed("id", "token"), "token", "left")
    joined = found.groupBy("id_", "k").agg(F.array_sort(F.collect_list(
        F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))).alias("all"))
    return joined.select(F.col("id_").alias(id_col), F.array_join(F.transform("all", lambda x: x["piece"]), " ").alias("decoded"))


class Chunk:
    """A run of documents as word numbers, and its distinct words."""

    def __init__(self, place: int):
        self.place, self.numbers, self.rows, self.docs, self.bytes = place, {}, [], [], 0

    def add(self, row: pa.Scalar, text: bytes) -> None:
        numbers = self.numbers
        words = text.split()
        self.docs.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint32))
        self.rows.append(row)
        self.bytes += len(text)

    def batches(self, kind: pa.DataType, slices: int):
        words = list(self.numbers)
        often = np.bincount(np.concatenate(self.docs), minlength=len(words)) if words else np.zeros(0, np.int64)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        for start in range(0, len(self.docs), 256):
            part = self.docs[start:start + 256]
            numbers = rank[np.concatenate(part)] if words else np.zeros(0, np.uint32)
            yield _rows(self.place, kind, [None], [self.rows[start:start + 256]],
                        [np.array([len(d) for d in part], np.uint32).tobytes()], [packed(numbers)])
        slice_of = np.array([zlib.crc32(w) for w in words], np.uint32) % np.uint32(slices)
        slice_of = slice_of[order].astype(np.uint16)
        ordered = [words[i] for i in order]
        yield _rows(self.place, kind, [-1], [None], [None], [packed(slice_of)])
        members = np.argsort(slice_of, kind="stable")
        ends = np.searchsorted(slice_of[members], np.arange(slices), "right")
        begin = 0
        found, blobs = [], []
        for number, end in enumerate(ends.tolist()):
            if end > begin:
                found.append(number)
                blobs.append(_ZIP.compress(b" ".join([ordered[i] for i in members[begin:end]])))
            begin = end
        if found:
            yield _rows(self.place, kind, found, [None] * len(found), [None] * len(found), blobs)


def _rows(place, kind, slices, rows, sizes, blobs):
    n = len(slices)
    flat = pa.array([r for some in rows for r in some or ()], kind)
    listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(some or ()) for some in rows)]), pa.int32()), flat)
    return pa.RecordBatch.from_arrays(
        [pa.array([place] * n, pa.int64()), pa.array(slices, pa.int32()), listed, pa.array(sizes, pa.binary()),
         pa.array(blobs, pa.binary())], names=["chunk", "slice", "rows", "sizes", "blob"])


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then the next ones and so on, compressed."""
    return _ZIP.compress(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unzipped(blob: bytes) -> bytes:
    return _UNZIP.decompress(blob)


def unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unzipped(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def encoded_words(name: str):
    """Slices of the distinct-word table: encodes each word of a slice once, answers every chunk in its order."""
    def each(batches):
        library = tokenizer(name)
        known, slice_now = {}, None
        for batch in batches:
            counts, ids = [], []
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if number != slice_now:
                    known, slice_now = {}, number
                words = unzipped(blob).split(b" ")
                new = list({w for w in words if w not in known})
                for start in range(0, len(new), 20_000):
                    part = new[start:start + 20_000]
                    found = library.encode_batch([w.decode() for w in part], add_special_tokens=False)
                    known.update(zip(part, (np.array(e.ids, np.uint32).tobytes() for e in found), strict=True))
                answers = [known[w] for w in words]
                counts.append(packed(np.array([len(a) // 4 for a in answers], np.uint32)))
                ids.append(packed(np.frombuffer(b"".join(answers), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("slice"), pa.array(counts, pa.binary()),
                                              pa.array(ids, pa.binary())], names=["chunk", "slice", "counts", "ids"])
    return each


def word_ids(answers: pa.Table) -> list[np.ndarray]:
    """The ids of each word of a chunk, by its number."""
    found = dict(zip(answers.column("slice").to_pylist(), zip(answers.column("counts").to_pylist(), answers.column("ids").to_pylist(), strict=True), strict=True))
    slice_of = unpacked(found.pop(-1)[0]).astype(np.uint16)
    out = [None] * len(slice_of)
    for number, (counts, ids) in found.items():
        flat, ends = unpacked(ids), np.cumsum(unpacked(counts)).tolist()
        begin = 0
        for word, end in zip(np.flatnonzero(slice_of == number).tolist(), ends, strict=True):
            out[word] = flat[begin:end]
            begin = end
    return out


def coded(docs: DataFrame, name: str = WORD_BPE, text_col: str = "text", carry: list[str] | None = None,
          digests: bool = False, chunk_bytes: int = 1 << 25) -> DataFrame:
    """Every row of ``docs`` encoded and decoded again.

    Returns the ``carry`` columns (default: all) in a struct ``row`` with ``n_tokens`` and either ``ids`` and
    ``decoded``, or with ``digests`` their SHA-256 (``ids_sha256``: of the decimal ids joined by one
    space). Null and empty texts have no tokens and decode to ''. Repeated rows are rows like any other,
    and columns of any name ride along. A chunk holds ``chunk_bytes`` of text, or one longer text.
    """
    carry = carry or docs.columns
    source = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = int(min(_MOST_SLICES, max(4, size // _SLICE_BYTES)))

    def chunked(batches):
        task, place = TaskContext.get().partitionId() << 33, 0
        chunk, kind = Chunk(task), None
        for batch in batches:
            row = batch.column("row")
            kind = row.type
            data, offsets = utf8(batch.column("text"))
            for i in range(batch.num_rows):
                chunk.add(row[i], data[offsets[i]:offsets[i + 1]].tobytes())
                if chunk.bytes >= chunk_bytes:
                    yield from chunk.batches(kind, slices)
                    place += 1
                    chunk = Chunk(task + place)
        if chunk.docs:
            yield from chunk.batches(kind, slices)

    shape = StructType([*StructType.fromDDL("chunk BIGINT, slice INT").fields,
                        StructField("rows", ArrayType(source.schema["row"].dataType)),
                        *StructType.fromDDL("sizes BINARY, blob BINARY").fields])
    chunks = saved(source.mapInArrow(chunked, shape), "chunks")
    words = chunks.filter("slice >= 0").select("chunk", "slice", "blob")
    answers = words.repartition("slice").sortWithinPartitions("slice").mapInArrow(
        encoded_words(name), "chunk BIGINT, slice INT, counts BINARY, ids BINARY")
    header = chunks.filter("slice = -1").select("chunk", "slice", F.col("blob").alias("counts"), F.lit(None).cast("binary").alias("ids"))
    texts = chunks.filter("slice IS NULL").select("chunk", "rows", "sizes", "blob")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, table = word_ids(right), pieces(name)
        id_texts = [" ".join(map(str, x.tolist())) for x in ids]
        piece_texts = [" ".join([table[i] for i in x.tolist()]) for x in ids]
        sizes = np.array([len(x) for x in ids], np.int64)
        silent = bool((sizes == 0).any())
        counts, first, second = [], [], []
        for lengths, blob in zip(left.column("sizes").to_pylist(), left.column("blob").to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(lengths, np.uint32))
            for numbers in np.split(unpacked(blob), ends[:-1]):
                if silent:
                    numbers = numbers[sizes[numbers] > 0]
                counts.append(int(sizes[numbers].sum()))
                places = numbers.tolist()
                text = " ".join([piece_texts[i] for i in places])
                if digests:
                    first.append(hashlib.sha256(" ".join([id_texts[i] for i in places]).encode()).hexdigest())
                    second.append(hashlib.sha256(text.encode()).hexdigest())
                else:
                    first.append(np.concatenate([ids[i] for i in places]).astype(np.int32) if places else np.zeros(0, np.int32))
                    second.append(text)
        rows = left.column("rows").combine_chunks()
        return pa.table({"row": (rows if isinstance(rows, pa.Array) else rows.chunk(0)).flatten(), "n_tokens": pa.array(counts, pa.int64()),
                         names[0]: pa.array(first, pa.string() if digests else pa.list_(pa.int32())),
                         names[1]: pa.array(second, pa.string())})

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    out = StructType([StructField("row", source.schema["row"].dataType), *StructType.fromDDL(
        f"n_tokens BIGINT, {names[0]} {'STRING' if digests else 'ARRAY<INT>'}, {names[1]} STRING").fields])
    return texts.groupBy("chunk").cogroup(answers.unionByName(header).groupBy("chunk")).applyInArrow(assemble, out)


def op4_bpe_roundtrip(spark, sf_dir):
    found = coded(documents(spark, sf_dir), carry=["doc_id"], digests=True)
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
