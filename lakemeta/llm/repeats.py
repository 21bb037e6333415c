"""Finding windows that occur twice: minimisers, a count-min prefilter and candidate blocks.

A sequence is any row of 64-bit values: word hashes, or bytes. Of the ``gram``-long pieces inside a
window the one with the smallest hash is its minimiser (the first of equals), so equal windows have
equal minimisers at equal places, and a window can only be repeated if its minimiser occurs at a
second place. Consecutive windows with the same minimiser form a *block*. Counting minimisers
instead of windows divides what has to be counted by about half a window's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemeta.llm.common import FIRST, SECOND, Rolling, binary_column, mix, null_safe, row_groups, saved, shuffles_removed, text_key, utf8

#: Values handled at once; bounds a task's arrays. Places inside a segment fit in 24 bits.
SEGMENT = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)
_ROWS = 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` values, by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(out) - (width - size)], out[width - size:]) if size < width else out


class Blocks:
    """The blocks of one segment: a run of sequences laid end to end, or a piece of a long one.

    ``rows``: sequence of each block; ``start``: its first window, counted in the segment;
    ``size``: its windows; ``minimiser``: the hash they share; ``digest``: of all they cover.
    """

    def __init__(self, values: np.ndarray, limits: np.ndarray, window: int, gram: int):
        windows = len(values) - window + 1
        self.start = self.size = self.rows = np.zeros(0, np.int64)
        self.minimiser = self.digest = np.zeros(0, np.uint64)
        if windows <= 0:
            return
        grams = Rolling(values, FIRST).windows(gram)
        marked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(marked, window - gram + 1) & _PLACE).astype(np.int64)[:windows]
        row = np.searchsorted(limits, np.arange(windows), "right") - 1
        good = np.arange(windows) + window <= limits[row + 1]
        first = good.copy()
        first[1:] &= ~good[:-1] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        last = good.copy()
        last[:-1] &= ~good[1:] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        self.start = np.flatnonzero(first)
        self.size = np.flatnonzero(last) + 1 - self.start
        self.rows = row[self.start]
        at = place[self.start]
        self.minimiser = grams[at]
        self.second = Rolling(values, SECOND)
        span = self.second.slices(self.start, self.start + self.size + window - 1)
        shape = (self.size.astype(np.uint64) << np.uint64(32)) | (at - self.start).astype(np.uint64)
        self.digest = mix(span ^ mix(shape))

    def keep(self, wanted: np.ndarray) -> None:
        for name in ("start", "size", "rows", "minimiser", "digest"):
            setattr(self, name, getattr(self, name)[wanted])


def segments(limits: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, from, to) of each segment; every window start is in exactly one."""
    row, rows = 0, len(limits) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(limits, limits[row] + SEGMENT, "right")) - 1)
        if limits[end] - limits[row] <= SEGMENT:
            yield row, end, int(limits[row]), int(limits[end])
        else:
            for begin in range(int(limits[row]), int(limits[end]) - window + 1, SEGMENT):
                yield row, end, begin, min(begin + SEGMENT + window - 1, int(limits[end]))
        row = end


def cells(minimiser: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each minimiser in each row of the sketch."""
    low = np.uint64((1 << bits) - 1)
    return [((minimiser >> np.uint64(20 * r)) & low).astype(np.int64) + (r << bits) for r in range(_ROWS)]


def sketch_bits(values: int, window: int, most: int) -> int:
    """Cells of a sketch row: four for each expected minimiser, between 2^16 and 2^``most``."""
    return min(most, max(16, int(8 * values / max(1, window)).bit_length()))


def count_min(minimisers: Callable, source: DataFrame, bits: int) -> np.ndarray:
    """One bit per sketch cell: was it hit twice or more?

    Every partition makes its own sketch, sent as its non-zero cells. They are shuffled once, by the chunk of the
    sketch they lie in, and both added up cell by cell and laid out as bits there: no unfinished chunk travels.
    The merged sketch never counts too low, so a repeated minimiser has all its cells set. Only the
    bits reach the driver: 2 * 2^bits / 8 bytes, whatever the input.
    """
    def partial(batches):
        held, waiting = [], 0
        for batch in batches:
            for found in minimisers(batch):
                held += cells(found, bits)
                waiting += len(found)
                if waiting > 1 << 20:
                    yield merged(held)
                    held, waiting = [], 0
        if held:
            yield merged(held)

    def merged(held):
        # A cell hit twice or more is sent twice; more hits tell nothing more.
        cell, hits = np.unique(np.concatenate(held), return_counts=True)
        cell = np.repeat(cell, np.minimum(hits, 2))
        chunk, first = np.unique(cell >> 15, return_index=True)
        offsets = np.append(first, len(cell)) * 2
        return pa.RecordBatch.from_arrays(
            [pa.array(chunk.astype(np.int32)), binary_column((cell & 32767).astype(np.uint16).view(np.uint8), offsets)], names=["chunk", "cells"])

    with shuffles_removed(source.sparkSession):
        twice = laid_out(source.mapInArrow(partial, "chunk INT, cells BINARY")).collect()
    sketch = np.zeros((_ROWS << bits) // 8, np.uint8)
    for chunk, part in twice:
        sketch[chunk * 4096:(chunk + 1) * 4096] = np.frombuffer(part, np.uint8)[:len(sketch)]
    return sketch


def laid_out(cells: DataFrame) -> DataFrame:
    """(chunk, bits): of a chunk's 32768 cells, which were hit twice or more; ``cells`` is (chunk, cells), two bytes a hit."""
    def chunk(table: pa.Table) -> pa.Table:
        hits = np.zeros(32768, np.int64)
        for part in table.column("cells").to_pylist():
            hits += np.bincount(np.frombuffer(part, np.uint16), minlength=32768)
        bits = np.packbits(hits >= 2, bitorder="little").tobytes()
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([bits], pa.binary())})

    return cells.groupBy("chunk").applyInArrow(chunk, "chunk INT, bits BINARY")


def estimated_twice(sketch: np.ndarray, minimiser: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(minimiser), bool)
    for cell in cells(minimiser, bits):
        found &= (sketch[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return found


def blocks_of(batch, sequences: Callable, window: int, gram: int):
    """(row in the batch of each block, first value of each block in its row, blocks, values, bytes)
    of every segment of a batch of (doc_id, key, text)."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
    for low, high in row_groups(offsets, 4 * SEGMENT):
        piece = data[offsets[low]:offsets[high]]
        values, limits, places = sequences(piece, offsets[low:high + 1] - offsets[low])
        for first, last, begin, end in segments(limits, window):
            inner = np.clip(limits[first:last + 1], begin, end) - begin
            found = Blocks(values[begin:end], inner, window, gram)
            if len(found.start):
                rows = found.rows + first
                yield rows + low, found.start + begin - limits[rows], found, piece, begin, places


BLOCK = "m BIGINT, b BIGINT, n INT, at BIGINT"


def repeated_ranges(source: DataFrame, sequences: Callable, payload: Callable, decide: Callable, window: int,
                    gram: int, values: int, most_bits: int) -> DataFrame:
    """(doc_id, key, ranges): where windows lie whose content starts anywhere else too.

    ``source`` is (doc_id, key, text). A range is ``first << 32 | length`` in values. ``decide`` gets
    the distinct candidate blocks (m, b, n, copies, payload) and returns (m, b, t, w): ``w``
    repeated windows from the ``t``-th of each such block; it needs to do so only for blocks that
    occur once, since every window of the others is repeated.
    """
    spark = source.sparkSession
    bits = sketch_bits(values, window, most_bits)

    def minimisers(batch):
        for _, _, found, *_ in blocks_of(batch, sequences, window, gram):
            yield found.minimiser

    sketch = spark.sparkContext.broadcast(count_min(minimisers, source, bits))

    def candidates(with_payload):
        def emit(batches):
            for batch in batches:
                for rows, at, found, piece, begin, places in blocks_of(batch, sequences, window, gram):
                    wanted = estimated_twice(sketch.value, found.minimiser, bits)
                    if not wanted.any():
                        continue
                    found.keep(wanted)
                    rows, at = pa.array(rows[wanted]), at[wanted]
                    out = [pa.array(found.minimiser.view(np.int64)), pa.array(found.digest.view(np.int64)),
                           pa.array(found.size.astype(np.int32)), pa.array(at.astype(np.int64))]
                    names = ["m", "b", "n", "at"]
                    if with_payload:
                        out.append(pa.array(payload(found, piece, begin, places), pa.binary()))
                        names.append("payload")
                    else:
                        out += [batch.column("doc_id").take(rows), batch.column("key").take(rows)]
                        names += ["doc_id", "key"]
                    yield pa.RecordBatch.from_arrays(out, names=names)
        extra = "payload BINARY" if with_payload else f"doc_id {source.schema['doc_id'].dataType.simpleString()}, key BIGINT"
        return source.mapInArrow(emit, f"{BLOCK}, {extra}")

    distinct = saved(candidates(True).groupBy("m", "b").agg(
        F.count("*").alias("copies"), F.first("n").alias("n"), F.first("payload").alias("payload")), "blocks")
    whole = distinct.filter("copies >= 2").select("m", "b", F.lit(0).alias("t"), F.col("n").alias("w"))
    verdict = whole.unionByName(decide(distinct))
    reach = F.shiftleft(F.col("at") + F.col("t"), 32) + F.col("w") + F.lit(window - 1)
    return (candidates(False).drop("n").join(verdict, ["m", "b"])
            .groupBy("doc_id", "key").agg(F.collect_set(reach).alias("ranges")))


#: Words of 64 bits in a filter of keys; it is broadcast, with 16 bytes a word.
_FILTER = 1 << 19


def possible(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``has``: false only where ``key`` (a hash) is surely not among ``keys``.

    A bitmap of at most ``_FILTER`` words is made of the keys, whatever their number; where it fills up, more
    rows are let through. It spares rows that have no partner the way to a join that is made afterwards.
    """
    word = F.shiftright(key, 6).bitwiseAND(_FILTER - 1)
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    held = saved(keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), "filter")
    # At most _FILTER rows, whatever the input.
    return df.withColumn("word", word).join(F.broadcast(held), "word", "left").withColumn(
        "has", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "bits")


def recurring(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of windows with two places or more. Written out, so that a hot key's rows can still be
    split in the join that follows."""
    return saved(windows.groupBy(*keys).agg(F.sum("copies").alias("places")).filter("places >= 2").drop("places"),
                 "recurring")


def contested(distinct: DataFrame) -> DataFrame:
    """Blocks whose minimiser has other blocks too, with their number (``texts``).

    Only there can two different blocks share a window; a minimiser with one block is settled by its copies.
    """
    shared = saved(distinct.groupBy("m").agg(F.count("*").alias("texts")).filter("texts >= 2"), "shared")
    return possible(distinct, "m", shared).filter("has").drop("has").join(shared, "m")


def unpacked(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (begin, end) covered by packed ranges."""
    ranges = np.sort(ranges)
    begin = ranges >> 32
    end = np.maximum.accumulate(begin + (ranges & 0xFFFFFFFF))
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    return begin[new], end[np.append(new[1:], True)]


def with_ranges(docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, ranges): every row of ``docs`` whole, as a struct, beside its repeated ranges. Texts that have none pass by the join."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"),
                       text_key(F.col(id_col), F.col(text_col)).alias("key"))
    ranges = saved(ranges, "ranges")
    marked = possible(rows, "key", ranges)
    met = null_safe(marked.filter("has"), ranges, ["doc_id", "key"], "left").select("row", "ranges")
    return met.unionByName(marked.filter(~F.col("has")).select("row", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges")))


def text_and_ranges(batch, text_col: str):
    """Each row's bytes and its runs to remove, as (bytes, begin, end)."""
    data, offsets = utf8(batch.column("row").field(text_col))
    column = batch.column(batch.schema.get_field_index("ranges"))
    packed = column.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    stops = np.cumsum(sizes)
    for i in range(batch.num_rows):
        begin, end = unpacked(packed[stops[i] - sizes[i]:stops[i]]) if sizes[i] else ((), ())
        yield data[offsets[i]:offsets[i + 1]].tobytes(), begin, end
