"""Substring dedup over words: a count-min prefilter, then exact grouping of what it lets through.

1. Every partition sketches its windows (through their minimisers); the merged sketch can only count too high.
2. A second pass keeps the windows estimated to be repeated, as blocks. Equal blocks are counted;
   where a minimiser has several different blocks, their windows are grouped one by one.

Windows are told apart by two 64-bit digests (their minimiser's and their own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemeta.llm.common import documents, ids_and_texts, row_and, word_hashes, word_spans
from lakemeta.llm.repeats import contested, recurring, repeated_ranges, text_and_ranges, with_ranges

_PIECE = 1 << 20


def word_sequences(data: np.ndarray, offsets: np.ndarray):
    """Word hashes of the rows laid end to end, and each row's first word; a megabyte of text at a time."""
    starts, hashes, at = [], [], 0
    space = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13))) if len(data) > _PIECE else None
    while at < len(data):
        stop = len(data)
        if stop - at > _PIECE:
            next_space = np.searchsorted(space, at + _PIECE)
            stop = int(space[next_space]) if next_space < len(space) else stop
        part = data[at:stop]
        first, last = word_spans(part, offsets[(offsets >= at) & (offsets <= stop)] - at)
        hashes.append(word_hashes(part, first, last))
        starts.append(first + at)
        at = stop
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets), None


def window_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35,
                 gram: int = 8, most_bits: int = 28) -> DataFrame:
    """Removes every word covered by a ``window``-word sequence that also starts anywhere else.

    Returns every row of ``docs`` as a struct ``row`` with ``n_words``, ``n_removed`` and ``kept``
    (the words left, joined by one space). Null and empty texts have no words; texts shorter than a
    window lose nothing; a repeated row is a second place of all its windows, so all of it goes.
    Columns of any name ride along in ``row``. ``most_bits`` bounds the sketch: its bits take
    2^(most_bits - 2) bytes. Beyond it the prefilter lets more through; the result stays the same.
    """
    source = ids_and_texts(docs, id_col, text_col)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def windows(found, piece, begin, places):
        hashes = found.second.windows(window)
        return [hashes[a:a + n].tobytes() for a, n in zip(found.start.tolist(), found.size.tolist(), strict=True)]

    ranges = repeated_ranges(source, word_sequences, windows, _shared_windows, window, gram, size // 6, most_bits)

    def cut(batches):
        for batch in batches:
            kept, counts, removed = [], [], []
            for text, begin, end in text_and_ranges(batch, text_col):
                words = text.split()
                counts.append(len(words))
                removed.append(int(sum(end) - sum(begin)))
                if removed[-1]:
                    keep = np.ones(len(words), bool)
                    for a, b in zip(begin, end, strict=True):
                        keep[a:b] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept"])

    placed = with_ranges(docs, ranges, id_col, text_col)
    return placed.mapInArrow(cut, row_and(placed, "n_words BIGINT, n_removed BIGINT, kept STRING"))


def _shared_windows(distinct: DataFrame) -> DataFrame:
    def each(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("n"))
            hashes = np.frombuffer(b"".join(batch.column("payload").to_pylist()), np.int64)
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            t = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            names = ["m", "b", "copies"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(rows)) for c in names] + [pa.array(t.astype(np.int32)), pa.array(hashes)],
                names=[*names, "t", "window"])

    windows = contested(distinct).select("m", "b", "copies", "n", "payload").mapInArrow(
        each, "m BIGINT, b BIGINT, copies BIGINT, t INT, window BIGINT")
    return (windows.filter("copies = 1").join(recurring(windows, ["m", "window"]), ["m", "window"], "left_semi")
            .select("m", "b", "t", F.lit(1).alias("w")))


def op1_window_dedup(spark, sf_dir):
    out = window_dedup(documents(spark, sf_dir))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
