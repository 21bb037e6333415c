"""Substring dedup over bytes: blockwise suffix sorting with a difference cover.

Only suffixes whose first ``length`` bytes may recur are sorted (``repeats`` finds them). Those that
share a minimiser form a bucket; a task sorts one bucket after another. Within a bucket, suffixes are
sorted by their first ``v`` bytes; ties longer than that are resolved by ranks of a sample: the
positions whose residue modulo ``v`` lies in a difference cover, ranked once per run of buckets. For
any two suffixes some shift below ``v`` leads both to sampled positions, so one rank lookup and at most
``v`` more bytes decide a tie, however long it is. Memory is one run of buckets; a bucket of very many
texts is sorted in parts, and the parts' classes of equal suffixes are added up by digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemeta.llm.common import SECOND, Rolling, documents, ids_and_texts, mix, row_and
from lakemeta.llm.repeats import contested, recurring, repeated_ranges, saved, text_and_ranges, with_ranges

_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_RUN, _PART = 1 << 20, 4096


def byte_sequences(data: np.ndarray, offsets: np.ndarray):
    return _BYTE_VALUES[data], offsets, None


def difference_cover(length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Its period v (a square of at most half of ``length``), which residues it holds, and for each pair
    of residues the smallest shift that leads both into it.

    {0 .. r-1} and the multiples of r: any difference d is r * ceil(d / r) less something below r.
    """
    r = next(r for r in (8, 4, 2, 1) if 2 * r * r <= length)
    v = r * r
    held = np.zeros(v, bool)
    held[:r] = held[::r] = True
    at = (np.arange(v)[:, None] + np.arange(v)) % v
    both = held[at][:, None, :] & held[at][None, :, :]
    return v, held, both.argmax(2)


def refined(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Splits classes by ``key`` and returns those of ``rows`` that still have company.

    A class is named by the place of its first member in sorted order, so names stay ordered.
    """
    order = np.lexsort((key, rank[rows]))
    old, key, rows = rank[rows][order], key[order], rows[order]
    place = np.arange(len(rows))
    group = np.ones(len(rows), bool)
    group[1:] = old[1:] != old[:-1]
    new = group.copy()
    new[1:] |= key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(new, place, 0))
    rank[rows] = old + start - np.maximum.accumulate(np.where(group, place, 0))
    alone = new & np.append(new[1:], True)
    return rows[~alone]


class SuffixClasses:
    """Classes of equal ``length``-byte prefixes among the suffixes at ``position`` (buckets kept apart)."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, position: np.ndarray, bucket: np.ndarray, length: int):
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.eight = np.zeros(len(text), np.uint64)
        for j in range(8):
            self.eight |= padded[j:j + len(text)] << np.uint64(56 - 8 * j)
        v, held, self.shift = difference_cover(length)
        self.v, depth = v, length - v
        sampled = np.flatnonzero(held[np.arange(len(text)) % v])
        sampled = sampled[sampled + depth <= ends[np.searchsorted(ends, sampled, "right")]]
        order = np.zeros(len(sampled), np.int64)
        self.sort(order, np.arange(len(sampled)), sampled, 0, depth)
        self.cover = np.full(len(text), -1, np.int64)
        self.cover[sampled] = order
        self.rank = np.zeros(len(position), np.int64)
        ties = refined(self.rank, np.arange(len(position)), bucket)
        ties = self.sort(self.rank, ties, position, 0, v)
        self.settle(ties, position, depth)

    def bytes_at(self, position: np.ndarray, size: int) -> np.ndarray:
        return self.eight[position] >> np.uint64(64 - 8 * size)

    def sort(self, rank: np.ndarray, rows: np.ndarray, position: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Refines by the bytes from ``begin`` to ``end``, eight at a time, while there are ties."""
        for at in range(begin, end, 8):
            if not len(rows):
                break
            rows = refined(rank, rows, self.bytes_at(position[rows] + at, min(8, end - at)))
        return rows

    def settle(self, rows: np.ndarray, position: np.ndarray, depth: int) -> None:
        """Resolves ties of more than ``v`` bytes: each class is split around one of its members, again and again."""
        while len(rows):
            order = np.argsort(self.rank[rows], kind="stable")
            rows = rows[order]
            names, first, sizes = np.unique(self.rank[rows], return_index=True, return_counts=True)
            pivot = np.repeat(position[rows[first + sizes // 2]], sizes)
            mine = position[rows]
            shift = self.shift[mine % self.v, pivot % self.v]
            side = np.sign(self.cover[mine + shift] - self.cover[pivot + shift])
            for at in range(0, self.v, 8):
                even = np.flatnonzero(side == 0)
                size = min(8, self.v - at)
                a, b = (self.bytes_at(p[even] + depth + at, size) for p in (mine, pivot))
                side[even] = (a > b).astype(np.int64) - (a < b)
            ties = refined(self.rank, rows, side)
            at_pivot = np.zeros(len(position), bool)
            at_pivot[rows[side == 0]] = True
            rows = ties[~at_pivot[ties]]


def whole_buckets(batches, limit: int = _RUN):
    """Tables of whole (m, part) buckets of about ``limit`` payload bytes; rows come sorted by bucket."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        m, part = (np.asarray(held.column(c)) for c in ("m", "part"))
        cuts = np.flatnonzero((m[1:] != m[:-1]) | (part[1:] != part[:-1])) + 1
        sizes = np.cumsum(np.asarray(pa.compute.binary_length(held.column("payload"))))
        done = 0
        for cut in cuts:
            if sizes[cut - 1] - (sizes[done - 1] if done else 0) >= limit:
                yield held.slice(done, cut - done)
                done = cut
        held = held.slice(done)
    if held is not None and held.num_rows:
        yield held


FOUND = "kind INT, m BIGINT, b BIGINT, t INT, w INT, digest BIGINT, copies BIGINT"
RUN, CLASS, OPEN = 0, 1, 2


def sorted_buckets(length: int):
    """Per run of buckets: RUN rows, the windows seen to be repeated, of blocks that occur once. For buckets
    in parts, also CLASS rows (a repeated window's digest) and OPEN rows (a window still alone in its part)."""
    def each(batches):
        for table in whole_buckets(batches):
            m, b, part, parts, copies, n = (np.asarray(table.column(c)) for c in ("m", "b", "part", "parts", "copies", "n"))
            payload = table.column("payload").to_pylist()
            text = np.frombuffer(b"".join(payload), np.uint8)
            ends = np.cumsum([len(x) for x in payload])
            start = ends - np.array([len(x) for x in payload])
            row = np.repeat(np.arange(len(n)), n)
            t = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            position = start[row] + t
            bucket = np.zeros(len(n), np.int64)
            bucket[1:] = np.cumsum((m[1:] != m[:-1]) | (part[1:] != part[:-1]))
            found = SuffixClasses(text, ends, position, bucket[row], length)
            places = np.bincount(found.rank, weights=copies[row], minlength=len(row)).astype(np.int64)
            split = parts[row] > 1
            hit = (places[found.rank] >= 2) & (copies[row] == 1)
            new = hit.copy()
            new[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
            old = hit.copy()
            old[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
            first, last = np.flatnonzero(new), np.flatnonzero(old)
            none = np.zeros(len(first), np.int64)
            yield _found(RUN, m[row[first]], b[row[first]], t[first], last - first + 1, none, none)
            if split.any():
                digest = Rolling(_BYTE_VALUES[text], SECOND).slices(position, position + length).view(np.int64)
                lead = np.flatnonzero(split & (places[found.rank] >= 2))
                lead = lead[np.unique(found.rank[lead], return_index=True)[1]]
                none = np.zeros(len(lead), np.int64)
                yield _found(CLASS, m[row[lead]], none, none, none, digest[lead], places[found.rank[lead]])
                lone = np.flatnonzero(split & (places[found.rank] == 1))
                none = np.ones(len(lone), np.int64)
                yield _found(OPEN, m[row[lone]], b[row[lone]], t[lone], none, digest[lone], none)
    return each


def _found(kind, m, b, t, w, digest, copies):
    kinds = [np.full(len(m), kind, np.int32), m, b, t.astype(np.int32), w.astype(np.int32), digest, copies]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in kinds],
                                      names=["kind", "m", "b", "t", "w", "digest", "copies"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                 gram: int = 32, most_bits: int = 28) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts anywhere else.

    Returns every row of ``docs`` as a struct ``row`` with ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``kept``, the bytes left (binary: a cut can fall inside a character). Null and empty texts have no
    bytes, shorter texts lose nothing, a repeated row is a second place of all its strings. Columns of
    any name ride along in ``row``. ``most_bits`` bounds the prefilter's sketch, not the result.
    """
    source = ids_and_texts(docs, id_col, text_col)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def covered(found, piece, begin, places):
        raw, first = piece.tobytes(), found.start + begin
        return [raw[a:e] for a, e in zip(first.tolist(), (first + found.size + length - 1).tolist(), strict=True)]

    def decide(distinct):
        buckets = (contested(distinct)
                   .withColumn("parts", F.ceil(F.col("texts") / _PART).cast("int"))
                   .withColumn("part", F.pmod("b", "parts").cast("int"))
                   .select("m", "part", "parts", "b", "copies", "n", "payload")
                   .repartition("m", "part").sortWithinPartitions("m", "part"))
        found = saved(buckets.mapInArrow(sorted_buckets(length), FOUND), "suffixes")
        repeated = recurring(found.filter(F.col("kind") != RUN), ["m", "digest"])
        runs = found.filter(F.col("kind") == RUN).select("m", "b", "t", "w")
        return runs.unionByName(found.filter(F.col("kind") == OPEN).join(repeated, ["m", "digest"], "left_semi")
                                .select("m", "b", "t", "w"))

    ranges = repeated_ranges(source, byte_sequences, covered, decide, length, gram, size, most_bits)

    def cut(batches):
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            for text, begin, end in text_and_ranges(batch, text_col):
                sizes.append(len(text))
                removed.append(int(sum(end) - sum(begin)))
                spans.append(len(begin))
                edges = [0, *(x for pair in zip(begin, end, strict=True) for x in pair), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)),
                 pa.array(kept, pa.binary())], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    placed = with_ranges(docs, ranges, id_col, text_col)
    return placed.mapInArrow(cut, row_and(placed, "n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept BINARY"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup(documents(spark, sf_dir)).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
