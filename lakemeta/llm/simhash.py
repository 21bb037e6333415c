"""SimHash near-duplicates: pigeonring filtering of fingerprints, then connected components.

A fingerprint's 64 bits form a ring of eight segments. If two fingerprints differ in at most two
bits, then from some segment on every chain of l consecutive segments differs in at most
l * 2 / 8 bits: none in the first three, one in up to seven, two in all. So such a pair agrees in three
consecutive segments and, of the four that follow, in the first two or the last two: 40 bits, in one of 16
ways. Fingerprints meet under these 16 keys; a pair passes its chain's budgets before its whole
distance is looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemeta.llm.common import documents, saved, text_key, utf8
from lakemeta.llm.components import components

SEGMENTS, DISTANCE = 8, 2
_CHUNK = 1 << 16
#: Above so many fingerprints under a key, partners are looked up instead of compared one by one.
_LOOKUP = 1024


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def over_half(ones: np.ndarray, count: int) -> int:
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bits set in over half of the hashes of the text's shingles; zero for no words."""
    words = text.lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _CHUNK):
        end = min(at + _CHUNK, count)
        pieces = map(b" ".join, zip(*(words[at + j:end + j] for j in range(shingle)), strict=True)) \
            if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(p, 42) for p in pieces], np.uint64)
        ones += bit_counts(hashes)
    return over_half(ones, count)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, key, fp): the fingerprint as a signed long; ``key`` tells rows of one id apart."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(id_col), F.col(text_col)).alias("key"),
                         F.col(text_col).alias("text"))

    def each(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            raw = data.tobytes()
            found = [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=["doc_id", "key", "fp"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(each, f"doc_id {kind}, key BIGINT, fp BIGINT")


def chain_keys(fp) -> list:
    """The 16 keys of a fingerprint: where its chain starts, which half follows, and those 40 bits."""
    def segment(k):
        return F.shiftrightunsigned(fp, 8 * (k % SEGMENTS)).bitwiseAND(255)

    def key(start, half):
        chosen = [start, start + 1, start + 2, start + 3 + 2 * half, start + 4 + 2 * half]
        out = F.lit(2 * start + half).cast("long")
        for k in chosen:
            out = F.shiftleft(out, 8).bitwiseOR(segment(k))
        return out

    return [key(start, half) for start in range(SEGMENTS) for half in (0, 1)]


def within_budgets(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Does every chain from ``start`` keep to its budget? The last chain is the whole ring."""
    different = a ^ b
    turn = (8 * start).astype(np.uint64)
    ring = (different >> turn) | (different << ((np.uint64(64) - turn) & np.uint64(63)))
    passed = np.ones(len(a), bool)
    for length in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << (8 * length)) - 1)
        passed[passed] = np.bitwise_count(ring[passed] & mask) <= length * DISTANCE // SEGMENTS
    return passed


class Forest:
    """Disjoint sets over 0 .. n-1 that remember which links joined them."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            high, once = np.unique(high, return_index=True)
            self.links.append((a[once], b[once]))
            self.root[high] = low[once]
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]


def _fixed(code: int) -> np.uint64:
    """The bits that a key of this kind fixes."""
    start, half = divmod(code, 2)
    chosen = [start, start + 1, start + 2, start + 3 + 2 * half, start + 4 + 2 * half]
    return np.uint64(sum(255 << 8 * (k % SEGMENTS) for k in chosen))


def linked_pairs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, under each key, what lies within the distance; ``keys`` are sorted."""
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(begin, len(keys)))
    forest, start = Forest(len(keys)), keys.view(np.uint64) >> np.uint64(41)
    rank = np.arange(len(keys)) - np.repeat(begin, sizes)
    left = np.repeat(sizes, sizes) - rank
    few = np.repeat(sizes <= _LOOKUP, sizes)
    for gap in range(1, int(sizes[sizes <= _LOOKUP].max(initial=0))):
        a = np.flatnonzero((left > gap) & few)
        near = within_budgets(fps[a], fps[a + gap], start[a])
        forest.join(a[near], a[near] + gap)
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    flips = np.concatenate([one, (one[:, None] | one)[np.triu_indices(64, 1)]])
    for at, size in zip(begin[sizes > _LOOKUP], sizes[sizes > _LOOKUP], strict=True):
        order = np.argsort(fps[at:at + size], kind="stable")
        ordered = fps[at:at + size][order]
        for flip in flips[(flips & _fixed(int(keys[at]) >> 40)) == 0]:
            place = np.minimum(np.searchsorted(ordered, ordered ^ flip), size - 1)
            hit = np.flatnonzero(ordered[place] == ordered ^ flip)
            near = within_budgets(ordered[hit], ordered[place[hit]], np.repeat(start[at], len(hit)))
            forest.join(at + order[hit[near]], at + order[place[hit[near]]])
    if not forest.links:
        return fps[:0], fps[:0]
    return tuple(fps[np.concatenate(side)] for side in zip(*forest.links, strict=True))


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links among distinct fingerprints that connect what lies within the distance.

    Those under one key are at most 2^24 (40 bits of 64 are fixed), so one task can always hold them.
    """
    keyed = (fps.select("fp", F.explode(F.array(*chain_keys(F.col("fp")))).alias("chain"))
             .repartition("chain").sortWithinPartitions("chain"))

    def each(batches):
        held_keys, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([held_keys, np.asarray(batch.column("chain"))])
            mine = np.concatenate([held_fps, np.asarray(batch.column("fp")).view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield _links(keys[:cut], mine[:cut])
            held_keys, held_fps = keys[cut:], mine[cut:]
        yield _links(held_keys, held_fps)

    return keyed.mapInArrow(each, "u BIGINT, v BIGINT")


def _links(keys, fps):
    a, b = linked_pairs(keys, fps) if len(keys) else (fps, fps)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, key, fp, component_id, leader): one row per row of ``docs``.

    Fingerprints that differ in at most two bits are linked; ``component_id`` is the smallest id that links
    reach, nulls aside (null where no row of the component has an id). ``leader`` is the ``key`` of
    that id's row: it picks one row where an id is repeated. Null and empty texts have fingerprint
    zero, repeated rows share a fingerprint; other columns are not read. Links are sought among distinct
    fingerprints only, so copies cost nothing, and every link between different ones is kept or implied.
    """
    return grouped(saved(fingerprints(docs, id_col, text_col, shingle), "fingerprints"), links)


def grouped(rows: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (doc_id, key, fp) with the component that the links among their distinct ``fp`` make, and its leader."""
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key")
    distinct = saved(rows.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    roots = saved(components(links_of(distinct.select("fp"))), "roots")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    leaders = saved(placed.groupBy("root").agg(F.min("first").alias("lead")), "leaders")
    table = saved(placed.join(leaders, "root").select(
        "fp", F.col("lead.doc_id").alias("component_id"), F.col("lead.key").alias("leader")), "table")
    return rows.join(table, "fp").select("doc_id", "key", "fp", "component_id", "leader")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component left: the one with the smallest id."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that lead their component in ``found``, one row of equal ones."""
    keep = found.filter(
        "doc_id <=> component_id AND key = leader").select("doc_id", "key").distinct()
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k1"), F.col("key").alias("k2")]
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"),
                       text_key(F.col(id_col), F.col(text_col)).alias("key")).select("row", *keys)
    left = rows.join(keep.select(*keys), ["k1", "k2"], "left_semi")
    whole = F.xxhash64(*[F.col("row").getField(c) for c in docs.columns])
    return left.groupBy("k1", "k2").agg(F.min_by("row", whole).alias("row")).select("row.*")


def op8_simhash_dedup(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
