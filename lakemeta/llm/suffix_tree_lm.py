"""Language model scores from a probabilistic suffix tree over words.

States are contexts of up to ``longest`` words. Every run of up to ``longest`` + 1 words that occurs at least twice in the
training texts is counted exactly; every part of such a run is one too, so runs grow word by word.
A context becomes a state if what follows it diverges from what follows its longest shorter state by more
than its next-word entries cost. A state's distribution is smoothed towards that shorter state: its entries by a
few pseudo counts, all other words by the shorter state's probabilities, scaled to the mass that is left. At the
root stands every word of the training texts, with its exact count. A token's probability is that of the
longest state that ends before it.

A text's log probability is so a sum over its runs: a context that is a state adds what other words are raised by,
a run after such a context what its entry differs by from that. The tree is a table of these weights, made by joins; texts
meet it in a join too, only the weights of the most frequent runs are broadcast.

Words and runs are told apart by 64-bit hashes. A run's hash is made of two: of the run without its last and without its first
word. Runs are counted as such pairs, so their parts come with the counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemeta.llm.common import discarded, documents, mix, row_groups, saved, shuffles_removed, utf8
from lakemeta.llm.window_dedup import word_sequences

#: Stands for the end of a text; no word hashes to it but by chance.
END = np.uint64(1)
_PIECE, _HELD = 1 << 20, 1 << 22
_TWIST = np.uint64(0xD1B54A32D192ED03)
#: The weights of at most so many runs, the most frequent ones, travel as a broadcast.
_BROADCAST = 1 << 20
#: Cells of a bitmap of runs, as a power of two; where it fills up, more runs travel to a join, with the same results.
_MOST_BITS = 28


def tokens(batch: pa.RecordBatch):
    """(first row, last row + 1, token hashes, where rows start) of a batch of texts, a megabyte at a time.

    Tokens are the words, A-Z lower-cased, and one end for every text, a null or empty one included.
    """
    data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
    for low, high in row_groups(offsets, _PIECE):
        part = data[offsets[low]:offsets[high]]
        part = np.where((part >= 65) & (part <= 90), part | np.uint8(32), part)
        words, limits, _ = word_sequences(part, offsets[low:high + 1] - offsets[low])
        yield low, high, np.insert(words, limits[1:], END), limits + np.arange(len(limits))


def joined(context: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The hashes of runs from those of the runs without their last and without their first word."""
    return mix(context * _TWIST + inner)


def run_parts(hashes: np.ndarray, starts: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2 to ``longest`` + 1: where the runs inside a text begin, and the hashes of their two parts."""
    row, dense, out = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), hashes, []
    for size in range(2, longest + 2):
        at = np.flatnonzero(row[:max(0, len(row) - size + 1)] == row[size - 1:])
        out.append((at, dense[at], dense[at + 1]))
        if size <= longest:
            dense = np.zeros(len(hashes), np.uint64)
            dense[at] = joined(*out[-1][1:])
    return out


def runs(hashes: np.ndarray, starts: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to ``longest`` + 1: the hashes of all runs inside a text, and where they begin."""
    return [(hashes, np.arange(len(hashes)))] + [(joined(*parts), at) for at, *parts in run_parts(hashes, starts, longest)]


def placed(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted table, -1 where it doesn't."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    order = np.argsort(values)
    ordered = values[order]
    at = np.minimum(np.searchsorted(table, ordered), len(table) - 1)
    out = np.empty(len(values), np.int64)
    out[order] = np.where(table[at] == ordered, at, -1)
    return out


class Bitmap:
    """A bit for each hash of a table; it says no only to hashes that surely are not in it."""

    def __init__(self, keys: DataFrame):
        self.mask = np.uint64((1 << min(_MOST_BITS, max(16, (8 * keys.count()).bit_length()))) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        cell = F.col("key").bitwiseAND(int(self.mask))
        cells = keys.select(F.shiftright(cell, 15).cast("int").alias("chunk"), cell.bitwiseAND(32767).cast("int").alias("cell"))

        def chunk(table: pa.Table) -> pa.Table:
            has = np.zeros(32768, bool)
            has[np.asarray(table["cell"])] = True
            return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([np.packbits(has, bitorder="little").tobytes()], pa.binary())})

        with shuffles_removed(keys.sparkSession):
            parts = cells.groupBy("chunk").applyInArrow(chunk, "chunk INT, bits BINARY").collect()
        for at, part in parts:
            self.bits[at * 4096:(at + 1) * 4096] = np.frombuffer(part, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes & self.mask
        return (self.bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counted(values: DataFrame, emit, name: str) -> DataFrame:
    """(``name``, n): how often each value that ``emit`` makes of a batch occurs, added up in the task first."""
    def table(held):
        value, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=[name, "n"])

    def each(batches):
        held, waiting = [], 0
        for batch in batches:
            for found in emit(batch):
                held.append(found)
                waiting += len(found)
                if waiting > _HELD:
                    yield table(held)
                    held, waiting = [], 0
        if waiting:
            yield table(held)

    return values.mapInArrow(each, f"{name} BIGINT, n BIGINT").groupBy(name).agg(F.sum("n").alias("n"))


def counted_runs(text: DataFrame, size: int, known, least: float) -> DataFrame:
    """(key, context, inner, n): how often each run of ``size`` words occurs, from ``least`` on, and its two parts.

    Runs with a part that a bitmap doesn't have are left out: they occur less often than ``least``.
    """
    def table(held):
        context, inner = (np.concatenate(side) for side in zip(*held, strict=True))
        order = np.lexsort((inner, context))
        context, inner = context[order], inner[order]
        first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (inner[1:] != inner[:-1]))[:len(context)])
        n = np.diff(np.append(first, len(context)))
        return pa.RecordBatch.from_arrays([*[pa.array(x[first].view(np.int64)) for x in (context, inner)], pa.array(n.astype(np.int64))],
                                          names=["context", "inner", "n"])

    def each(batches):
        held, waiting = [], 0
        for batch in batches:
            for _, _, hashes, starts in tokens(batch):
                _, context, inner = run_parts(hashes, starts, size - 1)[-1]
                both = known.value.has(context) & known.value.has(inner)
                held.append((context[both], inner[both]))
                waiting += len(held[-1][0])
                if waiting > _HELD:
                    yield table(held)
                    held, waiting = [], 0
        if waiting:
            yield table(held)

    def keys(batches):
        for batch in batches:
            context, inner = (np.asarray(batch.column(c)).view(np.uint64) for c in ("context", "inner"))
            yield pa.RecordBatch.from_arrays([pa.array(joined(context, inner).view(np.int64)), *batch.columns],
                                             names=["key", *batch.schema.names])

    often = text.mapInArrow(each, "context BIGINT, inner BIGINT, n BIGINT").groupBy("context", "inner").agg(F.sum("n").alias("n"))
    return often.filter(F.col("n") >= least).mapInArrow(keys, "key BIGINT, context BIGINT, inner BIGINT, n BIGINT")


def grown(text: DataFrame, shorter: DataFrame, size: int, least: float, pseudo: float) -> tuple[DataFrame, DataFrame]:
    """The runs of ``size`` words that occur ``least`` times or more as (key, n, entry, gain), and the states among their contexts.

    ``shorter``: (key, n, entry) of the runs a word shorter. ``entry`` is the log probability of a run's last word after the
    others, ``gain`` what it exceeds the shorter state's by, less what all words are raised by after that context: ``rest`` of
    the states (key, n, rest).
    """
    known = text.sparkSession.sparkContext.broadcast(Bitmap(shorter.select("key")))
    counts = saved(counted_runs(text, size, known, least), "runs")
    chance = (F.col("n") + pseudo * F.exp("shorter")) / (F.col("seen") + pseudo)
    rows = saved(counts.join(shorter.select(F.col("key").alias("inner"), F.col("entry").alias("shorter")), "inner").drop("inner")
                  .join(shorter.select(F.col("key").alias("context"), F.col("n").alias("seen")), "context")
                  .select("key", "n", "context", "seen", "shorter", F.log(chance).alias("own")), "entries")
    discarded(counts)
    left, left_shorter = 1 - F.sum(F.exp("own")), F.greatest(1 - F.sum(F.exp("shorter")), F.lit(1e-12))
    rest = F.log(F.greatest(left, F.lit(1e-12))) - F.log(left_shorter)
    seen = F.max("seen")
    pays = seen * (F.sum(F.exp("own") * (F.col("own") - F.col("shorter"))) + left * rest) \
        > 0.5 * F.log(F.greatest(seen, F.lit(2))) * (F.count("*") + 1)
    states = saved(rows.groupBy("context").agg(seen.alias("n"), rest.alias("rest"), pays.alias("pays")).filter("pays")
                    .select(F.col("context").alias("key"), "n", "rest"), "states")
    placed = rows.drop("seen").join(states.select(F.col("key").alias("context"), "rest"), "context", "left")
    state = F.col("rest").isNotNull()
    out = saved(placed.select("key", "n", F.when(state, F.col("own")).otherwise(F.col("shorter")).alias("entry"),
                               F.when(state, F.col("own") - F.col("shorter") - F.col("rest")).otherwise(0.0).alias("gain")), "grown")
    discarded(rows)
    return out, states


def suffix_tree(text: DataFrame, vocabulary: DataFrame, total: int, distinct: int, longest: int, share: float, pseudo: float) -> DataFrame:
    """(key, n, base, known, gain): what each occurrence of a word or run adds to a text's scores (log10), for words above the
    unknown word's 0.1; ``vocabulary`` is (word, n) of all tokens of ``text``."""
    least, scale = max(2, share * total), float(np.log(10))
    words = vocabulary.select(F.col("word").alias("key"), "n")
    shorter = words.filter(F.col("n") >= least).withColumn(
        "entry", F.log(F.col("n") + 0.1) - float(np.log(total + 0.1 * (distinct + 1))))
    weights, used = [words.withColumns({"base": F.log10(F.col("n") + 0.1) + 1, "known": F.lit(1), "gain": F.lit(0.0)})], [vocabulary]
    for size in range(2, longest + 2):
        shorter, states = grown(text, shorter, size, least, pseudo)
        used += [shorter, states]
        none = {"base": F.lit(0.0), "known": F.lit(0)}
        weights += [found.select("key", "n", *[v.alias(k) for k, v in none.items()], (F.col(gain) / scale).alias("gain"))
                    for found, gain in ((shorter.filter("gain <> 0"), "gain"), (states, "rest"))]
    every = weights[0]
    for more in weights[1:]:
        every = every.unionByName(more)
    out = saved(every.groupBy("key").agg(F.max("n").alias("n"), F.sum("base").alias("base"), F.sum("known").alias("known"),
                                          F.sum("gain").alias("gain")).filter("known > 0 OR gain <> 0"), "weights")
    discarded(*used)
    return out


def frequent_runs(weights: DataFrame):
    """The condition that holds for the most frequent runs, in steps of a quarter of a doubling, ``_BROADCAST`` at most."""
    step, least, runs_above = F.floor(4 * F.log2("n")), None, 0
    for at, count in sorted(weights.groupBy(step.alias("step")).count().collect(), reverse=True):
        runs_above += count
        if runs_above > _BROADCAST:
            break
        least = at
    return F.lit(False) if least is None else step >= least


def suffix_tree_scores(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", longest: int = 2,
                       share: float = 0.0, pseudo: float = 5.0) -> DataFrame:
    """``id_col`` of every row of ``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``: log10
    probabilities of the text by the words' counts alone and by the tree.

    ``training`` (a condition) says which rows are learned from. Null and empty texts are one token, their end. An
    empty table gives no rows; without training rows every token is unknown. Repeated ids keep their rows, other
    columns are not read. Runs count from two occurrences; only a caller's ``share`` of the training tokens asks for more.
    """
    spark = docs.sparkSession
    text = docs.filter(training).select(F.coalesce(text_col, F.lit("")).alias("text"))

    def words(batch):
        for _, _, hashes, _ in tokens(batch):
            yield hashes

    vocabulary = saved(counted(text, words, "word"), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    weights = suffix_tree(text, vocabulary, total, distinct, longest, share, pseudo)
    frequent = frequent_runs(weights)
    with shuffles_removed(spark):
        table = weights.filter(frequent).select("key", "base", "known", "gain").toArrow()
    order = np.argsort(np.asarray(table["key"]).view(np.uint64))
    table = [np.asarray(table[c])[order] for c in ("key", "base", "known", "gain")]
    held = spark.sparkContext.broadcast((table[0].view(np.uint64), *table[1:], Bitmap(weights.filter(~frequent).select("key"))))

    def each(batches):
        for batch in batches:
            keys, base, known, gain, others = held.value
            for low, high, hashes, starts in tokens(batch):
                row = np.repeat(np.arange(high - low), np.diff(starts))
                sums, rare, rows = [np.zeros(high - low) for _ in range(3)], [], []
                for found, at in runs(hashes, starts, longest):
                    place = placed(keys, found)
                    here = np.flatnonzero(place >= 0)
                    for k, weight in enumerate((base, known, gain)):
                        sums[k] += np.bincount(row[at[here]], weight[place[here]], high - low)
                    travels = np.flatnonzero((place < 0) & others.has(found))
                    rare.append(found[travels])
                    rows.append(row[at[travels]])
                rare, rows = np.concatenate(rare), np.concatenate(rows)
                order = np.lexsort((rare, rows))
                rare, rows = rare[order], rows[order]
                first = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (rows[1:] != rows[:-1]))[:len(rare)])
                times = np.diff(np.append(first, len(rare)))
                offsets = pa.array(np.searchsorted(rows[first], np.arange(high - low + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(low, high - low), pa.array(np.diff(starts)), *map(pa.array, sums),
                     pa.ListArray.from_arrays(offsets, pa.array(rare[first].view(np.int64))),
                     pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                    names=["id", "n_tokens", "base", "known", "gain", "rare", "times"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = source.mapInArrow(each, f"id {kind}, n_tokens BIGINT, base DOUBLE, known DOUBLE, gain DOUBLE, "
                                   "rare ARRAY<BIGINT>, times ARRAY<INT>").withColumn("at", F.monotonically_increasing_id())
    # What a text has already travels with an entry of its own, which no weight adds to: it occurs no times.
    keys, times = F.concat(F.array("at"), "rare"), F.concat(F.array(F.lit(0)), "times")
    entries = rows.select("at", F.struct("id", "n_tokens", "base", "known", "gain").alias("text"),
                          F.inline(F.arrays_zip(keys.alias("key"), times.alias("times"))))
    entries = entries.withColumn("text", F.when(F.col("times") == 0, F.col("text")))
    met = entries.join(weights.filter(~frequent).drop("n"), "key", "left")
    none = F.lit(0.0)
    whole = [F.sum(F.coalesce(f"text.{c}", none) + F.coalesce(F.col("times") * F.col(c), none)).alias(c) for c in ("base", "known", "gain")]
    base = F.col("base") - F.col("n_tokens") * float(1 + np.log10(total + 0.1 * (distinct + 1)))
    return met.groupBy("at").agg(F.max("text.id").alias("id"), F.sum("text.n_tokens").alias("n_tokens"), *whole).select(
        F.col("id").alias(id_col), "n_tokens", F.col("known").cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"), F.round(base, 9).alias("base_score"),
        F.round(base + F.col("gain"), 9).alias("score"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


def op12_suffix_tree_lm(spark, sf_dir):
    scores = suffix_tree_scores(documents(spark, sf_dir), ~held_out())
    return scores.withColumn("held_out", held_out())
