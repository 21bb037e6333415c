"""Toxicity scores from a small recurrent network, trained in one task by numpy.

A word enters as its own vector (words seen often enough in training) joined with the mean vector of
its character pieces, four bytes long (all words). A gated recurrent network reads each window of words in both
directions, attention pools the states, a logistic unit scores the window. A text's score is the
largest over its overlapping windows, which cover every word. Labels hold for whole texts, so training takes
the best window of a toxic text, chosen anew every epoch, and random windows of the others.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemeta.llm.common import documents, row_and, row_groups, utf8

WINDOW, STRIDE = 64, 32
_WORD_DIM = _CHAR_DIM = _STATE = 8
_BUCKET_BITS = 15
_EDGES = ".,;:!?\"'`()[]{}<>#*$%&|/\\-_=+~^@…«»„“”‘’"
_UNKNOWN = 0
#: Gates that leave the state as it is: what a window reads past its text's end.
_PADDING = np.concatenate([np.full((2, 1, _STATE), 30, np.float32), np.zeros((2, 1, 2 * _STATE), np.float32)], axis=2)


def normalised(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_EDGES)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the four-byte pieces of ``^word$$$``, all words end to end, and how many each has."""
    marked = [b"^%s$$$" % w.encode() for w in words]
    sizes = np.array([len(m) - 3 for m in marked], np.int64)
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    starts = np.repeat(np.cumsum(sizes + 3) - (sizes + 3) - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    value = raw[starts] | raw[starts + 1] << np.uint32(8) | raw[starts + 2] << np.uint32(16) | raw[starts + 3] << np.uint32(24)
    return ((value * np.uint32(2654435761)) >> np.uint32(32 - _BUCKET_BITS)).astype(np.int64), sizes


class Numbers(dict):
    """A number for each distinct word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


@dataclass
class Words:
    """What the network reads of some distinct words: ids of their own vectors, and their character pieces."""

    ids: np.ndarray
    flat: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], word_ids: dict[str, int]) -> Words:
        plain = [normalised(w) for w in words]
        return cls(np.array([word_ids.get(w, _UNKNOWN) for w in plain], np.int64), *gram_buckets(plain))

    def some(self, chosen: np.ndarray) -> Words:
        sizes = self.sizes[chosen]
        shift = (np.cumsum(self.sizes) - self.sizes)[chosen] - (np.cumsum(sizes) - sizes)
        return Words(self.ids[chosen], self.flat[np.repeat(shift, sizes) + np.arange(sizes.sum())], sizes)


def numbered_words(text: bytes, numbers: Numbers) -> np.ndarray:
    return np.array([numbers[w] for w in text.split()], np.int64)


def window_starts(words: int) -> range:
    """Windows every ``STRIDE`` words until the text is covered; a text without words has one."""
    return range(0, max(1, words - (WINDOW - STRIDE)), STRIDE)


def windows_of(numbers: np.ndarray) -> np.ndarray:
    """A text's windows as rows of word numbers, -1 where it ends."""
    starts = window_starts(len(numbers))
    padded = np.full(starts[-1] + WINDOW, -1, np.int64)
    padded[:len(numbers)] = numbers
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE][:len(starts)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def by_row(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``x @ m`` with each row's sums made in one order, whatever rows are beside it; matrix libraries don't promise that."""
    out = x[..., :1] * m[..., :1, :]
    for k in range(1, m.shape[-2]):
        out += x[..., k:k + 1] * m[..., k:k + 1, :]
    return out


@dataclass
class Network:
    """Parameters by name; a leading 2 in a shape means forward and backward."""

    word_ids: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, word_ids: dict[str, int], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        size = _WORD_DIM + _CHAR_DIM
        shapes = {"word": (len(word_ids) + 1, _WORD_DIM), "char": (1 << _BUCKET_BITS, _CHAR_DIM), "into": (2, size, 3 * _STATE),
                  "bias": (2, 1, 3 * _STATE), "back": (2, _STATE, 3 * _STATE), "look": (2 * _STATE,), "out": (2 * _STATE,)}
        p = {k: rng.normal(0, 0.1 if k in ("word", "char") else 0.3, s).astype(np.float32) for k, s in shapes.items()}
        p["bias"][:] = 0
        return cls(word_ids, p | {"level": np.zeros(1, np.float32)})

    def projected(self, words: Words, product=np.matmul) -> tuple[np.ndarray, np.ndarray]:
        """What each word adds to the gates in each direction, (2, words, 3 * state), and the words' vectors."""
        mean = np.zeros((len(words.ids), _CHAR_DIM), np.float32)
        if len(words.ids):
            at = np.cumsum(words.sizes) - words.sizes
            mean = np.add.reduceat(self.p["char"][words.flat], at, axis=0) / words.sizes[:, None]
        x = np.concatenate([self.p["word"][words.ids], mean], axis=1).astype(np.float32)
        return product(x, self.p["into"]) + self.p["bias"], x

    def run(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows ``index`` (rows of word numbers, -1 for padding); with ``keep``, what gradients need beside them.

        Without, a window's logit is the same to the last bit in any company.
        """
        product = np.matmul if keep else by_row
        batch, steps = index.shape
        order = np.ascontiguousarray(index.T)
        gates = np.concatenate([gates, _PADDING], axis=1)
        states = np.zeros((2, steps, batch, _STATE), np.float32)
        h = np.zeros((2, batch, _STATE), np.float32)
        kept = []
        for s in range(steps):
            x = np.stack([gates[0].take(order[s], axis=0, mode="wrap"), gates[1].take(order[steps - 1 - s], axis=0, mode="wrap")])
            u = product(h, self.p["back"])
            zr = _sigmoid(x[:, :, :2 * _STATE] + u[:, :, :2 * _STATE])
            z, r = zr[:, :, :_STATE], zr[:, :, _STATE:]
            un = u[:, :, 2 * _STATE:]
            n = np.tanh(x[:, :, 2 * _STATE:] + r * un)
            new = n + z * (h - n)
            if keep:
                kept.append((h, z, r, n, un))
            h = new
            states[0, s], states[1, steps - 1 - s] = h[0], h[1]
        both = np.concatenate([states[0], states[1]], axis=2)
        seen = order >= 0
        focus = np.where(seen, (both * self.p["look"]).sum(2), np.float32(-1e9))
        weight = np.exp(focus - focus.max(0)) * seen
        weight /= np.maximum(weight.sum(0), np.float32(1e-9))
        pooled = np.einsum("tb,tbk->bk", weight, both)
        logits = (pooled * self.p["out"]).sum(1) + self.p["level"][0]
        return (logits, (order, kept, both, weight, pooled)) if keep else logits

    def gradients(self, index: np.ndarray, words: Words, target: np.ndarray, weight_of: np.ndarray):
        """Gradients of the weighted log loss over a batch of windows."""
        unique, local = np.unique(index, return_inverse=True)
        local = local.reshape(index.shape)
        if unique[0] == -1:
            unique, local = unique[1:], local - 1
        part = words.some(unique)
        gates, x = self.projected(part)
        logits, (order, kept, both, weight, pooled) = self.run(gates, local, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((_sigmoid(logits) - target) * weight_of / weight_of.sum()).astype(np.float32)
        g["level"][0] = d.sum()
        g["out"] = pooled.T @ d
        d_pooled = d[:, None] * self.p["out"]
        d_both = weight[:, :, None] * d_pooled
        d_focus = weight * (np.einsum("tbk,bk->tb", both, d_pooled) - (pooled * d_pooled).sum(1))
        g["look"] = np.einsum("tbk,tb->k", both, d_focus)
        d_both += d_focus[:, :, None] * self.p["look"]
        steps = len(order)
        d_steps = np.zeros((2, *order.shape, 3 * _STATE), np.float32)
        dh = np.zeros((2, order.shape[1], _STATE), np.float32)
        back = self.p["back"].transpose(0, 2, 1)
        for s in range(steps - 1, -1, -1):
            h, z, r, n, un = kept[s]
            dh = dh + np.stack([d_both[s, :, :_STATE], d_both[steps - 1 - s, :, _STATE:]])
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], axis=2)
            g["back"] += h.transpose(0, 2, 1) @ du
            dh = dh * z + du @ back
            dx = np.concatenate([dz, dr, dn], axis=2)
            d_steps[0, s], d_steps[1, steps - 1 - s] = dx[0], dx[1]
        places = np.argsort(order, axis=None, kind="stable")
        used, first = np.unique(order.ravel()[places], return_index=True)
        d_gates = np.add.reduceat(d_steps.reshape(2, -1, 3 * _STATE)[:, places], first, axis=1)[:, used >= 0]
        g["bias"] = d_gates.sum(1, keepdims=True)
        g["into"] = x.T @ d_gates
        dx = (d_gates @ self.p["into"].transpose(0, 2, 1)).sum(0)
        per_piece = np.repeat(dx[:, _WORD_DIM:] / part.sizes[:, None], part.sizes, axis=0)
        for k in range(_WORD_DIM):
            g["word"][:, k] = np.bincount(part.ids, dx[:, k], len(self.p["word"]))
        for k in range(_CHAR_DIM):
            g["char"][:, k] = np.bincount(part.flat, per_piece[:, k], 1 << _BUCKET_BITS)
        return g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k in self.p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.001 * (g[k]**2 - self.v[k])
            self.p[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def train(texts: list[bytes], labels: list[int], min_count: int = 3, most_words: int = 20_000, updates: int = 200,
          batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """Fits the network to labelled texts; at least ``updates`` steps, whole epochs."""
    counts: dict[str, int] = {}
    for text in texts:
        for word in {normalised(w) for w in text.split()}:
            counts[word] = counts.get(word, 0) + 1
    common = sorted((w for w, c in counts.items() if c >= min_count), key=lambda w: (-counts[w], w))[:most_words]
    network = Network.fresh({w: i + 1 for i, w in enumerate(common)}, seed)
    numbers, rng = Numbers(), np.random.default_rng(seed)
    windows = [windows_of(numbered_words(t, numbers)) for t in texts]
    words = Words.of(list(numbers), network.word_ids)
    labels = np.array(labels)
    toxic, fine = np.flatnonzero(labels == 1), np.flatnonzero(labels != 1)
    pool = np.concatenate([windows[i] for i in toxic])
    parts = np.array_split(np.arange(len(words.ids)), len(words.ids) // 16384 + 1)
    edges = np.cumsum([0, *(len(windows[i]) for i in toxic)])
    adam, done, epoch = Adam(network.p, rate), 0, 0
    while done < updates:
        chosen = {i: rng.integers(len(windows[i])) for i in toxic}
        if epoch >= 2:
            gates = np.concatenate([network.projected(words.some(part))[0] for part in parts], axis=1)
            scores = np.concatenate([network.run(gates, part) for part in np.array_split(pool, len(pool) // 2048 + 1)])
            chosen = {i: int(np.argmax(scores[a:b])) for i, a, b in zip(toxic, edges[:-1], edges[1:], strict=True)}
        picks = [(i, chosen[i]) for i in toxic] + [(i, k) for i in fine for k in rng.integers(len(windows[i]), size=min(2, len(windows[i])))]
        rng.shuffle(picks)
        weight = len(fine) / max(1, len(toxic))
        for at in range(0, len(picks), batch):
            part = picks[at:at + batch]
            index = np.stack([windows[i][k] for i, k in part])
            target = np.array([labels[i] for i, _ in part], np.float32)
            balance = np.where(target == 1, min(weight, 4), 1).astype(np.float32)
            adam.step(network.gradients(index, words, target, balance))
            done += 1
        epoch += 1
    return network


class Scorer:
    """Scores texts, a few thousand windows at a time; what words add to the gates is worked out once."""

    def __init__(self, network: Network, most_words: int = 150_000):
        self.network, self.most = network, most_words
        self.forget()

    def forget(self) -> None:
        self.numbers, self.gates, self.known = Numbers(), np.zeros((2, 0, 3 * _STATE), np.float32), 0

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if len(self.numbers) > self.most:
            self.forget()
        windows = [windows_of(numbered_words(t, self.numbers)) for t in texts]
        new = list(islice(reversed(self.numbers), len(self.numbers) - self.known))[::-1]
        if new:
            added = self.network.projected(Words.of(new, self.network.word_ids), by_row)[0].astype(np.float32)
            self.gates, self.known = np.concatenate([self.gates, added], axis=1), len(self.numbers)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in windows])
        index = np.concatenate(windows) if windows else np.zeros((0, WINDOW), np.int64)
        best = np.full(len(texts), -np.inf, np.float32)
        for at in range(0, len(index), 2048):
            np.maximum.at(best, owner[at:at + 2048], self.network.run(self.gates, index[at:at + 2048]))
        return np.round(_sigmoid(best.astype(np.float64)), 9)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", most_rows: int = 1500, most_bytes: int = 1 << 16) -> DataFrame:
    """(label_id, text, label): a bounded sample of labelled texts of the fit folds: per class the ``most_rows`` ids
    that hash lowest (two negatives for a positive), texts over ``most_bytes`` left out. A row labelled twice counts
    as toxic if either label says so."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("label_id"))
             .agg(F.max(label_col).alias("label")).filter(~held_out(F.col("label_id"))))
    order = F.xxhash64("label_id")
    picked = (known.filter("label = 1").orderBy(order, "label_id").limit(most_rows)
              .unionByName(known.filter("label = 0").orderBy(order, "label_id").limit(2 * most_rows)))
    rows = docs.select(F.col(id_col).alias("label_id"), F.coalesce(text_col, F.lit("")).alias("text")).filter(
        F.octet_length("text") <= most_bytes).join(picked, "label_id")
    return rows.groupBy("label_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def fitted(table: pa.Table) -> pa.Table:
    """(model, level) of a sample: the network, or none and the label if there is one kind of label only."""
    texts = table["text"].cast(pa.binary()).to_pylist()
    rows = sorted(zip(table["label_id"].to_pylist(), texts, table["label"].to_pylist(), strict=True))
    labels = [label for _, _, label in rows]
    model = pickle.dumps(train([t for _, t, _ in rows], labels)) if len(set(labels)) == 2 else None
    return pa.table({"model": pa.array([model], pa.binary()), "level": pa.array([float(max(labels))])})


def held_out(id_):
    """The fold that labels are never learned from."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 3 == 1


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7,
           **options) -> DataFrame:
    """Every row of ``docs`` as a struct ``row`` with ``held_out``, ``score`` and ``predicted``.

    Only the text is scored; null and empty texts are one empty window. If the labels that may be learned
    from are all of one kind, the score is that label (0 for none at all). Equal texts get equal
    scores, however rows are partitioned, and columns of any name ride along.
    """
    sample = training_rows(docs, labels, id_col, text_col, **options)
    # The sample is bounded, so one task can hold it; the driver gets the parameters only.
    found = sample.groupBy().applyInArrow(fitted, "model BINARY, level DOUBLE").first()
    network = pickle.loads(found.model) if found and found.model else None
    constant = found.level if found else 0.0
    model = docs.sparkSession.sparkContext.broadcast(network)

    def each(batches):
        score = Scorer(model.value) if model.value else lambda texts: np.full(len(texts), constant)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            scores = []
            for low, high in row_groups(offsets, 1 << 20):
                scores.append(score([data[offsets[i]:offsets[i + 1]].tobytes() for i in range(low, high)]))
            found = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("held_out"), pa.array(found, pa.float64())],
                                             names=["row", "held_out", "score"])

    source = docs.select(F.struct("*").alias("row"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return source.mapInArrow(each, row_and(source, "held_out BOOLEAN, score DOUBLE")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def op5_toxicity(spark, sf_dir):
    found = scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("row.doc_id", "held_out", "score", "predicted")
