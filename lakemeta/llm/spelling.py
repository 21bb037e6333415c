"""Spelling variants of a vocabulary: words one edit apart, found by search schemes over FM-indexes.

A word one edit away shares either half of a word exactly, at its own begin or end. So two searches
suffice: the first half is matched exactly from the left and extended over the second, or the second half from
the right and over the first; each extension may spend one error. A search keeps the interval of suffix ranks
of what it has matched, over the vocabulary written with a delimiter before each word; since both start at a
delimiter, the index read to the right serves one and the index read to the left the other.

Words that share an exact half meet in a shard, which holds the index of its words. A half that very many
words share is dealt over a grid of shards, so none outgrows a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemeta.llm.common import documents, saved

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of a shard, about; words of one half that meet in one shard, at most about.
SHARD = 1 << 14
_HELD, _LONG, _BATCH = 1 << 19, 1 << 20, 1 << 13


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo: int | None = 97) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, and how often they occur.

    With ``typo``, a run whose crc32 with its document's id that number divides loses one letter. Null ids count
    as empty, null texts have no runs. Counts are combined in the task before they are shuffled.
    """
    def changed(word: str, prefix: int) -> str:
        h = zlib.crc32(word.encode(), prefix)
        return word if h % typo else word[:(at := h % len(word))] + word[at + 1:]

    def table(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def each(batches):
        held = Counter()
        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                said = text.as_buffer().to_pybytes().lower().decode() if text.is_valid else ""
                runs = Counter(RUN.findall(said) if len(said) < _LONG else (m.group() for m in RUN.finditer(said)))
                if typo:
                    prefix = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                    for word, n in runs.items():
                        held[changed(word, prefix)] += n
                else:
                    held.update(runs)
                if len(held) > _HELD:
                    yield table(held)
                    held = Counter()
        yield table(held)

    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(each, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """Words as code points laid end to end, each read forwards or backwards."""

    def __init__(self, words: list[str], backwards: bool):
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        if backwards:
            row = np.repeat(np.arange(len(words)), self.size)
            codes = codes[2 * self.start[row] + self.size[row] - 1 - np.arange(len(codes))]
        self.codes = codes


class Index:
    """An FM-index of words with a delimiter before each; ``step`` puts one symbol before what was matched."""

    def __init__(self, words: Words):
        self.symbols, inverse = np.unique(words.codes, return_inverse=True)
        self.count = len(words.size)
        self.rows = len(words.codes) + self.count
        text = np.zeros(self.rows, np.int64)
        row = np.repeat(np.arange(self.count), words.size)
        text[np.arange(len(words.codes)) + row + 1] = inverse + 1
        order = rotations(text)
        # Rows that start with a delimiter come first; this is the word behind each.
        heads = words.start + np.arange(self.count)
        self.word = np.searchsorted(heads, order[:self.count])
        self.before = text[order - 1]
        self.ranked = np.sort(self.before * self.rows + np.arange(self.rows))

    def symbol(self, codes: np.ndarray) -> np.ndarray:
        """The symbols of code points; a number beyond all for those that no word has."""
        at = np.searchsorted(self.symbols, codes)
        known = self.symbols[np.minimum(at, len(self.symbols) - 1)] == codes
        return np.where(known, at + 1, len(self.symbols) + 1)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol * self.rows
        return np.searchsorted(self.ranked, base + low), np.searchsorted(self.ranked, base + high)

    def choices(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, symbol) of what may stand before each interval: what does, for few rows, else any symbol."""
        letters = len(self.symbols)
        few = np.flatnonzero(high - low <= letters)
        size = (high - low)[few]
        row = np.repeat(few, size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]
        seen = np.unique(row * (letters + 1) + self.before[at])
        seen = seen[seen % (letters + 1) > 0]
        many = np.flatnonzero(high - low > letters)
        return (np.append(seen // (letters + 1), np.repeat(many, letters)),
                np.append(seen % (letters + 1), np.tile(np.arange(1, letters + 1), len(many))))


def rotations(text: np.ndarray) -> np.ndarray:
    """Where the sorted rotations of ``text`` start, by doubling the length they are sorted by."""
    rank, size = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (len(text) + 1) + np.roll(rank, -size)
        order = np.argsort(key, kind="stable")
        new = np.append(False, key[order][1:] != key[order][:-1])
        rank[order] = np.cumsum(new)
        size *= 2
        if rank[order[-1]] == len(text) - 1 or size > len(text):
            return order


def one_edit(index: Index, words: Words, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, found word) of words of the index exactly one edit away, the first ``exact`` letters read being equal.

    Each way to spend the error is tried where it gives a new word: a letter that repeats is dropped or
    doubled at the end of its run only, so no word is found twice by one query.
    """
    held = np.append(words.codes, 0)
    symbols = index.symbol(held)

    def at(query, place):
        inside = place < words.size[query]
        return np.where(inside, symbols[np.where(inside, words.start[query] + place, len(words.codes))], 0)

    query = np.arange(len(words.size))
    low, high = np.zeros(len(query), np.int64), np.full(len(query), index.count)
    spent = [np.zeros(0, np.int64)] * 4
    hits, turn = [], 0
    while len(query) or len(spent[0]):
        grown = [spent]
        open_ = turn >= exact[query]
        if open_.any():
            q, lo, hi = query[open_], low[open_], high[open_]
            here, following = at(q, np.int64(turn)), at(q, np.int64(turn + 1))
            drop = (here > 0) & (here != following)
            grown.append([q[drop], lo[drop], hi[drop], np.full(drop.sum(), turn + 1)])
            row, x = index.choices(lo, hi)
            other = x != here[row]
            row, x = row[other], x[other]
            a, b = index.step(x, lo[row], hi[row])
            some = b > a
            row, a, b = row[some], a[some], b[some]
            grown.append([q[row], a, b, np.full(len(row), turn)])
            inner = here[row] > 0
            grown.append([q[row[inner]], a[inner], b[inner], np.full(inner.sum(), turn + 1)])
        q, lo, hi, place = (np.concatenate(c) for c in zip(*grown, strict=True))
        symbol = at(q, place)
        lo, hi = index.step(symbol, lo, hi)
        ended = (symbol == 0) & (hi > lo)
        hits.append((q[ended], index.word[lo[ended]]))
        on = (symbol > 0) & (hi > lo)
        spent = [q[on], lo[on], hi[on], place[on] + 1]
        symbol = at(query, np.int64(turn))
        low, high = index.step(symbol, low, high)
        on = (symbol > 0) & (high > low)
        # A word that has been read to its end may still get a letter after it.
        query, low, high, turn = query[on], low[on], high[on], turn + 1
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


_FOUND = "word STRING, n BIGINT, n_near BIGINT, best STRUCT<less: BIGINT, word: STRING>"


def shard_search(words: pa.Table, queries: pa.Table) -> pa.Table:
    """For each query of a shard, how many of the shard's words are near and which of them leads.

    ``words`` and ``queries`` are (side, key, word, n). A word counts under the keys it is listed with.
    """
    asked = queries["word"].to_pylist()
    near = np.zeros(len(asked), np.int64)
    best_less, best_word = np.zeros(len(asked), np.int64), np.full(len(asked), None, object)
    if len(asked) and words.num_rows:
        coded = words["word"].combine_chunks().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        count = np.zeros(len(names), np.int64)
        count[code] = np.asarray(words["n"])
        order = np.empty(len(names), np.int64)
        order[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        keys, listed = np.unique(np.asarray(words["key"]), return_inverse=True)
        listed = np.unique(listed * len(names) + code)
        key = np.searchsorted(keys, np.asarray(queries["key"]))
        key = np.where(keys[np.minimum(key, len(keys) - 1)] == np.asarray(queries["key"]), key, len(keys))
        left = words["side"][0].as_py() == 0
        index = Index(Words(names, backwards=left))
        for at in range(0, len(asked), _BATCH):
            part = Words(asked[at:at + _BATCH], backwards=not left)
            exact = part.size // 2 if left else part.size - part.size // 2
            q, v = one_edit(index, part, exact)
            q = q + at
            pair = key[q] * len(names) + v
            spot = np.minimum(np.searchsorted(listed, pair), len(listed) - 1)
            mine = listed[spot] == pair
            if not left:
                # Those that share the first half too were found from the left.
                mine &= np.fromiter((not names[b].startswith(asked[a][:len(asked[a]) // 2])
                                     for a, b in zip(q.tolist(), v.tolist(), strict=True)), bool, len(q))
            q, v = q[mine], v[mine]
            near += np.bincount(q, minlength=len(asked))
            by = np.lexsort((order[v], -count[v], q))
            q, v = q[by], v[by]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
            best_less[q[first]] = -count[v[first]]
            best_word[q[first]] = [names[i] for i in v[first]]
    best = pa.StructArray.from_arrays([pa.array(best_less), pa.array(best_word.tolist(), pa.string())], ["less", "word"],
                                      mask=pa.array(near == 0))
    return pa.table({"word": queries["word"], "n": queries["n"], "n_near": pa.array(near), "best": best})


def neighbours(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, best): how many of the words are one edit away, and of those the one with the largest
    ``n``, the first in code-point order of equals, as (less: -n, word). ``words`` is (word, n), each word once.

    A word's halves are its first ``length / 2`` letters and the rest; words one letter longer or shorter are listed
    under the halves such queries have. A half with more than ``shard`` words is split into blocks that meet in
    pairs: exact, with work that grows with the square of such a group over ``shard``.
    """
    size = F.length("word")

    def half(side, length):
        part = F.left("word", F.floor(length / 2).cast("int")) if side == 0 else F.right("word", F.floor(length / 2).cast("int"))
        return F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side), part).alias("key"))

    queries = words.select("word", "n", F.inline(F.array(half(0, size), half(1, size + 1))))
    listed = words.select("word", "n", F.inline(F.array_distinct(F.array(
        *[half(side, size + side + more) for side in (0, 1) for more in (-1, 0, 1)]))))
    keys = saved(listed.groupBy("key").agg(F.count("*").alias("words")), "halves")
    total = keys.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    large = saved(keys.filter(F.col("words") > shard).select("key", F.ceil(F.col("words") / shard).alias("blocks")), "large-halves")
    shards = max(1, -(-total // (2 * shard)))

    def dealt(rows, across, along):
        rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn(across, F.pmod(F.xxhash64("word"), "blocks")).withColumn(
            along, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        key = F.xxhash64("key", "listed", "asked")
        # Named anew, since both sides come from the same words.
        return rows.select(*[F.col(c).alias(c) for c in ("side", "word", "n")], key.alias("key"),
                           (2 * F.pmod(key, F.lit(shards)) + F.col("side")).alias("shard"))

    found = (dealt(listed, "listed", "asked").groupBy("shard").cogroup(dealt(queries, "asked", "listed").groupBy("shard"))
             .applyInArrow(shard_search, _FOUND))
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, lead: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root): a word's form is the near word with the largest ``n``, if that is at least
    ``lead`` times its own; its root is where forms lead. Along forms ``n`` doubles, so there are no circles.

    ``words`` is (word, n), each word once and not null. No words give no rows.
    """
    better = -F.col("best.less") >= lead * F.col("n")
    forms = saved(neighbours(words).select(
        "word", "n", "n_near", F.when(better, F.col("best.word")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n")), "forms")
    roots = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = saved(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                 F.col("next").isNotNull().alias("moved")), "roots")
        roots = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return forms.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark, sf_dir):
    words = word_counts(documents(spark, sf_dir)).filter((F.length("word") >= 5) & (F.col("n") >= 3))
    return variants(saved(words, "words")).select("word", "form", "root", "n", "n_near", "form_n")


_TABLE = """(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) AS c FROM range(256) r(i)))"""

# Near words have a string in common that each of them is or becomes by losing one letter. What differs
# after the letters that agree at either end tells whether that is one edit.
OP11_SQL = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT {_TABLE} AS codes),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL HAVING length(run) >= 5),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c) - 64] END))),
  lambda a, b: xor(a >> 8, codes[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM each, t),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0
    THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT DISTINCT word, n, unnest(list_append(list_transform(range(length(word)::BIGINT),
    lambda i: substr(word, 1, i::INT) || substr(word, i::INT + 2)), word)) AS piece FROM words),
met AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.piece = b.piece AND a.word <> b.word
  AND abs(length(a.word) - length(b.word)) <= 1),
same AS (SELECT *, len(list_filter(range(1, least(length(word), length(near)) + 1), lambda i: substr(word, 1, i::INT) = substr(near, 1, i::INT))) AS head FROM met),
pairs AS (SELECT * FROM same WHERE CASE WHEN length(word) = length(near) THEN substr(word, head::INT + 2) = substr(near, head::INT + 2)
  WHEN length(word) < length(near) THEN substr(word, head::INT + 1) = substr(near, head::INT + 2)
  ELSE substr(word, head::INT + 2) = substr(near, head::INT + 1) END),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top, min(struct_pack(m := -near_n, w := encode(near)))['w'] AS lead FROM pairs GROUP BY 1),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN decode(b.lead) END AS form,
  CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n FROM words w LEFT JOIN best b USING (word)),
roots AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT r.word, f.form FROM roots r JOIN forms f ON f.word = r.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, n) AS root FROM (SELECT r.word, r.root, f.n FROM roots r JOIN forms f ON f.word = r.root) GROUP BY 1)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)"""
