from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from lakemeta.llm.spelling import Index, Words, neighbours, one_edit, op11_spelling_variants, variants, word_counts


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[head + (len(a) >= len(b)):] == b[head + (len(b) >= len(a)):]


def expected(words: dict[str, int]) -> set[tuple]:
    forms, sizes = {}, {}
    for word, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(word, v))
        sizes[word] = len(close)
        if close and -close[0][0] >= 2 * n:
            forms[word] = close[0][1]
    out = set()
    for word, n in words.items():
        root = word
        while root in forms:
            root = forms[root]
        out.add((word, forms.get(word), root, n, sizes[word], words[forms[word]] if word in forms else None))
    return out


def counted(rows) -> Counter:
    words = Counter()
    for id_, text in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            words[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return words


def found(df) -> set[tuple]:
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgé"])
def test_searches_find_each_near_word_once(letters):
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(150)})
    for left in (True, False):
        part = Words(words, backwards=not left)
        q, v = one_edit(Index(Words(words, backwards=left)), part, part.size // 2 if left else part.size - part.size // 2)
        want = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words)
                if near(a, b) and (b.startswith(a[:len(a) // 2]) if left else b.endswith(a[len(a) // 2:]))]
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == want


@pytest.mark.parametrize("shard", [4, 1 << 14])
def test_variants_equal_all_pairs(spark, shard, monkeypatch):
    """Also where a half is shared by far more words than a shard takes; chains of forms, ties, repeated letters."""
    rng = random.Random(5)
    words = {"thing" + "".join(rng.choice("abz") for _ in range(rng.randint(0, 5))): rng.randint(3, 60) for _ in range(150)}
    words |= {"colour": 100, "color": 40, "colur": 5, "colouur": 5, "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24,
              "éàüöä": 9, "éàüöà": 3, "tieab": 10, "tieac": 10, "tieaz": 5, "x" * 300: 3, "x" * 299: 7}
    df = spark.createDataFrame(list(words.items()), "word STRING, n BIGINT").repartition(3)
    monkeypatch.setattr("lakemeta.llm.spelling.neighbours", lambda w: neighbours(w, shard))
    assert found(variants(df)) == expected(words)
    assert found(variants(df.limit(0))) == set()


def test_registered_query(spark, tmp_path, awkward):
    rng = random.Random(8)
    stems = ["therein", "wholly", "Éclair", "straße", "NAÏVE", "colour"]
    said = lambda: " ".join(w if rng.random() > 0.3 else w[:2] + w[3:] for w in rng.choices(stems, k=30))
    rows = [(i, said()) for i in range(60)] + [(r.doc_id, r.text) for r in awkward.collect()] + [(None, said()), (3, "×÷abc_def-ghi9jkl")]
    spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id BIGINT, text STRING, word INT, `a.b` INT").write.parquet(str(tmp_path / "documents.parquet"))
    words = {w: n for w, n in counted(rows).items() if len(w) >= 5 and n >= 3}
    assert found(op11_spelling_variants(spark, str(tmp_path))) == expected(words)


def test_word_counts_without_typos(spark, awkward, no_documents):
    plain = {r.word: r.n for r in word_counts(awkward, typo=None).collect()}
    assert plain["ab"] == 400 and plain["x" * 5000] == 1
    assert word_counts(no_documents).count() == 0
