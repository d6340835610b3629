import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lectern.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_words(rows, one_in):
    for d, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            yield run


def plain(rows, one_in=31, min_length=7, ratio=10):
    count = Counter(w for w in plain_words(rows, one_in) if len(w) >= min_length)
    n = {w: k for w, k in count.items() if k >= 2}
    form, out = {}, []
    for w in n:
        others = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form[w] = others[0] if others and n[others[0]] >= ratio * n[w] else None
        out.append((w, len(others)))
    got = []
    for w, k in out:
        root = w
        while form[root]:
            root = form[root]
        got.append((w, n[w], k, form[w], n.get(form[w]), root))
    return sorted(got)


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([6, 7, 8, 12]))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaaaa", "straße×÷ÿ", "ABCdefgh"]
    rows = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = rng.choice(base[: rng.choice([3, 10, len(base)])])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:]])
            words.append(w if rng.random() < 0.9 else w.upper())
        rows.append((i, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    return rows + [(None, rows[0][1]), (None, None), (3, ""), (4, "x " * 50), rows[1], rows[1], (70, "q" * 4000 + " " + "q" * 3999), (71, "q" * 4000 + " " + "q" * 3999)]


@pytest.mark.parametrize("one_in, ratio", [(31, 10), (3, 2), (None, 2)])
def test_against_all_pairs(spark, monkeypatch, one_in, ratio):
    monkeypatch.setattr(spelling, "PIECE", 300)
    rows = corpus(one_in or 5)
    docs = spark.createDataFrame([(d, t, "k", 1, "z") for d, t in rows], "doc_id long, text string, word string, rank long, root string")
    got = spelling.spelling_variants(docs, deletions=one_in, ratio=ratio).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain(rows, one_in, ratio=ratio)
    assert sorted(map(tuple, got)) == want
    assert any(r[3] for r in want) and any(r[5] != (r[3] or r[0]) for r in want if ratio == 2) or ratio == 10


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "short few")], docs.schema)).count() == 0


def test_long_chain_of_forms(spark):
    words = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdewyx", "abcdvwyx"]
    text = [(i, " ".join([w] * (2 * 3**i))) for i, w in enumerate(words)]
    docs = spark.createDataFrame(text, "doc_id long, text string")
    got = {r.word: r for r in spelling.spelling_variants(docs, ratio=3).collect()}
    assert {r.root for r in got.values()} == {words[-1]} and got[words[0]].form == words[1] and got[words[-1]].form is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abÿ😀", min_size=2, max_size=7), min_size=2, max_size=30, unique=True))
def test_keys_meet_once_for_near_words_only(words):
    k1, k2, part, rank = spelling.group_rows(words, np.arange(len(words)), 1)
    groups = {}
    for a, b, p, r in zip(k1.tolist(), k2.tolist(), part.tolist(), rank.tolist()):
        groups.setdefault((a, b), []).append((p, r))
    met = Counter()
    for members in groups.values():
        for p, r in members:
            for q, s in members:
                if r < s and (p == q == spelling.WILDCARD or {p, q} == {spelling.ITSELF, spelling.SHORTENED}):
                    met[r, s] += 1
    want = {(i, j): 1 for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])}
    assert met == want
