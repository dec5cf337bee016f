from __future__ import annotations

import hashlib
import random
import re

import pytest
from helpers import AWKWARD, docs

from dqspark.llm import queries, substrings

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, size=13):
    """(n_words, kept words) of each (key, text): a window's words go if it starts under a smaller key; None is the largest."""
    first = {}
    for key, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            run = tuple(w[i : i + size])
            if key is not None and (run not in first or key < first[run]):
                first[run] = key
    out = []
    for key, text in rows:
        w = words(text)
        gone = {i + j for i in range(len(w) - size + 1) if (f := first.get(tuple(w[i : i + size]))) is not None and (key is None or f < key) for j in range(size)}
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def some_texts(draw, n):
    word = lambda: draw.choice(["the", "of", "a", *(f"w{i}" for i in range(60))])
    run = lambda k: [word() for _ in range(k)]
    shared = [run(draw.choice([5, 12, 13, 14, 30])) for _ in range(6)]
    base = run(80)
    texts = []
    for _ in range(n):
        parts = run(draw.randrange(30))
        for _ in range(draw.randrange(4)):
            cut = draw.choice(shared)
            parts += cut[draw.randrange(3) :] + run(draw.randrange(4))
        if draw.random() < 0.3:  # a near copy
            copy = list(base)
            copy[draw.randrange(80)] = word()
            parts = copy
        texts.append(draw.choice([" ", "\n", "  \t"]).join(parts))
    return texts


@pytest.mark.parametrize(("shard", "hot"), [(substrings.SHARD, substrings.HOT), (16, 4)])
def test_equals_brute_force(spark, monkeypatch, shard, hot):
    texts = some_texts(random.Random(1), 150) + AWKWARD + ["the " * 400, "the of " * 150, "x " * 12, "x " * 13, "x " * 13]
    monkeypatch.setattr(substrings.repeats, "__defaults__", (13, shard, hot))
    given = docs(spark, texts)
    want = brute(list(enumerate(texts)))
    got = {r.doc_id: r for r in substrings.dedup(given).collect()}
    assert len(got) == len(texts)
    for i, (n, kept) in enumerate(want):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (n, n - len(kept), " ".join(kept)), i
        assert sum(s.end - s.start for s in got[i].spans) == got[i].n_removed
        assert all(a.end < b.start for a, b in zip(got[i].spans, got[i].spans[1:], strict=False))
    made = {r.doc_id: r for r in substrings.digests(given).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in made.items()} == {i: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for i, r in got.items()}
    assert sum(r.n_removed > 0 for r in got.values()) > 50


def test_null_and_repeated_keys_and_text_keys(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(None, a), (None, a), ("k", a), ("k", a), ("k", f"{a} {b}"), ("l", b), (None, c), (None, c), ("m", f"so {c}"), ("n", f"so {c}"), ("n", f"so {c}"), (None, None), ("z", "")]
    given = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((str(r.doc_id), r.n_words, r.kept_text) for r in substrings.dedup(given).collect())
    assert got == sorted((str(k), n, " ".join(kept)) for (k, _), (n, kept) in zip(rows, brute(rows), strict=True))
    assert substrings.dedup(given.limit(0)).count() == 0 and substrings.digests(given.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.repeated_substrings(spark, SF).collect()}
    assert len(got) == len(rows)
    for (key, _), (n, kept) in zip(rows, brute(rows), strict=True):
        assert (got[key].n_words, got[key].n_removed, got[key].kept_sha256) == (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_pieces_hold_every_window_once_with_a_seed_of_its_own_words():
    draw, size = random.Random(2), 13
    lists = [[draw.choice([b"a", b"b", b"c", b"dd"]) for _ in range(draw.choice([0, 3, 12, 13, 14, 200]))] for _ in range(60)]
    held = substrings.Words([draw.choice([b" ", b"\n "]).join(w) for w in lists], substrings.Powers())
    assert held.counts.tolist() == [len(w) for w in lists]
    before = [sum(map(len, lists[:i])) for i in range(len(lists))]
    seen, seed_of = [], {}
    for o, s, word, n in zip(*(c.tolist() for c in substrings.pieces(held, size)), strict=True):
        assert n <= size - substrings.RUN + 1 and held.line(word, word + size) == b" ".join(lists[o][word - before[o] :][:size])
        at = word - before[o]
        for i in range(at, at + n):
            seen.append((o, i))
            assert seed_of.setdefault(tuple(lists[o][i : i + size]), s) == s
    assert sorted(seen) == [(o, i) for o, w in enumerate(lists) for i in range(len(w) - size + 1)]


def test_automaton_equals_brute_force():
    draw = random.Random(3)
    for size in (1, 3, 4):
        lists = [[draw.choice("ab") for _ in range(draw.randrange(12))] for _ in range(30)]
        keys = [draw.choice([None, *range(9)]) for _ in lists]
        order = lambda k: (k is None, k)
        got = substrings.first_keys([" ".join(w).encode() for w in lists if w], [k for w, k in zip(lists, keys, strict=True) if w], size)
        full = [(w, k) for w, k in zip(lists, keys, strict=True) if w]
        for (w, _), found in zip(full, got, strict=True):
            want = [min((k for v, k in full for j in range(len(v) - size + 1) if v[j : j + size] == w[i : i + size]), key=order) for i in range(len(w) - size + 1)]
            assert found == want
