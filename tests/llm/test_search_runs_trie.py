"""Nearest vectors, periodic runs and the prefix trie against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from bankrec.llm import collision_search, periodic_runs, prefix_trie, queries
from bankrec.llm.recompression import Grammar

VECTORS = "vec_id long, embedding array<float>, query_id long, rank string, block string, part string, kind string"


def _every():
    return F.col("vec_id") % 20 == 0


def _nearest(rows, k):
    """By the inner product of all pairs."""
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept[i] = max(kept.get(i, v), v)
    size = max(map(len, kept.values()))
    ids = np.array(sorted(kept))
    x = np.array([list(np.float32(kept[i])) + [0] * (size - len(kept[i])) for i in ids.tolist()], float)
    out = set()
    for q in range(len(ids)):
        if ids[q] % 20 == 0:
            scores = x @ x[q]
            order = [j for j in np.lexsort((ids, -scores.round(12))) if j != q][:k]
            out |= {(int(ids[q]), n, int(ids[j]), round(float(scores[j]), 9)) for n, j in enumerate(order, 1)}
    return out


def _search(spark, rows, k):
    df = spark.createDataFrame([(i, v, 1, *"abcd") for i, v in rows], VECTORS)
    got = collision_search.nearest(df, _every(), k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()}


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (None, [9.0, 9.0]), (8, []), (9, [1.0]), (20, [-1.0, 3.0]), (20, [-1.0, 3.0]), (10, [0.5, 0.5, 9.0])]
    assert _search(spark, rows, 3) == _nearest(rows, 3)
    assert _search(spark, rows, 50) == _nearest(rows, 50)          # fewer rows than asked for
    assert _search(spark, rows[3:9], 3) == set()
    assert collision_search.nearest(spark.createDataFrame([], VECTORS), _every()).count() == 0


def test_vectors_of_all_lengths_and_a_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24) * rng.lognormal()) for i in range(700)]
    rows += [(1000 + i, np.float32([0.5] * 24)) for i in range(300)]                        # equal vectors
    rows += [(2000 + i, np.float32([0.5] * 24) + rng.normal(size=24) * 0.01) for i in range(300)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    got, want = _search(spark, rows, 20), _nearest(rows, 20)
    assert len(got) == len(want) and len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.98 * len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall(spark, sf):
    df = queries.table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {(r.query_id, r.vec_id) for r in collision_search.nearest(df, _every(), 20).collect()}
    want = {w[::2][:2] for w in _nearest(rows, 20)}
    assert len(got & want) >= 0.95 * len(want)


def _runs(words, least, times):
    best = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def _words(text):
    return [w for w in re.split(r"[ \t-\r]+", text or "") if w]


def test_extensions_of_a_grammar():
    rng = random.Random(5)
    for _ in range(30):
        text = [0] + [rng.choice([2, 3, 3, 4]) for _ in range(rng.randint(2, 80))] * rng.randint(1, 3) + [1]
        grammar, n = Grammar(np.array(text)), len(text)
        a, b = np.array([(i, j) for i in range(1, n - 1) for j in range(i + 1, n - 1)]).T
        ahead, back = grammar.common(a, b), grammar.common(a, b, back=True)
        for i, j, right, left in zip(a.tolist(), b.tolist(), ahead.tolist(), back.tolist()):
            assert text[i:i + right] == text[j:j + right] and text[i + right] != text[j + right]
            assert text[i - left + 1:i + 1] == text[j - left + 1:j + 1] and text[i - left] != text[j - left]


def _periodic_texts():
    rng = random.Random(9)
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", "x  y z\n" * 5, "word " * 4000,
           "😀 é\x00 " * 9, "a a a a a a"]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    return out


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (5, 3)])
def test_runs(spark, least, times):
    texts = _periodic_texts()
    df = spark.createDataFrame([(i if i % 7 else None, t, "r", "c") for i, t in enumerate(texts)],
                               "doc_id long, text string, runs string, collapsed string")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.detect(df, least, times).collect()]
    want = []
    for i, t in enumerate(texts):
        words, runs = _words(t), _runs(_words(t), least, times)
        gone = {p for s, n, q in runs for p in range(s + q, s + n)}
        want.append((i if i % 7 else None, runs, " ".join(w for p, w in enumerate(words) if p not in gone)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs.detect(df.where("false")).count() == 0


def test_runs_query(spark, tmp_path):
    texts = _periodic_texts() + ["one two three four five six seven eight nine ten " * 3] * 60
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for i, t in enumerate(texts):
        words, h = _words(t), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        runs = _runs(words, 6, 4)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert changed > 3


def _trie(convs):
    """Nodes of ``{conv_id: [(role, text), ...]}``."""
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved, out = {}, {}, []
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) if children[n] else 1
        saved[n] = sum(saved[k] for k in children[n]) + ((len(members[n]) - 1) * len(_words(n[-1][1])) if n else 0)
        ends = sorted(c for c in members[n] if len(convs[c]) == len(n))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n],
                    saved[n], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def _conversations(rows):
    told = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            told[c].append((t is not None, t or 0, digest, role, text))
    return {c: [(role, text) for *_, role, text in sorted(v)] for c, v in told.items()}


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, partitions", [(1, 1), (2, 4), (3, 23), (4, 23)])
def test_trie(spark, tmp_path, seed, partitions):
    rng = random.Random(seed)
    rows = [(None, 1, "u", "x"), (40, None, None, None), (40, None, "u", ""), (61, 0, "u", "x")]
    for c in range(100, 100 + rng.choice([30, 150])):
        if rng.random() < 0.8:
            for k in range(rng.randint(1, 9)):
                text = rng.choice(["x y", "", "z\n\tw", None]) if rng.random() < 0.3 else "x y"
                rows.append((c, rng.choice([k, k, k, None]), rng.choice(["u", "a", None]) if rng.random() < 0.1 else "u", text))
    spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("o") for c in ("turns", "lead", "base", "key", "block")}
                                                   ).write.parquet(f"{tmp_path}/conversations.parquet")
    own = _conversations(rows)
    convs = {c: own.get(c - c % 20, [])[:zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4:] for c, v in own.items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = queries.op13_prefix_trie(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r) for r in got), key=str) == _trie(convs)


def test_trie_of_copies_and_of_nothing(spark):
    """A group of copies fills many blocks; its ids are one list."""
    rows = [(c, t, "u", "same words") for c in range(300) for t in range(3)] + [(300, 0, "u", "same words"), (301, 0, "u", "else")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 17)
    try:
        got = prefix_trie.nodes(prefix_trie.sequences(spark.createDataFrame(rows, TURNS))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r) for r in got), key=str) == _trie(_conversations(rows))
    assert prefix_trie.nodes(prefix_trie.sequences(spark.createDataFrame([], TURNS))).count() == 0
    alone = prefix_trie.nodes(spark.createDataFrame([(7, [])], "conv_id long, turns array<struct<key: binary, n_words: int>>"))
    assert [tuple(r)[:7] for r in alone.collect()] == [(7, 0, None, 1, 0, 1, 0)]
