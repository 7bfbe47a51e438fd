"""Periodic runs against a scan of every lag."""

import hashlib
import random
import zlib

import pytest

from taxrecon.llm import periodic_runs as M


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out)


def expected(doc_id, text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    from fractions import Fraction

    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digests = ["".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(w for i, w in enumerate(words) if i not in drop)]
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in digests))


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_a_scan_of_all_lags(seed):
    r = random.Random(seed)
    for _ in range(1500):
        n, k = r.randrange(70), r.choice([1, 2, 3, 5, 9])
        words = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randrange(3)):
            if n > 8:
                a, p = r.randrange(n), r.randrange(1, 9)
                for i in range(a + p, min(n, a + p * r.randrange(2, 9))):
                    words[i] = words[i - p]
        assert M.runs_of(words) == brute(words)


def test_hashes_that_agree_by_chance_are_compared_by_word(monkeypatch):
    monkeypatch.setattr(M, "_BASE", M.np.uint64(1))  # sums of words: any order of a block looks the same
    r = random.Random(5)
    for _ in range(600):
        words = [r.randrange(2) for _ in range(r.randrange(60))]
        assert M.runs_of(words) == brute(words)


def test_segments_split_until_stable():
    # c is rare; without the words beyond it, a is; then b's runs are too short.
    words = [1, 2] * 3 + [3] + [1, 2]
    assert M.surviving(M.np.array(words)) == []
    assert M.surviving(M.np.array([7] + [1, 2] * 4 + [8])) == [(1, 9)]
    assert M.surviving(M.np.array([], int)) == []


def test_long_texts_take_bounded_time():
    n = 120_000
    assert M.runs_of([0] * n) == [(0, n, 1)]
    assert M.runs_of([i % 5000 for i in range(n)]) == [(0, n, 5000)]
    assert M.runs_of([x for k in range(n // 4) for x in (k, k, k, k + 1)]) == []


def test_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(expected(*d) for d in docs)
    got = sorted(tuple(r) for r in M.op12_periodic_runs(spark, sf_dir).collect())
    assert got == want and any(r[1] for r in got)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a " * 9), (4, "   x y "), (5, "b\tb\nb\x0bb\x0cb\rb b"), (5, "b\tb\nb\x0bb\x0cb\rb b"), (10, "a b c d e f g h i j")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id bigint, text string, n_runs int, length string")
    got = sorted((tuple(r) for r in M.periodic_runs(docs, M.with_tail).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)
    assert M.periodic_runs(docs.limit(0)).collect() == []
    kept = {r["doc_id"]: r["text"] for r in M.without_runs(docs).collect()}
    assert kept[1] is None and kept[2] == "" and kept[5] == "b" and kept[None] == "a" and kept[4] == "   x y "
