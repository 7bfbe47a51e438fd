import hashlib
import itertools
import random
from collections import defaultdict

import pytest

from taxrecon.llm import exact_dedup, line_dedup, near_dedup, sentence_dedup


def frame(spark, rows, extra="kept string"):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], f"doc_id bigint, text string, {extra}")


# Exact dedup


def test_cuckoo_index():
    index, live = exact_dedup.CuckooIndex(4), set()
    r = random.Random(1)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(12_000):
        k = r.choice(keys)
        if r.random() < 0.7:
            assert index.insert(k)[1] == (k not in live)
            live.add(k)
        else:
            assert index.delete(k) == (k in live)
            live.discard(k)
    assert index.resizes > 0 and index.live == len(live)
    assert all((index.find(k) >= 0) == (k in live) for k in keys)


def test_fingerprint_hits_are_verified():
    index = exact_dedup.CuckooIndex(16)
    a = bytes(32)
    b = bytes(10) + b"x" * 22  # same place and fingerprint, another digest
    assert index.insert(a)[1] and index.find(b) == -1 and index.insert(b)[1]
    assert index.delete(a) and index.find(b) >= 0 and index.find(a) == -1


def test_hits_are_verified_on_the_content():
    index, digest = exact_dedup.CuckooIndex(16), hashlib.sha256(b"one").digest()
    assert index.insert(digest, "one") == (0, True) and index.insert(digest, "one") == (0, False)
    # Another text under the same digest is another text.
    assert index.find(digest, "two") == -1 and index.insert(digest, "two") == (1, True)
    assert index.delete(digest, "one") and index.find(digest, "one") == -1 and index.find(digest, "two") == 1
    full = exact_dedup.CuckooIndex(1)
    texts = [f"text {i}" for i in range(500)]
    for t in texts:
        full.insert(hashlib.sha256(t.encode()).digest(), t)
    assert full.resizes and [full.find(hashlib.sha256(t.encode()).digest(), t) for t in texts] == list(range(500))


def test_exact_edges(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (4, None), (5, ""), (6, " \t\n"), (7, "ü"), (None, "ü"), (2, "a  b"), (8, "a b")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert got == {(3, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 2, True), (None, 7, 2, False), (8, 8, 1, True)}
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_index_changes(spark):
    index = exact_dedup.index_digests(exact_dedup.digests(frame(spark, [(1, "a"), (2, "a"), (3, "b")])))
    ins, gone = exact_dedup.digests(frame(spark, [(9, "c"), (0, "a")])), exact_dedup.digests(frame(spark, [(3, "b"), (1, "a"), (5, "zz")]))
    rows = {r["digest"]: (r["group_size"], r["keep_id"]) for r in exact_dedup.change_index(index, ins, gone).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == {sha("a"): (2, 0), sha("c"): (1, 9)}


def test_an_index_of_many_shards_takes_no_digest_twice(spark):
    rows = exact_dedup.digests(frame(spark, [(i, f"text{i}") for i in range(60)]))
    index = exact_dedup.index_digests(rows, shard_rows=3)
    again = exact_dedup.change_index(index, rows, None, shard_rows=3)
    assert again.count() == again.select("digest").distinct().count() == 60 and {r["group_size"] for r in again.collect()} == {2}
    more = exact_dedup.change_index(again, exact_dedup.digests(frame(spark, [(i, f"text{i}") for i in range(300)])), rows, shard_rows=3)
    assert more.count() == 300 and sorted(r["group_size"] for r in more.collect()) == [1] * 240 + [2] * 60


def test_a_deleted_keeper_is_replaced_by_a_live_one(spark):
    index = exact_dedup.index_digests(exact_dedup.digests(frame(spark, [(1, "a b"), (2, "ab"), (3, "a b"), (4, "c")])))
    gone, live = exact_dedup.digests(frame(spark, [(1, "a b")])), exact_dedup.digests(frame(spark, [(2, "ab"), (3, "a b"), (4, "c")]))
    got = {(r["group_size"], r["keep_id"], r["keep_len"]) for r in exact_dedup.change_index(index, None, gone, live).collect()}
    assert got == {(2, 3, 3), (1, 4, 1)}
    assert {(r["group_size"], r["keep_id"]) for r in exact_dedup.change_index(index, None, gone).collect()} == {(2, None), (1, 4)}


def test_long_and_hot_texts(spark):
    rows = [(i, "hot text") for i in range(3000)] + [(5000 + i, f"t{i}") for i in range(3000)] + [(9000, "x y " * 200_000), (9001, "xy" * 200_000)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert got[7] == (0, 3000, False) and got[0] == (0, 3000, True) and got[5001] == (5001, 1, True)
    assert got[9000] == (9000, 2, True) and got[9001] == (9000, 2, False) and len(got) == len(rows)


def test_exact_query(spark, sf_dir, same):
    same(exact_dedup.op3_exact_dedup(spark, sf_dir), exact_dedup.OP3_SQL)


def test_index_changes_query(spark, sf_dir, same, tmp_path):
    same(exact_dedup.exact_index_changes(spark, sf_dir), exact_dedup.EXACT_INDEX_CHANGES_SQL)
    schema = "doc_id bigint, text string, source string, digest string, content int"
    rows = [(1, "a b", "first"), (2, "ab", "then"), (3, "a  b", "then"), (4, None, None), (5, " ", "first"), (None, "n", "mid"), (6, "n", "then"), (7, "only", "then"), (8, "ab", "first"), (8, "ab", "first"), (9, "long " * 50_000, "mid")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["group_size"], r["keep_len"], r["keep_id"]) for r in exact_dedup.exact_index_changes(spark, str(tmp_path)).collect()}
    assert got == {(3, 3, 1), (2, 1, 5), (1, 1, None), (1, 250_000, 9)}
    for name, some in (("one", [(1, "a", "s")]), ("none", [])):
        spark.createDataFrame([(*r, "x", 1) for r in some], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert exact_dedup.exact_index_changes(spark, f"{tmp_path}/{name}").count() == 0


# Line dedup


def brute_lines(rows, width=3):
    first, occurs = {}, []
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        full = [(n, x.strip(" \t\r\x0b\x0c")) for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
        for k in range(len(full) - width + 1):
            body = tuple(x for _, x in full[k : k + width])
            occurs.append((i, t, full[k][0], full[k + width - 1][0], body))
            first.setdefault(body, (i, t, full[k][0]))
    gone = defaultdict(set)
    for i, t, a, b, body in occurs:
        if first[body] != (i, t, a):
            gone[i, t].update(range(a, b + 1))
    return [(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t])) for i, t in rows]


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choices(["a", "b", " c ", "", "d\t", "e"], k=r.randint(0, 25)))) for i in range(60)]
    rows += [(None, rows[0][1]), (1000, None), (1001, ""), (7, rows[7][1]), (1002, "x\n" * 50), (1003, "long " * 20_000 + "\nb\nc\nq")]
    got = sorted(((x["doc_id"], x["text"]) for x in line_dedup.line_dedup(frame(spark, rows, "n_lines string")).collect()), key=repr)
    assert got == sorted(brute_lines(rows), key=repr)
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_hot_windows(spark):
    rows = [(i, f"a{i}\nx\ny\nz\nb{i}") for i in range(400)] + [(1000 + i, f"p{i % 150}\nq{i % 150}\nr{i % 150}") for i in range(300)]
    got = sorted(((x["doc_id"], x["text"]) for x in line_dedup.line_dedup(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(brute_lines(rows), key=repr)


def test_lines_query(spark, sf_dir, same):
    same(line_dedup.op2_line_dedup(spark, sf_dir), line_dedup.OP2_SQL)


def test_lines_plan_is_native(spark, sf_dir):
    plan = line_dedup.op2_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# Sentence dedup


def brute_spans(sizes, few=2, words=20, alone=50):
    out, n = set(), len(sizes)
    fits = lambda a, b: (b - a + 1 >= few and sum(sizes[a : b + 1]) >= words) or (a == b and sizes[a] >= alone)
    for i in range(n):
        out |= {(i, e) for e in [next((e for e in range(i, n) if fits(i, e)), None)] if e is not None}
        out |= {(s, i) for s in [next((s for s in range(i, -1, -1) if fits(s, i)), None)] if s is not None}
    return sorted(out)


def test_spans():
    r = random.Random(2)
    for _ in range(500):
        sizes = [r.choice([1, 2, 3, 6, 10, 18, 25, 49, 50, 60]) for _ in range(r.randint(0, 12))]
        assert sentence_dedup.spans(sizes) == brute_spans(sizes)


def test_every_sentence_of_a_repeated_run_is_covered():
    """Spans are the shortest runs alone; together they cover each longer run of enough sentences and words."""
    r = random.Random(3)
    for _ in range(2000):
        sizes = [r.choice([1, 2, 5, 9, 15, 19, 30]) for _ in range(r.randint(2, 12))]
        a = r.randrange(len(sizes) - 1)
        b = r.randrange(a + 1, len(sizes))
        if sum(sizes[a : b + 1]) >= 20:
            inside = [s for s in sentence_dedup.spans(sizes) if a <= s[0] and s[1] <= b]
            assert set(range(a, b + 1)) == {i for s in inside for i in range(s[0], s[1] + 1)}


def test_texts_without_spaces(spark):
    r = random.Random(4)
    say = lambda n: "".join(r.choice("天地玄黃宇宙洪荒日月盈昃辰宿列張") for _ in range(n)) + "。"
    passage = "".join(say(12) for _ in range(4))
    rows = [(i, say(15) + passage + say(11)) for i in range(4)]
    out = {x["doc_id"]: x["text"] for x in sentence_dedup.sentence_dedup(frame(spark, rows)).collect()}
    assert out[0] == rows[0][1] and all(passage not in out[i] and len(out[i]) == 28 for i in (1, 2, 3))
    base = say(300)
    near = [(1, base), (2, base[:150] + base[151:]), (3, say(300))]
    classes = lambda **kw: {x["doc_id"]: x["class_id"] for x in near_dedup.jaccard_classes(frame(spark, near), **kw).collect()}
    assert classes() == {1: 1, 2: 2, 3: 3} and classes(characters=True) == {1: 1, 2: 1, 3: 3}


def test_sentence_shards(spark, monkeypatch):
    r = random.Random(7)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(50)]
    rows = [(i, " ".join(" ".join(r.choices(words, k=r.randint(3, 12))).capitalize() + "." for _ in range(r.randint(0, 30)))) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1] + " " + rows[i % 11][1]) for i in range(40)]
    monkeypatch.setattr(sentence_dedup, "SHARD_CHARS", 500)
    monkeypatch.setattr(sentence_dedup, "BATCH_CHARS", 900)
    out = sentence_dedup.sentence_dedup(frame(spark, rows)).collect()
    assert sorted(((x["doc_id"], (x["text"] or "").split()) for x in out), key=repr) == brute_sentences(rows)


def brute_sentences(rows):
    first, gone, occurs = {}, defaultdict(set), []
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        for a, b, h1, h2 in sentence_dedup.text_spans(t):
            occurs.append((i, t, a, b, h1, h2))
            first.setdefault((h1, h2), (i, t, a))
    for i, t, a, b, h1, h2 in occurs:
        if first[h1, h2] != (i, t, a):
            gone[i, t].update(range(a, b))
    return sorted(((i, "".join(c for n, c in enumerate(t or "") if n not in gone[i, t]).split()) for i, t in rows), key=repr)


def test_sentences_against_brute_force(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(300)]
    sentence = lambda: " ".join(r.choices(words, k=r.randint(1, 15))).capitalize() + r.choice([".", "!", "?"])
    passage = " ".join(sentence() for _ in range(9))
    rows = [(i, " ".join([*(sentence() for _ in range(4)), *([passage] if i % 3 == 0 else []), *(sentence() for _ in range(4))])) for i in range(30)]
    rows += [(100, passage), (101, None), (102, ""), (None, passage), (3, rows[3][1]), (103, passage + " " + passage), (104, "no end " * 5000)]
    out = sentence_dedup.sentence_dedup(frame(spark, rows, "n_spans string")).collect()
    assert sorted(((x["doc_id"], (x["text"] or "").split()) for x in out), key=repr) == brute_sentences(rows)
    kept = {x["doc_id"]: x["text"] for x in out}
    assert passage in kept[0] and kept[100] == "" and all(passage[10:200] not in (kept[i] or "") for i in range(3, 30, 3))
    assert all(kept[i] == rows[i][1] for i in range(30) if i % 3)
    assert sentence_dedup.sentence_dedup(frame(spark, [])).count() == 0


def test_sentence_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["text"].split()) for r in sentence_dedup.op9_sentence_dedup(spark, sf_dir).collect()), key=repr)
    assert got == brute_sentences(docs)


# Near dedup


def shingles(t, n=5):
    w = (t or "").lower().split()
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_classes(docs, threshold=0.8):
    """set_id, class_id, links by set, from all pairs."""
    sets = defaultdict(list)
    for i, t in docs:
        sets[shingles(t)].append(i)
    sets.pop(frozenset(), None)
    reps = [(min(v), s) for s, v in sets.items()]
    parent, links = {i: i for i, _ in reps}, defaultdict(int)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, (_, s) in enumerate(reps):
        for g in s:
            index[g].append(k)
    pairs = defaultdict(int)
    for v in index.values():
        for p in itertools.combinations(v, 2):
            pairs[p] += 1
    for (a, b), both in pairs.items():
        if both >= threshold * (len(reps[a][1]) + len(reps[b][1]) - both) - 1e-9:
            links[reps[a][0]] += 1
            links[reps[b][0]] += 1
            x, y = root(reps[a][0]), root(reps[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: (min(v), root(min(v)), links[min(v)]) for s, v in sets.items() for i in v}


def test_bands():
    for recall in (0.9, 0.99, 0.999):
        b = near_dedup.bands_for(0.8, recall, 4)
        assert 1 - (1 - 0.8**4) ** b >= recall > 1 - (1 - 0.8**4) ** (b - 1)


@pytest.mark.parametrize("block", [4, 256])
def test_near_against_brute_force(spark, block):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]
    base = [r.choices(words, k=120) for _ in range(8)]
    docs = []
    for i in range(160):
        w = list(base[i % 8])
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "one two"), (503, "one two"), (504, "One  TWO"), (9, docs[9][1])]
    got = {x["doc_id"]: (x["set_id"], x["class_id"], x["n_links"]) for x in near_dedup.jaccard_classes(frame(spark, docs, "class_id string"), recall=0.999999, block=block).collect()}
    want = brute_classes(docs) | {500: (500, 500, 0), 501: (501, 501, 0)}
    assert got == want


def test_near_edges(spark):
    rows = near_dedup.jaccard_classes(frame(spark, [(None, "a b c"), (1, "a b c"), (None, None)])).collect()
    assert sorted(((x["doc_id"], x["class_id"], x["n_links"]) for x in rows), key=repr) == sorted([(None, None, 0), (1, 1, 0), (None, None, 0)], key=repr)
    assert near_dedup.jaccard_classes(frame(spark, [])).count() == 0
    # A key with two texts is one document.
    rows = near_dedup.jaccard_classes(frame(spark, [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l")])).collect()
    assert len(rows) == 3 and len({x["class_id"] for x in rows if x["doc_id"] == 1}) == 1


def test_every_text_of_a_key_links(spark):
    """A document with several texts links by each of them; two sets may share their smallest document."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(words[i : i + 20]) for i in (0, 20, 40))
    near_a, near_b = a.replace("w19", "x"), b.replace("w39", "y")
    docs = [(1, a), (1, b), (2, near_a), (3, near_b), (4, b), (5, c)]
    got = {(x["doc_id"]): (x["class_id"], x["n_links"], x["n_linked_docs"]) for x in near_dedup.jaccard_classes(frame(spark, docs), recall=0.9999999).collect()}
    # 1 links to 2 by one text, to 3 by the other, which 4 has as well.
    assert got == {1: (1, 2, 3), 2: (1, 1, 1), 3: (1, 1, 2), 4: (1, 1, 2), 5: (5, 0, 0)}
    # A key with a third of all rows, each another text, and copies of it.
    hot = [(7, f"{a} tail {i}") for i in range(60)] + [(8 + i, f"t{i} " + " ".join(words[: i % 40])) for i in range(120)] + [(7, f"{a} tail 3")] * 5
    rows = near_dedup.jaccard_classes(frame(spark, hot), recall=0.9999999, block=8).collect()
    assert len(rows) == len(hot) and len({(x["set_id"], x["class_id"], x["n_links"]) for x in rows if x["doc_id"] == 7}) == 1


def test_scripts_without_spaces_find_their_near_copies(spark):
    text = "".join(chr(0x4E00 + i * 37 % 900) for i in range(200))
    docs = [(1, text), (2, text[:100] + "\u4e00" + text[101:]), (3, text[::-1]), (4, "plain Latin text without copies"), (5, "नमस्ते " * 3)]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.jaccard_classes(frame(spark, docs), characters=None).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_sizes_part_the_blocks(spark):
    """Texts that share half of their n-grams but differ in size meet in buckets; the sizes decide which blocks meet."""
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(600)]
    base = r.choices(words, k=400)
    docs = [(i, " ".join(base[: r.randint(20, 400)])) for i in range(150)]
    got = {x["doc_id"]: (x["set_id"], x["class_id"], x["n_links"]) for x in near_dedup.jaccard_classes(frame(spark, docs), recall=0.9999999, rows=2, block=5).collect()}
    assert got == brute_classes(docs)


def test_components_end_with_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)], "u bigint, v bigint")
    assert {x["class"] for x in near_dedup.components(chain).collect()} == {0}
    hub = spark.createDataFrame([(0, i) for i in range(1, 2000)] + [(5000, i) for i in range(1, 2000)], "u bigint, v bigint")
    assert {x["class"] for x in near_dedup.components(hub).collect()} == {0}
    with pytest.raises(RuntimeError):
        near_dedup.components(chain, rounds=2)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x["v"]: x["class"] for x in near_dedup.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in nodes}


def test_near_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {x["doc_id"]: (x["set_id"], x["class_id"], x["n_links"]) for x in near_dedup.op5_jaccard_join(spark, sf_dir).collect()}
    want = brute_classes(docs)
    assert got == {i: want.get(i, (i, i, 0)) for i, _ in docs}


def test_a_block_that_meets_an_empty_one_counts_nothing_again(spark):
    grams = near_dedup.ngrams(" ".join(f"w{i}" for i in range(30)))
    rows = [(k, 1, 5, [], grams.tobytes(), k) for k in (1, 2)]
    assert near_dedup._verified(rows, 0.8, True) == []
    assert near_dedup._verified(rows, 0.8, False) == [(1, 1, None, 1, 1), (2, 2, 1, 1, 1)]


def test_sentences_of_many_scripts():
    for text in ("\u0928\u092e\u0938\u094d\u0924\u0947 \u0926\u0941\u0928\u093f\u092f\u093e\u0964 \u0915\u094d\u092f\u093e \u0939\u0948\u0964", "\u0645\u0627 \u0647\u0630\u0627\u061f \u0646\u0639\u0645\u06d4", "\u1230\u120b\u121d\u1362 \u12a5\u1295\u12f4\u1275\u1362", "One\u2026 Two.", "\u4f60\u597d\u3002\u518d\u89c1\uff01", "One. Two!", "\u1780\u17d4 \u1781\u17d4"):
        assert len(sentence_dedup.sentences(text)) == 2, text


@pytest.mark.parametrize("mark", ["\u0964", "\u06d4", "\u061f"])
def test_repeated_passages_of_other_scripts_go(spark, mark, monkeypatch):
    monkeypatch.setattr(sentence_dedup, "PARTITIONS", 3)
    r = random.Random(9)
    say = lambda n: " ".join("".join(chr(0x915 + r.randrange(30)) for _ in range(4)) for _ in range(n)) + mark
    passage = " ".join(say(9) for _ in range(4))
    rows = [(i, f"{' '.join(say(9) for _ in range(3))} {passage} {' '.join(say(9) for _ in range(3))}") for i in range(6)]
    out = {x["doc_id"]: x for x in sentence_dedup.sentence_dedup(frame(spark, rows)).collect()}
    assert passage in out[0]["text"] and out[0]["n_spans"] == 0
    assert all(passage not in out[i]["text"] and out[i]["n_spans"] == 1 and len(out[i]["text"].split()) == 54 for i in range(1, 6))
