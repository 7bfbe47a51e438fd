"""Alignment of two tokenizers against one that reads whole texts."""

import hashlib
import random
from collections import Counter
from itertools import islice

import pytest

from taxrecon.llm import alignment as M
from taxrecon.llm.tokens import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["a", "foo ", "  foo  bar", " ", "\n", "\x00", "a▁b c", "ﬁ é \t x\n y  ", "日本語 テスト", "<s> </s> <|endoftext|> x", "<0x0A>", "\n!", "a,\nb", "tab\t tab", " x", "x y", "　 z", "😀 😁👍🏽 ok", "\x1c x", "x\x1c y", "a  ", "x" * 3000]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


def plain(text, tools):
    """n_a, n_b, n_groups, groups, links by id pair of one whole text."""
    a, b = tools[0].encode(" " + text, add_special_tokens=False).ids, tools[1].encode(text)
    letters = {chr(i): i for i in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for i, x in enumerate(i for i in range(256) if i not in letters.values()):
        letters[chr(256 + i)] = x
    by_a = [bytes(letters[c] for c in tools[0].id_to_token(i)) for i in a]
    by_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(tools[1].id_to_piece, b)]
    if not text or not b"".join(by_a) == b"".join(by_b) == (" " + text).encode():
        return 0, 0, 0, "", Counter()
    ends = []
    for parts in (by_a, by_b):
        at, own = 0, []
        for x in parts:
            own.append((at, at + len(x)))
            at += len(x)
        ends.append(own)
    shared = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
    links, groups, low = Counter(), [[[], []] for _ in shared], 0
    for (s, e), i in zip(ends[0], a, strict=True):
        while ends[1][low][1] <= s:
            low += 1
        for (u, _), j in zip(islice(ends[1], low, None), islice(b, low, None), strict=True):
            if u >= e:
                break
            links[i, j] += 1
    for side, ids in enumerate((a, b)):
        at = 0
        for (_, e), i in zip(ends[side], ids, strict=True):
            groups[at][side].append(str(i))
            at += e == shared[at]
    groups = [",".join(x) + "|" + ",".join(y) for x, y in groups]
    return len(a), len(b), len(shared), ";".join(groups), links


def expected(rows, tools):
    known = {t: plain(t or "", tools) for t in {t for _, t in rows}}
    held = Counter(pair for _, t in rows for pair in known[t][4])
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for doc_id, t in rows:
        a, b, n, groups, links = known[t]
        out.append((doc_id, a, b, n, sum(links.values()), sum(k for p, k in links.items() if held[p] == best[p[0]]), sum(k * held[p] for p, k in links.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def test_words_by_themselves_give_the_whole_texts_alignment(tools):
    own, r = M.Aligner(tokenizer_path(A), tokenizer_path(B)), random.Random(3)
    letters = "abc XY.,!\n\t  é日😀▁<s>0'll \x1c"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randrange(1, 60))) for _ in range(1500)]
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        measures, groups, pairs, text, place, times = own.block(part)
        links = [Counter() for _ in part]
        for t, p, n in zip(text.tolist(), place.tolist(), times.tolist(), strict=True):
            links[t][divmod(int(pairs[p]), own.base)] = n
        for t, m, g, found in zip(part, measures.tolist(), groups, links, strict=True):
            assert (*m[:3], g, found) == plain(t, tools), repr(t)
            assert m[3] == sum(found.values())


def test_query_by_brute_force(spark, sf_dir, tools):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r) for r in M.op13_align_tokenizers(spark, sf_dir).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert got == {x[0]: x for x in expected(rows, tools)}


def test_small_blocks_copies_and_edge_cases(spark, tools, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_CHARS", 200)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "the same text, again") for i in range(40)] + [(None, "the text"), (None, None), (7, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id bigint, text string, docs int, digest string")
    got = sorted((tuple(r) for r in M.aligned(docs, tokenizer_path(A), tokenizer_path(B)).collect()), key=repr)
    assert got == expected(rows, tools)
    assert M.aligned(docs.limit(0), tokenizer_path(A), tokenizer_path(B)).collect() == []


def test_pairs_of_the_corpus(spark, tools):
    docs = spark.createDataFrame([(1, "low lower"), (2, "low lower"), (3, "low")], "doc_id bigint, text string")
    texts, pairs = M.aligned_texts(docs, tokenizer_path(A), tokenizer_path(B))
    assert sorted(r["docs"] for r in texts.collect()) == [1, 2]
    held = Counter()
    for t in ("low lower", "low lower", "low"):
        held.update(set(plain(t, tools)[4]))
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(held)
