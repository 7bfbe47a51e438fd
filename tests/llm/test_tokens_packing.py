import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxrecon.llm import packing, tokens

WORD, BYTE = tokens.tokenizer_path("word_bpe_49k.json"), tokens.tokenizer_path("byte_bpe_50k.json")
PARTS = ["a", "The", "é", "É", "İ", "ß", "Σ", " ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", ".", ",", "!", "'s", "'", "12", "½", "你", "<|endoftext|>", "<|startoftext|>", "́", "😀", ";"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=1, max_size=20))
def test_same_as_library(texts):
    from tokenizers import Tokenizer

    word, byte = tokens.encoder(WORD, False, True), tokens.encoder(BYTE, True, False)
    for own, path, form in ((word, WORD, lambda e: np.asarray(e.ids, "<u4").tobytes()), (byte, BYTE, lambda e: len(e.ids))):
        lib = Tokenizer.from_file(path) if not hasattr(own, "plain") else own.plain
        own.plain = lib
        assert own.batch(texts) == [form(e) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_long_texts(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdefé.,", k=r.randint(1, 9))) for _ in range(30_000)), "x" * 200_000, "ab " * 60_000, ""]
    for path, keep, lib in ((WORD, False, library[0]), (BYTE, True, library[1])):
        own = tokens.ChunkEncoder(path, keep, len, sum)
        assert own.batch(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert "".join(tokens.slices(texts[0], 1000)) == texts[0]
    assert all(a[-1:] != " " and b[:1] == " " for a, b in zip(tokens.slices(texts[0], 1000), tokens.slices(texts[0], 1000)[1:], strict=False))


def test_counts_edge_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "one two"), (4, "a " * 2000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_tokens string")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(df, BYTE).collect()), key=repr)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (None, 7, 2, False), (4, 4000, 2001, True)], key=repr)
    assert tokens.token_counts(df.limit(0), BYTE).count() == 0


def test_binary_lengths():
    for n in (1, 2047, 2048, 2049, 6000):
        parts = packing.binary_lengths(n, 2048)
        assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)


def test_packing_round_trip(spark, library):
    texts = [(1, None), (2, ""), (3, "hello world " * 900), (4, "Straße, naïve."), (None, "x"), (4, "Straße, naïve.")]
    df = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id bigint, text string, length int")
    rows = packing.pack(df, WORD).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    whole = {i: [*library[0].encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    seen = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["offset"] == 0 and r["doc_tokens"] == len(whole[r["doc_id"]]) and r["length"] & (r["length"] - 1) == 0
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {i: len(whole[i]) * (2 if i == 4 else 1) for i in whole}
    assert packing.pack(df.limit(0), WORD).count() == 0
    with pytest.raises(ValueError):
        packing.decompose(df, WORD, max_tokens=100)


@pytest.mark.parametrize("sent", [0, 500_000])
def test_buckets_are_ranges_of_ids(spark, monkeypatch, sent):
    monkeypatch.setattr(packing, "SENT", sent)
    r = random.Random(6)
    df = spark.createDataFrame([(i % 50, "a b " * r.choice([0, 1, 3, 40, 3000])) for i in range(200)], "doc_id bigint, text string").repartition(7)
    rows = sorted(packing.pack(df, WORD).collect(), key=lambda x: x["sequence_id"])
    assert [x["sequence_id"] for x in rows] == list(range(len(rows)))
    assert [x["length"] for x in rows] == sorted(x["length"] for x in rows)


def test_query_digests(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {i: np.asarray([*library[0].encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    rows = packing.op1_pack_power_of_two(spark, sf_dir).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) for x in ids.values())
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())


def test_query_counts(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in tokens.op4_token_counts(spark, sf_dir).collect():
        assert r["n_tokens"] == len(library[1].encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids)
