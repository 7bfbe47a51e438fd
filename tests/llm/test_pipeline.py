import os
import sys

import numpy as np

import corpus_pipeline as cp
from taxrecon.llm.common import table, written

sys.path.insert(0, os.path.dirname(__file__))


def test_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        if name == "language_id":
            assert docs.count() == before.filter(before.text.rlike(r"\p{L}")).count()
        if name == "near_dedup":
            assert docs.count() == docs.select("doc_id").distinct().count() <= before.count()
        assert docs.filter("n_chars <> length(text)").count() == 0
    rows = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(len(np.frombuffer(r["ids"], "<u4")) == r["length"] for r in rows)


def test_edge_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "!!", "en", "a", 2), (4, "the cat sat\non the mat\nand slept", "en", "a", 33), (5, "the cat sat\non the mat\nand slept", "en", "a", 33), (None, "le chat dort", None, None, 12), (6, "a", "en", "b", 1)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    kept = written(cp.language_id(spark, docs, sf_dir))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 6]
    kept = written(cp.dedup_lines(spark, kept, sf_dir))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 6]
    kept = written(cp.dedup_near(spark, kept, sf_dir))
    assert kept.count() == 3
    mixed = written(cp.mix(spark, kept, sf_dir))
    assert cp.pack(spark, mixed, sf_dir).count() >= 1
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_texts_that_share_a_doc_id_stay(spark, sf_dir):
    a, b = "the cat sat on the mat and slept", "a dog ran over the wide green field"
    rows = [(1, a, "en", "x", len(a)), (1, b, "en", "x", len(b)), (1, a, "en", "x", len(a)), (2, a, "en", "x", len(a)), (3, "!!", "en", "x", 2), (3, "!!", "en", "x", 2), (3, "??", "en", "x", 2)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    assert sorted((r["doc_id"], r["text"]) for r in cp.dedup_near(spark, docs, sf_dir).collect()) == [(1, b), (1, a), (3, "!!"), (3, "??")]


def test_rows_without_ids_are_mixed_one_by_one(spark, sf_dir):
    """300 rows of one source without a doc_id, and one doc_id with two texts of one size: the mix takes what its
    targets say, not the largest count for all."""
    rows = [(None, f"word{i} b c d e", "en", "a", 14) for i in range(300)] + [(7, "x y z", "en", "b", 5), (7, "p q r", "en", "b", 5)] + [(1000 + i, "w " * 50, "en", "c", 100) for i in range(40)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    out = cp.mix(spark, docs, sf_dir).collect()
    words = {s: sum(len(r["text"].split()) for r in out if r["source"] == s) for s in "abc"}
    # Shares 1 : 2 : 3 of 3506 words; b stops at 18 words, c and a share the rest 3 : 1.
    assert words["b"] <= 18 and abs(words["a"] - 872) < 120 and abs(words["c"] - 2616) < 250


def brute_pipeline(docs):
    """Ids that near dedup leaves, by plain loops over what line dedup left."""
    import test_dedup

    lines = test_dedup.brute_lines([(i, t) for i, t in docs if any(c.isalpha() for c in t or "")])
    before = dict(docs)
    kept = [(i, t) for i, t in lines if t == before[i] or t.strip()]
    classes = test_dedup.brute_classes(kept)
    best = {}
    for i, _ in kept:
        best.setdefault(classes[i][1] if i in classes else i, []).append(i)
    return {i for i, _ in kept}, {min(v) for v in best.values()}


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lines, near = brute_pipeline(rows)
    first = written(cp.language_id(spark, docs, sf_dir))
    second = written(cp.dedup_lines(spark, first, sf_dir))
    assert {r[0] for r in second.select("doc_id").collect()} == lines
    third = written(cp.dedup_near(spark, second, sf_dir))
    assert {r[0] for r in third.select("doc_id").collect()} == near
    assert third.filter("n_chars <> length(text)").count() == 0


def test_long_texts_and_further_columns(spark, sf_dir):
    text = "one two three four five " * 60_000
    rows = [(1, text, "en", "a", len(text), "x"), (2, "short text here", None, "a", 15, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size string")
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == cp.COLUMNS and out.count() > 0, name
    pieces = cp.pack(spark, docs.withColumn("length", docs["size"]).withColumn("part", docs["size"]), sf_dir)
    assert pieces.groupBy().sum("length").first()[0] == 300_000 + 1 + 3 + 1
