"""The quality classifier: its gradient, its features, held-out accuracy and edge cases."""

import zlib

import numpy as np

from taxrecon.llm import attention as M


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(1)
    model, first = M.Bags(9), np.array([0, 1, 4, 9])
    x, y = r.normal(size=(9, 9)), np.array([0.0, 1.0, 0.25])

    def loss():
        p = 1 / (1 + np.exp(-model.forward(x, first)[0]))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    found = model.gradient(x, first, y)
    for name, w in model.p.items():
        for i in np.ndindex(w.shape):
            was, step = w[i], 1e-6
            w[i] = was + step
            up = loss()
            w[i] = was - step
            down = loss()
            w[i] = was
            assert abs((up - down) / (2 * step) - found[name][i]) < 1e-5, name


def test_attention_sums_to_one_and_follows_the_telling_passage():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 9, 400)
    first = np.concatenate(([0], np.cumsum(sizes)))
    x = r.normal(size=(int(first[-1]), 6))
    y = (r.random(400) < 0.5).astype(float)
    told = first[:-1] + r.integers(0, sizes)
    x[:, 0] = 0.0
    x[told, 0] = np.where(y > 0, 3.0, -3.0)
    model = M.Bags(6)
    model.fit(x, first, y, 1.0)
    score, a = model.scores(x, first)
    assert ((score >= 0.5) == (y > 0)).mean() > 0.95
    assert np.allclose(np.add.reduceat(a, first[:-1]), 1)
    several = sizes > 1
    assert (a[told] > 1 / sizes)[several].mean() > 0.9


def test_passages_cover_whole_texts():
    words = [f"w{i}" for i in range(1000)]
    x, first = M.passages([b"", " ".join(words).encode(), b" \n\t", b"one"])
    assert first.tolist() == [0, 1, 17, 18, 19]
    assert not x[0].any() and not x[17].any()
    # What the last words are shows in the last passage alone.
    y, _ = M.passages([b"", " ".join([*words[:-1], "!!"]).encode(), b" \n\t", b"one"])
    assert (x[:16] == y[:16]).all() and (x[16] != y[16]).any()
    # Texts handled together give what each gives alone.
    z, _ = M.passages([" ".join(words).encode()])
    assert np.allclose(z, x[1:17])


def test_query_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in M.op11_quality_attention(spark, big).collect()}
    assert len(rows) == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    told = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{big}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = ([r["score"] for r, q in told if q == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.97 and np.mean([r["predicted"] == q for r, q in told]) > 0.95
    assert all(r["predicted"] for r, q in told if q == 1)


def test_rows_that_are_held_out_teach_nothing(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = M.held_out(F.col("doc_id"))
    docs.withColumn("lang", F.lit("xx")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    a, b = ({r["doc_id"]: r["score"] for r in M.op11_quality_attention(spark, str(p)).collect()} for p in (sf_dir, tmp_path))
    assert all(abs(a[d] - b[d]) < 1e-5 for d in a)


def test_edge_cases(spark):
    rows = [(1, "good text here"), (1, "good text here"), (2, None), (3, ""), (None, "x !! !!"), (5, "w " * 40_000)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id bigint, text string, score int, attention string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert M.fit(docs, none) is None
    assert {r["score"] for r in M.scored(docs, None).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0), (99, 0)], "doc_id bigint, quality int")
    assert M.fit(docs, one) == 2 / 3
    both = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (5, 0), (2, None)], "doc_id bigint, quality int")
    model = M.fit(docs, both)
    out = M.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and abs(sum(r["attention"]) - 1) < 1e-4 for r in out)
    assert max(len(r["attention"]) for r in out) == 40_000 // M.WORDS
    assert len({r["score"] for r in out if r["doc_id"] in (2, 3)}) == 1
    assert M.scored(docs.limit(0), model).collect() == []
