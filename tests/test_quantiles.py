"""Exact quantiles, running sums and the rank-based area under ROC; folds; SQL functions; shortest paths."""

import random

import pytest
from pyspark.sql import functions as F

from taxrecon.functions import scoring, sql
from taxrecon.operators import graph, model, quantiles


@pytest.mark.parametrize("fetched", [5, 10_000])
def test_quantiles_equal_percentile(spark, monkeypatch, fetched):
    monkeypatch.setattr(quantiles, "FETCHED", fetched)
    r = random.Random(2)
    cases = [[r.gauss(0, 1) for _ in range(700)], [float(r.randrange(4)) for _ in range(500)] + [None], [7.0] * 300, [1.0, 2.0], [-1.5]]
    for values in cases:
        rows = spark.createDataFrame([(v,) for v in values], "x double").persist()
        for q in (0.0, 0.3, 0.7, 1.0):
            assert quantiles.quantile(rows, "x", q) == rows.agg(F.percentile("x", q)).first()[0], (len(values), q)
    assert quantiles.quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None


def test_no_task_holds_all_values(spark, monkeypatch):
    """Of many values only a range of few is fetched."""
    monkeypatch.setattr(quantiles, "FETCHED", 50)
    rows = spark.range(20_000).select(((F.col("id") * 7919) % 20_011).cast("double").alias("x")).persist()
    values = sorted(float(i * 7919 % 20_011) for i in range(20_000))
    assert quantiles.order_statistics(rows, "x", [0, 13_999, 19_999]) == {0: values[0], 13_999: values[13_999], 19_999: values[-1]}


def test_auc_counts_pairs(spark):
    r = random.Random(3)
    rows = [(r.randrange(8) / 8, float(r.random() < 0.4)) for _ in range(120)] + [(None, 1.0), (0.5, None)]
    known = [x for x in rows if None not in x]
    want = [(a > b) + 0.5 * (a == b) for a, x in known for b, y in known if x > y]
    for parts in (1, 7):  # wherever the rows lie
        got = quantiles.auc(spark.createDataFrame(rows, "s double, l double").repartition(parts), "s", "l").first()
        assert got["auc"] == pytest.approx(sum(want) / len(want), abs=1e-12) and got["positives"] * got["negatives"] == len(want)
    assert quantiles.auc(spark.createDataFrame([(0.5, 1.0)], "s double, l double"), "s", "l").first()["auc"] is None
    assert quantiles.auc(spark.createDataFrame([], "s double, l double"), "s", "l").first()["auc"] is None


def test_running_sums(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k int, v int").repartition(5)
    got = {r["k"]: r["before"] for r in quantiles.running(rows, F.col("k"), "v", "before").collect()}
    total, want = 0, {}
    for k, v in sorted((i * 37 % 101, i) for i in range(101)):
        want[k] = total
        total += v
    assert got == want


def test_folds_do_not_depend_on_storage(spark):
    rows = spark.range(300).selectExpr("concat('v', id) AS vendor_id", *(f"cast(hash(id, {i}) % 100 as double) / 10 AS {c}" for i, c in enumerate(model.FEATURES)))
    one, other = model.folded(rows.coalesce(1)), model.folded(rows.repartition(6, F.rand(1)))
    assert {(r["vendor_id"], r["fold"]) for r in one.collect()} == {(r["vendor_id"], r["fold"]) for r in other.collect()}
    found = model.out_of_fold(model.labelled(rows), trees=10)
    assert found.count() == 300
    per = {r["fold"]: r for r in model.fold_metrics(found).collect()}
    assert set(per) == {-1, 0, 1, 2, 3, 4} and per[-1]["n"] == 300 == sum(per[k]["n"] for k in range(5)) and per[-1]["auc"] > 0.75


def test_sql_functions_are_the_column_functions(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(m, d, t, x) for m in (None, 0, 2, 3, 9) for d in (None, 0.0, 19.9, 50.0) for t in (None, 49, 99, 100) for x in (None, 5_000_000, 5_000_001, 10_000_001)], "m int, d double, t bigint, x bigint")
    score = scoring.predict_risk(F.col("m"), F.col("d"), F.col("t"))
    named = {"a": score, "b": scoring.classify_risk(score), "c": scoring.probability_label(score), "e": scoring.classify_mismatch(F.col("x"), F.col("m")), "f": scoring.invoice_risk_level(F.when(F.col("m") > 2, "Matched"), F.col("x")), "g": scoring.presence_status(F.col("m") > 1, F.col("d") > 1)}
    asked = rows.select("*", *(v.alias(k) for k, v in named.items()))
    found = spark.sql("""SELECT a, b, c, e, f, g, predict_risk(m, d, t) AS a2, classify_risk(a) AS b2, probability_label(a) AS c2, classify_mismatch(x, m) AS e2,
        invoice_risk_level(CASE WHEN m > 2 THEN 'Matched' END, x) AS f2, presence_status(m > 1, d > 1) AS g2 FROM {r}""", r=asked).collect()
    assert len(found) == 320 and all(r[k] == r[k + "2"] for r in found for k in named)


def test_shortest_paths(spark):
    edges = spark.createDataFrame([("v", "i1"), ("v", "i2"), ("i1", "g"), ("i2", "g"), ("i3", "g"), ("i3", "e"), ("x", "y")], "source string, target string")
    seeds = spark.createDataFrame([("i1",)], "id string")
    found = {r["id"]: (r["hop"], r["path"]) for r in graph.hops(edges, seeds, 4).collect()}
    assert found == {"i1": (0, "i1"), "v": (1, "i1>v"), "g": (1, "i1>g"), "i2": (2, "i1>g>i2"), "i3": (2, "i1>g>i3"), "e": (3, "i1>g>i3>e")}
    # A hub is reached and not passed.
    few = {r["id"]: r["path"] for r in graph.hops(edges, seeds, 4, hub=2).collect()}
    assert few == {"i1": "i1", "v": "i1>v", "g": "i1>g", "i2": "i1>v>i2"}
    assert graph.hops(edges, seeds.limit(0)).count() == 0
