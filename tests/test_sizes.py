"""What moves and is stored while the tables are made, from plans and counts."""

import pytest

from taxrecon.operators import reconcile
from taxrecon.plans import domain
from taxrecon.plans.domain import Domain


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_books_and_documents_meet_where_they_lie(spark, sf_dir):
    """Of the stored base the core moves, once; neither the joins nor the writer move rows again."""
    names = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was, held, d = {n: spark.conf.get(n) for n in names}, [], Domain(spark, sf_dir)
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        plan = _plan(d._reconciled(held))
    finally:
        for n, v in was.items():
            spark.conf.set(n, v)
    assert plan.count("SortMergeJoin") == 5 and "ENSURE_REQUIREMENTS" not in plan.replace("REPARTITION_BY_NUM", "")
    assert held[0].count() == d.base.count()
    held[0].unpersist()
    moved = _plan(d._computed())
    assert "Exchange hashpartitioning(month" in moved and "Exchange hashpartitioning(period" not in moved


def test_stored_invoices_are_those_of_a_plain_join(spark, sf_dir):
    d = Domain(spark, sf_dir)
    plain = reconcile.unified(d.gstr1, d.gstr2b, d.einvoices, d.eway_bills)
    assert sorted(plain.columns) == sorted(d.unified.columns)
    stored = d.unified.select(plain.columns)
    assert stored.count() == plain.count() and stored.exceptAll(plain).isEmpty() and plain.exceptAll(stored).isEmpty()
    assert domain.CORE == [c for c in d.base.columns if c in domain.CORE]


def test_documents_named_by_their_number_alone(spark, sf_dir):
    """Files without the other keys give the same flags where numbers are unique."""
    d = Domain(spark, sf_dir)
    bills, irns = d.eway_bills.select("invoice_no"), d.einvoices.select("invoice_no", "status")
    got = reconcile.unified(d.gstr1, d.gstr2b, irns, bills).groupBy("has_einvoice", "has_eway_bill", "match_status").count().collect()
    assert sorted(got) == sorted(d.unified.groupBy("has_einvoice", "has_eway_bill", "match_status").count().collect())


def test_vendor_ranks_are_those_of_the_whole_graph(spark):
    """Invoices of one kind are one node; numbers that several vendors use, and invoices of no vendor or period, too."""
    import pytest

    from taxrecon.operators import graph

    rows = [("a", "x", "p1", True, True), ("b", "x", "p1", True, True), ("c", "x", "p1", True, False), ("d", "y", "p2", False, True), ("d", "z", "p1", True, True), ("e", None, "p1", True, False), ("f", "y", "", True, True), ("g", "z", "p2", True, True), ("h", "z", "p2", True, True)]
    invoices = spark.createDataFrame(rows, "invoice_id string, vendor_id string, period string, in_gstr1 boolean, in_gstr2b boolean")
    vendors = spark.createDataFrame([("x",), ("y",), ("z",), ("idle",)], "vendor_id string")
    edges = graph.edges(invoices.selectExpr("*", "false as has_einvoice", "false as has_eway_bill"))
    ids = edges.selectExpr("explode(array(source, target)) id").union(vendors.selectExpr("concat('v-', vendor_id)")).union(invoices.selectExpr("explode(array(concat('i-', invoice_id), concat('g-GSTR-1-', period), concat('g-GSTR-2B-', period)))").filter("col not like 'g-%-'"))
    want = {r["id"]: r["rank"] for r in graph.pagerank(ids, edges).collect()}
    got = {r["vendor_id"]: r["rank"] for r in graph.vendor_ranks(vendors, invoices).collect()}
    assert set(got) == {"x", "y", "z", "idle"} and all(v == pytest.approx(want["v-" + k], abs=1e-12) for k, v in got.items())


def test_forest_rows_are_made_once(spark, sf_dir):
    from taxrecon.plans import queries

    first = queries._rows(Domain(spark, sf_dir))
    assert queries._rows(Domain(spark, sf_dir)) is first


def test_forests_are_trained_by_many_tasks(spark, monkeypatch):
    """Rows that are stored as one file are spread, the same way however they are stored."""
    from pyspark.sql import functions as F

    from taxrecon.operators import model

    monkeypatch.setattr(model, "ROWS", 50)
    n = F.col("id")
    rows = spark.range(400).select(F.concat(F.lit("V"), n.cast("string")).alias("vendor_id"), *((n * (k + 7) % 61).cast("double").alias(c) for k, c in enumerate(model.FEATURES)), (n % 3 == 0).cast("double").alias("label"))
    seen, keep = [], model.spread
    monkeypatch.setattr(model, "spread", lambda df: seen.append(keep(df)) or seen[-1])
    stored = [rows.coalesce(1), rows.repartition(3)]
    found = [{r["feature"]: r["importance"] for r in model.importances(model.train(df, trees=5), spark).collect()} for df in stored]
    assert all(found[0][c] == pytest.approx(found[1][c], abs=1e-9) for c in model.FEATURES)
    assert [df.rdd.getNumPartitions() for df in seen] == [8, 8] and seen[0].exceptAll(seen[1]).isEmpty()
    assert model.cross_validated(stored[0], folds=2, trees=2) > 0 and seen[-1].rdd.getNumPartitions() == 8
