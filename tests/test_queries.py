"""Every registered query of the reconciliation engine against its SQL on the smallest tables."""

import pytest

from taxrecon.plans import oracle
from taxrecon.plans.queries import QUERIES

ROWS_ONLY = {"vendor_risk_forest", "forest_feature_importance", "forest_metrics", "forest_confusion", "forest_cross_validation", "forest_fold_metrics"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY))
def test_matches_sql(spark, sf_dir, same, name):
    same(QUERIES[name](spark, sf_dir), oracle.ORACLES[name])


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) == set(oracle.ORACLES) | ROWS_ONLY


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.queries()) >= set(QUERIES)
    rows = {r["match_status"]: r["n"] for r in __spark_entry__.entry(spark).collect()}
    assert rows == {"Missing in GSTR-1": 356, "Missing in GSTR-2B": 204, "Tax Amount Mismatch": 61, "HSN Mismatch": 178, "Late Filing": 713, "E-Way Bill Missing": 183, "Matched": 3228}


def test_forest(spark, sf_dir):
    rows = QUERIES["vendor_risk_forest"](spark, sf_dir).collect()
    assert len(rows) == 10 and all(0 <= r["probability"] <= 1 for r in rows)


def test_forest_runs_the_defaults(spark, sf_dir):
    from taxrecon.plans import queries
    from taxrecon.plans.domain import Domain

    rows, fitted = queries._trained(Domain(spark, sf_dir))
    assert fitted.stages[-1].getNumTrees == 100
    full = {r["id"]: r["rank"] for r in QUERIES["pagerank"](spark, sf_dir).collect()}
    assert all(r["graph_centrality"] == pytest.approx(full["v-" + r["vendor_id"]], abs=1e-10) for r in rows.collect())


@pytest.mark.parametrize("name", ["stream_windowed_kpis", "stream_reconcile_outer"])
def test_streams_read_a_table_of_part_files(spark, sf_dir, same, tmp_path, name):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    same(QUERIES[name](spark, str(tmp_path)), oracle.ORACLES[name])


def test_return_documents_are_bounded(spark, sf_dir):
    from pyspark.sql import functions as F

    from taxrecon.plans.domain import Domain
    from taxrecon.sources import sinks

    d = Domain(spark, sf_dir)
    for documents, book, column in ((sinks.gstr1_documents, d.gstr1, "b2b"), (sinks.gstr2b_documents, d.gstr2b, "docdata.b2b")):
        # One supplier has a third of a period's invoices; the period holds a thousand.
        hot = book.limit(1000).withColumn("period", F.lit("2024-01")).withColumn("supplier_gstin", F.when(F.monotonically_increasing_id() % 3 == 0, "hot").otherwise(F.col("supplier_gstin")))
        sizes = [sum(len(s["inv"]) for s in r["b2b"]) for r in documents(hot, 50).select("period", F.col(column).alias("b2b")).collect()]
        assert sum(sizes) == 1000 and len(sizes) == 20 and max(sizes) < 100


def test_pagerank_sums_to_one(spark, sf_dir):
    from pyspark.sql import functions as F

    total = QUERIES["pagerank"](spark, sf_dir).agg(F.sum("rank")).first()[0]
    assert total == pytest.approx(1.0, abs=1e-5)


def test_a_period_prunes_the_stored_base(spark, sf_dir):
    """The second query reads what the first stored, and of it the files of its period."""
    from taxrecon.operators import reconcile
    from taxrecon.plans.domain import Domain

    base = Domain(spark, sf_dir).base
    assert Domain(spark, sf_dir).base is base
    d = Domain(spark, sf_dir)
    plan = reconcile.missing_in_gstr1(d.gstr1, d.gstr2b, d.vendor_master, "1995-03")._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [isnotnull(period") == 2 and "period#" in plan
    read = d.gstr2b.filter("period = '1995-03'").select("taxable")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<taxable:bigint,in_gstr2b:boolean>" in read


def test_a_base_that_was_cleared_is_stored_again(spark, sf_dir):
    import pathlib
    import urllib.parse

    from taxrecon.plans.domain import Domain

    base = Domain(spark, sf_dir).base
    n, folder = base.count(), pathlib.Path(urllib.parse.urlparse(base.inputFiles()[0]).path).parents[1]
    folder.rename(folder.with_name("away-" + folder.name))
    again = Domain(spark, sf_dir).base
    assert again is not base and again.count() == n and Domain(spark, sf_dir).base is again


def test_gstins_are_unique_at_any_number_of_suppliers(spark, tmp_path):
    from pyspark.sql import functions as F

    from taxrecon.plans.domain import Domain

    spark.range(1, 200_001).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(3).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.lit("n").alias("n_name"), F.lit(0).alias("n_regionkey")).write.parquet(f"{tmp_path}/nation.parquet")
    master = Domain(spark, str(tmp_path)).vendor_master
    assert master.select("gstin").distinct().count() == 200_000 and {r[0] for r in master.select(F.length("gstin")).distinct().collect()} == {14, 15}


def test_sorted_queries_are_in_order(spark, sf_dir):
    tax = [r["tax"] for r in QUERIES["missing_in_gstr1_by_tax"](spark, sf_dir).collect()]
    assert tax == sorted(tax, reverse=True)
    scores = [r["risk_score"] for r in QUERIES["vendor_scorecard_by_score"](spark, sf_dir).collect()]
    assert scores == sorted(scores, reverse=True)


def test_models_do_better_than_chance(spark, sf_dir):
    """Bands only: how the data are stored can move a tree."""
    from taxrecon.operators import model

    rows = spark.range(400).selectExpr("concat('v', id) AS vendor_id", *(f"cast(hash(id, {i}) % 100 as double) / 10 AS {c}" for i, c in enumerate(model.FEATURES)))
    data = model.labelled(rows)
    found = {(r["model"], r["metric"]): r["value"] for r in model.evaluated(data).collect()}
    assert len(found) == 10 and found["forest", "accuracy"] > 0.7 and found["boosted", "auc"] > 0.75
    assert 0.75 < model.cross_validated(data, trees=20) <= 1


def test_what_no_data_could_fail_has_rows(spark, sf_dir):
    for name in ("vendor_threshold_alerts", "stream_threshold_alerts", "vendor_quarantine", "missing_in_gstr1_period", "full_reconciliation_period"):
        assert QUERIES[name](spark, sf_dir).count() > 0, name
    assert QUERIES["blocked_itc"](spark, sf_dir).count() == 2 and QUERIES["gstin_quality"](spark, sf_dir).count() == 2
