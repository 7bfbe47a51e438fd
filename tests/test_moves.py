"""What moves where queries run at size, from plans, and that results stay those of the plain way."""

from pyspark.sql import functions as F

from taxrecon.operators import changes, clusters, graph, reconcile
from taxrecon.plans.domain import Domain
from taxrecon.sources import large_json
from taxrecon.sources.storage import written


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_named_invoices_leave_the_base_once(spark, sf_dir):
    """A batch of changes takes its invoices from the base's core; their figures are those of the four tables."""
    d = Domain(spark, sf_dir)
    named = d.base.filter("ok % 50 = 1").select(F.col("gstin").alias("supplier_gstin"), "invoice_no", "period")
    tables = d.gstr1, d.gstr2b, d.einvoices, d.eway_bills
    near = d.near(named)
    for got, whole in zip(near, tables, strict=True):
        want = whole.join(named, reconcile.KEYS, "left_semi").select(got.columns)
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    batch = changes.change(d.base.filter("ok % 50 = 1 and ok % 3 = 0").withColumn("supplier_gstin", F.col("gstin")), "gstr1", "delete", 1)
    for name in changes.FIGURES:
        assert changes.figures(changes.signed(*near, batch, near=True), name).exceptAll(changes.figures(changes.signed(*tables, batch), name)).isEmpty()
    assert not any("hashpartitioning" in _plan(t) for t in near)


def test_memberships_stay_with_their_groups(spark):
    """In a round of the clusters the (vendor, group) rows don't move, and what they say moves once."""
    rows = [(f"v{i % 40:02}", f"{i % 7}", f"p{i % 3}") for i in range(500)]
    invoices = spark.createDataFrame(rows, "vendor_id string, hsn string, period string")
    member = clusters.memberships(invoices).persist()
    assert member.count() == len(set(rows))
    labels = written(member.select("vendor_id", F.col("vendor_id").alias("label")).distinct())
    plan = _plan(clusters._heard(labels, member)).split("InMemoryRelation")[0]
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and plan.count("Window") >= 2
    member.unpersist()


def test_texts_of_ranges_do_not_move(spark, tmp_path):
    """Pieces of documents are numbered where they are read."""
    (tmp_path / "a.json").write_text('{"b2b": [{"ctin": "S", "inv": [{"inum": "1"}, {"inum": "2"}]}]}')
    plans, keep = [], large_json.written

    def spy(df, *args, **kw):
        plans.append((df.columns, _plan(df)))
        return keep(df, *args, **kw)

    large_json.written = spy
    try:
        assert large_json.gstr1(spark, str(tmp_path), "2025-07").count() == 2
    finally:
        large_json.written = keep
    texts = [plan for columns, plan in plans if "body" in columns or "value" in columns]
    assert texts and all("hashpartitioning" not in plan and "Sort" not in plan for plan in texts)


def test_edges_are_counted_at_the_front_alone(spark, monkeypatch):
    """A search for paths counts no edges of nodes that it doesn't reach."""
    edges = spark.createDataFrame([("a", "h"), *((f"x{i}", "h") for i in range(5)), ("a", "b"), ("b", "c"), ("c", "c")], "source string, target string")
    monkeypatch.setattr(graph, "degrees", None)
    found = {r["id"]: r["path"] for r in graph.hops(edges, spark.createDataFrame([("a",)], "id string"), 3, hub=5).collect()}
    assert found == {"a": "a", "h": "a>h", "b": "a>b", "c": "a>b>c"}


def test_invoices_take_the_rank_of_their_class(spark):
    """Ranks by classes of invoices are those of the whole graph; numbers of several vendors, of none, and without period."""
    rows = [("a", "x", "p1", True, True), ("b", "x", "p1", True, True), ("c", "x", "p1", True, False), ("d", "y", "p2", False, True), ("d", "z", "p1", True, True), ("e", None, "p1", True, False), ("f", "y", "", True, True), ("g", "z", "p2", True, True), ("d", "y", "p1", True, True)]
    invoices = spark.createDataFrame(rows, "invoice_id string, vendor_id string, period string, in_gstr1 boolean, in_gstr2b boolean")
    vendors = spark.createDataFrame([("x",), ("y",), ("z",), ("idle",)], "vendor_id string")
    edges = graph.edges(invoices.selectExpr("*", "false as has_einvoice", "false as has_eway_bill"))
    ids = edges.selectExpr("explode(array(source, target)) id").union(vendors.selectExpr("concat('v-', vendor_id)")).union(invoices.selectExpr("explode(array(concat('i-', invoice_id), concat('g-GSTR-1-', period), concat('g-GSTR-2B-', period)))").filter("col not like 'g-%-'"))
    want = {r["id"]: r["rank"] for r in graph.pagerank(ids, edges).collect()}
    got = graph.invoice_ranks(vendors, invoices).collect()
    assert len(got) == len(want) and all(abs(r["rank"] - want[r["id"]]) < 1e-12 for r in got)


def test_clusters_move_what_those_that_move_hear(spark, monkeypatch):
    """Vendors are numbers while clusters are found, and of a round only what the moving half of them hears is summed."""
    rows = [(f"v{i % 40:02}", f"{i % 7}", f"p{i % 3}") for i in range(500)] + [("alone", "x", None)]
    invoices = spark.createDataFrame(rows, "vendor_id string, hsn string, period string")
    plain = clusters.propagated(clusters.memberships(invoices), invoices.select("vendor_id").distinct())
    heard, keep = [], clusters._summed

    def spy(df):
        heard.append((df.schema["label"].dataType.simpleString(), {r["vendor_id"] for r in df.collect()}))
        return keep(df)

    monkeypatch.setattr(clusters, "_summed", spy)
    found = {tuple(r) for r in clusters.clusters(invoices).collect()}
    assert found == {tuple(r) for r in plain.collect()} and len(found) == 41 and ("alone", "alone") in found
    assert len(heard) == clusters.ROUNDS and {kind for kind, _ in heard} == {"int"}
    assert not heard[0][1] & heard[1][1] and len(heard[0][1] | heard[1][1]) == 40


def test_scores_that_need_more_than_64_bits(spark):
    """Weights whose products are too large for a long give the same clusters."""
    from pyspark.sql import functions as F

    rows = [(v, g, 7 * g) for g, vs in enumerate(("ab", "abc", "cd", "de", "def", "fa")) for v in vs]
    member = spark.createDataFrame(rows, "vendor_id string, g bigint, g2 bigint").withColumn("w", F.lit(3).cast("bigint"))
    vendors = member.select("vendor_id").distinct()
    want = sorted(clusters.propagated(member, vendors).collect())
    assert sorted(clusters.propagated(member.withColumn("w", F.col("w") * 2**40), vendors).collect()) == want


def test_the_vendors_are_sent_to_the_invoices(spark, sf_dir):
    """Their size is known before anything moves."""
    plan = _plan(Domain(spark, sf_dir).invoices.select("vendor_id", "hsn")).split("== Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
