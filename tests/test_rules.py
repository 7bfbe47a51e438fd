"""Golden values and edge cases of the rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from taxrecon.functions import scoring, text
from taxrecon.operators import graph, kpis, model, reconcile, vendors
from taxrecon.sources import returns, sinks
from taxrecon.streaming import jobs


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


@pytest.mark.parametrize("missed,late,tx,want,cls", [(3, 8, 50, 0.384, "Review"), (12, 30, 10, 0.704, "High Risk"), (0, 0, 500, 0.06, "Compliant"), (4, 12, 67, 0.4747, "Review"), (0, 0, None, 0.06, "Compliant")])
def test_predict_risk(spark, missed, late, tx, want, cls):
    score = scoring.predict_risk(F.lit(missed), F.lit(late), F.lit(tx).cast("int"))
    assert value(spark, score) == pytest.approx(want, abs=5e-5)
    assert value(spark, scoring.classify_risk(score)) == cls


def test_limits(spark):
    at = [(s, value(spark, scoring.classify_risk(F.lit(s))), value(spark, scoring.risk_band(F.lit(s)))) for s in (0.3, 0.6, 0.29)]
    assert at == [(0.3, "Review", "low"), (0.6, "High Risk", "medium"), (0.29, "Compliant", "low")]
    for tax, past, want in ((100_001, 0, "High Risk"), (100_000, 6, "High Risk"), (50_001, 0, "Medium Risk"), (50_000, 3, "Medium Risk"), (50_000, 2, "Low Risk")):
        assert value(spark, scoring.classify_mismatch(F.lit(tax * 100), F.lit(past))) == want
    assert value(spark, scoring.presence_status(F.lit(False), F.lit(False))) == "Matched"
    assert value(spark, scoring.presence_status(F.lit(None).cast("boolean"), F.lit(False))) == "Missing in GSTR-2B"
    assert value(spark, scoring.invoice_risk_level(F.lit("HSN Mismatch"), F.lit(50_000 * 100))) == "Medium"


@pytest.mark.parametrize("rupees,want", [(999, "999"), (1000, "1,000"), (450000, "4,50,000"), (12345678, "1,23,45,678")])
def test_lakh_grouping(spark, rupees, want):
    assert value(spark, text.inr_grouped(F.lit(rupees * 100))) == want


def test_compact(spark):
    got = [value(spark, text.inr_compact(F.lit(r * 100))) for r in (999, 1500, 810_000, 12_300_000)]
    assert got == ["₹999", "₹1.5K", "₹8.1 L", "₹1.2 Cr"]


def test_dates(spark):
    assert value(spark, text.parse_date(F.lit("15-07-2025"))) == datetime.date(2025, 7, 15)
    assert value(spark, text.parse_date(F.lit("2025-07-15"))) == datetime.date(2025, 7, 15)
    assert value(spark, text.parse_date(F.lit("15/07/2025"))) is None
    assert value(spark, text.due_date(F.lit("2025-12-31").cast("date"))) == datetime.date(2026, 1, 11)


BOOK = "supplier_gstin string, invoice_no string, period string, invoice_date date, taxable bigint, cgst bigint, sgst bigint, igst bigint, hsn string"


def books(spark):
    d, late = datetime.date(2025, 7, 1), datetime.date(2025, 8, 12)
    due = datetime.date(2025, 8, 11)
    one = [("A", "1", "2025-07", d, 100, 9, 9, 0, "10", due, due), ("A", "2", "2025-07", d, 100, 8, 9, 0, "10", due, due), ("B", "1", "2025-07", d, 100, None, 9, 0, "11", due, due), ("B", "3", "2025-07", d, 100, 9, 9, 0, "10", late, due)]
    two = [("A", "1", "2025-07", d, 100, 9, 9, 0, "10", "Y"), ("A", "2", "2025-07", d, 100, 9, 9, 0, "10", "Y"), ("B", "1", "2025-07", d, 100, 9, 9, 0, "12", "Y"), ("C", "9", "2025-07", d, 100, 9, 9, 0, "10", "Y")]
    g1 = spark.createDataFrame(one, BOOK + ", filed_date date, due_date date")
    g2 = spark.createDataFrame(two, BOOK + ", itc_available string")
    vendors_ = spark.createDataFrame([("A", "Ann"), ("B", "Bob")], "gstin string, name string")
    return g1, g2, vendors_


def test_checks_on_small_books(spark):
    g1, g2, v = books(spark)
    missing = reconcile.missing_in_gstr1(g1, g2, v).collect()
    assert [(r["invoice_id"], r["vendor_gstin"], r["vendor_name"]) for r in missing] == [("9", "C", None)]
    # The same number of two vendors is two invoices; a null on one side is no difference.
    assert [r["invoice_id"] for r in reconcile.tax_mismatch(g1, g2, v).collect()] == ["2"]
    assert [(r["invoice_id"], r["hsn_1"], r["hsn_2b"]) for r in reconcile.hsn_mismatch(g1, g2).collect()] == [("1", "11", "12")]
    assert reconcile.presence_match(g1, g2, "2025-06").count() == 0


def test_unified_statuses(spark):
    g1, g2, v = books(spark)
    none = spark.createDataFrame([], "invoice_no string, status string, irn string, ewb_no string")
    rows = {(r["supplier_gstin"], r["invoice_no"]): r["match_status"] for r in reconcile.unified(g1, g2, none, none).collect()}
    assert rows == {("A", "1"): "Matched", ("A", "2"): "Tax Amount Mismatch", ("B", "1"): "HSN Mismatch", ("B", "3"): "Missing in GSTR-2B", ("C", "9"): "Missing in GSTR-1"}


def test_one_number_of_two_suppliers_shares_nothing(spark):
    """A is in GSTR-1 alone and has the documents, B in GSTR-2B alone and has none; both invoices are numbered 1."""
    from taxrecon.operators import explain

    d = datetime.date(2025, 7, 1)
    g1 = spark.createDataFrame([("A", "1", "2025-07", d, 9_000_000, 9, 9, 0, "10", d, d)], BOOK + ", filed_date date, due_date date")
    g2 = spark.createDataFrame([("B", "1", "2025-07", d, 9_000_000, 9, 9, 0, "10", "Y")], BOOK + ", itc_available string")
    keys = "supplier_gstin string, invoice_no string, period string"
    irns = spark.createDataFrame([("A", "1", "2025-07", "I", "ACT")], keys + ", irn string, status string")
    bills = spark.createDataFrame([("A", "1", "2025-07", "W")], keys + ", ewb_no string")
    v = spark.createDataFrame([("a", "A", "Ann", "s"), ("b", "B", "Bob", "s")], "vendor_id string, gstin string, name string, state string")
    inv = reconcile.enriched(reconcile.unified(g1, g2, irns, bills), v)
    assert {(r["vendor_id"], r["has_einvoice"], r["has_eway_bill"]) for r in inv.collect()} == {("a", True, True), ("b", False, False)}
    context = {r["vendor_id"]: (r["filings"], r["irns"], r["ewbs"]) for r in explain.invoice_context(inv, irns, bills).collect()}
    assert context == {"a": ("GSTR-1 (2025-07)", "I", "W"), "b": ("GSTR-2B (2025-07)", "", "")}
    assert [r["invoice_id"] for r in reconcile.eway_bill_missing(g1, g2, bills).collect()] == ["1"]
    assert [r["supplier_gstin"] for r in reconcile.einvoice_missing(g1, g2, irns).collect()] == ["B"]
    asked = spark.createDataFrame([("1",)], "invoice_id string")
    assert len({r["explanation"] for r in explain.template_explanation(asked, inv).collect()}) == 2
    # Files that name an invoice by its number alone still meet it.
    assert reconcile.unified(g1, g2, irns.select("invoice_no", "irn", "status"), bills.select("invoice_no", "ewb_no")).filter("has_einvoice and has_eway_bill").count() == 2


def test_orders(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("c", 9), ("d", 9)], "invoice_id string, tax bigint")
    assert [r["invoice_id"] for r in reconcile.by_tax(rows).collect()] == ["b", "c", "d", "a"]
    assert [r["invoice_id"] for r in reconcile.by_difference(rows.withColumnRenamed("tax", "tax_difference")).collect()] == ["b", "c", "d", "a"]
    cards = spark.createDataFrame([("v2", 0.5), ("v1", 0.5), ("v3", 0.9)], "vendor_id string, risk_score double")
    assert [r["vendor_id"] for r in vendors.by_score(cards).collect()] == ["v3", "v1", "v2"]


def test_threshold_crossings_over_days_and_batches(spark, tmp_path):
    import random

    r = random.Random(5)
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=3 * i), r.randrange(4), r.choice(["error", "error", "view"]), round(r.uniform(-5, 20), 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    want, sums = [], {}
    for i, _, u, kind, value in rows:
        if kind == "error":
            before = sums.get(u, 0)
            sums[u] = before + round(value * 100)
            if sums[u] > 20_000 >= before:
                want.append((u, i, sums[u]))
    assert want and sorted(tuple(x) for x in jobs.threshold_crossings(df, 20_000).collect()) == sorted(want)
    apply = jobs.crossings_of_batches(str(tmp_path / "s"), str(tmp_path / "o"), 20_000)
    for n in (0, 1, 1, 2):  # a batch that comes again changes nothing
        apply(df.filter(F.col("event_id").between(100 * n, 100 * n + 99)), n)
    assert sorted(tuple(x) for x in spark.read.schema("user_id bigint, event_id bigint, running bigint").parquet(str(tmp_path / "o/*")).collect()) == sorted(want)


def test_histogram_leaves_out_one(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.6,), (1.0,)], "risk_score double")
    assert [r["n"] for r in vendors.histogram(df).orderBy("bucket").collect()] == [1, 1, 0, 0, 0, 0, 1, 0, 0, 0]


def test_empty_dashboard(spark):
    inv = spark.createDataFrame([], "match_status string, total_tax bigint")
    row = kpis.dashboard(inv, spark.createDataFrame([], "status string")).first()
    assert (row["total_invoices"], row["at_risk_itc"], row["match_rate"]) == (0, 0, 0.0)


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"b2b": [{"ctin": "X", "inv": [{"inum": "1", "idt": "15-07-2025", "val": 10.5, "iamt": 1.26}]}]}')
    row = returns.gstr1(spark, str(tmp_path), "2025-07").first()
    assert (row["taxable"], row["igst"], row["cgst"], row["hsn"], row["invoice_date"]) == (1050, 126, 0, "", datetime.date(2025, 7, 15))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('{"other": 1}')
    assert returns.gstr2b(spark, str(tmp_path / "b"), "2025-07").count() == 0
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.json").write_text('[{"Irn": "I", "DocDtls": {"No": "7"}}]')
    assert tuple(returns.einvoices(spark, str(tmp_path / "e")).first()) == ("I", "7", "", "ACT")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text("ctin,inum,idt,val,rt,iamt,camt,samt,hsn\nX,1,2025-07-01,5,0,0,0,0,1\nX,2,bad,5,0,0,0,0,1\n")
    good, bad = returns.gstr1_csv(spark, str(tmp_path / "c"), "2025-07")
    assert (good.count(), bad.count()) == (1, 1)


def test_einvoice_arrays_are_bounded(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("I"), "id").alias("irn"), F.col("id").cast("string").alias("invoice_no"), F.lit("ACT").alias("status"))
    sinks.einvoice_documents(rows, 50).write.option("maxRecordsPerFile", 1).text(str(tmp_path / "d"))
    assert len(list((tmp_path / "d").glob("*.txt"))) >= 15
    assert returns.einvoices(spark, str(tmp_path / "d")).select("irn", "invoice_no", "status").exceptAll(rows).count() == 0


def test_shared_folder(spark):
    from taxrecon.sources import storage

    kept = storage.written(spark.range(5).withColumn("period", F.lit("2024-01")), "period")
    assert kept.columns == ["id", "period"] and kept.schema["period"].dataType.simpleString() == "string"
    path = storage._tables[-1]
    assert "period=2024-01" in kept.inputFiles()[0] and path.rsplit("/", 1)[1] in kept.inputFiles()[0]

    class Remote:
        class sparkContext:
            master = "spark://x:7077"
            getCheckpointDir = staticmethod(lambda: None)
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(Remote)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "p", 1), (1, "b", "p", 2), (2, "c", "q", 1)], "k int, v string, period string, stamp int")
    path = str(tmp_path / "t")
    sinks.upsert(path, rows.limit(0), rows, ["k"], "stamp")
    sinks.upsert(path, spark.createDataFrame([(1, "b", "p", 2)], rows.schema), spark.createDataFrame([(1, "z", "p", 3)], rows.schema), ["k"], "stamp")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]
    named = sinks.first_name(spark.createDataFrame([("g", "", 1), ("g", "N", 2), ("g", "M", 3), ("h", None, 1)], "g string, name string, stamp int"), "g", "name", "stamp")
    assert {r["g"]: r["name"] for r in named.collect()} == {"g": "N", "h": None}
    ids = sinks.numbered_ids(spark.range(25), "V", [F.col("id")], 990, name="vid").orderBy("id").collect()
    assert (ids[0]["vid"], ids[8]["vid"], ids[24]["vid"]) == ("V991", "V999", "V1015")
    assert sinks.links(rows, "period", "k").count() == 2
    assert sorted(r["p"] for r in sinks.ranked(spark.range(40), "p", [F.desc("id")]).filter("p = 39 - id").collect()) == list(range(40))


def test_communities_and_degrees(spark):
    inv = spark.createDataFrame([("a", "1", "p"), ("b", "1", "p"), ("b", "2", "p"), ("c", "2", "p"), ("d", "9", "p")], "vendor_id string, hsn string, period string")
    assert {r[0]: r[1] for r in graph.communities(inv).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


@pytest.mark.parametrize("name", [lambda i: i, lambda i: 0 if i == 69 else i + 1, lambda i: i * 37 % 70])
def test_communities_of_a_long_chain(spark, name):
    # Vendors i and i + 1 share code i alone.
    rows = [(f"v{name(i):03}", str(c), "p") for i in range(70) for c in (i - 1, i)]
    inv = spark.createDataFrame(rows, "vendor_id string, hsn string, period string")
    assert {r[1] for r in graph.communities(inv, rounds=20).collect()} == {"v000"}
    with pytest.raises(RuntimeError):
        graph.communities(inv, rounds=1)


def test_model_round_trip(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("v"), "id").alias("vendor_id"), *(((F.col("id") * (i + 3)) % 17).cast("double").alias(c) for i, c in enumerate(model.FEATURES)))
    data = model.labelled(rows)
    assert data.filter("label = 1").count() == pytest.approx(60, abs=3)
    train, test = model.split(data)
    assert train.count() + test.count() == 200
    fitted = model.train(train, trees=10)
    model.save(fitted, str(tmp_path / "m"))
    again = model.predict(model.load(str(tmp_path / "m")), test).orderBy("vendor_id").collect()
    assert again == model.predict(fitted, test).orderBy("vendor_id").collect()
    assert model.importances(fitted, spark).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert model.metrics(fitted, test)["accuracy"] > 0.6
    assert model.confusion(fitted, test).agg(F.sum("n")).first()[0] == test.count()


def test_change_feed_is_idempotent(spark, tmp_path):
    seen = []
    path = str(tmp_path / "t")
    apply = jobs.reconcile_changes(path, ["k"], "stamp", lambda s, periods: seen.append(sorted(r[0] for r in periods.collect())))
    batch = spark.createDataFrame([(1, "p", 1), (2, "q", 1)], "k int, period string, stamp int")
    apply(batch, 0)
    apply(batch, 0)
    assert spark.read.parquet(path).count() == 2 and seen == [["p", "q"], ["p", "q"]]
