"""Figures kept by signed changes against figures from scratch."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from taxrecon.operators import changes, reconcile

DOCS = "supplier_gstin string, invoice_no string, period string"


def types(name):
    known = {c.split()[0]: c.split()[1] for c in changes.CHANGES.split(", ")}
    return ", ".join(f"{c} {known[c]}" for c in changes.BOOKS[name])


def row(name, key, r):
    day = date(2024, int(key[2][-2:]), 5)
    head = (*key, day, 6_000_000, r.choice([100, 200]), 100, 0, r.choice(["11", "22"]))
    return (*head, day + timedelta(r.choice([30, 60])), day + timedelta(45)) if name == "gstr1" else (*head, "Y")


@pytest.fixture(scope="module")
def world(spark):
    """Books of 60 invoices and three batches of random changes, with the books after each."""
    r = random.Random(8)
    keys = [(f"S{i % 4}", f"{i}", f"2024-{1 + i % 3:02}") for i in range(60)]
    books = {name: {k: row(name, k, r) for k in keys if r.random() < 0.7} for name in changes.BOOKS}
    first = {name: dict(rows) for name, rows in books.items()}
    batches, states, seq = [], [], 0
    for _ in range(3):
        batch = []
        for _ in range(30):
            seq += 1
            name, key = r.choice(list(changes.BOOKS)), r.choice(keys[:40])
            op = r.choice(["upsert", "upsert", "delete"])
            own = row(name, key, r)
            if op == "upsert":
                books[name][key] = own
            else:
                books[name].pop(key, None)
            at = dict(zip(changes.BOOKS[name], own, strict=True)) if op == "upsert" else dict(zip(reconcile.KEYS, key, strict=True))
            batch.append((seq, name, op, *(at.get(c.split()[0]) for c in changes.CHANGES.split(", ")[3:])))
        r.shuffle(batch)
        batches.append(batch)
        states.append({name: dict(rows) for name, rows in books.items()})
    documents = spark.createDataFrame([k for k in keys if r.random() < 0.5], DOCS)
    papers = documents.withColumn("status", F.lit("ACT")), documents

    def frames(state):
        return [spark.createDataFrame(list(state[name].values()), types(name)) for name in ("gstr1", "gstr2b")]

    return frames, first, batches, states, papers


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_figures_follow_changes(spark, world, tmp_path):
    frames, first, batches, states, papers = world
    before = reconcile.unified(*frames(first), *papers)
    apply = changes.maintained(*frames(first), *papers, str(tmp_path))
    for i, batch in enumerate(batches):
        apply(spark.createDataFrame(batch, changes.CHANGES), i)
        if i == 1:
            apply(spark.createDataFrame(batch, changes.CHANGES), i)  # one that comes again changes nothing
        now = reconcile.unified(*frames(states[i]), *papers)
        for name in changes.FIGURES:
            got = changes.current(spark, str(tmp_path), name, changes.figures(before, name))
            assert rows(got) == rows(changes.figures(now, name)), (i, name)


def test_a_correction_moves_its_own_figures_alone(spark, world):
    frames, first, _, _, papers = world
    key, old = next((k, v) for k, v in first["gstr1"].items() if k in first["gstr2b"])
    fixed = dict(zip(changes.BOOKS["gstr1"], old, strict=True)) | {"cgst": 999}
    change = spark.createDataFrame([(1, "gstr1", "upsert", *(fixed.get(c.split()[0]) for c in changes.CHANGES.split(", ")[3:]))], changes.CHANGES)
    found = changes.signed(*frames(first), *papers, change).collect()
    assert len(found) == 2 and {r["sign"] for r in found} == {-1, 1} and {(r["supplier_gstin"], r["invoice_no"], r["period"]) for r in found} == {key}
    assert {r["match_status"] for r in found if r["sign"] == 1} == {"Tax Amount Mismatch"}
    same = spark.createDataFrame([(1, "gstr1", "upsert", *(dict(zip(changes.BOOKS["gstr1"], old, strict=True)).get(c.split()[0]) for c in changes.CHANGES.split(", ")[3:]))], changes.CHANGES)
    assert changes.figures(changes.signed(*frames(first), *papers, same), "status").count() == 0


def test_no_changes_and_unknown_deletions(spark, world, tmp_path):
    frames, first, _, _, papers = world
    none = spark.createDataFrame([], changes.CHANGES)
    gone = spark.createDataFrame([(1, "gstr1", "delete", "S9", "none", "2024-01", *[None] * 9)], changes.CHANGES)
    for batch in (none, gone):
        assert changes.signed(*frames(first), *papers, batch).count() == 0


def test_metrics_are_those_of_a_full_pass(spark, world):
    from taxrecon.operators import vendors

    frames, first, _, _, papers = world
    unified = reconcile.unified(*frames(first), *papers)
    assert rows(changes.metrics(changes.figures(unified, "vendor_month"))) == rows(vendors.compliance(unified))


def test_bitmaps_let_all_named_rows_through(spark):
    """What is named stays, and little else; more values than bits let more through and lose none."""
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(F.xxhash64("id").alias("digest"), "id")
    named = rows.filter("id % 20 = 3").select("digest")
    kept = changes.likely(rows, named, "digest")
    assert kept.columns == rows.columns and named.exceptAll(kept.select("digest")).isEmpty()
    assert 3_000 <= kept.count() < 9_000
    most, changes.MOST = changes.MOST, 1 << 10
    try:
        assert named.exceptAll(changes.likely(rows, named, "digest").select("digest")).isEmpty()
    finally:
        changes.MOST = most
    assert changes.likely(rows, named.limit(0), "digest").isEmpty()


def test_a_batch_moves_once(spark, sf_dir):
    """Near tables and the changes lie by digest; neither joins nor what changes are laid over moves them again."""
    from taxrecon.plans.domain import Domain

    d, names = Domain(spark, sf_dir), {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    base = d.base.filter("ok % 10 = 1").withColumn("supplier_gstin", d.base["gstin"]).withColumn("itc_available", d.base["hsn"])
    before, new = changes.change(base, "gstr1", "delete", 1), changes.change(base.filter("sk % 2 = 0"), "gstr1", "upsert", 2).unionByName(changes.change(base, "gstr2b", "delete", 2))
    near, held, was = d.near(changes.named_by(new)), [], {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        rows = changes.signed(*near, new, before, near=True, held=held)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        plain = changes.signed(d.gstr1, d.gstr2b, d.einvoices, d.eway_bills, new, before)
        for name in changes.FIGURES:
            got, want = changes.figures(rows, name), changes.figures(plain, name)
            assert want.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    finally:
        for n, v in was.items():
            spark.conf.set(n, v)
    other = plain._jdf.queryExecution().executedPlan().toString()
    moves = [sum("Exchange" in line and "ENSURE_REQUIREMENTS" in line for line in text.split("\n")) for text in (plan, other)]
    assert len(held) == 2 and moves[0] * 3 < moves[1], moves
    for df in held:
        df.unpersist()
