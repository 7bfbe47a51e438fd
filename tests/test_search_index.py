"""Search by runs of characters against a look at every text."""

import random

import pytest

from taxrecon.operators import search_index as M
from taxrecon.plans.domain import Domain


@pytest.fixture(scope="module")
def index(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("aAbB1-É %_") for _ in range(r.randrange(9))) for _ in range(400)] + [None, "", "abc" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = M.postings(rows, "t", "k").persist()
    return texts, found, M.frequencies(found).persist()


def test_every_term_finds_what_a_scan_finds(index):
    texts, found, counts = index
    r = random.Random(7)
    terms = ["a", "B", "É", "-", "a1", "b-", "A1b", "%", "_", "zz", "abcabcabca", " "] + [t[i : i + r.randrange(1, 5)] for t in r.sample([t for t in texts if t], 12) for i in [r.randrange(len(t))]]
    for term in terms:
        want = [i for i, t in enumerate(texts) if t is not None and term.lower() in t.lower()]
        assert sorted(x["k"] for x in M.matches(found, counts, term).collect()) == want, term


def test_runs_of_a_text(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("AbA",), ("x",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(M.runs(F.col("t"))).collect()]
    assert sorted(got[0]) == ["a", "ab", "aba", "b", "ba"] and got[1] == ["x"] and not got[2] and not got[3]


def test_many_and_few_matches_give_the_same(spark, sf_dir, monkeypatch):
    d = Domain(spark, sf_dir)
    from taxrecon.operators import reconcile

    def rows(df):
        return sorted(tuple(r) for r in df.select("supplier_gstin", "invoice_id", "period", "vendor_name").collect())

    for term in ("9-1", "inv-", "#000000003", "nothing like it", ""):
        want = rows(reconcile.search(d.invoices, term=term, hide_matched=False))
        for few in (0, 1000):
            monkeypatch.setattr(M, "FEW", few)
            assert rows(M.found(d.invoices, d.id_index, d.name_index, term)) == want, (term, few)


def test_a_term_reads_its_bucket_and_few_invoices(spark, sf_dir):
    d = Domain(spark, sf_dir)
    plan = M.matches(*d.id_index, "INV-1-")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(run," in plan
    found = M.found(d.invoices, d.id_index, d.name_index, "INV-1-")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(invoice_no, [" in plan or "EqualTo(invoice_no," in plan
    assert found.count() == d.invoices.filter("invoice_id like 'INV-1-%'").count() > 0


def test_blocks_find_what_postings_of_texts_find(index, spark):
    texts, found, counts = index
    stored = M.blocks(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "t", "k").persist()
    named = M.block_postings(stored).persist()
    assert {(r["run"], r["n"]) for r in M.block_frequencies(named).collect()} == {(r["run"], r["n"]) for r in counts.collect()}
    for term in ("a", "É", "a1", "A1b", "abcabcabca", "zz", "%"):
        want = sorted(r["k"] for r in M.matches(found, counts, term).collect())
        assert sorted(r["k"] for r in M.matches(M.blocked(stored, named), M.block_frequencies(named), term).collect()) == want, term


def test_an_index_is_smaller_than_its_rows(spark, sf_dir):
    """Texts are stored once, not under every run, and a term of many matches joins no invoices."""
    d = Domain(spark, sf_dir)
    n = d.unified.count()
    texts = d._index("ids", lambda: d.unified, "invoice_no", "supplier_gstin", "period")[0]
    assert sum(spark.read.parquet(f).count() for f in texts.inputFiles()) < 2 * n
    plan = M.found(d.invoices, d.id_index, d.name_index, "inv-")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and plan.count("SortMergeJoin") == plan.count("SortMergeJoin [supplier_gstin") and "LeftSemi" not in plan


def test_runs_of_blocks_are_those_of_texts(spark):
    """Counts by block, taken a place at a time, are those of the texts' distinct runs."""
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(t, n % 2, n % 3) for n, t in enumerate(["aaaa", "ab", "a", "INV-11-1", "é日本é日本", "İİ", "  ", "Ab ab aB", "😀x😀x😀", "abcabcabc"])], "text string, part int, block int")
    plain = texts.select("part", "block", F.explode(M.runs(F.col("text"))).alias("run")).groupBy("part", "block", "run").agg(F.count("*").alias("n"))
    found = M.block_postings(texts)
    assert sorted(map(tuple, found.drop("bucket").select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct" not in plan and "lambda" not in plan
