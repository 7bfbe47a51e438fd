"""The domain tables, derived from the star-schema tables of a folder.

What every query starts from, one row per order and supplier, is built once per session and state of the source
tables, stored by period in the shared folder, and read from there: queries read the columns and periods they need.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import changes, reconcile, search_index, vendors
from ..sources.storage import is_there, state_of, written


#: Tables that were stored, by name, session, folder and state of its tables.
_stores: dict[tuple, DataFrame] = {}
SOURCES = ("lineitem", "orders", "customer", "supplier", "nation")
#: Documents of an invoice name it by all its keys.
DOCUMENT = ("gstin AS supplier_gstin", "invoice_no", "period")


def _key_text(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("ok").cast("string"), F.lit("-"), F.col("sk").cast("string"))


def _gstin(sk: Column, nation: Column) -> Column:
    full = F.concat(F.lpad((nation + 1).cast("string"), 2, "0"), F.lit("AB"), F.lpad((sk % 10**9).cast("string"), 9, "0"), F.lit("ZM"))
    return F.when(sk % 9 == 0, F.substring(full, 1, 14)).otherwise(full)  # some are faulty


#: What all else of an order and supplier follows from; only these columns move.
CORE = ["ok", "sk", "nation", "intra", "taxable", "tax", "mpk", "invoice_date"]
#: Parameter: rows that a task reconciles.
ROWS = 500_000


def _derived(core: DataFrame) -> DataFrame:
    """CORE columns, and maybe period, with what both books and all documents take from them."""
    core = core if "period" in core.columns else core.withColumn("period", text.period_of(F.col("invoice_date")))
    intra, s10 = F.col("intra"), F.col("sk") % 10
    b = core.withColumn("k", (F.col("ok") * 31 + F.col("sk")) % 100)
    k = F.col("k")
    b = b.withColumns({
        "gstin": _gstin(F.col("sk"), F.col("nation")), "invoice_no": _key_text("INV-"),
        "cgst": F.when(intra, F.expr("tax div 2")).otherwise(F.lit(0)).cast("bigint"),
        "sgst": F.when(intra, F.expr("tax - tax div 2")).otherwise(F.lit(0)).cast("bigint"),
        "igst": F.when(intra, F.lit(0)).otherwise(F.col("tax")).cast("bigint"),
        "hsn": (F.col("mpk") % 9000 + 1000).cast("string"), "hsn_other": ((F.col("mpk") + 1) % 9000 + 1000).cast("string"),
        "in_gstr1": k >= F.when(s10 < 5, 2).when(s10 < 9, 10).otherwise(30), "in_gstr2b": ~k.between(10, 14),
        "late": F.when(s10 == 9, k >= 30).otherwise(k.between(26, 33)), "due_date": text.due_date(F.col("invoice_date")),
    })
    off_days = F.when(F.col("late"), F.when(s10 == 9, 25 + F.col("sk") % 6).otherwise(F.col("sk") % 25 + 1)).otherwise(-(k % 5))
    return b.withColumn("filed_date", F.date_add("due_date", off_days.cast("int")))


def _gstr1(rows: DataFrame, *more: str) -> DataFrame:
    changed = F.col("k").between(15, 21)
    taxes = {c: F.when(changed, F.expr(f"{c} - {c} div 16")).otherwise(F.col(c)) for c in ("cgst", "sgst", "igst")}
    hsn = F.when(F.col("k").between(22, 25), F.col("hsn_other")).otherwise(F.col("hsn"))
    return rows.filter("in_gstr1").select(F.col("gstin").alias("supplier_gstin"), "invoice_no", "period", "invoice_date", "taxable", *(v.alias(c) for c, v in taxes.items()), hsn.alias("hsn"), "filed_date", "due_date", *more)


def _gstr2b(rows: DataFrame, *more: str) -> DataFrame:
    return rows.filter("in_gstr2b").select(F.col("gstin").alias("supplier_gstin"), "invoice_no", "period", "invoice_date", "taxable", "cgst", "sgst", "igst", "hsn", F.when(F.col("k").between(40, 44), "N").otherwise("Y").alias("itc_available"), *more)


def _eway_bills(rows: DataFrame, *more: str) -> DataFrame:
    return rows.filter((F.col("ok") + 3 * F.col("sk")) % 17 != 0).select(_key_text("EWB-").alias("ewb_no"), *map(F.expr, DOCUMENT), F.col("invoice_date").alias("ewb_date"), *more)


def _einvoices(rows: DataFrame, *more: str) -> DataFrame:
    return rows.filter((F.col("ok") + 5 * F.col("sk")) % 13 != 0).select(_key_text("IRN-").alias("irn"), *map(F.expr, DOCUMENT), F.lit("ACT").alias("status"), *more)


class Domain:
    """Lazy tables: the books gstr1 and gstr2b, einvoices, eway_bills, vendor_master, and what follows from
    them: unified (one row per invoice in either book), invoices (flat) and vendors (scored)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def vendor_master(self) -> DataFrame:
        """A row per supplier, stored: a join of both tables has no size that is known to be small, and invoices would move to it."""
        return self.kept("vendor master", self._vendor_master)

    def _vendor_master(self) -> DataFrame:
        sk = F.col("s_suppkey")
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(sk.alias("sk"), F.concat(F.lit("V"), F.lpad(sk.cast("string"), 6, "0")).alias("vendor_id"), F.col("s_name").alias("name"), _gstin(sk, F.col("n_nationkey")).alias("gstin"), F.col("n_name").alias("state"), F.col("n_regionkey").alias("region"))

    def _stored(self, name: str, make: Callable[[], DataFrame], lookup: tuple[str, ...] = (), by: str | None = "period", spread: bool = True) -> DataFrame:
        """A table by period (or another column), computed once a session and state of the source tables. Its files follow it, the
        large ones in parts, and lie in the order of the columns for lookups; unless spread, rows stay where they are."""
        key = (name, self.spark.sparkContext.applicationId, self.sf_dir, *(state_of(self.spark, f"{self.sf_dir}/{n}.parquet") for n in SOURCES))
        if key not in _stores or not is_there(self.spark, _stores[key]):
            rows = make().hint("rebalance", by) if spread else make()
            _stores[key] = written(rows.sortWithinPartitions(by, *lookup) if lookup else rows, *([by] if by else []), lookup=lookup)
        return _stores[key]

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A small table that takes long to make, stored like the others."""
        return self._stored(name, make, by=None, spread=False)

    @cached_property
    def base(self) -> DataFrame:
        """One row per (order, supplier), stored by period: both books and all documents come from it."""
        return self._stored("base", self._computed, spread=False)

    def _computed(self) -> DataFrame:
        """The base from the star schema. The join on the order key comes first: the aggregation by order and
        supplier then needs no shuffle of its own."""
        price, off = F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.round(F.col("l_discount") * 100).cast("bigint")
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_suppkey").alias("sk"), F.col("l_partkey").alias("pk"), price.alias("price"), off.alias("off"))
        lines = lines.withColumn("line_taxable", F.expr("(price * (100 - off) + 5) div 10")).withColumn("rate", F.expr("element_at(array(5L, 12L, 18L, 28L), cast(pk % 4 as int) + 1)"))
        lines = lines.withColumn("line_tax", F.expr("(line_taxable * rate + 50) div 100")).select("ok", "sk", "pk", "line_taxable", "line_tax")
        nation = self.table("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
        buyers = self.table("customer").join(nation, F.col("c_nationkey") == F.col("nation")).select("c_custkey", F.col("region").alias("buyer_region"))
        orders = self.table("orders").select(F.col("o_orderkey").alias("ok"), "o_custkey", F.col("o_orderdate").cast("date").alias("invoice_date")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("ok", "invoice_date", "buyer_region")
        per = lines.join(orders, "ok").groupBy("ok", "sk").agg(F.sum("line_taxable").alias("taxable"), F.sum("line_tax").alias("tax"), F.min("pk").alias("mpk"), F.first("invoice_date").alias("invoice_date"), F.first("buyer_region").alias("buyer_region"))
        # The supplier and the nation one after the other: a join of both has no size that is known to be small.
        sellers = self.table("supplier").select(F.col("s_suppkey").alias("sk"), F.col("s_nationkey").alias("nation"))
        core = per.join(sellers, "sk").join(nation, "nation").withColumn("intra", F.col("region") == F.col("buyer_region"))
        placed = core.select(*CORE, vendors.month_index().alias("month")).hint("rebalance", "month").drop("month")
        return _derived(placed).sortWithinPartitions("period", "ok", "sk")

    @cached_property
    def gstr1(self) -> DataFrame:
        return _gstr1(self.base)

    @cached_property
    def gstr2b(self) -> DataFrame:
        return _gstr2b(self.base)

    @cached_property
    def eway_bills(self) -> DataFrame:
        return _eway_bills(self.base)

    @cached_property
    def einvoices(self) -> DataFrame:
        return _einvoices(self.base)

    def near(self, named: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """gstr1, gstr2b, einvoices and eway_bills of the invoices that named has (by reconcile.KEYS): the base's core meets
        their digests once, and the tables are made of what is left. Another invoice with the digest of one stays."""
        digests = named.select(F.xxhash64(*reconcile.KEYS).alias("digest")).distinct()
        core = self.base.select(*CORE, "period", F.xxhash64("gstin", "invoice_no", "period").alias("digest"))
        # Bitmaps are sent first: of the core what may be named moves alone, where digests are too many to be sent.
        rows = _derived(written(changes.likely(core, digests, "digest").join(digests, "digest", "left_semi").drop("digest")))
        return _gstr1(rows), _gstr2b(rows), _einvoices(rows), _eway_bills(rows)

    @cached_property
    def unified(self) -> DataFrame:
        """The reconciled invoices, stored by period: one full outer join a session, and lookups by key read the row
        groups that may hold it."""
        held: list[DataFrame] = []
        # Rows of a share of a period meet where they lie, though the joins are by more columns than these two.
        name = "spark.sql.requireAllClusterKeysForCoPartition"
        was = self.spark.conf.get(name)
        self.spark.conf.set(name, "false")
        try:
            return self._stored("unified", lambda: self._reconciled(held), ("invoice_no", "supplier_gstin"), spread=False)
        finally:
            self.spark.conf.set(name, was)
            for df in held:
                df.unpersist()

    def _reconciled(self, held: list[DataFrame]) -> DataFrame:
        """Both books and the documents joined where their rows lie: the base's core moves once, to shares of a period
        of a bounded size, and stays there for all joins and the writer. What is held is to be released."""
        n, periods = self.base.count(), max(1, self.base.select("period").distinct().count())
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), n // ROWS)
        share = F.pmod(F.xxhash64("ok", "sk"), F.lit(-(-2 * parts // periods))).cast("int")
        placed = self.base.select(*CORE, "period", share.alias("share")).repartition(parts, "period", "share")
        held.append(_derived(placed).persist())
        held[0].count()
        books = (f(held[0], "share") for f in (_gstr1, _gstr2b, _einvoices, _eway_bills))
        return reconcile.unified(*books, also=("share",)).drop("share")

    @cached_property
    def invoices(self) -> DataFrame:
        return reconcile.enriched(self.unified, self.vendor_master)

    @cached_property
    def vendors(self) -> DataFrame:
        return vendors.scored(self.vendor_master, vendors.compliance(self.unified))

    def _index(self, name: str, rows: Callable[[], DataFrame], text_: str, *keys: str) -> tuple[DataFrame, DataFrame]:
        """Texts in blocks, the blocks' runs, and how many texts have each run."""
        texts = self._stored(name, lambda: search_index.blocks(rows(), text_, *keys), by="part", spread=False)
        found = self._stored(f"{name} postings", lambda: search_index.block_postings(texts), ("run",), "bucket")
        return search_index.blocked(texts, found), self._stored(f"{name} runs", lambda: search_index.block_frequencies(found), ("run",), "bucket")

    @cached_property
    def id_index(self) -> tuple[DataFrame, DataFrame]:
        """The index of the invoices' numbers, and how many each run has."""
        return self._index("ids", lambda: self.unified, "invoice_no", "supplier_gstin", "period")

    @cached_property
    def name_index(self) -> tuple[DataFrame, DataFrame]:
        """The index of the vendors' names."""
        return self._index("names", lambda: self.vendor_master, "name", "gstin")
