"""The vendor, invoice and return graph as node and edge tables, and iterative measures on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.storage import checkpointed, written
from .reconcile import mismatched


def nodes(vendors: DataFrame, invoices: DataFrame) -> DataFrame:
    """id, label, group, flagged of vendors, the two returns of each period, invoices and their documents; and what a
    node of its group knows besides: gstin, risk, state and status of a vendor, period of a return, status and amount
    of an invoice."""
    kinds = {"flagged": "boolean", "gstin": "string", "risk": "double", "state": "string", "status": "string", "period": "string", "amount": "bigint"}

    def node(id_, label, group: str, **known) -> Column:
        return F.struct(id_.alias("id"), label.alias("label"), F.lit(group).alias("group"), *(known.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))

    invoice_id, tail = F.col("invoice_id"), F.right("invoice_id", F.lit(3))
    own = [
        node(F.concat(F.lit("i-"), invoice_id), text.short_id(invoice_id), "invoice", flagged=mismatched(), status=F.when(mismatched(), "flagged").otherwise("matched"), amount=F.col("total")),
        F.when(F.col("has_einvoice"), node(F.concat(F.lit("e-"), invoice_id), F.concat(F.lit("IRN-"), tail), "einvoice")),
        F.when(F.col("has_eway_bill"), node(F.concat(F.lit("w-"), invoice_id), F.concat(F.lit("EWB-"), tail), "ewaybill")),
    ]
    returns = invoices.select("period").filter("period <> ''").distinct().select("period", F.explode(F.array(F.lit("GSTR-1"), F.lit("GSTR-2B"))).alias("type"))
    parts = [
        vendors.select(node(F.concat(F.lit("v-"), "vendor_id"), text.shortened(F.col("name")), "vendor", gstin=F.col("gstin"), risk=F.col("risk_score"), state=F.col("state"), status=F.col("status")).alias("x")),
        returns.select(node(F.concat(F.lit("g-"), "type", F.lit("-"), "period"), F.concat("type", F.lit(" "), text.period_label(F.col("period"))), "gstr", period=F.col("period")).alias("x")),
        invoices.select(F.explode(F.array_compact(F.array(*own))).alias("x")),
    ]
    return reduce(DataFrame.unionByName, parts).select("x.*")


def edges(invoices: DataFrame) -> DataFrame:
    """source, target, label, type, from one pass over invoices; one without a known vendor has no ISSUED edge."""

    def edge(cond: Column, source: Column, target: Column, label: str, kind: str) -> Column:
        return F.when(cond, F.struct(source.alias("source"), target.alias("target"), F.lit(label).alias("label"), F.lit(kind).alias("type")))

    def named(prefix: str, column: str) -> Column:
        return F.concat(F.lit(prefix), column)

    own, dated = named("i-", "invoice_id"), F.col("period") != ""
    found = [
        edge(F.col("vendor_id").isNotNull(), named("v-", "vendor_id"), own, "ISSUED", "issued"),
        edge(dated & F.col("in_gstr2b"), own, named("g-GSTR-2B-", "period"), "IN_2B", "reported"),
        edge(dated & F.col("in_gstr1"), own, named("g-GSTR-1-", "period"), "IN_1", "reported"),
        edge(F.col("has_einvoice"), own, named("e-", "invoice_id"), "E_INV", "einvoice"),
        edge(F.col("has_eway_bill"), own, named("w-", "invoice_id"), "EWB", "ewaybill"),
    ]
    return invoices.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.*")


def summarized_in(filings: DataFrame) -> DataFrame:
    """Edges from each return to the summary return of its period."""
    return filings.select(F.concat(F.lit("g-"), "type", F.lit("-"), "period").alias("source"), F.concat(F.lit("g-GSTR-3B-"), "period").alias("target"), F.lit("SUMMARIZED_IN").alias("label"), F.lit("summary").alias("type"))


def summary_returns(filings: DataFrame) -> DataFrame:
    """The summary return of each period, to which the SUMMARIZED_IN edges lead: period, what the suppliers report and
    owe, what the buyer may claim, and the difference."""

    def of(kind: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col(column))), F.lit(0))

    rows = filings.groupBy("period").agg(of("GSTR-1", "total_taxable").alias("outward_taxable"), of("GSTR-1", "total_tax").alias("outward_tax"), of("GSTR-2B", "total_tax").alias("input_tax"))
    return rows.withColumn("net_tax", F.col("outward_tax") - F.col("input_tax"))


def summary_nodes(filings: DataFrame) -> DataFrame:
    """id, label, group, period, amount (the net tax) of the summary returns."""
    rows = summary_returns(filings)
    return rows.select(F.concat(F.lit("g-GSTR-3B-"), "period").alias("id"), F.concat(F.lit("GSTR-3B "), text.period_label(F.col("period"))).alias("label"), F.lit("gstr").alias("group"), "period", F.col("net_tax").alias("amount"))


def layers(nodes_: DataFrame, edges_: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes of some groups and the edges that stay inside them."""
    seen = nodes_.filter(F.col("group").isin(groups))
    ids = seen.select("id")
    inside = edges_.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return seen, inside


def stats(nodes_: DataFrame) -> DataFrame:
    return nodes_.groupBy("group").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"))


def degrees(edges_: DataFrame) -> DataFrame:
    return edges_.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def top_nodes(nodes_: DataFrame, edges_: DataFrame, n: int = 200) -> DataFrame:
    """At most n nodes, by degree."""
    return nodes_.join(degrees(edges_), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "id").limit(n)


def around(nodes_: DataFrame, edges_: DataFrame, n: int = 200) -> DataFrame:
    """The edges among the n nodes of the highest degree."""
    return among(written(top_nodes(nodes_, edges_, n).select("id")), edges_)


def capped(edges_: DataFrame, n: int = 200) -> DataFrame:
    """id, group: at most n nodes that hang together: a fifth of them the vendors with the most invoices, two fifths
    those of their invoices with the most edges, the rest what most of these lead to; ties go to the smallest id."""

    def first(rows: DataFrame, most: int) -> DataFrame:
        # Read twice below, and at most n rows.
        return F.broadcast(written(rows.orderBy(F.desc("degree"), "id").limit(most).select("id", "group")))

    issued, onward = edges_.filter("type = 'issued'"), edges_.filter("type <> 'issued'")
    vendors = first(issued.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("degree")).withColumn("group", F.lit("vendor")), n // 5)
    theirs = issued.join(vendors.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
    out = onward.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("degree"))
    invoices = first(theirs.join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit("invoice").alias("group")), 2 * n // 5)
    met = onward.join(invoices.select(F.col("id").alias("source")), "source").withColumn("group", F.when(F.col("type") == "reported", "gstr").otherwise(F.col("type")))
    rest = first(met.groupBy(F.col("target").alias("id"), "group").agg(F.count("*").alias("degree")), n - n // 5 - 2 * n // 5)
    return vendors.unionByName(invoices).unionByName(rest)


def among(ids: DataFrame, edges_: DataFrame) -> DataFrame:
    """The edges among a few nodes."""
    few = F.broadcast(ids.select("id"))
    return edges_.join(few.withColumnRenamed("id", "source"), "source", "left_semi").join(few.withColumnRenamed("id", "target"), "target", "left_semi")


def hops(edges_: DataFrame, seeds: DataFrame, k: int = 3, hub: int = 1000) -> DataFrame:
    """seed, id, hop, path: what lies within k edges, in either direction, of each seed (id), with the shortest path to it
    from the seed, ids joined by >; of several the first by name. A node with more than hub edges is reached, but the
    search doesn't go through it, as half of everything is behind it. Nodes are visited once per seed."""
    ends = F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))
    both = edges_.select(F.explode(ends).alias("x")).select("x.*")
    # Written by themselves: seeds that are the first of an order are then taken from each task, not sorted whole.
    front = written(seeds.select("id").distinct())
    visited = written(front.select(F.col("id").alias("seed"), "id", F.col("id").alias("path"), F.lit(0).alias("hop")))
    for hop in range(1, k + 1):
        last = open_ = visited.filter(F.col("hop") == hop - 1)
        if hop > 1:
            # Edges are counted at the nodes of the front alone, so few rows move.
            counts = both.join(last.select(F.col("id").alias("a")).distinct(), "a", "left_semi").groupBy("a").agg(F.count("*").alias("degree"))
            wide = written(counts.filter(F.col("degree") > hub).select(F.col("a").alias("wide")))
            open_ = last.join(wide, F.col("id") == F.col("wide"), "left_anti")
        reached = open_.join(both, open_["id"] == both["a"]).select("seed", F.col("b").alias("to"), F.concat("path", F.lit(">"), "b").alias("path"))
        new = reached.groupBy("seed", "to").agg(F.min("path").alias("path")).withColumnRenamed("to", "id").join(visited.select("seed", "id"), ["seed", "id"], "left_anti")
        visited = written(visited.unionByName(new.select("seed", "id", "path", F.lit(hop).alias("hop"))))
    return visited.select("seed", "id", "hop", "path")


def vendor_connections(edges_: DataFrame) -> DataFrame:
    """Per vendor its invoices, and the returns and documents these lead to."""
    issued = edges_.filter("type = 'issued'").select(F.substring("source", 3, 100).alias("vendor_id"), F.col("target").alias("id"))
    onward = edges_.filter("type <> 'issued'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    return issued.join(onward, "id", "left").groupBy("vendor_id").agg(F.count("*").alias("invoices"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))


def pagerank(nodes_: DataFrame, edges_: DataFrame, rounds: int = 10, damping: float = 0.85, every: int = 5) -> DataFrame:
    """id, rank; ranks sum to 1. What nodes give along their out-edges to other nodes is counted, and the rest, which
    nodes without out-edges keep, is spread evenly: one sum per round instead of a join. Nodes, links and ranks lie
    by id for all rounds, so only what is given moves, summed before it does, hubs too. Every few rounds end in a
    checkpoint, from which lost partitions are computed again."""
    out = edges_.select(F.col("source").alias("id"), "target")
    links = out.join(out.groupBy("id").agg(F.count("*").alias("out")), "id").withColumn("w", F.lit(1))
    return _ranked(nodes_.select("id").distinct().withColumn("m", F.lit(1)), links, rounds, damping, every)


def vendor_ranks(vendors: DataFrame, invoices: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """vendor_id, rank as pagerank() gives them over vendors, invoices and returns."""
    ranks = _class_ranks(vendors, _placed_invoices(invoices), invoices, rounds, damping)
    return ranks.filter("id like 'v-%'").select(F.substring("id", 3, 100).alias("vendor_id"), "rank")


def invoice_ranks(vendors: DataFrame, invoices: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """id, rank as pagerank() gives them over vendors, invoices and returns. Invoices take the rank of their class."""
    placed = _placed_invoices(invoices)
    # A row per vendor, return and class, stored, so plans know how small it is.
    ranks = written(_class_ranks(vendors, placed, invoices, rounds, damping))
    own = placed.select("invoice_id", F.col("class").alias("id")).join(ranks, "id").select(F.concat(F.lit("i-"), "invoice_id").alias("id"), "rank")
    return ranks.filter("id not like 'i-%'").unionByName(own)


def _placed_invoices(invoices: DataFrame) -> DataFrame:
    """invoice_id, class, of, to: of an invoice the vendors that issued it and the returns that it leads to, with as many
    names as edges. Its class says the former: invoices of the same vendors are given the same in every round."""
    dated = F.col("period") != ""
    to = F.array_compact(F.array(*(F.when(dated & F.col(c), F.concat(F.lit(f"g-{kind}-"), "period")) for c, kind in (("in_gstr1", "GSTR-1"), ("in_gstr2b", "GSTR-2B")))))
    per = invoices.groupBy("invoice_id").agg(F.sort_array(F.collect_list("vendor_id")).alias("of"), F.flatten(F.collect_list(to)).alias("to"))
    return written(per.withColumn("class", F.concat(F.lit("i-"), F.to_json("of"))))


def _class_ranks(vendors: DataFrame, placed: DataFrame, invoices: DataFrame, rounds: int, damping: float) -> DataFrame:
    """id, rank of vendors, returns and classes of invoices. A class is one node with the number of its invoices, and a link
    to a return has the sum of the shares that they give it, so a round takes as many rows as classes have returns."""
    classes = written(placed.groupBy("class", "of").agg(F.count("*").alias("m")))
    issued = classes.select(F.col("class").alias("target"), "m", F.explode("of").alias("v")).select(F.concat(F.lit("v-"), "v").alias("id"), "target", F.lit(1.0).alias("w"), F.col("m").alias("n"))
    out = issued.groupBy("id").agg(F.sum("n").alias("out"))
    reported = placed.select(F.col("class").alias("id"), (1 / F.size("to")).alias("share"), F.explode("to").alias("target")).groupBy("id", "target").agg(F.sum("share").alias("w"))
    links = issued.join(out, "id").select("id", "target", "w", "out").unionByName(reported.select("id", "target", "w", F.lit(1).cast("bigint").alias("out")))
    returns = invoices.select("period").filter("period <> ''").distinct().select(F.explode(F.array(*(F.concat(F.lit(f"g-{kind}-"), "period") for kind in ("GSTR-1", "GSTR-2B")))).alias("id"))
    single = vendors.select(F.concat(F.lit("v-"), "vendor_id").alias("id")).distinct().unionByName(returns).withColumn("m", F.lit(1).cast("bigint"))
    return _ranked(single.unionByName(classes.select(F.col("class").alias("id"), "m")), links, rounds, damping, 5)


def _ranked(nodes_: DataFrame, links: DataFrame, rounds: int, damping: float, every: int) -> DataFrame:
    """id, rank of nodes (id, m: how many it stands for) and links (id, target, out: the edges of one node, w: from how
    many nodes of the source one of the target gets)."""
    spark = nodes_.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def placed(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "id").sortWithinPartitions("id").persist()

    ids = placed(written(nodes_))
    n = ids.agg(F.sum("m")).first()[0]
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    links = placed(written(links))
    ranks, held = ids.withColumn("rank", F.lit(1.0 / n)), [ids, links]
    for i in range(1, rounds + 1):
        given = links.join(ranks.select("id", "rank"), "id").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") / F.col("out") * F.col("w")).alias("got"))
        new = ids.join(given, "id", "left").select("id", "m", F.coalesce("got", F.lit(0.0)).alias("got"))
        if i == rounds:
            new = checkpointed(new)
        else:
            new = placed(checkpointed(new)) if i % every == 0 else new.persist()
            held.append(new)
        lost = 1.0 - (new.agg(F.sum(F.col("got") * F.col("m"))).first()[0] or 0.0)
        ranks = new.select("id", (F.lit((1 - damping) / n) + F.lit(damping) * (F.col("got") + F.lit(lost / n))).alias("rank"))
    for df in held:
        df.unpersist()
    return ranks


def communities(invoices: DataFrame, rounds: int = 200) -> DataFrame:
    """vendor_id, community: the smallest vendor reached through shared HSN codes of a period. A vendor and
    a code group exchange their smallest label each round, so no vendor pairs are made. All vendors of a label take
    the smallest that any of them met, then the label of the vendor that it names, so long chains shrink fast.
    Raises if labels still move after rounds."""
    member = checkpointed(invoices.filter("vendor_id is not null").select("vendor_id", F.concat_ws("|", "hsn", "period").alias("g")).distinct())
    labels = member.select("vendor_id").distinct().withColumn("community", F.col("vendor_id"))
    for _ in range(rounds):
        by_group = member.join(labels, "vendor_id").groupBy("g").agg(F.min("community").alias("low"))
        met = member.join(by_group, "g").groupBy("vendor_id").agg(F.min("low").alias("low"))
        lowest = labels.join(met, "vendor_id").groupBy("community").agg(F.min("low").alias("low"))
        near = checkpointed(labels.join(lowest, "community").select("vendor_id", F.col("low").alias("community")))
        ahead = near.select(F.col("vendor_id").alias("community"), F.col("community").alias("next"))
        new = checkpointed(near.join(ahead, "community").select("vendor_id", F.col("next").alias("community")))
        moved = new.join(labels.withColumnRenamed("community", "was"), "vendor_id").filter("community <> was").limit(1).count()
        labels = new
        if not moved:
            return labels
    raise RuntimeError(f"communities still grow after {rounds} rounds")
