"""Exact top-k inner-product search by dual-tree cover trees.

Vectors are dealt to cells by their nearest pivots, so a data shard, and a query block, lies in one part of the
space; each becomes a cover tree. A search walks both trees together: for a query node (centre a, covering
radius r) and a data node (centre b, radius s) no score can exceed a.b + r|b| + s|a| + rs, and the pair of nodes
is left out where that is below the worst kth score that the node's queries already have. A block searches a
shard that fits it well first. Above the shards stand the balls of cells and of groups of cells: a block goes down
from these, and meets those shards alone whose ball, and all balls above it, can still reach that worst score.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

#: Parameters: rows per data shard, queries per block, query blocks that meet a shard in one task, points per
#: leaf, pivots (a bounded sample of the data), balls of the top level up to which they go to every task.
SHARD_ROWS, QUERY_ROWS, LANE, LEAF, PIVOTS, ROOTS = 4096, 1024, 8, 64, 16_384, 16_384
#: A node is split only if its children, at half its radius, hold so many points each on average.
SPLIT = 8
_NODE = np.dtype([("lo", "<i4"), ("hi", "<i4"), ("kids", "<i4"), ("n_kids", "<i4"), ("radius", "<f8")])
_LEAST = np.iinfo(np.int64).min


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(axis=1))


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, centres): the points of each node are order[lo:hi], all within radius of its centre.
    The children of a node have centres more than half its radius apart and cover its points within half its
    radius; the first keeps its centre. A leaf has few points, or equal ones, or points that no such children
    bring together."""
    order = np.arange(len(x))
    nodes, centres = [(0, len(x), 0, 0, 0.0)], [x[:1].mean(axis=0) if len(x) else np.zeros(x.shape[1])]
    todo = [0] if len(x) else []
    while todo:
        at = todo.pop()
        lo, hi = nodes[at][:2]
        own = order[lo:hi]
        far = _far(x[own], centres[at])
        radius = float(far.max())
        kids = []
        if hi - lo > LEAF and radius > 0:
            near, to = far, np.zeros(hi - lo, int)
            picked = [centres[at]]
            while near.max() > radius / 2 and len(picked) * SPLIT <= hi - lo:
                c = x[own[int(near.argmax())]]
                d = _far(x[own], c)
                to[d < near] = len(picked)
                near = np.minimum(near, d)
                picked.append(c)
            if near.max() <= radius / 2:
                by = np.argsort(to, kind="stable")
                order[lo:hi] = own[by]
                edge = np.searchsorted(to[by], np.arange(len(picked) + 1))
                kids = [(lo + int(edge[i]), lo + int(edge[i + 1]), picked[i]) for i in range(len(picked)) if edge[i + 1] > edge[i]]
        nodes[at] = (lo, hi, len(nodes), len(kids), radius)
        for a, b, c in kids:
            todo.append(len(nodes))
            nodes.append((a, b, 0, 0, 0.0)), centres.append(c)
    return order, np.array(nodes, _NODE), np.array(centres)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if reach < 2**53 else a.astype(np.int64) @ b.T.astype(np.int64)


def search(q: np.ndarray, q_ids: np.ndarray, q_tree, d: np.ndarray, d_ids: np.ndarray, d_tree, k: int, floor: np.ndarray | None = None, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per query the k best scores and their ids, ties to the smaller id; a missing place has id -1 and the
    least score. A row with the query's own id is no candidate. Rows must be in the order of their trees.
    floor: per query a score below which nothing counts; met: takes the sizes of the leaves compared."""
    least = _LEAST
    floor = np.full(len(q), least) if floor is None else floor
    score, ids = np.full((len(q), k), least), np.full((len(q), k), -1, np.int64)
    (qn, qc), (dn, dc) = q_tree, d_tree
    if not len(q) or not len(d):
        return score, ids
    q_norm, d_norm = np.sqrt((qc**2).sum(axis=1)), np.sqrt((dc**2).sum(axis=1))

    def bounds(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        dot = (qc[i] * dc[j]).sum(axis=1)
        ub = dot + qn["radius"][i] * d_norm[j] + dn["radius"][j] * q_norm[i] + qn["radius"][i] * dn["radius"][j]
        return ub + 1e-9 * np.abs(ub) + 1e-6  # rounding never prunes

    first = bounds(np.array([0]), np.array([0]))[0]
    heap, count = [(-first, 0, 0, 0)], 1
    while heap:
        ub, _, i, j = heapq.heappop(heap)
        a, b = int(qn["lo"][i]), int(qn["hi"][i])
        worst = np.maximum(score[a:b, -1], floor[a:b]).min()
        if -ub < worst:
            continue
        ki, kj = int(qn["n_kids"][i]), int(dn["n_kids"][j])
        if not ki and not kj:
            lo, hi = int(dn["lo"][j]), int(dn["hi"][j])
            s = _product(q[a:b], d[lo:hi])
            if met is not None:
                met.append((b - a) * (hi - lo))
            s = np.where(q_ids[a:b, None] == d_ids[None, lo:hi], least, s)
            # Only rows that can still enter are merged.
            live = np.flatnonzero(((s >= np.maximum(score[a:b, -1], floor[a:b])[:, None]) & (s > least)).any(axis=1))
            if len(live):
                rows = a + live
                all_s = np.concatenate([score[rows], s[live]], axis=1)
                all_i = np.concatenate([ids[rows], np.broadcast_to(d_ids[lo:hi], (len(live), hi - lo))], axis=1)
                all_i = np.where(all_s == least, -1, all_i)
                by = np.lexsort((all_i, -all_s.astype(float) if np.abs(all_s[all_s > least]).max(initial=0) < 2**53 else ~all_s), axis=1)[:, :k]
                score[rows], ids[rows] = np.take_along_axis(all_s, by, 1), np.take_along_axis(all_i, by, 1)
            continue
        # The wider node opens.
        if kj and (not ki or dn["radius"][j] >= qn["radius"][i]):
            js = np.arange(dn["kids"][j], dn["kids"][j] + kj)
            is_ = np.full(kj, i)
        else:
            is_ = np.arange(qn["kids"][i], qn["kids"][i] + ki)
            js = np.full(ki, j)
        for x, y, u in zip(is_.tolist(), js.tolist(), bounds(is_, js).tolist(), strict=True):
            if u >= worst:
                heapq.heappush(heap, (-u, count, x, y))
                count += 1
    return score, ids


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, x: floor(256 * component) as bigint. Rows with a null id, a null vector, or a null or non-finite
    component are left out; repeated rows are one."""
    v = F.col("v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & fine)
    return rows.select("id", F.transform(v, lambda c: F.floor(c * F.lit(256.0))).alias("x")).distinct()


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), dim)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Number of the nearest pivot of each row."""
    return ((pivots**2).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)


def pivot_cells(rows: DataFrame, cells: int) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """By vector length, coarse pivots and under each its fine ones, about so many in all. They come from a sample
    of at most PIVOTS rows, those of the smallest hashes; they steer where rows go, never what is found."""
    wide = max(1, min(int(np.sqrt(PIVOTS)), int(np.ceil(np.sqrt(cells)))))
    sample = rows.select("x", F.xxhash64("id", "x").alias("h")).orderBy("h").limit(min(PIVOTS, 8 * wide * wide)).collect() if cells > 1 else []
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["x"]), []).append(r["x"])
    out = {}
    for dim, found in by_dim.items():
        x = np.unique(np.array(found, float).reshape(len(found), dim), axis=0)
        if dim and len(x) > 1:
            coarse = _spread(x, wide)
            to = _nearest(x, coarse)
            out[dim] = (coarse, [_spread(x[to == i], wide) if (to == i).any() else coarse[i : i + 1] for i in range(len(coarse))])
    return out


def _spread(x: np.ndarray, most: int) -> np.ndarray:
    """Rows far from one another, each the farthest from those before it."""
    picked, near = [0], _far(x, x[0])
    while len(picked) < most and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, _far(x, x[picked[-1]]))
    return x[picked]


def _celled(rows: DataFrame, pivots, part_rows: int) -> DataFrame:
    """rows with part: its length, cell and, of a cell with many rows, one of several shares by hash."""

    @F.pandas_udf("int")
    def cell(x: pd.Series) -> pd.Series:
        out, dims = np.full(len(x), -1, np.int32), x.map(len).to_numpy()
        for dim in np.unique(dims).tolist():
            if dim in pivots.value:
                coarse, fine = pivots.value[dim]
                at = np.flatnonzero(dims == dim)
                v = _matrix(x.iloc[at], dim).astype(float)
                to = _nearest(v, coarse)
                for i in np.unique(to).tolist():
                    out[at[to == i]] = i * 65536 + _nearest(v[to == i], fine[i])
        return pd.Series(out)

    dealt = written(rows.select("id", "x", F.size("x").alias("dim"), cell("x").alias("cell")))
    shares = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("id", "x"), F.col("shares"))
    return dealt.join(shares, ["dim", "cell"]).select("id", "x", "dim", "cell", F.concat_ws(":", "dim", "cell", share).alias("part"))


def _indexed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard or block as one row: its points in tree order, packed."""
    pdf = pdf.sort_values("id", kind="stable")
    dim = int(pdf["dim"].iloc[0])
    x = _matrix(pdf["x"], dim)
    order, nodes, centres = cover_tree(x.astype(float))
    x = x[order]
    kind = "<i2" if np.abs(x).max(initial=0) < 2**15 else "<i8"
    row = (pdf["part"].iloc[0], dim, int(pdf["cell"].iloc[0]), len(x), float(nodes["radius"][0]), centres[0].astype(float).tolist(), pdf["id"].to_numpy()[order].astype("<i8").tobytes(), kind, x.astype(kind).tobytes(), nodes.tobytes(), centres.astype("<f8").tobytes())
    return pd.DataFrame([row], columns=[c.split()[0] for c in _INDEX.split(", ")])


_INDEX = "part string, dim int, cell int, n int, radius double, centre array<double>, ids binary, kind string, points binary, nodes binary, centres binary"


def tree_index(rows: DataFrame, pivots, part_rows: int) -> DataFrame:
    """Cover trees of rows (id, x), one per part of about part_rows near one another, of one length. pivots: a
    broadcast of pivot_cells()."""
    return _celled(rows, pivots, part_rows).groupBy("part").applyInPandas(_indexed, _INDEX)


def _open(row) -> tuple:
    dim, ids = int(row.dim), np.frombuffer(row.ids, "<i8")
    x = np.frombuffer(row.points, row.kind).astype(np.int64).reshape(len(ids), dim)
    nodes = np.frombuffer(row.nodes, _NODE)
    return x, ids, (nodes, np.frombuffer(row.centres, "<f8").reshape(len(nodes), dim))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _dot(a: str, b: str) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def ball_bound(dot: Column) -> Column:
    """What no score of a query in the ball (q_centre, q_radius) and a point in (centre, radius) can exceed."""
    q, d = F.sqrt(_dot("q_centre", "q_centre")), F.sqrt(_dot("centre", "centre"))
    rest = F.col("q_radius") * d + F.col("radius") * q + F.col("q_radius") * F.col("radius")
    return dot + rest + F.lit(1e-9) * (F.abs(dot) + rest) + F.lit(1e-6)  # rounding never prunes


def _balls(children: DataFrame, by: list[str], name: str) -> DataFrame:
    """Balls of groups of balls (by, name, centre, radius, most): around the first child's centre, over all children."""
    first = children.groupBy(*by).agg(F.min_by("centre", name).alias("c"), F.max("most").alias("most"))
    far = F.sqrt(_total(F.zip_with("centre", "c", lambda x, y: (x - y) * (x - y)))) + F.col("radius")
    wide = children.drop("most").join(first, by).groupBy(*by).agg(F.max(far).alias("radius"))
    return first.join(wide, by).withColumnRenamed("c", "centre")


def root_tree(index: DataFrame) -> list[tuple[list[str], str, DataFrame]]:
    """Three levels over the shards of tree_index(), from the top: columns shared with the level above, the level's own
    key, its balls. A group has at most sqrt(PIVOTS) cells, and there are as many groups of a vector length."""
    shards = index.select("part", "dim", "cell", F.col("n").alias("most"), "radius", "centre")
    cells = written(_balls(shards, ["dim", "cell"], "part").withColumn("coarse", F.shiftright("cell", 16)))
    groups = written(_balls(cells, ["dim", "coarse"], "cell"))
    # All lengths' groups go to every task while they are few; with very many lengths they are shuffled by length.
    return [(["dim"], "coarse", F.broadcast(groups) if groups.count() <= ROOTS else groups), (["dim", "coarse"], "cell", cells), (["dim", "cell"], "part", shards)]


def descend(asked: DataFrame, tree: list[tuple[list[str], str, DataFrame]], k: int | None = None) -> DataFrame:
    """q_part, part: for each block of asked (part, dim, centre, radius) the shards whose balls, from the top of the tree
    to the shard, can reach the block's score worst. With k instead one shard, by the ball at each level whose centre
    fits best, among those over a shard with more than k rows if there are any."""
    step = asked.select(F.col("part").alias("q_part"), "dim", F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"), *(["worst"] if k is None else []))
    held = step.columns
    for on, key, balls in tree:
        met = step.join(balls, on)
        dot = _dot("q_centre", "centre")
        if k is None:
            step = met.filter(ball_bound(dot) >= F.col("worst").cast("double")).select(*held, key)
        else:
            step = met.groupBy("q_part").agg(F.max_by(F.struct(*held[1:], key), F.struct(F.col("most") > k, dot, F.col(key))).alias("s")).select("q_part", "s.*")
    return step.select("q_part", "part")


def _objects(pdf: pd.DataFrame) -> pd.DataFrame:
    """Text columns as plain objects: an empty one of pandas' own text type doesn't go back to Spark."""
    return pdf.astype({c: object for c in ("q_part", "part") if c in pdf})


def _searched(pairs: DataFrame, asked: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """q_part, at (place in the block), query_id, vec_id, score: of each pair (q_part, part) of a block and a shard each
    query's k best. A shard is read once for LANE blocks. asked has a list floors of the kth scores so far."""
    lanes = max(1, -(-asked.count() // LANE))
    lane = F.pmod(F.xxhash64("q_part"), F.lit(lanes)).alias("lane")
    dealt = pairs.select("q_part", "part", lane)
    cols = ("part", "dim", "ids", "kind", "points", "nodes", "centres")
    asks = dealt.select("q_part", F.col("part").alias("to"), F.col("lane").alias("by")).join(asked.select(*(F.col(c).alias(f"q_{c}") for c in (*cols, "floors"))), "q_part")
    meets = dealt.select("part", "lane").distinct().join(data.select(*cols), "part")

    def best(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        for drow in d.itertuples():
            dx, d_ids, d_tree = _open(drow)
            for qrow in q.rename(columns=lambda c: c.removeprefix("q_")).itertuples():
                qx, q_ids, q_tree = _open(qrow)
                floor = None if qrow.floors is None else np.frombuffer(qrow.floors, "<i8")
                score, ids = search(qx, q_ids, q_tree, dx, d_ids, d_tree, k, floor)
                at, place = np.nonzero(score > _LEAST)
                out.append(pd.DataFrame({"q_part": np.full(len(at), qrow.part, object), "at": at, "query_id": q_ids[at], "vec_id": ids[at, place], "score": score[at, place]}))
        return _objects(pd.concat(out) if out else pd.DataFrame({c: [] for c in ("q_part", "at", "query_id", "vec_id", "score")}))

    return meets.groupBy("part", "lane").cogroup(asks.groupBy("to", "by")).applyInPandas(best, "q_part string, at bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: for each query row its k best other rows of vectors by
    integer inner product, ties to the smaller id; all of them if there are fewer. Scores are exact while
    they fit 64 bits. Vectors only meet vectors of their own length. Null ids, null vectors and null or non-finite
    components take no part; equal rows are one; ids that repeat with other vectors are rows of their own. No
    queries, or an empty table: no rows. Other columns aren't read, so their names can't clash."""
    rows = written(quantised(vectors, key, vector))
    pivots = vectors.sparkSession.sparkContext.broadcast(pivot_cells(rows, -(-rows.count() // SHARD_ROWS)))
    data = written(tree_index(rows, pivots, SHARD_ROWS))
    asked = written(tree_index(quantised(queries, key, vector), pivots, QUERY_ROWS))
    tree = root_tree(data)
    first = written(descend(asked, tree, k))
    found = written(_searched(first, asked.withColumn("floors", F.lit(None).cast("binary")), data, k))

    # Then every other shard whose root can reach the worst kth score of a block.
    kth = found.groupBy("q_part", "at").agg(F.min("score").alias("kth"), F.count("*").alias("had")).filter(F.col("had") == k)
    floors = kth.groupBy("q_part").agg(F.collect_list(F.struct("at", "kth")).alias("floors"), F.min("kth").alias("least"))

    @F.pandas_udf("binary")
    def packed(n: pd.Series, floors: pd.Series) -> pd.Series:
        out = []
        for size, pairs in zip(n, floors, strict=True):
            x = np.full(size, _LEAST)
            for p in [] if pairs is None else pairs:
                x[p["at"]] = p["kth"]
            out.append(x.astype("<i8").tobytes())
        return pd.Series(out, dtype=object)

    full = F.when(F.size("floors") == F.col("n"), F.col("least")).otherwise(F.lit(_LEAST))
    held = written(asked.join(floors, asked["part"] == floors["q_part"], "left").select(*asked.columns, F.coalesce(full, F.lit(_LEAST)).alias("worst"), packed("n", "floors").alias("floors")))

    pairs = descend(held, tree)
    more = _searched(pairs.join(first, ["q_part", "part"], "left_anti"), held, data, k)
    place = F.row_number().over(Window.partitionBy("q_part", "at").orderBy(F.desc("score"), "vec_id"))
    return found.unionByName(more).withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k_search(spark, sf_dir: str) -> DataFrame:
    """For every row with vec_id divisible by 50 its 5 best other rows: query_id, rank, vec_id, score. Edge cases are
    those of top_k()."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
