"""N-gram Jaccard join by MinHash banding.

Texts become sets of hashed five-word n-grams. Equal sets are one class, represented by its smallest
document. Classes that share a band of their MinHash signature meet in a bucket; every pair in a bucket is
verified on the full sets. Buckets are worked in blocks: a task holds two blocks of bounded size and
returns link counts and a spanning forest, never the pairs, so a bucket of any size stays exact. The blocks of a
large bucket go by the size of the sets, and blocks whose sizes rule a link out don't meet.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import claim, cut, hash128, importable, table, written

N, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.999, 4
#: Parameters: classes in a block, words remembered per task, salts of a node with many edges.
BLOCK, CACHE_WORDS, SALTS = 256, 250_000, 8
#: Scripts written without spaces, of which every character is a word.
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_MASK = 0xFFFFFFFFFFFFFFFF


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of so many rows that find a pair at the threshold with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


_words: dict[str, int] = {}


def _hold_words() -> None:
    claim("words", _words.clear)


def wide(text: str) -> bool:
    """Whether most of a text is in scripts without spaces. Their characters take three bytes each."""
    return not text.isascii() and len(text.encode("utf-8", "surrogatepass")) > 2 * len(text) and 2 * len(_WIDE.findall(text)) > sum(map(len, text.split()))


def ngrams(text: str | None, n: int = N, characters: bool | None = False) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of text's words (lower case, by white space; with characters every
    character of a script without spaces is a word too; None: in texts that are mostly in such scripts). Fewer words
    than n are one n-gram; no words none."""
    text = (text or "").lower()
    words = (_WIDE.sub(r" \g<0> ", text) if (wide(text) if characters is None else characters) else text).split()
    if not words:
        return np.empty(0, np.uint64)
    new = [w for w in set(words) if w not in _words]
    if len(_words) + len(new) > CACHE_WORDS:
        _words.clear()
        new = list(set(words))
    for w in new:
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15 + 2 * i) + h[i : i + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_607)
    return r.integers(1, _MASK, count, np.uint64) | np.uint64(1), r.integers(0, _MASK, count, np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> list[int]:
    """One 63-bit hash per band of the MinHash signature."""
    a, b = _seeds(bands * rows)
    low = np.full(bands * rows, _MASK, np.uint64)
    for at in range(0, len(grams), 4096):
        x = grams[at : at + 4096, None] * a + b
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
    mix = np.zeros(bands, np.uint64)
    for i in range(rows):
        mix = _mixed(mix * np.uint64(0x9E3779B97F4A7C15) + low.reshape(bands, rows)[:, i])
    mix = _mixed(mix + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (mix >> np.uint64(1)).astype(np.int64).tolist()


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("k"), *(h.alias(f"h{i}") for i, h in enumerate(hash128(F.col(text)))), F.col(text).alias("t"))


def signatures(docs: DataFrame, text: str, key: str, n: int, bands: int, rows: int, characters: bool | None = False) -> DataFrame:
    """k, h0, h1 (hashes of the text), set_key (128-bit digest of the n-gram set, null for empty sets), size (of the set),
    bands."""
    schema = pa.schema([("k", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64()), ("set_key", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold_words()
        for b in batches:
            keys, sizes, hashes = [], [], []
            for t in b.column("t").to_pylist():
                g = ngrams(t, n, characters)
                sizes.append(len(g))
                keys.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                hashes.append(band_hashes(g, bands, rows) if len(g) else None)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h0"), b.column("h1"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, schema.field("bands").type)], schema=schema)

    return _texts(docs, text, key).mapInArrow(run, "k bigint, h0 bigint, h1 bigint, set_key binary, size bigint, bands array<bigint>")


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of n-gram sets have a Jaccard similarity of threshold or more."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    length = np.diff(np.r_[np.flatnonzero(np.r_[True, values[1:] != values[:-1]]), len(values)])
    # An n-gram of one set alone adds to no intersection.
    ids = np.repeat(np.cumsum(length > 1) - 1, length)
    shared = np.repeat(length > 1, length)
    ids, owner = ids[shared], owner[shared]
    both = np.zeros((m, m), np.float32)
    step = max(256, 2_000_000 // m)
    for a in range(0, int(ids[-1]) + 1 if len(ids) else 0, step):
        lo, hi = np.searchsorted(ids, [a, a + step])
        has = np.zeros((m, min(step, int(ids[-1]) + 1 - a)), np.float32)
        has[owner[lo:hi], ids[lo:hi] - a] = 1
        both += has @ has.T
    return both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6


def _verified(rows: list[tuple], threshold: float, apart: bool) -> list[tuple[int, int, int | None, int, int]]:
    """Of the sets in two blocks of a bucket, rows (k, n, block, buckets, grams, name) of it: (k, name, other, links,
    weight), where k has links, to so many documents; the edges from name to other are a spanning forest. apart: the blocks are two,
    whose own pairs are another group's work, even where one of them is empty."""
    rows = sorted(rows, key=lambda r: r[0])
    m = len(rows)
    link = linked([np.frombuffer(r[4], np.uint64) for r in rows], threshold)
    np.fill_diagonal(link, False)
    if apart:
        block = np.array([r[2] for r in rows])
        link &= block[:, None] != block[None, :]
    # A pair that met in an earlier bucket was counted there.
    where: dict[int, int] = {}
    flat = [[where.setdefault(b, len(where)) for b in r[3]] for r in rows]
    if where and link.any():
        earlier = np.zeros((m, len(where)), np.float32)
        for i, x in enumerate(flat):
            earlier[i, x] = 1
        link &= (earlier @ earlier.T) == 0
    counts, weights = link.sum(axis=1), link @ np.array([r[1] for r in rows])
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in np.flatnonzero(counts).tolist():
        for j in np.flatnonzero(link[i, :i]).tolist():
            if (x := root(i)) != (y := root(j)):
                parent[max(x, y)] = min(x, y)
    return [(rows[i][0], rows[i][5], rows[x][5] if (x := root(i)) != i else None, int(counts[i]), int(weights[i])) for i in np.flatnonzero(counts).tolist()]


def _verify(threshold: float):
    """Arrow function over rows sorted by (bucket, i, j); one such group is held at a time."""
    schema = pa.schema([(c, pa.int64()) for c in ("k", "name", "other", "links", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, out = [], None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("bucket", "i", "j", "k", "n", "block", "earlier", "grams", "name")]
            for bucket, i, j, *row in zip(*cols, strict=True):
                if (bucket, i, j) != at:
                    if len(group) > 1:
                        out += _verified(group, threshold, at[1] != at[2])
                    group, at = [], (bucket, i, j)
                group.append(row)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], schema=schema)
                out = []
        if len(group) > 1:
            out += _verified(group, threshold, at[1] != at[2])
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], schema=schema)

    return run


def _star(edges: DataFrame, side: DataFrame, on: str, how: str) -> DataFrame:
    """edges (u, v) with side by one of their nodes. A node with many edges is dealt out over SALTS; side holds few nodes
    and is there under each salt."""
    salt = F.pmod(F.xxhash64("u", "v"), F.lit(SALTS)).cast("int")
    copies = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", salt).join(copies, [on, "salt"], how).drop("salt")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """v, class: for nodes of edges (u, v, both not null) the smallest node that they are connected to. Alternating large and
    small stars; each round's edges are checkpointed. Rounds grow with the square of the log of the nodes at most; if edges
    still change after rounds, that is an error."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())

    def summary(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = summary(now)
    for _ in range(rounds):
        if not state[0]:
            break
        # Large star: neighbours above a node go to its smallest neighbour, where that is below the node itself.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lower = both.groupBy("u").agg(F.min("v").alias("m")).filter("m < u").select(F.col("u").alias("v"), "m")
        large = _star(now, lower, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: a node and its neighbours below go to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        several = low.filter("m < most").select("u", "m")
        small = _star(large, several, "u", "inner").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut(small.filter("u <> v").distinct())
        new = summary(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    tops = now.groupBy("u").agg(F.min("v").alias("class"))
    return tops.select(F.col("u").alias("v"), "class").union(now.select("v", F.col("v").alias("class")).distinct())


def jaccard_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK, characters: bool | None = False) -> DataFrame:
    """One row per document: key, set_id (smallest key with the same n-gram set), class_id (smallest key it
    is linked to through any chain), n_links (other n-gram sets at threshold or above), n_linked_docs (the
    documents behind these, and the other documents of its own set).

    Texts without words, or null, link to nothing: each is its own class. Rows with a null key come back
    with null classes and no links. A key that repeats is one document; if its texts differ, each of them links, its
    class is that of them all, and its counts are their sums. Keys are taken as bigint. Texts of any length count whole;
    an empty table gives no rows; other columns aren't read. A text without white space is one word and links to its
    copies alone, unless characters is set (see ngrams)."""
    importable(docs.sparkSession)
    bands = bands_for(threshold, recall, rows)
    signed = written(signatures(docs, text, key, n, bands, rows, characters))
    # A set of a document, with one of its texts.
    full = signed.filter("k is not null and set_key is not null").groupBy("k", "set_key").agg(F.min(F.struct("h0", "h1", "size", "bands")).alias("s")).select("k", "set_key", "s.*")
    # Sets at the threshold or above are at most one step of size apart.
    step = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("bigint") if threshold < 1 else F.col("size")
    first = full.groupBy("set_key", "size").agg(F.min(F.struct("k", "h0", "h1")).alias("f"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    # Sets have numbers of their own, as two can have the same smallest document; written, so that they keep them.
    sets = written(first.select("set_key", F.col("f.k").alias("set_id"), "f.h0", "f.h1", "n", "bands", step.alias("step"), F.monotonically_increasing_id().alias("sid")))
    entries = sets.select("sid", "step", F.explode("bands").alias("bucket"))
    # Buckets with the same members do the work once.
    crowd = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), "sid").cast("decimal(20,0)")).alias("b")).filter("m > 1")
    kept = crowd.groupBy("m", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    members = written(entries.join(kept, "bucket").withColumn("step", F.when(F.col("m") > block, F.col("step")).otherwise(0)))
    mine = members.groupBy("sid").agg(F.sort_array(F.collect_set("bucket")).alias("buckets")).join(sets.select("sid", F.col("set_id").alias("k"), "h0", "h1"), "sid")
    # Equal rows are one text.
    texts = _texts(docs, text, key).join(mine, ["k", "h0", "h1"]).groupBy("sid").agg(F.first("buckets").alias("buckets"), F.first("t").alias("t"))
    schema = pa.schema([("k", pa.int64()), ("buckets", pa.list_(pa.int64())), ("grams", pa.binary())])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold_words()
        for b in batches:
            found = [ngrams(t, n, characters).tobytes() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("buckets").cast(schema.field(1).type), pa.array(found, pa.binary())], schema=schema)

    hashed = texts.mapInArrow(grams, "k bigint, buckets array<bigint>, grams binary")
    # By bucket and step the number of blocks, and that of the steps next to it.
    by_step = Window.partitionBy("bucket").orderBy("step")
    crowds = members.groupBy("bucket", "step").agg(F.ceil(F.count("*") / block).cast("bigint").alias("parts"))
    beside = [(F.when(f("step").over(by_step) == F.col("step") + d, f("parts").over(by_step))) for f, d in ((F.lag, -1), (F.lead, 1))]
    crowds = crowds.withColumns({"below": F.coalesce(beside[0], F.lit(0)), "above": F.coalesce(beside[1], F.lit(0))})
    dealt = members.select("bucket", F.col("sid").alias("k"), "step").join(crowds, ["bucket", "step"]).join(sets.select(F.col("sid").alias("k"), "n", F.col("set_id").alias("name")), "k")

    def blocks(of, count):
        return F.transform(F.slice(F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0))), 1, count.cast("int")), lambda i: F.shiftleft(of, 24) + i)

    others = F.concat(blocks(F.col("step"), F.col("parts")), blocks(F.col("step") - 1, F.col("below")), blocks(F.col("step") + 1, F.col("above")))
    dealt = dealt.withColumn("block", F.shiftleft("step", 24) + F.pmod(F.xxhash64("k", "bucket"), F.col("parts"))).withColumn("other", F.explode(others))
    dealt = dealt.select("bucket", "k", "n", "name", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    work = hashed.join(dealt, "k").select("bucket", "i", "j", "k", "n", "name", "block", F.filter("buckets", lambda b: b < F.col("bucket")).alias("earlier"), "grams")
    verified = written(work.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_verify(threshold), "k bigint, name bigint, other bigint, links bigint, weight bigint"))

    links = verified.groupBy("k").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
    # The sets of a document with several belong together.
    several = full.groupBy("k").agg(F.count("*").alias("texts")).filter("texts > 1").select("k")
    theirs = full.select("k", "set_key").join(several, "k").join(sets.select("set_key", "set_id"), "set_key").select("k", "set_id")
    together = theirs.join(theirs.groupBy("k").agg(F.min("set_id").alias("low")), "k").select(F.col("set_id").alias("u"), F.col("low").alias("v"))
    classes = components(verified.filter("other is not null").select(F.col("name").alias("u"), F.col("other").alias("v")).unionByName(together))
    found = sets.join(links, sets["sid"] == links["k"], "left").drop("k").join(classes.withColumnRenamed("v", "k"), F.col("set_id") == F.col("k"), "left")
    found = found.select("set_key", "set_id", F.coalesce("class", "set_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.coalesce("weight", F.lit(0)) + F.col("n") - 1).alias("n_linked_docs"))
    by_key = full.select(F.col("k").alias("key"), "set_key").join(found, "set_key").groupBy("key").agg(F.min("set_id").alias("set_id"), F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"), F.sum("n_linked_docs").alias("n_linked_docs"))
    out = signed.select("k").join(by_key, F.col("k") == F.col("key"), "left")
    return out.select(F.col("k").alias(key), F.coalesce("set_id", "k").alias("set_id"), F.coalesce("class_id", "k").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_docs", F.lit(0)).alias("n_linked_docs"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """One row per document of the table: doc_id, set_id, class_id, n_links, n_linked_docs, by word 5-grams at 0.8; texts
    that are mostly in scripts without spaces have their characters as words. Edge cases are those of
    jaccard_classes()."""
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), characters=None)
