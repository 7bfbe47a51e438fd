"""Exact deduplication through a sharded cuckoo-filter index.

Normalised texts and their SHA-256 digests are dealt to shards by hash; in each shard a cuckoo filter over the
live digests answers which are new. A fingerprint hit counts only after the text that lies in the shard for that
slot has been compared; a full table doubles and is filled again from the stored digests. The filter also deletes,
so an index can follow a changing corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, table, written

SLOTS, KICKS = 4, 200
#: Parameters: digests and characters of normalised text that a shard has about.
SHARD_ROWS, SHARD_CHARS = 20_000, 16_000_000


class CuckooIndex:
    """Digests (bytes, 16 or more of them uniform) with their numbers: insert, find, delete. Each comes with the
    content that hits are verified against; without any, that is the digest itself."""

    def __init__(self, expected: int = 1024):
        self.size = 1 << max(4, (max(1, expected) * 10 // 9 // SLOTS).bit_length())
        self._clear()
        self.keys: list[bytes | None] = []  # live digests, from which a larger table is filled
        self.contents: list[str | bytes | None] = []
        self.live = self.resizes = self.checked = 0

    def _clear(self) -> None:
        self.prints = [0] * (self.size * SLOTS)
        self.owner = [-1] * (self.size * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[8:10], "little") or 1
        a = int.from_bytes(digest[:8], "little") & (self.size - 1)
        return fp, a, self._other(a, fp)

    def _other(self, at: int, fp: int) -> int:
        return at ^ (fp * 0x5BD1E995 & (self.size - 1))

    def _slot(self, digest: bytes, content: str | bytes | None) -> int:
        fp, a, b = self._places(digest)
        for at in (a, b):
            for s in range(at * SLOTS, at * SLOTS + SLOTS):
                if self.prints[s] == fp:
                    self.checked += 1
                    if self.contents[self.owner[s]] == (digest if content is None else content):
                        return s
        return -1

    def find(self, digest: bytes, content: str | None = None) -> int:
        """The number of a live digest, or -1."""
        s = self._slot(digest, content)
        return -1 if s < 0 else self.owner[s]

    def _place(self, digest: bytes, number: int) -> bool:
        fp, a, b = self._places(digest)
        for at in (a, b):
            for s in range(at * SLOTS, at * SLOTS + SLOTS):
                if not self.prints[s]:
                    self.prints[s], self.owner[s] = fp, number
                    return True
        at = b
        for kick in range(KICKS):
            s = at * SLOTS + kick % SLOTS
            self.prints[s], fp = fp, self.prints[s]
            self.owner[s], number = number, self.owner[s]
            at = self._other(at, fp)
            for t in range(at * SLOTS, at * SLOTS + SLOTS):
                if not self.prints[t]:
                    self.prints[t], self.owner[t] = fp, number
                    return True
        return False

    def _grow(self) -> None:
        """Doubles until every stored digest has a slot."""
        while True:
            self.size, self.resizes = self.size * 2, self.resizes + 1
            self._clear()
            if all(self._place(k, i) for i, k in enumerate(self.keys) if k is not None):
                return

    def insert(self, digest: bytes, content: str | None = None) -> tuple[int, bool]:
        """The digest's number, and whether it is new."""
        if (found := self.find(digest, content)) >= 0:
            return found, False
        self.keys.append(digest), self.contents.append(digest if content is None else content)
        self.live += 1
        if not self._place(digest, len(self.keys) - 1):
            self._grow()
        return len(self.keys) - 1, True

    def delete(self, digest: bytes, content: str | None = None) -> bool:
        s = self._slot(digest, content)
        if s < 0:
            return False
        self.keys[self.owner[s]] = self.contents[self.owner[s]] = None
        self.prints[s], self.owner[s] = 0, -1
        self.live -= 1
        return True


_CLASS = "shard bigint, digest string, group_size bigint, keep_len bigint, keep_id bigint"


def _merge(pdf: pd.DataFrame, stored: bool = True) -> pd.DataFrame:
    """One row per live digest of a shard, with its content if that is to be stored. Rows: digest, content, op
    (1 insert, -1 delete), n, len, id."""
    index, size, best = CuckooIndex(len(pdf)), [], []
    for hexed, content, op, n, length, doc in zip(pdf["digest"], pdf["content"], pdf["op"], pdf["n"], pdf["len"], pdf["id"], strict=True):
        digest = bytes.fromhex(hexed)
        if op < 0:
            if (i := index.find(digest, content)) >= 0:
                size[i] -= n
                if size[i] <= 0:
                    index.delete(digest, content)
            continue
        # Null ids sort last among equals.
        key = (-length, pd.isna(doc), 0 if pd.isna(doc) else int(doc))
        i, new = index.insert(digest, content)
        if new:
            size.append(n), best.append(key)
        else:
            size[i] += n
            best[i] = min(best[i], key)
    live = [i for i, k in enumerate(index.keys) if k is not None]
    out = pd.DataFrame({"shard": pdf["shard"].iloc[0], "digest": [index.keys[i].hex() for i in live], "group_size": pd.array([size[i] for i in live], "Int64"), "keep_len": pd.array([-best[i][0] for i in live], "Int64"), "keep_id": pd.array([None if best[i][1] else best[i][2] for i in live], "Int64")})
    # Objects: an empty column of pandas' own text type doesn't go back to Spark.
    return out.assign(content=pd.Series([index.contents[i] for i in live], dtype=object)).astype({"digest": object}) if stored else out.astype({"digest": object})


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, content (the text without white space; null: empty), its text_sha256, len in code points of the
    original."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("bigint"), F.regexp_replace(text, f"[{SPACE}]+", "").alias("content"), F.length(text).cast("bigint").alias("len"))
    return plain.select("doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"), "len", "content")


def _best() -> Column:
    """Of rows of digests() the longest, then the smallest id, null last, as struct b."""
    return F.min(F.struct((-F.col("len")).alias("l"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"))).alias("b")


def _shards(chars: Column, rows: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
    """So many that a shard has about shard_rows rows and SHARD_CHARS characters at most."""
    n, chars = rows.agg(F.count("*"), F.sum(chars.cast("bigint"))).first()
    return max(1, -(-n // shard_rows), -(-(chars or 0) // SHARD_CHARS))


def index_digests(digested: DataFrame, shard_rows: int = SHARD_ROWS, salts: int = 4, stored: bool = True, shards: int | None = None) -> DataFrame:
    """The live index of rows of digests(): shard, digest, group_size, keep_len, keep_id and, if it is to be stored for
    changes, content. Copies of one digest are first summed under salts, so at most that many rows of it reach its
    shard; shards grow in number with the rows and with their text."""
    summed = digested.groupBy(F.col("text_sha256").alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(F.count("*").alias("n"), _best(), F.first("content").alias("content"))
    shards = shards or _shards(F.length("content"), digested, shard_rows)
    rows = summed.select(F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"), "digest", "content", F.lit(1).alias("op"), "n", (-F.col("b.l")).alias("len"), F.col("b.id").alias("id"))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return _merge(pdf, stored)

    return rows.groupBy("shard").applyInPandas(merged, _CLASS + (", content string" if stored else ""))


def change_index(index: DataFrame, inserts: DataFrame | None, deletes: DataFrame | None, live: DataFrame | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index (stored) after inserting and deleting rows of digests(). Each deleted row takes one off its digest's
    group_size and the digest goes at 0; deletes of unknown digests do nothing. The shards follow from the new number
    of digests, and every row, old or new, is dealt by them alone, so a digest is never in two.

    keep_id stays that of the best row inserted while that row isn't deleted. Where it is and copies of it live on,
    their best takes its place if live (rows of digests() that remain) is given; else keep_id and keep_len are null."""

    def rows(df: DataFrame, op: int) -> DataFrame:
        return df.groupBy(F.col("text_sha256").alias("digest")).agg(F.count("*").alias("n"), _best(), F.first("content").alias("content")).select("digest", "content", F.lit(op).alias("op"), "n", (-F.col("b.l")).alias("len"), F.col("b.id").alias("id"))

    all_rows = index.select("digest", "content", F.lit(1).alias("op"), F.col("group_size").alias("n"), F.col("keep_len").alias("len"), F.col("keep_id").alias("id"))
    for df, op in ((inserts, 1), (deletes, -1)):
        if df is not None:
            all_rows = all_rows.unionByName(rows(df, op))
    all_rows = written(all_rows)
    shards = _shards(F.length("content"), all_rows, shard_rows)

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return _merge(pdf.sort_values("op", ascending=False, kind="stable"))

    out = all_rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))).groupBy("shard").applyInPandas(ordered, _CLASS + ", content string")
    if deletes is None:
        return out
    gone = deletes.select(F.col("text_sha256").alias("digest"), F.col("len").alias("keep_len"), F.col("doc_id").alias("keep_id"), F.lit(True).alias("lost")).distinct()
    named = (out["digest"] == gone["digest"]) & (out["keep_len"] == gone["keep_len"]) & out["keep_id"].eqNullSafe(gone["keep_id"])
    out = out.join(gone.select(*(F.col(c) for c in gone.columns)), named, "left").select(out["*"], "lost")
    if live is None:
        best = out.select("digest").limit(0).withColumns({"l": F.lit(None).cast("bigint"), "id": F.lit(None).cast("bigint")})
    else:
        best = live.groupBy(F.col("text_sha256").alias("digest")).agg(_best()).select("digest", (-F.col("b.l")).alias("l"), F.col("b.id").alias("id"))
    keep = [F.when(F.col("lost").isNull(), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("keep_len", "l"), ("keep_id", "id"))]
    return out.join(best, "digest", "left").select("shard", "digest", "group_size", *keep, "content")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Every document with its class: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when
    they are without white space; null counts as empty. The longest original stays, then the smallest
    doc_id (null last). Rows that repeat a kept doc_id and text are marked kept as well: they are that row. Texts of any
    length are hashed and compared whole; an empty table gives no rows; other columns aren't read."""
    found = digests(docs)
    # Texts aren't stored again: the index takes them from the documents.
    digested = written(found.withColumn("chars", F.length("content")).drop("content"))
    index = written(index_digests(found, stored=False, shards=_shards(F.col("chars"), digested))).select(F.col("digest").alias("text_sha256"), "keep_id", "group_size", "keep_len")
    # Digests with more than a thousandth of the rows, of which there are fewer than a thousand, are known to every task;
    # their documents stay where they are.
    hot = F.col("group_size") > digested.count() / 1000
    frequent = index.filter(hot).select(F.col("text_sha256").alias("d"), *(F.col(c).alias(f"hot_{c}") for c in ("keep_id", "group_size", "keep_len")))
    met = digested.join(F.broadcast(frequent), F.col("text_sha256") == F.col("d"), "left")
    cols = ("doc_id", "text_sha256", "len")
    joined = met.filter("d is not null").select(*cols, *(F.col(f"hot_{c}").alias(c) for c in ("keep_id", "group_size", "keep_len"))).unionByName(met.filter("d is null").select(*cols).join(index.filter(~hot), "text_sha256"))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len"))).alias("kept"), "text_sha256")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Edge cases are those of exact_dedup()."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def exact_index_changes(spark, sf_dir: str) -> DataFrame:
    """The index of documents after changes: built from all sources but the first, then the first source's documents
    come in and the last one's leave, as digests. One row per text that is left: digest, group_size, keep_len, keep_id.
    Null sources stay; one source alone comes and leaves, so nothing is left; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    first, last = docs.agg(F.min("source"), F.max("source")).first()

    def of(source: str | None) -> Column:
        return F.coalesce(F.col("source") == F.lit(source), F.lit(False))

    index = written(index_digests(digests(docs.filter(~of(first)))))
    changed = change_index(index, digests(docs.filter(of(first))), digests(docs.filter(of(last))), digests(docs.filter(~of(last))))
    return changed.select("digest", "group_size", "keep_len", "keep_id")


EXACT_INDEX_CHANGES_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS digest
  FROM documents WHERE source IS DISTINCT FROM (SELECT max(source) FROM documents)),
r AS (
  SELECT *, count(*) OVER (PARTITION BY digest) AS n,
         row_number() OVER (PARTITION BY digest ORDER BY len DESC, doc_id NULLS LAST) AS place
  FROM d)
SELECT digest, CAST(n AS BIGINT) AS group_size, CAST(len AS BIGINT) AS keep_len, doc_id AS keep_id FROM r WHERE place = 1
"""
