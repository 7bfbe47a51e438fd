"""Line deduplication over overlapping three-line windows, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, hash128, table, written


def _windows(lines: Column, width: int) -> Column:
    """Spans of width consecutive non-blank lines: their first and last place and two hashes of the lines."""
    full = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(" \t\r\x0b\x0c")).alias("t"))), lambda s: s["t"] != "")
    hashed = F.transform(full, lambda s: F.struct(s["i"].alias("i"), *(h.alias(n) for n, h in zip("ab", hash128(s["t"]), strict=True))))

    n = F.size(full)
    zipped = F.arrays_zip(*(F.slice(hashed, k + 1, F.greatest(n - width + 1, F.lit(0))) for k in range(width)))

    def span(z: Column) -> Column:
        at = [z[str(k)] for k in range(width)]
        return F.struct(at[0]["i"].alias("first"), at[-1]["i"].alias("last"), F.xxhash64(*(x["a"] for x in at)).alias("h1"), F.xxhash64(*(x["b"] for x in at)).alias("h2"))

    return F.transform(zipped, span)


def line_dedup(docs: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, every row and column kept, with text shortened and n_lines, n_removed (bigint) added.

    Lines end at \\n; white space around a line doesn't count, and blank lines stand in no window. Of the
    windows of width lines that are equal, the one that comes first by (key, place) stays; a line that any
    later one covers is removed, with blank lines inside it. So a run of equal lines in one document keeps
    its first line. Documents of fewer lines stay as they are, as do null texts (n_lines 0) and rows
    whose key is null. Rows equal in key and text count as one document and keep the same lines. Texts of any length are
    read whole; an empty table gives an empty one; a column of docs named n_lines or n_removed stays, and the new one is
    n_lines_ and so on."""
    n_lines, n_removed, h, lines, spans, gone = (fresh(docs, c) for c in ("n_lines", "n_removed", "__h", "__lines", "__spans", "__gone"))
    source = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.split(F.col(text), "\n", -1).alias("lines")).filter("k is not null and size(lines) >= %d" % width)
    occurs = written(source.select("k", "h", F.explode(_windows(F.col("lines"), width)).alias("s")).select("k", "h", "s.*"))
    place = F.struct("k", "h", "first")
    repeated = written(occurs.groupBy("h1", "h2").agg(F.min(place).alias("f"), F.max(place).alias("g"), F.count("*").alias("n")).filter("f <> g").select("h1", "h2", "f", "n"))
    # Windows with more than a thousandth of the occurrences, of which there are fewer than a thousand, are known to
    # every task; the others meet their occurrences by hash.
    hot = F.col("n") > occurs.count() / 1000
    frequent = repeated.filter(hot).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("f").alias("hot_f"))
    met = occurs.join(F.broadcast(frequent), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    cols = ("k", "h", "first", "last")
    often = met.filter("hot_f is not null").filter(place > F.col("hot_f")).select(*cols)
    rest = met.filter("hot_f is null").select(*cols, "h1", "h2").join(repeated.filter(~hot), ["h1", "h2"]).filter(place > F.col("f")).select(*cols)
    later = often.unionByName(rest).distinct()

    by_doc = Window.partitionBy("k", "h").orderBy("first", "last")
    reach = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", (reach.isNull() | (F.col("first") > reach)).cast("int")).withColumn("island", F.sum("new").over(by_doc))
    merged = islands.groupBy("k", "h", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    covered = merged.groupBy("k", "h").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias(gone)).select(F.col("k").alias(spans), F.col("h").alias(h), gone)

    joined = docs.join(covered, (F.col(key) == F.col(spans)) & (F.xxhash64(docs[text]) == F.col(h)), "left")
    parts = F.split(F.col(text), "\n", -1)
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda s: s["last"] + 1))
    ends = F.concat(F.transform(gone, lambda s: s["first"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col(lines), a + 1, b - a)))
    removed = F.aggregate(gone, F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    out = joined.withColumn(lines, parts)
    out = out.withColumn(n_lines, F.coalesce(F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)), F.lit(0)).cast("bigint")).withColumn(n_removed, F.coalesce(removed, F.lit(0)).cast("bigint"))
    return out.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns, n_lines, n_removed)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its text without repeated lines: doc_id, text, n_lines, n_removed. Edge cases are those of
    line_dedup()."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH l AS (
  SELECT d.doc_id, d.text, u.i - 1 AS i, string_split(d.text, chr(10))[u.i] AS line
  FROM documents d, unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS u(i)),
f AS (
  SELECT *, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM l),
w AS (
  SELECT doc_id, i AS first, lead(i, 2) OVER p AS last,
         t || chr(10) || lead(t, 1) OVER p || chr(10) || lead(t, 2) OVER p AS body
  FROM f WHERE t <> '' WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS n FROM w WHERE last IS NOT NULL),
gone AS (
  SELECT DISTINCT r.doc_id, u.i FROM r, unnest(range(r.first, r.last + 1)) AS u(i) WHERE r.n > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text, count(*) AS n
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY 1),
total AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(t.n, 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN total t USING (doc_id)
"""
