"""Line deduplication across documents, native DataFrame functions only.

Lines are exploded as (hash of the normalised line, document), distinct documents are
counted per hash, lines over the threshold are dropped except in the last document that
holds them, and the rest is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = "\t\n\x0b\f\r "
MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def _hash(key: Column) -> Column:
    # two hashes with different seeds: 128 bits
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, dropped array<struct>): hashes of the lines each document loses.

    One row per document and line hash is kept before counting, and counts are combined map-side,
    so a line that a third of all documents holds is a few partial counts per task.
    """
    keys = F.filter(
        F.transform(F.split(F.col("text"), "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars
    )
    held = (
        docs.select("doc_id", F.explode(F.array_distinct(F.transform(keys, _hash))).alias("line"))
        .groupBy("line", "doc_id").agg(F.lit(1).alias("one"))  # a repeated doc_id counts once
    )
    frequent = (
        held.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        .filter(F.col("n") >= min_docs)
    )
    return (
        held.join(frequent, "line").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("doc_id").agg(F.collect_list("line").alias("dropped"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_counts: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, plus ``n_lines`` and ``n_dropped`` (before, lost; they
    replace columns of these names) unless ``with_counts`` is off.

    Lines whose key has at least ``min_chars`` code points and is in at least ``min_docs``
    documents stay only in the largest doc_id that holds them (there all its copies stay).
    Null or empty text is one empty line and gives "". Rows that repeat a doc_id are one document
    when documents are counted and are cleaned alike; a null doc_id is a document
    that is never the largest. Extra columns pass through; an empty table gives an empty table.
    """
    drops = repeated_lines(docs, min_chars, min_docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    joined = rows.join(drops, F.col("row.doc_id").eqNullSafe(F.col("doc_id")), "left").withColumn(
        "lines", F.split(F.coalesce("row.text", F.lit("")), "\n", -1)  # after the join: only the text is shuffled
    )

    def stays(x: Column) -> Column:
        return ~((F.char_length(line_key(x)) >= min_chars) & F.array_contains(F.col("dropped"), _hash(line_key(x))))

    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    counts = {"n_lines": F.size("lines"), "n_dropped": F.size("lines") - F.size("kept")} if with_counts else {}
    columns = [F.concat_ws("\n", "kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in counts]
    return joined.withColumn("kept", kept).select(*columns, *[n.cast("long").alias(c) for c, n in counts.items()])


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """Digest of :func:`dedup_lines`: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
freq AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, freq.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN freq USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
