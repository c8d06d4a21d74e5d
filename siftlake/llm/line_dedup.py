"""Line dedup with compressed keep bitmaps, in DataFrame functions alone.

A line's key is the line without white space at both ends and with A-Z in lower case, as two
64-bit hashes. Occurrences are range-partitioned by key and document, so that a key which half of
all documents hold is split over many partitions, and walked in order: the first stream over the
sorted rows gives one row per key and document with its positions. Documents per key are then
partial sums. Keys found in at least `min_docs` documents lose their lines: all of them
(keep="none") or all but the first one of the lowest document (keep="first").

The result is a bitmap per document, not text: 64-bit words of dropped positions, words without
one left out. applied() joins them with the texts.

Defined results: very long texts are split as a whole, into one array of lines; null and empty texts are one empty line, which has no key and stays; rows equal
in doc_id and text are one document, whose lines count once, and each of them loses the same
lines; null is a doc_id like any other and sorts first; other columns are carried along by
applied(), whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import common

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lowered(text: Column) -> Column:
    """A-Z in lower case; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def keys_of(text: Column) -> Column:
    return F.transform(lines_of(lowered(text)), lambda line: F.btrim(line, F.lit(WHITE)))


def _occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """One row per keyed line: the hashes of its key, its document and its position."""
    text = common.text_or_empty(docs)
    hashed = F.transform(keys_of(text), lambda key, at: F.struct(at.alias("pos"), F.char_length(key).alias("n"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")))
    keyed = F.filter(hashed, lambda line: line["n"] >= max(1, least_chars))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(text).alias("body"), F.explode(keyed).alias("line"))
    return rows.select("line.h1", "line.h2", "doc", "body", "line.pos")


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", least_chars: int = 1) -> DataFrame:
    """doc, body (a hash of the text), and words: the dropped positions of each document that has any."""
    if keep not in ("none", "first"):
        raise ValueError(f"unknown keep {keep!r}")
    spark = docs.sparkSession
    # Both tables are read twice, by sampling and by joins: the first so that the texts are split once,
    # the second so that the join on a hot key can be split at run time.
    found = common.checkpointed(_occurrences(docs, least_chars))
    ranged = found.repartitionByRange(common.shuffle_partitions(spark), "h1", "h2", "doc", "body").sortWithinPartitions("h1", "h2", "doc", "body", "pos")
    by_doc = ranged.groupBy("h1", "h2", "doc", "body").agg(F.collect_set("pos").alias("at"))
    place = F.struct(F.col("doc"), F.col("body"), F.array_min("at").alias("pos"))
    keys = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min(place).alias("first")).where(F.col("docs") >= min_docs)
    keys = common.checkpointed(keys)
    hits = by_doc.join(keys, ["h1", "h2"])
    if keep == "first":
        kept = F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.body") == F.col("body"))
        hits = hits.withColumn("at", F.when(kept, F.array_remove("at", F.col("first.pos"))).otherwise(F.col("at")))
    bits = hits.select("doc", "body", F.explode("at").alias("pos"))
    words = bits.groupBy("doc", "body", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc", "body").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def applied(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Boxed rows (common.boxed) with `kept` (the text without dropped lines), n_lines and n_dropped."""
    rows = common.boxed(docs)
    joined = rows.join(bitmaps.withColumnRenamed("body", "its_body"), rows["id"].eqNullSafe(F.col("doc")) & (rows["body"] == F.col("its_body")), "left")
    text = F.col("row")["text"].cast("string")
    split = joined.withColumn("lines", lines_of(F.coalesce(text, F.lit(""))))
    dense = F.transform(F.sequence(F.lit(0), F.expr("(size(lines) - 1) div 64")), lambda word: F.coalesce(F.try_element_at("words", word.cast("long")), F.lit(0).cast("long")))
    split = split.withColumn("dense", F.when(F.col("words").isNotNull(), dense))
    kept = F.filter("lines", lambda line, at: F.getbit(F.get("dense", F.floor(at / 64).cast("int")), at % 64) == 0)
    dropped = F.aggregate(F.map_values("words"), F.lit(0).cast("long"), lambda total, bits: total + F.bit_count(bits))
    return split.select(
        "row",
        "id",
        F.when(F.col("words").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0)).alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    kept = applied(docs, drop_bitmaps(docs))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id
"""
