"""Exact copies by recipes of content-defined chunks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seclog.llm.common import documents, packed_rows, unpacked_rows
from seclog.sources.staging import staged

#: A chunk ends, once it has 256 bytes, behind three bytes that are 1 modulo 4, and at 4096 bytes at the latest. Where
#: it ends depends on the bytes before alone, in any script, so texts that share a passage share most chunks of it.
_ENDS = "[" + "".join(rf"\x{b:02x}" for b in range(1, 256, 4)) + "]"
CHUNK = r"(?s).{253,4093}?" + _ENDS + "{3}|.{1,4096}"


def chunks(text: Column) -> Column:
    """The chunks of a text in order, each with a character for a byte of UTF-8; together they are its bytes.

    An empty text has one empty chunk.
    """
    single = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    cut = F.regexp_extract_all(single, F.lit(CHUNK), F.lit(0))
    return F.when(F.char_length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def _cut(docs: DataFrame) -> DataFrame:
    """A row per chunk: doc_id, digest of the text, position, chunk and its digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    return rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.posexplode(chunks(F.col("text"))).alias("pos", "chunk")).withColumn(
        "digest", F.unhex(F.sha2("chunk", 256))
    )


def chunk_ids(docs: DataFrame) -> DataFrame:
    """(digest, chunk_id) of every different chunk.

    Chunks are grouped by their bytes, not only by their digest; two contents under one digest raise an error, so
    an identifier stands for one content. The content is moved once, after copies within a task are combined.
    """
    different = _cut(docs).groupBy("digest", "chunk").agg(F.lit(1).alias("n"))
    counted = different.groupBy("digest").agg(F.sum("n").alias("n"))
    found = F.when(F.col("n") == 1, F.monotonically_increasing_id()).otherwise(
        F.raise_error(F.concat(F.lit("two chunks have the digest "), F.hex("digest"))).cast("long")
    )
    return staged(counted.select("digest", found.alias("chunk_id")), "chunks")


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, recipe, copies): the ordered chunk identifiers of each different (doc_id, text)."""
    parts = _cut(docs).select("doc_id", "sha", "pos", "digest").join(chunk_ids(docs), "digest")
    listed = parts.groupBy("doc_id", "sha").agg(
        F.array_sort(F.collect_set(F.struct("pos", "chunk_id"))).alias("places"),
        F.count_if(F.col("pos") == 0).alias("copies"),
    )
    return listed.select("doc_id", "sha", F.transform("places", lambda p: p["chunk_id"]).alias("recipe"), "copies")


def exact_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), dropped ones too.

    ``keep_id`` is the largest doc_id with the same text, ``group_size`` the number of rows with it, ``kept`` is
    true for one row of the group, ``text_sha256`` the digest of the text. Null text counts as empty. Rows that
    repeat doc_id and text each get a row, of which one at most is kept; a null doc_id is smaller than any other
    (a group of nulls only keeps one row, with keep_id null). Other columns are not read; no rows give no rows.
    """
    made = staged(recipes(docs), "recipes")
    # As a table of its own, so that the join below has two shuffled sides and can split a group with many rows.
    groups = made.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = staged(groups, "groups")
    rows = made.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    )
    return rows.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged, whatever their names. Texts move once, in the last join.

    Of equal texts (null counts as empty) the row with the largest doc_id stays, a null doc_id being smaller than any
    other, and one of rows that repeat both. No rows give no rows.
    """
    stay = exact_copies(docs).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    return one_by_key(docs, stay)


def one_by_key(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``row_key`` in ``stay`` (column key)."""
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = packed_rows(docs, key=row_key(F.col("doc_id"), sha)).join(stay, "key", "left_semi")
    one = Window.partitionBy("key").orderBy(F.lit(1))
    return unpacked_rows(rows.withColumn("n", F.row_number().over(one)).filter("n = 1"), docs.columns)


def row_key(doc_id: Column, sha: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), sha)


def op6_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(documents(spark, sf_dir))


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""
