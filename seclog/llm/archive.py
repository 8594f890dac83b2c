"""A content-addressed web archive: payload bytes once per digest, record headers apart, records through joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.sources.staging import new_folder, staged

#: Fixed values of the format: base 32 digits by value, the letters that conv() uses for them.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of bytes in upper-case base 32: 160 bits are eight times five hexadecimal or four base 32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A row per row of ``pages`` (page_id, url, html): payload, its digests and what the record is.

    Payloads are equal if their SHA-256, which names them in the store, is; the store checks their bytes. Of equal
    payloads of ``min_bytes`` or more, the record with the largest page_id is the response.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("content"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))


def _line(name: str, value: Column) -> Column:
    """A header line, left out where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def header(kind: Column, refers_to: Column) -> Column:
    """The exact header of a record, up to and with its empty line. Line breaks in an address are percent-encoded."""
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.when(kind == "revisit", F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(kind == "revisit", F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(kind == "revisit", record_id(refers_to))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", length),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Two tables under ``folder``: ``payloads`` (content, payload) and ``headers`` (page_id, content, header, copy).

    Payload bytes are grouped by digest and content, so a payload is moved once per task that has it and stored
    once; two contents under one digest raise an error.
    """
    rows = records(pages, min_bytes)
    # Few bytes decide what a record is, so only they are joined.
    small = rows.drop("payload").withColumn("long_enough", F.col("payload_bytes") >= min_bytes)
    last = small.filter("long_enough").groupBy("content").agg(F.max("page_id").alias("response_id"))
    # As a table of its own, so that the join has two shuffled sides and can split a payload that many pages have.
    last = staged(last, "responses")
    marked = small.join(last, "content", "left").withColumn("response", ~F.col("long_enough") | F.col("page_id").eqNullSafe(F.col("response_id")))
    kind = F.when(F.col("response"), "response").otherwise("revisit")
    written = marked.select("page_id", "content", header(kind, F.col("response_id")).alias("header"), "long_enough", "response")
    written.write.parquet(f"{folder}/headers")
    different = rows.groupBy("content", "payload").agg(F.lit(1).alias("n"))
    different.select("content", "payload").write.parquet(f"{folder}/payloads")
    stored = pages.sparkSession.read.parquet(f"{folder}/payloads")
    clash = stored.groupBy("content").count().filter("count > 1").select(F.hex("content")).first()
    if clash:
        raise ValueError(f"two payloads have the digest {clash[0]}")


def _field(name: str, text: Column) -> Column:
    found = F.regexp_extract(text, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(F.length(found) > 0, found)


def read_archive(spark: SparkSession, folder: str, page_type: str = "long") -> DataFrame:
    """The archive's records: page_id, header, payload (of a revisit: that of the record it refers to) and what they say.

    Each record is its header joined with the stored payload; digest and length are taken from those bytes, and a
    payload that does not have the digest in its header raises an error.
    """
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    once = payloads.withColumn("true_digest", base32_sha1(F.col("payload"))).withColumn("true_bytes", F.octet_length("payload").cast("long"))
    rows = headers.join(once, "content")
    said = F.regexp_replace(_field("WARC-Payload-Digest", F.col("header")), "^sha1:", "")
    checked = F.when(said == F.col("true_digest"), said).otherwise(F.raise_error(F.concat(F.lit("payload differs from "), said)).cast("string"))
    number = lambda name: F.regexp_extract(F.col("header"), rf"{name}: <urn:page:([^>]*)>", 1).try_cast(page_type)
    return rows.select(
        number("WARC-Record-ID").alias("page_id"),
        F.col("true_bytes").alias("payload_bytes"),
        checked.alias("payload_digest"),
        _field("WARC-Type", F.col("header")).alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        "header",
        "payload",
    )


def record_bytes(rows: DataFrame) -> DataFrame:
    """``record``: the bytes of each record as they stand in a WARC file."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.withColumn("record", F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")))


def web_archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null address leaves the header line out, a null page_id stays null and never
    is the largest; rows with the largest page_id of equal payloads are all responses if repeated. Other columns
    are not read; no rows give no rows.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "archive")
    write_archive(pages, folder, min_bytes)
    read = read_archive(spark, folder, pages.schema["page_id"].dataType.simpleString())
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: DuckDB has SHA-1 in hexadecimal digits; 32 groups of five bits are looked up in the alphabet.
OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     g AS (SELECT html, max(page_id) AS last FROM p GROUP BY html),
     x AS (SELECT p.page_id, p.html, g.last, sha1(p.html) AS h FROM p JOIN g ON p.html = g.html),
     b AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(h, CAST(i + 1 AS BIGINT), 1)) - 1) AS n FROM x)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('{BASE32}', CAST(1 + (
           (n[CAST((5 * k) // 4 + 1 AS BIGINT)] * 16 + coalesce(n[CAST((5 * k) // 4 + 2 AS BIGINT)], 0))
           // CAST(pow(2, 3 - (5 * k) % 4) AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""
