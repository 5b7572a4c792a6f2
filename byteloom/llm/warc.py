"""Content-addressed WARC archive.

An archive is a folder of three tables. `payloads` holds each distinct payload once, under its SHA-256 digest,
bucketed by digest. `records` holds the exact header bytes of every WARC record, the digest of its payload and how
many records share it. `about` holds the number of buckets, so that any session can open the archive by its folder.
Joining the two gives back the original records byte for byte (`records_of`); every payload is
hashed again on the way and a wrong digest stops the query. Buckets join without moving payloads. Records whose payload is shared by
more than HOT are joined apart: they are dealt over shares of about HOT records, each of which gets its own copy of the payload.

Among records whose payloads are equal and at least REVISIT_BYTES long, the one with the largest page_id is a
response and the others are revisits of it; all other records are responses.

Defined cases: a null html is the empty payload; a null url gives no WARC-Target-URI; a null page_id never
is the largest, and stays a response if its group has no other id; repeated page_ids that are
the largest are all responses; repeated rows are records each; ties of equal payloads don't matter, as equal digests hold equal bytes; a very long html is one payload,
held whole by the task that hashes it; other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 1000
#: Records that one task joins with a payload.
HOT = 1000
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line; none where value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write(pages: DataFrame, folder: str, date: str = DATE, revisit_bytes: int = REVISIT_BYTES) -> str:
    """Writes an archive; returns its folder."""
    spark = pages.sparkSession
    rows = common.need(pages, page_id="long", url="string", html="string").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # equal digests hold equal bytes, so any of them will do; each task sends one of a kind
    table, buckets = f"warc_{uuid.uuid4().hex}", common.parallelism(spark)
    distinct = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    distinct.write.option("path", f"{folder}/payloads").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{folder}/about")

    facts = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    first = facts.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("sharing"))
    facts = facts.join(first, "digest")
    revisit = (F.col("bytes") >= revisit_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", name),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    facts.select("page_id", F.encode(head, "utf-8").alias("header"), "digest", "sharing").write.parquet(f"{folder}/records")
    return folder


def payloads_of(spark: SparkSession, folder: str) -> DataFrame:
    """digest, payload: the archive's payloads, which Spark knows to be bucketed; the catalogue keeps nothing."""
    buckets = spark.read.parquet(f"{folder}/about").first()["buckets"]
    table = f"warc_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} (digest STRING, payload BINARY) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}/payloads'")
    found = spark.table(table)
    found.schema  # resolved while the table is there
    spark.sql(f"DROP TABLE {table}")
    return found


def records_of(spark: SparkSession, folder: str, hot: int = HOT) -> DataFrame:
    """page_id, header, payload, record: the archive's records, rebuilt by a join and verified."""
    payloads, heads = payloads_of(spark, folder), spark.read.parquet(f"{folder}/records")
    few = heads.where(F.col("sharing") <= hot).join(payloads, "digest", "left").select("page_id", "header", "digest", "payload")
    # shares of a hot payload: ceil(sharing / hot), so copies of payloads number at most the records over hot, and one for each
    shares = F.ceil(F.col("sharing") / hot).cast("int")
    many = heads.where(F.col("sharing") > hot)
    copies = many.groupBy("digest").agg(F.max("sharing").alias("sharing")).join(payloads, "digest", "left")
    copies = copies.select("digest", "payload", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    dealt = many.select("page_id", "header", "digest", F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), shares).cast("int").alias("share"))
    dealt = dealt.join(copies.hint("shuffle_merge"), ["digest", "share"], "left").select("page_id", "header", "digest", "payload")
    both = few.unionByName(dealt)
    ok = F.col("payload").isNotNull() & (F.sha2("payload", 256) == F.col("digest"))
    payload = F.when(ok, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is missing or damaged: "), F.col("digest"))).cast("binary"))
    both = both.select("page_id", "header", payload.alias("payload"))
    body = F.when(F.decode("header", "utf-8").contains(f"{CRLF}WARC-Type: revisit{CRLF}"), F.lit("").cast("binary")).otherwise(F.col("payload"))
    return both.withColumn("record", F.concat("header", body, F.lit(CRLF * 2).cast("binary")))


def facts_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the records' own headers and payloads."""
    head = F.decode("header", "utf-8")

    def field(name: str, value: str) -> Column:
        return F.nullif(F.regexp_extract(head, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))

    length = field("Content-Length", r"(\d+)").cast("long")
    whole = F.octet_length("record") == F.octet_length("header") + length + 4
    checked = F.when(F.sha1("payload") == field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})"), F.sha1("payload")).otherwise(F.raise_error(F.lit("payload digest does not fit its header")).cast("string"))
    return records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"),
        F.when(whole, field("WARC-Type", "([a-z]+)")).otherwise(F.raise_error(F.lit("record length does not fit its header")).cast("string")).alias("record_type"),
        field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
    )
