"""Content-addressed web archive.

An archive is a folder of two tables: ``payloads`` holds the bytes of each distinct
payload once, under its SHA-256; ``records`` holds every record's exact WARC header block
with the digest of the payload it belongs to. Records are put together again by a join on
the digest, and each payload's digest is computed anew on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import shared_folder, text_or_empty

#: Payloads of fewer bytes are stored with every record's own response, as a revisit wouldn't pay.
LEAST_SHARED = 1000
#: Fixed values of the format.
VERSION = "WARC/1.1"
BREAK = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, least_shared: int = LEAST_SHARED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """The tables (payloads, records) of a set of pages.

    Of the pages with one payload of at least ``least_shared`` bytes that with the largest id
    is the response, others are revisits that refer to it; smaller payloads are responses all.
    Rows that repeat that largest id are responses too. A null id is never the largest
    unless all are null. A null html is the empty payload, a null url an empty target. Only
    digests and ids are shuffled to choose the responses; a payload that a third of all pages
    share is one row there, summed before the shuffle.
    """
    payload = text_or_empty(F.col(f"`{html_col}`")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), text_or_empty(F.col(f"`{url_col}`")).alias("url"), payload.alias("payload"))
    keyed = rows.select("page_id", "url", F.length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"))
    chosen = keyed.groupBy("digest").agg(F.max("page_id").alias("first"))
    shared = keyed.join(chosen, "digest")
    revisit = (F.col("bytes") >= least_shared) & F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    shared = shared.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first")))
    heads = shared.select("page_id", "digest", _header().alias("header"))

    # the bytes of a payload travel once: copies are dropped before the shuffle
    stored = rows.select(F.sha2("payload", 256).alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload"))
    return stored, heads


def _header() -> Column:
    """The header block of a record, up to the empty line that ends it."""
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), named("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), named("refers_to"))),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("record_type") == "revisit", F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    return F.concat(F.concat_ws(BREAK, *lines), F.lit(BREAK + BREAK)).cast("binary")


def write(pages: DataFrame, folder: str | None = None, **options) -> str:
    """Write the archive of ``pages`` and return its folder, by default a new one in the cluster's shared folder."""
    folder = folder or shared_folder(pages.sparkSession)
    payloads, heads = records(pages, **options)
    payloads.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    heads.write.parquet(f"{folder}/records")
    return folder


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of an archive: ``page_id, url, record_type, refers_to, payload_digest, header, payload, record, verified``.

    ``payload`` is that of the page, also for revisits; ``record`` is the WARC record as it
    stands in a file: header block, payload (none in a revisit) and two line breaks.
    ``verified`` says whether the payload has the stored SHA-256 and the header's SHA-1; a
    record whose payload isn't in the archive has a null payload and isn't verified.
    """
    heads = spark.read.parquet(f"{folder}/records")
    payloads = spark.read.parquet(f"{folder}/payloads")
    rows = heads.join(payloads, "digest", "left")
    kind = F.col("record_type")
    rows = rows.withColumn("record_type", _field("WARC-Type")).withColumn("payload_digest", F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", ""))
    refers = F.nullif(F.regexp_extract(_field("WARC-Refers-To"), "^<urn:page:(.*)>$", 1), F.lit(""))
    body = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    verified = F.coalesce((F.sha2("payload", 256) == F.col("digest")) & (F.sha1("payload") == F.col("payload_digest")), F.lit(False))
    return rows.select("page_id", _field("WARC-Target-URI").alias("url"), "record_type", refers.alias("refers_to"), "payload_digest", "header", "payload",
                       F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")).alias("record"), verified.alias("verified"))


def export(spark: SparkSession, folder: str, to: str) -> None:
    """The archive's records as plain WARC files. A record's last two line breaks are what the text writer puts after each row."""
    ended = read(spark, folder).select(F.col("record").cast("string").alias("value"))
    ended.select(F.expr("left(value, length(value) - 4)").alias("value")).write.option("lineSep", BREAK + BREAK).text(to)
