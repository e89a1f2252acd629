"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; record headers are kept
separately, byte for byte, and a record is rebuilt by joining the two.

    <archive>/headers   record_no, page_id, uri, header, sha256, …
    <archive>/payloads  sha256, payload, n_bytes

Which record of equal payloads is the response is decided on digests alone (a
min per digest, combined map-side, so thousands of copies cost one row per
task).  Only then do payload bytes move, once, also combined map-side.  Digests
are verified: two payloads may share an address only if SHA-256, SHA-1 and
length all agree, and the reader recomputes SHA-256 over what is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

CRLF = "\r\n"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are eight groups of five hex digits."""
    return _base32(F.sha1(payload))


def _base32(hex40: Column) -> Column:
    groups = [F.lpad(F.conv(F.substring(hex40, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), BASE32_HEX, BASE32)


def _header(c: dict[str, Column]) -> Column:
    """The exact header block of a record, its blank line included."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = c["record_type"] == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", c["record_type"]),
        line("WARC-Record-ID", c["record_id"]),
        line("WARC-Date", c["date"]),
        F.when(c["uri"].isNotNull(), line("WARC-Target-URI", F.regexp_replace(c["uri"], r"[\r\n]", " "))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c["sha1"])),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", c["refers_to_id"]))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(c["n_bytes"]).cast("string")),
        F.lit(CRLF),
    )


def _record_id(sha256: Column, record_no: Column) -> Column:
    h = F.md5(F.concat_ws(":", sha256, record_no.cast("string")))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                  min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write one WARC record per row of ``pages`` to ``path`` and return the path.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, the
    one with the smallest id (nulls last; among repeated rows the first read) is
    the response and the others are revisits of it.  Smaller payloads are always
    responses; their bytes are stored once all the same.

    Defined results: a null payload is empty; a null id or URI stays null and the
    URI line is left out; an empty table writes an empty archive; other columns
    are not archived.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(uri_col).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    digests = materialize(rows.select(
        F.monotonically_increasing_id().alias("record_no"), "page_id", "uri", "sha256",
        base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes")), "warc-digests")

    address = ["sha256", "sha1", "n_bytes"]
    first = F.min(F.struct(F.col("page_id").isNull().alias("null_id"), "page_id", "record_no"))
    firsts = materialize(digests.groupBy(*address).agg(first.alias("first"), F.count("*").alias("copies"))
                         .where("copies > 1")
                         .where(F.col("n_bytes") >= min_revisit_bytes), "warc-firsts")
    typed = digests.join(firsts.select(*[F.col(a).alias(f"_{a}") for a in address], "first"),
                         [F.col(a) == F.col(f"_{a}") for a in address], "left")
    revisit = F.col("first").isNotNull() & (F.col("first.record_no") != F.col("record_no"))
    typed = typed.select(
        "record_no", "page_id", "uri", *address, F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(revisit, _record_id(F.col("sha256"), F.col("first.record_no"))).alias("refers_to_id"),
        _record_id(F.col("sha256"), F.col("record_no")).alias("record_id"))
    header = _header({c: F.col(c) for c in typed.columns} | {"date": F.lit(date)})
    typed.withColumn("header", F.encode(header, "UTF-8")).write.option("compression", "zstd").parquet(f"{path}/headers")

    # One copy of each payload.  Equal addresses hold equal bytes, so any will do.
    stored = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).groupBy("sha256", "n_bytes").agg(F.first("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with the digests of the stored bytes; fails if one does not match its address."""
    p = spark.read.schema("sha256 string, n_bytes long, payload binary").parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("n_bytes"))
    return p.select(
        F.when(sound, F.col("sha256")).otherwise(F.raise_error(F.lit("payload does not match its digest"))).alias("sha256"),
        "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild the records: header block, payload (of the response, for a revisit too) and the whole record's bytes.

    page_id, uri, record_type, refers_to, header, payload, payload_bytes,
    payload_digest, record.  A revisit's record carries no payload bytes.
    """
    h = spark.read.parquet(f"{path}/headers")
    both = h.select("page_id", "uri", "refers_to", "header", "sha256", F.col("sha1").alias("_sha1")).join(read_payloads(spark, path), "sha256")
    text = F.decode("header", "UTF-8")
    kind = F.regexp_extract(text, r"\r\nWARC-Type: ([^\r\n]*)", 1)
    declared = F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]*)", 1)
    sound = declared == F.col("payload_digest")
    return both.select(
        "page_id", "uri", kind.alias("record_type"), "refers_to", "header", "payload", "payload_bytes",
        F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload digests differ"))).alias("payload_digest"),
        F.concat("header", F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n")).alias("record"))
