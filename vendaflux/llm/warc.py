"""WARC archives without repeated payloads.

Records are written as WARC/1.1 by Spark's text sink: a record ends with two line ends, which is the sink's line
separator, so part files are archives.  ``resolve`` looks at headers only: they are shuffled by payload digest, and the
smallest id of a digest becomes the original to which the others refer; revisit records that came in are joined to the
response with their digest the same way.  Payloads move once, to the records that keep them.

Cases: a null payload is an empty one.  A null id comes last and is written without an id line.  Of rows equal in id
and payload one is the response.  A null url is left out, control characters in it are escaped.  Revisits whose
digest has no response stay revisits that refer to nothing.  No rows give an empty archive.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendaflux.llm.common import shared_dir, text_of, written

END = "\r\n"
#: Payloads below this size are never replaced by a revisit.
LEAST_BYTES = 100
#: Bytes of payload in one archive, about: what a reading task holds at once.
ARCHIVE_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Header fields of a response record for each row: ``id, url, digest, bytes, type``."""
    payload = text_of(payload_col)
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.sha2(payload, 256).alias("digest"),
                        F.octet_length(payload).cast("long").alias("bytes"), F.lit("response").alias("type"))


def resolve(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Decide for each header row (``id, url, digest, bytes, type``): ``record_type`` and ``refers_to``.

    Counted by digest in each partition first; a digest that a third of all records share reaches one task as one row
    from each partition, and the join back is one that Spark splits."""
    rows = records.withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "warc_heads")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    whole = F.col("type") == "response"
    groups = (rows.where(F.col("bytes") >= least).groupBy("digest")
              .agg(F.count("*").alias("n"), F.min(F.when(whole, order)).alias("first"), F.bool_or(~whole).alias("had"))
              .where("n > 1 or had").select("digest", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")))
    is_first = F.col("first_row").isNull() & whole | (F.col("row") == F.col("first_row"))
    return (rows.join(groups, "digest", "left")
            .withColumn("record_type", F.when(is_first, "response").otherwise("revisit"))
            .withColumn("refers_to", F.when(~is_first, F.col("first_id"))).withColumn("refers_row", F.when(~is_first, F.col("first_row")))
            .drop("first_id", "first_row"))


def _record_id(of: Column, digest: Column, row: Column) -> Column:
    """A record's name: rows that share an id or a payload, or both, are told apart by their number."""
    h = F.md5(F.concat_ws("/", F.lit("record:"), of.cast("string"), digest, row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def record_text(date: str) -> Column:
    """The text of a record from ``id, row, url, digest, bytes, record_type, refers_to, refers_row, payload``."""
    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    body = F.when(revisit, F.lit("")).otherwise(text_of("payload"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END * 2))
    block = F.concat(http, body)
    return F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"), F.col("row"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), line("WARC-Refers-To", F.when(revisit & F.col("refers_row").isNotNull(), _record_id(F.col("refers_to"), F.col("digest"), F.col("refers_row")))),
        line("X-Record-Number", F.col("id").cast("string")), line("X-Refers-To-Number", F.when(revisit, F.col("refers_to").cast("string"))),
        line("X-Payload-Length", F.col("bytes").cast("string")), line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block)


def write_archives(pages: DataFrame, decided: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html",
                   date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of ``decided``; payloads come from ``pages`` for responses only."""
    def key(of: str, digest: Column) -> Column:
        return F.concat_ws("/", F.coalesce(F.col(of).cast("string"), F.lit("")), digest)

    total = decided.agg(F.sum("bytes")).first()[0] or 0
    files = max(1, -(-total // archive_bytes))
    payloads = (pages.select(key(id_col, F.sha2(text_of(payload_col), 256)).alias("key"), text_of(payload_col).alias("payload"))
                .repartition(files, "key"))
    once = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    payloads = payloads.withColumn("nth", once).where("nth = 1").drop("nth")
    heads = decided.withColumn("key", key("id", F.col("digest"))).repartition(files, "key")
    (heads.join(payloads, "key", "left").select(record_text(date).alias("value"))
     .write.option("lineSep", END * 2).option("compression", "gzip").text(path))


READ_SCHEMA = ("id string, url string, record_type string, digest string, refers_to string, stated_bytes long, "
               "payload binary, payload_sha256 string")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``path``; each record's length comes from its header, never from its content.

    ``payload_sha256`` is computed from the stored payload; the payload itself is left out on demand."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch.value:
                data, at, rows = text.encode("utf-8"), 0, []
                while at < len(data):
                    if data.startswith(b"\r\n", at):
                        at += 2
                        continue
                    stop = data.index(b"\r\n\r\n", at)
                    head = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8").split(END)[1:])
                    at = stop + 4 + int(head["Content-Length"])
                    block = data[stop + 4: at]
                    body = block[block.index(b"\r\n\r\n") + 4:]
                    whole = head["WARC-Type"] == "response"
                    rows.append((head.get("X-Record-Number"), head.get("WARC-Target-URI"), head["WARC-Type"],
                                 head["WARC-Payload-Digest"].removeprefix("sha256:"), head.get("X-Refers-To-Number"),
                                 int(head["X-Payload-Length"]), body if whole and payloads else None,
                                 hashlib.sha256(body).hexdigest() if whole else None))
                if rows:
                    yield pd.DataFrame(rows, columns=[f.split()[0] for f in READ_SCHEMA.split(", ")])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, READ_SCHEMA)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write deduplicated archives of all rows into the shared folder and return their records, read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, resolve(headers(pages, id_col, url_col, payload_col)), path, id_col, payload_col)
    return read_archives(spark, path, payloads=False)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
