"""Web archives: pages written as WARC records and read back.

A page becomes a response record whose HTTP body has chunked transfer framing; a page with the same payload as an earlier one
becomes a revisit record without a body. Blocks longer than a segment are cut: the first segment keeps the record's head, the
others are continuation records that name its id, their number and, in the last, the total length. Archives are written by
Spark's text writer: the end of a record is the line separator, so tasks commit whole files wherever the folder is.

Reading parses the archives record by record, groups continuation records by the id of the first, orders them by number,
verifies that numbers and total length are complete, and decodes the framing.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.llm.shared import SALTS, salted_lookup, stored, text_batches
from plantcast.session import work_path

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
# With segments this bounds the size of one archive.
RECORDS_PER_FILE = 4096
VERSION = "WARC/1.1"
NEW_LINE = "\r\n"
# Fixed value: the profile that the standard names for revisits of equal payloads.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE16, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RECORD = (
    "path string, number long, kind string, id string, uri string, refers_to string, digest string, origin string, "
    "segment long, total long, block binary"
)
_PAGE = "kind string, id string, uri string, refers_to string, digest string, payload_bytes long, intact boolean, payload binary"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hexadecimal digits are four digits in base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE16, BASE32)


def _page_uri(key: Column, row: Column) -> Column:
    return F.concat(F.lit("page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit("/"), row.cast("string"))


def page_key(uri: Column) -> Column:
    """Key of a page from the id of its record; null for a page without a key."""
    return F.nullif(F.regexp_extract(uri, r"^<page:(.*)/\d+>$", 1), F.lit(""))


def _chunked(body: Column, size: Column) -> Column:
    """Body in chunks of ``CHUNK_BYTES``, ended by an empty one. Bytes travel as a string and are not looked at."""
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(CHUNK_BYTES))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(
        starts,
        lambda at: F.concat(
            F.lower(F.hex(F.least(size - at, F.lit(CHUNK_BYTES)))), F.lit(NEW_LINE), F.substr(body, at + 1, F.lit(CHUNK_BYTES)).cast("string"), F.lit(NEW_LINE)
        ),
    )
    return F.concat(F.array_join(chunks, ""), F.lit(f"0{NEW_LINE}{NEW_LINE}"))


def _lines(**fields: Column) -> Column:
    """Header lines of the fields that are not null."""
    named = [F.concat(F.lit(name.replace("_", "-") + ": "), value.cast("string"), F.lit(NEW_LINE)) for name, value in fields.items()]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in named])


def page_records(pages: DataFrame, key: str, url: str, html: str, least_bytes: int = 0) -> DataFrame:
    """Column ``value``: one WARC record per row, without its last line separator.

    Of the pages with equal payloads of at least ``least_bytes``, the one with the smallest key (nulls last, equal keys in
    any order) is a response and the others are revisits of it. Null pages have an empty payload.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload"))
    marked = rows.select(
        "key", sha1_base32(F.col("payload")).alias("digest"), F.octet_length("payload").alias("size"), "url", F.monotonically_increasing_id().alias("row"), "payload"
    )
    # Rows get their numbers once: they are written with what the archives need.
    marked = stored(marked, "pages")
    slim = marked.select("key", "digest", "size", "row", F.pmod("row", F.lit(SALTS)).alias("salt"))
    place = F.struct(F.col("key").isNull().alias("n"), "key", "row")
    firsts = slim.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where(F.col("n") > 1).select("digest", "first")
    repeats = salted_lookup(slim, firsts, "digest", F.col("salt")).where(F.col("first.row") != F.col("row"))
    # Payloads are shuffled only where the table of repeats is too large to broadcast.
    repeats = stored(repeats.select(F.col("row").alias("_row"), "first"), "repeats")
    found = marked.join(repeats, F.col("row") == F.col("_row"), "left")
    again = F.col("first").isNotNull()
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{NEW_LINE}Content-Type: text/html; charset=utf-8{NEW_LINE}"),
        F.when(again, _lines(Content_Length=F.col("size"))).otherwise(_lines(Transfer_Encoding=F.lit("chunked"))),
        F.lit(NEW_LINE),
    )
    body = F.when(again, F.lit("")).otherwise(_chunked(F.col("payload"), F.col("size").cast("int")))
    block = F.concat(head, body).cast("binary")
    records = found.select(
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.concat(F.lit("<"), _page_uri(F.col("key"), F.col("row")), F.lit(">")).alias("id"),
        F.when(again, F.concat(F.lit("<"), _page_uri(F.col("first.key"), F.col("first.row")), F.lit(">"))).alias("refers_to"),
        # A line break in an address would end its header line.
        F.regexp_replace("url", r"[\r\n]+", "%0A").alias("url"),
        "digest",
        block.alias("block"),
    )
    size = F.octet_length("block")
    count = F.ceil(size / F.lit(SEGMENT_BYTES)).cast("int")
    cut = records.select("*", size.alias("size"), count.alias("count"), F.explode(F.sequence(F.lit(1), count)).alias("segment"))
    part = F.substr(F.col("block"), (F.col("segment") - 1) * SEGMENT_BYTES + 1, F.lit(SEGMENT_BYTES))
    several, later, last = F.col("count") > 1, F.col("segment") > 1, F.col("segment") == F.col("count")
    lines = _lines(
        WARC_Type=F.when(later, "continuation").otherwise(F.col("kind")),
        WARC_Record_ID=F.when(later, F.concat(F.rtrim("id", F.lit(">")), F.lit("#"), F.col("segment"), F.lit(">"))).otherwise(F.col("id")),
        WARC_Date=F.lit("1970-01-01T00:00:00Z"),
        WARC_Target_URI=F.col("url"),
        WARC_Payload_Digest=F.when(~later, F.concat(F.lit("sha1:"), F.col("digest"))),
        WARC_Refers_To=F.when(~later, F.col("refers_to")),
        WARC_Profile=F.when(~later & (F.col("kind") == "revisit"), F.lit(SAME_PAYLOAD)),
        WARC_Segment_Origin_ID=F.when(later, F.col("id")),
        WARC_Segment_Number=F.when(several, F.col("segment")),
        WARC_Segment_Total_Length=F.when(several & last, F.col("size")),
        Content_Type=F.lit("application/http; msgtype=response"),
        Content_Length=F.octet_length(part),
    )
    return cut.select(F.concat(F.lit(VERSION + NEW_LINE), lines, F.lit(NEW_LINE), part.cast("string")).alias("value"))


def write_archives(records: DataFrame, path: str) -> None:
    writer = records.write.option("lineSep", NEW_LINE * 2).option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.option("compression", "gzip").text(path)


def _inflated(content: bytes) -> bytes:
    """Content of an archive; compressed ones may have many members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def split_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(NEW_LINE)
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        start = end + 4
        at = start + int(fields["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} does not end there")
        yield fields, data[start:at]
        at += 4


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"segment": "Int64", "total": "Int64"})

    def number(value: str | None) -> int | None:
        return int(value) if value is not None else None

    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = []
            for i, (f, block) in enumerate(split_archive(_inflated(content))):
                digest = f.get("warc-payload-digest", "")
                rows.append((
                    path, i, f["warc-type"], f["warc-record-id"], f.get("warc-target-uri"), f.get("warc-refers-to"), digest.rpartition(":")[2] or None,
                    f.get("warc-segment-origin-id"), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), block,
                ))
                if len(rows) == 500:
                    yield frame(rows)
                    rows = []
            yield frame(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_parse, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: those without segments, and one for each segmented record with its blocks put together.

    ``intact`` says whether the first record is there, numbers run from 1 without a gap and only the last carries the total
    length, which is that of all blocks. A repeated segment counts once. Continuations without a first record give an incomplete one.
    """
    fields = ["kind", "id", "uri", "refers_to", "digest"]
    single = records.where(F.col("segment").isNull()).select(*fields, "block", F.lit(True).alias("intact"))
    parts = records.where(F.col("segment").isNotNull())
    head = F.when(F.col("kind") != "continuation", F.struct(*fields))
    # A record has as many segments as its one page needs.
    grouped = parts.groupBy(F.coalesce("origin", "id").alias("first")).agg(
        F.max(head).alias("head"), F.array_sort(F.collect_set(F.struct("segment", "total", "block"))).alias("parts")
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    blocks = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    totals = F.filter(F.transform("parts", lambda p: p["total"]), lambda t: t.isNotNull())
    whole = F.col("head").isNotNull() & (numbers == F.sequence(F.lit(1), F.size("parts")).cast("array<long>"))
    whole &= (F.size(totals) == 1) & (F.element_at("parts", -1)["total"] == F.octet_length(blocks))
    joined = grouped.select(*[F.col(f"head.{c}").alias(c) if c != "id" else F.col("first").alias("id") for c in fields], blocks.alias("block"), F.coalesce(whole, F.lit(False)).alias("intact"))
    return single.unionByName(joined)


def unchunk(body: bytes) -> bytes | None:
    """Body without its chunked framing; null if it does not end with an empty chunk. Chunk extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].partition(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        start = end + 2
        if size < 0 or body[start + size : start + size + 2] != b"\r\n":
            return None
        out.append(body[start : start + size])
        at = start + size + 2


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for kind, id_, uri, refers, digest, block, intact in zip(*(pdf[c] for c in ("kind", "id", "uri", "refers_to", "digest", "block", "intact"))):
            head, _, body = block.partition(b"\r\n\r\n")
            fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
            payload, size = None, None
            if kind == "revisit":
                size = int(fields.get(b"content-length", b"-1"))
            elif intact:
                payload = unchunk(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                intact = payload is not None and (digest is None or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
                size = len(payload) if payload is not None else None
            rows.append((kind, id_, uri, refers, digest, size, bool(intact), payload))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _PAGE.split(", ")])
        yield out.astype({"payload_bytes": "Int64"})


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives: ``kind``, ``id``, ``uri``, ``refers_to``, ``digest``, ``payload_bytes`` (of the full payload, for revisits
    too), ``intact`` (all segments there, framing complete, digest right) and ``payload`` (null for revisits and broken records)."""
    whole = reassemble(read_records(spark, path)).where(F.col("kind").isin("response", "revisit") | F.col("kind").isNull())
    return whole.mapInPandas(_decode, _PAGE)


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back. Repeated rows are separate records."""
    spark = pages.sparkSession
    text_batches(spark)
    path = work_path(spark, "warc")
    write_archives(page_records(pages, key, url, html, least_bytes), path)
    return read_pages(spark, path)
