r"""WARC archives: a writer by SQL functions, and a reader that salvages.

Records are WARC/1.1, each a gzip member of its own, so that damage costs no
more than the records it lies in. Archives are bounded by bytes. The writer
builds each record as a string, packs members into archives and hands each to
Spark's text sink as a row and a file of its own, so archives are committed
like any other output and lie in any store that Spark can reach.

The reader takes every byte of an archive in turn. A record that fails a
check (version line, header, length, end mark, block digest) is not trusted:
the reader searches for the next gzip member or version line that does pass,
goes on from there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, delete_at_end, new_path, stored, table

VERSION = b"WARC/1.1\r\n"
VERSION_START = b"WARC/1."
GZIP_START = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
#: An archive is closed at this many bytes: what a task holds at once, beside one record.
ARCHIVE_BYTES = 8 << 20
#: Bytes given to the decompressor at once, and blocks that a reader hands on at once.
PIECE, SEND_BYTES = 4096, 8 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four base32 digits."""
    return base32_of(F.sha1(data))


def base32_of(whole: Column) -> Column:
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def four(i: Column) -> Column:
        n = F.conv(F.substring(whole, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(digits, F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and what its record says.

    Null html is an empty payload. Of equal payloads the one with the largest
    page_id is the response and the others revisit it. Rows that repeat that
    page_id are responses too; null page_ids revisit like smaller ones, and
    are responses only where every page_id of the group is null. An empty table
    gives no records. A page's record is built and read whole. Columns but
    page_id, url and html, whatever their names, are not looked at.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("hex"))
    groups = rows.groupBy("hex", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = stored(groups.where("n > 1").select("hex", "payload_bytes", "first_id"), "payloads").hint("merge")
    out = rows.join(shared, ["hex", "payload_bytes"], "left").withColumn("payload_digest", base32_of(F.col("hex")))
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return out.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))


def record_text(r: DataFrame) -> DataFrame:
    """The records as strings, without the end mark that the sink writes."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    block_digest = F.when(revisit, base32_sha1(F.lit(""))).otherwise(F.col("payload_digest"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), block_digest),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return r.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives of ``ARCHIVE_BYTES`` about under ``path``; a gzip member a record, or with "none" plain records.

    The sink ends each archive with a separator: to gzip, a zero byte is padding; plain, it is the last end mark.
    """
    if compression not in ("gzip", "none"):
        raise ValueError(f"compression {compression}")
    gzipped = compression == "gzip"

    def archives(batches):
        held, size = [], 0
        for batch in batches:
            for text in batch["value"]:
                record = text.encode("utf-8") + END
                held.append(gzip.compress(record, 6, mtime=0) if gzipped else record)
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive(held)
                    held, size = [], 0
        if held:
            yield archive(held)

    def archive(records):
        whole = b"".join(records)
        return pd.DataFrame({"value": [whole if gzipped else whole[: -len(END)]]})

    packed = record_text(plan_records(pages)).mapInPandas(archives, "value binary").select(F.col("value").cast("string"))
    packed.write.option("lineSep", "\0" if gzipped else END.decode()).option("maxRecordsPerFile", 1).text(path)


def _header(data: bytes, at: int):
    """(fields, start of block) of a plausible record at ``at``, else None."""
    if not data.startswith(VERSION_START, at):
        return None
    # line by line: a false start ends at its first line that is none of a header
    fields, start, end = {}, at, data.find(b"\r\n", at)
    while end >= 0:
        start, end = end + 2, data.find(b"\r\n", end + 2)
        if end == start:
            break
        name, colon, value = data[start : max(end, start)].partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if end < 0:
        return None
    if not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 2


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(data: bytes, at: int):
    """(fields, block, end) of the valid record at ``at``, else the failed check's name."""
    found = _header(data, at)
    if not found:
        return "header"
    fields, start = found
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "length"
    block = data[start:end]
    digest = fields.get("warc-block-digest", "")
    if digest.lower().startswith("sha1:") and digest[5:].upper() != _sha1(block):
        return "digest"
    return fields, block, end + 4


def _member(data: bytes, at: int):
    """(content, end, whole) of the gzip member at ``at``; of a damaged one all that comes before the damage."""
    box, parts, end = zlib.decompressobj(31), [], at
    try:
        while end < len(data) and not box.eof:
            piece = data[end : end + PIECE]
            parts.append(box.decompress(piece))
            end += len(piece)
    except zlib.error:
        return b"".join(parts) + _until_damage(data, at, end), end, False
    end -= len(box.unused_data)
    if box.eof and end + 1 == len(data) and data[end] == 0:
        end += 1  # the sink's padding
    return b"".join(parts), end, box.eof


def _until_damage(data: bytes, at: int, end: int) -> bytes:
    """What the piece at ``end`` of the member at ``at`` decodes to before it fails."""
    box = zlib.decompressobj(31)
    for i in range(at, end, PIECE):
        box.decompress(data[i : i + PIECE])
    # a call that fails gives nothing: the byte it fails at is found, and drawn from byte by byte of output
    low, high = end, min(end + PIECE, len(data))
    while high - low > 1:
        middle = (low + high) // 2
        try:
            box.copy().decompress(data[end:middle])
            low = middle
        except zlib.error:
            high = middle
    parts = [box.decompress(data[end:low])]
    try:
        rest = data[low:high]
        while True:
            byte = box.decompress(rest, 1)
            if not byte:
                break
            parts.append(byte)
            rest = box.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(parts)


def salvage(data: bytes):
    """Yields ("record", start, end, fields, block, "") and ("gap", start, end, None, None, reason).

    Records and gaps together cover the whole archive, in order. Records that
    a damaged gzip member holds before its damage are given an empty range.
    """
    at, bad, reason = 0, None, ""
    marks = {VERSION_START: -1, GZIP_START: -1}

    def next_mark(after: int) -> int:
        """Each mark is searched for from where it was last found, so all searches together pass the archive once."""
        for mark, place in marks.items():
            if place < after:
                found = data.find(mark, after)
                marks[mark] = found if found >= 0 else len(data)
        return min(marks.values())

    while at < len(data):
        hit = None
        if data.startswith(GZIP_START, at):
            content, end, whole = _member(data, at)
            inner = list(salvage(content)) if content else []
            kept = [("record", at, end if whole else at, x[3], x[4], "") for x in inner if x[0] == "record"]
            # gaps within a member are given by their place in what it holds
            kept += [("gap", at, end, None, None, f"member {x[1]}-{x[2]} {x[5]}") for x in inner if x[0] == "gap" and whole]
            if whole and inner:
                hit = (end, kept)
            elif kept:
                # a damaged member: its records up to the damage are whole, the rest is a gap
                if bad is not None:
                    yield ("gap", bad, at, None, None, reason)
                    bad = None
                yield from kept
            failed = "gzip"
        else:
            found = _record(data, at)
            if isinstance(found, str):
                failed = found
            else:
                hit = (found[2], [("record", at, found[2], found[0], found[1], "")])
        if hit:
            if bad is not None:
                yield ("gap", bad, at, None, None, reason)
                bad = None
            yield from hit[1]
            at = hit[0]
            continue
        if bad is None:
            bad, reason = at, failed
        at = next_mark(at + 1)
    if bad is not None:
        yield ("gap", bad, len(data), None, None, reason)


READ_SCHEMA = (
    "path string, kind string, start long, end long, reason string, record_id string, record_type string, refers_to string,"
    " target_uri string, payload_digest string, payload_length long, block_bytes long, block_sha1 string, block binary"
)


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Rows of every record and every quarantined gap of the archives under ``path``.

    Without ``blocks`` a block's length and digest are given alone.
    """

    def parse(batches):
        for batch in batches:
            for where, data in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for kind, start, end, f, block, reason in salvage(bytes(data)):
                    f = f or {}
                    digest = f.get("warc-payload-digest", "").partition(":")[2] or None
                    length = f.get("x-payload-length", "")
                    about = (len(block), _sha1(block)) if block is not None else (None, None)
                    rows.append((
                        where, kind, start, end, reason, f.get("warc-record-id"), f.get("warc-type"), f.get("warc-refers-to"), f.get("warc-target-uri"),
                        digest, int(length) if length.isdigit() else None, *about, block if blocks else None,
                    ))
                    held += len(block or b"") if blocks else 0
                    if len(rows) >= 2000 or held >= SEND_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    def frame(rows):
        f = pd.DataFrame(rows, columns=[x.split()[0] for x in READ_SCHEMA.split(",")])
        return f.astype({"payload_length": "Int64", "block_bytes": "Int64"})

    # a batch holds archives up to the bytes that Arrow batches are bounded by, one at least
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, READ_SCHEMA)


def read_pages(spark: SparkSession, path: str, gaps_path: str | None = None) -> DataFrame:
    """What the archives say of each page; a response is measured from its block.

    A page whose record is damaged has no row; the byte ranges that were
    quarantined are written to ``gaps_path`` (path, start, end, reason).
    """
    found = stored(read_archives(spark, path, blocks=False).drop("block"), "records")
    if gaps_path:
        found.where("kind = 'gap'").select("path", "start", "end", "reason").write.parquet(gaps_path)
    r = found.where("kind = 'record'")
    response = F.col("record_type") == "response"

    def page(name: str) -> Column:
        return F.regexp_extract(F.coalesce(name, F.lit("")), r"<urn:page:(-?\d+)>", 1)

    def number(name: str) -> Column:
        return F.when(page(name) != "", page(name).cast("long"))

    return r.select(
        number("record_id").alias("page_id"),
        F.when(response, F.col("block_bytes")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.col("block_sha1")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    delete_at_end(spark, path)
    pages = read_pages(spark, path, f"{path}-gaps")
    delete_at_end(spark, f"{path}-gaps")
    delete(spark, path)
    return pages


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, hex, max(page_id) OVER (PARTITION BY html) AS first_id,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 5 * i + 1, 5) AS INTEGER) >> s) & 31 AS INTEGER), 1) for s in [15, 10, 5, 0]], '') for i in range(8)], '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN first_id END AS refers_to
FROM q
"""
