"""WARC archives written from page tables, and a reader that salvages damaged ones.

An archive is a sequence of gzip members, or of plain records. Spark's text sink writes the bytes
of a column and a separator after each row: between plain records that is the blank line pair that
ends a record, between members a member without content, which decompressors pass over.

The reader checks each member and record. Where a check fails, it searches the bytes behind for the
next member or version line that holds, goes on there, and reports the gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsframe.operators.ordering import PIECES_PER_TASK, salted_join

# Fixed values of the formats.
VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/1\.\d+\r?\n")
_MEMBER = b"\x1f\x8b\x08"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

#: Bytes that an archive may hold if its records are of average size, bytes of rows that a task
#: sends at once, and the bytes that a record's headers may have.
ARCHIVE_BYTES = 1 << 26
_SEND_BYTES = 1 << 23
_HEADER_BYTES = 1 << 16
_FEED = 1 << 16

RECORD_DDL = (
    "file string, begin long, end long, problem string, record_id string, record_type string, "
    "headers map<string,string>, payload_bytes long, payload binary"
)


def write_warc(
    pages: DataFrame,
    path: str,
    least_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    compress: bool = True,
) -> None:
    """One record per row below the new folder ``path``, the text in UTF-8 as its payload.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id is
    a ``response``, the others are ``revisit`` records that refer to it; smaller payloads are
    all responses. Null ids come before all others; of equal ids any one is the response. A null
    text is an empty payload. A record's id is ``<urn:x-page:ID:NAME>``, where the name is the
    payload's hash or a number, and tells rows with equal ids apart; a null id is ``-``. A null
    url gives no ``WARC-Target-URI``; line breaks in one are percent-encoded. No rows give a
    folder without records. Other columns are ignored. An archive holds ``ARCHIVE_BYTES`` at
    most if its records are of average size.
    """
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("-")).alias("page"),
        F.col(id_col).alias("rank"),
        F.col(url_col).cast("string").alias("url"),
        F.monotonically_increasing_id().alias("number"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("payload")).alias("size")).first()
    hot = _hot_payloads(rows, total["n"], least_bytes)
    built_ddl = (
        f"page string, rank {pages.schema[id_col].dataType.simpleString()}, url string, number long, "
        "size long, hash string, sha1 binary, record binary"
    )
    # Packed before it moves, and moved once, to where the copies of its payload are.
    built = rows.mapInArrow(_responses(date, compress, least_bytes), built_ddl)
    of_page, salts = F.lit(None).cast("string"), F.lit(1)
    if hot:
        table = F.create_map(*[F.lit(x) for hash_, (page, _) in hot.items() for x in (hash_, page)])
        of_page = F.try_element_at(table, F.col("hash"))
        table = F.create_map(*[F.lit(x) for hash_, (_, n) in hot.items() for x in (hash_, n)])
        salts = F.coalesce(F.try_element_at(table, F.col("hash")), F.lit(1))
    # A hot payload's rows are dealt over salts; those that may be its response stay together.
    spread = F.when(of_page == F.col("page"), 0).otherwise(F.pmod(F.xxhash64("number"), salts))
    records = (
        built.withColumn("of_page", of_page)
        .withColumn("salt", spread.cast("int"))
        .repartition("hash", "salt")
        .sortWithinPartitions("hash", "salt", F.desc_nulls_last("rank"))
        .drop("rank")
        .mapInArrow(_final(date, compress, least_bytes), "record binary")
    )
    between = zlib_member(b"") if compress else _END
    records.select(F.col("record").cast("string").alias("value")).write.option(
        "encoding", "ISO-8859-1"
    ).option("lineSep", between.decode("latin-1")).option(
        "maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (total["size"] or 1)))
    ).text(path)


def _hot_payloads(rows: DataFrame, n: int, least_bytes: int) -> dict[str, tuple[str, int]]:
    """By hash of each payload with more than one part in ``pieces`` of all rows: the page that is
    its response, and its parts. Fewer than ``pieces`` can be."""
    pieces = PIECES_PER_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = rows.where(F.length("payload") >= least_bytes).groupBy(F.sha2("payload", 256).alias("hash"))
    largest = groups.agg(
        F.max(F.struct("rank", "page")).alias("last"), F.count(F.lit(1)).alias("copies")
    ).where(F.col("copies") * pieces > 2 * n)
    return {
        row["hash"]: (row["last"]["page"], row["copies"] * pieces // n) for row in largest.collect()
    }


def zlib_member(data: bytes) -> bytes:
    """A gzip member without a name or time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page: str, number: object) -> str:
    return f"<urn:x-page:{quote(page, safe='-')}:{number}>"


def _record(row: dict, date: str) -> bytes:
    """One record up to the end of its block; a revisit if it names a page that it is ``of``."""
    revisit = row.get("of") is not None
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % row["size"]
    ) + (b"" if revisit else row["payload"])
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(row["page"], row["name"])),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{_base32(row['sha1'])}"),
        ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if row["url"] is not None:
        url = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", row["url"])
        headers.append(("WARC-Target-URI", url))
    if revisit:
        headers.append(("WARC-Refers-To", _record_id(row["of"], row["hash"])))
        headers.append(("WARC-Profile", _REVISIT))
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _packed(record: bytes, compress: bool) -> bytes:
    return zlib_member(record + _END) if compress else record


def _responses(date: str, compress: bool, least_bytes: int):
    """Every row as a response, with the hashes of its payload. What may be referred to is named by
    its hash, which no other response of its id then has; the rest by number."""

    def run(batches):
        for batch in batches:
            kept = batch.select(["page", "rank", "url", "number"])
            new, held, begin = [], 0, 0
            for i, row in enumerate(_rows(batch.drop_columns(["rank"])), 1):
                row["size"] = len(row["payload"])
                row["sha1"] = hashlib.sha1(row["payload"]).digest()
                row["hash"] = hashlib.sha256(row["payload"]).hexdigest()
                row["name"] = row["hash"] if row["size"] >= least_bytes else row["number"]
                new.append((row["size"], row["hash"], row["sha1"], _packed(_record(row, date), compress)))
                held += len(new[-1][-1])
                if held > _SEND_BYTES or i == batch.num_rows:
                    kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*new), kinds)]
                    yield pa.RecordBatch.from_arrays(
                        [*kept.slice(begin, i - begin).columns, *columns],
                        names=[*kept.schema.names, "size", "hash", "sha1", "record"],
                    )
                    new, held, begin = [], 0, i

    return run


def _final(date: str, compress: bool, least_bytes: int):
    """The records to write. The first row of a payload is its response, in the part of a hot one
    that may hold it; all others become revisits."""

    def run(batches):
        last, first = None, None
        for batch in batches:
            out = []
            for row in _rows(batch):
                if row["size"] < least_bytes:
                    out.append(row["record"])
                    continue
                if row["hash"] != last and row["salt"] == 0:
                    last, first = row["hash"], row["page"]
                    out.append(row["record"])
                    continue
                row["of"] = row["of_page"] if row["salt"] else first
                row["name"] = row["number"]
                out.append(_packed(_record(row, date), compress))
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    return run


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of all archives below ``path``, compressed or plain or both.

    A row with ``problem`` is a gap: the bytes from ``begin`` to ``end`` of ``file`` that no sound
    record explains, and the first check that failed there. All other rows are records: ``headers``
    as they stand, ``payload`` the block, or what follows the HTTP headers where there are any, and
    ``payload_bytes`` its size, for a revisit the size that its HTTP headers state. A record is
    sound if its member unpacks with the right checksum, its version line and headers hold, among
    them id, type and length, blank lines end it, and digests that it states in MD5, SHA-1 or SHA-256 agree. Empty files and
    members have no records. An archive is read in one task, which holds it whole.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, RECORD_DDL)


def sound_records(found: DataFrame) -> DataFrame:
    return found.where("problem IS NULL").drop("problem")


def quarantined(found: DataFrame) -> DataFrame:
    """``file, begin, end, problem`` of the gaps."""
    return found.where("problem IS NOT NULL").select("file", "begin", "end", "problem")


def with_payloads(records: DataFrame) -> DataFrame:
    """Records with the payloads of those that revisits refer to; null where that record is lost.

    Many revisits may refer to one record: their rows are cut into pieces.
    """
    full = records.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to"), F.col("payload").alias("_payload")
    )
    refers = F.when(F.col("record_type") == "revisit", F.col("headers")["warc-refers-to"])
    joined = salted_join(
        records.withColumn("refers_to", refers), full, ["refers_to"], "record_id", how="left"
    )
    payload = F.when(F.col("record_type") == "revisit", F.col("_payload"))
    return joined.withColumn("payload", payload.otherwise(F.col("payload"))).drop("_payload")


def page_of(record_id: Column) -> Column:
    """The page's id, as text, in a record id that ``write_warc`` gave; null for a null id."""
    return F.nullif(F.url_decode(F.split(record_id, ":")[2]), F.lit("-"))


class _Damage(Exception):
    """A failed check, and where reading may go on if the bytes up to there are explained."""

    def __init__(self, problem: str, resume: int | None = None) -> None:
        super().__init__(problem)
        self.problem, self.resume = problem, resume


def _unpacked(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place, and where the member ends."""
    unpacker = zlib.decompressobj(31)
    parts, place = [], at
    try:
        while not unpacker.eof:
            if place >= len(data):
                raise _Damage("the archive ends inside a member")
            parts.append(unpacker.decompress(data[place : place + _FEED]))
            place += _FEED
    except zlib.error as error:
        raise _Damage(f"member does not unpack: {error}") from error
    return b"".join(parts), min(place, len(data)) - len(unpacker.unused_data)


def _digest_holds(stated: str | None, content) -> bool:
    """Whether a digest such as ``sha1:BASE32`` or ``sha256:HEX`` agrees; unknown kinds do."""
    kind, _, text = (stated or "").strip().partition(":")
    if kind.lower() not in ("md5", "sha1", "sha256"):
        return True
    found = hashlib.new(kind.lower(), content).digest()
    text = text.strip()
    return text.lower() == found.hex() or text.upper().rstrip("=") == _base32(found).rstrip("=")


def _headers(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a space continues the one before."""
    fields, last = {}, None
    for line in lines.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif line:
            name, colon, value = line.partition(":")
            if not colon or not name.strip():
                raise _Damage("a header line without a name")
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def _blank_line(data, begin: int, end: int) -> tuple[int, int]:
    """Where the headers end and where what follows them begins."""
    found = re.compile(rb"\r?\n\r?\n").search(data, begin, end)
    return (found.start(), found.end()) if found else (-1, -1)


def _parsed(data, at: int) -> tuple[dict, int]:
    """The record at a place, and where it ends."""
    version = _VERSION_LINE.match(data, at)
    if not version:
        raise _Damage("no version line")
    stop, begin = _blank_line(data, version.end() - 1, min(len(data), at + _HEADER_BYTES))
    if stop < 0:
        raise _Damage("headers without an end")
    fields = _headers(bytes(data[version.end() : max(stop, version.end())]))
    length = fields.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length, re.ASCII):
        raise _Damage("no length")
    end = begin + int(length)
    if bytes(data[end : end + 4]) != _END:
        raise _Damage("no blank lines behind the block")
    for name in ("warc-type", "warc-record-id"):
        if name not in fields:
            raise _Damage(f"no {name}", end + 4)
    block = data[begin:end]
    if not _digest_holds(fields.get("warc-block-digest"), block):
        raise _Damage("block digest does not agree", end + 4)
    kind = fields["warc-type"].lower()
    payload, size = block, len(block)
    if fields.get("content-type", "").lower().startswith("application/http"):
        stop, body = _blank_line(block, 0, len(block))
        if stop >= 0:
            payload = block[body:]
            size = len(payload)
            if kind == "revisit":
                stated = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", block[:stop])
                size = int(stated[1]) if stated else None
    if kind != "revisit" and not _digest_holds(fields.get("warc-payload-digest"), payload):
        raise _Damage("payload digest does not agree", end + 4)
    record = {
        "record_id": fields["warc-record-id"],
        "record_type": kind,
        "headers": fields,
        "payload_bytes": size,
        "payload": bytes(payload),
    }
    return record, end + 4


def _at(data: memoryview, at: int) -> tuple[list[dict], int]:
    """The records of the member or the plain record at a place, and where it ends."""
    if data[at : at + 3] != _MEMBER:
        record, end = _parsed(data, at)
        return [record], end
    content, end = _unpacked(data, at)
    records, place = [], 0
    while place < len(content):
        try:
            record, place = _parsed(memoryview(content), place)
        except _Damage as damage:
            # The member is whole, so what is wrong lies within it.
            raise _Damage(damage.problem, end) from damage
        records.append(record)
    return records, end


_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d+\r?\n")


def salvaged(content: bytes) -> Iterator[dict]:
    """Records of an archive in order, and a row for each gap: begin, end and what failed first."""
    data, at = memoryview(content), 0
    gap, problem = None, None
    while at < len(data):
        try:
            records, end = _at(data, at)
        except _Damage as damage:
            if gap is None:
                gap, problem = at, damage.problem
            if damage.resume is not None:
                yield {"begin": gap, "end": damage.resume, "problem": problem}
                at, gap = damage.resume, None
                continue
            found = _CANDIDATE.search(content, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap is not None:
            yield {"begin": gap, "end": at, "problem": problem}
            gap = None
        for record in records:
            yield {"begin": at, "end": end, **record}
        at = end
    if gap is not None:
        yield {"begin": gap, "end": len(data), "problem": problem}


_SHAPE = pa.schema(
    [
        ("file", pa.string()),
        ("begin", pa.int64()),
        ("end", pa.int64()),
        ("problem", pa.string()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _table(rows: list[dict]) -> pa.RecordBatch:
    columns = []
    for field in _SHAPE:
        values = [row.get(field.name) for row in rows]
        if field.name == "headers":
            values = [None if v is None else list(v.items()) for v in values]
        columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=_SHAPE)


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            name = batch.column("path")[i].as_py()
            content = batch.column("content")[i].as_py() or b""
            rows, held = [], 0
            for row in salvaged(content):
                rows.append({"file": name, **row})
                held += len(row.get("payload") or b"") + 1024
                if held > _SEND_BYTES:
                    yield _table(rows)
                    rows, held = [], 0
            if rows:
                yield _table(rows)
