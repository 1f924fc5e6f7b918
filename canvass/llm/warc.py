"""WARC archives as a Spark data source, written and read (operator 5).

One gzip member holds one record, and the member's header carries its length (the extra field
``sl``, compressed and plain length).  A reader inflates the record's headers first; where a
predicate refuses them it goes on at the next member, and the payload is never decoded.  Predicates belong
to a load, as its options: Spark keeps one reader for all uses of a loaded frame, so what it would
push for one use would lose rows of another.
Members without that field are inflated and thrown away.  Each file is a partition; writers
close a file at ``FILE_BYTES``.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage,
)

from canvass.llm.shared import prepare
from canvass.session import work_dir

SCHEMA = ("warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "payload_length long, payload binary")
# Named fields of the columns; the last one is our extension.
FIELDS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
FILE_BYTES, HEAD_BYTES = 64 << 20, 4096
# gzip's magic number with deflate, its extra-field flag, and the RFC 4648 alphabet.
MAGIC, EXTRA = b"\x1f\x8b\x08", 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def located(path: str):
    return fs.FileSystem.from_uri(path)


def member(record: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(record) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = MAGIC + bytes([EXTRA]) + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, total, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def one_line(value) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record_of(row, date: str) -> bytes:
    payload = row["payload"]
    block = b"" if payload is None else HTTP % len(payload) + bytes(payload)
    lines = ["WARC/1.1", f"WARC-Date: {date}"]
    lines += [f"{field}: {one_line(row[name])}" for name, field in FIELDS.items() if row[name] is not None]
    if row["warc_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT}")
    if block:
        lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    """Tasks write to a pending folder of this write; the files of successful attempts are moved at the end."""

    def __init__(self, path: str, level: int) -> None:
        self.path, self.level = path, level
        self.pending = f"_pending/{uuid.uuid4().hex}"
        self.date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        system, path = located(self.path)
        system.create_dir(f"{path}/{self.pending}", recursive=True)

    def write(self, iterator) -> Written:
        system, path = located(self.path)
        files, out, size = [], None, 0
        for row in iterator:
            if out is None:
                files.append(f"{uuid.uuid4().hex}.warc.gz")
                out, size = system.open_output_stream(f"{path}/{self.pending}/{files[-1]}", compression=None), 0
            size += out.write(member(record_of(row, self.date), self.level))
            if size >= FILE_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        system, path = located(self.path)
        for name in (f for m in messages if m for f in m.files):
            system.move(f"{path}/{self.pending}/{name}", f"{path}/{name}")
        self.clean()

    def abort(self, messages) -> None:
        """Pending files are no part of the archive."""
        self.clean()

    def clean(self) -> None:
        """What is left are files of attempts that failed."""
        system, path = located(self.path)
        system.delete_dir(f"{path}/{self.pending}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, tests: list[tuple[str, str, object]]) -> None:
        self.path, self.tests = path, tests

    def wanted(self, head: dict) -> bool:
        for name, kind, value in self.tests:
            given = head.get(FIELDS[name].lower())
            if given is None or kind == "equal" and given not in value or kind == "starts" and not given.startswith(value):
                return False
        return True

    def partitions(self):
        system, path = located(self.path)
        names = [i.path for i in system.get_file_info(fs.FileSelector(path))
                 if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        return [InputPartition(n) for n in sorted(names)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.value) as source:
            end = source.size()
            at = 0
            while at < end:
                at, head, block = (packed_record if partition.value.endswith(".gz") else plain_record)(source, at, self.wanted)
                if block is not None:
                    yield row_of(head, block)


def headers_of(data: bytes) -> tuple[dict, int] | None:
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        return None
    lines = data[:stop].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, stop + 4


def plain_record(source, at: int, wanted):
    size = HEAD_BYTES
    while (found := headers_of(data := source.read_at(size, at))) is None:
        if len(data) < size:
            return source.size(), {}, None
        size *= 2
    head, start = found
    length = int(head.get("content-length", 0))
    block = source.read_at(length, at + start) if wanted(head) else None
    return at + start + length + 4, head, block


def packed_record(source, at: int, wanted):
    data = source.read_at(HEAD_BYTES, at)
    total = None
    if data[:3] == MAGIC and len(data) > 24 and data[3] == EXTRA and data[12:14] == b"sl":
        total = struct.unpack("<I", data[16:20])[0]
    inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
    plain, position, found = b"", at, None
    while found is None and not inflate.eof and data:
        plain += inflate.decompress(data)
        position += len(data)
        found = headers_of(plain)
        data = b"" if found else source.read_at(HEAD_BYTES, position)
    if found is None:
        return source.size(), {}, None
    head, start = found
    keep = wanted(head)
    if not keep and total:
        return at + total, head, None
    parts, step = [plain[start:]], 1 << 20
    while not inflate.eof:
        data = source.read_at(min(step, total - (position - at)) if total else step, position)
        if not data:
            break
        position += len(data)
        piece = inflate.decompress(data)
        if keep:
            parts.append(piece)
    follow = position - len(inflate.unused_data)
    return follow, head, b"".join(parts)[:int(head.get("content-length", 0))] if keep else None


def row_of(head: dict, block: bytes) -> tuple:
    payload = None
    if head.get("warc-type") == "response":
        payload = block[block.find(b"\r\n\r\n") + 4:]
    length = head.get("x-payload-length")
    return (*(head.get(f.lower()) for f in list(FIELDS.values())[:-1]), None if length is None else int(length), payload)


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; options ``level`` of gzip, and ``tests`` of the headers."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], json.loads(self.options.get("tests", "[]")))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"], int(self.options.get("level", 1)))


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.dataSource.register(WarcSource)


def base32_sha1(payload: Column) -> Column:
    """The upper-case base32 of the SHA-1: four letters for each five hex digits."""
    digits = F.sha1(payload)
    letters = []
    for i in range(8):
        value = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(ALPHABET), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records_of(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive records of pages: repeated payloads become revisits of the smallest page_id.

    Payloads shorter than ``least`` bytes are never revisits.  A NULL html is an empty payload.
    A NULL page_id counts as the largest; rows that share the smallest page_id of their payload
    are all responses.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("content", F.sha2("payload", 256))
    firsts = pages.groupBy("content").agg(F.min("page_id").alias("first_id")).withColumnRenamed("content", "same")
    joined = pages.join(firsts, F.col("content") == F.col("same"))
    again = (~F.col("page_id").eqNullSafe(F.col("first_id"))) & (F.octet_length("payload") >= least)

    def name(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), name("page_id").alias("record_id"),
        F.col("url").alias("target_uri"), F.when(again, name("first_id")).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record per page to ``path``; see ``records_of``."""
    register(pages.sparkSession)
    records_of(pages, least).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, equal: dict[str, str | list[str]] | None = None,
                  starts: dict[str, str] | None = None) -> DataFrame:
    """The records of all archives in a folder, or those whose headers have certain values or beginnings.

    Both name columns that are headers; a list gives several values.  Payloads of other records are
    not decoded, and a record without such a header is none of them.
    """
    register(spark)
    tests = [(c, "equal", [v] if isinstance(v, str) else list(v)) for c, v in (equal or {}).items()]
    tests += [(c, "starts", v) for c, v in (starts or {}).items()]
    if unknown := {c for c, _, _ in tests} - (FIELDS.keys() - {"payload_length"}):
        raise ValueError(f"no headers: {sorted(unknown)}")
    return spark.read.format("warc").option("tests", json.dumps(tests)).load(path)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back.

    Responses are decoded, and their length and digest come from the payload itself; of
    revisits only the headers are read.
    """
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_archives(pages, path, least)
    page = F.regexp_extract(F.col("record_id"), "^<urn:page:(-?[0-9]*)>$", 1)
    other = F.regexp_extract(F.col("refers_to"), "^<urn:page:(-?[0-9]*)>$", 1)
    responses = read_archives(spark, path, {"warc_type": "response"}).select(
        page.try_cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), F.col("target_uri").alias("url"))
    revisits = read_archives(spark, path, {"warc_type": "revisit"}).select(
        page.try_cast("long").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"), F.lit("revisit").alias("record_type"),
        other.try_cast("long").alias("refers_to"), F.col("target_uri").alias("url"))
    return responses.unionByName(revisits)
