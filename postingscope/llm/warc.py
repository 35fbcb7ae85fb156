"""WARC (operator 12): a Python data source that writes and reads web archives, and a writer of deduplicated captures.

`spark.read.format("warc")` plans partitions from file sizes (many small archives together), parses the header of a
record first and, from it alone, decides whether the record is wanted: filters on record_type, target_uri, record_id,
date, content_type, payload_digest, refers_to and payload_bytes are pushed down.  Payloads are decoded only where the
schema asks for `payload` and the record passed; all others are skipped: plain records by Content-Length, compressed
ones by the length in their gzip header's extra field (`sl`, as the WARC standard's annex on compression has it), or, in archives
without it, by inflating to the member's end.

`df.write.format("warc")` writes one archive per task, or several of about `rollBytes`, one gzip member per record.  A write
is valid once its manifest is there: readers of a folder take the archives that manifests list (all of them in a folder without
any), so files of failed or repeated tasks never count.

`write_captures` makes of rows with equal payloads one response and revisits.  Payloads are compared by SHA-256; of equal
ones the row with the largest id is the response (ties: the largest SHA-256 of the url; equal rows: any one of them).  Only payloads that
may have an equal go through a shuffle.

Defined cases: a null payload is empty; a null id has no field and sorts below all others; control characters and
spaces in urls are percent-encoded in headers; an empty table gives archives with a warcinfo record only, or none.
Damaged archives raise ValueError with file and offset.  Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not,
                                    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from postingscope.llm.common import bounded_filter, cut, may_contain, small_batches

READ_SCHEMA = ("record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, "
               "payload_bytes bigint, refers_to string, fields map<string,string>, payload binary")
ROLL_BYTES = 64 << 20           # an archive is closed beyond this size
PARTITION_BYTES = 64 << 20      # archives that one task reads, by their sizes
READ_BYTES = 1 << 18            # one read from the file system
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
HEADER_BYTES = 1 << 20          # a header this long is damage
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
         "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# ---- one record ----

def clean_value(value: str) -> str:
    """A header value without control characters and spaces."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def header(kind: str, record_id: str, date: str, fields: dict[str, str | None], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("\r\n".join([*lines, f"Content-Length: {length}"]) + "\r\n\r\n").encode()


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def gzip_member(data: bytes, level: int) -> bytes:
    """One gzip member whose extra field `sl` tells its own compressed and uncompressed length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def parse_header(head: bytes) -> dict[str, str]:
    """Named fields of a WARC header by lower-case name, continuation lines unfolded."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def payload_length(fields: dict[str, str], block_start: bytes, length: int) -> tuple[int, int]:
    """(where the payload starts in the block, its full length).  An HTTP message's payload follows its head."""
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        end = block_start.find(b"\r\n\r\n")
        if end >= 0:
            told = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", block_start[:end])
            if fields.get("warc-type") == "revisit" and told:
                return end + 4, int(told.group(1))
            return end + 4, length - end - 4
    return 0, length


# ---- filters ----

COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
           LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b,
           StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a}


def supported(f: Filter) -> bool:
    if isinstance(f, Not):
        return supported(f.child)
    known = (*COMPARE, IsNull, IsNotNull, EqualNullSafe)
    return isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in (*NAMES, "payload_bytes")


def column(f: Filter) -> str:
    return column(f.child) if isinstance(f, Not) else f.attribute[0]


def holds(f: Filter, row: dict) -> bool | None:
    """SQL truth of a filter: None is unknown."""
    if isinstance(f, Not):
        inner = holds(f.child, row)
        return None if inner is None else not inner
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    return None if value is None else COMPARE[type(f)](value, f.value)


# ---- reading ----

class _File:
    """Forward reads of a file through one buffer; what is skipped beyond it is not read."""

    def __init__(self, stream, name: str):
        self.stream, self.name, self.at, self.buffer, self.begins = stream, name, 0, b"", 0

    def peek(self, size: int) -> bytes:
        """Up to `size` bytes from the current position (fewer at the end of the file)."""
        have = self.begins + len(self.buffer) - self.at
        if have < size:
            keep = self.buffer[self.at - self.begins:] if have > 0 else b""
            self.stream.seek(self.at + len(keep))
            self.buffer, self.begins = keep + self.stream.read(max(READ_BYTES, size - len(keep))), self.at
        lo = self.at - self.begins
        return self.buffer[lo:lo + size]

    def length(self, fields: dict[str, str]) -> int:
        told = fields.get("content-length", "")
        if not told.isdigit():
            raise self.bad("record without a Content-Length")
        return int(told)

    def bad(self, what: str) -> ValueError:
        return ValueError(f"{self.name}, offset {self.at}: {what}")


def _until_header(more, f: _File) -> tuple[bytes, bytes]:
    """(header, what follows it so far) from a function that gives the next bytes."""
    got = b""
    while (end := got.find(b"\r\n\r\n")) < 0:
        new = more()
        if not new or len(got) > HEADER_BYTES:
            raise f.bad("no end of a record header")
        got += new
    return got[:end], got[end + 4:]


def _plain_record(f: _File):
    """(fields, first block bytes, block reader, end) of the uncompressed record at the current position."""
    size = 4096
    while (end := (got := f.peek(size)).find(b"\r\n\r\n")) < 0:
        if len(got) < size or size > HEADER_BYTES:
            raise f.bad("no end of a record header")
        size *= 4
    fields = parse_header(got[:end])
    length, start = f.length(fields), f.at + end + 4
    after = start + length

    def block() -> bytes:
        f.at = start
        data = f.peek(length)
        if len(data) < length:
            raise f.bad("record ends too early")
        return data

    def begins() -> bytes:
        at, f.at = f.at, start
        data = f.peek(min(length, 4096))
        f.at = at
        return data

    def skip() -> None:
        f.at = after
        while f.peek(1) in (b"\r", b"\n"):
            f.at += 1

    return fields, length, begins, block, skip


def _gzip_record(f: _File):
    """The same for a gzip member: inflated only as far as asked."""
    start, head = f.at, f.peek(4096)
    z = zlib.decompressobj(31)
    fed = 0

    def more(limit: int = 4096) -> bytes:
        nonlocal fed
        while not z.eof:
            data = z.unconsumed_tail
            if not data:
                f.at = start + fed
                data = f.peek(4096 if limit <= 4096 else READ_BYTES)
                fed += len(data)
                if not data:
                    raise f.bad("compressed record ends too early")
            out = z.decompress(data, limit)
            if out:
                return out
        return b""

    head_bytes, rest = _until_header(more, f)
    fields = parse_header(head_bytes)
    length, body = f.length(fields), [rest]

    def begins() -> bytes:
        while sum(map(len, body)) < min(length, 512) and not z.eof:
            body.append(more())
        return b"".join(body)

    def block() -> bytes:
        while not z.eof:
            body.append(more(READ_BYTES))
        data = b"".join(body)
        if len(data) < length:
            raise f.bad("record ends too early")
        return data[:length]

    def skip() -> None:
        if z.eof:
            f.at = start + fed - len(z.unused_data)
            return
        told = 0
        if len(head) >= 24 and head[3] & 4:
            extra = head[12:12 + struct.unpack("<H", head[10:12])[0]]
            while len(extra) >= 4:
                size = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and size == 8:
                    told = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + size:]
        if told:
            f.at = start + told
            return
        while not z.eof:
            more(READ_BYTES)
        f.at = start + fed - len(z.unused_data)

    return fields, length, begins, block, skip


def records(stream, name: str, filters: list[Filter], columns: list[str]) -> Iterator[dict]:
    """The wanted columns of the records of one archive that pass the filters."""
    f = _File(stream, name)
    needs_length = "payload_bytes" in columns or any(column(x) == "payload_bytes" for x in filters)
    while start := f.peek(2):
        at = f.at
        read = _gzip_record if start == b"\x1f\x8b" else _plain_record
        try:
            fields, length, begins, block, skip = read(f)
        except zlib.error as e:
            f.at = at
            raise f.bad(f"damaged record ({e})") from e
        row = {c: fields.get(n) for c, n in NAMES.items()}
        row["record_id"] = (row["record_id"] or "").strip("<>") or None
        row["refers_to"] = (row["refers_to"] or "").strip("<>") or None
        if needs_length:
            row["payload_bytes"] = payload_length(fields, begins(), length)[1]
        if all(holds(x, row) for x in filters):
            if "payload" in columns:
                data = block()
                row["payload"] = data[payload_length(fields, data[:HEADER_BYTES], length)[0]:]
            if "fields" in columns:
                row["fields"] = list(fields.items())
            yield row
        skip()
        if f.at <= at:
            raise f.bad("record without an end")


@dataclass
class ArchivePartition(InputPartition):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.schema = schema
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if supported(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        fs, path = file_system(self.path)
        sizes = archive_files(fs, path)
        out, held = [], 0
        for name in sorted(sizes):
            if not out or held + sizes[name] > self.partition_bytes:
                out.append(ArchivePartition([]))
                held = 0
            out[-1].files.append(name)
            held += sizes[name]
        return out or [ArchivePartition([])]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema
        fs, _ = file_system(self.path)
        schema, columns = to_arrow_schema(self.schema), self.schema.fieldNames()
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], schema.field(c).type) for c in columns], schema=schema)

        for name in partition.files:
            with fs.open_input_file(name) as stream:
                for row in records(stream, name, self.filters, columns):
                    held.append(row)
                    size += len(row.get("payload") or b"") + 200
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


def archive_files(fs: pafs.FileSystem, path: str) -> dict[str, int]:
    """Archives of a folder and their sizes: those in its manifests, or all *.warc and *.warc.gz without any; or the one file."""
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return {path: info.size}
    found = [x for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if x.type == pafs.FileType.File]
    manifests = [x for x in found if x.base_name.startswith("manifest-") and x.base_name.endswith(".json")]
    if not manifests:
        return {x.path: x.size for x in found if x.base_name.endswith((".warc", ".warc.gz"))}
    out: dict[str, int] = {}
    for m in manifests:
        with fs.open_input_stream(m.path) as s:
            out.update({f"{path.rstrip('/')}/{name}": size for name, size in json.loads(s.read())["files"]})
    return out


# ---- writing ----

@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_type, target_uri, payload, payload_bytes, payload_sha1 (hex), record_key, refers_key, fields.

    record_key (32 hex digits) names the record; a null key gets a random one.  A revisit has the head of its message only, refers_key is the
    record_key of its response.  `fields` are further named fields; null values are left out.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll_bytes = int(options.get("rollbytes", ROLL_BYTES))
        self.level = int(options.get("level", 1))
        self.compress = options.get("compression", "gzip") != "none"
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator):
        fs, path = file_system(self.path)
        done: list[tuple[str, int]] = []
        name = stream = None
        size = 0

        def put(data: bytes) -> int:
            data = gzip_member(data + b"\r\n\r\n", self.level) if self.compress else data + b"\r\n\r\n"
            stream.write(data)
            return len(data)

        try:
            for b in iterator:
                cols = {f: b.column(i) for i, f in enumerate(b.schema.names)}
                for i in range(b.num_rows):
                    if stream is None:
                        fs.create_dir(path, recursive=True)
                        name, size = f"{uuid.uuid4().hex}.warc{'.gz' if self.compress else ''}", 0
                        stream = fs.open_output_stream(f"{path.rstrip('/')}/{name}", compression=None)
                        info = b"format: WARC File Format 1.1\r\n"
                        size += put(header("warcinfo", str(uuid.uuid4()), self.date, {"WARC-Filename": name, "Content-Type": "application/warc-fields"}, len(info)) + info)
                    size += put(self.record({c: v[i].as_py() for c, v in cols.items()}))
                    if size >= self.roll_bytes:
                        stream.close()
                        done.append((name, size))
                        stream = None
        finally:
            if stream is not None:
                stream.close()
                done.append((name, size))
        return Written(done)

    def record(self, row: dict) -> bytes:
        payload = row["payload"] or b""
        revisit = row["record_type"] == "revisit"
        block = http_head(row["payload_bytes"]) + (b"" if revisit else payload)
        key = row["record_key"]
        fields = {"WARC-Target-URI": None if row["target_uri"] is None else clean_value(row["target_uri"]),
                  "Content-Type": "application/http; msgtype=response",
                  "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode(),
                  "WARC-Profile": REVISIT_PROFILE if revisit else None,
                  "WARC-Refers-To": f"<urn:uuid:{uuid.UUID(hex=row['refers_key'])}>" if revisit else None}
        fields |= {k: None if v is None else clean_value(v) for k, v in dict(row["fields"] or {}).items()}
        return header(row["record_type"], str(uuid.UUID(hex=key) if key else uuid.uuid4()), self.date, fields, len(block)) + block

    def commit(self, messages):
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path.rstrip('/')}/manifest-{uuid.uuid4().hex}.json") as s:
            s.write(json.dumps({"files": [f for m in messages if m for f in m.files]}).encode())

    def abort(self, messages):
        fs, path = file_system(self.path)
        for name, _ in [f for m in messages if m for f in m.files]:
            fs.delete_file(f"{path.rstrip('/')}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are only appended: use mode('append') and a folder of its own")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make format("warc") known and let Spark push filters into Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---- deduplicated captures ----

HOT_PAYLOADS = 1000             # payloads resolved by broadcast: those with more than one duplicate row in so many


def write_captures(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
                   options: dict[str, str] | None = None) -> None:
    """One record per row.  Of rows with equal payloads of at least `least_bytes`, one is the response, the others revisit it.

    Named fields X-Row-Id and, in revisits, X-Refers-To-Row-Id carry the ids.
    """
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    base = (pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("uri"), data.alias("payload"))
            .withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("d", F.sha2("payload", 256)).withColumn("u", F.sha2(F.col("uri").cast("binary"), 256)))
    # rows that share a payload: how many, and which is the response (id, url hash, rows equal in both)
    rows = base.where(F.col("payload_bytes") >= least_bytes).groupBy("d", "id", "u").agg(F.count(F.lit(1)).alias("c"))
    groups = cut(rows.groupBy("d").agg(F.sum("c").alias("n"), F.max(F.struct("id", "u", "c")).alias("best")).where("n > 1"))
    shared = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.max("best.c")).first()
    named = groups.select(F.col("d").alias("gd"), "n", "best")
    limit = shared[0] / HOT_PAYLOADS
    hot, cold = named.where(F.col("n") > limit).limit(HOT_PAYLOADS), named.where(F.col("n") <= limit)
    bits, size = bounded_filter(cold.select(F.xxhash64("gd").alias("h")), "h", shared[1])
    some = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(h):
        import numpy as np
        import pandas as pd
        return pd.Series(may_contain(some.value, size, h.to_numpy().astype(np.int64).view(np.uint64)))

    big = F.col("payload_bytes") >= least_bytes
    tagged = base.join(F.broadcast(hot), (F.col("d") == F.col("gd")) & big, "left").withColumn("check", F.col("gd").isNull() & big & maybe(F.xxhash64("d")))
    known = tagged.where("not check")
    looked = tagged.where("check").drop("gd", "n", "best").join(cold, F.col("d") == F.col("gd"), "left")
    one = F.col("gd").isNotNull() & F.col("id").eqNullSafe(F.col("best.id")) & F.col("u").eqNullSafe(F.col("best.u"))
    rows = known.unionByName(looked)
    revisit = F.col("gd").isNotNull() & ~one
    if (shared[2] or 0) > 1:        # repeated rows tie for the response: one of them is it, the others are counted out as revisits
        tied = one & (F.col("best.c") > 1)
        lead = cut(rows.where(tied).groupBy("d").agg(*[F.first(c).alias(c) for c in ("id", "uri", "payload", "payload_bytes", "u", "gd", "n", "best")]))
        again = (lead.withColumn("block", F.explode(F.expr("sequence(0L, (best.c - 2) div 1000)"))).repartition("d", "block")
                 .withColumn("copy", F.explode(F.expr("sequence(block * 1000, least(best.c - 2, block * 1000 + 999))"))))
        plain = rows.where(~F.coalesce(tied, F.lit(False)))
        rows = plain.select(*lead.columns, revisit.alias("revisit")).unionByName(
            lead.withColumn("revisit", F.lit(False))).unionByName(again.select(*lead.columns, F.lit(True).alias("revisit")))
    else:
        rows = rows.withColumn("revisit", revisit)
    key = F.when(F.col("gd").isNotNull(), F.substring("d", 1, 32))
    out = rows.select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.col("uri").alias("target_uri"),
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "payload_bytes", F.sha1("payload").alias("payload_sha1"),
        F.when(~F.col("revisit"), key).alias("record_key"), F.when(F.col("revisit"), key).alias("refers_key"),
        F.create_map(F.lit("X-Row-Id"), F.col("id").cast("string"),
                     F.lit("X-Refers-To-Row-Id"), F.when(F.col("revisit"), F.col("best.id").cast("string"))).alias("fields"))
    out.write.format("warc").mode("append").options(**(options or {})).option("path", folder).save()


def read_captures(spark: SparkSession, folder: str, id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """(row_id, target_uri, record_type, payload_bytes, payload_digest, refers_to_row[, payload]) of the responses and revisits of a folder."""
    register(spark)
    schema = "record_type string, target_uri string, payload_digest string, payload_bytes bigint, fields map<string,string>" + (", payload binary" if payloads else "")
    got = spark.read.format("warc").schema(schema).load(folder).where(F.col("record_type").isin("response", "revisit"))
    return got.select(F.col("fields")["x-row-id"].cast(id_type).alias("row_id"), "target_uri", "record_type", "payload_bytes",
                      F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
                      F.col("fields")["x-refers-to-row-id"].cast(id_type).alias("refers_to_row"), *(["payload"] if payloads else []))
