"""WARC archives as a Python data source, and archiving of pages with revisit records.

Reading: files are dealt into partitions by size on the driver; each record's header block is parsed first.
Filters on record_type and the header columns are pushed into the reader, and the payload of a record that
fails them (or of every record, with option payload=false) is not decoded: an uncompressed record is
skipped by its length, a gzip member by the skip length in its `sl` extra field where the writer left one,
else inflated without keeping it.

Writing: each task writes gzip members (one a record) or plain records to files of at most about
`max_file_bytes`, under `_staging`; commit moves the files of successful tasks to the folder itself, so a lost or repeated task
leaves nothing behind that a reader sees. Paths go to pyarrow's file systems (file, s3, gs, hdfs).

Null payload is empty; null header columns write no header. A table without rows gives an empty archive, which reads as no rows.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from lodestrata.llm import scratch, skew

#: Columns and the headers of the WARC format that they hold.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: Names of headers have no case: those that are known get the format's own.
_SPELLED = {h.lower(): h for h in (*HEADERS.values(), "Content-Length", "WARC-Profile", "X-Payload-Length")}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", headers map<string,string>, payload binary"
_ARROW = pa.schema([*((c, pa.string()) for c in HEADERS), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_BATCH_BYTES = 8 << 20


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def block(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in headers), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field says how long it is, packed and unpacked."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if len(data) >> 32 or len(body) >> 31:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + tail
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(data)) + body + tail


def parse(head: bytes) -> dict[str, str]:
    """Headers of a block, whose names have no case; folded lines are joined. The first line is the version."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, v = line.split(":", 1)
            last = _SPELLED.get(name.strip().lower(), name.strip())
            out[last] = v.strip()
    return out


def length_of(headers: dict[str, str], at: int) -> int:
    said = headers.get("Content-Length", "")
    if not said.isascii() or not said.isdigit():
        raise ValueError(f"record at {at} has no length")
    return int(said)


class Files:
    """Records of one file: headers first, then payload on demand."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """(headers, payload or None) of the records for which wanted(headers) gives (take, decode)."""
        at = 0
        while at < self.size:
            self.source.seek(at)
            start = self.source.read(2)
            if start == b"\x1f\x8b":
                at = yield from self._member(at, wanted)
            elif start.strip() == b"" or start[:1] in (b"\r", b"\n"):
                at += 1
            else:
                at = yield from self._plain(at, wanted)

    def _plain(self, at: int, wanted):
        self.source.seek(at)
        data = b""
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = self.source.read(16384)
            if not more:
                raise ValueError(f"record at {at} has no end of headers")
            data += more
        if not data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = parse(data[:end])
        n = length_of(headers, at)
        if at + end + 4 + n > self.size:
            raise ValueError(f"record at {at} is cut off")
        take, decode = wanted(headers)
        if take:
            payload = None
            if decode:
                payload = data[end + 4 : end + 4 + n]
                payload += self.source.read(n - len(payload)) if len(payload) < n else b""
            yield headers, payload
        return at + end + 4 + n + 4

    def _member(self, at: int, wanted):
        self.source.seek(at)
        head = self.source.read(4096)
        flags, place, length = head[3], 10, None
        if flags & 4:
            n = struct.unpack_from("<H", head, place)[0]
            extra, place = head[place + 2 : place + 2 + n], place + 2 + n
            while len(extra) >= 4:
                k = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and k == 8:
                    length = struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + k :]
        for bit in (8, 16):  # name, comment
            if flags & bit:
                place = head.index(b"\0", place) + 1
        place += 2 * bool(flags & 2)
        z = zlib.decompressobj(-15)
        data, raw, used = b"", head[place:], at + len(head)

        def inflate(most: int) -> bytes:
            nonlocal raw, used
            out = b""
            while not out and not z.eof:
                if not raw:
                    raw = self.source.read(65536)
                    used += len(raw)
                    if not raw:
                        raise ValueError(f"gzip member at {at} is cut off")
                out = z.decompress(raw, most)
                raw = z.unconsumed_tail
            return out

        while (end := data.find(b"\r\n\r\n")) < 0 and not z.eof:
            data += inflate(4096)
        if end < 0 or not data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = parse(data[:end])
        n = length_of(headers, at)
        take, decode = wanted(headers)
        if take and decode:
            parts, have = [data[end + 4 :]], len(data) - end - 4
            while have < n and not z.eof:
                parts.append(inflate(1 << 20))
                have += len(parts[-1])
            payload = b"".join(parts)[:n]
            if len(payload) != n:
                raise ValueError(f"record at {at} is cut off")
            yield headers, payload
        elif take:
            yield headers, None
        if length is not None:
            if at + length > self.size:
                raise ValueError(f"gzip member at {at} is cut off")
            return at + length
        seen = len(data) if not (take and decode) else None
        while not z.eof:
            more = len(inflate(1 << 20))
            seen = None if seen is None else seen + more
        if seen is not None and seen < end + 4 + n:
            raise ValueError(f"record at {at} is cut off")
        if used - len(z.unused_data) + 8 > self.size:
            raise ValueError(f"gzip member at {at} is cut off")
        return used - len(z.unused_data) + 8


class Share(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.part_bytes = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            kind = type(f).__name__
            if isinstance(f, (EqualTo, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((kind, HEADERS[f.attribute[0]], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        system, path = open_fs(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name.endswith((".warc", ".warc.gz")) and "/_staging/" not in x.path)
        shares: list[list[tuple[str, int]]] = []
        room = 0
        for name, size in files:
            if size > room:
                shares.append([])
                room = self.part_bytes
            shares[-1].append((name, size))
            room -= size
        return [Share(x) for x in shares] or [Share([])]

    def passes(self, headers: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            own = headers.get(name)
            if kind == "IsNull":
                ok = own is None
            elif own is None:
                ok = False
            else:
                ok = {"EqualTo": lambda: own == value, "In": lambda: own in value, "IsNotNull": lambda: True, "StringStartsWith": lambda: own.startswith(value), "StringEndsWith": lambda: own.endswith(value), "StringContains": lambda: value in own}[kind]()
            if not ok:
                return False
        return True

    def read(self, partition):
        system, _ = open_fs(self.path)
        rows, size = [], 0
        for name, length in partition.files:
            with system.open_input_file(name) as source:
                for headers, payload in Files(source, length).records(lambda h: (self.passes(h), self.payload)):
                    rows.append((*(headers.get(h) for h in HEADERS.values()), list(headers.items()), payload))
                    size += len(payload or b"") + 500
                    if size >= _BATCH_BYTES:
                        yield self.batch(rows)
                        rows, size = [], 0
        yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gzip = options.get("compression", "gzip") != "none"
        self.level = int(options.get("level", 1))
        self.most = int(options.get("max_file_bytes", 64 << 20))
        self.job = uuid.uuid4().hex

    def records(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        names = batch.schema.names
        columns = {c: batch.column(c).to_pylist() if c in names else [None] * batch.num_rows for c in (*HEADERS, "headers", "payload")}
        for i in range(batch.num_rows):
            own = [(h, columns[c][i]) for c, h in HEADERS.items() if columns[c][i] is not None]
            known = {*HEADERS.values(), "Content-Length"}
            own += [(k, v) for k, v in columns["headers"][i] or [] if k not in known and v is not None]
            yield block(own, columns["payload"][i] or b"")

    def write(self, iterator):
        system, path = open_fs(self.path)
        stage = f"{path}/_staging/{self.job}"
        system.create_dir(stage, recursive=True)
        names, out, size = [], None, 0
        info = block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        try:
            for batch in iterator:
                for data in self.records(batch):
                    if out is None or size >= self.most:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                        # buffered, for members are small
                        out, size = io.BufferedWriter(_Raw(system.open_output_stream(f"{stage}/{names[-1]}", compression=None)), 1 << 20), 0
                        out.write(member(info, self.level) if self.gzip else info)
                    data = member(data, self.level) if self.gzip else data
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        system, path = open_fs(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if x.type == fs.FileType.File and x.base_name.endswith((".warc", ".warc.gz")):
                    system.delete_file(x.path)
        system.create_dir(path, recursive=True)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{path}/_staging/{self.job}/{name}", f"{path}/{name}")
        self._drop(system, path)

    def abort(self, messages):
        self._drop(*open_fs(self.path))

    def _drop(self, system, path):
        if system.get_file_info(f"{path}/_staging/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_staging/{self.job}")


class _Raw(io.RawIOBase):
    """A pyarrow output stream as Python's raw stream, so that it can be buffered."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self):
        return True

    def write(self, data):
        return self.stream.write(data)

    def close(self):
        if not self.closed:
            self.stream.close()
        super().close()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest):
    """Base 32 of a SHA-1 digest in hexadecimal: five digits are four characters."""
    groups = [F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)])


def archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0, **options) -> None:
    """Writes a record for each page to WARC files at path.

    Of pages with equal payloads of at least revisit_bytes, the one with the largest id is a response, and others are
    revisits that name it. Pages that share that id are all responses; a null id is smaller than any other, and nulls alone are all responses.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("n"), (F.col(uri_col) if uri_col in pages.columns else F.lit(None)).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # which record each (id, digest) of several refers to is found without payloads; payloads meet it by both, so that those of a hot digest are spread
    marks = scratch.keep(rows.where(F.col("size") >= revisit_bytes).select("n", "sha"), "warc-digests")
    shared = marks.groupBy("sha").agg(F.max("n").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and keeper is not null")
    shared = scratch.keep(shared, "warc-keepers")
    keepers = skew.look_up(marks.where("n is not null"), shared, ["sha"], "copies", "inner").distinct()
    named = rows.where("n is not null").join(keepers, ["n", "sha"], "left")
    # records without an id are looked up by digest alone
    nameless = skew.look_up(rows.where("n is null"), shared, ["sha"], "copies") if not marks.where("n is null").isEmpty() else None
    rows = named if nameless is None else named.unionByName(nameless)
    revisit = F.col("keeper").isNotNull() & ~F.col("n").eqNullSafe(F.col("keeper")) & (F.col("size") >= revisit_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    records = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("id")).alias("record_id"), F.col("uri").alias("target_uri"), F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.lit("text/html").alias("content_type"), F.concat(F.lit("sha1:"), base32(F.col("sha"))).alias("payload_digest"), F.when(revisit, urn(F.col("keeper"))).alias("refers_to"),
        F.create_map(F.lit("X-Payload-Length"), F.col("size").cast("string"), F.lit("WARC-Profile"), F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"))
    records.write.format("warc").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.new_path(spark, "warc")
    archive(pages, path, revisit_bytes=0)
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    got = read(spark, path).where(F.col("record_type").isin("response", "revisit"))
    own = F.concat(F.lit("sha1:"), base32(F.sha1("payload")))
    sound = F.when((F.col("record_type") == "revisit") | (own == F.col("payload_digest")), F.substring("payload_digest", 6, 32)).otherwise(F.raise_error(F.lit("a payload does not have its digest")))
    size = F.when(F.col("record_type") == "revisit", F.col("headers")["X-Payload-Length"].cast("long")).otherwise(F.octet_length("payload").cast("long"))
    return got.select(number(F.col("record_id")).alias("page_id"), size.alias("payload_bytes"), sound.alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS s FROM p),
k AS (SELECT s, max(page_id) AS keeper FROM h GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(s, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM keeper OR keeper IS NULL THEN NULL ELSE keeper END AS refers_to
FROM h JOIN k USING (s)
"""

QUERIES = {"op1_warc": op1_warc}
ORACLE_SQL = {"op1_warc": SQL}
