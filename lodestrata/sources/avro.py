"""Avro container files as a Python data source: files are split at their sync markers and read into Arrow batches; tables are written as files of blocks.

A container has a schema, a codec and a sync marker of 16 bytes in its header, and blocks that end with the marker. A partition is a range of bytes of a file: it reads the blocks that begin in its range, the
first of them after the first marker there, so one large file is read by many tasks. Codecs are null, deflate and zstandard.

Types: boolean, int, long, float, double, bytes, string, fixed, enum (as string), arrays, maps, records, unions of null and one type; dates, timestamps of milli- and microseconds, with zone and local, decimals. A union of
several types is refused. A file that is cut off, or a block without its marker, is an error. The schema is that of the first file by name; a folder without files has none, and is an error unless a schema is given.
"""

from __future__ import annotations

import datetime
import decimal
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

MAGIC = b"Obj\x01"
_EPOCH, _DAY = datetime.datetime(1970, 1, 1), datetime.date(1970, 1, 1)
_MICRO = datetime.timedelta(microseconds=1)
_PLAIN = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "null": T.NullType()}
_LOGICAL = {"date": T.DateType(), "timestamp-millis": T.TimestampType(), "timestamp-micros": T.TimestampType(), "local-timestamp-millis": T.TimestampNTZType(), "local-timestamp-micros": T.TimestampNTZType()}


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, of a path or URI."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


# numbers

def zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F or n < 0:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


class Input:
    """Bytes with a place."""

    __slots__ = ("at", "data")

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise ValueError("a value is cut off")
        self.at += n
        return out


# schemas

class Schema:
    """Spark's type of an Avro schema, and the functions that read and write its values."""

    def __init__(self, said):
        self.named: dict[str, object] = {}
        self.type, self.read, self.write = self._of(said)

    def _of(self, said) -> tuple[T.DataType, Callable, Callable]:
        if isinstance(said, list):
            return self._union(said)
        if isinstance(said, str):
            if said in self.named:
                return self._of(self.named[said])
            said = {"type": said}
        kind, logical = said["type"], said.get("logicalType")
        if isinstance(kind, (list, dict)):
            return self._of(kind)
        if "name" in said:
            self.named[said["name"]] = said
        if logical == "decimal":
            return self._decimal(said)
        if logical in _LOGICAL and kind in ("int", "long"):
            return self._time(logical)
        if kind == "record":
            parts = [(f["name"], *self._of(f["type"])) for f in said["fields"]]
            names = [p[0] for p in parts]

            def write(v, out):
                for name, _, _, put in parts:
                    put(v[name], out)

            return T.StructType([T.StructField(n, t) for n, t, _, _ in parts]), lambda x: dict(zip(names, [get(x) for _, _, get, _ in parts], strict=True)), write
        if kind == "array":
            of, get, put = self._of(said["items"])
            return T.ArrayType(of), lambda x: list(self._blocks(x, get)), lambda v, out: self._put_blocks(v, put, out)
        if kind == "map":
            of, get, put = self._of(said["values"])
            pair = lambda x: (x.take(x.long()).decode(), get(x))

            def put_pair(kv, out):
                key = kv[0].encode()
                out += zigzag(len(key)) + key
                put(kv[1], out)

            return T.MapType(T.StringType(), of), lambda x: list(self._blocks(x, pair)), lambda v, out: self._put_blocks(v.items() if isinstance(v, dict) else v, put_pair, out)
        if kind == "enum":
            symbols = said["symbols"]
            return T.StringType(), lambda x: symbols[x.long()], lambda v, out: out.extend(zigzag(symbols.index(v)))
        if kind == "fixed":
            return T.BinaryType(), lambda x, n=said["size"]: x.take(n), lambda v, out: out.extend(v)
        if kind not in _PLAIN:
            return self._of(self.named[kind])
        return (_PLAIN[kind], *self._plain(kind))

    @staticmethod
    def _plain(kind: str) -> tuple[Callable, Callable]:
        def put_bytes(v, out):
            v = v.encode() if isinstance(v, str) else v
            out += zigzag(len(v)) + v

        return {
            "null": (lambda x: None, lambda v, out: None),
            "boolean": (lambda x: x.take(1) != b"\0", lambda v, out: out.append(bool(v))),
            "int": (Input.long, lambda v, out: out.extend(zigzag(v))),
            "long": (Input.long, lambda v, out: out.extend(zigzag(v))),
            "float": (lambda x: struct.unpack("<f", x.take(4))[0], lambda v, out: out.extend(struct.pack("<f", v))),
            "double": (lambda x: struct.unpack("<d", x.take(8))[0], lambda v, out: out.extend(struct.pack("<d", v))),
            "bytes": (lambda x: x.take(x.long()), put_bytes),
            "string": (lambda x: x.take(x.long()).decode(), put_bytes),
        }[kind]

    def _union(self, said: list) -> tuple[T.DataType, Callable, Callable]:
        others = [s for s in said if s != "null"]
        if len(others) != 1:
            if others:
                raise ValueError(f"a union of several types: {said}")
            return self._of("null")
        of, get, put = self._of(others[0])
        if len(said) == 1:
            return of, lambda x: get(x) if x.long() == 0 else None, put
        null = said.index("null")

        def write(v, out):
            out += zigzag(null if v is None else 1 - null)
            if v is not None:
                put(v, out)

        return of, lambda x: None if x.long() == null else get(x), write

    def _decimal(self, said: dict) -> tuple[T.DataType, Callable, Callable]:
        kind = T.DecimalType(said["precision"], said.get("scale", 0))
        size = said.get("size") if said["type"] == "fixed" else None
        wide = decimal.Context(prec=60)

        def read(x):
            n = int.from_bytes(x.take(size if size is not None else x.long()), "big", signed=True)
            return decimal.Decimal(n).scaleb(-kind.scale, wide)

        def write(v, out):
            n = int(v.scaleb(kind.scale, wide))
            data = n.to_bytes(size or n.bit_length() // 8 + 1, "big", signed=True)
            out += data if size is not None else zigzag(len(data)) + data

        return kind, read, write

    @staticmethod
    def _time(logical: str) -> tuple[T.DataType, Callable, Callable]:
        if logical == "date":
            return _LOGICAL[logical], lambda x: _DAY + datetime.timedelta(days=x.long()), lambda v, out: out.extend(zigzag((v - _DAY).days))
        unit = 1000 if logical.endswith("millis") else 1
        local = logical.startswith("local")

        def read(x):
            at = _EPOCH + x.long() * unit * _MICRO
            return at if local else at.replace(tzinfo=datetime.timezone.utc)

        return _LOGICAL[logical], read, lambda v, out: out.extend(zigzag((v.astimezone(datetime.timezone.utc).replace(tzinfo=None) - _EPOCH if v.tzinfo else v - _EPOCH) // (unit * _MICRO)))

    @staticmethod
    def _blocks(x: Input, get: Callable) -> Iterator:
        while n := x.long():
            if n < 0:
                n = -n
                x.long()  # its bytes
            for _ in range(n):
                yield get(x)

    @staticmethod
    def _put_blocks(v, put: Callable, out: bytearray) -> None:
        if len(v):
            out += zigzag(len(v))
            for y in v:
                put(y, out)
        out.append(0)


def schema_of(kind: T.DataType, name: str = "row", nullable: bool = False):
    """The Avro schema of a Spark type; what may be null is a union with null."""
    plain = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "binary": "bytes", "string": "string"}
    text = "string" if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else kind.simpleString()
    if text in plain:
        said = plain[text]
    elif isinstance(kind, T.StructType):
        said = {"type": "record", "name": name, "fields": [{"name": f.name, "type": schema_of(f.dataType, f"{name}_{i}", f.nullable)} for i, f in enumerate(kind)]}
    elif isinstance(kind, T.ArrayType):
        said = {"type": "array", "items": schema_of(kind.elementType, f"{name}_item", kind.containsNull)}
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        said = {"type": "map", "values": schema_of(kind.valueType, f"{name}_value", kind.valueContainsNull)}
    elif isinstance(kind, T.DecimalType):
        said = {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    elif isinstance(kind, T.DateType):
        said = {"type": "int", "logicalType": "date"}
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        said = {"type": "long", "logicalType": "local-timestamp-micros" if isinstance(kind, T.TimestampNTZType) else "timestamp-micros"}
    else:
        raise ValueError(f"Avro has no type for {kind.simpleString()}")
    return ["null", said] if nullable else said


# files

def _decoded(codec: str, data: bytes) -> bytes:
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def _long_of(source) -> int | None:
    """A number at the source's place; None at its end."""
    n = shift = 0
    while True:
        b = source.read(1)
        if not b:
            if shift:
                raise ValueError("a file is cut off")
            return None
        n |= (b[0] & 0x7F) << shift
        if b[0] < 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def header(source) -> tuple[dict, str, bytes]:
    """(schema, codec, sync marker) of a container, whose place is left after them."""
    if source.read(4) != MAGIC:
        raise ValueError("no Avro container")
    meta: dict[str, bytes] = {}
    while n := _long_of(source):
        if n < 0:
            n = -n
            _long_of(source)
        for _ in range(n):
            key = source.read(_long_of(source)).decode()
            meta[key] = source.read(_long_of(source))
    codec = meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate", "zstandard"):
        raise ValueError(f"no codec {codec}")
    sync = source.read(16)
    if len(sync) != 16:
        raise ValueError("a file is cut off")
    return json.loads(meta["avro.schema"]), codec, sync


def blocks(source, size: int, lo: int, hi: int, sync: bytes, began: int) -> Iterator[tuple[int, bytes]]:
    """(rows, data) of the blocks that begin in lo..hi; began: where the first of the file begins."""
    if lo <= began:
        at = began
    else:  # a block begins after the marker of the one before, which may end at lo
        at, step = max(began, lo - 16), 1 << 20
        while True:
            source.seek(at)
            part = source.read(step + 15)
            k = part.find(sync)
            if k >= 0:
                at += k + 16
                break
            if len(part) < step + 15:
                return
            at += step
    while at < hi and at < size:
        source.seek(at)
        rows = _long_of(source)
        n = _long_of(source)
        if rows is None or n is None:
            raise ValueError("a file is cut off")
        data, end = source.read(n), source.read(16)
        if len(data) != n or end != sync:
            raise ValueError(f"the block at {at} is cut off or has another marker")
        yield rows, data
        at = source.tell()


class Range(InputPartition):
    def __init__(self, name: str, size: int, lo: int, hi: int):
        self.name, self.size, self.lo, self.hi = name, size, lo, hi


def files_of(path: str) -> list[tuple[str, int]]:
    system, at = open_fs(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name.endswith(".avro") and not x.base_name.startswith(("_", ".")) and "/_staging-" not in x.path)


class AvroReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.part_bytes = int(options.get("partition_bytes", 64 << 20))

    def partitions(self):
        return [Range(name, size, lo, min(lo + self.part_bytes, size)) for name, size in files_of(self.path) for lo in range(0, size, self.part_bytes)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        arrow = to_arrow_schema(self.schema)
        if not partition.size:
            yield pa.RecordBatch.from_pylist([], schema=arrow)
            return
        system, _ = open_fs(self.path)
        with system.open_input_file(partition.name) as source:
            said, codec, sync = header(source)
            get = Schema(said).read
            for rows, data in blocks(source, partition.size, partition.lo, partition.hi, sync, source.tell()):
                x = Input(_decoded(codec, data))
                yield pa.RecordBatch.from_pylist([get(x) for _ in range(rows)], schema=arrow)


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class AvroWriter(DataSourceArrowWriter):
    """Each task writes a file under a name that a failed try can't share; files count when all are there."""

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.said, self.path, self.overwrite = json.dumps(schema_of(schema)), options["path"], overwrite
        self.codec = options.get("codec", "deflate")
        self.block_rows = int(options.get("block_rows", 4096))
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        system, at = open_fs(self.path)
        system.create_dir(f"{at}/_staging-{self.job}", recursive=True)
        name, sync, put = f"part-{uuid.uuid4().hex}.avro", uuid.uuid4().bytes, Schema(json.loads(self.said)).write
        with system.open_output_stream(f"{at}/_staging-{self.job}/{name}", compression=None) as out:
            meta = {"avro.schema": self.said.encode(), "avro.codec": self.codec.encode()}
            out.write(MAGIC + zigzag(len(meta)) + b"".join(zigzag(len(k)) + k.encode() + zigzag(len(v)) + v for k, v in meta.items()) + b"\0" + sync)
            for batch in iterator:
                for lo in range(0, batch.num_rows, self.block_rows):
                    rows, data = batch.slice(lo, self.block_rows).to_pylist(), bytearray()
                    for row in rows:
                        put(row, data)
                    packed = bytes(data)
                    if self.codec == "deflate":
                        z = zlib.compressobj(wbits=-15)
                        packed = z.compress(packed) + z.flush()
                    elif self.codec == "zstandard":
                        import zstandard

                        packed = zstandard.ZstdCompressor().compress(packed)
                    out.write(zigzag(len(rows)) + zigzag(len(packed)) + packed + sync)
        return Written(name)

    def commit(self, messages):
        system, at = open_fs(self.path)
        if self.overwrite:
            for name, _ in files_of(self.path):
                system.delete_file(name)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{at}/_staging-{self.job}/{m.name}", f"{at}/{m.name}")
        system.delete_dir(f"{at}/_staging-{self.job}")

    def abort(self, messages):
        system, at = open_fs(self.path)
        if system.get_file_info(f"{at}/_staging-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_staging-{self.job}")


class AvroFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "avro_files"

    def schema(self) -> T.StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no Avro files in {self.options['path']}")
        system, _ = open_fs(self.options["path"])
        with system.open_input_file(files[0][0]) as source:
            return Schema(header(source)[0]).type

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return AvroReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return AvroWriter(schema, self.options, overwrite)


def read_avro(spark: SparkSession, path: str, partition_bytes: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(AvroFiles)
    return spark.read.format("avro_files").option("partition_bytes", partition_bytes).load(path)


def write_avro(df: DataFrame, path: str, codec: str = "deflate", mode: str = "append", block_rows: int = 4096) -> None:
    df.sparkSession.dataSource.register(AvroFiles)
    df.write.format("avro_files").option("codec", codec).option("block_rows", block_rows).mode(mode).save(path)
