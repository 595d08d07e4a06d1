"""OSM PBF as a Spark data source: one partition a blob, decoded on the executors.

The file layout is public: length-prefixed blob headers, zlib blobs, protobuf primitive blocks with a
table of texts and delta-coded ids, places and references. Rows: (kind, id, lon, lat, refs, tags).

    spark.dataSource.register(PbfSource); spark.read.format("osm_pbf").load(path)

The path must be readable from driver and executors by plain file access.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id long, lon double, lat double, refs array<long>, tags map<string,string>"


def varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as numbers, the rest as bytes."""
    at = 0
    while at < len(buf):
        key, at = varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(buf, at)
        elif kind == 2:
            n, at = varint(buf, at)
            value, at = buf[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = buf[at : at + n], at + n
        else:
            raise ValueError(f"field kind {kind} is not in use")
        yield key >> 3, value


def packed(buf: bytes) -> list[int]:
    out, at = [], 0
    while at < len(buf):
        v, at = varint(buf, at)
        out.append(v)
    return out


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def running(values: list[int]) -> list[int]:
    """Sums of signed differences."""
    out, total = [], 0
    for v in values:
        total += zigzag(v)
        out.append(total)
    return out


def blobs(path: str) -> list[tuple[str, int, int]]:
    """(type, offset, size) of the file's blobs."""
    out = []
    with open(path, "rb") as f:
        while head := f.read(4):
            header = dict(fields(f.read(struct.unpack(">I", head)[0])))
            size = header[3]
            out.append((header[1].decode(), f.tell(), size))
            f.seek(size, 1)
    return out


def block(raw: bytes) -> Iterator[tuple]:
    """Rows of a blob."""
    parts = dict(fields(raw))
    data = zlib.decompress(parts[3]) if 3 in parts else parts[1]
    message = list(fields(data))
    texts = [v.decode() for n, v in fields(next(v for n, v in message if n == 1)) if n == 1]
    scalar = {n: v for n, v in message if n in (17, 19, 20)}
    grain, lat0, lon0 = scalar.get(17, 100), scalar.get(19, 0), scalar.get(20, 0)
    place = lambda v, origin: 1e-9 * (origin + grain * v)
    for n, group in message:
        if n != 2:
            continue
        for kind, body in fields(group):
            if kind == 2:  # dense nodes
                f = dict(fields(body))
                ids, lats, lons = running(packed(f[1])), running(packed(f[8])), running(packed(f[9]))
                keys = iter(packed(f.get(10, b"")))
                for i, la, lo in zip(ids, lats, lons, strict=True):
                    tags = {}
                    while k := next(keys, 0):
                        tags[texts[k]] = texts[next(keys)]
                    yield "node", i, place(lo, lon0), place(la, lat0), None, tags
            elif kind in (1, 3, 4):
                f = dict(fields(body))
                tags = {texts[k]: texts[v] for k, v in zip(packed(f.get(2, b"")), packed(f.get(3, b"")), strict=True)}
                if kind == 1:
                    yield "node", zigzag(f[1]), place(zigzag(f[9]), lon0), place(zigzag(f[8]), lat0), None, tags
                elif kind == 3:
                    yield "way", f[1], None, None, running(packed(f.get(8, b""))), tags
                else:
                    yield "relation", f[1], None, None, running(packed(f.get(9, b""))), tags


class Blob(InputPartition):
    def __init__(self, offset: int, size: int):
        super().__init__(None)
        self.offset, self.size = offset, size


class PbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Blob]:
        return [Blob(at, size) for kind, at, size in blobs(self.path) if kind == "OSMData"]

    def read(self, partition: Blob) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(partition.offset)
            yield from block(f.read(partition.size))


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"])
