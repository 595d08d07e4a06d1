"""Bounded-space online packing of token streams into sequences.

Each partition keeps a fixed number of open windows. A document is cut at whole sequences first; its
rest goes to the open window where it fits best. When it fits none and all windows are open, the
fullest is emitted: it is topped up with the front of the rest (documents may be cut freely), so that
an emitted sequence has no padding, and the remainder is placed again. At its end a partition merges
its open windows into full sequences by the same cutting and leaves less than one sequence.

Finally the leftovers of all partitions (under 2048 ids each, a handful of pieces) are merged: the
partitions' totals are summed up along their order, and each piece is cut where the joined stream
crosses a sequence's end. Only the last sequence of all may be padded; it is cut into
powers of two, which need none.

Scale: the scan's partitions are packed where they are read. Only the leftovers, below 2048 ids a
partition, are shuffled, and only a row a partition reaches the driver. Sequence numbers derive from
the partition's number and a counter, so a task that runs again gives the same rows.

Defined cases: null and empty texts are the end id alone; ids may repeat or be null (each row is a document of its own); a very
long text is encoded whole and cut into full sequences at once; of windows with equal room the one opened first is taken; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, slices, texts

LENGTH = 2048
OPEN = 64
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())]
)
SQL_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


class Packer:
    """Open windows of one partition. A piece is (doc, start, ids, tokens of its document)."""

    def __init__(self, length: int, windows: int):
        self.length, self.windows = length, windows
        self.open: list[tuple[int, int]] = []  # (free, number), ascending
        self.pieces: dict[int, list[tuple]] = {}
        self.next = 0

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Yields the sequences that this document completes, as lists of pieces."""
        whole = len(ids) // self.length * self.length
        for at in range(0, whole, self.length):
            yield [(doc, at, ids[at : at + self.length], len(ids))]
        start, total = whole, len(ids)
        while start < total:
            need = total - start
            at = bisect.bisect_left(self.open, (need, -1))
            if at < len(self.open):  # the smallest gap that takes it
                free, number = self.open.pop(at)
                self.pieces[number].append((doc, start, ids[start:].copy(), total))
                if free == need:
                    yield self.pieces.pop(number)
                else:
                    bisect.insort(self.open, (free - need, number))
                return
            if len(self.open) < self.windows:
                self.pieces[self.next] = [(doc, start, ids[start:].copy(), total)]
                bisect.insort(self.open, (self.length - need, self.next))
                self.next += 1
                return
            free, number = self.open.pop(0)  # the fullest
            self.pieces[number].append((doc, start, ids[start : start + free].copy(), total))
            yield self.pieces.pop(number)
            start += free

    def rest(self) -> Iterator[tuple[bool, list[tuple]]]:
        """Merges the open windows; (full, pieces). The last may not be full."""
        now: list[tuple] = []
        room = self.length
        for _, number in self.open:
            for doc, start, ids, total in self.pieces[number]:
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    now.append((doc, start, part, total))
                    start, room = start + len(part), room - len(part)
                    if room == 0:
                        yield True, now
                        now, room = [], self.length
        if now:
            yield False, now


def pack(df: DataFrame, encoder: Callable[[], Callable[[bytes], np.ndarray]], id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, windows: int = OPEN, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    encoder() is called once a task and gives text -> ids (unsigned 32-bit), end id included.
    """

    def run(batches):
        encode = encoder()
        packer = Packer(length, windows)
        part = TaskContext.get().partitionId()
        count = 0
        out: list[tuple] = []

        def rows(pieces, number, left=False):
            at = 0
            for doc, start, ids, total in pieces:
                raw = ids.astype("<u4", copy=False).tobytes()
                yield doc, start, len(ids), zlib.crc32(raw), total, number, at, part, raw if left or with_ids else None
                at += len(ids)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
            out.clear()
            return batch

        for batch in batches:
            for piece in slices(batch, 4 << 20):
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    for done in packer.add(doc, encode(text)):
                        out.extend(rows(done, part << 36 | count))
                        count += 1
                    if len(out) > 4000:
                        yield flush()
        for full, pieces in packer.rest():
            out.extend(rows(pieces, part << 36 | count if full else -1, not full))
            count += full
        if out:
            yield flush()

    packed = durable(texts(df, id_col, text_col).mapInArrow(run, SQL_SCHEMA))
    left = packed.filter("sequence_id < 0")
    totals = left.groupBy("part").agg(F.sum("length").alias("n")).orderBy("part").collect()  # a row a partition
    sums, at = [], 0
    for r in totals:
        sums.append((r["part"], at))
        at += r["n"]
    merged = _merge(left, sums, at, length)
    out = packed.filter("sequence_id >= 0").unionByName(merged).drop("part")
    return out if with_ids else out.drop("ids")


def _merge(left: DataFrame, sums: list[tuple], total: int, length: int) -> DataFrame:
    """Cuts the leftovers, joined in the order of their partitions, at the ends of sequences.

    sums: the ids before each partition's. The last, unfilled sequence becomes powers of two.
    """
    ends, at = [], total // length * length
    tail = at
    for k in reversed(range(length.bit_length())):
        if (total - tail) >> k & 1:
            ends.append((at, at + (1 << k)))
            at += 1 << k

    def cut(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                place, start = r.pop("base") + r["offset"], r["start"]
                ids = np.frombuffer(r["ids"], "<u4")
                while len(ids):
                    if place < tail:
                        number, begin = place // length, place // length * length
                        end = begin + length
                    else:
                        k = next(i for i, (a, b) in enumerate(ends) if a <= place < b)
                        number, (begin, end) = tail // length + k, ends[k]
                    part, ids = ids[: end - place], ids[end - place :]
                    raw = part.tobytes()
                    out.append(r | {"start": start, "length": len(part), "ids_crc32": zlib.crc32(raw), "sequence_id": 1 << 62 | number, "offset": place - begin, "ids": raw})
                    start, place = start + len(part), place + len(part)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    spark = left.sparkSession
    base = spark.createDataFrame(sums or [(-1, 0)], "part long, base long")
    return left.join(base, "part").mapInArrow(cut, SQL_SCHEMA)


class ByteBpe:
    """The byte-level vocabulary, through tiktoken where it gives the same ids, with an end id appended.

    path: a tokenizers file; ranks: the same vocabulary for tiktoken.
    """

    def __init__(self, path: str, ranks: str, end: int):
        self.path, self.ranks, self.end = path, ranks, end

    def __call__(self) -> Callable[[bytes], np.ndarray]:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(self.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(self.path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        end = np.array([self.end], np.uint32)

        def encode(text: bytes) -> np.ndarray:
            ids = coder.encode_to_numpy(text.decode("utf-8", "replace"), allowed_special="all")
            return np.concatenate((ids, end))

        return encode


def byte_bpe_50k(end: int = 1) -> ByteBpe:
    import public_tokenizers as P

    return ByteBpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), end)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), byte_bpe_50k())
