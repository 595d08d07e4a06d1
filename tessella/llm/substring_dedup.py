"""Substring dedup: windows of consecutive words that an earlier document has too are removed.

Level-wise doubling. Only windows that repeat across documents at one length are extended to twice
that length (here 13, 25 and 50 words; each is two overlapping halves, and its hash is made of
theirs):

1. Anchors. In each 50-word window the 13-word window of least hash is its anchor, so windows of
   equal words have equal anchors and about one word in twenty starts one. Anchors are
   counted over the corpus; those of a single document go.
2. A surviving anchor is extended to 25 words to either side. A 50-word window around the anchor holds one
   of the two extensions at least. Extensions of a single document go.
3. The 50-word windows around surviving extensions get 128-bit hashes, here 96 bits are kept, and the
   smallest identifier of each is found. Words under a window of a document with a larger identifier
   are removed. Windows are judged on the input.

Documents that equal an earlier one as a whole sequence of words skip step 3: all of their words go (50 words or more).

Scale: one pass over the texts gives anchors and digests, which are stored; each level is a count,
pre-aggregated before its exchange, joined back. The most frequent hashes, each over 1/HOT_PARTS of the rows
and so HOT_PARTS at most, are broadcast and never shuffled; all others are joined by hash. Besides rows of
about 30 bytes, the texts are shuffled twice: to meet their marks and to meet their removals. Every step
is stored in the shared folder, and deleted when the next one is.

Rows are told apart by identifier and a hash of the text, so rows that share an identifier are
judged each by its own windows, against smaller identifiers only.

Defined cases: null text has no words; texts under 50 words lose nothing; very long texts are read in
overlapping parts; rows with a null identifier are compared with nothing and stay whole; repeated rows get the
same result each; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, durable, slices, texts

HOT_PARTS = 4096
SLICE = 2 << 20
K1, K2, K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class WordHashes(dict):
    """64-bit hashes of words, emptied at a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about size bytes each."""
    at = 0
    while len(text) - at > 2 * size:
        cut = at + size
        while cut < len(text) and text[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def joined(a: np.ndarray, b: np.ndarray, k: np.uint64 = K1) -> np.ndarray:
    """Hashes of pairs, order-sensitive."""
    x = a * k + (b ^ (b >> np.uint64(31))) * K2
    x ^= x >> np.uint64(29)
    x *= K3
    return x ^ (x >> np.uint64(32))


def rolled(h: np.ndarray, length: int, k: np.uint64 = K1) -> np.ndarray:
    """Hashes of all windows of length, from h of single words, by doubling; the last step overlaps."""
    have = 1
    while have < length:
        step = min(have, length - have)
        h = joined(h[:-step], h[step:], k) if len(h) > step else h[:0]
        have += step
    return h


def sliding(h: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over h[i : i + size]."""
    have = 1
    while have < size:
        step = min(have, size - have)
        h = pick(h[:-step], h[step:])
        have += step
    return h


def lengths(window: int) -> tuple[int, int, int]:
    return -(-window // 4), -(-window // 2), window


def segments(row: tuple, body: bytes, window: int, watch=None) -> Iterator[tuple[tuple, int, list[bytes]]]:
    """(row, place of the first word, words) of a text; of a long text overlapping parts, each window in one. watch gets all words."""
    carry: list[bytes] = []
    at = 0
    for words in runs(body):
        if watch:
            watch(words)
        words = carry + words
        if len(words) >= window:
            yield row, at, words
            at += len(words) - window + 1
            carry = words[len(words) - window + 1 :]
        else:
            carry = words


def together(parts: list[tuple[tuple, int, list[bytes]]], hashes: WordHashes, window: int):
    """Word hashes of all parts end to end; per place its row, place in the document, and whether a window starts."""
    sizes = np.array([len(p[2]) for p in parts])
    h = np.concatenate([hashes.of(p[2]) for p in parts])
    part = np.repeat(np.arange(len(parts)), sizes)
    within = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = within <= np.repeat(sizes - window, sizes)
    row = np.array([p[0] for p in parts], np.int64)
    base = np.array([p[1] for p in parts], np.int64)
    return h, row[part], within + base[part], starts, within, np.repeat(sizes, sizes)


def anchor_rows(parts, hashes: WordHashes, window: int):
    """id, r, pos, hash, and the hashes of the extensions to the left and right (null where the text ends)."""
    small, half, _ = lengths(window)
    h, row, pos, starts, within, size = together(parts, hashes, window)
    hs = rolled(h, small)
    low = sliding(hs, window - small + 1, np.minimum)
    low = np.where(starts[: len(low)], low, np.uint64(0))
    span = window - small
    reach = sliding(np.concatenate((np.zeros(span, np.uint64), low)), span + 1, np.maximum)
    reach = np.concatenate((reach, np.zeros(max(0, len(hs) - len(reach)), np.uint64)))  # windows that start before the end
    tail = len(hs) - len(low)
    for k in range(1, tail + 1):  # the last places lie under the last windows only
        i = len(low) - 1 + k
        reach[i] = low[max(0, i - span) :].max(initial=0)
    at = np.flatnonzero((reach[: len(hs)] == hs) & (reach[: len(hs)] > 0))
    hh = rolled(h, half)
    left = within[at] >= half - small
    right = within[at] + half <= size[at]
    lh = np.where(left, hh[np.clip(at - (half - small), 0, len(hh) - 1)], np.uint64(0))
    rh = np.where(right, hh[np.clip(at, 0, len(hh) - 1)], np.uint64(0))
    return (
        pa.array(row[at, 0]), pa.array(row[at, 1]), pa.array(pos[at].astype(np.int32)), pa.array(hs[at].view(np.int64)),
        pa.array(lh.view(np.int64), mask=~left), pa.array(rh.view(np.int64), mask=~right),
    )


def candidates(hs: np.ndarray, shared: np.ndarray, small: int, half: int, window: int) -> np.ndarray:
    """Windows whose anchor's extensions that lie in them are all shared (by place).

    This depends on the window's words alone, so equal windows of any documents are judged alike.
    """
    anchor = np.arange(len(hs))
    have, size = 1, window - small + 1
    while have < size:  # place of the least hash, the leftmost on a tie
        step = min(have, size - have)
        a, b = anchor[:-step], anchor[step:]
        anchor = np.where(hs[a] <= hs[b], a, b)
        have += step
    start = np.arange(len(anchor))
    left = anchor - (half - small)
    by_left = (left < start) | shared[np.maximum(left, 0)]
    by_right = (anchor + half > start + window) | shared[anchor]
    return np.flatnonzero(by_left & by_right)


ANCHORS = pa.schema([("id", pa.int64()), ("r", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("hl", pa.int64()), ("hr", pa.int64())])
WINDOWS = pa.schema([("id", pa.int64()), ("r", pa.int64()), ("pos", pa.int32()), ("ha", pa.int64()), ("hb", pa.int32())])
DONE = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _scan(window: int):
    """Anchors, and for each row of window words or more one at place -1: the digest of its words and their number."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for piece in slices(batch, SLICE):
                parts, wholes = [], []
                for i, r, body in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if i is None:
                        continue
                    sizes, digest = [], xxhash.xxh3_128()

                    def watch(words, sizes=sizes, digest=digest):
                        sizes.append(len(words))
                        digest.update(b"".join([w + b" " for w in words]))

                    parts += segments((i, r), body, window, watch)
                    if sum(sizes) >= window:
                        a, b = np.frombuffer(digest.digest(), np.int64).tolist()
                        wholes.append((i, r, -1, a, b, sum(sizes)))
                if parts:
                    yield pa.RecordBatch.from_arrays(list(anchor_rows(parts, hashes, window)), schema=ANCHORS)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*wholes, strict=True), ANCHORS, strict=True)], schema=ANCHORS)

    return run


def _windows(window: int):
    small, half, _ = lengths(window)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for piece in slices(batch, SLICE):
                for k, (i, r, body) in enumerate(zip(*(piece.column(c).to_pylist() for c in range(3)), strict=True)):
                    at = piece.column(3)[k].values.to_numpy()
                    for _, base, words in segments((i, r), body, window):
                        shared = np.zeros(len(words), bool)
                        shared[at[(at >= base) & (at < base + len(words))] - base] = True
                        h = hashes.of(words)
                        pos = candidates(rolled(h, small), shared, small, half, window)
                        if len(pos):
                            yield pa.RecordBatch.from_arrays([
                                pa.array(np.full(len(pos), i)), pa.array(np.full(len(pos), r)), pa.array((pos + base).astype(np.int32)),
                                pa.array(rolled(h, window)[pos].view(np.int64)), pa.array((rolled(h, window, K2)[pos] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                            ], schema=WINDOWS)

    return run


def _clean(window: int, outputs: bool):
    def run(batches):
        for batch in batches:
            for piece in slices(batch, SLICE):
                out = []
                gone, copies = piece.column(2), piece.column(3).to_pylist()
                for k, (i, body) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)):
                    at = gone[k].values.to_numpy() if gone[k].is_valid else np.zeros(0, np.int64)
                    n = base = 0
                    digest, kept = hashlib.sha256(), []
                    removed = first = 0
                    for words in runs(body):
                        if copies[k]:
                            removed += len(words)
                            words = []
                        elif len(at):
                            edge = np.zeros(len(words) + 1, np.int64)
                            np.add.at(edge, np.clip(at - base, 0, len(words)), 1)
                            np.add.at(edge, np.clip(at + window - base, 0, len(words)), -1)
                            stay = np.cumsum(edge)[:-1] <= 0
                            base += len(words)
                            removed += int(len(words) - np.count_nonzero(stay))
                            words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                        if words:
                            part = (b" " if first else b"") + b" ".join(words)
                            first = 1
                            n += len(words)
                            digest.update(part)
                            kept.append(part if outputs else b"")
                    out.append((i, n + removed, removed, digest.hexdigest(), b"".join(kept).decode("utf-8", "replace") if outputs else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DONE, strict=True)], schema=DONE)

    return run


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows (a stored table) whose keys occur under two identifiers or more, with the least of these as lo; stored."""
    groups = durable(rows.groupBy(*keys).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").drop("hi"))
    many = (groups.agg(F.sum("n")).first()[0] or 0) // HOT_PARTS
    hot = groups.filter(F.col("n") > many).drop("n")  # HOT_PARTS rows at most: their counts add up to the total
    told = rows.join(F.broadcast(hot), list(keys), "left")
    few = told.filter("lo IS NULL").drop("lo").join(groups.filter(F.col("n") <= many).drop("n"), list(keys))
    out = durable(told.filter("lo IS NOT NULL").unionByName(few))
    discard(groups)
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, outputs: bool = False) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every row; with outputs, the kept words too (kept)."""
    small, half, _ = lengths(window)
    body = texts(df, id_col, text_col).toDF("id", "text").select("id", F.xxhash64("text").alias("r"), "text")

    scanned = durable(body.mapInArrow(_scan(window), "id long, r long, pos int, h long, hl long, hr long"))
    wholes = _shared(scanned.filter("pos < 0").select("id", "r", "h", "hl", "hr"), "h", "hl", "hr")
    copies = durable(wholes.filter("id > lo").select("id", "r").distinct())
    again = _shared(scanned.filter("pos >= 0"), "h")
    discard(scanned, wholes)

    sides = F.array(F.struct((F.col("pos") - (half - small)).alias("pos"), F.col("hl").alias("h")), F.struct("pos", F.col("hr").alias("h")))
    longer = durable(again.select("id", "r", F.explode(sides).alias("e")).filter("e.h IS NOT NULL").select("id", "r", "e.pos", "e.h").distinct())
    again, before = _shared(longer, "h"), again
    discard(before, longer)
    marks = durable(again.join(copies, ["id", "r"], "left_anti").groupBy("id", "r").agg(F.collect_list("pos").alias("at")))
    discard(again)

    found = durable(body.join(marks, ["id", "r"]).select("id", "r", "text", "at").mapInArrow(_windows(window), "id long, r long, pos int, ha long, hb int"))
    discard(marks)
    over = _shared(found, "ha", "hb")
    discard(found)
    gone = over.filter("id > lo").groupBy("id", "r").agg(F.collect_list("pos").alias("gone")).withColumn("copy", F.lit(False))
    gone, before = durable(gone.unionByName(copies.select("id", "r", F.lit(None).cast("array<int>").alias("gone"), F.lit(True).alias("copy")))), (over, copies)
    discard(*before)

    final = body.join(gone, ["id", "r"], "left").select("id", "text", "gone", F.coalesce("copy", F.lit(False)).alias("copy"))
    out = final.mapInArrow(_clean(window, outputs), "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if outputs else out.drop("kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM d WHERE len(ws) >= 50),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS t FROM starts),
low AS (SELECT t, min(doc_id) AS lo FROM win GROUP BY t HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(win.s, win.s + 50)) AS p FROM win JOIN low ON win.t = low.t WHERE win.doc_id > low.lo),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
stay AS (SELECT w.doc_id, count(*) AS k, string_agg(w.w, ' ' ORDER BY w.p) AS t
         FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN stay ON d.doc_id = stay.doc_id
"""
