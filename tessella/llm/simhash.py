"""SimHash near-duplicates: fingerprints, pivot distance tables, and components of linked fingerprints.

Fingerprint. A-Z is lower-cased, words are runs of anything but the six ASCII spaces, shingles are
3 words joined by one space, repeats included (fewer words: the whole sequence; none: fingerprint
zero). A bit is 1 if set in over half of the shingles' XXH64 (seed 42).

Search. Equal fingerprints are collapsed first, so that copies never form pairs. The table holds each
print's Hamming distances to 33 reference fingerprints (pivots): a base, and for each of the four
16-bit groups eight that differ from the base in 8 bits of that group alone. What a pivot's distance differs by
from the base's is therefore a coordinate of one group, and two prints within 2 bits have equal coordinates in
two groups at least. Candidates are the pairs that share such a cell (16 coordinates, six choices of
groups). Of these, pairs are discarded whose distances to some pivot differ by over 2 (the triangle
inequality: no link is lost), and the survivors are verified on the fingerprints. funnel() counts them step by step.

Cells of over 32 prints (clusters of near copies) make no pairs: there each print is filed under itself
and its one-bit variants in the groups that the cell leaves open; prints that share a variant are within 2 bits of each
other, and each is linked to the smallest, which keeps every component whole at 33 rows a print. The
same pivot test and verification follow.

Components: alternating large-star and small-star rounds over the links, lineage cut by checkpoints.

Defined cases: null and wordless texts get fingerprint zero and are linked like any other. Very long
texts are hashed in parts of CHUNK shingles. Rows of the same identifier keep a row each. A null identifier takes part, but
cannot be a component's name. An empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, discard, documents, durable, rowwise, texts

SEED = 42
GROUPS, MASKS, MASK_BITS = 4, 8, 8
BITS = 2
BUCKET = 32
CHUNK = 1 << 18


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[-n:] if len(words) >= shingle else ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id and fp (long, the 64 bits) of every row."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def kernel(ids, bodies):
        return ((i, fingerprint(b, shingle)) for i, b in zip(ids, bodies, strict=True))

    return texts(df, id_col, text_col).mapInArrow(rowwise(kernel, schema), "id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) * (x >> 63)


def pivots() -> list[int]:
    """Reference fingerprints by rule: a base, then MASKS for each group of 16 bits, which differ from it in MASK_BITS bits of the group."""
    base = xxhash.xxh64_intdigest("base", SEED)
    masks = []
    for g in range(GROUPS):
        for k in range(MASKS):
            places = sorted(range(16), key=lambda i, g=g, k=k: xxhash.xxh64_intdigest(f"{g} {k} {i}", SEED))[:MASK_BITS]
            masks.append(sum(1 << (16 * g + i) for i in places))
    return [base, *(base ^ m for m in masks)]


def _table(prints: DataFrame) -> DataFrame:
    """fp, rep and the pivot distance table: d, the distance to the base, and g0 to g3.

    A group's pivots differ from the base in 8 bits, so their distances are d + 8 - 2c with c from 0 to 8: four bits each.
    """
    base, *others = pivots()
    d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(base))))

    def group(g: int) -> Column:
        out = F.lit(0).cast("long")
        for k, p in enumerate(others[g * MASKS : (g + 1) * MASKS]):
            c = ((F.col("d") + MASK_BITS - F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p))))) / 2).cast("long")
            out = out.bitwiseOR(F.shiftleft(c, 4 * k))
        return out

    return prints.select("fp", "rep", d.alias("d")).select("*", *[group(g).alias(f"g{g}") for g in range(GROUPS)])


def _differences(a: str, b: str) -> list[Column]:
    """By how much the distances of a and b to each pivot differ."""
    base = F.col(f"{a}.d") - F.col(f"{b}.d")
    part = lambda c, k: F.shiftrightunsigned(F.col(c), 4 * k).bitwiseAND(F.lit(15))
    return [F.abs(base), *[F.abs(base - 2 * (part(f"{a}.g{g}", k) - part(f"{b}.g{g}", k))) for g in range(GROUPS) for k in range(MASKS)]]


def _near(a: str, b: str) -> Column:
    """The maximum coordinate difference is BITS or less."""
    return F.greatest(*_differences(a, b)) <= BITS


def _verified(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= BITS


CELLS = list(combinations(range(GROUPS), GROUPS - BITS))
TABLE = ["fp", "rep", "d", *[f"g{g}" for g in range(GROUPS)]]


def _filed(prints: DataFrame) -> DataFrame:
    """The table's rows under the cells of their coordinates: band (the choice of groups) and key."""
    cells = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftleft(f"g{a}", 32).bitwiseOR(F.col(f"g{b}")).alias("key")) for i, (a, b) in enumerate(CELLS)])
    return _table(prints).withColumn("at", F.explode(cells)).select("at.band", "at.key", *TABLE)


def _pairs(few: DataFrame) -> DataFrame:
    a, b = few.alias("a"), few.alias("b")
    return a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") > F.col("b.rep")))


def funnel(prints: DataFrame) -> list[tuple[str, int]]:
    """Pairs in the cells (as often as they share one), those left after each pivot in turn, and those verified."""
    differences = _differences("a", "b")
    gone = F.coalesce(*[F.when(d > BITS, k) for k, d in enumerate(differences)], F.lit(len(differences)))  # the first pivot to tell them apart
    falls = {r["gone"]: r for r in _pairs(_filed(prints)).select(gone.alias("gone"), _verified("a", "b").cast("long").alias("v")).groupBy("gone").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")).collect()}
    left = sum(r["n"] for r in falls.values())
    steps = [("cells", left)]
    for k in range(len(differences)):
        left -= falls[k]["n"] if k in falls else 0
        steps.append((f"pivot {k}", left))
    return [*steps, ("verified", falls[len(differences)]["v"] if len(differences) in falls else 0)]


def links(prints: DataFrame) -> DataFrame:
    """Links u > v between representatives of distinct fingerprints (fp, rep) at 2 bits or fewer.

    Every component of the full link graph is a component of these links.
    """
    filed = _filed(prints)
    sizes = filed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = durable(filed.join(sizes, ["band", "key"]))
    survivors = _pairs(shared.filter(F.col("n") <= BUCKET)).filter(_near("a", "b")).filter(_verified("a", "b"))
    out = survivors.select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))

    # One-bit variants in the two groups that the cell leaves open.
    free = [[16 * g + i for g in range(GROUPS) if g not in cell for i in range(16)] for cell in CELLS]
    masks = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << x)).cast("long") for x in row]) for row in free])
    many = shared.filter(F.col("n") > BUCKET)
    me = F.struct("rep", *[c for c in TABLE if c != "rep"])
    variants = many.withColumn("flip", F.explode(masks[F.col("band")])).withColumn("near", F.col("fp").bitwiseXOR(F.col("flip")))
    centre = variants.groupBy("band", "near").agg(F.min(me).alias("c"))
    found = variants.alias("a").join(centre.alias("b"), ["band", "near"]).select(F.struct(*[f"a.{c}" for c in TABLE]).alias("a"), F.col("b.c").alias("b"))
    found = found.filter(F.col("a.rep") > F.col("b.rep")).filter(_near("a", "b")).filter(_verified("a", "b"))
    links = durable(out.union(found.select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))).distinct())
    discard(shared)
    return links


def _stars(edges: DataFrame) -> bool:
    """Whether every node of edges (u, v) is the end of one edge, or the centre of others only."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"))))
    each = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return each.filter("up > 1 OR up = 1 AND least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node), for the nodes of edges (u, v) but the smallest of each component.

    Large-star links each node's larger neighbours to its smallest one, small-star its smaller ones;
    alternating them leaves stars after a few rounds (O(log^2) of the nodes at most). Edges that are stars already need no round.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.*").filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component (smallest identifier reachable) of every row."""
    own = durable(fingerprints(df, id_col, text_col))
    prints = durable(own.groupBy("fp").agg(F.min("id").alias("rep")))
    found = components(links(prints.filter("rep IS NOT NULL")))
    named = prints.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return own.join(named, "fp").select("id", "fp", "component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )
