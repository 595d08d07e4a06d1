"""Raster operators on a long table of cells (ix, iy, z): holes are missing rows or null z.

Neighbourhoods are an explode of each cell to its neighbours' places and an aggregate, so they cross
tile borders without halos and need one exchange a round.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table
from .graph import components, saved

EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def spread(cells: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """A row for each cell and neighbour place, with the cell's z."""
    to = F.array(*[F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")) for i, j in steps])
    return cells.select(F.explode(to).alias("p"), "z").select("p.ix", "p.iy", "z")


def fill_round(cells: DataFrame) -> DataFrame:
    """Null cells get the mean of the known ones about them, as whole numbers cut down."""
    about = spread(cells.filter("z IS NOT NULL"), EIGHT).groupBy("ix", "iy").agg(F.floor(F.sum("z") / F.count("z")).alias("mean"))
    return cells.join(about, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("z", "mean").alias("z"))


def fill(cells: DataFrame, rounds: int = 50) -> DataFrame:
    """fill_round until nothing changes, or rounds are over."""
    left = None
    for _ in range(rounds):
        cells = saved(fill_round(cells))
        now = cells.filter("z IS NULL").count()
        if now in (0, left):
            break
        left = now
    return cells


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by hundred price classes as a grid of 50 x 100 with holes."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_quantity").cast("long").alias("ix"), F.floor(F.col("l_extendedprice") / 1000).alias("iy")).agg(F.min("l_partkey").alias("z"))
    return g.select("ix", "iy", F.when(F.col("z") % 5 != 0, F.col("z")).alias("z"))


SURFACE = """
g AS (SELECT CAST(l_quantity AS BIGINT) AS ix, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS iy, CASE WHEN min(l_partkey) % 5 <> 0 THEN min(l_partkey) END AS z FROM lineitem GROUP BY 1, 2),
o(i, j) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
"""


@query("r01_fill_holes", f"""
WITH {SURFACE}, m AS (SELECT g.ix + i AS ix, g.iy + j AS iy, CAST(floor(CAST(sum(z) AS DOUBLE) / count(z)) AS BIGINT) AS mean FROM g, o WHERE z IS NOT NULL GROUP BY 1, 2)
SELECT g.ix, g.iy, coalesce(g.z, m.mean) AS z FROM g LEFT JOIN m ON g.ix = m.ix AND g.iy = m.iy
""")
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_round(surface(spark, sf_dir))


@query("r01b_fill_to_the_end", None)
def fill_to_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(surface(spark, sf_dir))


@query("r02_slope", f"""
WITH {SURFACE} SELECT a.ix, a.iy, b.z - a.z AS dx, c.z - a.z AS dy FROM g a LEFT JOIN g b ON b.ix = a.ix + 1 AND b.iy = a.iy LEFT JOIN g c ON c.ix = a.ix AND c.iy = a.iy + 1 WHERE a.z IS NOT NULL
""")
def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to the next cells, by two windows; a gap in the grid is no neighbour."""
    g = surface(spark, sf_dir)
    x, y = Window.partitionBy("iy").orderBy("ix"), Window.partitionBy("ix").orderBy("iy")
    dx = F.when(F.lead("ix").over(x) == F.col("ix") + 1, F.lead("z").over(x) - F.col("z"))
    dy = F.when(F.lead("iy").over(y) == F.col("iy") + 1, F.lead("z").over(y) - F.col("z"))
    return g.select("ix", "iy", "z", dx.alias("dx"), dy.alias("dy")).filter("z IS NOT NULL").drop("z")


@query("r03_height_above_ground", """
SELECT CAST(l_quantity AS BIGINT) AS ix, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS iy, max(l_partkey) - min(CASE WHEN l_returnflag = 'N' THEN l_partkey END) AS height FROM lineitem GROUP BY 1, 2
""")
def height_above_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface less ground, both from one aggregate of the points."""
    ground = F.min(F.when(F.col("l_returnflag") == "N", F.col("l_partkey")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("ix"), F.floor(F.col("l_extendedprice") / 1000).alias("iy")).agg((F.max("l_partkey") - ground).alias("height"))


@query("r04_paint_polygons", """
WITH p AS (SELECT p_partkey AS id, p_size AS x0, p_size + 2 AS x1, p_partkey % 40 AS y0, p_partkey % 40 + 3 AS y1 FROM part),
c AS (SELECT unnest(range(x0, x1 + 1)) AS ix, y0, y1, id FROM p), d AS (SELECT ix, unnest(range(y0, y1 + 1)) AS iy, id FROM c)
SELECT CAST(ix AS BIGINT) AS ix, iy, max(id) AS painted FROM d GROUP BY 1, 2
""")
def paint_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas burnt into cells; the later one wins."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("x"), (F.col("p_partkey") % 40).alias("y"))
    c = p.select("p_partkey", "y", F.explode(F.sequence(F.col("x"), F.col("x") + 2)).alias("ix")).select("p_partkey", "ix", F.explode(F.sequence(F.col("y"), F.col("y") + 3)).alias("iy"))
    return c.groupBy("ix", "iy").agg(F.max("p_partkey").alias("painted"))


@query("r06_erode_dilate", f"""
WITH {SURFACE}, n AS (SELECT g.ix + i AS ix, g.iy + j AS iy, min(z) AS lo, max(z) AS hi FROM g, (SELECT * FROM o UNION ALL SELECT 0, 0) o WHERE z IS NOT NULL GROUP BY 1, 2)
SELECT g.ix, g.iy, n.lo AS eroded, n.hi AS dilated FROM g JOIN n ON g.ix = n.ix AND g.iy = n.iy
""")
def erode_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = surface(spark, sf_dir)
    n = spread(g.filter("z IS NOT NULL"), [*EIGHT, (0, 0)]).groupBy("ix", "iy").agg(F.min("z").alias("eroded"), F.max("z").alias("dilated"))
    return g.select("ix", "iy").join(n, ["ix", "iy"])


def flood(z: dict, w: dict, fixed: dict) -> dict:
    """Lowers the levels w of cells with heights z to their fixpoint, least level first; fixed: levels of cells about them."""
    heap = [(level, *at) for at, level in (w | fixed).items()]
    heapq.heapify(heap)
    while heap:
        level, i, j = heapq.heappop(heap)
        if level > w.get((i, j), level):
            continue
        for a, b in EIGHT:
            at = i + a, j + b
            if at in w and (new := max(z[at], level)) < w[at]:
                w[at] = new
                heapq.heappush(heap, (new, *at))
    return w


def water_level(cells: DataFrame, side: int = 64) -> DataFrame:
    """ix, iy, z and level: the least, over ways to a border, of the highest cell on the way. Cells that lack a neighbour are border.

    Tiles of side x side cells are flooded apart, with the levels of the cells about them, until no level
    changes: a round for each tile on the longest way, not for each cell.
    """
    known = saved(cells.filter("z IS NOT NULL").select("ix", "iy", "z"))
    inner = spread(known, EIGHT).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    level = saved(known.join(inner, ["ix", "iy"], "left").select("ix", "iy", "z", F.when(F.coalesce("n", F.lit(0)) < 8, F.col("z")).otherwise(F.lit(1 << 40)).alias("w")))

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        at = list(zip(rows["ix"], rows["iy"], strict=True))
        own = dict(zip(at, rows["own"], strict=True))
        z, w = dict(zip(at, rows["z"], strict=True)), dict(zip(at, rows["w"], strict=True))
        new = flood(z, {k: v for k, v in w.items() if own[k]}, {k: v for k, v in w.items() if not own[k]})
        return pd.DataFrame([(*k, z[k], w[k], v) for k, v in new.items()], columns=["ix", "iy", "z", "old", "w"])

    tx, ty = (lambda d: F.floor((F.col("ix") + d) / side)), (lambda d: F.floor((F.col("iy") + d) / side))
    while True:
        tiles_of = F.array_distinct(F.array(*[F.struct(tx(i).alias("tx"), ty(j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        dealt = level.select("ix", "iy", "z", "w", F.explode(tiles_of).alias("t")).select("ix", "iy", "z", "w", "t.*")
        dealt = dealt.withColumn("own", (F.col("tx") == tx(0)) & (F.col("ty") == ty(0)))
        state = saved(dealt.groupBy("tx", "ty").applyInPandas(tile, "ix long, iy long, z long, old long, w long"))
        level = state.drop("old")
        if state.filter("w < old").limit(1).count() == 0:
            return level.select("ix", "iy", "z", F.col("w").alias("level"))


@query("r08_fill_depressions", None)
def fill_depressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water_level(surface(spark, sf_dir))


def smooth(fixed: np.ndarray, z: np.ndarray, target: np.ndarray, lam: float, tolerance: float = 1e-10) -> np.ndarray:
    """The surface of least sum of squared steps between neighbours plus lam times its squared distance to target, with z where fixed: conjugate gradients."""

    def product(x: np.ndarray) -> np.ndarray:
        out = lam * x
        for axis in (0, 1):
            step = np.diff(x, axis=axis)
            pad = [(0, 0), (0, 0)]
            pad[axis] = (1, 1)
            out -= np.diff(np.pad(step, pad), axis=axis)
        return out

    x = np.where(fixed, z, target)
    r = np.where(fixed, 0.0, lam * target - product(x))
    p, rr = r.copy(), float((r * r).sum())
    while rr > tolerance**2 * max(1.0, float((target * target).sum())):
        q = np.where(fixed, 0.0, product(p))
        alpha = rr / float((p * q).sum())
        x, r = x + alpha * p, r - alpha * q
        now = float((r * r).sum())
        p, rr = r + now / rr * p, now
    return x


@query("r09_smooth_surface", None)
def smooth_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tile of 32 x 32 cells: known cells stay, the others take the smoothest surface that leans on the tile's mean."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["i", "j"])
        z, known = np.zeros((32, 32)), np.zeros((32, 32), bool)
        at = rows["i"].to_numpy(), rows["j"].to_numpy()
        known[at] = rows["z"].notna().to_numpy()
        z[at] = rows["z"].fillna(0).to_numpy()
        mean = float(z[known].mean()) if known.any() else 0.0
        x = smooth(known, z, np.full((32, 32), mean), 0.05)
        return pd.DataFrame({"ix": rows["tx"] * 32 + rows["i"], "iy": rows["ty"] * 32 + rows["j"], "z": x[at]})

    return tiles(surface(spark, sf_dir), 32).groupBy("tx", "ty").applyInPandas(solve, "ix long, iy long, z double")


@query("r12_cut_tiles", f"WITH {SURFACE} SELECT ix // 16 AS tx, iy // 16 AS ty, count(*) AS cells, count(z) AS known, min(ix) AS x0, max(ix) AS x1 FROM g GROUP BY 1, 2")
def cut_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface(spark, sf_dir).groupBy(F.floor(F.col("ix") / 16).alias("tx"), F.floor(F.col("iy") / 16).alias("ty")).agg(
        F.count(F.lit(1)).alias("cells"), F.count("z").alias("known"), F.min("ix").alias("x0"), F.max("ix").alias("x1")
    )


@query("r13_local_relief", f"""
WITH {SURFACE}, p AS (SELECT ix, iy, z FROM g WHERE z IS NOT NULL),
q AS (SELECT p.ix, p.iy, median(CASE WHEN (g.ix - p.ix) * (g.ix - p.ix) + (g.iy - p.iy) * (g.iy - p.iy) <= 1 THEN g.z END) AS disc,
             median(CASE WHEN (g.ix - p.ix) * (g.ix - p.ix) + (g.iy - p.iy) * (g.iy - p.iy) BETWEEN 4 AND 16 THEN g.z END) AS ring
      FROM p JOIN g ON g.ix BETWEEN p.ix - 4 AND p.ix + 4 AND g.iy BETWEEN p.iy - 4 AND p.iy + 4 GROUP BY 1, 2)
SELECT ix, iy, disc - ring AS relief FROM q
""")
def local_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median inside a disc less that of a ring, at every known cell."""
    g = surface(spark, sf_dir)
    p = g.filter("z IS NOT NULL").select(F.col("ix").alias("px"), F.col("iy").alias("py"))
    near = [(i, j) for i in range(-4, 5) for j in range(-4, 5) if i * i + j * j <= 16]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * i + j * j).alias("d2")) for i, j in near])
    q = p.select("px", "py", F.explode(offsets).alias("o")).select("px", "py", (F.col("px") + F.col("o.i")).alias("ix"), (F.col("py") + F.col("o.j")).alias("iy"), "o.d2").join(g, ["ix", "iy"])
    disc, ring = F.median(F.when(F.col("d2") <= 1, F.col("z"))), F.median(F.when(F.col("d2") >= 4, F.col("z")))
    return q.groupBy(F.col("px").alias("ix"), F.col("py").alias("iy")).agg((disc - ring).alias("relief"))


@query("r14_label_cells", f"""
WITH RECURSIVE {SURFACE}, m AS (SELECT ix * 100000 + iy AS id, ix, iy FROM g WHERE z < 60),
b AS (SELECT x.id AS src, y.id AS dst FROM m x JOIN o ON TRUE JOIN m y ON y.ix = x.ix + o.i AND y.iy = x.iy + o.j),
c AS (SELECT id AS node, id AS label FROM m UNION SELECT b.dst, c.label FROM c JOIN b ON b.src = c.node WHERE c.label < b.dst)
SELECT node, min(label) AS component FROM c GROUP BY node
""")
def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-connected areas of low cells, named by their least cell."""
    m = surface(spark, sf_dir).filter("z < 60").select("ix", "iy", (F.col("ix") * 100000 + F.col("iy")).alias("z"))
    ahead = [s for s in EIGHT if s > (0, 0)]
    edges = spread(m, ahead).withColumnRenamed("z", "src").join(m.withColumnRenamed("z", "dst"), ["ix", "iy"]).select("src", "dst")
    return components(edges, m.select(F.col("z").alias("node")))


def fill_nearest(cells: DataFrame) -> DataFrame:
    """Null cells get the value of the nearest known one in king's moves; equal distances go to the smaller value."""
    while True:
        about = spread(cells.filter("z IS NOT NULL"), EIGHT).groupBy("ix", "iy").agg(F.min("z").alias("m"))
        state = saved(cells.join(about, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("z", "m").alias("z"), (F.col("z").isNull() & F.col("m").isNotNull()).alias("new")))
        cells = state.drop("new")
        if state.filter("new").limit(1).count() == 0:
            return cells


@query("r05_fill_nearest", None)
def fill_nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_nearest(surface(spark, sf_dir))


def shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Rows and columns by which b is moved against a: the peak of the phase correlation."""
    cross = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
    peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    i, j = np.unravel_index(int(peak.argmax()), peak.shape)
    return tuple(int(k - n if k > n // 2 else k) for k, n in zip((i, j), peak.shape, strict=True))


def best_match(image: np.ndarray, template: np.ndarray) -> tuple[int, int, float]:
    """Place and score of the best normalised cross-correlation of a template inside an image."""
    windows = np.lib.stride_tricks.sliding_window_view(image, template.shape)
    t = template - template.mean()
    w = windows - windows.mean(axis=(2, 3), keepdims=True)
    norm = np.sqrt((w * w).sum(axis=(2, 3)) * (t * t).sum())
    score = np.where(norm > 1e-9, (w * t).sum(axis=(2, 3)) / np.maximum(norm, 1e-9), 0.0)
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    return int(i), int(j), float(score[i, j])


def tiles(cells: DataFrame, size: int) -> DataFrame:
    """Cells with the tile they lie in and their place in it. A tile holds size x size cells at most."""
    return cells.select(F.floor(F.col("ix") / size).alias("tx"), F.floor(F.col("iy") / size).alias("ty"), (F.col("ix") % size).alias("i"), (F.col("iy") % size).alias("j"), "z")


def _image(rows: pd.DataFrame, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["z"].fillna(0).to_numpy()
    return out


@query("r07_template_match", None)
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tile of 16 x 16 cells: where a bright bar fits best."""
    bar = np.array([[0, 1, 1, 0]] * 6, float)

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, score = best_match(_image(rows, 16), bar)
        return pd.DataFrame({"tx": rows["tx"].iloc[:1], "ty": rows["ty"].iloc[:1], "i": [i], "j": [j], "score": [score]})

    return tiles(surface(spark, sf_dir), 16).groupBy("tx", "ty").applyInPandas(match, "tx long, ty long, i long, j long, score double")


@query("r10_phase_shift", None)
def phase_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tile: the shift between a raster and its copy moved by (3, -2) inside the tile."""
    def find(rows: pd.DataFrame) -> pd.DataFrame:
        image = _image(rows, 16)
        i, j = shift(image, np.roll(image, (3, -2), (0, 1)))
        return pd.DataFrame({"tx": rows["tx"].iloc[:1], "ty": rows["ty"].iloc[:1], "di": [i], "dj": [j]})

    return tiles(surface(spark, sf_dir), 16).groupBy("tx", "ty").applyInPandas(find, "tx long, ty long, di long, dj long")


@query("r11_most_specific_zone", """
WITH z AS (SELECT p_partkey AS id, p_size AS x0, p_size + 1 + p_partkey % 6 AS x1, p_partkey % 4 AS rank FROM part),
q AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS ix FROM lineitem), h AS (SELECT q.ix, z.id, row_number() OVER (PARTITION BY q.ix ORDER BY z.rank DESC, z.x1 - z.x0, z.id) AS n FROM q JOIN z ON q.ix >= z.x0 AND q.ix < z.x1)
SELECT ix, id FROM h WHERE n = 1
""")
def most_specific_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of highest rank over a cell, the narrowest of those."""
    z = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("x0"), (1 + F.col("p_partkey") % 6).alias("width"), (F.col("p_partkey") % 4).alias("rank"))
    cells = z.withColumn("ix", F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("width") - 1)))
    places = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("ix")).distinct()
    best = places.join(cells, "ix").groupBy("ix").agg(F.min(F.struct((-F.col("rank")).alias("r"), "width", F.col("p_partkey").alias("id"))).alias("m"))
    return best.select("ix", "m.id")
