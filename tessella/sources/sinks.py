"""Writers: layers, deterministic lines, upserts, manifests and reports."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_layers(df: DataFrame, path: str, layer: str = "layer", fmt: str = "parquet") -> None:
    """A folder a layer."""
    df.write.mode("overwrite").partitionBy(layer).format(fmt).save(path)


def rounded(x: Column, digits: int) -> Column:
    """Half to even."""
    return F.bround(x, digits)


def geojson_lines(df: DataFrame, id_col: str, x: str, y: str, properties: list[str], digits: int = 3) -> DataFrame:
    """A feature a line, as text in a column value, keys in a fixed order, sorted by id."""
    place = F.concat(F.lit("["), rounded(F.col(x), digits).cast("string"), F.lit(","), rounded(F.col(y), digits).cast("string"), F.lit("]"))
    props = F.to_json(F.struct(*sorted(properties)))
    line = F.concat(F.lit('{"type":"Feature","id":"'), F.col(id_col).cast("string"), F.lit('","geometry":{"type":"Point","coordinates":'), place, F.lit('},"properties":'), props, F.lit("}"))
    return df.select(id_col, line.alias("value")).orderBy(id_col).select("value")


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def manifest(df: DataFrame, layer: str, columns: list[str]) -> DataFrame:
    """By layer: rows and a digest that does not depend on their order (the sum of the rows' 64-bit hashes)."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.groupBy(layer).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.sum(row).cast("string"), 256).alias("digest"))


def markdown(rows: DataFrame, limit: int = 50) -> str:
    """A table of a small result, the first rows of it."""
    names = rows.columns
    body = [" | ".join("" if v is None else str(v) for v in r) for r in rows.limit(limit).collect()]
    return "\n".join([" | ".join(names), " | ".join(["-"] * len(names)), *body])


def write_kept(df: DataFrame, keep: DataFrame, key: str, path: str) -> None:
    """Rows whose key is kept, a JSON object a line."""
    df.join(keep.select(key), key, "left_semi").write.mode("overwrite").json(path)


def png(values: np.ndarray, lo: float, hi: float) -> bytes:
    """A grey picture of values from lo (black) to hi (white); missing values are black."""
    grey = np.nan_to_num(np.clip((values - lo) / (hi - lo), 0, 1) * 255).round().astype(np.uint8)
    lines = b"".join(b"\0" + row.tobytes() for row in grey)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def geotiff(values: np.ndarray, x0: float, y1: float, step: float, epsg: int) -> bytes:
    """A raster of 32-bit floats in one strip; (x0, y1) is its upper left corner."""
    height, width = values.shape
    body = values.astype("<f4").tobytes()
    doubles = struct.pack("<9d", step, step, 0.0, 0.0, 0.0, 0.0, x0, y1, 0.0)  # pixel scale, then tie point
    keys = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 32), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 0), (277, 3, 1, 1), (278, 4, 1, height), (279, 4, 1, len(body)), (339, 3, 1, 3), (33550, 12, 3, 0), (33922, 12, 6, 24), (34735, 3, 16, 72)]
    data = 8 + 2 + 12 * len(tags) + 4
    out = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    for tag, kind, n, value in tags:
        value += data if tag in (33550, 33922, 34735) else 0
        out += struct.pack("<HHII", tag, kind, n, data + 104 if tag == 273 else value)
    return out + struct.pack("<I", 0) + doubles + keys + body


def pictures(cells: DataFrame, size: int, lo: float, hi: float) -> DataFrame:
    """A PNG for each tile of size x size cells (ix, iy, z): tx, ty, png. Rows of a picture go from high iy to low."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        image = np.full((size, size), np.nan)
        image[size - 1 - rows["iy"].to_numpy() % size, rows["ix"].to_numpy() % size] = rows["z"].to_numpy(float)
        return pd.DataFrame({"tx": rows["tx"].iloc[:1], "ty": rows["ty"].iloc[:1], "png": [png(image, lo, hi)]})

    dealt = cells.select(F.floor(F.col("ix") / size).alias("tx"), F.floor(F.col("iy") / size).alias("ty"), "ix", "iy", "z")
    return dealt.groupBy("tx", "ty").applyInPandas(draw, "tx long, ty long, png binary")


def escaped(x: Column) -> Column:
    """Text as the value of an XML attribute."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def vehicle_types(df: DataFrame, id_col: str, attributes: list[str], digits: int = 3) -> DataFrame:
    """An element of a simulator's type list for each sampled driver, as text in a column value, sorted by id."""
    text = lambda c: escaped((F.bround(F.col(c), digits) if dict(df.dtypes)[c] == "double" else F.col(c)).cast("string"))
    parts = [F.concat(F.lit(f' {c}="'), text(c), F.lit('"')) for c in attributes]
    line = F.concat(F.lit('<vType id="'), text(id_col), F.lit('"'), *[F.coalesce(p, F.lit("")) for p in parts], F.lit("/>"))
    return df.select(id_col, line.alias("value")).orderBy(id_col).select("value")
