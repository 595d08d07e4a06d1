"""Readers of files: OSM XML, GeoJSON, drifting CSV, traces and road descriptions; grids of tiles and pages."""

from __future__ import annotations

import re
import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import last_wins

TAG = "tag array<struct<_k:string,_v:string>>"
OSM = {
    "node": f"_id long, _lon double, _lat double, {TAG}",
    "way": f"_id long, nd array<struct<_ref:long>>, {TAG}",
    "relation": f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {TAG}",
}


def tags_map(column: str = "tag") -> Column:
    """(_k, _v) pairs as a map; a key that comes twice keeps its last value."""
    pairs = F.coalesce(F.col(column), F.array().cast("array<struct<_k:string,_v:string>>"))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["_k"]), F.create_map(p["_k"], p["_v"])))
    return last


def osm_xml(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Nodes, ways and relations of OSM XML tiles; an element in several tiles is taken from the last file."""
    out = {}
    for kind, schema in OSM.items():
        rows = spark.read.format("xml").option("rowTag", kind).schema(schema).load(path).withColumn("_file", F.input_file_name()).filter("_id IS NOT NULL")
        one = last_wins(rows, ["_id"], [F.col("_file")])
        tags = tags_map().alias("tags")
        if kind == "node":
            out[kind] = one.select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), tags)
        elif kind == "way":
            out[kind] = one.select(F.col("_id").alias("id"), F.col("nd._ref").alias("refs"), tags)
        else:
            members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
            out[kind] = one.select(F.col("_id").alias("id"), members.alias("members"), tags)
    return out


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features with a geometry: type, coordinates as JSON text, properties as a map of texts."""
    schema = "features array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.filter("f.geometry IS NOT NULL").select("f.id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def delimiter(header: str, candidates: str = ";,\t|") -> str:
    """The candidate that the header has most of; ties go to the first."""
    return max(candidates, key=lambda c: (header.count(c), -candidates.index(c)))


def drifting_csv(spark: SparkSession, paths: Iterable[str], encoding: str = "UTF-8") -> DataFrame:
    """CSV files whose delimiter and columns differ by file: names trimmed and in lower case, missing columns null."""
    out = None
    for path in paths:
        head = spark.read.text(path).first()
        sep = delimiter(head[0] if head else ",")
        df = spark.read.option("header", True).option("encoding", encoding).csv(path, sep=sep)
        df = df.toDF(*[c.strip().lower() for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file to read")
    return out


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Simulation traces: time, vehicle, place and speed, from XML time steps (compressed or not)."""
    schema = "_time double, vehicle array<struct<_id:string,_x:double,_y:double,_speed:double,_lane:string>>"
    steps = spark.read.format("xml").option("rowTag", "timestep").schema(schema).load(path)
    return steps.select(F.col("_time").alias("t"), F.explode("vehicle").alias("v")).select("t", F.col("v._id").alias("vehicle"), F.col("v._x").alias("x"), F.col("v._y").alias("y"), F.col("v._speed").alias("speed"), F.col("v._lane").alias("lane"))


def roads(spark: SparkSession, path: str) -> DataFrame:
    """Roads of an OpenDRIVE file: id, length and reference-line pieces."""
    schema = "_id string, _length double, _junction string, planView struct<geometry:array<struct<_s:double,_x:double,_y:double,_hdg:double,_length:double>>>"
    r = spark.read.format("xml").option("rowTag", "road").schema(schema).load(path)
    return r.select(F.col("_id").alias("road"), F.col("_length").alias("length"), F.col("_junction").alias("junction"), F.col("planView.geometry").alias("pieces"))


FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".geojson": geojson,
    ".json": lambda s, p: s.read.json(p),
    ".csv": lambda s, p: drifting_csv(s, [p]),
    ".parquet": lambda s, p: s.read.parquet(p),
    ".orc": lambda s, p: s.read.orc(p),
    ".xodr": roads,
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """By the file name's ending."""
    for ending, reader in FORMATS.items():
        if path.endswith(ending):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}")


def tile_grid(box: tuple[float, float, float, float], size: float) -> list[tuple[float, float, float, float]]:
    """Tiles aligned on multiples of size that cover a box, row by row from the south-west."""
    first = [int(v // size) for v in box[:2]]
    last = [int(-(-v // size)) for v in box[2:]]
    return [(i * size, j * size, (i + 1) * size, (j + 1) * size) for j in range(first[1], last[1]) for i in range(first[0], last[0])]


def quadtree(fetch: Callable[[tuple], list[dict]], box: tuple[float, float, float, float], limit: int, depth: int = 14) -> dict:
    """All items of a limited search, by id: a full answer is split in four. The last answer of an id counts."""
    found: dict = {}
    todo = [(box, 0)]
    while todo:
        b, d = todo.pop()
        items = fetch(b)
        if len(items) >= limit and d < depth:
            mx, my = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
            todo += [((x0, y0, x1, y1), d + 1) for x0, x1 in ((b[0], mx), (mx, b[2])) for y0, y1 in ((b[1], my), (my, b[3]))]
        else:
            found |= {i["id"]: i for i in items}
    return found


def retried(call: Callable, tries: int = 5, base: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; after an OSError it waits base, 2 base, 4 base ... and tries again."""
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k == tries - 1:
                raise
            sleep(base * 2**k)


def promoted(df: DataFrame, properties: str, names: dict[str, T.DataType]) -> DataFrame:
    """Typed columns from a map of texts; a text that does not fit its type is null."""
    return df.withColumns({n: F.col(properties)[n].try_cast(t) for n, t in names.items()})


def read_json(path: str, tries: int = 3, wait: float = 0.2):
    """A JSON file that another process may be rewriting: read again when it is cut off or gone."""
    for attempt in range(tries):
        try:
            with open(path, encoding="utf-8") as f:
                return json.load(f)
        except (json.JSONDecodeError, FileNotFoundError):
            if attempt == tries - 1:
                raise
            time.sleep(wait * 2**attempt)


def scalar_value(text: str):
    """A plain scalar: quoted text, null, boolean, number, list in brackets, or text."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1].replace("''", "'") if text[0] == "'" else json.loads(text)
    if text.startswith("[") and text.endswith("]"):
        return [scalar_value(x) for x in text[1:-1].split(",") if x.strip()]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def read_yaml(text: str):
    """A subset of YAML: nested mappings and lists by indentation, scalars, comments. Anything else is an error."""
    lines = []
    for number, raw in enumerate(text.splitlines(), 1):
        bare = re.sub(r"""^((?:[^#'"]|'[^']*'|"[^"]*")*?)(?:^|\s)#.*$""", r"\1", raw).rstrip()
        if bare.strip() and bare.strip() != "---":
            if "\t" in bare[: len(bare) - len(bare.lstrip())]:
                raise ValueError(f"line {number}: a tab indents")
            lines.append((len(bare) - len(bare.lstrip()), bare.lstrip(), number))

    def pair(body: str, number: int) -> tuple[str, str]:
        m = re.fullmatch(r"""("[^"]*"|'[^']*'|[^:]+?)\s*:(?:\s+(.*))?""", body)
        if not m:
            raise ValueError(f"line {number}: neither a key nor an item")
        return str(scalar_value(m[1])), m[2] or ""

    def block(at: int, indent: int):
        listed = lines[at][1].startswith("- ") or lines[at][1] == "-"
        out = [] if listed else {}
        while at < len(lines) and lines[at][0] == indent:
            _, body, number = lines[at]
            if listed != (body.startswith("- ") or body == "-"):
                raise ValueError(f"line {number}: a list and a mapping are mixed")
            if listed:
                rest = body[1:].strip()
                if re.match(r"""(?:"[^"]*"|'[^']*'|[^:\['"]+?)\s*:(?:\s|$)""", rest):  # a mapping starts on the item's line
                    lines[at] = (indent + len(body) - len(rest), rest, number)
                    value, at = block(at, lines[at][0])
                else:
                    value, at = inner(rest, at, indent)
                out.append(value)
            else:
                key, rest = pair(body, number)
                if key in out:
                    raise ValueError(f"line {number}: {key} is there twice")
                out[key], at = inner(rest, at, indent)
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError(f"line {lines[at][2]}: unexpected indentation")
        return out, at

    def inner(rest: str, at: int, indent: int):
        if rest:
            return scalar_value(rest), at + 1
        at += 1
        if at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ") and not lines[at - 1][1].startswith("-")):
            return block(at, lines[at][0])
        return None, at

    if not lines:
        return None
    value, at = block(0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"line {lines[at][2]}: unexpected indentation")
    return value
