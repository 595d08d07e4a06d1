"""Operators that SQL cannot express, against brute force, invariants and small cases."""

import itertools
import json
import math
import random
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.functions import laws, lines
from tessella.operators import graph, joins, raster, rules, simulation, spatial, windows
from tessella.sources import paged, pbf, readers, sinks


def test_near_pairs_equal_brute_force(spark):
    rnd = random.Random(1)
    a = [(i, rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for i in range(60)]
    b = [(i, rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for i in range(60)]
    left, right = spark.createDataFrame(a, "i long, x double, y double"), spark.createDataFrame(b, "j long, u double, v double")
    got = {(r.i, r.j) for r in spatial.near_pairs(left, right, ["x", "y"], ["u", "v"], 1.7).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 1.7**2}
    near = {r.i: r.j for r in spatial.nearest(left, right, "i", "j", ["x", "y"], ["u", "v"], 1.7).collect()}
    for i, j in near.items():
        d = lambda k: ((a[i][1] - b[k][1]) ** 2 + (a[i][2] - b[k][2]) ** 2, k)  # noqa: B023, E731
        assert j == min(range(60), key=d)


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in linked}


def test_components_without_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.components(none, spark.createDataFrame([(3,)], "node long")).collect() == [(3, 3)]


def test_shortest_paths(spark):
    e = [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (3, 0, 1), (4, 5, 1)]
    got = {r.node: r.dist for r in graph.shortest(spark.createDataFrame(e, "src long, dst long, len long"), spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {0: 0, 1: 3, 2: 1, 3: 8}


def test_assignment_is_optimal():
    rnd = random.Random(3)
    for n, m in [(1, 1), (3, 5), (5, 3), (4, 4), (0, 2)]:
        cost = [[rnd.choice([None, rnd.randrange(1, 50)]) for _ in range(m)] for _ in range(n)]
        pairs = simulation.assign(cost, 1000)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        if n and m:
            wide = cost if n <= m else [list(c) for c in zip(*cost)]
            best = min(sum(1000 if wide[i][j] is None else wide[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(wide[0])), len(wide)))
            got = sum(cost[i][j] for i, j in pairs) + 1000 * (min(n, m) - len(pairs))
            assert got == best


def test_asof_takes_the_last_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 3)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 6, 60), ("b", 10, 90)], "k string, u long, v long")
    assert {r.id: r.v for r in joins.asof(left, right, "k", "t", "u", ["v"]).collect()} == {1: 50, 2: None, 3: None, 4: None}
    assert {r.id: r.v for r in joins.asof(left, right, "k", "t", "u", ["v"], forward=True).collect()} == {1: 50, 2: 20, 3: 90, 4: None}


def test_runs_and_overlay(spark):
    flags = spark.createDataFrame([("k", i, f) for i, f in enumerate([True, True, False, None, True])], "k string, i long, f boolean")
    got = sorted((r.start, r.stop, r.n) for r in windows.runs(flags, ["k"], ["i"], F.col("f"), "i").collect())
    assert got == [(0, 1, 2), (4, 4, 1)]
    base = spark.createDataFrame([("k", 0, 10, "base")], "k string, s0 long, s1 long, attr string")
    over = spark.createDataFrame([("k", 2, 4, "x"), ("k", 3, 5, "y")], "k string, s0 long, s1 long, attr string")
    got = sorted((r.a, r.b, r.attr) for r in windows.overlay(base, over, "k").collect())
    assert got == [(0, 2, "base"), (2, 3, "x"), (3, 4, "y"), (4, 5, "y"), (5, 10, "base")]


def test_holes_are_filled(spark):
    cells = spark.createDataFrame([(x, y, 7 if x == 0 else None) for x in range(4) for y in range(3)], "ix long, iy long, z long")
    assert {r.z for r in raster.fill(cells).collect()} == {7}


def test_nearest_fill_and_matching(spark):
    cells = spark.createDataFrame([(x, 0, {0: 5, 6: 2}.get(x)) for x in range(7)], "ix long, iy long, z long")
    assert [r.z for r in raster.fill_nearest(cells).orderBy("ix").collect()] == [5, 5, 5, 2, 2, 2, 2]
    rng = np.random.default_rng(1)
    image = rng.normal(size=(16, 16))
    assert raster.shift(image, np.roll(image, (3, -2), (0, 1))) == (3, -2)
    i, j, score = raster.best_match(image, image[4:8, 5:10] * 2 + 1)
    assert (i, j) == (4, 5) and abs(score - 1) < 1e-9


def test_lines():
    zigzag = [(x, 0.1 * (x % 2)) for x in range(11)]
    assert lines.simplified(zigzag, 0.2) == [zigzag[0], zigzag[-1]]
    assert lines.simplified([(0, 0), (5, 3), (10, 0)], 1) == [(0, 0), (5, 3), (10, 0)]
    assert set(lines.hull([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)])) == {(0, 0), (4, 0), (4, 4), (0, 4)}
    assert lines.at_abscissa([(0, 0), (3, 4)], 2.5) == (1.5, 2.0)
    assert len(lines.resampled([(0, 0), (10, 0)], 2)) == 6
    assert lines.offset([(0, 0), (10, 0)], 1) == [(0, 1), (10, 1)]


@pytest.mark.parametrize("law,params", [("normal", {"mean": 2, "std": 3}), ("lognormal", {"mean": 2, "std": 1}), ("logistic", {"mean": 1, "scale": 2}), ("uniform", {"low": 1, "high": 4}), ("exponential", {"mean": 2})])
def test_quantile_inverts_cdf(law, params):
    p = np.linspace(0.01, 0.99, 25)
    assert np.allclose(laws.cdf(law, params, laws.quantile(law, params, p)), p, atol=1e-6)


def test_queue_does_not_collide():
    for seed in range(3):
        rng = np.random.default_rng(seed)
        trace = simulation.simulate(7.0, rng.uniform(0.9, 2.0, 8), rng.uniform(11, 17, 8), 20.0)
        place = trace.pivot(index="step", columns="vehicle", values="s").to_numpy()
        assert (place[:, :-1] - place[:, 1:] > 5.0).all()
        assert (np.diff(place, axis=0) >= 0).all()


def test_critical_gap_recovers_the_law():
    rng = np.random.default_rng(5)
    want = np.exp(rng.normal(math.log(5), 0.3, 400))
    found = simulation.critical_gap(want * rng.uniform(1.01, 1.4, 400), want * rng.uniform(0.6, 0.99, 400))
    assert abs(found[0] - want.mean()) < 0.5
    assert simulation.critical_gap(np.ones(3), np.ones(3)) is None


def test_schema_errors():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string", "pattern": "^x"}}}}
    assert rules.schema_errors({"a": 1, "b": ["x1"]}, schema) == []
    assert rules.schema_errors({"b": ["y"]}, schema) == ["$.a: missing", "$.b[0]: does not match the pattern"]
    assert rules.schema_errors({"a": 0}, schema) == ["$.a: below 1"]
    assert rules.schema_errors(3, {"anyOf": [{"type": "string"}, {"minimum": 5}]}) == ["$: fits none of the choices"]


def test_osm_xml(spark, tmp_path):
    tile = '<osm><node id="1" lat="45.1" lon="5.2"><tag k="highway" v="{}"/></node><node id="2" lat="45" lon="5"/><way id="7"><nd ref="1"/><nd ref="2"/><tag k="name" v="A"/></way><relation id="9"><member type="way" ref="7" role="outer"/></relation></osm>'
    for name, v in (("a.osm", "stop"), ("b.osm", "crossing")):
        (tmp_path / name).write_text(tile.format(v))
    got = readers.osm_xml(spark, str(tmp_path))
    assert {r.id: r.tags for r in got["node"].collect()} == {1: {"highway": "crossing"}, 2: {}}
    assert [(r.id, r.refs, r.tags) for r in got["way"].collect()] == [(7, [1, 2], {"name": "A"})]
    assert got["relation"].first().members[0].ref == 7


def message(*parts):
    def varint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    out = b""
    for n, v in parts:
        out += varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v
    return out, varint


def test_pbf(spark, tmp_path):
    _, varint = message()
    build = lambda *p: message(*p)[0]
    zig = lambda v: varint(v << 1 if v >= 0 else (-v << 1) - 1)
    texts = build((1, b""), (1, b"highway"), (1, b"stop"))
    dense = build((1, zig(10) + zig(5)), (8, zig(451000000) + zig(-1000)), (9, zig(52000000) + zig(10)), (10, varint(1) + varint(2) + varint(0) + varint(0)))
    way = build((1, 77), (2, varint(1)), (3, varint(2)), (8, zig(10) + zig(5)))
    body = build((1, texts), (2, build((2, dense), (3, way))))
    packed = build((2, len(body)), (3, zlib.compress(body)))
    path = tmp_path / "x.pbf"
    with open(path, "wb") as f:
        for kind, blob in ((b"OSMHeader", build((1, b""))), (b"OSMData", packed)):
            head = build((1, kind), (3, len(blob)))
            f.write(struct.pack(">I", len(head)) + head + blob)
    spark.dataSource.register(pbf.PbfSource)
    rows = sorted(map(tuple, spark.read.format("osm_pbf").load(str(path)).collect()), key=lambda r: r[:2])
    assert [r[:2] for r in rows] == [("node", 10), ("node", 15), ("way", 77)]
    assert abs(rows[0][3] - 45.1) < 1e-9 and abs(rows[0][2] - 5.2) < 1e-9 and rows[0][5] == {"highway": "stop"}
    assert rows[2][4] == [10, 15] and rows[2][5] == {"highway": "stop"}


def test_geojson_csv_and_dispatch(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"features": [{"id": "1", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"n": 3}}, {"id": "2", "geometry": None, "properties": {}}]}))
    (tmp_path / "a.csv").write_text("Num; Year\n1;2018\n")
    (tmp_path / "b.csv").write_text("num,Lat\n2,45.5\n")
    f = readers.read(spark, str(tmp_path / "a.geojson")).collect()
    assert [(r.id, r.kind, r.coordinates, r.properties) for r in f] == [("1", "Point", "[1, 2]", {"n": "3"})]
    got = readers.drifting_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(map(tuple, got.select("num", "year", "lat").collect())) == [("1", "2018", None), ("2", None, "45.5")]


def test_pages_cells_and_retries(spark):
    assert len(readers.tile_grid((5, 5, 25, 15), 10)) == 6
    data = [{"id": i, "x": i / 10} for i in range(100)]
    inside = lambda b: [d for d in data if b[0] <= d["x"] < b[2]][:30]
    assert set(readers.quadtree(inside, (0, 0, 10, 10), 30)) == set(range(100))
    fetch = lambda cell, start, count: [{"id": i, "v": float(cell[0])} for i in range(start, min(start + count, 25))]
    got = paged.paged(spark, fetch, [(0, 0, 1, 1), (1, 0, 2, 1)], "id long, v double", count=10)
    assert sorted((r.id, r.v) for r in got.collect()) == [(i, 1.0) for i in range(25)]
    waits, calls = [], iter([OSError(), OSError(), 7])

    def call():
        x = next(calls)
        if isinstance(x, OSError):
            raise x
        return x

    assert readers.retried(call, sleep=waits.append) == 7 and waits == [1.0, 2.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.25, 3.0, "b"), (1, 0.125, 2.0, "a")], "id long, x double, y double, name string")
    assert [json.loads(r.value)["id"] for r in sinks.geojson_lines(df, "id", "x", "y", ["name"], 2).collect()] == ["1", "2"]
    sinks.write_layers(df, str(tmp_path / "layers"), "name")
    assert sorted(p.name for p in (tmp_path / "layers").iterdir() if p.is_dir()) == ["name=a", "name=b"]
    digests = lambda d: sorted(map(tuple, sinks.manifest(d, "name", ["id", "x"]).collect()))
    assert digests(df) == digests(df.orderBy("id"))
    assert sinks.markdown(df.select("id").orderBy("id")).splitlines()[2:] == ["1", "2"]


def test_every_customer_is_simulated(spark, small):
    from tessella.catalog import QUERIES

    out = QUERIES["t06_micro_simulation"](spark, small)
    assert out.count() == spark.read.parquet(f"{small}/customer.parquet").count() == out.select("corridor", "block", "vehicle").distinct().count()


def greedy(rows, clash):
    """A pass from best to worst that keeps what clashes with nothing kept."""
    kept = []
    for r in rows:
        if not any(clash(r, k) for k in kept):
            kept.append(r)
    return kept


def test_best_first_by_brute_force(spark, small):
    from tessella.catalog import QUERIES

    parts = spark.read.parquet(f"{small}/part.parquet").selectExpr("p_partkey", "p_brand", "CAST(floor(p_retailprice * 100) AS BIGINT) x", "p_size").collect()
    want = greedy(sorted(parts, key=lambda r: (r.p_size, r.p_partkey)), lambda a, b: a.p_brand == b.p_brand and abs(a.x - b.x) <= 100)
    assert {r.p_partkey for r in QUERIES["x04_best_first_within_radius"](spark, small).collect()} == {r.p_partkey for r in want}
    rank = {"purchase": 0, "click": 1}
    events = spark.read.parquet(f"{small}/events.parquet").selectExpr("event_id", "user_id", "event_type", "unix_micros(CAST(ts AS timestamp)) t").collect()
    events.sort(key=lambda r: (rank.get(r.event_type, 2), r.t, r.event_id))
    want = greedy(events, lambda a, b: a.user_id == b.user_id and abs(a.t - b.t) < 21_600_000_000)
    assert {r.event_id for r in QUERIES["o07_spaced_selection"](spark, small).collect()} == {r.event_id for r in want}


def test_first_choices_of_random_clashes(spark):
    rnd = random.Random(21)
    pairs = {(a, b) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(150)) if a < b}
    got = spatial.first_choices(spark.range(60).withColumnRenamed("id", "key"), spark.createDataFrame(sorted(pairs), "better long, worse long"))
    assert {r.key for r in got.collect()} == set(greedy(range(60), lambda a, b: (b, a) in pairs))


def test_greedy_cover_by_brute_force(spark, small):
    from tessella.catalog import QUERIES

    li = spark.read.parquet(f"{small}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()
    got = sorted(QUERIES["o06_greedy_cover"](spark, small).collect(), key=lambda r: (r.zone, r.place))
    for zone in {r.l_suppkey % 25 for r in li}:
        done, rest, want = set(), {r.l_suppkey for r in li if r.l_suppkey % 25 == zone}, []
        while rest:
            gain = {s: len({r.l_partkey for r in li if r.l_suppkey == s} - done) for s in rest}
            best = min(rest, key=lambda s: (-gain[s], s))
            if not gain[best]:
                break
            want.append((best, gain[best]))
            done |= {r.l_partkey for r in li if r.l_suppkey == best}
            rest.remove(best)
        assert [(r.l_suppkey, r.gain) for r in got if r.zone == zone] == want


def test_running_sums_over_ranges(spark):
    from tessella.operators import ordering

    rnd = random.Random(22)
    rows = [(k, rnd.randrange(9), rnd.randrange(5)) for k in range(500)]
    got = {r.id: r.before for r in ordering.running(spark.createDataFrame(rows, "id long, a long, v long").repartition(7), ["a", F.col("id").desc()], F.col("v"), "before").collect()}
    at = 0
    for k, _, v in sorted(rows, key=lambda r: (r[1], -r[0])):
        assert got[k] == at
        at += v
    assert ordering.running(spark.createDataFrame([], "a long"), ["a"], F.lit(1), "n").count() == 0


@pytest.mark.parametrize("side", [3, 64])
def test_water_level_by_relaxation(spark, side):
    rnd = random.Random(23)
    z = {(i, j): rnd.randrange(30) for i in range(14) for j in range(11) if rnd.random() > 0.03}
    w = {at: h if any((at[0] + a, at[1] + b) not in z for a, b in raster.EIGHT) else 1 << 40 for at, h in z.items()}
    changed = True
    while changed:
        changed = False
        for at in z:
            low = max(z[at], min(w.get((at[0] + a, at[1] + b), 1 << 40) for a, b in raster.EIGHT))
            if low < w[at]:
                w[at], changed = low, True
    cells = spark.createDataFrame([(*at, h) for at, h in z.items()], "ix long, iy long, z long")
    assert {(r.ix, r.iy): r.level for r in raster.water_level(cells, side).collect()} == w


def test_smooth_surface_solves_its_equations():
    rnd = np.random.default_rng(1)
    shape, lam = (5, 6), 0.3
    fixed, z, target = rnd.random(shape) < 0.3, rnd.normal(size=shape), rnd.normal(size=shape)
    n = fixed.size
    a, b = np.eye(n) * lam, lam * target.ravel()
    for i, j in itertools.product(*map(range, shape)):
        for di, dj in ((0, 1), (1, 0)):
            if i + di < shape[0] and j + dj < shape[1]:
                p, q = i * shape[1] + j, (i + di) * shape[1] + j + dj
                a[p, p] += 1
                a[q, q] += 1
                a[p, q] -= 1
                a[q, p] -= 1
    f = fixed.ravel()
    a[f], b[f] = np.eye(n)[f], z.ravel()[f]
    assert np.allclose(raster.smooth(fixed, z, target, lam).ravel(), np.linalg.solve(a, b), atol=1e-7)


def test_failing_rules_stop_no_other(spark, small, monkeypatch):
    def late(spark, sf_dir):
        rows = spark.range(3)
        return rows, F.col("id"), F.raise_error(F.lit("on a row")).cast("boolean"), F.col("id")

    def early(spark, sf_dir):
        return spark.range(3).select("missing"), F.col("id"), F.lit(True), F.col("id")

    one = next(iter(rules.RULES.values()))
    made = {n: type(one)(**{**vars(one), "name": n, "check": c}) for n, c in (("late", late), ("early", early))}
    monkeypatch.setattr(rules, "RULES", {**made, one.name: one})
    got = {r.rule: (r.n, r.note) for r in rules.results(spark, small).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.max("family").alias("note")).collect()}
    assert got["late"][0] == got["early"][0] == 1 and got["late"][1].startswith("not run") and got["early"][1].startswith("not run")
    assert got[one.name][0] > 100


def test_pages_with_a_filter_of_the_service(spark):
    asked = "kind IN ('a', 'it''s') AND v >= 3"

    def fetch(cell, start, count, where):
        assert where == asked
        rows = [{"id": i, "v": float(i), "kind": "a" if i % 2 else "b"} for i in range(25)]  # the service is loose
        return rows[start : start + count]

    got = paged.paged(spark, fetch, [(0, 0, 1, 1)], "id long, v double, kind string", count=10, pushed=[("kind", "in", ["a", "it's"]), ("v", ">=", 3)], residual="id < 20")
    assert sorted(r.id for r in got.collect()) == list(range(3, 20, 2))


def test_kept_rows_pictures_and_types(spark, tmp_path):
    df = spark.createDataFrame([(k, f'a<"{k}"&', k / 3) for k in range(10)], "id long, name string, v double")
    sinks.write_kept(df, spark.range(0, 10, 3), "id", f"{tmp_path}/kept")
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/kept").collect()) == [0, 3, 6, 9]
    lines = [r.value for r in sinks.vehicle_types(df.limit(2), "id", ["name", "v"]).collect()]
    assert lines[1] == '<vType id="1" name="a&lt;&quot;1&quot;&amp;" v="0.333"/>'
    cells = spark.createDataFrame([(i, j, float(i * 10 + j)) for i in range(6) for j in range(4)], "ix long, iy long, z double")
    found = {(r.tx, r.ty): bytes(r.png) for r in sinks.pictures(cells, 4, 0.0, 51.0).collect()}
    assert set(found) == {(0, 0), (1, 0)}
    body = found[0, 0]
    assert body[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", body[16:24]) == (4, 4)
    at = body.index(b"IDAT")
    grey = zlib.decompress(body[at + 4 : at + 4 + struct.unpack(">I", body[at - 4 : at])[0]])
    assert [grey[k * 5 + 1] for k in range(4)] == [15, 10, 5, 0] and grey[4] == 165


def test_geotiff_tags():
    values = np.arange(12, dtype=float).reshape(3, 4)
    raw = sinks.geotiff(values, 100.0, 200.0, 0.5, 2154)
    n = struct.unpack_from("<H", raw, 8)[0]
    tags = {t: (kind, m, v) for t, kind, m, v in (struct.unpack_from("<HHII", raw, 10 + 12 * k) for k in range(n))}
    assert tags[256][2] == 4 and tags[257][2] == 3 and list(tags) == sorted(tags)
    assert np.array_equal(np.frombuffer(raw, "<f4", 12, tags[273][2]).reshape(3, 4), values)
    assert struct.unpack_from("<3d", raw, tags[33550][2]) == (0.5, 0.5, 0.0) and struct.unpack_from("<6d", raw, tags[33922][2])[3:5] == (100.0, 200.0)
    assert struct.unpack_from("<16H", raw, tags[34735][2])[-1] == 2154


def test_yaml_subset():
    text = """
# a description
name: "R 01"   # said
size: 3
width: 3.5
open: true
none:
list: [1, a, 'b c']
roads:
  - id: r1
    lanes: [2, 1]
    ends:
      from: a
      to: b
  - id: r2
tags:
- x
- 'it''s # not a comment'
"""
    assert readers.read_yaml(text) == {
        "name": "R 01", "size": 3, "width": 3.5, "open": True, "none": None, "list": [1, "a", "b c"],
        "roads": [{"id": "r1", "lanes": [2, 1], "ends": {"from": "a", "to": "b"}}, {"id": "r2"}], "tags": ["x", "it's # not a comment"],
    }
    assert readers.read_yaml("") is None and readers.read_yaml("- 1\n- b") == [1, "b"]
    for bad in ("a: 1\n   b: 2", "a: 1\na: 2", "a: 1\n- b", "\ta: 1", "just text"):
        with pytest.raises(ValueError, match="line"):
            readers.read_yaml(bad)


def test_json_under_rewrite(tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"a": 1')
    with pytest.raises(json.JSONDecodeError):
        readers.read_json(str(path), 2, 0.01)
    import threading

    threading.Timer(0.15, lambda: path.write_text('{"a": 1}')).start()
    assert readers.read_json(str(path), 6, 0.05) == {"a": 1}


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{folder}/{name}.parquet")
    return str(folder)


def test_areas_meet_once_and_stay_with_the_executors(spark, tmp_path):
    """Repeated rows give a pair each, as in SQL; no side is broadcast, however small the file is."""
    from oracle import database, rows
    from tessella.catalog import QUERIES, SQL

    rnd = random.Random(5)
    parts = [(k // 2, rnd.choice(["a", "b", None]), rnd.randrange(6), rnd.uniform(0, 9)) for k in range(120)]
    folder = written(spark, tmp_path, part=(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double"))
    df = QUERIES["j25_overlapping_areas"](spark, folder)
    assert rows(df.toArrow()) == rows(database(folder).execute(SQL["j25_overlapping_areas"]).to_arrow_table())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_saved_tables_keep_no_estimate(spark):
    """The estimate of a join of itself doubles its digits; that of a loop must not grow with its rounds."""
    df = spark.range(3).withColumnRenamed("id", "k")
    for _ in range(8):
        df = graph.saved(df.join(df.select("k"), "k").distinct())
    assert df.count() == 3 and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 130


def test_group_bands_without_pairs(spark, tmp_path):
    from oracle import database, rows
    from tessella.catalog import QUERIES, SQL

    rnd = random.Random(6)
    odd = [(900, None), (901, None), (902, 59.99), (903, 60.0), (904, 119.99), (905, 180.0), (906, -0.01), (3, 9000.0), (3, 8000.0), (950, 8030.0), (951, 9060.0), (952, 9120.01)]
    bands = [(k, round(rnd.uniform(-900, 9000), 2)) for k in range(60)] + odd
    folder = written(spark, tmp_path, supplier=(bands, "s_suppkey long, s_acctbal double"))
    got = QUERIES["g16_group_bands"](spark, folder)
    assert rows(got.toArrow()) == rows(database(folder).execute(SQL["g16_group_bands"]).to_arrow_table())


def joined(df):
    """Rows that the largest join of a query makes; the query is run."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    left = [plan]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        left += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in name else [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_project_on_line_without_pairs(spark, tmp_path):
    """Vertices at one place, lines of one vertex, missing places, points beyond the ends; a join row a point."""
    from oracle import database, rows
    from tessella.catalog import QUERIES, SQL

    rnd = random.Random(7)
    vertices = [(k, k % 3, float(rnd.randrange(40))) for k in range(40)] + [(90, 0, None), (91, 5, 1.0), (92, 6, 2.0), (93, 6, 2.0), (94, 7, None), (95, 7, 1.0)]
    points = [(k, k % 8, rnd.uniform(-20, 60)) for k in range(400)] + [(900, 0, None), (901, 6, None)]
    folder = written(spark, tmp_path, supplier=(vertices, "s_suppkey long, s_nationkey int, s_acctbal double"), customer=(points, "c_custkey long, c_nationkey int, c_acctbal double"))
    df = QUERIES["g03_project_on_line"](spark, folder)
    assert joined(df) <= len(points)
    assert rows(df.toArrow()) == rows(database(folder).execute(SQL["g03_project_on_line"]).to_arrow_table())


def test_best_first_of_many_at_one_place(spark, tmp_path, monkeypatch):
    """As a plain pass gives it, with a pair for places only: copies of a place make none."""
    from tessella.catalog import QUERIES

    rnd = random.Random(8)
    parts = [(k, rnd.choice("ab"), rnd.randrange(1, 9), rnd.randrange(60) / 4) for k in range(900)] + [(950, None, 1, 1.0), (951, "a", 1, None), (952, "a", None, 3.0)]
    folder = written(spark, tmp_path, part=(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double"))
    seen, pairs = [], spatial.band_pairs
    monkeypatch.setattr(spatial, "band_pairs", lambda *a: seen.append(pairs(*a)) or seen[-1])
    got = {r.p_partkey for r in QUERIES["x04_best_first_within_radius"](spark, folder).collect()}
    order = lambda r: (r[2] is not None, r[2], r[0])
    clash = lambda a, b: a[1] is not None and a[1] == b[1] and a[3] is not None and b[3] is not None and abs(math.floor(a[3] * 100) - math.floor(b[3] * 100)) <= 100
    assert got == {r[0] for r in greedy(sorted(parts, key=order), clash)}
    assert seen[0].count() <= 120 * 4
