"""Scalar functions as column expressions: projections, angles, lines, dates and texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS 84 degrees to Lambert-93 metres: the conformal conic with two standard parallels, in closed form.

    The shape of the cone follows from its defining constants (fixed values): GRS 80, parallels 44 and 49,
    origin 46.5 N 3 E, false origin 700 000, 6 600 000.
    """
    a, f = 6378137.0, 1 / 298.257222101
    p1, p2, p0, l0, x0, y0 = math.radians(44), math.radians(49), math.radians(46.5), math.radians(3), 700000.0, 6600000.0
    e = math.sqrt(2 * f - f * f)
    width = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    iso = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = math.log(width(p1) / width(p2)) / math.log(iso(p1) / iso(p2))
    scale = a * width(p1) / (n * iso(p1) ** n)
    r0 = scale * iso(p0) ** n
    phi = F.radians(lat)
    s = e * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    r = scale * F.pow(t, F.lit(n))
    g = n * (F.radians(lon) - l0)
    return x0 + r * F.sin(g), y0 + r0 - r * F.cos(g)


def angle_gap(a: Column, b: Column, period: float = 360.0) -> Column:
    """Smallest difference of two angles modulo a period."""
    return F.abs(F.pmod(a - b + period / 2, F.lit(period)) - period / 2)


def heading(dx: Column, dy: Column) -> Column:
    """Compass bearing of a step, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def line_length(points: Column) -> Column:
    """Length of an array of (x, y) structs."""
    hop = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(hop, F.lit(0.0), lambda s, d: s + d)


def signed_area2(points: Column) -> Column:
    """Twice the signed area of a ring of (x, y) structs, closed implicitly; positive counter-clockwise."""
    shifted = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, shifted, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0).cast("long"), lambda s, c: s + c.cast("long"))


def clip_interval(x0: Column, dx: Column, low: float, high: float) -> tuple[Column, Column]:
    """Parameters at which x0 + t * dx enters and leaves [low, high]; an empty interval where it never does."""
    a, b = (F.lit(low) - x0) / dx, (F.lit(high) - x0) / dx
    inside = x0.between(low, high)
    enter = F.when(dx == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b))
    leave = F.when(dx == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b))
    return enter, leave


def clip_segment(ax: Column, ay: Column, bx: Column, by: Column, box: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Parameters (t0, t1) of the part of a segment inside a box; null where it misses."""
    ex, lx = clip_interval(ax, bx - ax, box[0], box[2])
    ey, ly = clip_interval(ay, by - ay, box[1], box[3])
    t0, t1 = F.greatest(F.lit(0.0), ex, ey), F.least(F.lit(1.0), lx, ly)
    return F.when(t0 <= t1, t0), F.when(t0 <= t1, t1)


#: Accented small letters and their bare forms.
ACCENTS = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def normalised(text: Column) -> Column:
    """Lower case, without accents, blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), *ACCENTS), r"\s+", " "))


def value_range(text: Column) -> Column:
    """'3,5 m', '2-4', '<5' as a struct (lo, hi); null where there is no number."""
    t = F.regexp_replace(text, ",", ".")
    number = r"([0-9]+(?:\.[0-9]+)?)"
    first = F.regexp_extract(t, number, 1).try_cast("double")
    second = F.regexp_extract(t, rf"{number}\s*(?:-|to|a)\s*{number}", 2).try_cast("double")
    return F.when(first.isNotNull(), F.struct(F.when(F.startswith(F.trim(t), F.lit("<")), 0.0).otherwise(first).alias("lo"), F.coalesce(second, first).alias("hi")))


def sign_codes(text: Column) -> Column:
    """'FR:B14[50],M9v2' as an array of (code, value)."""
    parts = F.split(F.regexp_replace(text, "^[A-Z]{2}:", ""), "[,;]")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([A-Za-z0-9.]+)", 1).alias("code"), F.regexp_extract(p, r"\[([^\]]*)\]", 1).alias("value")))


def sun_elevation(ts: Column, lon: Column, lat: Column) -> Column:
    """Elevation of the sun in degrees, to about a degree (mean longitude, equation of the centre to first order)."""
    d = F.unix_timestamp(ts.cast("timestamp")) / 86400.0 - 10957.5
    g = F.radians(F.pmod(357.529 + 0.98560028 * d, F.lit(360.0)))
    q = F.pmod(280.459 + 0.98564736 * d, F.lit(360.0))
    ecl = F.radians(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    tilt = F.radians(23.439 - 0.00000036 * d)
    ra = F.degrees(F.atan2(F.cos(tilt) * F.sin(ecl), F.cos(ecl)))
    dec = F.asin(F.sin(tilt) * F.sin(ecl))
    sidereal = F.pmod(280.46061837 + 360.98564736629 * d + lon, F.lit(360.0))
    hour = F.radians(sidereal - ra)
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(dec) + F.cos(F.radians(lat)) * F.cos(dec) * F.cos(hour)))


def following_acceleration(v: Column, gap: Column, approach: Column, desired: Column, headway: Column, standstill: float = 2.0, a: float = 1.5, b: float = 2.0) -> Column:
    """Intelligent-driver acceleration: free-road term less the interaction with the leader."""
    wish = standstill + F.greatest(F.lit(0.0), v * headway + v * approach / (2 * math.sqrt(a * b)))
    return a * (1 - F.pow(v / desired, F.lit(4.0)) - F.pow(wish / gap, F.lit(2.0)))


def needed_deceleration(approach: Column, gap: Column) -> Column:
    """Constant deceleration that just avoids a contact; 0 when not closing in."""
    return F.when(approach > 0, approach * approach / (2 * gap)).otherwise(0.0)


def braking_distance(v: Column, deceleration: float, reaction: float = 0.0, slope: float = 0.0) -> Column:
    """Reaction and braking distance in metres at v m/s; slope is positive uphill."""
    return v * reaction + v * v / (2 * (deceleration + 9.81 * slope))
