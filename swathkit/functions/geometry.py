"""Planar geometry on longitude and latitude in degrees, as Columns.

Rings are array<struct<lon,lat>>; a part is struct<kind,rings>, kind Polygon (first ring outer, others
holes) or MultiPoint (its points in the first ring).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance in degrees (fixed value).
EPSILON = 1e-9


def wrap_180(lon: Column) -> Column:
    """Longitude in [-180, 180]; positive multiples stay +180; near zero is zero."""
    wrapped = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return F.when((wrapped == -180.0) & (lon > 0), F.lit(180.0)).when(F.abs(wrapped) < 1e-12, F.lit(0.0)).otherwise(wrapped)


def circular_mean(lon: Column) -> Column:
    """Aggregate: mean direction in degrees, in (-180, 180]."""
    mean = F.degrees(F.atan2(F.sum(F.sin(F.radians(lon))), F.sum(F.cos(F.radians(lon)))))
    return F.when(mean <= -180.0, mean + 360.0).otherwise(mean)


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + f(v))


def centre(vertices: Column) -> tuple[Column, Column]:
    """(mean latitude, circular mean longitude) of an array of vertices."""
    mean = F.degrees(F.atan2(_sum(vertices, lambda v: F.sin(F.radians(v["lon"]))), _sum(vertices, lambda v: F.cos(F.radians(v["lon"])))))
    return _sum(vertices, lambda v: v["lat"]) / F.size(vertices), F.when(mean <= -180.0, mean + 360.0).otherwise(mean)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def drop_repeats(ring: Column) -> Column:
    """Without vertices equal to the one before."""
    return let(ring, lambda r: F.filter(r, lambda v, i: (i == 0) | (v != F.get(r, F.greatest(i - 1, F.lit(0))))))


def open_ring(ring: Column) -> Column:
    """Without the closing vertex."""
    closed = lambda r: (F.size(r) > 1) & (F.get(r, 0) == F.get(r, F.size(r) - 1))
    return let(ring, lambda r: F.when(closed(r), F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r))


def close_ring(ring: Column) -> Column:
    ends = lambda r: (F.size(r) > 0) & (F.get(r, 0) != F.get(r, F.size(r) - 1))
    return let(ring, lambda r: F.when(ends(r), F.concat(r, F.slice(r, 1, 1))).otherwise(r))


# What follows is SQL text made of SQL text: nested lambdas of Columns take seconds to build, one call to the JVM for each node.
# Lambda variables have one letter, or are core and e0; arguments that are names must be others, but for the r and p of callers.

#: Edges that a band of latitude holds about, and how often an edge may stand in bands on the average.
_PER_BAND, _COPIES = 8, 3
#: Far above rounding, and above EPSILON: what may touch a band stands in it.
MARGIN = 1e-8


def let_sql(value: str, name: str, body: str) -> str:
    """body, in which name stands for value, computed once per row."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def edges_sql(ring: str) -> str:
    """array<struct<x1,y1,x2,y2>> of a ring, the closing edge included; empty below three vertices."""
    core = "if(size(r) > 1 and get(r, 0) = get(r, size(r) - 1), slice(r, 1, greatest(size(r) - 1, 0)), r)"
    edge = "get(transform(array(get(core, (i + 1) % size(core))), w -> struct(v.lon as x1, v.lat as y1, w.lon as x2, w.lat as y2)), 0)"
    return let_sql(f"filter({ring}, v -> size({ring}) >= 3)", "r", let_sql(core, "core", f"transform(core, (v, i) -> {edge})"))


def banded_sql(edges: str) -> str:
    """struct<low, step, starts, edges>: the edges in bands of latitude, for edges_at_sql; null if there are none.

    An edge stands in each band that it reaches. The bands are as many as the edges fill without being
    copied more than a few times. Every band begins with an edge of NaN, which nothing touches or
    crosses, so `starts` has a place for each.
    """
    low, high = f"array_min(transform({edges}, e -> least(e.y1, e.y2)))", f"array_max(transform({edges}, e -> greatest(e.y1, e.y2)))"
    reach = f"aggregate({edges}, 0D, (s, e) -> s + abs(e.y2 - e.y1))"
    ends = let_sql(f"struct({low} as low, {high} as high, {reach} as reach)", "h", f"""struct(h.low as low, greatest(h.high - h.low, 1e-3D) as span,
        if(h.high - h.low > 1e-3D, greatest(1, cast(floor(least(size({edges}) / {_PER_BAND}D, {_COPIES} * size({edges}) * (h.high - h.low) / greatest(h.reach, 1e-8D))) as int)), 1) as n)""")
    band = lambda y: f"cast(greatest(0, least(k.n - 1, floor(({y} - k.low) * k.n / k.span))) as int)"
    nan = "cast('NaN' as double)"
    blank = f"transform(sequence(0, k.n - 1), b -> struct(b as b, {nan} as x1, {nan} as y1, {nan} as x2, {nan} as y2))"
    reached = f"transform(sequence({band(f'least(e.y1, e.y2) - {MARGIN}D')}, {band(f'greatest(e.y1, e.y2) + {MARGIN}D')}), b -> struct(b as b, e.x1 as x1, e.y1 as y1, e.x2 as x2, e.y2 as y2))"
    placed = f"array_sort(concat({blank}, flatten(transform({edges}, e -> {reached}))))"
    starts = "filter(transform(s, (e, i) -> if(i = 0 or get(s, greatest(i - 1, 0)).b <> e.b, i, null)), i -> i is not null)"
    bare = "transform(s, e -> struct(e.x1 as x1, e.y1 as y1, e.x2 as x2, e.y2 as y2))"
    made = let_sql(placed, "s", f"struct(k.low as low, k.span / k.n as step, {starts} as starts, {bare} as edges)")
    return f"if(size({edges}) > 0, {let_sql(ends, 'k', made)}, null)"


def one_band_sql(edges: str) -> str:
    """The edges of a small ring in the form of banded_sql, all in one band."""
    return f"if(size({edges}) > 0, struct({edges}[0].y1 as low, 1D as step, array(0) as starts, {edges} as edges), null)"


def edges_at_sql(lat: str, bands: str) -> str:
    """The edges of a banded ring that a point of this latitude can touch or cross."""
    band = f"cast(greatest(0, least(size({bands}.starts) - 1, floor(({lat} - {bands}.low) / {bands}.step))) as int)"
    stretch = f"slice({bands}.edges, get({bands}.starts, b) + 1, coalesce(get({bands}.starts, b + 1), size({bands}.edges)) - get({bands}.starts, b))"
    return f"if(size({bands}.starts) > 1, {let_sql(band, 'b', stretch)}, {bands}.edges)"


def in_ring_sql(lon: str, lat: str, edges: str) -> str:
    """Even-odd rule; points on an edge, or within EPSILON of one along the parallel, are inside."""
    eps = f"{EPSILON}D"
    crosses = f"((e.y1 > {lat}) <> (e.y2 > {lat}))"
    at = f"((e.x2 - e.x1) * ({lat} - e.y1) / (e.y2 - e.y1) + e.x1)"
    box = f"{lon} between least(e.x1, e.x2) - {eps} and greatest(e.x1, e.x2) + {eps} and {lat} between least(e.y1, e.y2) - {eps} and greatest(e.y1, e.y2) + {eps}"
    on = f"({box} and abs((e.x2 - e.x1) * ({lat} - e.y1) - ({lon} - e.x1) * (e.y2 - e.y1)) <= {eps})"
    touches = f"({on} or if({crosses}, abs({at} - {lon}) <= {eps}, false))"
    odd = f"size(filter(e0, e -> if({crosses}, {lon} < {at}, false))) % 2 = 1"
    return let_sql(edges, "e0", f"(exists(e0, e -> {touches}) or {odd})")


#: Vertices of a ring that stands in plain columns, and of one that takes a shorter way.
PLAIN, _FEW = 8, 4
CORNERS = [(f"ring_x{i}", f"ring_y{i}") for i in range(PLAIN)]


def plain_ring_sql(edges: str) -> str:
    """struct<ring_n, ring_x0, ring_y0, ...> of a ring given as its edges: how many vertices, and PLAIN of them, the last one repeated; null if there are more, or if the edges aren't a closed chain."""
    closed = f"forall(transform({edges}, (e, i) -> get({edges}, (i + 1) % size({edges})).x1 = e.x2 and get({edges}, (i + 1) % size({edges})).y1 = e.y2), b -> b)"
    corner = lambda i, axis: f"get({edges}, least({i}, size({edges}) - 1)).{axis}1"
    made = ", ".join(f"{corner(i, 'x')} as {x}, {corner(i, 'y')} as {y}" for i, (x, y) in enumerate(CORNERS))
    return f"if(size({edges}) between 3 and {PLAIN} and {closed}, struct(size({edges}) as ring_n, {made}), null)"


def in_plain_ring_sql(lon: str, lat: str) -> str:
    """What in_ring_sql says of a ring in the columns of plain_ring_sql, without lambdas, so that it is compiled: a repeated vertex is an edge without length, which changes nothing."""
    eps = f"{EPSILON}D"
    odd, touches = [], []
    for (x1, y1), (x2, y2) in zip(CORNERS, CORNERS[1:] + CORNERS[:1]):
        crosses = f"(({y1} > {lat}) <> ({y2} > {lat}))"
        at = f"(({x2} - {x1}) * ({lat} - {y1}) / ({y2} - {y1}) + {x1})"
        box = f"{lon} between least({x1}, {x2}) - {eps} and greatest({x1}, {x2}) + {eps} and {lat} between least({y1}, {y2}) - {eps} and greatest({y1}, {y2}) + {eps}"
        touches.append(f"({box} and abs(({x2} - {x1}) * ({lat} - {y1}) - ({lon} - {x1}) * ({y2} - {y1})) <= {eps}) or if({crosses}, abs({at} - {lon}) <= {eps}, false)")
        odd.append(f"if({crosses}, {lon} < {at}, false)")
    # Those of repeated vertices are left out in a triangle or quadrilateral.
    few, more = [*range(_FEW - 1), PLAIN - 1], range(_FEW - 1, PLAIN - 1)
    parity = lambda which: functools.reduce(lambda a, b: f"({a} <> {b})", [odd[i] for i in which])
    near = lambda which: " or ".join(touches[i] for i in which)
    return f"(({parity(few)} <> if(ring_n > {_FEW}, {parity(more)}, false)) or {near(few)} or if(ring_n > {_FEW}, {near(more)}, false))"


def in_part_sql(lon: str, lat: str, part: str) -> str:
    """part: struct<kind, x0, x1, y0, y1, rings array<banded>, points array<vertex>>. In the outer ring and in no hole (a hole's edge is outside); or at a point."""
    box = f"{lon} between {part}.x0 - {MARGIN}D and {part}.x1 + {MARGIN}D and {lat} between {part}.y0 - {MARGIN}D and {part}.y1 + {MARGIN}D"
    within = f"coalesce({in_ring_sql(lon, lat, edges_at_sql(lat, 'r'))}, false)"
    rings = f"exists({{0}}, r -> {within})"
    holes = rings.format(f"slice({part}.rings, 2, greatest(size({part}.rings) - 1, 0))")
    near = f"exists({part}.points, v -> abs(v.lon - {lon}) <= {EPSILON}D and abs(v.lat - {lat}) <= {EPSILON}D)"
    return f"({box} and if({part}.kind = 'Polygon', {rings.format(f'slice({part}.rings, 1, 1)')} and not {holes}, {near}))"
