"""Rings cut at the 0 and 180 degree meridians, as functions of the array of vertices: a row at a time, nothing is shuffled.

Longitudes are unwrapped by a running sum of jumps; every edge yields its crossings with multiples of
180 degrees; a running count of crossings numbers the pieces; pieces in one hemisphere that follow
each other are joined in a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathkit.functions.geometry import EPSILON, close_ring, drop_repeats, let, open_ring, wrap_180

_VERTICES = "array<struct<lon:double,lat:double>>"
_RINGS = f"array<{_VERTICES}>"
_ISLANDS = f"array<struct<zone:int,coords:{_VERTICES}>>"


def _crossings(lon1: Column, lon2: Column) -> Column:
    """Multiples of 180 strictly between two longitudes, in travel order, as an array (empty if none)."""
    east_low, east_high = F.ceil((lon1 + EPSILON) / 180.0), F.ceil((lon2 - EPSILON) / 180.0) - 1
    west_high, west_low = F.floor((lon1 - EPSILON) / 180.0), F.floor((lon2 + EPSILON) / 180.0) + 1
    east, west = (lon2 > lon1 + EPSILON) & (east_low <= east_high), (lon2 < lon1 - EPSILON) & (west_low <= west_high)
    first, last = F.when(east, east_low).when(west, west_high), F.when(east, east_high).when(west, west_low)
    return F.coalesce(F.transform(F.sequence(first, last), lambda k: k * 180.0), F.array().cast("array<double>"))


def _jump(lon: Column, before: Column) -> Column:
    """What is added from here on so that no step is longer than 180 degrees."""
    jump = lon - before
    return F.when(jump > 180, -360.0).when(jump < -180, 360.0).otherwise(0.0)


def unwrapped(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """vertices (keys, pos, lat, lon) with lon free of jumps over 180 degrees, as column ulon: for rings in rows."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return vertices.withColumn("step", _jump(F.col("lon"), F.lag("lon").over(w))).withColumn("ulon", F.col("lon") + F.sum("step").over(w)).drop("step")


def _before(numbers: Column) -> Column:
    """Sums of the numbers before each place, and of all at the end."""
    return F.aggregate(numbers, F.array(F.lit(0.0)), lambda sums, n: F.array_append(sums, F.get(sums, F.size(sums) - 1) + n))


def unwrap(ring: Column) -> Column:
    """The ring's vertices with longitudes free of jumps over 180 degrees."""
    steps = lambda r: F.transform(r, lambda v, i: F.when(i == 0, F.lit(0.0)).otherwise(_jump(v["lon"], F.get(r, F.greatest(i - 1, F.lit(0)))["lon"])))
    moved = lambda r, sums: F.transform(r, lambda v, i: F.struct((v["lon"] + F.get(sums, i + 1)).alias("lon"), v["lat"].alias("lat")))
    return let(ring, lambda r: let(_before(steps(r)), lambda sums: moved(r, sums)))


def _edges(ring: Column) -> Column:
    """struct<lat, lon, lat2, lon2, cross> of each edge of an unwrapped ring; the last one closes it, without a jump."""
    first, last = F.get(ring, 0), F.get(ring, F.size(ring) - 1)
    turn = first["lon"] - last["lon"]
    back = F.when(turn > 180, -F.ceil((turn - 180) / 360.0) * 360.0).when(turn < -180, F.ceil((-180 - turn) / 360.0) * 360.0).otherwise(0.0)
    closing = F.struct((first["lon"] + back).alias("lon"), first["lat"].alias("lat"))
    ahead = lambda i: F.when(i < F.size(ring) - 1, F.get(ring, i + 1)).otherwise(closing)
    edge = lambda v, n: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"), n["lat"].alias("lat2"), n["lon"].alias("lon2"), _crossings(v["lon"], n["lon"]).alias("cross"))
    return F.transform(ring, lambda v, i: let(ahead(i), lambda n: edge(v, n)))


def _stream(edges: Column, exact: bool) -> Column:
    """Vertices and crossings in travel order, with the number of their piece; a crossing ends one piece and begins the next."""
    row = lambda segment, lat, lon: F.struct(segment.cast("int").alias("segment"), lat.alias("lat"), lon.alias("lon"))
    shifted = lambda b: F.when(b == 0, b).when(b > 0, b - 360.0).otherwise(b + 360.0)
    lat_at = lambda e, b: e["lat"] + (b - e["lon"]) / (e["lon2"] - e["lon"]) * (e["lat2"] - e["lat"])
    pair = lambda e, n, b, j: F.array(row(n + j, lat_at(e, b), b), row(n + j + 1, lat_at(e, b), shifted(b)))

    def of_edge(e: Column, i: Column, before: Column) -> Column:
        n = F.get(before, i)
        rows = F.concat(F.array(row(n, e["lat"], e["lon"])), F.flatten(F.transform(e["cross"], lambda b, j: pair(e, n, b, j))))
        closing = F.array(row(F.get(before, i + 1), e["lat2"], e["lon2"]))
        return F.when(i == F.size(edges) - 1, F.concat(rows, closing)).otherwise(rows) if exact else rows

    counts = _before(F.transform(edges, lambda e: F.size(e["cross"]).cast("double")))
    return let(counts, lambda before: F.flatten(F.transform(edges, lambda e, i: of_edge(e, i, before))))


def pieces(core: Column, exact: bool = False) -> Column:
    """array<struct<segment, coords>>: the pieces of a cleaned open ring, in order, re-wrapped.

    exact=False leaves the closing vertex out, as the files that this must agree with do, so a ring
    that is cut loses its first corner or the corner at its closing edge; exact=True keeps it.
    """
    wrapped = lambda rows, s: F.transform(F.filter(rows, lambda r: r["segment"] == s), lambda r: F.struct(wrap_180(r["lon"]).alias("lon"), r["lat"].alias("lat")))
    cut = lambda rows: F.transform(F.sequence(F.lit(0), F.array_max(F.transform(rows, lambda r: r["segment"]))), lambda s: F.struct(s.alias("segment"), drop_repeats(wrapped(rows, s)).alias("coords")))
    found = let(unwrap(core), lambda u: let(_edges(u), lambda e: let(_stream(e, exact), cut)))
    return F.filter(found, lambda p: F.size(p["coords"]) >= 2)


def split_rings(rings: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """keys, segment, coords: a row for each piece of each ring (keys, core: cleaned open ring)."""
    return rings.select(*keys, F.explode(pieces(F.col("core"), exact)).alias("p")).select(*keys, "p.segment", "p.coords")


def _zone(coords: Column) -> Column:
    inner = lambda v: F.abs(v["lon"]) < 180 - EPSILON
    east = F.exists(coords, lambda v: (v["lon"] > EPSILON) & inner(v))
    west = F.exists(coords, lambda v: (v["lon"] < -EPSILON) & inner(v))
    return F.when(east & ~west, 1).when(west & ~east, -1).otherwise(0)


def _rest(array: Column, n: int = 1) -> Column:
    """Without the first n."""
    return F.slice(array, F.lit(n + 1), F.greatest(F.size(array) - n, F.lit(0)))


def _but_last(array: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))


def _island(zone: Column, coords: Column) -> Column:
    return F.struct(zone.cast("int").alias("zone"), coords.alias("coords"))


def _islands(found: Column) -> Column:
    """Pieces that follow each other without a change of hemisphere, joined: each but the first without its first vertex."""

    def add(done: Column, piece: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        apart = (piece["zone"] != 0) & (last["zone"] != 0) & (piece["zone"] != last["zone"])
        joined = _island(F.when(last["zone"] != 0, last["zone"]).otherwise(piece["zone"]), F.concat(last["coords"], _rest(piece["coords"])))
        return F.when((F.size(done) == 0) | apart, F.array_append(done, piece)).otherwise(F.array_append(_but_last(done), joined))

    zoned = F.transform(found, lambda p: _island(_zone(p["coords"]), p["coords"]))
    folded = F.aggregate(zoned, F.array().cast(_ISLANDS), add)
    return F.transform(folded, lambda g: _island(g["zone"], drop_repeats(g["coords"])))


def _round(islands: Column) -> Column:
    """The last island joined to the first, if they meet in one hemisphere."""
    first, last = F.get(islands, 0), F.get(islands, F.size(islands) - 1)
    meets = (F.size(islands) > 1) & ((first["zone"] == last["zone"]) | (first["zone"] == 0) | (last["zone"] == 0))
    merged = _island(F.when(first["zone"] != 0, first["zone"]).otherwise(last["zone"]), drop_repeats(F.concat(last["coords"], _rest(first["coords"]))))
    return F.when(meets, F.concat(F.array(merged), _but_last(_rest(islands)))).otherwise(islands)


def _cut(core: Column, exact: bool) -> Column:
    """struct<rings, straddles> of one cleaned ring."""
    side = lambda v, g: F.when((F.abs(F.abs(v["lon"]) - 180.0) < EPSILON) & (g["zone"] != 0), g["zone"] * 180.0).otherwise(v["lon"])
    aligned = lambda g: F.transform(g["coords"], lambda v: F.struct(side(v, g).alias("lon"), v["lat"].alias("lat")))
    kept = lambda gs: F.transform(F.filter(gs, lambda g: F.size(g["coords"]) >= 3), lambda g: close_ring(aligned(g)))
    out = lambda gs: F.struct(kept(gs).alias("rings"), F.exists(gs, lambda g: g["zone"] == 0).alias("straddles"))
    return let(pieces(core, exact), lambda p: let(_islands(p), lambda g: let(_round(g), out)))


def normalised(rings: Column, exact: bool = False) -> Column:
    """struct<rings, straddles>: rings cut at the meridians, closed, in order.

    Rings of fewer than three different vertices drop out. If no piece is left, the uncut rings stand.
    Without a usable ring there is an empty array. straddles: a ring has vertices on both sides but no
    crossing between vertices, as one with a vertex exactly on the meridian; it isn't cut.
    """
    cores = F.filter(F.transform(F.coalesce(rings, F.array().cast(_RINGS)), lambda r: drop_repeats(open_ring(r))), lambda r: F.size(r) >= 3)

    def out(whole: Column, cut: Column) -> Column:
        found = F.flatten(F.transform(cut, lambda c: c["rings"]))
        uncut = F.transform(whole, close_ring)
        return F.struct(F.when(F.size(found) > 0, found).otherwise(uncut).alias("rings"), F.exists(cut, lambda c: c["straddles"]).alias("straddles"))

    return let(cores, lambda whole: let(F.transform(whole, lambda core: _cut(core, exact)), lambda cut: out(whole, cut)))


def normalise_rings(footprints: DataFrame, exact: bool = False) -> DataFrame:
    """footprint_id, rings, straddles of footprints (footprint_id, rings: array<array<struct<lon,lat>>>)."""
    return footprints.select("footprint_id", F.explode(F.array(normalised(F.col("rings"), exact))).alias("n")).select("footprint_id", "n.rings", "n.straddles")
