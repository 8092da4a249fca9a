"""GeoJSON text from and to rings and parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathkit.functions.geometry import close_ring, let

_PAIRS = "array<double>"
_PART = "struct<kind:string,rings:array<array<struct<lon:double,lat:double>>>>"
_KINDS = ("Polygon", "MultiPolygon", "GeometryCollection", "Point", "MultiPoint")
#: Levels that are followed; the parsers of JSON end about there as well.
_DEPTH = 1000


def feature_text(rings: Column, central_time: Column, manifest: Column, name: Column | None = None) -> Column:
    """A Feature: one ring as Polygon, several as MultiPolygon; axis order lon, lat; rings closed. name: its id."""
    coords = F.transform(rings, lambda r: F.transform(close_ring(r), lambda v: F.array(v["lon"], v["lat"])))
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.transform(coords, lambda r: F.array(r)).alias("coordinates")))
    properties = F.to_json(F.struct(central_time.alias("central_time"), manifest.alias("manifest")))
    start = F.lit('{"type":"Feature","geometry":')
    if name is not None:
        start = F.concat(F.lit('{"type":"Feature","id":"'), name, F.lit('","geometry":'))
    return F.concat(start, F.when(F.size(rings) == 1, polygon).otherwise(many), F.lit(',"properties":'), properties, F.lit("}"))


def _vertices(pairs: Column) -> Column:
    usable = F.filter(pairs, lambda p: F.size(p) >= 2)
    return F.transform(usable, lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))


def _kind(o: Column) -> Column:
    return F.try_variant_get(o, "$.type", "string")


def _parts_of(geometry: Column) -> Column:
    """Parts of one Polygon, MultiPolygon, Point or MultiPoint, given as variant; no parts for other kinds."""
    get = lambda t: F.try_variant_get(geometry, "$.coordinates", t)
    part = lambda k, rings: F.struct(F.lit(k).alias("kind"), rings.alias("rings"))
    rings = lambda p: F.transform(p, _vertices)
    found = (
        F.when(_kind(geometry) == "Polygon", F.array(part("Polygon", rings(get(f"array<array<{_PAIRS}>>")))))
        .when(_kind(geometry) == "MultiPolygon", F.transform(get(f"array<array<array<{_PAIRS}>>>"), lambda p: part("Polygon", rings(p))))
        .when(_kind(geometry) == "Point", F.array(part("MultiPoint", F.array(_vertices(F.array(get(_PAIRS)))))))
        .when(_kind(geometry) == "MultiPoint", F.array(part("MultiPoint", F.array(_vertices(get(f"array<{_PAIRS}>"))))))
    )
    return F.coalesce(found, F.array().cast(f"array<{_PART}>"))


def _followed(start: Column, take, lead, kind: str, rounds: Column) -> Column:
    """What take gives of the objects reached from start: a fold over levels, each of which lead takes to the next."""

    def level(state: Column, _: Column) -> Column:
        here = state["open"]
        return F.struct(F.flatten(F.transform(here, lead)).alias("open"), F.concat(state["found"], F.flatten(F.transform(here, take))).alias("found"))

    empty = F.struct(start.alias("open"), F.array().cast(kind).alias("found"))
    whole = F.aggregate(F.sequence(F.lit(1), rounds), empty, level)
    deep = F.raise_error(F.lit(f"geometries are nested deeper than {_DEPTH} levels")).cast(kind)
    return let(whole, lambda s: F.when(F.size(s["open"]) > 0, deep).otherwise(s["found"]))


def _times(text: Column, word: str) -> Column:
    """How often a word stands in a text, which bounds the levels that it can open."""
    return F.least(F.size(F.split(text, word)), F.lit(_DEPTH))


def parts(doc: Column, text: Column) -> Column:
    """All parts of a GeoJSON document, given as variant and as its text.

    Features and feature collections are followed to their geometries, and objects of other kinds
    through their geometry member, so a LineString has no parts. Geometry collections are followed to
    any depth; only geometries count inside of them.
    """
    none = F.array().cast("array<variant>")
    member = lambda o: F.filter(F.array(F.try_variant_get(o, "$.geometry", "variant")), lambda g: g.isNotNull())
    features = lambda o: F.flatten(F.transform(F.try_variant_get(o, "$.features", "array<variant>"), member))
    known = lambda o: F.coalesce(_kind(o).isin(*_KINDS), F.lit(False))
    inward = lambda o: F.coalesce(F.when(known(o), none).when(_kind(o) == "FeatureCollection", features(o)).otherwise(member(o)), none)
    geometries = _followed(F.array(doc), lambda o: F.when(known(o), F.array(o)).otherwise(none), inward, "array<variant>", _times(text, "geometry") + 1)
    inner = lambda o: F.coalesce(F.when(_kind(o) == "GeometryCollection", F.try_variant_get(o, "$.geometries", "array<variant>")), none)
    return _followed(geometries, _parts_of, inner, f"array<{_PART}>", _times(text, "GeometryCollection") + 1)
