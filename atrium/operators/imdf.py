"""IMDF features beside levels, units and relationships: venue, address, building, footprint, opening, amenity, manifest; with the issues met.

Every function returns rows, one for each feature; issues are rows (severity, code, object_id) of functions of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators import spatial
from atrium.operators.export import geometry, polygon, uuid_of

#: IMDF categories of amenities by POI type (any other: unspecified), widths of openings that name none.
AMENITY_CATEGORY = {"restroom": "restroom", "elevator": "elevator", "stairs": "stairs", "information": "information"}
OPENING_WIDTH = {"door": 0.9, "opening": 1.2}
NO_HOLES = "array<array<struct<x:double,y:double>>>"


def labels(name: Column, names: Column, language: str) -> Column:
    """A map language -> text: the translations, and the plain name under ``language`` unless that is translated; blanks are left out, null when empty."""
    given = F.map_filter(F.transform_values(F.coalesce(names, F.create_map().cast("map<string,string>")), lambda _, v: F.trim(v)), lambda _, v: v != "")
    own = (F.trim(name) != "") & ~F.map_contains_key(given, language)
    every = F.when(F.coalesce(own, F.lit(False)), F.map_concat(given, F.create_map(F.lit(language), F.trim(name)))).otherwise(given)
    return F.when(F.size(every) > 0, every)


def issue(df: DataFrame, severity: str, code: str, key: str) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(key).cast("string").alias("object_id"))


def _address() -> list[Column]:
    return [F.col(c) for c in ("address", "locality", "province", "country", "postal_code")]


def addresses(sites: DataFrame) -> DataFrame:
    """id, site_id and the address of sites that state any part of one (null and empty parts are no parts)."""
    some = [F.coalesce(c != "", F.lit(False)) for c in _address()]
    any_part = some[0] | some[1] | some[2] | some[3] | some[4]
    return sites.filter(any_part).select(uuid_of(F.lit("address"), F.col("site_id")).alias("id"), "site_id", *_address())


def address_issues(sites: DataFrame) -> DataFrame:
    """A site without any address is an error; one without street, locality or country gets a warning."""
    found = addresses(sites)
    missing = issue(sites.join(found.select("site_id"), "site_id", "left_anti"), "error", "missing-address", "site_id")
    lacks = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return missing.union(issue(found.filter(lacks("address") | lacks("locality") | lacks("country")), "warning", "incomplete-address", "site_id"))


def building_outlines(buildings: DataFrame, spaces: DataFrame, floors: DataFrame) -> DataFrame:
    """building_id, outline, source: given (a footprint of three points or more), hull of all rooms, or none."""
    corners = spaces.join(floors.select("plane_id", "building_id"), "plane_id").select("building_id", F.explode("polygon").alias("p"))
    hulls = spatial.hulls(corners, "building_id").filter(F.size("hull") >= 3)
    given = F.when(F.size("footprint") >= 3, F.col("footprint")) if "footprint" in buildings.columns else F.lit(None).cast("array<struct<x:double,y:double>>")
    both = buildings.select("building_id", given.alias("given")).join(hulls, "building_id", "left")
    return both.select("building_id", F.coalesce("given", "hull").alias("outline"), F.when(F.col("given").isNotNull(), "given").when(F.col("hull").isNotNull(), "hull").otherwise("none").alias("source"))


def on_site(ring: Column, ox: Column, oy: Column, bearing: Column) -> Column:
    return F.transform(ring, lambda p: geom.to_site(p.x, p.y, ox, oy, bearing))


def on_globe(ring: Column, lon: Column, lat: Column) -> Column:
    """Site points as struct(x: longitude, y: latitude); null without an anchor."""

    def place(p: Column) -> Column:
        g = geom.to_lng_lat(p.x, p.y, lon, lat)
        return geom.point(g.lon, g.lat)

    return F.when(lon.isNotNull() & lat.isNotNull(), F.transform(ring, place))


def buildings_and_footprints(outlines: DataFrame, buildings: DataFrame, sites: DataFrame) -> DataFrame:
    """feature_type, id, building_id, geometry (JSON), display_x, display_y of building features (no geometry) and footprints.

    ``buildings``: building_id, project_id, ox, oy, bearing; ``sites``: project_id, lon, lat, sites without an anchor being refused.
    """
    at = outlines.join(buildings.select("building_id", "project_id", "ox", "oy", "bearing"), "building_id").join(anchored(sites).select("project_id", "lon", "lat"), "project_id")
    ring = on_globe(on_site(F.col("outline"), F.col("ox"), F.col("oy"), F.col("bearing")), F.col("lon"), F.col("lat"))
    middle = on_globe(on_site(F.array(geom.centroid(F.col("outline"))), F.col("ox"), F.col("oy"), F.col("bearing")), F.col("lon"), F.col("lat"))
    at = at.withColumn("ring", ring).withColumn("middle", F.when(F.col("outline").isNotNull(), F.get(middle, F.lit(0))))
    shape = F.to_json(polygon(F.col("ring"), F.array().cast(NO_HOLES)))
    row = lambda df, kind, g: df.select(F.lit(kind).alias("feature_type"), uuid_of(F.lit(kind), F.col("building_id")).alias("id"), "building_id", g.alias("geometry"), F.col("middle.x").alias("display_x"), F.col("middle.y").alias("display_y"))
    return row(at, "building", F.lit(None).cast("string")).union(row(at.filter("source <> 'none'"), "footprint", shape))


def footprint_issues(outlines: DataFrame) -> DataFrame:
    return issue(outlines.filter("source = 'hull'"), "warning", "approximated-footprint", "building_id").union(issue(outlines.filter("source = 'none'"), "error", "missing-footprint", "building_id"))


def openings(entrances: DataFrame, walls: DataFrame, levels: DataFrame) -> DataFrame:
    """Doors and openings on emitted levels as segments along their host wall (else their rotation): entrance_id, id, level_id, ax, ay, bx, by, door.

    A wall of no length gives no direction, so the segment shrinks to the position.
    """
    e = entrances.filter(F.col("type").isin(*OPENING_WIDTH)).join(levels.select("plane_id"), "plane_id", "left_semi")
    w = walls.select("plane_id", "wall_id", (F.col("ex") - F.col("sx")).alias("wx"), (F.col("ey") - F.col("sy")).alias("wy"))
    e = e.join(w, ["plane_id", "wall_id"], "left")
    length = F.sqrt(F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy"))
    length = F.when(length == 0, 1.0).otherwise(length)
    turn = F.radians(F.coalesce(F.col("rotation"), F.lit(0.0))) if "rotation" in entrances.columns else F.lit(0.0)
    dx, dy = F.coalesce(F.col("wx") / length, F.cos(turn)), F.coalesce(F.col("wy") / length, F.sin(turn))
    half = F.coalesce(F.col("width"), F.when(F.col("type") == "door", OPENING_WIDTH["door"]).otherwise(OPENING_WIDTH["opening"])) / 2
    x, y = F.col("x"), F.col("y")
    ends = [(x - dx * half).alias("ax"), (y - dy * half).alias("ay"), (x + dx * half).alias("bx"), (y + dy * half).alias("by")]
    return e.select("entrance_id", uuid_of(F.lit("opening"), F.col("entrance_id")).alias("id"), uuid_of(F.lit("level"), F.col("plane_id")).alias("level_id"), *ends, (F.col("type") == "door").alias("door"))


def units_of_pois(pois: DataFrame, spaces: DataFrame) -> DataFrame:
    """poi_id, unit_space: the space that a POI names, if its floor has it, else the first one that contains it."""
    found = spatial.first_space(pois.select("poi_id", "plane_id", "x", "y"), spaces, "poi_id").withColumnRenamed("space_id", "inside")
    p = pois.join(found, "poi_id", "left")
    if "space_id" not in pois.columns:
        return p.select("poi_id", F.col("inside").alias("unit_space"))
    named = spaces.select("plane_id", "space_id", F.col("space_id").alias("named"))
    return p.join(named, ["plane_id", "space_id"], "left").select("poi_id", F.coalesce("named", "inside").alias("unit_space"))


def amenities(pois: DataFrame, spaces: DataFrame, levels: DataFrame) -> DataFrame:
    """poi_id, id, category, unit_ids, x, y of POIs on emitted levels; POIs outside of every unit have none."""
    p = pois.join(levels.select("plane_id"), "plane_id", "left_semi")
    category = F.lit("unspecified")
    for kind, value in AMENITY_CATEGORY.items():
        category = F.when(F.col("type") == kind, value).otherwise(category)
    unit = F.when(F.col("unit_space").isNull(), F.array().cast("array<string>")).otherwise(F.array(uuid_of(F.lit("unit"), F.col("unit_space"))))
    return p.join(units_of_pois(p, spaces), "poi_id").select("poi_id", uuid_of(F.lit("amenity"), F.col("poi_id")).alias("id"), category.alias("category"), unit.alias("unit_ids"), "x", "y")


def amenity_issues(pois: DataFrame, spaces: DataFrame, levels: DataFrame) -> DataFrame:
    p = pois.join(levels.select("plane_id"), "plane_id", "left_semi")
    out = p.join(units_of_pois(p, spaces).filter("unit_space is null"), "poi_id", "left_semi")
    return issue(out, "warning", "amenity-without-unit", "poi_id").union(issue(p.filter("type = 'store'"), "warning", "store-as-amenity", "poi_id"))


def venues(outlines: DataFrame, buildings: DataFrame, sites: DataFrame) -> DataFrame:
    """project_id, id, outline: the hull of a site's building outlines in the site frame, null (``empty-venue``) where there are none."""
    at = outlines.join(buildings.select("building_id", "project_id", "ox", "oy", "bearing"), "building_id")
    corner = at.select("project_id", F.explode(on_site(F.col("outline"), F.col("ox"), F.col("oy"), F.col("bearing"))).alias("p"))
    hulls = spatial.hulls(corner, "project_id").withColumnRenamed("hull", "h")
    return sites.select("project_id").join(hulls, "project_id", "left").select("project_id", uuid_of(F.lit("venue"), F.col("project_id")).alias("id"), F.when(F.size("h") >= 3, F.col("h")).alias("outline"))


def anchored(sites: DataFrame) -> DataFrame:
    """The sites that can be written: those with a geographic anchor."""
    return sites.filter("lon is not null and lat is not null")


def manifests(sites: DataFrame, language: str, created: str, generated_by: str = "atrium") -> DataFrame:
    """project_id, manifest (JSON), refused: the code ``missing-geo-anchor`` for sites that cannot be written."""
    row = F.to_json(F.struct(F.lit("1.0.0").alias("version"), F.lit(created).alias("created"), F.lit(generated_by).alias("generated_by"), F.lit(language).alias("language")))
    anchor = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return sites.select("project_id", F.when(anchor, row).alias("manifest"), F.when(~anchor, "missing-geo-anchor").alias("refused"))


def connectors_without_units(stops: DataFrame, levels: DataFrame) -> DataFrame:
    """Connectors of which fewer than two stops on emitted levels stand in a space (``space_id``)."""
    good = stops.join(levels.select("plane_id"), "plane_id", "left_semi").filter("space_id is not null").groupBy("connector_id").agg(F.count(F.lit(1)).alias("n"))
    poor = stops.select("connector_id").distinct().join(good, "connector_id", "left").filter("coalesce(n, 0) < 2")
    return issue(poor, "warning", "connector-without-units", "connector_id")
