"""Project documents: reading JSON, the version gate, shape checks into a reject table, defaults, flattening and writing back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the version that documents are brought to.
CURRENT = "1.1.0"
#: Closed lists of the document format.
EDGE_TYPES = ("walk", "stairs", "elevator", "escalator")
CONNECTOR_TYPES = ("elevator", "stairs", "escalator", "ramp")
POINT = "struct<x:double,y:double>"
NAV = f"struct<nodes:array<struct<id:string,floorId:string,position:{POINT},type:string,name:string>>,edges:array<struct<id:string,`from`:string,`to`:string,type:string,distance:double,accessible:boolean,oneWay:boolean>>>"
LABELS = "name:string,names:map<string,string>,externalId:string"
FLOOR = (
    f"struct<id:string,{LABELS},level:double,elevation:double,"
    f"spaces:array<struct<id:string,floorId:string,polygon:array<{POINT}>,holes:array<array<{POINT}>>,type:string,height:double,stairDirection:string,stairSteps:double,properties:struct<{LABELS},category:string,code:string,tenantId:string>>>,"
    f"walls:array<struct<id:string,floorId:string,start:{POINT},`end`:{POINT},thickness:double,height:double>>,"
    f"entrances:array<struct<id:string,floorId:string,position:{POINT},spaceA:string,spaceB:string,type:string,wallId:string,width:double,height:double,sillHeight:double,rotation:double,depth:double,stepCount:double,landingDepth:double,doorOpenAngle:double>>,"
    f"pois:array<struct<id:string,floorId:string,position:{POINT},spaceId:string,type:string,{LABELS}>>,"
    f"furniture:array<struct<id:string,floorId:string,position:{POINT},spaceId:string,type:string,name:string,width:double,depth:double,height:double,rotation:double,modelData:string>>,"
    f"groups:array<struct<id:string,floorId:string,label:string,memberIds:array<string>>>,navigation:{NAV}>"
)
CONNECTOR = f"struct<id:string,{LABELS},type:string,stops:array<struct<floorId:string,nodeId:string,spaceId:string>>,accessible:boolean,direction:string,spec:struct<speed:double,averageWait:double,boardingTime:double,capacity:double>>"
BUILDING = f"struct<id:string,{LABELS},placement:struct<origin:{POINT},bearing:double>,footprint:array<{POINT}>,connectors:array<{CONNECTOR}>,floors:array<{FLOOR}>>"
SITE = f"struct<id:string,{LABELS},geoAnchor:struct<longitude:double,latitude:double>,address:struct<address:string,locality:string,province:string,country:string,postalCode:string>,navigation:{NAV}>"
PROJECT = f"struct<schemaVersion:string,id:string,name:string,site:{SITE},buildings:array<{BUILDING}>>"


def read(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """raw, doc: one row for each document; ``doc`` is null where the text is no JSON object.  ``lines``: one document to a line."""
    raw = spark.read.text(path, wholetext=not lines).select(F.col("value").alias("raw"))
    return parsed(raw)


def parsed(raw: DataFrame) -> DataFrame:
    doc = F.from_json("raw", PROJECT, {"mode": "PERMISSIVE"})
    return raw.withColumn("doc", F.when(F.ltrim("raw").startswith("{"), doc))


def version(text: Column) -> Column:
    """Major, minor, patch; null on anything else."""
    part = lambda i: F.split(text, r"\.")[i].cast("int")
    return F.when(text.rlike(r"^\d{1,9}\.\d{1,9}\.\d{1,9}$"), F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch")))


def gated(docs: DataFrame, migrations: dict[str, str] | None = None, target: str = CURRENT) -> DataFrame:
    """Adds ``refused`` (null: fine): versions that are missing, unreadable, newer, or without a way to ``target``; others are stamped with it.

    ``migrations`` maps a version to the next; a way is followed as far as it goes.
    """
    steps = migrations if migrations is not None else {"1.0.0": "1.1.0"}
    known = set()
    for start in steps:
        at = start
        while at in steps and at != target:
            at = steps[at]
        if at == target:
            known.add(start)
    has = F.col("doc.schemaVersion")
    goal = version(F.lit(target))
    refused = (
        F.when(F.col("doc").isNull(), "not-a-document").when(version(has).isNull(), "bad-version").when(version(has) > goal, "newer-version")
        .when((has != target) & ~has.isin(*(known or {""})), "no-migration")
    )
    return docs.withColumn("refused", refused).withColumn("doc", F.when(F.col("refused").isNull(), F.col("doc").withField("schemaVersion", F.lit(target))))


def faults(docs: DataFrame) -> DataFrame:
    """project_id, path, reason: every fault of shape; a document with one is left out of ``accepted``."""
    d = docs.filter("doc is not null").select(F.col("doc.id").alias("project_id"), "doc")
    number = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    floors = d.select("project_id", F.explode("doc.buildings").alias("b")).select("project_id", "b", F.explode("b.floors").alias("f"))

    def tell(df: DataFrame, ident: str, *tests: tuple[Column, str]) -> DataFrame:
        bad = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(reason)) for test, reason in tests]))
        return df.select("project_id", F.coalesce(F.col(ident), F.lit("?")).alias("path"), F.explode(bad).alias("reason"))

    of = lambda name: floors.select("project_id", F.explode(f"f.{name}").alias("o"))
    plane = floors.select("project_id", F.col("f.navigation").alias("n")).union(d.filter("doc.site is not null").select("project_id", "doc.site.navigation"))
    ring = lambda c: c.isNull() | F.exists(c, lambda p: number(p.x) | number(p.y))
    place = lambda: number(F.col("o.position.x")) | number(F.col("o.position.y"))
    every = [
        tell(d, "project_id", (F.col("doc.id").isNull(), "project id"), (F.col("doc.name").isNull(), "project name"), (F.col("doc.buildings").isNull(), "buildings")),
        tell(d.select("project_id", F.explode("doc.buildings").alias("b")), "b.id", (F.col("b.id").isNull(), "building id"), (F.col("b.name").isNull(), "building name"), (F.col("b.floors").isNull(), "floors")),
        tell(floors, "f.id", (F.col("f.id").isNull(), "floor id"), (number(F.col("f.level")), "floor level"), (number(F.col("f.elevation")), "floor elevation"), (F.col("f.spaces").isNull(), "floor spaces"), (F.col("f.navigation").isNull(), "floor navigation")),
        tell(of("spaces"), "o.id", (F.col("o.id").isNull(), "space id"), (ring(F.col("o.polygon")), "space polygon"), (F.exists(F.coalesce("o.holes", F.array().cast(f"array<array<{POINT}>>")), ring), "space hole"), (number(F.col("o.height")), "space height")),
        tell(of("walls"), "o.id", (number(F.col("o.start.x")) | number(F.col("o.start.y")) | number(F.col("o.end.x")) | number(F.col("o.end.y")), "wall ends"), (number(F.col("o.thickness")), "wall thickness")),
        tell(of("entrances"), "o.id", (place(), "entrance position"), (F.col("o.type").isNull(), "entrance type")),
        tell(of("pois"), "o.id", (place(), "poi position"), (F.col("o.type").isNull(), "poi type")),
        tell(plane.select("project_id", F.explode("n.nodes").alias("o")), "o.id", (F.col("o.id").isNull(), "node id"), (place(), "node position")),
        tell(plane.select("project_id", F.explode("n.edges").alias("o")), "o.id", (F.col("o.from").isNull() | F.col("o.to").isNull(), "edge ends"), (number(F.col("o.distance")) | (F.col("o.distance") < 0), "edge distance"), (F.coalesce(~F.col("o.type").isin(*EDGE_TYPES), F.lit(False)), "edge type")),
        tell(d.select("project_id", F.explode("doc.buildings").alias("b")).select("project_id", F.explode("b.connectors").alias("o")), "o.id", (~F.col("o.type").isin(*CONNECTOR_TYPES), "connector type"), (F.col("o.stops").isNull(), "connector stops"), (F.coalesce(F.col("o.spec.speed") <= 0, F.lit(False)), "connector speed"), (F.coalesce(~F.col("o.direction").isin("up", "down", "both"), F.lit(False)), "connector direction")),
        repeated_ids(d),
    ]
    out = every[0]
    for df in every[1:]:
        out = out.union(df)
    return out


def repeated_ids(d: DataFrame) -> DataFrame:
    """Ids used twice in a document: of buildings, of floors and the site, of nodes on any plane."""
    b = d.select("project_id", F.explode("doc.buildings").alias("b"))
    f = b.select("project_id", F.explode("b.floors").alias("f"))
    site = d.filter("doc.site is not null")
    ids = b.select("project_id", F.lit("building").alias("k"), "b.id").union(f.select("project_id", F.lit("plane"), "f.id")).union(site.select("project_id", F.lit("plane"), "doc.site.id"))
    ids = ids.union(f.select("project_id", F.lit("node"), F.explode("f.navigation.nodes.id"))).union(site.select("project_id", F.lit("node"), F.explode("doc.site.navigation.nodes.id")))
    return ids.groupBy("project_id", "k", "id").count().filter("count > 1").select("project_id", F.coalesce("id", F.lit("?")).alias("path"), F.concat(F.lit("repeated id of a "), "k").alias("reason"))


def accepted(docs: DataFrame) -> DataFrame:
    """Documents without a fault."""
    bad = faults(docs).select(F.col("project_id").alias("_bad")).distinct()
    return docs.filter("doc is not null").join(bad, F.col("doc.id").eqNullSafe(F.col("_bad")), "left_anti")


def planes(docs: DataFrame) -> DataFrame:
    """project_id, building_id (null outdoors), plane_id, ord and the floor or site navigation of every plane."""
    d = docs.filter("doc is not null").select(F.col("doc.id").alias("project_id"), "doc")
    f = d.select("project_id", F.posexplode("doc.buildings").alias("b_ord", "b")).select("project_id", F.col("b.id").alias("building_id"), F.posexplode("b.floors").alias("ord", "f"))
    indoor = f.select("project_id", "building_id", F.col("f.id").alias("plane_id"), "ord", F.col("f.level").alias("level"), F.col("f.elevation").alias("elevation"), F.col("f.navigation").alias("navigation"), "f")
    outdoor = d.filter("doc.site is not null").select("project_id", F.lit(None).cast("string").alias("building_id"), F.col("doc.site.id").alias("plane_id"), F.lit(0).alias("ord"), F.lit(None).cast("double").alias("level"), F.lit(None).cast("double").alias("elevation"), F.col("doc.site.navigation").alias("navigation"), F.lit(None).cast(FLOOR).alias("f"))
    return indoor.union(outdoor)


def flattened(docs: DataFrame) -> dict[str, DataFrame]:
    """The entity tables of accepted documents, with defaults filled in and ``ord`` for the place in each list."""
    p = planes(docs)
    floor = p.filter("f is not null")
    keys = ["project_id", "building_id", "plane_id"]
    each = lambda name: floor.select(*keys, F.posexplode(f"f.{name}").alias("ord", "o"))
    none = F.array().cast(f"array<array<{POINT}>>")
    nodes = p.select(*keys, F.posexplode("navigation.nodes").alias("ord", "o"))
    edges = p.select(*keys, F.posexplode("navigation.edges").alias("ord", "o"))
    return {
        "floors": floor.select(*keys, "ord", "level", "elevation"),
        "spaces": each("spaces").select(*keys, "ord", F.col("o.id").alias("space_id"), F.col("o.properties.name").alias("name"), F.col("o.properties.code").alias("code"), "o.type", F.col("o.properties.externalId").alias("external_id"), "o.polygon", F.coalesce("o.holes", none).alias("holes")),
        "walls": each("walls").select(*keys, "ord", F.col("o.id").alias("wall_id"), F.col("o.start.x").alias("sx"), F.col("o.start.y").alias("sy"), F.col("o.end.x").alias("ex"), F.col("o.end.y").alias("ey"), "o.thickness", "o.height"),
        "entrances": each("entrances").select(*keys, "ord", F.col("o.id").alias("entrance_id"), F.col("o.position.x").alias("x"), F.col("o.position.y").alias("y"), "o.type", F.col("o.spaceA").alias("space_a"), F.col("o.spaceB").alias("space_b"), F.col("o.wallId").alias("wall_id"), "o.width", "o.height", F.col("o.sillHeight").alias("sill_height"), "o.rotation", "o.depth", F.col("o.stepCount").alias("step_count")),
        "pois": each("pois").select(*keys, "ord", F.col("o.id").alias("poi_id"), F.col("o.position.x").alias("x"), F.col("o.position.y").alias("y"), F.col("o.spaceId").alias("space_id"), "o.type", "o.name", "o.names", F.col("o.externalId").alias("external_id")),
        "furniture": each("furniture").select(*keys, "ord", F.col("o.id").alias("furniture_id"), F.col("o.position.x").alias("x"), F.col("o.position.y").alias("y"), F.col("o.spaceId").alias("space_id"), "o.type", "o.width", "o.depth", "o.rotation"),
        "group_members": each("groups").select(*keys, F.col("o.id").alias("group_id"), F.posexplode("o.memberIds").alias("ord", "member_id")),
        "nodes": nodes.select(*keys, "ord", F.col("o.id").alias("node_id"), F.col("o.position.x").alias("x"), F.col("o.position.y").alias("y"), "o.type", F.col("o.floorId").alias("given_plane_id")),
        "edges": edges.select(*keys, "ord", F.col("o.id").alias("edge_id"), F.col("o.from").alias("from_id"), F.col("o.to").alias("to_id"), F.coalesce("o.type", F.lit("walk")).alias("type"), "o.distance", F.coalesce("o.accessible", F.lit(True)).alias("accessible"), F.coalesce("o.oneWay", F.lit(False)).alias("one_way")),
        "connectors": _connectors(docs),
        "stops": _connectors(docs).select("project_id", "building_id", "connector_id", "type", F.posexplode("stops").alias("ord", "s")).select("project_id", "building_id", "connector_id", "type", "ord", F.col("s.floorId").alias("plane_id"), F.col("s.nodeId").alias("node_id"), F.col("s.spaceId").alias("space_id")),
    }


def _connectors(docs: DataFrame) -> DataFrame:
    b = docs.filter("doc is not null").select(F.col("doc.id").alias("project_id"), F.explode("doc.buildings").alias("b"))
    c = b.select("project_id", F.col("b.id").alias("building_id"), F.explode("b.connectors").alias("c"))
    return c.select("project_id", "building_id", F.col("c.id").alias("connector_id"), "c.type", "c.accessible", "c.direction", F.col("c.spec.speed").alias("spec_speed"), F.col("c.spec.averageWait").alias("spec_wait"), F.col("c.spec.boardingTime").alias("spec_boarding"), "c.stops")


def written_back(docs: DataFrame) -> DataFrame:
    """project_id, raw: documents as JSON text."""
    return docs.filter("doc is not null").select(F.col("doc.id").alias("project_id"), F.to_json("doc").alias("raw"))


def latest(docs: DataFrame, stamp: str) -> DataFrame:
    """The newest document of each project by the column ``stamp``."""
    w = Window.partitionBy("doc.id").orderBy(F.desc(stamp))
    return docs.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
