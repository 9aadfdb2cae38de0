"""Plane geometry as Column expressions over rings (arrays of x, y structs, not closed) and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def following(ring: Column) -> Column:
    """Each vertex's successor, the last one's being the first."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def edges(ring: Column) -> Column:
    """An array of structs a, b."""
    return F.zip_with(ring, following(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive counter-clockwise; 0 under three points."""
    twice = _total(F.zip_with(ring, following(ring), lambda a, b: a.x * b.y - b.x * a.y))
    return F.when(F.size(ring) < 3, 0.0).otherwise(twice / 2)


def centroid(ring: Column) -> Column:
    """Centroid of the area; the mean of the vertices where there is no area."""
    area = signed_area(ring)
    cross = lambda a, b: a.x * b.y - b.x * a.y
    sx = _total(F.zip_with(ring, following(ring), lambda a, b: (a.x + b.x) * cross(a, b)))
    sy = _total(F.zip_with(ring, following(ring), lambda a, b: (a.y + b.y) * cross(a, b)))
    n = F.nullif(F.size(ring), F.lit(0)).cast("double")
    mean = point(F.coalesce(_total(F.transform(ring, lambda p: p.x)) / n, F.lit(0.0)), F.coalesce(_total(F.transform(ring, lambda p: p.y)) / n, F.lit(0.0)))
    return F.when(area == 0, mean).otherwise(point(F.try_divide(sx, area * 6), F.try_divide(sy, area * 6)))


def net_area(ring: Column, holes: Column) -> Column:
    """Area without the holes, 0 at least."""
    return F.greatest(F.lit(0.0), F.abs(signed_area(ring)) - _total(F.transform(holes, lambda h: F.abs(signed_area(h)))))


def box(ring: Column) -> Column:
    """x0, y0, x1, y1; zeros for no points."""
    side = lambda pick, f: F.coalesce(f(F.transform(ring, pick)), F.lit(0.0))
    return F.struct(side(lambda p: p.x, F.array_min).alias("x0"), side(lambda p: p.y, F.array_min).alias("y0"), side(lambda p: p.x, F.array_max).alias("x1"), side(lambda p: p.y, F.array_max).alias("y1"))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray casting, half-open in y."""
    crosses = lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < F.try_divide((e.b.x - e.a.x) * (y - e.a.y), e.b.y - e.a.y) + e.a.x)
    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def inside_with_holes(x: Column, y: Column, ring: Column, holes: Column) -> Column:
    return inside(x, y, ring) & ~F.exists(holes, lambda h: (F.size(h) >= 3) & inside(x, y, h))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """How far along the segment (0 to 1) its point nearest to p lies; 0 if it has no length."""
    dx, dy = bx - ax, by - ay
    t = F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def distance_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = foot(px, py, ax, ay, bx, by)
    return distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def distance_to_ring(px: Column, py: Column, ring: Column) -> Column:
    return F.array_min(F.transform(edges(ring), lambda e: distance_to_segment(px, py, e.a.x, e.a.y, e.b.x, e.b.y)))


def nearest_on_ring(px: Column, py: Column, ring: Column) -> Column:
    """distance, x, y of the boundary point nearest to p; the first edge wins a tie."""

    def near(e: Column) -> Column:
        t = foot(px, py, e.a.x, e.a.y, e.b.x, e.b.y)
        x, y = e.a.x + t * (e.b.x - e.a.x), e.a.y + t * (e.b.y - e.a.y)
        return F.struct(distance(px, py, x, y).alias("distance"), x.alias("x"), y.alias("y"))

    start = F.struct(F.lit(float("inf")).alias("distance"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(F.transform(edges(ring), near), start, lambda a, b: F.when(b.distance < a.distance, b).otherwise(a))


def crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The point where segments ab and cd meet; null if they don't or are parallel."""
    rx, ry, sx, sy = b.x - a.x, b.y - a.y, d.x - c.x, d.y - c.y
    cross = rx * sy - ry * sx
    t = F.try_divide((c.x - a.x) * sy - (c.y - a.y) * sx, cross)
    u = F.try_divide((c.x - a.x) * ry - (c.y - a.y) * rx, cross)
    return F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), point(a.x + t * rx, a.y + t * ry))


def self_crossing(ring: Column) -> Column:
    """Whether two edges that are not neighbours meet."""
    n = F.size(ring)
    numbered = F.transform(edges(ring), lambda e, i: F.struct(e.alias("e"), i.alias("i")))

    def meets(p: Column) -> Column:
        others = F.filter(numbered, lambda q: (q.i > p.i + 1) & ~((p.i == 0) & (q.i == n - 1)))
        return F.exists(others, lambda q: crossing(p.e.a, p.e.b, q.e.a, q.e.b).isNotNull())

    return F.coalesce((n >= 4) & F.exists(numbered, meets), F.lit(False))


def oriented(ring: Column, clockwise: bool = False) -> Column:
    """The ring closed and turned as asked."""
    turned = F.when((signed_area(ring) > 0) == F.lit(clockwise), F.reverse(ring)).otherwise(ring)
    return F.when(F.size(ring) > 0, F.array_append(turned, F.element_at(turned, 1))).otherwise(ring)


def to_site(x: Column, y: Column, ox: Column, oy: Column, bearing: Column) -> Column:
    """Building coordinates in the site frame: turned clockwise by the bearing (degrees), then moved."""
    a = F.radians(bearing)
    return point(ox + x * F.cos(a) + y * F.sin(a), oy - x * F.sin(a) + y * F.cos(a))


def to_building(x: Column, y: Column, ox: Column, oy: Column, bearing: Column) -> Column:
    a = F.radians(bearing)
    return point((x - ox) * F.cos(a) - (y - oy) * F.sin(a), (x - ox) * F.sin(a) + (y - oy) * F.cos(a))


#: Semi-major axis and squared eccentricity of WGS 84.
AXIS, E2 = 6378137.0, 6.69437999014e-3


def _radii(lat: Column) -> tuple[Column, Column]:
    """Metres for one radian of latitude and of longitude."""
    s = F.sin(F.radians(lat))
    w = 1 - s * s * E2
    return F.lit(AXIS * (1 - E2)) / (w * F.sqrt(w)), F.lit(AXIS) / F.sqrt(w) * F.cos(F.radians(lat))


def to_lng_lat(x: Column, y: Column, lon: Column, lat: Column) -> Column:
    """WGS 84 coordinates of a site point, by the tangent plane at the anchor; null without an anchor."""
    north, east = _radii(lat)
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct((lon + F.degrees(x / east)).alias("lon"), (lat + F.degrees(y / north)).alias("lat")))


def from_lng_lat(to_lon: Column, to_lat: Column, lon: Column, lat: Column) -> Column:
    north, east = _radii(lat)
    return F.when(lon.isNotNull() & lat.isNotNull(), point(F.radians(to_lon - lon) * east, F.radians(to_lat - lat) * north))


def moved(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: point(p.x + dx, p.y + dy))


def turned(ring: Column, cx: Column, cy: Column, degrees: Column) -> Column:
    """Turned counter-clockwise about (cx, cy)."""
    a = F.radians(degrees)
    return F.transform(ring, lambda p: point(cx + (p.x - cx) * F.cos(a) - (p.y - cy) * F.sin(a), cy + (p.x - cx) * F.sin(a) + (p.y - cy) * F.cos(a)))


def scaled(ring: Column, cx: Column, cy: Column, by: Column) -> Column:
    return F.transform(ring, lambda p: point(cx + (p.x - cx) * by, cy + (p.y - cy) * by))


def hull(points: Column) -> Column:
    """Convex hull, counter-clockwise, without collinear points: a fold over the sorted distinct points."""
    turn = lambda a, b, c: (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)
    none = F.slice(points, 1, 0)

    def push(stack: Column, p: Column) -> Column:
        n = F.size(stack)
        places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        holds = lambda i: (i < 1) | (turn(F.get(stack, i - 1), F.get(stack, i), p) > 0)
        keep = F.array_max(F.filter(places, holds))
        return F.array_append(F.slice(stack, 1, F.when(n == 0, 0).otherwise(keep + 1)), p)

    chain = lambda ps: F.aggregate(ps, none, push)
    ordered = F.array_sort(F.array_distinct(points))
    lower, upper = chain(ordered), chain(F.reverse(ordered))
    both = F.concat(F.slice(lower, 1, F.size(lower) - 1), F.slice(upper, 1, F.size(upper) - 1))
    return F.when(F.size(ordered) < 3, ordered).otherwise(both)


def pixel_to_world(px: Column, py: Column, ox: Column, oy: Column, metres_per_pixel: Column) -> Column:
    """x, y of an image pixel; the origin is the image's upper left corner and rows run down."""
    return F.struct((ox + px * metres_per_pixel).alias("x"), (oy - py * metres_per_pixel).alias("y"))


def world_to_pixel(x: Column, y: Column, ox: Column, oy: Column, metres_per_pixel: Column) -> Column:
    return F.struct(((x - ox) / metres_per_pixel).alias("x"), ((oy - y) / metres_per_pixel).alias("y"))


def calibrated(ax: Column, ay: Column, bx: Column, by: Column, metres: Column, ox: Column, oy: Column, metres_per_pixel: Column) -> Column:
    """ox, oy, metres_per_pixel after the two points are said to be ``metres`` apart; the first stays where it is.

    Without a positive length, or with two equal points, nothing changes.
    """
    a = world_to_pixel(ax, ay, ox, oy, metres_per_pixel)
    pixels = distance(ax, ay, bx, by) / metres_per_pixel
    scale = F.when((metres > 0) & (pixels > 0), metres / F.when(pixels > 0, pixels))
    moved = F.struct((ax - a.x * scale).alias("ox"), (ay + a.y * scale).alias("oy"), scale.alias("metres_per_pixel"))
    return F.when(scale.isNotNull(), moved).otherwise(F.struct(ox.alias("ox"), oy.alias("oy"), metres_per_pixel.alias("metres_per_pixel")))


def wall_panels(length: Column, height: Column, openings: Column) -> Column:
    """What is solid of a wall: an array of from, to, bottom, top, given its openings (an array of the same).

    The wall is cut into strips at the openings' ends; in each strip the openings are taken from below and what is
    between them stays, sills and lintels too.
    """
    ends = F.concat(F.array(F.lit(0.0), length), F.transform(openings, lambda o: o["from"]), F.transform(openings, lambda o: o["to"]))
    cuts = F.array_sort(F.array_distinct(ends))
    strips = F.filter(F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s.b - s.a >= 0.0001)
    from_below = F.array_sort(F.transform(openings, lambda o: F.struct(o.bottom.alias("bottom"), o.top.alias("top"), o["from"].alias("a"), o["to"].alias("b"))))
    panel = lambda s, low, high: F.struct(s.a.alias("from"), s.b.alias("to"), low.alias("bottom"), high.alias("top"))
    none = F.array().cast("array<struct<from:double,to:double,bottom:double,top:double>>")

    def of(s: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("cursor"), none.alias("out"))
        step = lambda c, o: F.struct(F.greatest(c["cursor"], o.top).alias("cursor"), F.when(o.bottom > c["cursor"], F.array_append(c["out"], panel(s, c["cursor"], o.bottom))).otherwise(c["out"]).alias("out"))
        last = lambda c: F.when(c["cursor"] < height, F.array_append(c["out"], panel(s, c["cursor"], height))).otherwise(c["out"])
        return F.aggregate(F.filter(from_below, lambda o: (o.a < s.b) & (o.b > s.a)), start, step, last)

    return F.flatten(F.transform(strips, of))


def on_turned_box(x: Column, y: Column, cx: Column, cy: Column, width: Column, depth: Column, degrees: Column) -> Column:
    """Whether a point lies on a box of ``width`` and ``depth`` around (cx, cy) that is turned by ``degrees``; its border belongs to it."""
    turn = F.radians(degrees)
    along = (x - cx) * F.cos(turn) + (y - cy) * F.sin(turn)
    across = (y - cy) * F.cos(turn) - (x - cx) * F.sin(turn)
    return (F.abs(along) <= width / 2) & (F.abs(across) <= depth / 2)
