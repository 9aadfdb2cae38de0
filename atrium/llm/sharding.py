"""Operator 5: a uniform shuffle into shards of exact sizes, from a hypergeometric communication matrix.

Each input partition puts its rows in random order.  How many of them go to each shard is drawn exactly:
in a uniform permutation the counts of one partition follow a multivariate hypergeometric law given what
the partitions before it took.  The matrix is drawn down a tree of partitions (32 children to a node), so no
task sees more than 32 sizes and the nodes of a level are independent.  The first rows of a partition's
order go to shard 0, the next to shard 1, and so on; in its shard each row gets a random key, and the rank by
that key is its slot.  Ranks are counted in key ranges of bounded size, with the ranges' own offsets added.

Everything is DataFrame expressions.  A draw walks the probabilities outward from the mode, twelve standard
deviations to each side (what lies beyond has less than 1e-30, under the resolution of a double), and
takes the value where the running sum passes a uniform number.  All numbers are hashes of row and node
numbers, and the numbered rows are written to the shared folder first, so a task that runs again
draws the same.

Defined cases: null text has no bytes and the checksum of nothing; nulls and repeated rows are rows like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atrium.llm.common import kept

FAN = 32
#: Rows of a table that is broadcast, at most; beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _steps(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(u: Column, need: Column, good: Column, rest: Column) -> Column:
    """How many of ``need`` draws without replacement from ``good`` + ``rest`` items are good ones."""
    d = lambda c: c.cast("double")
    whole = d(good) + d(rest)
    low, high = F.greatest(F.lit(0).cast("long"), need - rest), F.least(need, good)
    middle = F.least(high, F.greatest(low, F.floor((d(need) + 1) * ((d(good) + 1) / (whole + 2))).cast("long")))
    spread = F.sqrt(d(need) * (d(good) / F.greatest(whole, F.lit(1.0))) * (d(rest) / F.greatest(whole, F.lit(1.0))) * (F.greatest(whole - d(need), F.lit(0.0)) / F.greatest(whole - 1, F.lit(1.0))))
    facts = F.struct(need.alias("need"), good.alias("good"), rest.alias("rest"), low.alias("low"), high.alias("high"), middle.alias("middle"), (F.ceil(spread * 12) + 16).alias("reach"))

    def draw(x: Column) -> Column:
        need, good, rest, mid = d(x.need), d(x.good), d(x.rest), x.middle
        up = lambda k: (good - d(k)) * (need - d(k)) / ((d(k) + 1) * (rest - need + d(k) + 1))  # noqa: E731  weight of k + 1 against k
        down = lambda k: d(k) * (rest - need + d(k)) / ((good - d(k) + 1) * (need - d(k) + 1))  # noqa: E731  weight of k - 1 against k
        above = _steps(mid, F.least(x.high, mid + x.reach) - 1)
        below = F.transform(_steps(F.greatest(x.low, mid - x.reach) + 1, mid), lambda k: -k)
        below = F.transform(F.array_sort(below), lambda k: -k)

        def total(ks: Column, ratio) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
            return F.aggregate(ks, start, lambda a, k: F.struct((a.w * ratio(k)).alias("w"), (a.s + a.w * ratio(k)).alias("s")), lambda a: a.s)

        def find(ks: Column, ratio, target: Column, step: int) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), mid.alias("at"))
            return F.aggregate(ks, start, lambda a, k: F.struct((a.w * ratio(k)).alias("w"), (a.s + a.w * ratio(k)).alias("s"), F.when(a.s < target, k + step).otherwise(a.at).alias("at")), lambda a: a.at)

        def pick(t: Column) -> Column:
            aim = u * (t.above + t.below + 1)
            return F.when(aim < 1, mid).when(aim < 1 + t.above, find(above, up, aim - 1, 1)).otherwise(find(below, down, aim - 1 - t.above, -1))

        return _with(F.struct(total(above, up).alias("above"), total(below, down).alias("below")), pick)

    return _with(facts, draw)


def shared_out(size: Column, room: Column, *seed: Column) -> Column:
    """``size`` rows over shards with ``room`` places each: an array of counts."""
    all_room = F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(size.alias("need"), all_room.alias("left"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, shard: Column) -> Column:
        good = F.get(room, shard)
        count = hypergeometric(uniform(*seed, shard), a.need, good, a.left - good)
        return _with(count, lambda c: F.struct((a.need - c).alias("need"), (a.left - good).alias("left"), F.array_append(a.out, c).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(room) - 1), start, step, lambda a: a.out)


def communication_matrix(sizes: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """From (part, n), one row for each input partition: part and ``counts``, the rows that it sends to each shard."""
    numbered = kept(sizes.select("part", "n", (F.row_number().over(Window.orderBy("part")) - 1).cast("long").alias("i")))
    parts, rows = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not parts:
        return numbered.select("part", F.array().cast("array<bigint>").alias("counts"))
    depth = 1
    while FAN**depth < parts:
        depth += 1
    room = F.array(*[F.lit(rows // shards + (s < rows % shards)).cast("long") for s in range(shards)])
    nodes = numbered.sparkSession.range(1).select(F.col("id").alias("i"), room.alias("room"))
    for level in range(depth):
        below = FAN ** (depth - 1 - level)
        child = numbered.groupBy(F.floor(F.col("i") / below).cast("long").alias("child")).agg(F.sum("n").alias("n"))
        family = child.groupBy(F.floor(F.col("child") / FAN).cast("long").alias("i")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("children"))
        start = F.struct(F.col("room").alias("room"), F.array().cast("array<struct<child:bigint,room:array<bigint>>>").alias("out"))

        def step(a: Column, c: Column) -> Column:
            taken = shared_out(c.n, a.room, F.lit(seed), F.lit(level), c.child)  # noqa: B023
            return _with(taken, lambda t: F.struct(F.zip_with(a.room, t, lambda x, y: x - y).alias("room"), F.array_append(a.out, F.struct(c.child.alias("child"), t.alias("room"))).alias("out")))

        dealt = nodes.join(family, "i").select(F.explode(F.aggregate("children", start, step, lambda a: a.out)).alias("c"))
        nodes = kept(dealt.select(F.col("c.child").alias("i"), F.col("c.room").alias("room")))
    return numbered.join(nodes, "i").select("part", F.col("room").alias("counts"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffled(df: DataFrame, shards: int = 8, columns: list | None = None, seed: int = 0, range_rows: int = 20_000) -> DataFrame:
    """``columns`` of every row with ``shard`` (0 to shards - 1, counts at most one apart) and ``slot`` (its place there)."""
    first = df.select(*(columns or df.columns), F.monotonically_increasing_id().alias("_row"))
    local = first.withColumn("_key", F.xxhash64(F.lit(seed), "_row")).sortWithinPartitions("_key", "_row").drop("_key", "_row")
    rows = kept(local.withColumn("_row", F.monotonically_increasing_id()))
    part, rank = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    sizes = kept(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")))
    matrix = kept(communication_matrix(sizes, shards, seed))
    n_parts, n = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    running = F.aggregate("counts", F.array().cast("array<bigint>"), lambda a, c: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + c))
    ends = matrix.select(F.col("part").alias("_part"), running.alias("_ends"))
    ranges = max(1, -(-n // (shards * range_rows)))
    sent = rows.withColumn("_part", part).join(_small(ends, n_parts), "_part")
    sent = sent.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= rank)).cast("int")).drop("_part", "_ends")
    sent = sent.withColumn("_key", F.xxhash64(F.lit(seed + 1), "_row")).withColumn("_range", F.floor(uniform(F.lit(seed + 2), F.col("_row")) * ranges).cast("int"))
    held = sent.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = held.select("shard", "_range", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_key", "_row")) - 1
    placed = sent.withColumn("_place", place).join(_small(offsets, shards * ranges), ["shard", "_range"])
    return placed.withColumn("slot", F.col("_before") + F.col("_place")).drop("_row", "_key", "_range", "_place", "_before")


def shard_documents(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null) of every row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    columns = [F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]
    done = shuffled(df, shards, columns, seed)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
