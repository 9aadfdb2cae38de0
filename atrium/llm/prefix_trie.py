"""Operator 11: the prefix trie of conversations, by truncation peeling.

A node is a distinct sequence of first turns; it knows its members, children, the leaves below it and the words that a
cache of prefixes would save.  Peeling starts at the maximum depth: the conversations that end there are grouped, a group
is a node, its last turns are stripped, and what is left meets the conversations that end further up.  So nodes are found and
aggregated in one descent, and copies of one conversation are one row from the start.

Turns between two places where the company of a conversation changes (a *run*) have one set of members, so
a strip takes off a whole run: a first count marks the prefixes at which a conversation ends or two children
part, and a class of equal conversations is the path of its marks.  Rounds are then the marks on one path (two to ten), not the turns
of the longest conversation; all turns of a run follow from its deepest one in closed form.

A prefix is told by 128 bits: the XOR over its turns of two 64-bit hashes of place and MD5 of (role, text).  XOR can be summed by a
window whatever their number, and texts are read once and never shuffled.  Ids of the conversations that end at one node
are joined in pieces of neighbouring ids; a node with more than one piece is hashed as a stream over its pieces, so
no array holds a group.

Defined cases: rows with a null conversation id are left out; a null role or text is empty; turns of one number (null
numbers first) are in the order of their hashes, repeated rows are turns of their own; a conversation without turns is a member of the root
alone; a table without conversations has no nodes; texts and conversations may have any length; only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrium.llm.common import kept, short_batches

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids of one piece of a node's list agree in all but so many bits.
PIECE_BITS = 12
#: Runs with more children than this have copies, over which the children are dealt.
HOT = 2000
COPIES = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame) -> DataFrame:
    """conv, pos (from 1), turn_hash (MD5 of role and text), words of the table's turns (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    of = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit("|"), role, text).cast("binary")))
    rows = df.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", of.alias("turn_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "turn_hash")
    return rows.withColumn("pos", F.row_number().over(order)).drop("turn")


def shared_starts(own: DataFrame, every: int = 20, parts: int = 4) -> DataFrame:
    """conv, pos, turn_hash, words of rebuilt conversations: c takes the first h turns of c - c % ``every``, then its own after its first h.

    h is the CRC-32 of the decimal c modulo ``parts``.  A row with pos 0 stands for each conversation, so that one without turns is there.
    """
    h = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(parts)).cast("int")
    starts = own.filter((F.pmod("conv", F.lit(every)) == 0) & (F.col("pos") < parts)).withColumnRenamed("conv", "start")
    starts = starts.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("pos", "turn_hash", "words"))).alias("first"))  # fewer than ``parts`` rows
    convs = own.filter("pos = 1").select("conv", (F.col("conv") - F.pmod("conv", F.lit(every))).alias("start"))
    heads = convs.join(starts, "start", "left").select("conv", F.coalesce(F.slice("first", F.lit(1), h("conv")), F.array().cast("array<struct<pos:int,turn_hash:binary,words:bigint>>")).alias("first"))
    # the root stands at pos -parts and the head between it and 0 until all are numbered together
    zero = F.array(F.struct(F.lit(-parts).alias("pos"), F.lit(None).cast("binary").alias("turn_hash"), F.lit(0).cast("long").alias("words")))
    taken = F.transform("first", lambda t: F.struct((t["pos"] - parts).cast("int").alias("pos"), t["turn_hash"].alias("turn_hash"), t["words"].alias("words")))
    rows = heads.select("conv", F.inline(F.concat(zero, taken))).union(own.filter(F.col("pos") > h("conv")).select("conv", "pos", "turn_hash", "words"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv").orderBy("pos")) - 1)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv, depth (0: root), words and up (of its last turn: the number, and the sum up to it), k1, k2 (the prefix), p1, p2 (without its last turn), last."""
    order = Window.partitionBy("conv").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    mark = lambda salt: F.when(F.col("pos") > 0, F.xxhash64("pos", "turn_hash", F.lit(salt))).otherwise(F.lit(0).cast("long"))
    rows = rebuilt.select("conv", F.col("pos").alias("depth"), "words", mark("k1").alias("m1"), mark("k2").alias("m2"), "pos")
    keyed = rows.select("conv", "depth", "words", F.sum("words").over(so_far).alias("up"), "m1", "m2", F.bit_xor("m1").over(so_far).alias("k1"), F.bit_xor("m2").over(so_far).alias("k2"), F.lead("pos").over(order).isNull().alias("last"))
    return keyed.select("conv", "depth", "words", "up", "k1", "k2", F.col("k1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("m2")).alias("p2"), "last")


def ends(rows: DataFrame) -> DataFrame:
    """k1, k2, n, conv (the smallest), ends_sha256 of each node at which conversations end."""
    piece = F.shiftright("conv", PIECE_BITS)
    pieces = rows.filter("last").groupBy("k1", "k2", piece.alias("piece")).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    pieces = kept(pieces.withColumn("sha", F.sha2(F.col("ids").cast("binary"), 256)))
    nodes = kept(pieces.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min("sha").alias("ends_sha256"), F.count(F.lit(1)).alias("pieces")))
    single, several = nodes.filter("pieces = 1").drop("pieces"), nodes.filter("pieces > 1").drop("pieces", "ends_sha256")
    streamed = pieces.join(several.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "piece", "ids").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece").mapInArrow(_hash_pieces, "k1 long, k2 long, ends_sha256 string")
    return single.unionByName(several.join(streamed, ["k1", "k2"]).select("k1", "k2", "n", "conv", "ends_sha256"))


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, piece, ids) in order -> k1, k2, SHA-256 of the ids of all pieces joined by commas."""
    key, state, done = None, None, []
    for batch in batches:
        for k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key is not None:
        done.append((*key, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=["k1", "k2", "ends_sha256"])


def paths(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """conv, n, ends_sha256, path of each class of equal conversations.  path: (depth, up, k1, k2) of the marked prefixes, from the shortest on, without the root.

    ``rows``: the prefixes of the classes' smallest members.  Marked are the ends and the prefixes with two children or more.
    """
    nodes = rows.filter("depth > 0").groupBy("p1", "p2", "k1", "k2").agg(F.max("last").alias("ended"))
    forks = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("children")).filter("children > 1").select("k1", "k2")
    marked = nodes.filter("ended").select("k1", "k2").union(forks).distinct()
    stops = rows.filter("depth > 0").select("conv", "depth", "up", "k1", "k2").join(marked, ["k1", "k2"])
    found = stops.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "up", "k1", "k2"))).alias("path"))
    none = F.array().cast("array<struct<depth:int,up:bigint,k1:bigint,k2:bigint>>")
    return classes.select("conv", "n", "ends_sha256").join(found, "conv", "left").withColumn("path", F.coalesce("path", none))


def peel(classes: DataFrame) -> DataFrame:
    """The runs of the trie (path, n, conv, children, leaves, below, ends_sha256), from the longest paths down to the root.

    n: members; conv: the smallest; below: the words saved by all deeper runs.
    """
    longest = classes.agg(F.max(F.size("path"))).first()[0]
    ended = classes.select("path", "n", "conv", F.lit(0).cast("long").alias("children"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("below"), "ends_sha256")
    if longest is None:
        return ended
    found, survivors = [], None
    for depth in range(longest, -1, -1):
        here = ended.filter(F.size("path") == depth)
        met = here if survivors is None else here.unionByName(survivors)
        sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "below")]
        level = met.groupBy("path").agg(*sums, F.min("conv").alias("conv"), F.max("ends_sha256").alias("ends_sha256"))
        level = kept(level.withColumn("leaves", F.greatest("leaves", F.lit(1))))
        found.append(level)
        rest = F.slice("path", 1, depth - 1) if depth > 1 else F.slice("path", 1, 0)
        survivors = level.select(rest.alias("path"), "n", "conv", F.lit(1).cast("long").alias("children"), "leaves", (F.col("below") + (F.col("n") - 1) * _run_words()).alias("below"), F.lit(None).cast("string").alias("ends_sha256"))
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def _last(path: Column, field: str, back: int = 1) -> Column:
    """A field of the path's element so many from its end; 0 above the first (the root)."""
    return F.coalesce(F.try_element_at(path, F.lit(-back))[field], F.lit(0))


def _run_words() -> Column:
    return _last(F.col("path"), "up") - _last(F.col("path"), "up", 2)


def nodes(df: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    short_batches(df.sparkSession)
    rows = kept(prefixes(shared_starts(turns(df))))
    classes = kept(ends(rows))
    first = kept(rows.join(classes.select("conv", "n"), "conv", "left_semi"))
    runs = peel(kept(paths(first, classes)))
    path = F.col("path")
    end = [_last(path, f).alias(f) for f in ("k1", "k2")]
    above = [_last(path, f, 2).alias(t) for f, t in (("k1", "a1"), ("k2", "a2"))]
    runs = kept(runs.select("n", F.col("conv").alias("member"), "children", "leaves", "below", "ends_sha256", _last(path, "depth").alias("deepest"), _last(path, "depth", 2).alias("above"), _last(path, "up").alias("up_to"), F.size("path").alias("marks"), *end, *above))
    return _spelled(first, _with_parent(runs))


def _with_parent(runs: DataFrame) -> DataFrame:
    """Adds parent, the smallest member of the run above.  Children of runs with many of them are dealt over copies of their parent."""
    deal = F.pmod(F.xxhash64("member", F.lit(11)), F.lit(COPIES)).cast("int")
    tops = runs.filter("children > 0").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), "children", F.col("member").alias("parent"))
    crowded = tops.filter(F.col("children") > HOT).select("a1", "a2", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("deal"), F.col("parent").alias("far"))
    below = runs.filter("marks > 0").withColumn("deal", deal).join(crowded, ["a1", "a2", "deal"], "left")
    rest = below.filter("far is null").drop("far").join(tops.filter(F.col("children") <= HOT).drop("children"), ["a1", "a2"])
    dealt = below.filter("far is not null").withColumnRenamed("far", "parent")
    return rest.unionByName(dealt).drop("deal").unionByName(runs.filter("marks = 0").withColumn("parent", F.lit(None).cast("long")))


def _spelled(first: DataFrame, runs: DataFrame) -> DataFrame:
    """Every node of every run: a run's turns have one set of members and one child each but for the deepest."""
    here = F.when(F.col("marks") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("above") + 1, F.col("deepest")))
    each = runs.withColumn("depth", F.explode(here)).withColumnRenamed("member", "conv")
    turn = first.select("conv", "depth", "words", "up")
    at_end, top = F.col("depth") == F.col("deepest"), F.col("depth") == F.col("above") + 1
    saved = F.col("below") + F.when(F.col("depth") > 0, (F.col("n") - 1) * (F.col("up_to") - F.col("up") + F.col("words"))).otherwise(0)
    return each.join(turn, ["conv", "depth"]).select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(top, F.col("parent")).when(F.col("depth") > 0, F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at_end, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )
