"""Connected components and cyclic orders of tables of links.

Links are contracted first: a task takes them in runs of a bounded number, in the order of cells if their nodes have places, and joins what
hangs together within a run.  Only what crosses runs is left, and that goes in rounds of pointer jumping, each one join and one
written table; if it is no more than one run takes, in one more run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrium.operators.routing import written

#: How many links a task joins at once.
RUN = 131_072


def cell(plan: Column, x: Column, y: Column, size: float = 256.0, wide: int = 16) -> list[Column]:
    """Where a link is: those of one square of ``wide`` cells meet in one task, cell by cell."""
    cx, cy = F.floor(x / size), F.floor(y / size)
    return [F.struct(plan, F.floor(cx / wide), F.floor(cy / wide)), F.struct(cx, cy)]


def _tasks():
    """(links to labels, items to chains): what tasks do to runs, with all that it needs."""

    def leaves_of(values: pa.Array) -> list[np.ndarray]:
        """The columns of an array of (nested) structs without nulls."""
        if pa.types.is_struct(values.type):
            return [leaf for child in values.flatten() for leaf in leaves_of(child)]
        if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
            return [np.unique(values.to_numpy(zero_copy_only=False), return_inverse=True)[1]]
        return [values.to_numpy(zero_copy_only=False)]

    def ranked(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rank of each value among the distinct ones, where each distinct one is first), in the order of values."""
        leaves = leaves_of(values)
        order = np.lexsort(leaves[::-1])
        new = np.ones(len(order), bool)
        new[1:] = False
        for leaf in leaves:
            ordered = leaf[order]
            new[1:] |= ordered[1:] != ordered[:-1]
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.cumsum(new) - 1
        return ranks, order[new]

    def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """The smallest of ``n`` numbers that links a, b lead to from each."""
        root = np.arange(n)
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while (further := new[new]).tobytes() != new.tobytes():
                new = further
            if (new == root).all():
                return root
            root = new

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks()

    def column(table: pa.Table, name: str) -> pa.Array:
        column = table.column(name)
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links a, b to node, label: the smallest node that links of the same run lead to."""
        for run in runs(batches):
            both = pa.concat_arrays([column(run, "a"), column(run, "b")])
            ranks, first = ranked(both)
            root = roots(ranks[: run.num_rows], ranks[run.num_rows :], len(first))
            yield pa.RecordBatch.from_arrays([both.take(pa.array(first)), both.take(pa.array(first[root]))], names=["node", "label"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items and their next ones to the chains within a run: item, head, place (steps from the head), after (what follows the chain), long, least, at (its place).

        A whole cycle is a chain that begins at its smallest item and that nothing follows.
        """
        for run in runs(batches):
            n = run.num_rows
            both = pa.concat_arrays([column(run, "item"), column(run, "next")])
            ranks, first = ranked(both)
            where = np.full(len(first), -1)
            where[ranks[:n]] = np.arange(n)
            ahead = where[ranks[n:]]
            before = np.full(n, -1)
            inner = ahead >= 0
            before[ahead[inner]] = np.flatnonzero(inner)
            least = roots(np.flatnonzero(inner), ahead[inner], n) if inner.any() else np.arange(n)
            # what has no head before it is a cycle, cut at its smallest item
            open_chain = np.zeros(n, bool)
            open_chain[least[before < 0]] = True
            whole = ~open_chain[least]
            low = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(low, least, ranks[:n])
            start = whole & (ranks[:n] == low[least])
            before[start] = -1
            place, head = (before >= 0).astype(np.int64), np.where(before >= 0, before, np.arange(n))
            while True:
                further = head[head]
                if (further == head).all():
                    break
                place, head = place + place[head], further
            long = np.bincount(head, minlength=n)
            group = np.full(n, -1)
            is_low = ranks[:n] == low[least]
            group[head[is_low]] = np.flatnonzero(is_low)
            low_of = group[head]
            tail = np.full(n, -1)
            ends = place == long[head] - 1
            tail[head[ends]] = np.flatnonzero(ends)
            after = pa.array(tail[head], mask=whole)
            items, nexts = column(run, "item"), column(run, "next")
            columns = [items, items.take(pa.array(head)), pa.array(place), nexts.take(after), pa.array(long[head]), items.take(pa.array(low_of)), pa.array(place[low_of])]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "head", "place", "after", "long", "least", "at"])

    return joined, chained


def _in_order(df: DataFrame, near: list[Column] | None) -> DataFrame:
    """``df`` with rows that are near each other in one task and next to each other there."""
    if not near:
        return df
    return df.withColumn("_at", near[0]).withColumn("_in", near[1]).repartition("_at").sortWithinPartitions("_at", "_in").drop("_at", "_in")


def components(nodes: DataFrame, links: DataFrame, near=None) -> DataFrame:
    """node, component (the smallest node that links (a, b) lead to) of every node (column ``node``).

    ``near`` gives the place of a node (two columns as of ``cell``), so that links of one place are contracted together; without it, both
    tables may have a column ``at`` (square, cell) that holds it.
    """
    kind = nodes.schema["node"].dataType
    placed = ["at"] if near is None and "at" in links.columns else []
    every = links.select("a", "b", *placed).union(nodes.select("node", F.col("node").alias("b"), *placed))
    made = T.StructType([T.StructField("node", kind), T.StructField("label", kind)])
    where = near(F.col("a")) if near else [F.col("at.square"), F.col("at.cell")] if placed else None
    labels = _in_order(every, where).select("a", "b").mapInArrow(_tasks()[0], made)
    # a node has a label of each run that it occurs in
    labels = written(labels.groupBy("node").agg(F.min("label").alias("low"), F.collect_set("label").alias("all")))
    left = labels.filter(F.size("all") > 1).select(F.col("low").alias("a"), F.explode("all").alias("b")).filter("a <> b").distinct()
    left = written(left)
    if left.count() <= RUN:
        solved = left.coalesce(1).mapInArrow(_tasks()[0], made).select(F.col("node").alias("low"), F.col("label").alias("component"))
    else:
        ends = left.select(F.col("a").alias("node")).union(left.select("b"))
        solved = _jumped(ends, left).select(F.col("node").alias("low"), "component")
    return labels.join(solved, "low", "left").select("node", F.coalesce("component", "low").alias("component"))


def _jumped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """As ``components``, in rounds.

    A round lets each node hear of its neighbours' components and then jump to the component of its component, so rounds grow
    with the logarithm of the longest chain.
    """
    ends = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b")
    both = written(ends.distinct())
    labels = written(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        nearer = labels.join(heard, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("other", "component")).alias("component"))
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = written(nearer.join(above, "component", "left").select("node", "was", F.least("component", F.coalesce("above", "component")).alias("component")))
        labels = jumped.select("node", "component")
        if jumped.filter("was <> component").isEmpty():
            return labels


def cycles(following: DataFrame, near=None) -> DataFrame:
    """item, cycle (its smallest item), place (steps from that item) and size, of a permutation (item, next).

    Chains within runs become one item each.  Of those, each looks twice as far ahead in every round, so a cycle of n of them takes log n rounds.
    ``near`` gives the place of an item (two columns as of ``cell``).
    """
    kind = following.schema["item"].dataType
    names = {"item": kind, "head": kind, "place": T.LongType(), "after": kind, "long": T.LongType(), "least": kind, "at": T.LongType()}
    made = T.StructType([T.StructField(n, k) for n, k in names.items()])
    chains = written(_in_order(following.select("item", "next"), near(F.col("item")) if near else None).mapInArrow(_tasks()[1], made))
    heads = written(chains.filter("place = 0 and after is not null").select("head", "after", "long", "least", "at"))
    solved = _ringed(heads) if not heads.isEmpty() else heads.select("head", F.col("least").alias("cycle"), F.col("long").alias("from"), F.col("long").alias("size"))
    place = F.when(F.col("cycle").isNull(), F.col("place")).otherwise(F.pmod(F.col("from") + F.col("place"), F.coalesce("size", "long")))
    return chains.join(solved, "head", "left").select("item", F.coalesce("cycle", "least").alias("cycle"), place.alias("place"), F.coalesce("size", "long").alias("size"))


def _ringed(chains: DataFrame) -> DataFrame:
    """head, cycle (the smallest item), from (steps from that item to the head), size of chains (head, after, long, least, at) that follow each other."""
    state = written(chains.select(F.col("head").alias("item"), F.col("after").alias("ahead"), F.struct("least", F.col("head").alias("of")).alias("least")))
    while True:
        other = state.select(F.col("item").alias("ahead"), F.col("ahead").alias("further"), F.col("least").alias("seen"))
        met = written(state.join(other, "ahead").select("item", "further", F.col("least").alias("was"), F.least("least", "seen").alias("least")))
        state = met.select("item", F.col("further").alias("ahead"), "least")
        if met.filter("was <> least").isEmpty():
            break
    cycle_of = state.select(F.col("item").alias("head"), F.col("least.least").alias("cycle"), F.col("least.of").alias("first"))
    # items from each head to the end of the chain before that with the smallest item
    own = chains.select("head", "after", "long", "at")
    chain = own.join(cycle_of, "head").select(F.col("head").alias("item"), "cycle", "first", F.when(F.col("after") != F.col("first"), F.col("after")).alias("ahead"), F.col("long").alias("steps"))
    chain = written(chain)
    while not chain.filter("ahead is not null").isEmpty():
        other = chain.select(F.col("item").alias("ahead"), F.col("ahead").alias("further"), F.col("steps").alias("more"))
        chain = written(chain.join(other, "ahead", "left").select("item", "cycle", "first", F.col("further").alias("ahead"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    base = chain.filter("item = first").join(own.select(F.col("head").alias("item"), "at"), "item").select("first", F.col("steps").alias("size"), "at")
    return chain.join(base, "first").select(F.col("item").alias("head"), "cycle", F.pmod(F.col("size") - F.col("steps") - F.col("at"), F.col("size")).alias("from"), "size")
