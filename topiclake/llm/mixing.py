"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words by weight, at most a multiple of what it has; what goes
above is shared again among the others. Target over size is the number of copies that every
document of the source should have: its whole part is given to all, its fractional part is rounded.

Rounding is pivotal. Two documents with fractional parts meet; words are moved from one to the other,
in a random direction, until one of the parts is 0 or 1. The directions are drawn so that each
document's expected copies stay what they were, and the words of both together do not change, so a
source misses its target by a part of one document only. The document whose part is still open meets
the next one. Documents are taken from the longest to the shortest, in blocks; what is open at the end
of each block is combined with that of other blocks in the same way, level by level, until one document
of the source is left, which takes the nearer side.

Built-in functions only. A block is a row, so no source, however large, is in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclake.llm.quality_rules import let
from topiclake.llm.shards import with_slots
from topiclake.operators.keys import assign_keys
from topiclake.session import small_side, stage

# Documents of a block, and blocks that are combined at a time.
BLOCK = 256


def source_targets(
    sizes: DataFrame, source: str, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """(rank, source, source_size, target) from rows (source, source_size), one per source.

    Sources by code point, null last, have the weights in turn. Together the targets are ``share``
    of all sizes (less if every source is at its limit), each at most ``most`` times its source.
    """
    ranked = assign_keys(sizes, "rank", 0, [F.asc_nulls_last(source)])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.withColumn("_weight", weight), "sources")
    limit = F.lit(float(most)) * F.col("source_size")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    # The words of a unit of weight; it rises as sources reach their limits.
    level, full = 0.0, -1
    while True:
        over = F.col("_weight") * F.lit(level) > limit
        free, held, now = ranked.agg(
            F.sum(F.when(over, 0.0).otherwise(F.col("_weight"))), F.sum(F.when(over, limit).otherwise(0.0)),
            F.count_if(over),
        ).first()
        if not free or now == full:
            break
        level, full = (total - held) / free, now
    if not free:
        return ranked.select("rank", source, "source_size", limit.alias("target"))
    return ranked.select(
        "rank", source, "source_size", F.least(F.col("_weight") * F.lit(level), limit).alias("target")
    )


def draw(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))


def _meet(held: Column, x: Column) -> Column:
    """The open document of a block after it has met the next one, and who has been rounded up."""

    def moved(m: Column) -> Column:
        up, down = F.least(m["a"], m["b"]), F.least(m["c"], m["d"])
        rises = x["u"] * (up + down) < down
        raised = F.array_append(held["ones"], held["i"])

        def of(who: Column, p: Column, ones: Column) -> Column:
            return F.struct(who["i"].alias("i"), p.alias("p"), who["s"].alias("s"), ones.alias("ones"))

        return (
            F.when(rises & (m["a"] <= m["b"]), of(x, x["p"] - up / x["s"], raised))
            .when(rises, of(held, held["p"] + up / held["s"], held["ones"]))
            .when(m["c"] <= m["d"], of(x, x["p"] + down / x["s"], held["ones"]))
            .otherwise(of(held, held["p"] - down / held["s"], F.array_append(held["ones"], x["i"])))
        )

    # Words that the one can still take or give, and the other give or take.
    masses = F.struct(
        ((1 - held["p"]) * held["s"]).alias("a"), (x["p"] * x["s"]).alias("b"),
        (held["p"] * held["s"]).alias("c"), ((1 - x["p"]) * x["s"]).alias("d"),
    )
    return let(masses, moved)


def _folded(items: Column) -> Column:
    """(i, p, s, ones) of a block: the open item, its part and size, and the items rounded up."""
    first = F.get(items, F.lit(0))
    start = F.struct(
        first["i"].alias("i"), first["p"].alias("p"), first["s"].alias("s"),
        F.array().cast("array<int>").alias("ones"),
    )
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, _meet)


def _blocks(items: DataFrame, level: int, *carried: str) -> DataFrame:
    """One row per (rank, block) of items (rank, at, p, s): what is open in it, and who is rounded up.

    The ``carried`` columns of a block's items are kept in ``rows``.
    """
    fields = [
        (F.col("at") % BLOCK).cast("int").alias("i"), F.col("p"), F.col("s"),
        draw(F.col("rank"), F.lit(level), F.col("at")).alias("u"),
    ]
    entry = F.struct(*fields, *(F.col(c) for c in carried))
    block = F.floor(F.col("at") / F.lit(BLOCK)).cast("long").alias("block")
    grouped = items.groupBy("rank", block).agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    folded = grouped.withColumn("open", _folded(F.col("rows")))
    rows = F.transform("rows", lambda r: F.struct(r["i"].alias("i"), *(r[c].alias(c) for c in carried)))
    return stage(
        folded.select("rank", "block", rows.alias("rows"), "open.i", "open.p", "open.s", "open.ones"),
        "blocks",
    )


def _values(blocks: DataFrame, up: Column) -> DataFrame:
    """(rank, block, row, up) of all items of the blocks; ``up`` is what the open one of a block gets."""
    value = F.when(F.array_contains("ones", F.col("row.i")), 1).when(F.col("row.i") == F.col("i"), up).otherwise(0)
    return blocks.withColumn("row", F.explode("rows")).select("rank", "block", "row", value.cast("int").alias("up"))


def mix(
    df: DataFrame, keep: Sequence[str], source: str, size: Column,
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """The ``keep`` columns of all rows with size, source_size, target, copies and taken.

    ``copies`` is how often the mix takes a row, ``taken`` its size times that; no row is taken more
    than ``most`` times, rounded up. A null size counts as 0, and rows of size 0 are taken 0 times. Null
    sources are one source, the last one. Rows equal in all ``keep`` columns and size get the copies of
    their places in any order; all else is decided by contents, so runs agree. An empty table
    gives an empty one. Names in ``keep`` that the result adds are refused.
    """
    added = {"size", "source_size", "target", "copies", "taken"}
    if added & {c.lower() for c in keep}:
        raise ValueError(f"columns {sorted(added)} are added, name yours otherwise")
    names = [f"_k{i}" for i in range(len(keep))]
    rows = df.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), F.col(f"`{source}`").alias("_source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
    )
    rows = stage(rows, "sized")
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    targets = stage(source_targets(sizes, "_source", weights, share, most), "targets")
    per_source = small_side(targets.select("_source", "rank", "source_size", "target"))
    rows = rows.withColumnRenamed("_source", "_of")
    rows = rows.join(per_source, F.col("_of").eqNullSafe(F.col("_source"))).drop("_of", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_whole", F.floor(rate)).withColumn("_part", rate - F.floor(rate))
    open_ = (F.col("_part") > 0) & (F.col("_size") > 0)

    # The longest first; copies of a document differ in nothing.
    name = F.md5(F.concat_ws(":", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names)))
    fraction = rows.filter(open_).select("rank", "_size", "_part", *names)
    placed = with_slots(fraction, "rank", [-F.col("_size"), name, *(F.col(n) for n in names)], "at")
    items = placed.withColumnsRenamed({"_part": "p"}).withColumn("s", F.col("_size").cast("double"))
    levels = [_blocks(items, 0, "_size", *names)]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        above = levels[-1].select("rank", F.col("block").alias("at"), "p", "s")
        levels.append(_blocks(above, len(levels)))
    decided = _values(levels[-1], F.when(F.col("p") >= 0.5, 1).otherwise(0))
    for blocks in reversed(levels[:-1]):
        value = decided.select(
            "rank", (F.col("block") * BLOCK + F.col("row.i")).alias("block"), F.col("up").alias("_up")
        )
        decided = _values(blocks.join(value, ["rank", "block"]), F.col("_up"))
    decided = decided.select("rank", F.col("row._size").alias("_size"), *(F.col(f"row.{n}").alias(n) for n in names), "up")
    rest = rows.filter(~open_).select("rank", "_size", *names, F.lit(0).alias("up"))
    per_rank = small_side(targets.select("rank", "source_size", "target"))
    out = decided.unionByName(rest).join(per_rank, "rank")
    whole = F.when((F.col("source_size") > 0) & (F.col("_size") > 0), F.floor(F.col("target") / F.col("source_size")))
    out = out.withColumn("copies", (F.coalesce(whole, F.lit(0)) + F.col("up")).cast("long"))
    return out.select(
        *(F.col(n).alias(c) for c, n in zip(keep, names)), F.col("_size").alias("size"), "source_size",
        "target", "copies", (F.col("_size") * F.col("copies")).alias("taken"),
    )


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The rows of the mix itself: each row of :func:`mix` as often as it is taken."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
