"""Near-duplicates by bottom-k sketches of word-shingle sets, one hash function for all.

A document's set is hashed once; its sketch is the ``size`` least hash values. Documents with equal
sets become one node. Inverted lists hold, for each retained value, the nodes that have it. Two sets are
candidates if the similarity that the union of both sketches estimates is not far below the limit, so they
share many values; a node therefore needs only the lists of its rarest values, as many as it may lack and
one more (values that no other node has count among them). Of any two candidates at least one such list
is common, so no candidate is lost, and the long lists of common words and lines are mostly never made.

Short lists give all their pairs. In a long list every member is compared with one leader; lists whose
members are then connected are settled, so a group of copies costs one link per member. In the others each
member outside the leader's component meets all members, in tiles of bounded size: first by their
sketches, then, for the members that have a candidate there, by their whole sets. A tile returns a link at
most for each member and component. Every link is confirmed on whole sets; texts are fetched only for nodes
with candidates.

What is left out: that the estimate of two sets of just the limit's similarity is 5.5 deviations off has a
probability below 1e-7; sets of up to ``size`` shingles are always found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclake.llm.columns import shield
from topiclake.llm.text import LOWER, SOLID, Words, gram_hashes, mix, slices
from topiclake.operators.components import connected_components
from topiclake.session import small_side, stage

SIZE = 48
# Lists of up to so many members give all their pairs.
SHORT = 12
# Members of a list that meet in a task on each side, and bytes of their whole sets.
TILE, TILE_BYTES = 1024, 64 << 20
# Pairs of one hub that are confirmed in a row, and nodes whose names may be broadcast to find texts.
HUB_PAIRS = 512
SMALL_NODES = 1_000_000
# Bits of a bitmap for each row it lists; bits in a row of Spark's bitmaps, and rows of 4 kB at most.
LISTED_BITS, PIECE_BITS, MAX_PIECES = 16, 32_768, 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted hashes of the different shingles of each text.

    A text of fewer words, but not none, has the whole sequence as its only shingle.
    """
    words = Words(LOWER[data], offsets, SOLID)
    hashes = words.hashes()
    grams = gram_hashes(hashes, shingle).view(np.int64)
    bounds = words.bounds.tolist()
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            whole = mix(gram_hashes(hashes[a:b], b - a) + np.uint64(b - a))
            out.append(whole.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _sketches(df: DataFrame, shingle: int, size: int) -> DataFrame:
    """(_id, _key, n, _set, sketch) of texts (_id, _key, _text); ``_set`` is a digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                sets = shingle_sets(data, offsets, shingle)
                digests = [
                    hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), rows.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([s[:size] for s in sets], pa.list_(pa.int64())),
                    ],
                    ["_id", "_key", "n", "_set", "sketch"],
                )

    id_type = df.schema["_id"].dataType.simpleString()
    return df.mapInArrow(run, f"_id {id_type}, _key binary, n long, _set binary, sketch array<long>")


def union_estimate(a: Column, b: Column, size: int) -> Column:
    """Share of the ``size`` least values of both sketches that both hold."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    return F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least)


def _floor(limit: tuple, size: int) -> float:
    """Estimates below this are passed over."""
    share = limit[0] / limit[1]
    return share - 5.5 * math.sqrt(share * (1 - share) / size)


def _prefixes(nodes: DataFrame, floor: float) -> DataFrame:
    """(node, n, prefix, weight): the rarest values of each node that other nodes share.

    Candidates share ``floor`` of the larger sketch at least; the lists of the other values and one
    more, in the same order of rarity for all nodes, suffice to find them. ``weight`` is the length of a
    node's lists.
    """
    entries = nodes.select("node", F.size("sketch").alias("k"), F.explode("sketch").alias("key"))
    lengths = entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    lengths = small_side(stage(lengths, "lengths"), SMALL_NODES)
    shared = entries.join(lengths, "key").groupBy("node", "k").agg(
        F.array_sort(F.collect_list(F.struct("members", "key"))).alias("shared"),
        F.sum("members").alias("weight"),
    )
    needed = F.col("k") - F.ceil(F.lit(floor) * F.col("k") - F.lit(1e-9)).cast("int") + 1
    # Values of no other node are the rarest.
    left = needed - (F.col("k") - F.size("shared"))
    prefix = F.transform(F.slice("shared", F.lit(1), F.greatest(left, F.lit(0))), lambda x: x["key"])
    return shared.select("node", prefix.alias("prefix"), "weight").filter(F.size("prefix") > 0)


def _close(pairs: DataFrame, nodes: DataFrame, limit: tuple, size: int) -> DataFrame:
    """Pairs (u, v) whose sizes and union estimate allow a link."""
    numerator, denominator = limit
    a = nodes.select(F.col("node").alias("u"), F.col("n").alias("n_a"), F.col("sketch").alias("a"))
    b = nodes.select(F.col("node").alias("v"), F.col("n").alias("n_b"), F.col("sketch").alias("b"))
    return (
        pairs.join(a, "u")
        .join(b, "v")
        .filter(denominator * F.least("n_a", "n_b") >= numerator * F.greatest("n_a", "n_b"))
        .filter(union_estimate(F.col("a"), F.col("b"), size) >= _floor(limit, size))
        .select("u", "v")
    )


def _texts_of(roles: DataFrame, nodes: DataFrame, texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """The roles (node, ...) with the text of their node.

    What is asked for is broadcast if a count finds it small; then only the texts in question move. Rows
    that the table repeats (``repeated`` names them) come once.
    """
    named = roles.join(nodes.select("node", F.col("low").alias("_low"), F.col("low_key").alias("_low_key")), "node")
    again = small_side(repeated.select(F.col("_id").alias("_r"), F.col("_key").alias("_rk"), F.lit(True).alias("_again")))
    twice = (F.col("_low_key") == F.col("_rk")) & F.col("_low").eqNullSafe(F.col("_r"))
    named = stage(named.join(again, twice, "left").drop("_r", "_rk"), "wanted")
    found = texts.join(
        small_side(named, SMALL_NODES), (F.col("_key") == F.col("_low_key")) & F.col("_id").eqNullSafe(F.col("_low"))
    )
    once = found.filter("_again is null").select(*roles.columns, "_text")
    if named.filter("_again").isEmpty():
        return once
    many = found.filter("_again").groupBy(*roles.columns).agg(F.first("_text").alias("_text"))
    return once.unionByName(many)


def _confirmed(
    close: DataFrame, nodes: DataFrame, texts: DataFrame, repeated: DataFrame, shingle: int, limit: tuple
) -> DataFrame:
    """Links (u, v) among the candidates, on whole sets.

    The pairs of a hub ``v`` are dealt into parts; in each the hub's text comes first, then those of its
    partners, so that a text travels once per pair and no hub is in one task.
    """
    numerator, denominator = limit
    close = stage(close, "close")
    parts = close.groupBy("v").agg(F.ceil(F.count("*") / F.lit(HUB_PAIRS)).cast("int").alias("parts"))
    dealt = close.join(parts, "v").select(
        F.col("u").alias("node"), "v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), "u"
    )
    hubs = parts.select(
        F.col("v").alias("node"), "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(None).cast("long").alias("u"),
    )
    rows = _texts_of(hubs.unionByName(dealt), nodes, texts, repeated).select("v", "part", "u", "_text")
    rows = rows.repartition("v", "part").sortWithinPartitions("v", "part", F.asc_nulls_first("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.int64)
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                sets = shingle_sets(data, offsets, shingle)
                u, keep = rows.column(2), np.zeros(rows.num_rows, bool)
                partner = u.is_valid().to_numpy(zero_copy_only=False)
                for i, own in enumerate(sets):
                    if not partner[i]:
                        hub = own
                        continue
                    common = len(np.intersect1d(own, hub, assume_unique=True))
                    keep[i] = denominator * common >= numerator * (len(own) + len(hub) - common)
                yield pa.RecordBatch.from_arrays([u, rows.column(0)], ["u", "v"]).filter(pa.array(keep))

    return stage(rows.mapInArrow(run, "u long, v long"), "links")


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 1 << 10) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right.

    A few thousand values at a time become columns of two 0/1 matrices, whose product counts.
    """
    sets = [*left, *right]
    kinds, place = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # Only values on both sides count.
    sides = np.zeros((2, len(kinds)), bool)
    sides[(rows >= len(left)).astype(int), place] = True
    used = sides.all(axis=0)
    rows, place = rows[used[place]], (np.cumsum(used) - 1)[place[used[place]]]
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(used.sum()), columns):
        a, b = np.searchsorted(place, [begin, begin + columns])
        marks = np.zeros((len(sets), columns), np.float32)
        marks[rows[a:b], place[a:b] - begin] = 1
        out += marks[: len(left)] @ marks[len(left) :].T
    return out


def _tile_links(numerator: int, denominator: int):
    """Links of the members outside the leader's component in one tile of a list, on whole sets."""

    def run(table: pa.Table) -> pa.Table:
        node, root, first = (table.column(c).to_numpy() for c in ("node", "root", "first"))
        sets = _ragged(table.column("_set_values"))
        left, right = np.flatnonzero(first), np.arange(len(node))
        u, v = [], []
        if len(left) and len(np.unique(root)) > 1:
            common = intersections([sets[i] for i in left], sets)
            sizes = np.array([len(s) for s in sets])
            union = sizes[left][:, None] + sizes[None] - common
            linked = (denominator * common >= numerator * union) & (root[left][:, None] != root[None])
            share = common / np.maximum(union, 1)
            for i, row, similar in zip(left.tolist(), linked, share):
                hits = right[row]
                # One link to each other component, the best one.
                hits = hits[np.argsort(-similar[row], kind="stable")]
                _, one = np.unique(root[hits], return_index=True)
                u += [int(node[i])] * len(one)
                v += node[hits[one]].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _alive(numerator: int, denominator: int, floor: float):
    """Members of a tile with a candidate outside their component that no other list brings together."""

    def run(table: pa.Table) -> pa.Table:
        node, root, n, first = (table.column(c).to_numpy() for c in ("node", "root", "n", "first"))
        key = table.column("key")[0].as_py()
        sketches, prefixes = (_ragged(table.column(c)) for c in ("sketch", "prefix"))
        left = np.flatnonzero(first)
        common = intersections([sketches[i] for i in left], sketches)
        k = np.array([len(x) for x in sketches])
        hit = common >= floor * np.maximum(k[left][:, None], k[None]) - 1e-6
        hit &= denominator * np.minimum(n[left][:, None], n[None]) >= numerator * np.maximum(n[left][:, None], n[None])
        hit &= root[left][:, None] != root[None]
        # Of the lists that both are in, the one of the least value has the pair.
        before = [x[x < key] for x in prefixes]
        if hit.any() and any(len(x) for x in before):
            hit &= intersections([before[i] for i in left], before) == 0
        used = hit.any(0)
        asks = np.zeros(len(node), bool)
        asks[left] = hit.any(1)
        rows = np.flatnonzero(used | asks)
        return pa.table({
            "key": pa.array(np.full(len(rows), key)), "a": pa.array(np.full(len(rows), table.column("a")[0].as_py(), np.int32)),
            "b": pa.array(np.full(len(rows), table.column("b")[0].as_py(), np.int32)),
            "node": pa.array(node[rows]), "root": pa.array(root[rows]), "first": pa.array(asks[rows]),
        })

    return run


def _ragged(column: pa.ChunkedArray) -> list[np.ndarray]:
    rows = column.combine_chunks()
    rows = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows
    bounds, values = rows.offsets.to_numpy(), rows.values.to_numpy()
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _tiled(
    lists: DataFrame, leaders: DataFrame, roots: DataFrame, nodes: DataFrame,
    texts: DataFrame, repeated: DataFrame, shingle: int, limit: tuple, size: int,
) -> DataFrame | None:
    """Links within the long lists that hold several components; None if there is no such list.

    Members outside the leader's component are dealt over blocks, and so are all members; each block
    of the former meets each of the latter. Members are copied as often as the other side has blocks.
    """
    placed = lists.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    lead = leaders.join(roots.select(F.col("node").alias("v"), "root"), "v", "left").select(
        "key", F.coalesce("root", "v").alias("_main")
    )
    placed = placed.join(lead, "key").withColumn("out", F.col("root") != F.col("_main"))
    sizes = placed.groupBy("key").agg(
        F.count("*").alias("_all"), F.count_if("out").alias("_out"), F.sum("n").alias("_sum"),
    ).filter("_out > 0")
    members = stage(placed.join(sizes, "key").drop("_main"), "open")
    if members.isEmpty():
        return None
    least = F.ceil(8 * F.col("_sum") / F.lit(TILE_BYTES))
    outs = F.least(F.col("_out"), F.greatest(F.ceil(F.col("_out") / F.lit(TILE)), least)).cast("int")
    alls = F.least(F.col("_all"), F.greatest(F.ceil(F.col("_all") / F.lit(TILE)), least)).cast("int")
    place = F.xxhash64("node", "key")
    # As one that is compared: own block among the outer members, with every block of all members.
    left = members.filter("out").select(
        "key", "node", "root", "n", F.pmod(place, outs).cast("int").alias("a"),
        F.explode(F.sequence(F.lit(0), alls - 1)).alias("b"), F.lit(True).alias("first"),
    )
    right = members.select(
        "key", "node", "root", "n", F.explode(F.sequence(F.lit(0), outs - 1)).alias("a"),
        F.pmod(place, alls).cast("int").alias("b"), F.lit(False).alias("first"),
    )
    both = left.unionByName(right).groupBy("key", "a", "b", "node", "root", "n").agg(F.max("first").alias("first"))
    alive = stage(
        both.join(nodes.select("node", "sketch", "prefix"), "node").groupBy("key", "a", "b").applyInArrow(
            _alive(*limit, _floor(limit, size)), "key long, a int, b int, node long, root long, first boolean"
        ),
        "alive",
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                whole = pa.array(shingle_sets(data, offsets, shingle), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), whole], ["node", "_set_values"])

    found = _texts_of(alive.select("node").distinct(), nodes, texts, repeated)
    whole = found.mapInArrow(sets, "node long, _set_values array<long>")
    links = alive.join(whole, "node").groupBy("key", "a", "b").applyInArrow(_tile_links(*limit), "u long, v long")
    return stage(links, "tile_links")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.lit(0).alias("graph"), "u", "v")).select("node", "root")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
    limit: tuple[int, int] = (4, 5), size: int = SIZE,
) -> DataFrame:
    """Per document: ``key``, ``n_shingles``, ``component_id``, ``kept``, and what tells rows apart.

    Documents are linked if the intersection of their sets is at least ``limit`` of the union;
    ``component_id`` is the least key that links reach, and a document is kept if it is its own.
    ``set_key`` and ``text_key`` are digests of the set and the text; ``first_set`` marks the least
    set among the rows of the component's least key. One row out per row in. Null texts and texts without words
    are linked with nothing and kept. Rows of equal sets are always linked; repeated rows with the
    least key are all kept. A null key is never the least unless its component has no other, and
    such documents are kept too.
    """
    texts = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = texts.select("_id", F.unhex(F.md5("_text")).alias("_key"), "_text")
    rows = _sketches(texts, shingle, size).withColumn("_row", F.monotonically_increasing_id())
    rows = stage(rows, "sketched")
    # A node is a set, named by its first row; its text is that of the least key.
    named = F.struct("_id", "_key")
    low = F.coalesce(F.min(F.when(F.col("_id").isNotNull(), named)), F.min(named))
    nodes = rows.filter(F.col("_set").isNotNull()).groupBy("_set").agg(
        F.min("_row").alias("node"), low.alias("low"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch"),
    )
    nodes = stage(nodes.select("_set", "node", F.col("low._id").alias("low"), F.col("low._key").alias("low_key"), "n", "sketch"), "nodes")
    prefixes = stage(_prefixes(nodes, _floor(limit, size)), "prefixes")
    # From here on only nodes that share rare values count.
    known = nodes.select("node", "low", "low_key", "n", "sketch").join(prefixes, "node")
    known = stage(known, "known")
    lists = known.select("node", "n", "weight", F.explode("prefix").alias("key"))
    counts = lists.groupBy("key").agg(F.count("*").alias("members"), F.max(F.struct("weight", "node")).alias("l"))
    counts = stage(counts.filter("members > 1").select("key", "members", F.col("l.node").alias("v")), "lists")
    lists = stage(lists.join(counts, "key").select("key", "node", "n", "members", "v"), "members")

    short = lists.filter(F.col("members") <= SHORT)
    one = short.select("key", F.col("node").alias("u"), F.col("n").alias("n_u"))
    two = short.select("key", F.col("node").alias("v"), F.col("n").alias("n_v"))
    fits = limit[1] * F.least("n_u", "n_v") >= limit[0] * F.greatest("n_u", "n_v")
    pairs = one.join(two, "key").filter(F.col("u") < F.col("v")).filter(fits).select("u", "v")
    long = lists.filter(F.col("members") > SHORT)
    led = long.filter("node <> v").select(F.greatest("node", "v").alias("v"), F.least("node", "v").alias("u"))
    pairs = pairs.unionByName(led.select("u", "v")).distinct()
    repeated = rows.filter("n > 0").groupBy("_id", "_key").count().filter("count > 1")
    repeated = stage(repeated.select("_id", "_key"), "repeated")
    links = _confirmed(_close(pairs, known, limit, size), known, texts, repeated, shingle, limit)
    roots = stage(_components(links), "roots")
    leaders = counts.filter(F.col("members") > SHORT).select("key", "v")
    more = _tiled(long.select("key", "node", "n"), leaders, roots, known, texts, repeated, shingle, limit, size)
    if more is not None and not more.isEmpty():
        roots = stage(_components(links.unionByName(more)), "roots")

    members = nodes.join(roots, "node", "left").select(
        "_set", "low", F.coalesce("root", "node").alias("root")
    )
    least = members.groupBy("root").agg(F.min(F.struct("low", "_set")).alias("_least"))
    named = members.join(least, "root").select(
        "_set", F.col("_least.low").alias("component_id"), (F.col("_least._set") == F.col("_set")).alias("_first")
    )
    out = rows.select("_id", "_key", "n", "_set").join(named, "_set", "left")
    component = F.when(F.col("_set").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("_id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
        F.coalesce("_first", F.lit(True)).alias("first_set"),
        F.col("_set").alias("set_key"),
        F.col("_key").alias("text_key"),
    )


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
    limit: tuple[int, int] = (4, 5),
) -> DataFrame:
    """The rows of ``docs`` without all but one of each group; texts without words all stay.

    The row with the least key stays; among rows with that key, one of the least set, then the least
    text. Only what goes is joined with the rows, and only repeated rows are compared.
    """
    docs, restore = shield(docs, key, text)
    found = stage(near_duplicates(docs, key, text, shingle, limit), "near")
    pair = [F.col(key).alias("_drop_id"), F.col("text_key").alias("_drop_key")]
    grouped = found.filter("n_shingles > 0")
    stays = grouped.filter("kept and first_set")
    per_row = stays.groupBy(key, "set_key").agg(
        F.min("text_key").alias("text_key"), F.count("*").alias("rows")
    )
    repeated = stage(per_row.filter("rows > 1").select(*pair), "repeated")
    # Rows of repeated keys and sets are taken out too, one of each comes back.
    many = per_row.filter("rows > 1").select(F.col(key).alias("_i"), F.col("set_key").alias("_s"))
    again = stays.join(
        many, F.col(key).eqNullSafe(F.col("_i")) & (F.col("set_key") == F.col("_s")), "left_semi"
    )
    gone = grouped.filter("not (kept and first_set)").select(*pair).unionByName(again.select(*pair))
    gone = stage(gone.distinct(), "gone")
    marked = docs.withColumn("_key", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    safe, asked = _apart(marked, [key, "_key"], gone)
    same = F.col(key).eqNullSafe(F.col("_drop_id")) & (F.col("_key") == F.col("_drop_key"))
    left = asked.join(gone, same, "left_anti")
    # What comes back is among what goes.
    back = asked.join(repeated, same, "left_semi").dropDuplicates([key, "_key"])
    return restore(safe.unionByName(left).unionByName(back))


def _apart(rows: DataFrame, names: list[str], listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that are surely not in the table ``listed``, and the others, which a join must tell.

    Every listed row sets one bit of a bitmap of ``LISTED_BITS`` bits for each and bounded size, which is
    broadcast; a row whose bit is not set needs no join, so only what is listed is shuffled, and of the
    rest one row in ``LISTED_BITS``, or more where the bound holds.
    """
    pieces = math.ceil(LISTED_BITS * listed.count() / PIECE_BITS)
    pieces = min(max(pieces, 1), MAX_PIECES)

    def spot(columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(pieces * PIECE_BITS))

    bits = listed.select(spot(listed.columns).alias("_spot")).groupBy(
        F.floor(F.col("_spot") / PIECE_BITS).alias("_piece")
    ).agg(F.bitmap_construct_agg(F.pmod("_spot", F.lit(PIECE_BITS))).alias("_bits"))
    bits = F.broadcast(stage(bits, "bits"))  # MAX_PIECES rows at most
    place = F.pmod(spot(names), F.lit(PIECE_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))
    found = rows.withColumn("_piece", F.floor(spot(names) / PIECE_BITS)).join(bits, "_piece", "left")
    return found.filter(~is_set).select(*rows.columns), found.filter(is_set).select(*rows.columns)
