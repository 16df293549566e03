"""Self-join of sets by Jaccard likeness, without missing a pair; the result is connected components.

Sets as like as wanted share a member among their first ones in any common order, so only these prefixes are dealt out.
Members that are frequent in a sample come last, which leaves the rare ones in the prefixes; the order goes by buckets of
members, so that a small table holds it. Prefixes meet by member and
band of set length; a set goes to its own band and to the next. Members of one component needn't be compared with each
other: where many sets meet they are first compared with one pivot, a few times, then all that still lie in different
components and share enough of their prefixes. A bitmap of each whole set goes with its prefix: two bitmaps differ in no more
bits than their sets in members, so pairs that can't reach the likeness end where they meet. Every link is verified on whole sets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, join_unique, release, written
from .components import connected_components

#: Wanted likeness, as a fraction.
LIKENESS = (4, 5)
#: Sets in the sample that orders members, how often one counts as frequent there, how many such are told apart, and by how many buckets.
SAMPLE, FREQUENT, MOST, BUCKETS = 10_000, 8, 20_000, 1 << 16
#: Words of 64 bits in a bitmap, and which bits of a member choose its place there.
BITMAP, BITMAP_SHIFT = ("b0", "b1", "b2", "b3"), 16
#: Rounds of comparisons with pivots at most, and how many sets have to meet for one.
ROUNDS, MANY = 4, 50


def needed(n, m, likeness: tuple[int, int] = LIKENESS):
    """The least number of shared members with which sets of n and m reach the likeness, times ``sum(likeness)``."""
    return likeness[0] * (n + m)


def alike(a: str, b: str, likeness: tuple[int, int] = LIKENESS) -> Column:
    """Whether two set columns reach the likeness; sets of too different sizes aren't met."""
    n, m = F.size(a), F.size(b)
    fits = F.least(n, m) * likeness[1] >= F.greatest(n, m) * likeness[0]
    return F.when(fits, F.size(F.array_intersect(a, b)) * sum(likeness) >= needed(n, m, likeness)).otherwise(False)


def member_order(sample: DataFrame) -> list[int]:
    """For each bucket of members (remainder by ``BUCKETS``) its place in the common order, from (member) rows of a sample of the sets.

    A bucket with a member that is frequent in the sample comes the later the more frequent that is, all others come first.
    The order decides the cost only.
    """
    bucket = F.pmod("member", F.lit(BUCKETS).cast("long")).cast("int")
    counted = sample.groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.desc("n"), "member").limit(MOST).select(bucket.alias("b")).collect()
    order = [0] * BUCKETS
    for place, r in enumerate(reversed(rows), 1):
        order[r["b"]] = place
    return order


def prefix_length(n, likeness: tuple[int, int] = LIKENESS):
    """How many first members of a set of n are its prefix."""
    return n - -(-n * likeness[0] // likeness[1]) + 1


def first_members(members: np.ndarray, order: np.ndarray, likeness: tuple[int, int] = LIKENESS) -> np.ndarray:
    """The prefix of a set: its first members by (place of the bucket, member)."""
    place = order[members % BUCKETS]
    return members[np.lexsort((members, place))[: prefix_length(len(members), likeness)]]


def first_members_column(members: str, order: list[int], likeness: tuple[int, int] = LIKENESS) -> Column:
    """The same prefix of an array of longs, by column functions."""
    n = F.size(members)
    places = F.split(F.lit(",".join(map(str, order))), ",").cast("array<int>")
    keyed = F.transform(members, lambda m: F.struct(F.get(places, F.pmod(m, F.lit(BUCKETS).cast("long")).cast("int")).alias("place"), m.alias("member")))
    return F.slice(F.sort_array(keyed), F.lit(1), (n - F.ceil(n * likeness[0] / F.lit(likeness[1])) + 1).cast("int"))["member"]


def bitmap(members: np.ndarray) -> list[int]:
    """The bitmap of a set, as signed longs: each member flips one bit."""
    places = (members >> np.int64(BITMAP_SHIFT)) & np.int64(64 * len(BITMAP) - 1)
    odd = (np.bincount(places, minlength=64 * len(BITMAP)) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


def bitmap_columns(members: str) -> list[Column]:
    """The same bitmap of an array of longs, by column functions. Store it before rows multiply: plans evaluate it after an explode."""

    def word(i: int) -> Column:
        def flip(acc: Column, m: Column) -> Column:
            mine = F.shiftright(m, BITMAP_SHIFT + 6).bitwiseAND(F.lit(len(BITMAP) - 1).cast("long")) == i
            bit = F.shiftright(m, BITMAP_SHIFT).bitwiseAND(F.lit(63).cast("long")).cast("int")
            return F.when(mine, acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))).otherwise(acc)

        return F.aggregate(members, F.lit(0).cast("long"), flip)

    return [word(i).alias(b) for i, b in enumerate(BITMAP)]


def _hopeful(likeness: tuple[int, int]) -> Column:
    """Whether sets of n and m members, with bitmaps b and other_b, can reach the likeness by their sizes and bitmaps."""
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"other_{b}"))) for b in BITMAP), F.lit(0))
    total = F.col("n") + F.col("m")
    # Sets of n and m that differ in d members share (n + m - d) / 2.
    return (F.least("n", "m") * likeness[1] >= F.greatest("n", "m") * likeness[0]) & ((total - differ) * sum(likeness) >= 2 * needed(F.col("n"), F.col("m"), likeness))


def _verified(pairs: DataFrame, members_of, likeness: tuple[int, int]) -> DataFrame:
    """Those of the (u, v) pairs that reach the likeness, stored. Only sets of these keys are dealt out."""
    pairs = durable(pairs.select("u", "v"), "pairs")
    keys = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
    if not pairs.take(1):
        return pairs
    own = durable(members_of(keys), "sets")
    left = join_unique(pairs, own.select(F.col("key").alias("u"), F.col("members").alias("a")), "u", heavy=50)
    return durable(left.join(own.select(F.col("key").alias("v"), F.col("members").alias("b")), "v").where(alike("a", "b", likeness)).select("u", "v"), "links")


def _no_pairs(spark: SparkSession, *names: str) -> DataFrame:
    """An empty table of longs; one made of a Python list would start Python workers of its own."""
    return spark.range(0).select(*[F.col("id").alias(c) for c in names])


def _relabelled(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have been linked: the label of each link's v becomes that of its u.

    Nodes of one label are connected, while connected nodes may have several labels: labels only save comparisons.
    """
    label = lambda c, name: _no_pairs(links.sparkSession, c, name) if roots is None else roots.select(F.col("node").alias(c), F.col("root").alias(name))
    named = links.join(label("u", "ru"), "u", "left").join(label("v", "rv"), "v", "left").select(F.coalesce("ru", "u").alias("to"), F.coalesce("rv", "v").alias("root"))
    moves = durable(named.where("to <> root").groupBy("root").agg(F.min("to").alias("to")), "moves")
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    fresh = nodes.join(label("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    every = fresh if roots is None else roots.unionByName(fresh).distinct()
    out = every.join(F.broadcast(moves) if moves.count() <= BROADCAST_ROWS else moves, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return durable(out, "roots")


def _banded(shared: DataFrame, roots: DataFrame | None, likeness: tuple[int, int]) -> DataFrame:
    """Prefix rows with their component, once in their band of lengths and once as guests in the next."""
    rows = shared.withColumn("root", F.col("key")) if roots is None else shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(likeness[1] / likeness[0]) + 1e-9)
    both = F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))
    rows = rows.select("*", F.explode(both).alias("g")).select("member", "key", "n", *BITMAP, "root", "g.band", "g.own")
    mixed = rows.groupBy("member", "band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("own").alias("any"), F.count("*").alias("meet")).where("low <> high and any").select("member", "band", "meet")
    return durable(rows.join(mixed, ["member", "band"]), "banded")


def similar_components(prefixes: DataFrame, members_of, likeness: tuple[int, int] = LIKENESS, seed: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(member long, key long, n int, bitmap), the members of each set's prefix -> (node, root) of the keys with another in their component; root is the least key in it.

    Components are those of all pairs with a Jaccard index of ``likeness`` or more. A key has one set; empty sets have no
    links. ``members_of`` gives (key, members array<long>), one row a key, for a table of keys; members are distinct. ``seed``
    has (u, v) pairs that are worth comparing first. With ``sizes``, (key, n, bitmap) with one row a key, prefixes have members
    and keys only; most members are in one set alone, so fewer rows move with sizes and bitmaps.
    """
    own = Window.partitionBy("member")
    shared = prefixes.withColumn("low", F.min("key").over(own)).withColumn("high", F.max("key").over(own)).where("low <> high").drop("low", "high")
    shared = durable(shared if sizes is None else shared.join(sizes, "key"), "shared")
    links = _no_pairs(prefixes.sparkSession, "u", "v") if seed is None else _verified(seed.where("u <> v"), members_of, likeness)
    roots = None if seed is None else _relabelled(None, links)
    apart = (F.col("root") != F.col("other")) & _hopeful(likeness)
    others = [F.col(b).alias(f"other_{b}") for b in BITMAP]
    for k in range(ROUNDS):
        mark = written()
        many = _banded(shared, roots, likeness).where(F.col("meet") > MANY)
        if many.isEmpty():
            break
        # Each set is compared with that pivot of another component with which it shares most of its prefix.
        first = many.where("own").groupBy("member", "band").agg(F.min_by(F.struct(F.col("key").alias("u"), F.col("n").alias("m"), F.col("root").alias("other"), *others), F.xxhash64("key", F.lit(k))).alias("f")).select("member", "band", "f.*")
        pairs = many.join(first, ["member", "band"]).where(apart).groupBy("u", "key").agg(F.count("*").alias("c"))
        pairs = pairs.groupBy(F.col("key").alias("v")).agg(F.max_by("u", F.struct("c", "u")).alias("u"))
        new = _verified(pairs, members_of, likeness)
        if new.isEmpty():
            break
        links = durable(links.union(new), "links")
        roots = _relabelled(roots, new)
        release(mark, links, roots)
    # All that is known to be connected counts as one before the rest is compared.
    roots = None if roots is None else durable(connected_components(links), "roots")
    # Of two prefixes, what the one that ends first shares lies in the other, so their overlap bounds the sets'.
    rows = _banded(shared, roots, likeness)
    other = rows.select("member", "band", F.col("key").alias("u"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("own").alias("owned"), *others)
    pairs = rows.where("own").join(other, ["member", "band"]).where(apart).where("not owned or key < u")
    pairs = pairs.groupBy("key", "u").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    # A set of n has n * likeness members, rounded up, less one after its prefix.
    after = F.ceil(F.greatest("n", "m") * likeness[0] / likeness[1]) - 1
    pairs = pairs.where((F.col("c") + after) * sum(likeness) >= needed(F.col("n"), F.col("m"), likeness)).select("u", F.col("key").alias("v"))
    return connected_components(links.union(_verified(pairs, members_of, likeness)))
