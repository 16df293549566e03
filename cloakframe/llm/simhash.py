"""SimHash near-duplicates, linked by a binary trie self-join under a Hamming error budget.

Copies collapse first: the join works on distinct fingerprints. Fingerprints within ``budget`` bits agree in at
least ``kept`` of ``budget + kept`` blocks of bits, so they are dealt out under every choice of ``kept`` blocks and
meet in a group. In a group the trie over its fingerprints is joined with itself: node pairs go down together,
differing bits add up, and a pair beyond the budget goes no further. A group gives a star for each of its
components rather than its pairs, and the stars are joined by distributed connected components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batches_of, column_name, durable, join_unique, occupies, release, written
from .components import connected_components
from .setjoin import BITMAP, LIKENESS, SAMPLE, bitmap, first_members, member_order, similar_components

BITS = 64
#: Distinct fingerprints that a group holds on average, at most; beyond it more blocks have to agree.
GROUP = 512
#: Fingerprints beyond which a group is dealt out once more.
HOT = 20_000
#: Node pairs that a task holds at once.
FRONTIER = 1_000_000
#: Texts that a Python worker gets at once.
BATCH = 500
#: Fingerprints of whole groups that a task joins at once.
CHUNK = 50_000


def _hashed(text: str | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of the shingles of ``shingle`` words, repeats included, of all words where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    return [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)), strict=False)] or [xxhash.xxh64_intdigest(b" ".join(words), 42)]


def _sign(hashed: list[int]) -> int:
    if not hashed:
        return 0
    ones = np.unpackbits(np.array(hashed, dtype=">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed)).view(">u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of word shingles, repeats included: bit set if set in over half the XXH64 (seed 42) of the shingles. No words: 0."""
    return _sign(_hashed(text, shingle))


def _shingle_set(hashed: list[int]) -> tuple[int, np.ndarray]:
    """The set of hashes, and its own hash as its key; both as signed longs."""
    members = np.unique(np.array(hashed, dtype=np.uint64)).view(np.int64)
    return (xxhash.xxh64_intdigest(members.tobytes(), 42) ^ 1 << 63) - (1 << 63), members


def _fingerprints(shingle: int):
    """(doc_id, row, text) -> doc_id, row, fp."""

    def run(batches):
        occupies("simhash")
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "row", "fp"])

    return run


def _sets(shingle: int, likeness: tuple[int, int], places: np.ndarray):
    """(doc_id, row, text) -> doc_id, row, the set's key, size, prefix and bitmap, and the fingerprint, of one hashing of each text."""

    def run(batches):
        occupies("simhash")
        for batch in batches:
            keys, fps, sizes, prefixes, bitmaps = [], [], [], [], []
            for t in batch.column("text"):
                hashed = _hashed(t.as_py(), shingle)
                key, members = _shingle_set(hashed)
                keys.append(key)
                fps.append(_sign(hashed))
                sizes.append(len(members))
                prefixes.append(first_members(members, places, likeness) if len(members) else members)
                bitmaps.append(bitmap(members))
            words = np.array(bitmaps, dtype=np.int64).reshape(-1, len(BITMAP))
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(keys, pa.int64()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), *map(pa.array, words.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "key", "fp", "n", "prefix", *BITMAP])

    return run


def _members(shingle: int):
    """(key, text) -> key, members."""

    def run(batches):
        occupies("simhash")
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                sets = [_shingle_set(_hashed(t.as_py(), shingle))[1] for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.list_(pa.int64()))], ["key", "members"])

    return run


def _sampled_members(shingle: int):
    def run(batches):
        occupies("simhash")
        for batch in batches:
            for t in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(_hashed(t.as_py(), shingle))[1])], ["member"])

    return run


def trie_pairs(fps: np.ndarray, starts: np.ndarray, budget: int, frontier: int = FRONTIER):
    """Index pairs of fingerprints in the same group within ``budget`` bits, in blocks.

    fps: uint64, ascending and distinct within each group; starts: the groups' first indexes, then len(fps).
    A trie node is a range of the sorted fingerprints: those that share its leading bits.
    """
    one, zero = np.uint64(1), np.int64(0)
    lo, hi = starts[:-1].astype(np.int64), starts[1:].astype(np.int64)
    # A block of node pairs: depth, ranges of both nodes, differing bits; a node with itself has diff -1.
    stack = [(0, lo, hi, lo, hi, np.full(len(lo), -1))]
    ones_at: dict[int, np.ndarray] = {}
    while stack:
        depth, lo_a, hi_a, lo_b, hi_b, diff = stack.pop()
        alone = (diff >= 0) & (hi_a - lo_a == 1) & (hi_b - lo_b == 1)
        if alone.any():
            a, b = lo_a[alone], lo_b[alone]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= budget
            if near.any():
                yield a[near], b[near]
        go = ~alone & ~((diff < 0) & (hi_a - lo_a < 2))
        if depth == BITS or not go.any():
            continue
        lo_a, hi_a, lo_b, hi_b, diff = (x[go] for x in (lo_a, hi_a, lo_b, hi_b, diff))
        if len(lo_a) > frontier:
            half = len(lo_a) // 2
            stack += [(depth, *(x[s] for x in (lo_a, hi_a, lo_b, hi_b, diff))) for s in (slice(None, half), slice(half, None))]
            continue
        if depth not in ones_at:
            if len(ones_at) > 8:
                ones_at.clear()
            ones_at[depth] = np.concatenate([[zero], np.cumsum((fps >> np.uint64(BITS - 1 - depth)) & one, dtype=np.int64)])
        ones = ones_at[depth]
        mid_a, mid_b = hi_a - (ones[hi_a] - ones[lo_a]), hi_b - (ones[hi_b] - ones[lo_b])
        own = diff < 0
        pairs = [
            (lo_a, mid_a, lo_b, mid_b, diff),
            (mid_a, hi_a, mid_b, hi_b, diff),
            (lo_a, mid_a, mid_b, hi_b, np.where(own, 1, diff + 1)),
            tuple(x[~own] for x in (mid_a, hi_a, lo_b, mid_b, diff + 1)),
        ]
        new = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        keep = (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= budget)
        stack.append((depth + 1, *(x[keep] for x in new)))


def _roots(n: int, pairs) -> np.ndarray:
    """For each index the least index that it is linked with, directly or not."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            low = np.minimum(ra, rb)
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while (root != root[root]).any():
                root = root[root]
    return root


def _stars(budget: int):
    def join(fps: np.ndarray, keys: np.ndarray):
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        root = _roots(len(fps), trie_pairs(fps, np.r_[cuts, len(fps)], budget))
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[linked].view(np.int64)), pa.array(fps[root[linked]].view(np.int64))], ["u", "v"])

    def run(batches):
        occupies("simhash")
        fps, keys = np.empty(0, np.uint64), np.empty((0, 2), np.int64)
        for batch in batches:
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)])
            keys = np.concatenate([keys, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "bits")], 1).astype(np.int64)])
            if len(fps) >= CHUNK and (keys[0] != keys[-1]).any():
                end = int(np.argmax((keys == keys[-1]).all(1)))  # the last group may go on
                yield flip(join(fps[:end], keys[:end]))
                fps, keys = fps[end:], keys[end:]
        if len(fps):
            yield flip(join(fps, keys))

    def flip(batch):  # back from the order of signed longs
        return pa.RecordBatch.from_arrays([pa.array((c.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)) for c in batch.columns], ["u", "v"])

    return run


def block_masks(budget: int, kept: int) -> list[int]:
    """Signed 64-bit masks of every choice of ``kept`` of ``budget + kept`` blocks of bits."""
    n = budget + kept
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in (sum(c) for c in combinations(blocks, kept))]


def _masks_column(masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(i).cast("long").alias("block"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)])


def _split_masks(mask: int, budget: int) -> list[int]:
    """The mask's bits together with each of ``budget + 1`` blocks of the other bits."""
    other = [b for b in range(BITS) if not (mask % (1 << BITS)) >> b & 1]
    cuts = [len(other) * i // (budget + 1) for i in range(budget + 2)]
    wider = [mask % (1 << BITS) | sum(1 << b for b in other[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in wider]


def deal(fps: DataFrame, budget: int, kept: int, hot: int = HOT) -> DataFrame:
    """Distinct fp longs -> (fp, block, bits): the groups in which any two within ``budget`` bits meet.

    A group of more than ``hot`` fingerprints is dealt once more by blocks of the bits that it doesn't share, so it becomes
    many groups that share more; near ones still meet, since they differ in ``budget`` bits at most.
    """
    masks = block_masks(budget, kept)
    dealt = fps.select("fp", F.explode(_masks_column(masks)).alias("g")).select("fp", F.col("g.block").alias("block"), F.col("fp").bitwiseAND(F.col("g.mask")).alias("bits"))
    large = durable(dealt.groupBy("block", "bits").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("block", "bits"), "large")
    if large.isEmpty():
        return dealt
    wider = F.create_map(*[x for i, m in enumerate(masks) for x in (F.lit(i).cast("long"), F.array(*[F.lit(w).cast("long") for w in _split_masks(m, budget)]))])
    again = dealt.join(large, ["block", "bits"], "left_semi").select("fp", "block", F.posexplode(wider[F.col("block")]).alias("k", "mask"))
    again = again.select("fp", (F.col("block") + len(masks) * (F.col("k") + 1)).alias("block"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    return dealt.join(large, ["block", "bits"], "left_anti").select("fp", "block", "bits").unionByName(again)


def link_fingerprints(fps: DataFrame, budget: int = 3, hot: int = HOT) -> DataFrame:
    """Distinct fp longs -> (node, root) of those with another within ``budget`` bits; root is the least fp reachable.

    How many blocks have to agree follows the number of fingerprints, which keeps groups small; every choice finds the same links.
    """
    n, kept = fps.count(), 1
    while kept < 4 and n / 2 ** (BITS * kept / (budget + kept)) > GROUP:
        kept += 1
    stars = deal(fps, budget, kept, hot).repartition("block", "bits").sortWithinPartitions("block", "bits", "fp").mapInArrow(_stars(budget), "u long, v long")
    return connected_components(stars)


def near_duplicates(docs: DataFrame, budget: int = 3, shingle: int = 3, row: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, fp (long), root (the component's least fp), component_id: the smallest doc_id reachable over links of at most ``budget`` bits.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows stay; a row with a null
    doc_id has the component of its text, null if no doc_id is in it. An empty table gives an empty table. Texts of any
    length are read whole. Other columns aren't read, but for a long column that ``row`` names: it is passed on as row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (F.lit(None) if row is None else F.col(row)).cast("long").alias("row"), "text")
    own = durable(rows.mapInArrow(_fingerprints(shingle), f"doc_id {kind}, row long, fp long"), "fingerprints")
    classes = durable(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    linked = durable(link_fingerprints(classes.select("fp"), budget), "linked")
    found = _with_components(own, classes, linked, "fp")
    return found.drop("row") if row is None else found


def _with_components(own: DataFrame, classes: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """Rows of ``own`` with root and component_id; ``classes`` has the least doc_id of each key, ``linked`` the root of keys that are linked.

    A component's least doc_id goes to its members by ``join_unique``, as one component may hold most keys.
    """
    members = durable(linked.join(classes, linked["node"] == classes[key]).select(F.col("node").alias(key), "root", "first_id"), "members")
    n = members.count()
    members = join_unique(members.select(key, "root"), members.groupBy("root").agg(F.min("first_id").alias("component_id")), "root", n, small=n)
    by_class = classes.join(members, key, "left").select(key, F.coalesce("root", key).alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    return join_unique(own.select("doc_id", "row", key), durable(by_class, "components"), key).select("doc_id", "row", F.col(key).alias("fp"), "root", "component_id")


def as_hex(fp):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def similar_documents(docs: DataFrame, shingle: int = 5, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """(doc_id, text, row) -> doc_id, row, fp, root, component_id as ``near_duplicates``, linked where the sets of word shingles have a Jaccard index of ``likeness`` or more.

    ``row`` is a number of each row's own, stored with it. ``fp`` is the hash of the set. Each text is hashed once for its
    key, its fingerprint and its prefix; what the trie join links is compared first, the join of the prefixes finds the
    rest. Null and empty texts have the empty set and are one component.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = docs.select("row").count()
    some = docs.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    order = member_order(some.mapInArrow(_sampled_members(shingle), "member long"))
    own = durable(docs.select("doc_id", "row", "text").mapInArrow(_sets(shingle, likeness, np.array(order, dtype=np.int32)), f"doc_id {kind}, row long, key long, fp long, n int, prefix array<long>, {", ".join(f"{b} long" for b in BITMAP)}"), "set-keys")
    classes = durable(own.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), F.min("row").alias("row")), "classes")
    near = classes.join(link_fingerprints(classes.select("fp").distinct()).withColumnRenamed("node", "fp"), "fp", "left").select("key", F.coalesce("root", "fp").alias("near"))
    near = durable(near, "near")
    n = near.count()
    seed = join_unique(near, near.groupBy("near").agg(F.min("key").alias("v")), "near", n, small=n).select(F.col("key").alias("u"), "v")
    # One row of each set goes on; its prefix is there already.
    firsts = own.join(classes.select("key", "row"), ["key", "row"], "left_semi")
    prefixes = firsts.select(F.explode("prefix").alias("member"), "key")

    def members_of(keys: DataFrame) -> DataFrame:
        wanted = durable(classes.join(keys, "key", "left_semi").select("key", "row"), "wanted-rows")
        texts = docs.select("row", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "row")
        return texts.select("key", "text").mapInArrow(_members(shingle), "key long, members array<long>")

    linked = durable(similar_components(prefixes, members_of, likeness, seed, firsts.select("key", "n", *BITMAP)), "linked")
    return _with_components(own, classes.select("key", "first_id"), linked, "key")


def deduplicated(docs: DataFrame, shingle: int = 3, likeness: tuple[int, int] | None = None, **options) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest doc_id, any other before those without a doc_id.

    Components are those of ``similar_documents`` if a likeness is given, of ``near_duplicates`` otherwise. Of rows of one
    component with the same doc_id one stays; a doc_id that repeats in several components stays in each of which it is the
    smallest. Null and empty texts are one component; texts of any length are read whole; columns keep their names, whatever
    they are; an empty table gives an empty one.
    """
    own, row, mark = docs.columns, column_name(docs, "_row"), written()
    stored = durable(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    rows = stored.select("doc_id", "text", F.col(row).alias("row"))
    with batches_of(docs.sparkSession, BATCH):
        found = durable(similar_documents(rows, shingle, likeness) if likeness else near_duplicates(rows, shingle=shingle, row="row", **options), "found")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "row")).alias("k")).select(F.col("k.row").alias("row"))
    gone = durable(found.join(kept, "row", "left_anti").select(F.col("row").alias(row)), "gone")
    release(mark, stored, gone)
    return stored.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, row, "left_anti").select(*own)
