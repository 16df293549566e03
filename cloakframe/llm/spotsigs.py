"""SpotSigs document fingerprints.

A spot is a common word (the anchor); its signature is the anchor with the chain of the next ``CHAIN`` content words, common
words left out. Anchors are listed words and, for texts in other languages, short words that are frequent in the corpus. A
document's fingerprint is its set of signatures, likeness is the Jaccard index of two sets.

``near_duplicates`` finds all near pairs: equal sets collapse, sets meet by the signatures of their prefixes and by bands of
length (those whose sizes differ by more than the wanted likeness allows can't reach it), what prefixes share bounds what sets
can share, and what is left is compared. ``edited_neighbours`` gives the exact likeness of given pairs beside the class of
each document. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column_name, durable, join_unique, release, written
from .quality import VOCABULARY
from .setjoin import BITMAP, LIKENESS, SAMPLE, bitmap_columns, first_members_column, member_order, similar_components

#: Content words in a chain.
CHAIN = 3
#: Documents of one slice of the order by doc_id, slices at most, and sampled ids for each.
SLICE, MOST_SLICES, POINTS = 512, 10_000, 20
#: Anchors taken from the corpus: letters at most, the share of documents that have the word, and how many.
ANCHOR_LETTERS, ANCHOR_SHARE, MOST_ANCHORS = 4, 0.2, 100


def _words(text: Column) -> Column:
    """Words in lower case: runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def corpus_anchors(docs: DataFrame) -> list[str]:
    """Listed common words and the short words that are common, counted over all texts."""
    short = F.array_distinct(F.filter(_words(F.col("text")), lambda w: (F.length(w) <= ANCHOR_LETTERS) & w.rlike(r"^\p{L}+$")))
    found = durable(docs.select(F.explode(short).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "short-words")
    least = F.lit(max(1.0, ANCHOR_SHARE * docs.count()))
    rows = found.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(MOST_ANCHORS).collect()
    return sorted({*VOCABULARY, *(r["w"] for r in rows)})


def with_signatures(docs: DataFrame, text: str, name: str, anchors=VOCABULARY) -> DataFrame:
    """Add ``name``: the sorted set of 32-bit signatures of the whole column ``text``, as array of int.

    Null and empty texts have none. A text with words but no full chain has one signature, of all its words.
    """
    w, c, a = (column_name(docs, x) for x in ("_words", "_content", "_anchors"))
    chain = ", ".join(f"{c}[p - j + {k}]" for k in range(CHAIN))
    out = docs.withColumn(w, _words(F.col(text)))
    out = out.withColumn(c, F.filter(w, lambda x: ~x.isin(*anchors)))
    out = out.withColumn(a, F.expr(f"filter(transform({w}, (x, i) -> if({_isin('x', anchors)}, i, -1)), x -> x >= 0)"))
    # The j-th anchor at place p has p - j content words before it.
    spots = f"transform(filter(transform({a}, (p, j) -> named_struct('p', p, 'j', j)), s -> s.p - s.j + {CHAIN} <= size({c})), s -> cast(xxhash64({w}[s.p], {chain.replace('p - j', 's.p - s.j')}) as bigint))"
    narrow = f"sort_array(array_distinct(transform({spots}, x -> cast(shiftrightunsigned(x, 32) - 2147483648 as int))))"
    alone = f"if(size({w}) = 0, cast(array() as array<int>), array(cast(shiftrightunsigned(xxhash64(array_join({w}, ' ')), 32) - 2147483648 as int)))"
    out = out.withColumn(name, F.expr(narrow))
    return out.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(F.expr(alone))).drop(w, c, a)


def _isin(x: str, anchors) -> str:
    return f"{x} in (" + ", ".join(f"'{w}'" for w in anchors) + ")"


def as_string(signatures: str) -> Column:
    """A fingerprint as text: eight hex digits for each signature, in order."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x.cast("long") + 2147483648)), 8, "0")), "")


def jaccard(a: str, b: str) -> Column:
    """Likeness of two signature arrays, 1.0 for two empty ones; sets of which one is empty aren't met."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _place() -> Column:
    """The order of rows: null doc_ids first, then doc_id; equal ones by a hash of their texts."""
    return F.struct(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("hash"))


def _slice_bounds(docs: DataFrame) -> list[tuple]:
    """Places that cut the rows into slices of about ``SLICE`` rows, ``MOST_SLICES`` at most, from a bounded sample of places."""
    places = durable(docs.select(_place().alias("p")).select("p.*"), "places")
    n = places.count()
    slices = max(1, min(MOST_SLICES, n // SLICE))
    every = max(1, n // (slices * POINTS))
    rows = sorted(set(map(tuple, places.where(F.pmod(F.xxhash64("named", "id", "hash"), F.lit(every)) == 0).limit(4 * slices * POINTS).collect())))
    step = len(rows) / slices
    return sorted({rows[int(i * step)] for i in range(1, slices)}) if step >= 1 else rows


def _slice_of(bounds: list[tuple]) -> Column:
    """The number of bounds that aren't after a row's place ``p``, by halving."""
    if not bounds:
        return F.lit(0)
    array = F.from_json(F.lit("[" + ",".join(f'{{"named":{str(bool(a)).lower()},"id":{b},"hash":{c}}}' for a, b, c in bounds) + "]"), "array<struct<named:boolean,id:long,hash:long>>")
    low_high = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        after = F.coalesce(F.get(array, middle) <= F.col("p"), F.lit(False)) & (acc["low"] < acc["high"])
        return F.struct(F.when(after, middle + 1).otherwise(acc["low"]).alias("low"), F.when(after | (acc["low"] >= acc["high"]), acc["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), low_high, halve)["low"]


def next_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, text, slice, guest: rows dealt out so that each meets the next by doc_id (the first after the last).

    Null doc_ids come first, equal ones in the order of a hash of their texts, then of their texts. Rows go to slices of the
    order, of like numbers of rows whatever the ids; each slice's first row goes also to the slice before it, so neighbours
    meet without one ordered task for all rows. One row a slice is ordered in one task.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = _slice_bounds(rows)
    rows = rows.withColumn("p", _place())
    rows = rows.withColumn("slice", _slice_of(bounds))
    firsts = durable(rows.groupBy("slice").agg(F.min("p").alias("p")), "firsts")  # ``MOST_SLICES`` rows at most
    order = Window.orderBy("slice")
    before = firsts.select("p", F.coalesce(F.lag("slice").over(order), F.max("slice").over(Window.partitionBy())).alias("slice"))
    guests = rows.drop("slice").join(F.broadcast(before), "p").groupBy("p", "slice").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    return both.select("doc_id", "text", "p", "slice", "guest").repartition("slice")


def with_next(dealt: DataFrame) -> DataFrame:
    """Rows dealt by ``next_texts`` with the next row's text and signatures."""
    w = Window.partitionBy("slice").orderBy("guest", "p", "text")
    return dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("next_signatures", F.lead("signatures").over(w)).where("not guest").drop("guest", "slice", "p")


def edited_neighbours(docs: DataFrame, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next text.
    class_id is that of ``near_duplicates``. Null texts are empty. A single row is its own next. doc_ids are longs of any
    size; null ones come first. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchors = corpus_anchors(docs)
    mark = written()
    classes = near_classes(docs, likeness, anchors)
    release(mark, classes)
    rows = with_next(with_signatures(next_texts(docs), "text", "signatures", anchors))
    rows = rows.withColumn("key", F.xxhash64("signatures"))
    # Keys of one row without likes have no class row.
    rows = rows.join(F.broadcast(classes) if classes.count() <= BROADCAST_ROWS else classes, "key", "left")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = with_signatures(rows.withColumn("edited", edited), "edited", "edited_signatures", anchors)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string("signatures").alias("fingerprint"),
        as_string("edited_signatures").alias("edited_fingerprint"),
        jaccard("signatures", "edited_signatures").alias("near_edited"),
        jaccard("signatures", "next_signatures").alias("near_next"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def near_classes(docs: DataFrame, likeness: tuple[int, int] = LIKENESS, anchors=VOCABULARY) -> DataFrame:
    """(doc_id, text) -> (key, class_id), stored: fingerprints that several rows have or that are linked, with the smallest doc_id reachable.

    ``key`` is the hash of a signature array. Links are Jaccard indexes of ``likeness`` or more.
    """
    rows = with_signatures(docs, "text", "signatures", anchors).select("doc_id", F.xxhash64("signatures").alias("key"), "signatures")
    rows = durable(rows.select("*", *bitmap_columns(F.col("signatures").cast("array<long>"))), "signatures")
    classes = durable(rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    some = rows.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(max(1, classes.count() // SAMPLE))) == 0)
    order = member_order(some.select(F.explode(F.col("signatures").cast("array<long>")).alias("member")))
    sets = rows.select("key", F.col("signatures").cast("array<long>").alias("members"), *BITMAP)
    # Of copies one in each partition at most goes on, and of those one.
    prefixes = sets.where(F.size("members") > 0).select("key", F.size("members").alias("n"), *BITMAP, F.explode(first_members_column("members", order, likeness)).alias("member")).distinct()

    def members_of(keys: DataFrame) -> DataFrame:
        wanted = durable(keys, "wanted")
        return sets.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "key", "left_semi").groupBy("key").agg(F.first("members").alias("members"))

    linked = durable(similar_components(prefixes, members_of, likeness), "linked").withColumnRenamed("node", "key")
    met = durable(classes.join(linked, "key", "left").where("n > 1 or root is not null").select("key", "first_id", F.coalesce("root", "key").alias("root")), "roots")
    n = met.count()
    by_root = met.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return durable(join_unique(met.select("key", "root"), by_root, "root", n, small=n).select("key", "class_id"), "class-ids")


def near_duplicates(docs: DataFrame, likeness: tuple[int, int] = LIKENESS, anchors=VOCABULARY) -> DataFrame:
    """(doc_id, text) -> doc_id, class_id: the smallest doc_id reachable over links of a Jaccard index of ``likeness`` or more.

    Equal fingerprints collapse first; documents without signatures are one class. Repeated rows stay; a row with a null
    doc_id has the class of its text, null if no doc_id is in it. An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    classes = near_classes(docs, likeness, anchors)
    keyed = with_signatures(docs, "text", "signatures", anchors).select("doc_id", F.xxhash64("signatures").alias("key"))
    found = keyed.join(F.broadcast(classes) if classes.count() <= BROADCAST_ROWS else classes, "key", "left")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
