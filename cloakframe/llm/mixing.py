"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents, passed over as often as ``max_epochs`` allows. A document's virtual finish
time, in each pass, is the number of its source's tokens up to and with it, divided by the source's weight. All passes of all
documents are range-sorted by virtual finish time. Prefix sums over the sorted partitions say which queues have run dry by
then, hence how fast virtual time goes on; at the first document at which the total budget is spent the order is truncated,
and documents in service at that time are cut there. A queue that runs dry leaves the rest to the others by weight, which is
what resharing an excess means.

Sizes are worked out once and stored without the texts. Running sums are dealt out by (source, slice of the shuffle order):
slices are summed first, and their number grows with the table, so a source with a third of all rows is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column_name, durable, split_words

#: Rows of one slice of a source's shuffle order on average, if the source had all rows; slices go by leading hex digits of the key.
SLICE_ROWS = 20_000


def source_weights(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 2) -> DataFrame:
    """(source, source_size, ...) -> those, weight, cap. Sources in code point order, null last, take ``weights`` in turn; a cap is what all passes hold.

    One row a source: the window is over sources, not documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place % len(weights) + 1)).withColumn("cap", F.col("source_size") * max_epochs)


def truncation(passes: DataFrame, budget: float, weight: int) -> float | None:
    """(finish, weight, cap, last) of passes of documents -> the virtual time at which ``budget`` is spent; None if the queues run dry before.

    ``weight`` is that of all queues that aren't empty; ``last`` marks the one pass with which its queue of ``cap`` runs dry.
    """
    drained = passes.select("finish", F.when(F.col("last"), F.col("weight")).otherwise(0).alias("weight"), F.when(F.col("last"), F.col("cap")).otherwise(0).alias("cap"))
    placed = durable(drained.repartitionByRange("finish").withColumn("part", F.spark_partition_id()), "served")
    sums = placed.groupBy("part").agg(F.sum("weight").alias("weight"), F.sum("cap").alias("cap"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sums = sums.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_parts") for c in ("weight", "cap")])
    inside = Window.partitionBy("part").orderBy("finish").rowsBetween(Window.unboundedPreceding, -1)
    before = {c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("weight", "cap")}
    dry = placed.select("part", "finish", *[before[c].alias(f"{c}_in") for c in before]).join(F.broadcast(sums), "part")  # one row a partition is broadcast
    left = F.lit(weight) - F.col("weight_parts") - F.col("weight_in")
    level = F.when(left > 0, (F.lit(budget) - F.col("cap_parts") - F.col("cap_in")) / left)
    return dry.select("finish", level.alias("level")).where("level <= finish").agg(F.min_by("level", "finish").alias("cut")).first()["cut"]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, source; other columns pass through) without its text, with what the mix takes of it.

    Added columns: size (words; null text: 0), source_size, weight, target (its source's), taken (words taken, repeats
    counted, at most ``max_epochs`` times size) and finish (virtual finish time of the first pass). Targets share ``share``
    times all sizes by weight, none above ``max_epochs`` times its source's size. The document at a source's target is cut
    there. Shuffled by md5 of doc_id, then doc_id and size, so reruns agree; repeated rows are separate documents, a null
    doc_id counts as the empty text, null is a source of its own. Columns of these names in ``docs``, in any case, are replaced;
    an empty table gives an empty one.
    """
    docs = docs.drop("size", "source_size", "weight", "target", "taken", "finish")
    own = [c for c in docs.columns if c.lower() != "text"]
    queue, key, part, base, last, cap, epoch = (column_name(docs, c) for c in ("_queue", "_key", "_part", "_base", "_last", "_cap", "_epoch"))
    sized = docs.select(
        *own,
        F.size(split_words(F.col("text"))).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias(queue),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias(key),
    )
    sized = durable(sized, "sizes")
    digits, n = 1, sized.count()
    while 16**digits * SLICE_ROWS < n:
        digits += 1
    sized = sized.withColumn(part, F.substring(key, 1, digits))
    slices = durable(sized.groupBy(queue, "source", part).agg(F.sum("size").alias("part_size")), "slices")
    sources = source_weights(slices.groupBy(queue, "source").agg(F.sum("part_size").alias("source_size")), weights, max_epochs).withColumnRenamed("cap", cap)
    sources = durable(sources, "sources")
    all_of = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(F.col("source_size") > 0, F.col("weight"))), F.lit(0)).alias("weight")).first()
    running = Window.partitionBy(queue).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    plan = slices.withColumn(base, F.coalesce(F.sum("part_size").over(running), F.lit(0))).drop("part_size", "source").join(sources.drop("source"), queue)
    within = Window.partitionBy(queue, part).orderBy(key, "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn(last, F.sum("size").over(within)).join(plan, [queue, part])
    first = F.col(base) + F.col(last) - F.col("size")
    # Each pass of each document, with the pass that empties its queue marked.
    end = first + F.col("size") + F.col(epoch) * F.col("source_size")
    each = placed.where("size > 0").withColumn(epoch, F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    cut = truncation(each.select((end / F.col("weight")).alias("finish"), "weight", F.col(cap).alias("cap"), (end == F.col(cap)).alias("last")), share * all_of["size"], all_of["weight"])
    target = F.col(cap).cast("double") if cut is None else F.least(F.col(cap).cast("double"), F.col("weight") * F.lit(cut))
    served = [F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - first - F.col("source_size") * e)) for e in range(max_epochs)]
    out = placed.withColumn("target", target).withColumn("taken", sum(served[1:], served[0]).cast("long")).withColumn("finish", (first + F.col("size")) / F.col("weight"))
    return out.select(*own, "size", "source_size", "weight", "target", "taken", "finish")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with their own columns, once for every pass that takes them, in the order of virtual time.

    The copy at a source's target keeps its first words only, and n_chars, if there, follows the text. Documents without
    words are never taken; null doc_ids, null sources and repeated rows count as in ``mix_sources``; an empty table gives
    an empty one. Rows are told apart by a number of their own. The passes are range-sorted without their texts; texts are then
    joined once and go straight to their places.
    """
    spark, own = docs.sparkSession, docs.columns
    row, at, passes = (column_name(docs, c) for c in ("_row", "_at", "_passes"))
    stored = durable(docs.withColumn(row, F.monotonically_increasing_id()), "mix-input")
    mixed = mix_sources(stored.select(F.col(row).alias("row"), "doc_id", "text", "source"), **options).where("taken > 0")
    mixed = mixed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")) - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    virtual = F.col("finish") + F.col("epoch") * F.col("source_size") / F.col("weight")
    order = mixed.select("row", virtual.alias("virtual"), F.when(words < F.col("size"), words.cast("int")).alias("words"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = durable(order.repartitionByRange(n, "virtual").withColumn("part", F.spark_partition_id()), "mix-order")
    by_row = order.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("part", "virtual", "words")).alias(passes))  # a pass each
    by_row = durable(by_row, "mix-passes")
    small = by_row.count() <= BROADCAST_ROWS
    out = stored.join(F.broadcast(by_row) if small else by_row, row).withColumn(at, F.explode(passes))
    # Repeated rows and ties keep an order of their own, so that a lost task gives the same rows again.
    out = out.repartitionById(n, F.col(at)["part"]).sortWithinPartitions(F.col(at)["virtual"], row)
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    words = F.col(at)["words"]
    out = out.withColumn("text", F.when(words.isNotNull(), F.array_join(F.slice(pieces, F.lit(1), words), "")).otherwise(F.col("text")))
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own)
