"""Quality rules: divergence of a document's histograms from its language's references.

Two histograms are taken of every whole text: character classes, and common words (with one bin for all other words).
Reference histograms are sums over all documents of a language. A document of at least ``MIN_WORDS`` words is refused
when the Jensen-Shannon distance of either histogram from its language's reference passes its limit; shorter documents
don't say enough and are left to the base rules. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, durable, let, split_words

#: Words below which no divergence is judged.
MIN_WORDS = 50
#: Largest Jensen-Shannon distances (base 2, 0 to 1) from the language's reference: a floor, and what is added to it divided by
#: the root of the number of words, as the distance of a fair sample falls with its size in that way.
MAX_CLASS_DISTANCE = (0.2, 0.5)
MAX_COMMON_DISTANCE = (0.15, 2.0)
#: Languages of fewer words than this have no reference.
MIN_REFERENCE_WORDS = 2000

#: Frequent words of some languages.
COMMON_WORDS = {
    "en": "the of and to in is that it was for on are with as be by this from at or a an he they you not have his her but".split(),
    "fr": "le la les de des du un une et est que qui dans pour par sur avec au aux ce il elle ne pas en se son plus ou à".split(),
    "de": "der die das und ist in den von zu mit dem des ein eine auf für nicht sich als auch es an werden aus er hat dass sie nach bei".split(),
    "es": "el la los las de del que y en un una es por con para se su al lo como más no pero sus le o este sí porque entre".split(),
}
VOCABULARY = sorted(set().union(*COMMON_WORDS.values()))
#: Character classes, taken off in this order; what is left is the class of all others.
CLASSES = ["[a-z]+", SPACE + "+", "[A-Z]+", "[0-9]+", r"[^\x00-\x7F]+", "[#*$%&|<>]+", r"[.,;:!?'\"()\[\]{}\-_/]+"]
#: Where white space and symbols stand among the classes.
SPACES, SYMBOLS = 1, 5
#: Words of a window.
WINDOW = 5


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common.

    classes and common are histograms as arrays of long. A null text has no words and empty histograms.
    """
    t = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("w", split_words(F.col("t")))
    t = t.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Each word is hashed once; a window of five words is the hash of its words' hashes, taken in step.
    t = t.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    window = "slice(h, 1, greatest(0, size(h) - 4))"
    for k in range(1, WINDOW):
        window = f"zip_with({window}, slice(h, {k + 1}, greatest(0, size(h) - 4)), (a, b) -> xxhash64(a, b))"
    t = t.withColumn("g", F.expr(window))
    # Windows found again lie side by side once sorted; only texts that have any are sorted with positions.
    t = t.withColumn("s", F.expr("if(size(array_distinct(g)) = size(g), cast(array() as array<struct<h: bigint, p: int>>), sort_array(transform(g, (x, i) -> named_struct('h', x, 'p', i))))"))
    t = t.withColumn("p", F.expr("sort_array(transform(filter(s, (x, i) -> coalesce(get(s, i - 1).h = x.h, false) or coalesce(get(s, i + 1).h = x.h, false)), x -> x.p))"))
    t = t.withColumn("letters", F.split(F.lower("t"), r"[^\p{L}]+"))
    # Only a text's first and last piece can be empty.
    ends = F.when(F.element_at("letters", 1) == "", 1).otherwise(0) + F.when((F.element_at("letters", -1) == "") & (F.size("letters") > 1), 1).otherwise(0)
    t = t.withColumn("n_lower", (F.size("letters") - ends).cast("long"))
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])

    def histogram(m: Column) -> Column:
        """Counts of the vocabulary's words among the words ``m``; only those that occur are looked for in the joined text."""
        both = F.struct(F.array_distinct(m).alias("there"), F.concat(F.lit(" "), F.array_join(m, "  "), F.lit(" ")).alias("joined"))
        gone = lambda x, v: F.length(x) - F.length(F.replace(x, F.concat(F.lit(" "), v, F.lit(" ")), F.lit("")))
        return let(both, lambda x: F.transform(vocabulary, lambda v: F.when(F.array_contains(x["there"], v), (gone(x["joined"], v) / (F.length(v) + 2)).cast("long")).otherwise(F.lit(0).cast("long"))))

    t = t.withColumn("common", let(F.filter("letters", lambda x: x.isin(VOCABULARY)), histogram))
    for i, c in enumerate(CLASSES):
        t = t.withColumn(f"r{i}", F.regexp_replace("t" if i == 0 else f"r{i - 1}", c, ""))
    lengths = [F.length("t"), *(F.length(f"r{i}") for i in range(len(CLASSES)))]
    classes = [*(a - b for a, b in zip(lengths, lengths[1:], strict=False)), lengths[-1]]
    return t.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        (lengths[0] - classes[SPACES]).cast("long").alias("word_chars"),
        classes[SYMBOLS].cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(p, (x, i) -> least(5, coalesce(get(p, i + 1), x + 5) - x)), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.array(*[c.cast("long") for c in classes]).alias("classes"),
        F.concat("common", F.array(F.col("n_lower") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x))).alias("common"),
    )


def references(feats: DataFrame) -> DataFrame:
    """Histograms of each language over all documents: lang, ref_classes, ref_common, ref_words. One row a language; null lang is one too.

    Bins are summed as rows of (language, histogram, bin): a few hundred sums a language, partly summed before they are dealt out.
    """
    words = feats.groupBy("lang").agg(F.sum("n_words").alias("ref_words"))
    bins = None
    for name in ("classes", "common"):
        one = feats.select("lang", F.lit(name).alias("name"), F.posexplode(name).alias("bin", "n")).groupBy("lang", "name", "bin").agg(F.sum("n").alias("n"))
        bins = one if bins is None else bins.unionByName(one)
    folded = bins.groupBy("lang").agg(*[F.array_sort(F.collect_list(F.when(F.col("name") == n, F.struct("bin", "n"))))["n"].alias(f"ref_{n}") for n in ("classes", "common")])
    return words.join(folded, words["lang"].eqNullSafe(folded["lang"])).select(words["lang"], "ref_words", "ref_classes", "ref_common")


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance, base 2, of two count arrays of one length; null where either is all zero.

    Sums are bound once; the mixture's terms come from one pass over both arrays.
    """
    return F.expr(f"""
        transform(array(named_struct('p', aggregate({p}, 0D, (a, x) -> a + x), 'q', aggregate({q}, 0D, (a, x) -> a + x))), t ->
            if(t.p > 0 and t.q > 0, sqrt(greatest(0D, aggregate(
                zip_with({p}, {q}, (u, v) -> named_struct('x', u / t.p, 'y', v / t.q)), 0D,
                (a, s) -> a + if(s.x > 0, s.x * log2(2 * s.x / (s.x + s.y)), 0D) + if(s.y > 0, s.y * log2(2 * s.y / (s.x + s.y)), 0D)) / 2)), cast(null as double)))[0]""")


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_class: tuple[float, float] = MAX_CLASS_DISTANCE, max_common: tuple[float, float] = MAX_COMMON_DISTANCE) -> DataFrame:
    """(doc_id, text, lang) -> features, class_distance, common_distance, base_failed, kept; one row for each row.

    Null and empty texts have no words and fail the base rule; a null lang is compared with the documents without one;
    repeated rows are judged each for itself; an empty table gives an empty one. Distances are null where there is
    nothing to compare, and then don't count.
    """
    feats = durable(features(docs), "quality")
    refs = references(feats)
    found = feats.join(F.broadcast(refs) if _few(refs) else refs, feats["lang"].eqNullSafe(refs["lang"]), "left").drop(refs["lang"])
    found = found.withColumns({"class_distance": js_distance("classes", "ref_classes"), "common_distance": js_distance("common", "ref_common")})
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = (F.col("n_words") >= min_words) & (F.coalesce("ref_words", F.lit(0)) >= MIN_REFERENCE_WORDS)
    less = 1 / F.sqrt(F.greatest("n_words", F.lit(1)))
    far = F.lit(False)
    for distance, (floor, more) in (("class_distance", max_class), ("common_distance", max_common)):
        far = far | (F.coalesce(distance, F.lit(0.0)) > floor + more * less)
    return found.withColumn("base_failed", base).withColumn("kept", ~base & ~(judged & far)).drop("ref_classes", "ref_common", "ref_words")


def _few(refs: DataFrame, most: int = 10_000) -> bool:
    """Broadcast only a counted number of languages."""
    return refs.select("lang").limit(most + 1).count() <= most
