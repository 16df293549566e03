"""Identity maps and provenance as append-only tables.

A map is a table with a dense insertion number ``seq``. Additions are checked as a whole against themselves and the map
before any of them is written: an exact repeat adds nothing, a key or identity with another partner is a conflict.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import is_small, store
from ..types import AmbiguousMappingError, IdentifierConflictError, MapConflictError, ProvenanceConflictError

ENTITY_MAP = "seq long, alias string, real_value string, entity_type string, parent_alias string"
IDENTIFIER_MAP = "seq long, token string, identifier_value string, identifier_type string"
PROVENANCE = "job_id string, sheet_name string, row long, column int, token string, representation string"

#: key columns, identity columns and the error of each map
SHAPES = {
    "entity": (["alias"], ["real_value", "entity_type", "parent_alias"], MapConflictError),
    "identifier": (["token"], ["identifier_type", "identifier_value"], IdentifierConflictError),
    "provenance": (["job_id", "sheet_name", "row", "column"], ["token", "representation"], ProvenanceConflictError),
}
UNSET = object()
#: Keys of a range of a digest.
RANGE = 1 << 16


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def conflicts(additions: DataFrame, existing: DataFrame, shape: str) -> DataFrame:
    """(side, n): keys with several partners ("key") and, for maps, identities with several keys ("identity")."""
    keys, identity, _ = SHAPES[shape]
    new = additions.select(*keys, *identity)
    wanted = is_small(new)

    def part(side: str, by: list[str]) -> DataFrame:
        # Of the map only entries that share the key or identity with an addition matter.
        at = new.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
        old = existing.select(*keys, *identity).join(F.broadcast(at) if wanted else at, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left_semi")
        both = new.union(old).distinct()
        return both.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")

    parts = [part(*side) for side in ([("key", keys)] if shape == "provenance" else [("key", keys), ("identity", identity)])]
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def append(existing: DataFrame, additions: DataFrame, shape: str, order: list[Column] | None = None, stored: bool = False) -> DataFrame:
    """The map with the additions that it doesn't hold yet, numbered in ``order``; raises on any conflict, and then nothing is added.

    ``stored`` says that the additions are distinct and have one state already. What is added is written, the map isn't
    written again: the result reads both.
    """
    keys, identity, error = SHAPES[shape]
    additions = additions if stored else store(additions.distinct() if order is None else additions, "additions")
    for c in conflicts(additions, existing, shape).where("n > 0").collect():
        raise error("conflict", side=c["side"], count=c["n"])
    both = [*keys, *identity]
    old = existing.select(*[F.col(c).alias(f"old_{c}") for c in both])
    fresh = additions.join(old, [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in both], "left_anti")
    if shape == "provenance":
        return existing.unionByName(store(fresh.select(*existing.columns).distinct(), "provenance"))
    last = existing.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
    fresh = number(fresh.select(*both, *(["_first"] if "_first" in fresh.columns else [])), order or [F.col(c) for c in keys], last)
    return existing if fresh is None else existing.unionByName(store(fresh.select(*existing.columns), f"{shape}-map"))


def number(rows: DataFrame, order: list[Column], after: int) -> DataFrame | None:
    """``rows`` with ``seq`` from ``after`` + 1 on in the given order: range-sorted, numbered within partitions, with counts before. None if there are none."""
    placed = store(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id()), "numbering")
    within = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("_in")))
    before, base = {}, after
    for r in sorted(placed.groupBy("_part").count().collect()):
        before[r["_part"]], base = base, base + r["count"]
    if not before:
        return None
    start = F.create_map(*[F.lit(x) for p in before for x in (p, before[p])])[F.col("_part")]
    return within.withColumn("seq", (start + F.col("_n")).cast("long")).drop("_part", "_in", "_n")


def ordered(entries: DataFrame) -> DataFrame:
    """Entries in order: maps by insertion, provenance by coordinate."""
    return entries.orderBy("seq") if "seq" in entries.columns else entries.orderBy("sheet_name", "row", "column")


def contains(entries: DataFrame, key: str, value: str) -> bool:
    """Whether an alias or token is in use."""
    return not entries.where(F.col(key) == F.lit(value)).limit(1).isEmpty()


def at_coordinate(provenance: DataFrame, sheet_name: str, row: int, column: int) -> DataFrame:
    """The entry of one cell, if it has one."""
    return provenance.where((F.col("sheet_name") == F.lit(sheet_name)) & (F.col("row") == row) & (F.col("column") == column))


def cleared(entries: DataFrame) -> DataFrame:
    """An empty table of the same shape; a provenance's job stays with its folder."""
    return entries.sparkSession.createDataFrame([], entries.schema)


def lookup_token(identifier_map: DataFrame, identifier_type: str, value: str) -> str | None:
    """The token of an identifier."""
    found = identifier_map.where((F.col("identifier_type") == identifier_type) & (F.col("identifier_value") == F.lit(value))).select("token").limit(1).collect()
    return found[0]["token"] if found else None


def lookup_alias(entity_map: DataFrame, real_value: str, entity_type: str | None = None, parent_alias=UNSET) -> str | None:
    """The alias of a value; what isn't given isn't asked for, and several answers are an error."""
    found = entity_map.where(F.col("real_value") == F.lit(real_value))
    if entity_type is not None:
        found = found.where(F.col("entity_type") == entity_type)
    if parent_alias is not UNSET:
        found = found.where(F.col("parent_alias").eqNullSafe(F.lit(parent_alias)))
    rows = found.select("alias").limit(2).collect()
    if len(rows) > 1:
        raise AmbiguousMappingError("ambiguous_value")
    return rows[0]["alias"] if rows else None


def digest_header(domain: bytes, n: int) -> bytes:
    return len(domain).to_bytes(8, "big") + domain + n.to_bytes(8, "big")


def prefix_digest(entries: DataFrame, key: str, domain: bytes, n: int | None = None) -> str:
    """SHA-256 over domain, count and the digests of ranges of ``RANGE`` keys by seq, up to the ``n``-th key.

    A range's digest is the SHA-256 over its keys in order, each with its length as eight bytes. Ranges are hashed where the
    rows are; one digest a range goes through the driver.
    """
    n = entries.count() if n is None else n
    item = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(key)), 16, "0")), F.encode(key, "UTF-8"))
    ranges = entries.where(F.col("seq") <= n).groupBy(F.floor((F.col("seq") - 1) / RANGE).alias("range")).agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items"))
    joined = F.unhex(F.array_join(F.transform("items", lambda x: F.hex(x["item"])), ""))
    h = hashlib.sha256(digest_header(domain, n))
    for r in ranges.select("range", F.unhex(F.sha2(joined, 256)).alias("digest")).orderBy("range").toLocalIterator():
        h.update(bytes(r["digest"]))
    return h.hexdigest()
