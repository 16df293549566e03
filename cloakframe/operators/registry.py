"""Relational checks of the artifact registry: lineage, files, stores and backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import is_hex32, is_hex64, is_label, is_period, is_timestamp

ARTIFACTS = (
    "seq long, artifact_id string, kind string, sha256 string, created_at string, parent_artifact_ids array<string>, period string, label string, "
    "source_job_id string, provenance_id string, provenance_sha256 string"
)


def format_problems(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, field): fields of a wrong format."""
    checks = {"artifact_id": is_hex32(F.col("artifact_id")), "sha256": is_hex64(F.col("sha256")), "created_at": is_timestamp(F.col("created_at")), "period": is_period(F.col("period")), "label": is_label(F.col("label"))}
    bad = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return artifacts.select("artifact_id", F.explode(bad).alias("field"))


def repeats(artifacts: DataFrame) -> DataFrame:
    """(field, value, n): ids, hashes and provenance ids that occur more than once."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("artifact_id", "sha256", "provenance_id")])
    return artifacts.select(F.explode(fields).alias("x")).select("x.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n")).where("n > 1")


def lineage_problems(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, reason): parents that don't come before their child, kinds of parents that don't fit, periods that don't fit.

    A monthly artifact has no parent; a canonical one has a monthly one, a canonical one, or a canonical and a monthly one,
    in that order; a restored one has one of either. Monthly parents and those of restored artifacts are of the same
    period, canonical ones of no later one.
    """
    child = artifacts.select("artifact_id", "seq", "kind", "period", F.posexplode_outer("parent_artifact_ids").alias("pos", "parent_id"))
    parent = artifacts.select(F.col("artifact_id").alias("parent_id"), F.col("seq").alias("parent_seq"), F.col("kind").alias("parent_kind"), F.col("period").alias("parent_period"))
    x = child.join(parent, "parent_id", "left")
    there = F.col("parent_id").isNotNull()
    same = F.col("parent_period") == F.col("period")
    period_ok = F.when(F.col("kind") == "local_restored", same).when(F.col("parent_kind") == "anonymized_monthly", same).otherwise(F.col("parent_period") <= F.col("period"))
    each = x.groupBy("artifact_id", "kind").agg(
        F.coalesce(F.bool_or(there & (F.col("parent_seq").isNull() | (F.col("parent_seq") >= F.col("seq")))), F.lit(False)).alias("unknown"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(there, F.struct("pos", F.coalesce("parent_kind", F.lit("?")).alias("k"))))), lambda p: p["k"]), "+").alias("kinds"),
        F.coalesce(F.bool_and(F.when(there, period_ok)), F.lit(True)).alias("periods"),
    )
    fits = F.when(F.col("kind") == "anonymized_monthly", F.col("kinds") == "").when(F.col("kind") == "analytical_canonical", F.col("kinds").isin("anonymized_monthly", "analytical_canonical", "analytical_canonical+anonymized_monthly")).otherwise(F.col("kinds").isin("anonymized_monthly", "analytical_canonical"))
    return each.select("artifact_id", F.when(F.col("unknown"), "unknown_parent").when(~fits, "parent_kinds").when(~F.col("periods"), "period").alias("reason")).where("reason is not null")


def audit(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counts over artifacts and files (artifact_id, file_sha256): registered, present, missing, hash mismatches, orphans."""
    x = artifacts.select("artifact_id", "sha256").join(files, "artifact_id", "full_outer")
    known, there = F.col("sha256").isNotNull(), F.col("file_sha256").isNotNull()
    return x.agg(F.count_if(known).alias("n_registered"), F.count_if(known & (F.col("sha256") == F.col("file_sha256"))).alias("n_verified"), F.count_if(known & ~there).alias("n_missing"), F.count_if(known & there & (F.col("sha256") != F.col("file_sha256"))).alias("n_mismatched"), F.count_if(~known).alias("n_orphans"))


def listing(artifacts: DataFrame, kind: str | None = None, period: str | None = None) -> DataFrame:
    """Artifacts in order of registration, by kind and period where given."""
    for c, v in (("kind", kind), ("period", period)):
        if v is not None:
            artifacts = artifacts.where(F.col(c) == v)
    return artifacts.orderBy("seq")


def retention(backups: DataFrame, keep_last: int = 5) -> DataFrame:
    """(revision, name, keep): the newest ``keep_last`` by revision, then name; a registry has few backups."""
    newest = F.row_number().over(Window.orderBy(F.desc("revision"), F.desc("name")))
    return backups.select("revision", "name", (newest <= keep_last).alias("keep"))


def sync_state(stores: DataFrame) -> DataFrame:
    """(name, entry_count, present, actual_count, prefix_equal, pending) -> name, state: how a store stands to its manifest."""
    n, actual = F.col("entry_count"), F.col("actual_count")
    state = (
        F.when((n > 0) & ~F.col("present"), "store_missing")
        .when(actual < n, "store_regressed")
        .when(~F.col("prefix_equal"), "store_diverged")
        .when(actual == n, "consistent")
        .when(F.col("pending"), "ahead")
        .when(n == 0, "store_unexpected_entries")
        .otherwise("store_ahead_unmarked")
    )
    return stores.select("name", state.alias("state"))


def files_with_hashes(spark, folder: str) -> DataFrame:
    """(name, sha256, length) of the files of a folder."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


