"""Restoring originals: by recorded coordinates, or by value in tables of any shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import is_blank, is_formula
from ..sources.tables import sized
from ..types import AmbiguousRestoreError, RestoreValidationError, UnresolvedRestoreError

#: What every alias and token looks like; other texts aren't looked up.
KEY_SHAPE = r"^[A-Z]+_[0-9A-Z]+\z"
#: Why a recorded coordinate can't be restored, in the order in which it is tested.
COORDINATE_REASONS = ("unknown_sheet", "out_of_bounds", "merged_child", "token_mismatch", "unknown_token", "not_an_integer")


def check_binding(job_ids: DataFrame, provenance: DataFrame) -> str:
    """The one job that a file (``job_ids``: job_id) and its provenance belong to."""
    found = [r["job_id"] for r in job_ids.select("job_id").limit(2).collect()]
    if len(found) != 1 or not (found[0] or "").strip():
        raise RestoreValidationError("job_id_missing_or_repeated")
    other = provenance.where(~F.col("job_id").eqNullSafe(F.lit(found[0]))).limit(1).count()
    if other:
        raise RestoreValidationError("job_id_mismatch")
    return found[0]


def bounds(cells: DataFrame) -> DataFrame:
    """The extent of each sheet."""
    return cells.groupBy("sheet_name").agg(F.max("row").alias("max_row"), F.max("column").alias("max_column"))


def resolve_identifiers(cells: DataFrame, provenance: DataFrame, identifier_map: DataFrame, extent: DataFrame | None = None) -> DataFrame:
    """(sheet_name, row, column, value, representation, problem): what each recorded coordinate gets, or why it gets nothing."""
    at = ["sheet_name", "row", "column"]
    extent = bounds(cells) if extent is None else extent
    p = provenance.select(*at, "token", "representation")
    joined = p.join(sized(extent), "sheet_name", "left").join(cells.select(*at, F.col("s").alias("cell"), "is_merged_child"), at, "left").join(sized(identifier_map.select("token", "identifier_value")), "token", "left")
    problem = (
        F.when(F.col("max_row").isNull(), "unknown_sheet")
        .when((F.col("row") > F.col("max_row")) | (F.col("column") > F.col("max_column")), "out_of_bounds")
        .when(F.coalesce("is_merged_child", F.lit(False)), "merged_child")
        .when(~F.col("cell").eqNullSafe(F.col("token")), "token_mismatch")
        .when(F.col("identifier_value").isNull(), "unknown_token")
        .when((F.col("representation") == "integer") & F.col("identifier_value").try_cast("decimal(38,0)").isNull(), "not_an_integer")
    )
    return joined.select(*at, F.col("identifier_value").alias("value"), "representation", problem.alias("problem"))


def resolve_entities(cells: DataFrame, provenance: DataFrame, entity_map: DataFrame) -> DataFrame:
    """(sheet_name, row, column, value): every text cell outside the recorded coordinates that is exactly an alias, headers included."""
    at = ["sheet_name", "row", "column"]
    eligible = cells.where(F.col("s").rlike(KEY_SHAPE) & ~F.col("is_merged_child") & ~is_formula(F.col("s")) & ~is_blank(F.col("s")) & (F.col("kind") == "str"))
    return eligible.join(provenance.select(*at), at, "left_anti").join(sized(entity_map.select(F.col("alias").alias("s"), F.col("real_value").alias("value"))), "s").select(*at, "value")


def apply_plan(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """Cells with planned values laid over them; integers go back to integers."""
    at = ["sheet_name", "row", "column"]
    p = plan.select(*at, "value", "representation", F.lit(True).alias("_planned"))
    number = F.col("representation") == "integer"
    return (
        cells.join(p, at, "left")
        .withColumn("kind", F.when(F.col("_planned"), F.when(number, "int").otherwise("str")).otherwise(F.col("kind")))
        .withColumn("s", F.when(F.col("_planned"), F.when(number, None).otherwise(F.col("value"))).otherwise(F.col("s")))
        .withColumn("i", F.when(F.col("_planned") & number, F.col("value").try_cast("decimal(38,0)")).otherwise(F.col("i")))
        .select(*cells.columns)
    )


def restore(cells: DataFrame, provenance: DataFrame, entity_map: DataFrame, identifier_map: DataFrame | None) -> DataFrame:
    """Cells of a file with identifiers restored by coordinate and all other aliases by value; both plans stand before any cell changes."""
    if identifier_map is None and provenance.limit(1).count():
        raise RestoreValidationError("identifier_map_required")
    plan = None
    if identifier_map is not None:
        plan = resolve_identifiers(cells, provenance, identifier_map)
        bad = plan.where("problem is not null").agg(F.min(F.struct("sheet_name", "row", "column", "problem")).alias("v")).select("v.*").first()
        if bad["problem"] is not None:
            raise UnresolvedRestoreError(bad["problem"], row=bad["row"], column=bad["column"])
    entities = resolve_entities(cells, provenance, entity_map).withColumn("representation", F.lit("string"))
    return apply_plan(cells, entities if plan is None else plan.drop("problem").unionByName(entities))


@dataclass
class AnalyticalCounts:
    entities: int
    identifiers: int


def restored_values(table: DataFrame, columns: list[str], entity_map: DataFrame | None, identifier_map: DataFrame | None) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """Left joins of text columns with both maps; for each column the value by alias and by token, null where there is none."""
    out, hits = table, {}
    maps = [(m if m is None else sized(m.select(key, value)), key, value) for m, key, value in ((entity_map, "alias", "real_value"), (identifier_map, "token", "identifier_value"))]
    for n, c in enumerate(columns):
        cell = F.when(F.col(c).rlike(KEY_SHAPE), F.col(c))
        found = []
        for m, key, value in maps:
            if m is None:
                found.append(F.lit(None).cast("string"))
            else:
                side = m.select(F.col(key).alias(f"_k{key}{n}"), F.col(value).alias(f"_v{key}{n}"))
                out = out.join(side, cell == F.col(f"_k{key}{n}"), "left")
                found.append(F.col(f"_v{key}{n}"))
        hits[c] = (found[0], found[1])
    return out, hits


def ambiguous(table: DataFrame, entity_map: DataFrame, identifier_map: DataFrame) -> DataFrame:
    """(column, n): text cells that are both an alias and a token."""
    columns = [c for c, k in table.dtypes if k == "string"]
    joined, hits = restored_values(table, columns, entity_map, identifier_map)
    counts = joined.agg(*[F.count_if(a.isNotNull() & t.isNotNull()).alias(c) for c, (a, t) in hits.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.*").where("n > 0")


def restore_analytical(table: DataFrame, entity_map: DataFrame | None, identifier_map: DataFrame | None = None, check: bool = True) -> DataFrame:
    """A table of any shape with every text cell that is exactly an alias or a token replaced by its original, always as text.

    Blank cells and formulas stay. A cell that is both raises before anything is written.
    """
    columns = [c for c, k in table.dtypes if k == "string"]
    if check and entity_map is not None and identifier_map is not None and columns:
        for r in ambiguous(table, entity_map, identifier_map).limit(1).collect():
            raise AmbiguousRestoreError("alias_and_token", column=r["column"])
    joined, hits = restored_values(table, columns, entity_map, identifier_map)
    return joined.select(*[F.coalesce(*hits[c], F.col(c)).alias(c) if c in hits else F.col(c) for c in table.columns])


def count_restored(table: DataFrame, entity_map: DataFrame | None, identifier_map: DataFrame | None) -> DataFrame:
    """One row: cells restored from aliases and from tokens."""
    columns = [c for c, k in table.dtypes if k == "string"]
    joined, hits = restored_values(table, columns, entity_map, identifier_map)
    return joined.agg(*[F.coalesce(sum((F.count_if(hits[c][k].isNotNull()) for c in columns[1:]), F.count_if(hits[columns[0]][k].isNotNull())), F.lit(0)).cast("long").alias(name) for k, name in ((0, "n_entities"), (1, "n_identifiers"))])
