"""Anonymization of tables by per-column rules, as one plan over all tables of a job.

Columns are kept, emptied or pseudonymized. Values of pseudonymized columns are looked up in the identity maps; those that
aren't there get random keys first. Maps are committed before any output is written, so a published key can be undone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import is_blank
from ..sources.tables import is_small, union_all
from ..types import ALIAS_PREFIX, ENTITY_FIELDS, IDENTIFIER_FIELDS, PSEUDONYMIZABLE, TOKEN_PREFIX, FieldRule, MissingIdentifierMapError, RuleConfigurationError, UnsupportedTargetError
from . import guards, maps
from .keys import with_keys


@dataclass
class Sheet:
    """One table: positional columns and a row number ``row``, with its headers and rules by place."""

    name: str
    table: DataFrame
    rules: dict[int, FieldRule]
    headers: list[str] = field(default_factory=list)
    header_row: int = 1


@dataclass
class Anonymized:
    sheets: dict[str, DataFrame]
    entity_map: DataFrame
    identifier_map: DataFrame | None
    provenance: DataFrame


def check_rules(sheet: Sheet) -> None:
    """Rules are for exactly the columns there are, and only supported types are pseudonymized."""
    width = len(guards.data_columns(sheet.table))
    if any(isinstance(i, bool) or not isinstance(i, int) or i < 1 for i in sheet.rules):
        raise RuleConfigurationError("invalid_rule_key")
    missing, extra = set(range(1, width + 1)) - set(sheet.rules), set(sheet.rules) - set(range(1, width + 1))
    if missing or extra:
        raise RuleConfigurationError("rules_do_not_cover_columns", missing=sorted(missing), extra=sorted(extra))
    for i, rule in sorted(sheet.rules.items()):
        if rule.action.value == "pseudonymize" and rule.field_type.value not in PSEUDONYMIZABLE:
            raise UnsupportedTargetError("unsupported_target", column=i)


def coverage_differences(rules: DataFrame, columns: DataFrame) -> DataFrame:
    """(sheet, column, problem): columns without a rule and rules without a column, both given as (sheet, column)."""
    missing = columns.join(rules, ["sheet", "column"], "left_anti").withColumn("problem", F.lit("missing"))
    extra = rules.join(columns, ["sheet", "column"], "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def needs_identifiers(sheets: list[Sheet]) -> bool:
    return any(r.action.value == "pseudonymize" and r.field_type.value in IDENTIFIER_FIELDS for s in sheets for r in s.rules.values())


def _wanted(sheet: Sheet, fields: frozenset[str]) -> list[tuple[int, str, str]]:
    """(place, column, field type) of the columns to be pseudonymized."""
    return [(i, c, sheet.rules[i].field_type.value) for i, (c, _) in enumerate(guards.data_columns(sheet.table), 1) if sheet.rules[i].action.value == "pseudonymize" and sheet.rules[i].field_type.value in fields]


def identities(sheets: list[Sheet], fields: frozenset[str]) -> DataFrame | None:
    """(value, type, first): the distinct values of pseudonymized columns over all sheets, and where each is first seen."""
    parts = []
    for at, s in enumerate(sheets):
        cells = [F.struct(F.col(c).cast("string").alias("value"), F.lit(t).alias("type"), F.lit(i).alias("column")) for i, c, t in _wanted(s, fields)]
        if cells:
            x = s.table.select("row", F.explode(F.array(*cells)).alias("x")).where(~is_blank(F.col("x.value")))
            parts.append(x.groupBy("x.value", "x.type").agg(F.min(F.struct(F.lit(at).alias("sheet"), F.col("row").cast("long").alias("row"), F.col("x.column").alias("column"))).alias("first")))
    if not parts:
        return None
    return union_all(parts).groupBy("value", "type").agg(F.min("first").alias("first"))


def extend_entity_map(entity_map: DataFrame, sheets: list[Sheet], **options) -> DataFrame:
    """The map with an alias for every entity of the sheets."""
    seen = identities(sheets, ENTITY_FIELDS)
    if seen is None:
        return entity_map
    known = entity_map.where("parent_alias is null").select(F.col("real_value").alias("value"), F.col("entity_type").alias("type"))
    new = seen.join(known, ["value", "type"], "left_anti")
    prefix = F.create_map(*[F.lit(x) for kv in ALIAS_PREFIX.items() for x in kv])[F.col("type")]
    keyed = with_keys(new, entity_map.select("alias"), prefix, "alias", **options)
    rows = keyed.select("alias", F.col("value").alias("real_value"), F.col("type").alias("entity_type"), F.lit(None).cast("string").alias("parent_alias"), F.col("first").alias("_first"))
    return maps.append(entity_map, rows, "entity", [F.col("_first")], stored=True)


def extend_identifier_map(identifier_map: DataFrame, sheets: list[Sheet], **options) -> DataFrame:
    """The map with a token for every identifier of the sheets; integers count as their digits, values stay as written."""
    seen = identities(sheets, IDENTIFIER_FIELDS)
    if seen is None:
        return identifier_map
    known = identifier_map.select(F.col("identifier_value").alias("value"), F.col("identifier_type").alias("type"))
    new = seen.join(known, ["value", "type"], "left_anti")
    prefix = F.create_map(*[F.lit(x) for kv in TOKEN_PREFIX.items() for x in kv])[F.col("type")]
    keyed = with_keys(new, identifier_map.select("token"), prefix, "token", **options)
    rows = keyed.select("token", F.col("value").alias("identifier_value"), F.col("type").alias("identifier_type"), F.col("first").alias("_first"))
    return maps.append(identifier_map, rows, "identifier", [F.col("_first")], stored=True)


def _keys_of(sheet: Sheet, entity_map: DataFrame, identifier_map: DataFrame | None) -> tuple[DataFrame, bool]:
    """(value, type, key) of all keys that the sheet's types can have, and whether they're few."""
    parts = []
    for fields, table, key, value, kind in ((ENTITY_FIELDS, entity_map, "alias", "real_value", "entity_type"), (IDENTIFIER_FIELDS, identifier_map, "token", "identifier_value", "identifier_type")):
        types = sorted({t for _, _, t in _wanted(sheet, fields)})
        if types:
            source = table.where("parent_alias is null") if key == "alias" else table
            parts.append(source.where(F.col(kind).isin(*types)).select(F.col(value).alias("value"), F.col(kind).alias("type"), F.col(key).alias("key")))
    keys = union_all(parts)
    return keys, is_small(keys)


def project(sheet: Sheet, entity_map: DataFrame, identifier_map: DataFrame | None) -> DataFrame:
    """The sheet's rows with every column kept, emptied or replaced by keys; blanks stay as they are.

    Few keys are broadcast to each column. Many are joined once for all columns, with the cells that aren't blank in long
    form; keys then go back to their rows, so the wide table moves once however many columns there are.
    """
    out, columns, wanted = sheet.table, guards.data_columns(sheet.table), _wanted(sheet, PSEUDONYMIZABLE)
    made: dict[int, Column] = {}
    if wanted:
        keys, few = _keys_of(sheet, entity_map, identifier_map)
        if few:
            for i, c, t in wanted:
                side = keys.where(F.col("type") == t).select(F.col("value").alias(f"v{i}"), F.col("key").alias(f"k{i}"))
                out = out.join(F.broadcast(side), F.col(c).cast("string") == F.col(f"v{i}"), "left")
        else:
            cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("value"), F.lit(t).alias("type")) for i, c, t in wanted])
            long = out.select("row", F.explode(F.filter(cells, lambda x: ~is_blank(x["value"]))).alias("x")).select("row", "x.*")
            by_row = long.join(keys, ["value", "type"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("column", "key"))).alias("_keys"))
            out = out.join(by_row, "row", "left").withColumns({f"k{i}": F.col("_keys")[i] for i, _, _ in wanted}).drop("_keys")
        # A cell that isn't blank has a key by now; blanks pass through.
        made = {i: F.when(is_blank(F.col(c)), F.col(c).cast("string")).otherwise(F.col(f"k{i}")) for i, c, _ in wanted}
    chosen = []
    for i, (c, _) in enumerate(columns, 1):
        action = sheet.rules[i].action.value
        chosen.append((F.lit(None).cast(sheet.table.schema[c].dataType) if action == "remove" else F.col(c) if action == "keep" else made[i]).alias(c))
    return out.select("row", *chosen, *[c for c in sheet.table.columns if c.endswith(guards.KIND)])


def provenance_of(sheet: Sheet, projected: DataFrame, job_id: str) -> DataFrame | None:
    """One row for each cell that got a token, with what it was written as."""
    wanted = _wanted(sheet, IDENTIFIER_FIELDS)
    if not wanted:
        return None
    kinds = dict(sheet.table.dtypes)

    def representation(c: str) -> Column:
        kind = guards.kind_column(sheet.table, c)
        return F.lit("string" if kinds[c] == "string" else "integer") if kind is None else F.when(kind == "int", "integer").otherwise("string")

    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).alias("token"), representation(c).alias("representation")) for i, c, _ in wanted])
    rows = projected.select(F.col("row").cast("long").alias("row"), F.explode(cells).alias("x")).where(~is_blank(F.col("x.token")))
    return rows.select(F.lit(job_id).alias("job_id"), F.lit(sheet.name).alias("sheet_name"), "row", F.col("x.column"), F.col("x.token"), F.col("x.representation"))


def anonymize(sheets: list[Sheet], entity_map: DataFrame, job_id: str, identifier_map: DataFrame | None = None, provenance: DataFrame | None = None, **options) -> Anonymized:
    """All sheets of a job; raises before anything is written if any rule or cell is refused.

    The order is: rules, cells (the first refused one in row-major order raises), entity map, identifier map, provenance, rows.
    """
    for s in sheets:
        check_rules(s)
    if needs_identifiers(sheets) and identifier_map is None:
        raise MissingIdentifierMapError("identifier_map_required")
    for s in sheets:
        guards.require(guards.violations(s.table, s.rules))
    spark = sheets[0].table.sparkSession
    entity_map = extend_entity_map(entity_map, sheets, **options)
    if needs_identifiers(sheets):
        identifier_map = extend_identifier_map(identifier_map, sheets, **options)
    done = {s.name: project(s, entity_map, identifier_map) for s in sheets}
    parts = [p for s in sheets if (p := provenance_of(s, done[s.name], job_id)) is not None]
    base = provenance if provenance is not None else maps.empty(spark, maps.PROVENANCE)
    if parts:
        base = maps.append(base, union_all(parts), "provenance", [])
    return Anonymized(done, entity_map, identifier_map, base)
