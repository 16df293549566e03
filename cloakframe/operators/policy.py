"""The policy gate: which sheets are processed, by which rules, and whether headers and kept columns are safe.

The checks are tables of problems with fixed reasons; ``gate`` raises the first in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import STRIP_CHARS, is_identifier_like
from ..sources.tables import cell_text, sized
from ..types import KEEP_SCANNED, ColumnSafetyError, CoverageError, FieldRule, action_matrix

RULES = "sheet_name string, column int, column_name string, field_type string, action string"
POLICIES = "sheet_name string, policy string"


def rules_table(spark: SparkSession, rules: dict[str, dict[int, FieldRule]]) -> DataFrame:
    rows = [(s, i, r.column_name, r.field_type.value, r.action.value) for s, by_place in rules.items() for i, r in by_place.items()]
    return spark.createDataFrame(rows, RULES)


def action_violations(rules: DataFrame) -> DataFrame:
    """(rules' columns, reason): rules whose action the matrix forbids for their type."""
    matrix = rules.sparkSession.createDataFrame(action_matrix(), "field_type string, action string, reason string")
    return rules.join(F.broadcast(matrix), ["field_type", "action"]).where("reason is not null").select(*rules.columns, "reason")


def coverage_problems(sheets: DataFrame, policies: DataFrame) -> DataFrame:
    """(sheet_name, reason, place): sheets (title, state) without a policy, policies without a sheet, and then no sheet or no visible sheet left to process."""
    full = sheets.select(F.col("title").alias("sheet_name"), "state").join(policies, "sheet_name", "full_outer")
    each = full.select("sheet_name", F.when(F.col("policy").isNull(), "missing_worksheet_policy").when(F.col("state").isNull(), "policy_for_unknown_worksheet").when(~F.col("policy").isin("process", "remove_all"), "invalid_policy_value").alias("reason")).where("reason is not null")
    both = F.col("policy") == "process"
    some = full.agg(F.coalesce(F.max((both & F.col("state").isNotNull()).cast("int")), F.lit(0)).alias("any"), F.coalesce(F.max((both & (F.col("state") == "visible")).cast("int")), F.lit(0)).alias("seen"))
    none = some.select(F.lit(None).cast("string").alias("sheet_name"), F.when(F.col("any") == 0, "no_process_worksheet_remains").when(F.col("seen") == 0, "no_visible_process_worksheet").alias("reason")).where("reason is not null")
    order = F.create_map(*[F.lit(x) for kv in (("invalid_policy_value", 0), ("missing_worksheet_policy", 1), ("policy_for_unknown_worksheet", 2), ("no_process_worksheet_remains", 3), ("no_visible_process_worksheet", 4)) for x in kv])
    return each.unionByName(none).withColumn("place", order[F.col("reason")])


def rule_problems(policies: DataFrame, rules: DataFrame) -> DataFrame:
    """(sheet_name, reason, place): rules for sheets without a policy, processed sheets without rules, rules for removed sheets."""
    full = policies.join(rules.select("sheet_name").distinct().withColumn("has", F.lit(True)), "sheet_name", "full_outer")
    reason = F.when(F.col("policy").isNull(), "rules_for_unknown_worksheet").when((F.col("policy") == "process") & F.col("has").isNull(), "missing_process_rules").when((F.col("policy") == "remove_all") & F.col("has"), "rules_for_remove_all_worksheet")
    order = F.create_map(*[F.lit(x) for kv in (("rules_for_unknown_worksheet", 0), ("missing_process_rules", 1), ("rules_for_remove_all_worksheet", 2)) for x in kv])
    return full.select("sheet_name", reason.alias("reason")).where("reason is not null").withColumn("place", order[F.col("reason")])


def remaining_sheets(sheets: DataFrame, policies: DataFrame) -> DataFrame:
    """Sheets left once the removed ones are gone, numbered anew; a workbook has few sheets."""
    left = sheets.join(policies.where("policy = 'remove_all'").select(F.col("sheet_name").alias("title")), "title", "left_anti")
    return left.withColumn("sheet_index", F.row_number().over(Window.orderBy("sheet_index"))).select(*sheets.columns)


def header_mismatches(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """(sheet_name, column): columns whose header in row 1 isn't exactly the rule's name."""
    heads = cells.where("row = 1").select("sheet_name", "column", cell_text().alias("header"), F.col("kind"))
    joined = rules.join(heads, ["sheet_name", "column"], "left")
    same = F.col("header").eqNullSafe(F.col("column_name")) & F.coalesce(F.col("kind") != "int", F.lit(True))
    return joined.where(~same).select("sheet_name", "column")


def _scanned(cells: DataFrame, rules: DataFrame) -> DataFrame:
    body = cells.where("row > 1").withColumn("text", F.when(F.col("kind").isin("str", "int"), F.when(F.col("kind") == "str", F.trim(F.col("s"), F.lit(STRIP_CHARS))).otherwise(F.col("i").cast("string"))))
    blank = (F.col("kind") == "null") | ((F.col("kind") == "str") & (F.col("text") == ""))
    return body.where(~blank).join(sized(rules), ["sheet_name", "column"])


def scan(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """(sheet_index, sheet_name, column, field_type, action, n_values, n_identifier_like, n_formulas) of columns with rules, in one pass below the header."""
    x = _scanned(cells, rules)
    like = F.coalesce(is_identifier_like(F.col("text")), F.lit(False))
    return x.groupBy("sheet_index", "sheet_name", "column", "field_type", "action").agg(F.count("*").alias("n_values"), F.count_if(like).alias("n_identifier_like"), F.count_if(F.col("kind") == "formula").alias("n_formulas"))


def keep_violations(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """(sheet_name, row, column): identifier-like values, kpp included, in kept columns of types that are scanned."""
    kept = rules.where((F.col("action") == "keep") & F.col("field_type").isin(*sorted(KEEP_SCANNED)))
    return _scanned(cells, kept).where(F.coalesce(is_identifier_like(F.col("text")), F.lit(False))).select("sheet_name", "row", "column")


def expected_identifiers(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """(sheet_index, column, identifier_type, expected): non-blank cells of columns whose identifiers are pseudonymized, invalid ones too."""
    wanted = rules.where((F.col("action") == "pseudonymize") & F.col("field_type").isin("inn", "kpp", "ogrn"))
    return _scanned(cells, wanted).groupBy("sheet_index", "column", F.col("field_type").alias("identifier_type")).agg(F.count("*").alias("expected")).orderBy("sheet_index", "column")


def has_formula(cells: DataFrame) -> DataFrame:
    """(sheet_name, found): whether a sheet has any formula, row 1 included."""
    return cells.groupBy("sheet_name").agg(F.bool_or(F.col("kind") == "formula").alias("found"))


def gate(cells: DataFrame, sheets: DataFrame, policies: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raise the first problem; else the remaining sheets, their cells, and the expected identifier counts.

    The order is coverage, rules, action matrix, headers, formulas, kept values.
    """
    for problems in (coverage_problems(sheets, policies), rule_problems(policies, rules)):
        p = problems.agg(F.min(F.struct("place", "sheet_name", "reason")).alias("p")).select("p.*").first()
        if p["reason"]:
            raise CoverageError(p["reason"])
    for p in action_violations(rules).orderBy("sheet_name", "column").limit(1).collect():
        raise ColumnSafetyError(p["reason"], column=p["column"])
    left = remaining_sheets(sheets, policies)
    inside = cells.drop("sheet_index").join(sized(left.select("sheet_index", F.col("title").alias("sheet_name"))), "sheet_name").select(*cells.columns)
    if header_mismatches(inside, rules).limit(1).count():
        raise CoverageError("header_mismatch")
    if has_formula(inside).where("found").limit(1).count():
        raise CoverageError("formula_rejected")
    for v in keep_violations(inside, rules).orderBy("sheet_name", "row", "column").limit(1).collect():
        raise ColumnSafetyError("cross_type_identifier_detected", row=v["row"], column=v["column"])
    return left, inside, expected_identifiers(inside, rules)
