"""Guards: violations as a table, the first one raised before anything is written.

A guard is an action of its own, since checks inside a projection may be pruned with the column they stand in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import VALIDATORS, candidate, is_blank, is_formula
from ..types import ENTITY_FIELDS, EntityValueError, FieldRule, FormulaError, IdentifierValueError

#: Reason codes of cells in the order in which a cell is tested, and their errors.
REASONS = {"formula": FormulaError, "not_text": EntityValueError, "invalid": IdentifierValueError}


#: A column of mixed cells holds their texts; its companion, named with this ending, holds the cells' kinds (str, int or other).
KIND = "_kind"


def cell_reason(c: Column, kind: str, field_type: str, cell_kind: Column | None = None) -> Column:
    """Why a cell can't be pseudonymized, or null: blank cells pass, then formulas, then the type or the validator decides."""
    text = F.lit(kind == "string") if cell_kind is None else cell_kind == "str"
    seen = candidate(c, kind) if cell_kind is None else F.when(cell_kind == "str", candidate(c, "string")).when(cell_kind == "int", c)
    formula = is_formula(c) & text if kind == "string" else F.lit(False)
    if field_type in ENTITY_FIELDS:
        bad, reason = ~text, "not_text"
    else:
        bad, reason = ~F.coalesce(VALIDATORS[field_type](seen), F.lit(False)), "invalid"
    return F.when(is_blank(c), None).when(formula, "formula").when(bad, reason)


def kind_column(table: DataFrame, c: str) -> Column | None:
    return F.col(c + KIND) if c + KIND in table.columns else None


def violations(table: DataFrame, rules: dict[int, FieldRule], row: str = "row") -> DataFrame:
    """(row, column, reason) of every cell that stops the job; ``row`` names the row number's column."""
    cells = data_columns(table, row)
    found = [F.struct(F.lit(i).alias("column"), cell_reason(F.col(c), kind, rules[i].field_type.value, kind_column(table, c)).alias("reason")) for i, (c, kind) in enumerate(cells, 1) if rules[i].action.value == "pseudonymize"]
    if not found:
        return table.sparkSession.createDataFrame([], "row long, column int, reason string")
    return table.select(F.col(row).cast("long").alias("row"), F.explode(F.filter(F.array(*found), lambda s: s["reason"].isNotNull())).alias("v")).select("row", "v.column", "v.reason")


def data_columns(table: DataFrame, row: str = "row") -> list[tuple[str, str]]:
    """Columns of cells with their types, companions left out."""
    return [(c, k) for c, k in table.dtypes if c != row and not c.endswith(KIND)]


def first_violation(found: DataFrame) -> DataFrame:
    """The first in row-major order: one row, nulls if there is none."""
    return found.agg(F.min(F.struct("row", "column", "reason")).alias("v")).select("v.row", "v.column", "v.reason")


def require(found: DataFrame) -> None:
    """Raise the error of the first violation, if there is one."""
    v = first_violation(found).first()
    if v["reason"] is not None:
        raise REASONS[v["reason"]](v["reason"], row=v["row"], column=v["column"])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
