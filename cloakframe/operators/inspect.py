"""Inspection before a file leaves: known values, formulas, comments, links, metadata and package parts, as findings.

A finding says what and where, never the value. Counts are exact; details are kept for the first hundred of a kind, which is
what the report shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import part_kind
from ..sources.tables import sized, store
from ..types import BLOCKING_KINDS, FINDING_KINDS

#: Details kept for each kind; counts go on.
DETAILS = 100
FINDINGS = "kind string, phase int, worksheet_index int, row long, column int, part string"
_COLUMNS = ["kind", "phase", "worksheet_index", "row", "column", "part"]


def kind_place(kind: str = "kind") -> Column:
    """A kind's place in the report."""
    return F.array_position(F.array(*[F.lit(k) for k in FINDING_KINDS]), F.col(kind)).cast("int")


def _finding(df: DataFrame, kind, phase: int, **at) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    null = F.lit(None).cast("int")
    return df.select(kind.alias("kind"), F.lit(phase).alias("phase"), *[at.get(c, null).cast("long" if c == "row" else "int").alias(c) for c in ("worksheet_index", "row", "column")], at.get("part", F.lit(None).cast("string")).cast("string").alias("part"))


def known_values(entity_map: DataFrame | None, identifier_map: DataFrame | None) -> DataFrame:
    """(value, known): distinct confidential values, at most one row for each value and kind."""
    parts = []
    if entity_map is not None:
        parts.append(entity_map.select(F.col("real_value").alias("value"), F.lit("known_entity_value").alias("known")))
    if identifier_map is not None:
        parts.append(identifier_map.select(F.col("identifier_value").alias("value"), F.lit("known_identifier_value").alias("known")))
    return (parts[0] if len(parts) == 1 else parts[0].union(parts[1])).distinct()


def value_hits(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Cells that are exactly a known value; integers are compared with identifiers only, formulas with nothing."""
    text = cells.where(F.col("kind").isin("str", "int")).select("sheet_index", "row", "column", "kind", F.coalesce("s", F.col("i").cast("string")).alias("value"))
    hit = text.withColumnRenamed("kind", "cell").join(sized(known), "value").where((F.col("cell") == "str") | (F.col("known") == "known_identifier_value"))
    return _finding(hit, F.col("known"), 5, worksheet_index=F.col("sheet_index"), row=F.col("row"), column=F.col("column"))


def cell_findings(cells: DataFrame) -> DataFrame:
    """Formulas, comments and hyperlinks."""
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in (("formula", F.col("kind") == "formula"), ("comment", F.col("has_comment")), ("hyperlink", F.col("has_hyperlink")))]), lambda k: k.isNotNull())
    x = cells.select("sheet_index", "row", "column", F.explode(found).alias("found"))
    return _finding(x, F.col("found"), 5, worksheet_index=F.col("sheet_index"), row=F.col("row"), column=F.col("column"))


def sheet_findings(sheets: DataFrame, known: DataFrame | None) -> DataFrame:
    """Hidden sheets, and titles that are known values."""
    out = _finding(sheets.where("state <> 'visible'"), "hidden_worksheet", 4, worksheet_index=F.col("sheet_index"))
    if known is not None:
        hit = sheets.join(sized(known), F.col("title") == F.col("value"))
        out = out.unionByName(_finding(hit, F.col("known"), 4, worksheet_index=F.col("sheet_index")))
    return out


def property_findings(properties: DataFrame, known: DataFrame | None, markers: tuple[str, ...] = ("RestoredFromJobId", "AnalyticallyRestored"), allowed: tuple[str, ...] = ("JobId",)) -> DataFrame:
    """(scope: custom or core, name, value): restored markers, other custom properties, core properties, and known values among them."""
    custom, core = properties.where("scope = 'custom'"), properties.where("scope = 'core' and value is not null and value <> ''")
    out = _finding(custom.where(F.col("name").isin(*markers)), "restored_marker", 0, part=F.col("name"))
    out = out.unionByName(_finding(custom.where(~F.col("name").isin(*markers, *allowed)), "custom_property", 0))
    out = out.unionByName(_finding(core, "core_property", 1, part=F.col("name")))
    if known is not None:
        hit = core.join(sized(known), "value")
        out = out.unionByName(_finding(hit, F.col("known"), 1, part=F.col("name")))
    return out


def part_findings(parts: DataFrame) -> DataFrame:
    """Package parts (name) whose kind is a finding."""
    return _finding(parts.withColumn("found", part_kind(F.col("name"))).where("found is not null"), F.col("found"), 6, part=F.col("name"))


def counts(findings: DataFrame) -> DataFrame:
    """(kind, severity, n) in report order, kinds without findings left out."""
    n = findings.groupBy("kind").agg(F.count("*").alias("n"))
    severity = F.when(F.col("kind").isin(*BLOCKING_KINDS), "blocking").otherwise("unverified")
    return n.select("kind", severity.alias("severity"), "n").orderBy(kind_place())


def details(findings: DataFrame, most: int = DETAILS) -> DataFrame:
    """The first findings of each kind in scan order, with ``truncated`` where there are more.

    Each partition first keeps its own first ones, so one kind with most of the rows doesn't meet in one task.
    """
    findings = store(findings, "findings")  # read twice
    order = [F.col(c).asc_nulls_first() for c in ("phase", "worksheet_index", "row", "column", "part")]
    own = Window.partitionBy("kind", "_part").orderBy(*order)
    first = findings.withColumn("_part", F.pmod(F.xxhash64("worksheet_index", "row", "column", "part"), F.lit(256))).withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= most).drop("_n", "_part")
    n = F.broadcast(findings.groupBy("kind").agg((F.count("*") > most).alias("truncated")))  # one row a kind: 22 at most
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("_n") <= most)
    return ranked.join(n, "kind").withColumnRenamed("_n", "place").orderBy(kind_place(), "place")


def report(findings: DataFrame) -> DataFrame:
    """One row: has_blocking_findings, has_unverified_exposures, n."""
    blocking = F.col("kind").isin(*BLOCKING_KINDS)
    return findings.agg(F.coalesce(F.bool_or(blocking), F.lit(False)).alias("has_blocking_findings"), F.coalesce(F.bool_or(~blocking), F.lit(False)).alias("has_unverified_exposures"), F.count("*").alias("n"))


def inspect(cells: DataFrame, sheets: DataFrame, properties: DataFrame | None = None, parts: DataFrame | None = None, extras: DataFrame | None = None, entity_map: DataFrame | None = None, identifier_map: DataFrame | None = None) -> DataFrame:
    """All findings of a workbook; ``extras`` are findings of other producers (defined names, tables, headers and footers)."""
    known = known_values(entity_map, identifier_map) if entity_map is not None or identifier_map is not None else None
    out = cell_findings(cells).unionByName(sheet_findings(sheets, known))
    if known is not None:
        out = out.unionByName(value_hits(cells, known))
    if properties is not None:
        out = out.unionByName(property_findings(properties, known))
    if parts is not None:
        out = out.unionByName(part_findings(parts))
    return out if extras is None else out.unionByName(extras.select(*_COLUMNS))


def refusal(findings: DataFrame) -> DataFrame:
    """One row: why a scrub can't go on, by priority marker, entity, identifier; null if it can."""
    n = {k: F.max(F.when(F.col("kind") == k, 1).otherwise(0)) for k in BLOCKING_KINDS}
    return findings.agg(F.when(n["restored_marker"] == 1, "restored_marker_present").when(n["known_entity_value"] == 1, "known_entity_value_present").when(n["known_identifier_value"] == 1, "known_identifier_value_present").alias("reason"))
