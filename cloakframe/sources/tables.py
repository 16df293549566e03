"""Wide tables with positional columns and long tables of cells.

Headers may repeat, be blank or be numbers, so columns go by place: c0001, c0002 and so on, with the headers kept aside.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import JobValidationError
from .sealed import SCRATCH_KEY, seal, sealed_schema, unseal

#: Rows up to which a table is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 100_000

#: Schema of a cell in long form; ``kind`` says which of the value columns holds it.
CELLS = (
    "sheet_index int, sheet_name string, row long, column int, kind string, s string, i decimal(38,0), d double, b boolean, ts timestamp_ntz, "
    "is_merged_child boolean, has_comment boolean, has_hyperlink boolean"
)
SHEETS = "sheet_index int, title string, state string, max_row long, max_column int"


_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one in spark.checkpoint.dir; a temporary one where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise JobValidationError("no_shared_folder")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
        base = _own[app]
    return base.rstrip("/")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a table and read it back, so that it has one state for all who use it. Strings are sealed on disk; it is removed when the driver ends."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    seal(df, SCRATCH_KEY).write.parquet(path)
    return unseal(df.sparkSession.read.schema(sealed_schema(df.schema)).parquet(path), df.schema, SCRATCH_KEY)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended already; what is left is sealed
            pass


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a table is counted to have at most ``BROADCAST_ROWS`` rows."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marked for broadcast only if it is counted to be small."""
    return F.broadcast(df) if is_small(df, rows) else df


def place(i: int) -> str:
    return f"c{i:04d}"


def positional(df: DataFrame, row=None, first_row: int = 2) -> tuple[DataFrame, list[str]]:
    """A table with positional names and a row number, and its headers.

    ``row`` is an expression for the row number; without one, rows are numbered in the order in which the table is read:
    counts of the partitions first, then numbers within each.
    """
    headers = list(df.columns)
    named = df.toDF(*[place(i) for i in range(1, len(headers) + 1)])
    if row is not None:
        return df.select(row.cast("long").alias("row"), *[F.col(f"`{c}`").alias(place(i)) for i, c in enumerate(headers, 1)]), headers
    marked = named.withColumn("_at", F.monotonically_increasing_id())
    sizes = {r["p"]: r["n"] for r in marked.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, base = {}, first_row
    for p in sorted(sizes):
        before[p], base = base, base + sizes[p]
    if not before:
        return named.select(F.lit(0).cast("long").alias("row"), *named.columns), headers
    start = F.create_map(*[F.lit(x) for p in before for x in (p, before[p])])[F.shiftright("_at", 33)]
    return marked.select((start + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long").alias("row"), *named.columns), headers


def tagged(name: str, kind: str) -> Column:
    """A struct of the value columns of a cell."""
    c = F.col(name)
    null = F.lit(None)
    values = {"s": null.cast("string"), "i": null.cast("decimal(38,0)"), "d": null.cast("double"), "b": null.cast("boolean"), "ts": null.cast("timestamp_ntz")}
    if kind == "string":
        tag, values["s"] = F.when(c.startswith("="), "formula").otherwise("str"), c
    elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal") and kind.endswith(",0)"):
        tag, values["i"] = F.lit("int"), c.cast("decimal(38,0)")
    elif kind == "boolean":
        tag, values["b"] = F.lit("bool"), c
    elif kind == "date":
        tag, values["ts"] = F.lit("date"), c.cast("timestamp_ntz")
    elif kind.startswith("timestamp"):
        tag, values["ts"] = F.lit("datetime"), c.cast("timestamp_ntz")
    else:
        tag, values["d"] = F.lit("float"), c.cast("double")
    return F.struct(F.when(c.isNull(), "null").otherwise(tag).alias("kind"), *[v.alias(k) for k, v in values.items()])


def to_cells(table: DataFrame, headers: list[str], sheet_index: int = 1, sheet_name: str = "Sheet1", header_row: int = 1) -> DataFrame:
    """A wide table and its headers in long form; null cells are left out, as in a file."""
    named = [c for c in table.columns if c != "row"]
    kinds = dict(table.dtypes)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), tagged(c, kinds[c]).alias("v")) for i, c in enumerate(named, 1)])).alias("x")
    rows = table.select(F.col("row").cast("long").alias("row"), cells).select("row", "x.column", "x.v.*").where("kind <> 'null'")
    top = table.sparkSession.createDataFrame([(header_row, i, h) for i, h in enumerate(headers, 1)], "row long, column int, s string").where("s is not null")
    top = top.select("row", "column", F.lit("str").alias("kind"), "s", *[F.lit(None).cast(t).alias(n) for n, t in (("i", "decimal(38,0)"), ("d", "double"), ("b", "boolean"), ("ts", "timestamp_ntz"))])
    flags = [F.lit(False).alias(f) for f in ("is_merged_child", "has_comment", "has_hyperlink")]
    return top.unionByName(rows).select(F.lit(sheet_index).cast("int").alias("sheet_index"), F.lit(sheet_name).alias("sheet_name"), "row", "column", "kind", "s", "i", "d", "b", "ts", *flags)


def cell_text(prefix: str = "") -> Column:
    """A cell as text: strings and formulas as they are, integers in digits, other kinds null."""
    return F.coalesce(F.col(prefix + "s"), F.col(prefix + "i").cast("string"))


def to_wide(cells: DataFrame, width: int, header_row: int = 1, value: str = "text") -> DataFrame:
    """Rows below the header as text, one positional column for each place; one shuffle by row, blanks null."""
    body = cells.where(F.col("row") > header_row).withColumn("text", F.coalesce(cell_text(), F.col("d").cast("string"), F.col("b").cast("string"), F.col("ts").cast("string")))
    return body.groupBy("row").agg(*[F.max(F.when(F.col("column") == i, F.col(value))).alias(place(i)) for i in range(1, width + 1)])


def dense(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Every place of every sheet's rectangle, blanks as kind null; places are made by sequences, not by a cross join."""
    grid = sheets.select("sheet_index", F.col("title").alias("sheet_name"), "max_column", F.explode(F.sequence(F.lit(1).cast("long"), F.col("max_row").cast("long"))).alias("row")).select("sheet_index", "sheet_name", "row", F.explode(F.sequence(F.lit(1), "max_column")).alias("column"))
    full = grid.join(cells.drop("sheet_name"), ["sheet_index", "row", "column"], "left")
    return full.fillna("null", ["kind"]).fillna(False, ["is_merged_child", "has_comment", "has_hyperlink"])


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
