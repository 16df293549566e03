"""The closed grammar of scrubbed packages, checked on rows of elements and attributes.

Parts are read into rows (part, kind, place, parent, element, attribute, value); which elements may stand in which, which
attributes they have and what shape a value has is a table of rules. So many packages are checked at once, by joins with the
rules, and every problem is a row. Shapes are column predicates. Values of cells aren't looked at, only the structure.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "part string, kind string, place long, parent string, element string, attribute string, value string"

_NUMBER = r"-?[0-9]+(\.[0-9]+)?"
_CELL = r"\$?[A-Z]{1,3}\$?[0-9]+"


def _matches(pattern: str):
    return lambda v: v.rlike(rf"^(?:{pattern})\z")


def _within(pattern: str, low: float, high: float):
    return lambda v: v.rlike(rf"^(?:{pattern})\z") & v.try_cast("double").between(low, high)


def _one_of(*values: str):
    return lambda v: v.isin(*values)


#: Shapes of attribute values, by name.
SHAPES = {
    "bool": _one_of("0", "1", "true", "false"),
    "int": _matches(r"-?[0-9]+"),
    "count": _matches(r"[0-9]+"),
    "float": _matches(_NUMBER),
    "scientific": _matches(_NUMBER + r"([eE][+-]?[0-9]+)?"),
    "unit": _within(_NUMBER + r"([eE][+-]?[0-9]+)?", 0, 1),
    "tint": _within(_NUMBER + r"([eE][+-]?[0-9]+)?", -1, 1),
    "cell": _matches(_CELL),
    "range": _matches(_CELL + f"(:{_CELL})?"),
    "ranges": _matches(f"{_CELL}(:{_CELL})?( {_CELL}(:{_CELL})?)*"),
    "rgb": _matches("[0-9A-Fa-f]{6}([0-9A-Fa-f]{2})?"),
    "measure": _matches(_NUMBER + "(mm|cm|in|pt|pc|pi)"),
    "rid": _matches("rId[0-9]+"),
    "title": lambda v: F.length(v).between(1, 31) & ~v.rlike(r"[\[\]:*?/\\\x00-\x1f]") & ~v.startswith("'") & ~v.endswith("'"),
    "span": _matches("[0-9]+:[0-9]+( [0-9]+:[0-9]+)*"),
    "word": _matches("[A-Za-z][A-Za-z0-9]*"),
    "state": _one_of("visible", "hidden", "veryHidden"),
    "cell_type": _one_of("n", "s", "b", "e", "str", "inlineStr"),
    "pane": _one_of("topLeft", "topRight", "bottomLeft", "bottomRight"),
    "pane_state": _one_of("frozen", "frozenSplit", "split"),
    "view": _one_of("normal", "pageBreakPreview", "pageLayout"),
    "underline": _one_of("single", "double", "singleAccounting", "doubleAccounting", "none"),
    "vertical_run": _one_of("baseline", "superscript", "subscript"),
    "scheme": _one_of("none", "major", "minor"),
    "line": _one_of("none", "thin", "medium", "dashed", "dotted", "thick", "double", "hair", "mediumDashed", "dashDot", "mediumDashDot", "dashDotDot", "mediumDashDotDot", "slantDashDot"),
    "pattern": _one_of("none", "solid", "mediumGray", "darkGray", "lightGray", "darkHorizontal", "darkVertical", "darkDown", "darkUp", "darkGrid", "darkTrellis", "lightHorizontal", "lightVertical", "lightDown", "lightUp", "lightGrid", "lightTrellis", "gray125", "gray0625"),
    "horizontal": _one_of("general", "left", "center", "right", "fill", "justify", "centerContinuous", "distributed"),
    "vertical": _one_of("top", "center", "bottom", "justify", "distributed"),
    "gradient": _one_of("linear", "path"),
    "preserve": _one_of("preserve", "default"),
    "text": lambda v: v.isNotNull(),
}

_COLOR = "auto=bool indexed=count rgb=rgb theme=count tint=tint"
#: For each kind of part, element: its parents, then attributes with their shapes.
GRAMMAR = {
    "workbook": """
        workbook : -
        sheets : workbook
        sheet : sheets : name=title sheetId=count state=state id=rid""",
    "worksheet": f"""
        worksheet : -
        dimension : worksheet : ref=range
        sheetViews : worksheet
        sheetView : sheetViews : workbookViewId=count tabSelected=bool showGridLines=bool showFormulas=bool showRowColHeaders=bool showZeros=bool rightToLeft=bool zoomScale=count zoomScaleNormal=count zoomScaleSheetLayoutView=count zoomScalePageLayoutView=count view=view topLeftCell=cell showRuler=bool showOutlineSymbols=bool defaultGridColor=bool showWhiteSpace=bool colorId=count windowProtection=bool
        pane : sheetView : xSplit=float ySplit=float topLeftCell=cell activePane=pane state=pane_state
        sheetFormatPr : worksheet : baseColWidth=count defaultColWidth=float defaultRowHeight=float customHeight=bool zeroHeight=bool thickTop=bool thickBottom=bool outlineLevelRow=count outlineLevelCol=count
        cols : worksheet
        col : cols : min=count max=count width=float style=count hidden=bool bestFit=bool customWidth=bool outlineLevel=count collapsed=bool phonetic=bool
        sheetData : worksheet
        row : sheetData : r=count spans=span s=count customFormat=bool ht=float hidden=bool customHeight=bool outlineLevel=count collapsed=bool thickTop=bool thickBot=bool ph=bool
        c : row : r=cell s=count t=cell_type
        v : c : space=preserve
        f : c : t=word ref=range si=count ca=bool space=preserve
        is : c
        t : is : space=preserve
        mergeCells : worksheet : count=count
        mergeCell : mergeCells : ref=range
        printOptions : worksheet : horizontalCentered=bool verticalCentered=bool headings=bool gridLines=bool gridLinesSet=bool
        pageMargins : worksheet : left=scientific right=scientific top=scientific bottom=scientific header=scientific footer=scientific""",
    "styles": f"""
        styleSheet : -
        numFmts : styleSheet : count=count
        numFmt : numFmts : numFmtId=count formatCode=text
        fonts : styleSheet : count=count knownFonts=bool
        font : fonts
        name : font : val=text
        sz : font : val=float
        b : font : val=bool
        i : font : val=bool
        strike : font : val=bool
        outline : font : val=bool
        shadow : font : val=bool
        condense : font : val=bool
        extend : font : val=bool
        u : font : val=underline
        vertAlign : font : val=vertical_run
        scheme : font : val=scheme
        family : font : val=count
        charset : font : val=count
        color : font left right top bottom diagonal start end vertical horizontal stop : {_COLOR}
        fills : styleSheet : count=count
        fill : fills
        patternFill : fill : patternType=pattern
        fgColor : patternFill : {_COLOR}
        bgColor : patternFill : {_COLOR}
        gradientFill : fill : type=gradient degree=scientific left=unit right=unit top=unit bottom=unit
        stop : gradientFill : position=unit
        borders : styleSheet : count=count
        border : borders : diagonalUp=bool diagonalDown=bool outline=bool
        left : border : style=line
        right : border : style=line
        top : border : style=line
        bottom : border : style=line
        diagonal : border : style=line
        start : border : style=line
        end : border : style=line
        vertical : border : style=line
        horizontal : border : style=line
        cellStyleXfs : styleSheet : count=count
        cellXfs : styleSheet : count=count
        xf : cellStyleXfs cellXfs : numFmtId=count fontId=count fillId=count borderId=count xfId=count quotePrefix=bool pivotButton=bool applyNumberFormat=bool applyFont=bool applyFill=bool applyBorder=bool applyAlignment=bool applyProtection=bool
        alignment : xf : horizontal=horizontal vertical=vertical textRotation=count wrapText=bool indent=count relativeIndent=int justifyLastLine=bool shrinkToFit=bool readingOrder=count
        protection : xf : locked=bool hidden=bool""",
    "sharedStrings": """
        sst : - : count=count uniqueCount=count
        si : sst
        t : si : space=preserve""",
    "relationships": """
        Relationships : -
        Relationship : Relationships : Id=rid Type=text Target=text""",
    "types": """
        Types : -
        Default : Types : Extension=word ContentType=text
        Override : Types : PartName=text ContentType=text""",
}
#: Attributes that have to be there.
REQUIRED = {("workbook", "sheet"): ("name", "sheetId", "id"), ("worksheet", "mergeCell"): ("ref",), ("worksheet", "col"): ("min", "max"), ("styles", "numFmt"): ("numFmtId", "formatCode"), ("relationships", "Relationship"): ("Id", "Type", "Target")}


def _rules() -> tuple[list[tuple], list[tuple]]:
    """(kind, parent, element) and (kind, element, attribute, shape) of the grammar."""
    places, attributes = [], []
    for kind, text in GRAMMAR.items():
        for line in text.strip().splitlines():
            element, parents, *rest = (x.strip() for x in line.split(" : "))
            places += [(kind, "" if p == "-" else p, element) for p in parents.split()]
            attributes += [(kind, element, *a.split("=")) for a in " ".join(rest).split()]
    return places, attributes


def part_kind(name: str) -> str:
    """Which part of the grammar holds for a part; ``other`` has none."""
    if name.endswith(".rels"):
        return "relationships"
    if name.startswith("xl/worksheets/") and name.endswith(".xml"):
        return "worksheet"
    return {"[Content_Types].xml": "types", "xl/workbook.xml": "workbook", "xl/styles.xml": "styles", "xl/sharedStrings.xml": "sharedStrings"}.get(name, "other")


def part_nodes(name: str, data: bytes) -> Iterator[tuple]:
    """A part's elements, one row for each attribute and one without, in document order; streamed, so nothing is kept of what was read."""
    kind, place, above = part_kind(name), 0, []
    local = lambda tag: tag.rsplit("}", 1)[-1]
    if kind == "other":
        return
    try:
        for event, e in ET.iterparse(io.BytesIO(data), ("start", "end")):
            if event == "start":
                place += 1
                parent = local(above[-1].tag) if above else ""
                yield name, kind, place, parent, local(e.tag), None, None
                for a, v in e.attrib.items():
                    yield name, kind, place, parent, local(e.tag), local(a), v
                above.append(e)
            else:
                above.pop()
                e.clear()
                if above:
                    above[-1].remove(e)
    except ET.ParseError:
        yield name, kind, place, "", "", None, "not XML"


def package_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of every package at a path that Spark can read, with the file's path; one task reads a file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.split()[0] for f in NODES.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        out = pd.DataFrame(list(part_nodes(n, z.read(n))), columns=names).astype(object)
                        yield out.where(out.notna(), None).assign(path=p)

    return files.mapInPandas(parse, NODES + ", path string")


def nodes_of(spark: SparkSession, parts: dict[str, bytes]) -> DataFrame:
    """The nodes of one package's parts."""
    return spark.createDataFrame([n for name, data in parts.items() for n in part_nodes(name, data)], NODES)


def problems(nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(..., part, place, element, attribute, reason): what the grammar doesn't allow, for packages told apart by ``by``.

    Reasons: malformed, unknown_element (in its parent), unknown_attribute, invalid_value, missing_attribute,
    repeated_relationship, repeated_title, uncounted (a ``count`` that isn't the number of children). Tables of rules are broadcast.
    """
    spark, at = nodes.sparkSession, [*by, "part"]
    places, attributes = _rules()
    places = F.broadcast(spark.createDataFrame([(*p, True) for p in places], "kind string, parent string, element string, allowed boolean"))
    attributes = F.broadcast(spark.createDataFrame(attributes, "kind string, element string, attribute string, shape string"))
    required = F.broadcast(spark.createDataFrame([(k, e, list(a)) for (k, e), a in REQUIRED.items()], "kind string, element string, needed array<string>"))
    null = F.lit(None).cast("string")

    def found(df: DataFrame, reason, attribute=null) -> DataFrame:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return df.select(*at, "place", "element", attribute.alias("attribute"), reason.alias("reason")).where("reason is not null")

    own = nodes.where("attribute is null")
    elements = own.join(places, ["kind", "parent", "element"], "left")
    out = found(elements, F.when(F.col("element") == "", "malformed").when(F.col("allowed").isNull(), "unknown_element"))
    shaped = nodes.where("attribute is not null").join(attributes, ["kind", "element", "attribute"], "left")
    fits: Column = F.lit(None).cast("boolean")
    for name, check in SHAPES.items():
        fits = F.when(F.col("shape") == name, F.coalesce(check(F.col("value")), F.lit(False))).otherwise(fits)
    out = out.unionByName(found(shaped, F.when(F.col("shape").isNull(), "unknown_attribute").when(~fits, "invalid_value"), F.col("attribute")))
    each = nodes.join(required, ["kind", "element"]).groupBy(*at, "place", "element", "needed").agg(F.collect_set("attribute").alias("has"))
    lacking = each.select(*at, "place", "element", F.explode(F.array_except("needed", "has")).alias("attribute"))
    out = out.unionByName(found(lacking, "missing_attribute", F.col("attribute")))
    for kind, element, attribute, reason in (("relationships", "Relationship", "Id", "repeated_relationship"), ("workbook", "sheet", "name", "repeated_title")):
        twice = nodes.where((F.col("kind") == kind) & (F.col("element") == element) & (F.col("attribute") == attribute)).groupBy(*at, "element", "attribute", F.lower("value").alias("low")).agg(F.count("*").alias("n"), F.max("place").alias("place")).where("n > 1")
        out = out.unionByName(found(twice, reason, F.col("attribute")))
    # A container's children all have it as parent, and there's one of each container in a part.
    counted = nodes.where("attribute = 'count'").select(*at, "place", "element", F.col("value").alias("said"))
    children = own.groupBy(*at, F.col("parent").alias("element")).agg(F.count("*").alias("n"))
    wrong = counted.join(children, [*at, "element"], "left").where("coalesce(n, 0) <> try_cast(said as long) and element <> 'sst'")
    return out.unionByName(found(wrong, "uncounted", F.lit("count")))
