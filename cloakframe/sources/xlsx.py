"""Spreadsheet packages: cells, sheets, properties and parts as tables, and values written back into a copy.

A package is one zip file, parsed by one task; many files are read in parallel. Nothing is written by the readers.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from decimal import Decimal
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.formats import relationship_target, relationships_of
from ..types import PackageError, WriterValidationError
from .tables import CELLS, SHEETS, sized

#: Namespaces and types of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
CUSTOM = "http://schemas.openxmlformats.org/officeDocument/2006/custom-properties"
VARIANT = "http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes"
CUSTOM_ID = "{D5CDD505-2E9C-101B-9397-08002B2CF9AE}"
#: Number formats of dates and times that a package needn't declare.
BUILT_IN_DATES = frozenset({*range(14, 23), *range(45, 48)})
BUILT_IN_TIMES = frozenset({18, 19, 20, 21, 45, 46, 47})
JOB_ID, RESTORED_FROM, ANALYTICAL = "JobId", "RestoredFromJobId", "AnalyticallyRestored"

for _prefix, _uri in (("", MAIN), ("r", OFFICE_REL)):
    ET.register_namespace(_prefix, _uri)


def tag(name: str, ns: str = MAIN) -> str:
    return f"{{{ns}}}{name}"


def split_reference(ref: str) -> tuple[int, int]:
    """B3 -> (3, 2)."""
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?([0-9]+)", ref)
    if not m:
        raise PackageError("invalid_cell_reference")
    column = 0
    for ch in m[1]:
        column = column * 26 + ord(ch) - 64
    return int(m[2]), column


def reference(row: int, column: int) -> str:
    letters = ""
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def ranges(ref: str) -> Iterator[tuple[int, int, int, int]]:
    for part in ref.split():
        a, _, b = part.partition(":")
        r1, c1 = split_reference(a)
        r2, c2 = split_reference(b or a)
        yield r1, c1, r2, c2


@dataclass
class SheetPart:
    title: str
    state: str
    part: str


@dataclass
class Package:
    """The parts of one file, parsed where asked for."""

    parts: dict[str, bytes]
    sheets: list[SheetPart] = field(default_factory=list)

    @classmethod
    def load(cls, data: bytes) -> Package:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                p = cls({n: z.read(n) for n in z.namelist() if not n.endswith("/")})
        except zipfile.BadZipFile:
            raise PackageError("invalid_input_package") from None
        book = p.workbook_part()
        targets = {i: t for i, _, t, external in p.relationships(book) if not external}
        for s in p.xml(book).iter(tag("sheet")):
            p.sheets.append(SheetPart(s.get("name"), s.get("state") or "visible", targets.get(s.get(tag("id", OFFICE_REL)), "")))
        return p

    def xml(self, part: str) -> ET.Element:
        try:
            return ET.fromstring(self.parts[part])
        except (KeyError, ET.ParseError):
            raise PackageError("invalid_input_package") from None

    def relationships(self, part: str) -> list[tuple[str, str, str, bool]]:
        """(id, type's last word, target part or address, external) of a part's relationships; "" is the package."""
        at = relationships_of(part) if part else "_rels/.rels"
        if at not in self.parts:
            return []
        out = []
        for r in self.xml(at):
            external = r.get("TargetMode") == "External"
            target = r.get("Target") if external else relationship_target(part, r.get("Target"))
            out.append((r.get("Id"), r.get("Type", "").rsplit("/", 1)[-1], target, external))
        return out

    def workbook_part(self) -> str:
        found = [t for _, kind, t, _ in self.relationships("") if kind == "officeDocument"]
        if len(found) != 1 or found[0] not in self.parts:
            raise PackageError("invalid_input_package")
        return found[0]

    def related(self, part: str, kind: str) -> list[str]:
        return [t for _, k, t, external in self.relationships(part) if k == kind and not external and t in self.parts]

    def strings(self) -> list[str]:
        for part in self.related(self.workbook_part(), "sharedStrings"):
            return [_text(si) for si in self.xml(part).findall(tag("si"))]
        return []

    def date_styles(self) -> dict[int, str]:
        """Style number -> date, time or datetime."""
        out: dict[int, str] = {}
        for part in self.related(self.workbook_part(), "styles"):
            x = self.xml(part)
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in x.iter(tag("numFmt"))}
            for i, xf in enumerate(x.findall(f"{tag('cellXfs')}/{tag('xf')}")):
                n = int(xf.get("numFmtId") or 0)
                if n in own:
                    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", own[n]).lower()
                    date, time = re.search(r"[yd]", bare), re.search(r"[hs]", bare)
                    if date or time:
                        out[i] = "datetime" if date and time else "date" if date else "time"
                elif n in BUILT_IN_DATES:
                    out[i] = "datetime" if n == 22 else "time" if n in BUILT_IN_TIMES else "date"
        return out

    def cells(self) -> Iterator[dict]:
        """Cells that are there, sheet by sheet in row-major order."""
        strings, dates = self.strings(), self.date_styles()
        for index, sheet in enumerate(self.sheets, 1):
            if not sheet.part:
                continue
            x = self.xml(sheet.part)
            merged = [m for mc in x.iter(tag("mergeCell")) for m in ranges(mc.get("ref"))]
            linked = [m for h in x.iter(tag("hyperlink")) for m in ranges(h.get("ref"))]
            commented = {split_reference(c.get("ref")) for part in self.related(sheet.part, "comments") for c in self.xml(part).iter(tag("comment"))}
            at_row = 0
            for row in x.iter(tag("row")):
                at_row = int(row.get("r") or at_row + 1)
                at_column = 0
                for c in row.findall(tag("c")):
                    r, at_column = split_reference(c.get("r")) if c.get("r") else (at_row, at_column + 1)
                    inside = lambda m, r=r, k=at_column: m[0] <= r <= m[2] and m[1] <= k <= m[3]
                    yield {
                        "sheet_index": index, "sheet_name": sheet.title, "row": r, "column": at_column, **_value(c, strings, dates),
                        "is_merged_child": any(inside(m) and (r, at_column) != m[:2] for m in merged),
                        "has_comment": (r, at_column) in commented, "has_hyperlink": any(map(inside, linked)),
                    }

    def extent(self) -> Iterator[dict]:
        seen: dict[int, list[int]] = {}
        for c in self.cells():
            e = seen.setdefault(c["sheet_index"], [1, 1])
            e[0], e[1] = max(e[0], c["row"]), max(e[1], c["column"])
        for i, s in enumerate(self.sheets, 1):
            r, c = seen.get(i, [1, 1])
            yield {"sheet_index": i, "title": s.title, "state": s.state, "max_row": r, "max_column": c}

    def properties(self) -> Iterator[dict]:
        for kind, scope in (("core-properties", "core"), ("custom-properties", "custom")):
            for part in self.related("", kind):
                for p in self.xml(part):
                    name = p.get("name") if scope == "custom" else p.tag.rsplit("}", 1)[-1]
                    yield {"scope": scope, "name": name, "value": "".join(p.itertext())}

    def extras(self) -> Iterator[dict]:
        """Findings besides cells, properties and parts: defined names, tables, headers and footers."""
        none = {"worksheet_index": None, "row": None, "column": None, "part": None}
        for _ in self.xml(self.workbook_part()).iter(tag("definedName")):
            yield {"kind": "defined_name", "phase": 2, **none}
        for i, s in enumerate(self.sheets, 1):
            if s.part:
                for _ in self.related(s.part, "table"):
                    yield {"kind": "table", "phase": 3, **none, "worksheet_index": i}
                if any((e.text or "").strip() for h in self.xml(s.part).iter(tag("headerFooter")) for e in h):
                    yield {"kind": "header_footer", "phase": 3, **none, "worksheet_index": i}

    def job_id(self) -> str:
        """The one job id of the file."""
        found = [p["value"] for p in self.properties() if p["scope"] == "custom" and p["name"] == JOB_ID]
        if len(found) != 1 or not found[0].strip():
            raise PackageError("job_id_missing_or_repeated")
        return found[0]

    def save(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name in sorted(self.parts, key=lambda n: (n != "[Content_Types].xml", n)):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), self.parts[name], zipfile.ZIP_DEFLATED)
        return out.getvalue()


def _text(x: ET.Element) -> str:
    """Plain text of a string item, phonetic hints left out."""
    return "".join(t.text or "" for r in x if r.tag in (tag("t"), tag("r")) for t in ([r] if r.tag == tag("t") else r.findall(tag("t"))))


def _value(c: ET.Element, strings: list[str], dates: dict[int, str]) -> dict:
    out = {"kind": "null", "s": None, "i": None, "d": None, "b": None, "ts": None}
    kind, v, f = c.get("t") or "n", c.findtext(tag("v")), c.find(tag("f"))
    if f is not None:
        return out | {"kind": "formula", "s": "=" + (f.text or "")}
    if kind == "inlineStr":
        return out | {"kind": "str", "s": _text(c.find(tag("is")))} if c.find(tag("is")) is not None else out
    if v is None:
        return out
    if kind == "s":
        return out | {"kind": "str", "s": strings[int(v)]}
    if kind in ("str", "e"):
        return out | {"kind": "error" if kind == "e" else "str", "s": v}
    if kind == "b":
        return out | {"kind": "bool", "b": v == "1"}
    shown = dates.get(int(c.get("s") or 0))
    if shown:
        when = datetime(1899, 12, 30) + timedelta(days=float(v))
        return out | ({"kind": "time", "s": when.strftime("%H:%M:%S")} if shown == "time" else {"kind": shown, "ts": when})
    return out | ({"kind": "int", "i": Decimal(v)} if re.fullmatch(r"-?[0-9]+", v) else {"kind": "float", "d": float(v)})


class _Files(InputPartition):
    def __init__(self, path: str):
        self.path = path


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").option("table", "cells" or "sheets").load(path)``: one task for each file."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SHEETS if self.options.get("table") == "sheets" else CELLS

    def reader(self, schema) -> DataSourceReader:
        return _XlsxReader(self.options, [f.name for f in schema.fields])


class _XlsxReader(DataSourceReader):
    def __init__(self, options, names):
        self.path, self.table, self.names = options["path"], options.get("table", "cells"), names

    def partitions(self):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        info = store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            return [_Files(f"{self.path.rstrip('/')}/{i.base_name}") for i in store.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".xlsx")]
        return [_Files(self.path)]

    def read(self, partition):
        from pyarrow import fs

        path = partition.path
        store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        with store.open_input_stream(at) as f:
            package = Package.load(f.read())
        for row in package.extent() if self.table == "sheets" else package.cells():
            yield tuple(row[n] for n in self.names)


PROPERTIES = "scope string, name string, value string"
EXTRAS = "kind string, phase int, worksheet_index int, row long, column int, part string"
PARTS = "name string, bytes long, compressed long"


def read_package(spark: SparkSession, path: str, table: str) -> DataFrame:
    """cells, sheets, properties, extras or parts of every package at a path that Spark can read, with the file's path."""
    schema = {"cells": CELLS, "sheets": SHEETS, "properties": PROPERTIES, "extras": EXTRAS, "parts": PARTS}[table]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^(]*\))", schema)]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = _parts(content) if table == "parts" else getattr(Package.load(content), {"sheets": "extent"}.get(table, table))()
                out = pd.DataFrame([{**r, "path": p} for r in rows], columns=[*names, "path"])
                yield out.astype(object).where(out.notna(), None)

    return files.mapInPandas(parse, schema + ", path string")


def _parts(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [{"name": i.filename, "bytes": i.file_size, "compressed": i.compress_size} for i in z.infolist()]


def sink_problems(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """(sheet_name, row, column, reason): cells to be written that have no sheet, a double place, a place out of bounds, or a value in a merged child."""
    doubled = cells.groupBy("sheet_name", "row", "column").agg(F.count("*").alias("n"), F.max((F.col("is_merged_child") & (F.col("kind") != "null")).cast("int")).alias("child"))
    x = doubled.join(sized(sheets.select(F.col("title").alias("sheet_name"), "max_row", "max_column")), "sheet_name", "left")
    reason = F.when(F.col("max_row").isNull(), "unknown_sheet").when(F.col("n") > 1, "duplicate_coordinate").when((F.col("row") < 1) | (F.col("column") < 1) | (F.col("row") > F.col("max_row")) | (F.col("column") > F.col("max_column")), "out_of_bounds").when(F.col("child") == 1, "merged_child")
    return x.select("sheet_name", "row", "column", reason.alias("reason")).where("reason is not null")


def with_values(package: Package, values: dict[str, dict[tuple[int, int], object]]) -> Package:
    """A copy with values overwritten at coordinates; styles and everything else stay. None empties a cell."""
    out = Package(dict(package.parts), package.sheets)
    by_title = {s.title: s for s in package.sheets}
    for title, cells in values.items():
        if title not in by_title:
            raise WriterValidationError("unknown_sheet")
        x = out.xml(by_title[title].part)
        there = {split_reference(c.get("r")): c for c in x.iter(tag("c")) if c.get("r")}
        for at, v in cells.items():
            if at not in there:
                if v is None:
                    continue
                raise WriterValidationError("out_of_bounds", row=at[0], column=at[1])
            _set(there[at], v)
        out.parts[by_title[title].part] = ET.tostring(x, encoding="UTF-8", xml_declaration=True)
    return out


def _set(c: ET.Element, v: object) -> None:
    for child in list(c):
        c.remove(child)
    c.attrib.pop("t", None)
    if v is None:
        return
    if isinstance(v, bool):
        c.set("t", "b")
        ET.SubElement(c, tag("v")).text = "1" if v else "0"
    elif isinstance(v, int | float | Decimal):
        ET.SubElement(c, tag("v")).text = str(v)
    elif isinstance(v, datetime):
        ET.SubElement(c, tag("v")).text = repr((v - datetime(1899, 12, 30)) / timedelta(days=1))
    else:
        c.set("t", "inlineStr")
        t = ET.SubElement(ET.SubElement(c, tag("is")), tag("t"))
        t.text = str(v)
        t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


#: What a published worksheet keeps, in this order, and the attributes of a cell.
PUBLISHED_ELEMENTS = ("dimension", "sheetViews", "sheetFormatPr", "cols", "sheetData", "mergeCells", "printOptions", "pageMargins")
CELL_ATTRIBUTES = ("r", "s", "t")
#: The format's main content type.
MAIN_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def published(package: Package, drop: Iterable[str] = ()) -> Package:
    """A new package of a closed list of parts: the sheets without those in ``drop``, the styles, and the texts that cells still refer to.

    Whatever may hold a copy of a cell's value stays behind: shared strings of cells that were overwritten, cached results of
    formulas, comments, charts, pivot caches, names, links, validations, formats, headers and document properties.
    """
    drop = set(drop)
    kept = [s for s in package.sheets if s.title not in drop]
    strings, places, parts = package.strings(), {}, {}
    for i, s in enumerate(kept, 1):
        x, root = package.xml(s.part), ET.Element(tag("worksheet"))
        for name in PUBLISHED_ELEMENTS:
            root.extend(x.findall(tag(name)))
        for view in root.iter(tag("sheetView")):
            for child in [c for c in view if c.tag != tag("pane")]:
                view.remove(child)
        for row in root.iter(tag("row")):
            for child in [c for c in row if c.tag != tag("c")]:
                row.remove(child)
        for c in root.iter(tag("c")):
            _publish_cell(c, strings, places)
        parts[f"xl/worksheets/sheet{i}.xml"] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    styles = next((package.parts[p] for p in package.related(package.workbook_part(), "styles")), None)
    return Package.load(Package(assembled(parts, [(s.title, s.state) for s in kept], styles, list(places))).save())


def _publish_cell(c: ET.Element, strings: list[str], places: dict[str, int]) -> None:
    """A cell of value and formula alone; texts go to the shared strings, which ``places`` numbers."""
    kind, formula = c.get("t") or "n", c.find(tag("f"))
    text = None
    if formula is None and kind == "s" and c.findtext(tag("v")) is not None:
        text = strings[int(c.findtext(tag("v")))]
    elif formula is None and kind == "inlineStr" and c.find(tag("is")) is not None:
        text = _text(c.find(tag("is")))
    for child in list(c):
        if child.tag != tag("f") and (child.tag != tag("v") or formula is not None or text is not None):
            c.remove(child)
    for a in set(c.attrib) - set(CELL_ATTRIBUTES):
        del c.attrib[a]
    if formula is not None:
        c.attrib.pop("t", None)
    elif text is not None:
        c.set("t", "s")
        ET.SubElement(c, tag("v")).text = str(places.setdefault(text, len(places)))
    elif kind in ("s", "inlineStr"):
        c.attrib.pop("t", None)


def assembled(sheets: dict[str, bytes], titles: list[tuple[str, str]], styles: bytes | None, texts: list[str]) -> dict[str, bytes]:
    """The parts of a package around its sheets, which are numbered from one."""
    parts, listed, rels, types = dict(sheets), "", "", ""

    def add(kind: str, target: str, content: str) -> str:
        nonlocal rels, types
        rid = f"rId{rels.count('<Relationship ') + 1}"
        rels += f'<Relationship Id="{rid}" Type="{OFFICE_REL}/{kind}" Target="{target}"/>'
        types += f'<Override PartName="/xl/{target}" ContentType="{MAIN_TYPE}.{content}+xml"/>'
        return rid

    for i, (title, state) in enumerate(titles, 1):
        rid = add("worksheet", f"worksheets/sheet{i}.xml", "worksheet")
        e = ET.Element("sheet", {"name": title, "sheetId": str(i), **({} if state == "visible" else {"state": state})})
        listed += ET.tostring(e, encoding="unicode").removesuffix("/>") + f' r:id="{rid}"/>'
    if styles is not None:
        add("styles", "styles.xml", "styles")
        parts["xl/styles.xml"] = styles
    if texts:
        add("sharedStrings", "sharedStrings.xml", "sharedStrings")
        root = ET.Element(tag("sst"))
        for t in texts:
            e = ET.SubElement(ET.SubElement(root, tag("si")), tag("t"), {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
            e.text = t
        parts["xl/sharedStrings.xml"] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    parts["xl/workbook.xml"] = f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE_REL}"><sheets>{listed}</sheets></workbook>'.encode()
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{PACKAGE_REL}">{rels}</Relationships>'.encode()
    parts["_rels/.rels"] = f'<Relationships xmlns="{PACKAGE_REL}"><Relationship Id="rId1" Type="{OFFICE_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>'.encode()
    parts["[Content_Types].xml"] = f'<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{MAIN_TYPE}.sheet.main+xml"/>{types}</Types>'.encode()
    return parts


def with_property(package: Package, name: str, value: str, drop: tuple[str, ...] = ()) -> Package:
    """A copy with exactly one custom property of that name; those in ``drop`` go."""
    out = Package(dict(package.parts), package.sheets)
    at = (out.related("", "custom-properties") or ["docProps/custom.xml"])[0]
    root = out.xml(at) if at in out.parts else ET.Element(tag("Properties", CUSTOM))
    for p in list(root):
        if p.get("name") in (name, *drop):
            root.remove(p)
    p = ET.SubElement(root, tag("property", CUSTOM), {"fmtid": CUSTOM_ID, "name": name})
    ET.SubElement(p, tag("lpwstr", VARIANT)).text = value
    for i, p in enumerate(root, 2):
        p.set("pid", str(i))
    if at not in out.parts:
        types, rels = out.xml("[Content_Types].xml"), out.xml("_rels/.rels")
        ET.SubElement(types, tag("Override", TYPES), {"PartName": "/" + at, "ContentType": "application/vnd.openxmlformats-officedocument.custom-properties+xml"})
        ET.SubElement(rels, tag("Relationship", PACKAGE_REL), {"Id": "rIdJob", "Type": OFFICE_REL + "/custom-properties", "Target": at})
        out.parts["[Content_Types].xml"], out.parts["_rels/.rels"] = (ET.tostring(x, encoding="UTF-8", xml_declaration=True) for x in (types, rels))
    out.parts[at] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    return out


def new_package(sheets: dict[str, list[list]], states: dict[str, str] | None = None) -> Package:
    """A plain package of rows of values, for results that have no source file."""
    parts = {}
    for i, rows in enumerate(sheets.values(), 1):
        root = ET.Element(tag("worksheet"))
        data = ET.SubElement(root, tag("sheetData"))
        for r, values in enumerate(rows, 1):
            row = ET.SubElement(data, tag("row"), {"r": str(r)})
            for k, v in enumerate(values, 1):
                if v is None:
                    continue
                c = ET.SubElement(row, tag("c"), {"r": reference(r, k)})
                if isinstance(v, str) and v.startswith("="):
                    ET.SubElement(c, tag("f")).text = v[1:]
                else:
                    _set(c, v)
        parts[f"xl/worksheets/sheet{i}.xml"] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    styles = f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font><name val="Calibri"/></font></fonts><fills count="1"><fill><patternFill/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>'
    return Package.load(Package(assembled(parts, [(t, (states or {}).get(t, "visible")) for t in sheets], styles.encode(), [])).save())


def publish(data: bytes, destination: str, replace: bool = True) -> None:
    """Write a file whole or not at all; with ``replace`` off an existing one is refused."""
    folder = os.path.dirname(os.path.abspath(destination))
    handle, temp = tempfile.mkstemp(dir=folder, prefix=".", suffix=".tmp")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if replace:
            os.replace(temp, destination)
        else:
            try:
                os.link(temp, destination)
            except FileExistsError:
                raise WriterValidationError("destination_exists") from None
    finally:
        if os.path.exists(temp):
            os.unlink(temp)
