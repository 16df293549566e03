"""Format predicates of registry fields, package paths and style values."""

from __future__ import annotations

import posixpath
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_CHARS = 64

#: Number formats by what they show, and what each falls back to.
FORMAT_FALLBACK = {"datetime": "dd.mm.yyyy hh:mm:ss", "date": "yyyy-mm-dd", "time": "hh:mm:ss", "percent": "0.00%", "other": "0.00"}
#: Fonts that stay.
FONTS = ("Calibri", "Calibri Light", "Arial", "Times New Roman", "Courier New", "Segoe UI", "Tahoma", "Verdana", "Aptos")
#: Own number formats that stay.
FORMATS = ("yyyy-mm-dd", "dd.mm.yyyy", "dd.mm.yy", "dd.mm.yyyy hh:mm", "dd.mm.yyyy hh:mm:ss", "hh:mm", "hh:mm:ss")
#: Names that a file can't have on some systems.
RESERVED = frozenset({"con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))})


def is_hex32(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9a-f]{32}\z"), F.lit(False))


def is_hex64(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def is_period(c: Column) -> Column:
    """A month, as 2024-07."""
    return F.coalesce(c.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])\z"), F.lit(False))


def is_timestamp(c: Column) -> Column:
    """A UTC second that exists, as 2024-07-01T00:00:00Z."""
    shape = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z")
    return F.coalesce(shape & F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull(), F.lit(False))


def is_label(c: Column) -> Column:
    """Null, or 1 to 64 characters without control characters or white space at the ends."""
    from .identifiers import strip

    fits = F.length(c).between(1, LABEL_CHARS) & (strip(c) == c) & ~c.rlike(r"[\x00-\x1f\x7f-\x9f]")
    return c.isNull() | F.coalesce(fits, F.lit(False))


def part_kind(name: Column) -> Column:
    """Which finding the name of a package part stands for; null for none."""
    low = F.lower(name)
    base = F.element_at(F.split(low, "/"), -1)
    xml = low.endswith(".xml")
    quiet = low.endswith("/") | low.endswith(".rels") | low.contains("/_rels/")
    return (
        F.when(quiet, None)
        .when(low.startswith("xl/externallinks/") & xml, "external_link")
        .when(low.startswith("xl/drawings/") & xml, "drawing")
        .when(low.startswith("xl/charts/") & base.startswith("chart") & xml, "chart")
        .when(low.startswith("xl/chartsheets/") & xml, "chartsheet")
        .when(low.startswith("xl/media/"), "media")
        .when(low.startswith("xl/embeddings/"), "embedding")
        .when((low.startswith("xl/pivotcache/") | low.startswith("xl/pivottables/")) & xml, "pivot")
        .when(low.startswith("customxml/") & xml, "custom_xml")
        .when(low == "xl/vbaproject.bin", "vba")
        .when((low.startswith("xl/threadedcomments/") | low.startswith("xl/persons/")) & xml, "threaded_comment")
    )


def is_safe_member(name: Column) -> Column:
    """Whether a package part's name can be taken as a relative path on any system."""
    parts = F.split(name, "/")
    stems = F.transform(parts, lambda p: F.lower(F.split(p, r"\.")[0]))
    fine = (F.length(name) > 0) & ~name.rlike(r"[\x00\\:]") & ~name.startswith("/")
    fine = fine & ~F.exists(parts, lambda p: p.isin("", ".", "..") | p.endswith(" ") | p.endswith("."))
    return F.coalesce(fine & ~F.exists(stems, lambda s: s.isin(*sorted(RESERVED))), F.lit(False))


def canonical_member(name: str) -> str:
    """The name by which parts collide."""
    return name.casefold()


def relationship_target(source: str, target: str) -> str | None:
    """The part that a relationship of ``source`` names; None where it leaves the package."""
    path = target if target.startswith("/") else posixpath.join("/", posixpath.dirname(source), target)
    out: list[str] = []
    for step in path.split("/"):
        if step == "..":
            if not out:
                return None
            out.pop()
        elif step not in ("", "."):
            out.append(step)
    return "/".join(out)


def relationships_of(part: str) -> str:
    """Where a part's relationships are kept."""
    folder, name = posixpath.split(part)
    return posixpath.join(folder, "_rels", name + ".rels")


def content_type(part: str, overrides: dict[str, str], defaults: dict[str, str]) -> str | None:
    """A part's declared type: its own, else its extension's."""
    return overrides.get("/" + part) or defaults.get(part.rsplit(".", 1)[-1].lower() if "." in part else "")


def font_name(name: str | None) -> str:
    """A listed font, else the default one."""
    plain = unicodedata.normalize("NFC", name or "").strip()
    return plain if plain in FONTS else FONTS[0]


def number_format(code: str | None) -> str:
    """A listed format, else one that still shows the same kind of value."""
    if code in FORMATS:
        return code
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code or "").lower()
    date, time = bool(re.search(r"[yd]", bare)), bool(re.search(r"[hs]", bare))
    kind = "datetime" if date and time else "date" if date else "time" if time else "percent" if "%" in bare else "other"
    return FORMAT_FALLBACK[kind]


def kdf_problem(n: int, r: int, p: int, memory: int = 256 << 20) -> str | None:
    """Why scrypt parameters can't be used, or None."""
    if any(isinstance(v, bool) or not isinstance(v, int) for v in (n, r, p)):
        return "kdf_type"
    if not 1 << 14 <= n <= 1 << 20 or n & (n - 1):
        return "kdf_n"
    if not 1 <= r <= 32:
        return "kdf_r"
    if not 1 <= p <= 16:
        return "kdf_p"
    return "kdf_memory" if 128 * n * r > memory else None
