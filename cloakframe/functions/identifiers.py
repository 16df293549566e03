"""Validators of business identifiers and cell predicates, as column expressions without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that count as white space at the ends of a value.
STRIP_CODES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
STRIP_CHARS = "".join(map(chr, STRIP_CODES))

#: Checksum weights.
WEIGHTS_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
WEIGHTS_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
WEIGHTS_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def strip(c: Column) -> Column:
    """The value without white space at its ends."""
    return F.trim(c, F.lit(STRIP_CHARS))


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space; numbers are never blank."""
    return c.isNull() | (strip(c.cast("string")) == "")


def is_formula(c: Column) -> Column:
    return F.coalesce(c.startswith("="), F.lit(False))


def candidate(c: Column, kind: str) -> Column:
    """The text that validators see: strings stripped, integers in digits, anything else null."""
    if kind == "string":
        return strip(c)
    return c.cast("string") if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal") and kind.endswith(",0)") else F.lit(None).cast("string")


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i, 1).cast("int")


def _check(c: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + _digit(c, i) * w
    return total % 11 % 10


def _digits(c: Column, n: int) -> Column:
    return c.rlike(rf"^[0-9]{{{n}}}\z")


def is_inn(c: Column) -> Column:
    """Ten digits with one check digit or twelve with two."""
    ten = _check(c, WEIGHTS_10) == _digit(c, 10)
    twelve = (_check(c, WEIGHTS_11) == _digit(c, 11)) & (_check(c, WEIGHTS_12) == _digit(c, 12))
    return F.when(_digits(c, 10), ten).when(_digits(c, 12), twelve).otherwise(False)


def is_ogrn13(c: Column) -> Column:
    return F.when(_digits(c, 13), F.substring(c, 1, 12).cast("bigint") % 11 % 10 == _digit(c, 13)).otherwise(False)


def is_ogrnip(c: Column) -> Column:
    return F.when(_digits(c, 15), F.substring(c, 1, 14).cast("bigint") % 13 % 10 == _digit(c, 15)).otherwise(False)


def is_ogrn(c: Column) -> Column:
    """Either form."""
    return is_ogrn13(c) | is_ogrnip(c)


def is_kpp(c: Column) -> Column:
    """Its shape alone; there is no checksum."""
    return F.coalesce(c.rlike(r"^[0-9]{4}[0-9A-Z]{2}[0-9]{3}\z"), F.lit(False))


def value_type(c: Column) -> Column:
    """inn, ogrn or unknown; a kpp is never told by its value."""
    return F.when(is_inn(c), "inn").when(is_ogrn(c), "ogrn").otherwise("unknown")


def is_identifier_like(c: Column) -> Column:
    """Any identifier's shape and checksum, kpp included."""
    return is_inn(c) | is_ogrn(c) | is_kpp(c)


VALIDATORS = {"inn": is_inn, "kpp": is_kpp, "ogrn": is_ogrn}
