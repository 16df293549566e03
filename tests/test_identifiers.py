import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.functions import headers, identifiers

INNS = ["7707083893", "500100732259"]
OGRNS = ["1047709000008", "1027700132195", "304770900000126"]


def check(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(identifiers.candidate(F.col("v"), kind))).collect()]


def plain_inn(c):
    if c is None or not c.isascii() or not c.isdigit():
        return False
    digit = lambda w: sum(int(a) * b for a, b in zip(c, w, strict=False)) % 11 % 10
    if len(c) == 10:
        return digit(identifiers.WEIGHTS_10) == int(c[9])
    return len(c) == 12 and digit(identifiers.WEIGHTS_11) == int(c[10]) and digit(identifiers.WEIGHTS_12) == int(c[11])


def test_vectors(spark):
    assert check(spark, INNS + [" 7707083893　", "7707083893\n"], identifiers.is_inn) == [True] * 4
    assert check(spark, ["770708389", "77070838933", "1", "", "７707083893", None, "7707083894"], identifiers.is_inn) == [False] * 7
    assert check(spark, OGRNS, identifiers.is_ogrn) == [True] * 3
    assert check(spark, ["104770900000", "10477090000081", "1047709000009"], identifiers.is_ogrn) == [False] * 3
    assert check(spark, ["770701001", "7707AB001"], identifiers.is_kpp) == [True] * 2
    assert check(spark, ["77070100", "7707ab001", "7707АВ001", None], identifiers.is_kpp) == [False] * 4
    assert check(spark, INNS + OGRNS + ["770701001", None], identifiers.value_type) == ["inn"] * 2 + ["ogrn"] * 3 + ["unknown"] * 2


def test_kinds(spark):
    assert check(spark, [7707083893, 770701001], identifiers.is_inn, "bigint") == [True, False]
    assert check(spark, [770701001], identifiers.is_kpp, "bigint") == [True]
    assert check(spark, [7707083893.0], identifiers.is_inn, "double") == [False]
    assert check(spark, [True], identifiers.is_identifier_like, "boolean") == [False]


def test_strip_is_pythons(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert sorted(map(ord, spaces)) == sorted(identifiers.STRIP_CODES)
    values = [f"{s}x{s}" for s in spaces] + ["​x"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(identifiers.strip(F.col("v")), identifiers.is_blank(F.col("v"))).collect()
    assert [r[0] for r in rows] == [v.strip() for v in values]
    assert not any(r[1] for r in rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789７", min_size=8, max_size=14), min_size=20, max_size=60))
def test_inn_against_plain_python(spark, values):
    assert check(spark, values, identifiers.is_inn) == [plain_inn(v) for v in values]


@pytest.mark.parametrize(("header", "kind"), [("  Компания ", "company"), ("ИНН   контрагента", "inn"), ("E-MAIL", "email"), ("ИНН2", "unknown"), (None, "unknown"), (5, "unknown"), ("й", "unknown")])
def test_headers(header, kind):
    assert headers.column_type(header) == kind


def test_header_dictionary():
    assert sum(map(len, headers.HEADERS.values())) == 41
    assert all(headers.normalize_header(h) == h for hs in headers.HEADERS.values() for h in hs)
