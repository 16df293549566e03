"""Every query of the engine against its SQL."""

import decimal
import math

import duckdb
import pytest

from cloakframe.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else round(float(v), 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(SQL[name])
    assert got == rows([c[0] for c in result.description], result.fetchall())


def test_map_lookups_whatever_rows_a_limit_takes(spark, duck, sf_dir, monkeypatch):
    frame, calls = type(spark.range(0)), []
    limit = frame.limit

    def other_end(self, n):  # on a cluster a limit over several files takes any rows
        calls.append(n)
        ends = [c.desc() if len(calls) % 2 else c.asc() for c in map(self.__getitem__, self.columns)]
        return limit(self.orderBy(*ends), n)

    monkeypatch.setattr(frame, "limit", other_end)
    monkeypatch.setattr(frame, "take", lambda self, n: limit(self, n).collect())
    got = [tuple(r) for r in QUERIES["map_lookups"](spark, sf_dir).collect()]
    assert got == duck.execute(SQL["map_lookups"]).fetchall()


def test_the_engine_stands_alone():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "cloakframe"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p
