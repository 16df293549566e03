import pytest
from pyspark.sql import functions as F

from cloakframe.operators import guards, keys, maps, restore
from cloakframe.operators.anonymize import Sheet, anonymize, check_rules
from cloakframe.sources import tables
from cloakframe.sources.tables import place, positional, to_cells
from cloakframe.types import (
    Action,
    AmbiguousMappingError,
    AmbiguousRestoreError,
    EntityValueError,
    FieldRule,
    FieldType,
    FormulaError,
    IdentifierValueError,
    KeySpaceExhaustedError,
    MapConflictError,
    MissingIdentifierMapError,
    ProvenanceConflictError,
    RestoreValidationError,
    RuleConfigurationError,
    UnresolvedRestoreError,
    UnsupportedTargetError,
)


def rule(kind, action):
    return FieldRule("x", FieldType(kind), Action(action))


def sheet(spark, rows, schema, rules, name="s"):
    return Sheet(name, spark.createDataFrame(rows, schema), rules)


def entities(spark):
    return maps.empty(spark, maps.ENTITY_MAP)


def tokens(spark):
    return maps.empty(spark, maps.IDENTIFIER_MAP)


def run(spark, *sheets, **more):
    return anonymize(list(sheets), entities(spark), "job", tokens(spark), **more)


def test_values_are_exact(spark):
    values = ["ООО Ромашка", "ООО  Ромашка", " ООО Ромашка", "ооо ромашка", "É", "É", None, " 　", "ООО Ромашка"]
    s = sheet(spark, [(i + 2, v) for i, v in enumerate(values)], "row long, c0001 string", {1: rule("company", "pseudonymize")})
    done = run(spark, s)
    got = [r[1] for r in done.sheets["s"].orderBy("row").collect()]
    assert got[6:8] == [None, " 　"]
    assert got[0] == got[8] and len({*got[:6]}) == 6
    assert all(a.startswith("C_") and len(a) == 11 for a in got[:6])
    assert [r.real_value for r in done.entity_map.orderBy("seq").collect()] == values[:6]


def test_actions(spark):
    s = sheet(spark, [(2, "a", 5, "=x"), (3, "b", None, None)], "row long, c0001 string, c0002 int, c0003 string", {1: rule("branch", "keep"), 2: rule("financial", "keep"), 3: rule("unknown", "remove")})
    assert run(spark, s).sheets["s"].orderBy("row").collect() == [(2, "a", 5, None), (3, "b", None, None)]


@pytest.mark.parametrize(
    ("rows", "schema", "kind", "error", "row"),
    [
        ([(2, "ok"), (3, "=A1")], "row long, c0001 string", "company", FormulaError, 3),
        ([(2, 42)], "row long, c0001 long", "company", EntityValueError, 2),
        ([(2, "7707083893"), (4, "7707083894"), (3, "1")], "row long, c0001 string", "inn", IdentifierValueError, 3),
        ([(2, 770107391)], "row long, c0001 long", "inn", IdentifierValueError, 2),
        ([(2, 7707083893.0)], "row long, c0001 double", "inn", IdentifierValueError, 2),
    ],
)
def test_guards(spark, rows, schema, kind, error, row):
    with pytest.raises(error) as e:
        run(spark, sheet(spark, rows, schema, {1: rule(kind, "pseudonymize")}))
    assert e.value.where["row"] == row
    assert not any(str(v) in str(e.value) for _, v in rows if isinstance(v, str) and len(v) > 3)


def test_rules(spark):
    s = sheet(spark, [(2, "a")], "row long, c0001 string", {2: rule("company", "keep")})
    with pytest.raises(RuleConfigurationError):
        check_rules(s)
    with pytest.raises(RuleConfigurationError):
        check_rules(Sheet("s", s.table, {True: rule("company", "keep")}))
    with pytest.raises(UnsupportedTargetError):
        check_rules(Sheet("s", s.table, {1: rule("phone", "pseudonymize")}))
    with pytest.raises(MissingIdentifierMapError):
        anonymize([sheet(spark, [(2, "7707083893")], "row long, c0001 string", {1: rule("inn", "pseudonymize")})], entities(spark), "job")


def test_same_digits_of_two_types_differ(spark):
    s = sheet(spark, [(2, "7707083893", "7707083893")], "row long, c0001 string, c0002 string", {1: rule("inn", "pseudonymize"), 2: rule("inn", "pseudonymize")})
    a = run(spark, s).sheets["s"].first()
    assert a[1] == a[2]
    t = sheet(spark, [(2, "999999999")], "row long, c0001 string", {1: rule("kpp", "pseudonymize")})
    assert run(spark, t).sheets["s"].first()[1].startswith("KPP_")


def test_coordinate_restore(spark):
    s = sheet(spark, [(2, "Иванов", 7707083893, "7707AB001"), (3, None, None, " ")], "row long, c0001 string, c0002 long, c0003 string", {1: rule("person", "pseudonymize"), 2: rule("inn", "pseudonymize"), 3: rule("kpp", "pseudonymize")})
    done = run(spark, s)
    assert sorted((r.row, r.column, r.representation) for r in done.provenance.collect()) == [(2, 2, "integer"), (2, 3, "string")]
    cells = to_cells(done.sheets["s"], ["ФИО", "ИНН", "КПП"], sheet_name="s")
    back = {(r.row, r.column): (r.kind, r.s, r.i) for r in restore.restore(cells, done.provenance, done.entity_map, done.identifier_map).collect()}
    assert back[2, 1] == ("str", "Иванов", None) and back[2, 2][0] == "int" and int(back[2, 2][2]) == 7707083893 and back[2, 3][1] == "7707AB001"
    with pytest.raises(UnresolvedRestoreError):
        restore.restore(cells.withColumn("s", F.when(F.col("column") == 3, "KPP_000000000").otherwise(F.col("s"))), done.provenance, done.entity_map, done.identifier_map)
    with pytest.raises(RestoreValidationError):
        restore.restore(cells, done.provenance, done.entity_map, None)
    with pytest.raises(RestoreValidationError):
        restore.check_binding(spark.createDataFrame([("other",)], "job_id string"), done.provenance)
    assert restore.check_binding(spark.createDataFrame([("job",)], "job_id string"), done.provenance) == "job"


def test_analytical_restore(spark):
    e = spark.createDataFrame([(1, "C_AAAAAAAAA", "ООО", "company", None)], maps.ENTITY_MAP)
    i = spark.createDataFrame([(1, "INN_AAAAAAAAA", "7707083893", "inn")], maps.IDENTIFIER_MAP)
    t = spark.createDataFrame([("C_AAAAAAAAA", " C_AAAAAAAAA", 1), ("INN_AAAAAAAAA", " ", 2), ("=C_AAAAAAAAA", None, 3)], "a string, b string, n int")
    assert restore.restore_analytical(t, e, i).orderBy("n").collect() == [("ООО", " C_AAAAAAAAA", 1), ("7707083893", " ", 2), ("=C_AAAAAAAAA", None, 3)]
    assert restore.count_restored(t, e, i).first() == (1, 1)
    with pytest.raises(AmbiguousRestoreError):
        restore.restore_analytical(t, e, i.withColumn("token", F.lit("C_AAAAAAAAA")))


def test_map_constraints(spark):
    e = spark.createDataFrame([(1, "C_1", "a", "company", None)], maps.ENTITY_MAP)
    add = lambda *rows: spark.createDataFrame(rows, "alias string, real_value string, entity_type string, parent_alias string")
    assert maps.append(e, add(("C_1", "a", "company", None)), "entity").count() == 1
    assert [r.seq for r in maps.append(e, add(("C_3", "c", "company", None), ("C_2", "a", "person", None)), "entity").orderBy("seq").collect()] == [1, 2, 3]
    for bad in (("C_1", "b", "company", None), ("C_9", "a", "company", None)):
        with pytest.raises(MapConflictError):
            maps.append(e, add(bad), "entity")
    p = maps.empty(spark, maps.PROVENANCE)
    rows = spark.createDataFrame([("j", "s", 1, 1, "T", "string"), ("j", "s", 1, 1, "U", "string")], maps.PROVENANCE)
    with pytest.raises(ProvenanceConflictError):
        maps.append(p, rows, "provenance")
    two = spark.createDataFrame([(1, "C_1", "a", "company", None), (2, "P_1", "a", "person", None)], maps.ENTITY_MAP)
    assert maps.lookup_alias(two, "a", "person") == "P_1" and maps.lookup_alias(two, "z") is None
    with pytest.raises(AmbiguousMappingError):
        maps.lookup_alias(two, "a")


def test_lookups(spark):
    i = spark.createDataFrame([(1, "INN_1", "7707083893", "inn")], maps.IDENTIFIER_MAP)
    assert maps.lookup_token(i, "inn", "7707083893") == "INN_1" and maps.lookup_token(i, "kpp", "7707083893") is None
    assert maps.contains(i, "token", "INN_1") and not maps.contains(i, "token", "INN_2") and maps.cleared(i).count() == 0
    p = spark.createDataFrame([("j", "s", 3, 1, "INN_1", "string"), ("j", "s", 2, 1, "INN_1", "string")], maps.PROVENANCE)
    assert [r.row for r in maps.ordered(p).collect()] == [2, 3] and maps.at_coordinate(p, "s", 3, 1).first().token == "INN_1"


def test_digest(spark):
    e = spark.createDataFrame([(1, "C_AAAAAAAAA", "x", "company", None), (2, "C_BBBBBBBBB", "y", "company", None)], maps.ENTITY_MAP)
    import hashlib

    item = lambda k: len(k).to_bytes(8, "big") + k
    ranges = [hashlib.sha256(item(b"C_AAAAAAAAA") + item(b"C_BBBBBBBBB")).digest()]
    assert maps.prefix_digest(e, "alias", b"d") == hashlib.sha256(maps.digest_header(b"d", 2) + b"".join(ranges)).hexdigest()
    maps.RANGE, ranges = 1, [hashlib.sha256(item(k)).digest() for k in (b"C_AAAAAAAAA", b"C_BBBBBBBBB")]
    try:
        assert maps.prefix_digest(e, "alias", b"d") == hashlib.sha256(maps.digest_header(b"d", 2) + b"".join(ranges)).hexdigest()
    finally:
        maps.RANGE = 1 << 16
    assert maps.prefix_digest(e, "alias", b"d", 1) != maps.prefix_digest(e, "alias", b"d")


def test_colliding_keys_are_made_again(spark):
    new = spark.createDataFrame([("a",), ("b",)], "value string")
    calls = iter([F.lit("C_1"), F.concat(F.lit("C_"), F.col("value"))])
    got = keys.with_keys(new, spark.createDataFrame([("C_0",)], "key string"), F.lit("C"), "key", make=lambda p: next(calls)).collect()
    assert sorted(r.key for r in got) == ["C_1", "C_b"]
    with pytest.raises(KeySpaceExhaustedError):
        keys.with_keys(new, spark.createDataFrame([("C_1",)], "key string"), F.lit("C"), "key", make=lambda p: F.lit("C_1"), attempts=3)


def test_positional_and_first_violation(spark):
    t, heads = positional(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "x string, `y.z` int"))
    assert heads == ["x", "y.z"] and t.columns == ["row", place(1), place(2)]
    assert [r.row for r in t.orderBy(place(2)).collect()] == [2, 3, 4]
    v = guards.violations(t, {1: rule("inn", "pseudonymize"), 2: rule("company", "pseudonymize")})
    assert guards.first_violation(v).first() == (2, 1, "invalid")


def test_many_keys_are_joined_once(spark, monkeypatch):
    rows = [(i, f"v{i % 5}" if i % 4 else None, f"v{i % 3}", "7707083893" if i % 2 else " ") for i in range(2, 30)]
    rules = {1: rule("company", "pseudonymize"), 2: rule("person", "pseudonymize"), 3: rule("inn", "pseudonymize")}
    s = sheet(spark, rows, "row long, c0001 string, c0002 string, c0003 string", rules)
    few = run(spark, s)
    from cloakframe.operators.anonymize import project

    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    many = project(s, few.entity_map, few.identifier_map)
    assert sorted(many.collect()) == sorted(few.sheets["s"].collect())


def test_scratch_is_sealed(spark, tmp_path, monkeypatch):
    import pathlib

    monkeypatch.setattr(tables, "scratch", lambda _: f"file://{tmp_path}")
    done = run(spark, sheet(spark, [(2, "OriginalCompany", "7707083893"), (3, None, None)], "row long, c0001 string, c0002 string", {1: rule("company", "pseudonymize"), 2: rule("inn", "pseudonymize")}))
    assert sorted(r[0] for r in done.entity_map.select("real_value").collect()) == ["OriginalCompany"] and done.provenance.count() == 1
    files = [p for p in pathlib.Path(tmp_path).rglob("*") if p.is_file()]
    content = b"".join(p.read_bytes() for p in files)
    keys = [done.entity_map.first()["alias"], done.identifier_map.first()["token"]]
    assert files and not any(x.encode() in content for x in ("OriginalCompany", "7707083893", *keys))
    assert "OriginalCompany" not in done.entity_map._jdf.queryExecution().toString()
