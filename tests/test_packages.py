import os
from datetime import datetime

import pytest

from cloakframe.operators import grammar, inspect, maps, scrub
from cloakframe.plans import jobs
from cloakframe.sources import container, manifest
from cloakframe.sources.xlsx import JOB_ID, Package, XlsxSource, new_package, publish, published, reference, split_reference, with_property, with_values
from cloakframe.types import Action, ColumnSafetyError, CryptoError, FieldRule, FieldType, IdentifierValueError, JobValidationError, PackageError, RestoreValidationError, WorkspaceError, WriterValidationError


def rule(name, kind, action):
    return FieldRule(name, FieldType(kind), Action(action))


ROWS = [["Компания", "ИНН", "Выручка"], ["ООО Ромашка", "7707083893", 10], ["ООО Лютик", "500100732259", 20], ["ООО Ромашка", None, 5]]
RULES = {"Data": {1: rule("Компания", "company", "pseudonymize"), 2: rule("ИНН", "inn", "pseudonymize"), 3: rule("Выручка", "financial", "keep")}}


def values(package, title="Data"):
    return {(c["row"], c["column"]): c["s"] if c["s"] is not None else c["i"] if c["i"] is not None else c["d"] for c in package.cells() if c["sheet_name"] == title}


def load(path):
    with open(path, "rb") as f:
        return Package.load(f.read())


def test_references():
    assert split_reference("AB12") == (12, 28) and reference(12, 28) == "AB12"
    with pytest.raises(PackageError):
        split_reference("1A")


def test_cells_keep_their_kinds():
    p = new_package({"S & <x>": [["a", 1, 2.5, True, None, "=A1", datetime(2024, 2, 1)]]})
    assert [c["kind"] for c in p.cells()] == ["str", "int", "float", "bool", "formula", "float"]
    assert p.sheets[0].title == "S & <x>"


def test_values_are_overwritten_in_a_copy():
    p = new_package({"Data": ROWS})
    q = with_values(p, {"Data": {(2, 1): "C_1", (2, 2): None}})
    assert values(q)[2, 1] == "C_1" and values(q)[2, 2] is None and values(p)[2, 1] == "ООО Ромашка"
    for bad in ({"Nope": {}}, {"Data": {(99, 1): "x"}}):
        with pytest.raises(WriterValidationError):
            with_values(p, bad)


def test_publish(tmp_path):
    at = str(tmp_path / "a.xlsx")
    publish(b"1", at)
    publish(b"2", at)
    with pytest.raises(WriterValidationError):
        publish(b"3", at, replace=False)
    assert open(at, "rb").read() == b"2" and os.listdir(tmp_path) == ["a.xlsx"]


def test_anonymize_and_restore_workbooks(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in ("a.xlsx", "b.xlsx", "c.xlsx"))
    publish(new_package({"Data": ROWS, "Notes": [["ООО Ромашка"]]}).save(), a)
    e, i = maps.empty(spark, maps.ENTITY_MAP), maps.empty(spark, maps.IDENTIFIER_MAP)
    done = jobs.anonymize_workbook(spark, a, b, RULES, e, identifier_map=i, policies=None)
    out = values(load(b))
    assert out[2, 1] == out[4, 1] != out[3, 1] and out[2, 2].startswith("INN_") and int(out[2, 3]) == 10 and out[1, 1] == "Компания"
    assert load(b).job_id() == done.job_ids[0]
    assert jobs.restore_workbook(spark, b, c, done.provenance, done.entity_map, done.identifier_map) == 5
    assert values(load(c)) == values(load(a))
    with pytest.raises(JobValidationError):
        jobs.restore_workbook(spark, b, c, done.provenance, done.entity_map, done.identifier_map)
    d, f = str(tmp_path / "d.xlsx"), str(tmp_path / "f.xlsx")
    publish(new_package({"Sum": [["who", "n"], [out[2, 1], 15], [f"x {out[2, 1]}", 1]]}).save(), d)
    assert jobs.restore_analytical_workbook(spark, d, f, done.entity_map, done.identifier_map) == 1
    assert values(load(f), "Sum")[2, 1] == "ООО Ромашка"
    with pytest.raises(RestoreValidationError):
        jobs.restore_analytical_workbook(spark, f, str(tmp_path / "g.xlsx"), done.entity_map)
    with pytest.raises(JobValidationError):
        jobs.anonymize_workbooks(spark, [jobs.Item(a, a, RULES)], e)


def test_columns_of_mixed_cells(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in ("a.xlsx", "b.xlsx", "c.xlsx"))
    rows = [["ИНН", "Сумма"], ["7707083893", 1], [500100732259, "x"], [None, 2.5], [" ", None], [7707083893, True]]
    publish(new_package({"Data": rows}).save(), a)
    e, i = maps.empty(spark, maps.ENTITY_MAP), maps.empty(spark, maps.IDENTIFIER_MAP)
    rules = {"Data": {1: rule("ИНН", "inn", "pseudonymize"), 2: rule("Сумма", "financial", "keep")}}
    done = jobs.anonymize_workbook(spark, a, b, rules, e, identifier_map=i)
    assert done.identifier_map.count() == 2 and sorted((r.row, r.representation) for r in done.provenance.collect()) == [(2, "string"), (3, "integer"), (6, "integer")]
    jobs.restore_workbook(spark, b, c, done.provenance, done.entity_map, done.identifier_map)
    kinds = lambda p: [(x["row"], x["column"], x["kind"], x["s"], x["i"], x["d"], x["b"]) for x in load(p).cells() if x["kind"] != "null"]
    assert kinds(c) == kinds(a)
    publish(new_package({"Data": [["ИНН", "Сумма"], ["7707083893", 1], [2.5, 1]]}).save(), str(tmp_path / "d.xlsx"))
    with pytest.raises(IdentifierValueError):
        jobs.anonymize_workbook(spark, str(tmp_path / "d.xlsx"), b, rules, e, identifier_map=i)


def test_gate_before_a_job(spark, tmp_path):
    a = str(tmp_path / "a.xlsx")
    publish(new_package({"Data": [*ROWS, ["x", None, 770701001]], "Notes": [["n"]]}).save(), a)
    e, i = maps.empty(spark, maps.ENTITY_MAP), maps.empty(spark, maps.IDENTIFIER_MAP)
    with pytest.raises(ColumnSafetyError):
        jobs.anonymize_workbook(spark, a, str(tmp_path / "b.xlsx"), RULES, e, identifier_map=i, policies={"Data": "process", "Notes": "remove_all"})


def test_xlsx_format(spark, tmp_path):
    publish(new_package({"Data": ROWS}).save(), str(tmp_path / "a.xlsx"))
    spark.dataSource.register(XlsxSource)
    assert spark.read.format("xlsx").load(str(tmp_path)).where("row > 1").count() == 8
    assert spark.read.format("xlsx").option("table", "sheets").load(str(tmp_path)).first()["max_column"] == 3


def test_container(spark):
    cost = (1 << 14, 8, 1)
    sealed = container.encrypt_bytes(spark, b"secret", "long enough", cost)
    assert container.decrypt_bytes(spark, sealed, "long enough") == b"secret" and b"secret" not in sealed
    for bad in (sealed[:-1] + bytes([sealed[-1] ^ 1]), sealed[:20] + bytes([sealed[20] ^ 1]) + sealed[21:], sealed[:30]):
        with pytest.raises(CryptoError):
            container.decrypt_bytes(spark, bad, "long enough")
    with pytest.raises(CryptoError):
        container.decrypt_bytes(spark, sealed, "wrong password")
    with pytest.raises(CryptoError):
        container.encrypt_bytes(spark, b"x", "short", cost)
    with pytest.raises(CryptoError):
        container.encrypt_bytes(spark, b"x", "long enough", (1000, 8, 1))


def test_map_files(spark, tmp_path):
    m = spark.createDataFrame([(1, "C_1", "ООО", "company", None)], maps.ENTITY_MAP)
    container.write_map(m, str(tmp_path / "m"), "long enough", "entity", cost=(1 << 14, 8, 1))
    assert container.read_map(spark, str(tmp_path / "m"), "long enough", "entity").collect() == m.collect()
    with pytest.raises(CryptoError):
        container.read_map(spark, str(tmp_path / "m"), "long enough", "identifier")


def test_manifest_is_strict():
    m = manifest.Manifest("w", mapping=manifest.StoreState(2, "d"))
    good = manifest.serialize(m)
    assert manifest.parse(good) == m
    for bad in (good.replace(b'"revision":0', b'"revision":0,"revision":1'), good.replace(b'"revision":0', b'"revision":NaN'), good.replace(b'"version":1', b'"version":true'), good[:-1] + b',"more":1}', b"{"):
        with pytest.raises(WorkspaceError):
            manifest.parse(bad)


def test_scrub(spark):
    p = with_property(new_package({"Data": ROWS, "Hidden": [["=1+1"]]}, {"Hidden": "hidden"}), JOB_ID, "j")
    scrub.preflight(p.save())
    roles = scrub.inventory(p).counts()
    assert roles["worksheet"] == 2 and roles["custom-properties"] == 1
    e = spark.createDataFrame([(1, "C_1", "ООО Ромашка", "company", None)], maps.ENTITY_MAP)
    counts = {r.kind: r.n for r in inspect.counts(scrub.findings_of(spark, p, e)).collect()}
    assert counts == {"known_entity_value": 2, "formula": 1, "hidden_worksheet": 1}
    with pytest.raises(PackageError) as x, scrub.external_candidate(spark, p.save(), e):
        pass
    assert x.value.reason == "known_entity_value_present"
    with scrub.external_candidate(spark, p.save()) as (path, digest):
        clean = load(path)
        assert len(digest) == 64 and values(clean) == values(p) and not list(clean.properties())
    assert not os.path.exists(path)
    assert scrub.post_problems(p.save()) == ["parts", "relationships"]


@pytest.mark.parametrize("limit", ["file_bytes", "entries", "bytes", "sheets", "cells"])
def test_limits(limit):
    with pytest.raises(PackageError) as e:
        scrub.preflight(new_package({"Data": ROWS}).save(), {**scrub.LIMITS, limit: 0})
    assert e.value.reason == "resource_limit_exceeded"


def test_orphan_parts_are_refused():
    p = new_package({"Data": ROWS})
    p.parts["xl/extra.xml"] = b"<a/>"
    with pytest.raises(PackageError):
        scrub.inventory(p)


def test_published_workbooks_hold_no_originals(spark, tmp_path):
    a, b = str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")
    p = published(new_package({"Data": [*ROWS, ["ООО Сирень", "7707083893", "=A2"]], "Notes": [["ООО Ромашка", "TOPSECRET"]]}))
    assert "ООО Ромашка".encode() in p.parts["xl/sharedStrings.xml"]  # as other programs write texts
    p.parts["xl/worksheets/sheet1.xml"] = p.parts["xl/worksheets/sheet1.xml"].replace(b"</f></c>", "</f><v>ООО Ромашка</v></c>".encode())
    p.parts["docProps/core.xml"] = "<x>ООО Лютик</x>".encode()
    publish(p.save(), a)
    e, i = maps.empty(spark, maps.ENTITY_MAP), maps.empty(spark, maps.IDENTIFIER_MAP)
    jobs.anonymize_workbook(spark, a, b, RULES, e, identifier_map=i)
    out = b"".join(load(b).parts.values())
    assert [s.title for s in load(b).sheets] == ["Data", "Notes"] and b"TOPSECRET" in out  # without policies other sheets stay
    assert b"7707083893" not in out and "ООО Лютик".encode() not in out and "ООО Сирень".encode() not in out
    assert all("ООО Ромашка".encode() not in d for n, d in load(b).parts.items() if n != "xl/sharedStrings.xml")  # Notes has it
    publish(published(p, drop={"Notes"}).save(), a)
    rows = {"Data": [*ROWS], "Notes": [["ООО Ромашка", "TOPSECRET"]]}
    publish(published(new_package(rows)).save(), a)
    jobs.anonymize_workbook(spark, a, b, RULES, e, identifier_map=i, policies={"Data": "process", "Notes": "remove_all"})
    out = b"".join(load(b).parts.values())
    assert [s.title for s in load(b).sheets] == ["Data"]
    assert not any(x.encode() in out for x in ("ООО Ромашка", "ООО Лютик", "7707083893", "500100732259", "TOPSECRET", "Notes"))
    assert values(load(b))[2, 3] == 10


def test_grammar_takes_what_scrub_gives(spark):
    p = new_package({"Data": ROWS, "More": [["=1+1", None, 2.5, True]]}, {"More": "hidden"})
    assert grammar.problems(grammar.nodes_of(spark, scrub.scrub(p).parts)).collect() == []
    p.parts["xl/worksheets/sheet1.xml"] = p.parts["xl/worksheets/sheet1.xml"].replace(b"<sheetData>", b"<sheetPr/><sheetData>")
    assert [r.element for r in grammar.problems(grammar.nodes_of(spark, p.parts)).collect()] == ["sheetPr"]
