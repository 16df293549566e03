import os
import subprocess
import sys

import pytest

from cloakframe.operators import inspect, maps, registry
from cloakframe.operators.workspace import Workspace, leftover, locked
from cloakframe.sources.xlsx import new_package, publish
from cloakframe.types import WorkspaceError


def entries(spark, *values):
    return spark.createDataFrame([(i, f"C_{i:09d}", v, "company", None) for i, v in enumerate(values, 1)], maps.ENTITY_MAP)


@pytest.fixture
def ws(spark, tmp_path):
    return Workspace.create(spark, str(tmp_path / "ws"), "long enough")


def test_mutation_and_recovery(spark, ws):
    with ws.mutation() as s:
        s.mapping = entries(spark, "a")
    with pytest.raises(RuntimeError), ws.mutation():
        raise RuntimeError
    with pytest.raises(WorkspaceError) as e, ws.mutation():
        pass
    assert e.value.reason == "mutation_pending"
    ws._write("mapping", entries(spark, "a", "b"), 50)  # what a broken-off job may leave
    assert ws.diagnose()["mapping"] == "ahead"
    assert ws.recover().mapping.entry_count == 2
    ws._write("mapping", entries(spark, "a", "b").replace("C_000000001", "C_999999999"), 60)
    assert ws.diagnose()["mapping"] == "store_diverged"


def test_wrong_password(spark, ws):
    from cloakframe.types import CryptoError

    with pytest.raises(CryptoError):
        Workspace.open(spark, ws.folder, "something else")


def test_lock(ws):
    with locked(ws.folder):
        with pytest.raises(WorkspaceError), locked(ws.folder):
            pass
        code = f"import sys; sys.path.insert(0, {os.getcwd()!r}); from cloakframe.operators.workspace import locked\nwith locked({ws.folder!r}): pass"
        assert b"lock_held" in subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).stderr


def test_artifacts(spark, ws):
    none = spark.createDataFrame([], inspect.FINDINGS)
    ids = []
    for n, (kind, parents) in enumerate((("anonymized_monthly", 0), ("analytical_canonical", 1), ("local_restored", 1))):
        i, path = ws.allocate()
        publish(new_package({"S": [[n]]}).save(), path)
        ws.register(i, kind, "2024-07", tuple(ids[-parents:]) if parents else (), findings=none)
        ids.append(i)
    i, path = ws.allocate()
    publish(new_package({"S": [[99]]}).save(), path)
    with pytest.raises(WorkspaceError) as e:
        ws.register(i, "anonymized_monthly", "2024-07", (ids[0],), findings=none)
    assert e.value.reason == "invalid_lineage"
    with pytest.raises(WorkspaceError) as e:
        ws.register(i, "anonymized_monthly", "2024-07")
    assert e.value.reason == "evidence"
    ws.set_latest(ids[1])
    assert ws.latest().artifact_id == ids[1]
    with pytest.raises(WorkspaceError):
        ws.set_latest(ids[0])
    assert ws.verify() == {"n_registered": 3, "n_verified": 3, "n_missing": 0, "n_mismatched": 0, "n_orphans": 1, "n_leftovers": 0}
    publish(b"changed", ws.artifact_path(ids[0]))
    with pytest.raises(WorkspaceError):
        ws.verified_path(ids[0])
    assert [r.artifact_id for r in registry.listing(ws.artifacts(), "local_restored").collect()] == [ids[2]]


def test_staging(spark, ws, tmp_path):
    publish(b"x", str(tmp_path / "a.xlsx"))
    i, path = ws.stage(str(tmp_path / "a.xlsx"))
    assert open(path, "rb").read() == b"x" and i in path and ws.allocate_provenance()[1].endswith(".bin")
    with ws.stores() as s:
        assert s.mapping.count() == 0


def test_backups(spark, ws):
    names = [ws.snapshot(keep_last=2) for _ in range(3)]
    left = [r.name for r in ws.backups().collect()]
    assert len(left) == 2 and set(left) <= set(names)
    assert set(ws.verify_backup(left[0]).values()) == {"consistent"}
    with pytest.raises(WorkspaceError):
        ws.verify_backup("../x")
    assert leftover(".manifest.bin.abc.tmp") and not leftover("manifest.bin")


def test_adoption(spark, tmp_path):
    ws = Workspace.adopt(spark, str(tmp_path / "w"), "long enough", entries(spark, "a", "b"), maps.empty(spark, maps.IDENTIFIER_MAP))
    assert ws.manifest().mapping.entry_count == 2
