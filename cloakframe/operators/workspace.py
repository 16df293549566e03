"""The workspace: identity maps with a manifest that commits to them, artifacts with lineage, and backups.

Maps are parquet tables with sealed strings, one folder for each version; their key is in the
encrypted manifest, which names the version by its counts and digests. A mutation
sets the pending flag, appends, proves that the old map is a prefix of the new one, and clears the flag.
"""

from __future__ import annotations

import fcntl
import os
import re
import secrets
import shutil
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from ..sources import manifest as mf
from ..sources.manifest import Artifact, Manifest, StoreState
from ..sources.sealed import seal, sealed_schema, unseal
from ..sources.xlsx import publish
from ..types import WorkspaceError
from . import maps, registry

DOMAINS = {"mapping": b"cloakframe/StoreDigest/v1/mapping", "identifier": b"cloakframe/StoreDigest/v1/identifier"}
KEYS = {"mapping": "alias", "identifier": "token"}
SCHEMAS = {"mapping": maps.ENTITY_MAP, "identifier": maps.IDENTIFIER_MAP}
_held: set[str] = set()


@contextmanager
def locked(folder: str):
    """Exclusive use of a workspace, at once or not at all, also within one process."""
    path = os.path.realpath(f"{folder}/.lock")
    if path in _held:
        raise WorkspaceError("lock_nested")
    with open(path, "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise WorkspaceError("lock_held") from None
        _held.add(path)
        try:
            yield
        finally:
            _held.discard(path)
            fcntl.flock(f, fcntl.LOCK_UN)


@dataclass
class Stores:
    """The maps inside a mutation: extended by assignment, never cleared."""

    mapping: DataFrame
    identifier: DataFrame


class Workspace:
    """A folder on a file system that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, password: str):
        self.spark, self.folder, self.password = spark, folder.rstrip("/"), password
        self._key: bytes | None = None

    def _store_key(self) -> bytes:
        """The key of the stores, from the encrypted manifest."""
        if self._key is None:
            self._key = bytes.fromhex(self.manifest().store_key)
        return self._key

    @classmethod
    def create(cls, spark: SparkSession, folder: str, password: str) -> Workspace:
        if len(password) < 8:
            raise WorkspaceError("password_too_short")
        if os.path.exists(f"{folder}/manifest.bin"):
            raise WorkspaceError("already_exists")
        for d in ("stores", "artifacts", "provenance", "backups"):
            os.makedirs(f"{folder}/{d}", exist_ok=True)
        ws = cls(spark, folder, password)
        ws._key, states = secrets.token_bytes(32), {}
        for name in KEYS:
            ws._write(name, maps.empty(spark, SCHEMAS[name]), 0)
            states[name] = StoreState(0, maps.prefix_digest(maps.empty(spark, SCHEMAS[name]), KEYS[name], DOMAINS[name]))
        ws._save(Manifest(secrets.token_hex(16), **states, store_key=ws._key.hex()))
        return ws

    @classmethod
    def open(cls, spark: SparkSession, folder: str, password: str) -> Workspace:
        ws = cls(spark, folder, password)
        ws.manifest()
        return ws

    @classmethod
    def adopt(cls, spark: SparkSession, folder: str, password: str, entity_map: DataFrame, identifier_map: DataFrame) -> Workspace:
        """A new workspace over existing maps, read again and checked before it counts."""
        ws = cls.create(spark, folder, password)
        with ws.mutation() as s:
            s.mapping, s.identifier = entity_map, identifier_map
        if set(ws.diagnose().values()) != {"consistent"}:
            raise WorkspaceError("adoption_failed")
        return ws

    def manifest(self) -> Manifest:
        path = f"{self.folder}/manifest.bin"
        if not os.path.exists(path):
            raise WorkspaceError("not_a_workspace")
        return mf.load(self.spark, path, self.password)

    def _save(self, m: Manifest) -> None:
        mf.save(self.spark, m, f"{self.folder}/manifest.bin", self.password)

    def _write(self, name: str, df: DataFrame, version: int) -> None:
        seal(df, self._store_key()).write.mode("overwrite").parquet(f"file://{os.path.abspath(self.folder)}/stores/{name}-{version:08d}")

    def _versions(self, name: str) -> list[int]:
        return sorted(int(m[1]) for d in os.listdir(f"{self.folder}/stores") if (m := re.fullmatch(rf"{name}-([0-9]{{8}})", d)) and os.path.exists(f"{self.folder}/stores/{d}/_SUCCESS"))

    def read(self, name: str) -> DataFrame:
        """The newest whole version of a map."""
        versions = self._versions(name)
        if not versions:
            raise WorkspaceError("store_missing")
        schema = maps.empty(self.spark, SCHEMAS[name]).schema
        stored = self.spark.read.schema(sealed_schema(schema)).parquet(f"file://{os.path.abspath(self.folder)}/stores/{name}-{versions[-1]:08d}")
        return unseal(stored, schema, self._store_key())

    def state_of(self, name: str, df: DataFrame | None = None) -> StoreState:
        df = self.read(name) if df is None else df
        return StoreState(df.count(), maps.prefix_digest(df, KEYS[name], DOMAINS[name]))

    def diagnose(self) -> dict[str, str]:
        """How each map stands to the manifest."""
        m = self.manifest()
        rows = []
        for name in KEYS:
            s, present = getattr(m, name), bool(self._versions(name))
            df = self.read(name) if present else maps.empty(self.spark, SCHEMAS[name])
            n = df.count()
            equal = n >= s.entry_count and maps.prefix_digest(df, KEYS[name], DOMAINS[name], s.entry_count) == s.prefix_digest
            rows.append((name, s.entry_count, present, n, equal, m.pending))
        stores = self.spark.createDataFrame(rows, "name string, entry_count long, present boolean, actual_count long, prefix_equal boolean, pending boolean")
        return {r["name"]: r["state"] for r in registry.sync_state(stores).collect()}

    def _require_append_only(self, name: str, old: StoreState, df: DataFrame) -> None:
        if df.count() < old.entry_count or maps.prefix_digest(df, KEYS[name], DOMAINS[name], old.entry_count) != old.prefix_digest:
            raise WorkspaceError("append_only_violation")

    @contextmanager
    def mutation(self):
        """The maps, to be extended; an error inside leaves the pending flag set, for ``recover``."""
        with locked(self.folder):
            m = self.manifest()
            if m.pending:
                raise WorkspaceError("mutation_pending")
            bad = {s for s in self.diagnose().values()} - {"consistent"}
            if bad:
                raise WorkspaceError(sorted(bad)[0])
            m = m.next(pending=True)
            self._save(m)
            stores = Stores(self.read("mapping"), self.read("identifier"))
            yield stores
            states = {}
            for name in KEYS:
                df = getattr(stores, name)
                self._require_append_only(name, getattr(m, name), df)
                if df.count() != getattr(m, name).entry_count:  # nothing new, nothing written
                    self._write(name, df, m.revision)
                states[name] = self.state_of(name)
            self._save(m.next(pending=False, **states))

    def recover(self) -> Manifest:
        """Take over what a broken-off mutation has appended beyond the committed prefix."""
        with locked(self.folder):
            m = self.manifest()
            if not m.pending:
                raise WorkspaceError("nothing_to_recover")
            bad = set(self.diagnose().values()) - {"consistent", "ahead"}
            if bad:
                raise WorkspaceError(sorted(bad)[0])
            m = m.next(pending=False, **{n: self.state_of(n) for n in KEYS})
            self._save(m)
            return m

    # Artifacts

    def artifacts(self) -> DataFrame:
        rows = [(i, a.artifact_id, a.kind, a.sha256, a.created_at, list(a.parent_artifact_ids), a.period, a.label, a.source_job_id, a.provenance_id, a.provenance_sha256) for i, a in enumerate(self.manifest().artifacts, 1)]
        return self.spark.createDataFrame(rows, registry.ARTIFACTS)

    def artifact_path(self, artifact_id: str) -> str:
        return f"{self.folder}/artifacts/{artifact_id}.xlsx"

    def provenance_path(self, provenance_id: str) -> str:
        return f"{self.folder}/provenance/{provenance_id}.bin"

    def allocate(self) -> tuple[str, str]:
        """A fresh artifact id and where its file goes."""
        i = secrets.token_hex(16)
        return i, self.artifact_path(i)

    def allocate_provenance(self) -> tuple[str, str]:
        """A fresh provenance id and where its file goes."""
        i = secrets.token_hex(16)
        return i, self.provenance_path(i)

    def stage(self, source: str) -> tuple[str, str]:
        """Copy a file to a fresh artifact's place, to be registered there."""
        i, path = self.allocate()
        with open(source, "rb") as f:
            publish(f.read(), path, replace=False)
        return i, path

    @contextmanager
    def stores(self):
        """Both maps for reading, while nothing else can change them."""
        with locked(self.folder):
            yield Stores(self.read("mapping"), self.read("identifier"))

    def register(self, artifact_id: str, kind: str, period: str, parents: tuple[str, ...] = (), label: str | None = None, job_id: str | None = None, provenance_id: str | None = None, findings: DataFrame | None = None) -> Artifact:
        """Take up a file that lies at its place; anonymized and analytical ones need an inspection without blocking findings."""
        from . import inspect

        path = self.artifact_path(artifact_id)
        if not os.path.exists(path):
            raise WorkspaceError("artifact_missing")
        if kind != "local_restored" and (findings is None or inspect.report(findings).first()["has_blocking_findings"]):
            raise WorkspaceError("evidence")
        proof = None
        if provenance_id is not None:
            if not os.path.exists(self.provenance_path(provenance_id)):
                raise WorkspaceError("provenance_missing")
            proof = hash_file(self.provenance_path(provenance_id))
        with locked(self.folder):
            m = self.manifest()
            a = Artifact(artifact_id, kind, hash_file(path), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), tuple(parents), period, label, job_id, provenance_id, proof)
            m = m.next(artifacts=(*m.artifacts, a))
            table = self.spark.createDataFrame([(i, x.artifact_id, x.kind, x.sha256, x.created_at, list(x.parent_artifact_ids), x.period, x.label, x.source_job_id, x.provenance_id, x.provenance_sha256) for i, x in enumerate(m.artifacts, 1)], registry.ARTIFACTS)
            for found, reason in ((registry.format_problems(table), "artifact_format"), (registry.repeats(table), "artifact_repeated"), (registry.lineage_problems(table), "invalid_lineage")):
                if found.limit(1).count():
                    raise WorkspaceError(reason)
            self._save(m)
        return a

    def get(self, artifact_id: str) -> Artifact:
        for a in self.manifest().artifacts:
            if a.artifact_id == artifact_id:
                return a
        raise WorkspaceError("unknown_artifact")

    def verified_path(self, artifact_id: str) -> str:
        """Where an artifact lies, once its hash has been checked."""
        a = self.get(artifact_id)
        path = self.artifact_path(artifact_id)
        if not os.path.exists(path):
            raise WorkspaceError("artifact_missing")
        if hash_file(path) != a.sha256:
            raise WorkspaceError("artifact_changed")
        return path

    def verified_provenance(self, artifact_id: str) -> str:
        a = self.get(artifact_id)
        if a.provenance_id is None or not os.path.exists(self.provenance_path(a.provenance_id)):
            raise WorkspaceError("provenance_missing")
        if hash_file(self.provenance_path(a.provenance_id)) != a.provenance_sha256:
            raise WorkspaceError("provenance_changed")
        return self.provenance_path(a.provenance_id)

    def set_latest(self, artifact_id: str) -> None:
        """Point to the analytical artifact that counts."""
        if self.get(artifact_id).kind != "analytical_canonical":
            raise WorkspaceError("not_analytical")
        with locked(self.folder):
            self._save(self.manifest().next(latest_analytical=artifact_id))

    def latest(self) -> Artifact | None:
        i = self.manifest().latest_analytical
        return None if i is None else self.get(i)

    def verify(self) -> dict[str, int]:
        """Counts of registered, verified, missing, changed and orphan files."""
        rows = [(f[:-5], hash_file(f"{self.folder}/artifacts/{f}")) for f in sorted(os.listdir(f"{self.folder}/artifacts")) if re.fullmatch(r"[0-9a-f]{32}\.xlsx", f)]
        files = self.spark.createDataFrame(rows, "artifact_id string, file_sha256 string")
        return registry.audit(self.artifacts(), files).first().asDict() | {"n_leftovers": sum(leftover(f) for f in os.listdir(f"{self.folder}/artifacts"))}

    # Backups

    def snapshot(self, keep_last: int = 5) -> str:
        """Copy manifest and maps, then drop all but the newest backups."""
        with locked(self.folder):
            m = self.manifest()
            if m.pending:
                raise WorkspaceError("mutation_pending")
            name = f"{m.revision:08d}-{secrets.token_hex(4)}"
            temp = f"{self.folder}/backups/.{name}.tmp"
            os.makedirs(f"{temp}/stores")
            for s in KEYS:
                v = f"{s}-{self._versions(s)[-1]:08d}"
                shutil.copytree(f"{self.folder}/stores/{v}", f"{temp}/stores/{v}")
            shutil.copy2(f"{self.folder}/manifest.bin", f"{temp}/manifest.bin")
            os.rename(temp, f"{self.folder}/backups/{name}")
            for r in registry.retention(self.backups(), keep_last).where("not keep").collect():
                shutil.rmtree(f"{self.folder}/backups/{r['name']}")
            return name

    def backups(self) -> DataFrame:
        found = [(int(n[:8]), n) for n in sorted(os.listdir(f"{self.folder}/backups")) if re.fullmatch(r"[0-9]{8}-[0-9a-f]{8}", n)]
        return self.spark.createDataFrame(found, "revision int, name string").orderBy("revision", "name")

    def verify_backup(self, name: str) -> dict[str, str]:
        if not re.fullmatch(r"[0-9]{8}-[0-9a-f]{8}", name) or not os.path.isdir(f"{self.folder}/backups/{name}"):
            raise WorkspaceError("unknown_backup")
        return Workspace(self.spark, f"{self.folder}/backups/{name}", self.password).diagnose()


def hash_file(path: str) -> str:
    h = sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def leftover(name: str) -> bool:
    """Whether a name is that of a file whose writing broke off."""
    return re.fullmatch(r"\.[\w.-]*\.?tmp", name) is not None
