"""The workspace manifest: canonical JSON with exact keys, kept in an encrypted container."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession

from ..types import ARTIFACT_KINDS, WorkspaceError
from .container import decrypt_bytes, encrypt_bytes
from .xlsx import publish

#: Size limits of the encrypted and the plain manifest.
CIPHER_BYTES, PLAIN_BYTES = 16 << 20, 8 << 20
VERSION = 1


@dataclass(frozen=True)
class StoreState:
    """A commitment to the first ``entry_count`` keys of a map."""

    entry_count: int = 0
    prefix_digest: str = ""


@dataclass(frozen=True)
class Artifact:
    artifact_id: str
    kind: str
    sha256: str
    created_at: str
    parent_artifact_ids: tuple[str, ...]
    period: str
    label: str | None = None
    source_job_id: str | None = None
    provenance_id: str | None = None
    provenance_sha256: str | None = None


@dataclass(frozen=True)
class Manifest:
    workspace_id: str
    revision: int = 0
    pending: bool = False
    mapping: StoreState = field(default_factory=StoreState)
    identifier: StoreState = field(default_factory=StoreState)
    artifacts: tuple[Artifact, ...] = ()
    latest_analytical: str | None = None
    #: What the stores' strings are sealed with, in hex.
    store_key: str = ""

    def next(self, **changes) -> Manifest:
        return replace(self, revision=self.revision + 1, **changes)


def _no_repeats(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise WorkspaceError("manifest_repeated_key")
    return out


def _no_constant(_):
    raise WorkspaceError("manifest_not_finite")


def serialize(m: Manifest) -> bytes:
    return json.dumps({"version": VERSION, **asdict(m)}, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def parse(data: bytes) -> Manifest:
    """Anything but exactly the known keys and types is refused."""
    if len(data) > PLAIN_BYTES:
        raise WorkspaceError("manifest_too_large")
    try:
        d = json.loads(data, object_pairs_hook=_no_repeats, parse_constant=_no_constant)
    except ValueError:
        raise WorkspaceError("manifest_not_json") from None
    known = {"version", *Manifest.__dataclass_fields__}
    if not isinstance(d, dict) or set(d) != known or type(d["version"]) is not int or d["version"] != VERSION:
        raise WorkspaceError("manifest_keys")
    states = {}
    for s in ("mapping", "identifier"):
        if not isinstance(d[s], dict) or set(d[s]) != set(StoreState.__dataclass_fields__) or type(d[s]["entry_count"]) is not int or d[s]["entry_count"] < 0:
            raise WorkspaceError("manifest_store")
        states[s] = StoreState(**d[s])
    artifacts = []
    for a in d["artifacts"]:
        if not isinstance(a, dict) or set(a) != set(Artifact.__dataclass_fields__) or a["kind"] not in ARTIFACT_KINDS or not re.fullmatch("[0-9a-f]{64}", a["sha256"]):
            raise WorkspaceError("manifest_artifact")
        artifacts.append(Artifact(**{**a, "parent_artifact_ids": tuple(a["parent_artifact_ids"])}))
    if type(d["revision"]) is not int or d["revision"] < 0 or not isinstance(d["pending"], bool) or not isinstance(d["store_key"], str) or not re.fullmatch("([0-9a-f]{64})?", d["store_key"]):
        raise WorkspaceError("manifest_keys")
    return Manifest(d["workspace_id"], d["revision"], d["pending"], **states, artifacts=tuple(artifacts), latest_analytical=d["latest_analytical"], store_key=d["store_key"])


def save(spark: SparkSession, m: Manifest, path: str, password: str, **options) -> None:
    publish(encrypt_bytes(spark, serialize(m), password, **options), path)


def load(spark: SparkSession, path: str, password: str) -> Manifest:
    with open(path, "rb") as f:
        data = f.read(CIPHER_BYTES + 1)
    if len(data) > CIPHER_BYTES:
        raise WorkspaceError("manifest_too_large")
    return parse(decrypt_bytes(spark, data, password))
