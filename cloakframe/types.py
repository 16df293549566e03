"""Enums, rules, the column action matrix and error classes.

Error messages carry codes and coordinates only, never values of cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class FieldType(Enum):
    COMPANY = "company"
    BRANCH = "branch"
    DEPARTMENT = "department"
    PERSON = "person"
    INN = "inn"
    KPP = "kpp"
    OGRN = "ogrn"
    PHONE = "phone"
    EMAIL = "email"
    ADDRESS = "address"
    FINANCIAL = "financial"
    UNKNOWN = "unknown"


class Action(Enum):
    PSEUDONYMIZE = "pseudonymize"
    REMOVE = "remove"
    KEEP = "keep"


#: Alias and token prefixes.
ALIAS_PREFIX = {"company": "C", "branch": "B", "department": "D", "person": "P", "unknown": "X"}
TOKEN_PREFIX = {"inn": "INN", "kpp": "KPP", "ogrn": "OGRN"}

#: What the column action matrix is built from.
KEEP_FORBIDDEN = frozenset({"company", "person", "phone", "email", "address", "unknown"})
KEEP_SCANNED = frozenset({"inn", "kpp", "ogrn", "branch", "department", "financial"})
ENTITY_FIELDS = frozenset({"company", "person"})
IDENTIFIER_FIELDS = frozenset({"inn", "kpp", "ogrn"})
PSEUDONYMIZABLE = ENTITY_FIELDS | IDENTIFIER_FIELDS

WORKSHEET_POLICIES = ("process", "remove_all")
REPRESENTATIONS = ("string", "integer")
ARTIFACT_KINDS = ("anonymized_monthly", "analytical_canonical", "local_restored")

#: Finding kinds in report order; the first three block.
FINDING_KINDS = (
    "restored_marker", "known_entity_value", "known_identifier_value", "formula", "comment", "hyperlink", "core_property",
    "custom_property", "defined_name", "header_footer", "table", "hidden_worksheet", "external_link", "drawing", "chart",
    "chartsheet", "media", "embedding", "pivot", "custom_xml", "vba", "threaded_comment",
)
BLOCKING_KINDS = FINDING_KINDS[:3]


def allowed(field_type: str, action: str) -> str | None:
    """None if the matrix allows the action for the type, else the reason why not."""
    if action == "keep" and field_type in KEEP_FORBIDDEN:
        return "keep_forbidden_for_type"
    if action == "pseudonymize" and field_type not in PSEUDONYMIZABLE:
        return "pseudonymize_unsupported_for_type"
    return None


def action_matrix() -> list[tuple[str, str, str | None]]:
    """All (field type, action, reason against it)."""
    return [(t.value, a.value, allowed(t.value, a.value)) for t in FieldType for a in Action]


@dataclass(frozen=True)
class FieldRule:
    """What to do with one column; rules are bound by the column's 1-based place, the name is for cross-checks."""

    column_name: str
    field_type: FieldType
    action: Action

    def to_dict(self) -> dict[str, str]:
        return {"column_name": self.column_name, "field_type": self.field_type.value, "action": self.action.value}

    @classmethod
    def from_dict(cls, data: dict[str, str]) -> FieldRule:
        return cls(data["column_name"], FieldType(data["field_type"]), Action(data["action"]))


class EngineError(Exception):
    """Base of all errors here; ``reason`` is a fixed code, ``where`` says coordinates."""

    def __init__(self, reason: str, **where):
        self.reason, self.where = reason, where
        super().__init__(reason + ("" if not where else " at " + ", ".join(f"{k}={v}" for k, v in where.items())))


class RuleConfigurationError(EngineError): ...


class MissingIdentifierMapError(RuleConfigurationError): ...


class UnsupportedTargetError(EngineError): ...


class FormulaError(EngineError): ...


class EntityValueError(EngineError): ...


class IdentifierValueError(EngineError): ...


class MapConflictError(EngineError): ...


class IdentifierConflictError(EngineError): ...


class ProvenanceConflictError(EngineError): ...


class AmbiguousMappingError(EngineError): ...


class KeySpaceExhaustedError(EngineError): ...


class RestoreValidationError(EngineError): ...


class UnresolvedRestoreError(RestoreValidationError): ...


class AmbiguousRestoreError(EngineError): ...


class CoverageError(EngineError): ...


class ColumnSafetyError(EngineError): ...


class PackageError(EngineError): ...


class WriterValidationError(EngineError): ...


class JobValidationError(EngineError): ...


class InspectionError(EngineError): ...


class CryptoError(EngineError): ...


class WorkspaceError(EngineError): ...
