"""Column types by header, on the driver: a table has few headers, and Spark has no casefold or normalization."""

from __future__ import annotations

import re
import unicodedata

#: Headers, normalized, by field type.
HEADERS = {
    "company": ("компания", "организация", "наименование организации", "наименование компании", "контрагент"),
    "branch": ("филиал", "наименование филиала"),
    "department": ("подразделение", "отдел", "департамент", "структурное подразделение"),
    "person": ("фио", "ф.и.о.", "сотрудник", "физическое лицо"),
    "inn": ("инн", "инн организации", "инн контрагента"),
    "kpp": ("кпп", "кпп организации", "кпп контрагента"),
    "ogrn": ("огрн", "огрнип", "огрн организации"),
    "phone": ("телефон", "номер телефона", "мобильный телефон"),
    "email": ("email", "e-mail", "электронная почта", "адрес электронной почты"),
    "address": ("адрес", "юридический адрес", "фактический адрес", "почтовый адрес"),
    "financial": ("выручка", "оборот", "доход", "расходы", "маржинальность", "прибыль"),
}
_TYPE_OF = {h: t for t, hs in HEADERS.items() for h in hs}


def normalize_header(header: str) -> str:
    """Stripped, composed, case-folded, with single spaces."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", header.strip()).casefold())


def column_type(header: object) -> str:
    """The field type that a header names, unknown for all others and for non-strings."""
    return _TYPE_OF.get(normalize_header(header), "unknown") if isinstance(header, str) else "unknown"
