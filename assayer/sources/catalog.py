"""Rules and the columns in focus: the built-in catalogue, and rules from YAML files."""

from __future__ import annotations

import logging
import re
from pathlib import Path

from ..functions.nulls import EIN
from ..functions.rules import ENTITY_TYPE, NAME_COLUMNS, Rule
from ..functions.states import CODES, MILITARY

log = logging.getLogger(__name__)

#: Patterns and bounds of the provider registry's columns.
NAME_PATTERN = r"^[A-Za-z\s\-\'\.]{1,100}$"
CITY_PATTERN = r"^[A-Za-z\s\-\'\.]{1,40}$"
POSTAL_PATTERN = r"^(\d{5}(-\d{4})?(\.0)?|\d{9}(\.0)?)$"
ADDRESS_STATES = [*CODES, *MILITARY]
MAILING, PRACTICE = "Business Mailing Address", "Business Practice Location Address"


def default_rule_id(column: str) -> str:
    return re.sub(r"[^A-Z0-9]+", "_", column.upper()).strip("_") + "_FORMAT"


def _built_in() -> dict[str, tuple[str, dict]]:
    """Each column's rule type and settings."""
    regex = lambda p: ("regex", {"pattern": p})
    enum = lambda *v: ("enum", {"values": list(v)})
    length = lambda a, b: ("length", {"min": a, "max": b})
    phone, date = ("phone", {"min_digits": 7, "max_digits": 20}), ("date", {"not_future": True})
    out = {
        "NPI": regex(r"^\d{10}$"),
        ENTITY_TYPE: enum("1", "2"),
        EIN: regex(r"^(\d{9}|<UNAVAIL>)$"),
        NAME_COLUMNS[0]: regex(NAME_PATTERN),
        NAME_COLUMNS[2]: length(2, 120),
        NAME_COLUMNS[1]: regex(NAME_PATTERN),
    }
    for place in (MAILING, PRACTICE):
        out[f"Provider First Line {place}"] = out[f"Provider Second Line {place}"] = length(1, 80)
        out[f"Provider {place} City Name"] = regex(CITY_PATTERN)
        out[f"Provider {place} State Name"] = enum(*ADDRESS_STATES)
        out[f"Provider {place} Postal Code"] = regex(POSTAL_PATTERN)
        out[f"Provider {place} Country Code (If outside U.S.)"] = regex("^[A-Z]{2}$")
        out[f"Provider {place} Telephone Number"] = out[f"Provider {place} Fax Number"] = phone
    out |= {"Provider Enumeration Date": date, "Last Update Date": date}
    for n in (1, 2):
        out[f"Healthcare Provider Taxonomy Code_{n}"] = regex("^[A-Za-z0-9]{10}$")
        out[f"Provider License Number_{n}"] = regex("^[A-Za-z0-9]{1,25}$")
        out[f"Provider License Number State Code_{n}"] = enum(*ADDRESS_STATES)
        out[f"Healthcare Provider Primary Taxonomy Switch_{n}"] = enum("Y", "N")
    out |= {f"Healthcare Provider Taxonomy Group_{n}": length(1, 50) for n in (1, 2)}
    out["Certification Date"] = date
    for n in (1, 2):
        out[f"Other Provider Identifier_{n}"] = length(1, 100)
        out[f"Other Provider Identifier Type Code_{n}"] = length(1, 10)
        out[f"Other Provider Identifier State_{n}"] = enum(*ADDRESS_STATES)
        out[f"Other Provider Identifier Issuer_{n}"] = length(1, 100)
    return out


#: Ids that don't follow from the column's name.
RULE_IDS = {"NPI": "NPI_FORMAT", ENTITY_TYPE: "ENTITY_TYPE_FORMAT", EIN: "EIN_FORMAT", NAME_COLUMNS[2]: "ORG_NAME_FORMAT", NAME_COLUMNS[0]: "PROVIDER_LAST_NAME_FORMAT"}


def provider_rules() -> dict[str, Rule]:
    """The rules of the 43 provider columns."""
    ids = lambda c: RULE_IDS.get(c) or default_rule_id(c.replace(" (If outside U.S.)", ""))
    return {c: Rule(ids(c), c, kind, config, f"{c}: {kind} {config}") for c, (kind, config) in _built_in().items()}


def focused_columns() -> list[str]:
    """The 43 columns, in order."""
    return list(_built_in())


def load_rules(path: str | Path) -> dict[str, Rule]:
    """Rules of a YAML file, or of all ``*.yaml`` in a folder: ``rules: {column: {rule_type, rule_config, rule_id, description}}``.

    A rule without a type is left out and logged; without an id it gets one made of the column's name.
    """
    import yaml

    path = Path(path)
    files = sorted(path.glob("*.yaml")) if path.is_dir() else [path]
    out: dict[str, Rule] = {}
    for file in files:
        listed = (yaml.safe_load(file.read_text(encoding="utf-8")) or {}).get("rules") or {}
        for column, entry in listed.items():
            if not entry or not entry.get("rule_type"):
                log.warning("%s: no rule type for %s", file.name, column)
                continue
            out[column] = Rule(entry.get("rule_id") or f"{column.upper().replace(' ', '_')}_FORMAT", column, entry["rule_type"], entry.get("rule_config") or {}, entry.get("description") or "")
    return out


def load_settings(path: str | Path) -> dict[str, dict]:
    """All YAML files of a folder, by their stems."""
    import yaml

    return {f.stem: yaml.safe_load(f.read_text(encoding="utf-8")) or {} for f in sorted(Path(path).glob("*.yaml"))}


def find_column(columns: list[str], name: str) -> str | None:
    """The column of this name: exactly, else in any case."""
    return name if name in columns else next((c for c in columns if c.lower() == name.lower()), None)


def rules_coverage(rules: dict[str, Rule], columns: list[str] | None = None) -> dict:
    """How many focused columns have a rule, which have none, and rules by type."""
    columns = focused_columns() if columns is None else columns
    kinds: dict[str, int] = {}
    for r in rules.values():
        kinds[r.rule_type] = kinds.get(r.rule_type, 0) + 1
    return {"covered": sum(c in rules for c in columns), "columns": len(columns), "without": [c for c in columns if c not in rules], "by_type": kinds}
