"""Column rules, compiled to boolean columns.

A rule type is a function of the stripped value, the rule's settings, the column's
name and the date that counts as today.  ``RULE_TYPES`` can be extended.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import is_null_like, strip

ENTITY_TYPE = "Entity Type Code"

#: What Python's float() reads.
PY_FLOAT = r"(?i)^[+-]?(inf(inity)?|nan|((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?)$"

#: Date formats that validation accepts, and those that repairs read besides, in order of trial.
DATE_FORMATS = (
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
)
MORE_DATE_FORMATS = (
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M.d.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("yyyy.M.d", r"^\d{4}\.\d{1,2}\.\d{1,2}$"),
)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    column_name: str
    rule_type: str
    rule_config: Mapping = field(default_factory=dict)
    description: str = ""


def today(as_of: dt.date | str | None) -> Column:
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def parsed_date(v: Column, formats: tuple = DATE_FORMATS) -> Column:
    """The first format that reads the text as a date of the calendar."""
    tries = [F.when(v.rlike(shape), F.try_to_date(v, form)) for form, shape in formats]
    return F.coalesce(*tries)


def whole_number_text(v: Column) -> Column:
    """Text of a number without a fraction as that of an integer ("1.0" as "1"), other text as it is."""
    x = F.when(v.rlike(PY_FLOAT) & ~v.rlike("(?i)inf|nan"), F.replace(v, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(x.isNotNull() & (x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(v)


def _regex(v: Column, config: Mapping, name: str, as_of: Column) -> Column:
    return v.rlike("(?U)^(?:" + config.get("pattern", "") + ")")


def _enum(v: Column, config: Mapping, name: str, as_of: Column) -> Column:
    values = [str(x) for x in config.get("values", ())]
    return (whole_number_text(v) if name == ENTITY_TYPE else v).isin(*values) if values else F.lit(False)


def _length(v: Column, config: Mapping, name: str, as_of: Column) -> Column:
    n, most = F.char_length(v), config.get("max")
    least = n >= int(config.get("min", 0))
    return least if most is None else least & (n <= int(most))


def _numeric(v: Column, config: Mapping, name: str, as_of: Column) -> Column:
    return v.rlike(PY_FLOAT)


def _date(v: Column, config: Mapping, name: str, as_of: Column) -> Column:
    d = parsed_date(v)
    good = d.isNotNull()
    return good & (d <= as_of) if config.get("not_future") else good


def _phone(v: Column, config: Mapping, name: str, as_of: Column) -> Column:
    return F.char_length(F.regexp_replace(v, r"(?U)\D", "")).between(int(config.get("min_digits", 7)), int(config.get("max_digits", 20)))


RULE_TYPES: dict[str, Callable[[Column, Mapping, str, Column], Column]] = {
    "regex": _regex,
    "enum": _enum,
    "length": _length,
    "numeric": _numeric,
    "date": _date,
    "phone": _phone,
}


def matches(c: Column, rule: Rule | None, name: str = "", as_of: dt.date | str | Column | None = None, *, stripped: bool = False) -> Column:
    """Whether a value that isn't missing satisfies the rule; without a rule every such value does, an unknown type none."""
    if rule is None:
        return F.lit(True)
    made = RULE_TYPES.get(rule.rule_type)
    if made is None:
        return F.lit(False)
    day = as_of if isinstance(as_of, Column) else today(as_of)
    return F.coalesce(made(c if stripped else strip(c), rule.rule_config, name or rule.column_name, day), F.lit(False))


def conforms(c: Column, rule: Rule | None, name: str = "", as_of: dt.date | str | None = None) -> Column:
    """Whether a value is there and satisfies the rule."""
    name = name or (rule.column_name if rule else "")
    return F.when(is_null_like(c, name), False).otherwise(matches(c, rule, name, as_of))


def matches_long(name: Column, value: Column, rules: Mapping[str, Rule], as_of: dt.date | str | None = None) -> Column:
    """The same over rows of (column's name, stripped value): columns that share a rule's settings share its expression."""
    groups: dict[tuple, list[str]] = {}
    for column, rule in rules.items():
        key = (rule.rule_type, repr(sorted(rule.rule_config.items(), key=str)), column == ENTITY_TYPE)
        groups.setdefault(key, []).append(column)
    cases = [(name.isin(*columns), matches(value, rules[columns[0]], columns[0], as_of, stripped=True)) for columns in groups.values()]
    if not cases:
        return F.lit(True)
    return reduce(lambda a, x: a.when(*x), cases[1:], F.when(*cases[0])).otherwise(True)


def entity_type(c: Column) -> Column:
    """The entity type as an integer, truncated; null if missing or no number."""
    v = strip(c)
    x = F.when(v.rlike(PY_FLOAT) & ~v.rlike("(?i)inf|nan"), F.replace(v, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(~is_null_like(c, ENTITY_TYPE), x).try_cast("int")


NAME_COLUMNS = ("Provider Last Name (Legal Name)", "Provider First Name", "Provider Organization Name (Legal Business Name)")
ORGANIZATION = NAME_COLUMNS[2]


def required_of(name: str) -> int:
    """The entity type that a name column is required of."""
    return 2 if name == ORGANIZATION else 1


def conditionally_complete(entity: Column, value: Column, name: str) -> Column:
    """Whether a row meets the requirement of a name column: the other entity type always does, an invalid one never."""
    et = entity_type(entity)
    need = required_of(name)
    return F.coalesce(F.when(et == need, ~is_null_like(value, name)).when(et == 3 - need, True), F.lit(False))
