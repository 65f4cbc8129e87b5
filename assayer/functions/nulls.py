"""The null model: which texts stand for a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EIN = "Employer Identification Number (EIN)"

#: Texts, stripped and in lower case, that count as null.
NULL_TOKENS = (
    "", "-", "--", "---", "----",
    "na", "n/a", "n.a", "n.a.",
    "null", "none", "nan", "nil", "nill",
    "unavail", "unavailable", "<unavail>", "<null>", "<none>", "<na>",
    "unknown", "unk", "missing", "not applicable", "not available",
)

_SPACE = r"[\s\x1c-\x1f]"


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; Spark's trim knows the space alone."""
    return F.regexp_replace(c.cast("string"), f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_null_like(c: Column, name: str | Column = "", *, stripped: bool = False) -> Column:
    """Whether a value counts as missing; ``name`` is the column's name, as text or as a column of long rows."""
    low = F.lower(c if stripped else strip(c))
    listed = c.isNull() | low.isin(*NULL_TOKENS)
    if isinstance(name, Column):
        return listed & ~((name == EIN) & (low == "<unavail>") & c.isNotNull())
    return c.isNull() | low.isin(*[t for t in NULL_TOKENS if t != "<unavail>"]) if name == EIN else listed


def non_null_count(c: Column, name: str = "") -> Column:
    """Aggregate: how many values don't count as missing."""
    return F.count_if(~is_null_like(c, name))
