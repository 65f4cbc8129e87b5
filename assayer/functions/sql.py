"""Rules as SQL functions, for who writes SQL alone.

The body of each function is the SQL text of the expression that the rule compiles to, so Spark
inlines and optimizes it as any other; no user code runs for a row.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .nulls import is_null_like
from .rules import Rule, conforms


def function_name(column: str) -> str:
    """``conforms_`` and the column's name in lower case, with an underscore for all that isn't a letter or digit."""
    return "conforms_" + re.sub(r"[^0-9a-z]+", "_", column.lower()).strip("_")


def sql_text(spark: SparkSession, expression: Column, parameter: str = "x") -> str:
    """The SQL text of an expression over one text column named as the parameter."""
    analyzed = spark.createDataFrame([], f"{parameter} string").select(expression.alias("y"))._jdf.queryExecution().analyzed()
    return analyzed.expressions().head().child().sql()


def register(spark: SparkSession, rules: Mapping[str, Rule], *, as_of: dt.date | str | None = None, names: Mapping[str, str] | None = None, temporary: bool = True) -> list[str]:
    """Creates a function of one text for each rule's column, and ``null_like``; returns their names.

    ``names`` gives functions other names than ``function_name`` does; two rules of one name are an error.  Without
    ``temporary`` the functions are stored in the session's current database; dates are then judged
    as of the day that is given, or of the day of the call.
    """
    made: dict[str, Column] = {"null_like": is_null_like(F.col("x"))}
    for column, rule in rules.items():
        name = (names or {}).get(column) or function_name(column)
        if name in made:
            raise ValueError(f"two rules make a function {name}")
        made[name] = conforms(F.col("x"), rule, column, as_of)
    for name, expression in made.items():
        kind = "OR REPLACE TEMPORARY " if temporary else "OR REPLACE "
        spark.sql(f"CREATE {kind}FUNCTION `{name}`(x STRING) RETURNS BOOLEAN RETURN {sql_text(spark, expression)}")
    return list(made)
