"""Issues: what a profile has to object to."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import NAME_COLUMNS, Rule
from .profile import UNIQUE_COLUMN, UNIVERSAL, Profile

DATASET = "__DATASET__"
CONFORMITY_LIMIT, COMPLETENESS_LIMIT, EXAMPLES = 95.0, 85.0, 5
FIELDS = "column_name string, issue_type string, count long, percentage double, description string, examples array<string>, rule_violated string"


def _number(c: Column) -> Column:
    return F.format_string("%.1f", c)


def detect(profile: Profile, rules: Mapping[str, Rule], *, conformity_limit: float = CONFORMITY_LIMIT, completeness_limit: float = COMPLETENESS_LIMIT, examples: int = EXAMPLES) -> DataFrame:
    """seq (order of detection), and FIELDS.

    A column with bad values below the limit has two conformity issues, one for the
    values and one for the limit; a column without any value has the second alone.
    """
    spark = profile.metrics.sparkSession
    m = profile.metrics
    bad = profile.violations.where(F.col("position") <= examples).groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("position", "value")))["value"].alias("examples"))
    ids = spark.createDataFrame([(c, r.rule_id) for c, r in rules.items()] or [("", "")], "column_name string, rule_id string")
    m = m.join(bad, "column_name", "left").join(ids, "column_name", "left")
    if profile.conditional is not None:
        m = m.join(profile.conditional.select("column_name", "n_individual", "n_organization"), "column_name", "left")
    else:
        m = m.withColumn("n_individual", F.lit(0)).withColumn("n_organization", F.lit(0))
    name, total, score = F.col("column_name"), F.col("total_count"), F.col("completeness_score")
    none = F.array().cast("array<string>")
    shown = F.coalesce("examples", none)

    def issue(seq: int, when: Column, kind: str, count: Column, percentage: Column, text: Column, rule: Column, listed: Column = none) -> Column:
        row = F.struct(
            (F.col("position") * 10 + seq).alias("seq"),
            name.alias("column_name"),
            F.lit(kind).alias("issue_type"),
            count.cast("long").alias("count"),
            percentage.cast("double").alias("percentage"),
            text.alias("description"),
            listed.alias("examples"),
            rule.alias("rule_violated"),
        )
        return F.when(when, row)

    nulls, people, firms, wrong = F.col("null_count"), F.col("n_individual"), F.col("n_organization"), F.col("non_conforming_count")
    short = score < 100
    universal, conditional = name.isin(*UNIVERSAL), name.isin(*NAME_COLUMNS)
    need = lambda k, kind, n: F.concat(name, F.lit(f" is required for Entity Type Code = {k} ({kind}) but has "), n.cast("string"), F.lit(" null values"))
    all_issues = [
        issue(0, short & universal, "completeness", nulls, 100 - score, F.concat(F.lit("Required field "), name, F.lit(" has "), nulls.cast("string"), F.lit(" null values")), F.concat(name, F.lit("_REQUIRED"))),
        issue(1, short & conditional & (people > 0), "completeness", people, people / total * 100, need(1, "Individual", people), F.concat(name, F.lit("_REQUIRED_FOR_INDIVIDUAL"))),
        issue(2, short & conditional & (firms > 0), "completeness", firms, firms / total * 100, need(2, "Organization", firms), F.concat(name, F.lit("_REQUIRED_FOR_ORGANIZATION"))),
        issue(3, short & ~universal & ~conditional, "completeness", nulls, 100 - score, F.concat(F.lit("Field "), name, F.lit(" should not be null but has "), nulls.cast("string"), F.lit(" null values")), F.concat(name, F.lit("_NOT_NULL"))),
        issue(4, wrong > 0, "conformity", wrong, F.try_divide(wrong * 100, F.col("non_null_count")), F.concat(name, F.lit(" has "), wrong.cast("string"), F.lit(" values that don't match required format")), F.col("rule_id"), shown),
        issue(5, (name == UNIQUE_COLUMN) & (F.col("duplicate_count") > 0), "uniqueness", F.col("duplicate_count"), F.try_divide(F.col("duplicate_count") * 100, total), F.concat(name, F.lit(" field has "), F.col("duplicate_count").cast("string"), F.lit(" duplicate values")), F.lit(f"{UNIQUE_COLUMN}_UNIQUE")),
        issue(6, F.col("conformity_score") < conformity_limit, "conformity", wrong, 100 - F.col("conformity_score"), F.concat(name, F.lit(" conformity ("), _number(F.col("conformity_score")), F.lit("%) below threshold")), F.col("rule_id"), shown),
    ]
    rows = m.select(F.explode(F.filter(F.array(*all_issues), lambda x: x.isNotNull())).alias("x")).select("x.*")
    whole = F.col("overall_completeness")
    last = profile.dataset.where(whole < completeness_limit).select(
        F.lit(1 << 30).alias("seq"),
        F.lit(DATASET).alias("column_name"),
        F.lit("completeness").alias("issue_type"),
        F.lit(0).cast("long").alias("count"),
        (100 - whole).alias("percentage"),
        F.concat(F.lit("Overall dataset completeness ("), _number(whole), F.lit("%) is below acceptable threshold")).alias("description"),
        none.alias("examples"),
        F.lit(None).cast("string").alias("rule_violated"),
    )
    return rows.unionByName(last)


def consolidate(issues: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """One issue for each column and type: summed counts, mean percentage, the first examples, the first rule."""
    first = F.min_by(F.struct("description", "rule_violated"), "seq")
    merged = issues.groupBy("column_name", "issue_type").agg(
        F.count("*").alias("merged"),
        F.min("seq").alias("seq"),
        F.sum("count").alias("count"),
        F.avg("percentage").alias("percentage"),
        first.alias("f"),
        F.slice(F.flatten(F.array_sort(F.collect_list(F.struct("seq", "examples")))["examples"]), 1, examples).alias("examples"),
    )
    return merged.select("seq", "column_name", "issue_type", "count", "percentage", "f.description", "examples", "f.rule_violated", "merged")
