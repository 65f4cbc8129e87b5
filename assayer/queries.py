"""Queries over the bundled tables, one or more for each operator, with SQL that gives the same rows.

The tables are clean, so queries read a provider-shaped view of ``customer`` that
is made dirty by arithmetic on its key; the view's SQL is plain enough for both
engines.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .functions import fixes, nulls, rules, sql, states
from .functions.nulls import EIN
from .functions.rules import ENTITY_TYPE, NAME_COLUMNS, Rule
from .operators import accept, anomaly, issues, partial, profile, recommend, repair, reports, validate, wide
from .sources import files, history, reference, scratch
from .sources.catalog import MAILING, POSTAL_PATTERN, focused_columns, provider_rules
from .sources.files import ROW
from .streaming import quality

AS_OF = "2024-06-30"

# --- the dirty view

VIEW = """
SELECT c_custkey AS k,
  CASE WHEN c_custkey % 13 = 0 THEN substr(cast(1000000000 + c_custkey AS string), 1, 9) WHEN c_custkey % 7 = 0 THEN ' N/A ' WHEN c_custkey % 11 = 0 THEN '-'
       WHEN c_custkey % 17 = 0 THEN '1000000001' WHEN c_custkey % 19 = 0 THEN 'NPI:' || cast(1000000000 + c_custkey AS string) ELSE cast(1000000000 + c_custkey AS string) END AS npi,
  CASE c_custkey % 10 WHEN 0 THEN '1.0' WHEN 1 THEN '2' WHEN 2 THEN '' WHEN 3 THEN '3' WHEN 4 THEN '2.0' ELSE '1' END AS et,
  CASE c_custkey % 6 WHEN 0 THEN '<UNAVAIL>' WHEN 1 THEN '12-3456789' WHEN 2 THEN '12345' WHEN 3 THEN 'unavailable' WHEN 4 THEN '<unavail>' ELSE cast(100000000 + c_custkey AS string) END AS ein,
  CASE WHEN c_custkey % 4 = 0 THEN 'unknown' WHEN c_custkey % 9 = 0 THEN 'Smith, MD' WHEN c_custkey % 19 = 0 THEN 'Jones3' WHEN c_custkey % 23 = 0 THEN 'Wood, M.D., PhD' ELSE 'Miller' END AS last_name,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Ann' END AS first_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_name || ' Clinic' END AS org,
  CASE c_custkey % 5 WHEN 0 THEN '12 Main St, Springfield, IL' WHEN 1 THEN 'PO Box 7' WHEN 2 THEN NULL WHEN 3 THEN 'Oak Ave, Columbus Ohio' ELSE '9 Elm Road; Boston; Suite 4' END AS addr1,
  CASE c_custkey % 3 WHEN 0 THEN NULL ELSE 'Floor 2' END AS addr2,
  CASE WHEN c_custkey % 8 = 0 THEN 'NEW YORK, NY' WHEN c_custkey % 9 = 0 THEN 'CHICAGO,' WHEN c_custkey % 10 = 0 THEN NULL ELSE 'Boston' END AS city,
  CASE c_nationkey % 6 WHEN 0 THEN 'new york' WHEN 1 THEN 'ca' WHEN 2 THEN 'TX' WHEN 3 THEN 'Ontario' WHEN 4 THEN NULL ELSE 'QQ' END AS state,
  CASE c_custkey % 7 WHEN 0 THEN '90210' WHEN 1 THEN '12345-6789' WHEN 2 THEN 'ZIP 60601' WHEN 3 THEN 'T4L 1Z3' WHEN 4 THEN NULL WHEN 5 THEN '80511606.0' ELSE '917' END AS postal,
  CASE WHEN c_nationkey % 6 = 3 THEN 'CA' WHEN c_custkey % 5 = 0 THEN NULL ELSE 'US' END AS country,
  CASE c_custkey % 9 WHEN 0 THEN '(123) 456-7890' WHEN 1 THEN '12345' WHEN 2 THEN '1234567890123456789012' WHEN 3 THEN 'n/a' ELSE '123-456-' || cast(1000 + c_custkey % 9000 AS string) END AS phone,
  CASE c_custkey % 9 WHEN 0 THEN '01/15/2024' WHEN 1 THEN '2024-1-15' WHEN 2 THEN '01-15-2024' WHEN 3 THEN '2024/01/15' WHEN 4 THEN '25/12/2020' WHEN 5 THEN '01.15.2024' WHEN 6 THEN '2030-01-01' WHEN 7 THEN '2020-02-30' ELSE 'soon' END AS day,
  CASE c_custkey % 4 WHEN 0 THEN 'MD ' || cast(c_custkey AS string) || '-1' WHEN 1 THEN 'A' || cast(c_custkey AS string) WHEN 2 THEN '' ELSE '###' END AS license,
  CASE c_custkey % 5 WHEN 0 THEN 'y' WHEN 1 THEN 'N' WHEN 2 THEN 'X' WHEN 3 THEN 'Y' ELSE 'missing' END AS switch,
  CASE c_custkey % 7 WHEN 0 THEN '1,234.5' WHEN 1 THEN '5' WHEN 2 THEN '1_000' WHEN 3 THEN 'abc' WHEN 4 THEN '-0.25' WHEN 5 THEN '1e3' ELSE 'NaN ' END AS amount,
  c_nationkey AS nation
FROM customer"""

ADDRESS = f"Provider {MAILING}"
HEADERS = {
    "npi": "NPI", "et": ENTITY_TYPE, "ein": EIN, "last_name": NAME_COLUMNS[0], "first_name": NAME_COLUMNS[1], "org": NAME_COLUMNS[2],
    "addr1": f"Provider First Line {MAILING}", "addr2": f"Provider Second Line {MAILING}", "city": f"{ADDRESS} City Name", "state": f"{ADDRESS} State Name",
    "postal": f"{ADDRESS} Postal Code", "country": f"{ADDRESS} Country Code (If outside U.S.)", "phone": f"{ADDRESS} Telephone Number",
    "day": "Provider Enumeration Date", "license": "Provider License Number_1", "switch": "Healthcare Provider Primary Taxonomy Switch_1",
}
RULES = {h: provider_rules()[h] for h in HEADERS.values()}
NUMERIC = Rule("AMOUNT", "amount", "numeric")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VIEW.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view under the registry's headers, with the key as the row's place."""
    d = dirty(spark, sf_dir)
    return d.select(F.col("k").alias(ROW), *[F.col(c).alias(h) for c, h in HEADERS.items()])


# --- SQL for the oracles

TOKENS = ", ".join(f"'{t}'" for t in nulls.NULL_TOKENS)
V = f"WITH v AS ({VIEW.replace(' AS string)', ' AS VARCHAR)')})"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def missing(c: str, name: str = "") -> str:
    low = f"lower({strip(c)})"
    return f"({c} IS NULL OR ({low} IN ({TOKENS})" + (f" AND {low} <> '<unavail>'" if c == "ein" or name == "ein" else "") + "))"


def date(c: str, formats: tuple[str, ...]) -> str:
    shapes = {"%m/%d/%Y": r"^\d{1,2}/\d{1,2}/\d{4}$", "%Y-%m-%d": r"^\d{4}-\d{1,2}-\d{1,2}$", "%m-%d-%Y": r"^\d{1,2}-\d{1,2}-\d{4}$", "%Y/%m/%d": r"^\d{4}/\d{1,2}/\d{1,2}$", "%d/%m/%Y": r"^\d{1,2}/\d{1,2}/\d{4}$", "%m.%d.%Y": r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%Y.%m.%d": r"^\d{4}\.\d{1,2}\.\d{1,2}$"}
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({c}, '{shapes[f]}') THEN CAST(try_strptime({c}, '{f}') AS DATE) END" for f in formats) + ")"


FOUR = ("%m/%d/%Y", "%Y-%m-%d", "%m-%d-%Y", "%Y/%m/%d")
SEVEN = (*FOUR, "%d/%m/%Y", "%m.%d.%Y", "%Y.%m.%d")
CODES = ", ".join(f"'{c}'" for c in [*states.CODES, *states.MILITARY])
PLAIN_CODES = ", ".join(f"'{c}'" for c in states.CODES)
FLOAT = r"^[+-]?(inf(inity)?|nan|((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?)$"
WHOLE_ET = f"CASE WHEN regexp_matches({strip('et')}, '^\\d+\\.0*$') THEN regexp_replace({strip('et')}, '\\.0*$', '') ELSE {strip('et')} END"
OK = {
    "npi": f"regexp_matches({strip('npi')}, '^\\d{{10}}$')",
    "et": f"{WHOLE_ET} IN ('1', '2')",
    "ein": f"regexp_matches({strip('ein')}, '^(\\d{{9}}|<UNAVAIL>)$')",
    "last_name": f"regexp_matches({strip('last_name')}, '^[A-Za-z\\s\\-''\\.]{{1,100}}$')",
    "first_name": f"regexp_matches({strip('first_name')}, '^[A-Za-z\\s\\-''\\.]{{1,100}}$')",
    "org": f"length({strip('org')}) BETWEEN 2 AND 120",
    "addr1": f"length({strip('addr1')}) BETWEEN 1 AND 80",
    "addr2": f"length({strip('addr2')}) BETWEEN 1 AND 80",
    "city": f"regexp_matches({strip('city')}, '^[A-Za-z\\s\\-''\\.]{{1,40}}$')",
    "state": f"{strip('state')} IN ({CODES})",
    "postal": f"regexp_matches({strip('postal')}, '{POSTAL_PATTERN}')",
    "country": f"regexp_matches({strip('country')}, '^[A-Z]{{2}}$')",
    "phone": "length(regexp_replace(phone, '\\D', '', 'g')) BETWEEN 7 AND 20",
    "day": f"coalesce({date(strip('day'), FOUR)} <= DATE '{AS_OF}', false)",
    "license": f"regexp_matches({strip('license')}, '^[A-Za-z0-9]{{1,25}}$')",
    "switch": f"{strip('switch')} IN ('Y', 'N')",
    "amount": f"regexp_matches(lower({strip('amount')}), '{FLOAT}')",
}
LONG = ", cells AS (" + " UNION ALL ".join(f"SELECT k, {i} AS position, '{h}' AS column_name, {c} AS value, {missing(c)} AS nul, NOT {missing(c)} AND coalesce({OK[c]}, false) AS ok FROM v" for i, (c, h) in enumerate(HEADERS.items())) + ")"
LAST, FIRST, ORG = (f"'{NAME_COLUMNS[i]}'" for i in range(3))
ET_INT = f"CASE WHEN {missing('et')} THEN NULL ELSE CAST(trunc(TRY_CAST({strip('et')} AS DOUBLE)) AS INTEGER) END"
NEED = f"""(CASE WHEN column_name IN ({LAST}, {FIRST}) THEN CASE WHEN e = 1 THEN NOT nul WHEN e = 2 THEN true ELSE false END
    WHEN column_name = {ORG} THEN CASE WHEN e = 2 THEN NOT nul WHEN e = 1 THEN true ELSE false END ELSE NOT nul END)"""
METRICS = (
    LONG
    + f""", typed AS (SELECT c.*, {ET_INT.replace('et', 't.et')} AS e FROM cells c JOIN (SELECT k, et FROM v) t USING (k)), metrics AS (
    SELECT position, column_name, count(*) AS total_count, count(*) FILTER (WHERE NOT nul) AS non_null_count, count(*) FILTER (WHERE nul) AS null_count,
        count(DISTINCT value) AS unique_count, count(*) - count(DISTINCT value) AS duplicate_count, count(*) FILTER (WHERE ok) AS conforming_count,
        count(*) FILTER (WHERE NOT nul AND NOT ok) AS non_conforming_count,
        100.0::DOUBLE * count(*) FILTER (WHERE coalesce({NEED}, false)) / count(*) AS completeness_score,
        CASE WHEN column_name = 'NPI' THEN 100.0::DOUBLE * count(DISTINCT value) / count(*) END AS uniqueness_score,
        coalesce(100.0::DOUBLE * count(*) FILTER (WHERE ok) / nullif(count(*) FILTER (WHERE NOT nul), 0), 0) AS conformity_score,
        CAST(min(length(value)) AS INTEGER) AS min_length, CAST(max(length(value)) AS INTEGER) AS max_length, avg(length(value)) AS avg_length,
        count(*) FILTER (WHERE e = 1 AND nul AND column_name IN ({LAST}, {FIRST})) AS people, count(*) FILTER (WHERE e = 2 AND nul AND column_name = {ORG}) AS firms
    FROM typed GROUP BY position, column_name)"""
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(nulls.quoted(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else nulls.quoted(f.name) for f in df.schema])


def only(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.select(*names))


# --- nulls and rules


@query(f"{V} SELECT k, {missing('npi')} AS npi_null, {missing('ein')} AS ein_null, {missing('last_name')} AS last_null, {missing('org')} AS org_null FROM v")
def null_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dirty(spark, sf_dir)
    return d.select("k", nulls.is_null_like(F.col("npi"), "NPI").alias("npi_null"), nulls.is_null_like(F.col("ein"), EIN).alias("ein_null"), nulls.is_null_like(F.col("last_name")).alias("last_null"), nulls.is_null_like(F.col("org")).alias("org_null"))


@query(f"{V} SELECT count(*) FILTER (WHERE NOT {missing('npi')}) AS npi, count(*) FILTER (WHERE NOT {missing('ein')}) AS ein, count(*) FILTER (WHERE NOT {missing('phone')}) AS phone FROM v")
def null_like_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).agg(nulls.non_null_count(F.col("npi")).alias("npi"), nulls.non_null_count(F.col("ein"), EIN).alias("ein"), nulls.non_null_count(F.col("phone")).alias("phone"))


def _conformity(column: str, rule: Rule) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(validate.validate_column(dirty(spark, sf_dir), column, Rule(rule.rule_id, column, rule.rule_type, rule.rule_config), AS_OF).drop("rule_id"))

    return run


for _name, _c in {"regex": "npi", "enum": "state", "length": "org", "numeric": "amount", "date": "day", "phone": "phone"}.items():
    QUERIES[f"conformity_{_name}"] = _conformity(_c, NUMERIC if _c == "amount" else RULES[HEADERS[_c]])
    _good = f"NOT {missing(_c)} AND coalesce({OK[_c]}, false)"
    ORACLES[f"conformity_{_name}"] = f"""{V} SELECT '{_c}' AS column_name, count(*) AS total_count, count(*) FILTER (WHERE NOT {missing(_c)}) AS non_null_count, count(*) FILTER (WHERE {_good}) AS conforming_count,
        count(*) FILTER (WHERE NOT {missing(_c)}) - count(*) FILTER (WHERE {_good}) AS non_conforming_count,
        round(100.0::DOUBLE * count(*) FILTER (WHERE {_good}) / count(*) FILTER (WHERE NOT {missing(_c)}), 6) AS conformity_score FROM v"""


@query(f"{V} SELECT k, " + ", ".join(f"NOT {missing(c)} AND coalesce({OK[c]}, false) AS {c}" for c in HEADERS) + " FROM v")
def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dirty(spark, sf_dir)
    return d.select("k", *[rules.conforms(F.col(c), RULES[h], h, AS_OF).alias(c) for c, h in HEADERS.items()])


@query(f"{V}{METRICS} SELECT column_name, people AS n_individual, firms AS n_organization, round(completeness_score, 6) AS completeness_score FROM metrics WHERE column_name IN ({LAST}, {FIRST}, {ORG})")
def conditional_completeness_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = providers(spark, sf_dir)
    found = profile.conditional_counts(d)
    return rounded(found.join(profile.metrics(d, RULES, as_of=AS_OF), "column_name").select("column_name", "n_individual", "n_organization", "completeness_score"))


# --- profiles

_METRIC_COLUMNS = ("column_name", "total_count", "non_null_count", "null_count", "unique_count", "duplicate_count", "conforming_count", "non_conforming_count", "completeness_score", "uniqueness_score", "conformity_score", "min_length", "max_length", "avg_length")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" if c.endswith("_score") or c == "avg_length" else c for c in _METRIC_COLUMNS)


@query(f"{V}{METRICS} SELECT {_ROUNDED} FROM metrics")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(profile.metrics(providers(spark, sf_dir), RULES, as_of=AS_OF), *_METRIC_COLUMNS)


_PLAIN = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM orders" for c in _PLAIN)
    + f") SELECT column_name, count(*) AS total_count, count(*) FILTER (WHERE NOT {missing('value')}) AS non_null_count, count(DISTINCT value) AS unique_count, round(avg(length(value)), 6) AS avg_length FROM c GROUP BY 1"
)
def plain_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(*_PLAIN)
    return only(profile.metrics(d, {}), "column_name", "total_count", "non_null_count", "unique_count", "avg_length")


@query("""WITH c AS (SELECT 'p_brand' AS column_name, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
    n AS (SELECT column_name, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY ALL)
    SELECT column_name, value, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM n) WHERE r <= 5""")
def top5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size")
    return profile.top_values(profile.histogram(d)).select("column_name", "value", "n", "rank")


@query(f"{V} SELECT count(*) AS total_count, count(DISTINCT npi) AS unique_count, count(*) - count(DISTINCT npi) AS duplicate_count, round(100.0::DOUBLE * count(DISTINCT npi) / count(*), 6) AS uniqueness_score FROM v")
def uniqueness_npi(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = profile.metrics(providers(spark, sf_dir).select(ROW, "NPI"), RULES, as_of=AS_OF)
    return only(m, "total_count", "unique_count", "duplicate_count", "uniqueness_score")


@query("SELECT count(*) AS total_count, count(DISTINCT (l_orderkey, l_linenumber)) AS unique_count FROM lineitem")
def uniqueness_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"))
    return profile.metrics(d, {}).select("total_count", "unique_count")


@query(f"{V}{METRICS} SELECT 'providers' AS dataset_name, max(total_count) AS total_rows, CAST(count(*) AS INTEGER) AS total_columns, round(avg(completeness_score), 6) AS overall_completeness, round(max(uniqueness_score), 6) AS overall_uniqueness, round(avg(conformity_score), 6) AS overall_conformity FROM metrics")
def dataset_profile_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.dataset_profile(profile.metrics(providers(spark, sf_dir), RULES, as_of=AS_OF), dataset_name="providers"))


@query(f"{V}{METRICS} SELECT round(100.0::DOUBLE * sum(non_null_count) / sum(total_count), 6) AS overall_completeness, round(100.0::DOUBLE * sum(conforming_count) / sum(non_null_count), 6) AS overall_conformity FROM metrics")
def dataset_profile_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(profile.dataset_profile(profile.metrics(providers(spark, sf_dir), RULES, as_of=AS_OF), weighting="cells"), "overall_completeness", "overall_conformity")


_BAD = "SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY k) AS INTEGER) AS position, k AS row_index, value FROM cells WHERE NOT nul AND NOT ok"


@query(f"{V}{LONG} SELECT * FROM ({_BAD}) WHERE position <= 10")
def first_n_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.violations(providers(spark, sf_dir), RULES, 10, as_of=AS_OF)


@query(f"{V}{METRICS} SELECT column_name, non_conforming_count FROM metrics WHERE conformity_score < 95")
def critical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.critical_columns(profile.metrics(providers(spark, sf_dir), RULES, as_of=AS_OF)).select("column_name", "non_conforming_count")


@query(f"""{V}{METRICS} SELECT column_name, CASE WHEN uniqueness_score IS NULL THEN 'none' WHEN uniqueness_score = 100 THEN 'perfect' WHEN uniqueness_score >= 90 THEN 'good' ELSE 'poor' END AS uniqueness,
    CASE WHEN conformity_score = 100 THEN 'perfect' WHEN conformity_score >= 90 THEN 'good' ELSE 'poor' END AS conformity, CASE WHEN completeness_score >= 90 THEN 'good' WHEN completeness_score >= 70 THEN 'fair' ELSE 'poor' END AS completeness FROM metrics""")
def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = profile.metrics(providers(spark, sf_dir), RULES, as_of=AS_OF)
    return m.select("column_name", reports.quality_band(F.col("uniqueness_score")).alias("uniqueness"), reports.quality_band(F.col("conformity_score")).alias("conformity"), reports.completeness_band(F.col("completeness_score")).alias("completeness"))


# --- issues

ISSUES = (
    METRICS
    + f""", listed AS (SELECT column_name, list(value ORDER BY k) AS ex FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY k) AS r FROM cells WHERE NOT nul AND NOT ok) WHERE r <= 5 GROUP BY 1),
    found AS (
    SELECT position * 10 + s AS seq, column_name, kind AS issue_type, n AS count, p AS percentage, rule, CASE WHEN s IN (4, 6) THEN coalesce(ex, []) ELSE [] END AS examples FROM (
        SELECT *, 0 AS s, 'completeness' AS kind, null_count AS n, 100 - completeness_score AS p, column_name || '_REQUIRED' AS rule FROM metrics WHERE completeness_score < 100 AND column_name IN ('NPI', '{ENTITY_TYPE}')
        UNION ALL SELECT *, 1, 'completeness', people, 100.0::DOUBLE * people / total_count, column_name || '_REQUIRED_FOR_INDIVIDUAL' FROM metrics WHERE people > 0
        UNION ALL SELECT *, 2, 'completeness', firms, 100.0::DOUBLE * firms / total_count, column_name || '_REQUIRED_FOR_ORGANIZATION' FROM metrics WHERE firms > 0
        UNION ALL SELECT *, 3, 'completeness', null_count, 100 - completeness_score, column_name || '_NOT_NULL' FROM metrics WHERE completeness_score < 100 AND column_name NOT IN ('NPI', '{ENTITY_TYPE}', {LAST}, {FIRST}, {ORG})
        UNION ALL SELECT *, 4, 'conformity', non_conforming_count, 100.0::DOUBLE * non_conforming_count / non_null_count, 'rule' FROM metrics WHERE non_conforming_count > 0
        UNION ALL SELECT *, 5, 'uniqueness', duplicate_count, 100.0::DOUBLE * duplicate_count / total_count, 'NPI_UNIQUE' FROM metrics WHERE column_name = 'NPI' AND duplicate_count > 0
        UNION ALL SELECT *, 6, 'conformity', non_conforming_count, 100 - conformity_score, 'rule' FROM metrics WHERE conformity_score < 95
    ) i LEFT JOIN listed USING (column_name)
    UNION ALL SELECT 1073741824, '__DATASET__', 'completeness', 0, 100 - avg(completeness_score), NULL, [] FROM metrics HAVING avg(completeness_score) < 85)"""
)


def _issues(spark: SparkSession, sf_dir: str) -> tuple[profile.Profile, DataFrame]:
    found = profile.profile(providers(spark, sf_dir), RULES, as_of=AS_OF)
    return found, issues.detect(found, RULES)


@query(f"{V}{ISSUES} SELECT column_name, issue_type, CAST(count AS BIGINT) AS count, round(percentage, 6) AS percentage, CASE WHEN rule = 'rule' THEN NULL ELSE rule END AS rule_violated, array_to_string(examples, '|') AS examples FROM found")
def issues_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("issue_type") != "conformity", F.col("rule_violated"))
    return rounded(_issues(spark, sf_dir)[1].select("column_name", "issue_type", "count", "percentage", rule.alias("rule_violated"), F.array_join("examples", "|").alias("examples")))


@query(f"{V}{ISSUES} SELECT column_name, issue_type, CAST(count(*) AS BIGINT) AS merged, CAST(sum(count) AS BIGINT) AS count, round(avg(percentage), 6) AS percentage, array_to_string(flatten(list(examples ORDER BY seq))[1:5], '|') AS examples FROM found GROUP BY 1, 2")
def issue_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(issues.consolidate(_issues(spark, sf_dir)[1]).select("column_name", "issue_type", "merged", "count", "percentage", F.array_join("examples", "|").alias("examples")))


@query(f"{V}{ISSUES} SELECT issue_type, count(*) AS n FROM found GROUP BY 1")
def issues_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_kind(_issues(spark, sf_dir)[1], "issue_type")


# --- validation

_RATE = "coalesce(100.0::DOUBLE * conforming_count / nullif(non_null_count, 0), 100)"


@query(f"{V}{METRICS} SELECT column_name, total_count, non_null_count, null_count, conforming_count, non_conforming_count, round({_RATE}, 6) AS conformity_rate, (SELECT coalesce(string_agg(value, '; ' ORDER BY position), '') FROM ({_BAD}) b WHERE b.column_name = m.column_name AND b.position <= 3) AS samples FROM metrics m")
def bulk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.validate_dataset(providers(spark, sf_dir), RULES, as_of=AS_OF)
    return rounded(found.select("column_name", "total_count", "non_null_count", "null_count", "conforming_count", "non_conforming_count", "conformity_rate", F.concat_ws("; ", "samples").alias("samples")))


@query(f"{V}{METRICS} SELECT round(100.0::DOUBLE * sum(conforming_count) / sum(non_null_count), 6) AS overall_conformity_rate, round(avg({_RATE}), 6) AS average_column_rate, CAST(sum(non_conforming_count) AS BIGINT) AS total_violations, count(*) AS columns_validated, CAST(sum(total_count) AS BIGINT) AS cells FROM metrics")
def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validate.overall(validate.validate_dataset(providers(spark, sf_dir), RULES, as_of=AS_OF)))


@query(f"{V}{METRICS} SELECT column_name, non_conforming_count FROM metrics WHERE non_conforming_count > 0 ORDER BY 2 DESC, 1 LIMIT 5")
def worst_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.worst_columns(validate.validate_dataset(providers(spark, sf_dir), RULES, as_of=AS_OF), 5).select("column_name", "non_conforming_count")


# --- history and anomalies: a day's events of one type as a column's run

POINTS = "WITH points AS (SELECT 'events' AS dataset_name, event_type AS column_name, 'completeness' AS metric, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS profiling_timestamp, 'run' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, 100.0::DOUBLE * count(*) FILTER (WHERE value > 20) / count(*) AS value FROM events GROUP BY event_type, CAST(ts AS DATE))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("column_name"), F.to_date("ts").alias("d")).agg((100.0 * F.count_if(F.col("value") > 20) / F.count("*")).alias("value"))
    return e.select(F.lit("events").alias("dataset_name"), "column_name", F.lit("completeness").alias("metric"), F.col("d").cast("timestamp_ntz").alias("profiling_timestamp"), F.concat(F.lit("run"), F.col("d").cast("string")).alias("run_id"), "value")


_LAST_DAY = "SELECT * FROM points WHERE profiling_timestamp = (SELECT max(profiling_timestamp) FROM points)"
_BASE = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY profiling_timestamp) AS r FROM points WHERE profiling_timestamp < (SELECT max(profiling_timestamp) FROM points)),
    base AS (SELECT column_name, count(*) AS history_size, CASE WHEN min(value) = max(value) THEN min(value) ELSE avg(value) END AS baseline_value, CASE WHEN min(value) = max(value) THEN 0 ELSE stddev_pop(value) END AS baseline_std FROM ranked WHERE r <= 50 GROUP BY 1)"""
_JUDGE = """, z AS (SELECT *, value - baseline_value AS delta, abs(value - baseline_value) / nullif(baseline_std, 0) AS z_score FROM {rows} WHERE history_size >= 3),
    hit AS (SELECT *, CASE WHEN abs(delta) >= 4 OR z_score >= 2.25 THEN 'high' WHEN abs(delta) >= 2.4 OR z_score >= 1.5 THEN 'medium' ELSE 'low' END AS severity FROM z WHERE delta <= 0 AND (abs(delta) >= 2 OR z_score >= 1.5))"""
TIGHT = anomaly.Settings(z_limit=1.5, limits={"completeness": 2.0, "uniqueness": 1.0, "conformity": 2.0})


@query(POINTS + " SELECT column_name, run_id, round(value, 6) AS value FROM points")
def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(points(spark, sf_dir), "column_name", "run_id", "value")


@query(POINTS + " SELECT arg_max(run_id, profiling_timestamp) AS run_id FROM points")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).agg(F.max_by("run_id", F.struct("profiling_timestamp", "run_id")).alias("run_id"))


@query(POINTS + _BASE + " SELECT column_name, history_size, round(baseline_value, 6) AS baseline_value, round(baseline_std, 6) AS baseline_std FROM base")
def history_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    last = p.agg(F.max("profiling_timestamp").alias("t"))
    return only(anomaly.baseline(p.join(last, F.col("profiling_timestamp") < F.col("t")).drop("t")), "column_name", "history_size", "baseline_value", "baseline_std")


@query(POINTS + _BASE + _JUDGE.format(rows=f"({_LAST_DAY}) JOIN base USING (column_name)") + " SELECT column_name, round(value, 6) AS current_value, round(baseline_value, 6) AS baseline_value, round(delta, 6) AS delta, round(z_score, 6) AS z_score, severity FROM hit")
def anomaly_delta_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    last = F.broadcast(p.agg(F.max("profiling_timestamp").alias("t")))
    now = p.join(last, F.col("profiling_timestamp") == F.col("t")).drop("t")
    before = p.join(last, F.col("profiling_timestamp") < F.col("t")).drop("t")
    return only(anomaly.detect(now, before, TIGHT), "column_name", "current_value", "baseline_value", "delta", "z_score", "severity")


_RUNNING = """, w AS (SELECT *, count(*) OVER e AS history_size, CASE WHEN min(value) OVER e = max(value) OVER e THEN min(value) OVER e ELSE avg(value) OVER e END AS baseline_value,
    CASE WHEN min(value) OVER e = max(value) OVER e THEN 0 ELSE stddev_pop(value) OVER e END AS baseline_std FROM points WINDOW e AS (PARTITION BY column_name ORDER BY profiling_timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(POINTS + _RUNNING + _JUDGE.format(rows="w") + " SELECT column_name, run_id, round(delta, 6) AS delta, round(z_score, 6) AS z_score, severity FROM hit")
def anomaly_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(anomaly.detect_all(points(spark, sf_dir), TIGHT), "column_name", "run_id", "delta", "z_score", "severity")


@query(POINTS + " SELECT column_name, count(*) AS points, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most, min(value) = max(value) AS stable FROM points GROUP BY 1")
def stability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.stability(points(spark, sf_dir)))


@query(POINTS + " SELECT column_name, count(*) AS runs FROM points GROUP BY 1")
def runs_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.runs_per_column(points(spark, sf_dir))


@query(POINTS + " SELECT column_name, count(DISTINCT run_id) AS runs, count(DISTINCT run_id) >= 3 AS enough FROM points GROUP BY 1")
def covered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.covered_columns(points(spark, sf_dir))


@query(POINTS + " SELECT (SELECT count(DISTINCT run_id) FROM points) AS run_count, (SELECT count(*) FROM points) AS metric_count, (SELECT count(*) FROM points WHERE value < 50) AS issue_count, (SELECT count(*) FROM points WHERE value < 80) AS anomaly_count, (SELECT count(DISTINCT dataset_name) FROM points) AS dataset_count")
def db_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return reports.statistics(p.select("dataset_name", "run_id").distinct(), p, p.where("value < 50"), p.where("value < 80"))


@query(POINTS + " SELECT dataset_name, count(DISTINCT run_id) AS runs FROM points GROUP BY 1")
def runs_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.runs_per_dataset(points(spark, sf_dir).select("dataset_name", "run_id").distinct())


@query(POINTS + " SELECT column_name, run_id FROM points WHERE column_name = (SELECT min(column_name) FROM points) ORDER BY profiling_timestamp DESC LIMIT 10")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return reports.recent(p.join(F.broadcast(p.agg(F.min("column_name").alias("column_name"))), "column_name"), "profiling_timestamp").select("column_name", "run_id")


@query("""WITH runs AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, count(*) FILTER (WHERE event_id % 3 > 0 OR day(ts) % 7 = 0) * CASE WHEN day(ts) % 7 = 0 THEN 3 ELSE 1 END AS total_rows FROM events GROUP BY CAST(ts AS DATE), day(ts)),
    r AS (SELECT *, row_number() OVER (ORDER BY total_rows) AS r, count(*) OVER () AS n FROM runs)
    SELECT run_id, CAST(total_rows AS BIGINT) AS total_rows FROM r WHERE total_rows > 2.0 * (SELECT max(total_rows) FILTER (WHERE r = n // 2 + 1) FROM r)""")
def outlier_runs_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.dayofmonth("ts") % 7 == 0
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d"), week.alias("w")).agg(F.count_if((F.col("event_id") % 3 > 0) | week).alias("n"))
    runs = e.select(F.col("d").cast("string").alias("run_id"), (F.col("n") * F.when(F.col("w"), 3).otherwise(1)).alias("total_rows"))
    return reports.outlier_runs(runs).select("run_id", "total_rows")


# --- repairs of values


def _fixer(name: str, sql: str, made: Callable[[], dict[str, Column]]) -> None:
    QUERIES[name] = lambda spark, sf_dir: dirty(spark, sf_dir).select("k", *[c.alias(n) for n, c in made().items()])
    ORACLES[name] = f"{V} {sql}"


def _rule(c: str) -> Rule:
    return RULES[HEADERS[c]]


_digits = lambda c: f"regexp_replace({c}, '\\D', '', 'g')"
_NAMES = ", ".join(f"('{n}', '{c}')" for n, c in (states.STATES | states.MORE_NAMES).items())
_CODE = f"coalesce(CASE WHEN upper({strip('state')}) IN ({PLAIN_CODES}) THEN upper({strip('state')}) END, (SELECT c FROM (VALUES {_NAMES}) t(n, c) WHERE n = upper({strip('state')})))"
_fixer("fix_enum", f"SELECT k, CASE upper({strip('switch')}) WHEN 'Y' THEN 'Y' WHEN 'N' THEN 'N' END AS switch, CASE WHEN {WHOLE_ET} IN ('1', '2') THEN {WHOLE_ET} END AS et, {_CODE} AS state FROM v", lambda: {"switch": fixes.fix_enum(F.col("switch"), _rule("switch"), HEADERS["switch"]), "et": fixes.fix_enum(F.col("et"), _rule("et"), ENTITY_TYPE), "state": fixes.fix_enum(F.col("state"), _rule("state"), HEADERS["state"])})
_fixer(
    "fix_regex_id",
    f"""SELECT k, CASE WHEN length({_digits('npi')}) > 0 THEN lpad({_digits('npi')}[1:10], 10, '0') END AS npi,
    CASE WHEN upper({strip('ein')}) = '<UNAVAIL>' THEN '<UNAVAIL>' WHEN length({_digits('ein')}) >= 9 THEN {_digits('ein')}[1:9] END AS ein,
    CASE WHEN length(regexp_replace(license, '[^A-Za-z0-9]', '', 'g')) BETWEEN 1 AND 25 THEN regexp_replace(license, '[^A-Za-z0-9]', '', 'g') END AS license,
    CASE WHEN city LIKE '%, NY' THEN 'NY' ELSE regexp_replace(city, '[ ,.]+$', '') END AS city FROM v""",
    lambda: {
        "npi": fixes.fix_regex(F.col("npi"), _rule("npi"), "NPI"), "ein": fixes.fix_regex(F.col("ein"), _rule("ein"), EIN), "license": fixes.fix_regex(F.col("license"), _rule("license"), HEADERS["license"]),
        "city": fixes.fix_regex(F.col("city"), _rule("city"), HEADERS["city"], address_states=[*states.CODES, *states.MILITARY]),
    },
)
_cleaned = f"regexp_replace({strip('postal')}, '[^\\d-]', '', 'g')"
_norm = _digits("regexp_replace(replace(postal, '.0', ''), '[. _-]', '', 'g')")
_normal = f"CASE WHEN length({_norm}) = 0 THEN NULL WHEN length({_norm}) <= 5 THEN lpad({_norm}, 5, '0') WHEN length({_norm}) <= 8 THEN {_norm} ELSE {_norm}[1:5] END"
_fixer("fix_postal", f"SELECT k, CASE WHEN regexp_matches({_cleaned}, '{POSTAL_PATTERN}') THEN {_cleaned} END AS fixed, {_normal} AS normal FROM v", lambda: {"fixed": fixes.fix_regex(F.col("postal"), _rule("postal"), HEADERS["postal"]), "normal": states.normal_postal_code(F.col("postal"))})
_SHORT = Rule("S", "org", "length", {"min": 2, "max": 12})
_fixer("fix_length", f"SELECT k, CASE WHEN length({strip('org')}) >= 2 THEN {strip('org')}[1:12] END AS org FROM v", lambda: {"org": fixes.fix_length(F.col("org"), _SHORT)})
_fixer("fix_phone", f"SELECT k, CASE WHEN length({_digits('phone')}) >= 7 THEN {_digits('phone')}[1:20] END AS phone FROM v", lambda: {"phone": fixes.fix_phone(F.col("phone"), _rule("phone"))})
_ISO = f"regexp_matches(day, '^\\d{{4}}-') AND {date('day', ('%Y-%m-%d',))} IS NOT NULL"
_fixer("fix_date", f"SELECT k, CASE WHEN {date('day', SEVEN)} <= DATE '{AS_OF}' THEN CASE WHEN {_ISO} THEN strftime({date('day', SEVEN)}, '%Y-%m-%d') ELSE strftime({date('day', SEVEN)}, '%m/%d/%Y') END END AS day FROM v", lambda: {"day": fixes.fix_date(F.col("day"), _rule("day"), AS_OF)})
_fixer("fix_numeric", "SELECT k, CASE k % 7 WHEN 0 THEN '1234.5' WHEN 1 THEN '5.0' WHEN 2 THEN '1000.0' WHEN 3 THEN NULL WHEN 4 THEN '-0.25' WHEN 5 THEN '1000.0' ELSE 'nan' END AS amount FROM v", lambda: {"amount": fixes.fix_numeric(F.col("amount"))})
_fixer("name_degree_split", "SELECT k, CASE last_name WHEN 'Smith, MD' THEN 'Smith' WHEN 'Wood, M.D., PhD' THEN 'Wood, M.D.' END AS name, CASE last_name WHEN 'Smith, MD' THEN 'MD' WHEN 'Wood, M.D., PhD' THEN 'PhD' END AS degree FROM v", lambda: {x: fixes.split_name_and_degree(F.col("last_name"))[x] for x in ("name", "degree")})
_fixer("state_name_to_code", f"SELECT k, {_CODE} AS code FROM v", lambda: {"code": states.state_code(F.col("state"))})
_ZIPS = ", ".join(f"('{z}', '{s}')" for z, s in states.ZIP3.items())
_ORDERED = ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate(states.STATES.items()))
_ADDRESS = "concat_ws(' ', addr1, addr2)"
_STATE_SQL = f"""coalesce((SELECT c FROM (VALUES {_NAMES}) t(n, c) WHERE n = upper({strip('state')}) AND n NOT LIKE 'U%S%VIRGIN%'), CASE WHEN upper({strip('state')}) IN ({PLAIN_CODES}) THEN upper({strip('state')}) END,
    (SELECT arg_min(c, i) FROM (VALUES {_ORDERED}) t(i, n, c) WHERE contains(upper({_ADDRESS}), n)), (SELECT s FROM (VALUES {_ZIPS}) t(z, s) WHERE z = ({_normal})[1:3]))"""
_fixer("infer_state_zip3", f"SELECT k, {_STATE_SQL} AS code FROM v", lambda: {"code": states.infer_state(F.col("state"), address=states.joined_address(F.col("addr1"), F.col("addr2")), postal_code=F.col("postal"))})
_fixer(
    "foreign_postal",
    "SELECT k, coalesce(CASE WHEN country = 'US' THEN false WHEN regexp_matches(upper(postal), '^[A-Z]\\d[A-Z]\\s?\\d[A-Z]\\d$') THEN coalesce(country = 'CA', true) ELSE regexp_matches(upper(postal), '[A-Z]') END, false) AS is_foreign FROM v",
    lambda: {"is_foreign": states.foreign_postal(F.col("postal"), F.col("country"))},
)
_CITY = "CASE k % 5 WHEN 0 THEN 'SPRINGFIELD' WHEN 3 THEN 'COLUMBUS OHIO' WHEN 4 THEN 'BOSTON' END"
_fixer("infer_city_from_address", f"SELECT k, CASE WHEN k % 5 = 1 THEN NULL ELSE {_CITY} END AS city FROM v", lambda: {"city": states.infer_city(F.when(F.col("k") % 5 != 1, F.col("addr1")))})


# --- lookups


@query(f"{V}, m AS (SELECT DISTINCT CASE n_nationkey % 6 WHEN 3 THEN 'ONTARIO' ELSE upper(n_name) END AS s, CASE WHEN n_nationkey % 2 = 1 THEN 'CA' ELSE 'MX' END AS c FROM nation) SELECT k, coalesce(country <> 'US' AND EXISTS (SELECT 1 FROM m WHERE s = upper(state) AND c = country), false) AS is_foreign FROM v")
def foreign_state_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    pairs = n.select(F.when(F.col("n_nationkey") % 6 == 3, "ONTARIO").otherwise(F.upper("n_name")).alias("state"), F.when(F.col("n_nationkey") % 2 == 1, "CA").otherwise("MX").alias("country")).distinct()
    return reference.foreign_state(dirty(spark, sf_dir), F.col("state"), F.col("country"), pairs, "is_foreign").select("k", "is_foreign")


@query(f"{V}, m AS (SELECT lpad(CAST(60000 + n_nationkey * 601 AS VARCHAR), 5, '0') AS z, upper(n_name) AS s FROM nation) SELECT k, coalesce((SELECT s FROM m WHERE z = ({_normal})), CASE WHEN length({_normal}) >= 5 THEN (SELECT s FROM m WHERE z = ({_normal})[1:5]) END, (SELECT s FROM (SELECT z[1:3] AS z3, arg_max(s, z) AS s FROM m GROUP BY 1) WHERE z3 = ({_normal})[1:3])) AS state FROM v")
def postal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.lpad((60000 + F.col("n_nationkey") * 601).cast("string"), 5, "0").alias("z"), F.upper("n_name").alias("s"))
    short = n.groupBy(F.left("z", F.lit(3)).alias("code")).agg(F.max_by("s", "z").alias("state"))
    maps = n.select(F.col("z").alias("code"), F.col("s").alias("state")).unionByName(short)
    return reference.postal_lookup(dirty(spark, sf_dir), states.normal_postal_code(F.col("postal")), maps, "state_found").select("k", F.col("state_found").alias("state"))


@query(f"{V}, m AS (SELECT 'BOSTON' AS city, 'MA' AS s UNION ALL SELECT 'CHICAGO', 'IL') SELECT k, s AS state FROM v LEFT JOIN m ON upper({strip('v.city')}) = m.city")
def city_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = spark.createDataFrame([("BOSTON", "MA"), ("CHICAGO", "IL")], "city string, state string")
    return reference.lookup(dirty(spark, sf_dir), F.upper(nulls.strip(F.col("city"))), cities, "city", "state", "found").select("k", F.col("found").alias("state"))


# --- recommendations

_IMPUTED = f"CASE WHEN {missing('et')} THEN CASE WHEN NOT {missing('org')} THEN '2' WHEN NOT {missing('last_name')} OR NOT {missing('first_name')} THEN '1' END END"


@query(f"{V} SELECT k AS row_index, {_IMPUTED} AS et FROM v WHERE {missing('et')}")
def entity_type_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = providers(spark, sf_dir)
    return d.where(nulls.is_null_like(F.col(ENTITY_TYPE))).select(ROW, recommend.imputed_entity_type(d).alias("et"))


@query(f"""{V}, c AS (SELECT count(*) FILTER (WHERE {missing('et')}) AS n_missing, count(*) FILTER (WHERE {_IMPUTED} = '2') AS n_organization, count(*) FILTER (WHERE {_IMPUTED} = '1') AS n_individual FROM v),
    r AS (SELECT *, (n_organization + n_individual)::DOUBLE / n_missing AS ratio FROM c)
    SELECT n_missing, n_organization, n_individual, round(ratio, 6) AS ratio, round(CASE WHEN ratio >= 0.85 THEN 0.85 + (ratio - 0.85) * (0.10 / 0.15) ELSE 0.85 * ratio END, 6) AS confidence FROM r""")
def entity_type_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recommend.entity_type_counts(providers(spark, sf_dir)))


_FIXABLE = {
    "npi": f"length({_digits('value')}) >= 10", "ein": f"length({_digits('value')}) >= 9", "phone": f"length({_digits('value')}) >= 7", "day": f"{date('value', SEVEN)} IS NOT NULL", "org": "false",
    "switch": "lower(value) IN ('y', 'n')", "state": f"upper(value) IN ({_NAMES.replace('(', '').replace(')', '')}) OR (upper(value) IN ({CODES}) AND value <> upper(value))",
}


@query(
    f"{V}{LONG}, a AS ("
    + " UNION ALL ".join(f"SELECT '{HEADERS[c]}' AS column_name, count(*) AS n_analyzed, count(*) FILTER (WHERE {f}) AS n_fixable FROM ({_BAD}) WHERE column_name = '{HEADERS[c]}' AND position <= 10" for c, f in _FIXABLE.items())
    + ") SELECT column_name, n_analyzed, n_fixable, CAST(CASE WHEN n_fixable::DOUBLE / n_analyzed >= 0.8 THEN 0.90 WHEN n_fixable::DOUBLE / n_analyzed >= 0.6 THEN 0.85 WHEN n_fixable::DOUBLE / n_analyzed >= 0.4 THEN 0.75 ELSE 0.65 END AS DOUBLE) AS confidence FROM a"
)
def recommend_conformity_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = {HEADERS[c]: RULES[HEADERS[c]] for c in _FIXABLE}
    bad = profile.violations(providers(spark, sf_dir), some, 10, as_of=AS_OF)
    found = recommend.analyzed(bad, some)
    return found.select("column_name", "n_analyzed", "n_fixable", recommend.confidence(F.col("n_fixable") / F.col("n_analyzed")).alias("confidence"))


@query(f"""{V}{ISSUES} SELECT column_name, issue_type, CAST(arg_min(count, seq) AS BIGINT) AS issue_count, CAST(CASE issue_type WHEN 'conformity' THEN 0.6 ELSE 0.8 END AS DOUBLE) AS confidence_score FROM found WHERE issue_type IN ('conformity', 'uniqueness') GROUP BY 1, 2""")
def recommendation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.recommend(_issues(spark, sf_dir)[1], None, RULES).select("column_name", "issue_type", "issue_count", "confidence_score")


@query()
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, seen = _issues(spark, sf_dir)
    return rounded(recommend.recommend(seen, found.metrics, RULES, providers(spark, sf_dir)).drop("seq"))


_COLLAPSED = f"regexp_replace({strip('value')}, '\\s+', ' ', 'g')"
_ALNUM = "upper(regexp_replace(value, '[^A-Za-z0-9]', '', 'g'))"
_PATTERNS = {c: RULES[HEADERS[c]].rule_config["pattern"].replace("'", "''") for c in ("npi", "ein", "last_name", "city", "postal", "license")}
_SPACED = {c: f"({_COLLAPSED} <> {strip('value')} AND regexp_matches({_COLLAPSED}, '^(?:{p})'))" for c, p in _PATTERNS.items()}
_REPAIRS = _FIXABLE | {
    **_SPACED,
    "npi": f"{_FIXABLE['npi']} OR {_SPACED['npi']}",
    "ein": f"{_FIXABLE['ein']} OR {_SPACED['ein']}",
    "postal": f"{_SPACED['postal']} OR regexp_matches({_digits('value')}, '^(?:{_PATTERNS['postal']})')",
    "license": f"{_SPACED['license']} OR ({_ALNUM} <> '' AND regexp_matches({_ALNUM}, '^(?:{_PATTERNS['license']})'))",
}
_ADVICE = f"""{ISSUES}, tried AS (SELECT column_name, count(*) AS k, count(*) FILTER (WHERE CASE column_name {' '.join(f"WHEN '{HEADERS[c]}' THEN ({r})" for c, r in _REPAIRS.items())} ELSE false END) AS f
        FROM (SELECT DISTINCT column_name, i, examples[i] AS value FROM (SELECT column_name, examples, unnest(range(1, len(examples) + 1)) AS i FROM found WHERE issue_type = 'conformity')) GROUP BY 1),
    told AS (SELECT count(*) FILTER (WHERE {missing('et')}) AS n_missing, count(*) FILTER (WHERE ({_IMPUTED}) IS NOT NULL) AS n_told FROM v),
    sure AS (SELECT CASE WHEN n_told::DOUBLE / n_missing >= 0.85 THEN 0.85 + (n_told::DOUBLE / n_missing - 0.85) * (0.10 / 0.15) ELSE 0.85 * n_told / n_missing END AS c FROM told),
    advice AS (SELECT *, CASE WHEN percentage < 5 THEN 'low' ELSE 'medium' END AS size,
        CASE WHEN issue_type = 'conformity' THEN 'format_correction' WHEN issue_type = 'uniqueness' THEN 'remove_duplicates'
             WHEN column_name = '{ENTITY_TYPE}' OR column_name IN ({LAST}, {FIRST}, {ORG}) THEN 'conditional_imputation'
             WHEN column_name IN ('{HEADERS['city']}', '{HEADERS['state']}', '{HEADERS['postal']}') THEN 'context_imputation'
             WHEN column_name = '{HEADERS['country']}' AND (SELECT completeness_score FROM metrics WHERE column_name = '{HEADERS['state']}') > 50 THEN 'default_imputation' END AS fix_strategy,
        CASE WHEN issue_type = 'conformity' THEN CASE WHEN k IS NULL THEN 0.6 WHEN f::DOUBLE / k >= 0.8 THEN 0.90 WHEN f::DOUBLE / k >= 0.6 THEN 0.85 WHEN f::DOUBLE / k >= 0.4 THEN 0.75 ELSE 0.65 END
             WHEN issue_type = 'uniqueness' THEN 0.95 WHEN column_name = '{ENTITY_TYPE}' THEN (SELECT c FROM sure) WHEN column_name = '{HEADERS['city']}' THEN 0.80 WHEN column_name = '{HEADERS['state']}' THEN 0.85 WHEN column_name = '{HEADERS['postal']}' THEN 0.70 ELSE 0.75 END AS confidence_score,
        CASE WHEN issue_type = 'conformity' THEN CASE WHEN f > 0 THEN 'low' ELSE 'medium' END WHEN issue_type = 'uniqueness' THEN 'high' WHEN percentage < 5 THEN 'low' ELSE 'medium' END AS estimated_impact,
        CASE WHEN issue_type = 'conformity' THEN coalesce(f > 0, false) WHEN issue_type = 'uniqueness' THEN false ELSE column_name IN ('{ENTITY_TYPE}', '{HEADERS['city']}', '{HEADERS['state']}', '{HEADERS['country']}') END AS actionable,
        CASE WHEN issue_type <> 'completeness' THEN NULL WHEN column_name = '{HEADERS['country']}' THEN 'US' WHEN column_name = '{ENTITY_TYPE}' THEN 'by row' END AS suggested
        FROM (SELECT found.*, k, f FROM found LEFT JOIN tried ON found.column_name = tried.column_name AND found.issue_type = 'conformity' AND len(examples) > 0)),
    first_advice AS (SELECT * FROM advice WHERE fix_strategy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY column_name, issue_type ORDER BY seq) = 1)"""


def _advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, seen = _issues(spark, sf_dir)
    return recommend.recommend(seen, found.metrics, RULES, providers(spark, sf_dir))


@query(f"{V}{_ADVICE} SELECT column_name, issue_type, CAST(count AS BIGINT) AS issue_count, fix_strategy, round(CAST(confidence_score AS DOUBLE), 6) AS confidence_score, estimated_impact, actionable, suggested FROM first_advice")
def recommendation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    suggested = F.when(F.col("suggested_value").startswith("Row-specific"), "by row").otherwise(F.col("suggested_value")).alias("suggested")
    return rounded(_advice(spark, sf_dir).select("column_name", "issue_type", "issue_count", "fix_strategy", "confidence_score", "estimated_impact", "actionable", suggested))


@query(f"{V}{_ADVICE} SELECT count(*) AS total, count(*) FILTER (WHERE actionable) AS actionable_count, count(*) FILTER (WHERE NOT actionable) AS requires_review_count, count(*) FILTER (WHERE estimated_impact = 'high') AS high_impact_count FROM first_advice")
def recommendation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.summary(_advice(spark, sf_dir))


@query(POINTS + _RUNNING + _JUDGE.format(rows="w") + " SELECT column_name, 'investigate_root_cause' AS fix_strategy, CAST(CASE WHEN severity = 'high' AND z_score > 3 THEN 0.9 WHEN severity = 'high' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence_score, severity AS estimated_impact, false AS actionable, count(*) AS n FROM hit GROUP BY ALL")
def anomaly_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recommend.for_anomalies(anomaly.detect_all(points(spark, sf_dir), TIGHT).withColumnRenamed("value", "current_value"))
    return reports.by_kind(found, "column_name", "fix_strategy", "confidence_score", "estimated_impact", "actionable")


# --- row-level repair

RECS = [
    repair.Recommendation(HEADERS["npi"], "conformity", "format_correction", 0.9), repair.Recommendation(HEADERS["last_name"], "conformity", "format_correction", 0.75), repair.Recommendation(HEADERS["state"], "conformity", "format_correction", 0.85),
    repair.Recommendation(HEADERS["postal"], "conformity", "format_correction", 0.75), repair.Recommendation(HEADERS["switch"], "conformity", "format_correction", 0.65),
    repair.Recommendation(ENTITY_TYPE, "completeness", "conditional_imputation", 0.9, True, "Row-specific"), repair.Recommendation(HEADERS["country"], "completeness", "default_imputation", 0.75, True, "US"),
    repair.Recommendation(HEADERS["city"], "completeness", "context_imputation", 0.8, True),
]
_N, _R = "CAST(NULL AS VARCHAR)", "'format_correction'"
_L = strip("last_name")
_POSTAL_FOREIGN = "(CASE WHEN country = 'US' THEN false WHEN regexp_matches(upper(postal), '^[A-Z]\\d[A-Z]\\s?\\d[A-Z]\\d$') THEN coalesce(country = 'CA', true) ELSE regexp_matches(upper(postal), '[A-Z]') END)"
_POSTAL_FIXED = f"CASE WHEN regexp_matches({_cleaned}, '{POSTAL_PATTERN}') THEN {_cleaned} END"
_NPI_FIXED = f"CASE WHEN length({_digits('npi')}) > 0 THEN lpad({_digits('npi')}[1:10], 10, '0') END"


def _audit(column: str, kind: str, original: str, value: str, strategy: str, confidence: float, reason: str, where: str) -> str:
    return f"SELECT k AS row_index, '{column}' AS \"column\", '{kind}' AS issue_type, {original} AS original_value, {value} AS recommended_value, {strategy} AS strategy, CAST({confidence} AS DOUBLE) AS confidence, {reason} AS reason FROM v WHERE {where}"


def _bad(c: str) -> str:
    return f"NOT {missing(c)} AND NOT coalesce({OK[c]}, false)"


_REPAIRABLE = {"npi": (_NPI_FIXED, "regex cleanup", 0.9), "switch": ("CASE upper(switch) WHEN 'Y' THEN 'Y' WHEN 'N' THEN 'N' END", "enum normalization", 0.65)}
_AUDIT = [_audit(HEADERS[c], "conformity", c, f"({f})", _R, conf, f"CASE WHEN ({f}) IS NULL THEN 'Need Review' ELSE '{r}' END", _bad(c)) for c, (f, r, conf) in _REPAIRABLE.items()]
_AUDIT += [
    _audit(HEADERS["state"], "conformity", "state", f"({_CODE})", _R, 0.85, f"CASE WHEN ({_CODE}) IS NULL THEN '{repair.STATE_REVIEW}' ELSE '{repair.TO_CODE}' END", _bad("state")),
    _audit(HEADERS["postal"], "conformity", "postal", f"CASE WHEN {_POSTAL_FOREIGN} THEN postal ELSE ({_POSTAL_FIXED}) END", _R, 0.75, f"CASE WHEN {_POSTAL_FOREIGN} THEN '{repair.FOREIGN_POSTAL}' WHEN ({_POSTAL_FIXED}) IS NULL THEN 'Need Review' ELSE 'regex cleanup' END", _bad("postal")),
    _audit(HEADERS["last_name"], "data_enhancement", "last_name", "'Smith'", _R, 1.0, "'Split medical degree/title: MD'", "last_name = 'Smith, MD'"),
    _audit(fixes.DEGREE_COLUMN, "data_enhancement", "last_name", "'MD'", _R, 1.0, "'Extracted from Provider Last Name: Smith, MD'", "last_name = 'Smith, MD'"),
    _audit(HEADERS["last_name"], "conformity", "last_name", _N, _R, 0.75, "'Need Review'", f"{_bad('last_name')} AND last_name <> 'Smith, MD'"),
    _audit(ENTITY_TYPE, "completeness", _N, f"({_IMPUTED})", "'conditional_imputation'", 0.9, f"CASE WHEN ({_IMPUTED}) = '2' THEN 'Organization Name present' ELSE 'Individual Name present' END", f"({_IMPUTED}) IS NOT NULL"),
    _audit(HEADERS["country"], "completeness", _N, "'US'", "'default_imputation'", 0.75, "'Default imputation (standard value)'", missing("country")),
    _audit(HEADERS["city"], "completeness", _N, f"({_CITY})", "'context_imputation'", 0.8, f"CASE WHEN ({_CITY}) IS NULL THEN '{repair.NO_INFERENCE}' ELSE 'city inference from context' END", missing("city")),
]


def _repaired(spark: SparkSession, sf_dir: str) -> repair.Repaired:
    d = providers(spark, sf_dir).withColumn(HEADERS["addr2"], F.lit(None).cast("string"))
    one = nulls.quoted(HEADERS["addr1"])
    return repair.repair(d.withColumn(HEADERS["addr1"], F.when(F.col(ROW) % 5 != 1, one)), RECS, RULES, as_of=AS_OF)


@query(f"{V} " + " UNION ALL ".join(_AUDIT))
def sidecar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).sidecar


@query(
    f"{V} SELECT k AS row_index, CASE WHEN {_bad('npi')} THEN ({_NPI_FIXED}) END AS npi, CASE WHEN {_bad('npi')} THEN ({_NPI_FIXED}) IS NOT NULL ELSE false END AS npi_applied, CASE WHEN {_bad('state')} THEN ({_CODE}) END AS state, CASE WHEN last_name = 'Smith, MD' THEN 'MD' END AS degree, ({_IMPUTED}) AS et, CASE WHEN {missing('country')} THEN 'US' END AS country FROM v"
)
def repaired_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _repaired(spark, sf_dir).table
    fixed = lambda c: nulls.quoted(f"{HEADERS[c]}__auto_fixed").alias(c)
    return t.select(ROW, fixed("npi"), nulls.quoted("NPI__fix_applied").alias("npi_applied"), fixed("state"), nulls.quoted(fixes.DEGREE_COLUMN).alias("degree"), fixed("et"), fixed("country"))


@query(f"""{V}, a AS (SELECT count(*) FILTER (WHERE NOT {missing('npi')}) AS n, count(*) FILTER (WHERE NOT {missing('npi')} AND {OK['npi']}) AS good, count(*) FILTER (WHERE {_bad('npi')} AND ({_NPI_FIXED}) IS NOT NULL) AS more, count(*) AS total FROM v)
    SELECT 'NPI' AS column_name, round(100.0::DOUBLE * good / n, 6) AS conformity_before, round(100.0::DOUBLE * (good + more) / n, 6) AS conformity_after, round(100.0::DOUBLE * n / total, 6) AS completeness_before, round(100.0::DOUBLE * n / total, 6) AS completeness_after, round(100.0::DOUBLE * (good + more) / n - 100.0::DOUBLE * good / n, 6) AS conformity_gain FROM a""")
def before_after_conformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _repaired(spark, sf_dir).table
    one = {"NPI": "NPI"}
    both = validate.before_after(validate.scores(t, RULES, one, AS_OF), validate.scores(repair.effective(t, ["NPI"]), RULES, one, AS_OF))
    return only(both, "column_name", "conformity_before", "conformity_after", "completeness_before", "completeness_after", "conformity_gain")


@query(f"{V}, a AS (" + " UNION ALL ".join(_AUDIT) + ") SELECT reason, count(*) AS n FROM a GROUP BY 1")
def sidecar_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_kind(_repaired(spark, sf_dir).sidecar, "reason")


@query(f"{V}, a AS (" + " UNION ALL ".join(_AUDIT) + ") SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY \"column\", issue_type ORDER BY row_index) <= 10")
def fix_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.details(_repaired(spark, sf_dir).sidecar)


@query(f"{V}, a AS (" + " UNION ALL ".join(_AUDIT) + ") SELECT \"column\", issue_type, count(*) AS n, count(recommended_value) AS n_values, round(min(confidence), 6) AS confidence FROM a GROUP BY 1, 2")
def sidecar_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows written to a file and read again."""
    path = scratch.fresh_path(spark, "sidecar") + "_fix_recommendations.csv"
    files.save_dataset(_repaired(spark, sf_dir).sidecar, path)
    rows = spark.read.schema(repair.SIDECAR).csv(path, header=True, escape='"')
    return rounded(rows.groupBy("column", "issue_type").agg(F.count("*").alias("n"), F.count("recommended_value").alias("n_values"), F.min("confidence").alias("confidence")))


@query(f"{V}, a AS (SELECT count(*) FILTER (WHERE NOT {missing('npi')}) AS n, count(*) FILTER (WHERE NOT {missing('npi')} AND {OK['npi']}) AS good, count(*) FILTER (WHERE {_bad('npi')} AND ({_NPI_FIXED}) IS NOT NULL) AS more, count(*) AS total, count(*) FILTER (WHERE NOT {missing('license')}) AS ln, count(*) FILTER (WHERE NOT {missing('license')} AND {OK['license']}) AS lgood FROM v)\n"
    "SELECT CAST(2 AS BIGINT) AS columns_before, CAST(1 AS BIGINT) AS columns_after, CAST(1 AS BIGINT) AS columns_common, round(50.0::DOUBLE * n / total + 50.0::DOUBLE * ln / total, 6) AS average_completeness_before, round(100.0::DOUBLE * n / total, 6) AS average_completeness_after, round(50.0::DOUBLE * good / n + 50.0::DOUBLE * lgood / ln, 6) AS average_conformity_before, round(100.0::DOUBLE * (good + more) / n, 6) AS average_conformity_after, CAST(0 AS DOUBLE) AS mean_completeness_gain, round(100.0::DOUBLE * more / n, 6) AS mean_conformity_gain FROM a")
def before_after_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that was not repaired counts on its own side only."""
    t = _repaired(spark, sf_dir).table
    before = validate.scores(t, RULES, {c: c for c in ("NPI", HEADERS["license"])}, AS_OF)
    return rounded(validate.improvement(validate.before_after(before, validate.scores(repair.effective(t, ["NPI"]), RULES, {"NPI": "NPI"}, AS_OF))))


@query(f"{V} SELECT {LAST} AS column_name, count(*) FILTER (WHERE {missing('last_name')} AND et IN ('1', '1.0')) AS rows_failed UNION ALL SELECT {ORG}, count(*) FILTER (WHERE {missing('org')} AND et IN ('2', '2.0')) FROM v".replace(" UNION ALL", " FROM v UNION ALL"))
def names_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = [repair.Recommendation(c, "completeness", "conditional_imputation", 0.75) for c in (NAME_COLUMNS[0], NAME_COLUMNS[2])]
    return repair.repair(providers(spark, sf_dir), recs, RULES, as_of=AS_OF).results.select("column_name", "rows_failed")


_CITY_STATE = "(SELECT s FROM m WHERE city = upper(" + strip("v.city") + "))"


@query(f"{V}, m AS (SELECT 'BOSTON' AS city, 'MA' AS s UNION ALL SELECT 'CHICAGO', 'IL'), a AS (SELECT k, {_CITY_STATE} AS found, state FROM v) SELECT k AS row_index, found AS recommended_value, CASE WHEN found IS NULL THEN '{repair.NO_INFERENCE}' ELSE 'state inference from context' END AS reason FROM a WHERE {missing('state')}")
def state_from_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a state, by the map of cities alone: nothing else of the address is there."""
    d = providers(spark, sf_dir)
    bare = d.withColumns({HEADERS[c]: F.lit(None).cast("string") for c in ("addr1", "addr2", "postal")})
    cities = spark.createDataFrame([("BOSTON", "MA"), ("CHICAGO", "IL")], "city string, state string")
    rec = repair.Recommendation(HEADERS["state"], "completeness", "context_imputation", 0.85, True)
    return repair.repair(bare, [rec], RULES, maps=repair.Maps(cities=cities), as_of=AS_OF).sidecar.select(ROW, "recommended_value", "reason")


_TOWNS = "['TOWN' || (k % 7), 'TOWN' || (k % 11), 'CITY' || (k % 5)]"


@query(f"{V}, m AS (SELECT 'TOWN' || i AS city, 'S' || (i % 3) AS s FROM range(10001) t(i) UNION ALL SELECT 'CITY' || i, 'S1' FROM range(5) t(i)), c AS (SELECT k, generate_subscripts({_TOWNS}, 1) AS i, unnest({_TOWNS}) AS x FROM v) SELECT k AS row_index, arg_min(x, i) AS city FROM c JOIN m ON x = city AND s = 'S' || (k % 3) GROUP BY k")
def city_choice_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several candidates the first that a map of more than 10,000 cities has in the row's state."""
    rows = dirty(spark, sf_dir).select(F.col("k").alias(ROW))
    named = F.array(*[F.concat(F.lit(p), (F.col(ROW) % n).cast("string")) for p, n in (("TOWN", 7), ("TOWN", 11), ("CITY", 5))])
    towns = spark.range(10_001).select(F.concat(F.lit("TOWN"), "id").alias("city"), F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("state"))
    cities = towns.union(spark.range(5).select(F.concat(F.lit("CITY"), "id"), F.lit("S1")))
    found = reference.first_in_state(rows, rows, ROW, named, F.concat(F.lit("S"), (F.col(ROW) % 3).cast("string")), cities, "city")
    return found.where("city IS NOT NULL")


# --- files and the history store: written, then read


@query(f"{V} SELECT npi, ein, last_name, org, nullif(license, '') AS license FROM v")
def saved_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV by suffix, read again by the focused columns; such a file doesn't tell empty text from none."""
    path = scratch.fresh_path(spark, "providers") + ".csv"
    files.save_dataset(providers(spark, sf_dir).drop(ROW), path)
    some = ["npi", "ein", "last_name", "org", "license"]
    read = files.load_dataset(spark, path, columns=[HEADERS[c] for c in some], row_index=False)
    return read.select(*[nulls.quoted(HEADERS[c]).alias(c) for c in some])


@query(f"{V} SELECT k AS row_index, coalesce(npi, '') AS npi, coalesce(org, '') AS org FROM v ORDER BY k LIMIT 20")
def first_rows_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.first_rows(providers(spark, sf_dir), 20)
    return files.preview(rows).select(ROW, F.col("NPI").alias("npi"), nulls.quoted(HEADERS["org"]).alias("org"))


def _stored(spark: SparkSession, sf_dir: str, *names: str) -> history.History:
    """A store with, for each dataset's name, a run that was expired and one that was stored twice."""
    found, seen = _issues(spark, sf_dir)
    store, now = history.History(spark, scratch.fresh_path(spark, "history")), dt.datetime(2024, 6, 30)
    for name in names or ("providers",):
        store.store(found, seen, at=now - dt.timedelta(days=200), dataset_name=name, run_id="old")
        for _ in range(2):
            store.store(found, seen, at=now, dataset_name=name, run_id="new")
    return store


@query(f"{V}{ISSUES} SELECT 'profiling_runs' AS table_name, 'new' AS run_id, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'column_metrics', 'new', count(*) FROM metrics UNION ALL SELECT 'issues', 'new', count(*) FROM found")
def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    parts = [store.table(t).groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "run_id", "n") for t in history.TABLES]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"{V}{METRICS} SELECT column_name, total_count, non_null_count, CASE WHEN column_name = 'NPI' THEN round(uniqueness_score, 6) END AS uniqueness_score, round(completeness_score, 6) AS completeness_score, round(conformity_score, 6) AS conformity_score FROM metrics")
def stored_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(_stored(spark, sf_dir).profile_of("new")[1], "column_name", "total_count", "non_null_count", "uniqueness_score", "completeness_score", "conformity_score")


@query(POINTS + _RUNNING + _JUDGE.format(rows="w") + " SELECT column_name, count(*) AS stored, CAST(sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high, (SELECT count(*) FROM hit) AS cleared, CAST(0 AS BIGINT) AS kept FROM hit GROUP BY 1")
def stored_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, read, cleared for their dataset, and counted again."""
    store = history.History(spark, scratch.fresh_path(spark, "history"))
    found = anomaly.detect_all(points(spark, sf_dir), TIGHT).withColumn("metric", F.concat_ws(" ", "metric", "run_id")).drop("run_id")
    store.store_anomalies(found, dataset_name="events", run_id="r", at=dt.datetime(2024, 6, 30))
    rows = store.table("anomalies").groupBy("column_name").agg(F.count("*").alias("stored"), F.count_if(F.col("severity") == "high").alias("high")).collect()  # a row for each type of event
    store.clear_anomalies("none")
    cleared = store.clear_anomalies("events")
    kept = store.table("anomalies").count()
    return spark.createDataFrame([(*r, cleared, kept) for r in rows], "column_name string, stored long, high long, cleared long, kept long")


@query(f"{V}{ISSUES} SELECT d AS dataset_name, t AS table_name, CASE t WHEN 'profiling_runs' THEN 1 WHEN 'column_metrics' THEN (SELECT count(*) FROM metrics) ELSE (SELECT count(*) FROM found) END * (d = 'x/y')::INT AS n FROM (VALUES ('a:b 50%'), ('x/y')) x(d), (VALUES ('profiling_runs'), ('column_metrics'), ('issues')) y(t)")
def deleted_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets with runs of the same id, under names that folders escape: one is deleted, files and all."""
    store = _stored(spark, sf_dir, "a:b 50%", "x/y")
    store.delete_run("new", dataset="a:b 50%")
    left = [(d, t, store.table(t, d).count()) for d in ("a:b 50%", "x/y") for t in ("profiling_runs", "column_metrics", "issues")]
    return spark.createDataFrame(left, "dataset_name string, table_name string, n long")


@query(f"{V}{ISSUES} SELECT 'profiling_runs' AS table_name, CAST(1 AS BIGINT) AS n_before, CAST(0 AS BIGINT) AS n_after UNION ALL SELECT 'column_metrics', count(*), 0 FROM metrics UNION ALL SELECT 'issues', count(*), 0 FROM found UNION ALL SELECT 'anomalies', 0, 0")
def deleted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    before = store.delete_run("new", dry_run=True)
    assert store.delete_run("new") == before
    return spark.createDataFrame([(t, n, store.table(t).count()) for t, n in before.items()], "table_name string, n_before long, n_after long")


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index, o_orderkey, o_totalprice FROM orders")
def row_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in an ordered table."""
    return files.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, CAST(c_custkey AS VARCHAR) AS k, c_name || chr(10) || 'says \"' || c_mktsegment || '\",' || chr(10) || chr(10) || c_custkey AS note FROM customer")
def csv_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with line ends, quotes and commas: written as CSV, read again in parts, with each row's place."""
    note = F.concat("c_name", F.lit('\nsays "'), "c_mktsegment", F.lit('",\n\n'), F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer").orderBy("c_custkey").select(F.col("c_custkey").alias("k"), note.alias("note"))
    path = files.save_dataset(rows, scratch.fresh_path(spark, "notes") + ".csv")
    return files.load_dataset(spark, path, focused_only=False)


@query(f"{V}{METRICS} SELECT column_name, total_count, non_null_count, conforming_count, non_conforming_count, round(completeness_score, 6) AS completeness_score, round(conformity_score, 6) AS conformity_score, min_length, max_length, round(avg_length, 6) AS avg_length, true AS unique_within FROM metrics")
def merged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts of the table profiled by three runs, stored, and merged without reading any again; the different values are near the exact ones."""
    d, store = providers(spark, sf_dir), history.History(spark, scratch.fresh_path(spark, "states"))
    for i in range(3):
        part = d.where(F.col(ROW) % 3 == i)
        store.store_states(partial.states(part, RULES, as_of=AS_OF, source=F.lit(f"part {i}")), dataset_name="providers", run_id=f"r{i}")
    found = partial.metrics(partial.merge(store.table("profile_states", "providers")))
    exact = profile.histogram(d).groupBy("column_name").agg(F.count("value").alias("exact"))
    within = F.abs(F.col("unique_count") - F.col("exact")) <= 0.04 * F.col("exact")
    return rounded(found.join(exact, "column_name").select("column_name", "total_count", "non_null_count", "conforming_count", "non_conforming_count", "completeness_score", "conformity_score", "min_length", "max_length", "avg_length", within.alias("unique_within")))


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM orders" for c in ("o_orderstatus", "o_orderpriority")) + "), n AS (SELECT column_name, value, count(*) AS n FROM c GROUP BY ALL) SELECT column_name, value, n, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank FROM n QUALIFY rank <= 5")
def merged_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent values from the states of each month's orders."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    parts = partial.states(table(spark, sf_dir, "orders"), {}, columns=["o_orderstatus", "o_orderpriority"], source=month)
    return partial.top_values(partial.merge(parts))


_TWO = ("CAST(o_orderkey AS VARCHAR) || ' ordered by customer ' || CAST(o_custkey AS VARCHAR)", "'the clerk of every third order ' || CAST(o_orderkey % 3001 AS VARCHAR)")


@query(
    f"WITH c AS (SELECT 'each' AS column_name, {_TWO[0]} AS value FROM orders UNION ALL SELECT 'some', {_TWO[1]} FROM orders), n AS (SELECT column_name, value, count(*) AS n FROM c GROUP BY ALL),"
    " t AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM n)"
    " SELECT column_name, count(*) AS unique_count, CAST(sum(n) AS BIGINT) AS total_count, round(sum(n * length(value)) / sum(n), 6) AS avg_length, string_agg(value || ':' || n, '; ' ORDER BY r) FILTER (WHERE r <= 5) AS top FROM t GROUP BY 1"
)
def near_unique_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of many values, by digests."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    d = table(spark, sf_dir, "orders").select(F.concat(key.cast("string"), F.lit(" ordered by customer "), customer).alias("each"), F.concat(F.lit("the clerk of every third order "), (key % 3001).cast("string")).alias("some"))
    found = wide.profile_routed(d, {}, by_digest=["each", "some"])
    top = found.top_values.groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), "; ").alias("top"))
    return rounded(found.metrics.join(top, "column_name").select("column_name", "unique_count", "total_count", "avg_length", "top"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS window_start, count(*) AS total_count, count(DISTINCT user_id) AS unique_count, count(*) - count(DISTINCT user_id) AS duplicate_count, round(100.0::DOUBLE * count(DISTINCT user_id) / count(*), 6) AS uniqueness_score FROM events WHERE user_id IS NOT NULL GROUP BY CAST(ts AS DATE)")
def window_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.uniqueness(table(spark, sf_dir, "events"), "ts", "user_id")
    return rounded(found.withColumn("window_start", F.to_date("window_start").cast("string")))


@query(f"{V} SELECT k, " + ", ".join(f"NOT {missing(c)} AND coalesce({OK[c]}, false) AS {c}" for c in HEADERS) + f", {missing('org')} AS none FROM v")
def rules_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text alone, by functions that the rules make."""
    sql.register(spark, RULES, as_of=AS_OF, names={h: f"conforms_{c}" for c, h in HEADERS.items()})
    verdicts = ", ".join(f"conforms_{c}({c}) AS {c}" for c in HEADERS)
    return spark.sql(f"SELECT k, {verdicts}, null_like(org) AS none FROM {{d}}", d=dirty(spark, sf_dir))


@query(f"{V}, a AS (" + " UNION ALL ".join(_AUDIT) + ") SELECT v.k, coalesce(a.recommended_value, v.npi) AS npi, v.nation FROM v LEFT JOIN (SELECT * FROM a WHERE \"column\" = 'NPI' AND recommended_value IS NOT NULL) a ON a.row_index = v.k")
def accepted_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table, repaired in those of its partitions that have something to repair."""
    path = scratch.fresh_path(spark, "accepted") + ".parquet"
    dirty(spark, sf_dir).select("k", F.col("npi").alias("NPI"), "nation").write.partitionBy("nation").parquet(path)
    loaded = files.load_dataset(spark, path, focused_only=False)
    accepted = repair.repair(loaded, [r for r in RECS if r.column_name == "NPI"], RULES, as_of=AS_OF).sidecar
    accept.apply(spark, path, accepted, ["nation"])
    return spark.read.parquet(path).select("k", F.col("NPI").alias("npi"), "nation")


# --- more reports


@query(POINTS + ", r AS (SELECT unnest(['click', 'view', 'never seen']) AS column_name) SELECT column_name, 'rule' AS has FROM r WHERE column_name NOT IN (SELECT column_name FROM points) UNION ALL SELECT DISTINCT column_name, 'history' FROM points WHERE column_name NOT IN (SELECT column_name FROM r)")
def rules_without_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules_of = spark.createDataFrame([("click",), ("view",), ("never seen",)], "column_name string")
    return reports.coverage(rules_of, points(spark, sf_dir))


@query(POINTS + _RUNNING + " SELECT CASE WHEN value > baseline_value THEN 'improvement (ignored)' WHEN abs(value - baseline_value) < 5 AND (CASE WHEN baseline_std > 0 THEN abs(value - baseline_value) / baseline_std WHEN value = baseline_value THEN 0 ELSE 1e300 END) < 2 THEN 'within thresholds' ELSE 'flagged' END AS status, count(*) AS n FROM w WHERE history_size >= 3 GROUP BY 1")
def flagged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    before = Window.partitionBy("column_name").orderBy("profiling_timestamp").rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.min("value").over(before), F.max("value").over(before)
    held = p.select("value", F.count("*").over(before).alias("n_before"), F.when(low == high, low).otherwise(F.avg("value").over(before)).alias("baseline_value"), F.when(low == high, 0.0).otherwise(F.stddev_pop("value").over(before)).alias("baseline_std"))
    return reports.by_kind(reports.flagged(held.where("n_before >= 3")), "status")


@query(POINTS + " SELECT count(DISTINCT run_id) - 1 AS history_size FROM points")
def earlier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.earlier_runs(points(spark, sf_dir).select("dataset_name", "run_id").distinct(), "events")


@query(f"{V}{METRICS}, r AS (SELECT *, row_number() OVER (ORDER BY non_conforming_count DESC, column_name) AS r FROM metrics WHERE non_conforming_count > 0) SELECT count(*) AS columns, CAST(coalesce(sum(non_conforming_count), 0) AS BIGINT) AS violations FROM r WHERE r > 5")
def remaining_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.remaining_violations(validate.validate_dataset(providers(spark, sf_dir), RULES, as_of=AS_OF), 5)


@query(f"{V}{METRICS} SELECT column_name, total_count, non_null_count, printf('%.2f%%', completeness_score) AS completeness, CASE WHEN column_name = 'NPI' THEN printf('%.2f%%', uniqueness_score) ELSE 'N/A' END AS uniqueness, CASE WHEN column_name = 'NPI' THEN CAST(duplicate_count AS VARCHAR) ELSE 'N/A' END AS duplicates, printf('%.2f%%', conformity_score) AS conformity, non_conforming_count FROM metrics")
def column_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.column_details(profile.profile(providers(spark, sf_dir), RULES, as_of=AS_OF).metrics)


@query(f"{V}{METRICS} SELECT column_name, non_null_count, conforming_count, printf('%.2f%%', {_RATE}) AS conformity_rate, (SELECT coalesce(string_agg(value, '; ' ORDER BY position), '') FROM ({_BAD}) b WHERE b.column_name = m.column_name AND b.position <= 3) AS samples FROM metrics m")
def validation_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.validate_dataset(providers(spark, sf_dir), RULES, as_of=AS_OF)
    return reports.validation_details(found).select("column_name", "non_null_count", "conforming_count", "conformity_rate", "samples")


@query(f"{V}{METRICS} SELECT count(*) AS n_columns, CAST(sum(total_count) AS BIGINT) AS cells, CAST(sum(non_conforming_count) AS BIGINT) AS violations FROM metrics")
def validation_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document, read back by its parts."""
    found = validate.validate_dataset(providers(spark, sf_dir), RULES, as_of=AS_OF)
    made = reports.validation_document(validate.overall(found), found)
    shape = "summary struct<cells:long,total_violations:long>, column_results array<struct<column_name:string,non_conforming_count:long>>"
    read = made.select(F.from_json("json", shape).alias("x"))
    return read.select(F.size("x.column_results").cast("long").alias("n_columns"), F.col("x.summary.cells").alias("cells"), F.aggregate("x.column_results", F.lit(0).cast("long"), lambda a, c: a + c["non_conforming_count"]).alias("violations"))


# --- the rest


@query("SELECT * FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sample(table(spark, sf_dir, "orders"), 100, key="o_orderkey")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS window_start, count(*) AS total_count, count(*) AS non_null_count, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS conforming_count, CAST(100 AS DOUBLE) AS completeness_score, round(100.0::DOUBLE * count(*) FILTER (WHERE event_type IN ('click', 'view')) / count(*), 6) AS conformity_score FROM events GROUP BY CAST(ts AS DATE)")
def multi_window_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("KIND", "event_type", "enum", {"values": ["click", "view"]})
    found = quality.windowed(table(spark, sf_dir, "events"), "ts", "event_type", rule)
    return rounded(found.withColumn("window_start", F.to_date("window_start").cast("string")))


_FOCUS = {"c_custkey": focused_columns()[0], "c_name": focused_columns()[3], "c_nationkey": focused_columns()[1]}


@query("SELECT " + ", ".join(f'CAST({c} AS VARCHAR) AS "{h}"' for c, h in sorted(_FOCUS.items(), key=lambda x: focused_columns().index(x[1]))) + " FROM customer")
def focused_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured columns, in their order, of a table that has them in another and has more."""
    c = table(spark, sf_dir, "customer")
    return files.as_text(files.focus(c.select("c_acctbal", *[F.col(x).alias(h) for x, h in _FOCUS.items()], "c_mktsegment")))


_KIND = " ".join(f"WHEN '{h}' THEN '{RULES[h].rule_type}'" for h in HEADERS.values())


@query(f"{V}{METRICS} SELECT CASE column_name {_KIND} END AS rule_type, CAST(count(*) AS INTEGER) AS n_columns, CAST(sum(total_count) AS BIGINT) AS values, true AS timed FROM metrics GROUP BY 1")
def rule_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each type's rules are timed over."""
    found = validate.throughput(providers(spark, sf_dir), RULES, as_of=AS_OF)
    return found.select("rule_type", "n_columns", "values", ((F.col("seconds") > 0) & (F.col("values_per_second") > 0)).alias("timed"))


@query(f"{V}{METRICS} SELECT CASE column_name {_KIND} END AS rule_type, count(*) AS n_columns, CAST(sum(non_null_count) AS BIGINT) AS checked, CAST(sum(conforming_count) AS BIGINT) AS conforming FROM metrics GROUP BY 1")
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules of each type cover: columns, values and how many of these conform."""
    found = validate.validate_dataset(providers(spark, sf_dir), RULES, as_of=AS_OF)
    return found.groupBy("rule_type").agg(F.count("*").alias("n_columns"), F.sum("non_null_count").alias("checked"), F.sum("conforming_count").alias("conforming"))


@query(f"{V}{ISSUES} SELECT (SELECT count(*) FROM metrics) AS n_columns, (SELECT count(*) FROM v) AS total_rows, (SELECT CAST(sum(conforming_count) AS BIGINT) FROM metrics) AS conforming, count(*) AS n_issues, CAST(sum(least(len(examples), 2)) AS BIGINT) AS n_examples FROM found")
def profile_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document of a profile and its issues, read back by its parts."""
    found, seen = _issues(spark, sf_dir)
    made = reports.profile_document(found, seen, examples=2)
    shape = "dataset struct<total_rows:long>, columns array<struct<column_name:string,conforming_count:long>>, issues array<struct<column_name:string,examples:array<string>>>"
    read, total = made.select(F.from_json("json", shape).alias("x")), F.lit(0).cast("long")
    conforming, shown = F.aggregate("x.columns", total, lambda a, c: a + c["conforming_count"]), F.aggregate("x.issues", total, lambda a, i: a + F.coalesce(F.size(i["examples"]), F.lit(0)))
    return read.select(F.size("x.columns").cast("long").alias("n_columns"), F.col("x.dataset.total_rows").alias("total_rows"), conforming.alias("conforming"), F.size("x.issues").cast("long").alias("n_issues"), shown.alias("n_examples"))


@query(f"{V}{_ADVICE} SELECT count(*) AS total, count(*) FILTER (WHERE actionable) AS actionable_count, round(CAST(sum(confidence_score) AS DOUBLE), 6) AS confidence, count(DISTINCT fix_strategy) AS strategies FROM first_advice")
def recommendation_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document of recommendations, read back by its parts."""
    advice = _advice(spark, sf_dir)
    made = reports.recommendation_document(recommend.summary(advice), advice)
    shape = "summary struct<total:long,actionable_count:long>, recommendations array<struct<fix_strategy:string,confidence_score:double>>"
    read = made.select(F.from_json("json", shape).alias("x"))
    confidence = F.aggregate("x.recommendations", F.lit(0.0), lambda a, r: a + r["confidence_score"])
    strategies = F.size(F.array_distinct(F.transform("x.recommendations", lambda r: r["fix_strategy"]))).cast("long")
    return rounded(read.select(F.size("x.recommendations").cast("long").alias("total"), F.col("x.summary.actionable_count").alias("actionable_count"), confidence.alias("confidence"), strategies.alias("strategies")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column's profile with the number of issues it gives."""
    found, seen = _issues(spark, sf_dir)
    n = seen.groupBy("column_name").agg(F.count("*").alias("issues"))
    return rounded(found.metrics.join(n, "column_name", "left").na.fill(0, ["issues"]).drop("position"))
