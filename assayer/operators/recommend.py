"""Repairs worth recommending: one for each column and kind of issue, with a confidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixes import is_state_column
from ..functions.nulls import is_null_like, quoted, strip
from ..functions.rules import DATE_FORMATS, ENTITY_TYPE, MORE_DATE_FORMATS, NAME_COLUMNS, Rule, parsed_date, whole_number_text
from ..functions.states import STATES, literal_map
from ..sources.catalog import MAILING, PRACTICE, find_column

FIELDS = "column_name string, issue_type string, fix_strategy string, fix_description string, confidence_score double, estimated_impact string, actionable boolean, suggested_value string, rationale string"


# --- which of a rule's violations can be repaired, and how


SETTINGS = "column_name string, kind string, pattern string, digits int, upper boolean, plain boolean, lows map<string,string>, allowed array<string>, named boolean, entity boolean, least int, most int"


def rule_settings(spark: SparkSession, rules: Mapping[str, Rule]) -> DataFrame:
    """What the repairs of a column's violations depend on, a row for each column."""
    rows = []
    for c, rule in rules.items():
        config, kind = rule.rule_config, rule.rule_type
        pattern, values = str(config.get("pattern", "")), [str(x) for x in config.get("values", ())]
        lows: dict[str, str] = {}
        for x in values:
            lows.setdefault(x.lower(), x)
        digits = (10 if c == "NPI" else 9 if "EIN" in c else 0) if r"\d" in pattern else None
        low, high = ("min_digits", "max_digits") if kind == "phone" else ("min", "max")
        most = config.get(high, 20 if kind == "phone" else None)
        plain = "Taxonomy Code" in c or "License Number" in c
        rows.append((c, kind, f"(?U)^(?:{pattern})", digits, "[A-Za-z]" in pattern, plain, lows, values, is_state_column(c), c == ENTITY_TYPE, int(config.get(low, 7 if kind == "phone" else 0)), None if most is None else int(most)))
    return spark.createDataFrame(rows, SETTINGS)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _regex_fixes(v: Column) -> tuple[Column, Column]:
    fits = lambda x: F.regexp(x, F.col("pattern"))
    one, d, plain = F.regexp_replace(v, r"(?U)\s+", " "), F.regexp_replace(v, r"(?U)\D", ""), F.upper(F.regexp_replace(v, "[^A-Za-z0-9]", ""))
    n, wanted = F.char_length(d), F.col("digits")
    tests = [
        ((one != v) & fits(one), F.lit("one space between words would make it match")),
        (F.when(wanted > 0, n >= wanted).when(wanted == 0, (n > 0) & fits(d)), F.when(wanted > 0, _text("its first ", wanted.cast("string"), " digits would match")).otherwise("its digits alone would match")),
        (F.col("upper") & fits(F.upper(v)), F.lit("capital letters would make it match")),
        (F.col("plain") & (plain != "") & fits(plain), F.lit("letters and digits alone, in capitals, would match")),
        (fits(v), F.lit("without blanks at its ends it matches")),
    ]
    said = F.array_compact(F.array(*[F.when(t, x) for t, x in tests]))
    return F.size(said) > 0, said


def _length_fixes(v: Column) -> tuple[Column, Column]:
    n, least, most = F.char_length(v), F.col("least"), F.col("most")
    said = F.when(n > most, _text("its first ", most.cast("string"), " characters would fit")).when(n < least, "shorter than allowed; what is missing has to be looked up").when(F.char_length("value") != n, "without blanks at its ends it fits")
    return F.lit(False), F.array_compact(F.array(said))


def _enum_fixes(v: Column) -> tuple[Column, Column]:
    hit, allowed, code, whole = F.try_element_at("lows", F.lower(v)), F.col("allowed"), F.try_element_at(literal_map(STATES), F.upper(v)), whole_number_text(v)
    case = F.coalesce(hit != v, F.lit(False))
    named = F.col("named") & F.coalesce(F.array_contains(allowed, code), F.lit(False))
    number = F.col("entity") & F.coalesce(F.array_contains(allowed, whole) & (whole != v), F.lit(False))
    said = F.when(number, _text("write '", whole, "' for '", v, "'")).when(named, _text("'", v, "' names the state '", code, "'")).when(case, _text("'", v, "' differs from '", hit, "' in case alone"))
    return case | named | number, F.array(F.coalesce(said, _text("none of the allowed values: ", F.array_join(allowed, ", "))))


def _phone_fixes(v: Column) -> tuple[Column, Column]:
    n, least, most = F.char_length(F.regexp_replace("value", r"(?U)\D", "")), F.col("least"), F.col("most")
    said = F.when(n.between(least, most), "its digits alone would do").when(n > most, _text("more than ", most.cast("string"), " digits; the first ones would do"))
    return F.when(most >= least, n >= least).otherwise(n > most), F.array_compact(F.array(said))


def _date_fixes(v: Column) -> tuple[Column, Column]:
    read = parsed_date(v, (*DATE_FORMATS, *MORE_DATE_FORMATS)).isNotNull()
    return read, F.array_compact(F.array(F.when(read, "a date in another format; write it as MM/DD/YYYY")))


#: For each kind of rule: whether a violating ``value`` counts as repairable, and the suggestions it gives.
FIXES = {"regex": _regex_fixes, "length": _length_fixes, "enum": _enum_fixes, "phone": _phone_fixes, "date": _date_fixes}


def violation_fixes(rows: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """``rows`` of ``column_name`` and ``value`` that have a rule, with ``g`` (repairable) and ``s`` (suggestions).

    Rules differ by what a small table says of them, so there is one branch for each
    kind of rule, not for each column, and plans don't grow with the columns.
    """
    if not rules:
        return rows.limit(0).withColumns({"g": F.lit(False), "s": F.array().cast("array<string>")})
    settings = rule_settings(rows.sparkSession, rules)
    joined, v = rows.join(F.broadcast(settings), "column_name"), strip(F.col("value"))  # a row for each column that has a rule
    good, said = F.lit(False), F.array().cast("array<string>")
    for kind, of in FIXES.items():
        g, s = of(v)
        good, said = F.when(F.col("kind") == kind, g).otherwise(good), F.when(F.col("kind") == kind, s).otherwise(said)
    return joined.select(*rows.columns, F.coalesce(good, F.lit(False)).alias("g"), said.alias("s"))


FALLBACKS = {
    "regex": lambda c: ["no repair is known; compare the values with the pattern and with their source"],
    "length": lambda c: ["no repair is known; compare the lengths with the limits"],
    "enum": lambda c: [f"allowed are {', '.join(map(str, c.get('values', ())))}"],
    "phone": lambda c: [f"allowed are {c.get('min_digits', 7)} to {c.get('max_digits', 20)} digits"],
    "date": lambda c: ["write dates as MM/DD/YYYY"],
}


def confidence(ratio: Column) -> Column:
    """Of the share of violations that look repairable."""
    return F.when(ratio >= 0.8, 0.90).when(ratio >= 0.6, 0.85).when(ratio >= 0.4, 0.75).otherwise(0.65)


def analyzed(violations: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """column_name, n_analyzed, n_fixable, suggestions (distinct, sorted) from rows of column_name and value."""
    rows = violation_fixes(violations, rules)
    return rows.groupBy("column_name").agg(F.count("*").alias("n_analyzed"), F.count_if("g").alias("n_fixable"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("suggestions"))


# --- the entity type, which other columns of a row tell


def imputed_entity_type(df: DataFrame) -> Column | None:
    """For a row without entity type: '2' with an organization's name, else '1' with a person's; null otherwise.  None if columns lack."""
    found = [find_column(df.columns, c) for c in (ENTITY_TYPE, NAME_COLUMNS[2], NAME_COLUMNS[0], NAME_COLUMNS[1])]
    if None in found:
        return None
    et, org, last, first = found
    there = lambda c: ~is_null_like(quoted(c), c)
    return F.when(is_null_like(quoted(et), et), F.when(there(org), "2").when(there(last) | there(first), "1"))


def entity_type_confidence(ratio: Column) -> Column:
    return F.when(ratio >= 0.85, 0.85 + (ratio - 0.85) * (0.10 / 0.15)).otherwise(0.85 * ratio)


def entity_type_counts(df: DataFrame) -> DataFrame | None:
    """One row: how many rows lack the type, and what they can be given."""
    given = imputed_entity_type(df)
    if given is None:
        return None
    et = find_column(df.columns, ENTITY_TYPE)
    missing = is_null_like(quoted(et), et)
    counts = df.agg(F.count_if(missing).alias("n_missing"), F.count_if(given == "2").alias("n_organization"), F.count_if(given == "1").alias("n_individual"))
    ratio = F.try_divide((F.col("n_organization") + F.col("n_individual")).cast("double"), F.col("n_missing"))
    return counts.withColumn("ratio", F.coalesce(ratio, F.lit(0.0))).withColumn("confidence", entity_type_confidence(F.col("ratio")))


# --- one recommendation per issue


def _impact(percentage: Column) -> Column:
    return F.when(percentage < 5, "low").otherwise("medium")


def recommend(issues: DataFrame, metrics: DataFrame | None, rules: Mapping[str, Rule], df: DataFrame | None = None, *, analyze: int = 10) -> DataFrame:
    """Recommendations for issues: the first of each (column, kind) that gives one.

    Without ``metrics`` the plain forms are given; without ``df`` those that need a
    look at the data are left out, as are fills no value can be suggested for.
    """
    spark = issues.sparkSession
    name, kind, n, pct = F.col("column_name"), F.col("issue_type"), F.col("count"), F.col("percentage")
    text = lambda *x: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in x])
    none, no = F.lit(None).cast("string"), F.lit(False)

    def rec(strategy, description, conf, impact, actionable, suggested=none, rationale=F.lit("")) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_col(strategy).alias("fix_strategy"), description.alias("fix_description"), as_col(conf).cast("double").alias("confidence_score"), as_col(impact).alias("estimated_impact"), as_col(actionable).alias("actionable"), suggested.alias("suggested_value"), rationale.alias("rationale"))

    fill = text("Fill ", n.cast("string"), " missing values in ", name)
    remove = lambda what: text("Investigate and remove ", n.cast("string"), what)
    unique_plain = rec("remove_duplicates", text("Investigate and remove ", n.cast("string"), " duplicate values in ", name), 0.8, "high", no)
    format_plain = rec("format_correction", text("Investigate and correct ", n.cast("string"), " format violations in ", name), 0.6, "medium", no)
    if metrics is None:
        made = F.when(kind == "conformity", format_plain).when(kind == "uniqueness", unique_plain)
        return _first(issues.withColumn("r", made))

    known = metrics.select("column_name", F.lit(True).alias("known"))
    states = metrics.where(name.contains("State Name")).select(F.regexp_replace("column_name", "State Name$", "Country Code (If outside U.S.)").alias("column_name"), F.col("completeness_score").alias("state_completeness"))
    listed = issues.where(F.size("examples") > 0).select("seq", "column_name", F.explode(F.slice("examples", 1, analyze)).alias("value"))
    tried = violation_fixes(listed, rules).groupBy("seq").agg(F.count("*").alias("k"), F.count_if("g").alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    spare = spark.createDataFrame([(c, FALLBACKS[r.rule_type](r.rule_config)) for c, r in rules.items() if r.rule_type in FALLBACKS] or [("", [""])], "column_name string, spare array<string>")
    rows = issues.join(known, "column_name", "left").join(states, "column_name", "left").join(tried, "seq", "left").join(spare, "column_name", "left")
    rows = rows.withColumn("s", F.when(F.size("s") > 0, F.col("s")).otherwise(F.coalesce("spare", F.array().cast("array<string>"))))

    columns = df.columns if df is not None else []
    whole = lambda place: all(c in columns for c in (f"Provider First Line {place}", f"Provider Second Line {place}", f"Provider {place} Postal Code", f"Provider {place} Country Code (If outside U.S.)"))
    context = F.when(name.contains("Practice Location"), F.lit(whole(PRACTICE))).otherwise(F.lit(whole(MAILING)))
    data, address = F.lit(df is not None), name.contains("Address")
    city, state = name.contains("City Name") & address, name.contains("State Name") & address
    word = F.when(state, "state").otherwise("city")
    needs = text("Whether a row needs ", name, " depends on its entity type: persons (1) have a last and a first name, organizations (2) a business name. Each row is judged by its own type.")
    place = rec(
        "context_imputation", fill, F.when(context, F.when(state, 0.85).otherwise(0.80)).otherwise(0.6), _impact(pct), context, none,
        F.when(context, text("The row's address lines, postal code and country tell its ", word, ".")).otherwise("Columns of the address are not there, so somebody has to look at these rows"),
    )
    postal = rec("context_imputation", fill, 0.70, _impact(pct), no, none, F.lit("Address and state narrow a postal code down but don't settle it; check by hand."))
    country = rec("default_imputation", fill, 0.75, _impact(pct), F.lit(True), F.lit("US"), F.lit("Most rows name a state, so an address without a country is taken to be in the US."))
    complete = (
        F.when(data & name.isin(*NAME_COLUMNS), rec("conditional_imputation", fill, 0.75, _impact(pct), no, none, needs))
        .when(data & (city | state), place)
        .when(data & name.contains("Postal Code") & address, postal)
        .when(name.contains("Country Code") & address & (F.col("state_completeness") > 50), country)
    )
    counts = entity_type_counts(df) if df is not None else None
    if counts is not None:
        c = counts.first()
        told, missing = c.n_organization + c.n_individual, c.n_missing
        by_row = rec(
            "conditional_imputation", text("Fill ", n.cast("string"), " missing Entity Type Code values from the names in each row"), c.confidence, _impact(pct), F.lit(True), F.lit("Row-specific: '2' with an organization name, '1' with an individual name"),
            F.lit(f"{told} of {missing} rows tell their type ({c.n_organization} organizations, {c.n_individual} individuals)"),
        )
        complete = F.when(name == ENTITY_TYPE, by_row if told else rec("default_imputation", fill, 0.5, "high", no)).otherwise(complete)

    k, f, said = F.col("k"), F.col("f"), F.array_join(F.slice("s", 1, 3), ", ")
    fixable = (f > 0) & (F.size("s") > 0)
    why = text(
        k.cast("string"), F.when(k == n, " violations, all there are, were tried").otherwise(text(" of ", n.cast("string"), " violations were tried")), " in ", name,
        F.when(f > 0, text("; ", f.cast("string"), " of them can be repaired: ", said)).otherwise(text("; none can be repaired without a look: ", said)),
    )
    formats = rec("format_correction", text("Correct ", n.cast("string"), " format violations in ", name), confidence(f / k), F.when(fixable, "low").otherwise("medium"), fixable, none, why)
    conform = F.when(F.col("known") & k.isNotNull(), formats).otherwise(format_plain)
    unique = F.when(F.col("known") & (name == "NPI"), rec("remove_duplicates", remove(" duplicate NPI values"), 0.95, "high", no)).otherwise(unique_plain)
    made = F.when(kind == "conformity", conform).when(kind == "uniqueness", unique).when((kind == "completeness") & F.col("known"), complete)
    return _first(rows.withColumn("r", made))


def _first(rows: DataFrame) -> DataFrame:
    """Rows with a recommendation ``r``, the first of each column and kind."""
    order = Window.partitionBy("column_name", "issue_type").orderBy("seq")
    first = rows.where(F.col("r").isNotNull()).withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return first.select("seq", "column_name", "issue_type", F.col("count").alias("issue_count"), "r.*")


def for_anomalies(anomalies: DataFrame) -> DataFrame:
    """A recommendation to investigate for each anomaly."""
    one = lambda c: F.format_string("%.1f", c)
    down = F.col("delta") < 0
    return anomalies.select(
        "column_name",
        F.lit("anomaly").alias("issue_type"),
        F.lit("investigate_root_cause").alias("fix_strategy"),
        F.concat(F.lit("find out why "), F.col("metric"), F.lit(" is "), one(F.abs("delta")), F.when(down, " points below").otherwise(" points above"), F.lit(" its usual level")).alias("fix_description"),
        F.when((F.col("severity") == "high") & (F.col("z_score") > 3), 0.9).when(F.col("severity") == "high", 0.7).otherwise(0.5).alias("confidence_score"),
        F.col("severity").alias("estimated_impact"),
        F.lit(False).alias("actionable"),
        F.lit(None).cast("string").alias("suggested_value"),
        F.concat(F.lit("earlier runs had a "), F.col("metric"), F.lit(" of about "), one(F.col("baseline_value")), F.lit(", this one has "), one(F.col("current_value"))).alias("rationale"),
    )


def summary(recommendations: DataFrame) -> DataFrame:
    """One row: how many, how many actionable, how many to review, how many of high impact."""
    return recommendations.agg(F.count("*").alias("total"), F.count_if("actionable").alias("actionable_count"), F.count_if(~F.col("actionable")).alias("requires_review_count"), F.count_if(F.col("estimated_impact") == "high").alias("high_impact_count"))
