"""Row-level repairs: new columns beside the originals, and an audit row for each decision.

All recommendations of a run become expressions of one projection.  A column's
cascade of tests is one expression that gives a struct, so precedence is written
once; side columns and audit rows both read from it.  Originals never change.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixes import DEGREE_COLUMN, fix_value, split_name_and_degree
from ..functions.nulls import is_null_like, quoted, strip
from ..functions.rules import ENTITY_TYPE, NAME_COLUMNS, Rule, conditionally_complete, conforms, entity_type, matches, required_of
from ..functions.states import CODES, city_candidates, foreign_postal, infer_city, infer_state, joined_address, normal_postal_code, state_code
from ..sources import reference
from ..sources.catalog import MAILING, PRACTICE, find_column
from ..sources.files import ROW
from .recommend import imputed_entity_type

#: Labels and reasons of audit rows.
SIDECAR = f"{ROW} long, `column` string, issue_type string, original_value string, recommended_value string, strategy string, confidence double, reason string"
REASONS = {"enum": "enum normalization", "regex": "regex cleanup", "length": "length truncation", "phone": "phone cleanup", "date": "date reformat", "numeric": "numeric parse"}
STRATEGIES = {"default_imputation": "Default imputation (standard value)", "mode_imputation": "Mode imputation (most common value)", "context_imputation": "Context-based inference", "conditional_imputation": "Conditional imputation"}
NO_INFERENCE = "Inference failed - insufficient context or not found in reference files"
REVIEW, STATE_REVIEW = "Need Review", "State column - requires manual review or context-based inference"
TO_CODE, FOREIGN_STATE, FOREIGN_POSTAL = "converted full state name to abbreviation", "foreign state name", "validate foreign postal code"
OUTCOME = "struct<fixed:string,reason:string,text:string,degree:string,n_fixed:int,n_failed:int,rows:array<struct<column:string,issue_type:string,original_value:string,recommended_value:string,strategy:string,confidence:double,reason:string>>>"


@dataclass(frozen=True)
class Recommendation:
    column_name: str
    issue_type: str
    fix_strategy: str
    confidence_score: float = 0.0
    actionable: bool = False
    suggested_value: str | None = None
    estimated_impact: str = "medium"


@dataclass
class Maps:
    """Reference maps, each optional: see ``sources.reference``."""

    cities: DataFrame | None = None
    postal: DataFrame | None = None
    states: DataFrame | None = None


@dataclass
class Repaired:
    table: DataFrame  # the dataset with the new columns
    sidecar: DataFrame  # an audit row for each decision
    results: DataFrame  # column_name, issue_type, rows_fixed, rows_failed
    ordered: DataFrame | None = None  # the audit rows with ``seq``, their order within a row


def collected(recommendations: DataFrame) -> list[Recommendation]:
    """Recommendations as values: there is at most one for each column and kind."""
    names = Recommendation.__dataclass_fields__
    return [Recommendation(*[r[n] for n in names]) for r in recommendations.select(*names).collect()]


def chosen(recs: Iterable[Recommendation], *, only_actionable: bool = True, kinds: Iterable[str] = ("conformity", "completeness")) -> list[Recommendation]:
    """Those to apply, in order: conformity, completeness, others.  The first two need not be actionable."""
    kinds, order = set(kinds), {"conformity": 0, "completeness": 1}
    kept = [r for r in recs if r.issue_type in kinds and (r.issue_type in order or r.actionable or not only_actionable)]
    return sorted(kept, key=lambda r: order.get(r.issue_type, 2))


def _percent(x: float) -> str:
    return f"{x:.0%}"


def recommendation_text(rec: Recommendation, original: Column, fixed: Column, rule: Rule | None) -> Column:
    """What a reader is told, from a value and its repair (null: none)."""
    sure, kind = _percent(rec.confidence_score), rule.rule_type if rule else None
    if rec.issue_type == "completeness":
        how = {"default_imputation": "Default imputation", "context_imputation": "Context-based inference"}.get(rec.fix_strategy, rec.fix_strategy)
        yes = F.concat(F.lit("Missing value imputed: NULL → '"), fixed, F.lit(f"' ({how}). Confidence: {sure}. Action: Auto-fix applied."))
        return F.coalesce(yes, F.lit(f"Missing value detected. Recommendation: Review and fill manually. Issue: Completeness violation. Impact: {rec.estimated_impact}. Requires: Manual intervention."))
    # The sentences a reader gets.
    done = {
        "enum": ("Format corrected", " (normalized to valid enum value)"), "regex": ("Format corrected", " (cleaned to match required pattern)"), "length": ("Length corrected", " (truncated to valid length)"),
        "phone": ("Phone format corrected", " (normalized to digits only)"), "date": ("Date format corrected", " (reformatted to standard format)"), "numeric": ("Numeric format corrected", " (parsed and normalized)"),
    }
    wrong = {
        "enum": ("does not match allowed values. Recommendation: Review and correct manually", "Invalid enum value"), "regex": ("does not match required pattern. Recommendation: Review format and correct manually", "Pattern violation"),
        "length": ("has invalid length. Recommendation: Review and adjust length manually", "Length violation"), "phone": ("is not a valid phone format. Recommendation: Review and correct phone number manually", "Phone format violation"),
        "date": ("is not a valid date format. Recommendation: Review and correct date manually", "Date format violation"), "numeric": ("is not a valid numeric format. Recommendation: Review and correct numeric value manually", "Numeric format violation"),
    }
    head, tail = done.get(kind, ("Format corrected", ""))
    yes = F.concat(F.lit(f"{head}: '"), original, F.lit("' → '"), fixed, F.lit(f"'{tail}. Confidence: {sure}. Action: Auto-fix applied."))
    if kind == "enum" and "State" in rec.column_name and "Address" in rec.column_name:
        told = F.concat(F.lit("State inferred from context: '"), original, F.lit("' → '"), fixed, F.lit(f"' (inferred from city/postal code/address). Confidence: {sure}. Action: Auto-fix applied."))
        yes = F.when(F.upper(original).isin(*CODES), yes).otherwise(told)
    what, issue = wrong.get(kind, ("violates validation rules. Recommendation: Review and correct manually", rec.issue_type))
    no = F.concat(F.lit("Value '"), original, F.lit(f"' {what}. Issue: {issue}. Impact: {rec.estimated_impact}. Requires: Manual intervention."))
    return F.when(fixed.isNotNull(), yes).otherwise(no)


def _place(name: str) -> str | None:
    return PRACTICE if "Practice Location" in name else MAILING if "Mailing" in name else None


def _sibling(columns: list[str], name: str, what: str) -> Column | None:
    place = _place(name)
    found = None
    if place:
        found = find_column(columns, f"Provider {what} {place}" if what.endswith("Line") else f"Provider {place} {what}")
    return quoted(found).cast("string") if found else None


def _address(columns: list[str], name: str) -> Column:
    """Both lines of the address that a column belongs to."""
    lines = [_sibling(columns, name, what) for what in ("First Line", "Second Line")]
    return joined_address(*[F.lit(None).cast("string") if x is None else x for x in lines])


def _row(rec: Recommendation, original: Column, value: Column, reason: Column | str, *, column: str | None = None, kind: str | None = None, confidence: float | None = None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(column or rec.column_name).alias("column"),
        F.lit(kind or rec.issue_type).alias("issue_type"),
        (original if original is not None else text).cast("string").alias("original_value"),
        (value if value is not None else text).cast("string").alias("recommended_value"),
        F.lit(rec.fix_strategy).alias("strategy"),
        F.lit(float(rec.confidence_score if confidence is None else confidence)).alias("confidence"),
        (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
    )


def _outcome(fixed=None, reason=None, text=None, degree=None, n_fixed=0, n_failed=0, rows: list[Column] = ()) -> Column:
    none = F.lit(None).cast("string")
    as_col = lambda x: none if x is None else x if isinstance(x, Column) else F.lit(x)
    listed = F.array(*rows) if rows else F.array()
    return F.struct(as_col(fixed).alias("fixed"), as_col(reason).alias("reason"), as_col(text).alias("text"), as_col(degree).alias("degree"), F.lit(n_fixed).alias("n_fixed"), F.lit(n_failed).alias("n_failed"), listed.alias("rows")).cast(OUTCOME)


class Steps:
    """Values that later expressions read by name, computed in steps.

    A step is a struct behind a generator: the optimizer doesn't copy what stands
    there into each of the many places that read it, so plans stay small.
    """

    def __init__(self):
        self.held: list[list[Column]] = []

    def bind(self, step: int, value: Column) -> Column:
        """The name of a value computed in the given step, which reads earlier ones."""
        while len(self.held) <= step:
            self.held.append([])
        self.held[step].append(value)
        return F.col(f"__s{step}.x{len(self.held[step]) - 1}")

    def over(self, df: DataFrame) -> DataFrame:
        for i, values in enumerate(self.held):
            if values:
                df = df.select("*", F.explode(F.array(F.struct(*[v.alias(f"x{k}") for k, v in enumerate(values)]))).alias(f"__s{i}"))
        return df


def conformity_outcome(df: DataFrame, rec: Recommendation, rule: Rule, *, as_of=None, address_states: list[str] | None = None, foreign: Column | None = None, city_suffix: str = "state_code", steps: Steps) -> Column:
    """The cascade of a conformity repair; the first case that holds decides.

    Already right values stay, states' names become codes, names lose their degrees,
    foreign states and postal codes are kept for a check, other states go to review,
    and the rest is repaired by its rule if the result then satisfies it.
    """
    name = rec.column_name
    v = quoted(find_column(df.columns, name)).cast("string")
    bind = steps.bind
    missing, good = bind(0, is_null_like(v, name)), bind(0, conforms(v, rule, name, as_of))
    state, postal, last = "State Name" in name and "Address" in name, "Postal Code" in name and "Address" in name, name == NAME_COLUMNS[0]
    held = lambda x: matches(x, rule, name, as_of) & ~is_null_like(x, name)
    cases: list[tuple[Column, Column]] = [(missing, _outcome())]
    source = v
    if state:
        code = bind(0, state_code(v))
        cases.append((~good & bind(1, F.coalesce(held(code), F.lit(False))), _outcome(code, TO_CODE, recommendation_text(rec, v, code, rule), n_fixed=1, rows=[_row(rec, v, code, TO_CODE)])))
    if last:
        parts = bind(0, split_name_and_degree(v))
        who, degree = parts["name"], parts["degree"]
        split = F.concat(F.lit("split medical degree/title: "), degree)
        more = _row(rec, v, degree, F.concat(F.lit("Extracted from Provider Last Name: "), v), column=DEGREE_COLUMN, kind="data_enhancement", confidence=1.0)
        first = _row(rec, v, who, F.concat(F.lit("Split medical degree/title: "), degree), kind="data_enhancement", confidence=1.0)
        cases.append((bind(1, who.isNotNull() & F.coalesce(held(who), F.lit(False))), _outcome(who, split, recommendation_text(rec, v, who, rule), degree, n_fixed=1, rows=[first, more])))
        source = F.coalesce(who, v)
    cases.append((good, _outcome()))
    if state:
        if foreign is not None:
            cases.append((foreign, _outcome(text=FOREIGN_STATE, rows=[_row(rec, v, v, FOREIGN_STATE)])))
        cases.append((F.lit(True), _outcome(text=recommendation_text(rec, v, F.lit(None).cast("string"), rule), n_failed=1, rows=[_row(rec, v, None, STATE_REVIEW)])))
    else:
        if postal:
            cases.append((bind(0, foreign_postal(v, _sibling(df.columns, name, "Country Code (If outside U.S.)"))), _outcome(text=FOREIGN_POSTAL, rows=[_row(rec, v, v, FOREIGN_POSTAL)])))
        fixed = bind(1, fix_value(source, rule, name, as_of=as_of, address_states=address_states, city_suffix=city_suffix))
        ok = bind(2, fixed.isNotNull() & held(fixed))
        reason = F.lit(REASONS.get(rule.rule_type, "conformity fix"))
        if last:
            with_degree = _outcome(fixed, split, recommendation_text(rec, v, fixed, rule), degree, n_fixed=1, rows=[_row(rec, v, fixed, split), more])
            cases.append((ok & who.isNotNull(), with_degree))
        cases.append((ok, _outcome(fixed, reason, recommendation_text(rec, v, fixed, rule), n_fixed=1, rows=[_row(rec, v, fixed, reason)])))
        cases.append((F.lit(True), _outcome(text=recommendation_text(rec, v, F.lit(None).cast("string"), rule), n_failed=1, rows=[_row(rec, v, None, REVIEW)])))
    out = F.when(*cases[0])
    for when, what in cases[1:]:
        out = out.when(F.coalesce(when, F.lit(False)), what)
    return out


def completeness_outcome(df: DataFrame, rec: Recommendation, rule: Rule | None, *, city: Column | None = None, postal: Column | None = None, agreed: Column | None = None, steps: Steps) -> Column | None:
    """The repair of missing values: by the row's names, by its address, or by the suggested value.  None: nothing to do.

    Of several candidates for a city, ``agreed`` is the first that a join found in the row's state.
    """
    name = rec.column_name
    v = quoted(find_column(df.columns, name)).cast("string")
    missing, none = steps.bind(0, is_null_like(v, name)), F.lit(None).cast("string")
    if name == ENTITY_TYPE and "Row-specific" in str(rec.suggested_value):
        given = imputed_entity_type(df)
        if given is None:
            return None
        given = steps.bind(0, given)
        reason = F.when(given == "2", "Organization Name present").otherwise("Individual Name present")
        done = _outcome(given, reason, recommendation_text(rec, v, given, None), n_fixed=1, rows=[_row(rec, None, given, reason)])
        return F.when(given.isNotNull(), done).when(missing, _outcome(text=recommendation_text(rec, v, none, None), n_failed=1)).otherwise(_outcome())
    if name in NAME_COLUMNS:
        et = find_column(df.columns, ENTITY_TYPE)
        if et is None:
            return None
        needed = missing & (entity_type(quoted(et)) == required_of(name)) & ~conditionally_complete(quoted(et), v, name)
        return F.when(F.coalesce(needed, F.lit(False)), _outcome(text=recommendation_text(rec, v, none, None), n_failed=1)).otherwise(_outcome())
    is_state, is_city = "State Name" in name and "Address" in name, "City Name" in name and "Address" in name
    if rec.fix_strategy == "context_imputation" and (is_state or is_city):
        address = _address(df.columns, name)
        code = _sibling(df.columns, name, "Postal Code")
        if is_state:
            value = infer_state(F.lit(""), city_state=city, address=address, postal_code=code, postal_state=postal)
            if rule is not None:
                value = steps.bind(0, value)
                value = F.when(conforms(value, rule, name), value)
            reason = "state inference from context"
        else:
            value, reason = infer_city(address), "city inference from context"
            value = value if agreed is None else F.coalesce(agreed, value)
        value = steps.bind(1, value)
        done = _outcome(value, reason, recommendation_text(rec, v, value, None), n_fixed=1, rows=[_row(rec, None, value, reason)])
        failed = _outcome(text=recommendation_text(rec, v, none, None), n_failed=1, rows=[_row(rec, None, None, NO_INFERENCE)])
        return F.when(~missing, _outcome()).when(value.isNotNull(), done).otherwise(failed)
    if rec.suggested_value is None:
        return None
    value, reason = F.lit(rec.suggested_value), STRATEGIES.get(rec.fix_strategy, rec.fix_strategy)
    return F.when(missing, _outcome(value, reason, recommendation_text(rec, v, value, None), n_fixed=1, rows=[_row(rec, None, value, reason)])).otherwise(_outcome())


def repair(df: DataFrame, recs: Iterable[Recommendation], rules: Mapping[str, Rule], *, maps: Maps | None = None, as_of=None, only_actionable: bool = True, kinds: Iterable[str] = ("conformity", "completeness"), recommendations_only: bool = False, city_suffix: str = "state_code", folder: str | None = None) -> Repaired:
    """Applies recommendations to a dataset with a ``row_index``.

    ``recommendations_only`` leaves out values and flags: texts and audit rows alone.
    With ``folder``, a shared one, outcomes are written there once, and the table, the
    audit rows and the results read them; without, each works them out for itself.
    """
    maps, spark = maps or Maps(), df.sparkSession
    states = sorted({s for c, r in rules.items() if "State Name" in c and "Address" in c and r.rule_type == "enum" for s in r.rule_config.get("values", ())})
    base, plan, extra, steps = df, [], [], Steps()
    for i, rec in enumerate(chosen(recs, only_actionable=only_actionable, kinds=kinds)):
        column = find_column(df.columns, rec.column_name)
        if column is None:
            plan.append((rec, None, None))
            continue
        rule, found = rules.get(rec.column_name), None
        state = "State Name" in rec.column_name and "Address" in rec.column_name
        if rec.issue_type == "conformity" and rule is not None:
            hit = None
            country = _sibling(df.columns, rec.column_name, "Country Code (If outside U.S.)")
            if state and maps.states is not None and country is not None:
                base = reference.foreign_state(base, quoted(column), F.when(~is_null_like(country), country), maps.states, f"__f{i}")
                hit = F.col(f"__f{i}")
                extra.append(f"__f{i}")
            found = conformity_outcome(df, rec, rule, as_of=as_of, address_states=states, foreign=hit, city_suffix=city_suffix, steps=steps)
        elif rec.issue_type == "completeness":
            by_city = by_code = agreed = None
            city, code = _sibling(df.columns, rec.column_name, "City Name"), _sibling(df.columns, rec.column_name, "Postal Code")
            if state and maps.cities is not None and city is not None:
                base = reference.lookup(base, F.upper(strip(city)), maps.cities, "city", "state", f"__c{i}")
                by_city = F.col(f"__c{i}")
                extra.append(f"__c{i}")
            if state and maps.postal is not None and code is not None:
                base = reference.postal_lookup(base, normal_postal_code(code), maps.postal, f"__p{i}")
                by_code = F.col(f"__p{i}")
                extra.append(f"__p{i}")
            here = _sibling(df.columns, rec.column_name, "State Name")
            if "City Name" in rec.column_name and "Address" in rec.column_name and rec.fix_strategy == "context_imputation" and maps.cities is not None and here is not None:
                named = city_candidates(F.coalesce(_address(df.columns, rec.column_name), F.lit("")))
                named = F.when(is_null_like(quoted(column).cast("string"), rec.column_name) & (F.size(named) > 1), named)
                base = reference.first_in_state(base, df, ROW, named, F.upper(strip(here)), maps.cities, f"__a{i}")
                agreed = F.col(f"__a{i}")
                extra.append(f"__a{i}")
            found = completeness_outcome(df, rec, rule, city=by_city, postal=by_code, agreed=agreed, steps=steps)
        plan.append((rec, column, found))
    done = [(r, c, o) for r, c, o in plan if o is not None]
    if not done:
        empty = spark.createDataFrame([], SIDECAR)
        results = [(r.column_name, r.issue_type, 0, 0, c is not None) for r, c, _ in plan]
        return Repaired(df, empty, spark.createDataFrame(results, "column_name string, issue_type string, rows_fixed long, rows_failed long, success boolean"))
    once = F.explode(F.array(F.struct(*[o.alias(f"o{i}") for i, (_, _, o) in enumerate(done)]))).alias("__o")
    outcomes = steps.over(base).select(*[quoted(c) for c in df.columns], once)
    if folder is not None:
        outcomes.write.mode("overwrite").parquet(folder)
        outcomes = spark.read.schema(outcomes.schema).parquet(folder)

    columns: dict[str, list[str]] = {}
    for i, (_, c, _) in enumerate(done):
        columns.setdefault(c, []).append(f"__o.o{i}")
    sides: list[Column] = []
    for c, held in columns.items():
        last = lambda what: F.coalesce(*[F.col(o)[what] for o in reversed(held)])  # noqa: E731, B023  the last repair wins
        if not recommendations_only:
            sides += [last("fixed").alias(f"{c}__auto_fixed"), last("fixed").isNotNull().alias(f"{c}__fix_applied"), last("reason").alias(f"{c}__fix_reason")]
        sides.append(last("text").alias(f"{c}__recommendation"))
    degrees = [f"__o.o{i}" for i, (r, _, _) in enumerate(done) if r.column_name == NAME_COLUMNS[0] and r.issue_type == "conformity"]
    if degrees and not recommendations_only:
        sides.append(F.coalesce(*[F.col(o)["degree"] for o in degrees]).alias(DEGREE_COLUMN))
    kept = [quoted(c) for c in df.columns if c != DEGREE_COLUMN or not degrees or recommendations_only]
    table = outcomes.select(*kept, *sides)

    rows = F.flatten(F.array(*[F.col(f"__o.o{i}")["rows"] for i in range(len(done))]))
    ordered = outcomes.select(ROW, F.posexplode(rows).alias("seq", "x")).select(ROW, "seq", "x.*")
    totals = outcomes.agg(*[F.coalesce(F.sum(F.col(f"__o.o{i}")[n]), F.lit(0)).alias(f"{n}{i}") for i in range(len(done)) for n in ("n_fixed", "n_failed")])
    listed = F.array(*[F.struct(F.lit(r.column_name).alias("column_name"), F.lit(r.issue_type).alias("issue_type"), F.col(f"n_fixed{i}").alias("rows_fixed"), F.col(f"n_failed{i}").alias("rows_failed"), (F.col(f"n_failed{i}") == 0).alias("success")) for i, (r, _, _) in enumerate(done)])
    results = totals.select(F.explode(listed).alias("x")).select("x.*")
    return Repaired(table, ordered.drop("seq"), results, ordered)


def effective(table: DataFrame, columns: Iterable[str], *, with_recommended: DataFrame | None = None) -> DataFrame:
    """The values after repair: the repaired one, else a recommended one, else the original.

    ``with_recommended`` has audit rows; of several for one cell the last by ``seq`` wins
    (without that column, the greatest kind of issue and value).
    """
    columns = list(columns)
    fixed = [F.coalesce(quoted(f"{c}__auto_fixed"), quoted(c)).alias(c) if f"{c}__auto_fixed" in table.columns else quoted(c) for c in columns]
    if with_recommended is None:
        return table.select(ROW, *fixed)
    order = ["seq"] if "seq" in with_recommended.columns else ["issue_type", "recommended_value"]
    found = with_recommended.where(F.col("recommended_value").isNotNull()).groupBy(ROW).pivot("column", columns).agg(F.max_by("recommended_value", F.struct(*order)))
    renamed = found.select(ROW, *[quoted(c).alias(f"__r_{c}") for c in columns])
    return table.select(ROW, *fixed).join(renamed, ROW, "left").select(ROW, *[F.coalesce(quoted(f"__r_{c}"), quoted(c)).alias(c) for c in columns])


def details(sidecar: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` audit rows of each column and kind of issue, by their place."""
    order = Window.partitionBy("column", "issue_type").orderBy(ROW)
    return sidecar.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")
