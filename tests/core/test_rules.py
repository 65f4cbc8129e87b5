import pytest
from pyspark.sql import functions as F

from assayer.functions import fixes, nulls, rules, states
from assayer.functions.nulls import EIN
from assayer.functions.rules import ENTITY_TYPE, Rule
from assayer.sources.catalog import ADDRESS_STATES, MAILING, focused_columns, provider_rules

AS_OF = "2024-06-30"
RULES = provider_rules()


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "column, good, bad",
    [
        ("NPI", ["1234567890", " 1234567890\t", "0000000000"], ["123456789", "12345678901", "abcdefghij", "123-456-789", None, "", "n/a"]),
        (ENTITY_TYPE, ["1", "2", "1.0", "2.00"], ["3", "0", "A", None, "", "1.5"]),
        (EIN, ["123456789", "<UNAVAIL>"], ["12345678", "unavailable", "<unavail>"]),
        (f"Provider {MAILING} Telephone Number", ["1234567890", "(123) 456-7890", "1" * 20], ["123456", "1" * 21, "abc", None, ""]),
        ("Provider Enumeration Date", ["2020-01-15", "01/15/2020", "1-5-2020", "2020/1/5"], ["2031-12-31", "soon", "2020-13-01", "2020-02-30", "01/05/20", None]),
        ("Provider Organization Name (Legal Business Name)", ["AB", "A" * 120], ["A", "A" * 121, None, ""]),
        (f"Provider {MAILING} State Name", ["CA", "NY", "AE"], ["XX", "California", "ca"]),
    ],
)
def test_provider_rules(spark, column, good, bad):
    got = values(spark, good + bad, lambda v: rules.conforms(v, RULES[column], column, AS_OF))
    assert got == [True] * len(good) + [False] * len(bad)


def test_numeric_reads_what_python_reads(spark):
    texts = ["123", "123.45", "-123", "0", "1e5", " 7 ", "1_000", ".5", "5.", "abc", "123abc", "1d", "1.0f", "0x1p3", "1__0", "Infinity", "-inf", "e5"]

    def python(t):
        try:
            float(t)
            return True
        except ValueError:
            return False

    rule = Rule("N", "c", "numeric")
    assert values(spark, texts, lambda v: rules.conforms(v, rule)) == [python(t) for t in texts]


def test_unknown_type_and_no_rule(spark):
    assert values(spark, ["a", None, "na"], lambda v: rules.conforms(v, Rule("R", "c", "other"))) == [False] * 3
    assert values(spark, ["a", None, "na"], lambda v: rules.conforms(v, None)) == [True, False, False]


def test_null_tokens(spark):
    texts = [None, "", " \t", "N/A", "Unknown", "<UNAVAIL>", "none ", "0", "x", "-----"]
    assert values(spark, texts, lambda v: nulls.is_null_like(v)) == [True] * 7 + [False] * 3
    assert values(spark, ["<UNAVAIL>", "unavail", None], lambda v: nulls.is_null_like(v, EIN)) == [False, True, True]
    df = spark.createDataFrame([(EIN, "<unavail>"), ("x", "<unavail>"), (EIN, None)], "c string, v string")
    assert [r[0] for r in df.select(nulls.is_null_like(F.col("v"), F.col("c"))).collect()] == [False, True, True]


def test_extended_rule_types(spark):
    rules.RULE_TYPES["starts"] = lambda v, config, name, day: v.startswith(config["with"])
    try:
        assert values(spark, ["ab", "ba", None], lambda v: rules.conforms(v, Rule("S", "c", "starts", {"with": "a"}))) == [True, False, False]
    finally:
        del rules.RULE_TYPES["starts"]


@pytest.mark.parametrize(
    "column, pairs",
    [
        ("NPI", {"123-456-7890": "1234567890", "123456789012": "1234567890", "12345": "0000012345", "abc": None}),
        (EIN, {"12-3456789": "123456789", "<unavail>": "<UNAVAIL>", "12345678901": "123456789", "12345": None}),
        (f"Provider {MAILING} Postal Code", {"12345 ": "12345", "ZIP 12345": "12345", "T4L 1Z3": None, "80511606.0": "805116060"}),
        ("Healthcare Provider Taxonomy Code_1", {"207q-00000x": "207Q00000X", "207": None}),
        ("Provider License Number_1", {"MD 18839": "MD18839", "000396-1": "0003961", "###": None}),
        (f"Provider {MAILING} City Name", {"NEW YORK, NY": "NY", "CHICAGO,": "CHICAGO", "St.  Paul": "St. Paul"}),
        ("Provider Enumeration Date", {"01-15-2024": "01/15/2024", "2024-01-15": "2024-01-15", "01.15.2024": "01/15/2024", "25/12/2020": "12/25/2020", "2031-01-01": None, "x": None}),
        (f"Provider {MAILING} Telephone Number", {"1" * 22: "1" * 20, "12345": None, "(123) 456-7890": "1234567890"}),
        ("Provider Organization Name (Legal Business Name)", {"A" * 125: "A" * 120, "A": None}),
        ("Healthcare Provider Primary Taxonomy Switch_1", {"y": "Y", "N": "N", "X": None}),
        (ENTITY_TYPE, {"1.0": "1", "2": "2", "7": None}),
        (f"Provider {MAILING} State Name", {"new york": "NY", "NewYork": "NY", "ca": "CA", "Ontario": None, "D.C.": None}),
    ],
)
def test_value_repairs(spark, column, pairs):
    got = values(spark, list(pairs), lambda v: fixes.fix_value(v, RULES[column], column, as_of=AS_OF, address_states=ADDRESS_STATES))
    assert dict(zip(pairs, got)) == pairs


def test_numeric_repair_writes_like_python(spark):
    texts = ["1,234.56", "5", "-0.25", "12345678", "1e3", "123456789.5", "0.0005", "abc"]
    want = [None if t == "abc" else str(float(t.replace(",", ""))) for t in texts]
    assert values(spark, texts, fixes.fix_numeric) == want


def test_city_suffix_flag(spark):
    rule, name = RULES[f"Provider {MAILING} City Name"], f"Provider {MAILING} City Name"
    assert values(spark, ["NEW YORK, NY"], lambda v: fixes.fix_regex(v, rule, name, address_states=ADDRESS_STATES, city_suffix="strip_suffix")) == ["NEW YORK"]


def test_degrees(spark):
    texts = ["Smith, MD", "Johnson, MD, PhD", "Smith, Company", "Smith", None, "MD", "Lee, P.A.-C."]
    assert [tuple(x) for x in values(spark, texts, fixes.split_name_and_degree)] == [("Smith", "MD"), ("Johnson, MD", "PhD"), (None, None), (None, None), (None, None), (None, None), ("Lee", "P.A.-C.")]
    assert values(spark, ["LCSW, LPC", "md", "MD, something", "x", ""], fixes.is_degree) == [True, True, True, False, False]


def test_postal_and_states(spark):
    assert values(spark, ["917.0", "9180", "91803-1100", "91803100", "9635012001", None, "abc"], states.normal_postal_code) == ["00917", "09180", "91803", "91803100", "96350", None, None]
    assert values(spark, ["new york", "NewYork", "AE", "U.S. Virgin Islands", "tx"], states.state_code) == ["NY", "NY", None, "VI", "TX"]
    df = spark.createDataFrame([("", "90210", None), ("AE", "90210", None), ("ohio", None, None), ("", None, "1 Texas Rd"), ("APO AP", None, None)], "s string, p string, a string")
    got = [r[0] for r in df.select(states.infer_state(F.col("s"), address=F.col("a"), postal_code=F.col("p"))).collect()]
    assert got == ["CA", None, "OH", "TX", "AP"]


def test_foreign_postal(spark):
    rows = [("T4L 1Z3", "CA", True), ("T4L 1Z3", "MX", False), ("SW1 1AA", "GB", True), ("3000", "AU", True), ("12345", "DE", True), ("ABC", "FR", True), ("90210", "US", False), ("ZIP 1", None, True), (None, "CA", False)]
    df = spark.createDataFrame(rows, "p string, c string, x boolean")
    assert all(r[0] == r[1] for r in df.select(states.foreign_postal(F.col("p"), F.col("c")), "x").collect())


def test_infer_city(spark):
    texts = ["12 Main St, Springfield, IL", "9 Elm Road; Boston; Suite 4", "PO Box 7", None, "Oak Ave, New Haven, CT"]
    assert values(spark, texts, states.infer_city) == ["SPRINGFIELD", "BOSTON", None, None, "NEW HAVEN"]
    cities = F.create_map(F.lit("BOSTON"), F.lit("MA"))
    assert values(spark, ["Boston, Springfield Hill"], lambda v: states.infer_city(v, F.lit("ma"), cities)) == ["BOSTON"]


def test_catalogue():
    assert len(focused_columns()) == 43 and set(RULES) == set(focused_columns())
    assert RULES["NPI"].rule_id == "NPI_FORMAT"
    assert RULES[f"Provider {MAILING} Country Code (If outside U.S.)"].rule_id == "PROVIDER_BUSINESS_MAILING_ADDRESS_COUNTRY_CODE_FORMAT"


def test_rules_from_yaml(tmp_path):
    from assayer.sources.catalog import load_rules

    (tmp_path / "r.yaml").write_text("rules:\n  A b:\n    rule_type: length\n    rule_config: {min: 1}\n  C:\n    rule_id: X\n")
    found = load_rules(tmp_path)
    assert list(found) == ["A b"] and found["A b"].rule_id == "A_B_FORMAT"
