"""One scenario for each rule, label aliases, and the agreement of labels with explanations."""

import pytest
from pyspark.sql import functions as F

from veriloom.operators import pairs, rules


def fact(id, text, value=None, **more):
    base = dict.fromkeys([c for c, _ in pairs.FIELDS]) | {"id": id, "text": text, "source_document": f"doc{id}"}
    base |= {"value_num": float(value)} if isinstance(value, (int, float)) else {"value_str": value}
    return base | more


def judge(spark, f1, f2, label, explanation="", confidence="0.9"):
    kind = "struct<" + ",".join(f"{c}:{t}" for c, t in pairs.FIELDS) + ">"
    rows = spark.createDataFrame([(f1, f2, label, confidence, explanation, None)], f"f1 {kind}, f2 {kind}, relationship string, confidence string, explanation string, context_notes string")
    return rules.judge(rows).collect()[0]


SAME = {"entity": "Acme", "time_period": "FY24"}


@pytest.mark.parametrize(
    ("f1", "f2", "label", "rule", "result"),
    [
        (fact("1", "Acme earned 100", 100, **SAME), fact("2", "Acme earned 100", 100, **SAME), "contradicts", 1, "corroborates"),
        (fact("1", "Acme earned about 8,140", 8140, **SAME), fact("2", "Acme earned 8,141", 8141, **SAME), "contradicts", 1, "corroborates"),
        (fact("1", "Acme planned 120 buses", 120, **SAME), fact("2", "96 buses entered service", 96, **SAME), "contradicts", 2, "reconciled"),
        (fact("1", "Acme had 5", 5, entity="Acme", time_period="FY23"), fact("2", "Acme had 9", 9, **SAME), "contradicts", 2, "reconciled"),
        (fact("1", "Acme had 96 rather than the 120 expected", 96, **SAME), fact("2", "Acme had 120", 120, **SAME), "contradicts", 2, "reconciled"),
        (fact("1", "Heat caused deaths", None, **SAME), fact("2", "Heat correlated with deaths", None, **SAME), "contradicts", 3, "reconciled"),
        (fact("1", "Acme has 5", 5, entity="Acme"), fact("2", "Acme has 9", 9, entity="Acme"), "contradicts", 4, "insufficient_context"),
        (fact("1", "Acme has 5", 5, **SAME), fact("2", "Beta has 9", 9, entity="Beta", time_period="FY24"), "contradicts", 5, "insufficient_context"),
        (fact("1", "Acme has 5", 5, **SAME), fact("2", "Acme has 9", 9, **SAME), "contradicts", 0, "contradicts"),
        (fact("1", "Acme has 5", 5, **SAME), fact("2", "Acme has 9", 9, **SAME), "reconcile", 6, "contradicts"),
        (fact("1", "Acme has 5", 5, **SAME), fact("2", "Acme has 5", 5, **SAME), "reconciled", 6, "corroborates"),
        (fact("1", "Acme has 5", 5, **SAME), fact("2", "Acme has 9", 9, **SAME), "corroborate", 0, "corroborates"),
        (fact("1", "Acme has 5", "5 units", **SAME), fact("2", "Acme has 5", "5", **SAME), "contradicts", 1, "corroborates"),
        (fact("1", None), fact("2", None), None, 0, "unrelated"),
    ],
)
def test_rules(spark, f1, f2, label, rule, result):
    out = judge(spark, f1, f2, label)
    assert (out.rule, out.relationship) == (rule, result)
    assert "guardrail" not in out.explanation.lower()


def test_explanation_of_a_rule(spark):
    out = judge(spark, fact("1", "Acme has 5.", 5, **SAME), fact("2", "Acme has 5 ", 5, **SAME), "contradicts")
    assert out.explanation.startswith("Fact 1 states: Acme has 5. Fact 2 states: Acme has 5. The two values are consistent")


@pytest.mark.parametrize(
    ("label", "explanation", "relationship", "told"),
    [
        ("contradicts", "The facts are consistent.", "corroborates", "The facts are consistent."),
        ("corroborates", "They agree.", "corroborates", "They agree."),
        ("contradicts", "Numbers are far apart.", "contradicts", "Numbers are far apart. The facts assert mutually"),
        ("unrelated", "A different scope.", "reconciled", "A different scope."),
        ("contradicts", "", "contradicts", ""),
        ("corroborates", "Not enough said; a conflict", "insufficient_context", "Not enough said; a conflict"),
    ],
)
def test_agreement(spark, label, explanation, relationship, told):
    rows = spark.createDataFrame([(label, explanation)], "relationship string, explanation string")
    out = rules.consistent(rows).collect()[0]
    assert out.relationship == relationship and out.explanation.startswith(told)


def test_confidence_is_clamped(spark):
    assert [judge(spark, fact("1", "a"), fact("2", "b"), "unrelated", confidence=c).confidence for c in ("7", "-1", "x", None, "0.25")] == [1.0, 0.0, 0.0, 0.0, 0.25]


def test_status(spark):
    rows = spark.createDataFrame([("they planned it",), ("it was delivered",), ("planned and delivered",), ("nothing",), (None,)], "text string")
    assert [r.s for r in rows.select(rules.status(F.struct("text")).alias("s")).collect()] == ["plan", "actual", "mixed", "unknown", "unknown"]


def test_each_cue_is_looked_for_once(spark):
    """Also below a condition on the outcome and for several verdicts on a pair: otherwise the work grows with each use."""
    from veriloom import queries

    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    for name in ("relationship_summary", "comparisons", "top3_per_label", "guardrail_labels"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("precipitated") == 2, name
        assert plan.count("mutually exclusive") <= 1, name
        assert "Repartition" in plan, name
    spark.conf.unset("spark.sql.debug.maxToStringFields")
