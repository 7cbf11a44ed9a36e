"""The rules that check a model's verdict on two facts against what the facts say, as expressions over f1 and f2.

Every signal is true or false, never null.  The rules are one ordered CASE, so the number of the rule that fired can be shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import fixed, scalars
from veriloom.functions.text import capitalize, clean_claim, normalize



def canonical_label(label: Column) -> Column:
    names = fixed.LABEL_ALIASES | {name: name for name in fixed.LABELS}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(known[F.lower(F.trim(label))], F.lit("unrelated"))


def clamped(confidence: Column) -> Column:
    return F.least(F.greatest(F.coalesce(confidence.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def number(f: Column) -> Column:
    return F.coalesce(f["value_num"], scalars.plain_number(f["value_str"]))


def status(f: Column) -> Column:
    text = normalize(f["text"])
    plan, actual = text.rlike(fixed.PLAN), text.rlike(fixed.ACTUAL)
    return F.when(plan & actual, "mixed").when(plan, "plan").when(actual, "actual").otherwise(F.lit("unknown"))


def close(a: Column, b: Column, relative: float = 1e-9) -> Column:
    return (a == b) | (F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b)))


def _both_differ(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a != b)


def reading(f: Column) -> Column:
    """What the signals need of a fact: its texts normalised once, and each cue looked for once."""
    begin = F.struct(normalize(f["text"]).alias("said"), number(f).alias("number"), *[normalize(f[c]).alias(c) for c in ("unit", "entity", "time_period", "scope")])

    def cues(p: Column) -> Column:
        says = lambda pattern: _sure(p["said"].rlike(pattern))
        stated = F.regexp_replace(scalars._group(p["said"], fixed.CONTRAST, 1), ",", "").try_cast("double")
        return F.struct(
            *[p[c].alias(c) for c in ("number", "unit", "entity", "time_period", "scope")],
            F.array_sort(F.array_distinct(F.regexp_extract_all(p["said"], F.lit(fixed.SCOPE), F.lit(1)))).alias("cues"), stated.alias("stated"),
            says(fixed.PLAN).alias("plan"), says(fixed.ACTUAL).alias("actual"), says(fixed.CUMULATIVE).alias("cumulative"), says(fixed.REVISED).alias("revised"),
            says(fixed.APPROXIMATE).alias("approximate"), says(fixed.PERCENT_POINT).alias("percent_points"), says(fixed.CAUSAL).alias("causal"),
            says(fixed.CORRELATION).alias("correlated"), says(fixed.NEGATION).alias("negated"),
        )

    return scalars.let(begin, cues)


def signals(f1: Column, f2: Column, tolerance: float = 0.02) -> dict[str, Column]:
    """All signals by name, as expressions that read both facts each time; `with_signals` reads them once."""
    return _signals(reading(f1), reading(f2), tolerance)


def with_signals(rows: DataFrame, tolerance: float = 0.02, to: str = "s") -> DataFrame:
    """Rows with f1 and f2, and all signals as one struct.  Rows are settled between the steps, so nothing is read twice, whatever stands above."""
    rows = scalars.settled(rows.withColumns({"__1": reading(F.col("f1")), "__2": reading(F.col("f2"))}))
    s = _signals(F.col("__1"), F.col("__2"), tolerance)
    return scalars.settled(rows.withColumn(to, F.struct(*[c.alias(k) for k, c in s.items()])).drop("__1", "__2"))


def _signals(a: Column, b: Column, tolerance: float) -> dict[str, Column]:
    v1, v2 = a["number"], b["number"]
    contrast = lambda stated, other: _sure(close(stated, other) & ~close(v1, v2))
    only = lambda p, one, two: p[one] & ~p[two]
    approximate = a["approximate"] | b["approximate"]
    present = v1.isNotNull() & v2.isNotNull()
    near = _sure(F.when(approximate, F.abs(v1 - v2) <= tolerance * F.greatest(F.abs(v1), F.abs(v2), F.lit(1.0))).otherwise(close(v1, v2)))
    out = {
        "values_present": present,
        "values_close": near,
        "values_conflict": present & ~near,
        "period_differs": _both_differ(a["time_period"], b["time_period"]),
        "scope_differs": _both_differ(a["scope"], b["scope"]),
        "units_differ": _both_differ(a["unit"], b["unit"]),
        "scope_cues_differ": (F.size(a["cues"]) > 0) & (F.size(b["cues"]) > 0) & (a["cues"] != b["cues"]),
        "plan_contrast": contrast(a["stated"], v2) | contrast(b["stated"], v1),
        "opposite_status": (only(a, "plan", "actual") & only(b, "actual", "plan")) | (only(a, "actual", "plan") & only(b, "plan", "actual")),
        "cumulative_or_revised": a["cumulative"] | b["cumulative"] | a["revised"] | b["revised"],
        "approximate": approximate,
        "percent_points": a["percent_points"] | b["percent_points"],
        "causal_vs_correlated": (a["causal"] & b["correlated"]) | (b["causal"] & a["correlated"]),
        "negated": a["negated"] | b["negated"],
        "periods_unknown": (a["time_period"] == "") & (b["time_period"] == ""),
        "not_comparable": (a["entity"] == "") | (b["entity"] == "") | (a["entity"] != b["entity"]) | (a["time_period"] == "") | (b["time_period"] == ""),
    }
    out = {k: _sure(v) for k, v in out.items()}
    context = F.lit(False)
    for k in ("period_differs", "scope_differs", "units_differ", "scope_cues_differ", "plan_contrast", "opposite_status", "cumulative_or_revised", "approximate", "percent_points"):
        context = context | out[k]
    return out | {"reconciling_context": context, "basis_differs": out["units_differ"] | out["percent_points"]}


def rule(label: Column, s: dict[str, Column]) -> Column:
    """Number of the first rule that fires, 0 for none."""
    contradicts = label == "contradicts"
    return (
        F.when(contradicts & s["values_present"] & s["values_close"] & ~s["basis_differs"], 1)
        .when(contradicts & s["values_present"] & (s["values_conflict"] | s["basis_differs"]) & s["reconciling_context"], 2)
        .when(contradicts & s["causal_vs_correlated"], 3)
        .when(contradicts & s["values_conflict"] & s["periods_unknown"] & ~s["opposite_status"], 4)
        .when(contradicts & s["values_conflict"] & ~s["reconciling_context"] & s["not_comparable"], 5)
        .when((label == "reconciled") & ~s["reconciling_context"], 6)
        .otherwise(F.lit(0))
    )


def ruled_label(label: Column, fired: Column, conflict: Column) -> Column:
    return (
        F.when(fired == 1, "corroborates")
        .when(fired.isin(2, 3), "reconciled")
        .when(fired.isin(4, 5), "insufficient_context")
        .when((fired == 6) & conflict, "contradicts")
        .when(fired == 6, "corroborates")
        .otherwise(label)
    )


def explained(f1: Column, f2: Column, reason: Column) -> Column:
    a, b = clean_claim(f1["text"]), clean_claim(f2["text"])
    base = F.concat(capitalize(F.regexp_replace(reason, r"[ .]+$", "")), F.lit("."))
    return F.when((a != "") & (b != ""), F.concat(F.lit("Fact 1 states: "), a, F.lit(". Fact 2 states: "), b, F.lit(". "), base)).otherwise(base)


def _hits(text: Column) -> Column:
    """Of each label, whether a lower-case explanation has its cues and whether it names it."""
    return F.struct(*[c for label, cues in fixed.EXPLAINS for c in (
        text.rlike(cues).alias(label), (F.contains(text, F.lit(f'"{label}"')) | F.contains(text, F.lit(label.replace("_", " ")))).alias(f"named_{label}"))])


def _implied(hits: Column) -> Column:
    first = lambda hit: F.coalesce(*[F.when(hit(label), F.lit(label)) for label, _ in fixed.EXPLAINS])
    return F.coalesce(first(lambda label: hits[label] & hits[f"named_{label}"]), first(lambda label: hits[label]))


def implied_label(explanation: Column) -> Column:
    """The label an explanation speaks for, null if for none: of those it has cues of the first that it also names, else the first."""
    return scalars.let(_hits(F.lower(explanation)), _implied)


def _own_cue(label: Column, hits: Column) -> Column:
    out = F.lit(False)
    for name, _ in fixed.EXPLAINS:
        out = F.when(label == name, hits[name]).otherwise(out)
    return out


def agreed(label: Column, explanation: Column) -> Column:
    """(relationship, explanation) made to agree: the label yields to an explanation that speaks only for another one; what still lacks a cue of its label gets a sentence."""
    carried = lambda p, *names: [p[c].alias(c) for c in names]

    def searched(p: Column) -> Column:
        return F.struct(*carried(p, "label", "text", "given"), (F.regexp_replace(p["text"], r"(?U)\s+", "") == "").alias("blank"), _hits(p["low"]).alias("hits"))

    def relabel(p: Column) -> Column:
        other = _implied(p["hits"])
        keep = p["blank"] | _own_cue(p["label"], p["hits"]) | other.isNull()
        return F.struct(F.when(keep, p["label"]).otherwise(other).alias("label"), *carried(p, "text", "blank", "given", "hits"))

    def complete(p: Column) -> Column:
        more = F.lit(None).cast("string")
        for name, sentence in fixed.SUPPORT.items():
            more = F.when(p["label"] == name, F.lit(sentence)).otherwise(more)
        lacks = ~p["blank"] & more.isNotNull() & ~_own_cue(p["label"], p["hits"])
        told = F.when(lacks, F.concat(F.regexp_replace(p["text"], r"[ .]+$", ""), F.lit(". "), more)).otherwise(p["given"])
        return F.struct(p["label"].alias("relationship"), told.alias("explanation"))

    text = F.coalesce(explanation, F.lit(""))
    begin = F.struct(label.alias("label"), text.alias("text"), F.lower(text).alias("low"), explanation.alias("given"))
    return scalars.let(begin, lambda p: scalars.let(searched(p), lambda q: scalars.let(relabel(q), complete)))


def consistent(rows: DataFrame, label: str = "relationship", explanation: str = "explanation") -> DataFrame:
    rows = rows.withColumn("__a", agreed(F.col(label), F.col(explanation)))
    return rows.withColumns({label: F.col("__a.relationship"), explanation: F.col("__a.explanation")}).drop("__a")


def judge(verdicts: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """f1, f2, relationship, confidence, explanation, context_notes as a model gave them, to comparisons; `rule` says what changed the label.

    The steps are settled one after the other: each is computed once a row, also where a condition on the result follows.
    """
    rows = with_signals(verdicts.select("f1", "f2", "confidence", "context_notes", F.coalesce("explanation", F.lit("")).alias("__told"), canonical_label(F.col("relationship")).alias("__label")), tolerance, "__s")
    rows = rows.withColumn("rule", rule(F.col("__label"), {k: F.col("__s")[k] for k in rows.schema["__s"].dataType.names}))
    rows = scalars.settled(rows.withColumn("__label", ruled_label(F.col("__label"), F.col("rule"), F.col("__s.values_conflict"))).drop("__s"))
    key = F.when(F.col("rule") == 6, F.concat_ws(" ", F.lit("6"), "__label")).otherwise(F.col("rule").cast("string"))
    reason = F.create_map(*[F.lit(x) for pair in fixed.REASONS.items() for x in pair])[key]
    rows = rows.withColumn("__told", F.when(F.col("rule") > 0, explained(F.col("f1"), F.col("f2"), reason)).otherwise(F.col("__told")))
    rows = rows.select(F.coalesce("f1.id", F.lit("f1")).alias("fact1_id"), F.coalesce("f2.id", F.lit("f2")).alias("fact2_id"), "confidence", "context_notes", "rule", agreed(F.col("__label"), F.col("__told")).alias("v"))
    return scalars.settled(rows).select("fact1_id", "fact2_id", "v.relationship", clamped(F.col("confidence")).alias("confidence"), "v.explanation", "context_notes", "rule")


def related(comparisons: DataFrame) -> DataFrame:
    return comparisons.where(F.col("relationship") != "unrelated")
