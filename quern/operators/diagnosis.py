"""Hypotheses on failed runs, graded by controls that differ in one factor only.

A run that failed is supported by a run of the same stratum and criterion that passed, all of whose factors but one are
equal.  For each factor, runs are keyed by a hash of all the others, and grouped; a group keeps, for each value of the factor
that passed, its least run, and of those the two least, so that every failed run finds one of another value.  Pairs are never
listed, however many runs share a key.

Null factors are values like others; a null outcome is unassessed, neither failure nor control; runs with equal ids are runs
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may be behind a failure in a module.
CANDIDATES = {
    "C1": ["algorithm_policy", "engineering"], "C2": ["algorithm_policy"], "C3": ["algorithm_policy", "engineering"], "C4": ["algorithm_policy", "data_knowledge"],
    "C5": ["data_knowledge", "algorithm_policy", "engineering"], "C6": ["engineering", "algorithm_policy"], "C7": ["algorithm_policy", "engineering"], "C8": ["algorithm_policy", "engineering"],
}
#: Grades, by what can be seen of a run.
GRADES = {"instrumented": "verified_under_test", "black_box": "supported_hypothesis"}
OPEN = "needs_investigation"


def controls(runs: DataFrame, run: str, same: list[str], factors: list[str], outcome: str = "outcome") -> DataFrame:
    """(run, same, factor, control, was, now): for failed runs, one passed run of equal `same` that differs in one factor only."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    others = lambda f: F.sha2(F.concat_ws("\x1f", F.lit(f), *[text(c) for c in [*same, *[x for x in factors if x != f]]]).cast("binary"), 256)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), text(f).alias("value"), others(f).alias("k")) for f in factors])).alias("x")
    long = runs.where(F.col(outcome).isin("fail", "pass")).select(F.col(run).alias("run"), *same, F.col(outcome).alias("o"), each).select("run", *same, "o", "x.*")
    passed = long.where("o = 'pass'").groupBy("k", "value").agg(F.min("run").alias("run"))
    # a value's least run, and of all values the two least: one of them has another value than the failed run's
    two = passed.groupBy("k").agg(F.min(F.struct("value", "run")).alias("a"), F.max(F.struct("value", "run")).alias("b"))
    j = long.where("o = 'fail'").join(two, "k")
    pick = F.when(F.col("a.value") != F.col("value"), F.col("a")).when(F.col("b.value") != F.col("value"), F.col("b"))
    return j.withColumn("c", pick).where("c is not null").select("run", *same, "factor", F.col("c.run").alias("control"), F.nullif("value", F.lit("\0")).alias("was"), F.nullif(F.col("c.value"), F.lit("\0")).alias("now"))


def hypotheses(runs: DataFrame, run: str, same: list[str], factors: list[str], module: str = "module", observability: str = "observability", outcome: str = "outcome") -> DataFrame:
    """(run, same, category, evidence_level, factor, control): for failed runs, what controls support, and candidates of the module that none does.

    A control's category is its factor's name.  An observability other than the two is an error of its row: it has no grade, and is left out.
    """
    failed = runs.where(F.col(outcome) == "fail").select(F.col(run).alias("run"), *same, F.col(module).alias("module"), F.col(observability).alias("seen"))
    grade = F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])
    own = controls(runs, run, same, factors, outcome).join(failed.select("run", *same, "seen").distinct(), ["run", *same])
    backed = own.select("run", *same, F.col("factor").alias("category"), F.try_element_at(grade, "seen").alias("evidence_level"), "factor", "control").where("evidence_level is not null")
    behind = F.create_map(*[x for m, cs in CANDIDATES.items() for x in (F.lit(m), F.array(*[F.lit(c) for c in cs]))])
    none = F.lit(None).cast("string")
    open_ = failed.select("run", *same, F.explode(F.try_element_at(behind, "module")).alias("category"), F.lit(OPEN).alias("evidence_level"), none.alias("factor"), F.lit(None).cast(runs.schema[run].dataType).alias("control")).distinct()
    return backed.union(open_)
