"""Writers that refuse to overwrite, and reports with every value escaped.

Defined cases: an empty result is written as an empty table; nulls stay null in JSON and are empty cells in HTML; nothing is written
where a rule is broken, and an existing path is never overwritten.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import core


class ContractViolation(ValueError):
    """Raised by fail_closed(), with the first violations."""


def fail_closed(violations: DataFrame, show: int = 20) -> None:
    """Raises if there is any violation.  Call it before the write that the rules guard."""
    found = violations.limit(show).collect()
    if found:
        raise ContractViolation("; ".join(str(r.asDict()) for r in found))


def create_lines(df: DataFrame, path: str) -> None:
    """JSON lines; an existing path is an error."""
    df.write.mode("errorifexists").json(path)


def create_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def create_report(spark: SparkSession, sections: dict[str, DataFrame], path: str, most: int = 1000) -> None:
    """One JSON object, {section: [rows]}, in a new folder; sections are small aggregates, and one of over `most` rows is refused.

    Rows come in the order of their columns.  An empty section is an empty list; an existing path is an error.
    """
    one = spark.range(1).select(F.lit(1).alias("__k"))
    for name, df in sections.items():
        if df.limit(most + 1).count() > most:
            raise ContractViolation(f"section {name} has over {most} rows")
        one = one.join(df.agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name)))
    create_lines(one.drop("__k").coalesce(1), path)


def training_rows(evaluations: DataFrame, runs: DataFrame, sft: str, preference: str) -> DataFrame:
    """Writes approved candidates as SFT or preference rows; returns the counts by kind.

    evaluations: case_id, run_id, model_id, split, kind, review_status, ideal_response, chosen, rejected.  A row
    that isn't approved is a skip; an approved one must be of the dev split and have a run (case_id, model_id,
    run_id, prompt, seq): by run_id, else by case and model.
    """
    approved = F.coalesce(F.col("review_status") == "approved", F.lit(False))
    found = core.fallback_join(evaluations, runs.select(F.col("run_id").alias("r"), F.col("case_id").alias("c"), F.col("model_id").alias("m"), "prompt", "seq"), ("run_id", "r"), (["case_id", "model_id"], ["c", "m"]), "prompt", "seq")
    rules = F.array_compact(F.array(
        F.when(approved & (F.col("split") != "dev"), "SPLIT_NOT_DEV"), F.when(approved & F.col("matched_by").isNull(), "RUN_MISSING"),
        F.when(approved & (F.col("kind") == "sft") & F.col("ideal_response").isNull(), "NO_RESPONSE"),
        F.when(approved & (F.col("kind") == "preference") & (F.col("chosen").isNull() | F.col("rejected").isNull() | F.coalesce(F.col("chosen") == F.col("rejected"), F.lit(False))), "NO_PREFERENCE"),
    ))
    fail_closed(found.select("case_id", F.explode(rules).alias("rule")))
    kept = found.where(approved)
    create_lines(kept.where("kind = 'sft'").select("case_id", "prompt", F.col("ideal_response").alias("response")), sft)
    create_lines(kept.where("kind = 'preference'").select("case_id", "prompt", "chosen", "rejected"), preference)
    return found.groupBy(F.when(approved, F.col("kind")).otherwise("skipped").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def html_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small aggregate as HTML; larger results are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    cell = lambda tag, v: f"<{tag}>{escape('' if v is None else str(v), quote=True)}</{tag}>"
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows)
    return f"<h1>{escape(title)}</h1><table><tr>{''.join(cell('th', c) for c in df.columns)}</tr>{body}</table>"


def markdown_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small aggregate as Markdown; pipes are escaped, larger results are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    line = lambda cells: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)]) + "\n"


def visible(cases: DataFrame, allowed: list[str], sentinel: str | None = None) -> DataFrame:
    """Only the allowed columns; with a sentinel, any visible text that holds it is a violation."""
    out = cases.select(*allowed)
    if sentinel is not None:
        fail_closed(out.where(F.contains(F.to_json(F.struct("*")), F.lit(sentinel))).select(F.lit("HIDDEN_FIELD_VISIBLE").alias("rule")))
    return out
