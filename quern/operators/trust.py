"""Trust of training sources: policies, authenticated files, materialised cases, partition decisions, exports.

Everything is a table: what breaks a rule is a row of (entity, rule), and callers fail closed on them.  Nulls in keys are
violations; rows that repeat are reported once as repeated; empty tables give empty results, and an empty policy trusts nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X

from .governance import inside_folder, missing, repeated, union, violations

#: Keys that a payload's digest leaves out, splits, and the parts of a case's core.
PROVENANCE_KEYS = ("_training_export_context", "benchmark_provenance.materialized_payload_sha256")
SPLITS, TRAINING_SPLIT = ["dev", "regression", "heldout"], "dev"
CORE_FIELDS = ("task_type", "data_origin", "patient_context", "evidence_snapshot", "interaction", "expected_behavior", "graph_eval", "safety", "scoring")


def payload_digest(text: Column, without: tuple[str, ...] = PROVENANCE_KEYS) -> Column:
    """SHA-256 of a JSON object's canonical text without some dotted keys; null if the text is null or no object."""

    def of(s: str) -> str | None:
        try:
            body = json.loads(s)
        except ValueError:
            return None
        if not isinstance(body, dict):
            return None
        for path in without:
            *parents, key = path.split(".")
            at = body
            for p in parents:
                at = at.get(p) if isinstance(at, dict) else None
            if isinstance(at, dict):
                at.pop(key, None)
        return sha256(X.canonical_text(body).encode()).hexdigest()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([None if not v.is_valid else of(v.as_py()) for v in values], pa.string())

    return run(text)


def core_digest(text: Column, fields: tuple[str, ...] = CORE_FIELDS) -> Column:
    """SHA-256 of the canonical text of the fields that make a case what it is, absent ones as null."""

    def of(s: str) -> str:
        body = json.loads(s)
        return sha256(X.canonical_text({f: body.get(f) for f in fields}).encode()).hexdigest()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([None if not v.is_valid else of(v.as_py()) for v in values], pa.string())

    return run(text)


def aggregate_digest(files: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """(files, aggregate): one digest of the sorted lines `digest  path`, joined by newlines; no files give that of nothing.

    Spark sorts the lines by ranges; they pass through one digest in their order, a batch at a time, and are never gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, h = 0, sha256()
        for batch in batches:
            for line in batch["line"].to_pylist():
                h.update(("\n" if n else "").encode() + line.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([h.hexdigest()])], names=["files", "aggregate"])

    lines = files.select(F.concat(F.col(digest), F.lit("  "), F.col(path)).alias("line")).where("line is not null").orderBy("line")
    one = lines.coalesce(1).mapInArrow(run, "files long, aggregate string").agg(F.max("files").alias("f"), F.max("aggregate").alias("a"))
    return one.select(F.coalesce("f", F.lit(0)).cast("long").alias("files"), F.coalesce("a", F.lit(sha256(b"").hexdigest())).alias("aggregate"))


def policy_violations(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """(entity, rule) of a policy: cases (case_id, split, blob, core), ordinary sources (path, case_id, blob, core).

    Ids must be in their compatible form and unique over both; blobs are unique; no core lies in several splits, and no
    ordinary source has the core of a benchmark case.
    """
    every = cases.select("case_id", "blob").unionByName(sources.select("case_id", "blob"))
    core = cases.where("core is not null")
    across = core.groupBy("core").agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.col("core").alias("entity"), F.lit("CORE_IN_SEVERAL_SPLITS").alias("rule"))
    derived = sources.join(core.select("core").distinct(), "core", "left_semi").select(F.col("path").alias("entity"), F.lit("SOURCE_DERIVED_FROM_BENCHMARK").alias("rule"))
    own = violations(cases, "case_id", {"MISSING_ID": F.coalesce(F.trim("case_id"), F.lit("")) == "", "ID_NOT_CANONICAL": ~X.is_nfkc(F.col("case_id")), "UNKNOWN_SPLIT": ~F.coalesce(F.col("split").isin(SPLITS), F.lit(False)), "MISSING_BLOB": F.col("blob").isNull()})
    return union(own, repeated(every, ["case_id"], "REPEATED_ID"), repeated(every.where("blob is not null"), ["blob"], "REPEATED_BLOB"), across, derived)


def authentication(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(entity, rule) of trusted entries (path, base, blob) whose file (path, content) is missing, outside its folder or not the one trusted."""
    found = files.select("path", X.git_blob_sha1(F.col("content")).alias("observed"))
    j = entries.join(found, "path", "left")
    inside = inside_folder(F.col("base"), F.expr("CASE WHEN startswith(path, concat(base, '/')) THEN substring(path, length(base) + 2) ELSE path END")) & F.startswith("path", F.concat("base", F.lit("/")))
    return violations(j, "path", {"OUTSIDE_FOLDER": ~F.coalesce(inside, F.lit(False)), "FILE_MISSING": F.col("observed").isNull(), "BLOB_MISMATCH": F.col("observed").isNotNull() & ~F.col("observed").eqNullSafe(F.col("blob"))})


def materialised(refs: DataFrame, cases: DataFrame, suite: dict[str, str], allowed: list[str], prohibited: list[str]) -> DataFrame:
    """Cases with provenance and eligibility: case_id, family_id, split, variant_type, training_eligible, body, payload_sha256.

    refs: family_id, case_id, split, variant_type, path; cases: path, case_json.  A suite that allows another split than dev,
    or doesn't prohibit heldout and regression, is refused.
    """
    if set(allowed) - {TRAINING_SPLIT} or not {"heldout", "regression"} <= set(prohibited) or set(allowed) & set(prohibited):
        raise ValueError("the suite's training splits are unsafe")
    eligible = F.col("split").isin(allowed or [""]) & ~F.col("split").isin(prohibited)
    j = refs.join(cases, "path")
    bound = F.struct(
        *[F.lit(v).alias(k) for k, v in sorted(suite.items())], "family_id", "split", "variant_type", F.col("path").alias("source_case_path"), F.sha2("case_json", 256).alias("source_case_sha256"), eligible.alias("training_eligible")
    )
    body = F.concat(F.lit('{"benchmark_provenance":'), F.to_json(bound), F.lit(',"case":'), F.col("case_json"), F.lit("}"))
    return j.select("case_id", "family_id", "split", "variant_type", eligible.alias("training_eligible"), body.alias("body")).withColumn("payload_sha256", payload_digest(F.col("body")))


def materialisation_summary(rows: DataFrame) -> DataFrame:
    """split (null: all), cases, eligible, blocked, families."""
    return rows.groupingSets([["split"], []], "split").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("training_eligible").alias("eligible"), F.count_if(~F.col("training_eligible")).alias("blocked"), F.countDistinct("family_id").alias("families")
    )


def partition_decisions(cases: DataFrame, authority: DataFrame, sources: DataFrame) -> DataFrame:
    """(case_id, split, eligible, reason) of every case that asks to be trained on; reason is null where it may.

    cases: case_id, payload (its JSON), declared_split; authority (materialised benchmark cases): case_id, split,
    training_eligible, payload_sha256; sources (ordinary ones): case_id, payload_sha256.  A payload must be exactly what
    its authority says, and a case that declares a split needs a benchmark authority.
    """
    own = cases.select("case_id", "declared_split", payload_digest(F.col("payload")).alias("__d"))
    a = authority.select("case_id", F.col("split").alias("__split"), F.col("training_eligible").alias("__ok"), F.col("payload_sha256").alias("__a"))
    s = sources.select("case_id", F.col("payload_sha256").alias("__s"))
    j = own.join(a, "case_id", "left").join(s, "case_id", "left")
    bench, plain = F.col("__a").isNotNull(), F.col("__s").isNotNull()
    reason = (
        F.when(bench & ~F.col("__d").eqNullSafe(F.col("__a")), "PAYLOAD_DIVERGES_FROM_AUTHORITY").when(bench & ~F.col("__ok"), "SPLIT_IS_EVALUATION_ONLY").when(bench & (F.col("__split") != TRAINING_SPLIT), "SPLIT_NOT_ALLOWED").when(bench, None)
        .when(F.col("declared_split").isNotNull(), "PARTITIONED_WITHOUT_AUTHORITY").when(~plain, "NO_AUTHORITY").when(~F.col("__d").eqNullSafe(F.col("__s")), "PAYLOAD_DIVERGES_FROM_SOURCE")
    )
    return j.select("case_id", F.col("__split").alias("split"), reason.isNull().alias("eligible"), reason.alias("reason"))


def export_rows(candidates: DataFrame, gate: DataFrame) -> DataFrame:
    """candidates with `exported` (sft, preference, skipped, blocked) and `why`.

    candidates: case_id, kind, review_status, ideal, chosen, rejected; gate: case_id, decision (ALLOW, REVIEW, BLOCK).  Only
    approved candidates of a case that the lineage gate allows are exported; an approved one without its texts is a
    violation that the caller fails on (why begins with MISSING).
    """
    j = candidates.join(gate.select("case_id", F.col("decision").alias("__g")), "case_id", "left")
    best = F.coalesce("ideal", "chosen")
    approved = F.coalesce(F.col("review_status") == "approved", F.lit(False))
    why = (
        F.when(~approved, "NOT_APPROVED").when(F.coalesce(F.col("kind"), F.lit("none")) == "none", "NO_KIND").when(F.col("__g").isNull(), "NO_DECISION").when(F.col("__g") == "BLOCK", "LINEAGE_BLOCK").when(F.col("__g") == "REVIEW", "LINEAGE_REVIEW")
        .when(best.isNull(), "MISSING_IDEAL").when((F.col("kind") == "preference") & F.col("rejected").isNull(), "MISSING_REJECTED").when((F.col("kind") == "preference") & (F.col("rejected") == best), "MISSING_DIFFERENCE")
    )
    out = j.withColumn("why", why)
    exported = F.when(F.col("why").isNull(), F.col("kind")).when(F.col("why").isin("NOT_APPROVED", "NO_KIND"), "skipped").otherwise("blocked")
    return out.withColumn("exported", exported).drop("__g")


def export_manifest(rows: DataFrame) -> DataFrame:
    """(exported, why, n) of export_rows()."""
    return rows.groupBy("exported", "why").agg(F.count(F.lit(1)).alias("n"))


def unknown_cases(evaluations: DataFrame, cases: DataFrame) -> DataFrame:
    return missing(evaluations, "case_id", cases, "case_id", "UNKNOWN_CASE")
