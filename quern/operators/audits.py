"""Audits of notes, dialogues, review packets and source registries: counters and faults, never repairs.

Bodies that aren't what they should be are counted, not failed on.  Null texts hold no claims; repeated rows count each, unless
said otherwise; empty tables give empty results, and dialogue_audit() a row of zeros; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X

from .evaluation import rate

# ---- claims in notes

#: Headings whose lists are claims, and how a claim names its source.
CLAIM_HEADINGS = ("## 关系", "## 相关药物", "## 相关公司")
SOURCE = r"（?来源[:：]\s*(https?://[^\s）)]+)"
UNSUPPORTED, UNKNOWN = "UNSUPPORTED", "UNKNOWN"


def tier(url: Column, tiers: list[tuple[str, list[str]]], none: str = UNSUPPORTED) -> Column:
    """The first tier one of whose names the address contains."""
    rules = [F.when(reduce(lambda a, b: a | b, [F.contains(url, F.lit(n)) for n in names]), F.lit(level)) for level, names in tiers]
    return F.coalesce(*rules, F.lit(none))


def claims(notes: DataFrame, tiers: list[tuple[str, list[str]]], name: str = "name", body: str = "body", headings: tuple[str, ...] = CLAIM_HEADINGS) -> DataFrame:
    """(name, claim_id, text, url, level): the list lines below headings of relations, numbered within their note."""
    lines = notes.select(name, F.posexplode(F.split(F.col(body), "\n")).alias("__n", "__l")).withColumn("__l", F.trim("__l"))
    opens = reduce(lambda a, b: a | b, [F.startswith("__l", F.lit(h)) for h in headings])
    flag = F.when(opens, F.lit(True)).when(F.startswith("__l", F.lit("## ")), F.lit(False))
    w = Window.partitionBy(name).orderBy("__n")
    inside = F.coalesce(F.last(flag, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False))
    found = lines.withColumns({"__in": inside, "__head": opens}).where(F.col("__in") & ~F.col("__head") & F.col("__l").rlike("^- .+$"))
    url = F.regexp_extract("__l", SOURCE, 1)
    number = F.lpad(F.row_number().over(w).cast("string"), 4, "0")
    return found.select(
        name, F.concat(F.lit("C-"), F.substring(F.col(name), 1, 8), F.lit("-"), number).alias("claim_id"), F.substring(F.regexp_extract("__l", "^- (.+)$", 1), 1, 80).alias("text"), url.alias("url"),
        F.when(url == "", UNSUPPORTED).otherwise(tier(url, tiers)).alias("level"),
    )


def claim_levels(found: DataFrame, levels: list[str], name: str = "name") -> DataFrame:
    """(name, claims, one column for each level, unsupported_rate) of each note, and of all under a null name."""
    counts = [F.count_if(F.col("level") == level).alias(level.lower()) for level in levels]
    g = found.rollup(name).agg(F.count(F.lit(1)).alias("claims"), *counts)
    return g.withColumn("unsupported_rate", rate(F.col(UNSUPPORTED.lower()), F.col("claims")))


def best_tier(urls: DataFrame, tiers: list[tuple[str, list[str]]], key: str, url: str = "url") -> DataFrame:
    """(key, tier): the best tier of many addresses, UNKNOWN if none has one."""
    rank = reduce(lambda w, kv: w.when(F.col("__t") == kv[1], F.lit(kv[0])), enumerate(level for level, _ in tiers), F.when(F.lit(False), F.lit(0)))
    names = F.array(*[F.lit(level) for level, _ in tiers])
    g = urls.withColumn("__t", tier(F.col(url), tiers, UNKNOWN)).groupBy(key).agg(F.min(rank).alias("__r"))
    return g.select(key, F.coalesce(F.get(names, F.col("__r")), F.lit(UNKNOWN)).alias("tier"))


# ---- dialogues

COUNTERS = [
    "dialogues", "turns", "malformed_dialogues", "malformed_turns", "empty_dialogues", "empty_sentences", "invalid_roles", "missing_dialogue_ids", "missing_turn_ids", "duplicate_dialogue_ids", "duplicate_turn_ids",
    "adjacent_same_role_pairs", "dialogues_with_adjacent_same_role", "actions_present_turns", "actions_nonempty_turns", "actions_empty_turns", "actions_missing_or_nonlist_turns", "action_entries", "nondict_action_entries",
    "message_nonempty_turns", "exact_normalized_duplicate_dialogues", "schema_usable_unique_dialogues",
]


def _named(v: Column) -> Column:
    """A type and value that identify something: a text that isn't blank, or a whole number; else null."""
    kind, s = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return F.when((kind == "STRING") & (F.trim(s) != ""), F.concat(F.lit("s:"), s)).when(kind == "BIGINT", F.concat(F.lit("i:"), s))


def dialogue_audit(dialogues: DataFrame, roles: tuple[str, ...] = ("doctor", "patient"), position: str = "position", body: str = "body") -> DataFrame:
    """(counter, n): the counters of dialogues {dialogue, information: [{turn, role, sentence, actions, message}]} in JSON.

    Roles follow as role:x, first and last ones as first_role:x and last_role:x.  Of dialogues with an id the first by position
    is no duplicate.  A dialogue is usable if its id is new and every turn is whole; usable ones with equal roles and sentences,
    up to form and white space, are duplicates.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    d = dialogues.select(F.col(position).alias("p"), F.try_parse_json(body).alias("v")).withColumn("object", F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)))
    d = d.withColumns({"id": F.when(F.col("object"), _named(get(F.col("v"), "$.dialogue", "variant"))), "turns": F.when(F.col("object"), get(F.col("v"), "$.information", "array<variant>"))})
    first = d.where("id is not null").groupBy("id").agg(F.min("p").alias("first")).select(F.col("id").alias("i"), "first")
    d = d.join(first, F.col("id") == F.col("i"), "left").withColumn("again", F.coalesce(F.col("p") > F.col("first"), F.lit(False)))
    t = d.select("p", F.posexplode("turns").alias("k", "t")).withColumn("whole", F.coalesce(F.startswith(F.schema_of_variant("t"), F.lit("OBJECT")), F.lit(False)))
    said, role = get(F.col("t"), "$.sentence", "variant"), get(F.col("t"), "$.role", "string")
    text = F.when(F.schema_of_variant(said) == "STRING", F.trim(X.spaced_form(get(said, "$", "string"))))
    actions = F.when(F.startswith(F.schema_of_variant(get(F.col("t"), "$.actions", "variant")), F.lit("ARRAY")), get(F.col("t"), "$.actions", "array<variant>"))
    t = t.withColumns({"role": F.when(F.col("whole"), F.when(role.isin(*roles), role).otherwise("invalid")), "text": F.coalesce(text, F.lit("")), "id": F.when(F.col("whole"), _named(get(F.col("t"), "$.turn", "variant"))), "actions": actions, "message": get(F.col("t"), "$.message", "string")})
    w = Window.partitionBy("p").orderBy("k")
    t = t.withColumns({"before": F.lag("role").over(w), "seen": F.when(F.col("id").isNotNull(), F.row_number().over(Window.partitionBy("p", "id").orderBy("k")))})
    t = t.withColumns({"twice": F.coalesce(F.col("seen") > 1, F.lit(False)), "repeats": F.coalesce((F.col("role") == F.col("before")) & (F.col("role") != "invalid"), F.lit(False))})
    n = lambda name, cond: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    whole, listed = F.col("whole"), F.col("actions").isNotNull()
    good = whole & (F.col("role") != "invalid") & (F.col("text") != "") & F.col("id").isNotNull() & ~F.col("twice")
    per = t.groupBy("p").agg(
        F.count(F.lit(1)).alias("turns"), n("malformed_turns", ~whole), n("empty_sentences", whole & (F.col("text") == "")), n("invalid_roles", F.col("role") == "invalid"), n("missing_turn_ids", whole & F.col("id").isNull()), n("duplicate_turn_ids", F.col("twice")),
        n("adjacent_same_role_pairs", F.col("repeats")), n("actions_present_turns", whole & listed), n("actions_nonempty_turns", whole & (F.size("actions") > 0)), n("actions_empty_turns", whole & listed & (F.size("actions") == 0)),
        n("actions_missing_or_nonlist_turns", whole & ~listed), F.sum(F.when(whole & listed, F.size("actions")).otherwise(0)).alias("action_entries"),
        F.sum(F.when(whole & listed, F.size(F.filter("actions", lambda a: ~F.coalesce(F.startswith(F.schema_of_variant(a), F.lit("OBJECT")), F.lit(False))))).otherwise(0)).alias("nondict_action_entries"),
        n("message_nonempty_turns", whole & (F.trim("message") != "")), F.bool_and(good).alias("good"), F.min_by("role", F.when(whole, F.col("k"))).alias("first_role"), F.max_by("role", F.when(whole, F.col("k"))).alias("last_role"),
        F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.when(whole, F.struct("k", "role", "text")))), lambda x: F.array(x["role"], x["text"]))).cast("binary"), 256).alias("signature"),
        *[n(f"role:{r}", F.col("role") == r) for r in (*roles, "invalid")],
    )
    sums = ["turns", "malformed_turns", "empty_sentences", "invalid_roles", "missing_turn_ids", "duplicate_turn_ids", "adjacent_same_role_pairs", "actions_present_turns", "actions_nonempty_turns", "actions_empty_turns", "actions_missing_or_nonlist_turns", "action_entries", "nondict_action_entries", "message_nonempty_turns"]
    j = d.select("p", "object", "id", "again", F.col("turns").isNotNull().alias("listed"), F.size("turns").alias("size")).join(per, "p", "left")
    usable = F.col("id").isNotNull() & ~F.col("again") & F.coalesce(F.col("good"), F.lit(False))
    names = [f"role:{r}" for r in (*roles, "invalid")]
    one = j.withColumn("usable", usable).agg(
        F.count(F.lit(1)).alias("dialogues"), *[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in [*sums, *names]], n("malformed_dialogues", ~F.col("object") | ~F.col("listed")), n("empty_dialogues", F.col("listed") & (F.col("size") == 0)),
        n("missing_dialogue_ids", F.col("object") & F.col("id").isNull()), n("duplicate_dialogue_ids", F.col("again")), n("dialogues_with_adjacent_same_role", F.col("adjacent_same_role_pairs") > 0), n("__usable", F.col("usable")),
        F.count_distinct(F.when(F.col("usable"), F.col("signature"))).alias("schema_usable_unique_dialogues"), *[n(f"{end}_role:{r}", F.col(f"{end}_role") == r) for end in ("first", "last") for r in (*roles, "invalid")],
    )
    one = one.withColumn("exact_normalized_duplicate_dialogues", F.col("__usable") - F.col("schema_usable_unique_dialogues"))
    ends = [f"{end}_role:{r}" for end in ("first", "last") for r in (*roles, "invalid")]
    pairs = [F.struct(F.lit(c).alias("counter"), F.col(f"`{c}`").cast("long").alias("n")) for c in [*COUNTERS, *names, *ends]]
    return one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


# ---- review packets and calibration


def rebinding_faults(packet: DataFrame, returned: DataFrame, current: DataFrame) -> DataFrame:
    """(blind_id, fault): what keeps returned reviews from being bound to the items that were sent.

    packet: blind_id, item, content (a digest of what was shown); returned: blind_id, content, rubric_version; current: item,
    content, rubric_version, annotated.  An untouched review (null rubric) is missing, not a fault of its own.
    """
    sent = packet.select(F.col("blind_id").alias("b"), "item", F.col("content").alias("shown"))
    now = current.select(F.col("item").alias("i"), F.col("content").alias("is_now"), F.col("rubric_version").alias("asked"), "annotated")
    n = returned.groupBy("blind_id").agg(F.count(F.lit(1)).alias("times"))
    r = returned.join(n, "blind_id").join(sent, F.col("blind_id") == F.col("b"), "left").join(now, F.col("item") == F.col("i"), "left")
    unlike = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    known = F.col("b").isNotNull()
    rules = F.array_compact(F.array(
        F.when(F.col("times") > 1, "REPEATED"), F.when(~known, "UNKNOWN_BLIND_ID"), F.when(known & F.col("i").isNull(), "ITEM_GONE"), F.when(known & unlike("content", "shown"), "REVIEWED_CONTENT_CHANGED"),
        F.when(F.col("i").isNotNull() & unlike("shown", "is_now"), "ITEM_CHANGED_SINCE"), F.when(F.col("i").isNotNull() & F.col("rubric_version").isNotNull() & unlike("rubric_version", "asked"), "RUBRIC_MISMATCH"), F.when(F.coalesce("annotated", F.lit(False)) & F.col("rubric_version").isNotNull(), "ALREADY_ANNOTATED"),
    ))
    missing = sent.join(returned.where("rubric_version is not null").select(F.col("blind_id").alias("b")).distinct(), "b", "left_anti").select(F.col("b").alias("blind_id"), F.lit("NOT_REVIEWED").alias("fault"))
    return r.select("blind_id", F.explode(rules).alias("fault")).distinct().union(missing)


def version_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(category, cases, exact_old, exact_new, gained, lost) of two versions' answers (case_id, category, expected, found arrays) side by side.

    Cases that one version lacks count as not exact there.
    """
    own = lambda df, name: df.select("case_id", "category", F.array_sort(F.array_distinct("expected")).eqNullSafe(F.array_sort(F.array_distinct("found"))).alias(name))
    j = own(old, "o").join(own(new, "n"), ["case_id", "category"], "full").fillna(False, ["o", "n"])
    return j.groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.count_if("o").alias("exact_old"), F.count_if("n").alias("exact_new"), F.count_if(F.col("n") & ~F.col("o")).alias("gained"), F.count_if(F.col("o") & ~F.col("n")).alias("lost"))


# ---- registries of sources


def registry_findings(registry: DataFrame, sources: DataFrame, cited: DataFrame, internal: str = "", strict_hosts: bool = False) -> DataFrame:
    """(file, id, rule, severity) of manifests against a registry of sources; warnings don't fail a release.

    registry: source_id, host; sources: file, source_id, url, document_date; cited (claims of cases and of backbones): file,
    claim_id, source_id, passage_id, locator, claim_scope, evidence_role, review_status, backbone.  Backbone claims name
    registered sources, those of cases the sources of their file.  Addresses with the internal scheme need no host.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    row = lambda df, file, key, rules: df.select(file.alias("file"), key.alias("id"), F.explode(F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, cond in rules]))).alias("x")).select("file", "id", "x.*")
    again = registry.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = [row(again, F.lit(None).cast("string"), F.col("source_id"), [("DUPLICATE_REGISTERED_SOURCE", "error", F.lit(True))])]
    hosts = registry.where("host is not null").select(F.lower("host").alias("h")).distinct()
    n = Window.partitionBy("file", "source_id")
    named = sources.withColumn("host", F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))).withColumn("times", F.count(F.lit(1)).over(n))
    # a host and the domains above it, met with the registered ones by equality
    parts = F.split("host", r"\.")
    above = named.select(F.col("url").alias("u"), "host").distinct().select("u", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("h"))
    known = above.join(hosts, "h", "left_semi").select("u").distinct().withColumn("known", F.lit(True))
    inside = F.startswith(F.coalesce("url", F.lit("")), F.lit(internal)) if internal else F.lit(False)
    s = named.join(known, F.col("url") == F.col("u"), "left")
    out.append(row(s, F.col("file"), F.col("source_id"), [
        ("SOURCE_WITHOUT_ID", "error", blank("source_id")), ("DUPLICATE_LOCAL_SOURCE", "error", ~blank("source_id") & (F.col("times") > 1)), ("MISSING_URL", "error", blank("url")),
        ("UNREGISTERED_HOST", "error" if strict_hosts else "warning", ~blank("url") & ~inside & F.col("known").isNull()),
    ]))
    local = sources.where(~blank("source_id")).groupBy(F.col("file").alias("lf"), F.col("source_id").alias("ls")).agg(F.max("document_date").alias("document_date"))
    global_ = registry.select(F.col("source_id").alias("gs")).distinct()
    twice = cited.where(~blank("passage_id") & ~F.coalesce("backbone", F.lit(False))).groupBy(F.col("file").alias("pf"), F.col("passage_id").alias("pp")).agg(F.count(F.lit(1)).alias("uses"))
    c = cited.join(local, (F.col("file") == F.col("lf")) & (F.col("source_id") == F.col("ls")), "left").join(global_, F.col("source_id") == F.col("gs"), "left").join(twice, (F.col("file") == F.col("pf")) & (F.col("passage_id") == F.col("pp")), "left")
    backbone = F.coalesce("backbone", F.lit(False))
    found = F.when(backbone, F.col("gs").isNotNull()).otherwise(F.col("ls").isNotNull())
    out.append(row(c, F.col("file"), F.col("claim_id"), [
        ("UNKNOWN_SOURCE", "error", ~found), ("MISSING_PASSAGE", "error", ~backbone & blank("passage_id")), ("REPEATED_PASSAGE", "warning", F.coalesce(F.col("uses") > 1, F.lit(False))), ("MISSING_LOCATOR", "error", ~backbone & blank("locator")),
        ("MISSING_SCOPE", "error", ~backbone & blank("claim_scope")), ("MISSING_ROLE", "error", ~backbone & blank("evidence_role")), ("VERIFIED_WITHOUT_DATE", "warning", ~backbone & F.coalesce(F.col("review_status") == "source_verified", F.lit(False)) & F.col("document_date").isNull()),
    ]))
    return reduce(DataFrame.union, out)
