"""Six public interfaces: the request that a query asks for, and typed rows of a recorded answer.

Nothing here reaches a network: requests are text for whoever records, answers are the recorded bodies of adapters.Recorded.
Bodies are nested differently in each interface; paths into variants take out what is wanted, so a body of another shape, a
null one or one that is no JSON gives nulls or no rows, never an error.  Rows that repeat are kept; extra columns of the
recorded rows stay out of the answers; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Addresses and parameters, as (name, constant) or (name, field of the query in braces).
REQUESTS = {
    "label": ("https://dailymed.nlm.nih.gov/dailymed/services/v2/spls.json", [("drug_name", "{drug_name}"), ("name_type", "{name_type|both}"), ("pagesize", "100"), ("page", "1")]),
    "approvals": ("https://api.fda.gov/drug/drugsfda.json", [("search", 'application_number:"{application_number}"'), ("limit", "10")]),
    "trial": ("https://clinicaltrials.gov/api/v2/studies/{nct_id}", []),
    "drug_name": ("https://rxnav.nlm.nih.gov/REST/rxcui.json", [("name", "{name}"), ("search", "2")]),
    "literature": ("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", [("db", "pubmed"), ("term", "{term}"), ("retmode", "json"), ("retmax", "{retmax|5}")]),
    "adverse_event": ("https://api.fda.gov/drug/event.json", [("search", 'patient.drug.openfda.generic_name:"{generic_name}"'), ("limit", "1")]),
}
#: Records kept of a list of labels.
MOST_LABELS = 20


def _encoded(c: Column, plus: bool = True) -> Column:
    """Percent-encoding of a parameter; in a path a blank is %20."""
    s = F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return s if plus else F.replace(s, F.lit("+"), F.lit("%20"))


def _filled(template: str, query: Column) -> Column:
    """A template with the query's fields; a field after | is used where the query has none."""
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        field, _, rest = rest.partition("}")
        name, _, default = field.partition("|")
        value = F.try_element_at(query, F.lit(name))
        out += [F.lit(head), F.coalesce(value, F.lit(default)) if default else value]
    return F.concat(*out, F.lit(rest))


def request(adapter: str, query: Column) -> Column:
    """The address that a query (map of strings) asks for; null where a field that it needs is missing."""
    base, params = REQUESTS[adapter]
    if "{" in base:
        head, field = base[: base.index("{")], base[base.index("{") :]
        address = F.concat(F.lit(head), _encoded(_filled(field, query), plus=False))
    else:
        address = F.lit(base)
    pairs = [F.concat(F.lit(f"{name}="), _encoded(_filled(value, query))) for name, value in params]
    written = pairs[0] if pairs else None
    for p in pairs[1:]:
        written = F.concat(written, F.lit("&"), p)
    return F.concat(address, F.lit("?"), written) if pairs else address


def _at(v: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _answers(recorded: DataFrame, adapter: str) -> DataFrame:
    return recorded.where(F.col("adapter") == adapter).select("query", "status", "fetched_at", F.try_parse_json("body").alias("v"))


def labels(recorded: DataFrame) -> DataFrame:
    """(query, status, result_count, place, title, setid, spl_version, published): the first records of each answer; place null without any."""
    rows = _answers(recorded, "label").select("query", "status", _at("v", "$.data", "array<variant>").alias("data"))
    each = rows.select("query", "status", F.coalesce(F.size("data"), F.lit(0)).alias("result_count"), F.posexplode_outer(F.slice("data", 1, MOST_LABELS)).alias("place", "r"))
    date = F.try_to_date(_at("r", "$.published_date", "string"), "MMM d, yyyy")
    return each.select("query", "status", "result_count", "place", _at("r", "$.title", "string").alias("title"), _at("r", "$.setid", "string").alias("setid"), _at("r", "$.spl_version", "int").alias("spl_version"), date.alias("published"))


def latest_labels(found: DataFrame) -> DataFrame:
    """Of labels() the newest of each setid: by date, then version."""
    return found.where("setid is not null").groupBy("query", "setid").agg(F.max_by(F.struct("title", "spl_version", "published"), F.struct("published", "spl_version")).alias("r")).select("query", "setid", "r.*")


def approvals(recorded: DataFrame) -> DataFrame:
    rows = _answers(recorded, "approvals").select("query", "status", F.explode(_at("v", "$.results", "array<variant>")).alias("r"))
    return rows.select("query", "status", _at("r", "$.application_number", "string").alias("application_number"))


def trials(recorded: DataFrame) -> DataFrame:
    p = "$.protocolSection"
    return _answers(recorded, "trial").select("query", "status", _at("v", f"{p}.identificationModule.nctId", "string").alias("nct_id"), _at("v", f"{p}.identificationModule.briefTitle", "string").alias("brief_title"), _at("v", f"{p}.statusModule.overallStatus", "string").alias("overall_status"))


def drug_names(recorded: DataFrame) -> DataFrame:
    return _answers(recorded, "drug_name").select("query", "status", F.explode(_at("v", "$.idGroup.rxnormId", "array<string>")).alias("rxnorm_id"))


def literature(recorded: DataFrame) -> DataFrame:
    return _answers(recorded, "literature").select("query", "status", F.posexplode(_at("v", "$.esearchresult.idlist", "array<string>")).alias("place", "pmid"))


def adverse_events(recorded: DataFrame) -> DataFrame:
    return _answers(recorded, "adverse_event").select("query", "status", _at("v", "$.meta.results.total", "long").alias("total"))
