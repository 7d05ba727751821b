"""Normal forms, tokens and span functions as Columns.

What the JVM can express stays in built-in functions; NFKC, full case folding, canonical JSON of dynamic
bodies and spans with offsets are Arrow UDFs.  All take nulls to nulls.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in lineage anchors.
STOPWORDS = (
    "a an and are as at be by case do for from in is it no not of on or that the this to use with without only provided supplied"
).split()
#: Words that tell nothing of a claim.
CLAIM_STOPWORDS = "the a an of to and or for in on with is are be by that this as it from at when if but has have had can all".split()
#: Other names of failure labels.
FAILURE_ALIASES = {
    "STALE": "STALE_KNOWLEDGE", "FRESHNESS": "STALE_KNOWLEDGE", "MISSING_KNOWLEDGE": "KNOWLEDGE_MISSING", "RETRIEVAL_FAILURE": "RETRIEVAL_MISS",
    "SOURCE_ROLE": "SOURCE_HIERARCHY", "EVIDENCE_HIERARCHY": "SOURCE_HIERARCHY", "RELATION_SHORTCUT": "REASONING_FAILURE",
    "RELATION_OVERSIMPLIFY": "REASONING_FAILURE", "METRIC_SALIENCE_BIAS": "REASONING_FAILURE", "FORECAST_OVERCONFIDENCE": "OVERCLAIM",
    "UNSAFE_DRUG": "UNSAFE_MEDICATION", "MEDICATION_SAFETY": "UNSAFE_MEDICATION", "TOOL_FAILURE": "BAD_TOOL_CALL", "JUDGE_DRIFT": "JUDGE_INCONSISTENCY",
}
NOT_WORD = r"[^\p{L}\p{N}_]+"


def _mapped(kind: str, of: Callable) -> Callable[[Column], Column]:
    """A lazily built Arrow UDF (UDF types need a session)."""

    def column(c: Column) -> Column:
        @F.arrow_udf(kind)
        def run(values: pa.Array) -> pa.Array:
            return pa.array([None if v is None else of(v) for v in values.to_pylist()], _ARROW[kind])

        return run(c)

    return column


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_MENTIONS = "array<struct<kind: string, start: int, end: int, word: string>>"
_PIECES = "array<struct<at: int, part: string>>"
_ARROW = {
    "string": pa.string(),
    "boolean": pa.bool_(),
    "array<struct<kind: string, start: int, end: int>>": pa.list_(_SPAN),
    _PIECES: pa.list_(pa.struct([("at", pa.int32()), ("part", pa.string())])),
    _MENTIONS: pa.list_(pa.struct([*_SPAN, ("word", pa.string())])),
    "array<struct<path: string, text: string>>": pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())])),
}

nfkc = _mapped("string", lambda s: unicodedata.normalize("NFKC", s))
fold = _mapped("string", lambda s: unicodedata.normalize("NFKC", s).casefold())
is_nfkc = _mapped("boolean", lambda s: s == unicodedata.normalize("NFKC", s))


def canonical_text(v) -> str:
    return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


canonical_json = _mapped("string", lambda s: canonical_text(json.loads(s)))


def _tidy(v):
    if isinstance(v, dict):
        return {k: _tidy(v[k]) for k in sorted(v)}
    if isinstance(v, list):
        return [_tidy(x) for x in v]
    return " ".join(v.split()) if isinstance(v, str) else v


tidy_json = _mapped("string", lambda s: canonical_text(_tidy(json.loads(s))))


def light_fold(c: Column) -> Column:
    """Case folding of the driver's tables without a UDF: lower case, sharp s as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def word_form(c: Column, folded: Callable[[Column], Column] = fold) -> Column:
    """Form A: folded, everything but words to single spaces."""
    return F.trim(F.regexp_replace(folded(c), NOT_WORD, " "))


def dense_form(c: Column, folded: Callable[[Column], Column] = fold) -> Column:
    """Form B: folded, without white space."""
    return F.regexp_replace(folded(c), r"[\s\x{00A0}\x{3000}]+", "")


def spaced_form(c: Column, normal: Callable[[Column], Column] = nfkc) -> Column:
    """Form C: single spaces, case kept."""
    return F.trim(F.regexp_replace(normal(c), r"\s+", " "))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s)


def short_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 20))


def edge_id(namespace: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", namespace, subject, predicate, obj)), 1, 16)


def git_blob_sha1(content: Column) -> Column:
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string"))
    return F.sha1(F.concat(head.cast("binary"), F.unhex(F.lit("00")), content.cast("binary")))


def failure_label(c: Column) -> Column:
    plain = F.translate(F.trim(F.regexp_extract(F.upper(F.trim(c)), r"^[^(:\[]*", 0)), " -", "__")
    alias = F.create_map(*[F.lit(x) for kv in FAILURE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(alias, plain), plain)


def entity_form(c: Column) -> Column:
    """An entity's name without articles and version words."""
    s = F.regexp_replace(F.lower(c), r"\b(the|a|an|version|v\d+(\.\d+)*)\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


# ---- tokens


def _parts(c: Column, sep: str) -> Column:
    return F.filter(F.split(c, sep), lambda x: x != "")


def words_a(c: Column, folded: Callable[[Column], Column] = fold) -> Column:
    return _parts(word_form(c, folded), " ")


def content_words(c: Column, folded: Callable[[Column], Column] = fold) -> Column:
    """Distinct words that are no stopword and have four letters or a digit."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(words_a(c, folded), lambda x: ~F.array_contains(stop, x) & ((F.length(x) >= 4) | x.rlike(r"\p{Nd}"))))


def char_ngrams(c: Column, n: int = 4) -> Column:
    """Distinct n-grams of characters, blanks included; a shorter text is its own; an empty one has none."""
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))  # a list, as finding the i-th character of a string takes i steps
    grams = F.flatten(F.transform(F.array(chars), lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat(*[F.get(x, i + k) for k in range(n)]))))
    return F.array_distinct(F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) <= n, F.array(c)).otherwise(grams))


def turn_ngrams(turns: Column, n: int = 3) -> Column:
    """n-grams within each turn, never across turns."""
    return F.array_distinct(F.flatten(F.transform(turns, lambda t: char_ngrams(t, n))))


def words_b(c: Column, folded: Callable[[Column], Column] = fold) -> Column:
    """Bigrams of Han runs (a lone character is itself), and Latin words with inner ' and -."""
    s = folded(c)
    han = F.regexp_extract_all(s, F.lit(r"[\x{3400}-\x{9fff}]+"), F.lit(0))
    pairs = F.flatten(F.transform(han, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(pairs, F.regexp_extract_all(s, F.lit(r"[a-z0-9]+(?:['’-][a-z0-9]+)*"), F.lit(0)))


def words_c(c: Column) -> Column:
    """Words of two letters or digits and more without those that a claim shares with any text."""
    stop = F.array(*[F.lit(w) for w in CLAIM_STOPWORDS])
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))


def clauses(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?;。！？；\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def _regex_spans(cues: dict[str, str]) -> Callable[[str], list[dict]]:
    compiled = [(k, re.compile(p)) for k, p in cues.items()]
    return lambda s: sorted(({"kind": k, "start": m.start(), "end": m.end()} for k, p in compiled for m in p.finditer(s)), key=lambda x: (x["start"], x["end"], x["kind"]))


def spans(c: Column, cues: dict[str, str]) -> Column:
    """kind, start and exclusive end (in characters) of every match of the named patterns."""
    return _mapped("array<struct<kind: string, start: int, end: int>>", _regex_spans(cues))(c)


def mentions(c: Column, cues: dict[str, str]) -> Column:
    """spans() with the matched text as `word`: cutting it out of a long text again would read the text once for each match."""
    find = _regex_spans(cues)
    return _mapped(_MENTIONS, lambda s: [{**x, "word": s[x["start"] : x["end"]]} for x in find(s)])(c)


def pieces(c: Column, separator: str) -> Column:
    """at (in characters) and part of what stands before, between and after the matches of a pattern whose classes are ASCII, as in the JVM."""
    find = re.compile(separator, re.ASCII).finditer

    def cut(s: str) -> list[dict]:
        seps = [m.span() for m in find(s)]
        return [{"at": a, "part": s[a:b]} for a, b in zip([0, *(e for _, e in seps)], [*(b for b, _ in seps), len(s)])]

    return _mapped(_PIECES, cut)(c)


#: Opening and closing marks of what is reported, not said.
QUOTES = {"“": "”", "「": "」", "『": "』", '"': '"'}
_MARK = re.compile("[" + re.escape("".join({*QUOTES, *QUOTES.values()})) + "]")


def _quoted(s: str) -> list[dict]:
    """Spans of outermost quotations; one that is never closed runs to the end."""
    spans, open_marks, begin = [], [], 0
    for m in _MARK.finditer(s):
        if open_marks and m[0] == QUOTES[open_marks[-1]]:
            open_marks.pop()
            if not open_marks:
                spans.append({"kind": "closed", "start": begin, "end": m.end()})
        elif m[0] in QUOTES:
            begin = begin if open_marks else m.start()
            open_marks.append(m[0])
    return [*spans, {"kind": "open", "start": begin, "end": len(s)}] if open_marks else spans


quoted_spans = _mapped("array<struct<kind: string, start: int, end: int>>", _quoted)


def quotes_masked(text: Column, spans: Column) -> Column:
    """text with quoted_spans blanked; a closed one ends its clause with a semicolon, so lengths stay."""
    filled = lambda q: F.when(q["kind"] == "closed", F.concat(F.repeat(F.lit(" "), q["end"] - q["start"] - 1), F.lit(";"))).otherwise(F.repeat(F.lit(" "), q["end"] - q["start"]))
    none = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, q: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, q["start"] - a["at"]), filled(q)).alias("out"), q["end"].alias("at"))
    return F.aggregate(spans, none, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def plain_form(s: str) -> str:
    """word_form() of a Python string."""
    return " ".join(re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", s).casefold()).split())


def leaves_of(value, least_chars: int = 30, least_words: int = 5) -> list[dict]:
    """Forms of the strings in a JSON value that are long enough to tell something, with their paths."""
    found, todo = [], [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{path}[{k}]", x) for k, x in enumerate(v)]
        elif isinstance(v, str) and len(form := plain_form(v)) >= least_chars and form.count(" ") >= least_words - 1:
            found.append({"path": path, "text": form})
    return sorted(found, key=lambda x: x["path"])


leaf_strings = _mapped("array<struct<path: string, text: string>>", lambda s: [{**x, "path": x["path"].lstrip(".")} for x in leaves_of(json.loads(s))])


#: Cues that negate what follows at once (Chinese in the short reach, English in the whole one) or stands before.
NEGATES_HAN = r"(?:不涉及|不包括|不查|不看|不要|不用|无需|不需要|不是查|不是看|不是问|不是要|排除|避免|而非|不走|不参考|不依赖|不采用|不搜|不检索)\s*$"
NEGATES = r"(?:\bnot\b|\bno\b|\bwithout\b|\bexclude(?:d|s|ing)?\b|\bexcluding\b|\bdo\s+not\s+(?:want|need|use|check|search|look\s+for)\b|\bdon't\s+(?:want|need|use|check|search)\b|\bnot\s+looking\s+for\b|\brather\s+than\b|\binstead\s+of\b)\s*$"
NEGATED_AFTER = r"^\s*(?:不需要|不用|不要|除外|排除|is\s+not\s+needed|not\s+needed|is\s+excluded)"
#: Sentence marks.
MARKS = "。！？!?;；\n"
#: Characters that are read before, shortly before, and after a mention.
REACH, SHORT_REACH, AFTER_REACH = 48, 24, 18


def negated_at(text: Column, start: Column, end: Column) -> Column:
    """Whether the mention from start to end (exclusive) of a lower-case text is negated.

    A cue must end where the mention begins: within 48 characters before it that no sentence mark parts from it (24 for
    Chinese cues), or begin within the 18 characters after it.
    """
    before = F.substring(text, F.greatest(start + 1 - REACH, F.lit(1)), F.least(start, F.lit(REACH)))
    # what follows the last mark; a line's end right before the mention parts nothing.  No pattern: one took most of the time.
    before = F.when(F.endswith(before, F.lit("\r\n")), F.left(before, F.length(before) - 2)).when(F.endswith(before, F.lit("\n")), F.left(before, F.length(before) - 1)).otherwise(before)
    before = F.substring_index(F.translate(before, MARKS, "\n" * len(MARKS)), "\n", -1)
    short = F.substring(before, F.greatest(F.length(before) - SHORT_REACH + 1, F.lit(1)), F.lit(SHORT_REACH))
    after = F.substring(text, end + 1, F.lit(AFTER_REACH))
    return short.rlike(NEGATES_HAN) | before.rlike(NEGATES) | after.rlike(NEGATED_AFTER)


def phrase_places(text: Column, phrase: str) -> Column:
    """Starts (from 0) of a phrase's occurrences that don't overlap, in reading order.  Only a text that holds the phrase is cut."""
    pieces = F.split(text, f"\\Q{phrase}\\E", -1)
    ends = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n")), lambda s, x: F.struct(F.concat(s["at"], F.array(s["n"] + F.length(x))).alias("at"), (s["n"] + F.length(x) + len(phrase)).alias("n")), lambda s: s["at"])
    return F.when(F.contains(text, F.lit(phrase)), ends).otherwise(F.when(text.isNotNull(), F.array().cast("array<int>")))


def rows_of(items: Column) -> Column:
    """A row for each item, and one null row where there is none, to be left out by the caller.

    An outer explode, as Spark derives a filter on the whole expression from a plain one.  For phrases it was faster; for the
    clauses and rules of propositions it was slower, so they keep a plain one.
    """
    return F.explode_outer(items)


def phrase_hits(text: Column, groups: dict[str, list[str]]) -> Column:
    """array<struct<kind, start, end>> of every occurrence of each group's phrases, group by group."""

    def of(kind: str, phrase: str) -> Column:
        return F.transform(phrase_places(text, phrase), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("start"), (i + len(phrase)).alias("end")))

    return F.concat(*[of(kind, p.lower()) for kind, phrases in groups.items() for p in phrases])


# ---- similarity of arrays that hold distinct values


def dice(a: Column, b: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return F.try_divide(inter, F.size(a) + F.size(b) - inter)


def containment(a: Column, b: Column) -> Column:
    """The share of a that b holds; 0 for an empty a."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def blended(tokens_a: Column, tokens_b: Column, grams_a: Column, grams_b: Column) -> Column:
    return F.round(0.58 * dice(tokens_a, tokens_b) + 0.42 * dice(grams_a, grams_b), 6)


def bm25_term(tf: Column, df: Column, n: Column, length: Column, average: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
