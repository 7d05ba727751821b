"""Ranking of passages, sections and entities over eligible rows.

Defined cases: null and empty texts have no terms and are never ranked; null ids are ranked like others; ties go by id; rows that
repeat an id are one text's terms together; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X

from .core import in_scope, top, valid_at


def passage_violations(passages: DataFrame) -> DataFrame:
    """(id, rule): ids that are missing or repeated, texts that are missing, reversed validity."""
    rules = F.array_compact(F.array(F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "NO_ID"), F.when(F.col("text").isNull(), "NO_TEXT"), F.when(F.col("valid_from") > F.col("valid_to"), "REVERSED")))
    twice = passages.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return passages.select("id", F.explode(rules).alias("rule")).union(twice.select("id", F.lit("REPEATED_ID").alias("rule")))


def rank_evidence(queries: DataFrame, passages: DataFrame, k: int = 3, as_of: Column | None = None, population: Column | None = None) -> DataFrame:
    """query_id, rank, id, score: BM25 whose statistics are of the eligible passages only.

    queries: query_id, query; passages: id, text, valid_from, valid_to, population array.  Eligibility comes
    before every count.  Only words of the queries are aggregated.  Ties go to the smaller id.
    """
    at = F.lit(None).cast("date") if as_of is None else as_of
    scope = F.lit(None).cast("string") if population is None else X.fold(F.trim(population))
    fits = valid_at(at, F.col("valid_from"), F.col("valid_to")) & in_scope(F.col("__scope"), F.transform("population", lambda x: F.lower(F.trim(x))))
    own = passages.withColumn("__scope", scope).where(fits).select("id", X.words_b(F.col("text")).alias("w"))
    sized = own.select("id", F.size("w").alias("len"), "w")
    whole = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("average"))
    asked = queries.select("query_id", F.explode(F.array_distinct(X.words_b(F.col("query")))).alias("word"))
    tf = sized.select("id", "len", F.explode("w").alias("word")).join(asked.select("word").distinct(), "word", "left_semi").groupBy("id", "len", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    terms = tf.join(df, "word").join(F.broadcast(whole))  # one row
    score = X.bm25_term(F.col("tf"), F.col("df"), F.col("n"), F.col("len"), F.col("average"))
    scored = terms.withColumn("s", score).join(asked, "word").groupBy("query_id", "id").agg(F.sum("s").alias("score")).where("score > 0")
    return top(scored, ["query_id"], [F.desc(F.round("score", 9)), F.col("id")], k).select("query_id", "rank", "id", "score")


def rank_sections(queries: DataFrame, sections: DataFrame, preferred: DataFrame, k: int = 3) -> DataFrame:
    """query_id, rank, doc_id, title, score: a word counts 4 in the title, else 1 in the text; preferred titles get 6 more.

    queries: query_id, words array; sections: doc_id, position, title, text; preferred: query_id, title.
    """
    w = queries.select("query_id", F.explode(F.array_distinct(F.transform("words", F.lower))).alias("word"))
    bag = lambda c: F.array_distinct(X.words_a(F.col(c), X.light_fold))
    s = sections.select("doc_id", "position", "title", bag("title").alias("tw"), bag("text").alias("xw"))
    hits = s.select("doc_id", "position", "title", F.explode(F.array_union("tw", "xw")).alias("word"), "tw")
    hits = hits.join(w, "word").groupBy("query_id", "doc_id", "position", "title").agg(F.sum(F.when(F.array_contains("tw", F.col("word")), 4).otherwise(1)).alias("base"))
    wish = preferred.select("query_id", F.lower("title").alias("__t"), F.lit(6).alias("bonus")).distinct()
    j = hits.join(wish, (hits["query_id"] == wish["query_id"]) & (F.lower("title") == F.col("__t")), "left").select(hits["*"], (F.col("base") + F.coalesce("bonus", F.lit(0))).cast("int").alias("score"))
    return top(j, ["query_id"], [F.desc("score"), F.col("doc_id"), F.col("position")], k).select("query_id", "rank", "doc_id", "title", "score")


def find_entity(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """question_id and its best entity: name equal 100, name in the question 10 (longest wins), one more for a word of the body.

    Names meet questions through their first word, so it is an equi-join.  Names are few words.
    """
    q = questions.select("question_id", X.word_form(F.col("question"), X.light_fold).alias("q"))
    e = entities.select("entity", X.word_form(F.col("entity"), X.light_fold).alias("name"), X.word_form(F.coalesce("body", F.lit("")), X.light_fold).alias("body")).where("name <> ''")
    words = q.select("question_id", "q", F.explode(F.array_distinct(F.split("q", " "))).alias("first"))
    j = words.join(e.withColumn("first", F.substring_index("name", " ", 1)), "first").where(F.contains(F.concat(F.lit(" "), "q", F.lit(" ")), F.concat(F.lit(" "), "name", F.lit(" "))))
    score = F.when(F.col("q") == F.col("name"), 100).otherwise(10) + F.when(F.arrays_overlap(F.split("q", " "), F.split("body", " ")), 1).otherwise(0)
    best = j.withColumn("score", score).groupBy("question_id").agg(F.max(F.struct("score", F.length("name").alias("l"), F.col("entity").alias("e"))).alias("b"))
    return questions.select("question_id").join(best, "question_id", "left").select("question_id", F.col("b.e").alias("entity"), F.col("b.score").alias("score"))


def inject_evidence(cases: DataFrame, passages: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(cases with the texts of their first k allowed passages in order, violations for missing ones); cases: case_id, allowed array."""
    want = cases.select("case_id", F.posexplode(F.slice("allowed", 1, k)).alias("at", "id"))
    j = want.join(passages.select("id", "text"), "id", "left")
    bad = j.where("text is null").select("case_id", F.col("id").alias("missing"))
    texts = j.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("evidence"))
    return cases.join(texts, "case_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))), bad


#: Entities of a block, entities of a band, pairs that a task counts at once.
BLOCK, BAND, COUNTED = 1 << 8, 1 << 16, 1 << 21


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, shared) of the cells of a partition, sorted by cell; a cell has BLOCK * BAND pairs at most."""
    at, codes, counts, waiting, size = None, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not len(codes):
            return new, n
        both, where = np.unique(np.concatenate([codes, new]), return_inverse=True)
        return both, np.bincount(where, np.concatenate([counts, n])).astype(np.int64)

    def told() -> Iterator[pa.RecordBatch]:
        for k in range(0, len(codes), 1 << 16):
            c = codes[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at[0] * BLOCK + c // BAND), pa.array(at[1] * BAND + c % BAND), pa.array(counts[k : k + (1 << 16)])], names=["a", "b", "shared"])

    for batch in batches:
        ids = batch["ids"]
        values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        for k, cell in enumerate(zip(batch["block"].to_pylist(), batch["band"].to_pylist())):
            if cell != at:
                codes, counts = merged()
                yield from told()
                at, codes, counts, waiting, size = cell, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
            mine = values[ends[k] : ends[k + 1]]
            own, others = mine[mine // BLOCK == cell[0]], mine[mine // BAND == cell[1]]
            step = max(1, COUNTED // max(1, len(others)))
            for j in range(0, len(own), step):
                some = own[j : j + step]
                first = (some - cell[0] * BLOCK) * BAND - cell[1] * BAND
                waiting.append((first[:, None] + others[None, :])[others[None, :] > some[:, None]])
                size += len(waiting[-1])
                if size >= max(COUNTED, len(codes)):
                    codes, counts = merged()
                    waiting, size = [], 0
    codes, counts = merged()
    yield from told()


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, shared): how many neighbours n the entities a < b share; edges: distinct (s, n), s a long.

    Pairs are never shuffled: a neighbour's entities go once to each cell (a block of entities, a band of others) that they meet
    in, and all pairs of a cell are counted there.  A neighbour's list is as long as there are entities at most.
    """
    block_of, band_of = (lambda x: F.shiftright(x, BLOCK.bit_length() - 1)), (lambda x: F.shiftright(x, BAND.bit_length() - 1))
    known = edges.where("s is not null and n is not null").groupBy("n").agg(F.array_sort(F.collect_list(F.col("s").cast("long"))).alias("ids")).where("size(ids) > 1")
    blocks = known.select("ids", F.explode(F.array_distinct(F.transform("ids", block_of))).alias("block"))
    tail = blocks.select("block", F.filter("ids", lambda x: block_of(x) >= F.col("block")).alias("ids"))
    bands = tail.select("block", "ids", F.explode(F.array_distinct(F.transform("ids", band_of))).alias("band"))
    here = lambda x: (block_of(x) == F.col("block")) | (band_of(x) == F.col("band"))
    cells = bands.select("block", "band", F.filter("ids", here).alias("ids")).where("size(ids) > 1")
    return cells.repartition("block", "band").sortWithinPartitions("block", "band").mapInArrow(_pair_counts, "a long, b long, shared long")


#: Weights of what two entities share, with the count that is full, and of ties between them, by mode; levels.
WEIGHTS = {
    "pharma": {"target": (0.30, 1.5), "indication": (0.25, 1.5), "modality": (0.15, 1.5), "investor": (0.10, 1.5), "analysis": (0.05, 2.0)},
    "semi": {"product": (0.25, 1.5), "customer": (0.20, 2.0), "supplier": (0.15, 2.0), "investor": (0.10, 1.5), "analysis": (0.05, 2.0)},
}
TIES = {"pharma": {"direct": 0.10, "licensing": 0.15, "trial": 0.10}, "semi": {"direct": 0.10, "industry": 0.15}}
COMPETITOR_FLOOR = 0.75
LEVELS = [(0.75, "alert"), (0.5, "watch"), (0.4, "note")]


def overlap_score(counts: DataFrame, mode: str) -> DataFrame:
    """counts (a column for each kind, a boolean for each tie, direct_competitor) with score and level.

    A declared direct competitor scores 0.75 at least.  Missing counts are 0, missing ties false.
    """
    shares = [F.least(F.lit(1.0), F.coalesce(F.col(k), F.lit(0)) / full) * w for k, (w, full) in WEIGHTS[mode].items()]
    ties = [F.when(F.coalesce(F.col(k), F.lit(False)), w).otherwise(0.0) for k, w in TIES[mode].items()]
    score = sum([*shares, *ties], F.lit(0.0))
    floor = F.coalesce(F.col("direct_competitor"), F.lit(False)) & F.coalesce(F.col("direct"), F.lit(False))
    out = counts.withColumn("score", F.round(F.when(floor, F.greatest(score, F.lit(COMPETITOR_FLOOR))).otherwise(score), 6))
    level = F.lit("none")
    for least, name in reversed(LEVELS):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    return out.withColumn("level", level)


def relation_types(counts: DataFrame) -> DataFrame:
    """counts with types, the kinds of relation of two entities of the pharma mode: target, indication and modality counts, both_marketed, ties."""
    has = lambda k: F.coalesce(F.col(k), F.lit(0)) > 0
    tie = lambda k: F.coalesce(F.col(k), F.lit(False))
    main = F.when(has("target") & has("indication") & tie("both_marketed"), "DIRECT_COMMERCIAL_COMPETITOR").when(has("target") & has("indication"), "PIPELINE_COMPETITOR")
    main = main.when(has("target"), "MECHANISTIC_NEIGHBOR+SHARED_TARGET").when(has("indication"), "MARKET_COMPETITOR")
    declared = F.when(tie("direct") & tie("direct_competitor"), "DIRECT_COMPETITOR").when(tie("direct"), "SUPPLY_CHAIN_LINK")
    modality = F.when(has("modality") & ~F.coalesce(F.contains(main, F.lit("COMPETITOR")), F.lit(False)) & ~(tie("direct") & tie("direct_competitor")), "SHARED_MODALITY")
    rest = [F.when(tie("licensing"), "LICENSING_LINK"), F.when(tie("collaboration"), "COLLABORATION_LINK"), F.when(tie("trial"), "TRIAL_OVERLAP"), F.when(has("customer"), "SHARED_CUSTOMER"), F.when(has("supplier"), "SHARED_SUPPLIER"), F.when(has("investor"), "SHARED_INVESTOR")]
    found = F.array_compact(F.array(declared, main, modality, *rest))
    return counts.withColumn("types", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("COMMON_ECOSYSTEM"))))


def entity_overlap(edges: DataFrame, kinds: DataFrame, entity: str, ties: DataFrame | None = None, mode: str = "pharma", excluded: list[str] | None = None) -> DataFrame:
    """Every other entity that shares neighbours with one, or is tied to it: counts by kind, types, score, level.

    edges: (a, b) both ways; kinds: node, kind (indexes and other kinds named in `excluded` don't count as neighbours);
    ties: entity and booleans direct_competitor, licensing, collaboration, trial, industry, both_marketed of its
    relation to the one.  The entity's neighbours are joined with all edges, two hops.
    """
    counted = [*dict.fromkeys([*WEIGHTS["pharma"], *WEIGHTS["semi"]])]
    flags = ["direct_competitor", "licensing", "collaboration", "trial", "industry", "both_marketed"]
    mine = edges.where(F.col("a") == entity).select(F.col("b").alias("n")).distinct()
    typed = kinds.select(F.col("node").alias("n"), "kind").distinct()
    other = edges.join(mine, edges["b"] == mine["n"]).where(F.col("a") != entity).select("a", "n").distinct().join(typed, "n", "left").where(~F.coalesce(F.col("kind").isin(excluded or []), F.lit(False)))
    g = other.groupBy("a").agg(F.count(F.lit(1)).alias("shared"), *[F.count_if(F.col("kind") == k).alias(k) for k in counted])
    j = g.join(mine.select(F.col("n").alias("a"), F.lit(True).alias("direct")), "a", "full").na.fill(0, ["shared", *counted])
    if ties is not None:
        own = ties.select(F.col("entity").alias("a"), *[(F.col(f) if f in ties.columns else F.lit(False)).alias(f) for f in flags])
        j = j.join(own, "a", "left")
    else:
        j = j.withColumns({f: F.lit(False) for f in flags})
    return overlap_score(relation_types(j.na.fill(False, ["direct", *flags])), mode).withColumnRenamed("a", "entity")
