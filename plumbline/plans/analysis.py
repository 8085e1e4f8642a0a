"""The full analysis: candidates, scores, enrichment, evidence, assignment."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import candidates, evidence, network, ranking, scoring
from plumbline.scratch import materialise
from plumbline.settings import Settings


@dataclass
class Analysis:
    """The results of a batch; evidence and assignment are worked out when they
    are first asked for."""

    cases: DataFrame
    edges: DataFrame
    stats: DataFrame
    find_evidence: Callable[[], DataFrame]
    assign: Callable[[], DataFrame]

    @cached_property
    def evidence(self) -> DataFrame:
        return self.find_evidence()

    @cached_property
    def assigned(self) -> DataFrame:
        return self.assign()


def score_pairs(pairs: DataFrame, subs: DataFrame, refs: DataFrame, settings: Settings) -> DataFrame:
    """Scores of candidate pairs (sub_pos, sub_id, ref_pos, ref_id); a family
    that is off costs nothing and counts nothing."""
    keys = scoring.PAIR
    out = pairs.select(*keys)
    words = candidates.jaccard_pairs(subs, refs, settings.word_shingle_size).select("sub_pos", "ref_pos", "jaccard")
    if settings.enable_shingle:
        out = out.join(words, ["sub_pos", "ref_pos"], "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0)))
        out = scoring.shingle_scores(out, subs, refs, settings).select(*keys, "shingle")
    else:
        out = out.withColumn("shingle", F.lit(0.0))
    if settings.enable_exact:
        exact = scoring.exact_scores(pairs.select(*keys), subs, refs, settings)
        out = out.join(exact.select("sub_pos", "ref_pos", "exact"), ["sub_pos", "ref_pos"])
    else:
        out = out.withColumn("exact", F.lit(0.0))
    if settings.enable_fuzzy:
        fuzzy = scoring.fuzzy_scores(pairs.select(*keys), subs, refs)
        out = out.join(fuzzy.select("sub_pos", "ref_pos", "fuzzy", "align"), ["sub_pos", "ref_pos"])
    else:
        out = out.withColumn("fuzzy", F.lit(0.0))
    total = scoring.total_score(F.col("exact"), F.col("shingle"), F.col("fuzzy"), F.lit(0.0), settings.weights())
    return out.withColumns({"graph": F.lit(0.0), "total": total})


def enrich(scored: DataFrame, n_vertices: int, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Scores with the graph's signal, and the edges of the enriched graph."""
    if not settings.enable_graph:
        return scored, network.edges_of(scored, "sub_id", "ref_id", "total", 1.1)
    first = network.edges_of(scored, "sub_id", "ref_id", "total", settings.graph_edge_threshold)
    signal = network.signals(first, network.edge_degrees(first), n_vertices).select("src", "dst", "signal")
    pair = (F.least("sub_id", "ref_id") == F.col("src")) & (F.greatest("sub_id", "ref_id") == F.col("dst"))
    out = scored.join(signal, pair, "left").withColumn("graph", F.coalesce("signal", F.lit(0.0))).drop("src", "dst", "signal")
    total = scoring.total_score(F.col("exact"), F.col("shingle"), F.col("fuzzy"), F.col("graph"), settings.weights())
    out = materialise(out.withColumn("total", total), "enriched")
    return out, network.edges_of(out, "sub_id", "ref_id", "total", settings.graph_edge_threshold)


def analyse(subs: DataFrame, refs: DataFrame, reviewers: DataFrame, settings: Settings, n_subs: int, n_refs: int, gated: bool = True, progress: Callable[[str, int, int], None] = lambda phase, done, of: None) -> Analysis:
    """The whole batch over prepared submissions and references.  ``progress``
    is told of each phase as it begins, and of the end."""
    progress("validation", 0, 4)
    if n_subs < 0 or n_refs < 0:
        raise ValueError("counts are not negative")
    progress("preparation", 1, 4)
    gate = settings.candidate_threshold if gated and settings.enable_shingle else 0.0
    pairs = materialise(candidates.minhash_candidates(subs, refs, gate, settings.word_shingle_size), "candidates")
    # What is scored is taken apart for the candidates' texts only.
    paired = lambda docs, key: materialise(candidates.of_positions(docs, pairs.select(F.col(key).alias("pos"))), "paired")
    subs, refs = paired(subs, "sub_pos"), paired(refs, "ref_pos")
    progress("analysis", 2, 4)
    scored = materialise(score_pairs(pairs, subs, refs, settings), "scored")
    progress("indexing", 3, 4)
    enriched, edges = enrich(scored, n_subs + n_refs, settings)
    cases = scoring.cases(enriched, n_refs)

    def found() -> DataFrame:
        return evidence.compact(materialise(evidence.evidence(cases, subs, refs, settings), "evidence"), settings.max_evidence)

    total = n_subs * n_refs
    stats = pairs.agg(F.count("*").alias("candidates")).select(F.lit(total).alias("pairs"), "candidates", ((F.lit(total) - F.col("candidates")) / float(max(1, total))).alias("reduction"))
    progress("complete", 4, 4)
    return Analysis(cases, edges, stats, found, lambda: ranking.assign(cases, reviewers, settings.review_threshold))
