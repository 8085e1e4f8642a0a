"""Pair scores: exact phrase coverage, shingles, fuzzy alignment, composite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import udfs as U
from plumbline.settings import Settings

FUZZY_TOKENS, WINDOW_CHARS = 900, 100_000
PAIR = ["sub_pos", "sub_id", "ref_pos", "ref_id"]


def phrases(tokens: Column, settings: Settings) -> Column:
    """Windows of max(5, shingle size) tokens, or the whole text if shorter."""
    width = max(5, settings.word_shingle_size)

    def body(t: Column) -> Column:
        return F.when(F.size(t) >= width, X.word_shingles(t, width)).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast(X.STRINGS))

    return X.let(tokens, body)


def _sides(pairs: DataFrame, subs: DataFrame, refs: DataFrame, *columns: str) -> DataFrame:
    a = subs.select(F.col("pos").alias("sub_pos"), *[F.col(c).alias(f"sub_{c}") for c in columns])
    b = refs.select(F.col("pos").alias("ref_pos"), *[F.col(c).alias(f"ref_{c}") for c in columns])
    return pairs.join(a, "sub_pos").join(b, "ref_pos")


def exact_matches(pairs: DataFrame, subs: DataFrame, refs: DataFrame, settings: Settings) -> DataFrame:
    """``(pair, phrase, at)``: eligible phrases of the submission (distinct,
    with their index) that stand in the reference's text.

    Substring containment is an equi-join: a phrase t1..tw stands in a text
    exactly if its inner tokens stand there in a row behind a token that ends
    with t1 and before one that starts with tw.  The pairs are joined to the
    references' side first, so that a passage of all texts meets the paired ones
    only."""
    width = max(5, settings.word_shingle_size)
    wanted = pairs.select("sub_pos").distinct()
    mine = subs.join(wanted, F.col("pos") == F.col("sub_pos"), "left_semi")
    listed = mine.select(F.col("pos").alias("sub_pos"), F.size("tokens").alias("n"), F.posexplode_outer(phrases(F.col("tokens"), settings)).alias("at", "phrase"))
    eligible = listed.filter(F.length("phrase") >= settings.min_exact_phrase_characters)
    least = lambda found: found.groupBy("sub_pos", "n", "phrase").agg(F.min("at").alias("at"))
    parts = F.split("phrase", " ")
    inner = F.array_join(F.slice(parts, 2, width - 2), " ")
    grams = refs.select(F.col("pos").alias("ref_pos"), "tokens", F.posexplode_outer(X.word_shingles(F.col("tokens"), width - 2)).alias("g", "inner"))
    # The inner gram at token g needs a token before it and one behind it.
    grams = grams.filter((F.col("g") >= 1) & (F.col("g") + width - 2 < F.size("tokens"))).select("ref_pos", "inner", F.get("tokens", F.col("g") - 1).alias("left"), F.get("tokens", F.col("g") + width - 2).alias("right"))
    # Most phrases' inner tokens stand in no reference: these are left out before phrases move.
    long = least(eligible.filter(F.col("n") >= width).withColumn("inner", inner).join(grams.select("inner").distinct(), "inner", "left_semi"))
    long = long.withColumns({"inner": inner, "head": F.element_at(parts, 1), "tail": F.element_at(parts, -1)})
    there = grams.join(pairs.select("sub_pos", "ref_pos"), "ref_pos")
    found = long.join(there, ["sub_pos", "inner"]).filter(F.col("left").endswith(F.col("head")) & F.col("right").startswith(F.col("tail"))).select("sub_pos", "ref_pos", "phrase", "at").distinct()
    whole = _sides(pairs.join(least(eligible.filter(F.col("n") < width)), "sub_pos"), subs, refs, "norm").filter(F.col("ref_norm").contains(F.col("phrase")))
    return found.unionByName(whole.select("sub_pos", "ref_pos", "phrase", "at"))


def exact_scores(pairs: DataFrame, subs: DataFrame, refs: DataFrame, settings: Settings) -> DataFrame:
    """``pairs`` with ``matched``, ``eligible`` and ``exact`` (0 if none)."""
    matched = exact_matches(pairs, subs, refs, settings).groupBy("sub_pos", "ref_pos").agg(F.count("*").alias("matched"))
    kept = F.filter(F.array_distinct(phrases(F.col("tokens"), settings)), lambda p: F.length(p) >= settings.min_exact_phrase_characters)
    eligible = subs.select(F.col("pos").alias("sub_pos"), F.size(kept).alias("eligible"))
    out = pairs.join(matched, ["sub_pos", "ref_pos"], "left").join(eligible, "sub_pos").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return out.withColumn("exact", F.when(F.col("eligible") > 0, F.col("matched") / F.col("eligible")).otherwise(0.0))


def char_jaccard(a: Column, b: Column, size: int) -> Column:
    """Jaccard of character shingles; each side's width is capped by its own
    length, texts are read up to their first 100,000 characters."""
    shingles = lambda t: X.char_shingles(F.substring(t, 1, WINDOW_CHARS), F.least(F.lit(size), F.greatest(F.length(t), F.lit(1))))
    return X.set_jaccard(shingles(a), shingles(b))


def shingle_scores(pairs: DataFrame, subs: DataFrame, refs: DataFrame, settings: Settings) -> DataFrame:
    """``pairs`` (with word ``jaccard``) and ``char_jaccard`` and ``shingle``."""
    full = _sides(pairs, subs, refs, "norm")
    full = full.withColumn("char_jaccard", char_jaccard(F.col("sub_norm"), F.col("ref_norm"), settings.character_shingle_size))
    return full.drop("sub_norm", "ref_norm").withColumn("shingle", 0.65 * F.col("jaccard") + 0.35 * F.col("char_jaccard"))


def fuzzy_scores(pairs: DataFrame, subs: DataFrame, refs: DataFrame) -> DataFrame:
    """``pairs`` with the alignment, LCS and edit parts and ``fuzzy``, over the
    first 900 words of either side.  Only candidate pairs reach Python."""
    head = lambda d: d.withColumn("head", F.slice("words", 1, FUZZY_TOKENS))
    full = _sides(pairs, head(subs), head(refs), "head")
    a, b = F.col("sub_head"), F.col("ref_head")
    full = full.withColumns({"align": U.measures(a, b), "longest": F.greatest(F.size(a), F.size(b))}).drop("sub_head", "ref_head")
    full = full.withColumns({"lcs": F.col("align.lcs"), "edits": F.col("align.edits")})
    share = lambda x: F.when(F.col("longest") > 0, x).otherwise(1.0)
    lcs, edit = share(F.col("lcs") / F.col("longest")), share(1.0 - F.col("edits") / F.col("longest"))
    return full.withColumn("fuzzy", 0.50 * F.col("align.similarity") + 0.30 * lcs + 0.20 * edit)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(x, F.lit(0.0))))


def total_score(exact: Column, shingle: Column, fuzzy: Column, graph: Column, weights: tuple[float, ...]) -> Column:
    """Weighted mean of the clamped parts.  A family that is off has weight 0;
    the graph's weight counts in the base pass too, with signal 0."""
    weighted = [clamp(x) * float(w) for x, w in zip((exact, shingle, fuzzy, graph), weights, strict=True)]
    return clamp(reduce(lambda a, b: a + b, weighted) / F.lit(float(weights[0] + weights[1] + weights[2] + weights[3])))


def cases(scored: DataFrame, n_refs: int, prefix: str = "PD") -> DataFrame:
    """``scored`` with ``ordinal``, ``case_id`` and ``risk``."""
    ordinal = F.col("sub_pos") * n_refs + F.col("ref_pos")
    out = scored.withColumn("ordinal", ordinal).withColumn("case_id", F.concat_ws("-", F.lit(prefix), (ordinal + 1).cast("string"), "sub_id", "ref_id"))
    return out.withColumn("risk", X.risk(F.col("total")))
