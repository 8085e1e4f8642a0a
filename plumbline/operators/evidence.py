"""Located evidence of scored pairs, and its compaction.

Each document is taken apart once, into a table of its tokens with their places
in the text and in the normal form.  Evidence is joins on it: a phrase stands in
a text exactly if its inner tokens stand there in a row behind a token that ends
with its first and before one that starts with its last, so phrases meet windows
of tokens by (pair's submission, inner tokens), and shingles by their words.  The
pairs come into the joins before the texts meet, on the references' side: a
passage that all documents share meets the paired documents only.  The alignment
alone is a kernel, over batches of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.operators import scoring
from plumbline.scratch import materialise
from plumbline.settings import STOPWORDS, Settings

TYPES = ("EXACT", "SHINGLE", "FUZZY", "MULTI_PATTERN")
LABELS = ("Knuth-Morris-Pratt", "Rabin-Karp (hash verified)", "Z-algorithm")
MULTI_PATTERNS, FUZZY_TOKENS = 512, 900
SCHEMA = "case_id string, idx int, type string, sub_start int, sub_end int, ref_start int, ref_end int, similarity double, algorithm string, excerpt string"
_RUN = r"[\p{L}\p{Nd}]+"


def token_rows(docs: DataFrame) -> DataFrame:
    """``(pos, i, token, at, to, norm_at)`` of every token of ``docs`` (pos,
    content): where it stands in the content and where it starts in the normal
    form.  Places count code points; lower case is as long as what it stands for."""
    runs = F.arrays_zip(F.split("content", _RUN).alias("gap"), F.regexp_extract_all("content", F.lit(_RUN), F.lit(0)).alias("raw"))
    rows = docs.select("pos", F.posexplode(runs).alias("i", "m")).filter("m.raw is not null").select("pos", "i", X.lower_each(F.col("m.raw")).alias("token"), F.length("m.gap").alias("gap"), F.length("m.raw").alias("raw"))
    along = Window.partitionBy("pos").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"to": F.sum(F.col("gap") + F.col("raw")).over(along), "norm_to": F.sum(F.length("token") + 1).over(along) - 1})
    return rows.select("pos", "i", "token", (F.col("to") - F.col("raw")).alias("at"), "to", (F.col("norm_to") - F.length("token")).alias("norm_at"))


def _windows(tokens: DataFrame, width: int) -> DataFrame:
    """``(pos, i, token, at, norm_at, inner, tail, tail_at)`` of each ``width``
    tokens in a row: the first, the inner ones joined, the last."""
    row = Window.partitionBy("pos").orderBy("i")
    inner = F.concat_ws(" ", *[F.lead("token", k).over(row) for k in range(1, width - 1)])
    return tokens.select("pos", "i", "token", "at", "norm_at", inner.alias("inner"), F.lead("token", width - 1).over(row).alias("tail"), F.lead("at", width - 1).over(row).alias("tail_at")).filter("tail is not null")


def _phrases(windows: DataFrame, settings: Settings) -> DataFrame:
    """``(pos, phrase, i, rank, head, inner, tail)``: eligible phrases of each
    document, once, by their first window."""
    text = F.concat_ws(" ", "token", "inner", "tail")
    first = windows.filter(F.length(text) >= settings.min_exact_phrase_characters).groupBy("pos", text.alias("phrase")).agg(F.min(F.struct("i", "token", "inner", "tail")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("f.i"))
    return first.select("pos", "phrase", "f.i", rank.alias("rank"), F.col("f.token").alias("head"), "f.inner", "f.tail")


def _stands(windows: DataFrame) -> DataFrame:
    """Windows that were joined with phrases by their inner tokens (``left``,
    ``left_at``, ``left_norm``, ``right``, ``right_at``): those in which the
    phrase stands, with ``place`` (norm_at, start, end)."""
    hits = windows.filter(F.col("left").endswith(F.col("head")) & F.col("right").startswith(F.col("tail")))
    skipped = F.length("left") - F.length("head")
    start = F.col("left_at") + skipped
    end = F.col("right_at") + F.length("tail")
    return hits.withColumn("place", F.struct((F.col("left_norm") + skipped).alias("norm_at"), start.alias("start"), end.alias("end")))


def _sided(windows: DataFrame, key: str) -> DataFrame:
    return windows.select(F.col("pos").alias(key), "inner", F.col("token").alias("left"), F.col("at").alias("left_at"), F.col("norm_at").alias("left_norm"), F.col("tail").alias("right"), F.col("tail_at").alias("right_at"))


def phrase_hits(pairs: DataFrame, sub_tokens: DataFrame, ref_tokens: DataFrame, settings: Settings) -> DataFrame:
    """``(sub_pos, ref_pos, phrase, i, rank, place)``: every place, overlapping
    ones too, at which an eligible phrase of the submission stands in the
    reference.  ``i`` is the phrase's first window, ``rank`` its number among the
    submission's phrases.  Submissions shorter than a window are left out."""
    width = max(5, settings.word_shingle_size)
    phrases = _phrases(_windows(sub_tokens, width), settings).withColumnRenamed("pos", "sub_pos")
    there = _sided(_windows(ref_tokens, width), "ref_pos").join(pairs.select("sub_pos", "ref_pos"), "ref_pos")
    return _stands(phrases.join(there, ["sub_pos", "inner"])).select("sub_pos", "ref_pos", "phrase", "i", "rank", "head", "inner", "tail", "place")


def _exact(pairs: DataFrame, subs: DataFrame, refs: DataFrame, sub_tokens: DataFrame, ref_tokens: DataFrame, settings: Settings) -> DataFrame:
    """``(sub_pos, ref_pos, phrase, i, rank, here, there)``: the first place of
    each phrase on either side."""
    width = max(5, settings.word_shingle_size)
    hits = phrase_hits(pairs, sub_tokens, ref_tokens, settings)
    first = materialise(hits.groupBy("sub_pos", "ref_pos", "phrase", "i", "rank", "head", "inner", "tail").agg(F.min("place").alias("there")), "evidence-phrases")
    own = _stands(first.select("sub_pos", "phrase", "head", "inner", "tail").distinct().join(_sided(_windows(sub_tokens, width), "sub_pos"), ["sub_pos", "inner"]))
    here = own.groupBy("sub_pos", "phrase").agg(F.min("place").alias("here"))
    long = first.join(here, ["sub_pos", "phrase"]).select("sub_pos", "ref_pos", "phrase", "i", "rank", "here", "there")
    # A submission of fewer tokens is one phrase as a whole.
    whole = sub_tokens.groupBy("pos").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda t: t["token"]), " ").alias("phrase"), F.min("at").alias("start"), F.max("to").alias("end"))
    whole = whole.filter((F.col("n") < width) & (F.length("phrase") >= settings.min_exact_phrase_characters)).withColumnRenamed("pos", "sub_pos")
    found = pairs.select("sub_pos", "ref_pos").join(whole, "sub_pos").join(refs.select(F.col("pos").alias("ref_pos"), "norm"), "ref_pos").withColumn("norm_at", F.expr("instr(norm, phrase)") - 1).filter("norm_at >= 0").drop("norm")
    last = F.col("norm_at") + F.length("phrase") - 1
    placed = found.join(ref_tokens.select(F.col("pos").alias("ref_pos"), "token", "at", F.col("norm_at").alias("t")), "ref_pos")
    holds = lambda x: (F.col("t") <= x) & (x < F.col("t") + F.length("token"))
    on = lambda x: F.max(F.when(holds(x), F.col("at") + x - F.col("t")))
    short = placed.groupBy("sub_pos", "ref_pos", "phrase", "start", "end", "norm_at").agg(on(F.col("norm_at")).alias("from"), (on(last) + 1).alias("upto"))
    place = lambda norm, a, b: F.struct(norm.cast("long").alias("norm_at"), F.col(a).cast("long").alias("start"), F.col(b).cast("long").alias("end"))
    short = short.select("sub_pos", "ref_pos", "phrase", F.lit(0).alias("i"), F.lit(1).alias("rank"), place(F.lit(0), "start", "end").alias("here"), place(F.col("norm_at"), "from", "upto").alias("there"))
    as_long = F.transform(F.array("here", "there"), lambda p: F.struct(p["norm_at"].cast("long").alias("norm_at"), p["start"].cast("long").alias("start"), p["end"].cast("long").alias("end")))
    long = long.withColumn("both", as_long).select("sub_pos", "ref_pos", "phrase", "i", "rank", F.get("both", F.lit(0)).alias("here"), F.get("both", F.lit(1)).alias("there"))
    return long.unionByName(short)


def _words(tokens: DataFrame, stop: list[str]) -> DataFrame:
    """``(pos, w, token, at, to)``: tokens that are no stopwords, numbered."""
    kept = tokens.filter(~F.col("token").isin(stop)) if stop else tokens
    return kept.select("pos", (F.row_number().over(Window.partitionBy("pos").orderBy("i")) - 1).alias("w"), "token", "at", "to")


def _shingles(words: DataFrame, width: int) -> DataFrame:
    """``(pos, w, shingle, at, to)`` of each ``width`` words in a row."""
    row = Window.partitionBy("pos").orderBy("w")
    text = F.concat_ws(" ", "token", *[F.lead("token", k).over(row) for k in range(1, width)])
    return words.select("pos", "w", text.alias("shingle"), "at", F.lead("to", width - 1).over(row).alias("to")).filter("to is not null")


def evidence(cases: DataFrame, subs: DataFrame, refs: DataFrame, settings: Settings, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """Evidence rows (``SCHEMA``) of ``cases`` (case_id, sub_pos, ref_pos,
    shingle, and ``align`` if it is known) over prepared documents.  ``idx``
    numbers a case's rows: exact phrases by their place among the submission's,
    the first hit of many patterns, shingles by their place, the alignment."""
    stop = X.normalized_stopwords(stopwords) if settings.remove_stopwords else []
    used = lambda docs, key: docs.join(cases.select(F.col(key).alias("pos")).distinct(), "pos", "left_semi")
    sub_tokens = materialise(token_rows(used(subs, "sub_pos").select("pos", "content")), "evidence-tokens")
    ref_tokens = materialise(token_rows(used(refs, "ref_pos").select("pos", "content")), "evidence-tokens")
    parts: list[DataFrame] = []

    def add(rows: DataFrame, order: int, kind: Column | str, by: str, spans: tuple[str, str, str, str], similarity: Column, algorithm: Column, excerpt: str) -> None:
        places = [F.col(c).cast("int").alias(n) for c, n in zip(spans, ("sub_start", "sub_end", "ref_start", "ref_end"), strict=True)]
        parts.append(rows.select("sub_pos", "ref_pos", F.lit(order).alias("o"), F.col(by).cast("long").alias("k"), F.lit(kind).alias("type"), *places, similarity.cast("double").alias("similarity"), algorithm.alias("algorithm"), F.col(excerpt).alias("excerpt")))

    if settings.enable_exact:
        exact = materialise(_exact(cases, subs, refs, sub_tokens, ref_tokens, settings), "evidence-exact")
        spans = ("here.start", "here.end", "there.start", "there.end")
        label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("i") % 3 + 1).cast("int"))
        add(exact, 0, "EXACT", "i", spans, F.lit(1.0), label, "phrase")
        n = F.length("phrase")
        first = Window.partitionBy("sub_pos", "ref_pos").orderBy(F.col("there.norm_at") + n, n.desc(), "i")
        several = exact.filter(F.col("rank") <= MULTI_PATTERNS).withColumn("hit", F.row_number().over(first)).filter("hit = 1")
        add(several, 1, "MULTI_PATTERN", "i", spans, F.lit(1.0), F.lit("Aho-Corasick"), "phrase")
    if settings.enable_shingle:
        mine = _shingles(_words(sub_tokens, stop), settings.word_shingle_size).select(F.col("pos").alias("sub_pos"), "shingle", F.col("w").alias("i"), F.col("at").alias("a"), F.col("to").alias("b"))
        theirs = _shingles(_words(ref_tokens, stop), settings.word_shingle_size).groupBy(F.col("pos").alias("ref_pos"), "shingle").agg(F.min(F.struct("w", "at", "to")).alias("first"))
        theirs = theirs.join(cases.select("sub_pos", "ref_pos", F.col("shingle").alias("score")), "ref_pos")
        both = mine.join(theirs, ["sub_pos", "shingle"])
        add(both, 2, "SHINGLE", "i", ("a", "b", "first.at", "first.to"), F.least(F.lit(1.0), F.greatest(F.col("score"), F.lit(0.01))), F.lit("word-shingle Jaccard"), "shingle")
    if settings.enable_fuzzy:
        aligned = cases if "align" in cases.columns else scoring.fuzzy_scores(cases.select("sub_pos", "ref_pos"), subs, refs)
        heads = lambda tokens, side: (
            _words(tokens, stop).filter(F.col("w") < FUZZY_TOKENS).groupBy(F.col("pos").alias(f"{side}_pos")).agg(F.array_sort(F.collect_list(F.struct("w", "token", "at", "to"))).alias(side))
        )
        ends = aligned.filter("align.score > 0").join(heads(sub_tokens, "sub"), "sub_pos").join(heads(ref_tokens, "ref"), "ref_pos")
        at = lambda side, k, field: F.get(side, k)[field]
        ends = ends.select(
            "sub_pos",
            "ref_pos",
            at("sub", F.col("align.sub_start"), "at").alias("a"),
            at("sub", F.col("align.sub_end") - 1, "to").alias("b"),
            at("ref", F.col("align.ref_start"), "at").alias("c"),
            at("ref", F.col("align.ref_end") - 1, "to").alias("d"),
            F.col("align.similarity").alias("s"),
            F.array_join(F.transform(F.slice("sub", F.col("align.sub_start") + 1, F.col("align.sub_end") - F.col("align.sub_start")), lambda t: t["token"]), " ").alias("words"),
        )
        add(ends, 3, "FUZZY", "a", ("a", "b", "c", "d"), F.least(F.lit(1.0), "s"), F.lit("Smith-Waterman"), "words")
    if not parts:
        return cases.sparkSession.createDataFrame([], SCHEMA)
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = rows.join(cases.select("case_id", "sub_pos", "ref_pos"), ["sub_pos", "ref_pos"])
    idx = F.row_number().over(Window.partitionBy("case_id").orderBy("o", "k")) - 1
    return rows.select("case_id", idx.alias("idx"), "type", "sub_start", "sub_end", "ref_start", "ref_end", "similarity", "algorithm", "excerpt")


def compact(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of each case by greedy cover, with ``place``.

    Each type is worth 64 units once and each row one of its own, relevance is
    its similarity, cost its length.  The greedy choice is two windows: the
    best row of a type counts 65 units, every other 1."""
    length = F.greatest(F.lit(1.0), (F.col("sub_end") - F.col("sub_start")) / 50.0)
    relevance = F.greatest(F.lit(0.01), F.col("similarity"))
    rows = rows.withColumns({"__rel": relevance, "__cost": length, "__n": F.count("*").over(Window.partitionBy("case_id"))})
    first = Window.partitionBy("case_id", "type").orderBy((65 * F.col("__rel") / F.col("__cost")).desc(), F.col("__rel").desc(), "idx")
    rows = rows.withColumn("__units", F.when(F.row_number().over(first) == 1, 65).otherwise(1))
    best = Window.partitionBy("case_id").orderBy((F.col("__units") * F.col("__rel") / F.col("__cost")).desc(), F.col("__units").desc(), F.col("__rel").desc(), "idx")
    place = F.when(F.col("__n") > limit, F.row_number().over(best)).otherwise(F.col("idx") + 1)
    return rows.withColumn("place", place).filter(F.col("place") <= limit).drop("__rel", "__cost", "__n", "__units")


def located(rows: DataFrame, cases: DataFrame, subs: DataFrame, refs: DataFrame) -> DataFrame:
    """``rows`` with ``sub_from``, ``sub_to``, ``ref_from`` and ``ref_to``: line
    and column of each end in its file (``line_offset`` counts header lines)."""
    rows = rows.join(cases.select("case_id", "sub_pos", "ref_pos"), "case_id")
    for side, docs in (("sub", subs), ("ref", refs)):
        skipped = F.col("line_offset") if "line_offset" in docs.columns else F.lit(0)
        rows = rows.join(docs.select(F.col("pos").alias(f"{side}_pos"), F.col("content").alias("__content"), skipped.alias("__skipped")), f"{side}_pos")
        for end, offset in (("from", f"{side}_start"), ("to", f"{side}_end")):
            line, column = X.line_of(F.col("__content"), F.col(offset)) + F.col("__skipped"), X.column_of(F.col("__content"), F.col(offset))
            rows = rows.withColumn(f"{side}_{end}", F.format_string("line %d, column %d", line, column))
        rows = rows.drop("__content", "__skipped", f"{side}_pos")
    return rows
