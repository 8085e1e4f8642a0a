"""Personal data: pattern spans, and information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Each
distinct value is a protected entity e.  Words that stand close to an entity
disclose it to the degree that they occur with it and nowhere else: with n(t)
the corpus count of a word t, co(t, e) its count within ``CONTEXT_WORDS`` words
of e, n(e) the entity's count and N all words,

    PMI(t; e) = log2( (co(t, e) / n(t)) / (n(e) / N) ),   IC(e) = log2(N / n(e)),

and t discloses e when PMI >= ``DISCLOSURE`` * IC, with n(t) + 1 for n(t) in the
PMI so that words of a small corpus are not taken for rare ones.  An entity that
occurs once is judged like any other.  Such words are removed.

Where single values are too rare to say more, their classes speak: an e-mail's
domain, an address's network, a card's issuer, a phone number's area.  Words
stand for a class c by the same measure among the words near entities of its
kind alone (N, n(t), n(c), co(t, c) are counts of such places, each text once),
so that words which go with every entity of the kind, like "mail", say nothing.
A word that discloses the class, at ``CLASS_SUPPORT`` places or more, but no
single value, is generalised: it is replaced by what it is, a name or a word.

Words are marked where they stand close to that entity, and only there: a text
without an entity is never touched.

Offsets come from cutting a text at its matches: the pieces' and matches'
lengths, summed along a text, are the places.  The patterns below match exactly
what the contract's do, from the left and without overlap, but are written with
possessive groups and look-behinds so that long runs cost linear time and no
recursion.  All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import let
from plumbline.llm.rows import fresh, text_key, text_of
from plumbline.scratch import materialise, scope

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap necessary conditions, so that most texts are not taken apart.
MAY_HOLD = {"email": None, "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
CONTEXT_WORDS, CONTEXT_CHARS = 5, 80
TERM = r"\p{L}{3,}"
DISCLOSURE = 0.9
CLASS_SUPPORT = 3
#: What stands for a span in a sanitised text, by tag: base spans by kind, a
#: removed word, a generalised name, another generalised word.
TAGS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<TERM>", "<NAME>", "<WORD>")
#: Code points of the pieces from which a sanitised text is put together.
CHUNK = 4096


def _may(kind: str, text: Column) -> Column:
    return text.contains("@") if MAY_HOLD[kind] is None else text.rlike(MAY_HOLD[kind])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == 0, True)
        .when(kind == 1, value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == 2, n.between(13, 19) & F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def base_spans(texts: DataFrame) -> DataFrame:
    """``(doc_id, text_key, kind, start, end, value, before, after)`` of every
    valid match in ``texts`` (doc_id, text_key, text), whose rows are
    different; ``before`` and ``after`` are the text next to it."""
    found = [
        F.struct(
            F.lit(k).alias("kind"),
            F.when(_may(kind, F.col("text")), F.split("text", PATTERNS[kind])).alias("pieces"),
            F.when(_may(kind, F.col("text")), F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).alias("values"),
        )
        for k, kind in enumerate(KINDS[:4])
    ]
    cut = texts.select("doc_id", "text_key", F.explode(F.array(*found)).alias("f")).filter("size(f.values) > 0")
    rows = cut.select("doc_id", "text_key", "f.kind", F.posexplode(F.arrays_zip("f.pieces", "f.values", F.slice("f.pieces", 2, 1 << 30).alias("next"))).alias("i", "m"))
    rows = rows.select(
        "doc_id",
        "text_key",
        "kind",
        "i",
        F.length("m.pieces").alias("gap"),
        F.col("m.values").alias("value"),
        F.right("m.pieces", F.lit(CONTEXT_CHARS)).alias("before"),
        F.left("m.next", F.lit(CONTEXT_CHARS)).alias("after"),
    )
    along = Window.partitionBy("doc_id", "text_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(along)
    placed = rows.withColumn("end", end).filter("value is not null").withColumn("start", F.col("end") - F.length("value"))
    return placed.filter(_valid(F.col("kind"), F.col("value"))).select("doc_id", "text_key", "kind", "start", "end", "value", "before", "after")


def _words_at(context: Column, from_left: bool) -> Column:
    """The ``CONTEXT_WORDS`` words nearest to the span, as (word, offset) in
    ``context``; a word that the context's far end may have cut is left out."""
    words, gaps = F.regexp_extract_all(context, F.lit(TERM), F.lit(0)), F.split(context, TERM)
    total = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), (total(gaps, i + 1) + total(words, i)).alias("at")))
    whole = F.length(context) < CONTEXT_CHARS
    if from_left:
        kept = F.filter(placed, lambda x: whole | (x["at"] > 0))
        return F.slice(kept, F.greatest(F.size(kept) - CONTEXT_WORDS + 1, F.lit(1)), F.lit(CONTEXT_WORDS))
    kept = F.filter(placed, lambda x: whole | (x["at"] + F.length(x["word"]) < CONTEXT_CHARS))
    return F.slice(kept, 1, CONTEXT_WORDS)


def class_of(kind: Column, value: Column) -> Column:
    """The class of an entity: domain, network, issuer or area."""
    digits = _digits(value)
    part = F.when(kind == 0, F.lower(F.substring_index(value, "@", -1))).when(kind == 1, F.substring_index(value, ".", 3)).when(kind == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    return F.concat_ws(":", kind.cast("string"), part)


def context_terms(spans: DataFrame) -> DataFrame:
    """``(doc_id, text_key, kind, entity, cls, term, capital, start, end)`` of
    the words close to each span."""
    who = ("doc_id", "text_key", "kind", F.concat_ws(":", "kind", F.lower("value")).alias("entity"), class_of(F.col("kind"), F.col("value")).alias("cls"))
    left = spans.select(*who, (F.col("start") - F.length("before")).alias("origin"), F.explode(_words_at(F.col("before"), True)).alias("w"))
    right = spans.select(*who, F.col("end").alias("origin"), F.explode(_words_at(F.col("after"), False)).alias("w"))
    start = F.col("origin") + F.col("w.at")
    return left.unionByName(right).select(
        "doc_id", "text_key", "kind", "entity", "cls", F.lower("w.word").alias("term"), F.col("w.word").rlike(r"^\p{Lu}").alias("capital"), start.alias("start"), (start + F.length("w.word")).alias("end")
    ).distinct()


def _ratio(co: Column, n: Column, ic: Column) -> Column:
    """PMI / IC of a word with ``n`` uses, ``co`` of them by the entity."""
    return F.when(ic > 0, F.log2(F.least(co / (n + 1), F.lit(1.0))) / ic + 1)


def disclosing_terms(texts: DataFrame, spans: DataFrame, contexts: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """``(entity, term)`` whose co-occurrence reaches the disclosure threshold.
    Words are counted over all ``texts``, first within each partition."""
    together = contexts.groupBy("entity", "term").agg(F.count("*").alias("co"))
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("n"))
    all_words = texts.agg(F.sum(F.regexp_count("text", F.lit(TERM)))).first()[0] or 1
    entities = spans.groupBy(F.concat_ws(":", "kind", F.lower("value")).alias("entity")).agg(F.count("*").alias("n_entity"))
    scored = together.join(counts, "term").join(entities, "entity")
    ic = F.log2(F.greatest(F.lit(float(all_words)) / F.col("n_entity"), F.lit(1.0)))
    return scored.filter(_ratio(F.col("co"), F.col("n"), ic) >= disclosure).select("entity", "term")


def class_terms(contexts: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """``(cls, term)`` whose co-occurrence reaches the disclosure threshold among
    the places near entities of the class's kind."""
    places = contexts.select("text_key", "kind", "cls", "term", "start").distinct()
    together = places.groupBy("kind", "cls", "term").agg(F.count("*").alias("co"))
    together = materialise(together, "pii-classes")
    terms = together.groupBy("kind", "term").agg(F.sum("co").alias("n"))
    classes = together.groupBy("kind", "cls").agg(F.sum("co").alias("n_class"))
    kinds = together.groupBy("kind").agg(F.sum("co").alias("n_kind"))  # four rows
    often = together.filter(F.col("co") >= CLASS_SUPPORT)
    scored = often.join(terms, ["kind", "term"]).join(classes.join(kinds, "kind"), ["kind", "cls"])
    return scored.filter(_ratio(F.col("co"), F.col("n"), F.log2(F.col("n_kind") / F.col("n_class"))) >= disclosure).select("cls", "term")


def all_spans(texts: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """``(doc_id, text_key, spans)`` of every text of ``texts`` (doc_id,
    text_key, text) that has any, ``spans`` sorted by start: tag, start, end,
    and where the text that stays begins before it, null if it is covered."""
    may = F.lit(False)
    for kind in KINDS[:4]:
        may = may | _may(kind, F.col("text"))
    candidates = texts.filter(may).dropDuplicates(["doc_id", "text_key"])
    spans = materialise(base_spans(candidates), "pii-spans")
    contexts = materialise(context_terms(spans), "pii-contexts")
    at = ("doc_id", "text_key", "start", "end")
    removed = contexts.join(disclosing_terms(texts, spans, contexts, disclosure), ["entity", "term"], "left_semi").select(*at, F.lit(4).alias("tag"))
    general = contexts.join(class_terms(contexts, disclosure), ["cls", "term"], "left_semi").select(*at, F.when(F.col("capital"), 5).otherwise(6).alias("tag"))
    marked = removed.unionByName(general).groupBy(*at).agg(F.min("tag").alias("tag"))
    rows = spans.select(*at, F.col("kind").alias("tag")).unionByName(marked)
    # In order along a text: a word that a base span overlaps is none of its
    # own, and what overlaps an earlier span is covered by it.
    of = Window.partitionBy("doc_id", "text_key").orderBy("start", F.desc("end"), "tag")
    base = F.col("tag") < 4
    upto = F.max(F.when(base, F.col("end"))).over(of.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(base, F.col("start"))).over(of.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"upto": upto, "behind": behind}).filter(base | ((F.coalesce("upto", F.lit(0)) <= F.col("start")) & (F.col("behind").isNull() | (F.col("behind") >= F.col("end")))))
    covered = F.coalesce(F.max("end").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("stays", F.when(covered <= F.col("start"), covered))
    listed = rows.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag", "stays"))).alias("spans"))
    return materialise(listed, "pii-listed")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), text_key(text_col).alias("text_key"))


def _kind(span: Column) -> Column:
    return F.least(span["tag"], F.lit(4))


def _listed(spans: Column) -> Column:
    """kind:start:end of the spans, by kind and start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(_kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with(*tags: int) -> Callable[[Column], Column]:
    return lambda s: s["tag"].isin(*tags)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_removed,
    n_generalised)``, one row per row of ``docs``; the last two count words.

    A null or empty text has no spans.  Repeated rows get equal results; rows
    of one id but different texts are told apart by a hash of the text; ids
    keep their type and may be null.  An empty table gives an empty result;
    columns of other names are not looked at.  Offsets count code points.
    """
    texts = _keyed(docs, id_col, text_col)
    found = all_spans(texts, disclosure).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "spans")
    joined = texts.select("doc_id", "text_key").join(found, (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,tag:int,stays:bigint>>"))
    joined = joined.select("doc_id", spans.alias("spans"))
    counts = [F.size(F.filter("spans", _with(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    more = [F.size(F.filter("spans", _with(*tags))).cast("long").alias(name) for name, tags in (("n_removed", (4,)), ("n_generalised", (5, 6)))]
    return joined.select("doc_id", *counts, F.sha2(_listed(F.filter("spans", _with(0, 1, 2, 3))), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), *more)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs``, all columns, with base spans replaced by ``<EMAIL>``, ``<IP>``,
    ``<CARD>`` and ``<PHONE>``, words that disclose an entity by ``<TERM>`` and
    words that disclose its class by ``<NAME>`` or ``<WORD>``.  Overlapping
    spans are removed as one.  Texts without spans, null ones too, stay as they
    are and are not shuffled.  Cases are as in ``find_pii``."""
    texts = _keyed(docs, id_col, text_col)
    i, k, spans = fresh(docs, "pii_id", "pii_key", "pii_spans")
    with scope(docs.sparkSession) as keep:
        found = keep(all_spans(texts, disclosure))
    found = found.select(F.col("doc_id").alias(i), F.col("text_key").alias(k), F.col("spans").alias(spans))
    may = F.lit(False)
    for kind in KINDS[:4]:
        may = may | F.coalesce(_may(kind, F.col(text_col).cast("string")), F.lit(False))
    clean, rest = docs.filter(~may), docs.filter(may)
    rest = rest.join(found, (text_key(text_col) == F.col(k)) & F.col(id_col).eqNullSafe(F.col(i)), "left")
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(_cut_out(F.col(text_col).cast("string"), F.col(spans)))
    return clean.unionByName(rest.withColumn(text_col, text).drop(i, k, spans))


def _cut_out(text: Column, spans: Column) -> Column:
    """The text with tags for its spans.  Places are looked up in pieces of
    ``CHUNK`` code points, so the work grows with length and spans, not with
    their product."""
    tags = F.array(*[F.lit(t) for t in TAGS])
    chunk = lambda c: F.substring(text, (c * CHUNK + 1).cast("int"), F.lit(CHUNK))
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / CHUNK).cast("int")), chunk)

    def put_together(all_: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            def part(c: Column) -> Column:
                lo = F.greatest(a, c * CHUNK)
                return F.substring(F.get(all_, c.cast("int")), (lo - c * CHUNK + 1).cast("int"), (F.least(b, (c + 1) * CHUNK) - lo).cast("int"))

            return F.when(a < b, F.array_join(F.transform(F.sequence(F.floor(a / CHUNK), F.floor((b - 1) / CHUNK)), part), "")).otherwise("")

        open_ = F.filter(spans, lambda s: s["stays"].isNotNull())
        pieces = F.transform(open_, lambda s: F.concat(between(s["stays"], s["start"]), F.get(tags, s["tag"])))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), let(last, lambda e: between(e, F.length(text).cast("long"))))

    return let(chunks, put_together)
