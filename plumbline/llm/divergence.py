"""Source divergence audit: how far each source's words lie from its language's.

Terms are runs of letters, A-Z lower-cased.  A language keeps the terms that
stand in ``LEAST_DOCUMENTS`` of its documents or more.  Over these V terms every
(language, source) group, and every language, has shares by add-one smoothing,

    p = 1 + floor(10^9 (count + 1) / (N + V)),

N its occurrences of kept terms, and (p - q)^2 / q, rounded down, says how far a
term's share p lies from another share q.  Summed over all kept terms this
compares two sources of a language; by term, against the language's own share,
it lists what a source says too often.

The plan is relational: matches are exploded and counted within each partition
before anything is shuffled; groups are crossed with their language's kept
terms, so that absent terms have shares too; the dense table joins itself on
(language, term), by the number that a kept term has, each unordered pair of
sources once with both directions, and the sums begin within the join's tasks.
The vocabulary of one language is dealt over ``SALTS`` keys.  Rows of the dense table are terms times sources, of the
self-join terms times pairs of sources: both grow with the vocabulary, not with
the documents.  All arithmetic is exact, in integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.rows import text_of
from plumbline.scratch import materialise

#: All but the ASCII characters that are no lower-case letter, for lower-cased
#: texts.  They are listed one by one: the JVM looks these up in a bit table,
#: which ranges do not get (a fifth of the time).
TERM = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).islower()) + "]+"
LEAST_DOCUMENTS = 3
#: Terms of a group that are listed, by falling divergence.
LISTED = 200
SALTS = 64
UNIT = 1_000_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else.  Where all else is lower-case letters the
    JVM's own lower-casing does the same, sooner."""
    return F.when(text.rlike(r"[^\x00-\x7F\p{Ll}]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def numbered_groups(docs: DataFrame, lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, Column]:
    """``(lang, source, g)`` of the groups that occur, stored, and the
    expression that gives a document's ``g``: a seeded hash, of a seed for which
    no two groups share one."""
    names = text_of(lang_col), text_of(source_col)
    groups = materialise(docs.select(names[0].alias("lang"), names[1].alias("source")).distinct(), "divergence-names")
    seed = 0
    while True:
        g = F.xxhash64(F.lit(seed), *names)
        named = groups.withColumn("g", F.xxhash64(F.lit(seed), "lang", "source"))
        if named.groupBy("g").count().filter("count > 1").isEmpty():
            return named, g
        seed += 1


def term_counts(docs: DataFrame, g: Column, text_col: str = "text") -> DataFrame:
    """``(g, term, n, docs)``: occurrences and documents of each term in each
    group."""
    found = F.regexp_extract_all(lower_ascii(text_of(text_col)), F.lit(TERM), F.lit(0))
    lists = docs.select(g.alias("g"), found.alias("terms"))
    lists = lists.select("g", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    rows = lists.select("g", "once", F.explode("terms").alias("term"))
    return rows.groupBy("g", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (n + v)), exact beyond 64 bits too."""
    wide = F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (n + v).cast("decimal(20,0)"))
    return F.when(count < UNIT, F.call_function("div", (count + 1) * UNIT, n + v)).otherwise(wide) + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, listed: int = LISTED) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.  Part ``pair``: for each
    group each other source of its language, by divergence from it.  Part
    ``term``: the ``listed`` terms whose share in the group exceeds that in the
    language most, by divergence.  Ties go by item, in the order of UTF-8.

    Null texts, languages and sources count as empty strings.  A language
    without kept terms has all its pairs at 0; one with a single source has no
    pairs.  Repeated rows count as documents of their own, very long texts are
    taken whole.  An empty table gives an empty result; columns of other names
    are not looked at.
    """
    named, g = numbered_groups(docs, lang_col, source_col)
    counts = materialise(term_counts(docs, g, text_col), "divergence-counts")
    by_term = counts.join(named.select("g", "lang"), "g").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    # Kept terms have numbers, so that what follows joins and sorts numbers.
    numbered = by_term.filter(F.col("docs") >= least).select(F.monotonically_increasing_id().alias("t"), "lang", "term", "lang_n")
    vocabulary = materialise(numbered, "divergence-terms")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    kept = counts.join(named.select("g", "lang"), "g").join(vocabulary, ["lang", "term"]).select("g", "t", "term", "n", "lang_n")
    kept = materialise(kept, "divergence-kept")
    totals = kept.groupBy("g").agg(F.sum("n").alias("total"))
    groups = named.join(totals, "g", "left").join(sizes, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = materialise(groups, "divergence-groups")

    salt = F.pmod(F.hash("t"), F.lit(SALTS))
    dealt = groups.select("lang", "g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    zeros = vocabulary.select("lang", "t", salt.alias("salt")).join(dealt, ["lang", "salt"]).select("t", "g", F.lit(0).cast("long").alias("n"))
    # By term first: the counts and the self-join then need one exchange.
    dense = zeros.unionByName(kept.select("t", "g", "n")).repartition("t").groupBy("t", "g").agg(F.sum("n").alias("n"))
    shares = dense.join(groups.select("g", "total", "v"), "g").select("t", "g", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    met = shares.join(shares.select("t", F.col("g").alias("h"), F.col("p").alias("q")), "t").filter("g < h")
    sums = met.groupBy("g", "h").agg(F.sum(_distance(F.col("p"), F.col("q"))).alias("there"), F.sum(_distance(F.col("q"), F.col("p"))).alias("back"))
    ways = F.explode(F.array(F.struct("g", "h", F.col("there").alias("value")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("value"))))
    sums = sums.select(ways.alias("w")).select("w.*")
    pairs = groups.select("lang", "source", "g").join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h")), "lang").filter("g <> h")
    pairs = pairs.join(sums, ["g", "h"], "left").withColumn("value", F.coalesce("value", F.lit(0)))

    heard = kept.join(groups, "g")
    heard = heard.withColumns({"p": _share(F.col("n"), F.col("total"), F.col("v")), "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))})
    terms = heard.filter("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order)
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return pairs.withColumn("rank", rank).select(*columns("pair")).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= listed).select(*columns("term")))


#: DuckDB SQL of op13 over the view ``documents``.
SQL = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
k AS (SELECT c.* FROM c JOIN kept USING (lang, term)),
dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(k.n, 0)::HUGEINT AS n
  FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = kept.term),
p AS (SELECT *, (1 + (1000000000 * (n + 1)) // (sum(n) OVER w + count(*) OVER w)::HUGEINT)::BIGINT AS p FROM dense WINDOW w AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM dense GROUP BY ALL),
q AS (SELECT *, (1 + (1000000000 * (n + 1)) // (sum(n) OVER w + count(*) OVER w)::HUGEINT)::BIGINT AS q FROM whole WINDOW w AS (PARTITION BY lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q)) // q.q
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM items)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
