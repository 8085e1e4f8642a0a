"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the hash of its content (its blob).
The ledger has a row for each scan of a blob: which rules, in which versions,
have seen it, and what they found.  A scan takes the blobs of the given versions
to the rules that have not seen them yet, and to no others: a text that stands
under a thousand paths, or that an earlier scan covered, is not read by a rule
again, and a rule of a new version reads every blob once.  Findings are joined
back to all paths and versions by blob.

    rows = scan_new(versions, ledger)       # appended to the ledger by update_ledger
    spans_by_version(versions, ledger)      # a row for each version
    findings(versions, ledger)              # a row for each finding and version

A ledger row is written once, with its findings, so a run that dies leaves
either the whole of it or nothing.  Secrets are kept by their hash alone.

Copies of a blob are dropped within each partition before texts are shuffled;
where results are joined back, blobs of a ``1 / HOT_BLOBS``-th of all versions or
more, at most ``HOT_BLOBS``, are dealt over ``SALTS`` keys.  Offsets come from
cutting a text at its matches: lengths of pieces and matches, summed along the
text, are the places.  All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.rows import fresh, text_of
from plumbline.scratch import materialise
from plumbline.sources import files

_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
HOT_BLOBS, SALTS = 256, 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches of ``pattern`` from the left, not overlapping,
    of which those that are not ``valid`` are dropped; ``may`` is a cheap
    necessary condition on the whole text."""

    kind: str
    version: int
    pattern: str
    may: Callable[[Column], Column]
    valid: Callable[[Column], Column] = lambda value: F.lit(True)

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _longer(n: int) -> Callable[[Column], Column]:
    return lambda value: F.length(value) >= n


BASE = (
    Rule("assign", 1, f"(?i){_ASSIGN}", lambda t: t.rlike(f"(?i){_ASSIGN}"), lambda v: F.length(F.regexp_extract(v, f"(?i){_ASSIGN}", 2)) >= 12),
    Rule("access", 1, "AKIA[A-Z0-9]+", lambda t: t.contains("AKIA"), _longer(18)),
    Rule("hex", 1, "[0-9a-f]{16,}+", lambda t: t.rlike("[0-9a-f]{16}"), _longer(16)),
)
#: Further kinds: private keys by their first line, signed web tokens, and
#: credentials within an address.
RULES = (
    *BASE,
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda t: t.contains("PRIVATE KEY-----")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", lambda t: t.contains(".eyJ")),
    Rule("url", 1, r"://[A-Za-z0-9._%+-]++:[A-Za-z0-9._%+!$&*=-]++@", lambda t: t.contains("://") & t.contains("@")),
)
SPANS = "array<struct<kind:string,version:int,start:bigint,end:bigint,secret:string>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


def blob_of(text_col: str) -> Column:
    """SHA-256 of the text; a null text is an empty one."""
    return F.sha2(text_of(text_col), 256)


def _seen(ledger: DataFrame) -> DataFrame:
    """``(blob, seen)``: a blob's rules of all scans."""
    return ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger rows (``LEDGER``) of the blobs of ``versions`` and rules that
    ``ledger`` does not have yet; stored.  Blobs without findings have a row
    too, which says that they were seen."""
    texts = versions.select(blob_of(text_col).alias("blob"), text_of(text_col).alias("text")).dropDuplicates(["blob"])
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        texts = texts.withColumn("todo", wanted)
    else:
        known = _seen(ledger).withColumnRenamed("blob", "seen_blob")
        texts = texts.join(known, F.col("blob") == F.col("seen_blob"), "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        texts = texts.filter(F.size("todo") > 0).drop("seen_blob", "seen")

    def cut(k: int, rule: Rule) -> Column:
        here = F.array_contains("todo", rule.key) & rule.may(F.col("text"))
        return F.struct(F.lit(k).alias("k"), F.when(here, F.split("text", rule.pattern)).alias("pieces"), F.when(here, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).alias("values"))

    nothing = F.array().cast("array<string>")
    mark = F.struct(F.lit(-1).alias("k"), nothing.alias("pieces"), nothing.alias("values"))  # a row for each blob, found or not
    found = texts.select("blob", "todo", F.explode(F.array(mark, *[cut(k, r) for k, r in enumerate(rules)])).alias("f")).filter("f.k < 0 or size(f.values) > 0")
    rows = found.select("blob", F.when(F.col("f.k") < 0, F.col("todo")).alias("todo"), "f.k", F.posexplode_outer(F.arrays_zip("f.pieces", "f.values")).alias("i", "m"))
    along = Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("blob", "todo", "k", "i", F.length("m.pieces").alias("gap"), F.length("m.values").alias("size"), F.col("m.values").alias("value"))
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(along))
    valid, kind, version = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, rule in enumerate(rules):
        of = F.col("k") == k
        valid, kind, version = F.when(of, rule.valid(F.col("value"))).otherwise(valid), F.when(of, rule.kind).otherwise(kind), F.when(of, rule.version).otherwise(version)
    span = F.struct(kind.alias("kind"), version.alias("version"), (F.col("end") - F.col("size")).alias("start"), F.col("end").alias("end"), F.sha2("value", 256).alias("secret"))
    listed = rows.groupBy("blob").agg(F.max("todo").alias("rules"), F.collect_list(F.when(F.col("value").isNotNull() & valid, span)).alias("spans"))
    return materialise(listed.select("blob", "rules", F.col("spans").cast(SPANS).alias("spans")), "secret-ledger")


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, empty if there is none yet."""
    return spark.read.schema(LEDGER).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], LEDGER)


def update_ledger(spark: SparkSession, path: str, versions: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Scans what is new in ``versions`` and appends it to the ledger at
    ``path``, a folder that every executor shares; gives the whole ledger.  One
    writer at a time: of two at once both would scan the same blobs, whose rows
    then stand twice, with equal findings."""
    scan_new(versions, open_ledger(spark, path), rules, text_col).write.mode("append").parquet(path)
    return open_ledger(spark, path)


def spans_by_version(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The columns of ``versions`` without the text, with ``secret_blob`` and
    ``secret_spans`` (kind, version, start, end, secret), in order of start and
    then of ``rules``.  Each row of ``versions`` has one, repeated rows too; null
    and empty texts have no spans; very long texts are taken whole.  Findings of
    other rules or rule versions that the ledger holds are left out.  Columns of
    clashing names stay: the new ones get underscores in front.  Offsets count
    code points."""
    blob, spans, salt, hot_blob, hot_salt, of = fresh(versions, "secret_blob", "secret_spans", "secret_salt", "secret_hot", "secret_hot_salt", "secret_of")
    rest = [F.col(f"`{c}`") for c in versions.columns if c != text_col]
    addressed = materialise(versions.select(*rest, blob_of(text_col).alias(blob)), "secret-versions")
    keys = [r.key for r in rules]
    place = F.array(*[F.lit(key) for key in keys])
    key_of = lambda s: F.concat_ws("@", s["kind"], s["version"].cast("string"))
    rows = ledger.filter(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).filter(key_of(F.col("s")).isin(keys)).distinct()
    ordered = F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.array_position(place, key_of(F.col("s"))).alias("place"), F.col("s").alias("s"))))
    found = rows.groupBy(F.col("blob").alias(of)).agg(F.transform(ordered, lambda x: x["s"]).alias(spans))

    least = addressed.count() / HOT_BLOBS
    hot = F.broadcast(addressed.groupBy(F.col(blob).alias(hot_blob)).agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("n") > SALTS)).select(hot_blob))
    dealt = addressed.join(hot, F.col(blob) == F.col(hot_blob), "left").withColumn(salt, F.when(F.col(hot_blob).isNotNull(), F.floor(F.rand(0) * SALTS)).otherwise(0).cast("int")).drop(hot_blob)
    salts = F.when(F.col(hot_blob).isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = found.join(hot, F.col(of) == F.col(hot_blob), "left").select(of, spans, F.explode(salts).alias(hot_salt))
    joined = dealt.join(found, (F.col(blob) == F.col(of)) & (F.col(salt) == F.col(hot_salt)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in addressed.columns], F.coalesce(F.col(spans), F.array().cast(SPANS)).alias(spans))


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """A row for each finding in each version: the columns of ``versions``
    without the text, ``secret_blob``, kind, version, start, end and secret
    (the matched text's SHA-256) under ``secret_found``."""
    out = spans_by_version(versions, ledger, rules, text_col)
    spans, (found,) = out.columns[-1], fresh(versions, "secret_found")
    return out.withColumn(found, F.explode(spans)).drop(spans)


def listed(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """kind:start:end of the spans (of ``kinds`` only), in their order."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob)`` of
    documents that no ledger has seen, each the only version of its path."""
    versions = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = spans_by_version(versions, scan_new(versions))
    spans, kinds = F.col("secret_spans"), [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in kinds], F.sha2(listed(spans, kinds), 256).alias("base_sha256"), listed(spans).alias("spans"), F.col("secret_blob").alias("blob"))


def _sql_kind(k: int, kind: str, pattern: str, valid: str) -> str:
    return f"""
  SELECT rid, {k} AS k, '{kind}' AS kind, i, v, {valid} AS valid,
         sum(gap + len(v)) OVER (PARTITION BY rid ORDER BY i) AS stop
  FROM (SELECT rid, unnest(range(len(vs))) AS i, unnest(vs) AS v, unnest(list_transform(ps[:len(vs)], lambda x: len(x))) AS gap
        FROM (SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS vs, regexp_split_to_array(t, '{pattern}') AS ps FROM d))"""


_SQL_ASSIGN = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)") + _ASSIGN.split(")", 1)[1].replace("'", "''")
#: DuckDB SQL of op11 over the view ``documents``.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_kind(*x) for x in (
    (0, "assign", _SQL_ASSIGN, f"len(regexp_extract(v, '{_SQL_ASSIGN}', 2)) >= 12"),
    (1, "access", "AKIA[A-Z0-9]+", "len(v) >= 18"),
    (2, "hex", "[0-9a-f]+", "len(v) >= 16"),
    (3, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    (4, "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    (5, "url", "://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$&*=-]+@", "true"),
))}),
s AS (SELECT *, kind || ':' || (stop - len(v))::BIGINT::VARCHAR || ':' || stop::BIGINT::VARCHAR AS span, stop - len(v) AS start FROM found WHERE valid),
a AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (k < 3), '') AS base, string_agg(span, ',' ORDER BY start, k) AS spans
      FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN a USING (rid)
"""
