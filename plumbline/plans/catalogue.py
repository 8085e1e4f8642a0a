"""Registered queries of the engine and the SQL that checks them.

Submissions are ``documents``, references ``benchmark``; the near-duplicate
network is ``documents`` against itself.  Reviewers and settings are fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import kernels as K
from plumbline.functions import text as X
from plumbline.functions import udfs as U
from plumbline.operators import candidates, corpus, cover, evidence, matching, network, ranking, scoring
from plumbline.operators.ordering import along
from plumbline.plans import analysis
from plumbline.report import case_reports, status, summary_lines
from plumbline.scratch import materialise
from plumbline.settings import STOPWORDS, Settings
from plumbline.sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SETTINGS = Settings()
REVIEWERS = ((0, "R1", "Reviewer One", 2), (1, "R2", "Reviewer Two", 2), (2, "R3", "Reviewer Three", 1))
OFF_GRAPH = Settings(enable_fuzzy=False, enable_graph=False)

# ------------------------------------------------------------------ SQL parts
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _prepared_sql(name: str, table: str, key: str, prefix: str) -> str:
    return f"""
{name}0 AS (SELECT {key} AS pos, '{prefix}' || {key} AS id, text AS content, trim(lower(regexp_replace(text, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))) AS norm FROM {table}),
{name}1 AS (SELECT *, list_filter(string_split(norm, ' '), lambda t: t <> '') AS tokens FROM {name}0),
{name} AS (SELECT *, list_filter(tokens, lambda t: NOT list_contains({_STOP}, t)) AS words FROM {name}1)"""


def _shingles_sql(tokens: str, w: int) -> str:
    return f"CASE WHEN len({tokens}) >= {w} THEN list_transform(range(0, len({tokens}) - {w - 1}), lambda i: array_to_string({tokens}[i + 1 : i + {w}], ' ')) ELSE [] END"


SUBS = _prepared_sql("subs", "documents", "doc_id", "D")
REFS = _prepared_sql("refs", "benchmark", "item_id", "B")
PAIRS = f"""
ss AS (SELECT pos, id, list_distinct({_shingles_sql('words', 4)}) AS s FROM subs),
rs AS (SELECT pos, id, list_distinct({_shingles_sql('words', 4)}) AS s FROM refs),
sx AS (SELECT pos AS sub_pos, id AS sub_id, len(s) AS sn, unnest(s) AS g FROM ss),
rx AS (SELECT pos AS ref_pos, id AS ref_id, len(s) AS rn, unnest(s) AS g FROM rs),
jp AS (SELECT sub_pos, sub_id, ref_pos, ref_id, sn, rn, count(*) AS n_both FROM sx JOIN rx USING (g) GROUP BY ALL),
pairs AS (SELECT sub_pos, sub_id, ref_pos, ref_id, n_both, n_both / (sn + rn - n_both) AS jaccard FROM jp)"""
_GRAMS = "list_distinct(CASE WHEN len(substr({t}, 1, 100000)) >= {w} AND len({t}) > 0 THEN list_transform(range(1, len(substr({t}, 1, 100000)) - {w} + 2), lambda i: substr({t}, i, {w})) ELSE [] END)"
CHARS = f"""
cg AS (
  SELECT p.*, {_GRAMS.format(t='s.norm', w='least(9, greatest(1, len(s.norm)))')} AS a, {_GRAMS.format(t='r.norm', w='least(9, greatest(1, len(r.norm)))')} AS b
  FROM pairs p JOIN subs s ON s.pos = sub_pos JOIN refs r ON r.pos = ref_pos),
cj AS (SELECT sub_pos, sub_id, ref_pos, ref_id, jaccard, coalesce(len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 0) AS char_jaccard FROM cg),
shingled AS (SELECT *, 0.65::DOUBLE * jaccard + 0.35::DOUBLE * char_jaccard AS shingle FROM cj)"""
EXACT = f"""
ph AS (SELECT pos, CASE WHEN len(tokens) >= 5 THEN {_shingles_sql('tokens', 5)} WHEN len(tokens) > 0 THEN [norm] ELSE [] END AS p FROM subs),
px AS (SELECT pos, unnest(p) AS phrase, generate_subscripts(p, 1) - 1 AS at_index FROM ph),
eligible AS (SELECT pos AS sub_pos, phrase, min(at_index) AS at_index FROM px WHERE len(phrase) >= 28 GROUP BY ALL),
matches AS (
  SELECT p.sub_pos, p.ref_pos, phrase, at_index, s.norm AS sub_norm, r.norm AS ref_norm
  FROM pairs p JOIN eligible USING (sub_pos) JOIN refs r ON r.pos = p.ref_pos JOIN subs s ON s.pos = p.sub_pos WHERE contains(r.norm, phrase)),
exact AS (
  SELECT p.*, coalesce(m.n, 0) AS matched, coalesce(e.n, 0) AS eligible, coalesce(m.n / e.n, 0) AS exact
  FROM pairs p LEFT JOIN (SELECT sub_pos, ref_pos, count(*) AS n FROM matches GROUP BY ALL) m USING (sub_pos, ref_pos)
  LEFT JOIN (SELECT sub_pos, count(*) AS n FROM eligible GROUP BY ALL) e USING (sub_pos))"""
_W = OFF_GRAPH.weights()
CASES = f"""
nrefs AS (SELECT count(*) AS n FROM benchmark),
scored AS (
  SELECT e.sub_pos, e.sub_id, e.ref_pos, e.ref_id, exact, shingle, least(1.0, greatest(0.0, (exact * {_W[0]}::DOUBLE + shingle * {_W[1]}::DOUBLE) / ({_W[0]}::DOUBLE + {_W[1]}::DOUBLE))) AS total
  FROM exact e JOIN shingled USING (sub_pos, ref_pos)),
cases AS (
  SELECT *, sub_pos * n + ref_pos AS ordinal, 'PD-' || (sub_pos * n + ref_pos + 1) || '-' || sub_id || '-' || ref_id AS case_id,
         CASE WHEN total >= 0.75 THEN 'CRITICAL' WHEN total >= 0.55 THEN 'HIGH' WHEN total >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk
  FROM scored CROSS JOIN nrefs)"""
ALL_CASES = f"WITH {SUBS}, {REFS}, {PAIRS}, {CHARS}, {EXACT}, {CASES}"
REVIEW = """,
reviewers(pos, id, name, capacity) AS (VALUES (0, 'R1', 'Reviewer One', 2), (1, 'R2', 'Reviewer Two', 2), (2, 'R3', 'Reviewer Three', 1)),
slots AS (SELECT *, sum(capacity) OVER (ORDER BY pos) AS upto FROM reviewers),
queue AS (SELECT *, row_number() OVER (ORDER BY total DESC, case_id) AS place FROM cases WHERE total >= 0.30),
assigned AS (SELECT q.*, s.id AS reviewer_id, s.name AS reviewer_name FROM queue q JOIN slots s ON place > upto - capacity AND place <= upto)"""
SEQ = """,
seq AS (
  SELECT row_number() OVER (ORDER BY total DESC, case_id DESC) - 1 AS pos, case_id, total, floor(total * 1000000 + 0.5)::BIGINT AS score FROM cases),
flags AS (SELECT *, (score >= 300000)::INT AS flag FROM seq)"""
# The graph as it is defined: every pair of documents, copies too.
NEAR = f"""WITH RECURSIVE {SUBS},
sets AS (SELECT pos, list_sort(list_distinct({_shingles_sql('words', 4)})) AS s FROM subs),
heads0 AS (SELECT pos, min(pos) OVER (PARTITION BY s) AS head FROM sets WHERE len(s) > 0),
sh AS (SELECT pos, len(s) AS n, unnest(s) AS g FROM sets),
twos AS (SELECT p.pos AS a, q.pos AS b, p.n AS pn, q.n AS qn, count(*) AS k FROM sh p JOIN sh q ON p.g = q.g AND p.pos < q.pos GROUP BY ALL),
near AS (SELECT a AS src, b AS dst, k / (pn + qn - k) AS similarity, greatest(1e-6::DOUBLE, 1.0::DOUBLE - k / (pn + qn - k)) AS cost FROM twos WHERE k / (pn + qn - k) >= 0.28::DOUBLE),
ways AS (SELECT src, dst, cost FROM near UNION ALL SELECT dst, src, cost FROM near),
dg AS (SELECT src AS v, count(*) AS k FROM ways GROUP BY src),
shown AS (SELECT near.* FROM near JOIN heads0 x ON x.pos = src JOIN heads0 y ON y.pos = dst WHERE src = x.head AND (dst = y.head OR y.head = src))"""
REACH = """,
reach(a, b) AS (SELECT src, dst FROM ways UNION SELECT r.a, w.dst FROM reach r JOIN ways w ON r.b = w.src),
parts AS (SELECT a AS v, least(a, min(b)) AS component FROM reach GROUP BY a),
heads AS (SELECT component, 'GROUP-' || row_number() OVER (ORDER BY component) AS group_id FROM (SELECT DISTINCT component FROM parts)),
grouped AS (SELECT group_id, v FROM parts JOIN heads USING (component))"""
# An edge is in the forest if no path of lesser edges joins its ends.
FOREST = """,
cand AS (SELECT src, dst, cost, row_number() OVER (ORDER BY cost, src, dst) AS o FROM shown),
turns AS (SELECT o, src AS a, dst AS b FROM cand UNION ALL SELECT o, dst, src FROM cand),
lesser(o, v) AS (SELECT o, src FROM cand UNION SELECT l.o, t.b FROM lesser l JOIN turns t ON t.a = l.v AND t.o < l.o)"""
# The three dynamic programs row by row; what goes along a row is a running
# maximum or minimum.  ``origin`` is the cell (i * 1000 + j) at which the traceback
# from a cell ends: its own if it is 0, else that of the cell it goes back to; of
# cells reached from the left, that of the last one that is not.
ALIGNED = f"""WITH RECURSIVE {SUBS}, {REFS}, {PAIRS},
two AS (SELECT sub_pos, ref_pos, sub_id, ref_id, s.words[1:900] AS a, r.words[1:900] AS b FROM pairs JOIN subs s ON s.pos = sub_pos JOIN refs r ON r.pos = ref_pos),
across AS (SELECT sub_pos, ref_pos, a, 0::BIGINT AS j, NULL::VARCHAR AS w FROM two UNION ALL SELECT sub_pos, ref_pos, a, generate_subscripts(b, 1), unnest(b) FROM two),
dp(sub_pos, ref_pos, i, j, lcs, edits, local, origin) AS (
  SELECT sub_pos, ref_pos, 0::BIGINT, j, 0::BIGINT, j, 0::BIGINT, j FROM across
  UNION ALL
  SELECT sub_pos, ref_pos, i, j, lcs, edits, local, CASE WHEN local = 0 THEN i * 1000 + j ELSE last_value(CASE WHEN own >= local THEN whence END IGNORE NULLS) OVER upto END FROM (
    SELECT sub_pos, ref_pos, i, j, max(lcs) OVER line AS lcs, min(edits - j) OVER line + j AS edits, max(own + 2 * j) OVER line - 2 * j AS local, own, CASE WHEN own = 0 THEN i * 1000 + j ELSE whence END AS whence FROM (
      SELECT sub_pos, ref_pos, i, j, lcs, edits, greatest(0, up, diagonal) AS own, CASE WHEN diagonal >= up THEN from_diagonal ELSE from_up END AS whence FROM (
        SELECT d.sub_pos, d.ref_pos, i + 1 AS i, d.j, greatest(lcs, coalesce(lag(lcs) OVER up + (w = a[i + 1])::BIGINT, 0)) AS lcs,
               least(edits + 1, coalesce(lag(edits) OVER up + (w <> a[i + 1])::BIGINT, edits + 1)) AS edits, local - 2 AS up, origin AS from_up,
               coalesce(lag(local) OVER up + CASE WHEN w = a[i + 1] THEN 3 ELSE -2 END, 0) AS diagonal, lag(origin) OVER up AS from_diagonal
        FROM dp d JOIN across x ON x.sub_pos = d.sub_pos AND x.ref_pos = d.ref_pos AND x.j = d.j WHERE i < len(a) WINDOW up AS (PARTITION BY d.sub_pos, d.ref_pos ORDER BY d.j)))
    WINDOW line AS (PARTITION BY sub_pos, ref_pos ORDER BY j))
  WINDOW upto AS (PARTITION BY sub_pos, ref_pos ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
best AS (SELECT sub_pos, ref_pos, max(local) AS alignment, arg_min(origin, (-local, i, j)) AS origin, arg_min(i, (-local, i, j)) AS i_end, arg_min(j, (-local, i, j)) AS j_end FROM dp GROUP BY ALL),
measured AS (
  SELECT sub_id, ref_id, sub_pos, ref_pos, alignment, best.origin // 1000 AS i0, best.origin % 1000 AS j0, i_end, j_end, least(1.0::DOUBLE, coalesce(alignment / nullif(3 * least(len(a), len(b)), 0), 0)) AS similarity, lcs, edits, greatest(len(a), len(b)) AS longest
  FROM two JOIN best USING (sub_pos, ref_pos) JOIN dp USING (sub_pos, ref_pos) WHERE i = len(a) AND j = len(b))"""
# 64-bit arithmetic in 128-bit integers; a product is taken in halves.
_times = lambda x, c: f"(({x}::HUGEINT * {c & 0xFFFFFFFF} + (({x}::HUGEINT * {c >> 32}) % 4294967296) * 4294967296) % 18446744073709551616)::UBIGINT"


def _finish_sql(name: str, source: str, keys: str) -> str:
    """Tables ``name`` (keys, x): the finaliser over ``source`` (keys, x)."""
    return f"""
{name}1 AS (SELECT {keys}, xor(x, x >> 30) AS x FROM {source}), {name}2 AS (SELECT {keys}, {_times('x', K.MIX_A)} AS x FROM {name}1),
{name}3 AS (SELECT {keys}, xor(x, x >> 27) AS x FROM {name}2), {name}4 AS (SELECT {keys}, {_times('x', K.MIX_B)} AS x FROM {name}3),
{name} AS (SELECT {keys}, xor(x, x >> 31) AS x FROM {name}4)"""


SIGNED = f"""WITH {SUBS}, {REFS},
sides AS (SELECT 's' AS side, pos, id, list_distinct({_shingles_sql('words', 4)}) AS s FROM subs UNION ALL SELECT 'r', pos, id, list_distinct({_shingles_sql('words', 4)}) FROM refs),
held AS (SELECT side, pos, unnest(s) AS g FROM sides),
signs AS (SELECT g, list_transform(regexp_extract_all(g, '(?s).'), lambda c: unicode(c)) AS c FROM (SELECT DISTINCT g FROM held)),
units AS (SELECT g, flatten(list_transform(c, lambda u: CASE WHEN u < 65536 THEN [u] ELSE [55296 + (u - 65536) // 1024, 56320 + (u - 65536) % 1024] END)) AS u FROM signs),
folded AS (SELECT g, xor(list_reduce(list_prepend({K.FNV_OFFSET}::UBIGINT, flatten(list_transform(u, lambda v: [(v % 256)::UBIGINT, (v // 256)::UBIGINT]))), lambda h, b: {_times('xor(h, b)', K.FNV_PRIME)}), len(u)::UBIGINT) AS x FROM units),
{_finish_sql('hashed', 'folded', 'g')},
steps AS (SELECT slot, ((slot::HUGEINT * {K.GAMMA} + {K.MINHASH_SEED}) % 18446744073709551616)::UBIGINT AS x FROM range(1, 129) r(slot)),
{_finish_sql('salts', 'steps', 'slot')},
salted AS (SELECT g, slot, xor(hashed.x, salts.x) AS x FROM hashed CROSS JOIN salts),
{_finish_sql('mixed', 'salted', 'g, slot')},
sig AS (SELECT side, pos, slot, min(x & 9223372036854775807::UBIGINT) AS v FROM held JOIN mixed USING (g) GROUP BY ALL),
agreed AS (SELECT a.pos AS sub_pos, b.pos AS ref_pos, count(*) AS k FROM sig a JOIN sig b ON a.side = 's' AND b.side = 'r' AND a.slot = b.slot AND a.v = b.v GROUP BY ALL)"""
_V = SETTINGS.weights()
_TOTAL = f"least(1.0, greatest(0.0, (exact * {_V[0]}::DOUBLE + shingle * {_V[1]}::DOUBLE + fuzzy * {_V[2]}::DOUBLE + {{}} * {_V[3]}::DOUBLE) / ({_V[0]}::DOUBLE + {_V[1]}::DOUBLE + {_V[2]}::DOUBLE + {_V[3]}::DOUBLE)))"
# The whole analysis: the candidates take the place of the overlapping pairs.
WHOLE = f"""{SIGNED.replace('WITH', 'WITH RECURSIVE', 1)}, {PAIRS.replace('pairs AS', 'shared AS')},
pairs AS (
  SELECT a.pos AS sub_pos, a.id AS sub_id, b.pos AS ref_pos, b.id AS ref_id, coalesce(jaccard, 0) AS jaccard FROM sides a JOIN sides b ON a.side = 's' AND b.side = 'r'
  LEFT JOIN agreed g ON g.sub_pos = a.pos AND g.ref_pos = b.pos LEFT JOIN shared o ON o.sub_pos = a.pos AND o.ref_pos = b.pos WHERE len(a.s) = 0 OR len(b.s) = 0 OR k >= 0.12::DOUBLE * 128),
{CHARS}, {EXACT}, {ALIGNED[ALIGNED.index('two AS') :]},
fuzzed AS (
  SELECT sub_id, ref_id, 0.50::DOUBLE * coalesce(similarity, 0) + 0.30::DOUBLE * coalesce(lcs / nullif(longest, 0), 1) + 0.20::DOUBLE * coalesce(1.0::DOUBLE - edits / nullif(longest, 0), 1) AS fuzzy FROM measured),
based AS (SELECT e.sub_pos, e.ref_pos, e.sub_id, e.ref_id, exact, shingle, fuzzy, {_TOTAL.format('0.0::DOUBLE')} AS base FROM exact e JOIN shingled USING (sub_pos, ref_pos) JOIN fuzzed f ON f.sub_id = e.sub_id AND f.ref_id = e.ref_id),
linked AS (SELECT sub_id, ref_id, base FROM based WHERE base >= 0.28::DOUBLE),
ends AS (SELECT v, count(*) AS k FROM (SELECT sub_id AS v FROM linked UNION ALL SELECT ref_id FROM linked) GROUP BY v),
sizes AS (SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark) AS n, (SELECT count(*) FROM benchmark) AS n_refs),
signalled AS (
  SELECT l.sub_id, l.ref_id, least(1.0::DOUBLE, 0.75::DOUBLE * base + 0.25::DOUBLE * ((x.k + y.k) / (2.0::DOUBLE * greatest(1, n - 1)))) AS graph
  FROM linked l JOIN ends x ON x.v = l.sub_id JOIN ends y ON y.v = l.ref_id CROSS JOIN sizes),
graded AS (SELECT b.*, coalesce(graph, 0) AS graph FROM based b LEFT JOIN signalled USING (sub_id, ref_id)),
final AS (SELECT *, {_TOTAL.format('graph')} AS total FROM graded)"""
# Evidence by the definition: phrases and shingles are sought in the whole normal
# forms, and places of the normal form are led back through the tokens.
_RUNS = "SELECT '{0}' AS side, pos, unnest(range(len(v)))::BIGINT AS i, unnest(v) AS raw, unnest(list_transform(g[1:len(v)], lambda x: len(x))) AS gap FROM (SELECT pos, regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}]+') AS v, regexp_split_to_array(content, '[\\p{{L}}\\p{{Nd}}]+') AS g FROM {1})"
EVIDENCE = f"""{WHOLE},
runs AS ({_RUNS.format('s', 'subs')} UNION ALL {_RUNS.format('r', 'refs')}),
toks AS (SELECT side, pos, i, lower(raw) AS token, len(raw) AS n, sum(gap + len(raw)) OVER w - len(raw) AS c, sum(len(raw) + 1) OVER w - len(raw) - 1 AS x FROM runs WINDOW w AS (PARTITION BY side, pos ORDER BY i)),
wtoks AS (SELECT side, pos, token, c, c + n AS c_end, row_number() OVER (PARTITION BY side, pos ORDER BY i) - 1 AS w FROM toks WHERE NOT list_contains({_STOP}, token)),
case_of AS (SELECT 'PD-' || (f.sub_pos * n_refs + f.ref_pos + 1) || '-' || f.sub_id || '-' || f.ref_id AS case_id, f.sub_pos, f.ref_pos, f.shingle FROM final f CROSS JOIN sizes),
phrased AS (
  SELECT m.sub_pos, m.ref_pos, m.phrase, m.at_index, len(m.phrase) AS n, strpos(sub_norm, m.phrase) - 1 AS x, strpos(ref_norm, m.phrase) - 1 AS y, k.rank
  FROM matches m JOIN (SELECT *, row_number() OVER (PARTITION BY sub_pos ORDER BY at_index) AS rank FROM eligible) k ON k.sub_pos = m.sub_pos AND k.phrase = m.phrase),
led AS (
  SELECT p.*, a.c + p.x - a.x AS sub_start, b.c + p.x + p.n - b.x AS sub_end, c.c + p.y - c.x AS ref_start, d.c + p.y + p.n - d.x AS ref_end,
         row_number() OVER (PARTITION BY p.sub_pos, p.ref_pos ORDER BY p.rank > 512, p.y + p.n, p.n DESC, at_index) AS r
  FROM phrased p JOIN toks a ON a.side = 's' AND a.pos = p.sub_pos AND p.x BETWEEN a.x AND a.x + a.n - 1 JOIN toks b ON b.side = 's' AND b.pos = p.sub_pos AND p.x + p.n - 1 BETWEEN b.x AND b.x + b.n - 1
  JOIN toks c ON c.side = 'r' AND c.pos = p.ref_pos AND p.y BETWEEN c.x AND c.x + c.n - 1 JOIN toks d ON d.side = 'r' AND d.pos = p.ref_pos AND p.y + p.n - 1 BETWEEN d.x AND d.x + d.n - 1),
grams AS (SELECT side, pos, w, array_to_string(list(token) OVER g, ' ') AS g, c, last(c_end) OVER g AS c_end, count(*) OVER g AS n FROM wtoks WINDOW g AS (PARTITION BY side, pos ORDER BY w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
items AS (
  SELECT sub_pos, ref_pos, 0 AS o, at_index AS k, 'EXACT' AS type, sub_start, sub_end, ref_start, ref_end, 1.0::DOUBLE AS similarity,
         CASE at_index % 3 WHEN 0 THEN 'Knuth-Morris-Pratt' WHEN 1 THEN 'Rabin-Karp (hash verified)' ELSE 'Z-algorithm' END AS algorithm, phrase AS excerpt FROM led
  UNION ALL SELECT sub_pos, ref_pos, 1, at_index, 'MULTI_PATTERN', sub_start, sub_end, ref_start, ref_end, 1.0, 'Aho-Corasick', phrase FROM led WHERE r = 1 AND rank <= 512
  UNION ALL SELECT q.sub_pos, q.ref_pos, 2, s.w, 'SHINGLE', s.c, s.c_end, t.c, t.c_end, greatest(q.shingle, 0.01::DOUBLE), 'word-shingle Jaccard', s.g
    FROM case_of q JOIN grams s ON s.side = 's' AND s.pos = q.sub_pos AND s.n = 4 JOIN (SELECT pos, g, arg_min(c, w) AS c, arg_min(c_end, w) AS c_end FROM grams WHERE side = 'r' AND n = 4 GROUP BY ALL) t ON t.pos = q.ref_pos AND t.g = s.g
  UNION ALL SELECT m.sub_pos, m.ref_pos, 3, 0, 'FUZZY', a.c, b.c_end, c.c, d.c_end, similarity, 'Smith-Waterman',
    (SELECT string_agg(token, ' ' ORDER BY w) FROM wtoks z WHERE z.side = 's' AND z.pos = m.sub_pos AND z.w BETWEEN m.i0 AND m.i_end - 1)
    FROM measured m JOIN wtoks a ON a.side = 's' AND a.pos = m.sub_pos AND a.w = m.i0 JOIN wtoks b ON b.side = 's' AND b.pos = m.sub_pos AND b.w = i_end - 1
    JOIN wtoks c ON c.side = 'r' AND c.pos = m.ref_pos AND c.w = m.j0 JOIN wtoks d ON d.side = 'r' AND d.pos = m.ref_pos AND d.w = j_end - 1 WHERE alignment > 0),
numbered AS (SELECT case_id, (row_number() OVER (PARTITION BY case_id ORDER BY o, k) - 1)::INT AS idx, i.* FROM items i JOIN case_of USING (sub_pos, ref_pos)),
worth AS (SELECT *, greatest(0.01::DOUBLE, similarity) AS rel, greatest(1.0::DOUBLE, (sub_end - sub_start) / 50.0::DOUBLE) AS price, count(*) OVER (PARTITION BY case_id) AS n FROM numbered),
valued AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY case_id, type ORDER BY 65 * rel / price DESC, rel DESC, idx) = 1 THEN 65 ELSE 1 END AS u FROM worth),
chosen AS (SELECT *, CASE WHEN n > 8 THEN row_number() OVER (PARTITION BY case_id ORDER BY u * rel / price DESC, u DESC, rel DESC, idx) ELSE idx + 1 END AS place FROM valued)"""
COVER = """WITH RECURSIVE
sets AS (SELECT s_suppkey % 7 AS k, list_distinct(list(s_nationkey::BIGINT)) AS s FROM supplier GROUP BY 1),
step(n, chosen, uncovered) AS (
  SELECT 0, ''::VARCHAR, (SELECT list(n_nationkey::BIGINT ORDER BY n_nationkey) FROM nation)
  UNION ALL
  SELECT n + 1, CASE n WHEN 0 THEN '' ELSE chosen || ',' END || k, list_filter(uncovered, lambda x: NOT list_contains(s, x)) FROM (
    SELECT *, row_number() OVER (ORDER BY len(list_intersect(s, uncovered)) DESC, k) AS r FROM step CROSS JOIN sets WHERE len(list_intersect(s, uncovered)) > 0) WHERE r = 1)"""
DIGRAPH = """WITH RECURSIVE
e(src, dst, cost) AS (SELECT n_nationkey, (n_nationkey * 3 + 1) % 25, 1.0::DOUBLE + n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 5, 2.0::DOUBLE + n_regionkey FROM nation WHERE n_nationkey < 12),
digraph AS (SELECT src, dst, cost FROM e WHERE src <> dst)"""

# A directed graph of documents within their source: neighbours by id, from the
# shorter to the longer text, and every fifth document back to the one four
# places before it.  Costs follow lengths, so that they cancel along a cycle, and
# add something that is below 0 in some sources.
LINKS = """WITH RECURSIVE
placed AS (SELECT doc_id, source, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL),
linked AS (
  SELECT CASE WHEN a.n <= b.n THEN a.doc_id ELSE b.doc_id END AS src, CASE WHEN a.n <= b.n THEN b.doc_id ELSE a.doc_id END AS dst, abs(b.n - a.n) AS rise, a.source FROM placed a JOIN placed b ON a.source = b.source AND b.k = a.k + 1
  UNION ALL SELECT b.doc_id, a.doc_id, a.n - b.n, a.source FROM placed a JOIN placed b ON a.source = b.source AND b.k = a.k + 4 WHERE b.doc_id % 5 = 0),
links AS (SELECT src, dst, min((rise + CASE WHEN source IN ('src3', 'src7') THEN -40 ELSE 10 END) / 100.0::DOUBLE) AS cost FROM linked GROUP BY src, dst)"""
LINKS_REACH = "reach(a, b) AS (SELECT src, dst FROM links UNION SELECT r.a, l.dst FROM reach r JOIN links l ON r.b = l.src)"


# ------------------------------------------------------------------ frames
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prepared(spark: SparkSession, d: str, name: str, key: str, prefix: str, wanted: DataFrame | None) -> DataFrame:
    docs = table(spark, d, name).select(key, "text")
    if wanted is not None:
        docs = docs.join(wanted.select(F.col("pos").alias("__pos")).distinct(), F.col(key).cast("long").eqNullSafe(F.col("__pos")), "left_semi")
    out = corpus.prepare(corpus.spread(docs), key, "text", prefix)
    if wanted is None:
        out.narrowed = lambda pos: _prepared(spark, d, name, key, prefix, pos)
    return out


def submissions(spark: SparkSession, d: str, wanted: DataFrame | None = None) -> DataFrame:
    """Prepared documents; of ``wanted`` (pos) alone, if given."""
    return _prepared(spark, d, "documents", "doc_id", "D", wanted)


def references(spark: SparkSession, d: str, wanted: DataFrame | None = None) -> DataFrame:
    return _prepared(spark, d, "benchmark", "item_id", "B", wanted)


def overlapping(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submissions and references of a pair, stored, and the pairs that share a
    word shingle.  What is scored is taken apart for the texts of a pair only."""
    all_subs, all_refs = submissions(spark, d), references(spark, d)
    # Taken apart once, for the pairs and for their scores.
    subs = materialise(candidates.of_positions(all_subs, candidates.sharing(all_subs, all_refs, SETTINGS.word_shingle_size).filter("not short")), "paired")
    pairs = materialise(candidates.pairs_of_sharing(subs, all_refs, SETTINGS.word_shingle_size), "pairs")
    refs = materialise(candidates.of_positions(all_refs, pairs.select(F.col("ref_pos").alias("pos"))), "paired")
    return subs, refs, pairs


def document_links(spark: SparkSession, d: str) -> DataFrame:
    """``(src, dst, cost)``, as ``LINKS``."""
    docs = table(spark, d, "documents").filter("doc_id is not null and source is not null").select("source", F.col("doc_id").alias("a"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    row = Window.partitionBy("source").orderBy("a")
    ahead = docs.select("*", F.lead("a").over(row).alias("b"), F.lead("n").over(row).alias("m"), F.lead("a", 4).over(row).alias("c"), F.lead("n", 4).over(row).alias("o"))
    up = F.col("n") <= F.col("m")
    near = ahead.filter("b is not null").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("dst"), F.abs(F.col("m") - F.col("n")).alias("rise"), "source")
    far = ahead.filter("c % 5 = 0").select(F.col("c").alias("src"), F.col("a").alias("dst"), (F.col("n") - F.col("o")).alias("rise"), "source")
    cost = (F.col("rise") + F.when(F.col("source").isin("src3", "src7"), -40).otherwise(10)) / 100.0
    return materialise(near.unionByName(far).groupBy("src", "dst").agg(F.min(cost).alias("cost")), "links")


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Scored cases without the fuzzy and graph families."""
    subs, refs, pairs = overlapping(spark, d)
    exact = scoring.exact_scores(pairs.select(*scoring.PAIR), subs, refs, OFF_GRAPH).select("sub_pos", "ref_pos", "exact")
    both = scoring.shingle_scores(pairs, subs, refs, OFF_GRAPH).join(exact, ["sub_pos", "ref_pos"])
    total = scoring.total_score(F.col("exact"), F.col("shingle"), F.lit(0.0), F.lit(0.0), OFF_GRAPH.weights())
    scored = both.withColumn("total", total).select(*scoring.PAIR, "exact", "shingle", "total")
    return materialise(scoring.cases(scored, table(spark, d, "benchmark").count()), "cases")


def reviewers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REVIEWERS, "pos int, id string, name string, capacity int")


def near_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges between the representatives of different shingle sets, and
    ``(pos, representative)`` of every document that has shingles."""
    classes = candidates.shingle_classes(submissions(spark, d))
    pairs = candidates.similar_pairs(classes, SETTINGS.graph_edge_threshold)
    return materialise(network.edges_of(pairs, "a", "b", "jaccard", SETTINGS.graph_edge_threshold), "near-edges"), classes.select("pos", "representative")


def near_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between documents: representatives, and a star of copies each."""
    edges, members = near_graph(spark, d)
    return edges.unionByName(materialise(network.stars(members), "document-copies"))


def vertices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("v"))


def digraph(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("double").alias("r"))
    a = n.select("src", ((F.col("src") * 3 + 1) % 25).alias("dst"), (F.col("r") + 1.0).alias("cost"))
    b = n.filter("src < 12").select("src", (F.col("src") + 5).alias("dst"), (F.col("r") + 2.0).alias("cost"))
    return a.unionByName(b).filter("src <> dst")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------ text
@query(f"WITH {SUBS} SELECT pos AS doc_id, norm FROM subs")
def normalize_text(spark, d):
    return submissions(spark, d).select(F.col("pos").alias("doc_id"), "norm")


@query(f"WITH {SUBS} SELECT pos AS doc_id, len(tokens) AS n_tokens, len(words) AS n_words, array_to_string(words[1:5], ' ') AS opening FROM subs")
def token_counts(spark, d):
    return submissions(spark, d).select(F.col("pos").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"), F.size("words").cast("long").alias("n_words"), F.array_join(F.slice("words", 1, 5), " ").alias("opening"))


@query(f"WITH {SUBS}, s AS (SELECT pos, {_shingles_sql('words', 4)} AS g FROM subs) SELECT pos AS doc_id, len(g) AS n, len(list_distinct(g)) AS n_distinct, list_min(g) AS least, list_max(g) AS greatest FROM s")
def word_shingles(spark, d):
    s = submissions(spark, d).select("pos", X.word_shingles(F.col("words"), 4).alias("g"))
    return s.select(F.col("pos").alias("doc_id"), F.size("g").cast("long").alias("n"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct"), F.array_min("g").alias("least"), F.array_max("g").alias("greatest"))


@query(f"WITH {SUBS}, s AS (SELECT pos, CASE WHEN len(norm) >= 9 THEN list_transform(range(1, len(norm) - 7), lambda i: substr(norm, i, 9)) ELSE [] END AS g FROM subs) SELECT pos AS doc_id, len(g) AS n, len(list_distinct(g)) AS n_distinct FROM s")
def char_shingles(spark, d):
    s = submissions(spark, d).select("pos", X.char_shingles(F.col("norm"), 9).alias("g"))
    return s.select(F.col("pos").alias("doc_id"), F.size("g").cast("long").alias("n"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct"))


@query(
    "WITH t AS (SELECT doc_id, text, strpos(text, 'the') - 1 AS o FROM documents WHERE contains(text, 'the')), b AS (SELECT doc_id, o, substr(text, 1, o) AS before FROM t) "
    "SELECT doc_id, o AS offs, len(regexp_extract_all(before, '\\r\\n|\\r|\\n')) + 1 AS line, len(regexp_replace(before, '(?s)^.*[\\r\\n]', '')) + 1 AS col FROM b"
)
def locate(spark, d):
    t = table(spark, d, "documents").filter(F.col("text").contains("the")).withColumn("offs", F.instr("text", "the") - 1)
    return t.select("doc_id", F.col("offs").cast("long").alias("offs"), X.line_of(F.col("text"), F.col("offs")).cast("long").alias("line"), X.column_of(F.col("text"), F.col("offs")).cast("long").alias("col"))


@query("SELECT p_partkey, list_filter(range(0, len(p_name) - 1), lambda i: substr(p_name, i + 1, 2) = 'an') AS x, NULL AS y FROM part".replace("list_filter", "array_to_string(list_filter").replace("'an')", "'an'), ',')").replace("AS x, NULL AS y", "AS places"))
def pattern_positions(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(X.positions(F.col("p_name"), F.lit("an")), lambda i: i.cast("string")), ",").alias("places"))


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def prefix_search(spark, d):
    return table(spark, d, "customer").filter(F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_name").orderBy("c_name")


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance, 1 - levenshtein(p_name, p_type) / greatest(len(p_name), len(p_type))::DOUBLE AS similarity FROM part")
def edit_distance_char(spark, d):
    x = F.levenshtein("p_name", "p_type")
    return table(spark, d, "part").select("p_partkey", x.cast("long").alias("distance"), (1 - x / F.greatest(F.length("p_name"), F.length("p_type"))).alias("similarity"))


@query("SELECT doc_id, '[' || (doc_id + 1) || ']' AS tag, regexp_replace(source || '/' || lang || ' x', '[^A-Za-z0-9._-]', '_', 'g') AS name, CASE WHEN len(f) > 260 THEN substr(f, 1, 260) || '...' ELSE f END AS line, printf('%.2f%%', n_chars / 7.0::DOUBLE) AS share FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def formatting(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.format_string("[%d]", F.col("doc_id") + 1).alias("tag"), X.safe_name(F.concat("source", F.lit("/"), "lang", F.lit(" x"))).alias("name"), X.single_line(F.col("text")).alias("line"), F.format_string("%.2f%%", F.col("n_chars") / 7.0).alias("share"))


# ------------------------------------------------------------------ pairs
@query(f"WITH {SUBS}, {REFS}, {PAIRS} SELECT sub_id, ref_id, n_both AS overlap, jaccard FROM pairs")
def jaccard_word(spark, d):
    return candidates.jaccard_pairs(submissions(spark, d), references(spark, d)).select("sub_id", "ref_id", F.col("both").alias("overlap"), "jaccard")


@query(f"WITH {SUBS}, {REFS}, {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY jaccard DESC, ref_pos) AS k FROM pairs) SELECT sub_id, ref_id, jaccard FROM r WHERE k = 1")
def best_reference(spark, d):
    w = Window.partitionBy("sub_id").orderBy(F.col("jaccard").desc(), "ref_pos")
    pairs = candidates.jaccard_pairs(submissions(spark, d), references(spark, d))
    return pairs.withColumn("k", F.row_number().over(w)).filter("k = 1").select("sub_id", "ref_id", "jaccard")


@query(f"WITH {SUBS}, {REFS}, {PAIRS}, {CHARS} SELECT sub_id, ref_id, char_jaccard, shingle FROM shingled")
def shingle_score(spark, d):
    subs, refs, pairs = overlapping(spark, d)
    return scoring.shingle_scores(pairs, subs, refs, SETTINGS).select("sub_id", "ref_id", "char_jaccard", "shingle")


@query(f"WITH {SUBS}, {REFS}, {PAIRS}, {EXACT} SELECT pos AS doc_id, count(*) AS n_phrases, count(DISTINCT phrase) FILTER (len(phrase) >= 28) AS n_eligible, min(phrase) FILTER (len(phrase) >= 28) AS least FROM px GROUP BY pos")
def exact_phrases(spark, d):
    p = submissions(spark, d).select(F.col("pos").alias("doc_id"), F.explode_outer(scoring.phrases(F.col("tokens"), SETTINGS)).alias("phrase")).filter("phrase is not null")
    kept = F.when(F.length("phrase") >= SETTINGS.min_exact_phrase_characters, F.col("phrase"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n_phrases"), F.count_distinct(kept).alias("n_eligible"), F.min(kept).alias("least"))


@query(f"WITH {SUBS}, {REFS}, {PAIRS}, {EXACT} SELECT sub_id, ref_id, matched, eligible, exact FROM exact")
def exact_score(spark, d):
    subs, refs, pairs = overlapping(spark, d)
    return scoring.exact_scores(pairs.select(*scoring.PAIR), subs, refs, SETTINGS).select("sub_id", "ref_id", "matched", F.col("eligible").cast("long").alias("eligible"), "exact")


@query(
    f"WITH {SUBS}, {REFS}, {PAIRS}, {EXACT} SELECT 'D' || sub_pos AS sub_id, 'B' || ref_pos AS ref_id, at_index AS idx, phrase, strpos(sub_norm, phrase) - 1 AS sub_at, strpos(ref_norm, phrase) - 1 AS ref_at, "
    "CASE at_index % 3 WHEN 0 THEN 'Knuth-Morris-Pratt' WHEN 1 THEN 'Rabin-Karp (hash verified)' ELSE 'Z-algorithm' END AS algorithm FROM matches"
)
def exact_evidence(spark, d):
    subs, refs, pairs = overlapping(spark, d)
    m = scoring._sides(scoring.exact_matches(pairs.select(*scoring.PAIR), subs, refs, SETTINGS), subs, refs, "id", "norm")
    label = F.element_at(F.array(*[F.lit(x) for x in evidence.LABELS]), (F.col("at") % 3 + 1).cast("int"))
    return m.select("sub_id", "ref_id", F.col("at").cast("long").alias("idx"), "phrase", (F.expr("instr(sub_norm, phrase)") - 1).cast("long").alias("sub_at"), (F.expr("instr(ref_norm, phrase)") - 1).cast("long").alias("ref_at"), label.alias("algorithm"))


@query(
    f"WITH {SUBS}, {REFS}, {PAIRS}, {EXACT}, k AS (SELECT *, row_number() OVER (PARTITION BY sub_pos ORDER BY at_index) AS rank FROM eligible), "
    "m AS (SELECT m.*, strpos(ref_norm, m.phrase) - 1 AS ref_at FROM matches m JOIN k ON k.sub_pos = m.sub_pos AND k.phrase = m.phrase WHERE k.rank <= 512), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY sub_pos, ref_pos ORDER BY ref_at + len(phrase), len(phrase) DESC, at_index) AS r FROM m) "
    "SELECT 'D' || sub_pos AS sub_id, 'B' || ref_pos AS ref_id, phrase, ref_at FROM f WHERE r = 1"
)
def multi_pattern_first(spark, d):
    subs, refs, pairs = overlapping(spark, d)
    m = scoring.exact_matches(pairs.select(*scoring.PAIR), subs, refs, SETTINGS)
    listed = F.filter(F.array_distinct(scoring.phrases(F.col("tokens"), SETTINGS)), lambda p: F.length(p) >= SETTINGS.min_exact_phrase_characters)
    first = subs.select(F.col("pos").alias("sub_pos"), F.slice(listed, 1, evidence.MULTI_PATTERNS).alias("several"))
    m = scoring._sides(m.join(first, "sub_pos").filter(F.array_contains("several", F.col("phrase"))).drop("several"), subs, refs, "id", "norm").withColumn("ref_at", (F.expr("instr(ref_norm, phrase)") - 1).cast("long"))
    w = Window.partitionBy("sub_pos", "ref_pos").orderBy(F.col("ref_at") + F.length("phrase"), F.length("phrase").desc(), "at")
    return m.withColumn("r", F.row_number().over(w)).filter("r = 1").select("sub_id", "ref_id", "phrase", "ref_at")


@query(
    f"WITH {SUBS}, {REFS}, {PAIRS}, s AS (SELECT pos AS sub_pos, unnest({_shingles_sql('words', 4)}) AS g, generate_subscripts({_shingles_sql('words', 4)}, 1) - 1 AS sub_at FROM subs), "
    f"r0 AS (SELECT pos AS ref_pos, unnest({_shingles_sql('words', 4)}) AS g, generate_subscripts({_shingles_sql('words', 4)}, 1) - 1 AS ref_at FROM refs), r AS (SELECT ref_pos, g, min(ref_at) AS ref_at FROM r0 GROUP BY ALL) "
    "SELECT 'D' || sub_pos AS sub_id, 'B' || ref_pos AS ref_id, sub_at, ref_at, g AS shingle FROM s JOIN r USING (g)"
)
def shingle_evidence(spark, d):
    subs, refs = submissions(spark, d), references(spark, d)
    s = subs.select(F.col("id").alias("sub_id"), F.posexplode_outer(X.word_shingles(F.col("words"), 4)).alias("sub_at", "shingle"))
    r = corpus.first_positions(refs.withColumn("sh", X.word_shingles(F.col("words"), 4)), "sh").select(F.col("id").alias("ref_id"), "shingle", F.col("at").cast("long").alias("ref_at"))
    return s.join(r, "shingle").select("sub_id", "ref_id", F.col("sub_at").cast("long").alias("sub_at"), "ref_at", "shingle")


@query(f"{ALL_CASES} SELECT case_id, sub_id, ref_id, ordinal, exact, shingle, total, risk FROM cases")
def composite_no_fuzzy(spark, d):
    return cases(spark, d).select("case_id", "sub_id", "ref_id", "ordinal", "exact", "shingle", "total", "risk")


@query(f"WITH {SUBS}, {REFS}, {PAIRS}, n AS (SELECT (SELECT count(*) FROM documents) * (SELECT count(*) FROM benchmark) AS total) SELECT total AS total_pairs, (SELECT count(*) FROM pairs) AS candidates, CASE WHEN total = 0 THEN 0 ELSE (total - (SELECT count(*) FROM pairs)) / total END AS reduction FROM n")
def batch_stats(spark, d):
    total = table(spark, d, "documents").count() * table(spark, d, "benchmark").count()
    n = candidates.jaccard_pairs(submissions(spark, d), references(spark, d)).agg(F.count("*").alias("candidates"))
    return n.select(F.lit(total).cast("long").alias("total_pairs"), "candidates", ((F.lit(total) - F.col("candidates")) / float(max(1, total))).alias("reduction"))


# ------------------------------------------------------------------ rankings
@query(f"{ALL_CASES} SELECT row_number() OVER (ORDER BY total DESC, case_id DESC) AS place, case_id, total FROM cases")
def ranked_desc(spark, d):
    c = cases(spark, d)
    return ranking.placed(c.select("case_id", "total")).select("place", "case_id", "total").orderBy("place")


@query(f"{ALL_CASES} SELECT row_number() OVER (ORDER BY total, case_id) AS place, case_id, total FROM cases")
def ranked_asc(spark, d):
    c = cases(spark, d)
    return ranking.placed(c.select("case_id", "total"), descending=False).select("place", "case_id", "total").orderBy("place")


@query(f"{ALL_CASES} SELECT case_id, total FROM cases ORDER BY total DESC, case_id DESC LIMIT 5")
def top_risks(spark, d):
    return ranking.top(cases(spark, d), 5).select("case_id", "total")


@query(f"{ALL_CASES} SELECT case_id, total, row_number() OVER (ORDER BY total DESC, case_id) AS place FROM cases WHERE total >= 0.30")
def review_queue(spark, d):
    return ranking.review_queue(cases(spark, d), SETTINGS.review_threshold).select("case_id", "total", F.col("place").cast("long").alias("place"))


@query(f"{ALL_CASES} SELECT case_id, total FROM cases WHERE total BETWEEN 0.2 AND 0.6")
def score_range(spark, d):
    return ranking.by_score(cases(spark, d), 0.2, 0.6).select("case_id", "total")


@query(f"{ALL_CASES}, r AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY total DESC, case_id DESC) AS k FROM cases) SELECT sub_id, case_id, total FROM r WHERE k = 1")
def best_per_submission(spark, d):
    return ranking.best_per_submission(cases(spark, d)).select("sub_id", "case_id", "total")


@query(f"{ALL_CASES}, r AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY total DESC, case_id DESC) AS k FROM cases) SELECT sub_id, case_id, risk, total FROM r WHERE k = 1 AND upper(risk) = 'LOW' AND contains(lower(sub_id), 'd2')")
def ranked_filtered(spark, d):
    return ranking.filtered(cases(spark, d), "D2", "low").select("sub_id", "case_id", "risk", "total")


@query(f"{ALL_CASES} SELECT risk, count(*) AS n, min(total) AS least, max(total) AS greatest FROM cases GROUP BY risk")
def risk_histogram(spark, d):
    return cases(spark, d).groupBy("risk").agg(F.count("*").alias("n"), F.min("total").alias("least"), F.max("total").alias("greatest"))


@query(f"{ALL_CASES} {SEQ} SELECT pos, case_id, score, flag, sum(flag) OVER (ORDER BY pos)::BIGINT AS flagged FROM flags")
def prefix_flagged(spark, d):
    s = ranking.prefix_flagged(ranking.sequence(cases(spark, d), SETTINGS.review_threshold))
    return s.select(F.col("at").cast("long").alias("pos"), "case_id", "score", "flag", "flagged")


@query(f"{ALL_CASES} {SEQ} SELECT count(*) AS n, min(score) AS least, max(score) AS greatest, sum(score)::BIGINT AS total, avg(score) AS mean, sum(flag)::BIGINT AS flagged FROM flags WHERE pos BETWEEN 3 AND 12")
def range_summary(spark, d):
    return ranking.summarize(ranking.sequence(cases(spark, d), SETTINGS.review_threshold), 3, 12)


@query(f"{ALL_CASES} {SEQ} SELECT pos, case_id, CASE WHEN pos BETWEEN 2 AND 6 THEN score + 10000 ELSE score END AS score, ((CASE WHEN pos BETWEEN 2 AND 6 THEN score + 10000 ELSE score END) >= 300000)::INT AS flag FROM flags")
def range_add(spark, d):
    s = ranking.sequence(cases(spark, d), SETTINGS.review_threshold)
    # As in SQL, a sum may pass 1: copies of a reference stand at 1 already.
    return ranking.add_to_range(s, 2, 6, 0.01, SETTINGS.review_threshold, bounded=False).select(F.col("at").cast("long").alias("pos"), "case_id", "score", "flag")


@query(f"{ALL_CASES} {SEQ} SELECT pos, case_id, CASE WHEN pos = 4 THEN 123457 ELSE score END::BIGINT AS score, ((CASE WHEN pos = 4 THEN 123457 ELSE score END) >= 300000)::INT AS flag FROM flags")
def range_update(spark, d):
    s = ranking.sequence(cases(spark, d), SETTINGS.review_threshold)
    return ranking.update_score(s, 4, 0.1234567, SETTINGS.review_threshold).select(F.col("at").cast("long").alias("pos"), "case_id", "score", "flag")


# ------------------------------------------------------------------ review
@query(f"{ALL_CASES} {REVIEW} SELECT case_id, place, reviewer_id, reviewer_name FROM assigned")
def assign_reviewers(spark, d):
    return ranking.assign(cases(spark, d), reviewers(spark), SETTINGS.review_threshold).select("case_id", F.col("place").cast("long").alias("place"), "reviewer_id", "reviewer_name")


@query(f"{ALL_CASES} {REVIEW} SELECT case_id, total FROM cases WHERE total >= 0.30 AND case_id NOT IN (SELECT case_id FROM assigned)")
def unassigned(spark, d):
    c = cases(spark, d)
    return ranking.unassigned(c, ranking.assign(c, reviewers(spark), SETTINGS.review_threshold), SETTINGS.review_threshold).select("case_id", "total")


@query(f"{ALL_CASES} {REVIEW}, u AS (SELECT r.id AS reviewer_id, capacity, count(a.case_id) AS used FROM reviewers r LEFT JOIN assigned a ON a.reviewer_id = r.id GROUP BY ALL) SELECT reviewer_id, capacity, used, greatest(0, capacity - used) AS remaining, CASE WHEN capacity > 0 THEN used / capacity ELSE 0 END AS ratio FROM u")
def utilization(spark, d):
    return ranking.utilisation(ranking.assign(cases(spark, d), reviewers(spark), SETTINGS.review_threshold), reviewers(spark))


@query(f"{ALL_CASES} {REVIEW} SELECT (SELECT count(*) FROM documents) AS submissions, (SELECT count(*) FROM benchmark) AS refs, count(*) AS results, count(*) FILTER (risk IN ('HIGH', 'CRITICAL')) AS high, count(*) FILTER (total >= 0.30) - (SELECT count(*) FROM assigned) AS pending FROM cases")
def dashboard(spark, d):
    c = cases(spark, d)
    done = ranking.assign(c, reviewers(spark), SETTINGS.review_threshold).count()
    a = c.agg(F.count("*").alias("results"), F.count_if(F.col("risk").isin("HIGH", "CRITICAL")).alias("high"), (F.count_if(F.col("total") >= SETTINGS.review_threshold) - done).alias("pending"))
    return a.select(F.lit(table(spark, d, "documents").count()).cast("long").alias("submissions"), F.lit(table(spark, d, "benchmark").count()).cast("long").alias("refs"), "*")


@query(
    f"{ALL_CASES} {REVIEW} SELECT c.case_id, c.case_id || ' | ' || c.sub_id || ' <-> ' || c.ref_id || ' | ' || printf('%.2f%%', c.total * 100.0::DOUBLE) || ' | ' || c.risk || ' | ' || "
    "coalesce(reviewer_id, CASE WHEN c.total >= 0.30 THEN 'AWAITING_ASSIGNMENT' ELSE 'BELOW_THRESHOLD' END) AS line FROM cases c LEFT JOIN assigned a USING (case_id)"
)
def report_summary(spark, d):
    c = cases(spark, d)
    return summary_lines(c, ranking.assign(c, reviewers(spark), SETTINGS.review_threshold), SETTINGS.review_threshold)


@query(f"{ALL_CASES} {REVIEW} SELECT c.case_id AS \"caseId\", c.total AS score, reviewer_id AS \"reviewerId\", coalesce(reviewer_id, CASE WHEN c.total >= 0.30 THEN 'AWAITING_ASSIGNMENT' ELSE 'BELOW_THRESHOLD' END) AS status FROM cases c LEFT JOIN assigned a USING (case_id)")
def assignment_status(spark, d):
    c = cases(spark, d)
    a = ranking.assign(c, reviewers(spark), SETTINGS.review_threshold).select("case_id", "reviewer_id")
    return c.join(a, "case_id", "left").select(F.col("case_id").alias("caseId"), F.col("total").alias("score"), F.col("reviewer_id").alias("reviewerId"), status(F.col("total"), F.col("reviewer_id"), SETTINGS.review_threshold).alias("status"))


@query(f"{ALL_CASES} SELECT sub_id, case_id, total FROM cases WHERE sub_id = (SELECT min(sub_id) FROM cases)")
def cases_of_submission(spark, d):
    c = cases(spark, d)
    return ranking.cases_of(c, c.agg(F.min("sub_id")).first()[0] or "").select("sub_id", "case_id", "total")


@query(f"{ALL_CASES} SELECT case_id, total FROM cases WHERE case_id = (SELECT max(case_id) FROM cases)")
def case_lookup(spark, d):
    c = cases(spark, d)
    return ranking.case_by_id(c, c.agg(F.max("case_id")).first()[0] or "").select("case_id", "total")


@query("SELECT 'D' || doc_id AS id, length(text) AS n FROM documents WHERE doc_id = 17")
def document_lookup(spark, d):
    return corpus.document_by_id(submissions(spark, d), "D17").select("id", F.length("content").cast("long").alias("n"))


@query("SELECT 'D' || doc_id AS id FROM documents ORDER BY lower('D' || doc_id), 1")
def document_list(spark, d):
    return corpus.document_list(submissions(spark, d)).select("id")


@query(f"{ALL_CASES} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT doc_id) FROM documents) AS ids, (SELECT count(*) FROM cases) AS cases, (SELECT count(DISTINCT case_id) FROM cases) AS case_ids, 0::BIGINT AS orphans")
def catalogue_invariants(spark, d):
    return corpus.invariants(submissions(spark, d), cases(spark, d))


# ------------------------------------------------------------------ graph
@query(f"{NEAR} SELECT src, dst, similarity, cost FROM shown")
def graph_edges(spark, d):
    return near_edges(spark, d)


@query(f"{NEAR} SELECT pos AS v, head AS representative FROM heads0")
def graph_members(spark, d):
    # The classes alone: who is a copy of whom does not hang on the edges.
    return candidates.shingle_classes(submissions(spark, d)).select(F.col("pos").alias("v"), "representative")


@query(f"{NEAR} SELECT doc_id AS v, coalesce(k, 0) AS degree FROM documents LEFT JOIN dg ON dg.v = doc_id")
def graph_degree(spark, d):
    return network.degrees(*near_graph(spark, d), vertices(spark, d))


@query(
    f"{NEAR}, nv AS (SELECT count(*) AS n FROM documents) SELECT src, dst, similarity, "
    "least(1.0::DOUBLE, 0.75::DOUBLE * similarity + 0.25::DOUBLE * ((x.k + y.k) / (2.0::DOUBLE * greatest(1, n - 1)))) AS signal FROM shown JOIN dg x ON x.v = src JOIN dg y ON y.v = dst CROSS JOIN nv"
)
def graph_signal(spark, d):
    edges, members = near_graph(spark, d)
    degree = network.degrees(edges, members, vertices(spark, d))
    return network.signals(network.with_members(edges, members), degree, table(spark, d, "documents").count()).select("src", "dst", "similarity", "signal")


@query(f"{NEAR} {REACH} SELECT group_id, v FROM grouped")
def groups(spark, d):
    return network.groups(near_edges(spark, d))


@query(f"{NEAR}, walk(v, level) USING KEY (v) AS (SELECT min(src), 0 FROM near UNION SELECT w.dst, min(level) + 1 FROM walk JOIN ways w ON w.src = walk.v WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.v = w.dst) GROUP BY w.dst) SELECT v, level FROM walk WHERE v IS NOT NULL")
def bfs_levels(spark, d):
    edges, members = near_graph(spark, d)
    source = network.with_members(edges, members).agg(F.min("src")).first()[0]
    if source is None:
        return spark.createDataFrame([], "v long, level int")
    return network.for_members(network.levels(edges, source), members, source, "level", 1)


@query(f"{NEAR} {REACH}, worst AS (SELECT src AS v, max(1.0::DOUBLE - CASE WHEN cost <= 1e-6::DOUBLE THEN 0 ELSE cost END) AS worst FROM ways GROUP BY src) SELECT doc_id AS v, coalesce(group_id, '') AS group_id, round(coalesce(worst, 0), 9) AS worst FROM documents LEFT JOIN grouped g ON g.v = doc_id LEFT JOIN worst w ON w.v = doc_id")
def graph_snapshot(spark, d):
    between, heads = near_graph(spark, d)
    edges = materialise(network.with_members(between, heads), "document-edges")
    # A copy's cases are its representative's, and those with its copies.
    of_heads = network.snapshot_nodes(heads.select(F.col("representative").alias("v")).distinct(), edges, edges.limit(0).select(F.col("src").alias("v"), F.lit("").alias("group_id")))
    worst = heads.join(of_heads.select(F.col("v").alias("representative"), "worst"), "representative").select(F.col("pos").alias("v"), "worst")
    return vertices(spark, d).join(worst, "v", "left").join(network.groups(edges), "v", "left").select("v", F.coalesce("group_id", F.lit("")).alias("group_id"), F.round(F.coalesce("worst", F.lit(0.0)), 9).alias("worst"))


@query(f"{NEAR}, best(v, distance) USING KEY (v) AS (SELECT min(src), 0.0::DOUBLE FROM near UNION SELECT w.dst, min(best.distance + cost) FROM best JOIN ways w ON w.src = best.v LEFT JOIN recurring.best r ON r.v = w.dst WHERE r.v IS NULL OR best.distance + cost < r.distance - 1e-12 GROUP BY w.dst) SELECT v, round(distance, 6) AS distance FROM best WHERE v IS NOT NULL")
def shortest_path(spark, d):
    edges, members = near_graph(spark, d)
    source = network.with_members(edges, members).agg(F.min("src")).first()[0]
    if source is None:
        return spark.createDataFrame([], "v long, distance double")
    found = network.distances(edges, source)
    return network.for_members(found, members, source, "distance", network.LEAST_COST).withColumn("distance", F.round("distance", 6))


@query(
    f"{NEAR}, turns AS (SELECT src, dst, cost FROM shown UNION ALL SELECT dst, src, cost FROM shown), best(v, distance) USING KEY (v) AS (SELECT min(src), 0.0::DOUBLE FROM shown UNION SELECT w.dst, min(best.distance + cost) FROM best JOIN turns w ON w.src = best.v LEFT JOIN recurring.best r ON r.v = w.dst WHERE r.v IS NULL OR best.distance + cost < r.distance - 1e-12 GROUP BY w.dst), "
    "back AS (SELECT dst AS v, arg_min(src, (round(a.distance + cost, 9), src)) AS p FROM turns JOIN best a ON a.v = src JOIN best b ON b.v = dst WHERE a.distance < b.distance GROUP BY dst), "
    "path(v, p) AS (SELECT v, p FROM back WHERE v = (SELECT v FROM best ORDER BY round(distance, 6) DESC, v LIMIT 1) UNION ALL SELECT b.v, b.p FROM path JOIN back b ON b.v = path.p) "
    "SELECT src, dst, similarity, cost, EXISTS (SELECT 1 FROM path WHERE least(path.v, path.p) = src AND greatest(path.v, path.p) = dst) AS selected FROM shown"
)
def path_edges(spark, d):
    """The path from the first vertex to the one farthest from it."""
    edges = near_edges(spark, d)
    source = edges.agg(F.min("src")).first()[0]
    if source is None:
        return network.on_path(edges, edges)
    far = materialise(network.distances(edges, source), "path-distances")
    target = far.orderBy(F.round("distance", 6).desc(), "v").first()["v"]
    return network.on_path(edges, network.path_between(edges, source, target, far))


@query(f"{NEAR} {FOREST} SELECT src, dst, cost FROM cand WHERE NOT EXISTS (SELECT 1 FROM lesser l WHERE l.o = cand.o AND l.v = cand.dst)")
def mst(spark, d):
    return network.minimum_forest(near_edges(spark, d))


@query(f"{LINKS}, {LINKS_REACH}, back AS (SELECT x.a AS v, min(x.b) AS m FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT v, least(v, coalesce(m, v)) AS component FROM (SELECT src AS v FROM links UNION SELECT dst FROM links) LEFT JOIN back USING (v)")
def scc(spark, d):
    return network.strong_components(document_links(spark, d))


@query(
    f"{LINKS}, {LINKS_REACH}, blocked AS (SELECT DISTINCT y.b AS v FROM reach x JOIN reach y ON x.a = x.b AND y.a = x.a), free AS (SELECT src, dst FROM links WHERE dst NOT IN (SELECT v FROM blocked)), "
    "ends AS (SELECT src AS v FROM links UNION SELECT dst FROM links), lv(v, level) AS (SELECT v, 0 FROM ends WHERE v NOT IN (SELECT dst FROM links) UNION SELECT f.dst, level + 1 FROM lv JOIN free f ON f.src = lv.v) "
    "SELECT v, max(level)::INT AS level FROM ends LEFT JOIN lv USING (v) GROUP BY v"
)
def topo_levels(spark, d):
    """Levels of documents over their links; null on and behind cycles."""
    return network.topological_levels(document_links(spark, d))


@query(
    f"{LINKS}, ends AS (SELECT src AS v FROM links UNION SELECT dst FROM links), n AS (SELECT count(*) AS n FROM ends), run(k, v, dist) AS (SELECT 0::BIGINT, v, CASE WHEN v IN (SELECT min(doc_id) FROM placed GROUP BY source) THEN 0.0::DOUBLE END FROM ends "
    "UNION ALL SELECT k + 1, v, min(dist) FROM (SELECT k, v, dist FROM run UNION ALL SELECT k, dst, dist + cost FROM run JOIN links ON v = src) WHERE k <= (SELECT n FROM n) GROUP BY k, v), "
    f"{LINKS_REACH}, last AS (SELECT a.v, a.dist, b.dist AS before FROM run a JOIN run b USING (v) WHERE a.k = (SELECT n + 1 FROM n) AND b.k = (SELECT n FROM n)), sunk AS (SELECT v FROM last WHERE dist < before UNION SELECT b FROM reach JOIN last ON v = a WHERE dist < before) "
    "SELECT v, CASE WHEN v IN (SELECT v FROM sunk) THEN '-inf'::DOUBLE ELSE dist END AS distance FROM last WHERE dist IS NOT NULL"
)
def signed_distances(spark, d):
    """From the first document of each source over links of any sign."""
    links = document_links(spark, d)
    first = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("v")).select("v")
    known = links.select(F.col("src").alias("v")).union(links.select("dst")).distinct()
    return network.signed_distances(links, first.join(known, "v", "left_semi"))


@query(f"{DIGRAPH}, walk(a, b, dist) AS (SELECT src, dst, cost FROM digraph UNION SELECT a, dst, dist + cost FROM walk JOIN digraph ON b = src WHERE dist + cost < 40) SELECT a, b, min(dist) AS distance FROM walk WHERE a <> b GROUP BY a, b")
def apsp(spark, d):
    def kernel(n: int, edges: list[K.Edge]) -> list[tuple]:
        m = K.floyd_warshall(n, edges)
        return [(a, b, float(m[a, b])) for a in range(n) for b in range(n) if a != b and m[a, b] < K.INF]

    return network.on_driver(digraph(spark, d), kernel, "a int, b int, distance double")


@query(f"{DIGRAPH}, walk(v, dist) AS (SELECT 0, 0.0::DOUBLE UNION SELECT dst, dist + cost FROM walk JOIN digraph ON v = src WHERE dist + cost < 40) SELECT v, min(dist) AS distance FROM walk GROUP BY v")
def bellman_ford(spark, d):
    return network.on_driver(digraph(spark, d), lambda n, e: [(v, x) for v, x in enumerate(K.bellman_ford(n, e, 0)) if x < K.INF], "v int, distance double")


@query()
def max_flow(spark, d):
    def kernel(n: int, edges: list[K.Edge]) -> list[tuple]:
        value, side = K.max_flow(n, [(a, b, int(w)) for a, b, w in edges], 0, n - 1)
        return [(value, ",".join(map(str, side)))]

    return network.on_driver(digraph(spark, d).filter("src < dst"), kernel, "flow long, cut string")


@query(f"{COVER} SELECT chosen, array_to_string(uncovered, ',') AS uncovered, n::DOUBLE AS cost FROM step ORDER BY n DESC LIMIT 1")
def set_cover(spark, d):
    # Groups of suppliers that together serve every nation.
    members = table(spark, d, "supplier").select(F.pmod("s_suppkey", F.lit(7)).alias("set"), F.col("s_nationkey").alias("element"))
    universe = table(spark, d, "nation").select(F.col("n_nationkey").alias("element"))
    sets = members.select("set", F.lit(1.0).alias("relevance"), F.lit(1.0).alias("cost")).distinct()
    chosen, _ = cover.greedy_cover(members.join(universe, "element", "left_semi"), sets)
    left = universe.join(members.join(chosen.select("set"), "set", "left_semi"), "element", "left_anti")
    listed = lambda df, by, c: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col(c).cast("string").alias("v")))), lambda x: x["v"]), ",").alias(c), F.count("*").cast("double").alias("n"))
    return listed(chosen, "place", "set").join(listed(left, "element", "element").drop("n")).select(F.col("set").alias("chosen"), F.col("element").alias("uncovered"), F.col("n").alias("cost"))


@query(
    "WITH RECURSIVE m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS e FROM lineitem WHERE l_quantity >= 49), step(n, chosen, last, gain, open) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, (SELECT list(DISTINCT e) FROM m) UNION ALL "
    "SELECT n + 1, s, s, k, list_filter(open, lambda x: NOT list_contains(es, x)) FROM (SELECT n, open, s, es, k, row_number() OVER (ORDER BY k DESC, s) AS r FROM (SELECT n, open, s, es, len(list_intersect(es, open)) AS k FROM step CROSS JOIN (SELECT s, list(e) AS es FROM m GROUP BY s)) WHERE k > 0) WHERE r = 1) "
    "SELECT chosen AS supplier, n AS place, gain AS new_parts FROM step WHERE n > 0"
)
def supplier_cover(spark, d):
    """Suppliers that by the greedy rule cover all parts of large line items."""
    members = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("element"))
    chosen, _ = cover.greedy_cover(members, members.select("set", F.lit(1.0).alias("relevance"), F.lit(1.0).alias("cost")).distinct())
    return chosen.select(F.col("set").alias("supplier"), F.col("place").cast("long").alias("place"), F.col("new").alias("new_parts"))


@query(
    "WITH suits AS (SELECT DISTINCT l_orderkey AS c, n_regionkey AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' AND l_quantity >= 47), "
    "seats AS (SELECT n_regionkey AS r, count(*) AS capacity FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), "
    "masks AS (SELECT mask, count(*) AS n FROM (SELECT c, bit_or(1 << r) AS mask FROM suits JOIN seats USING (r) GROUP BY c) GROUP BY mask), "
    # A greatest matching is as large as the least cut: some regions' seats, and the orders that another region suits.
    "cuts AS (SELECT s, (SELECT coalesce(sum(capacity), 0) FROM seats WHERE (s >> r) & 1 = 1) + (SELECT coalesce(sum(n), 0) FROM masks WHERE mask & (31 - s) <> 0) AS cut FROM (SELECT unnest(range(32)) AS s)) "
    "SELECT 'orders' AS measure, (SELECT coalesce(sum(n), 0) FROM masks)::BIGINT AS value UNION ALL SELECT 'seats', (SELECT coalesce(sum(capacity), 0) FROM seats)::BIGINT UNION ALL SELECT 'assigned', (SELECT min(cut) FROM cuts)::BIGINT UNION ALL SELECT 'beyond capacity', 0 UNION ALL SELECT 'unsuited', 0"
)
def assign_regions(spark, d):
    """Orders with large returns to regions: each suits the regions of the
    suppliers of these lines, and a region takes one for each customer of its
    own.  Some regions fill up, others do not."""
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("reviewer_id"))
    of = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "reviewer_id")
    returns = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 47")
    suits = returns.join(of, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("case_id"), "reviewer_id").distinct()
    seats = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("reviewer_id").alias("id")).agg(F.count("*").alias("capacity"))
    found = matching.matching(suits, seats)
    used = found.groupBy(F.col("reviewer_id").alias("id")).agg(F.count("*").alias("used"))
    measures = {
        "orders": suits.join(seats, F.col("reviewer_id") == F.col("id"), "left_semi").agg(F.count_distinct("case_id").alias("value")),
        "seats": seats.agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("value")),
        "assigned": found.agg(F.count_distinct("case_id").alias("value")),
        "beyond capacity": used.join(seats, "id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("value")),
        "unsuited": found.join(suits, ["case_id", "reviewer_id"], "left_anti").agg(F.count("*").alias("value")),
    }
    return reduce(DataFrame.union, [m.select(F.lit(name).alias("measure"), F.col("value").cast("long").alias("value")) for name, m in measures.items()])


# ------------------------------------------------------------------ sets, sorts, catalogue
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("WITH q AS (SELECT round(l_quantity * 100)::INT AS x, count(*) AS n FROM lineitem GROUP BY 1) SELECT x, n, sum(n) OVER (ORDER BY x)::BIGINT AS upto FROM q")
def int_sorts(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.round(F.col("l_quantity") * 100).cast("int").alias("x")).agg(F.count("*").alias("n"))
    return along(q, [F.col("x").asc()], upto=F.col("n")).select("x", "n", "upto").orderBy("x")


@query("SELECT 'D' || doc_id AS id, source AS path FROM documents WHERE 'D' || doc_id BETWEEN 'D10' AND 'D19'")
def doc_range(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("path"))
    return docs.filter(F.col("id").between("D10", "D19")).orderBy("id")


@query("SELECT source AS path, count(*) AS n, min('D' || doc_id) AS first_id FROM documents WHERE source BETWEEN 'src1' AND 'src3' GROUP BY source")
def path_range(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("path"))
    return docs.filter(F.col("path").between("src1", "src3")).groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_wins(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def remove_documents(spark, d):
    toxic = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, d, "documents").join(toxic, "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT 'SUBMISSION' AS doc_type, count(*) AS n, count(DISTINCT text) AS texts FROM documents UNION ALL SELECT 'REFERENCE', count(*), count(DISTINCT text) FROM benchmark")
def union_corpora(spark, d):
    a = table(spark, d, "documents").select(F.lit("SUBMISSION").alias("doc_type"), "text")
    b = table(spark, d, "benchmark").select(F.lit("REFERENCE").alias("doc_type"), "text")
    return a.unionByName(b).groupBy("doc_type").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS loaded, l.doc_id IS NOT NULL AS stored FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def catalogue_consistency(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.lit(True).alias("loaded"))
    b = table(spark, d, "labels").select("doc_id", F.lit(True).alias("stored")).distinct()
    j = a.join(b, "doc_id", "full").select("doc_id", F.coalesce("loaded", F.lit(False)).alias("loaded"), F.coalesce("stored", F.lit(False)).alias("stored"))
    return j.filter(~(F.col("loaded") & F.col("stored")))


@query("WITH b AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) SELECT h AS byte, count(*) AS n FROM b GROUP BY h")
def byte_histogram(spark, d):
    h = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0))).alias("byte"))
    return h.groupBy("byte").agg(F.count("*").alias("n"))


@query("SELECT item_id, true AS same FROM benchmark")
def huffman_roundtrip(spark, d):
    raw = F.encode("text", "UTF-8")
    return table(spark, d, "benchmark").select("item_id", (U.decompress(U.compress(raw)) == raw).alias("same"))


# ------------------------------------------------------------------ ingest
# A file per row: ids are language and length, so that many are taken twice.
_FILES = "SELECT '{0}/' || coalesce({1}, '-') || '-' || {2} || '.txt' AS path, 'ID: ' || coalesce({3}, '-') || length(coalesce(text, '')) || chr(10) || 'TITLE: ' || coalesce({1}, '-') || chr(10) || chr(10) AS head, coalesce({3}, '-') || length(coalesce(text, '')) AS doc_id, coalesce({1}, '-') AS title, coalesce(text, '') AS body, '{4}' AS doc_type FROM {5}"
PARSED = f"""
files AS ({_FILES.format('in', 'source', 'doc_id', 'lang', 'SUBMISSION', 'documents')} UNION ALL {_FILES.format('ref', "'item'", 'item_id', "'ref'", 'REFERENCE', 'benchmark')}),
checked AS (
  SELECT *, split_part(path, '/', -1) AS name, CASE WHEN strlen(head || body) > 2000000 THEN 'file too large' WHEN trim(body, ' ') = '' THEN 'no text' WHEN NOT regexp_matches(body, '[\\p{{L}}\\p{{Nd}}]') THEN 'no letter or digit' WHEN NOT regexp_matches(doc_id, '^[\\p{{L}}\\p{{Nd}}_-]+$') THEN 'bad id' END AS reason FROM files),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_type, doc_id, reason IS NULL ORDER BY lower(name), name, path) AS k, row_number() OVER (PARTITION BY doc_id, reason IS NULL ORDER BY doc_type DESC, lower(name), path) AS k_both FROM checked)"""


def parsed_files(spark: SparkSession, d: str, name: str) -> DataFrame:
    folder, key, doc_type = {"documents": ("in", "doc_id", "SUBMISSION"), "benchmark": ("ref", "item_id", "REFERENCE")}[name]
    t = table(spark, d, name).withColumn("text", F.coalesce("text", F.lit("")))
    source, lang = (F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))) if name == "documents" else (F.lit("item"), F.lit("ref"))
    content = F.encode(F.concat(F.lit("ID: "), lang, F.length("text").cast("string"), F.lit("\nTITLE: "), source, F.lit("\n\n"), "text"), "UTF-8")
    rows = t.select(F.concat(F.lit(f"{folder}/"), source, F.lit("-"), F.col(key).cast("string"), F.lit(".txt")).alias("path"), content.alias("content"))
    return ingest.parse(rows.withColumn("length", F.octet_length("content").cast("long")), doc_type)


@query(f"WITH {PARSED} SELECT doc_id, title, length(body) AS n, 3 AS line_offset, row_number() OVER (ORDER BY lower(name), name, path) - 1 AS pos FROM ranked WHERE doc_type = 'SUBMISSION' AND reason IS NULL AND k = 1")
def ingest_documents(spark, d):
    docs, _ = ingest.import_files(parsed_files(spark, d, "documents"))
    return docs.select("doc_id", "title", F.length("content").cast("long").alias("n"), "line_offset", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {PARSED} SELECT path AS file, doc_id, coalesce(reason, 'duplicate id') AS reason FROM ranked WHERE doc_type = 'SUBMISSION' AND (reason IS NOT NULL OR k > 1)")
def ingest_errors(spark, d):
    return ingest.import_files(parsed_files(spark, d, "documents"))[1]


@query(f"WITH {PARSED} SELECT doc_type, count(*) FILTER (reason IS NULL AND k_both = 1) AS valid, count(*) FILTER (reason IS NOT NULL OR k_both > 1) AS invalid FROM ranked GROUP BY doc_type")
def ingest_validate(spark, d):
    return ingest.validate(parsed_files(spark, d, "documents"), parsed_files(spark, d, "benchmark"))


@query(f"WITH {PARSED}, first AS (SELECT * FROM ranked WHERE doc_type = 'SUBMISSION' AND reason IS NULL AND k = 1) SELECT 'APDS_DOCUMENT_INDEX' AS line UNION ALL SELECT 'VERSION' || chr(9) || '1' UNION ALL SELECT 'COUNT' || chr(9) || count(*) FROM first UNION ALL SELECT 'RECORD' || chr(9) || doc_id || chr(9) || doc_type || chr(9) || path FROM first")
def catalogue_snapshot(spark, d):
    docs, _ = ingest.import_files(parsed_files(spark, d, "documents"))
    return ingest.snapshot_lines(docs)


# ------------------------------------------------------------------ kernels and the whole
@query(
    f"{SIGNED} SELECT a.id AS sub_id, b.id AS ref_id, CASE WHEN len(a.s) > 0 AND len(b.s) > 0 THEN k / 128.0::DOUBLE END AS estimate FROM sides a JOIN sides b ON a.side = 's' AND b.side = 'r' "
    "LEFT JOIN agreed ON sub_pos = a.pos AND ref_pos = b.pos WHERE len(a.s) = 0 OR len(b.s) = 0 OR k >= 0.12::DOUBLE * 128"
)
def minhash_candidates(spark, d):
    return candidates.minhash_candidates(submissions(spark, d), references(spark, d), SETTINGS.candidate_threshold).select("sub_id", "ref_id", "estimate")


@query(f"{ALIGNED} SELECT sub_id, ref_id, alignment, similarity, lcs, edits, 0.50::DOUBLE * similarity + 0.30::DOUBLE * (lcs / longest) + 0.20::DOUBLE * (1.0::DOUBLE - edits / longest) AS fuzzy FROM measured")
def fuzzy_score(spark, d):
    subs, refs, pairs = overlapping(spark, d)
    out = scoring.fuzzy_scores(pairs.select(*scoring.PAIR), subs, refs)
    return out.select("sub_id", "ref_id", F.col("align.score").alias("alignment"), F.col("align.similarity").alias("similarity"), "lcs", "edits", "fuzzy")


@query(
    f"{WHOLE} SELECT 'PD-' || (sub_pos * n_refs + ref_pos + 1) || '-' || sub_id || '-' || ref_id AS case_id, sub_id, ref_id, exact, shingle, fuzzy, graph, total, "
    "CASE WHEN total >= 0.75 THEN 'CRITICAL' WHEN total >= 0.55 THEN 'HIGH' WHEN total >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM final CROSS JOIN sizes"
)
def full_pipeline(spark, d):
    a = whole(spark, d)
    return a.cases.select("case_id", "sub_id", "ref_id", "exact", "shingle", "fuzzy", "graph", "total", "risk")


@query(f"{EVIDENCE} SELECT case_id, idx, type, sub_start::INT AS sub_start, sub_end::INT AS sub_end, ref_start::INT AS ref_start, ref_end::INT AS ref_end, similarity, algorithm, excerpt, place::INT AS place FROM chosen WHERE place <= 8")
def evidence_compact(spark, d):
    return whole(spark, d).evidence


@query(f"{ALIGNED} SELECT sub_id, ref_id, alignment AS score, i0 AS sub_from, i_end AS sub_to, j0 AS ref_from, j_end AS ref_to FROM measured WHERE alignment > 0")
def alignment_spans(spark, d):
    subs, refs, pairs = overlapping(spark, d)
    out = scoring.fuzzy_scores(pairs.select(*scoring.PAIR), subs, refs).filter("align.score > 0")
    spans = [F.col(f"align.{c}").cast("long").alias(n) for c, n in (("score", "score"), ("sub_start", "sub_from"), ("sub_end", "sub_to"), ("ref_start", "ref_from"), ("ref_end", "ref_to"))]
    return out.select("sub_id", "ref_id", *spans)


@query(
    f"WITH {SUBS}, {REFS}, {PAIRS}, {EXACT}, stands AS (SELECT sub_pos, ref_pos, phrase, ref_norm, unnest(range(len(ref_norm) - len(phrase) + 1)) AS ref_at FROM matches) "
    "SELECT 'D' || sub_pos AS sub_id, 'B' || ref_pos AS ref_id, phrase, ref_at, row_number() OVER (PARTITION BY sub_pos, ref_pos ORDER BY ref_at + len(phrase), len(phrase) DESC, phrase) AS hit FROM stands WHERE substr(ref_norm, ref_at + 1, len(phrase)) = phrase "
    "AND sub_pos IN (SELECT pos FROM subs WHERE len(tokens) >= 5)"
)
def multi_pattern_hits(spark, d):
    """All hits of all phrases of a submission in its reference, by their end,
    at one end from the longest on."""
    subs, refs, pairs = overlapping(spark, d)
    # Only texts of a pair are taken apart, and only once.
    tokens = lambda docs: materialise(evidence.token_rows(docs.select("pos", "content")), "pair-tokens")
    hits = evidence.phrase_hits(pairs, tokens(subs), tokens(refs), SETTINGS)
    n = F.length("phrase")
    order = Window.partitionBy("sub_pos", "ref_pos").orderBy(F.col("place.norm_at") + n, n.desc(), "phrase")
    ids = lambda key, p: F.concat(F.lit(p), F.col(key).cast("string"))
    return hits.select(ids("sub_pos", "D").alias("sub_id"), ids("ref_pos", "B").alias("ref_id"), "phrase", F.col("place.norm_at").cast("long").alias("ref_at"), F.row_number().over(order).cast("long").alias("hit"))


@query()
def case_report(spark, d):
    a = whole(spark, d)
    return case_reports(a.cases, evidence.located(a.evidence, a.cases, submissions(spark, d), references(spark, d)), a.assigned, SETTINGS.review_threshold)


def whole(spark: SparkSession, d: str) -> analysis.Analysis:
    n_subs, n_refs = table(spark, d, "documents").count(), table(spark, d, "benchmark").count()
    return analysis.analyse(submissions(spark, d), references(spark, d), reviewers(spark), SETTINGS, n_subs, n_refs)
