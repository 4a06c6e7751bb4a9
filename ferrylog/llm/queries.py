"""One query per operator of this subpackage, over whole tables, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylog.llm import bpe, decontamination, learning, licences, minhash, mixing, negatives, pivots, projections, quality, runs, secrets, suffixes, toxicity
from ferrylog.llm.common import table
from ferrylog.session import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Target weights of the mix: the first source, a third of all rows, goes down to a tenth; the others rise in steps.
WEIGHTS = {"src0": 10.0} | {f"src{i}": 3.0 + i % 4 for i in range(1, 16)}
OTHER_WEIGHT, SEED = 8.0, 20
LEAST_SCORE = 0.3


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def either_case(pattern: str) -> str:
    """For engines whose case folding goes beyond A-Z: each letter as a class of both cases."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


#: Rules whose patterns need what the other engine lacks, said without it: it searches in linear time by itself.
_PLAIN = {"jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"}


def _sql_rule(place: int, rule: secrets.Rule) -> str:
    if rule.kind in _PLAIN:
        rule = secrets.Rule(rule.kind, rule.version, _PLAIN[rule.kind], 0, rule.least)
    pattern = rule.pattern.replace("(?i:(password|passwd|secret|token|api_?key))", f"({either_case('password|passwd|secret|token|api_?key')})").replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(g[:len(m)], lambda x: length(x))) AS gap,
      unnest(list_transform(m, lambda x: length(x))) AS size, unnest(list_transform(c, lambda x: length(x))) AS counted, {rule.least} AS least
    FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS g, regexp_extract_all(coalesce(text, ''), '{pattern}', 0) AS m,
      regexp_extract_all(coalesce(text, ''), '{pattern}', {rule.measured}) AS c FROM documents) WHERE len(m) > 0"""


_BASE = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
SECRETS_SQL = f"""
WITH hits AS ({" UNION ALL ".join(_sql_rule(i, r) for i, r in enumerate(secrets.RULES))}),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, place ORDER BY i) AS stop FROM hits),
spans AS (SELECT doc_id, place, kind, (stop - size)::BIGINT AS start, concat(kind, ':', (stop - size)::BIGINT, ':', stop::BIGINT) AS span FROM placed WHERE counted >= least),
told AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)},
  string_agg(span, ',' ORDER BY start, place) FILTER (kind IN ({_BASE})) AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told USING (doc_id)"""


def judged(scored: DataFrame, held_out: int, folds: int) -> DataFrame:
    """The fold and the decision beside each score; a row without an id was never learned from."""
    return scored.select(
        "doc_id",
        F.coalesce(learning.fold("doc_id", folds) == held_out, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"),
    )


@query("op1_quality_classifier")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    weights = quality.fit(docs, table(spark, folder, "labels"), learning.fold("doc_id", 5) != 0)
    return judged(quality.score(docs, weights), 0, 5)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NEAR_SQL = f"""
WITH RECURSIVE cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM cut),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id != b.doc_id AND 100 * least(a.n, b.n) >= {minhash.PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {minhash.PERCENT} * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least_of AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_of ON u = doc_id"""


@query("op6_minhash_near_dedup", NEAR_SQL)
def _(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


REPEATS_SQL = f"""
WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents WHERE doc_id IS NOT NULL),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - {suffixes.LEAST} + 2)) AS i FROM cut WHERE len(w) >= {suffixes.LEAST}),
windows AS (SELECT doc_id, i - 1 AS start, array_to_string(w[i:i + {suffixes.LEAST - 1}], ' ') AS x FROM places),
repeated AS (SELECT x, min(doc_id) AS first_id FROM windows GROUP BY x HAVING min(doc_id) != max(doc_id)),
found AS (SELECT DISTINCT doc_id, start, first_id FROM windows JOIN repeated USING (x)),
marked AS (SELECT *, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + {suffixes.LEAST} THEN 0 ELSE 1 END AS new FROM found),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS number FROM marked)
SELECT doc_id, min(start) AS start_word, max(start) + {suffixes.LEAST} AS end_word, max(start) + {suffixes.LEAST} - min(start) AS n_words, min(first_id) AS first_id, doc_id = min(first_id) AS kept
FROM numbered GROUP BY doc_id, number"""


@query("op2_suffix_dedup", REPEATS_SQL)
def _(spark, folder):
    return suffixes.repeated_passages(table(spark, folder, "documents"))


_TEMPLATES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licences.TEMPLATES.items())
_OVER, _UNDER = licences.LEAST


LICENCE_SQL = f"""
WITH cut AS (SELECT 0 AS i, NULL AS doc_id, licence, x FROM (VALUES {_TEMPLATES}) t(licence, x) UNION ALL SELECT row_number() OVER (), doc_id, NULL, coalesce(text, '') FROM documents),
words AS (SELECT i, doc_id, licence, regexp_extract_all(translate(x, '{_UPPER}', '{_UPPER.lower()}'), '[a-z0-9]+') AS w FROM cut),
grams AS (SELECT i, licence, unnest(range(0, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM words WHERE len(w) > 1),
marks AS (SELECT licence, g, count(*) AS c, sum(count(*)) OVER (PARTITION BY licence) AS b FROM grams WHERE i = 0 GROUP BY licence, g),
hits AS (SELECT i, marks.licence, p, g, c, b, row_number() OVER (PARTITION BY i, marks.licence, g ORDER BY p) AS k FROM grams JOIN marks USING (g) WHERE i > 0),
enough AS (SELECT i, licence FROM hits GROUP BY i, licence HAVING count(*) FILTER (k <= c) * {2 * _UNDER - _OVER} >= {_OVER} * any_value(b)),
near AS (SELECT h.*, e.p AS before FROM hits h SEMI JOIN enough USING (i, licence) LEFT JOIN hits e ON e.i = h.i AND e.licence = h.licence AND e.g = h.g AND e.k = h.k - h.c),
spans AS (SELECT s.i, s.licence, s.b, s.p AS start, h.p - s.p + 1 AS a, count(*) FILTER (h.before IS NULL OR h.before < s.p) OVER (PARTITION BY s.i, s.licence, s.p ORDER BY h.p) AS common
  FROM near s JOIN near h ON h.i = s.i AND h.licence = s.licence AND h.p >= s.p AND {_OVER} * (h.p - s.p + 1) <= {2 * _UNDER - _OVER} * s.b),
best AS (SELECT *, 2.0::DOUBLE * common / (a + b) AS dice FROM spans WHERE 2 * {_UNDER} * common >= {_OVER} * (a + b) QUALIFY row_number() OVER (PARTITION BY i, licence ORDER BY dice DESC, start, a) = 1)
SELECT words.doc_id, best.licence, dice, start, a + 1 AS words FROM best JOIN words USING (i) WHERE i > 0"""


@query("op3_licence_scans", LICENCE_SQL)
def _(spark, folder):
    return licences.licence_matches(table(spark, folder, "documents"))


@query("op7_toxicity")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), learning.fold("doc_id", 4) != 2)
    return judged(toxicity.score(docs, model), 2, 4)


LINKS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
fit AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM fit a, fit b WHERE a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(u, v) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
numbers AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT r.u AS vec_id, coalesce(any_value(n), 0) AS n_links, min(r.v) AS component_id, r.u = min(r.v) AS kept FROM reach r LEFT JOIN numbers ON numbers.u = r.u GROUP BY r.u"""


@query("op4_pivot_near_dedup", LINKS_SQL)
def _(spark, folder):
    return pivots.near_vectors(table(spark, folder, "embeddings"))


@query("op8_nearest_neighbours")
def _(spark, folder):
    return projections.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op5_secret_scans", SECRETS_SQL)
def _(spark, folder):
    return secrets.secret_report(table(spark, folder, "documents"), new_path(spark, "ledger"))


_LISTED = ", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())


def mixing_sql(docs: str = "documents") -> str:
    hashed = "('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 13))::BIGINT"
    draw = hashed.format(seed=SEED, parts="coalesce(doc_id::VARCHAR, '')")
    key = hashed.format(seed=SEED + 1, parts="coalesce(doc_id::VARCHAR, ''), mix_copy::VARCHAR")
    return f"""
WITH listed(s, w) AS (VALUES {_LISTED}),
sized AS (SELECT listed.s AS g, any_value(coalesce(w, {OTHER_WEIGHT})) AS w, sum(coalesce(length(text), 0))::DOUBLE AS n FROM {docs} LEFT JOIN listed ON source = s GROUP BY listed.s HAVING n > 0),
rates AS (SELECT g, (w / (SELECT sum(w) FROM sized)) * (1.0::DOUBLE * (SELECT sum(n) FROM sized)) / n AS r FROM sized),
steps AS (SELECT g, sum(exp(k * ln(r) - r - lgamma(k + 1.0))) OVER (PARTITION BY g ORDER BY k) AS c FROM rates, (SELECT unnest(range(0, 120))::DOUBLE AS k)),
cuts AS (SELECT g, list(least(c, 1.0) ORDER BY c) AS cs FROM steps GROUP BY g),
drawn AS (SELECT d.*, len(list_filter(cs, lambda x: x <= {draw} / 4503599627370496.0)) AS k FROM {docs} d LEFT JOIN listed ON source = listed.s JOIN cuts ON cuts.g IS NOT DISTINCT FROM listed.s),
many AS (SELECT * EXCLUDE (k), unnest(range(1, k + 1))::INTEGER AS mix_copy FROM drawn WHERE k > 0)
SELECT *, {key} AS mix_key FROM many"""


@query("op9_mix_sources", mixing_sql())
def _(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents"), WEIGHTS, rest=OTHER_WEIGHT, seed=SEED)


@query("op10_byte_bpe")
def _(spark, folder):
    return bpe.token_digests(table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


NEGATIVES_SQL = f"""
WITH fit AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
met AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM met WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN met USING (anchor_id) WHERE NOT alike AND {negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= {negatives.NEGATIVES}"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def _(spark, folder):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


_CRC32 = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""
RUNS_SQL = f"""
WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x != '') AS w, {_CRC32} AS h FROM documents),
sized AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS turns FROM cut),
texts AS (SELECT doc_id, CASE WHEN planted THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + turns)) END]) ELSE w END AS w FROM sized),
places AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS x, len(w) AS n FROM texts),
equal AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM places a JOIN places b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM equal),
found AS (SELECT doc_id, min(i) AS start, count(*) + p AS length, p AS period FROM islands GROUP BY doc_id, p, island HAVING count(*) + p >= greatest({runs.LEAST_WORDS}, {runs.LEAST_PERIODS} * p)),
kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.period < f.period AND o.start <= f.start AND o.start + o.length >= f.start + f.length)),
best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs FROM kept GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM kept),
collapsed AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN collapsed USING (doc_id)"""


@query("op12_periodic_runs", RUNS_SQL)
def _(spark, folder):
    return runs.run_report(table(spark, folder, "documents"), planted=True)


def _bare_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '')"


LEAKS_SQL = f"""
WITH items AS (SELECT item_id, {_bare_words("text")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - {decontamination.WORDS - 2}, 2)), lambda i: array_to_string(w[i:i + {decontamination.WORDS - 1}], ' '))) AS x,
  least(len(w), {decontamination.WORDS}) AS k FROM items WHERE len(w) > 0),
docs AS (SELECT doc_id, {_bare_words("text")} AS w FROM documents),
places AS (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS x FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
met AS (SELECT doc_id, item_id, i, k FROM places JOIN windows USING (k, x)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM met) GROUP BY doc_id),
told AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN told USING (doc_id)"""


@query("op13_decontamination", LEAKS_SQL)
def _(spark, folder):
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")
