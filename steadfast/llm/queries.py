"""The registered queries of these operators: QUERIES[name] = (spark callable, sql or None)."""

import public_tokenizers

from steadfast.llm import bpe, codes, counts, fim, fingerprints, langid, lm, neardup, packing, pii, quality, shards, topk
from steadfast.llm.common import table

QUERIES = {}
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the same ids as byte_bpe_50k.json
WORDS = public_tokenizers.path("word_bpe_49k.json")


NEAREST_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)) WHERE rank <= 5"""
FIM_SQL = """WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
  h AS (SELECT doc_id, text, units, len(units) AS n, ('0x' || substr(d, 1, 8))::BIGINT % (len(units) + 1) AS a,
    ('0x' || substr(d, 9, 8))::BIGINT % (len(units) + 1) AS b, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM u),
  c AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, array_to_string(units[1:least(a, b)], '') AS p,
    array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1:], '') AS s FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM c"""


def _codes_sql(parts=16, entries=64, rounds=2):
    """Codebooks of all rounds in long form; every round compares every part with every entry."""
    steps = [f"""v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS w
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (SELECT r, vec_id, label, p, w[p * (len(w) // {parts}) + 1:(p + 1) * (len(w) // {parts})] AS v FROM v, range({parts}) t(p)),
    b0 AS MATERIALIZED (SELECT p, r AS e, v AS c FROM x WHERE r < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT r, vec_id, label, p, v, e, d FROM (SELECT x.*, e, row_number() OVER (PARTITION BY r, p ORDER BY d, e) AS k, d
      FROM (SELECT x.*, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{i} USING (p)) x) WHERE k = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY j) AS c FROM (SELECT p, e, j, sum(v[j])::BIGINT AS s, count(*) AS n
      FROM d{i}, range(1, len(v) + 1) t(j) GROUP BY ALL) GROUP BY p, e),
    b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (p, e))""")
    return f"""WITH {", ".join(steps)},
  coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM d{rounds} GROUP BY r, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM coded"""


ORACLES = {"op8_topk": NEAREST_SQL, "op12_fim": FIM_SQL, "op13_codes": _codes_sql()}


def query(fn):
    QUERIES[fn.__name__] = (fn, ORACLES.get(fn.__name__))
    return fn


@query
def op1_fingerprints(spark, sf):
    return fingerprints.with_neighbour(table(spark, sf, "documents"))


@query
def op2_quality(spark, sf):
    return quality.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op3_lm(spark, sf):
    return lm.score(table(spark, sf, "documents"))


@query
def op4_langid(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


@query
def op5_neardup(spark, sf):
    return neardup.groups(table(spark, sf, "documents"), similarity_pct=85)


@query
def op6_bpe(spark, sf):
    return bpe.encode(table(spark, sf, "documents"), MULTI_RANKS, digests=True)


@query
def op7_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), RANKS)


@query
def op8_topk(spark, sf):
    return topk.nearest(table(spark, sf, "embeddings"))


@query
def op9_shards(spark, sf):
    return shards.materialised(table(spark, sf, "documents"), RANKS)


@query
def op10_pii(spark, sf):
    return pii.report(table(spark, sf, "documents"))


@query
def op11_counts(spark, sf):
    return counts.count(table(spark, sf, "documents"), WORDS)


@query
def op12_fim(spark, sf):
    return fim.fill_in_middle(table(spark, sf, "documents"), digests=True)


@query
def op13_codes(spark, sf):
    return codes.compress(table(spark, sf, "embeddings"))
