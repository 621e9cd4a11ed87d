"""DuckDB SQL of the queries that SQL can express.

The statements state the rules again, by plain joins and lists; they share no
code with the operators except the fixed word lists and thresholds.
"""

from __future__ import annotations

from airwell.llm import quality, sharding

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_COMPONENTS = """reach(node, component) AS (
  SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.component = l.a),
lowest AS (SELECT node, least(node, min(component)) AS component FROM reach GROUP BY node)"""

OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.98),
{_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
       vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN lowest ON node = vec_id
"""


def near_duplicate_sql(percent: int) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {lower} FROM documents)),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
          WHERE 100 * k >= {percent} * (na.n + nb.n - k)),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id,
       d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN lowest ON node = d.doc_id
"""


def sharding_sql(shards: int = sharding.SHARDS, size: int = sharding.TABLE_SIZE) -> str:
    number = lambda s: f"CAST('0x' || substr(md5({s}), 1, 15) AS BIGINT)"
    return f"""
WITH RECURSIVE names AS (
  SELECT i, {number("'shard-' || i || '/offset'")} % {size} AS o, {number("'shard-' || i || '/skip'")} % {size - 1} + 1 AS k
  FROM range({shards}) t(i)),
lists AS (SELECT list(o ORDER BY i) AS os, list(k ORDER BY i) AS ks FROM names),
turns(turn, taken, slot) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range({size}), lambda x: false), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT turn + 1, list_concat(taken[1:found], [true], taken[found + 2:]), found FROM (
    SELECT turn, taken, list_filter(list_transform(range({size}),
        lambda j: (os[turn % {shards} + 1] + j * ks[turn % {shards} + 1]) % {size}), lambda p: NOT taken[p + 1])[1] AS found
    FROM turns, lists WHERE turn < {size})),
owner AS (SELECT slot, (turn - 1) % {shards} AS shard FROM turns WHERE turn > 0),
keys AS (SELECT doc_id, {number("coalesce(CAST(doc_id AS VARCHAR), '')")} % {size} AS slot FROM documents)
SELECT doc_id, slot, shard FROM keys JOIN owner USING (slot)
"""


def quality_sql() -> str:
    common = [w for ws in quality.COMMON_WORDS.values() for w in ws]
    common = list(dict.fromkeys(common))
    forms = ", ".join(f"('{f}', '{w}')" for w in common for f in dict.fromkeys((w, w.capitalize())))
    count = lambda rule: f"len(regexp_extract_all(coalesce(text, ''), '{rule}'))"
    langs = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang, {_WORDS} AS w FROM documents),
base AS (
  SELECT r, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) AS n_chars,
    {count('[#*$%&|<>]')} AS n_symbols, {count('[A-Z]')} AS upper_n, {count('[0-9]')} AS digit_n,
    {count('[a-z]')} AS lower_n, len(regexp_extract_all(text, '[.,;:!?''()"-]')) AS point_n,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
windows AS (SELECT r, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS k
            FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1),
again AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(3) t(j) GROUP BY r),
forms(form, word) AS (VALUES {forms}),
cells AS (
  SELECT r, 'c' AS kind, b AS bin, CAST(v AS DOUBLE) AS v, n_chars AS total FROM (
    SELECT r, n_chars, unnest(['lower', 'upper', 'digit', 'point', 'symbol', 'other', 'space']) AS b,
      unnest([lower_n, upper_n, digit_n, point_n, n_symbols, word_chars - lower_n - upper_n - digit_n - point_n - n_symbols,
              n_chars - word_chars]) AS v FROM base)
  UNION ALL
  SELECT base.r, 'w', t.word, CAST(coalesce(c.n, 0) AS DOUBLE), n_words FROM base
  JOIN (SELECT DISTINCT word FROM forms) t ON true
  LEFT JOIN (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM d) JOIN forms ON form = x GROUP BY r, word) c
    ON c.r = base.r AND c.word = t.word),
bins AS (
  SELECT * FROM cells UNION ALL
  SELECT r, 'w', '', greatest(total - sum(v), 0), total FROM cells WHERE kind = 'w' GROUP BY r, total),
unit AS (SELECT r, kind, bin, v / greatest(sum(v) OVER (PARTITION BY r, kind), 1e-12) AS p FROM bins),
means AS (SELECT lang, kind, bin, avg(v / greatest(total, 1)) AS q FROM cells JOIN base USING (r) WHERE lang IN ({langs}) GROUP BY ALL),
refs AS (
  SELECT lang, kind, bin, q / sum(q) OVER (PARTITION BY lang, kind) AS q FROM (
    SELECT * FROM means UNION ALL
    SELECT lang, 'w', '', greatest(1 - sum(q), 0) FROM means WHERE kind = 'w' GROUP BY lang)),
apart AS (
  SELECT r, u.kind, lang, sqrt(greatest(sum(
    (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0)) AS jsd
  FROM unit u JOIN refs f ON f.kind = u.kind AND f.bin = u.bin GROUP BY r, u.kind, lang),
nearest AS (SELECT r, min(jsd) FILTER (kind = 'c') AS cj, min(jsd) FILTER (kind = 'w') AS wj FROM apart GROUP BY r),
judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(again.n, 0) AS n_repeat_words,
    n_words < {quality.MIN_WORDS} OR 100 * coalesce(again.n, 0) > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN n_chars >= {quality.GUARD_CHARS} THEN cj END AS cj, CASE WHEN n_words >= {quality.GUARD_WORDS} THEN wj END AS wj
  FROM base LEFT JOIN again USING (r) LEFT JOIN nearest USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(cj, 0) > {quality.MAX_CHAR_JSD}
    OR (coalesce(cj, 0) > {quality.BOTH_CHAR_JSD} AND coalesce(wj, 0) > {quality.BOTH_WORD_JSD})) AS kept,
  round(cj, 6) AS char_jsd, round(wj, 6) AS word_jsd
FROM judged
"""


OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor AS anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": OP1,
    "op5_minhash_near_dedup": near_duplicate_sql(85),
    "op8_lookup_sharding": sharding_sql(),
    "op9_quality_divergence": quality_sql(),
    "op12_hard_negatives": OP12,
}
