"""DuckDB SQL that gives the same rows as a query, for the operators that SQL can express.

The others hash, tokenize or train: tests/llm compares them with plain versions, the public library or held-out labels.
"""

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_LINKED = """ n_linked AS (SELECT a, count(*) AS k FROM p GROUP BY a), r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
  reach AS (SELECT a, min(b) AS m FROM r GROUP BY a)"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
  ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9), {_LINKED}
  SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
  FROM embeddings LEFT JOIN n_linked ON vec_id = n_linked.a LEFT JOIN reach ON vec_id = reach.a"""

SIMILAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)), {_LINKED}
  SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
  FROM documents LEFT JOIN n_linked ON doc_id = n_linked.a LEFT JOIN reach ON doc_id = reach.a"""

REPEATS = f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
  i AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS g, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
  f AS (SELECT g, min(doc_id) AS m FROM i GROUP BY g),
  hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM i JOIN f USING (g) WHERE m < doc_id),
  x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
  k AS (SELECT x.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY x.p) AS t FROM x ANTI JOIN hit ON x.doc_id = hit.doc_id AND x.p = hit.p GROUP BY x.doc_id)
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""

_CRC_TABLE = "crc AS (SELECT list(x ORDER BY i) AS steps FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS x FROM range(256) t(i)))"


def _crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes of ``text``, where the column ``steps`` of the table ``crc`` is in reach."""
    byte = f"list_transform(range(CAST(octet_length(encode({text})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {byte}), lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1])), 4294967295)"


CONVERSATIONS = f"""WITH {_CRC_TABLE}, t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
  o AS (SELECT conv_id, list({{'g': g, 'w': w}} ORDER BY turn NULLS FIRST, g) AS s FROM (SELECT conv_id, turn, md5(length(r) || ':' || r || x) AS g, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM t) GROUP BY conv_id),
  h AS (SELECT conv_id, s, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM o, crc),
  b AS (SELECT h.conv_id, list_concat(coalesce(f.s[1:h], []), h.s[h + 1:]) AS s FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % 20),
  p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM b),
  k AS (SELECT conv_id, d, array_to_string(list_transform(s[1:d], lambda e: e.g), '') AS k, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w, len(s) = d AS ended FROM p),
  n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM k GROUP BY k, d),
  c AS (SELECT substr(k, 1, len(k) - 32) AS k, count(*) AS c FROM n WHERE d > 0 GROUP BY 1),
  u AS (SELECT substr(k, 1, 32 * j) AS k, sum(CASE WHEN c IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * w) AS saved FROM (SELECT n.*, c, unnest(range(0, d + 1)) AS j FROM n LEFT JOIN c USING (k)) GROUP BY 1)
  SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
  FROM n JOIN u USING (k) LEFT JOIN c USING (k) LEFT JOIN n p ON n.d > 0 AND p.k = substr(n.k, 1, len(n.k) - 32)"""

_RUNS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _features(name: str, key: str) -> str:
    return f"""{name}w AS (SELECT {key} AS id, {_RUNS} AS w FROM {name}),
  {name}f AS (SELECT id, array_to_string(w[i:i + n - 1], ' ') AS f FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {name}w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n))"""


RESAMPLED = f"""WITH {_CRC_TABLE}, {_features("documents", "doc_id")}, {_features("benchmark", "item_id")},
  x AS (SELECT f, {_crc32("f")} % 10000 AS b FROM (SELECT f FROM documentsf UNION SELECT f FROM benchmarkf), crc),
  s AS (SELECT b, count(*) AS s FROM documentsf JOIN x USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM benchmarkf JOIN x USING (f) GROUP BY b),
  total AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM documentsf) AS s, (SELECT CAST(count(*) AS DOUBLE) FROM benchmarkf) AS t),
  g AS (SELECT b, CAST(floor(1000 * ln((coalesce(CAST(t.t AS DOUBLE), 0) + 1) * (total.s + 10000) / ((CAST(s.s AS DOUBLE) + 1) * (total.t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), total),
  w AS (SELECT id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM documentsf JOIN x USING (f) JOIN g USING (b) GROUP BY id),
  d AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(v.w) >= 20 AS able, CAST('0x' || substr(sha256('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM documents JOIN documentsw v ON v.id = doc_id LEFT JOIN w ON w.id = doc_id),
  r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
  k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS k, count(*) FILTER (able) OVER () AS n FROM r)
  SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 5 * n // 100 THEN k END AS rank FROM k"""
