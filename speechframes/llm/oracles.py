"""DuckDB equivalents of the operators that SQL can express exactly."""

from __future__ import annotations

from speechframes.llm import licenses

# base32 of a SHA-1: each five hexadecimal digits are four characters
WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, url, octet_length(encode(html)) AS n, sha1(html) AS hex FROM p),
d AS (
  SELECT page_id, url, n, array_to_string(list_transform(range(0, 8), lambda b: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * b + 1, 5) AS INTEGER) >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS digest
  FROM h
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url
FROM f
"""

# bytes are pairs of hexadecimal digits here
SUFFIXES = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS s
  FROM (SELECT doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - 99))) AS p FROM t)
),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
i AS (SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 AS reach FROM later),
k AS (SELECT doc_id, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM k GROUP BY doc_id, run),
g AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte, a AS to_byte FROM r
      UNION ALL SELECT doc_id, max(b), NULL FROM r GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(x, 2 * from_byte + 1, 2 * (coalesce(to_byte, length(x) // 2) - from_byte)), '' ORDER BY from_byte) AS x FROM g JOIN t USING (doc_id) GROUP BY g.doc_id),
n AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(length(t.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(kept.x, t.x))) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN kept ON t.doc_id = kept.doc_id
"""

JACCARD = """
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM t WHERE len(w) > 0),
c AS (SELECT doc_id, g, len(g) AS n, min(doc_id) OVER (PARTITION BY md5(array_to_string(g, chr(10)))) AS text_class FROM s),
e AS (SELECT doc_id, n, unnest(g) AS gram FROM c WHERE doc_id = text_class),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, root) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT t.doc_id, coalesce(roots.root, c.text_class, t.doc_id) AS class_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.text_class, t.doc_id) AS text_class
FROM t LEFT JOIN c ON t.doc_id = c.doc_id LEFT JOIN n ON n.a = c.text_class LEFT JOIN roots ON roots.node = c.text_class
"""

# crc32 bit by bit; pairs of equal words at distance p, whose gapless stretches are the runs
PERIODIC = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w, CAST(doc_id AS VARCHAR) AS s FROM documents),
c(doc_id, s, pos, crc, bits) AS (
  SELECT DISTINCT doc_id, s, 1, xor(4294967295, CAST(ascii(substr(s, 1, 1)) AS BIGINT)), 0 FROM d WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, CASE WHEN bits = 8 THEN pos + 1 ELSE pos END,
         CASE WHEN bits = 8 THEN xor(crc, CAST(ascii(substr(s, pos + 1, 1)) AS BIGINT)) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END, CASE WHEN bits = 8 THEN 0 ELSE bits + 1 END
  FROM c WHERE NOT (bits = 8 AND pos = length(s))
),
h AS (SELECT doc_id, xor(crc, 4294967295) AS h FROM c WHERE bits = 8 AND pos = length(s)),
a AS (SELECT k, d.doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d LEFT JOIN h USING (doc_id)),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT k, doc_id, CASE WHEN n > 0 AND h % 10 = 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
u AS (SELECT k, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
e AS (SELECT x.k, y.i - x.i AS p, x.i FROM u x JOIN u y ON x.k = y.k AND x.word = y.word AND x.i < y.i),
r AS (SELECT k, p, min(i) AS s, count(*) + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY k, p ORDER BY i) AS island FROM e) GROUP BY k, p, island HAVING count(*) >= greatest(p, 12 - p)),
runs AS (SELECT k, s, l, min(p) AS p FROM r GROUP BY k, s, l),
sums AS (SELECT k, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM runs GROUP BY k),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l DESC, s, p) AS nth FROM runs) WHERE nth = 1),
reach AS (SELECT u.k, u.i FROM u JOIN runs ON u.k = runs.k AND u.i >= runs.s + runs.p AND u.i < runs.s + runs.l GROUP BY u.k, u.i),
kept AS (SELECT u.k, string_agg(word, ' ' ORDER BY u.i) AS x FROM u LEFT JOIN reach ON u.k = reach.k AND u.i = reach.i WHERE reach.i IS NULL GROUP BY u.k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
FROM t LEFT JOIN sums ON t.k = sums.k LEFT JOIN best ON t.k = best.k LEFT JOIN kept ON t.k = kept.k
"""

# the same blocks, seats and seeded orders; 262144 is the number of blocks of a mix
MIX = r"""
WITH k AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + nth % 3] AS weight, CAST(sum(words) OVER () AS BIGINT) AS mix FROM s),
l AS (
  SELECT *, CAST(greatest(1, ceil(mix / 262144)) AS BIGINT) AS block,
         (mix - 3 * coalesce(sum(words) OVER (ORDER BY words / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY words / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM w
),
f AS (SELECT *, 3 * words <= rate * weight AS capped FROM l),
g AS (SELECT *, first(CASE WHEN NOT capped THEN rate END) OVER (ORDER BY capped, words / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common FROM f),
t AS (SELECT *, CASE WHEN capped THEN CAST(3 * words AS DOUBLE) ELSE common * weight END AS target, CAST(ceil(words / block) AS BIGINT) AS cuts FROM g),
seats AS (SELECT CAST(floor(coalesce(sum(target) / any_value(block), 0) + 0.5) AS BIGINT) AS n FROM t WHERE NOT capped),
claims AS (SELECT nth, capped, cuts, weight, unnest(range(CASE WHEN capped THEN 3 * cuts ELSE least(3 * cuts, n) END)) AS pick FROM t, seats),
given AS (SELECT nth, cuts, pick FROM (SELECT *, row_number() OVER (PARTITION BY capped ORDER BY weight / (2 * pick + 1) DESC, nth) AS r FROM claims), seats WHERE capped OR r <= n),
turns AS (SELECT nth, pass, b, row_number() OVER (PARTITION BY nth, pass ORDER BY md5('0:' || nth || ':' || pass || ':' || b)) - 1 AS turn
          FROM (SELECT nth, pass, unnest(range(cuts)) AS b FROM t, range(3) AS passes(pass))),
times AS (SELECT turns.nth, b, count(given.nth) AS times FROM turns LEFT JOIN given ON given.nth = turns.nth AND given.pick // given.cuts = pass AND given.pick % given.cuts = turn GROUP BY turns.nth, b),
c AS (SELECT times.nth, b, times, b * block AS from_word,
             coalesce(sum(times * (least((b + 1) * block, words) - b * block)) OVER (PARTITION BY times.nth ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM times JOIN t USING (nth)),
d AS (SELECT k.*, t.nth, t.words, t.target, t.block, sum(size) OVER (PARTITION BY t.nth ORDER BY o ROWS UNBOUNDED PRECEDING) AS x FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target,
       CAST(CASE WHEN size > 0 THEN z.before + z.times * (x - z.from_word) - a.before - a.times * (x - size - a.from_word) ELSE 0 END AS BIGINT) AS taken
FROM d LEFT JOIN c a ON a.nth = d.nth AND a.b = (x - size) // d.block LEFT JOIN c z ON z.nth = d.nth AND z.b = (x - 1) // d.block
"""

NEGATIVES = """
WITH r AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT a.k, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.k <> b.k WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.k, p.nth ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.k = s.k AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.nth <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLES = {
    "op3_warc": WARC,
    "op7_suffix_dedup": SUFFIXES,
    "op9_jaccard_join": JACCARD,
    "op10_license_scan": licenses.ORACLE,
    "op11_periodic_runs": PERIODIC,
    "op12_source_mix": MIX,
    "op13_hard_negatives": NEGATIVES,
}
