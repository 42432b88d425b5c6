"""SQL of the queries that SQL can express, written from their contracts."""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Exact matches by equal slices; the near ones (within a word of their place beside the rarest) by places of words.
CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, list_slice(w, s, s + 9) AS ws FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
one AS (SELECT ws, len(ws) AS n, row_number() OVER () AS id FROM (SELECT DISTINCT ws FROM win)),
cut AS (SELECT rid, s, n, list_slice(w, s + 1, s + n) AS ws FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM one) WHERE len(w) >= n)),
exact AS (SELECT rid, s, n, id FROM cut JOIN one USING (ws, n)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM exact) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM exact JOIN one USING (id) JOIN win ON win.ws = one.ws GROUP BY rid),
post AS (SELECT rid, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
often AS (SELECT word, count(*) AS c FROM post GROUP BY word),
lists AS (SELECT id, n, word, off, row_number() OVER (PARTITION BY id ORDER BY c, word, off) AS k FROM (SELECT id, n, unnest(ws) AS word, unnest(range(0, n)) AS off FROM one) JOIN often USING (word)),
starts AS (SELECT id, n, rid, pos - off AS s FROM lists JOIN post USING (word) WHERE k = 1),
probe AS (SELECT DISTINCT s.id, s.n, s.rid, s.s, l.k FROM starts s JOIN lists l ON l.id = s.id JOIN post p ON p.rid = s.rid AND p.word = l.word AND p.pos - s.s - l.off BETWEEN -1 AND 1),
close AS (SELECT id, rid FROM probe GROUP BY id, n, rid, s HAVING count(*) = n),
near AS (SELECT rid, count(DISTINCT item) AS n_near FROM close JOIN one USING (id) JOIN win ON win.ws = one.ws GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near USING (rid)
"""

#: The unsigned CRC of a word's bytes: by a table of the polynomial's 256 remainders.
_CRC = """
WITH RECURSIVE steps AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i) UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
remainders AS (SELECT list(c ORDER BY byte) AS tbl FROM steps WHERE k = 8),
"""
_BUCKET = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(encode(word))::INT, 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::BIGINT)), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 10000"

RESAMPLING = f"""{_CRC}
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT rid, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
buckets AS (SELECT word, {_BUCKET} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), remainders),
source AS (SELECT bucket, count(*) AS s FROM dw JOIN buckets USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM bw JOIN buckets USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain FROM source LEFT JOIN target USING (bucket)),
weights AS (SELECT rid, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY rid),
scores AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (rid)),
ranks AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM scores WHERE n_features >= 20) // 100 THEN place END AS rank FROM ranks
"""
