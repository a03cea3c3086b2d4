"""The subpackage's queries as SQL for another engine, where SQL can say them."""

from __future__ import annotations

from steadyield.llm.feistel_shards import KEYS, SHARDS
from steadyield.llm.secret_scan import RULES
from steadyield.llm.source_mix import SEED

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# with every rule of the cascade spelled out; the order of the rules has no bearing on the verdict
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
tri AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
tri2 AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM tri),
often AS (SELECT r, i FROM tri2 QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
line AS (SELECT r, unnest(l) AS x FROM d),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered
  FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR (n_upper > n_lower AND 4 * n_upper > word_chars) OR 2 * n_lettered < n_words OR 2 * n_dup_lines > greatest(n_lines, 4) OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b"""

MIX = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}') AS place FROM documents),
s0 AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, row_number() OVER w AS k, coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM s1 WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST)),
f AS (SELECT min_by(before, k) AS before, min_by(left_weight, k) AS left_weight, min(k) AS k FROM s2 WHERE CAST(3 * source_size AS DOUBLE) * left_weight > CAST(total - before AS DOUBLE) * weight),
s AS (SELECT s2.source, source_size, CASE WHEN f.k IS NULL OR s2.k < f.k THEN CAST(3 * source_size AS DOUBLE) ELSE CAST((total - f.before) * weight AS DOUBLE) / CAST(f.left_weight AS DOUBLE) END AS target FROM s2, f),
q AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT q.doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  size * len(list_filter([0, 1, 2], lambda p: size > 0 AND CAST(2 * (p * source_size + upto) - size AS DOUBLE) < 2 * target)) AS taken
FROM q JOIN s ON s.source IS NOT DISTINCT FROM q.source"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
n AS (SELECT payload_digest, max(page_id) AS newest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN newest IS NULL OR newest = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN newest <> page_id THEN newest END AS refers_to
FROM p LEFT JOIN n USING (payload_digest)"""


def _spans(rank: int, kind: str, pattern: str, least: int, group: int, any_case: bool) -> str:
    """Matches and the texts between them give the places: what stands before the k-th match is gaps and matches before it."""
    quoted = pattern.replace("'", "''")
    flags = ", 'i'" if any_case else ""
    # the engine's split knows no flags, so case folding goes into the pattern
    inline = ("(?i)" if any_case else "") + quoted
    value = f"regexp_extract(m, '{quoted}', {group}{flags})" if group else "m"
    return f"""
SELECT r, {rank} AS rank, '{kind}' AS kind, s AS start, s + len(m) AS stop FROM (
  SELECT r, ms[k] AS m, list_sum(list_transform(gaps[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: len(x))), 0) AS s
  FROM (SELECT r, regexp_extract_all(t, '{quoted}', 0{flags}) AS ms, regexp_split_to_array(t, '{inline}') AS gaps, unnest(range(1, len(ms) + 1)) AS k FROM d))
WHERE len({value}) >= {least}"""


SECRETS = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(_spans(k, r.kind, r.pattern, r.min_chars, r.group, r.any_case) for k, r in enumerate(RULES))
    + """), g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, rank) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""
)


def _step(k: int, source: str) -> str:
    """One round of the network as a named step, so that no expression is repeated within another."""
    key = KEYS[k]
    return f"SELECT i, half, n, r AS l, xor(l, ((xor(m >> 15, m) * {0x2545F}) & 2147483647) >> 3 & ((1::BIGINT << half) - 1)) AS r FROM (SELECT *, ((r + 1) * {key} + {key >> 7}) & 2147483647 AS m FROM {source})"


_PASS = "SELECT i, half, n, (l << half) | r AS p FROM (" + _step(3, "(" + _step(2, "(" + _step(1, "(" + _step(0, "(SELECT i, half, n, p >> half AS l, p & ((1::BIGINT << half) - 1) AS r FROM {rows})") + ")") + ")") + ")") + ")"

# the checksum goes bit by bit through eight-entry steps of its polynomial, byte after byte
SHARD_SQL = f"""
WITH RECURSIVE code AS (SELECT list(c ORDER BY b) AS table_ FROM (SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
d0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, octet_length(encode(t)) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(t))), lambda k: CAST(('0x' || substr(hex(encode(t)), 2 * k + 1, 2)) AS BIGINT))), lambda c, x: xor(c >> 8, table_[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d0, code),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS i FROM d),
total AS (SELECT count(*) AS n FROM d),
width AS (SELECT n, greatest(1, (len(bin(greatest(n - 1, 1))) + 1) // 2) AS half FROM total),
walk(i, half, n, p) AS (
  SELECT * FROM ({_PASS.format(rows="(SELECT i, half, n, i AS p FROM numbered, width)")})
  UNION ALL SELECT * FROM ({_PASS.format(rows="(SELECT i, half, n, p FROM walk WHERE p >= n)")}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {SHARDS} AS INTEGER) AS shard, p // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM numbered JOIN (SELECT * FROM walk WHERE p < n) USING (i)"""

# each control string that is escaped gets one more character
CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len('<|turn|><|text|><|end|>') + len(role) + len(text) + len(regexp_extract_all(role, '{p}')) + len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""".replace("{p}", r"<\\*(?:\|turn\||\|text\||\|end\||\|endoftext\||/?s)>|\[\\*/?INST\]")

# cheapest edits of all beginnings, by the state that they end in; texts ride along
_I = "CASE WHEN {0} IS NOT NULL THEN {{'c': {0}.c + 3, 'e': {0}.e || 'I', 't': list_append({0}.t, '{1}:')}} END"
_D = "CASE WHEN {0} IS NOT NULL THEN {{'c': {0}.c + 4, 'e': {0}.e || 'D', 't': {0}.t}} END"
_R = "CASE WHEN {0} IS NOT NULL AND fault < 2 THEN {{'c': {0}.c + 3 + 3 * fault, 'e': {0}.e || 'R', 't': list_append({0}.t, '{1}:' || text)}} END"
_K = "CASE WHEN {0} IS NOT NULL AND fault < 2 AND initial = '{1}' THEN {{'c': {0}.c + 3 * fault, 'e': {0}.e || 'K', 't': list_append({0}.t, role || ':' || text)}} END"
_LEAST = lambda *offers: "list_min(list_filter([" + ", ".join(offers) + "], lambda x: x IS NOT NULL))"
_INSERTED = f"(SELECT * REPLACE ({_LEAST('v3', _I.format('v2', 'assistant'))} AS v3) FROM (SELECT * REPLACE ({_LEAST('v2', *(_I.format(v, 'user') for v in ('v0', 'v1', 'v3')))} AS v2) FROM ROWS))"
REPAIR = f"""
WITH RECURSIVE code AS (SELECT list(c ORDER BY b) AS table_ FROM (SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
hit AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(k)), lambda j: CAST(('0x' || substr(hex(k), 2 * j + 1, 2)) AS BIGINT))), lambda c, x: xor(c >> 8, table_[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS damage FROM keyed, code),
d0 AS (SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE damage WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE damage <> 0),
d1 AS (SELECT *, row_number() OVER w AS n, lag(role[1]) OVER w AS before, role[1] AS initial, regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS has, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy)),
d AS (SELECT *, CASE WHEN NOT has THEN 3 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 1 ELSE 0 END AS fault FROM d1),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM d GROUP BY conv_id),
nothing AS (SELECT CAST(NULL AS STRUCT(c BIGINT, e VARCHAR, t VARCHAR[])) AS v),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST({{'c': 0, 'e': '', 't': []}} AS STRUCT(c BIGINT, e VARCHAR, t VARCHAR[])) AS v0, v AS v1, v AS v2, v AS v3 FROM figures, nothing
  UNION ALL
  SELECT conv_id, n, {_D.format('v0')}, {_LEAST(_D.format('v1'), _K.format('v0', 's'))}, {_LEAST(_D.format('v2'), *(f.format(v, x) for v in ('v0', 'v1', 'v3') for f, x in ((_K, 'u'), (_R, 'user'))))}, {_LEAST(_D.format('v3'), _K.format('v2', 'a'), _R.format('v2', 'assistant'))}
  FROM {_INSERTED.replace('ROWS', "(SELECT d.conv_id, d.n, d.role, d.text, d.initial, d.fault, v0, v1, v2, v3 FROM paths JOIN d ON d.conv_id IS NOT DISTINCT FROM paths.conv_id AND d.n = paths.n + 1)")}),
ended AS (SELECT conv_id, {_LEAST('v0', 'v3')} AS v FROM {_INSERTED.replace('ROWS', "(SELECT paths.* FROM paths JOIN figures f ON f.conv_id IS NOT DISTINCT FROM paths.conv_id AND f.n = paths.n)")})
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.c, 0) AS cost, coalesce(v.e, '') AS audit, sha256(coalesce(array_to_string(v.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""

SQL = {"op12_chat_format": CHAT, "op13_conversation_repair": REPAIR, "op3_quality_rules": QUALITY, "op4_source_mix": MIX, "op5_warc": WARC, "op7_feistel_shards": SHARD_SQL, "op10_secret_scan": SECRETS}
