"""DuckDB SQL for those of the opN queries that SQL can express.

Written from the definitions of the results, not from the operators: payloads are compared as whole
texts, a mix is one running number for each source, words are compared as words and not as hashes,
and spans come from the expressions without an index.
"""

from __future__ import annotations

W = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM d
"""

MIX = rf"""
WITH s AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    coalesce(len(regexp_extract_all(text, '{W}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, floor(sqrt(size) * 4)::BIGINT AS klass,
    ('0x' || substr(h, 1, 8))::BIGINT % greatest(1, least(4096, (SELECT count(*) FROM s) // 2000)) AS part FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY klass, part, size, h, doc_id) AS rank FROM k),
w AS (SELECT skey, sum(size)::BIGINT AS source_size FROM s GROUP BY skey),
v AS (SELECT skey, source_size, ([3, 1, 2][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT])::DOUBLE AS weight, source_size::DOUBLE * 2 AS most FROM w),
r AS (SELECT *, most / weight AS room FROM v),
-- The level at which the sources that are not full share: the least room-ordered level that does not exceed its room.
t AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM r WINDOW before AS (ORDER BY room, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT room AS at_room, skey AS at_key, level AS found FROM t WHERE level <= room ORDER BY room, skey LIMIT 1),
g AS (SELECT t.skey, source_size, CASE WHEN room > at_room OR (room = at_room AND skey >= at_key) THEN found * weight ELSE most END AS target FROM t LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(2::DOUBLE, target / source_size) ELSE 0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix' || skey), 1, 8))::BIGINT / 4294967296::DOUBLE AS first FROM g),
c AS (SELECT doc_id, size, source_size, target, (floor(rate * rank + first) - floor(rate * (rank - 1) + first))::BIGINT AS copies FROM o JOIN e USING (skey))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""


def _either(word: str) -> str:
    """A word, each letter in either case: `(?i)` would let other letters of Unicode in."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = rf"({'|'.join(_either(w) for w in ('password', 'passwd', 'secret', 'token', 'api_?key'))})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
#: Kind, expression, group that counts, its least length. A run of hexadecimal digits is whole, so its least length may stand in the expression.
_KINDS = [
    ("assign", _ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", "sk_live_[A-Za-z0-9]{24,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
]


def _matches(rank: int, kind: str, regex: str, group: int, least: int) -> str:
    pieces = f"""SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(g) AS g, unnest(b[1:len(m)]) AS b FROM (
        SELECT r, regexp_extract_all(text, '{regex}') AS m, regexp_extract_all(text, '{regex}', {group}) AS g, regexp_split_to_array(text, '{regex}') AS b
        FROM d WHERE regexp_matches(text, '{regex}'))"""
    return f"""SELECT r, '{kind}' AS kind, {rank} AS rank, stop - length(m) AS start, stop FROM (
        SELECT r, m, g, sum(length(b) + length(m)) OVER (PARTITION BY r ORDER BY i) AS stop FROM ({pieces})) WHERE length(g) >= {least}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_matches(i, *k) for i, k in enumerate(_KINDS))}),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, regexp_extract_all(text, '{W}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{W}')) AS lines FROM d),
m AS (SELECT r, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{SPACES}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_case, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS alpha, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM l),
w AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS w FROM l),
n AS (SELECT r, i, w, lag(w) OVER o AS last, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2, w3, w4) AS n FROM n WHERE w4 IS NOT NULL),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM g WHERE n > 1) GROUP BY r),
q AS (SELECT r, count(*) FILTER (w = last) AS stutters, count(DISTINCT w) AS different FROM n GROUP BY r),
b AS (SELECT m.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
    coalesce(stutters, 0) AS stutters, coalesce(different, 0) AS different, word_chars::DOUBLE / greatest(n_words, 1) AS mean FROM m LEFT JOIN p USING (r) LEFT JOIN q USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.2::DOUBLE * n_words OR (n_lines >= 4 AND n_dup_lines > 0.5::DOUBLE * n_lines) OR mean < 2 OR mean > 16
    OR (alpha >= 20 AND upper_case > 0.4::DOUBLE * alpha) OR digits > 0.5::DOUBLE * greatest(word_chars, 1) OR stutters > 0.3::DOUBLE * n_words
    OR (n_words >= 40 AND different < least(0.3::DOUBLE * n_words, 2.0::DOUBLE * sqrt(n_words)))) AS kept
FROM b
"""

COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM s, (VALUES (1), (2), (3)) AS t(k)) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, any_value(k) AS k, any_value(a) AS a,
    min(struct_pack(score := (1000000::HUGEINT * a * a) // (l::HUGEINT * r), cut := cut, l := l, r := r)) AS best FROM (
    SELECT c.*, cut, x.f AS l, y.f AS r FROM c JOIN (VALUES (1), (2)) AS t(cut) ON cut < k
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')) GROUP BY lang, phrase),
m AS (SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT cuts.lang, cuts.phrase, a, best, row_number() OVER (PARTITION BY cuts.lang ORDER BY best.score DESC, a DESC, cuts.phrase) AS rank
    FROM cuts LEFT JOIN m ON m.lang = cuts.lang AND m.phrase = cuts.phrase WHERE k = 3 OR coalesce(100 * longest, 0) < 50 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, best.l::BIGINT AS l, best.r::BIGINT AS r, n::BIGINT AS n, best.score::BIGINT AS score
FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

SQL: dict[str, str] = {
    "op3_warc_records": WARC,
    "op6_source_mix": MIX,
    "op8_secret_scan": SECRETS,
    "op9_quality_cascade": QUALITY,
    "op13_collocations": COLLOCATIONS,
}
