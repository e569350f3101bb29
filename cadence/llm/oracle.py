"""DuckDB SQL of the queries that need more than an expression or two: the same
results written the plain way, row by row and string by string."""

from __future__ import annotations

from cadence.llm import conversation_repair as cr
from cadence.llm import spelling
from cadence.llm.suffix_dedup import LENGTH

#: The reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320

#: One row: the table of CRC-32, made by its rule.
CRC_TABLE = f"""crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k : CASE WHEN c & 1 = 1 THEN xor({_POLYNOMIAL}::BIGINT, c >> 1) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS tab
  FROM range(256) r(i))"""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, where ``tab`` of CRC_TABLE is in scope."""
    digits = f"hex(encode({text}))"
    bytes_of = f"list_transform(range(octet_length(encode({text}))), lambda k : ('0x' || substr({digits}, 2 * k + 1, 2))::BIGINT)"
    step = "xor(tab[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce({bytes_of}, lambda c, b : {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def suffix_dedup_sql() -> str:
    """Every string of LENGTH bytes of every document, as hex digits, with the smallest document it starts in."""
    width = 2 * LENGTH
    return f"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, doc_id, p, substr(h, 2 * p + 1, {width}) AS s FROM (SELECT *, unnest(range(n - {LENGTH - 1})) AS p FROM d WHERE n >= {LENGTH})),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT w.rid, w.p FROM w JOIN m USING (s) WHERE m.least < w.doc_id OR (w.doc_id IS NULL AND m.least IS NOT NULL)),
cut AS (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS begins FROM hit),
run AS (SELECT rid, p, sum(begins) OVER (PARTITION BY rid ORDER BY p) AS k FROM cut),
span AS (SELECT rid, k, min(p) AS a, max(p) + {LENGTH} AS b FROM run GROUP BY rid, k),
gap AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS z FROM span),
kept AS (
  SELECT d.rid, string_agg(substr(d.h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(d.h), 2 * max(b) + 1) AS h,
         sum(b - a) AS n_removed, count(*) AS n_spans
  FROM d JOIN gap ON d.rid = gap.rid GROUP BY d.rid)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(kept.n_removed, 0)::BIGINT AS n_removed, coalesce(kept.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.rid = kept.rid"""


def spelling_sql(garble: int) -> str:
    """Words near each other: one is the other without a character, or both are the
    same without the character at one place."""
    h = crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{spelling.LETTERS}')) AS run FROM documents),
hashed AS (SELECT run, {h} AS h FROM runs, crc_table WHERE length(run) >= 5),
damaged AS (SELECT CASE WHEN h % {garble} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
w AS (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
v AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS less FROM (SELECT *, unnest(range(length(word)))::INT AS p FROM w)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.less = b.less AND a.p = b.p AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
near AS (SELECT word, count(*) AS n_near FROM pairs GROUP BY word),
best AS (SELECT word, other, other_n FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) = 1),
form AS (SELECT w.word, w.n, coalesce(near.n_near, 0) AS n_near, CASE WHEN best.other_n >= 2 * w.n THEN best.other END AS form,
                CASE WHEN best.other_n >= 2 * w.n THEN best.other_n END AS form_n
         FROM w LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON walk.at = form.word WHERE form.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN form ON walk.at = form.word WHERE form.form IS NULL)
SELECT form.word, form.form, ends.root, form.n::BIGINT AS n, form.n_near::BIGINT AS n_near, form.form_n::BIGINT AS form_n FROM form JOIN ends USING (word)"""


def conversation_repair_sql() -> str:
    """The cheapest edits by dynamic programming forward, a row at a time: for every
    state of the pattern the least (cost, initials) that leads there."""
    hit = crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    blank = "[\\x20\\x09-\\x0D]"
    # (state in front, state behind, role) of the rows that may be inserted or given another role
    steps = "(VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) nx(q, r, role)"
    kept = "(VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) kp(q, initial, r)"

    def inserted(name: str) -> str:
        """``name`` and all it leads to by inserting up to two rows."""
        once = "SELECT conv_key, i, nx.r AS q, {'cost': x.cost + %d, 'audit': x.audit || 'I', 'lines': list_append(x.lines, nx.role || ':')} AS x FROM %s s JOIN %s ON s.q = nx.q"
        first = once % (cr.INSERT, name, steps)
        second = once % (cr.INSERT, f"({first})", steps)
        return f"SELECT conv_key, i, q, x FROM {name} UNION ALL {first} UNION ALL {second}"

    before = inserted("st")
    edits = f"""SELECT b.conv_key, b.i, b.q, {{'cost': x.cost + {cr.DELETE}, 'audit': x.audit || 'D', 'lines': x.lines}} AS x, f.i AS row_no
      FROM ({before}) b JOIN f ON f.conv_key = b.conv_key AND f.i = b.i + 1
      UNION ALL SELECT b.conv_key, b.i, kp.r, {{'cost': x.cost + f.cut::INT, 'audit': x.audit || 'K', 'lines': list_append(x.lines, f.role || ':' || f.text)}}, f.i
      FROM ({before}) b JOIN f ON f.conv_key = b.conv_key AND f.i = b.i + 1 JOIN {kept} ON kp.q = b.q AND kp.initial = left(f.role, 1) WHERE NOT f.must_go
      UNION ALL SELECT b.conv_key, b.i, nx.r, {{'cost': x.cost + {cr.REROLE} + f.cut::INT, 'audit': x.audit || 'R', 'lines': list_append(x.lines, nx.role || ':' || f.text)}}, f.i
      FROM ({before}) b JOIN f ON f.conv_key = b.conv_key AND f.i = b.i + 1 JOIN {steps} ON nx.q = b.q WHERE NOT f.must_go"""
    return f"""WITH RECURSIVE {CRC_TABLE},
hits AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {hit} % 20 AS hit FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS conv_key, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) FROM hits WHERE hit <> 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_key ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i,
         NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, regexp_matches(text, '[^.!?\\x20\\x09-\\x0D]{blank}*\\z') AS cut_off
  FROM damaged),
faults AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_key, role, text ORDER BY i) > 1 AS duplicate,
         lag(left(role, 1)) OVER (PARTITION BY conv_key ORDER BY i) AS initial_before
  FROM placed),
f AS (SELECT *, blank OR duplicate AS must_go, NOT blank AND NOT duplicate AND cut_off AS cut FROM faults),
counts AS (
  SELECT conv_key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
         count_if(cut) AS truncated, count_if(initial_before IS NOT NULL AND initial_before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last
  FROM f GROUP BY conv_key),
st AS (
  SELECT DISTINCT conv_key, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS x FROM f
  UNION ALL
  SELECT conv_key, row_no, q, arg_min(x, (x.cost, x.audit)) FROM ({edits}) GROUP BY conv_key, row_no, q),
fin AS (SELECT s.conv_key, arg_min(x, (x.cost, x.audit)) AS x FROM ({before}) s JOIN counts c ON s.conv_key = c.conv_key AND s.i = c.last WHERE s.q IN (0, 3) GROUP BY s.conv_key)
SELECT e.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(fin.x.cost, 0)::BIGINT AS cost,
       coalesce(fin.x.audit, '') AS audit, sha256(coalesce(array_to_string(fin.x.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS conv_key FROM conversations) e
LEFT JOIN counts c USING (conv_key) LEFT JOIN fin USING (conv_key)"""
