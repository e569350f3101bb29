"""DuckDB SQL for every named query of ``plans/catalog.py``: the same result
written the plain way (join first, group, window), used as the correctness
oracle. Tables are the driver's views of the same Parquet files.

Conventions: sums are exact at two decimals -- here over DECIMAL(18,2), on the
Spark side over BIGINT cents -- and cast to DOUBLE (0 when empty); averages
are DOUBLE sum / count; calendar parts are INTEGER; the values of a series are
added in the order of its hours.
"""

from __future__ import annotations

# ------------------------------------------------------------------ bindings
Y = """SELECT l.l_orderkey AS key, l.l_shipdate AS ts, l.l_suppkey AS id,
       s.s_name AS entity, l.l_quantity AS v
FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey"""

O = """SELECT o.o_orderkey AS key, o.o_orderdate AS ts, o.o_custkey AS id,
       c.c_name AS entity, o.o_totalprice AS v
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"""

H = """SELECT event_id AS key, ts, user_id AS id, event_type AS entity, value AS v
FROM events"""

H2 = """SELECT event_id AS key,
       CASE WHEN user_id % 2 = 0 THEN ts - INTERVAL 1 YEAR ELSE ts END AS ts,
       user_id AS id, event_type AS entity, value AS v
FROM events"""

D_RAW = """SELECT event_id AS key, user_id AS id, event_type AS entity,
       CASE WHEN event_id % 97 = 0 THEN 'not a time'
            ELSE strftime(date_trunc('second', ts), '%m/%d/%Y %I:%M:%S %p') END AS ts_text,
       CASE WHEN event_id % 89 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS v_text
FROM events"""


def _num(t: str) -> str:
    """Lenient text -> DOUBLE (empty, NaN, junk -> NULL)."""
    x = f"TRY_CAST(trim({t}) AS DOUBLE)"
    return f"(CASE WHEN {t} IS NULL OR trim({t}) = '' OR isnan({x}) THEN NULL ELSE {x} END)"


D = f"""SELECT key, id, entity,
       COALESCE(try_strptime(ts_text, '%m/%d/%Y %I:%M:%S %p'), TRY_CAST(ts_text AS TIMESTAMP)) AS ts,
       {_num('v_text')} AS v
FROM ({D_RAW})"""

SUM = "SUM(CAST(v AS DECIMAL(18,2)))"
TOTAL = f"COALESCE(CAST({SUM} AS DOUBLE), 0.0)"


def _label(h: str) -> str:
    return (
        f"(CAST(CASE WHEN {h} % 12 = 0 THEN 12 ELSE {h} % 12 END AS VARCHAR)"
        f" || CASE WHEN {h} < 12 THEN ' AM' ELSE ' PM' END)"
    )


def _season(m: str) -> str:
    return (
        f"(CASE WHEN {m} IN (12, 1, 2) THEN 'Winter' WHEN {m} IN (3, 4, 5) THEN 'Spring' "
        f"WHEN {m} IN (6, 7, 8) THEN 'Summer' WHEN {m} IN (9, 10, 11) THEN 'Fall' END)"
    )


def _sanitize(c: str) -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
    return (
        f"COALESCE(substring(trim(translate({c}, '/\\*[]:?'',.', '---()-----'), {blanks}), 1, 31),"
        f" 'Unknown_Station')"
    )


def _years(a: int, b: int) -> str:
    """a <= year(ts) <= b as a timestamp range."""
    return f"ts >= TIMESTAMP '{a}-01-01 00:00:00' AND ts < TIMESTAMP '{b + 1}-01-01 00:00:00'"


YR = "CAST(year(ts) AS INTEGER)"
MO = "CAST(month(ts) AS INTEGER)"
HR = "CAST(hour(ts) AS INTEGER)"

ENTITY_TOTALS_9697 = f"""SELECT {YR} AS year, entity, {TOTAL} AS total
FROM ({Y}) WHERE {_years(1996, 1997)} AND entity IS NOT NULL GROUP BY 1, 2"""


def _share(binding: str, scale: str) -> str:
    return f"""WITH f AS (SELECT {YR} AS year, entity, v FROM ({binding}) WHERE {_years(1996, 1997)}),
e AS (SELECT year, entity, {TOTAL} AS total FROM f WHERE entity IS NOT NULL GROUP BY 1, 2),
t AS (SELECT year, {TOTAL} AS group_total FROM f GROUP BY 1)
SELECT e.year, e.entity, e.total,
       (CASE WHEN t.group_total > 0 THEN e.total / t.group_total ELSE 0.0 END){scale}
FROM e JOIN t ON e.year = t.year"""


SEASON_SUMS = f"""es AS (
  SELECT year, season, entity, SUM(CAST(v AS DECIMAL(18,2))) AS s FROM (
    SELECT {YR} AS year, {_season('month(ts)')} AS season, entity, v
    FROM ({Y}) WHERE {_years(1996, 1997)}) q
  WHERE season IS NOT NULL AND entity IS NOT NULL GROUP BY 1, 2, 3)"""

SEASON_CELLS = ", ".join(
    f"COALESCE(CAST(SUM(CASE WHEN season = '{n}' THEN s END) AS DOUBLE), 0.0) AS \"{n}\""
    for n in ["Winter", "Spring", "Summer", "Fall"]
)


def _series(where: str, having: str, first_seen: bool = False) -> str:
    part = "PARTITION BY year, month, id, entity ORDER BY hour"
    seen = "CASE WHEN v IS NOT NULL THEN hour END"
    if first_seen:
        # one series per (year, month, id), named by the earliest row
        f = f"""f AS (
  SELECT {YR} AS year, {MO} AS month, {HR} AS hour, id, ts, entity, v
  FROM ({H}) WHERE ts IS NOT NULL AND id IS NOT NULL {where}),
nm AS (SELECT year, month, id, min({{'ts': ts, 'e': entity}}).e AS entity FROM f GROUP BY 1, 2, 3),
g AS (SELECT f.year, f.month, f.id, nm.entity, f.hour,
             CASE WHEN COUNT(f.v) > 0 THEN CAST(SUM(CAST(f.v AS DECIMAL(18,2))) AS DOUBLE) / COUNT(f.v) END AS v
      FROM f JOIN nm ON f.year = nm.year AND f.month = nm.month AND f.id = nm.id
      GROUP BY 1, 2, 3, 4, 5),"""
    else:
        f = f"""f AS (
  SELECT {YR} AS year, {MO} AS month, {HR} AS hour, id, entity, v
  FROM ({H}) WHERE ts IS NOT NULL AND id IS NOT NULL AND entity IS NOT NULL {where}),
g AS (SELECT year, month, id, entity, hour,
             CASE WHEN COUNT(v) > 0 THEN CAST({SUM} AS DOUBLE) / COUNT(v) END AS v
      FROM f GROUP BY 1, 2, 3, 4, 5),"""
    return f"""WITH {f}
c AS (SELECT year, month, id, entity, COUNT(v) AS n_slots FROM g GROUP BY 1, 2, 3, 4 {having}),
sp AS (SELECT c.*, CAST(h.range AS INTEGER) AS hour FROM c, range(24) h),
j AS (SELECT sp.year, sp.month, sp.id, sp.entity, sp.n_slots, sp.hour, g.v
      FROM sp LEFT JOIN g ON sp.year = g.year AND sp.month = g.month AND sp.id = g.id
                          AND sp.entity = g.entity AND sp.hour = g.hour),
w AS (SELECT *,
        last_value(v IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
        last_value({seen} IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ph,
        first_value(v IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
        first_value({seen} IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nh
      FROM j),
x AS (SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
                     ELSE pv + (nv - pv) * (hour - ph) / (nh - ph) END AS filled FROM w)
SELECT year, month, id, entity, hour, {_label('hour')} AS label, v, filled,
       m.mean, n_slots
FROM x JOIN (SELECT year, month, id, entity,
                    CASE WHEN COUNT(filled) > 0
                         THEN list_reduce(list(filled ORDER BY hour) FILTER (WHERE filled IS NOT NULL),
                                          lambda a, b : a + b) / COUNT(filled) END AS mean
             FROM x GROUP BY 1, 2, 3, 4) m USING (year, month, id, entity)"""


HOUR_SUMS_H = f"""SELECT entity, {HR} AS hour, {TOTAL} AS total, COUNT(v) AS n
FROM ({H}) WHERE ts IS NOT NULL AND entity IS NOT NULL GROUP BY 1, 2"""

ORACLE: dict[str, str] = {
    "totals_by_year": f"""WITH t AS (SELECT {YR} AS year, {TOTAL} AS total FROM ({Y})
  WHERE {_years(1994, 2002)} GROUP BY 1),
y AS (SELECT CAST(range AS INTEGER) AS year FROM range(1994, 2003))
SELECT y.year, COALESCE(t.total, 0.0) AS total FROM y LEFT JOIN t ON y.year = t.year""",
    "entity_totals": ENTITY_TOTALS_9697,
    "entity_share": _share(Y, " AS share"),
    "entity_share_pct": _share(O, " * 100 AS pct"),
    "top15_by_year": f"""SELECT year, CAST(rn AS INTEGER) AS rank, entity, total FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY total DESC, entity ASC) AS rn
  FROM ({ENTITY_TOTALS_9697}) e) r WHERE rn <= 15""",
    "top10_rank_aligned": f"""WITH r AS (
  SELECT year, entity, total,
         row_number() OVER (PARTITION BY year ORDER BY total DESC, entity ASC) AS rn
  FROM ({ENTITY_TOTALS_9697}) e),
a AS (SELECT rn, entity AS entity_a, total AS total_a FROM r WHERE year = 1996 AND rn <= 10),
b AS (SELECT rn, entity AS entity_b, total AS total_b FROM r WHERE year = 1997 AND rn <= 10)
SELECT CAST(COALESCE(a.rn, b.rn) AS INTEGER) AS rank, entity_a, total_a, entity_b, total_b
FROM a FULL OUTER JOIN b ON a.rn = b.rn""",
    "top10_entity_aligned": f"""WITH e AS ({ENTITY_TOTALS_9697}),
a AS (SELECT entity, total AS total_a FROM (
        SELECT *, row_number() OVER (ORDER BY total DESC, entity ASC) AS rn FROM e WHERE year = 1996) q
      WHERE rn <= 10),
b AS (SELECT entity, total AS total_b FROM e WHERE year = 1997)
SELECT a.entity, a.total_a, COALESCE(b.total_b, 0.0) AS total_b FROM a LEFT JOIN b ON a.entity = b.entity""",
    "season_matrix": f"""WITH {SEASON_SUMS}
SELECT year, entity, {SEASON_CELLS} FROM es GROUP BY 1, 2""",
    "season_compare": f"""WITH {SEASON_SUMS},
p AS (SELECT season, SUM(CASE WHEN year = 1996 THEN s END) AS a,
             SUM(CASE WHEN year = 1997 THEN s END) AS b FROM es GROUP BY 1),
c AS (SELECT * FROM (VALUES (0, 'Winter'), (1, 'Spring'), (2, 'Summer'), (3, 'Fall')) t(slot, season))
SELECT CAST(c.slot AS INTEGER) AS slot, c.season,
       COALESCE(CAST(p.a AS DOUBLE), 0.0) AS y1996, COALESCE(CAST(p.b AS DOUBLE), 0.0) AS y1997
FROM c LEFT JOIN p ON c.season = p.season""",
    "season_top5": f"""WITH {SEASON_SUMS},
w AS (SELECT year, entity, {SEASON_CELLS}, COALESCE(CAST(SUM(s) AS DOUBLE), 0.0) AS total
      FROM es GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY total DESC, entity ASC) AS rn FROM w)
SELECT year, CAST(rn AS INTEGER) AS rank, entity, "Winter", "Spring", "Summer", "Fall", total,
       MAX(greatest("Winter", "Spring", "Summer", "Fall")) OVER () AS peak
FROM r WHERE rn <= 5""",
    "weekday_avg": f"""WITH d AS (
  SELECT {YR} AS year, CAST(isodow(ts) - 1 AS INTEGER) AS slot, CAST(ts AS DATE) AS date,
         SUM(CAST(v AS DECIMAL(18,2))) AS s
  FROM ({O}) WHERE {_years(1996, 1997)} GROUP BY 1, 2, 3),
m AS (SELECT year, slot, COALESCE(CAST(SUM(COALESCE(s, 0)) AS DOUBLE), 0.0) / COUNT(*) AS avg_total
      FROM d GROUP BY 1, 2),
c AS (SELECT y.year, w.slot, w.day FROM (VALUES (1996), (1997)) y(year),
      (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'),
              (5, 'Saturday'), (6, 'Sunday')) w(slot, day))
SELECT CAST(c.year AS INTEGER) AS year, CAST(c.slot AS INTEGER) AS slot, c.day, m.avg_total
FROM c LEFT JOIN m ON c.year = m.year AND c.slot = m.slot""",
    "hour_avg_by_entity_year": f"""SELECT year, entity, hour,
       CASE WHEN COUNT(v) > 0 THEN CAST({SUM} AS DOUBLE) / COUNT(v) ELSE 0.0 END AS avg
FROM (SELECT {YR} AS year, {HR} AS hour, id, entity, v FROM ({H2})
      WHERE {_years(2023, 2024)} AND id IS NOT NULL AND entity IS NOT NULL) f
GROUP BY year, id, entity, hour""",
    "hour_avg_by_entity": f"""SELECT id, entity, {HR} AS hour,
       CASE WHEN COUNT(v) > 0 THEN CAST({SUM} AS DOUBLE) / COUNT(v) END AS avg
FROM ({H}) WHERE ts IS NOT NULL AND id IS NOT NULL AND entity IS NOT NULL GROUP BY 1, 2, 3""",
    "hour_profile": f"""WITH p AS (SELECT {HR} AS hour, {TOTAL} / COUNT(*) AS avg_per_row
  FROM ({H}) WHERE ts IS NOT NULL GROUP BY 1),
h AS (SELECT CAST(range AS INTEGER) AS hour, CAST((range + 23) % 24 AS INTEGER) AS slot FROM range(24))
SELECT h.slot, h.hour, p.avg_per_row FROM h LEFT JOIN p ON h.hour = p.hour""",
    "hour_sum_subset": f"""SELECT {HR} AS hour, {TOTAL} AS total FROM ({H})
WHERE entity IN ('click', 'view') AND ts IS NOT NULL GROUP BY 1""",
    "network_hour_curve": f"""WITH m AS (
  SELECT {YR} AS year, {HR} AS hour,
         CASE WHEN COUNT(v) > 0 THEN CAST({SUM} AS DOUBLE) / COUNT(v) END AS avg
  FROM ({H2}) WHERE {_years(2023, 2024)} GROUP BY 1, 2),
w AS (SELECT hour, MAX(CASE WHEN year = 2023 THEN avg END) AS y2023,
             MAX(CASE WHEN year = 2024 THEN avg END) AS y2024 FROM m GROUP BY 1),
h AS (SELECT CAST(range AS INTEGER) AS hour, {_label('range')} AS label FROM range(24))
SELECT h.hour, h.label, w.y2023, w.y2024 FROM h LEFT JOIN w ON h.hour = w.hour""",
    "monthly_series": _series("", "HAVING COUNT(v) >= 12"),
    "monthly_series_all": _series("", ""),
    "monthly_series_one_month": _series(
        "AND ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-02-01 00:00:00'", ""
    ),
    "profile_readback": f"""SELECT id, entity, {_sanitize('entity')} AS clean_name, hour, {_label('hour')} AS label,
       CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / n END AS avg
FROM (SELECT {YR} AS year, id, entity, {HR} AS hour, {SUM} AS s, COUNT(v) AS n
      FROM ({H}) WHERE ts IS NOT NULL AND id IS NOT NULL AND entity IS NOT NULL GROUP BY 1, 2, 3, 4) g
WHERE year = 2024""",
    "clean_facts": f"""SELECT key AS event_id, ts, v AS value FROM ({D}) d
WHERE ts IS NOT NULL AND v IS NOT NULL""",
    "quality_counts": f"""SELECT COUNT(*) AS rows,
       COUNT(*) FILTER (WHERE ts IS NULL) AS bad_ts,
       COUNT(*) FILTER (WHERE v IS NULL) AS bad_value,
       COUNT(*) FILTER (WHERE ts IS NOT NULL AND v IS NOT NULL) AS kept,
       CASE WHEN COUNT(*) > 0
            THEN COUNT(*) FILTER (WHERE ts IS NOT NULL AND v IS NOT NULL) / COUNT(*) ELSE 0.0 END AS valid_ratio,
       MIN(ts) AS min_ts, MAX(ts) AS max_ts,
       MIN(CASE WHEN ts IS NOT NULL AND v IS NOT NULL THEN ts END) AS min_kept_ts,
       MAX(CASE WHEN ts IS NOT NULL AND v IS NOT NULL THEN ts END) AS max_kept_ts
FROM ({D}) d""",
    "rows_per_year": f"""SELECT {YR} AS year, COUNT(*) AS rows FROM ({Y}) y WHERE ts IS NOT NULL GROUP BY 1""",
    "regex_year_hour12": f"""SELECT year, clock_hour12, {TOTAL} AS total FROM (
  SELECT TRY_CAST(regexp_extract(ts_text, '(\\d{{4}})', 1) AS INTEGER) AS year,
         TRY_CAST(regexp_extract(ts_text, '\\d+/\\d+/\\d+\\s+(\\d+):\\d+:\\d+', 1) AS INTEGER) AS clock_hour12,
         {_num('v_text')} AS v
  FROM ({D_RAW}) r) p
WHERE year IS NOT NULL AND clock_hour12 IS NOT NULL GROUP BY 1, 2""",
    "entity_directory": f"SELECT DISTINCT id, entity FROM ({O}) o",
    "first_month_rows": f"""WITH f AS ({O}),
fm AS (SELECT id, MIN(date_trunc('month', ts)) AS first_month FROM f
       WHERE id IS NOT NULL AND ts IS NOT NULL GROUP BY id)
SELECT f.key, f.id, {YR.replace('ts', 'f.ts')} AS year, {MO.replace('ts', 'f.ts')} AS month, f.v
FROM f JOIN fm ON f.id = fm.id AND date_trunc('month', f.ts) = fm.first_month""",
    "entity_range_extract": f"""SELECT key, id, ts, v FROM ({O}) o
WHERE id IN (10, 20) AND ts BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 23:59:59'""",
    "page_extract": f"""SELECT key, ts, v FROM ({O}) o
WHERE ts BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 23:59:59'
ORDER BY ts, key LIMIT 100 OFFSET 200""",
    "sanitized_names": f"""SELECT url AS raw, {_sanitize('url')} AS clean FROM pages
UNION ALL SELECT p_type AS raw, {_sanitize('p_type')} AS clean FROM part""",
    "label_text": f"""WITH t AS (SELECT {YR} AS year, {SUM} AS s FROM ({Y}) WHERE ts IS NOT NULL GROUP BY 1),
u AS (SELECT year, COALESCE(CAST(s AS DOUBLE), 0.0) AS total,
             COALESCE(CAST(SUM(s) OVER () AS DOUBLE), 0.0) AS grand FROM t)
SELECT year, format('{{:,.0f}}', total) AS total_text, printf('%.2f', total) AS total_2dp,
       printf('%.2f%%', floor((CASE WHEN grand > 0 THEN total / grand ELSE 0.0 END) * 10000.0 + 0.5) / 100.0)
         AS pct_text,
       CAST(year AS VARCHAR) || ': ' || format('{{:,.0f}}', total) AS title
FROM u""",
    "merge_partials": HOUR_SUMS_H,
    "outer_add": f"""SELECT {HR} AS hour, {TOTAL} AS total FROM ({H}) WHERE ts IS NOT NULL GROUP BY 1""",
    "months_seen": f"""SELECT DISTINCT {YR} AS year, {MO} AS month FROM (
  SELECT l_shipdate AS ts FROM lineitem UNION ALL SELECT o_orderdate AS ts FROM orders) u
WHERE ts IS NOT NULL""",
    "running_hour_state": HOUR_SUMS_H,
    "append_pages": """SELECT event_type AS entity, COUNT(*) AS rows FROM events
WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1""",
    "report_bundle": ENTITY_TOTALS_9697,
}
ORACLE["peak_hours"] = f"""WITH a AS (
  SELECT year, id, entity, hour, CAST({SUM} AS DOUBLE) / COUNT(v) AS avg
  FROM (SELECT {YR} AS year, {HR} AS hour, id, entity, v FROM ({H2})
        WHERE {_years(2023, 2024)} AND id IS NOT NULL AND entity IS NOT NULL) f
  GROUP BY 1, 2, 3, 4 HAVING COUNT(v) > 0),
r AS (SELECT *,
        row_number() OVER (PARTITION BY year, id, entity ORDER BY avg DESC, hour ASC) AS rp,
        row_number() OVER (PARTITION BY year, id, entity ORDER BY avg ASC, hour ASC) AS rl
      FROM a)
SELECT year, id, entity,
       MAX(CASE WHEN rp = 1 THEN hour END) AS peak_hour, MAX(CASE WHEN rp = 1 THEN avg END) AS peak_avg,
       MAX(CASE WHEN rl = 1 THEN hour END) AS low_hour, MAX(CASE WHEN rl = 1 THEN avg END) AS low_avg
FROM r GROUP BY 1, 2, 3"""
ORACLE["entity_totals_fine"] = f"""SELECT {YR} AS year, entity, COALESCE(SUM(v / 1024), 0.0) AS total
FROM ({Y}) WHERE {_years(1996, 1997)} AND entity IS NOT NULL GROUP BY 1, 2"""
ORACLE["entity_range_positions"] = f"""SELECT key, id, ts, v, row_number() OVER (ORDER BY ts, key, id) AS position
FROM ({ORACLE['entity_range_extract']}) x"""
ORACLE["deep_page"] = """SELECT * FROM (
  SELECT l_shipdate, l_orderkey, l_linenumber, l_quantity,
         row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) AS position FROM lineitem) x
WHERE position BETWEEN 50001 AND 50100"""
ORACLE["entity_ranks"] = f"""SELECT year, entity, total,
       CAST(row_number() OVER (PARTITION BY year ORDER BY total DESC, entity ASC) AS INTEGER) AS rank
FROM (SELECT {YR} AS year, entity, {TOTAL} AS total FROM ({O})
      WHERE {_years(1996, 1997)} AND entity IS NOT NULL GROUP BY 1, 2) e"""
ORACLE["stored_partials"] = HOUR_SUMS_H
ORACLE["csv_facts"] = f"""SELECT ts, CAST(id AS VARCHAR) AS id, entity, v FROM ({D}) d
WHERE ts IS NOT NULL AND v IS NOT NULL"""
ORACLE["rows_per_weekday"] = f"""SELECT CAST(isodow(ts) - 1 AS INTEGER) AS slot, dayname(ts) AS day, COUNT(*) AS rows
FROM ({O}) o WHERE ts IS NOT NULL GROUP BY 1, 2"""
ORACLE["strict_stamps"] = f"SELECT {HR} AS hour, COUNT(*) AS rows FROM ({H}) h WHERE ts IS NOT NULL GROUP BY 1"
ORACLE["voted_stamps"] = f"""SELECT date_trunc('second', ts) AS ts, CAST(id AS VARCHAR) AS id, entity, v
FROM ({H}) h WHERE ts IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)"""
ORACLE["first_month_landed"] = ORACLE["first_month_rows"]
ORACLE["months_landed"] = f"SELECT DISTINCT {YR} AS year, {MO} AS month FROM ({O}) o WHERE ts IS NOT NULL"
ORACLE["run_counters"] = f"""WITH d AS ({D}),
k AS (SELECT ts FROM d WHERE ts IS NOT NULL AND v IS NOT NULL)
SELECT 'rows_read' AS counter, CAST(NULL AS INTEGER) AS year, COUNT(*) AS value FROM d
UNION ALL SELECT 'bad_stamp', NULL, COUNT(*) FILTER (WHERE ts IS NULL) FROM d
UNION ALL SELECT 'bad_measure', NULL, COUNT(*) FILTER (WHERE v IS NULL) FROM d
UNION ALL SELECT 'rows_kept', NULL, COUNT(*) FROM k
UNION ALL SELECT 'rows_in_year', 2023, COUNT(*) FILTER (WHERE year(ts) = 2023) FROM k
UNION ALL SELECT 'rows_in_year', 2024, COUNT(*) FILTER (WHERE year(ts) = 2024) FROM k"""
ORACLE["pages_quarantine"] = """WITH e AS (SELECT *, event_id // 500 AS p FROM events),
s AS (SELECT CASE WHEN p % 7 = 3 THEN 'not one JSON array' ELSE 'whole' END AS name, p,
             CASE WHEN p % 7 = 3 THEN 0 ELSE COUNT(*) END AS n FROM e GROUP BY p
      UNION ALL SELECT 'whole', -1, 0)
SELECT name, COUNT(*) AS pages, CAST(SUM(n) AS BIGINT) AS records FROM s GROUP BY 1
UNION ALL
SELECT event_type, NULL, COUNT(*) FROM e
WHERE p % 7 <> 3 AND ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1"""
ORACLE["append_pages_quarantine"] = ORACLE["pages_quarantine"]
ORACLE["monthly_series_by_id"] = _series("", "HAVING COUNT(v) >= 12", first_seen=True)
ORACLE["season_bundle_top5"] = ORACLE["season_top5"]
ORACLE["monthly_series_streamed"] = ORACLE["monthly_series"]
ORACLE["monthly_series_written"] = ORACLE["monthly_series_by_id"]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
