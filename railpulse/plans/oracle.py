"""DuckDB oracle SQL per registered query (independent brute-force logic).

Each statement starts from the pre-registered driver tables through the
adapter CTEs of ``fixtures.ADAPTER_SQL`` and restates the job's rule in
plain SQL.
"""

from __future__ import annotations

from railpulse.plans.fixtures import with_ctes

ORACLE: dict[str, str] = {}

WINDOW = "INTERVAL '1 day'"
LINE = "N"

RANK_SQL = """CASE WHEN {c} = '-' THEN 0 WHEN lower({c}) = 'due' THEN 1
  WHEN regexp_full_match({c}, '[0-9]+:[0-9]+')
    THEN 2 + CAST(split_part({c}, ':', 1) AS BIGINT) * 60 + CAST(split_part({c}, ':', 2) AS BIGINT)
  ELSE 999999 END"""
SECONDS_SQL = """CASE WHEN regexp_full_match({c}, '[0-9]+:[0-9]+')
    THEN CAST(split_part({c}, ':', 1) AS BIGINT) * 60 + CAST(split_part({c}, ':', 2) AS BIGINT)
  END"""

VIEW_COLS = ("id, set_number, trip_number, line_code, station_code, station_name, platform_name, "
             "current_location, time_to_station, destination, calculated_lat, calculated_lng, "
             "heading, timestamp")


def latest_sql(line_filter: str = "") -> str:
    return f"""
SELECT {VIEW_COLS} FROM (
  SELECT p.*, row_number() OVER (PARTITION BY set_number, line_code
      ORDER BY timestamp DESC, {RANK_SQL.format(c='time_to_station')} ASC, id ASC) AS rn
  FROM predictions p
  WHERE timestamp >= (SELECT max(timestamp) FROM predictions) - {WINDOW} {line_filter}
) WHERE rn = 1"""


ORACLE["q_latest_per_train"] = with_ctes(["predictions"], latest_sql())
ORACLE["q_latest_line_filter"] = with_ctes(["predictions"], latest_sql(f"AND line_code = '{LINE}'"))
ORACLE["q_countdown"] = with_ctes(["predictions"], f"""
SELECT id, time_to_station, {RANK_SQL.format(c='time_to_station')} AS countdown_rank,
       {SECONDS_SQL.format(c='time_to_station')} AS countdown_seconds
FROM predictions""")


# ---------------------------------------------------------------- text helpers (DuckDB/RE2)
def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean_loc(x: str) -> str:
    for pat in [r"(?i)\s+Platform\s+[\d\s\w]+$", r"(?i)\s+Sidings?", r"(?i)\s+Depot",
                r"(?i)\s+Yard", r"(?i)\s+Junction", r"\s*\(.*?\)", r"\.+$"]:
        x = f"regexp_replace({x}, '{pat}', '', 'g')"
    return trim_ws(x)


def clean_lookup(x: str) -> str:
    for pat in [r"(?i) Underground Station", r"(?i) Station", r"(?i) Platform\s*[\d\w\s]+$",
                r"\."]:
        x = f"regexp_replace({x}, '{pat}', '', 'g')"
    return trim_ws(x)


def f8(x: str) -> str:
    return trim_ws(f"regexp_replace({x}, '\\.$', '')")


def nullif_blank(x: str) -> str:
    return f"NULLIF({x}, '')"


RE = {
    "between": r"(?i)^Between\s+(.+?)\s+and\s+(.+)$",
    "at_platform": r"(?i)^At\s+Platform$",
    "at": r"(?i)^At\s+(.+?)(?:\s+Platform\s+[\d\s\w]+)?(?:\s+Sidings?)?$",
    "approaching": r"(?i)^Approaching\s+(.+?)(?:\s+Platform\s+[\d\s\w]+)?$",
    "left": r"(?i)^(?:Left|Departed)\s+(.+)$",
    "leaving": r"(?i)^Leaving\s+(.+)$",
    "held": r"(?i)^Held\s+(?:at\s+)?(.+)$",
}


def loc_cols(t: str) -> str:
    """loc_type, s1, s2 columns for location text ``t``."""
    def m(k):
        return f"regexp_matches({t}, '{RE[k]}')"

    def g(k, i=1):
        return nullif_blank(clean_loc(f"regexp_extract({t}, '{RE[k]}', {i})"))
    blank = f"({t} IS NULL OR {trim_ws(t)} = '')"
    typ = (f"CASE WHEN {blank} THEN 'unknown' WHEN {m('between')} THEN 'between' "
           f"WHEN {m('at_platform')} THEN 'at' WHEN {m('at')} THEN 'at' "
           f"WHEN {m('approaching')} THEN 'approaching' WHEN {m('left')} THEN 'left' "
           f"WHEN {m('leaving')} THEN 'left' WHEN {m('held')} THEN 'at' ELSE 'unknown' END")
    s1 = (f"CASE WHEN {blank} THEN NULL WHEN {m('between')} THEN {g('between')} "
          f"WHEN {m('at_platform')} THEN NULL WHEN {m('at')} THEN {g('at')} "
          f"WHEN {m('approaching')} THEN {g('approaching')} WHEN {m('left')} THEN {g('left')} "
          f"WHEN {m('leaving')} THEN {g('leaving')} WHEN {m('held')} THEN {g('held')} END")
    s2 = f"CASE WHEN NOT {blank} AND {m('between')} THEN {g('between', 2)} END"
    return f"{typ} AS loc_type, {s1} AS s1, {s2} AS s2"


ORACLE["q_parse_location"] = with_ctes(["predictions"], f"""
SELECT id, current_location, loc_type, s1 AS station1, s2 AS station2,
       CASE WHEN loc_type = 'at' THEN COALESCE(s1, NULLIF(regexp_replace(station_name, '\\.$', ''), ''))
            WHEN loc_type = 'approaching' THEN s1 WHEN loc_type = 'between' THEN s2 END AS next_station
FROM (SELECT id, current_location, station_name, {loc_cols('current_location')} FROM predictions)""")

# ---------------------------------------------------------------- name resolution (brute force)
from railpulse.functions.constants import STATION_NAME_ALIASES  # noqa: E402

ALIASES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}')" for a, b in STATION_NAME_ALIASES) + ") t(alias_key, alias_name)"


DNAME = "lower(replace(st.name, '.', ''))"
DNOPAR = "lower(" + trim_ws(r"replace(regexp_replace(st.name, '\s*\(.*?\)', '', 'g'), '.', '')") + ")"


def resolve_sql(names_rel: str) -> str:
    """name -> best station by brute-force priority over names x stations."""
    s = "qa.s"
    d = DNAME
    qnp = "lower(" + trim_ws(f"regexp_replace({s}, " + r"'\s*\(.*?\)'" + ", '', 'g')") + ")"
    return f"""
SELECT q.name, b.code, b.st_name, b.lat, b.lng, b.pr AS match_priority
FROM (SELECT DISTINCT name FROM {names_rel}) q
LEFT JOIN (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY pr, length(st_name), st_name, code) rn
    FROM (
      SELECT qk.name, st.code, st.name AS st_name, st.lat, st.lng,
             CASE WHEN {d} = qk.ql THEN 0
                  WHEN {d} = qk.qamp THEN 1
                  WHEN starts_with({d}, qk.ql) THEN 2
                  WHEN replace({d}, chr(39), '') = qk.qna THEN 3
                  WHEN {DNOPAR} = qk.qnp THEN 4
                  WHEN contains({d}, qk.ql) THEN 5 END AS pr
      FROM (
        SELECT *, regexp_replace(qnp, '(?i) and ', ' & ', 'g') AS qamp FROM (
          SELECT name, lower({s}) AS ql, lower(replace({s}, chr(39), '')) AS qna, {qnp} AS qnp
          FROM (SELECT q0.name, COALESCE(al.alias_name, q0.c) AS s
                FROM (SELECT name, {clean_lookup('name')} AS c
                      FROM (SELECT DISTINCT name FROM {names_rel})) q0
                LEFT JOIN ({ALIASES_SQL}) al ON lower(q0.c) = al.alias_key) qa)) qk
      CROSS JOIN stations st
    ) WHERE pr IS NOT NULL
  ) WHERE rn = 1
) b ON b.name = q.name"""


ORACLE["q_resolve_names"] = with_ctes(["name_variants", "stations"],
                                      resolve_sql("name_variants"))

# ---------------------------------------------------------------- dimensions
from railpulse.functions.constants import STATION_LINE_CODE_MAP  # noqa: E402

_MAP_CASE = "CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATION_LINE_CODE_MAP) + " END"
_MAP_IN = "{x} IN (" + ", ".join(f"'{a}'" for a, _ in STATION_LINE_CODE_MAP) + ")"


def _mapped(list_expr: str, field: str = "") -> str:
    x = f"i{field}"
    return (f"list_transform(list_filter({list_expr}, lambda i: {_MAP_IN.format(x=x)}), "
            f"lambda i: {_MAP_CASE.format(x=x)})")


CANDIDATES_SQL = f"""
SELECT doc_idx, sp_idx, code, name, lat, lng,
       list_concat(a, list_filter(b, lambda x, j: NOT list_contains(a, x) AND list_position(b, x) = j)) AS lines
FROM (
  SELECT doc_idx, sp_idx, COALESCE(NULLIF(stationNaptan, ''), naptanId, '') AS code,
         {trim_ws("replace(COALESCE(commonName, ''), ' Underground Station', '')")} AS name,
         lat, lon AS lng,
         flatten(list_transform(list_filter(COALESCE(lineModeGroups, []), lambda g: g.modeName = 'tube'),
                 lambda g: {_mapped("COALESCE(g.lineIdentifier, [])")})) AS a,
         {_mapped("COALESCE(lines, [])", ".id")} AS b
  FROM stop_points)
WHERE lat IS NOT NULL AND lat <> 0 AND lng IS NOT NULL AND lng <> 0"""

EXTRA: dict[str, tuple[list[str], str]] = {}
EXTRA["st_candidates"] = (["stop_points"], f"SELECT * FROM ({CANDIDATES_SQL}) WHERE len(lines) > 0")

ORACLE["q_station_build"] = with_ctes(["st_candidates"], """
SELECT code, name, lat, lng, array_to_string(lines, ',') AS lines,
       'POINT(' || CAST(lng AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS location_wkt
FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY doc_idx, sp_idx) rn FROM st_candidates)
WHERE rn = 1""", EXTRA)

ORACLE["q_station_quality"] = with_ctes(["st_candidates"], """
SELECT count(*) AS n_stations, COALESCE(max(length(COALESCE(code, ''))), 0) AS max_code_len,
       COALESCE(max(length(COALESCE(name, ''))), 0) AS max_name_len,
       count(*) FILTER (WHERE length(COALESCE(code, '')) > 20) AS n_code_too_long,
       count(*) FILTER (WHERE length(COALESCE(name, '')) > 100) AS n_name_too_long,
       count(*) FILTER (WHERE length(COALESCE(code, '')) = 0) AS n_missing_code,
       (count(*) FILTER (WHERE length(COALESCE(code, '')) > 20 OR length(COALESCE(name, '')) > 100
                         OR length(COALESCE(code, '')) = 0)) = 0 AS valid
FROM st_candidates""", EXTRA)
# NB: ``valid`` counts issues, not stations; a station with two issues counts twice in Spark.
ORACLE["q_station_quality"] = ORACLE["q_station_quality"].replace(
    """(count(*) FILTER (WHERE length(COALESCE(code, '')) > 20 OR length(COALESCE(name, '')) > 100
                         OR length(COALESCE(code, '')) = 0)) = 0 AS valid""",
    """count(*) FILTER (WHERE length(COALESCE(code, '')) > 20 OR length(COALESCE(name, '')) > 100
                         OR length(COALESCE(code, '')) = 0) = 0 AS valid""")

ORACLE["q_station_issues"] = with_ctes(["st_candidates"], """
SELECT sp_idx, code, name, 'code_too_long' AS issue, length(code) AS length FROM st_candidates WHERE length(COALESCE(code, '')) > 20
UNION ALL
SELECT sp_idx, code, name, 'name_too_long', length(name) FROM st_candidates WHERE length(COALESCE(name, '')) > 100
UNION ALL
SELECT sp_idx, code, name, 'missing_code', 0 FROM st_candidates WHERE length(COALESCE(code, '')) = 0""",
                                       EXTRA)

EXTRA["edges_raw"] = (["route_stops", "route_line_map"], """
WITH s AS (
  SELECT line_id, seq_no, pos, COALESCE(NULLIF(stationId, ''), NULLIF(id, '')) AS code, lat, lon
  FROM route_stops),
s2 AS (
  SELECT line_id, seq_no, row_number() OVER w - 1 AS i, code AS from_code, lat AS from_lat,
         lon AS from_lng, lead(code) OVER w AS to_code, lead(lat) OVER w AS to_lat,
         lead(lon) OVER w AS to_lng
  FROM s WHERE code IS NOT NULL
  WINDOW w AS (PARTITION BY line_id, seq_no ORDER BY pos)),
per_id AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id, least(from_code, to_code),
                   greatest(from_code, to_code) ORDER BY seq_no, i) AS rn
                 FROM s2 WHERE to_code IS NOT NULL) WHERE rn = 1),
per_code AS (
  SELECT * FROM (SELECT p.*, m.line_code, row_number() OVER (PARTITION BY m.line_code, from_code, to_code
                   ORDER BY m.line_rank, seq_no, i) AS rn2
                 FROM per_id p JOIN route_line_map m USING (line_id)) WHERE rn2 = 1)
SELECT line_code, from_code, to_code, CAST(i AS INTEGER) AS sequence_order, from_lat, from_lng,
       to_lat, to_lng, CAST(NULL AS INTEGER) AS travel_time_seconds
FROM per_code
WHERE from_lat IS NOT NULL AND from_lat <> 0 AND from_lng IS NOT NULL AND from_lng <> 0
  AND to_lat IS NOT NULL AND to_lat <> 0 AND to_lng IS NOT NULL AND to_lng <> 0""")

EXTRA["seg_times"] = (["timetable_intervals"], """
WITH seg AS (
  SELECT line_code, departure, route_idx, set_idx, interval_idx,
         COALESCE(lag(COALESCE(stop_id, '')) OVER w, COALESCE(departure, '')) AS from_code,
         COALESCE(stop_id, '') AS to_code,
         COALESCE(time_to_arrival, 0.0) - COALESCE(lag(COALESCE(time_to_arrival, 0.0)) OVER w, 0.0) AS minutes
  FROM timetable_intervals
  WINDOW w AS (PARTITION BY line_code, departure, route_idx, set_idx ORDER BY interval_idx)),
segf AS (
  SELECT *, CAST(round_even(minutes * 60, 0) AS BIGINT) AS seconds FROM seg
  WHERE to_code <> '' AND from_code <> '' AND minutes > 0),
per_tt AS (
  SELECT line_code, departure, from_code, to_code,
         list_reduce(list(seconds ORDER BY route_idx, set_idx, interval_idx), lambda a, x: (a + x) // 2) AS tt_seconds,
         min(route_idx * 0) AS _z,
         arg_min([route_idx, set_idx, interval_idx], [route_idx, set_idx, interval_idx]) AS tt_first
  FROM segf GROUP BY ALL)
SELECT line_code, from_code, to_code,
       CAST(list_reduce(list(tt_seconds ORDER BY departure), lambda a, x: (a + x) // 2) AS INTEGER) AS seconds,
       min(departure) AS first_dep,
       arg_min(tt_first, departure) AS first_pos
FROM per_tt GROUP BY line_code, from_code, to_code""")

ORACLE["q_adjacency"] = with_ctes(["edges_raw"], "SELECT * FROM edges_raw", EXTRA)

ORACLE["q_terminals"] = with_ctes(["edges_raw", "stations"], """
SELECT line_code, count(*) AS n_terminals, min(code) AS first_terminal, max(code) AS last_terminal
FROM (SELECT DISTINCT e.line_code, e.from_code AS code, s.name
      FROM edges_raw e JOIN stations s ON s.code = e.from_code WHERE e.sequence_order = 0)
GROUP BY line_code""", EXTRA)

ORACLE["q_segment_times"] = with_ctes(["seg_times"],
                                      "SELECT line_code, from_code, to_code, seconds FROM seg_times",
                                      EXTRA)

# per edge: the timed pair applied last among those matching either direction
EXTRA["edges_applied"] = (["edges_raw", "seg_times"], """
SELECT e.line_code, e.from_code, e.to_code, e.sequence_order, e.from_lat, e.from_lng, e.to_lat, e.to_lng,
       CAST(COALESCE(t.seconds, e.travel_time_seconds, 120) AS INTEGER) AS travel_time_seconds,
       t.seconds IS NOT NULL AS timed
FROM edges_raw e
LEFT JOIN (
  SELECT * FROM (
    SELECT e2.line_code, e2.from_code, e2.to_code, t.seconds,
           row_number() OVER (PARTITION BY e2.line_code, e2.from_code, e2.to_code
                              ORDER BY t.first_dep DESC, t.first_pos DESC) AS rn
    FROM edges_raw e2 JOIN seg_times t ON t.line_code = e2.line_code
      AND ((t.from_code = e2.from_code AND t.to_code = e2.to_code)
           OR (t.from_code = e2.to_code AND t.to_code = e2.from_code))
  ) WHERE rn = 1
) t USING (line_code, from_code, to_code)""")
EXTRA["edges"] = (["edges_applied"], "SELECT * EXCLUDE (timed) FROM edges_applied")

ORACLE["q_apply_times"] = with_ctes(["edges_applied"], "SELECT * FROM edges_applied", EXTRA)

EXTRA["unmatched"] = (["edges_raw", "seg_times"], """
SELECT t.* FROM seg_times t
WHERE NOT EXISTS (SELECT 1 FROM edges_raw e WHERE e.line_code = t.line_code
   AND ((e.from_code = t.from_code AND e.to_code = t.to_code)
        OR (e.from_code = t.to_code AND e.to_code = t.from_code)))""")

ORACLE["q_unmatched_times"] = with_ctes(
    ["unmatched"], "SELECT line_code, from_code, to_code, seconds FROM unmatched", EXTRA)
ORACLE["q_unmatched_report"] = with_ctes(["unmatched"], """
SELECT line_code, from_code, to_code, seconds FROM unmatched
ORDER BY line_code, first_dep, first_pos LIMIT 20""", EXTRA)

ORACLE["q_line_stations"] = with_ctes(["edges"], """
SELECT line_code, from_code AS code FROM edges UNION SELECT line_code, to_code FROM edges""", EXTRA)

ORACLE["q_neighbours"] = with_ctes(["edges"], """
SELECT line_code, station_code, nb_code, nb_lat, nb_lng, travel_time,
       row_number() OVER (PARTITION BY line_code, station_code
                          ORDER BY sequence_order, line_code, from_code, to_code) AS nb_rank
FROM (
  SELECT line_code, from_code AS station_code, to_code AS nb_code, to_lat AS nb_lat, to_lng AS nb_lng,
         COALESCE(travel_time_seconds, 120) AS travel_time, sequence_order, from_code, to_code FROM edges
  UNION ALL
  SELECT line_code, to_code, from_code, from_lat, from_lng, COALESCE(travel_time_seconds, 120),
         sequence_order, from_code, to_code FROM edges WHERE from_code <> to_code)""", EXTRA)

ORACLE["q_fk_violations"] = with_ctes(["edges", "seed_lines"], """
SELECT 'missing_line' AS violation, line_code, from_code, to_code FROM edges
WHERE line_code NOT IN (SELECT code FROM seed_lines)
UNION ALL
SELECT 'duplicate_key', line_code, from_code, to_code FROM edges GROUP BY ALL HAVING count(*) > 1
UNION ALL
SELECT 'null_required', line_code, from_code, to_code FROM edges
WHERE line_code IS NULL OR from_code IS NULL OR to_code IS NULL OR sequence_order IS NULL""", EXTRA)

ORACLE["q_seed"] = with_ctes(["seed_lines", "fixture_line_codes"], """
SELECT * FROM seed_lines
UNION ALL
SELECT * FROM fixture_line_codes WHERE code NOT IN (SELECT code FROM seed_lines)""")

EXTRA["upsert_st"] = (["stations"], """
SELECT s.code, s.name, s.lat, s.lng, array_to_string(s.lines, ',') AS lines, p.s_acctbal
FROM stations s JOIN supplier p ON s.code = 'ST' || CAST(p.s_suppkey AS VARCHAR)""")
ORACLE["q_upsert"] = with_ctes(["upsert_st"], """
SELECT code, name, lat, lng, lines FROM upsert_st
WHERE s_acctbal < 5000 AND code NOT IN (SELECT code FROM upsert_st WHERE s_acctbal >= 2500)
UNION ALL
SELECT code, name || ' (new)', lat, lng, lines FROM upsert_st WHERE s_acctbal >= 2500""", EXTRA)

# ---------------------------------------------------------------- positions (brute force)
ANY = "'<any line>'"
SECS = SECONDS_SQL.format(c="time_to_station")

EXTRA["latest"] = (["predictions"], latest_sql())
EXTRA["parsed"] = (["latest"], f"""
SELECT l.*, {loc_cols('current_location')},
       (station_name IS NOT NULL AND station_name <> '') AS sn_ok,
       (destination IS NOT NULL AND destination <> '') AS dn_ok,
       COALESCE({f8('station_name')}, '') AS sn_key,
       (line_code IS NOT NULL AND line_code <> '') AS has_line,
       CASE WHEN line_code IS NULL OR line_code = '' THEN {ANY} ELSE line_code END AS line_key,
       {SECS} AS secs
FROM latest l""")
EXTRA["needed"] = (["parsed"], f"""
SELECT DISTINCT name FROM (
  SELECT unnest([CASE WHEN sn_ok THEN {f8('station_name')} END,
                 CASE WHEN dn_ok THEN {f8('destination')} END, s1, s2]) AS name FROM parsed)
WHERE name IS NOT NULL""")
EXTRA["resolved"] = (["needed", "stations"], resolve_sql("needed"))
EXTRA["lk"] = (["parsed", "resolved"], f"""
SELECT raw, a.code AS d_code, a.lat AS d_lat, a.lng AS d_lng,
       CASE WHEN a.code IS NOT NULL THEN a.code ELSE b.code END AS code,
       CASE WHEN a.code IS NOT NULL THEN a.lat ELSE b.lat END AS lat,
       CASE WHEN a.code IS NOT NULL THEN a.lng ELSE b.lng END AS lng
FROM (SELECT DISTINCT raw FROM (SELECT unnest([s1, s2, station_name, destination, sn_key]) AS raw
                                FROM parsed) WHERE raw IS NOT NULL) r
LEFT JOIN resolved a ON a.name = r.raw
LEFT JOIN resolved b ON b.name = {f8('r.raw')}""")
EXTRA["ls"] = (["edges"], """
SELECT DISTINCT line_code, code FROM (SELECT line_code, from_code AS code FROM edges
                                      UNION ALL SELECT line_code, to_code FROM edges)""")
EXTRA["nb"] = (["edges"], f"""
WITH n AS (
  SELECT line_code, from_code AS station_code, to_code AS nb_code, to_lat AS nb_lat, to_lng AS nb_lng,
         COALESCE(travel_time_seconds, 120) AS tt, sequence_order, from_code, to_code FROM edges
  UNION ALL
  SELECT line_code, to_code, from_code, from_lat, from_lng, COALESCE(travel_time_seconds, 120),
         sequence_order, from_code, to_code FROM edges WHERE from_code <> to_code)
SELECT line_code AS line_key, * FROM n UNION ALL SELECT {ANY} AS line_key, * FROM n""")


def _slot(alias: str, key: str, guard: str | None, field: str = "") -> str:
    cond = f"AND ({guard})" if guard else ""
    return (f"LEFT JOIN lk {alias} ON {alias}.raw = {key} {cond}")


EXTRA["ctx_base"] = (["parsed", "lk", "ls"], f"""
SELECT p.*,
  k1.code AS r1_code, k1.lat AS r1_lat, k1.lng AS r1_lng,
  k2.code AS r2_code, k2.lat AS r2_lat, k2.lng AS r2_lng,
  kp.code AS rp_code, kp.lat AS rp_lat, kp.lng AS rp_lng,
  kd.code AS rd_code, kd.lat AS rd_lat, kd.lng AS rd_lng,
  CASE WHEN p.sn_ok THEN kv.code END AS rv_code,
  kv.d_code AS to_code, kv.d_lat AS to_lat, kv.d_lng AS to_lng,
  (NOT p.has_line OR EXISTS (SELECT 1 FROM ls WHERE ls.line_code = p.line_code AND ls.code = k1.code)) AS on1,
  (NOT p.has_line OR EXISTS (SELECT 1 FROM ls WHERE ls.line_code = p.line_code AND ls.code = k2.code)) AS on2,
  (NOT p.has_line OR EXISTS (SELECT 1 FROM ls WHERE ls.line_code = p.line_code
                             AND ls.code = CASE WHEN p.sn_ok THEN kv.code END)) AS onv
FROM parsed p
{_slot('k1', 'p.s1', None)}
{_slot('k2', 'p.s2', None)}
{_slot('kp', 'p.station_name', 'p.sn_ok')}
{_slot('kd', 'p.destination', 'p.dn_ok')}
{_slot('kv', 'p.sn_key', None)}""")

# validation
VALID_SQL = """(NOT has_line
  OR (loc_type = 'at' AND s1 IS NULL AND NOT sn_ok)
  OR (loc_type IN ('approaching', 'left') AND s1 IS NULL)
  OR (loc_type = 'between' AND (s1 IS NULL OR s2 IS NULL))
  OR (loc_type = 'unknown' AND NOT sn_ok)
  OR CASE WHEN loc_type = 'at' THEN (CASE WHEN s1 IS NOT NULL THEN r1_code IS NOT NULL AND on1
                                          ELSE rv_code IS NOT NULL AND onv END)
          WHEN loc_type IN ('approaching', 'left') THEN r1_code IS NOT NULL AND on1
          WHEN loc_type = 'between' THEN r1_code IS NOT NULL AND on1 AND r2_code IS NOT NULL AND on2
          ELSE rv_code IS NOT NULL AND onv END)"""

def ctx_sql(base: str, cond: str) -> str:
    return f"""
WITH v AS (SELECT * FROM {base} WHERE {cond}),
ap AS (SELECT * FROM (
  SELECT v.id, nb.nb_code AS ap_code, nb.nb_lat AS ap_lat, nb.nb_lng AS ap_lng, nb.tt AS ap_tt,
         row_number() OVER (PARTITION BY v.id ORDER BY
           CASE WHEN v.rp_code IS NOT NULL AND nb.nb_code = v.rp_code THEN 1 ELSE 0 END,
           nb.sequence_order, nb.line_code, nb.from_code, nb.to_code) AS rn
  FROM v JOIN nb ON nb.line_key = v.line_key AND nb.station_code = v.r1_code) WHERE rn = 1),
lf AS (SELECT * FROM (
  SELECT v.id, nb.nb_code AS lf_code, nb.nb_lat AS lf_lat, nb.nb_lng AS lf_lng, nb.tt AS lf_tt,
         (v.rp_code IS NOT NULL AND nb.nb_code = v.rp_code) AS lf_toward,
         row_number() OVER (PARTITION BY v.id ORDER BY
           CASE WHEN v.rp_code IS NOT NULL AND nb.nb_code = v.rp_code THEN 0 ELSE 1 END,
           nb.sequence_order, nb.line_code, nb.from_code, nb.to_code) AS rn
  FROM v JOIN nb ON nb.line_key = v.line_key AND nb.station_code = v.r1_code) WHERE rn = 1),
sg AS (SELECT * FROM (
  SELECT v.id, e.travel_time_seconds AS sg_tt,
         row_number() OVER (PARTITION BY v.id ORDER BY
           CASE WHEN v.has_line AND e.line_code = v.line_code THEN 0 ELSE 1 END,
           e.sequence_order, e.line_code, e.from_code, e.to_code) AS rn
  FROM v JOIN edges e ON (e.from_code = v.r1_code AND e.to_code = v.r2_code)
                      OR (e.from_code = v.r2_code AND e.to_code = v.r1_code)) WHERE rn = 1)
SELECT v.*, ap.ap_code, ap.ap_lat, ap.ap_lng, ap.ap_tt, lf.lf_code, lf.lf_lat, lf.lf_lng,
       lf.lf_tt, lf.lf_toward, sg.sg_tt, sg.id IS NOT NULL AS sg_found
FROM v LEFT JOIN ap USING (id) LEFT JOIN lf USING (id) LEFT JOIN sg USING (id)"""


EXTRA["ctx"] = (["ctx_base", "nb", "edges"], ctx_sql("ctx_base", VALID_SQL))


def _frac(tt: str, default: float) -> str:
    return (f"(CASE WHEN secs IS NULL THEN {default} "
            f"ELSE greatest(0.0, least(1.0, 1.0 - secs / ({tt}))) END)")


def _interp(a: str, b: str, f: str) -> tuple[str, str]:
    return (f"({a}_lat + ({b}_lat - {a}_lat) * {f})", f"({a}_lng + ({b}_lng - {a}_lng) * {f})")


def _pos_case() -> tuple[str, str, str]:
    conf = "CASE WHEN secs IS NULL THEN 'estimated' ELSE 'interpolated' END"
    plat = ("sn_ok AND rp_code IS NOT NULL", "rp_lat", "rp_lng", "'estimated'")
    at_src = "CASE WHEN s1 IS NOT NULL THEN r1_{f} WHEN sn_ok THEN rp_{f} END"
    la, ga = _interp("ap", "r1", _frac("ap_tt", 0.9))
    lt, gt = _interp("r1", "rp", _frac("lf_tt", 0.1))
    ln, gn = _interp("r1", "lf", _frac("lf_tt", 0.1))
    lb, gb = _interp("r1", "r2", _frac("COALESCE(sg_tt, 120)", 0.5))
    rules = [
        # (condition, lat, lng, confidence) — first true wins, else NULL
        ("loc_type = 'at' AND (" + at_src.format(f="code") + ") IS NOT NULL",
         at_src.format(f="lat"), at_src.format(f="lng"), "'exact'"),
        ("loc_type = 'at'", "NULL", "NULL", "NULL"),
        ("loc_type IN ('approaching', 'left', 'between') AND (s1 IS NULL OR (loc_type = 'between' AND s2 IS NULL))",
         "NULL", "NULL", "NULL"),
        ("loc_type IN ('approaching', 'left') AND NOT (r1_code IS NOT NULL AND on1) AND " + plat[0],
         plat[1], plat[2], plat[3]),
        ("loc_type IN ('approaching', 'left') AND NOT (r1_code IS NOT NULL AND on1)", "NULL", "NULL", "NULL"),
        ("loc_type = 'approaching' AND ap_code IS NOT NULL", la, ga, conf),
        ("loc_type = 'approaching'", "r1_lat", "r1_lng", "'estimated'"),
        ("loc_type = 'left' AND lf_code IS NOT NULL AND lf_toward", lt, gt, conf),
        ("loc_type = 'left' AND lf_code IS NOT NULL", ln, gn, conf),
        ("loc_type = 'left'", "r1_lat", "r1_lng", "'estimated'"),
        ("loc_type = 'between' AND NOT (r1_code IS NOT NULL AND r2_code IS NOT NULL AND on1 AND on2) AND "
         + plat[0], plat[1], plat[2], plat[3]),
        ("loc_type = 'between' AND NOT (r1_code IS NOT NULL AND r2_code IS NOT NULL AND on1 AND on2)",
         "NULL", "NULL", "NULL"),
        ("loc_type = 'between'", lb, gb, conf),
        (plat[0], plat[1], plat[2], plat[3]),
    ]
    out = []
    for i in (1, 2, 3):
        out.append("CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rules) + " END")
    return tuple(out)


PLAT, PLNG, PCONF = _pos_case()
NORM = "lower(" + trim_ws("replace({c}, '.', '')") + ")"

EXTRA["positions"] = (["ctx", "nb"], f"""
WITH c AS (SELECT *, {PLAT} AS c_lat, {PLNG} AS c_lng, {PCONF} AS c_conf FROM ctx),
pc AS (SELECT *,
  (calculated_lat IS NOT NULL AND calculated_lat <> 0 AND calculated_lng IS NOT NULL AND calculated_lng <> 0) AS pre,
  (secs IS NULL AND sn_ok AND dn_ok AND {NORM.format(c='station_name')} <> {NORM.format(c='destination')}
   AND rp_code IS NOT NULL AND rd_code IS NOT NULL AND rp_code <> rd_code) AS want_next
  FROM c),
nx AS (SELECT * FROM (
  SELECT pc.id, nb.nb_lat AS nx_lat, nb.nb_lng AS nx_lng, nb.tt AS nx_tt,
         row_number() OVER (PARTITION BY pc.id ORDER BY
           (nb.nb_lat - pc.rd_lat) * (nb.nb_lat - pc.rd_lat) + (nb.nb_lng - pc.rd_lng) * (nb.nb_lng - pc.rd_lng),
           nb.sequence_order, nb.line_code, nb.from_code, nb.to_code) AS rn
  FROM pc JOIN nb ON nb.line_key = pc.line_key AND nb.station_code = pc.rp_code
  WHERE pc.want_next) WHERE rn = 1)
SELECT pc.*,
  CASE WHEN pre THEN calculated_lat WHEN c_conf IS NOT NULL THEN c_lat WHEN to_code IS NOT NULL THEN to_lat END AS lat,
  CASE WHEN pre THEN calculated_lng WHEN c_conf IS NOT NULL THEN c_lng WHEN to_code IS NOT NULL THEN to_lng END AS lng,
  CASE WHEN pre THEN 'precalculated' WHEN c_conf IS NOT NULL THEN c_conf
       WHEN to_code IS NOT NULL THEN 'station_fallback' ELSE 'none' END AS position_confidence,
  secs AS time_to_station_seconds,
  nx.nx_lat AS predicted_next_lat, nx.nx_lng AS predicted_next_lng, nx.nx_tt AS predicted_travel_time
FROM pc LEFT JOIN nx USING (id)""")

ORACLE["q_line_validation"] = with_ctes(["ctx_base"], f"""
SELECT id, set_number, line_code, loc_type FROM ctx_base WHERE {VALID_SQL}""", EXTRA)

ORACLE["q_positions"] = with_ctes(["positions"], """
SELECT id, set_number, line_code, loc_type, lat, lng, position_confidence, to_lat, to_lng,
       time_to_station_seconds FROM positions""", EXTRA)

ORACLE["q_position_stats"] = with_ctes(["positions"], """
SELECT count(*) AS filtered_trains,
       count(*) FILTER (WHERE position_confidence NOT IN ('station_fallback', 'none')) AS positioned,
       count(*) FILTER (WHERE position_confidence = 'station_fallback') AS fallback_used,
       count(*) FILTER (WHERE position_confidence = 'none') AS missing,
       count(*) FILTER (WHERE lat IS NOT NULL AND lng IS NOT NULL) AS shown
FROM positions""", EXTRA)

ORACLE["q_next_station"] = with_ctes(["positions"], """
SELECT id, set_number, line_code, predicted_next_lat, predicted_next_lng, predicted_travel_time
FROM positions""", EXTRA)

# ---------------------------------------------------------------- features and labels
from railpulse.functions.constants import LINE_COLORS, LINE_SPLITS  # noqa: E402

COLOR_SQL = ("COALESCE(CASE line_code " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LINE_COLORS)
             + " END, '#888888')")


def labels_sql(rel: str, extra_cols: str = "") -> str:
    label = "regexp_replace(station_name, '\\.$', '')"
    nxt = (f"CASE WHEN loc_type = 'at' THEN COALESCE(s1, NULLIF({label}, '')) "
           f"WHEN loc_type = 'approaching' THEN s1 WHEN loc_type = 'between' THEN s2 END")
    return f"""
SELECT *, loc_type AS location_type,
  CASE WHEN loc_type = 'at' AND s1 IS NULL AND {label} IS NOT NULL AND {label} <> ''
       THEN 'At ' || {label} ELSE current_location END AS display_location,
  CASE WHEN loc_type = 'at' THEN 'At ' || COALESCE(NULLIF(nxt, ''), NULLIF(station_name, ''), 'station')
       WHEN nxt IS NOT NULL AND nxt <> '' AND time_to_station IS NOT NULL AND time_to_station <> ''
            AND time_to_station <> '-' THEN 'Next: ' || nxt || ' in ' || time_to_station
       WHEN time_to_station IS NOT NULL AND time_to_station <> '' AND time_to_station <> '-'
            THEN 'ETA: ' || time_to_station
       ELSE 'Status: ' || loc_type END AS eta_label,
  {COLOR_SQL} AS line_color
FROM (SELECT *, {nxt} AS nxt {extra_cols} FROM {rel})"""


ORACLE["q_train_labels"] = with_ctes(["predictions"], f"""
SELECT id, location_type, nxt AS next_station, display_location, eta_label, line_color
FROM ({labels_sql(f"(SELECT *, {loc_cols('current_location')} FROM predictions)")})""")

EXTRA["features"] = (["positions"], f"""
SELECT id, set_number, trip_number, line_code, station_name, display_location AS current_location,
       location_type, nxt AS next_station, time_to_station, destination, timestamp, lat, lng,
       position_confidence, lat AS from_lat, lng AS from_lng, to_lat, to_lng, time_to_station_seconds,
       timestamp AS data_timestamp, predicted_next_lat, predicted_next_lng, predicted_travel_time,
       eta_label, line_color
FROM ({labels_sql("(SELECT * FROM positions WHERE lat IS NOT NULL AND lng IS NOT NULL)")})""")

ORACLE["q_train_features"] = with_ctes(["features"], "SELECT * FROM features", EXTRA)

ORACLE["q_station_features"] = with_ctes(["stations"], """
SELECT code, name, lat, lng, array_to_string(lines, ',') AS lines FROM stations
WHERE lat IS NOT NULL AND lng IS NOT NULL AND list_contains(lines, 'A')""")

SPLITS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{n}', '{col}', {o})" for c, n, col, o in LINE_SPLITS) + ") t(code, v_name, v_color, line_offset)"
EXTRA["line_variants"] = (["seed_lines", "fixture_line_codes"], f"""
SELECT l.code, COALESCE(s.v_name, l.name) AS name, COALESCE(s.v_color, l.color) AS color,
       COALESCE(s.line_offset, 0) AS line_offset
FROM (SELECT * FROM seed_lines UNION ALL
      SELECT * FROM fixture_line_codes WHERE code NOT IN (SELECT code FROM seed_lines)) l
LEFT JOIN ({SPLITS_SQL}) s USING (code)""")

ORACLE["q_line_features"] = with_ctes(["line_variants", "edges"], """
SELECT v.code, v.name, v.color, v.line_offset, COALESCE(c.n, 0) AS n_segments
FROM line_variants v LEFT JOIN (SELECT line_code AS code, count(*) AS n FROM edges GROUP BY 1) c
USING (code)""", EXTRA)

ORACLE["q_line_segments"] = with_ctes(["line_variants", "edges"], """
SELECT v.code, v.name, v.color, v.line_offset, e.from_code, e.to_code, e.from_lng, e.from_lat,
       e.to_lng, e.to_lat
FROM line_variants v LEFT JOIN edges e ON e.line_code = v.code""", EXTRA)

# ---------------------------------------------------------------- coverage (no line, direct names)
EXTRA["cov_parsed"] = (["latest"], f"""
SELECT l.*, {loc_cols('current_location')},
       (station_name IS NOT NULL AND station_name <> '') AS sn_ok,
       (destination IS NOT NULL AND destination <> '') AS dn_ok,
       FALSE AS has_line, {ANY} AS line_key, {SECS} AS secs
FROM latest l""")
EXTRA["cov_names"] = (["cov_parsed"], """
SELECT DISTINCT name FROM (SELECT unnest([s1, s2, station_name, destination]) AS name FROM cov_parsed)
WHERE name IS NOT NULL AND name <> ''""")
EXTRA["cov_resolved"] = (["cov_names", "stations"], resolve_sql("cov_names"))
EXTRA["cov_ctx_base"] = (["cov_parsed", "cov_resolved"], """
SELECT p.*, k1.code AS r1_code, k1.lat AS r1_lat, k1.lng AS r1_lng,
       k2.code AS r2_code, k2.lat AS r2_lat, k2.lng AS r2_lng,
       kp.code AS rp_code, kp.lat AS rp_lat, kp.lng AS rp_lng,
       TRUE AS on1, TRUE AS on2
FROM cov_parsed p
LEFT JOIN cov_resolved k1 ON k1.name = p.s1
LEFT JOIN cov_resolved k2 ON k2.name = p.s2
LEFT JOIN cov_resolved kp ON kp.name = p.station_name AND p.sn_ok""")
EXTRA["cov_ctx"] = (["cov_ctx_base", "nb", "edges"], ctx_sql("cov_ctx_base", "TRUE"))
EXTRA["coverage"] = (["cov_ctx"], f"""
SELECT set_number, trip_number, line_code, station_name, current_location, time_to_station,
       destination, loc_type, pre AS has_precalculated_position,
       (pre OR c_conf IS NOT NULL) AS will_show_on_map, c_lat AS calc_lat, c_lng AS calc_lng,
       c_conf AS calc_confidence,
       CASE WHEN c_conf IS NULL AND NOT (calculated_lat IS NOT NULL AND calculated_lat <> 0) THEN
         CASE WHEN loc_type = 'unknown'
              THEN 'Location text "' || COALESCE(current_location, 'null') || '" doesn''t match any pattern'
              ELSE 'Could not find station(s) in database for "' || COALESCE(current_location, 'null') || '"'
         END END AS reason_if_missing
FROM (SELECT *, {PLAT} AS c_lat, {PLNG} AS c_lng, {PCONF} AS c_conf,
        (calculated_lat IS NOT NULL AND calculated_lat <> 0 AND calculated_lng IS NOT NULL
         AND calculated_lng <> 0) AS pre
      FROM cov_ctx)""")

ORACLE["q_coverage_summary"] = with_ctes(["coverage"], """
SELECT count(*) AS total_trains_in_db, count(*) FILTER (WHERE will_show_on_map) AS visible_on_map,
       count(*) FILTER (WHERE NOT will_show_on_map) AS missing_from_map,
       count(*) - count(DISTINCT set_number) AS duplicate_set_numbers, 'all' AS line_filter
FROM coverage""", EXTRA)
ORACLE["q_missing_by_reason"] = with_ctes(["coverage"], """
SELECT COALESCE(reason_if_missing, 'unknown') AS reason, count(*) AS n_trains,
       min(set_number) AS first_set_number, max(set_number) AS last_set_number
FROM coverage WHERE NOT will_show_on_map GROUP BY 1""", EXTRA)
ORACLE["q_missing_trains"] = with_ctes(["coverage"], """
SELECT COALESCE(reason_if_missing, 'unknown') AS reason, set_number, line_code, current_location, loc_type
FROM coverage WHERE NOT will_show_on_map""", EXTRA)

# ---------------------------------------------------------------- trajectory / overlap
ORACLE["q_trajectory"] = with_ctes(["features"], """
SELECT id, set_number, line_code, offset_s,
  CASE WHEN to_lat IS NOT NULL AND to_lng IS NOT NULL AND time_to_station_seconds IS NOT NULL
            AND time_to_station_seconds > 0
         THEN from_lat + (to_lat - from_lat) * least(1.0, greatest(0.0, CAST(offset_s AS DOUBLE))
                                                      / CAST(time_to_station_seconds AS DOUBLE))
       WHEN time_to_station_seconds IS NULL AND predicted_next_lat IS NOT NULL
            AND predicted_next_lng IS NOT NULL AND offset_s > 30
         THEN from_lat + (predicted_next_lat - from_lat) * least(0.35, (CAST(offset_s AS DOUBLE) - 30)
                                                      / COALESCE(CAST(predicted_travel_time AS DOUBLE), 120.0))
       ELSE from_lat END AS traj_lat,
  CASE WHEN to_lat IS NOT NULL AND to_lng IS NOT NULL AND time_to_station_seconds IS NOT NULL
            AND time_to_station_seconds > 0
         THEN from_lng + (to_lng - from_lng) * least(1.0, greatest(0.0, CAST(offset_s AS DOUBLE))
                                                      / CAST(time_to_station_seconds AS DOUBLE))
       WHEN time_to_station_seconds IS NULL AND predicted_next_lat IS NOT NULL
            AND predicted_next_lng IS NOT NULL AND offset_s > 30
         THEN from_lng + (predicted_next_lng - from_lng) * least(0.35, (CAST(offset_s AS DOUBLE) - 30)
                                                      / COALESCE(CAST(predicted_travel_time AS DOUBLE), 120.0))
       ELSE from_lng END AS traj_lng
FROM features, (SELECT CAST(unnest(generate_series(0, 120, 10)) AS INTEGER) AS offset_s) g""", EXTRA)


def fixed4_sql(x: str) -> str:
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(CAST(round(CAST(CAST(abs({x}) AS VARCHAR)"
            f" AS DECIMAL(38,18)), 4) AS DECIMAL(38,4)) AS VARCHAR))")


ORACLE["q_overlap_spread"] = with_ctes(["features"], f"""
SELECT id, set_number, line_code, n AS overlap_count,
  round(CASE WHEN n > 1 THEN lat + sin(6.283185307179586 / n * i - 1.5707963267948966) * 0.00015 ELSE lat END, 9) AS display_lat,
  round(CASE WHEN n > 1 THEN lng + cos(6.283185307179586 / n * i - 1.5707963267948966) * 0.00015 ELSE lng END, 9) AS display_lng
FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n,
             row_number() OVER (PARTITION BY k ORDER BY set_number ASC NULLS FIRST, line_code ASC NULLS FIRST) - 1 AS i
      FROM (SELECT *, {fixed4_sql('lng')} || ',' || {fixed4_sql('lat')} AS k FROM features))""", EXTRA)

# ---------------------------------------------------------------- flatten, retention, recency, stale
ORACLE["q_flatten_xml"] = with_ctes(["predictions"], """
SELECT station_code, station_name, platform_name, platform_code, trip_number, set_number,
       time_to_station, destination, current_location, line_code FROM predictions""")

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
ORACLE["q_retention"] = with_ctes(["predictions"], f"""
SELECT count(*) FILTER (WHERE timestamp < {AS_OF} - INTERVAL '7 days') AS deleted_count,
       count(*) FILTER (WHERE timestamp >= {AS_OF} - INTERVAL '7 days') AS kept_count
FROM predictions""")
ORACLE["q_fact_sweep"] = with_ctes(["predictions"], """
SELECT set_number, trip_number, line_code, station_code, platform_code, time_to_station, timestamp,
       (SELECT count(*) FROM predictions WHERE timestamp < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '7 days 5 hours') AS deleted_count,
       count(*) OVER () AS kept_count
FROM predictions WHERE timestamp >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '7 days 5 hours'""")
ORACLE["q_fact_latest"] = with_ctes(["predictions"], latest_sql().replace("SELECT id, ", "SELECT ", 1))
ORACLE["q_recent_count"] = with_ctes(["predictions"], f"""
SELECT count(*) FILTER (WHERE timestamp > {AS_OF} - INTERVAL '5 days') AS recent_rows,
       count(*) AS total_rows FROM predictions""")
ORACLE["q_stale_retention"] = with_ctes(["predictions"], """
SELECT set_number, line_code, last_seen, last_seen <> newest AS stale
FROM (SELECT set_number, line_code, max(timestamp) AS last_seen,
             (SELECT max(timestamp) FROM predictions) AS newest
      FROM predictions GROUP BY set_number, line_code)
WHERE last_seen = newest OR epoch_ms(newest) - epoch_ms(last_seen) < 3 * 86400 * 1000""")

ORACLE["q_fold_hot"] = """
SELECT l_linenumber, count(*) AS n,
       list_reduce(list(seconds ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, seconds), lambda a, x: (a + x) // 2) AS folded
FROM (SELECT *, CASE WHEN l_shipdate >= TIMESTAMP '1997-01-01' THEN CAST(120 AS BIGINT)
                     ELSE CAST(trunc(l_quantity * 10) AS BIGINT) END AS seconds
      FROM lineitem)
GROUP BY l_linenumber
"""


# ---------------------------------------------------------------- C15: one observation after the other
_SNAPSHOTS = dict(EXTRA)
_SNAPSHOTS["latest"] = (["predictions"], f"""
SELECT {VIEW_COLS} FROM (
  SELECT p.*, row_number() OVER (PARTITION BY set_number, line_code, timestamp
      ORDER BY {RANK_SQL.format(c='time_to_station')}, id) AS rn FROM predictions p) WHERE rn = 1""")
_SNAPSHOTS["polls"] = (["positions"], """
SELECT timestamp AS ts, lag(timestamp) OVER (ORDER BY timestamp) AS prev_poll
FROM (SELECT DISTINCT timestamp FROM positions WHERE lat IS NOT NULL AND lng IS NOT NULL)""")
_SNAPSHOTS["obs"] = (["positions", "polls"], """
SELECT set_number, line_code, row_number() OVER (PARTITION BY set_number, line_code ORDER BY timestamp) AS i,
       timestamp AS ts, station_name, CAST(lat AS DOUBLE) AS from_lat, CAST(lng AS DOUBLE) AS from_lng,
       CAST(to_lat AS DOUBLE) AS to_lat, CAST(to_lng AS DOUBLE) AS to_lng,
       CAST(time_to_station_seconds AS DOUBLE) AS eta_s, epoch_ms(timestamp) AS ms,
       CAST(predicted_next_lat AS DOUBLE) AS pred_lat, CAST(predicted_next_lng AS DOUBLE) AS pred_lng,
       CAST(predicted_travel_time AS DOUBLE) AS pred_tt, epoch_ms(prev_poll) AS prev_ms
FROM positions JOIN polls ON polls.ts = positions.timestamp WHERE lat IS NOT NULL AND lng IS NOT NULL""")
_MOVING = "s.to_lat IS NOT NULL AND s.to_lng IS NOT NULL AND s.eta_s > 0"
_REACHED = "least(1.0, greatest(0.0, (o.ms - s.data_ts_ms) / 1000.0) / s.eta_s)"


def _reached(c: str) -> str:
    """Where the old trajectory is by now; a re-anchored one always has an ETA, so no dwelling."""
    return (f"CASE WHEN {_MOVING} THEN s.from_{c} + (s.to_{c} - s.from_{c}) * {_REACHED} ELSE s.from_{c} END")


_SNAPSHOTS["merged"] = (["obs"], f"""
SELECT set_number, line_code, i, ts, from_lat, from_lng, to_lat, to_lng, eta_s, ms AS data_ts_ms,
       pred_lat, pred_lng, pred_tt, station_name, 0 AS reanchors FROM obs WHERE i = 1
UNION ALL
SELECT set_number, line_code, i, ts,
  CASE WHEN act = 'replace' THEN n_from_lat WHEN act = 'keep' THEN from_lat ELSE r_lat END,
  CASE WHEN act = 'replace' THEN n_from_lng WHEN act = 'keep' THEN from_lng ELSE r_lng END,
  CASE WHEN act = 'keep' THEN to_lat ELSE n_to_lat END, CASE WHEN act = 'keep' THEN to_lng ELSE n_to_lng END,
  CASE WHEN act = 'replace' THEN n_eta WHEN act = 'keep' THEN eta_s ELSE greatest(0.0, (n_ms + n_eta * 1000 - n_ms) / 1000.0) END,
  CASE WHEN act = 'keep' THEN data_ts_ms ELSE n_ms END,
  n_pred_lat, n_pred_lng, n_pred_tt, n_station,
  CASE WHEN act = 'replace' THEN 0 WHEN act = 'keep' THEN reanchors ELSE reanchors + 1 END
FROM (
  SELECT s.* EXCLUDE (i, ts), o.i, o.ts, o.ms AS n_ms, o.eta_s AS n_eta, o.station_name AS n_station,
    o.from_lat AS n_from_lat, o.from_lng AS n_from_lng, o.to_lat AS n_to_lat, o.to_lng AS n_to_lng,
    o.pred_lat AS n_pred_lat, o.pred_lng AS n_pred_lng, o.pred_tt AS n_pred_tt,
    {_reached("lat")} AS r_lat, {_reached("lng")} AS r_lng,
    CASE WHEN coalesce(o.prev_ms - epoch_ms(s.ts) >= 90000, false) OR s.station_name IS DISTINCT FROM o.station_name
           OR s.eta_s IS NULL OR o.eta_s IS NULL THEN 'replace'
         WHEN abs((o.ms + o.eta_s * 1000) - (s.data_ts_ms + s.eta_s * 1000)) < 20000 THEN 'keep' ELSE 'anchor' END AS act
  FROM merged s JOIN obs o ON o.set_number = s.set_number AND o.line_code IS NOT DISTINCT FROM s.line_code AND o.i = s.i + 1)""")
ORACLE["q_eta_reconcile"] = with_ctes(["merged"], """
SELECT set_number, line_code, ts AS last_seen, i AS n_obs, from_lat, from_lng, to_lat, to_lng, eta_s,
       data_ts_ms, pred_lat, pred_lng, pred_tt, station_name, reanchors
FROM (SELECT *, max(i) OVER (PARTITION BY set_number, line_code) AS n FROM merged) WHERE i = n""", _SNAPSHOTS).replace("WITH ", "WITH RECURSIVE ", 1)


# ---------------------------------------------------------------- O1, A12, F19, S16
ORACLE["q_ordered_stations"] = with_ctes(["stations"], """
SELECT row_number() OVER (ORDER BY name, code) AS rank, code, name FROM stations""")
ORACLE["q_ordered_lines"] = with_ctes(["edges_raw"], """
SELECT row_number() OVER (ORDER BY line_code, sequence_order, from_code, to_code) AS rank, line_code, sequence_order,
       from_code, to_code FROM edges_raw""", EXTRA)
ORACLE["q_apply_counts"] = with_ctes(["edges_raw", "seg_times", "edges_applied"], """
SELECT (SELECT count(*) FROM seg_times t JOIN edges_raw e ON e.line_code = t.line_code
          AND ((t.from_code = e.from_code AND t.to_code = e.to_code) OR (t.from_code = e.to_code AND t.to_code = e.from_code))) AS updated,
       count(*) FILTER (WHERE NOT timed) AS defaulted, count(*) AS edges
FROM edges_applied""", EXTRA)
ORACLE["q_edge_geometry"] = with_ctes(["edges_raw"], """
SELECT line_code, from_code, to_code,
       'LINESTRING(' || CAST(from_lng AS DOUBLE) || ' ' || CAST(from_lat AS DOUBLE) || ', ' || CAST(to_lng AS DOUBLE) || ' ' || CAST(to_lat AS DOUBLE) || ')' AS segment_geometry
FROM edges_raw""", EXTRA)
ORACLE["q_line_geojson"] = with_ctes(["line_variants", "edges_raw"], """
SELECT '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || CAST(from_lng AS DOUBLE) || ',' || CAST(from_lat AS DOUBLE)
    || '],[' || CAST(to_lng AS DOUBLE) || ',' || CAST(to_lat AS DOUBLE) || ']]},"properties":{"code":"' || v.code || '","name":"' || v.name || '","color":"' || v.color
    || '","line_offset":' || v.line_offset || ',"from_code":"' || e.from_code || '","to_code":"' || e.to_code || '"}}' AS feature
FROM line_variants v JOIN edges_raw e ON e.line_code = v.code""", EXTRA)
