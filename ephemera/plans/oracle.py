"""The queries as SQL for another engine, with the same arithmetic in the same order, so that instants agree to the millisecond."""

from __future__ import annotations

import math

from ..functions.labels import DOMAIN
from ..functions.solar import HORIZON, OBLIQUITY, PERIHELION, RAD
from ..sources.dimensions import CROSS_QUARTERS, PHASES, SEASONS
from .queries import LONG_DOMAIN, STRICT

DAY = "86400000"
TAU = repr(2 * math.pi)
PI = repr(math.pi)


def _num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# --- derived inputs -----------------------------------------------------------------------------------------

CUSTOMERS = "SELECT c_custkey AS location_id, ((c_custkey*7919) % 12001)/100E0 - 60E0 AS lat, ((c_custkey*104729) % 35999)/100E0 - 180E0 AS lon FROM customer"
SUPPLIERS = "SELECT s_suppkey AS location_id, 55E0 + ((s_suppkey*37) % 3501)/100E0 AS lat, ((s_suppkey*104729) % 35999)/100E0 - 180E0 AS lon FROM supplier"
#: The suppliers' places after some moved, left or came.
MOVED = f"""SELECT location_id, CASE WHEN location_id % 10 = 0 THEN -lat ELSE lat END AS lat, lon FROM ({SUPPLIERS}) WHERE location_id % 10 <> 1
UNION ALL SELECT location_id + 1000000, -lat, lon FROM ({SUPPLIERS}) WHERE location_id % 10 = 2"""
#: Each customer's place with a window of its own.
OWN = f"""SELECT location_id, lat, lon, CAST(unnest(generate_series(CAST(first AS TIMESTAMP), CAST(first + CAST(CASE WHEN location_id % 500 = 0 THEN 73000 ELSE (location_id * 7) % 60 END AS INTEGER) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
FROM (SELECT *, DATE '1900-01-01' + CAST(CASE WHEN location_id % 500 = 0 THEN 0 ELSE (location_id * 37) % 40000 END AS INTEGER) AS first FROM ({CUSTOMERS}))"""
RAW = """SELECT c_custkey AS location_id, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS lat_text,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(CAST(c_acctbal/10 AS DECIMAL(12,3)) AS VARCHAR) || CASE WHEN c_custkey % 7 = 0 THEN 'd' ELSE '' END END AS lon_text
FROM customer"""


def _span(name: str, column: str, before: int = 1, after: int = 1) -> str:
    return f"SELECT min(year({column})) - {before} AS first, max(year({column})) + {after} AS last FROM {name}"


# --- sun ----------------------------------------------------------------------------------------------------


def _sun_times(inputs: str, day_ms: str = "epoch_ms(CAST(day AS TIMESTAMP))") -> str:
    """A chain of common table expressions that ends in sun_times; inputs has lat, lon and whatever day_ms needs."""
    steps = [
        ("lw", f"{_num(RAD)} * (-lon)"),
        ("phi", f"{_num(RAD)} * lat"),
        ("d", f"({day_ms}) / 86400000E0 - 0.5E0 + 2440588 - 2451545"),
        ("n", f"floor(d - 0.0009E0 - lw / {TAU}e0 + 0.5E0)"),
        ("ds", f"0.0009E0 + lw / {TAU}e0 + n"),
        ("m", f"{_num(RAD)} * (357.5291E0 + 0.98560028E0 * ds)"),
        ("lng", f"m + {_num(RAD)} * (1.9148E0 * sin(m) + 0.02E0 * sin(2 * m) + 0.0003E0 * sin(3 * m)) + {_num(PERIHELION)} + {PI}e0"),
        ("declination", f"asin({_num(math.sin(OBLIQUITY))} * sin(lng))"),
        ("cosw", f"({_num(math.sin(HORIZON))} - sin(phi) * sin(declination)) / (cos(phi) * cos(declination))"),
        ("w", "CASE WHEN cosw BETWEEN -1 AND 1 THEN acos(greatest(-1, least(1, cosw))) END"),
        ("noon", "2451545 + ds + 0.0053E0 * sin(m) - 0.0069E0 * sin(2 * lng)"),
        ("jset", f"2451545 + (0.0009E0 + (w + lw) / {TAU}e0 + n) + 0.0053E0 * sin(m) - 0.0069E0 * sin(2 * lng)"),
        ("rise_ms", "CAST(trunc(((noon - (jset - noon)) + 0.5E0 - 2440588) * 86400000E0) AS BIGINT)"),
        ("set_ms", "CAST(trunc((jset + 0.5E0 - 2440588) * 86400000E0) AS BIGINT)"),
    ]
    sql, last = f"s0 AS ({inputs})", "s0"
    for k, (name, formula) in enumerate(steps, 1):
        sql += f",\ns{k} AS (SELECT *, {formula} AS {name} FROM {last})"
        last = f"s{k}"
    return f"{sql},\nsun_times AS (SELECT * FROM {last})"


def _daily(places: str, first: int = 2025, last: int = 2027) -> str:
    return f"SELECT p.*, CAST(g.day AS DATE) AS day FROM ({places}) p, (SELECT unnest(generate_series(TIMESTAMP '{first}-01-01', TIMESTAMP '{last}-12-31', INTERVAL 1 DAY)) AS day) g"


EVENTS = """sun_events AS (
  SELECT location_id, lat, lon, day, 0 AS kind_rank, 'sunrise' AS kind, rise_ms AS event_ms FROM sun_times WHERE rise_ms IS NOT NULL
  UNION ALL SELECT location_id, lat, lon, day, 1, 'sunset', set_ms FROM sun_times WHERE set_ms IS NOT NULL)"""


def _text(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN '0' ELSE regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '') END"


def _stamp(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y%m%dT%H%M%S')"


LABELS = f"""offsets AS (SELECT *, CAST(floor(lon / 15E0 + 0.5E0) AS INTEGER) AS offset_hours FROM sun_events),
labelled AS (
  SELECT *, event_ms + 60000 AS end_ms,
    'UTC' || CASE WHEN offset_hours >= 0 THEN '+' ELSE '-' END || lpad(CAST(abs(offset_hours) AS VARCHAR), 2, '0') AS tz_id,
    CAST(make_timestamp((event_ms + offset_hours * 3600000) * 1000) AS DATE) AS local_date,
    {_stamp("event_ms + offset_hours * 3600000")} AS local_start,
    {_stamp("event_ms + 60000 + offset_hours * 3600000")} AS local_end,
    kind || '-' || strftime(make_timestamp((event_ms + offset_hours * 3600000) * 1000), '%Y%m%d') || '-' || {_text("lat")} || '-' || {_text("lon")} || '@{DOMAIN}' AS uid
  FROM offsets)"""


def _labelled(first: int = 2025, last: int = 2027, places: str = SUPPLIERS, domain: str = DOMAIN) -> str:
    return f"WITH {_sun_times(_daily(places, first, last))},\n{EVENTS},\n{LABELS.replace(f'@{DOMAIN}', f'@{domain}')}\n"


CR = "chr(13) || chr(10)"


def _lines(*parts: str) -> str:
    return f" || {CR} || ".join(parts)


def _head(product: str, title: str) -> str:
    return _lines("'BEGIN:VCALENDAR'", "'VERSION:2.0'", f"'PRODID:{product}'", "'CALSCALE:GREGORIAN'", "'METHOD:PUBLISH'", f"'X-WR-CALNAME:' || {title}")


def _folded(line: str) -> str:
    """A line of ASCII cut into lines of at most 75 characters."""
    rest = f"list_transform(range(0, CAST(ceil((length({line}) - 75) / 74E0) AS BIGINT)), lambda i: {CR} || ' ' || substr({line}, 76 + 74 * i, 74))"
    return f"CASE WHEN length({line}) <= 75 THEN {line} ELSE substr({line}, 1, 75) || list_aggregate({rest}, 'string_agg', '') END"


# --- seasons ------------------------------------------------------------------------------------------------

_SEASONS = ", ".join(f"({i}, '{name}', {', '.join(map(_num, c))})" for i, name, *c in SEASONS)
_CROSSES = ", ".join(f"({i}, '{name}')" for i, name in CROSS_QUARTERS)


def _jde(years: str) -> str:
    """years: SQL of one row (first, last); common table expressions that end in jdes."""
    return f"""bounds AS ({years}),
years AS (SELECT CAST(unnest(generate_series(first - 1, last + 1)) AS INTEGER) AS year FROM bounds),
jdes AS (SELECT year, idx, name, a + b * y + c * pow(y, 2) + d * pow(y, 3) + e * pow(y, 4) AS jde
  FROM (SELECT *, (year - 2000) / 1000E0 AS y FROM years, (VALUES {_SEASONS}) AS s(idx, name, a, b, c, d, e)))"""


_JDE_MS = "CAST(trunc((jde - 2440587.5E0) * 86400000E0) AS BIGINT)"
SEASON_ROWS = f"season_rows AS (SELECT year, idx, jde, {_JDE_MS} AS event_ms, name, 'season-' || idx || '-' || year || '@{DOMAIN}' AS uid FROM jdes, bounds WHERE year BETWEEN first AND last)"
CROSS_ROWS = f"""cross_rows AS (SELECT year, idx, jde, event_ms, name, 'crossquarter-' || idx || '-' || year || '@{DOMAIN}' AS uid FROM (
  SELECT year, x.idx, x.jde, {_JDE_MS.replace("jde", "x.jde")} AS event_ms, c.name
  FROM (SELECT year, idx, (lag(jde) OVER (ORDER BY year, idx) + jde) / 2 AS jde FROM jdes) x JOIN (VALUES {_CROSSES}) AS c(idx, name) ON c.idx = x.idx), bounds
  WHERE event_ms >= epoch_ms(make_date(first, 1, 1)::TIMESTAMP) AND event_ms < epoch_ms(make_date(last + 1, 1, 1)::TIMESTAMP))"""


# --- moon ---------------------------------------------------------------------------------------------------

_PHASE = [
    ("d", "ms / 86400000E0 - 0.5E0 + 2440588 - 2451545"),
    ("ma", f"{_num(RAD)} * (357.5291E0 + 0.98560028E0 * d)"),
    ("lng", f"ma + {_num(RAD)} * (1.9148E0 * sin(ma) + 0.02E0 * sin(2 * ma) + 0.0003E0 * sin(3 * ma)) + {_num(PERIHELION)} + {PI}e0"),
    ("sdec", f"asin(sin(0E0) * {_num(math.cos(OBLIQUITY))} + cos(0E0) * {_num(math.sin(OBLIQUITY))} * sin(lng))"),
    ("sra", f"atan2(sin(lng) * {_num(math.cos(OBLIQUITY))} - tan(0E0) * {_num(math.sin(OBLIQUITY))}, cos(lng))"),
    ("mm", f"{_num(RAD)} * (134.963E0 + 13.064993E0 * d)"),
    ("ml", f"{_num(RAD)} * (218.316E0 + 13.176396E0 * d) + {_num(RAD * 6.289)} * sin(mm)"),
    ("mb", f"{_num(RAD * 5.128)} * sin({_num(RAD)} * (93.272E0 + 13.229350E0 * d))"),
    ("dist", "385001 - 20905 * cos(mm)"),
    ("mdec", f"asin(sin(mb) * {_num(math.cos(OBLIQUITY))} + cos(mb) * {_num(math.sin(OBLIQUITY))} * sin(ml))"),
    ("mra", f"atan2(sin(ml) * {_num(math.cos(OBLIQUITY))} - tan(mb) * {_num(math.sin(OBLIQUITY))}, cos(ml))"),
    ("p", "acos(sin(sdec) * sin(mdec) + cos(sdec) * cos(mdec) * cos(sra - mra))"),
    ("inc", "atan2(149598000E0 * sin(p), dist - 149598000E0 * cos(p))"),
    ("ang", "atan2(cos(sdec) * sin(sra - mra), sin(sdec) * cos(mdec) - cos(sdec) * sin(mdec) * cos(sra - mra))"),
    ("phase", f"0.5E0 + 0.5E0 * inc * CASE WHEN ang < 0 THEN -1E0 ELSE 1E0 END / {PI}e0"),
]


def _phase_of(source: str) -> str:
    """A subquery over a source with column ms that adds phase and what it is made of."""
    sql = source
    for name, formula in _PHASE:
        sql = f"(SELECT *, {formula} AS {name} FROM {sql})"
    return sql


def _moon(years: str) -> str:
    names = ", ".join(f"({i}, '{name}')" for i, name, _ in PHASES)
    return f"""WITH RECURSIVE bounds AS ({years}),
samples AS (SELECT epoch_ms(unnest(generate_series(make_date(first, 1, 1)::TIMESTAMP, make_date(last + 1, 1, 1)::TIMESTAMP, INTERVAL 1 DAY))) AS ms FROM bounds),
daily AS (SELECT ms, phase FROM {_phase_of("samples")}),
pairs AS (SELECT ms, phase, lag(phase) OVER (ORDER BY ms) AS before FROM daily),
brackets AS (SELECT idx, name, ms - {DAY} AS low_ms, ms AS high_ms FROM pairs, (VALUES {names}) AS n(idx, name)
  WHERE CASE idx WHEN 0 THEN before < 0.25 AND phase >= 0.25 WHEN 1 THEN before < 0.5 AND phase >= 0.5 WHEN 2 THEN before < 0.75 AND phase >= 0.75 ELSE before > 0.875 AND phase < 0.125 END),
halved AS (
  SELECT 0 AS step, idx, name, CAST(low_ms AS DOUBLE) AS low, CAST(high_ms AS DOUBLE) AS high, CAST((low_ms + high_ms) / 2 AS DOUBLE) AS mid FROM brackets
  UNION ALL
  SELECT step, idx, name, low, high, (low + high) / 2 FROM (
    SELECT step + 1 AS step, idx, name, CASE WHEN early THEN mid ELSE low END AS low, CASE WHEN early THEN high ELSE mid END AS high FROM (
      SELECT *, CASE idx WHEN 0 THEN phase < 0.25 WHEN 1 THEN phase < 0.5 WHEN 2 THEN phase < 0.75 ELSE phase > 0.5 END AS early
      FROM {_phase_of("(SELECT *, trunc(mid) AS ms FROM halved WHERE step < 30)")}))),
moon_rows AS (SELECT event_ms, name, 'moon-' || replace(lower(name), ' ', '') || '-' || strftime(make_timestamp(event_ms * 1000), '%Y%m%d') || '@{DOMAIN}' AS uid
  FROM (SELECT CAST(trunc(mid) AS BIGINT) AS event_ms, name FROM halved WHERE step = 30))"""


def _celestial() -> str:
    years = _span("events", "ts")
    return f"""{_moon(years)},
{_jde(years).replace("bounds AS (" + years + "),", "", 1).strip()},
{SEASON_ROWS}, {CROSS_ROWS},
celestial AS (
  SELECT 0 AS block, year, 0 AS sub, idx, event_ms, name, uid FROM season_rows
  UNION ALL SELECT 0, year, 1, idx, event_ms, name, uid FROM cross_rows
  UNION ALL SELECT 1, 0, 0, 0, event_ms, name, uid FROM moon_rows)"""


# --- queries ------------------------------------------------------------------------------------------------

_PARSED = f"""WITH raw AS ({RAW}),
parsed AS (SELECT *, TRY_CAST(lat_text AS DOUBLE) AS lat, CASE WHEN lon_text LIKE '%d' THEN NULL ELSE TRY_CAST(lon_text AS DOUBLE) END AS lon FROM raw),
reasons AS (SELECT *,
  CASE WHEN lat_text IS NULL THEN 'lat missing' WHEN lat IS NULL THEN 'lat not a number' WHEN lat NOT BETWEEN -90 AND 90 THEN 'lat out of range' END AS r1,
  CASE WHEN lon_text IS NULL THEN 'lon missing' WHEN lon IS NULL THEN 'lon not a number' WHEN lon NOT BETWEEN -180 AND 180 THEN 'lon out of range' END AS r2 FROM parsed)"""

_SUN_SELECT = "SELECT location_id, lat, lon, day, kind, event_ms FROM sun_events"
_BODY = _lines("'BEGIN:VEVENT'", "'DTSTART;TZID=' || tz_id || ':' || local_start", "'DTEND;TZID=' || tz_id || ':' || local_end", "'SUMMARY:' || CASE kind WHEN 'sunrise' THEN 'Sunrise' ELSE 'Sunset' END", "'UID:' || uid", "'END:VEVENT'")
_SHIFT = "CASE WHEN offset_hours >= 0 THEN '+' ELSE '-' END || lpad(CAST(abs(offset_hours) AS VARCHAR), 2, '0') || '00'"
_ZONE = _lines("'BEGIN:VTIMEZONE'", "'TZID:' || tz_id", "'BEGIN:STANDARD'", "'DTSTART:16010101T000000'", f"'TZOFFSETFROM:' || {_SHIFT}", f"'TZOFFSETTO:' || {_SHIFT}", "'TZNAME:' || tz_id", "'END:STANDARD'", "'END:VTIMEZONE'")
_SUN_HEAD = _lines(_head("-//Ephemera//Sunrise Calendar//EN", f"'Sunrise & Sunset (' || {_text('lat')} || ', ' || {_text('lon')} || ')'"), _ZONE)
_UTC_BODY = _lines("'BEGIN:VEVENT'", f"'DTSTART:' || {_stamp('event_ms')} || 'Z'", f"'DTEND:' || {_stamp('event_ms + 60000')} || 'Z'", "'SUMMARY:' || name", "'UID:' || uid", "'END:VEVENT'")
_PER_UID = "SELECT uid, arg_min(event_ms, (day, event_ms)) AS event_ms FROM labelled GROUP BY uid"


def _feeds(labelled: str, body: str = _BODY, head: str = _SUN_HEAD, tail: str = "'END:VCALENDAR'") -> str:
    return f"""{labelled}, bodies AS (SELECT *, {body} AS body, {head} AS head FROM labelled),
ics AS (SELECT CAST(location_id AS VARCHAR) AS feed_id, 'sunrise-' || min({_text("lat")}) || '-' || min({_text("lon")}) || '.ics' AS filename,
  min(head) || {CR} || string_agg(body, {CR} ORDER BY day, kind_rank) || {CR} || {tail} AS ics FROM bodies GROUP BY location_id)
SELECT feed_id, filename, length(ics) AS n_chars, md5(ics) AS ics_md5 FROM ics"""


def _diff(old: str, new: str) -> str:
    return f"""WITH a AS ({old} {_PER_UID}), b AS ({new} {_PER_UID}),
diff AS (SELECT coalesce(a.uid, b.uid) AS uid, CASE WHEN a.uid IS NULL THEN 'insert' WHEN b.uid IS NULL THEN 'delete' ELSE 'update' END AS action, a.event_ms AS old_ms, b.event_ms AS new_ms
  FROM a FULL OUTER JOIN b ON a.uid = b.uid WHERE a.event_ms IS DISTINCT FROM b.event_ms)"""


_STAMP = f"'DTSTAMP:' || {_stamp(str(STRICT.stamp_ms))} || 'Z'"
_STRICT_BODY = _BODY.replace("'BEGIN:VEVENT'", f"'BEGIN:VEVENT' || {CR} || {_STAMP}").replace("'UID:' || uid", f"({_folded(chr(40) + chr(39) + 'UID:' + chr(39) + ' || uid)')})")
_STRICT_HEAD = _SUN_HEAD.replace("|| ', ' ||", "|| '\\, ' ||")

_CELESTIAL_FEED = f"""{_celestial()},
ics AS (SELECT {_head("-//Ephemera//Celestial Calendar//EN", "'Celestial Events'")} || {CR} || string_agg({_UTC_BODY}, {CR} ORDER BY block, year, sub, idx, event_ms) || {CR} || 'END:VCALENDAR' AS ics FROM celestial)
SELECT 'celestial' AS feed_id, 'celestial.ics' AS filename, length(ics) AS n_chars, md5(ics) AS ics_md5 FROM ics"""

#: The records of each written file: its line, whether it can be read, and its id.
_RECORDS = f"""{_PARSED},
lines AS (
  SELECT *, 'csv' AS kind, CASE WHEN location_id % 19 = 0 THEN '' WHEN location_id % 23 = 0 THEN 'no number' ELSE CAST(location_id AS VARCHAR) END
    || ',' || coalesce(lat_text, '') || ',' || coalesce(lon_text, '') || CASE WHEN location_id % 13 = 0 THEN ',surplus' ELSE '' END AS line,
    location_id % 13 = 0 OR (location_id % 19 <> 0 AND location_id % 23 = 0) AS bad FROM reasons
  UNION ALL
  SELECT * EXCLUDE (whole), 'json', CASE WHEN location_id % 17 = 0 THEN substr(whole, 1, length(whole) - 1) WHEN location_id % 29 = 0 THEN '{{' || whole ELSE whole END, location_id % 17 = 0 OR location_id % 29 = 0
  FROM (SELECT *, '{{' || concat_ws(',', CASE WHEN location_id % 19 <> 0 THEN '"location_id":' || location_id END, '"lat":"' || lat_text || '"', '"lon":"' || lon_text || '"') || '}}' AS whole FROM reasons))"""
_USER = "SELECT event_id, epoch_us(ts) // 1000 AS ms, ((user_id*7919) % 12001)/100E0 - 60E0 AS lat, ((user_id*104729) % 35999)/100E0 - 180E0 AS lon, k FROM events, (VALUES (-1), (0), (1)) AS n(k)"

ORACLE_SQL = {
    "season_events": f"WITH {_jde(_span('orders', 'o_orderdate', 0, 0))}, {SEASON_ROWS} SELECT * FROM season_rows",
    "cross_quarter_days": f"WITH {_jde(_span('orders', 'o_orderdate'))}, {CROSS_ROWS} SELECT * FROM cross_rows",
    "sun_events": f"WITH {_sun_times(_daily(CUSTOMERS))},\n{EVENTS} {_SUN_SELECT}",
    "sun_events_polar": f"WITH {_sun_times(_daily(SUPPLIERS))},\n{EVENTS} {_SUN_SELECT}",
    "sun_event_labels": f"{_labelled()} SELECT location_id, day, kind, end_ms, offset_hours, tz_id, local_date, local_start, local_end, uid FROM labelled",
    "sun_daily_totals": f"""WITH {_sun_times(_daily(SUPPLIERS))}
SELECT location_id, CAST(year(day) AS INTEGER) AS year, count(rise_ms) AS days_with, CAST(count(*) FILTER (WHERE rise_ms IS NULL) AS BIGINT) AS days_without,
  CAST(floor(sum(set_ms - rise_ms)::DOUBLE / greatest(count(rise_ms), 1)) AS BIGINT) AS mean_ms
FROM sun_times GROUP BY location_id, year(day)""",
    "valid_locations": f"{_PARSED} SELECT location_id, lat, lon FROM reasons WHERE r1 IS NULL AND r2 IS NULL",
    "rejected_locations": f"{_PARSED} SELECT location_id, lat_text, lon_text, concat_ws('; ', r1, r2) AS reason FROM reasons WHERE r1 IS NOT NULL OR r2 IS NOT NULL",
    "moon_phase_daily": f"{_moon(_span('events', 'ts'))} SELECT ms, round(phase, 6) AS phase FROM daily",
    "moon_events": f"{_moon(_span('orders', 'o_orderdate'))} SELECT * FROM moon_rows",
    "celestial_events": f"{_celestial()} SELECT * FROM celestial",
    "sun_feed": _feeds(_labelled()),
    "strict_feed": _feeds(_labelled(domain=LONG_DOMAIN), _STRICT_BODY, _STRICT_HEAD, f"'END:VCALENDAR' || {CR}"),
    "feed_files": f"""SELECT filename, n_chars AS n_bytes, ics_md5 AS file_md5 FROM ({_feeds(_labelled())})
UNION ALL SELECT filename, n_chars, ics_md5 FROM ({_CELESTIAL_FEED})""",
    "refreshed_files": f"SELECT filename, n_chars AS n_bytes, ics_md5 AS file_md5 FROM ({_feeds(_labelled(2025, 2027, MOVED))})",
    "stored_feed": _feeds(_labelled(2026, 2028, MOVED)),
    "celestial_feed": _CELESTIAL_FEED,
    "refresh_diff": f"{_diff(_labelled(2025, 2027), _labelled(2026, 2028))} SELECT action, count(*) AS events, min(uid) AS first_uid FROM diff GROUP BY action",
    "changed_places": f"""WITH a AS (SELECT {_text("lat")} || ',' || {_text("lon")} AS place FROM ({SUPPLIERS})), b AS (SELECT {_text("lat")} || ',' || {_text("lon")} AS place FROM ({MOVED}))
SELECT DISTINCT coalesce(a.place, b.place) AS place, CASE WHEN a.place IS NULL THEN 'insert' WHEN b.place IS NULL THEN 'delete' ELSE 'update' END AS action FROM a FULL OUTER JOIN b ON a.place = b.place""",
    "repeated_ids": f"""SELECT CAST(n AS BIGINT) AS location_id, count(*) AS places, arg_min(lat, (lat, lon)) AS first_lat, arg_min(lon, (lat, lon)) AS first_lon
FROM (SELECT c.c_nationkey AS n, p.lat, p.lon FROM customer c JOIN ({CUSTOMERS}) p ON p.location_id = c.c_custkey) GROUP BY n HAVING count(*) > 1""",
    "refresh_apply": f"WITH {_sun_times(_daily(MOVED, 2026, 2028))},\n{EVENTS} {_SUN_SELECT}",
    "refresh_cells": f"""SELECT CAST(CASE WHEN year < 2028 AND location_id < 1000000 AND location_id % 10 <> 0 THEN 1 ELSE 2 END AS INTEGER) AS made, year, count(*) AS cells
FROM ({MOVED}), (SELECT CAST(unnest([2026, 2027, 2028]) AS INTEGER) AS year) GROUP BY 1, 2""",
    "refresh_store_diff": f"{_diff(_labelled(2025, 2027), _labelled(2026, 2028, MOVED))} SELECT uid, action, coalesce(old_ms, 0) AS old_ms, coalesce(new_ms, 0) AS new_ms FROM diff",
    "sun_events_own_windows": f"WITH {_sun_times(OWN)},\n{EVENTS} SELECT location_id, day, kind, event_ms FROM sun_events",
    "file_records": f"""{_RECORDS}
SELECT kind, CASE WHEN NOT bad AND location_id % 19 <> 0 THEN CAST(location_id AS VARCHAR) END AS location_id, CASE WHEN NOT bad THEN lat END AS lat, CASE WHEN NOT bad THEN lon END AS lon,
  CASE WHEN NOT bad THEN lat_text END AS lat_text, CASE WHEN NOT bad THEN lon_text END AS lon_text, CASE WHEN bad THEN line END AS record,
  CASE WHEN bad THEN 'record cannot be read' ELSE concat_ws('; ', CASE WHEN location_id % 19 = 0 THEN 'location_id missing' END, r1, r2) END AS reason FROM lines""",
    "uid_collisions": f"{_labelled()} SELECT location_id, uid, count(*) AS events FROM labelled GROUP BY location_id, uid HAVING count(*) > 1",
    "event_moon_phase": f"SELECT event_id, ms, round(phase, 6) AS moon_phase FROM {_phase_of('(SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)')}",
    "event_daylight": f"""WITH {_sun_times(_USER, "CAST(floor(ms / 86400000E0) AS BIGINT) * 86400000 + k * 86400000")}
SELECT event_id, ms, CASE WHEN bool_or(k = 0 AND rise_ms IS NOT NULL) THEN bool_or(coalesce(ms >= rise_ms AND ms < set_ms, false)) END AS daylight FROM sun_times GROUP BY event_id, ms""",
    "orders_by_season": f"""WITH {_jde(_span('orders', 'o_orderdate', 1, 0))}, {SEASON_ROWS},
spans AS (SELECT name, year, event_ms, coalesce(lead(event_ms) OVER (ORDER BY event_ms), event_ms + 366 * CAST(86400000 AS BIGINT)) AS until FROM season_rows)
SELECT name AS season, year AS season_year, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN spans ON epoch_us(o_orderdate) // 1000 >= event_ms AND epoch_us(o_orderdate) // 1000 < until GROUP BY name, year""",
}
