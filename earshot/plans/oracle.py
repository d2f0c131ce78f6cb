"""The same results in DuckDB's SQL."""

from __future__ import annotations

from ..operators import dsp
from ..sources.labels import THEME_RULES

_NIGHT = "(22,23,0,1,2,3,4,5,6)"


def _r(x: str, digits: int = 1) -> str:
    s = f"1{'0' * digits}e0"
    return f"(floor(({x}) * {s} + 0.5e0) / {s})"


def _leq(x: str = "dba", where: str = "") -> str:
    tail = f" FILTER (WHERE {where})" if where else ""
    return _r(f"10e0 * log10(avg(pow(10e0, {x} / 10e0)){tail})")


def _p(q: float, x: str = "dba", where: str = "") -> str:
    tail = f" FILTER (WHERE {where})" if where else ""
    return _r(f"quantile_disc({x}, {q}){tail}")


_DBA = _r("30e0 + least(value, 120e0) * 0.5e0")
CH = f"""ch AS (SELECT event_id AS chunk_id, ts AS dt_utc, 'dev-' || CAST(user_id % 8 AS VARCHAR) AS device_id, 'dev-' || CAST(user_id % 8 AS VARCHAR) || '.jsonl' AS source_file,
  {_DBA} AS dba, {_DBA} + 3e0 AS lafmax,
  CASE event_type WHEN 'view' THEN 'Speech' WHEN 'click' THEN 'Vehicle' WHEN 'purchase' THEN 'Wind' WHEN 'signup' THEN 'Bird' ELSE 'gated' END AS top_label,
  CAST(event_id % 100 AS DOUBLE) / 100e0 AS top_confidence, coalesce(event_type = 'error', false) AS gated,
  timezone('Europe/Amsterdam', timezone('UTC', ts)) AS dt_local FROM events)"""
_MACRO = "CASE {0} WHEN 'Speech' THEN 'Human & Community' WHEN 'Bird' THEN 'Human & Community' WHEN 'Vehicle' THEN 'Traffic & Transit' WHEN 'Vehicle / Tire Rolling' THEN 'Traffic & Transit' WHEN 'Wind' THEN 'Environmental & Weather' ELSE 'Unclassified / Ambient' END"
VO = f"""vo AS (SELECT *, CASE WHEN NOT gated AND top_label <> 'gated' AND top_confidence >= 0.25e0 THEN top_label END AS vote FROM ch),
vm AS (SELECT *, {_MACRO.format("vote")} AS macro, CASE WHEN gated THEN 'Relative silence' ELSE {_MACRO.format("vote")} END AS category FROM vo)"""
_STATS = f"{_leq()} AS leq_db, {_p(0.1)} AS l90_db, {_p(0.9)} AS l10_db, count(*) AS chunks, count(*) FILTER (WHERE gated) AS gated_chunks, {_r('100e0 * count(*) FILTER (WHERE gated) / count(*)')} AS gated_pct"
_T = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_PERIOD = "CASE WHEN hour({0}) IN " + _NIGHT + " THEN 'night' ELSE 'day' END"
_GAP = "CASE WHEN g < 24 THEN g || ' h gap' WHEN g % 24 = 0 THEN (g // 24) || ' d gap' ELSE (g // 24) || ' d ' || (g % 24) || ' h gap' END"
_SECONDS = "(epoch_us({1}) - epoch_us({0})) / 1e6"


_PLACE = "CASE category WHEN 'Traffic & Transit' THEN 0 WHEN 'Human & Community' THEN 1 WHEN 'Environmental & Weather' THEN 2 WHEN 'Infrastructure & Mechanical' THEN 3 WHEN 'Unclassified / Ambient' THEN 4 WHEN 'Relative silence' THEN 6 ELSE 5 END"


def _budget(key: str, name: str) -> str:
    lead = f"{key} AS {name}, " if key else ""
    group, part = (f"{name}, " if key else ""), (f"PARTITION BY {name}" if key else "")
    return f"WITH {CH}, {VO}, b AS (SELECT {lead}category, count(*) AS chunks FROM vm GROUP BY {group}category) SELECT {group}category, CAST(row_number() OVER ({part} ORDER BY {_PLACE}, category) AS INT) AS place, chunks, chunks * 0.975e0 AS seconds, {_r(f'100e0 * chunks / sum(chunks) OVER ({part})')} AS pct FROM b"


def _events(threshold: str) -> str:
    """Common tables up to one row for each event."""
    return f"""{CH}, {VO}, th AS (SELECT {threshold} AS threshold),
n AS (SELECT vm.*, threshold, row_number() OVER (ORDER BY dt_utc, chunk_id) AS rn, count(*) OVER () AS total, dba >= threshold AS active FROM vm, th),
a AS (SELECT *, max(CASE WHEN active THEN rn END) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, max(CASE WHEN active THEN rn END) OVER (ORDER BY rn) AS last FROM n),
s AS (SELECT *, sum(CASE WHEN active AND (prev IS NULL OR rn - prev - 1 > 2) THEN 1 ELSE 0 END) OVER (ORDER BY rn) AS event FROM a),
m AS (SELECT *, max(CASE WHEN active THEN rn END) OVER (PARTITION BY event) AS l FROM s WHERE event > 0 AND rn - last <= 2),
k AS (SELECT * FROM m WHERE rn <= CASE WHEN total - l > 2 THEN l + 2 ELSE l END),
v AS (SELECT event, arg_max(vote, (c, -f)) AS dominant FROM (SELECT event, vote, count(*) AS c, min(rn) AS f FROM k WHERE vote IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT event, min(dt_utc) AS a, max(dt_utc) AS b, count(*) AS chunk_count, min(rn) AS start_rn, max(dba) AS max_dba, max(lafmax) AS max_lafmax, {_leq()} AS leq_db, any_value(threshold) AS threshold FROM k GROUP BY event HAVING count(*) >= 2),
e AS (SELECT g.*, dominant, CASE WHEN dominant = 'Wind' AND max_dba > 52e0 THEN 'Vehicle / Tire Rolling' ELSE coalesce(dominant, 'Unclassified / Ambient') END AS resolved FROM g LEFT JOIN v USING (event)),
ev AS (SELECT start_rn, {_T.format("a")} AS start_utc, {_T.format("b")} AS end_utc, {_r(f"CASE WHEN b > a THEN {_SECONDS.format('a', 'b')} + 0.975e0 ELSE chunk_count * 0.975e0 END", 2)} AS duration_s, chunk_count, max_dba, max_lafmax, leq_db, dominant, resolved, {_MACRO.format("resolved")} AS macro, threshold FROM e)"""


_EV = "start_rn, start_utc, end_utc, duration_s, chunk_count, max_dba, max_lafmax, leq_db, dominant, resolved, macro"
_SPANS = f"""{CH}, o AS (SELECT *, CASE WHEN NOT gated AND top_confidence >= 0.25e0 THEN top_label END AS l FROM ch),
p AS (SELECT *, CASE WHEN l IS DISTINCT FROM lag(l) OVER (PARTITION BY device_id ORDER BY dt_utc, chunk_id) OR row_number() OVER (PARTITION BY device_id ORDER BY dt_utc, chunk_id) = 1 AND l IS NOT NULL THEN 1 ELSE 0 END AS new FROM o),
q AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY dt_utc, chunk_id) AS span FROM p),
sp AS (SELECT device_id, span, any_value(l) AS label, min(dt_utc) AS t0, max(dt_utc) AS t1, arg_min(dba, (dt_utc, chunk_id)) AS height, min(top_confidence) AS confidence, count(*) AS rows FROM q WHERE l IS NOT NULL GROUP BY 1, 2)"""
_LEVELS = f"""lv AS (SELECT {_leq(where="hour(dt_local) BETWEEN 7 AND 18")} AS lday_db, {_leq(where="hour(dt_local) BETWEEN 19 AND 22")} AS levening_db, {_leq(where="hour(dt_local) IN (23,0,1,2,3,4,5,6)")} AS lnight_db FROM ch),
ld AS (SELECT *, {_r("10e0 * log10((coalesce(12e0 * pow(10e0, lday_db / 10e0), 0) + coalesce(4e0 * pow(10e0, (levening_db + 5e0) / 10e0), 0) + coalesce(8e0 * pow(10e0, (lnight_db + 10e0) / 10e0), 0)) / (CASE WHEN lday_db IS NULL THEN 0e0 ELSE 12e0 END + CASE WHEN levening_db IS NULL THEN 0e0 ELSE 4e0 END + CASE WHEN lnight_db IS NULL THEN 0e0 ELSE 8e0 END))")} AS lden_db FROM lv)"""
_PEAKS = """lev AS (SELECT chunk_id, epoch_us(dt_utc) AS us, coalesce(lafmax, dba) AS level, dba, source_file, dt_utc FROM ch),
p1 AS (SELECT * FROM lev ORDER BY level DESC, dt_utc, chunk_id LIMIT 1),
p2 AS (SELECT lev.* FROM lev, p1 WHERE abs(lev.us - p1.us) >= 60000000 ORDER BY lev.level DESC, lev.dt_utc, lev.chunk_id LIMIT 1),
p3 AS (SELECT lev.* FROM lev, p1, p2 WHERE abs(lev.us - p1.us) >= 60000000 AND abs(lev.us - p2.us) >= 60000000 ORDER BY lev.level DESC, lev.dt_utc, lev.chunk_id LIMIT 1),
pk AS (SELECT CAST(1 AS INT) AS rank, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3)"""
_AMB = f"""{CH}, lv AS (SELECT *, dba - 120e0 AS raw, lafmax - 120e0 AS level, pow(10e0, (lafmax - 117e0) / 20e0) AS peak FROM ch),
am AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY dt_utc, chunk_id) AS k, round(coalesce(quantile_cont(raw, 0.1) OVER (PARTITION BY device_id ORDER BY dt_utc, chunk_id ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING), raw), 9) AS floor_, level - lag(level) OVER (PARTITION BY device_id ORDER BY dt_utc, chunk_id) AS delta FROM lv),
wg AS (SELECT *, greatest(12e0, least(40e0, -23e0 - floor_ - 18e0)) AS max_gain FROM am),
wa AS MATERIALIZED (SELECT *, level + max_gain >= -35e0 AS warm FROM wg)"""
_GATE = f"""{_AMB}, o AS MATERIALIZED (SELECT device_id, chunk_id, raw, level, delta, warm, level >= floor_ + 5e0 AND warm AS above, k FROM wa),
f AS (SELECT device_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS chunk_id, false AS gate_open, 0 AS streak, 'closed' AS reason FROM o WHERE k = 1
UNION ALL SELECT device_id, k, chunk_id, held OR jump, CASE WHEN held AND NOT jump THEN s ELSE 0 END, CASE WHEN jump THEN 'delta' WHEN was AND held THEN 'hold' WHEN held THEN 'l90' ELSE 'closed' END FROM (
  SELECT *, NOT held AND warm AND level >= -55e0 AND coalesce(delta >= 4e0, false) AS jump FROM (
    SELECT *, CASE WHEN was THEN s < 2 ELSE above END AS held FROM (
      SELECT o.device_id, o.k, o.chunk_id, o.level, o.delta, o.warm, o.above, f.gate_open AS was, CASE WHEN f.gate_open AND NOT o.above THEN f.streak + 1 ELSE 0 END AS s FROM f JOIN o ON o.device_id = f.device_id AND o.k = f.k + 1)))),
g AS (SELECT wa.*, f.gate_open, f.reason, f.streak FROM wa JOIN f USING (device_id, chunk_id) WHERE f.k > 0)"""
_TELE = f"""{CH}, te AS (SELECT *, NOT gated AND chunk_id % 3 <> 0 AS gate_open, CASE WHEN chunk_id % 5 = 0 THEN CASE WHEN gated THEN 'gated' ELSE 'triggered' END END AS clap_status,
CASE WHEN chunk_id % 7 = 0 THEN CASE WHEN gated THEN 'gated' ELSE 'triggered' END END AS dasm_status, device_id || '-r' AS recording_id, row_number() OVER (PARTITION BY source_file ORDER BY dt_utc, chunk_id) - 1 AS chunk_index FROM ch)"""
_ARMED = "a AS (SELECT device_id, chunk_id AS armed_id FROM ch WHERE top_label = 'Vehicle' AND dba >= 70)"
_SPAN_LABEL = "CASE WHEN {0} < 0 THEN NULL WHEN {0} = 0 THEN '0 min' WHEN {0} < 60 THEN '< 1 min' ELSE concat_ws(' ', CASE WHEN {0} // 86400 > 0 THEN ({0} // 86400) || ' d' END, CASE WHEN {0} // 3600 > 0 THEN ({0} % 86400 // 3600) || ' h' END, ({0} % 3600 // 60) || ' min') END"


def _indoor(x: str, a: int) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {_r(f'greatest(20e0, {x} - {a}e0)')} END"


def _theme() -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower(display_name), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in THEME_RULES)
    return f"CASE {cases} ELSE 'Other' END"


def _lived(name: str, where: str) -> str:
    """Badges of a selection."""
    return f"""SELECT * FROM (WITH {CH.replace("ch AS (", "c0 AS (", 1)}, ch AS (SELECT * FROM c0 WHERE {where}), {_LEVELS}, i AS (SELECT ld.*, (SELECT max(coalesce(lafmax, dba)) FROM ch) AS peak, {_indoor('lnight_db', 30)} AS nc, {_indoor('lnight_db', 15)} AS no, {_indoor('lden_db', 30)} AS lc, {_indoor('lden_db', 15)} AS lo, {_indoor('lday_db', 30)} AS dc, {_indoor('lday_db', 15)} AS do_ FROM ld),
        b AS (SELECT *, coalesce(nc, dc) AS bc, CASE WHEN nc IS NOT NULL THEN no ELSE do_ END AS bo, lnight_db IS NOT NULL AS night, lday_db IS NOT NULL OR levening_db IS NOT NULL AS day FROM i)
        SELECT '{name}' AS selection, lden_db, peak AS peak_db, CASE WHEN nc IS NULL THEN 'watch' WHEN nc <= 30 AND no <= 40 THEN 'ok' WHEN nc <= 40 THEN 'watch' ELSE 'alert' END AS sleep_badge, CASE WHEN lc IS NULL THEN 'watch' WHEN lc <= 35 AND lo <= 45 THEN 'ok' WHEN lc <= 50 THEN 'watch' ELSE 'alert' END AS office_badge,
        CASE WHEN bc IS NULL THEN 'watch' WHEN peak >= 70 OR (bo > 40 AND NOT bc <= 30) THEN 'alert' WHEN bo > 40 THEN 'watch' ELSE 'ok' END AS baby_badge, NOT (night AND day) AS insufficient, CASE WHEN NOT night THEN 'no night' WHEN NOT day THEN 'no day' END AS warning FROM b)"""


def _spectrum() -> str:
    """Summaries of the tones in closed form: under a Hann window a tone lies in its bin and, a quarter as strong, in the two beside it."""
    w = [f"2e0 * 48000 * tan(pi() * {c}e0 / 48000)" for c in dsp.CORNERS]
    curve = f"pow(pow({w[3]}, 2) * pow(10e0, {dsp.CURVE_GAIN}e0 / 20e0) * pow(w, 4) / ((w * w + pow({w[0]}, 2)) * sqrt((w * w + pow({w[1]}, 2)) * (w * w + pow({w[2]}, 2))) * (w * w + pow({w[3]}, 2))), 2)"
    half = 2 ** (1 / 6)
    centres = ", ".join(f"({k}, {c / half!r}, {c * half!r})" for k, c in enumerate(dsp.CENTRES))
    regions = ", ".join(f"({100 + k}, {a}e0, {b}e0)" for k, (a, b) in enumerate((dsp.LOW, dsp.MID, dsp.HIGH)))
    sides = []
    for k in ("z", "a"):
        share = lambda n, k=k: f"round(100e0 * sum({k}) FILTER (band = {n}) / sum({k}) FILTER (band >= 100), 1)"
        sides.append(
            f"string_agg(CAST(CAST(round(round(10e0 * log10(greatest({k}, 1e-20)), 1) * 10) AS INT) AS VARCHAR), ',' ORDER BY band) FILTER (band < 100) AS levels_{k}, "
            f"any_value(centroid_{k}) AS centroid_{k}, any_value(rolloff_{k}) AS rolloff_{k}, {share(100)} AS low_{k}, {share(101)} AS mid_{k}, {share(102)} AS high_{k}"
        )
    rolloff = ", ".join(
        f"round(sum(hz * {k}) / sum({k}), 1) AS centroid_{k}, any_value(f) + CASE WHEN sum({k}) FILTER (k = -1) >= 0.85e0 * sum({k}) THEN -10e0 WHEN sum({k}) FILTER (k < 1) >= 0.85e0 * sum({k}) THEN 0e0 ELSE 10e0 END AS rolloff_{k}" for k in ("z", "a")
    )
    return f"""WITH {CH}, t AS (SELECT chunk_id, 100e0 * (1 + chunk_id % 50) AS f, pow(10e0, (dba - 120e0) / 20e0) AS amp FROM ch),
        p AS (SELECT chunk_id, f, k, f + 10e0 * k AS hz, amp * amp * 0.1e0 / CASE WHEN k = 0 THEN 3e0 ELSE 12e0 END AS z, 2e0 * 48000 * tan(pi() * (f + 10e0 * k) / 48000) AS w FROM t, (SELECT unnest([-1, 0, 1]) AS k)),
        q AS (SELECT *, z * {curve} AS a FROM p), c AS (SELECT chunk_id, {rolloff} FROM q GROUP BY chunk_id),
        b AS (SELECT band, ceil(low / 10e0) AS first, floor(high / 10e0) AS last FROM (VALUES {centres}, {regions}) v(band, low, high)),
        s AS (SELECT chunk_id, band, sum(z * wide) AS z, sum(a * wide) AS a FROM (SELECT q.*, band, CASE WHEN hz / 10e0 < first OR hz / 10e0 > last OR first = last THEN 0e0 WHEN hz / 10e0 IN (first, last) THEN 5e0 ELSE 10e0 END AS wide FROM q, b) GROUP BY 1, 2)
        SELECT chunk_id, {", ".join(sides)} FROM s JOIN c USING (chunk_id) GROUP BY chunk_id"""


_C = "SELECT l_night_db, l50_day_db, noisy_pct, "
SQL = {
    "hourly_timeline": f"WITH {CH}, h AS (SELECT date_trunc('hour', dt_local) AS hour, {_STATS} FROM ch GROUP BY 1) SELECT {_T.format('hour')} AS hour, * EXCLUDE (hour), {_PERIOD.format('hour')} AS period FROM h WHERE chunks * 0.975e0 >= 5e0",
    "hourly_timeline_gaps": f"""WITH {CH}, h AS (SELECT date_trunc('hour', dt_local) AS hour, {_leq()} AS leq_db, count(*) AS chunks FROM ch GROUP BY 1 HAVING count(*) * 0.975e0 >= 12 * 0.975e0),
        p AS (SELECT *, lag(hour) OVER (ORDER BY hour) AS prev FROM h), q AS (SELECT prev, CAST((epoch(hour) - epoch(prev)) // 3600 - 1 AS BIGINT) AS g FROM p)
        SELECT {_T.format('hour')} AS hour, leq_db, chunks, false AS is_gap, NULL::BIGINT AS gap_hours, NULL::VARCHAR AS gap FROM h
        UNION ALL SELECT {_T.format("prev + INTERVAL 1 HOUR")}, NULL, NULL, true, g, {_GAP} FROM q WHERE g > 0""",
    "typical_day": f"WITH {CH}, h AS (SELECT hour(dt_local) AS hour, {_STATS} FROM ch GROUP BY 1), r AS (SELECT CAST(range AS INT) AS hour FROM range(24)) SELECT r.hour, leq_db, l90_db, l10_db, coalesce(chunks, 0) AS chunks, coalesce(gated_chunks, 0) AS gated_chunks, gated_pct, CASE WHEN r.hour IN {_NIGHT} THEN 'night' ELSE 'day' END AS period FROM r LEFT JOIN h ON r.hour = h.hour",
    "level_percentiles": f"WITH {CH} SELECT device_id, {_p(0.9)} AS l10_db, {_p(0.5)} AS l50_db, {_p(0.1)} AS l90_db FROM ch GROUP BY 1",
    "leq_by_device": f"WITH {CH} SELECT device_id, {_leq()} AS leq_db, count(*) AS chunks FROM ch GROUP BY 1",
    "recording_summary": f"WITH {CH}, s AS (SELECT source_file, count(*) AS chunks, min(dt_utc) AS a, max(dt_utc) AS b FROM ch GROUP BY 1) SELECT source_file, chunks, {_T.format('a')} AS first_utc, {_T.format('b')} AS last_utc, {_r('CASE WHEN b > a THEN ' + _SECONDS.format('a', 'b') + ' + 0.975e0 ELSE chunks * 0.975e0 END', 3)} AS seconds FROM s",
    "location": f"WITH {CH}, s AS (SELECT device_id, count(*) AS c, min((dt_utc, chunk_id)) AS f FROM ch GROUP BY 1) SELECT device_id AS location FROM s ORDER BY c DESC, f LIMIT 1",
    "lden": f"WITH {CH}, {_LEVELS} SELECT * FROM ld",
    "vote_labels": f"WITH {CH}, {VO} SELECT chunk_id, vote, macro, category FROM vm",
    "theme_catalog": f"WITH {CH}, n AS (SELECT p_name AS display_name FROM part UNION ALL SELECT DISTINCT top_label FROM ch) SELECT {_theme()} AS theme, count(*) AS labels FROM n GROUP BY 1",
    "time_budget_total": _budget("", ""),
    "time_budget_period": _budget(_PERIOD.format("dt_local"), "period"),
    "time_budget_hourly": f"""WITH {CH}, {VO}, b AS (SELECT date_trunc('hour', dt_local) AS hour, category, count(*) AS chunks FROM vm GROUP BY 1, 2),
        t AS (SELECT *, sum(chunks) OVER (PARTITION BY hour) * 0.975e0 AS seconds_total, sum(chunks) OVER (PARTITION BY hour) AS n FROM b),
        h AS (SELECT * FROM t WHERE seconds_total >= 12 * 0.975e0), p AS (SELECT hour, lag(hour) OVER (ORDER BY hour) AS prev FROM (SELECT DISTINCT hour FROM h)),
        q AS (SELECT prev, CAST((epoch(hour) - epoch(prev)) // 3600 - 1 AS BIGINT) AS g FROM p)
        SELECT {_T.format('hour')} AS hour, category, CAST(row_number() OVER (PARTITION BY hour ORDER BY {_PLACE}, category) AS INT) AS place, chunks, chunks * 0.975e0 AS seconds, {_r('100e0 * chunks / n')} AS pct, seconds_total, false AS is_gap, NULL::BIGINT AS gap_hours, NULL::VARCHAR AS gap, strftime(hour, '%d %b %H:%M') AS label, {_PERIOD.format('hour')} AS period FROM h
        UNION ALL SELECT {_T.format("prev + INTERVAL 1 HOUR")}, NULL, NULL, NULL, NULL, NULL, NULL, true, g, {_GAP}, {_GAP}, NULL FROM q WHERE g > 0""",
    "acoustic_events": f"WITH {_events('45e0')} SELECT {_EV} FROM ev",
    "acoustic_events_top": f"WITH {_events('45e0')} SELECT {_EV} FROM ev ORDER BY duration_s DESC, max_dba DESC, start_rn LIMIT 12",
    "events_l90_threshold": f"WITH {_events(f'(SELECT {_p(0.1)} + 5e0 FROM ch)')} SELECT start_rn, chunk_count, max_dba, leq_db, threshold, threshold - 5e0 AS l90_db FROM ev",
    "sound_diet": f"WITH {_events('45e0')}, d AS (SELECT macro, sum(duration_s) AS secs, count(*) AS events FROM ev GROUP BY 1) SELECT macro, {_r('secs')} AS event_seconds, events, {_r('100e0 * secs / sum(secs) OVER ()')} AS pct FROM d",
    "label_spans": f"WITH {_SPANS} SELECT device_id, label, {_T.format('t0')} AS t0, {_T.format('t1')} AS t1, height, confidence, rows FROM sp",
    "change_markers": f"WITH {_SPANS} SELECT device_id, label, {_T.format('t0')} AS t, height AS dba, confidence FROM sp",
    "downsample_points": f"WITH {CH}, n AS (SELECT *, row_number() OVER (ORDER BY dt_utc, chunk_id) AS rn, count(*) OVER () AS total FROM ch), b AS (SELECT *, CASE WHEN total <= 1500 THEN rn ELSE (rn * 1500 - 1) // total END AS b FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY dba DESC, lafmax DESC, rn) AS k FROM b) SELECT rn, chunk_id, dba, lafmax FROM o WHERE k = 1",
    "inspect_window": f"WITH {CH} SELECT chunk_id, device_id, dba, top_label FROM ch WHERE epoch_us(dt_utc) BETWEEN epoch_us(TIMESTAMP '2024-01-10 12:00:00') - 450000000 AND epoch_us(TIMESTAMP '2024-01-10 12:00:00') + 450000000",
    "top_disturbances": f"WITH {CH}, {VO}, {_PEAKS} SELECT rank, pk.chunk_id, level, pk.dba, pk.source_file, category, CASE WHEN gated THEN 'Relative silence' ELSE coalesce(vote, 'Unclassified / Ambient') END AS label, {_T.format('dt_local')} AS at_local FROM pk JOIN vm ON pk.chunk_id = vm.chunk_id",
    "peak_snippets": f"WITH {CH}, {_PEAKS}, j AS (SELECT rank, ch.chunk_id, (epoch_us(ch.dt_utc) - us) / 1e6 AS offset_s, ch.dba FROM ch JOIN pk ON ch.source_file = pk.source_file AND abs(epoch_us(ch.dt_utc) - us) <= 3600000000) SELECT *, row_number() OVER (PARTITION BY rank ORDER BY abs(offset_s), chunk_id) = 1 AS nearest FROM j",
    "overview_summary": f"""WITH {_TELE} SELECT device_id, count(*) AS chunks, {_r('avg(dba)')} AS mean_dba, {_p(0.5)} AS l50_db, {_p(0.9)} AS l10_db, {_p(0.1)} AS l90_db, {_leq()} AS leq_db, {_r('avg(lafmax)')} AS mean_lafmax, max(lafmax) AS max_lafmax,
        count(*) FILTER (WHERE lafmax >= 65e0) AS loud_chunks, CASE WHEN count(lafmax) > 0 THEN {_r('100e0 * count(*) FILTER (WHERE lafmax >= 65e0) / count(lafmax)')} ELSE 0e0 END AS loud_pct, {_r('100e0 * count(*) FILTER (WHERE gated) / count(*)')} AS gated_pct, {_r('100e0 * count(*) FILTER (WHERE NOT gated AND gate_open) / count(*)')} AS gate_open_pct, count(*) FILTER (WHERE NOT gated AND top_label IS NOT NULL) AS classified, CASE WHEN count(*) = 1 THEN 1 ELSE CAST(floor((epoch_us(max(dt_utc)) - epoch_us(min(dt_utc))) / 1e6) AS BIGINT) END AS duration_s FROM te GROUP BY 1""",
    "top_labels": f"WITH {CH} SELECT top_label, count(*) AS rows FROM ch WHERE NOT gated GROUP BY 1 ORDER BY 2 DESC, min((dt_utc, chunk_id)) LIMIT 8",
    "comfort_rating": f"""WITH {CH}, a AS (SELECT {_leq(where=f"hour(dt_local) IN {_NIGHT}")} AS l_night_db, {_p(0.5, where=f"hour(dt_local) NOT IN {_NIGHT}")} AS l50_day_db, {_r("100e0 * count(*) FILTER (WHERE NOT gated) / count(*)")} AS noisy_pct FROM ch),
        b AS (SELECT *, least(40e0, greatest(0e0, (l_night_db - 40e0) * 2e0)) AS rn, least(35e0, greatest(0e0, (l50_day_db - 45e0) * 1.5e0)) AS rd, least(25e0, greatest(0e0, noisy_pct - 10e0)) AS rv FROM a),
        c AS (SELECT *, 100e0 / (CASE WHEN rn IS NULL THEN 0e0 ELSE 40e0 END + CASE WHEN rd IS NULL THEN 0e0 ELSE 35e0 END + CASE WHEN rv IS NULL THEN 0e0 ELSE 25e0 END) AS scale FROM b),
        d AS (SELECT *, coalesce({_r('rn * scale', 2)}, 0) AS night_penalty, coalesce({_r('rd * scale', 2)}, 0) AS day_penalty, coalesce({_r('rv * scale', 2)}, 0) AS volatility_penalty FROM c),
        e AS (SELECT *, CAST(round_even(greatest(0e0, least(100e0, 100e0 - night_penalty - day_penalty - volatility_penalty)), 0) AS INT) AS score FROM d)
        {_C} night_penalty, day_penalty, volatility_penalty, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade,
        CASE WHEN score >= 85 THEN 'Tranquil' WHEN score >= 70 THEN 'Balanced' WHEN score >= 55 THEN 'Active' WHEN score >= 40 THEN 'Vibrant' ELSE 'Intense' END AS label,
        CASE WHEN l50_day_db IS NOT NULL AND l_night_db IS NOT NULL THEN 'full' WHEN l50_day_db IS NOT NULL THEN 'day only' WHEN l_night_db IS NOT NULL THEN 'night only' ELSE 'none' END AS coverage, l50_day_db IS NULL OR l_night_db IS NULL AS insufficient FROM e""",
    "indoor_badges": f"""WITH {CH}, {_LEVELS}, i AS (SELECT ld.*, (SELECT max(lafmax) FROM ch) AS peak, {_indoor('lnight_db', 30)} AS night_closed, {_indoor('lnight_db', 15)} AS night_open, {_indoor('lden_db', 30)} AS lden_closed, {_indoor('lden_db', 15)} AS lden_open, {_indoor('lday_db', 30)} AS day_closed, {_indoor('lday_db', 15)} AS day_open FROM ld),
        b AS (SELECT *, coalesce(night_closed, day_closed) AS bc, CASE WHEN night_closed IS NOT NULL THEN night_open ELSE day_open END AS bo FROM i)
        SELECT * EXCLUDE (bc, bo), CASE WHEN night_closed IS NULL THEN 'watch' WHEN night_closed <= 30 AND night_open <= 40 THEN 'ok' WHEN night_closed <= 40 THEN 'watch' WHEN night_closed <= 30 AND night_open <= 45 THEN 'watch' ELSE 'alert' END AS sleep_badge,
        CASE WHEN lden_closed IS NULL THEN 'watch' WHEN lden_closed <= 35 AND lden_open <= 45 THEN 'ok' WHEN lden_closed <= 50 THEN 'watch' ELSE 'alert' END AS office_badge,
        CASE WHEN bc IS NULL THEN 'watch' WHEN peak >= 70 OR (bo > 40 AND NOT bc <= 30) THEN 'alert' WHEN bo > 40 THEN 'watch' ELSE 'ok' END AS baby_badge FROM b""",
    "who_check": f"WITH {CH}, {_LEVELS} SELECT lnight_db, lden_db, lnight_db <= 45 AS night_met, lden_db <= 53 AS day_met, {_r('lnight_db - 45e0')} AS night_delta, {_r('lden_db - 53e0')} AS day_delta, CASE WHEN lnight_db IS NULL AND lden_db IS NULL THEN 'watch' WHEN coalesce(lnight_db <= 45, true) AND coalesce(lden_db <= 53, true) THEN 'ok' WHEN coalesce(lnight_db <= 45, false) OR coalesce(lden_db <= 53, false) THEN 'watch' ELSE 'alert' END AS tone FROM ld",
    "ambient_floor": f"WITH {_AMB} SELECT chunk_id, {_r('floor_', 6)} AS floor, {_r('delta', 6)} AS delta, {_r('max_gain', 6)} AS max_gain, warm FROM wa",
    "gain_smoothing": f"""WITH RECURSIVE {_GATE}, l AS (SELECT chunk_id, avg(pow(10e0, raw / 20e0)) OVER (PARTITION BY device_id ORDER BY dt_utc, chunk_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rms, peak, max_gain FROM g WHERE gate_open)
        SELECT g.chunk_id, gate_open, {_r('CASE WHEN gate_open THEN 20e0 * log10(greatest(rms, 1e-12)) ELSE raw END', 6)} AS smoothed_dbfs, CASE WHEN gate_open THEN {_r('least(least(pow(10e0, -23e0 / 20e0) / greatest(rms, 1e-12), 0.9e0 / l.peak), pow(10e0, l.max_gain / 20e0))', 4)} ELSE 0e0 END AS gain FROM g LEFT JOIN l ON g.chunk_id = l.chunk_id""",
    "gate_state": f"WITH RECURSIVE {_GATE} SELECT device_id, chunk_id, gate_open, reason, streak FROM g",
    "fixed_capture_windows": f"WITH {CH}, a AS (SELECT device_id, chunk_id AS armed_id, dt_utc AS at FROM ch WHERE top_label = 'Vehicle' AND dba >= 70) SELECT a.device_id, armed_id, count(*) AS rows, CAST(sum(chunk_id) AS BIGINT) AS ids FROM a JOIN ch ON a.device_id = ch.device_id AND ch.dt_utc BETWEEN a.at - INTERVAL 1800 SECOND AND a.at + INTERVAL 1800 SECOND GROUP BY 1, 2",
    "zero_shot_topk": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings), s AS (SELECT c.vec_id, p.vec_id AS prompt_id, array_cosine_similarity(c.e, p.e) AS sim FROM v c, v p WHERE p.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, prompt_id) AS rank FROM s) SELECT vec_id, CAST(rank AS INT) AS rank, prompt_id, {_r('greatest(0e0, least(1e0, (sim + 1e0) / 2e0))', 6)} AS confidence FROM r WHERE rank <= 3""",
    "embedding_quality": "SELECT count(*) AS vectors, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64) AS wrong_length, count(*) FILTER (WHERE coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0, true)) AS not_finite, count(*) FILTER (WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) > 1e-3) AS not_unit FROM embeddings",
    "frame_spans": f"""WITH {CH}, i AS (SELECT device_id || '/' || strftime(dt_utc, '%Y-%m-%d') AS clip, top_confidence AS s, row_number() OVER (PARTITION BY device_id, CAST(dt_utc AS DATE) ORDER BY dt_utc, chunk_id) - 1 AS i FROM ch),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY clip ORDER BY i) AS g FROM i WHERE s >= 0.5e0), r AS (SELECT clip, g, min(i) AS a, max(i) + 1 AS b, max(s) AS m FROM g GROUP BY 1, 2) SELECT clip, {_r('a / 50e0', 3)} AS t0_s, {_r('b / 50e0', 3)} AS t1_s, {_r('m', 4)} AS confidence FROM r""",
    "json_props": f"SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS rows, {_r('avg(value)', 6)} AS mean_value FROM events GROUP BY 1",
    "export_projection": f"WITH {CH} SELECT chunk_id, device_id, dba, device_id || '-no-spectrum.jsonl' AS file FROM ch",
    "spectrum_bands": _spectrum(),
    "octave_bands": f"WITH {CH}, b AS (SELECT centre, centre / pow(2e0, 1e0 / 6e0) AS low, centre * pow(2e0, 1e0 / 6e0) AS high FROM (VALUES {', '.join(f'({c}e0)' for c in dsp.CENTRES)}) t(centre)) SELECT centre, {_r('low', 6)} AS low, {_r('high', 6)} AS high, count(chunk_id) AS chunks FROM b LEFT JOIN ch ON 100e0 * (1 + chunk_id % 50) >= low AND 100e0 * (1 + chunk_id % 50) < high GROUP BY centre, low, high",
    "resource_levels": "SELECT CASE WHEN value >= 90 THEN 'critical' WHEN value >= 75 THEN 'warn' WHEN value IS NULL THEN 'unknown' ELSE 'ok' END AS level, CASE WHEN (event_id * 4099) & 15 > 0 THEN 'critical' WHEN (event_id * 4099) & 983040 > 0 THEN 'warn' ELSE 'ok' END AS throttle, count(*) AS rows FROM events GROUP BY 1, 2",
    "label_formats": f"""WITH {CH}, p AS (SELECT device_id, min(dt_local) AS a, max(dt_local) AS b, count(*) AS n, {_leq()} AS level FROM ch GROUP BY 1),
        m AS (SELECT *, CAST(floor((epoch_us(b) - epoch_us(a)) / 1e6) AS BIGINT) AS m, n * 700e0 AS z FROM p)
        SELECT device_id, {_SPAN_LABEL.format('m')} AS duration,
        CASE WHEN z < 1024 THEN CAST(CAST(z AS BIGINT) AS VARCHAR) || ' B' WHEN z < 1048576 THEN printf('%.1f KB', z / 1024e0) ELSE printf('%.1f MB', z / 1048576e0) END AS size,
        CASE WHEN CAST(a AS DATE) = CAST(b AS DATE) THEN strftime(a, '%Y-%m-%d') WHEN year(a) = year(b) AND month(a) = month(b) THEN strftime(a, '%b %-d') || ' – ' || strftime(b, '%-d') WHEN year(a) = year(b) THEN strftime(a, '%b %-d') || ' – ' || strftime(b, '%b %-d') ELSE strftime(a, '%b %d, %Y') || ' – ' || strftime(b, '%b %d, %Y') END AS span,
        CASE WHEN level < 40 THEN 'Quiet bedroom' WHEN level < 55 THEN 'Conversational backdrop' WHEN level < 70 THEN 'Busy street / TV' ELSE 'Lawnmower / peak traffic' END AS anchor,
        CASE WHEN hour(a) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(a) BETWEEN 12 AND 17 THEN 'day' WHEN hour(a) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS part, device_id || 'ünï' AS name FROM m""",
    "chart_categories": f"WITH {CH}, {VO}, c AS (SELECT DISTINCT category FROM vm) SELECT category, CAST(row_number() OVER (ORDER BY {_PLACE}, category) AS INT) AS place FROM c",
    "total_duration": f"WITH {CH}, s AS (SELECT source_file, count(*) AS chunks, min(dt_utc) AS a, max(dt_utc) AS b FROM ch GROUP BY 1), t AS (SELECT {_r('CASE WHEN b > a THEN ' + _SECONDS.format('a', 'b') + ' + 0.975e0 ELSE chunks * 0.975e0 END', 3)} AS seconds FROM s) SELECT count(*) AS recordings, {_r('sum(seconds)')} AS seconds FROM t",
    "inspect_marks": "WITH " + _SPANS.replace("FROM ch)", "FROM ch WHERE epoch_us(dt_utc) BETWEEN epoch_us(TIMESTAMP '2024-01-10 12:00:00') - 450000000 AND epoch_us(TIMESTAMP '2024-01-10 12:00:00') + 450000000)").replace("0.25e0", "0e0") + f" SELECT device_id, label, {_T.format('t0')} AS t0, {_T.format('t1')} AS t1, height, confidence, rows FROM sp",
    "overview_identity": f"WITH {_TELE} SELECT source_file, any_value(device_id) AS first_device, any_value(recording_id) AS first_recording, {_T.format('min(dt_utc)')} AS started_at, {_T.format('max(dt_utc)')} AS ended_at, CASE WHEN count(dasm_status) > 0 THEN 'dasm' WHEN count(clap_status) > 0 THEN 'clap' ELSE 'off' END AS heavy_ml FROM te GROUP BY 1",
    "overview_labels": f"""WITH {_TELE}, l AS (SELECT source_file, 'yamnet' AS kind, top_label AS label, dt_utc, chunk_id FROM te WHERE NOT gated AND top_label <> 'gated'
        UNION ALL SELECT source_file, 'clap', 'a ' || lower(top_label), dt_utc, chunk_id FROM te WHERE clap_status = 'triggered'
        UNION ALL SELECT source_file, 'dasm', unnest(CASE WHEN chunk_id % 2 = 0 THEN ['Car', 'Wind'] ELSE [top_label] END), dt_utc, chunk_id FROM te WHERE dasm_status = 'triggered'),
        c AS (SELECT source_file, kind, label, count(*) AS rows, min((dt_utc, chunk_id)) AS f FROM l GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY source_file, kind ORDER BY rows DESC, f, label) AS place FROM c) SELECT source_file, kind, CAST(place AS INT) AS place, label, rows FROM r WHERE place <= 8""",
    "recordings_catalog": f"""WITH {_TELE}, p AS (SELECT source_file AS name, count(*) AS lines, min(dt_utc) AS a, max(dt_utc) AS b, min(dt_local) AS l, CASE WHEN count(dasm_status) > 0 THEN 'dasm' WHEN count(clap_status) > 0 THEN 'clap' ELSE 'off' END AS heavy_ml FROM te GROUP BY 1),
        q AS (SELECT *, CASE WHEN b = a THEN 1 ELSE CAST(floor((epoch_us(b) - epoch_us(a)) / 1e6) AS BIGINT) END AS d FROM p)
        SELECT name, lines, strftime(l, '%Y-%m-%d %H:%M') || CASE WHEN epoch(l) - epoch(a) = 7200 THEN ' CEST' ELSE ' CET' END AS started, d AS duration_s, {_SPAN_LABEL.format('d')} AS duration, heavy_ml, {_T.format('b')} AS modified FROM q""",
    "recording_bounds": f"WITH {CH}, b AS (SELECT source_file, arg_min(ch, (dt_utc, chunk_id)) AS f, arg_max(ch, (dt_utc, chunk_id)) AS l FROM ch GROUP BY 1) SELECT source_file, f.chunk_id AS first_chunk_id, f.dba AS first_dba, f.top_label AS first_top_label, l.chunk_id AS last_chunk_id, l.dba AS last_dba, l.top_label AS last_top_label FROM b",
    "status_snapshot": f"""WITH {_TELE}, b AS (SELECT source_file, count(*) AS chunk_count, arg_max(top_label, (dt_utc, chunk_id)) AS last_label, arg_max(dba, (dt_utc, chunk_id)) AS last_dba, min(dt_utc) AS a, any_value(recording_id) AS recording_id FROM te GROUP BY 1)
        SELECT source_file, chunk_count, last_label, last_dba, {_T.format('a')} AS started_at, CAST(floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(a)) / 1e6) AS BIGINT) AS elapsed_s, recording_id FROM b""",
    "stored_events": f"WITH {_TELE} SELECT device_id, strftime(dt_utc, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, CAST(chunk_index AS INT) AS chunk_index, recording_id, round(pow(10e0, (dba - 120e0) / 20e0), 8) AS rms_unweighted, round(dba, 1) AS \"dBA_spl\", CASE WHEN chunk_id % 11 = 0 THEN 'n/a' ELSE top_label END AS top_label, CASE WHEN chunk_id % 11 = 0 THEN 0e0 ELSE top_confidence END AS top_confidence, round(lafmax, 1) AS \"LAFmax_dB\" FROM te",
    "gate_metadata": f"WITH RECURSIVE {_GATE} SELECT chunk_id, round(floor_, 1) AS ambient_noise_floor_dbfs, round(floor_ + 5e0, 1) AS silence_gate_open_dbfs, round(level, 1) AS gate_level_dbfs, round(raw, 1) AS raw_rms_dbfs, CAST(least(k, 300) AS INT) AS ambient_sample_count, NOT gate_open AS gated, reason AS gate_open_reason FROM g",
    "capture_onsets": f"""WITH RECURSIVE {_GATE}, r AS (SELECT *, k - coalesce(max(CASE WHEN NOT gate_open THEN k END) OVER w, 0) AS opened, k - coalesce(max(CASE WHEN NOT raw > floor_ + 3e0 THEN k END) OVER w, 0) AS high FROM g WINDOW w AS (PARTITION BY device_id ORDER BY k)),
        s AS (SELECT *, least(CASE WHEN opened > 0 THEN opened WHEN high > 0 THEN high ELSE 1 END, k, 5) AS run FROM r)
        SELECT device_id, chunk_id, CASE WHEN opened > 0 THEN 'gate_open' WHEN high > 0 THEN 'energy_rise' ELSE 'trigger_chunk' END AS reason, CAST(run - 1 AS INT) AS rows_back, least(run * 0.975e0 + 0.15e0, least(k * 0.975e0, 4e0)) AS lead_s FROM s""",
    "lookback_rows": f"WITH {CH}, {_ARMED}, n AS (SELECT device_id, chunk_id, row_number() OVER (PARTITION BY device_id ORDER BY dt_utc, chunk_id) AS k FROM ch) SELECT x.device_id, a.armed_id, y.chunk_id, CAST(x.k - y.k AS INT) AS back, least(0.975e0, 4e0 - (x.k - y.k) * 0.975e0) AS kept_s FROM a JOIN n x ON x.chunk_id = a.armed_id JOIN n y ON y.device_id = x.device_id AND y.k BETWEEN x.k - 4 AND x.k",
    "fixed_capture_fill": f"""WITH {CH}, {_ARMED}, n AS (SELECT device_id, chunk_id, row_number() OVER (PARTITION BY device_id ORDER BY dt_utc, chunk_id) AS k, count(*) OVER (PARTITION BY device_id) AS total FROM ch),
        p AS (SELECT n.device_id, armed_id, least(5e0, k * 0.975e0) AS pre_s, least(5e0, (total - k) * 0.975e0) AS post_s FROM a JOIN n ON n.chunk_id = armed_id) SELECT *, 5e0 - pre_s AS pad_before_s, 5e0 - post_s AS pad_after_s, post_s >= 5e0 AS complete FROM p""",
    "host_levels": f"""WITH v AS (SELECT event_id, value, event_type, value * 268435456e0 / 1073741824e0 AS gib, 100e0 * (value * 268435456e0) / 17179869184e0 AS pct, event_id * 4099 AS m FROM events),
        l AS (SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN -value < -70 THEN 'critical' WHEN -value < -60 THEN 'warn' ELSE 'ok' END AS wifi, {_r('greatest(0e0, least(100e0, (90e0 - value) / 60e0 * 100e0))')} AS wifi_pct,
          CASE WHEN event_type = 'error' OR value IS NULL OR value >= 200 THEN 'critical' WHEN value >= 80 THEN 'warn' ELSE 'ok' END AS ping, CASE WHEN gib < 1 OR pct < 10 THEN 'critical' WHEN gib < 4 OR pct < 20 THEN 'warn' ELSE 'ok' END AS disk,
          CASE WHEN value IS NULL THEN 'unknown' WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'warn' ELSE 'ok' END AS cpu, CASE WHEN value IS NULL THEN 'unknown' WHEN value >= 80 THEN 'critical' WHEN value >= 70 THEN 'warn' ELSE 'ok' END AS temperature,
          concat_ws(',', CASE WHEN m & 1 > 0 THEN 'under_voltage' END, CASE WHEN m & 2 > 0 THEN 'freq_capped' END, CASE WHEN m & 4 > 0 THEN 'throttled' END, CASE WHEN m & 8 > 0 THEN 'soft_temp_limit' END) AS now,
          concat_ws(',', CASE WHEN m & 65536 > 0 THEN 'under_voltage' END, CASE WHEN m & 131072 > 0 THEN 'freq_capped' END, CASE WHEN m & 262144 > 0 THEN 'throttled' END, CASE WHEN m & 524288 > 0 THEN 'soft_temp_limit' END) AS since_start FROM v)
        SELECT *, CASE WHEN 'critical' IN (wifi, ping, disk, cpu, temperature) THEN 'critical' WHEN 'warn' IN (wifi, ping, disk, cpu, temperature) THEN 'warn' ELSE 'ok' END AS overall FROM l""",
    "value_formats": f"""WITH {CH}, n AS (SELECT *, CASE WHEN (chunk_id % 400 % 30) * 60 + chunk_id % 400 % 61 = 0 THEN 60 ELSE (chunk_id % 400 % 30) * 60 + chunk_id % 400 % 61 END AS m FROM ch)
        SELECT chunk_id, CASE WHEN m % 60 = 0 THEN (m // 60) || 'h' ELSE m || 'm' END AS timeout, printf('%.1f dBA', dba) AS level, strftime(date_trunc('hour', dt_local), '%d %b %H:%M') AS hour_label, strftime(dt_local, '%d %b') AS day_label, strftime(dt_utc, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(dt_utc, '%Y-%m-%dT%H-%M-%SZ') AS recording FROM n""",
    "host_texts": """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'net ' || event_id END AS ssid, CASE WHEN event_id % 5 <> 0 THEN floor((-(event_id % 60 + 30) - 0.25e0) * 10e0 + 0.5e0) / 10e0 END AS dbm, CASE WHEN event_id % 3 <> 0 THEN event_id % 300 + 0.5e0 END AS ping_ms,
        'wlan0' AS interface, event_id % 2 = 0 AS cards, CASE event_id % 4 WHEN 0 THEN 1.5e0 WHEN 1 THEN CAST(-event_id AS DOUBLE) ELSE CAST(event_id AS DOUBLE) END AS number, CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 0 ELSE event_id END AS count,
        CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE event_id END AS count_or_null FROM events""",
    "lived_experience": " UNION ALL ".join(_lived(*x) for x in (("all", "true"), ("quiet nights", f"hour(dt_local) NOT IN {_NIGHT} OR dba < 40"), ("quiet", f"dba < CASE WHEN hour(dt_local) IN {_NIGHT} THEN 40 ELSE 60 END"), ("days", f"hour(dt_local) NOT IN {_NIGHT}"))),
    "arm_cooldown": f"""WITH RECURSIVE {CH}, w AS (SELECT device_id, chunk_id, epoch_us(dt_utc) / 1e6 AS sec, dba, NOT gated AS open, row_number() OVER o AS k, max(CASE WHEN gated THEN 1 ELSE 0 END) OVER o AS any_, list(dba) OVER (PARTITION BY device_id ORDER BY dt_utc, chunk_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS five,
          CASE WHEN top_label IN ('Vehicle', 'Speech') THEN 'label:' || top_label WHEN top_label = 'Wind' AND dba >= 55 THEN 'ambiguous:Wind@dBA>=55.0' END AS cand FROM ch WINDOW o AS (PARTITION BY device_id ORDER BY dt_utc, chunk_id)),
        x AS (SELECT *, k - coalesce(max(CASE WHEN NOT open THEN k END) OVER (PARTITION BY device_id ORDER BY k), 0) AS run FROM w),
        y AS (SELECT *, least(least(run, least(k, 5)) * 0.975e0 + 0.15e0, least(least(k, 5) * 0.975e0, 4e0)) AS lead FROM x),
        r AS MATERIALIZED (SELECT *, list_max(list_slice(five, -CAST(ceil(lead / 0.975e0 - 1e-9) AS INT), -1)) AS seed FROM y),
        f AS (SELECT device_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS chunk_id, '' AS status, '' AS reason, NULL::BIGINT AS capture_of, NULL::VARCHAR AS end_reason, NULL::DOUBLE AS event_seconds, NULL::DOUBLE AS dba_peak,
            NULL::DOUBLE AS last_arm, false AS active, 0e0 AS seconds, 0e0 AS peak, 0 AS closed, 0 AS decay, CAST(-1 AS BIGINT) AS armed_id FROM r WHERE k = 1
          UNION ALL SELECT device_id, k, chunk_id, CASE WHEN was THEN 'pending' WHEN NOT open THEN 'gated' WHEN arms THEN 'scheduled' ELSE 'skipped' END,
            CASE WHEN was THEN 'capturing' WHEN NOT open THEN 'gated' WHEN arms THEN cand WHEN cand IS NULL THEN 'no_match' ELSE 'cooldown' END,
            CASE WHEN why IS NOT NULL THEN armed END, why, CASE WHEN why IS NOT NULL THEN round(sec_, 3) END, CASE WHEN why IS NOT NULL THEN peak_ END,
            CASE WHEN arms THEN sec ELSE last_arm END, (was OR arms) AND why IS NULL, sec_, peak_, closed_, decay_, CASE WHEN arms THEN chunk_id ELSE armed END FROM (
            SELECT *, CASE WHEN NOT was THEN NULL WHEN sec_ >= 5 THEN 'capped' WHEN closed_ >= 2 THEN 'gate_close' WHEN decay_ >= 2 THEN 'peak_decay' END AS why FROM (
              SELECT *, CASE WHEN was OR arms THEN CASE WHEN dba <= peak_ - 5e0 THEN CASE WHEN was THEN decay + 1 ELSE 1 END ELSE 0 END ELSE decay END AS decay_ FROM (
                SELECT *, CASE WHEN was THEN greatest(peak, dba) WHEN arms THEN seed ELSE peak END AS peak_, CASE WHEN was THEN least(seconds + 0.975e0, 5e0) WHEN arms THEN lead ELSE seconds END AS sec_, CASE WHEN was AND NOT open THEN closed + 1 WHEN was OR arms THEN 0 ELSE closed END AS closed_ FROM (
                  SELECT r.device_id, r.k, r.chunk_id, r.sec, r.dba, r.open, r.cand, r.lead, r.seed, f.active AS was, f.last_arm, f.seconds, f.peak, f.closed, f.decay, f.armed_id AS armed,
                    NOT f.active AND r.open AND r.cand IS NOT NULL AND (f.last_arm IS NULL OR r.sec - f.last_arm >= 5) AS arms FROM f JOIN r ON r.device_id = f.device_id AND r.k = f.k + 1)))))
        SELECT device_id, chunk_id, status, reason, capture_of, end_reason, event_seconds, dba_peak FROM f WHERE k > 0""",
}
SQL |= {
    "level_histograms": f"WITH {CH}, {VO} SELECT strftime(dt_local, '%Y-%m-%d') AS day, {_T.format("date_trunc('hour', dt_local)")} AS hour, device_id, source_file, category, gated, CAST(round(dba * 10) AS INT) AS tenth, count(*) AS chunks, max(coalesce(lafmax, dba)) AS max_peak FROM vm GROUP BY ALL",
    "histogram_devices": f"WITH {CH} SELECT device_id, {_leq()} AS leq_db, count(*) AS chunks, {_p(0.9)} AS l10_db, {_p(0.5)} AS l50_db, {_p(0.1)} AS l90_db FROM ch GROUP BY 1",
    # A tone has whole cycles in half a chunk, so its power there is half the square of its strength.
    "captured_waveforms": f"""WITH {CH}, r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY dt_utc, chunk_id) AS rn, pow(10e0, (dba - 120e0) / 10e0) / 2 AS power FROM ch),
        w AS (SELECT a.device_id, a.chunk_id AS armed_id, k.part, r.power FROM r a CROSS JOIN (VALUES (-1, 2400), (0, 4800), (1, 4800), (2, 2400)) k(ahead, part) LEFT JOIN r ON r.device_id = a.device_id AND r.rn = a.rn + k.ahead WHERE a.top_label = 'Vehicle' AND a.dba >= 85)
        SELECT device_id, armed_id, 14400 AS samples, CAST(coalesce(sum(part) FILTER (power IS NULL), 0) AS BIGINT) AS missing, {_r('10e0 * log10(sum(part * power) / 14400e0)', 3)} AS level_db FROM w GROUP BY 1, 2""",
    "histogram_timeline": SQL["hourly_timeline"], "histogram_typical_day": SQL["typical_day"], "histogram_lden": SQL["lden"], "histogram_budget": SQL["time_budget_period"],
}
