"""DuckDB SQL of the registered queries, written from the operators' definitions."""

from __future__ import annotations

from ..config import ACCURACY, CONSUMER_NAMES, INDUSTRIAL_NAMES, LIMITS, POSITION_SIGMA, RELIABILITY, UAV_BANDS_MHZ
from ..sources.events import OBSERVATION_SQL

R = "6371000.0::double"
BASE = (
    "with recursive "
    + OBSERVATION_SQL
    + f""",
located as (select *, 30.45 + degrees(n / {R}) as lat, 114.0 + degrees(e / ({R} * cos(radians(30.45::double)))) as lon, u as alt_geom,
  case when source in ('adsb', 'remote_id') then 'cooperative' else 'non_cooperative' end as target_type from obs),
flagged as (select *, coalesce(source <> 'spectrum' and sqrt((e - lag(e) over w) * (e - lag(e) over w) + (n - lag(n) over w) * (n - lag(n) over w)) > 200 * (time_sec - lag(time_sec) over w), false) as bad_position,
  coalesce(source <> 'spectrum' and abs(u - lag(u) over w) > 50 * (time_sec - lag(time_sec) over w), false) as bad_altitude
  from located window w as (partition by source, target_id order by time_sec, obs_id)),
clean as (select obs_id, source, source_rank, target_id, user_id, time_sec, case when not bad_position then e end as e, case when not bad_position then n end as n, case when not bad_altitude then u end as u,
  speed, heading, climb_rate, case when not bad_position then lat end as lat, case when not bad_position then lon end as lon, alt_geom, sensor_id, frequency, uav_model_text, target_type from flagged)"""
)


def case(key: str, values: dict, default: float, part: int | None = None) -> str:
    lines = " ".join(f"when '{k}' then {v if part is None else v[part]}" for k, v in values.items())
    return f"cast(case {key} {lines} else {default} end as double)"


W = [f"1 / ({case('source', ACCURACY, ACCURACY['radar'][k], k)} * {case('source', ACCURACY, ACCURACY['radar'][k], k)})" for k in range(3)]
HEADING = "((degrees(atan2({e}, {n})) % 360) + 360) % 360"


def _mean(v: str, k: int) -> str:
    return f"sum({v} * w{k}) / sum(case when {v} is not null then w{k} end)"


FUSED = f""",
weighted as (select 'ST' || lpad(cast(user_id as varchar), 4, '0') as system_track_id, round_even(time_sec / 5, 0) * 5 as bin, source, e, n, u,
  speed * sin(radians(heading)) as ve, speed * cos(radians(heading)) as vn, {W[0]} as w0, {W[1]} as w1, {W[2]} as w2
  from clean where source <> 'spectrum' and e is not null and n is not null),
binned as (select system_track_id, cast(bin as double) as time_sec, {_mean('e', 0)} as e, {_mean('n', 0)} as n, {_mean('u', 1)} as u, {_mean('ve', 2)} as ve, {_mean('vn', 2)} as vn, list_sort(list(distinct source)) as s
  from weighted group by all),
fused as (select system_track_id, time_sec, e, n, u, sqrt(ve * ve + vn * vn) as speed, {HEADING.format(e='ve', n='vn')} as heading, array_to_string(s, ',') as sources, cast(len(s) as integer) as source_count from binned)"""

SUMMARY = """,
summary as (select source_rank, source, target_id, min(time_sec) as t_min, max(time_sec) as t_max, avg(e) as e_c, avg(n) as n_c, avg(u) as u_c, count(*) as n_rows
  from clean where source <> 'spectrum' group by all having count(*) >= 5),
coarse as (select a.source as source_a, a.target_id as target_id_a, b.source as source_b, b.target_id as target_id_b, a.t_min as t_min_a, a.t_max as t_max_a, b.t_min as t_min_b, b.t_max as t_max_b, a.n_rows as n_rows_a, b.n_rows as n_rows_b,
  sqrt((a.e_c - b.e_c) * (a.e_c - b.e_c) + (a.n_c - b.n_c) * (a.n_c - b.n_c)) as centroid_m from summary a join summary b on a.source_rank < b.source_rank
  where a.t_max + 180 >= b.t_min - 180 and b.t_max + 180 >= a.t_min - 180
    and sqrt((a.e_c - b.e_c) * (a.e_c - b.e_c) + (a.n_c - b.n_c) * (a.n_c - b.n_c)) <= case when a.source = 'remote_id' and b.source = 'radar' then 200 else 300 end)"""

MATCHED = """,
ranked as (select *, row_number() over (partition by source, target_id order by time_sec, obs_id) - 1 as k, count(*) over (partition by source, target_id) as m from clean where source <> 'spectrum'),
sides as (select *, case when n_rows_a <= n_rows_b then source_a else source_b end as bs, case when n_rows_a <= n_rows_b then target_id_a else target_id_b end as bt,
  case when n_rows_a <= n_rows_b then source_b else source_a end as os, case when n_rows_a <= n_rows_b then target_id_b else target_id_a end as ot
  from coarse where greatest(t_min_a, t_min_b) <= least(t_max_a, t_max_b)),
met as (select s.source_a, s.target_id_a, s.source_b, s.target_id_b, p.k as probe, p.time_sec as t1, p.e as e1, p.n as n1, p.u as u1, p.speed as s1, p.heading as h1, coalesce(p.climb_rate, 0) as c1,
  o.time_sec as t2, o.e as e2, o.n as n2, o.u as u2, o.speed as s2, o.heading as h2, coalesce(o.climb_rate, 0) as c2,
  row_number() over (partition by s.source_a, s.target_id_a, s.source_b, s.target_id_b, p.k order by abs(p.time_sec - o.time_sec), o.k) as r
  from sides s join ranked p on p.source = s.bs and p.target_id = s.bt and (p.m <= 3 or p.k in (0, p.m // 2, p.m - 1)) join ranked o on o.source = s.os and o.target_id = s.ot),
near as (select *, sqrt((e1 - e2) * (e1 - e2) + (n1 - n2) * (n1 - n2) + (u1 - u2) * (u1 - u2)) as d3,
  sqrt(pow(s1 * sin(radians(h1)) - s2 * sin(radians(h2)), 2) + pow(s1 * cos(radians(h1)) - s2 * cos(radians(h2)), 2) + pow(c1 - c2, 2)) as dv,
  least(abs(h1 - h2), 360 - abs(h1 - h2)) as dh, abs(u1 - u2) as du, greatest(120.0::double, least(180.0::double, 5 / case when s1 > 0 then s1 else 10 end)) as win
  from met where r = 1 and abs(t1 - t2) <= 60 and sqrt((e1 - e2) * (e1 - e2) + (n1 - n2) * (n1 - n2)) <= 500),
scored as (select *, case when abs(t1 - t2) > win or d3 > 800 or coalesce(dv > 50, false) or coalesce(dh > 90, false) then 0.0::double
  else 0.35::double * exp(-(d3 * d3) / (2 * (800.0::double / 3) * (800.0::double / 3))) + 0.25::double * coalesce(1 - dv / 50, 0.5::double) + 0.2::double * coalesce(1 - dh / 90, 0.5::double) + 0.2::double * case when du > 500 then 0 else 1 - du / 500 end end as score from near)"""

BEST = """,
best as (select * from (select *, row_number() over (partition by source_a, target_id_a, source_b, target_id_b order by score desc, probe) as b from scored where score is not null) where b = 1 and score >= 0.6),
ordered as (select *, row_number() over (partition by source_a, source_b order by score desc, target_id_a, target_id_b) as pos from best),
steps(source_a, source_b, pos, used_a, used_b, taken) as (
  select distinct source_a, source_b, 0::bigint, []::varchar[], []::varchar[], false from ordered
  union all
  select s.source_a, s.source_b, o.pos,
    case when list_contains(s.used_a, o.target_id_a) or list_contains(s.used_b, o.target_id_b) then s.used_a else list_append(s.used_a, o.target_id_a) end,
    case when list_contains(s.used_a, o.target_id_a) or list_contains(s.used_b, o.target_id_b) then s.used_b else list_append(s.used_b, o.target_id_b) end,
    not (list_contains(s.used_a, o.target_id_a) or list_contains(s.used_b, o.target_id_b))
  from steps s join ordered o on o.source_a = s.source_a and o.source_b = s.source_b and o.pos = s.pos + 1),
assoc as (select o.* from ordered o join steps s on s.source_a = o.source_a and s.source_b = o.source_b and s.pos = o.pos and s.taken)"""

GROUPS = """,
tracks as (select distinct source, target_id, source_rank || ':' || target_id as id from clean where source <> 'spectrum'),
ends as (select a.id as a, b.id as b from assoc x join tracks a on a.source = x.source_a and a.target_id = x.target_id_a join tracks b on b.source = x.source_b and b.target_id = x.target_id_b),
reach(id, other) as (select id, id from tracks union select r.id, case when e.a = r.other then e.b else e.a end from reach r join ends e on e.a = r.other or e.b = r.other),
grouped as (select t.source, t.target_id, min(r.other) as g from tracks t join reach r on r.id = t.id group by all),
numbered as (select g, row_number() over (order by g) as k from (select distinct g from grouped))"""

ENDS = """,
placed as (select source, target_id, time_sec, e, n, row_number() over (partition by source, target_id order by time_sec, obs_id) as i, count(*) over (partition by source, target_id) as m
  from clean where source <> 'spectrum' and e is not null and n is not null),
ep as (select source, target_id,
  max(case when i = 1 then time_sec end) as t_s, max(case when i = 1 then e end) as e_s, max(case when i = 1 then n end) as n_s,
  max(case when i = least(5, m) then time_sec end) as t_s5, max(case when i = least(5, m) then e end) as e_s5, max(case when i = least(5, m) then n end) as n_s5,
  max(case when i = m then time_sec end) as t_e, max(case when i = m then e end) as e_e, max(case when i = m then n end) as n_e,
  max(case when i = greatest(1, m - 4) then time_sec end) as t_e5, max(case when i = greatest(1, m - 4) then e end) as e_e5, max(case when i = greatest(1, m - 4) then n end) as n_e5
  from placed where m >= 3 group by all),
vel as (select *, case when t_s5 > t_s then (e_s5 - e_s) / (t_s5 - t_s) else 0 end as ve_s, case when t_s5 > t_s then (n_s5 - n_s) / (t_s5 - t_s) else 0 end as vn_s,
  case when t_e > t_e5 then (e_e - e_e5) / (t_e - t_e5) else 0 end as ve_e, case when t_e > t_e5 then (n_e - n_e5) / (t_e - t_e5) else 0 end as vn_e from ep),
gaps as (select o.source, o.target_id as tid_old, w.target_id as tid_new, w.t_s - o.t_e as gap, sqrt(pow(o.e_e + o.ve_e * (w.t_s - o.t_e) - w.e_s, 2) + pow(o.n_e + o.vn_e * (w.t_s - o.t_e) - w.n_s, 2)) as err,
  sqrt(o.ve_e * o.ve_e + o.vn_e * o.vn_e) as s0, sqrt(w.ve_s * w.ve_s + w.vn_s * w.vn_s) as s1, """ + f"abs({HEADING.format(e='o.ve_e', n='o.vn_e')} - {HEADING.format(e='w.ve_s', n='w.vn_s')}) as dh" + """
  from vel o join vel w on o.source = w.source and o.target_id <> w.target_id and w.t_s - o.t_e between 0.5 and 120),
gated as (select *, case when s0 > 1 and s1 > 1 then abs(s0 - s1) / greatest(s0, s1) else 0 end as ratio, least(dh, 360 - dh) as turn from gaps),
pieces as (select *, 1 - 0.4::double * err / 600 - 0.3::double * ratio - 0.3::double * turn / 180 as score from gated where err <= 600 and ratio <= 1 and turn <= 180),
broken as (select source, tid_old, tid_new, round(gap, 2) as gap_sec, round(err, 2) as pred_error_m, round(ratio, 3) as speed_ratio, round(turn, 1) as heading_diff_deg, round(score, 4) as score, case when score >= 0.7 then 'confirmed' else 'suspected' end as status
  from (select *, row_number() over (partition by source, tid_new order by score desc, tid_old) as k from pieces) where k = 1)"""

LABELS = f""",
labels as (select target_id, case when regexp_matches(lower(uav_model_text), '{"|".join(CONSUMER_NAMES)}') then 'uav_consumer' when regexp_matches(lower(uav_model_text), '{"|".join(INDUSTRIAL_NAMES)}') then 'uav_industrial' else 'uav_unknown' end as label
  from (select target_id, uav_model_text, row_number() over (partition by target_id order by count(*) desc, uav_model_text) as k from clean where uav_model_text is not null group by target_id, uav_model_text) where k = 1)"""

_DECIDE = {
    "category": "when label is not null then label when source = 'adsb' and max_speed > 80 then 'ga' when source = 'remote_id' and mean_alt < 120 then 'uav_consumer' when source = 'remote_id' then 'uav_industrial' when mean_speed is not null and mean_alt is not null and (mean_speed > 50 or mean_alt > 600) then 'ga' when mean_speed is not null and mean_alt is not null then 'uav_consumer' else 'unknown' end",
    "confidence": "when label is not null then 0.95::double when source = 'adsb' and max_speed > 80 then 0.9 when source = 'remote_id' and mean_alt < 120 then 0.85 when source = 'remote_id' then 0.8 when mean_speed is not null and mean_alt is not null then 0.7 else 0 end",
    "reason": "when label is not null then 'spectrum label' when source = 'adsb' and max_speed > 80 then 'fast cooperative aircraft' when source = 'remote_id' and mean_alt < 120 then 'remote id, low' when source = 'remote_id' then 'remote id' when mean_speed is not null and mean_alt is not null and (mean_speed > 50 or mean_alt > 600) then 'fast or high' when mean_speed is not null and mean_alt is not null then 'slow and low' else 'no kinematics' end",
}
CLASSES = LABELS + f""",
single as (select c.source, c.target_id, any_value(l.label) as label, avg(coalesce(alt_geom, u)) as mean_alt, avg(speed) as mean_speed, max(speed) as max_speed from clean c left join labels l using (target_id) group by all),
joint as (select system_track_id, null::varchar as source, null::varchar as label, avg(u) as mean_alt, avg(speed) as mean_speed, max(speed) as max_speed from fused group by all),
classes as (select source || ':' || target_id as track_id, source, target_id as original_tid, case {_DECIDE['category']} as category, case {_DECIDE['confidence']} as confidence, case {_DECIDE['reason']} as reason from single
  union all select system_track_id, 'fused', system_track_id, case {_DECIDE['category']}, round(least((case {_DECIDE['confidence']}) + 0.05::double, 0.99::double), 4), case {_DECIDE['reason']} from joint)"""


def _limit(k: int) -> str:
    return case("category", LIMITS, LIMITS["unknown"][k], k)


_TRACKS = """
tracked as (select source || ':' || target_id as track_id, time_sec, speed, heading, climb_rate, alt_geom, u, obs_id from clean{joint})"""
_JOINT = " union all select system_track_id, time_sec, speed, heading, null, null, u, 0 from fused"


def _tracked(joint: bool) -> str:
    return "," + _TRACKS.format(joint=_JOINT if joint else "")


RULES = f""",
sized as (select *, coalesce(alt_geom, u) as altitude, count(*) over p as n, coalesce(avg(speed) over p, 0) as ms, coalesce(avg(coalesce(alt_geom, u)) over p, 0) as ma,
  time_sec - lag(time_sec) over w as dt, abs(speed - lag(speed) over w) as dv, lead(time_sec) over w - lag(time_sec) over w as wide, abs(lead(heading) over w - lag(heading) over w) as dh
  from tracked window p as (partition by track_id), w as (partition by track_id order by time_sec, obs_id)),
limited as (select *, case when ma > 1000 or ms > 80 then 'ga' when ms < 25 and ma < 300 then 'uav_consumer' when ma < 800 then 'uav_industrial' else 'unknown' end as category from sized where n >= 2),
ruled as (
  select track_id, time_sec, 'overspeed' as type, 1.0::double as confidence, 'high' as severity from limited where speed > {_limit(0)}
  union all select track_id, time_sec, 'stall_speed', 0.9, 'medium' from limited where speed > 0 and speed < {_limit(1)} and not speed > {_limit(0)}
  union all select track_id, time_sec, 'altitude_ceiling', 1, 'medium' from limited where altitude > {_limit(5)}
  union all select track_id, time_sec, 'excessive_climb', 1, 'high' from limited where climb_rate > {_limit(2)}
  union all select track_id, time_sec, 'excessive_descent', 1, 'high' from limited where climb_rate < -{_limit(3)} and not climb_rate > {_limit(2)}
  union all select track_id, time_sec, 'excessive_turn', 1, 'high' from limited where wide >= 2 and least(dh, 360 - dh) > {_limit(4)} * wide
  union all select track_id, time_sec, 'impossible_accel', 1, 'critical' from limited where dt > 0 and dv > 30 * dt)"""

ZSCORE = """,
rolled as (select *, row_number() over w as k, count(*) over (partition by track_id) as total from tracked window w as (partition by track_id order by time_sec, obs_id)),
""" + ",\n".join(
    f"z_{c} as (select track_id, time_sec, 'statistical_deviation_{c}' as type, k, total, {c} as v, avg({c}) over w as m, stddev_pop({c}) over w as s, count({c}) over w as c from rolled window w as (partition by track_id order by time_sec, obs_id rows between 5 preceding and 5 following))"
    for c in ("speed", "heading", "climb_rate", "u")
) + """,
zs as (select track_id, time_sec, type, abs(v - m) / s as z from (""" + " union all ".join(f"select * from z_{c}" for c in ("speed", "heading", "climb_rate", "u")) + """) where total >= 10 and k > 5 and k <= total - 5 and c >= 5 and s >= 1e-6 and abs(v - m) / s > 3),
deviating as (select track_id, time_sec, type, least(z / 6, 0.99::double) as confidence, case when z < 4.5 then 'medium' else 'high' end as severity from zs)"""

LOSS = """,
lost as (select track_id, time_sec, 'signal_loss' as type, 0.85::double as confidence, case when dt > 120 then 'high' else 'medium' end as severity
  from (select *, time_sec - lag(time_sec) over (partition by track_id order by time_sec, obs_id) as dt from tracked) where dt > 60)"""

DROPOUT = """,
dropped as (select system_track_id as track_id, time_sec, 'cooperative_dropout' as type, 0.8::double as confidence, 'critical' as severity
  from (select *, regexp_matches(sources, 'adsb|remote_id') as coop, lag(regexp_matches(sources, 'adsb|remote_id')) over (partition by system_track_id order by time_sec) as was from fused) where was and not coop)"""

EVENTS = FUSED + _tracked(True) + RULES + ZSCORE + LOSS + DROPOUT + """,
every as (select * from ruled union all select * from deviating union all select * from lost union all select * from dropped),
events_kept as (select track_id, time_sec, type, confidence, severity from (select *, row_number() over (partition by track_id, type, round_even(time_sec, 0)
  order by case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end desc, time_sec, confidence desc) as k from every) where k = 1)"""

CONFLICTS = """,
framed as (select round_even(time_sec / 2, 0) * 2 as frame, system_track_id as track, e, n, u, coalesce(speed, 0) * sin(radians(coalesce(heading, 0))) as ve, coalesce(speed, 0) * cos(radians(coalesce(heading, 0))) as vn
  from (select *, row_number() over (partition by round_even(time_sec / 2, 0), system_track_id order by time_sec desc) as k from fused) where k = 1 and e is not null and n is not null and u is not null),
duos as (select a.frame, a.track as track_a, b.track as track_b, b.e - a.e as de, b.n - a.n as dn, b.u - a.u as du, b.ve - a.ve as we, b.vn - a.vn as wn from framed a join framed b on a.frame = b.frame and a.track < b.track),
moving as (select *, sqrt(de * de + dn * dn + du * du) as dist, sqrt(we * we + wn * wn) as rel, de * we + dn * wn as dot from duos),
approach as (select *, case when rel >= 1 then -dot / (rel * rel) end as t from moving where not (rel < 5 and dist < 1000)),
risky as (select *, case when rel < 1 or t < 0 then dist else sqrt(pow(de + we * t, 2) + pow(dn + wn * t, 2) + du * du) end as dcpa, case when rel < 1 and dist > 500 then null when rel < 1 or t < 0 then 0 else t end as tcpa,
  case when dist > 4000 then 0.0::double else least(1.0::double, exp(-(dist * dist) / (2 * (2000.0::double / 3) * (2000.0::double / 3))) * greatest(0.1::double, 1 - 2 * case when rel > 1e-3 and dist > 1e-3 then dot / (rel * dist) else 0 end)) end as risk from approach),
levelled as (select *, case when dcpa < 200 and tcpa < 20 then 'critical' when dcpa < 500 and tcpa < 60 then 'warning' when risk > 0.5 then 'caution' end as level from risky),
conflicts as (select cast(frame as double) as time_sec, track_a, track_b, round(dcpa, 1) as dcpa_m, round(tcpa, 1) as tcpa_s, round(rel, 2) as rel_speed_ms, round(risk, 3) as potential_risk, level,
  case level when 'critical' then 'critical' when 'warning' then 'high' else 'medium' end as severity, case when risk >= 0.3 then round(30 + 30 * risk, 1) end as advice_turn_deg from levelled where level is not null)"""

HEAT = """,
cells as (select cast(floor(e / 500) as bigint) as grid_x, cast(floor(n / 500) as bigint) as grid_y, count(*) as count, avg(u) as avg_u from clean where e is not null and n is not null group by all),
heat as (select grid_x, grid_y, (grid_x + 0.5::double) * 500 as center_e, (grid_y + 0.5::double) * 500 as center_n, count, avg_u from cells)"""

FLOW = """,
flow as (select cast(trunc(time_sec / 60) * 60 as double) as time_sec, count(distinct target_id) as active_targets, count(*) as total_reports, avg(alt_geom) as avg_altitude from located group by all)"""

CORRIDORS = HEAT + """,
dense as (select *, grid_x * 100000 + grid_y as id from heat where count >= 5),
linked as (select a.id as a, b.id as b from dense a join dense b on abs(a.grid_x - b.grid_x) + abs(a.grid_y - b.grid_y) = 1),
spread(id, other) as (select id, id from dense union select s.id, l.b from spread s join linked l on l.a = s.other),
owned as (select d.*, min(s.other) as component from dense d join spread s on s.id = d.id group by all),
grown as (select component, count(*) as cell_count, sum(count)::bigint as total_points, avg(center_e) as center_e, avg(center_n) as center_n, min({'e': center_e, 'n': center_n}) as west, max({'e': center_e, 'n': center_n}) as east from owned group by component having count(*) >= 3),
corr as (select cell_count, total_points, center_e, center_n, round(""" + HEADING.format(e="east.e - west.e", n="east.n - west.n") + """, 1) as direction_deg, round(sqrt(pow(east.e - west.e, 2) + pow(east.n - west.n, 2)), 1) as length_m from grown)"""

POG = """,
t0 as (select min(time_sec) as t0 from located where source = 'spectrum'),
heard as (select target_id, cast(floor((time_sec - t0) / 5) as bigint) as win, list_sort(list(distinct sensor_id)) as sensors from located, t0 where source = 'spectrum' group by all),
sets as (select sensors, count(*) as events, len(sensors) as k from heard group by all),
sited as (select *, list_avg(list_transform(sensors, lambda s: (s - 2) * 1500)) as ce, list_avg(list_transform(sensors, lambda s: (s * 2 % 5 - 2) * 1500)) as cn, greatest(500.0::double, 5000 / (0.5::double * k)) as spr from sets),
homed as (select *, greatest(0, least(79, cast(trunc((ce + 8000) / 200) as integer))) as ci, greatest(0, least(79, cast(trunc((cn + 8000) / 200) as integer))) as cj, case when k = 1 then 25 else cast(trunc(3 * spr / 200) as integer) end as rch from sited),
board as (select x.range as col, y.range as row from range(80) x, range(80) y),
touch as (select h.*, b.col, b.row, sqrt(pow(b.col * 200 - 8000 + 100 - ce, 2) + pow(b.row * 200 - 8000 + 100 - cn, 2)) as d from homed h join board b on abs(b.col - ci) <= rch and abs(b.row - cj) <= rch),
gained as (select *, case when k > 1 then (0.3::double + 0.2::double * least(k, 4)) * exp(-0.5::double * pow(d / spr, 2)) when d between 50 and 5000 then ln(0.62::double / (1 - 0.62::double + 1e-10)) * exp(-0.5::double * pow((d - 2500) / 1500, 2)) * 0.15::double end as gain from touch),
grid as (select cast(row as integer) as row, cast(col as integer) as col, least(4.0::double, sum(gain * events)) as log_odds, sum(events)::bigint as detection_count, 1 / (1 + exp(-least(4.0::double, sum(gain * events)))) as probability from gained where gain is not null group by row, col)"""

ALARMS = """,
sw as (select *, cast(floor(time_sec / 10) as bigint) as win, time_sec - lag(time_sec) over (partition by target_id, floor(time_sec / 10) order by time_sec, obs_id) as step from located where source = 'spectrum'),
sg as (select target_id, win, count(*) as rows, count(distinct sensor_id) as sensors, avg(frequency) as freq, avg(time_sec) as tc, stddev_pop(step) as sd, avg(step) as ms, avg(e) as se, avg(n) as sn from sw group by all),
few as (select distinct system_track_id from fused),
nearby as (select g.target_id, g.win, f.system_track_id, avg(f.e) as me, avg(f.n) as mn, any_value(se) as se, any_value(sn) as sn from sg g join fused f on abs(f.time_sec - g.tc) <= 10 join few using (system_track_id) where g.sensors >= 2 group by all),
backed as (select distinct target_id, win, true as ok from nearby where sqrt(pow(me - se, 2) + pow(mn - sn, 2)) < 4000),
judged as (select g.*, case when sensors = 1 and rows <= 2 then 'single_station_isolated' when freq > 0 and not (""" + " or ".join(f"freq between {a} and {b}" for a, b in UAV_BANDS_MHZ) + """) then 'frequency_out_of_band'
  when rows >= 3 and ms < 2 and ms > 0 and sd / ms > 1.5 then 'irregular_intervals' when sensors >= 2 and ok is null then 'no_track_corroboration' end as reason from sg g left join backed using (target_id, win))"""

ERRORS = """,
middle as (select system_track_id, avg(e) as te, avg(n) as tn from fused group by all),
srcs as (select 'ST' || lpad(cast(user_id as varchar), 4, '0') as system_track_id, source, avg(e) as se, avg(n) as sn from clean where source <> 'spectrum' and e is not null and n is not null group by all),
errs as (select system_track_id, source, sqrt(pow(se - te, 2) + pow(sn - tn, 2)) as error_m, """ + case("source", RELIABILITY, 0.6) + " as rel, " + case("source", POSITION_SIGMA, 50.0) + """ as sg from srcs join middle using (system_track_id)),
posmass as (select *, 0.8::double * rel * (1 - doubt) as r0, 0.7::double * doubt as f0 from (select *, 1 / (1 + exp(-0.8::double * (error_m / sg - 3))) as doubt from errs)),
pm as (select system_track_id, source, rel, r0 / (r0 + f0 + greatest(0, 1 - r0 - f0)) as r, f0 / (r0 + f0 + greatest(0, 1 - r0 - f0)) as f, greatest(0, 1 - r0 - f0) / (r0 + f0 + greatest(0, 1 - r0 - f0)) as t from posmass)"""

CREDIBILITY = ERRORS + """,
q as (select system_track_id, source, rel * case when source in ('adsb', 'remote_id') then 0.85::double else 0.65::double end as w from pm),
evid as (select system_track_id, source, 0 as part, 0.85::double * w as r, 0.05::double * (1 - w) as f, 1 - 0.85::double * w - 0.05::double * (1 - w) as t from q union all select system_track_id, source, 1, r, f, t from pm),
listed as (select *, row_number() over (partition by system_track_id order by source, part) as i, count(*) over (partition by system_track_id) as n from evid),
avgd as (select system_track_id, avg(r) as r, avg(f) as f, avg(t) as t from evid group by all),
fold(system_track_id, i, r, f, t, k) as (select system_track_id, i, r, f, t, 0.0::double from listed where i = 1
  union all select l.system_track_id, l.i, (a.r * l.r + a.r * l.t + a.t * l.r) / (1 - a.r * l.f - a.f * l.r), (a.f * l.f + a.f * l.t + a.t * l.f) / (1 - a.r * l.f - a.f * l.r), a.t * l.t / (1 - a.r * l.f - a.f * l.r), greatest(a.k, a.r * l.f + a.f * l.r)
  from fold a join listed l on l.system_track_id = a.system_track_id and l.i = a.i + 1),
mfold(system_track_id, i, r, f, t, k) as (select system_track_id, 1::bigint, r / (r + f + t), f / (r + f + t), t / (r + f + t), 0.0::double from avgd
  union all select l.system_track_id, l.i, (a.r * m.r + a.r * m.t + a.t * m.r) / (1 - a.r * m.f - a.f * m.r), (a.f * m.f + a.f * m.t + a.t * m.f) / (1 - a.r * m.f - a.f * m.r), a.t * m.t / (1 - a.r * m.f - a.f * m.r), greatest(a.k, a.r * m.f + a.f * m.r)
  from mfold a join listed l on l.system_track_id = a.system_track_id and l.i = a.i + 1 join (select system_track_id, r / (r + f + t) as r, f / (r + f + t) as f, t / (r + f + t) as t from avgd) m on m.system_track_id = a.system_track_id),
final as (select l.system_track_id, l.n, case when d.k > 0.65 then m.r else d.r end as r, case when d.k > 0.65 then m.f else d.f end as f, case when d.k > 0.65 then m.t else d.t end as t, case when d.k > 0.65 then m.k else d.k end as k, case when d.k > 0.65 then 'murphy' else 'dempster' end as strategy
  from listed l join fold d using (system_track_id, i) join mfold m using (system_track_id, i) where l.i = l.n)"""


def _name(x: str, y: str) -> str:
    return f"printf('G%+04d_%+04d', {x}, {y})"


NET = FUSED + f""",
cellular as (select system_track_id, time_sec, cast(round_even(e / 500, 0) as integer) as gi, cast(round_even(n / 500, 0) as integer) as gj from fused where e is not null and n is not null),
visited as (select *, {_name('gi', 'gj')} as node, lag({_name('gi', 'gj')}) over (partition by system_track_id order by time_sec) as prev from cellular),
edges as (select prev as src, node as dst, count(*) as weight from visited where prev is not null and prev <> node group by all),
both_ways as (select src as a, dst as b, weight from edges union all select dst, src, weight from edges),
nodes as (select node, gi, gj, count(*) as traffic, count(distinct system_track_id) as tracks_passing from visited where node in (select a from both_ways) group by all),
degs as (select a as node, count(*) as degree, sum(weight)::bigint as strength from both_ways group by a)"""

CC = """,
und as (select distinct a, b from both_ways),
flood(id, other) as (select distinct a, a from und union select f.id, u.b from flood f join und u on u.a = f.other),
wcc as (select id as node, min(other) as component from flood group by id)"""

ROOM = """,
span as (select greatest(1, cast(floor(greatest(1.0::double, max(time_sec) - min(time_sec)) / 60) as bigint)) as windows from fused),
room as (select n.node, traffic, greatest(1.0::double, least(50.0::double, 0.6::double * 500 * 500 / (100 * 100) * greatest(coalesce(degree, 0), 1))) as capacity, windows from nodes n left join degs using (node), span)"""


def _labels(rounds: int) -> str:
    """Synchronous votes, written out round by round; a settled labelling repeats itself."""
    sql = ",\nsym as (select a, b, sum(weight) as weight from both_ways group by all),\nl0 as materialized (select distinct a as id, a as label from both_ways)"
    for k in range(rounds):
        sql += f""",
v{k + 1} as materialized (select id, label, sum(weight) as weight from (select s.a as id, l.label, s.weight from sym s join l{k} l on l.id = s.b union all select id, label, 1 from l{k}) group by all),
l{k + 1} as materialized (select id, label from (select *, row_number() over (partition by id order by weight desc, label) as r from v{k + 1}) where r = 1)"""
    return sql


_RMSE = """,
timed as (select system_track_id, min(time_sec) as t0, max(time_sec) as t1 from fused where e is not null group by all having count(*) >= 5),
picked as (select * from timed order by system_track_id{limit}),
asked as (select p.system_track_id, c.source, c.target_id, c.obs_id, c.time_sec, c.e, c.n, row_number() over (partition by p.system_track_id, c.source, c.target_id order by c.time_sec, c.obs_id) as k,
  count(*) over (partition by p.system_track_id, c.source, c.target_id) as m from clean c join picked p on c.time_sec between p.t0 - 5 and p.t1 + 5{members} where c.source <> 'spectrum' and c.e is not null and c.n is not null),
closest as (select a.source, a.e - f.e as de, a.n - f.n as dn, row_number() over (partition by a.system_track_id, a.obs_id order by abs(a.time_sec - f.time_sec), f.time_sec) as r from asked a join fused f on f.system_track_id = a.system_track_id and abs(a.time_sec - f.time_sec) <= 3 where a.m >= 3 and a.k <= 20),
rmse as (select source, sqrt(avg(de * de)) as rmse_e, sqrt(avg(dn * dn)) as rmse_n, sqrt(avg(de * de + dn * dn)) as rmse_total, count(*) as samples from closest where r = 1 group by source having count(*) >= 10)"""
_PREDICTION = """,
three as (select *, lag(time_sec) over w as tp, lag(e) over w as ep, lag(n) over w as np, lead(time_sec) over w as tn, lead(e) over w as en, lead(n) over w as nn from fused window w as (partition by system_track_id order by time_sec)),
missed as (select sqrt(pow(e + (e - ep) / (time_sec - tp) * (tn - time_sec) - en, 2) + pow(n + (n - np) / (time_sec - tp) * (tn - time_sec) - nn, 2)) as miss from three where time_sec - tp >= 0.01 and tn - time_sec >= 0.01),
prediction as (select sqrt(avg(miss * miss)) as fused_rmse, count(miss) as samples from missed)"""


def _rounds(columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns.split())


_EVENT = f"track_id, type, severity, {_rounds('time_sec confidence')}"


def oracle_sql() -> dict[str, str]:
    out = {
        "observation_table": BASE + f" select obs_id, source, cast(source_rank as integer) as source_rank, target_id, user_id, sensor_id, uav_model_text, target_type, {_rounds('time_sec e n u speed heading climb_rate lat lon alt_geom frequency', 6)} from located",
        "parse_rev_time": """with t as (select event_id, (event_id * 7919) % 86400 as t from events), p as (select event_id, t // 3600 as h, (t % 3600) // 60 as m, t % 60 as s from t)
select event_id, case event_id % 5 when 0 then printf('%02d:%02d:%02d.5', h, m, s) when 1 then printf('%02d:%02d:%02d', h, m, s) when 2 then printf('%02d:%02d.25', m, s) when 3 then printf('%d.5', s) else 'n/a' end as rev_time,
  cast(case event_id % 5 when 0 then h * 3600 + m * 60 + s + 0.5 when 1 then h * 3600 + m * 60 + s when 2 then m * 60 + s + 0.25 when 3 then s + 0.5 end as double) as time_sec from p""",
        "enu_roundtrip": BASE + f" select obs_id, round(e, 3) as e2, round(n, 3) as n2, round(u, 3) as u2, round((lon - 114.0) * 111320 * cos(radians(30.45::double)), 3) as flat_e, round((lat - 30.45) * 111320, 3) as flat_n from located",
        "haversine_zone": BASE + f" select obs_id, round(2 * {R} * asin(sqrt(least(1.0::double, pow(sin(radians(30.45 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(30.45::double)) * pow(sin(radians(114.0 - lon) / 2), 2)))), 3) as distance_m from located where source in ('adsb', 'radar')",
        "polar_to_enu": BASE + f""" select obs_id, round(speed * 10 * cos(radians(u / 20)) * sin(radians(heading)), 4) as pe, round(speed * 10 * cos(radians(u / 20)) * cos(radians(heading)), 4) as pn, round(speed * 10 * sin(radians(u / 20)), 4) as pu,
  round({HEADING.format(e='speed * sin(radians(heading))', n='speed * cos(radians(heading))')}, 4) as back, round(least(abs(heading - 10), 360 - abs(heading - 10)), 4) as turn, round(greatest(120.0::double, least(180.0::double, 5 / case when speed > 0 then speed else 10 end)), 4) as window_s,
  case when u > 1000 or speed > 80 then 'ga' when speed < 25 and u < 300 then 'uav_consumer' when u < 800 then 'uav_industrial' else 'unknown' end as category from located where source = 'radar'""",
        "reference_centroid": BASE + " select round(avg(lat), 6) as lat0, round(avg(lon), 6) as lon0, round(avg(coalesce(alt_geom, 0)), 6) as alt0 from (select *, row_number() over (partition by source order by target_id, time_sec, obs_id) as k from located where lat is not null and lon is not null) where k <= 100",
        "outlier_rejection": BASE + " select obs_id, source, target_id, bad_position, bad_altitude from flagged where bad_position or bad_altitude",
        "data_gaps": BASE + " select obs_id, source, target_id, round(gap, 4) as gap_s from (select *, time_sec - lag(time_sec) over (partition by source, target_id order by time_sec, obs_id) as gap from located) where gap > 120",
        "resample_linear": BASE + """,
pts as (select source, target_id, time_sec, avg(e) as e, avg(n) as n, avg(u) as u from clean where source <> 'spectrum' group by all having avg(e) is not null and avg(n) is not null and avg(u) is not null),
sp as (select source, target_id, floor(min(time_sec)) as t0, ceil(max(time_sec)) as t1, count(*) as m from pts group by all having count(*) >= 2),
tl as (select source, target_id, cast(t0 + 60 * unnest(range(0, cast(floor((t1 - t0) / 60) as bigint) + 1)) as double) as t from sp),
num as (select *, row_number() over (partition by source, target_id order by time_sec) as i, count(*) over (partition by source, target_id) as m from pts),
pick as (select tl.source, tl.target_id, tl.t, least(greatest(count(num.i) filter (num.time_sec <= tl.t), 1), any_value(num.m) - 1) as i from tl join num using (source, target_id) group by all)
select p.source, p.target_id, round(p.t, 3) as time_sec, round(a.e + (p.t - a.time_sec) / (b.time_sec - a.time_sec) * (b.e - a.e), 3) as e, round(a.n + (p.t - a.time_sec) / (b.time_sec - a.time_sec) * (b.n - a.n), 3) as n, round(a.u + (p.t - a.time_sec) / (b.time_sec - a.time_sec) * (b.u - a.u), 3) as u
from pick p join num a on a.source = p.source and a.target_id = p.target_id and a.i = p.i join num b on b.source = p.source and b.target_id = p.target_id and b.i = p.i + 1""",
        "track_summary": BASE + SUMMARY + f" select cast(source_rank as integer) as source_rank, source, target_id, n_rows, {_rounds('t_min t_max e_c n_c u_c')} from summary",
        "coarse_candidates": BASE + SUMMARY + " select source_a, target_id_a, source_b, target_id_b, round(centroid_m, 3) as centroid_m from coarse",
        "nearest_time_match": BASE + SUMMARY + MATCHED + " select source_a, target_id_a, source_b, target_id_b, cast(probe as integer) as probe, round(t1, 4) as t1, round(t2, 4) as t2 from scored",
        "pair_similarity": BASE + SUMMARY + MATCHED + " select source_a, target_id_a, source_b, target_id_b, cast(probe as integer) as probe, round(score, 4) as score, round(d3, 4) as dist_3d_m, round(du, 4) as d_alt_m, round(dv, 4) as speed_diff_ms, round(dh, 4) as heading_diff_deg, round(win, 4) as time_window_sec from scored where score is not null",
        "greedy_association": BASE + SUMMARY + MATCHED + BEST + " select round(t1, 4) as time_sec, source_a as src_a, target_id_a as tid_a, source_b as src_b, target_id_b as tid_b, round(score, 4) as score, case when score >= 0.85 then 'confirmed' else 'suspected' end as level, round(d3, 4) as dist_3d_m, round(du, 4) as d_alt_m, round(dv, 4) as speed_diff_ms, round(dh, 4) as heading_diff_deg, round(win, 4) as time_window_sec from assoc",
        "broken_tracks": BASE + ENDS + " select * from broken",
        "maintenance_stats": BASE + ENDS + " select source, count(*) as pairs, count(*) filter (status = 'confirmed') as confirmed, count(*) filter (status = 'suspected') as suspected, round(avg(gap_sec), 4) as avg_gap_sec, round(avg(pred_error_m), 4) as avg_error_m from broken group by rollup(source)",
        "frame_confirmation": BASE + """ select target_id, frame, matched, case when matched and seen >= 3 and hits >= 3 then 'confirmed' when matched and hits >= greatest(1, seen // 2) then 'suspected' when not matched and seen >= 3 and hits = 0 then 'pending' when not matched and hits > 0 then 'suspected' else 'pending' end as level
from (select target_id, obs_id as frame, obs_id % 3 <> 0 as matched, sum(cast(obs_id % 3 <> 0 as integer)) over w as hits, count(*) over w as seen from located where source <> 'spectrum' window w as (partition by target_id order by obs_id rows between 2 preceding and current row))""",
        "track_groups": BASE + SUMMARY + MATCHED + BEST + GROUPS + " select printf('ST%04d', k) as system_track_id, source, target_id from grouped join numbered using (g)",
        "wls_fused_tracks": BASE + FUSED + f" select system_track_id, sources, source_count, {_rounds('time_sec e n u speed heading')} from fused",
        "rmse_per_source": BASE + FUSED + _RMSE.format(limit="", members="") + f" select source, samples, {_rounds('rmse_e rmse_n rmse_total')} from rmse",
        "rmse_per_source_members": BASE + FUSED + _RMSE.format(limit="", members=" and 'ST' || lpad(cast(c.user_id as varchar), 4, '0') = p.system_track_id") + f" select source, samples, {_rounds('rmse_e rmse_n rmse_total')} from rmse",
        "fused_prediction_rmse": BASE + FUSED + _PREDICTION + " select round(fused_rmse, 3) as fused_rmse, samples from prediction",
        "rmse_improvement": BASE + FUSED + _RMSE.format(limit="", members="") + _PREDICTION + " select source, round(greatest(0, (rmse_total - fused_rmse) / rmse_total * 100), 1) as improvement_pct from rmse, prediction",
        "fused_smoothness": BASE + FUSED + """,
m as (select *, coalesce(speed, 0) * sin(radians(coalesce(heading, 0))) as ve, coalesce(speed, 0) * cos(radians(coalesce(heading, 0))) as vn, greatest(0.01::double, time_sec - lag(time_sec) over w) as dt, count(*) over (partition by system_track_id) as c from fused window w as (partition by system_track_id order by time_sec)),
a as (select *, (ve - lag(ve) over w) / dt as ae, (vn - lag(vn) over w) / dt as an from m where c >= 4 window w as (partition by system_track_id order by time_sec)),
j as (select *, (ae - lag(ae) over w) / dt as je, (an - lag(an) over w) / dt as jn from a window w as (partition by system_track_id order by time_sec)),
t as (select system_track_id, sqrt(avg(je * je + jn * jn)) as jerk, stddev_pop(speed) as dev from j group by all)
select round(avg(jerk), 5) as jerk_rms, round(avg(dev), 5) as speed_std, count(*) as tracks from t""",
        "spectrum_labels": BASE + LABELS + " select target_id, label from labels",
        "classify_tracks": BASE + FUSED + CLASSES + " select track_id, source, original_tid, category, round(confidence, 4) as confidence, reason from classes",
        "rule_anomalies": BASE + _tracked(False) + RULES + f" select {_EVENT} from ruled",
        "zscore_anomalies": BASE + _tracked(False) + ZSCORE + f" select {_EVENT} from deviating",
        "signal_loss": BASE + _tracked(False) + LOSS + f" select {_EVENT} from lost",
        "coop_dropout": BASE + FUSED + DROPOUT + f" select {_EVENT} from dropped",
        "anomaly_events": BASE + EVENTS + f" select {_EVENT} from events_kept",
        "conflict_events": BASE + FUSED + CONFLICTS + " select * from conflicts",
        "temporal_flow": BASE + FLOW + f" select time_sec, active_targets, total_reports, {_rounds('avg_altitude')} from flow",
        "heatmap": BASE + HEAT + f" select grid_x, grid_y, count, {_rounds('center_e center_n avg_u')} from heat",
        "corridors": BASE + CORRIDORS + f" select cell_count, total_points, {_rounds('center_e center_n direction_deg length_m', 3)} from corr",
        "flow_report": BASE + FLOW + CORRIDORS + """ select round(max(time_sec) - min(time_sec), 4) as time_span_sec, max(active_targets) as peak_targets, (select time_sec from flow order by active_targets desc, time_sec limit 1) as peak_time_sec, sum(total_reports)::bigint as total_reports,
  (select count(*) from cells where count >= (select quantile_cont(count, 0.95) from cells)) as hotspot_count, (select count(*) from corr) as corridor_count from flow""",
        "pog_events": BASE + POG + " select cast(len(sensors) as integer) as sensors, count(*) as events from heard group by all",
        "pog_grid": BASE + POG + f" select row, col, detection_count, {_rounds('log_odds probability')} from grid",
        "pog_high_cells": BASE + POG + " select count(*) filter (probability > 0.58) as high_prob_cells, round(count(*) filter (probability > 0.55) / 6400, 4) as coverage, round(max(probability), 4) as max_probability from grid",
        "pog_track_overlap": BASE + POG + FUSED + """,
pt as (select system_track_id, greatest(0, least(79, cast(trunc((e + 8000) / 200) as integer))) as col, greatest(0, least(79, cast(trunc((n + 8000) / 200) as integer))) as row from fused)
select system_track_id, round(avg(coalesce(probability, 0.5)), 4) as overlap, count(*) as points from pt left join grid using (row, col) group by all""",
        "false_alarm_filter": BASE + FUSED + ALARMS + ' select target_id, win as "window", rows, sensors, reason from judged where reason is not null',
        "ds_detection_mass": BASE + f""",
w as (select obs_id, {case('source', RELIABILITY, 0.6)} * greatest(0.1::double, least(1.0::double, coalesce(speed / 50, 0.05))) as w from located)
select obs_id, round_even((case when obs_id % 4 <> 0 then 0.85::double * w else 0.1::double * w end) * 1e4::double, 0) / 1e4::double as m_r, round_even((case when obs_id % 4 <> 0 then 0.05::double * (1 - w) else 0.6::double * w end) * 1e4::double, 0) / 1e4::double as m_f,
  round_even((1 - case when obs_id % 4 <> 0 then 0.85::double * w else 0.1::double * w end - case when obs_id % 4 <> 0 then 0.05::double * (1 - w) else 0.6::double * w end) * 1e4::double, 0) / 1e4::double as m_t from w""",
        "ds_position_mass": BASE + FUSED + ERRORS + " select system_track_id, source, round_even((r) * 1e4::double, 0) / 1e4::double as m_r, round_even((f) * 1e4::double, 0) / 1e4::double as m_f, round_even((t) * 1e4::double, 0) / 1e4::double as m_t from pm",
        "ds_coverage_mass": BASE + FUSED + """,
s as (select system_track_id, max(source_count) / 3 as s from fused group by all)
select system_track_id, round_even((0.9::double * s * 0.8::double) * 1e4::double, 0) / 1e4::double as m_r, round_even((0.2::double * (1 - s)) * 1e4::double, 0) / 1e4::double as m_f, round_even((greatest(0.0::double, 1 - 0.9::double * s * 0.8::double - 0.2::double * (1 - s))) * 1e4::double, 0) / 1e4::double as m_t from s""",
        "ds_credibility": BASE + FUSED + CREDIBILITY + " select round(r, 4) as credibility, round(f, 4) as false_prob, round(t, 4) as uncertainty, round(k, 4) as conflict_k, strategy, case when r > 0.65 then 'confirmed_real' when f > 0.5 then 'suspected_false' when k > 0.65 then 'high_conflict' else 'uncertain' end as decision, system_track_id, cast(n // 2 as integer) as n_sources from final",
        "net_edges": BASE + NET + " select src, dst, weight from edges",
        "net_nodes": BASE + NET + " select node, gi, gj, traffic, tracks_passing from nodes",
        "degree_centrality": BASE + NET + " select node, round(degree / (2 * ((select count(*) from degs) - 1)), 6) as degree_centrality from degs",
        "weighted_degree": BASE + NET + " select node, round(strength / (select max(strength) from degs), 6) as weighted_degree from degs",
        "net_statistics": BASE + NET + """,
und as (select distinct a, b from both_ways where a <> b),
ks as (select a, count(*) as k from und group by a),
tri as (select x.a, count(*) as c from und x join und y on x.a = y.a and x.b < y.b join und z on z.a = x.b and z.b = y.b group by x.a),
cl as (select avg(case when k > 1 then 2 * coalesce(c, 0) / (k * (k - 1)) else 0 end) as c from ks left join tri using (a)),
nn as (select count(*) as n from degs), ee as (select count(*) as e from edges)
select n as nodes, e as edges, round(2 * e / n, 6) as avg_degree, round(e / (n * (n - 1)), 6) as density, round(c, 6) as avg_clustering from nn, ee, cl""",
        "congestion": BASE + NET + ROOM + " select node, round(traffic / (capacity * windows), 4) as congestion_index, round(capacity, 1) as dynamic_capacity, traffic as traffic_count, traffic / (capacity * windows) > 1 as is_congested from room where traffic > 0",
        "weak_components": BASE + NET + CC + " select node, component from wcc",
        "vulnerability": BASE + NET + CC + """,
cand as (select node as gone from degs order by strength desc, node limit 30),
cut_links as (select c.gone, u.a, u.b from cand c join und u on u.a <> c.gone and u.b <> c.gone),
cut_flood(gone, id, other) as (select distinct gone, a, a from cut_links union select f.gone, f.id, l.b from cut_flood f join cut_links l on l.gone = f.gone and l.a = f.other),
cut_cc as (select gone, id, min(other) as component from cut_flood group by all),
cut_n as (select gone, count(distinct component) as parts, count(*) as linked from cut_cc group by gone),
was as (select count(distinct component) as was, count(*) as n from wcc)
select c.gone as node, coalesce(parts, 0) + (n - 1 - coalesce(linked, 0)) - was as components_increase, traffic as traffic_load,
  round(0.5::double * (coalesce(parts, 0) + (n - 1 - coalesce(linked, 0)) - was) + 0.5::double * traffic / (select sum(traffic) from nodes), 4) as vulnerability_score
from cand c left join cut_n using (gone) join nodes on node = c.gone, was""",
        "label_communities": BASE + NET + _labels(50) + " select id as node, label as community from l50",
        "community_capacity": BASE + NET + ROOM + _labels(50) + " select label as community, count(*) as n_nodes, round(sum(capacity), 1) as total_capacity, sum(traffic)::bigint as current_load, round(sum(traffic) / (sum(capacity) * max(windows)), 4) as utilization, sum(traffic) / (sum(capacity) * max(windows)) > 0.8 as is_saturated from room join l50 on id = node group by label",
        "target_list": BASE + EVENTS + CLASSES + f""",
roll as (select system_track_id, min(time_sec) as s, max(time_sec) as x, count(*) as n_points, avg(e) as e, avg(n) as n, avg(u) as u, avg(speed) as sp, max(speed) as mx, array_to_string(list_sort(list_distinct(flatten(list(string_split(sources, ','))))), '|') as sources from fused group by all),
an as (select track_id, count(*) as c, array_to_string(list_sort(list(distinct type)), '|') as types, max(case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end) as sev from events_kept group by all)
select r.system_track_id, round(s, 2) as start_sec, round(x, 2) as end_sec, round(x - s, 2) as duration_sec, n_points, r.sources, round(30.45 + degrees(n / {R}), 6) as avg_lat, round(114.0 + degrees(e / ({R} * cos(radians(30.45::double)))), 6) as avg_lon, round(u, 2) as avg_alt_m, round(sp, 2) as avg_speed_ms, round(mx, 2) as max_speed_ms,
  coalesce(category, 'unknown') as category, coalesce(k.confidence, 0) as confidence, coalesce(c, 0) as anomaly_count, coalesce(types, '') as anomaly_types, coalesce(case sev when 4 then 'critical' when 3 then 'high' when 2 then 'medium' when 1 then 'low' end, 'none') as max_severity
from roll r left join (select * from classes where source = 'fused') k on k.track_id = r.system_track_id left join an on an.track_id = r.system_track_id""",
        "unified_trajectory": BASE + FUSED + CLASSES + " select c.source, c.target_id, round(time_sec, 2) as time_sec, round(lat, 6) as lat, round(lon, 6) as lon, round(coalesce(alt_geom, u), 2) as alt_m, round(speed, 2) as speed_ms, round(heading, 2) as heading_deg, coalesce(category, 'unknown') as category, target_type from clean c left join (select * from classes where source <> 'fused') k on k.source = c.source and k.original_tid = c.target_id where c.source <> 'spectrum' and lat is not null and lon is not null",
        "result_summary": BASE + EVENTS + CLASSES + CONFLICTS + """ select 'category' as section, category as name, count(*) as count from classes group by all union all select 'anomaly_type', type, count(*) from events_kept group by all
union all select 'anomaly_severity', severity, count(*) from events_kept group by all union all select 'conflict_level', level, count(*) from conflicts group by all""",
        "dashboard_summary": BASE + " select source, count(*) as reports, count(distinct target_id) as targets, round(max(time_sec) - min(time_sec), 2) as span_sec from located group by all",
        "sampled_tracks": BASE + " select source, target_id, cast(k as integer) as point, round(time_sec, 2) as time_sec, round(lat, 6) as lat, round(lon, 6) as lon from (select *, dense_rank() over (partition by source order by target_id) as r, row_number() over (partition by source, target_id order by time_sec, obs_id) as k from clean where lat is not null and lon is not null) where r <= 20 and k <= 30",
        "top_anomaly_types": BASE + EVENTS + " select type, count(*) as events from events_kept group by type order by events desc, type limit 10",
        "anomaly_histogram": BASE + EVENTS + """,
sp as (select min(time_sec) as t0, max(time_sec) as t1, (max(time_sec) - min(time_sec)) / 29 as width from events_kept)
select severity, bin, round(any_value(t0 + bin * width), 4) as from_sec, count(*) as events from (select severity, cast(least(28, coalesce(floor((time_sec - t0) / nullif(width, 0)), 0)) as integer) as bin, t0, width from events_kept, sp) group by severity, bin""",
        "congestion_bands": BASE + NET + ROOM + """ select case when ci > 1 then 'congested' when round(ci, 4) > 0.5 then 'busy' else 'normal' end as band, count(*) as nodes from (select traffic / (capacity * windows) as ci from room where traffic > 0) group by band""",
        "congested_nodes": BASE + NET + ROOM + " select node, round(traffic / (capacity * windows), 4) as congestion_index, round(capacity, 1) as dynamic_capacity, traffic as traffic_count, traffic / (capacity * windows) > 1 as is_congested from room where traffic > 0 order by congestion_index desc, node limit 20",
        "network_report": BASE + NET + ROOM + _labels(50) + """,
gr as (select sum(traffic) / (sum(capacity) * max(windows)) > 0.8 as full_up from room join l50 on id = node group by label)
select round(sum(traffic) / (sum(capacity) * max(windows)), 4) as global_congestion_index, count(*) filter (traffic / (capacity * windows) > 1) as n_congested_nodes,
  round(count(*) filter (traffic / (capacity * windows) > 1) / greatest(count(*) filter (traffic > 0), 1), 4) as congested_node_ratio, (select count(*) from gr) as n_communities, (select count(*) from gr where full_up) as n_saturated_communities from room""",
        "mean_improvement": BASE + FUSED + _RMSE.format(limit="", members="") + _PREDICTION + " select round(avg(round(greatest(0, (rmse_total - fused_rmse) / rmse_total * 100), 1)), 2) as mean_improvement_pct from rmse, prediction",
        "occupancy_report": BASE + FUSED + ALARMS + """ select (select count(*) from located where source = 'spectrum') as detections, coalesce(sum(rows), 0)::bigint as false_alarms,
  round(coalesce(sum(rows), 0) / (select count(*) from located where source = 'spectrum'), 4) as false_alarm_rate from judged where reason is not null""",
        "sensor_files": BASE + f""" select source, cast(source_rank as integer) as source_rank, target_id, case when source = 'spectrum' then uav_model_text end as uav_model_text, {_rounds('time_sec lat lon')},
  round(case when source = 'spectrum' or (source = 'radar' and (heading is null or climb_rate is null)) then null else speed end, 4) as speed,
  round(case when source = 'spectrum' or (source = 'radar' and (heading is null or speed is null)) then null else climb_rate end, 4) as climb_rate, round(case when source = 'spectrum' then frequency end, 4) as frequency
  from located where time_sec is not null and (source = 'spectrum' or (lat is not null and lon is not null))""",
        "top_events": BASE + EVENTS + f" select {_EVENT} from (select * from events_kept order by time_sec, track_id, type limit 200)",
    }
    hav = f"2 * {R} * asin(sqrt(least(1.0::double, pow(sin(radians(z.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(z.lat)) * pow(sin(radians(z.lon - c.lon) / 2), 2))))"
    out["geofence_events"] = BASE + f""", z(name, lon, lat, radius, low, high) as (values ('airfield', 114.0::double, 30.45::double, 1500, 0, 400), ('works', 114.012::double, 30.455::double, 800, 100, 1000))
select round(time_sec, 4) as time_sec, source || ':' || target_id as track_id, 'geofence_intrusion' as type, name as fence_name, round({hav}, 1) as distance_to_center_m, 'critical' as level, 'critical' as severity, 'inside ' || name as description
from clean c join z on {hav} < radius and coalesce(c.alt_geom, c.u) between low and high where source in ('adsb', 'radar')"""
    return out
