"""DuckDB text of the registered queries, over the driver's views.

Written from the operators' definitions with DuckDB's own means (column-valued lags and frames, ordered
aggregates), not from the Spark plans. Each query takes the common table expressions that it needs.
"""

from __future__ import annotations

from ..operators.tune import DEFAULT_GRID
from .fixtures import BODYPARTS

K4 = "video_id, agent_id, target_id, video_frame"


def _scores(name: str, halved: int | None = None) -> str:
    value = "value" if halved is None else f"case when event_id % 3 = {halved} then value / 2 else value end"
    return f"""{name} as (select cast(user_id % 2 as int) as lab_id, cast(user_id % 10 as int) as video_id, 1 as agent_id, cast(1 + user_id % 2 as int) as target_id,
  event_type as action, cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as int) as video_frame, cast(max({value}) as float) as score
  from events group by all)"""


def _best(name: str, source: str, where: str) -> str:
    return f"""{name} as (select * from {source} where {where} qualify row_number() over (partition by {K4} order by score desc, action) = 1)"""


def _islands(name: str, source: str, keys: str = "lab_id, video_id, agent_id, target_id", names: bool = False) -> str:
    ids = "'mouse' || agent_id as agent_id, 'mouse' || target_id as target_id" if names else "agent_id, target_id"
    lead = keys.replace("agent_id, target_id", ids)
    return f"""{name} as (select {lead}, action, min(video_frame) as start_frame, cast(max(video_frame) + 1 as int) as stop_frame from (
    select *, sum(case when action = before and video_frame = last + 1 then 0 else 1 end) over (partition by {keys} order by video_frame) as run from (
      select *, lag(action) over (partition by {keys} order by video_frame) as before, lag(video_frame) over (partition by {keys} order by video_frame) as last from {source}))
    group by {keys}, run, action having count(*) >= 2)"""


SCORES = _scores("everything")
PREDS = _scores("preds", 1)
TRUTH = ", ".join([_scores("truth", 0), _best("truth_best", "truth", "score > 40"), _islands("a", "truth_best")])
SUB = ", ".join([_best("preds_best", "preds", "score > 20"), _islands("sub", "preds_best", names=True)])
W = "w as (select distinct lab_id, video_id, agent_id, target_id, action from preds where not (lab_id = 0 and action = 'error') and not (lab_id = 1 and action = 'signup'))"
SCALED = "scaled as (select * exclude (score), cast((cast(score as double) - 100) / 10 as float) as score from preds)"
SOL = """lists as (select video_id, to_json(list_sort(list(distinct 'mouse' || agent_id || ',mouse' || target_id || ',' || action))) as json from w group by video_id),
  sol as (select lab_id, video_id, 'mouse' || agent_id as agent_id, 'mouse' || target_id as target_id, action, start_frame, stop_frame,
    coalesce(cast(json as varchar), '[]') as behaviors_labeled from a left join lists using (video_id))"""
ACTIVE = "active as (select distinct video_id, 'mouse' || agent_id as agent_id, 'mouse' || target_id as target_id, action from w where video_id in (select video_id from sol))"
DURATIONS = "dur as (select lab_id, action, cast(round_even(median(stop_frame - start_frame), 0) as int) as roll_frames from a group by all)"
LABELS = "labels_f as (select video_id, agent_id, target_id, cast(unnest(range(start_frame, stop_frame)) as int) as video_frame, action from a)"


def _smooth(name: str, source: str, half: str, join: str = "") -> str:
    w = f"partition by video_id, agent_id, target_id, action order by video_frame rows between coalesce({half}, 0) preceding and coalesce({half}, 0) following"
    return f"""{name} as (select s.* exclude (score), cast(case when {half} is not null and count(score) over (w) = 2 * {half} + 1 then cast(avg(score) over (w) as float) else score end as float) as score
  from {source} s {join})""".replace("over (w)", f"over ({w})")


SMOOTH = _smooth("smooth", "preds", "(roll_frames // 2)", "left join dur d using (lab_id, action)").replace("s.* exclude (score)", "s.lab_id, s.video_id, s.agent_id, s.target_id, s.action, s.video_frame").replace("partition by video_id", "partition by s.video_id")

_POINTS = " union all ".join(
    f"""select cast(vec_id // 100 as int) as video_id, {m} as mouse_id, cast(vec_id % 100 as int) as video_frame, '{p}' as bodypart,
    case when vec_id % 37 <> 5 and (vec_id + {i * 7 + m}) % 23 <> 0 then embedding[{(m - 1) * 16 + 2 * i + 1}] end as x, case when vec_id % 37 <> 5 and (vec_id + {i * 7 + m}) % 23 <> 0 then embedding[{(m - 1) * 16 + 2 * i + 2}] end as y from embeddings"""
    for m in (1, 2)
    for i, p in enumerate(BODYPARTS)
)
_WIDE_COLUMNS = ", ".join(f"max(case when bodypart = '{p}' then {axis} end) as {axis}_{p}" for p in BODYPARTS for axis in "xy")
WIDE = f"wide as (select video_id, mouse_id, video_frame, {_WIDE_COLUMNS} from ({_POINTS}) where x is not null or y is not null group by all)"
META = """meta as (select distinct cast(vec_id // 100 as int) as video_id from embeddings),
  m as (select *, cast(case when video_id % 2 = 0 then 20 else 30 end as double) as fps, cast(10 + video_id as double) as scale,
    greatest(1, cast(round_even(cast(case when video_id % 2 = 0 then 20 else 30 end as float) * cast(0.1 as float), 0) as int)) as kf from meta)"""
PAIRS = """pairs as (select video_id, 1 as agent_id, 2 as target_id from meta union all select video_id, 1, 1 from meta union all select video_id, 2, 1 from meta where video_id % 2 = 0)"""
DT = ", ".join([WIDE, META, PAIRS, "dt as (select p.*, f.video_frame from pairs p left join (select distinct video_id, video_frame from wide) f using (video_id))"])


def _geometry(name: str, source: str, keys: str) -> str:
    upper, lower = ["nose", "ear_left", "ear_right", "neck"], ["tail_base", "hip_left", "hip_right"]
    mean = lambda axis, parts: "list_avg([" + ", ".join(f"cast({axis}_{p} as double)" for p in parts) + "])"
    means = ", ".join(f"{mean(axis, parts)} as {axis}_{n}" for n, parts in (("center", [*upper, *lower, "body_center"]), ("upper", upper), ("lower", lower)) for axis in "xy")
    floor = "case when raw_len < 1e-6 then cast(1e-6 as double) else raw_len end"
    return f"""{name} as (select *, (x_upper - x_lower) / body_len as unit_x, (y_upper - y_lower) / body_len as unit_y from (
    select *, {floor} as body_len from (select *, sqrt((x_upper - x_lower) * (x_upper - x_lower) + (y_upper - y_lower) * (y_upper - y_lower)) as raw_len from (select {keys}, x_ear_left, x_ear_right, y_ear_left, y_ear_right, {means} from {source}))))"""


GEOMETRY = _geometry("g", "wide", "video_id, mouse_id, video_frame")
SPINE = """spine as (select p.video_id, p.agent_id, p.target_id, f.video_frame, coalesce(l.action, 'Nothing') as action
  from (select distinct video_id, agent_id, target_id from w) p left join (select distinct video_id, video_frame from wide) f using (video_id)
  left join labels_f l on l.video_id = p.video_id and l.agent_id = p.agent_id and l.target_id = p.target_id and l.video_frame = f.video_frame)"""
FULL_SPINE = ", ".join([PREDS, TRUTH, W, LABELS, WIDE, META, SPINE])
FRAMES = ", ".join([PREDS, TRUTH, W, _best("every", "truth", "true"), f"spine as (select {K4}, case when score > 40 then action else 'Nothing' end as action from every)"])
SCORED = ", ".join([PREDS, TRUTH, SUB, W, SOL, ACTIVE])


def _fbeta(name: str, sub: str, extra: str = "") -> str:
    """Statistics of the submission table, split by ``extra`` ('z, ' or nothing)."""
    x = extra.rstrip(", ")
    values = f"(select distinct {extra}lab_id from {name}_s)" if extra else "(select distinct lab_id from sol)"
    both = f" and h.{x} = v.{x}" if extra else ""
    both_n = f" and n.{x} = v.{x}" if extra else ""
    pick = f"v.{x}, " if extra else ""
    return f"""{name}_s as (select {extra}l.lab_id, s.video_id, s.agent_id, s.target_id, s.action, s.start_frame, s.stop_frame from {sub} s
    join (select distinct video_id, lab_id from sol) l using (video_id) semi join active using (video_id, agent_id, target_id, action)),
  {name}_n as (select {extra}lab_id, action, cast(sum(stop_frame - start_frame) as bigint) as said from {name}_s group by all),
  {name}_h as (select {extra}lab_id, action, cast(sum(least(o.stop_frame, s.stop_frame) - greatest(o.start_frame, s.start_frame)) as bigint) as tp
    from sol o join {name}_s s using (lab_id, video_id, agent_id, target_id, action) where o.start_frame < s.stop_frame and s.start_frame < o.stop_frame group by all),
  {name}_c as (select {pick}v.lab_id, t.action, coalesce(h.tp, 0) as tp, coalesce(n.said, 0) - coalesce(h.tp, 0) as fp, t.truth - coalesce(h.tp, 0) as fn
    from {values} v join (select lab_id, action, cast(sum(stop_frame - start_frame) as bigint) as truth from sol group by all) t on t.lab_id = v.lab_id
    left join {name}_h h on h.lab_id = t.lab_id and h.action = t.action{both} left join {name}_n n on n.lab_id = t.lab_id and n.action = t.action{both_n}),
  {name} as (select *, case when tp + fp + fn > 0 then cast(2 * tp as double) / (2 * tp + fn + fp) else cast(0 as double) end as f_beta from {name}_c)"""


def _six(*names: str) -> str:
    return ", ".join(f"round(cast({n} as double), 6) + 0.0 as {n}" for n in names)


#: Rows of the spine with the class that a model of ``view`` takes them for.
KINDS = """kinds as (select *, case when action = 'view' then 'positive' when action <> 'Nothing' or (video_id, agent_id, target_id) in (select (video_id, agent_id, target_id) from w where action = 'view') then 'real' else 'maybe' end as neg_class from spine)"""


def _sampled(name: str, source: str, seed: int, by: str, kept: str) -> str:
    """The first rows of each group by the seeded draw."""
    draw = f"md5(concat_ws('|', '{seed}', {K4}, action))"
    return f"""{name} as (select * from (select *, row_number() over (partition by {by} order by {draw}, {K4}, action) as place, count(*) over (partition by {by}) as held from {source}) where place <= {kept})"""


def _folds(wanted: int | None) -> str:
    """Three folds for ``view`` with the seed 42, or ``wanted`` ones from repeated deals."""
    count = "k" if wanted is None else str(wanted)
    return f"""seen as (select cast(video_id as varchar) as video_id, max(cast(action = 'view' as int)) as has from spine group by video_id),
  size as (select cast(greatest(1, least(3, sum(has), count(*))) as int) as k from seen),
  deals as (select *, cast(unnest(range(cast(ceil({count} / k) as int))) as int) as deal from seen, size),
  dealt as (select *, deal * k + (row_number() over (partition by deal order by has desc, md5(concat_ws('|', '42', deal, video_id)), video_id) - 1) % k as own from deals),
  folds as (select cast(f.fold as int) as fold, d.video_id, case when d.own = f.fold then 'val' else 'train' end as role from dealt d, (select unnest(range({count})) as fold from size) f where f.fold >= d.deal * d.k and f.fold < (d.deal + 1) * d.k)"""


def _query(ctes: list[str] | str, body: str) -> str:
    return f"with {ctes if isinstance(ctes, str) else ', '.join(ctes)} {body}"


def _tune(by: str, source: str, islands_by: str) -> list[str]:
    grid = ", ".join(f"cast({z} as float)" for z in DEFAULT_GRID)
    return [
        f"bounds as (select {by}, min(score) as low, max(score) as high from scaled group by {by})",
        f"fitting as (select *, list_filter([{grid}], lambda z: z >= low and z <= high) as zs from bounds)",
        f"cand as (select {by}, unnest(case when len(zs) > 0 then zs else [low] end) as z from fitting)",
        f"alive as (select s.*, c.z from {source} s join cand c using ({by}) where s.score > c.z)",
        _islands("found", "alive", islands_by, names=True),
        _fbeta("tried", "found", "z, "),
    ]


W4 = "partition by video_id, agent_id, target_id order by video_frame"
WM = "partition by video_id, mouse_id order by video_frame"


def _lag(x: str, w: str = "w", k: str = "kf") -> str:
    return f"lag({x}, {k}) over {w}"


def _masks(source: str, name: str, w: str) -> str:
    return f"""{name} as (select *, ok1 and coalesce(lag(ok1, kf) over w, false) as ok2, ok1 and coalesce(lag(ok1, kf) over w, false) and coalesce(lag(ok1, 2 * kf) over w, false) as ok3 from (
    select *, coalesce(video_frame - lag(video_frame, kf) over w = kf, false) as ok1 from {source} window w as ({w})) window w as ({w}))"""


def _rate(x: str, ok: str = "ok1") -> str:
    return f"case when {ok} then {x} - lag({x}, kf) over w end * (fps / kf)"


def _wrapped(x: str) -> str:
    return f"case when ok1 then atan2(sin({x} - lag({x}, kf) over w), cos({x} - lag({x}, kf) over w)) end * (fps / kf)"


def _floor(x: str, least: str) -> str:
    return f"case when {x} is not null then greatest({x}, cast({least} as double)) end"


def _invariants() -> str:
    stages = [
        DT,
        GEOMETRY,
        """j as (select d.*, m.fps, m.kf, a.x_center as ox, a.y_center as oy, a.unit_x as ux, a.unit_y as uy, a.body_len as len, t.unit_x as tux, t.unit_y as tuy,
          t.x_center - a.x_center as dx, t.y_center - a.y_center as dy, t.x_upper - a.x_center as hx, t.y_upper - a.y_center as hy
          from dt d join m using (video_id) left join g a on a.video_id = d.video_id and a.mouse_id = d.agent_id and a.video_frame = d.video_frame
          left join g t on t.video_id = d.video_id and t.mouse_id = d.target_id and t.video_frame = d.video_frame)""",
        f"""k as (select *, {_floor("median(len) over (partition by video_id, agent_id, target_id)", "1e-9")} as ref, dx * ux + dy * uy as rx, dy * ux - dx * uy as ry, hx * ux + hy * uy as qx, hy * ux - hx * uy as qy, atan2(tuy, tux) - atan2(uy, ux) as turn from j)""",
        """s0 as (select video_id, agent_id, target_id, video_frame, fps, kf, ox, oy, ux, uy, ref, sqrt(rx * rx + ry * ry) / ref as r_center, sqrt(qx * qx + qy * qy) / ref as r_head, atan2(ry + 0.0, rx + 0.0) as theta_center,
          atan2(qy + 0.0, qx + 0.0) as theta_head, cos(turn) as cos_dpsi, sin(turn) as sin_dpsi, rx / ref as long, ry / ref as lat, cos(atan2(ry + 0.0, rx + 0.0)) as cos_theta, sin(atan2(ry + 0.0, rx + 0.0)) as sin_theta from k)""",
        _masks("s0", "s1", W4),
        f"""s2 as (select *, {_rate("r_center")} as dr_center, {_wrapped("theta_center")} as dtheta_center, {_rate("long")} as v_long, {_rate("lat")} as v_lat, {_rate("r_head")} as head_approach,
          case when ok1 then ox - lag(ox, kf) over w end as mx, case when ok1 then oy - lag(oy, kf) over w end as my from s1 window w as ({W4}))""",
        f"""s3 as (select *, (mx * ux + my * uy) * (fps / kf / {_floor("ref", "1e-9")}) as vf, (my * ux - mx * uy) * (fps / kf / {_floor("ref", "1e-9")}) as vl, {_rate("dr_center", "ok2")} as d2r_center,
          {_rate("dtheta_center", "ok2")} as d2dtheta_center, {_rate("v_long", "ok2")} as a_long, {_rate("v_lat", "ok2")} as a_lat, sqrt({_floor("long * long + lat * lat", "1e-12")}) as los from s2 window w as ({W4}))""",
        f"""s4 as (select *, (vf * (long / los) + vl * (lat / los)) / sqrt({_floor("vf * vf + vl * vl", "1e-12")}) as align_agent_los,
          (v_long * (long / los) + v_lat * (lat / los)) / sqrt({_floor("v_long * v_long + v_lat * v_lat", "1e-12")}) as align_target_los, -sign(theta_center) * dtheta_center as turn_toward,
          (v_long * vf + v_lat * vl) / (sqrt(v_long * v_long + v_lat * v_lat) * sqrt(vf * vf + vl * vl) + cast(1e-6 as double)) as motion_parallel,
          cast(coalesce(ok1 and dr_center < 0 and cos_theta > 0, false) as int) as approaching from s3)""",
        f"""s5 as (select *, avg(approaching) over (partition by video_id, agent_id, target_id order by video_frame rows between (2 * kf - 1) preceding and current row) as frac_approach_tau,
          (video_frame - last_value(case when r_center < 1 then video_frame end ignore nulls) over ({W4} rows between unbounded preceding and current row)) / fps as t_since_contact from s4)""",
    ]
    names = "r_center r_head theta_center theta_head cos_dpsi sin_dpsi long lat v_long v_lat dr_center d2r_center dtheta_center d2dtheta_center align_agent_los align_target_los motion_parallel frac_approach_tau t_since_contact a_long a_lat turn_toward head_approach cos_theta sin_theta".split()
    return _query(stages, f"select {K4}, {_six(*names)} from s5")


def _single_mouse() -> str:
    centred = lambda f, x: f"{f}({x}) over ({WM} rows between (kf * 3 // 2) preceding and (kf * 3 // 2) following)"
    names = "v_forward v_lateral a_forward a_lateral speed_total turn_agent curvature turn_smoothness forward_consistency lat_ratio_med speed_med mouse_body_len ear_gap".split()
    stages = [
        DT,
        GEOMETRY,
        "mice as (select distinct video_id, mouse_id, video_frame from (select video_id, agent_id as mouse_id, video_frame from dt union all select video_id, target_id, video_frame from dt))",
        """t0 as (select c.*, m.fps, m.kf, x_center as ox, y_center as oy, unit_x as ux, unit_y as uy, body_len as ref, body_len as mouse_body_len,
          sqrt((cast(x_ear_left as double) - x_ear_right) * (cast(x_ear_left as double) - x_ear_right) + (cast(y_ear_left as double) - y_ear_right) * (cast(y_ear_left as double) - y_ear_right)) / body_len as ear_gap, atan2(unit_y, unit_x) as psi
          from mice c join m using (video_id) left join g using (video_id, mouse_id, video_frame))""",
        _masks("t0", "t1", WM),
        f"""t2 as (select *, case when ok1 then ox - lag(ox, kf) over w end as dx, case when ok1 then oy - lag(oy, kf) over w end as dy, {_wrapped("psi")} as turn_agent from t1 window w as ({WM}))""",
        f"""t3 as (select *, (dx * ux + dy * uy) * (fps / kf / {_floor("ref", "1e-9")}) as v_forward, (dy * ux - dx * uy) * (fps / kf / {_floor("ref", "1e-9")}) as v_lateral from t2)""",
        f"""t4 as (select *, sqrt(v_forward * v_forward + v_lateral * v_lateral) as speed_total, {_rate("v_forward", "ok2")} as a_forward, {_rate("v_lateral", "ok2")} as a_lateral,
          case when ok2 then abs(dx * (dy - lag(dy, kf) over w) - dy * (dx - lag(dx, kf) over w)) end / {_floor("pow(dx * dx + dy * dy, cast(1.5 as double))", "1e-6")} * ref as curvature,
          abs(v_lateral) / {_floor("abs(v_forward)", "1e-6")} as lat_ratio from t3 window w as ({WM}))""",
        f"""t5 as (select *, {centred("sum", "cast(ok1 as int)")} = 2 * (kf * 3 // 2) + 1 as whole, {centred("avg", "v_forward")} as fm, {centred("avg", "turn_agent")} as tm, {centred("avg", "lat_ratio")} as lm, {centred("avg", "speed_total")} as sm from t4)""",
        f"""t6 as (select *, cast(1.253314 as double) * {centred("avg", "abs(v_forward - fm)")} as fsd, cast(1.253314 as double) * {centred("avg", "abs(turn_agent - tm)")} as tsd from t5)""",
        """t7 as (select *, case when whole then tsd end as turn_smoothness, case when whole then fm / (fsd + cast(1e-6 as double)) end as forward_consistency, case when whole then lm end as lat_ratio_med, case when whole then sm end as speed_med from t6)""",
    ]
    picks = ", ".join(f"round(cast({r}.{n} as double), 6) + 0.0 as {p}_{n}" for r, p in (("a", "ag"), ("t", "tg")) for n in names)
    return _query(
        stages,
        f"""select d.video_id, d.agent_id, d.target_id, d.video_frame, {picks} from dt d
        left join t7 a on a.video_id = d.video_id and a.mouse_id = d.agent_id and a.video_frame = d.video_frame left join t7 t on t.video_id = d.video_id and t.mouse_id = d.target_id and t.video_frame = d.video_frame""",
    )


def _pair_distances() -> str:
    parts = ["nose", "neck", "tail_base"]

    def square(r1: str, a: str, r2: str, b: str, tag: str) -> str:
        dx, dy = (f"(cast({r1}.{axis}_{a} as double) - cast({r2}.{axis}_{b} as double))" for axis in "xy")
        return f"round({dx} * {dx} + {dy} * {dy}, 6) + 0.0 as {tag}_{a}_{b}"

    own = [square(r, a, r, b, tag) for r, tag in (("a", "m1m1"), ("t", "m2m2")) for i, a in enumerate(parts) for b in parts[i + 1 :]]
    cross = [square("a", a, "t", b, "m1m2") for a in parts for b in parts]
    return _query(
        DT,
        f"""select d.video_id, d.agent_id, d.target_id, d.video_frame, {", ".join(own + cross)} from dt d
        left join wide a on a.video_id = d.video_id and a.mouse_id = d.agent_id and a.video_frame = d.video_frame left join wide t on t.video_id = d.video_id and t.mouse_id = d.target_id and t.video_frame = d.video_frame""",
    )


def _temporal() -> str:
    return _query(
        [
            DT,
            "v0 as (select d.*, m.fps, m.kf, cast(x_nose as double) as v from dt d join m using (video_id) left join wide a on a.video_id = d.video_id and a.mouse_id = d.agent_id and a.video_frame = d.video_frame)",
            _masks("v0", "v1", W4),
            f"v2 as (select *, avg(v) over ({W4} rows between (kf - 1) preceding and current row) as w1 from v1)",
            f"""v3 as (select *, case when ok1 then w1 end as v_lagw1_mean, case when ok2 then lag(w1, kf) over w end as v_lagw2_mean, case when ok3 then lag(w1, 2 * kf) over w end as v_lagw3_mean from v2 window w as ({W4}))""",
        ],
        f"select {K4}, {_six('v', 'v_lagw1_mean', 'v_lagw2_mean', 'v_lagw3_mean')} from v3",
    )


def oracle_sql() -> dict[str, str]:
    wide_values = _six(*[f"{axis}_{p}" for p in BODYPARTS for axis in "xy"])
    actions = ["click", "error", "purchase", "signup", "view"]
    pivot = "pv as (select " + K4 + ", " + ", ".join(f"max(case when action = '{a}' then score end) as {a}" for a in actions) + f" from preds group by {K4})"
    tuned = [PREDS, SCALED, TRUTH, W, SOL, ACTIVE, *_tune("lab_id, action", "scaled", "lab_id, z, action, video_id, agent_id, target_id")]
    tuned[-2] = tuned[-2].replace("as target_id, action, min", "as target_id, min").replace("run, action having", "run having")
    best = lambda by, value, source: f"select {by}, round(cast(z as double), 6) + 0.0 as z_thr, round(cast(cast({value} as float) as double), 6) + 0.0 as score from {source} qualify row_number() over (partition by {by} order by {value} desc, z) = 1"
    per_action = "scored as (select c.lab_id, c.action, c.z, round(coalesce(t.f_beta, 0), 9) as f from cand c semi join sol using (lab_id, action) left join tried t on t.lab_id = c.lab_id and t.action = c.action and t.z = c.z)"
    per_lab = [PREDS, SCALED, TRUTH, W, SOL, ACTIVE, _best("top", "scaled", "true"), *_tune("lab_id", "top", "lab_id, z, video_id, agent_id, target_id")]
    lab_scored = "scored as (select c.lab_id, c.z, round(coalesce(avg(t.f_beta), 0), 9) as f from cand c left join tried t on t.lab_id = c.lab_id and t.z = c.z group by all)"
    allowed = "allowed as (select p.* from {} p where (video_id, agent_id, target_id, action) in (select (video_id, agent_id, target_id, action) from w) or action in ('unlabeled', 'Nothing'))"
    allowed, allowed_scaled = allowed.format("preds"), allowed.format("scaled")
    thr = "thr as (" + best("lab_id, action", "f", "scored").replace("round(cast(z as double), 6) + 0.0 as z_thr", "z as z_thr") + ")"
    submit_ctes = [
        PREDS, SCALED, TRUTH, W, SOL, ACTIVE, DURATIONS, allowed_scaled,
        SMOOTH.replace("from preds s", "from allowed s"),
        *[c.replace("from scaled group", "from smooth group") for c in _tune("lab_id, action", "smooth", "lab_id, z, action, video_id, agent_id, target_id")],
        per_action, thr,
        _best("final", "(select s.* from smooth s join thr using (lab_id, action) where s.score > z_thr)", "true"),
        _islands("submitted", "final", "video_id, agent_id, target_id", names=True),
    ]
    submit_ctes[13] = submit_ctes[13].replace("as target_id, action, min", "as target_id, min").replace("run, action having", "run having")
    by_lab = [
        PREDS, "scaled as (select * exclude (score, action), case when action = 'error' then 'Nothing' else action end as action, cast((cast(score as double) - 100) / 10 as float) as score from preds)", TRUTH, W, SOL, ACTIVE, allowed_scaled,
        _smooth("smooth", "allowed", "1"), _best("top", "smooth", "true"),
        *[c.replace("from scaled group", "from smooth group") for c in _tune("lab_id", "top", "lab_id, z, video_id, agent_id, target_id")],
        lab_scored, "thr as (" + best("lab_id", "f", "scored").replace("round(cast(z as double), 6) + 0.0 as z_thr", "z as z_thr") + ")",
        _best("final", "(select s.* from smooth s join thr using (lab_id) where s.score > z_thr)", "true"),
        _islands("submitted", "final", "video_id, agent_id, target_id", names=True),
    ]
    smooth3 = _smooth("sm", "everything", "1")
    raw_best, raw = _best("raw_best", "preds", "true"), _islands("raw", "raw_best", names=True)
    overlap_rows = "rows_ as (select video_id, agent_id, target_id, action, start_frame, stop_frame from a union all select video_id, agent_id, target_id, action, start_frame + 1, stop_frame + 2 from a)"
    flags = lambda t: f"select *, coalesce(max(stop_frame) over (partition by video_id, agent_id, target_id order by start_frame, stop_frame, action rows between unbounded preceding and 1 preceding) > start_frame, false) as overlaps from {t}"
    report = ", ".join(
        f"(select count(*) from {t}) as {n}_rows, (select count(*) from {t} where {' or '.join(f'{c} is null' for c in cols.split())}) as {n}_missing, (select count(*) from {t} where start_frame >= stop_frame) as {n}_empty, (select count(*) from ({flags(t)}) where \"overlaps\") as {n}_overlaps"
        for t, n, cols in (("sol", "solution", "video_id agent_id target_id action start_frame stop_frame behaviors_labeled lab_id"), ("sub", "submission", "video_id agent_id target_id action start_frame stop_frame"))
    )
    logit = lambda p: f"ln(q / (1 - q)) from (select *, least(greatest({p}, cast(1e-6 as double)), 1 - cast(1e-6 as double)) as q"
    clip = lambda x: f"least(greatest({x}, cast(1e-6 as double)), 1 - cast(1e-6 as double))"
    odds = lambda x: f"ln({clip(x)} / (1 - {clip(x)}))"
    n = "cast(length(action) as double)"
    platt = f"{odds(f'1 / (1 + exp(-({n} / 100 * score + -{n} / 10)))')} - {odds(f'{n} / 20')}"
    dilated = "case when video_id % 2 = 0 then 4 else 6 end"
    return {
        "intervals": _query([SCORES, smooth3, _best("b", "sm", "score > 10"), _islands("i", "b", names=True)], "select * exclude (lab_id) from i"),
        "smooth_scores": _query([PREDS, TRUTH, DURATIONS, SMOOTH], "select * exclude (score), round(cast(round(score, 3) as double), 6) + 0.0 as score from smooth"),
        "argmax_filter": _query([PREDS, _best("b", "preds", "score > 20")], f"select * exclude (score), {_six('score')} from b"),
        "whitelist_filter": _query([PREDS, W, allowed], f"select * exclude (score), {_six('score')} from allowed"),
        "melt_scores": _query([PREDS], f"select {K4}, action, {_six('score')} from preds where score is not null"),
        "wide_scores_pivot": _query([PREDS, pivot], f"select {K4}, {_six(*actions)} from pv"),
        "whitelist_parse": _query(
            [META],
            """select 'lab' || (video_id % 2) as lab_id, video_id, 1 as agent_id, 2 as target_id, 'chase' as action from m union all select 'lab' || (video_id % 2), video_id, 1, 1, 'rear' from m
            union all select 'lab' || (video_id % 2), video_id, 2, 1, 'sniff' from m where video_id % 2 = 0""",
        ),
        "bodypart_intersection": _query(
            [
                META,
                """p as (select 'lab' || (video_id % 2) as lab_id, video_id, unnest(['nose', 'ear_left', 'ear_right', 'neck', 'body_center', 'hip_left', 'hip_right', 'tail_base']) as part from m)""",
                "c as (select lab_id, part from p where not (part = 'neck' and video_id % 3 = 0) group by lab_id, part having count(*) = (select count(*) from m where 'lab' || (m.video_id % 2) = p.lab_id))",
            ],
            "select lab_id, string_agg(part, ',' order by part) as bodyparts from c group by lab_id",
        ),
        "action_duration": _query([TRUTH, DURATIONS], "select * from dur"),
        "expand_intervals": _query([TRUTH, LABELS], "select * from labels_f"),
        "tracks_wide": _query([WIDE], f"select video_id, mouse_id, video_frame, {wide_values} from wide"),
        "pair_spine": _query(
            FULL_SPINE,
            """select s.*, round(cast(a.x_nose as double), 6) + 0.0 as ag_x_nose, round(cast(a.y_tail_base as double), 6) + 0.0 as ag_y_tail_base, round(cast(t.x_nose as double), 6) + 0.0 as tg_x_nose, round(cast(t.y_tail_base as double), 6) + 0.0 as tg_y_tail_base
            from spine s left join wide a on a.video_id = s.video_id and a.mouse_id = s.agent_id and a.video_frame = s.video_frame left join wide t on t.video_id = s.video_id and t.mouse_id = s.target_id and t.video_frame = s.video_frame""",
        ),
        "normalize_coords": _query([WIDE, META], "select video_id, mouse_id, video_frame, round(cast(x_nose as double) / scale, 6) + 0.0 as x_nose, round(cast(y_neck as double) / scale, 6) + 0.0 as y_neck from wide join m using (video_id)"),
        "body_geometry": _query(
            [WIDE, GEOMETRY, f"r as (select *, {_floor('median(body_len) over (partition by video_id, mouse_id)', '1e-9')} as ref_len from g)"],
            f"select video_id, mouse_id, video_frame, {_six(*[f'{axis}_{p}' for p in ('center', 'upper', 'lower') for axis in 'xy'], 'body_len', 'unit_x', 'unit_y', 'ref_len')} from r",
        ),
        "ear_gap": _query([WIDE], "select video_id, mouse_id, video_frame, round(sqrt(pow(cast(x_ear_left as double) - x_ear_right, 2) + pow(cast(y_ear_left as double) - y_ear_right, 2)), 6) + 0.0 as ear_gap from wide"),
        "pair_distances": _pair_distances(),
        "lag_structure": _query([WIDE, META, "l0 as (select wide.*, fps, kf from wide join m using (video_id))", _masks("l0", "l1", WM)], "select video_id, mouse_id, video_frame, kf, ok1, ok2, ok3 from l1"),
        "lagged_rates": _query(
            [WIDE, META, "l0 as (select video_id, mouse_id, video_frame, cast(x_nose as double) as x, atan2(cast(y_nose as double), cast(x_nose as double)) as psi, fps, kf from wide join m using (video_id))", _masks("l0", "l1", WM)],
            f"select video_id, mouse_id, video_frame, round({_rate('x')}, 6) + 0.0 as vx, round({_wrapped('psi')}, 6) + 0.0 as turn from l1 window w as ({WM})",
        ),
        "invariants": _invariants(),
        "single_mouse": _single_mouse(),
        "temporal_feats": _temporal(),
        "submit": _query(submit_ctes, "select * from submitted"),
        "submit_per_lab": _query(by_lab, "select * from submitted"),
        "evaluate_scores": _query(
            [*submit_ctes, _best("raw_best", "scaled", "true"), _islands("raw", "raw_best", names=True), _fbeta("r", "raw"), _fbeta("p", "submitted")],
            "select lab_id, action, round(r.f_beta, 6) + 0.0 as f_raw, round(p.f_beta, 6) + 0.0 as f_post from r join p using (lab_id, action)",
        ),
        "solution_json": _query([PREDS, TRUTH, W, SOL], "select * from sol"),
        "overlap_check": _query([TRUTH, overlap_rows], flags("rows_")),
        "validate_report": _query(SCORED, f"select {report}, (select count(distinct video_id) from sub where video_id not in (select video_id from sol)) as unknown_videos, (select count(*) from (select video_id from sol group by video_id having count(distinct behaviors_labeled) > 1)) as inconsistent_videos"),
        "interval_overlap": _query(
            SCORED,
            """select video_id, agent_id, target_id, action, cast(sum(least(o.stop_frame, s.stop_frame) - greatest(o.start_frame, s.start_frame)) as bigint) as overlap
            from sol o join sub s using (video_id, agent_id, target_id, action) where o.start_frame < s.stop_frame and s.start_frame < o.stop_frame group by all""",
        ),
        "fbeta_by_action": _query([SCORED, _fbeta("st", "sub")], f"select lab_id, action, tp, fp, fn, {_six('f_beta')} from st"),
        "fbeta_macro": _query([SCORED, _fbeta("st", "sub")], "select round(avg(f), 6) + 0.0 as macro_f_beta from (select avg(f_beta) as f from st group by lab_id)"),
        "raw_vs_post_scores": _query(
            [SCORED, raw_best, raw, _fbeta("r", "raw"), DURATIONS, SMOOTH, _best("post_best", "smooth", "score > 20"), _islands("post", "post_best", names=True), _fbeta("p", "post")],
            "select lab_id, action, round(r.f_beta, 6) + 0.0 as f_raw, round(p.f_beta, 6) + 0.0 as f_post from r join p using (lab_id, action)",
        ),
        "tune_z": _query([*tuned, per_action], best("lab_id, action", "f", "scored")),
        "tune_z_per_lab": _query([*per_lab, lab_scored], best("lab_id", "f", "scored")),
        "platt_apply": _query([PREDS], f"select {K4}, action, round(cast(round(cast({platt} as float), 3) as double), 6) + 0.0 as calibrated from preds".replace("round(cast(round(cast(", "round(round(cast(cast(").replace(" as float), 3) as double), 6)", " as float) as double), 3), 6)")),
        "prob_to_logit": _query([PREDS], f"select {K4}, action, round({logit('cast(score as double) / 100')} from preds), 6) + 0.0 as logit".replace("round(ln(q / (1 - q)) from (", "round(ln(q / (1 - q)), 6) + 0.0 as logit from (").replace("from preds), 6) + 0.0 as logit", "from preds)")),
        "logloss": _query(
            [PREDS],
            f"select action, round(-avg(case when y = 1 then ln(q) else ln(1 - q) end), 6) + 0.0 as log_loss from (select action, video_frame % 2 as y, {clip('1 / (1 + exp(-((cast(score as double) - 50) / 20)))')} as q from preds) group by action",
        ),
        "neg_classes": _query([FULL_SPINE, KINDS], f"select {K4}, action, neg_class from kinds"),
        "sample_by_video": _query([FRAMES, _sampled("taken", "spine", 1, "video_id", "floor(held * 30 / 100)")], f"select {K4}, action from taken"),
        "sample_unlabelled": _query(
            [FRAMES, "unlabelled as (select * from spine where action = 'Nothing')", _sampled("taken", "unlabelled", 1, "video_id, agent_id, target_id", "greatest(floor(held * 10 / 100), 1)")],
            f"select {K4}, action from spine where action <> 'Nothing' union all select {K4}, action from taken",
        ),
        "fold_membership": _query([FRAMES, _folds(7)], "select fold, video_id, role from folds"),
        "fold_rows": _query(
            [
                FRAMES,
                KINDS,
                _folds(None),
                "own as (select k.* exclude (video_id), cast(k.video_id as varchar) as video_id from kinds k semi join (select * from folds where fold = 0 and role = 'train') f on cast(k.video_id as varchar) = f.video_id)",
                "sure as (select * from own where neg_class = 'real')",
                "unsure as (select * from own where neg_class = 'maybe')",
                _sampled("half", "sure", 5, "video_id", "floor(held * 50 / 100)"),
                _sampled("fifth", "unsure", 5, "video_id", "floor(held * 20 / 100)"),
            ],
            " union all ".join(f"select {K4}, action, neg_class from {t}" for t in ("own where neg_class = 'positive'", "half", "fifth")),
        ),
        "augmented_train": _query(
            [FRAMES, _folds(None)],
            f"select {K4}, action, false as aug from spine union all select {K4}, action, true as aug from spine where cast(video_id as varchar) not in (select video_id from folds where fold = 0 and role = 'val')",
        ),
        "run_weights": _query(
            [
                SCORES,
                _best("b", "everything", "true"),
                f"c as (select *, action = 'view' as y, lag(action = 'view', 1, false) over ({W4}) as prior from b)",
                f"r as (select *, sum(cast(y <> prior as int)) over ({W4}) as run from c)",
                "q as (select *, case when y then 1.0::double / count(*) over (partition by video_id, agent_id, target_id, run) end as w from r)",
            ],
            f"select {K4}, action, round(case when y then w * (select count(w) / sum(w) from q) else 1 end, 6) + 0.0 as weight from q",
        ),
        "pseudo_mask": _query(
            [FULL_SPINE, _scores("third", 2), _best("ps", "third", "score > 30")],
            f"""select distinct s.video_id, s.agent_id, s.target_id, s.video_frame, p.action as pseudo_action from spine s join ps p using ({K4}) where s.action = 'Nothing'
            and (s.video_id, s.agent_id, s.target_id, p.action) not in (select (video_id, agent_id, target_id, action) from w where action <> 'view')""",
        ),
        "pseudo_labels": _query(
            [
                FULL_SPINE,
                _scores("third", 2),
                _best("ps", "third", "score > 30"),
                "looked as (select distinct video_id, agent_id, target_id, action from w where action <> 'view')",
                f"mask as (select distinct {K4} from ps where action = 'view' and (video_id, agent_id, target_id) not in (select (video_id, agent_id, target_id) from looked where action = 'view'))",
            ],
            f"select {K4}, case when m.hit and action = 'Nothing' then 'view' else action end as action, case when m.hit and action = 'Nothing' then cast(0.25 as double) else cast(1 as double) end as weight from spine left join (select *, true as hit from mask) m using ({K4})",
        ),
        "dilate_labels": _query(
            FULL_SPINE,
            f"""select {K4}, action, coalesce(case when video_id in (select video_id from meta) then max(cast(action <> 'Nothing' as int)) over (partition by video_id, agent_id, target_id order by video_frame, action
            rows between ({dilated}) preceding and ({dilated}) following) = 1 end, false) as near_label from spine""",
        ),
        "fill_zeros": _query(
            FULL_SPINE,
            "select s.*, "
            + ", ".join(f"round(cast(coalesce({r}.{c}, 0) as double), 6) + 0.0 as {p}_{c}" for r, p, c in (("a", "ag", "x_nose"), ("a", "ag", "y_neck"), ("t", "tg", "x_neck"), ("t", "tg", "y_tail_base")))
            + " from (select * replace (coalesce(video_frame, 0) as video_frame) from spine) s left join wide a on a.video_id = s.video_id and a.mouse_id = s.agent_id and a.video_frame = s.video_frame left join wide t on t.video_id = s.video_id and t.mouse_id = s.target_id and t.video_frame = s.video_frame",
        ),
        "bidir_fill": _query(
            [DT, "f as (select d.*, a.x_nose, t.y_tail_base from dt d left join wide a on a.video_id = d.video_id and a.mouse_id = d.agent_id and a.video_frame = d.video_frame left join wide t on t.video_id = d.video_id and t.mouse_id = d.target_id and t.video_frame = d.video_frame)"],
            f"select {K4}, " + ", ".join(f"round(cast(coalesce(last_value({c} ignore nulls) over ({W4} rows between unbounded preceding and current row), first_value({c} ignore nulls) over ({W4} rows between current row and unbounded following), 0) as double), 6) + 0.0 as {c}" for c in ("x_nose", "y_tail_base")) + " from f",
        ),
        "class_counts": _query(FULL_SPINE, "select video_id, action, count(*) as n_rows from spine group by all"),
        "class_encode": _query([PREDS], "select action, cast(row_number() over (order by action) - 1 as int) as class_id from (select distinct action from preds)"),
        "grid_expand": "select cast(neg as double) as neg, cast(unl as double) as unl from (values (10), (20), (50)) a(neg), (values (0), (5)) b(unl)",
        "stream_intervals": _query([PREDS, _best("preds_best", "preds", "score > 20"), _islands("i", "preds_best")], "select * exclude (lab_id) from i"),
        "long_smoothing": _query(
            [
                """days as (select cast(l_suppkey % 10 as int) as video_id, l_returnflag || l_linestatus as action, cast(date_diff('day', date '1990-01-01', cast(l_shipdate as date)) as int) as video_frame,
                cast(floor(max(l_extendedprice)) as float) as score from lineitem group by all)"""
            ],
            """select video_id, action, video_frame, round(cast(case when count(score) over w = 201 then cast(avg(cast(score as double)) over w as float) else score end as double), 6) + 0.0 as score
            from days window w as (partition by video_id, action order by video_frame rows between 100 preceding and 100 following)""",
        ),
    }
