"""Lag structure and temporal features.

Lags count rows of a track, not frames; masks ok1, ok2, ok3 say where one, two or three lags of
unbroken frames lie behind a row. All windows of one operator share a partitioning and an order, so
each operator takes one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_even, hypot, safe_max, wrap_angle
from ..functions.sizes import broadcast_if_small
from ..functions.tables import materialise
from ..functions.windows import centred, distinct_values, lagged, ordered, trailing
from .geometry import agent_frame, body_geometry, ear_gap, reference_length

PAIR_TRACK = ["aug", "video_id", "agent_id", "target_id"]
MOUSE_TRACK = ["aug", "video_id", "mouse_id"]

#: Names and order of the features.
PAIR_FEATURES = (
    "r_center", "r_head", "theta_center", "theta_head", "cos_dpsi", "sin_dpsi", "long", "lat", "v_long", "v_lat",
    "dr_center", "d2r_center", "dtheta_center", "d2dtheta_center", "align_agent_los", "align_target_los",
    "motion_parallel", "frac_approach_tau", "t_since_contact", "a_long", "a_lat", "turn_toward", "head_approach",
    "cos_theta", "sin_theta",
)
MOUSE_FEATURES = (
    "v_forward", "v_lateral", "a_forward", "a_lateral", "speed_total", "turn_agent", "curvature", "turn_smoothness",
    "forward_consistency", "lat_ratio_med", "speed_med", "mouse_body_len", "ear_gap",
)


def lag_frames(meta: DataFrame, lag_sec: float) -> DataFrame:
    """(video_id, fps, kf): lag in rows, at least 1, rounded half to even in single precision."""
    product = F.col("frames_per_second").cast("float") * F.lit(lag_sec).cast("float")
    return meta.select("video_id", F.col("frames_per_second").cast("double").alias("fps"), F.greatest(half_even(product), F.lit(1)).alias("kf"))


class Lags:
    """A table with its lag columns and the expressions over them."""

    def __init__(self, dt: DataFrame, meta: DataFrame, lag_sec: float, by: Sequence[str], values: Sequence[int] | None = None):
        dim = lag_frames(meta, lag_sec)
        self.values = list(values) if values is not None else distinct_values(dim, "kf")
        self.window = ordered(by, ["video_frame"])
        self.k = F.col("kf")
        self.table = dt.join(broadcast_if_small(dim), "video_id", "left")

    def lag(self, c: Column, times: int = 1) -> Column:
        return lagged(c, self.k, self.values, self.window, times)

    def masks(self) -> DataFrame:
        """Adds ok1, ok2 and ok3."""
        no = F.lit(False)
        t = self.table.withColumn("ok1", F.coalesce(F.col("video_frame") - self.lag(F.col("video_frame")) == self.k, no))
        ok1 = F.col("ok1")
        t = t.withColumns({"ok2": ok1 & F.coalesce(self.lag(ok1), no), "ok3": ok1 & F.coalesce(self.lag(ok1), no) & F.coalesce(self.lag(ok1, 2), no)})
        self.table = t
        return t

    def delta(self, c: Column, ok: str = "ok1", angle: bool = False) -> Column:
        d = c - self.lag(c)
        return F.when(F.col(ok), wrap_angle(d) if angle else d)

    def rate(self, c: Column, ok: str = "ok1", angle: bool = False) -> Column:
        return self.delta(c, ok, angle) * (F.col("fps") / self.k)


def add_lag_structure(dt: DataFrame, meta: DataFrame, lag_sec: float, by: Sequence[str], values: Sequence[int] | None = None) -> DataFrame:
    return Lags(dt, meta, lag_sec, by, values).masks()


def pair_invariants(dt: DataFrame, meta: DataFrame, *, lag_sec: float, norm_by: str | None = None, values: Sequence[int] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """The 25 pair features in the agent's frame; columns named in ``carry`` pass along."""
    ids = [*PAIR_TRACK, "video_frame", *(["action"] if "action" in dt.columns else []), *(f"`{x}`" for x in carry)]
    c = F.col
    t = body_geometry(body_geometry(dt, "ag"), "tg").withColumn("ref", reference_length(norm_by, "ag_body_len", PAIR_TRACK))
    to_center = agent_frame(c("tg_x_center") - c("ag_x_center"), c("tg_y_center") - c("ag_y_center"), c("ag_unit_x"), c("ag_unit_y"))
    to_head = agent_frame(c("tg_x_upper") - c("ag_x_center"), c("tg_y_upper") - c("ag_y_center"), c("ag_unit_x"), c("ag_unit_y"))
    turn = F.atan2("tg_unit_y", "tg_unit_x") - F.atan2("ag_unit_y", "ag_unit_x")
    theta = F.atan2(to_center[1], to_center[0])
    t = t.select(
        *ids,
        (hypot(*to_center) / c("ref")).alias("r_center"),
        (hypot(*to_head) / c("ref")).alias("r_head"),
        theta.alias("theta_center"),
        F.atan2(to_head[1], to_head[0]).alias("theta_head"),
        F.cos(turn).alias("cos_dpsi"),
        F.sin(turn).alias("sin_dpsi"),
        (to_center[0] / c("ref")).alias("long"),
        (to_center[1] / c("ref")).alias("lat"),
        F.cos(theta).alias("cos_theta"),
        F.sin(theta).alias("sin_theta"),
        c("ag_x_center").alias("ox"),
        c("ag_y_center").alias("oy"),
        c("ag_unit_x").alias("ux"),
        c("ag_unit_y").alias("uy"),
        "ref",
    )
    lags = Lags(t, meta, lag_sec, PAIR_TRACK, values)
    lags.masks()
    moved = agent_frame(lags.delta(c("ox")), lags.delta(c("oy")), c("ux"), c("uy"))
    body = c("fps") / c("kf") / safe_max(c("ref"), 1e-9)
    first = {n: lags.rate(c(s), angle=s == "theta_center") for n, s in (("dr_center", "r_center"), ("dtheta_center", "theta_center"), ("v_long", "long"), ("v_lat", "lat"), ("head_approach", "r_head"))}
    t = lags.table.withColumns(first | {"vf": moved[0] * body, "vl": moved[1] * body})
    t = t.withColumns({n: lags.rate(c(s), "ok2") for n, s in (("d2r_center", "dr_center"), ("d2dtheta_center", "dtheta_center"), ("a_long", "v_long"), ("a_lat", "v_lat"))})
    speed = lambda a, b: F.sqrt(safe_max(a * a + b * b, 1e-12))
    los = speed(c("long"), c("lat"))
    along = c("long") / los, c("lat") / los
    approaching = F.coalesce(c("ok1") & (c("dr_center") < 0) & (c("cos_theta") > 0), F.lit(False)).cast("int")
    t = t.withColumns(
        {
            "align_agent_los": (c("vf") * along[0] + c("vl") * along[1]) / speed(c("vf"), c("vl")),
            "align_target_los": (c("v_long") * along[0] + c("v_lat") * along[1]) / speed(c("v_long"), c("v_lat")),
            "turn_toward": -F.signum("theta_center") * c("dtheta_center"),
            "motion_parallel": (c("v_long") * c("vf") + c("v_lat") * c("vl")) / (hypot(c("v_long"), c("v_lat")) * hypot(c("vf"), c("vl")) + 1e-6),
            "approaching": approaching,
        }
    )
    contact = F.last(F.when(c("r_center") < 1, c("video_frame")), ignorenulls=True).over(lags.window.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumns({"frac_approach_tau": trailing(F.avg, c("approaching"), c("kf"), lags.values, lags.window, 2), "t_since_contact": (c("video_frame") - contact) / c("fps")})
    return t.select(*ids, *PAIR_FEATURES)


def mouse_tracks(dt: DataFrame) -> DataFrame:
    """Each mouse's own track, from the pairs it takes part in; its rows as agent come first."""
    parts = [x[3:] for x in dt.columns if x.startswith(("ag_x_", "ag_y_"))]

    def of(role: str, me: str, other: str, first: int) -> DataFrame:
        return dt.select("aug", "video_id", F.col(me).alias("mouse_id"), "video_frame", *[F.col(f"{role}_{p}").alias(p) for p in parts], F.lit(first).alias("__first"), F.col(other).alias("__other"))

    both = of("ag", "agent_id", "target_id", 0).unionByName(of("tg", "target_id", "agent_id", 1))
    w = ordered([*MOUSE_TRACK, "video_frame"], ["__first", "__other"])
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__first", "__other")


def mouse_kinematics(tracks: DataFrame, meta: DataFrame, *, lag_sec: float, norm_by: str | None = None, values: Sequence[int] | None = None) -> DataFrame:
    """The 13 features of a mouse's own track (columns x_/y_ of its parts)."""
    c = F.col
    t = body_geometry(tracks, "").withColumn("ref", reference_length(norm_by, "body_len", MOUSE_TRACK))
    t = t.select(*MOUSE_TRACK, "video_frame", c("x_center").alias("ox"), c("y_center").alias("oy"), c("unit_x").alias("ux"), c("unit_y").alias("uy"), "ref", c("body_len").alias("mouse_body_len"), ear_gap(t.columns, c("ref")).alias("ear_gap"))
    lags = Lags(t, meta, lag_sec, MOUSE_TRACK, values)
    lags.masks()
    t = lags.table.withColumns({"dx": lags.delta(c("ox")), "dy": lags.delta(c("oy")), "turn_agent": lags.rate(F.atan2("uy", "ux"), angle=True)})
    along = agent_frame(c("dx"), c("dy"), c("ux"), c("uy"))
    body = c("fps") / c("kf") / safe_max(c("ref"), 1e-9)
    t = t.withColumns({"v_forward": along[0] * body, "v_lateral": along[1] * body})
    bend = c("dx") * lags.delta(c("dy"), "ok2") - c("dy") * lags.delta(c("dx"), "ok2")
    t = t.withColumns(
        {
            "speed_total": hypot(c("v_forward"), c("v_lateral")),
            "a_forward": lags.rate(c("v_forward"), "ok2"),
            "a_lateral": lags.rate(c("v_lateral"), "ok2"),
            "curvature": F.abs(bend) / safe_max(F.pow(c("dx") * c("dx") + c("dy") * c("dy"), F.lit(1.5)), 1e-6) * c("ref"),
            "lat_ratio": F.abs("v_lateral") / safe_max(F.abs("v_forward"), 1e-6),
        }
    )
    half = F.floor(c("kf") * 3 / 2).cast("int")
    halves = sorted({v * 3 // 2 for v in lags.values})
    mean = lambda x: centred(F.avg, x, half, halves, lags.window)
    t = t.withColumns(
        {
            "whole": centred(F.sum, c("ok1").cast("int"), half, halves, lags.window) == 2 * half + 1,
            "forward_mean": mean(c("v_forward")),
            "turn_mean": mean(c("turn_agent")),
            "lat_ratio_mean": mean(c("lat_ratio")),
            "speed_mean": mean(c("speed_total")),
        }
    )
    # mean absolute deviation from the rolling mean, scaled to a normal's standard deviation (fixed value)
    spread = lambda x, m: 1.253314 * mean(F.abs(x - m))
    t = t.withColumns({"forward_sd": spread(c("v_forward"), c("forward_mean")), "turn_sd": spread(c("turn_agent"), c("turn_mean"))})
    valid = {"turn_smoothness": c("turn_sd"), "forward_consistency": c("forward_mean") / (c("forward_sd") + 1e-6), "lat_ratio_med": c("lat_ratio_mean"), "speed_med": c("speed_mean")}
    t = t.withColumns({n: F.when(c("whole"), x) for n, x in valid.items()})
    return t.select(*MOUSE_TRACK, "video_frame", *MOUSE_FEATURES)


def single_mouse(dt: DataFrame, meta: DataFrame, *, lag_sec: float, norm_by: str | None = None, values: Sequence[int] | None = None) -> DataFrame:
    """Kinematics of agent (ag_) and target (tg_), computed once per mouse, written, and joined twice."""
    dt = materialise(dt, "pair-rows")
    ids = [*PAIR_TRACK, "video_frame", *(["action"] if "action" in dt.columns else [])]
    own = mouse_kinematics(mouse_tracks(dt), meta, lag_sec=lag_sec, norm_by=norm_by, values=values)
    return join_mouse_features(dt.select(*ids), materialise(own, "mouse-features"))


def join_mouse_features(out: DataFrame, own: DataFrame) -> DataFrame:
    """``out`` with its agent's and its target's rows of ``own``."""
    ids = [f"`{x}`" for x in out.columns]
    for role, me in (("ag", "agent_id"), ("tg", "target_id")):
        named = own.select("aug", "video_id", F.col("mouse_id").alias(me), "video_frame", *[F.col(f).alias(f"{role}_{f}") for f in MOUSE_FEATURES])
        out = out.join(named, ["aug", "video_id", me, "video_frame"], "left")
    return out.select(*ids, *[f"{r}_{f}" for r in ("ag", "tg") for f in MOUSE_FEATURES])


def lag_window_stats(dt: DataFrame, meta: DataFrame, columns: Sequence[str], *, lag_sec: float, by: Sequence[str] = PAIR_TRACK, num_windows: int = 3, values: Sequence[int] | None = None) -> DataFrame:
    """``{column}_lagw{n}_mean``: trailing means over one lag, and the same one and two lags earlier.

    Masked by ok1, ok2 and ok3; further windows are not masked.
    """
    lags = Lags(dt, meta, lag_sec, by, values)
    lags.masks()
    there = [x for x in columns if x in dt.columns]
    t = lags.table.withColumns({f"__{x}": trailing(F.avg, F.col(x), lags.k, lags.values, lags.window) for x in there})
    out = {}
    for x in there:
        for n in range(1, num_windows + 1):
            value = F.col(f"__{x}") if n == 1 else lags.lag(F.col(f"__{x}"), n - 1)
            out[f"{x}_lagw{n}_mean"] = F.when(F.col(f"ok{n}"), value) if n <= 3 else value
    return t.withColumns(out).select(*[F.col(f"`{x}`") for x in dt.columns], *out)
