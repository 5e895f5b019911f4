"""Preparation of raw pairs over frames: gates, one timeline, robot and human features, measures.

A pair is one row of arrays. Gates on raw values are expressions over that row. Its timeline, its resampled frames, what is taken over a whole sequence (floors, anchor, smoothed facing, bones) and
what the measures need of each frame are NumPy over batches of pairs, in slices of a bounded number of frames. For features, frames are rows, each with the frames beside it, so velocities need no
window, and what is computed of one frame is NumPy over batches of frames of any samples. Measures are aggregates by sample whose partial sums are made where the frames are: one row a sample is
shuffled, and no frame is. `frames` gives the features in the long layout that sources.corpus.write takes.

pairs: sample_id (unique), human (flat, 22 joints), human_fps, root, rotation (x, y, z, w), dof, robot_fps, all z-up; optional bodies (flat) and body_names give tracks of robot
bodies, of which the ankles are used in place of forward kinematics; a row with an optional reason was rejected before and keeps it. Null arrays break the shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow import constants as C
from strideflow.functions import geometry as G
from strideflow.functions import kernels as K
from strideflow.operators import quality, timeline
from strideflow.sources.shared import scratch

ANKLES = ("left_ankle_roll_link", "right_ankle_roll_link")
JOINTS = len(K.REST_DIRECTIONS)
#: Parent of each human joint; bones (by their lower joint) of both legs and of the spine, which make up the stature.
PARENTS = [0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 12, 13, 14, 16, 17, 18, 19]
LEGS, SPINE = ([1, 4, 7], [2, 5, 8]), [3, 6, 9, 12, 15]
MEASURES = [
    "max_joint_speed", "max_root_speed", "max_angular_speed", "max_dof_speed", "energy_correlation", "floor_y", "foot_penetration", "near_floor_slide", "quaternion_norm_error",
]


def _at(values: Column, k: int | Column, width: int | Column) -> Column:
    """Row k of a flat array."""
    return F.slice(values, (F.lit(k) * width + 1).cast("int"), width)


def _each(n: Column, make: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), make)


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def quantile(values: Column, q: float) -> Column:
    """A percentile of an array with linear interpolation; null for an empty one."""
    place = lambda s: F.lit(q) * (F.size(s) - 1)
    low = lambda s: F.get(s, F.floor(place(s)).cast("int"))
    high = lambda s: F.coalesce(F.get(s, F.floor(place(s)).cast("int") + 1), low(s))
    return G.let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, low(s) + (high(s) - low(s)) * (place(s) - F.floor(place(s)))))


# ---- batches of frames


def _values(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A column of numbers, or of arrays of one width as (rows, width); NaN for nulls."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).astype(float)
    some = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = width or (len(flat) // max(some.sum(), 1))
    out = np.full((len(column), width), np.nan)
    if width:  # none where every row is null
        out[some] = flat.reshape(-1, width)
    return out


def _nullable(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The inverse: NaN becomes null."""
    flat = pa.array(values.ravel(), mask=np.isnan(values.ravel())).cast(kind)
    return flat if values.ndim == 1 else pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], flat)


def _by_frame(frames: DataFrame, columns: dict[str, Column], keep: list[str], run: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray | pa.Array]], schema: str) -> DataFrame:
    """keep and the columns of schema, which run makes of the given columns of a batch of frames."""
    names = [*columns]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            with np.errstate(invalid="ignore", divide="ignore"):
                made = run({k: _values(batch.column(f"_{k}")) for k in names})
            arrays = {k: v if isinstance(v, pa.Array) else _nullable(v, pa.float32() if v.dtype == np.float32 else pa.float64()) for k, v in made.items()}
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *arrays.values()], [*keep, *arrays])

    given = frames.select(*keep, *[c.alias(f"_{k}") for k, c in columns.items()])
    return given.mapInArrow(batches, ", ".join([*(f"{k} {given.schema[k].dataType.simpleString()}" for k in keep), schema]))


def _points(flat: np.ndarray) -> np.ndarray:
    return flat.reshape(len(flat), flat.shape[1] // 3, 3)


def _norm(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(-1))


# ---- gates on whole rows


def checked(pairs: DataFrame, limits: list[tuple[float, float]]) -> DataFrame:
    """Adds frames_a, frames_b, common_end, points, quaternion_norm_error, early and late: the first reason before and after the gates on the human skeleton."""
    n = len(limits)
    for name, kind in (("bodies", "array<double>"), ("body_names", "array<string>"), ("reason", "string")):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, F.lit(None).cast(kind))
    of = lambda c, width: F.coalesce(F.when(F.size(c) % width == 0, F.size(c) / width), F.lit(-1)).cast("long")
    rows = pairs.withColumns({"frames_a": of("human", 3 * JOINTS), "frames_b": of("dof", n), "robot_fps": F.col("robot_fps").cast("double"), "human_fps": F.col("human_fps").cast("double")})
    whole = (F.col("frames_a") > 0) & (F.col("frames_b") > 0) & (of("root", 3) == F.col("frames_b")) & (of("rotation", 4) == F.col("frames_b"))
    sound = F.forall(F.array("human", "root", "rotation", "dof"), lambda a: F.forall(a, quality.finite))
    norms = _each(F.col("frames_b"), lambda k: F.abs(F.sqrt(F.aggregate(_at(F.col("rotation"), k, 4), F.lit(0.0), lambda s, x: s + x * x)) - 1))
    low, high = _literal([a for a, _ in limits]), _literal([b for _, b in limits])
    over = F.transform("dof", lambda x, i: F.greatest(F.get(low, i % n) - x, x - F.get(high, i % n)))
    rows = rows.withColumn("shape", F.coalesce("reason", F.when(F.coalesce(F.size("dof") % n != 0, F.lit(True)), "g1_dof_shape_or_finite"), F.when(~whole, "source_shape")))
    rows = rows.withColumn("finite", F.when(F.col("shape").isNull(), F.coalesce(sound, F.lit(False))).otherwise(F.lit(False)))
    rows = rows.withColumns({"quaternion_norm_error": F.when(F.col("finite"), F.array_max(norms)), "dof_violation": F.when(F.col("finite"), F.greatest(F.array_max(over), F.lit(0.0)))})
    first = F.coalesce("shape", quality.first_failure(quality.raw_gates()[:3]))
    stands = ~F.coalesce((F.col("human_fps") > 0) & (F.col("robot_fps") > 0) & quality.finite(F.col("human_fps")) & quality.finite(F.col("robot_fps")), F.lit(False))
    rows = rows.withColumn("early", first).withColumns({f"fps_{side}": F.when(stands, 1.0).otherwise(F.col(name)) for side, name in (("a", "human_fps"), ("b", "robot_fps"))})
    rows = timeline.common_timeline(rows.drop("reason"), C.TARGET_FPS).withColumnRenamed("reason", "timeline_reason")
    lost = F.col("bodies").isNotNull() & F.col("body_names").isNotNull() & ~F.coalesce(F.size(F.array_intersect("body_names", F.array(*map(F.lit, ANKLES)))) == len(ANKLES), F.lit(False))
    late = F.coalesce(F.when(stands, "timeline_shape"), F.col("timeline_reason"), F.when(lost, "g1_body_order"))
    return rows.withColumn("late", late).drop("shape", "finite", "dof_violation", "timeline_reason", "duration_error", "tolerance")


def _slices(batch: pa.RecordBatch, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most SLICE_POINTS frames, of which each row has n; a longer row is alone."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        stop = max(int(np.searchsorted(ends, SLICE_POINTS + (ends[at - 1] if at else 0), "right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def skeleton_measures(rows: DataFrame) -> DataFrame:
    """(sample_id, stature, bone_cv, raw_joint_speed) of raw human frames: sample_id, human, human_fps. Bones whose mean length is next to nothing do not count; a row without whole frames is left out."""
    n = F.when(F.size("human") % (3 * JOINTS) == 0, F.size("human") / (3 * JOINTS)).cast("long")
    given = rows.select("sample_id", "human", F.col("human_fps").cast("double").alias("human_fps"), n.alias("n")).where("n > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in _slices(batch, batch.column("n").to_numpy().astype(np.int64))):
            p = Pairs(part)
            human = _points(p.flat("human")[0].reshape(-1, 3 * JOINTS))
            lengths = _norm(human[:, 1:] - human[:, PARENTS[1:]])
            mean = np.add.reduceat(lengths, p.start) / p.n[:, None]
            std = np.sqrt(np.add.reduceat((lengths - mean[p.owner]) ** 2, p.start) / p.n[:, None])
            bone = lambda bones: lengths[:, np.array(bones) - 1].sum(1)
            stature = _percentiles((bone(LEGS[0]) + bone(LEGS[1])) / 2 + bone(SPINE), p.owner, p.start, p.n, 0.5)
            with np.errstate(invalid="ignore", divide="ignore"):
                varied = np.where(mean > C.STILL_STD, std / mean, -1.0).max(1)
            speed = np.concatenate([[0.0], _norm(human[1:] - human[:-1]).max(1)]) * np.where(p.k > 0, p.numbers("human_fps")[p.owner], 0.0)
            found = [stature, np.where(varied < 0, np.nan, varied), np.maximum.reduceat(speed, p.start)]
            yield pa.RecordBatch.from_arrays([part.column("sample_id"), *(_nullable(x, pa.float64()) for x in found)], ["sample_id", "stature", "bone_cv", "raw_joint_speed"])

    return given.mapInArrow(run, f"sample_id {given.schema['sample_id'].dataType.simpleString()}, stature double, bone_cv double, raw_joint_speed double")


# ---- one timeline


def body_path(tree: K.BodyTree, name: str) -> Column:
    """The bodies from below the root to one of them, as an array of structs."""
    steps, k = [], tree.names.index(name)
    while k > 0:
        turn = K.quaternions(np.asarray(tree.rotations[k])[None])[0]
        steps.append(F.struct(_literal(tree.offsets[k]).alias("offset"), _literal(turn).alias("turn"), F.lit(int(tree.joints[k])).alias("joint"), _literal(tree.axes[k]).alias("axis")))
        k = tree.parents[k]
    return F.array(*reversed(steps))


def body_position(path: Column, root: Column, rotation: Column, dof: Column) -> Column:
    """Where the last body of a path is: a fold over it that carries a position and a rotation. A body whose joint is negative has none."""

    def step(state: Column, body: Column) -> Column:
        offset = G.let(F.struct(state["q"].alias("q"), body["offset"].alias("v")), lambda s: _rotated(s["q"], s["v"]))
        half = F.coalesce(F.when(body["joint"] >= 0, F.get(dof, body["joint"])), F.lit(0.0)) / 2
        bent = G.let(F.struct(F.sin(half).alias("s"), F.cos(half).alias("c")), lambda h: F.array(*[h["s"] * F.get(body["axis"], F.lit(i)) for i in range(3)], h["c"]))
        turned = _times(_times(state["q"], body["turn"]), bent)
        return F.struct(F.zip_with(state["p"], offset, lambda a, b: a + b).alias("p"), turned.alias("q"))

    return F.aggregate(path, F.struct(root.alias("p"), rotation.alias("q")), step)["p"]


def _items(a: Column, n: int) -> list[Column]:
    return [F.get(a, F.lit(i)) for i in range(n)]


def _times(a: Column, b: Column) -> Column:
    """Quaternion product of two arrays, each computed once."""
    return G.let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.array(*G.product(_items(s["a"], 4), _items(s["b"], 4))))


def _rotated(q: Column, v: Column) -> Column:
    """v turned by q, with what both terms need computed once."""
    t = F.array(*[2 * x for x in G.cross(_items(q, 3), _items(v, 3))])
    return G.let(t, lambda t: F.array(*[x + F.get(q, F.lit(3)) * y + z for x, y, z in zip(_items(v, 3), _items(t, 3), G.cross(_items(q, 3), _items(t, 3)), strict=True)]))


class Pairs:
    """The pairs of a batch, each array column as one flat array, and the grid points of all pairs one after another: owner, and k, the point's number in its pair."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.n = self.numbers("n").astype(np.int64)
        self.owner, self.end = np.repeat(np.arange(len(self.n)), self.n), np.cumsum(self.n)
        self.start = self.end - self.n
        self.k = np.arange(len(self.owner)) - self.start[self.owner]
        self.some = np.flatnonzero(self.n)

    def numbers(self, name: str) -> np.ndarray:
        return np.nan_to_num(_values(self.batch.column(name)))

    def bracket(self, fps: str, frames: str) -> tuple[np.ndarray, np.ndarray]:
        """The source frame at or before each grid point that has another after it, and how far between the two the point is."""
        place = self.k / C.TARGET_FPS * self.numbers(fps)[self.owner]
        left = np.maximum(np.minimum(np.floor(place), self.numbers(frames)[self.owner] - 2), 0)
        return left.astype(np.int64), np.minimum(place - left, 1.0)[:, None]

    def flat(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """All values, and where those of each grid point's pair begin."""
        column = self.batch.column(name)
        length = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
        return column.flatten().to_numpy(zero_copy_only=False).astype(float), (np.cumsum(length) - length)[self.owner]

    def ends(self, name: str, width: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The frames on both sides of each grid point."""
        values, first = self.flat(name)
        rows = values.reshape(-1, width)
        return rows[first // width + left], rows[first // width + left + 1]

    def lists(self, values: pa.Array) -> pa.Array:
        """What stands at the grid points as a list for each pair; null where a pair has none."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], self.end]).astype(np.int32)), values, mask=pa.array(self.n == 0))

    def whole(self, values: np.ndarray) -> np.ndarray:
        """Values of the pairs with grid points, and NaN for the others."""
        out = np.full((len(self.n), *values.shape[1:]), np.nan)
        out[self.some] = values
        return out


def _percentiles(values: np.ndarray, owner: np.ndarray, start: np.ndarray, size: np.ndarray, q: float) -> np.ndarray:
    """A percentile with linear interpolation of each owner's values, which begin at start."""
    values = values[np.lexsort((values, owner))]
    place = q * (size - 1)
    low = np.floor(place).astype(np.int64)
    below, above = values[start + low], values[start + np.minimum(low + 1, size - 1)]
    return below + (above - below) * (place - low)


def _mixed(ends: tuple[np.ndarray, np.ndarray], share: np.ndarray) -> np.ndarray:
    return ends[0] + (ends[1] - ends[0]) * share


def _arc_mixed(ends: tuple[np.ndarray, np.ndarray], share: np.ndarray) -> np.ndarray:
    """Along the shorter arc between two rotations; linear where the arc is tiny; of length 1."""
    a, b = (q / _norm(q)[:, None] for q in ends)
    d = (a * b).sum(1, keepdims=True)
    angle = np.arccos(np.minimum(np.abs(d), 1.0))
    sine = np.sin(angle)
    tiny = sine < 1e-8
    u, v = (np.where(tiny, x, np.sin(x * angle) / np.where(tiny, 1.0, sine)) for x in (1 - share, share))
    mixed = a * u + b * v * np.where(d < 0, -1.0, 1.0)
    return mixed / _norm(mixed)[:, None]


def _y_up(flat: np.ndarray) -> np.ndarray:
    """z-up points, or the vector part of rotations, to y-up: (x, y, z) becomes (x, z, -y)."""
    p = _points(flat)
    return np.stack([p[..., 0], p[..., 2], -p[..., 1]], -1).reshape(flat.shape)


def _list_of(values: np.ndarray) -> pa.Array:
    """Rows of arrays of one width; NaN becomes null."""
    return _nullable(values, pa.float64())


def _align(p: Pairs, tree: K.BodyTree, dof: int) -> dict[str, pa.Array]:
    """The columns that `aligned` adds, for the pairs of a batch."""
    (left, share), (at, part) = p.bracket("human_fps", "frames_a"), p.bracket("robot_fps", "frames_b")
    human = _y_up(_mixed(p.ends("human", 3 * JOINTS, left), share))
    raw, q, joints = _mixed(p.ends("root", 3, at), part), _arc_mixed(p.ends("rotation", 4, at), part), _mixed(p.ends("dof", dof, at), part)
    feet = np.empty((len(p.owner), 2, 3))
    wide = p.numbers("wide").astype(np.int64)[p.owner]
    own, tracked = wide == 0, np.flatnonzero(wide)
    places = tree.positions(raw[own], q[own], joints[own], ANKLES)
    values, first = p.flat("bodies")
    for side, name in enumerate(ANKLES):
        feet[own, side] = places[name]
        body = (p.numbers(f"place{side}").astype(np.int64)[p.owner] - 1)[tracked]
        ends = tuple(values[(first[tracked] + ((at[tracked] + e) * wide[tracked] + body) * 3)[:, None] + np.arange(3)] for e in (0, 1))
        feet[tracked, side] = _mixed(ends, part[tracked])
    root, q, feet = _y_up(raw), np.concatenate([_y_up(q[:, :3]), q[:, 3:]], 1), _y_up(feet.reshape(-1, 6))
    starts = p.start[p.some]

    floor = p.whole(_percentiles(feet[:, [1, 4]].ravel(), np.repeat(p.owner, 2), 2 * starts, 2 * p.n[p.some], C.FLOOR_PERCENTILE))  # of the heights of both feet

    joint = lambda j: human[:, 3 * j : 3 * j + 3]
    across = joint(K.LEFT_HIP) - joint(K.RIGHT_HIP) + joint(K.RIGHT_SHOULDER) - joint(K.LEFT_SHOULDER)
    across = np.stack([across[:, 2], -across[:, 0]], 1) / np.where(_norm(across) > 0, _norm(across), np.nan)[:, None]
    hips = (joint(K.RIGHT_HIP) - joint(K.LEFT_HIP))[starts]
    level = np.hypot(hips[:, 0], hips[:, 2])
    ahead = np.stack([hips[:, 2], -hips[:, 0]], 1) / np.where(level > 0, level, np.nan)[:, None]
    x, _, z = K.matrices(q[starts])[..., 0].T
    level, zero = np.hypot(x, z), np.zeros(len(starts))
    x, z = (v / np.where(level > 1e-8, level, np.nan) for v in (x, z))
    basis = np.stack([z, zero, -x, zero, zero + 1, zero, x, zero, z], 1)
    basis[np.isnan(x)] = np.nan

    before = lambda v: np.where((p.k > 0)[:, None], np.roll(v, 1, 0), np.nan)
    sides = {"root": root, "q": q, "dof": joints, "feet": feet}
    measures = frame_measures(sides | {f"{k}0": before(v) for k, v in sides.items()} | {"human": human, "human0": before(human), "floor_y": floor[p.owner]})
    struct = lambda columns: pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else _list_of(v) for v in columns.values()], [*columns])
    column = lambda v: pa.array(np.full(len(p.n), None), pa.list_(pa.float64())) if not len(p.some) else _where(_list_of(v), np.isnan(v).all(1))
    smooth = _smoothed(across, p)
    return {
        "grid": p.lists(struct({"human": human, "robot": struct(sides)})), "floor_y": _nullable(floor, pa.float64()), "ground_y": _nullable(p.whole(np.minimum.reduceat(human[:, 1::3].min(1), starts) if len(starts) else zero), pa.float64()),
        "origin": column(p.whole(root[starts] * (1, 0, 1))), "basis": column(p.whole(basis)), "ahead": column(p.whole(ahead)), "start": column(p.whole(human[starts][:, [0, 2]])),
        "faces": p.lists(struct({"x": smooth[:, 0], "z": smooth[:, 1]})), "steps": p.lists(struct(measures)),
    }


def _where(lists: pa.Array, null: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(null), pa.scalar(None, lists.type), lists)


def _smoothed(values: np.ndarray, p: Pairs, sigma: float = K.SMOOTHING) -> np.ndarray:
    """Gaussian filter along each pair to four deviations; the ends are repeated."""
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights, first, last, out = weights / weights.sum(), p.start[p.owner], p.n[p.owner] - 1, np.zeros(values.shape)
    for j, w in zip(range(-radius, radius + 1), weights, strict=True):
        out += w * values[first + np.clip(p.k + j, 0, last)]
    return out


_VECTOR = "array<double>"
_ROBOT = f"struct<root: {_VECTOR}, q: {_VECTOR}, dof: {_VECTOR}, feet: {_VECTOR}>"
STEPS = "joints double, root double, angle double, dof double, near array<double>, low double, x double, y double"
SLICE_POINTS = 1 << 15  # grid points that are aligned at once; a longer sequence is alone


def aligned(rows: DataFrame, tree: K.BodyTree, dof: int) -> DataFrame:
    """(sample_id, early, late, quaternion_norm_error, grid, floor_y, ground_y, origin, basis, ahead, start, faces, steps): frames at 20 a second, y-up, in one array; null where early or late is set.

    floor_y: of the feet; ground_y: the lowest joint; origin and basis: the robot's anchor; ahead: where the human faces in the first frame; start: its root there;
    faces: smoothed facing (x, z) of each frame; steps: what `frame_measures` gives of each frame. Pairs are aligned many at a time in NumPy, in slices of batches of bounded numbers of points.
    """
    c, keep = F.col, ["sample_id", "early", "late", "quaternion_norm_error"]
    [tree.names.index(name) for name in ANKLES]  # both have to be there
    good = c("early").isNull() & c("late").isNull()
    tracked = c("bodies").isNotNull() & c("body_names").isNotNull()
    given = rows.select(
        *keep, F.when(good, c("points")).otherwise(0).alias("n"), *[F.when(good, c(k).cast("double")).alias(k) for k in ("human_fps", "robot_fps", "frames_a", "frames_b")],
        *[F.when(good, c(k)).alias(k) for k in ("human", "root", "rotation", "dof")], F.when(good & tracked, c("bodies")).alias("bodies"), F.when(good & tracked, F.size("body_names")).otherwise(0).alias("wide"),
        *[F.when(good & tracked, F.array_position("body_names", name)).alias(f"place{side}") for side, name in enumerate(ANKLES)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, batch.column("n").to_numpy().astype(np.int64)):
                with np.errstate(invalid="ignore", divide="ignore"):
                    made = _align(Pairs(part), tree, dof)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *made.values()], [*keep, *made])

    schema = f"early string, late string, quaternion_norm_error double, grid array<struct<human: {_VECTOR}, robot: {_ROBOT}>>, floor_y double, ground_y double, origin {_VECTOR}, basis {_VECTOR}, ahead {_VECTOR}, start {_VECTOR}, "
    steps = ", ".join(": ".join(x.split(" ", 1)) for x in STEPS.split(", "))
    return given.mapInArrow(run, f"sample_id {given.schema['sample_id'].dataType.simpleString()}, {schema}faces array<struct<x: double, z: double>>, steps array<struct<{steps}>>")


# ---- frames


def beside(rows: DataFrame) -> DataFrame:
    """One row for each frame: t, now and before (null on the first), and a and b, the human frames whose difference is its displacement, which the last frame repeats."""
    last = F.size("grid") - 1
    step = lambda i, k: F.get("grid", F.greatest(F.least(i, last - 1), F.lit(0)) + k)["human"]
    one = lambda f, i: F.struct(
        i.cast("long").alias("t"), f.alias("now"), F.when(i > 0, F.get("grid", i - 1)["robot"]).alias("before"), F.when(i > 0, F.get("grid", i - 1)["human"]).alias("human_before"),
        step(i, 0).alias("a"), step(i, 1).alias("b"), F.get("faces", i).alias("face"),
    )
    return rows.select("sample_id", "floor_y", "ground_y", "origin", "basis", "ahead", "start", F.explode(F.transform("grid", one)).alias("f")).select("*", "f.*").drop("f")


def frame_measures(c: dict[str, np.ndarray]) -> dict[str, np.ndarray | pa.Array]:
    """What the measures need of each frame (STEPS), of both sides there and in the frame before (a 0 in the name; NaN on the first) and floor_y."""
    fps = float(C.TARGET_FPS)
    some = ~np.isnan(c["root0"][:, :1]).all(1) if c["root0"].shape[1] else np.zeros(len(c["root"]), bool)
    c = c | {k: c[k[:-1]] if not c[k].shape[1] else c[k] for k in ("human0", "root0", "q0", "dof0", "feet0")}  # a batch of first frames alone
    joints, dof, feet, own = _norm(_points(c["human"]) - _points(c["human0"])) * fps, np.abs(c["dof"] - c["dof0"]) * fps, _points(c["feet"]), np.where(some, 1.0, np.nan)
    slide = np.hypot(*np.moveaxis((feet - _points(c["feet0"]))[..., [0, 2]], -1, 0)) * fps
    near = (feet[..., 1] - c["floor_y"][:, None] <= C.NEAR_FLOOR_M) & some[:, None]
    angle = 2 * np.arccos(np.minimum(np.abs((c["q"] * c["q0"]).sum(1)), 1.0)) * fps
    first = np.concatenate([[0], np.cumsum(near.sum(1))]).astype(np.int32)
    return {
        "joints": joints.max(1) * own, "root": _norm(c["root"] - c["root0"]) * fps * own, "angle": angle * own, "dof": dof.max(1) * own, "near": pa.ListArray.from_arrays(first, pa.array(slide[near])),
        "low": feet[..., 1].min(1), "x": joints.mean(1) * own, "y": dof.mean(1) * own,
    }


def aligned_measures(frames: DataFrame) -> DataFrame:
    """The measures of frames of `beside`, as `measured` gives them."""
    c = F.col
    sides = {f"{k}{n}": c(f"{side}.{k}") for side, n in (("now.robot", ""), ("before", 0)) for k in ("root", "q", "dof", "feet")}
    given = sides | {"human": c("now.human"), "human0": c("human_before"), "floor_y": c("floor_y")}
    return measured(_by_frame(frames, given, ["sample_id", "floor_y", "origin", "basis", "ahead"], frame_measures, STEPS))


def measured(f: DataFrame) -> DataFrame:
    """(sample_id, points, the measures but for quaternion_norm_error, undefined, origin, basis) of rows of STEPS, one a frame, beside sample_id, floor_y, origin, basis and ahead: undefined is the reason of frames without features."""
    c = F.col
    largest = lambda x: F.coalesce(F.max(x), F.lit(0.0))
    undefined = F.coalesce(F.when(F.bool_or(c("basis").isNull()), "g1_root_upright"), F.when(F.bool_or(c("ahead").isNull()), "human_hip_direction"))
    return f.groupBy("sample_id").agg(
        F.count("*").alias("points"), largest("joints").alias("max_joint_speed"), largest("root").alias("max_root_speed"), largest("angle").alias("max_angular_speed"), largest("dof").alias("max_dof_speed"),
        F.coalesce(quality.guarded_corr("x", "y"), F.lit(1.0)).alias("energy_correlation"), F.min("floor_y").alias("floor_y"), F.greatest(F.lit(0.0), -F.min("low")).alias("foot_penetration"),
        F.coalesce(quantile(F.flatten(F.collect_list("near")), 0.95), F.lit(0.0)).alias("near_floor_slide"), undefined.alias("undefined"),
        F.any_value("origin").alias("origin"), F.any_value("basis").alias("basis"),
    )


def robot_features(c: dict[str, np.ndarray]) -> np.ndarray:
    """(75) of frames of `beside`: position, rotation columns and joints in the anchored frame, causal velocities in the axes of the frame before (zero on the first), contacts."""
    fps, some = float(C.TARGET_FPS), ~np.isnan(c["root0"][:, :1]) if c["root0"].shape[1] else np.zeros((len(c["root"]), 1), bool)
    before = {k: np.where(some, c[f"{k}0"], c[k]) if c[f"{k}0"].shape[1] else c[k] for k in ("root", "q", "dof", "feet")}  # a first frame has moved from where it is
    basis, feet = c["basis"].reshape(-1, 3, 3), _points(c["feet"])
    wxyz = lambda q: np.concatenate([q[:, 3:], q[:, :3]], 1)
    local = (basis @ (c["root"] - c["origin"] * (1, 0, 1))[..., None])[..., 0]
    turned = np.swapaxes(basis @ K.matrices(c["q"])[..., :2], 1, 2).reshape(-1, 6)
    back = K.conjugate(wxyz(before["q"]))
    step = K.hamilton(back, wxyz(c["q"]))
    step = np.where(step[:, :1] < 0, -step, step)
    length = np.linalg.norm(step[:, 1:], axis=1, keepdims=True)
    angular = step[:, 1:] * np.where(length < 1e-12, 2.0, 2 * np.arctan2(length, step[:, :1]) / np.where(length < 1e-12, 1.0, length)) * fps
    speed = _norm(feet - _points(before["feet"])) * fps
    contact = (feet[..., 1] - c["floor_y"][:, None] <= C.CONTACT_HEIGHT_M) & (speed <= C.CONTACT_SPEED_M_S)
    linear = K.turn(back, (c["root"] - before["root"]) * fps)
    return np.concatenate([local, turned, c["dof"], np.where(some, linear, 0.0), np.where(some, angular, 0.0), (c["dof"] - before["dof"]) * fps, contact], 1).astype(np.float32)


def human_features(c: dict[str, np.ndarray], threshold: float) -> np.ndarray:
    """(262) of frames of `beside`: positions on the floor with the first root over the origin and facing +z, displacement to the next frame, rotations of 21 joints, contacts of four foot joints.

    The facing mixes hips with shoulders and is smoothed; the first frame is not turned. The rotation of a bone in the world is the shortest turn from its rest direction; along a chain each is taken relative to the one before it, and at the chain's start to the
    facing. A bone that points exactly against its rest direction has NaN.
    """
    (fx, fz), (x0, z0), ground = c["ahead"].T[..., None], c["start"].T[..., None], c["ground_y"][:, None]

    def placed(flat: np.ndarray) -> np.ndarray:
        """Joints moved to the floor and the origin and turned about the vertical."""
        x, y, z = np.moveaxis(_points(flat), -1, 0)
        return np.stack([fz * (x - x0) - fx * (z - z0), y - ground, fx * (x - x0) + fz * (z - z0)], -1)

    p, step = placed(c["human"]), placed(c["b"]) - placed(c["a"])
    (sx, sz), zero = c["face"].T, np.zeros(len(p))
    facing = K.arc(np.stack([fz[:, 0] * sx - fx[:, 0] * sz, zero, fx[:, 0] * sx + fz[:, 0] * sz], 1), np.array([0.0, 0.0, 1.0]) + np.zeros((len(p), 3)))
    facing[c["t"] == 0] = (1, 0, 0, 0)
    before = {child: parent or 0 for chain in K.CHAINS for parent, child in zip((None, *chain[1:-1]), chain[1:], strict=True)}
    above = {child: parent for chain in K.CHAINS for parent, child in zip(chain[:-1], chain[1:], strict=True)}
    rest = np.broadcast_to(np.array(K.REST_DIRECTIONS[1:], float), (len(p), JOINTS - 1, 3))
    world = np.concatenate([facing[:, None], K.arc(rest, p[:, 1:] - p[:, [above[j] for j in range(1, JOINTS)]])], 1)
    local = K.hamilton(K.conjugate(world[:, [before[j] for j in range(1, JOINTS)]]), world[:, 1:])
    still = (step[:, K.FEET] ** 2).sum(-1) < threshold
    return np.concatenate([a.reshape(len(p), -1) for a in (p, step, K.rotation_columns(local), still)], 1).astype(np.float32)


def features(frames: DataFrame, threshold: float = 0.002) -> DataFrame:
    """(sample_id, t, human array<float> (262), robot array<float> (75)) of frames of `beside` that have a basis and a way ahead; what is undefined is null."""
    c = F.col
    sides = {f"{k}{n}": c(f"{side}.{k}") for side, n in (("now.robot", ""), ("before", 0)) for k in ("root", "q", "dof", "feet")}
    own = {"human": c("now.human"), "a": c("a"), "b": c("b"), "face": F.array("face.x", "face.z"), "t": c("t")} | {k: c(k) for k in ("ground_y", "floor_y", "ahead", "start", "origin", "basis")}
    return _by_frame(frames, own | sides, ["sample_id", "t"], lambda v: {"human": human_features(v, threshold), "robot": robot_features(v)}, "human array<float>, robot array<float>")


# ---- the job


def prepare(pairs: DataFrame, limits: list[tuple[float, float]], tree: K.BodyTree) -> tuple[DataFrame, DataFrame]:
    """(records, frames). records: sample_id, reason, detail (the measure that a gate refused), frames, MEASURES, origin, basis; one row a pair, nulls where a pair was rejected.
    frames: sample_id, t, human array<float> (262), robot array<float> (75) of accepted pairs.

    The aligned sequences are written once to the shared folder, and both results read them. A body that is not in the tree, or in body_names, is no ankle: without tracks the tree has to have both.
    """
    spark, at = pairs.sparkSession, scratch(pairs.sparkSession, "tracks")
    aligned(checked(pairs, limits), tree, len(limits)).write.parquet(at)
    rows = spark.read.parquet(at)
    steps = rows.select("sample_id", "floor_y", "origin", "basis", "ahead", F.explode("steps").alias("s")).select("*", "s.*").drop("s")
    found = rows.select("sample_id", "early", "late", "quaternion_norm_error").join(skeleton_measures(pairs), "sample_id", "left").join(measured(steps), "sample_id", "left")
    raw = quality.first_failure([(reason, F.col("raw_joint_speed") > C.MAX_JOINT_SPEED_M_S) if reason == "human_joint_speed" else (reason, failed) for reason, failed in quality.raw_gates()[3:]])
    reason = F.coalesce("early", raw, "late", "undefined", quality.first_failure(quality.aligned_gates()))
    found = found.withColumn("reason", reason)
    accepted = F.col("reason").isNull()
    detail = F.coalesce(*[F.when(F.col("reason") == name, F.col("raw_joint_speed" if name == "human_joint_speed" else column)) for name, column, *_ in quality.BOUNDS if column in found.columns])
    basis = F.array(*[F.get("basis", F.lit(3 * (k % 3) + k // 3)) for k in range(9)])
    records = found.select(
        "sample_id", "reason", detail.alias("detail"), F.when(accepted, F.col("points")).alias("frames"), *[F.when(accepted, F.col(m)).alias(m) for m in MEASURES], F.when(accepted, F.col("origin")).alias("origin"), F.when(accepted, basis).alias("basis")
    )
    accepted = rows.join(records.where("reason IS NULL").select("sample_id"), "sample_id", "left_semi")
    return records, features(beside(accepted.where("basis IS NOT NULL AND ahead IS NOT NULL")))


def prepared_rows(records: DataFrame, frames: DataFrame) -> DataFrame:
    """One row a pair: the records with human_features and robot_features (flat) and the measures as a map named quality. A sequence has to fit in a row."""
    whole = frames.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("t", "human", "robot"))).alias("f"))
    whole = whole.select("sample_id", F.flatten("f.human").alias("human_features"), F.flatten("f.robot").alias("robot_features"))
    measures = F.when(F.col("reason").isNull(), F.create_map(*[c for m in MEASURES for c in (F.lit(m), F.col(m))])).alias("quality")
    return records.select("sample_id", "reason", "detail", F.coalesce("frames", F.lit(0)).cast("int").alias("frames"), measures, "origin", "basis").join(whole, "sample_id", "left")
