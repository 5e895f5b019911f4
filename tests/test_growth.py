"""What must not grow: expressions with the depth of a formula, memory and round trips with the input."""

import numpy as np
from pyspark.sql import functions as F

from strideflow.functions import geometry as G


def test_gram_schmidt_is_small_and_right(spark):
    six = G.matrix_to_6d(G.to_matrix(F.col("q")))
    assert len(str(G.matrix_from_6d(six))) < 100_000  # tens of millions of characters when steps are nested in each other
    rng = np.random.default_rng(0)
    r = rng.normal(size=(20, 6))
    rows = [(k, x.tolist()) for k, x in enumerate(r)] + [(20, [0.0] * 6), (21, [1.0, 2.0, 3.0, 2.0, 4.0, 6.0]), (22, None)]
    got = spark.createDataFrame(rows, "k int, r array<double>").select("k", G.matrix_from_6d(F.col("r")).alias("m")).orderBy("k").collect()
    x = r[:, :3] / np.linalg.norm(r[:, :3], axis=1, keepdims=True)
    z = np.cross(x, r[:, 3:])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    np.testing.assert_allclose([g.m for g in got[:20]], np.stack([x, np.cross(z, x), z], 2).reshape(20, 9), atol=1e-12)
    assert [g.m for g in got[20:]] == [None] * 3


def test_pairs_are_spread_over_tasks(spark, data):
    """Spark leaves a repartition by the window's own key out, and then merges the small rows of all pairs into one task."""
    from strideflow.plans import tracks as plans
    from strideflow.sources.shared import materialise

    files = materialise(plans.pairs(spark, data), "pairs").select(F.input_file_name()).distinct().count()
    assert files == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_undefined_turns_are_null_in_batches_of_first_frames(spark):
    """A batch may have first frames alone, without a frame before; a bone against its rest direction has no turn."""
    from strideflow.functions import kernels as K
    from strideflow.operators import tracks

    joints = np.zeros((22, 3))
    for chain in K.CHAINS:
        for a, b in zip(chain[:-1], chain[1:], strict=True):
            joints[b] = joints[a] + 0.3 * np.array(K.REST_DIRECTIONS[b]) * (-1 if b == 21 else 1)
    human = joints.ravel().tolist()
    robot = (([0.0, 0.8, 0.0]), [0.0, 0.0, 0.0, 1.0], [0.1] * 29, [0.0, 0.02, 0.1, 0.0, 0.02, -0.1])
    side = "struct<root array<double>, q array<double>, dof array<double>, feet array<double>>"
    schema = f"sample_id string, t long, now struct<human array<double>, robot {side}>, before {side}, human_before array<double>, a array<double>, b array<double>, face struct<x double, z double>, floor_y double, ground_y double, origin array<double>, basis array<double>, ahead array<double>, start array<double>"
    row = ("a", 0, (human, robot), None, None, human, human, (0.0, 1.0), 0.02, 0.0, [0.0] * 3, [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0], [0.0, 1.0], [0.0, 0.0])
    row = tuple([float(x) for x in v] if isinstance(v, list) else v for v in row)
    frames = spark.createDataFrame([row], schema)
    f = tracks.features(frames).first()
    turns = np.array(f.human[132:258], float).reshape(21, 6)
    assert np.isnan(turns[20]).all() and np.isfinite(turns[:20]).all() and f.human[20 * 6 + 138 - 6] is None
    assert list(f.robot[38:73]) == [0.0] * 35 and list(f.robot[73:]) == [1.0, 1.0] and len(f.robot) == 75
    m = tracks.aligned_measures(frames).first()
    assert (m.points, m.max_joint_speed, m.max_dof_speed, m.near_floor_slide, m.energy_correlation) == (1, 0.0, 0.0, 0.0, 1.0)


def test_pairs_are_aligned_and_measured_without_a_row_a_frame(spark):
    """Sequences are aligned in batches of pairs; expressions over arrays took a good half of the job, and frames as rows for the measures most of the rest."""
    from test_tracks import LIMITS, pair, frame_of, robot_tree

    from strideflow.operators import tracks

    rows = frame_of(spark, [pair("a", 61, 55, 30.0, 27.0, 2), pair("b", robot_fps=9.0), pair("c", 20)])
    keep, tracks.SLICE_POINTS = tracks.SLICE_POINTS, 25
    got = [tracks.aligned(tracks.checked(rows, LIMITS), robot_tree(), 29), tracks.skeleton_measures(rows)]
    plans = [g._jdf.queryExecution().optimizedPlan().toString() for g in got]
    found = {r.sample_id: r for r in got[0].collect()}, {r.sample_id: r for r in got[1].collect()}
    tracks.SLICE_POINTS = keep
    assert all("MapInArrow" in p and "explode" not in p for p in plans) and "body_position" not in plans[0] and "slice(" not in plans[0].split("MapInArrow")[0]
    assert {k: (r.grid is None) for k, r in found[0].items()} == {"a": False, "b": True, "c": False} and all(found[0]["b"][k] is None for k in ("floor_y", "origin", "basis", "faces", "steps"))
    assert [len(found[0][k].grid) for k in "ac"] == [len(found[0][k].steps) for k in "ac"] == [41, 20] and found[1].keys() == {"a", "b", "c"} and found[1]["a"].raw_joint_speed > 0


def test_grid_points_equal_given_targets_and_are_not_sorted(spark):
    """The points of a grid are as many as a sample is long, not as it has sources: they come after the sort."""
    from strideflow.operators import timeline

    rng = np.random.default_rng(3)
    rows = [(k, float(s), t, float(v)) for k in range(6) for t, (s, v) in enumerate(zip(np.sort(np.round(rng.uniform(0, 40, 1 + 3 * k), 1)), rng.normal(size=1 + 3 * k), strict=True))]
    rows += [(9, 5.0, 0, 1.0), (9, 5.0, 1, 2.0), (9, 7.0, 2, 4.0)]
    points = spark.createDataFrame(rows, "id long, s double, t long, value double")
    fps = 1 / 0.3
    targets = timeline.grid(points.groupBy("id").agg(F.min("s").alias("first_s"), F.max("s").alias("last_s")), fps)
    got = timeline.grid_linear(points, fps, "id", ties=("t",))
    ours = {(r.id, r.at): r.value for r in got.collect()}
    theirs = {(r.id, r.at): r.value for r in timeline.resample_linear(points, targets, "id").collect()}
    assert ours.keys() == theirs.keys() and len(ours) == got.count() > 400 and all(abs(ours[k] - theirs[k]) < 1e-12 for k in ours if k != (9, 5.0))
    assert ours[9, 5.0] == 2.0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window")  # the plan's top is its end


class Given:
    """A table of one Arrow batch, to see in what batches a function for mapInArrow gives its rows."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def test_archives_leave_a_worker_in_bounded_batches():
    import pyarrow as pa

    from strideflow.sources import prepared

    n, pairs = 200, 60
    tracks = {k: np.random.default_rng(1).random((n, w)) for k, w in prepared.WIDTHS.items()}
    rows = [{"sequence_id": f"s{i}", "source_fps": 50.0, "source_format": "safe_npz", **{k: v.ravel().tolist() for k, v in tracks.items()}, "anchor_origin": [0.0] * 3, "anchor_basis": np.eye(3).ravel().tolist()} for i in range(4)]
    (made,) = prepared.archives(Given(pa.RecordBatch.from_pylist(rows)))
    content = made.column(1)[0].as_py()
    out = prepared.load(Given(pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(pairs)]), pa.array([content] * (pairs - 1) + [b"x"])], ["sequence_id", "content"])))
    assert sum(b.num_rows for b in out) == pairs and max(b.nbytes for b in out) < 2 * prepared.SLICE < sum(b.nbytes for b in out)
    assert out[-1].column(1).to_pylist()[-2:] == [None, "unreadable"] and out[-1].column(0).to_pylist()[-2:] == ["s0", str(pairs - 1)]
    np.testing.assert_array_equal(out[0].column(6)[0].values.to_numpy(), tracks["human_features"].astype(np.float32).ravel())


class Held:
    """A state that counts the requests made of it."""

    def __init__(self, value=None):
        self.value, self.requests = value, 0

    def _ask(self, value=None):
        self.requests += 1
        return value

    def exists(self):
        return self._ask(self.value is not None)

    def get(self):
        return self._ask(iter(list(self.value)) if isinstance(self.value, list) else self.value)

    def update(self, value):
        self.value = self._ask(value)

    def appendList(self, values):
        self.value = self._ask([*(self.value or []), *values])

    def appendValue(self, value):
        self.appendList([value])


def test_prefix_state_is_asked_a_few_times_a_micro_batch():
    import pandas as pd

    from strideflow.streaming.owned import Prefixes

    p = Prefixes(256)
    p.pairs, p.counts = Held(), Held()

    def batch(first, n):
        kinds = ["snapshot" if s % 10 == 9 else "pair" for s in range(first, first + n)]
        rows = pd.DataFrame({"seq": range(first, first + n), "kind": kinds, "human": [s % 250 for s in range(first, first + n)], "robot": [300 if s == 5 else s % 200 for s in range(first, first + n)]})
        return next(p.handleInputRows((1,), iter([rows]), None)), [s for s in range(first, first + n) if s % 10 != 9 and s != 5]

    one, first = batch(0, 100)
    assert p.pairs.requests == 1 and p.counts.requests == 2 and [x[0] for x in p.pairs.value] == [s % 250 for s in first]
    two, second = batch(100, 100)
    assert p.pairs.requests == 3 and p.counts.requests == 5
    whole, last = [s % 250 for s in first + second], two.iloc[-1]
    assert last.human_prefix == whole and last.place == len(whole) and last.refused == 1 and one.iloc[9].human_prefix == [0, 1, 2, 3, 4, 6, 7, 8]
    q = Prefixes(256)
    q.pairs, q.counts = Held(), Held()
    empty = next(q.handleInputRows((1,), iter([pd.DataFrame({"seq": [0], "kind": ["snapshot"], "human": [None], "robot": [None]})]), None))
    assert empty.reason.tolist() == ["empty"] and q.pairs.requests == 0
