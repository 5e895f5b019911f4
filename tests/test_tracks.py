"""The preparation job over frames against the same in NumPy, one pair at a time."""

import brute_prepare as brute
import numpy as np
import pytest
from test_kernels import walk

from strideflow.functions import kernels as K
from strideflow.operators import tracks

DOF = tuple(f"j{k}" for k in range(29))
LIMITS = [(-3.0, 3.0)] * 29
SCHEMA = "sample_id string, human array<double>, human_fps double, root array<double>, rotation array<double>, dof array<double>, robot_fps double, bodies array<double>, body_names array<string>, note string"
SAME = dict(zip(tracks.MEASURES, brute.QUALITY, strict=True))


def robot_tree():
    """Two legs of six joints with turned bodies, the other joints beside them."""
    def leg(side, first):
        out = ""
        names = [f"{side}_{k}" for k in range(5)] + [f"{side}_ankle_roll_link"]
        for k, n in enumerate(names):
            w, x = np.cos(0.01 * k), np.sin(0.01 * k)
            out += f'<body name="{n}" pos="0 {0.1 if side == "left" else -0.1} {-0.12 - 0.01 * k}" quat="{w} {x} 0 0"><joint name="j{first + k}" axis="{"0 1 0" if k % 2 else "1 0 0"}"/>'
        return out + "</body>" * 6

    rest = "".join(f'<body name="b{k}"><joint name="j{k}"/></body>' for k in range(12, 29))
    return K.BodyTree.parse(f'<m><worldbody><body name="pelvis">{leg("left", 0)}{leg("right", 6)}{rest}</body></worldbody></m>', DOF)


def pair(name, frames=40, robot_frames=None, human_fps=20.0, robot_fps=20.0, seed=0, pace=0.01, lift=1.0):
    rng = np.random.default_rng(seed)
    m = robot_frames or frames
    t, r = np.arange(frames), np.arange(m)
    yaw = 0.02 * t
    base = walk(1)[0] * 0.28
    turned = np.stack([base[:, 0] * np.cos(yaw)[:, None] + base[:, 2] * np.sin(yaw)[:, None], np.broadcast_to(base[:, 1], (frames, 22)), base[:, 2] * np.cos(yaw)[:, None] - base[:, 0] * np.sin(yaw)[:, None]], 2)
    joints = (turned + np.stack([pace * t + 0.002 * np.sin(t), 0 * t, 0.005 * t], 1)[:, None])[..., [0, 2, 1]] * (1, -1, 1)  # z up
    q = np.stack([0.05 * np.sin(0.1 * r), 0.03 * np.cos(0.2 * r), np.sin(0.03 * r), np.cos(0.03 * r)], 1)
    q = q / np.linalg.norm(q, axis=1, keepdims=True) * np.where(r % 7 == 3, -1, 1)[:, None]
    dof = 0.1 * np.sin(0.2 * r[:, None] + np.arange(29)) + 0.002 * rng.random((m, 29))
    root = np.stack([pace * r, 0.002 * r, np.full(m, lift)], 1)
    flat = lambda x: x.ravel().tolist()
    return {"sample_id": name, "human": flat(joints), "human_fps": human_fps, "root": flat(root), "rotation": flat(q), "dof": flat(dof), "robot_fps": robot_fps, "note": "x"}


def frame_of(spark, rows):
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def expected(rows, tree):
    def feet(root, q, dof):
        at = tree.positions(root, q, dof)
        return np.stack([at[a] for a in tracks.ANKLES], 1)

    out = {}
    for r in rows:
        try:
            dof = brute.shaped(r["dof"], 29, reason="g1_dof_shape_or_finite")
            bodies = brute.shaped(r["bodies"], len(r["body_names"]), 3) if r.get("bodies") else None
            out[r["sample_id"]] = (None, brute.prepare_one(brute.shaped(r["human"], 22, 3), r["human_fps"], brute.shaped(r["root"], 3), brute.shaped(r["rotation"], 4), dof, r["robot_fps"], np.array(LIMITS), feet, bodies, r.get("body_names")))
        except brute.Rejected as e:
            out[r["sample_id"]] = (e.reason, e.detail)
    return out


@pytest.fixture(scope="module")
def cases():
    good = pair("good")
    rotated = pair("tracked", seed=1)
    roots = np.reshape(rotated["root"], (-1, 3))
    rotated |= {"bodies": np.stack([roots, roots - [0, -0.1, 0.7], roots - [0, 0.1, 0.71]], 1).ravel().tolist(), "body_names": ["x", *tracks.ANKLES]}
    jump = pair("jump")
    jump["dof"] = (np.reshape(jump["dof"], (-1, 29)) + np.where(np.arange(40) > 20, 2.0, 0)[:, None]).ravel().tolist()
    bent, norm, nan = pair("bent"), pair("norm"), pair("nan")
    bent["dof"][77], norm["rotation"][9], nan["human"][5] = 9.0, 3.0, float("nan")
    bones = pair("bones")
    bones["human"] = (np.reshape(bones["human"], (-1, 22, 3)) + np.where(np.arange(40) % 2, 0.03, 0)[:, None, None] * (np.arange(22) == 15)[None, :, None]).ravel().tolist()
    rows = [
        good, rotated, jump, bent, norm, nan, bones, pair("resampled", 61, 55, 30.0, 27.0, 2), pair("slow", 20, 40, 10.0, 20.0, 3), pair("late", robot_fps=9.0), pair("short", 2, 2, 90.0, 90.0),
        pair("one", 1), pair("tall") | {"human": [9 * x for x in good["human"]]}, pair("fast", pace=0.3), pair("sprint", pace=0.9), pair("deep", lift=0.4), pair("lost") | {"bodies": [0.0] * 120, "body_names": ["x"]},
        pair("cut") | {"dof": [0.0] * 30}, pair("flat") | {"human": [0.0] * 65}, pair("few") | {"root": [0.0] * 9}, pair("twenty", 20), pair("two", 2),
    ]
    return rows


def test_job_equals_numpy(spark, cases):
    tree = robot_tree()
    want = expected(cases, tree)
    records, frames = tracks.prepare(frame_of(spark, cases).repartition(3), LIMITS, tree)
    got, f = {r.sample_id: r for r in records.collect()}, frames.collect()
    assert {k: r.reason for k, r in got.items()} == {k: w[0] for k, w in want.items()}
    assert {w[0] for w in want.values()} >= {None, "g1_dof_speed", "g1_dof_limit", "g1_quaternion_norm", "source_nonfinite", "human_bone_length", "timeline_mismatch", "timeline_shape", "human_height", "g1_root_speed", "human_joint_speed", "g1_foot_penetration", "g1_body_order"}
    for k, (reason, w) in want.items():
        r = got[k]
        own = sorted((x for x in f if x.sample_id == k), key=lambda x: x.t)
        if reason:
            assert not own and r.frames is None and (r.detail is None or np.isnan(w) or reason.startswith("timeline") or abs(r.detail - w) < 1e-9), k
            continue
        human, robot, measures, anchor = w
        assert r.frames == len(human) == len(own) and [x.t for x in own] == list(range(len(own)))
        np.testing.assert_allclose([x.robot for x in own], robot, atol=2e-5, err_msg=k)
        np.testing.assert_allclose([x.human for x in own], human, atol=2e-4, err_msg=k)
        np.testing.assert_allclose(r.origin, anchor.origin, atol=1e-12)
        np.testing.assert_allclose(r.basis, anchor.basis.ravel(), atol=1e-12)
        for ours, theirs in SAME.items():
            assert abs(r[ours] - measures[theirs]) < 1e-6, (k, ours, r[ours], measures[theirs])


def test_nulls_and_empty_tables(spark):
    tree = robot_tree()
    odd = [{"sample_id": "null"}, pair("empty") | {"human": [], "root": [], "rotation": [], "dof": []}, pair("rate") | {"human_fps": None}, pair("zero") | {"robot_fps": 0.0}, pair("hole")]
    odd[-1]["root"][4] = None
    records, frames = tracks.prepare(frame_of(spark, odd), LIMITS, tree)
    assert {r.sample_id: r.reason for r in records.collect()} == {"null": "g1_dof_shape_or_finite", "empty": "source_shape", "rate": "timeline_shape", "zero": "timeline_shape", "hole": "source_nonfinite"}
    assert frames.count() == 0
    records, frames = tracks.prepare(frame_of(spark, odd).limit(0), LIMITS, tree)
    assert records.count() == frames.count() == 0


def test_feet_equal_the_body_tree(spark):
    from pyspark.sql import functions as F

    tree, rng = robot_tree(), np.random.default_rng(5)
    q = rng.normal(size=(8, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    root, dof = rng.normal(size=(8, 3)), rng.normal(size=(8, 29))
    df = spark.createDataFrame([(k, root[k].tolist(), q[k].tolist(), dof[k].tolist()) for k in range(8)], "k int, root array<double>, q array<double>, dof array<double>")
    for name in ("left_2", *tracks.ANKLES):
        got = df.orderBy("k").select(tracks.body_position(tracks.body_path(tree, name), F.col("root"), F.col("q"), F.col("dof")).alias("p")).collect()
        np.testing.assert_allclose([r.p for r in got], tree.positions(root, q, dof)[name], atol=1e-9)
