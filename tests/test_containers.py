"""Source adapters: every source's arrays and every reason, and the job from files to features."""

import numpy as np

from strideflow.functions.kernels import BodyTree
from strideflow.operators import containers

DOF = tuple(f"j{k}" for k in range(29))
RECORD = "sample_id string, source_dataset string, human struct<path string, locator string, fps double, frame_start int, frame_end int>, g1 struct<path string, locator string, fps double, frame_start int, frame_end int>"


def flat(rng, *shape):
    return rng.random(shape).ravel().tolist()


def test_sources_and_reasons(spark):
    rng = np.random.default_rng(3)
    whole = np.arange(5 * 72, dtype=float)
    bone = {"smpl_joints": whole.tolist(), "pose_aa": flat(rng, 5, 72), "transl": flat(rng, 5, 3)}
    robot = {"root_trans_offset": flat(rng, 5, 3), "root_rot": flat(rng, 5, 4), "dof": flat(rng, 5, 29)}
    row = {"joints": flat(rng, 6, 66), "root_pos": flat(rng, 6, 3), "root_rot": flat(rng, 6, 4), "dof_pos": flat(rng, 6, 29)}
    tracks = {"body_positions": flat(rng, 6, 2, 3), "body_rotations": flat(rng, 6, 2, 4), "dof_positions": flat(rng, 6, 29)}
    bodies = {"dof_names": list(DOF), "body_names": ["pelvis", "hand"]}
    held = [
        ("b", "", 0, bone, {}), ("short", "", 0, bone | {"transl": [0.0] * 12}, {}), ("r", "", 0, robot, {}),
        ("x", "one", 0, row | {"joints": []}, {}), ("x", "one", 1, row, {}), ("x", "nan", 0, row | {"root_pos": [float("nan")] * 18}, {}), ("x", "none", 0, {}, {}),
        ("e", "", 0, tracks, bodies), ("order", "", 0, tracks, bodies | {"dof_names": list(DOF[::-1])}),
    ]
    ref = lambda path, locator="", start=1, stop=4: (path, locator, 20.0, start, stop)
    records = [
        ("bone", "Bone-Seed", ref("b"), ref("r", "absent")), ("schema", "Bone-Seed", ref("short"), ref("r")), ("inter", "Inter-X", ref("x", "one"), ref("x", "one")),
        ("finite", "Inter-X", ref("x", "one"), ref("x", "nan")), ("empty", "Inter-X", ref("x", "none"), ref("x", "one")), ("lost", "Inter-X", ref("x", "two"), ref("x", "one")),
        ("range", "Inter-X", ref("x", "one", 1, 7), ref("x", "one")), ("body", "HumanML3D", ref("x", "one"), ref("e")), ("order", "HumanML3D", ref("x", "one"), ref("order")),
        ("zero", "Inter-X", ref("x", "one", 2, 2), ref("x", "one", 2, 2)), ("other", "Kit", ref("x", "one"), ref("x", "one")), ("null", None, None, None),
    ]
    got = {r.sample_id: r for r in containers.load_pairs(spark.createDataFrame(records, RECORD), spark.createDataFrame(held, containers.CONTAINER), DOF).collect()}
    assert {k: r.reason for k, r in got.items() if r.reason} == {
        "schema": "bone_seed_smpl_schema", "finite": "source_nonfinite", "empty": "source_nonfinite", "lost": "source_locator", "range": "source_frame_range",
        "order": "g1_dof_order", "other": "source_dataset", "null": "source_dataset",
    }
    assert got["bone"].human == whole.reshape(5, 24, 3)[:, :22].ravel().tolist() and got["bone"].rotation == robot["root_rot"][4:16] and got["bone"].bodies is None
    quarter = np.reshape(row["root_rot"], (6, 4))[1:4][:, [1, 2, 3, 0]]
    assert got["inter"].human == row["joints"][66:264] and got["inter"].rotation == quarter.ravel().tolist() and got["inter"].dof == row["dof_pos"][29:116]
    at, turn = np.reshape(tracks["body_positions"], (6, 2, 3))[1:4], np.reshape(tracks["body_rotations"], (6, 2, 4))[1:4]
    assert got["body"].root == at[:, 0].ravel().tolist() and got["body"].rotation == turn[:, 0][:, [1, 2, 3, 0]].ravel().tolist()
    assert got["body"].bodies == at.ravel().tolist() and got["body"].body_names == ["pelvis", "hand"]
    assert got["zero"].human == [] and got["zero"].rotation == [] and got["lost"].dof is None
    assert containers.load_pairs(spark.createDataFrame([], RECORD), spark.createDataFrame([], containers.CONTAINER), DOF).count() == 0


def test_job_from_files_to_features(spark, tmp_path):
    from test_operators import raw_pair

    pair = raw_pair()
    turned = np.reshape(pair["rotation"], (-1, 4))[:, [3, 0, 1, 2]]
    np.savez(tmp_path / "h.npz", joints=np.reshape(pair["human"], (-1, 22, 3)))
    np.savez(tmp_path / "g.npz", root_pos=np.reshape(pair["root"], (-1, 3)), root_rot=turned, dof_pos=np.reshape(pair["dof"], (-1, 29)))
    (tmp_path / "bad.npz").write_bytes(b"no archive")
    files = containers.npz_containers(spark, str(tmp_path))
    path = lambda name: next(r.path for r in files.select("path").collect() if r.path.endswith(name))
    ref = lambda name: (path(name), None, 20.0, 0, 12)
    records = spark.createDataFrame([("a", "Inter-X", ref("/h.npz"), ref("/g.npz")), ("bad", "Inter-X", ref("/bad.npz"), ref("/g.npz"))], RECORD)
    body = "".join(f'<body name="{n}" pos="{p}"><joint name="{j}" axis="0 1 0"/></body>' for n, p, j in [("left_ankle_roll_link", "0 0.1 -0.8", "j0"), ("right_ankle_roll_link", "0 -0.1 -0.8", "j1")])
    rest = "".join(f'<body name="b{k}"><joint name="j{k}"/></body>' for k in range(2, 29))
    tree = BodyTree.parse(f'<m><worldbody><body name="pelvis">{body}{rest}</body></worldbody></m>', DOF)
    got = {r.sample_id: r for r in containers.prepare_corpus(records, files, [(-3.0, 3.0)] * 29, tree, DOF).collect()}
    assert got["bad"].reason == "source_nonfinite" and got["a"].reason is None
    assert got["a"].frames == 12 and len(got["a"].human_features) == 12 * 262 and len(got["a"].robot_features) == 12 * 75
