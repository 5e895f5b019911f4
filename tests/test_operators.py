"""Operators on small exact cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.functions import keys
from strideflow.operators import codebook, corpus, frames, joins, metrics, normalize, quality, splits, timeline
from strideflow.sources import motion, sinks


def test_windows_repeat_the_last_frame_and_mask_it(spark):
    s = spark.createDataFrame([(1, list(range(6)), 6)], "sample_id long, values array<int>, n int")
    every, some = frames.token_masks()
    r = frames.windowed(s, 8, 8).select("frames", "frame_mask", every.alias("e"), some.alias("s")).collect()
    assert len(r) == 1 and r[0].frames == [0, 1, 2, 3, 4, 5, 5, 5] and r[0].frame_mask == [True] * 6 + [False] * 2
    assert r[0].e == [True, False] and r[0].s == [True, True]


def test_no_window_starts_beyond_the_end(spark):
    lengths = spark.createDataFrame([(1, 6), (2, 10), (3, 0)], "sample_id long, n int")
    assert [(r.sample_id, r.start) for r in frames.window_starts(lengths, 4, 8).orderBy("sample_id", "start").collect()] == [(1, 0), (2, 0), (2, 8)]


def test_linear_resampling(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.1, 1.0), (1, 0.4, 4.0)], "id long, s double, value double")
    t = spark.createDataFrame([(1, 0.0), (1, 0.2), (1, 0.4)], "id long, at double")
    assert [round(r.value, 9) for r in timeline.resample_linear(p, t, "id").orderBy("at").collect()] == [0.0, 2.0, 4.0]


def test_common_timelines(spark):
    df = spark.createDataFrame([(51, 50.0, 31, 30.0), (1770, 50.0, 1063, 30.0), (100, 50.0, 10, 30.0), (1, 50.0, 9, 30.0)], "frames_a int, fps_a double, frames_b int, fps_b double")
    r = timeline.common_timeline(df, 20.0).collect()
    assert (r[0].points, round(r[0].common_end, 6), r[0].reason) == (21, 1.0, None)
    assert round((r[1].points - 1) / 20, 2) == 35.35 and r[1].reason is None
    assert [r[2].reason, r[3].reason] == ["timeline_mismatch", "timeline_shape"]


def test_clip_bounds(spark):
    a, b, fps = timeline.clip_bounds(F.lit(25), F.lit(219), F.lit(219), F.lit(364))
    r = spark.range(1).select(a.alias("a"), b.alias("b"), fps.alias("f")).first()
    assert (r.a, r.b) == (41, 364) and abs(r.f - 20 * 364 / 219) < 1e-12


def test_keys(spark):
    folder, name = keys.canonical_motion_key(F.lit("./pose_data/KIT_x/3/jump_left02_poses.npy"))
    track = keys.track_key(F.lit("KIT_x/3/jump_left02_poses_120_jpos.npy"))
    base, person = keys.person_key(F.lit("clip_P3_P12"))
    r = spark.range(1).select(folder.alias("f"), name.alias("n"), base.alias("b"), person.alias("p"), *track).first()
    assert tuple(r) == ("kitx/3", "jumpleft02poses", "clip_P3", "12", "kitx/3", "jumpleft02poses", 120)


def test_group_splits(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), ("b", "val"), ("c", "train")], "g string, split string")
    assert {r.g: r.split for r in splits.group_split(df, "g").collect()} == {"a": "test", "b": "val", "c": "train"}


def test_codebook_statistics(spark):
    t = spark.createDataFrame([(0, True), (1, True), (255, True), (1, True), (9, False), (9, False)], "token_id int, m boolean")
    u = codebook.usage(codebook.histogram(t, mask=F.col("m"))).first()
    assert u.used == 3 and u.dead_ratio == 253 / 256 and abs(u.perplexity - 2.82842712474619) < 1e-12


def test_masked_fit_and_floor(spark):
    df = spark.createDataFrame([([1.0, 5.0], True), ([3.0, 5.0], True), ([1000.0, 1.0], False)], "x array<double>, m boolean")
    r = normalize.fit_vector(df, "x", F.col("m")).orderBy("dim").collect()
    assert (r[0]["mean"], r[0]["std"], r[1]["std"]) == (2.0, 1.0, 1e-4)
    stats = normalize.as_arrays(normalize.fit_vector(df, "x", F.col("m")))
    back = normalize.apply(normalize.apply(df, "x", stats), "x", stats, inverse=True).collect()
    np.testing.assert_allclose(back[0].x, [1.0, 5.0])


def test_contacts(spark):
    df = spark.createDataFrame([(1, t, 0.0, 2.0 * (t > 0)) for t in range(5)], "sample_id long, t int, y double, v double")
    assert [r.contact for r in quality.foot_contact(df, "sample_id", "t", "y", F.col("v")).orderBy("t").collect()] == [True, False, False, False, False]
    m = metrics.contact_metrics(spark.createDataFrame([(0.0, 0.0)], "a double, b double"), F.col("a"), F.col("b")).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)


def test_gates_keep_their_order(spark):
    df = spark.createDataFrame([(9.0, 99.0, 1.0, 1.0, 0.0), (1.0, 1.0, 1.0, -0.5, 9.0), (1.0, 1.0, 1.0, 1.0, 0.0)], "max_root_speed double, max_angular_speed double, max_dof_speed double, energy_correlation double, foot_penetration double")
    assert [r.reason for r in df.withColumn("reason", quality.first_failure(quality.aligned_gates())).collect()] == ["g1_root_speed", "pair_energy_alignment", None]
    assert [r[0] for r in spark.sql("SELECT explode(array(1D, double('nan'), double('inf'), null)) AS x").select(quality.finite(F.col("x"))).collect()] == [True, False, False, False]


def test_greedy_packing(spark):
    df = spark.createDataFrame([("a", k, n) for k, n in enumerate([3, 3, 9, 1, 1])], "split string, id long, n long")
    r = corpus.pack_shards(df, "split", "id", "n", 6).orderBy("id").collect()
    assert [(x.shard, x.frame_start) for x in r] == [(0, 0), (0, 3), (1, 0), (2, 0), (2, 1)]


def test_unique_candidates_and_lookups(spark):
    rows, found = spark.createDataFrame([(1,), (2,), (3,)], "k long"), spark.createDataFrame([(1,), (2,), (2,)], "k long")
    r = {x.k: x.reason for x in joins.unique_candidate(rows, found, "k", "none", "many").collect()}
    assert r == {1: None, 2: "many", 3: "none"}


def pair(frames=8, fps=20.0):
    one = np.tile(np.array([0, 0, 0, 1], "f4"), (frames, 1))
    zeros = lambda *s: np.zeros((frames, *s), "f4")
    actor = {"fps": fps, "root_pos": zeros(3), "root_rot": one, "pose_body": zeros(69), "joints_pos": zeros(24, 3), "betas": np.zeros(10, "f4"), "gender": "neutral"}
    return actor, {"fps": fps, "root_pos": zeros(3), "root_rot": one, "dof_pos": zeros(29), "joints_pos": zeros(20, 3)}


def test_pair_files(spark, tmp_path):
    def save(name, actor, reactor):
        np.savez(tmp_path / f"{name}_actor.npz", **actor)
        np.savez(tmp_path / f"{name}_reactor.npz", **reactor)

    save("G001T001A001R001", *pair())
    save("G001T001A001R002", pair(3)[0], pair(4)[1])
    bad = pair()[0]
    bad["joints_pos"][0, 0, 0] = np.nan
    save("G001T001A001R003", bad, pair()[1])
    np.savez(tmp_path / "G001T001A001R004_actor.npz", **pair()[0])
    (tmp_path / "G001T001A001R004_reactor.pkl").write_bytes(b"never opened")
    states = {(r.sequence_id[-1], r.ext): r.state for r in motion.discover_pairs(spark, str(tmp_path)).collect()}
    assert states == {("1", "npz"): "matched", ("2", "npz"): "matched", ("3", "npz"): "matched", ("4", "npz"): "actor_only", ("4", "pkl"): "reactor_only"}
    assert {r.sequence_id[-1]: r.reason for r in motion.load_pairs(spark, str(tmp_path)).collect()} == {"1": None, "2": "frame_count", "3": "nonfinite"}


def test_split_files(spark, tmp_path):
    body = {"schema_id": "s", "schema_version": 1, "source": {"sequence_count": 2}, "splits": {"train": ["a"], "val": ["b"], "test": []}}
    (tmp_path / "s.json").write_text(json.dumps(body))
    assert {r.sequence_id: r.split for r in motion.fixed_splits(spark, str(tmp_path / "s.json")).collect()} == {"a": "train", "b": "val"}
    body["splits"]["test"] = ["a"]
    (tmp_path / "t.json").write_text(json.dumps(body))
    with pytest.raises(ValueError):
        motion.fixed_splits(spark, str(tmp_path / "t.json"))


def test_normaliser_files(spark, tmp_path):
    stats = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "dim int, mean double, std double")
    path = str(tmp_path / "n.json")
    sinks.write_normalizer(stats, path, "x", "y", 20.0)
    assert motion.normalizer(path, "x")["std"] == [2.0, 4.0]
    with pytest.raises(ValueError):
        motion.normalizer(path, "z")


def test_checksums_tell_changes(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    before = spark.createDataFrame(sinks.checksums(spark, str(tmp_path)).collect())
    (tmp_path / "b").write_text("3")
    (tmp_path / "c").write_text("4")
    (tmp_path / "a").unlink()
    found = {r.path: r.problem for r in corpus.checksum_differences(before, sinks.checksums(spark, str(tmp_path))).collect()}
    assert found == {"a": "missing", "b": "changed", "c": "unexpected"}


def raw_pair(frames=12, **changes):
    from test_kernels import walk

    t = np.arange(frames)
    joints = walk(frames)[..., [0, 2, 1]] * (0.28, -0.28, 0.28)  # z up
    root = np.stack([0.01 * t, 0 * t, np.full(frames, 0.8)], 1)
    row = {"sample_id": "a", "human": joints.ravel().tolist(), "human_fps": 20.0, "root": root.ravel().tolist(), "rotation": np.tile([0.0, 0, 0, 1], (frames, 1)).ravel().tolist(), "dof": np.outer(0.01 * t, np.ones(29)).ravel().tolist(), "robot_fps": 20.0}
    return row | changes


def test_prepared_pairs_and_their_reasons(spark):
    import brute_prepare as prepare

    def feet(root, q, dof):
        return np.stack([root - [0, 0.1, 0.8], root - [0, -0.1, 0.8]], 1)

    jump = np.outer((np.arange(12) > 5) * 2.0, np.ones(29)).ravel().tolist()
    bent = np.zeros((12, 29))
    bent[3, 5] = 9.0
    rows = [raw_pair(), raw_pair(sample_id="jump", dof=jump), raw_pair(sample_id="bent", dof=bent.ravel().tolist()), raw_pair(sample_id="late", robot_fps=10.0), raw_pair(sample_id="norm", rotation=[0.5] * 4 + [1.0] * 44)]
    nan = raw_pair(sample_id="nan")
    nan["root"] = [float("nan"), *nan["root"][1:]]
    tall = raw_pair(sample_id="tall")
    tall["human"] = [9 * x for x in tall["human"]]
    ankles = np.stack([np.asarray(raw_pair()["root"]).reshape(-1, 3) - [0, y, 0.8] for y in (-0.1, 0.1)], 1)
    tracked = raw_pair(sample_id="tracked", bodies=ankles.ravel().tolist(), body_names=["right_ankle_roll_link", "left_ankle_roll_link"])
    odd = [raw_pair(sample_id="no ankles", bodies=ankles.ravel().tolist(), body_names=["a", "b"]), raw_pair(sample_id="cut", dof=[0.0] * 30), raw_pair(sample_id="flat", human=[0.0] * 65), raw_pair(sample_id="short", dof=[0.0] * 29 * 11)]
    schema = "sample_id string, human array<double>, human_fps double, root array<double>, rotation array<double>, dof array<double>, robot_fps double, bodies array<double>, body_names array<string>"
    df = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in [*rows, nan, tall, tracked, *odd]], schema)
    got = {r.sample_id: r for r in prepare.prepare_pairs(df, [(-3.0, 3.0)] * 29, feet).collect()}
    assert {k: r.reason for k, r in got.items()} == {"a": None, "jump": "g1_dof_speed", "bent": "g1_dof_limit", "late": "timeline_mismatch", "norm": "g1_quaternion_norm", "nan": "source_nonfinite", "tall": "human_height", "tracked": None, "no ankles": "g1_body_order", "cut": "g1_dof_shape_or_finite", "flat": "source_shape", "short": "source_shape"}
    assert got["tracked"].robot_features == got["a"].robot_features and len(got["a"].origin) == 3 and len(got["a"].basis) == 9
    from strideflow.functions import kernels as K
    from test_kernels import walk

    direct = K.human_features(K.place_human((walk(12) * 0.28).astype(np.float32))[0])  # the y-up joints that the z-up input stands for
    np.testing.assert_allclose(np.reshape(got["a"].human_features, direct.shape), direct, atol=1e-4)
    assert got["a"].frames == 12 and len(got["a"].human_features) == 12 * 262 and len(got["a"].robot_features) == 12 * 75 and set(got["a"].quality) == set(prepare.QUALITY)


def test_signatures_ignore_place():
    from test_kernels import walk

    import brute_prepare as prepare

    assert prepare.motion_signature(walk(5)) == prepare.motion_signature(walk(5) + 0.25) != prepare.motion_signature(walk(5) * 1.1)


def test_dead_codes_start_again(spark):
    book = spark.createDataFrame([(0, 5.0, [5.0, 0.0]), (1, 0.1, [1.0, 1.0]), (2, 0.2, [2.0, 2.0])], "code long, mass double, sums array<double>")
    vectors = spark.createDataFrame([(1, 0, [3.0, 4.0]), (2, 0, [7.0, 8.0])], "id long, token_id long, v array<double>")
    got = {r.code: r for r in codebook.ema_update(book, vectors, "v", "id", 0.5).collect()}
    assert not got[0].dead and (got[0].mass, got[0].sums) == (3.5, [7.5, 6.0])
    assert [(got[c].dead, got[c].mass, got[c].centre) for c in (1, 2)] == [(True, 1.0, [7.0, 8.0]), (True, 1.0, [3.0, 4.0])]


def test_running_totals_over_ranges(spark):
    from strideflow.operators import corpus

    df = spark.createDataFrame([(k * 7919 % 1000, k % 5) for k in range(1000)], "id long, tokens long").repartition(5)
    rows = sorted(tuple(r) for r in corpus.token_offsets(df, "id").select("id", "tokens", "offset_start", "offset_end").collect())
    end = 0
    for _, n, start, stop in rows:
        assert (start, stop) == (end, end + n)
        end = stop
    assert sorted(r.batch for r in corpus.batches(df, "id", 300).collect()) == sorted(k // 300 for k in range(1000))
    assert corpus.token_offsets(df.limit(0), "id").collect() == []
