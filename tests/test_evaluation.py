"""Evaluation records against NumPy."""

import numpy as np

from strideflow.functions.kernels import gram_schmidt
from strideflow.operators import evaluation as E


def made(width, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(6, width)), rng.normal(size=(6, width))
    return a, b, [True, True, False, True, True, False]


def close(got, want):
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, rtol=1e-9, err_msg=k)


def angle(a, b):
    return np.arccos(np.clip(((a * b).sum((-1, -2)) - 1) / 2, -1, 1))


def test_robot(spark):
    a, b, mask = made(75, 1)
    df = spark.createDataFrame([("s", k, a[k].tolist(), b[k].tolist(), mask[k]) for k in range(6)], "s string, t int, a array<double>, b array<double>, m boolean")
    got = E.robot_reconstruction(df.repartition(3), ["s"], "t", "a", "b", "m").first().asDict()
    a, b = a[mask], b[mask]
    ra, rb, d = gram_schmidt(a[:, 3:9]), gram_schmidt(b[:, 3:9]), np.abs(b - a)
    world = lambda r, x: (r @ x[:, 38:41, None])[..., 0]
    turn = np.arctan2(rb[:, 0, 2], rb[:, 2, 2]) - np.arctan2(ra[:, 0, 2], ra[:, 2, 2])
    far = np.linalg.norm((b - a)[:, :3], axis=1)
    close(got, {
        "n": 4, "mae": d.mean(), "rmse": np.sqrt((d**2).mean()), "max_abs": d.max(), "joint_mae": d[:, 9:38].mean(0), "joint_degrees": np.degrees(d[:, 9:38].mean(0)), "worst_joint": d[:, 9:38].mean(0).argmax(), "worst_joint_mae": d[:, 9:38].mean(0).max(),
        "ade": far.mean(), "fde": far[-1], "rotation": angle(ra, rb).mean(), "local_velocity": d[:, 38:41].mean(), "world_velocity": np.abs(world(rb, b) - world(ra, a)).mean(), "angular_velocity": d[:, 41:44].mean(),
        "joint_velocity": d[:, 44:73].mean(), "yaw": np.abs(np.arctan2(np.sin(turn), np.cos(turn))).mean(), "height": d[:, 1].mean(),
    })
    t, p = a[:, 73:] >= 0.5, b[:, 73:] >= 0.5
    assert got["contact_f1"] == (2 * (t & p).sum() / (t.sum() + p.sum()) if (t | p).any() else 0)
    assert E.robot_reconstruction(df.where("false"), ["s"], "t", "a", "b", "m").count() == 0


def test_human(spark):
    a, b, mask = made(12 + 12 + 4, 2)
    df = spark.createDataFrame([("s", a[k].tolist(), b[k].tolist(), mask[k]) for k in range(6)], "s string, a array<double>, b array<double>, m boolean")
    got = E.human_reconstruction(df, ["s"], "a", "b", "m", (0, 12), (12, 24), (24, 28)).first().asDict()
    a, b = a[mask], b[mask]
    pa, pb = a[:, :12].reshape(-1, 4, 3), b[:, :12].reshape(-1, 4, 3)
    ra, rb = (gram_schmidt(x[:, 12:24].reshape(-1, 6)) for x in (a, b))
    t, p = a[:, 24:] >= 0.5, b[:, 24:] >= 0.5
    close(got, {
        "n": 4, "mae": np.abs(b - a).mean(), "mpjpe": np.linalg.norm(pb - pa, axis=2).mean(), "root_relative_mpjpe": np.linalg.norm((pb - pb[:, :1]) - (pa - pa[:, :1]), axis=2).mean(),
        "rotation": angle(ra, rb).mean(), "contact_precision": (t & p).sum() / p.sum(), "contact_recall": (t & p).sum() / t.sum(),
    })
