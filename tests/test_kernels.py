"""Kernels and column expressions against exact small values, round trips and each other."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.functions import geometry as G
from strideflow.functions import kernels as K


def walk(frames=5):
    base = np.zeros((22, 3))
    for chain in K.CHAINS:
        for a, b in zip(chain[:-1], chain[1:], strict=True):
            base[b] = base[a] + np.array(K.REST_DIRECTIONS[b], float)
    base[[14, 17, 19, 21], 0] -= 0.25
    t = np.arange(frames, dtype=float)
    return base + np.array([3.0, 1.5, -2.0]) + np.stack([0.1 * t, 0 * t, 0.05 * t], 1)[:, None]


def test_human_features_have_the_known_digest():
    features = K.human_features(K.place_human(walk())[0])
    assert features.shape == (5, 262)
    assert hashlib.sha256(np.round(features.astype(float), 6).tobytes()).hexdigest() == "c6d26842f5566fca0625dc7f8d9502c8467dece84522f8d7df95e7febbc92b80"


def test_placing_a_human_and_back():
    placed, state = K.place_human(walk())
    back = K.unplace_human(placed, state)
    np.testing.assert_allclose(back[..., [0, 2]], walk()[..., [0, 2]], atol=1e-5)
    np.testing.assert_allclose(K.human_positions(K.human_features(placed)), placed, atol=1e-6)


@pytest.mark.parametrize("joints", [walk(1), np.full((3, 22, 3), np.nan), np.zeros((3, 21, 3))])
def test_human_features_reject(joints):
    with pytest.raises(ValueError):
        K.human_features(joints)


def random_rotations(n=50, seed=0):
    q = np.random.default_rng(seed).standard_normal((n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return np.where(q[:, 3:] < 0, -q, q)


def test_rotations_round_trip():
    q = random_rotations()
    np.testing.assert_allclose(K.quaternions(K.matrices(q)), q, atol=1e-10)
    m = K.matrices(q)
    np.testing.assert_allclose(K.gram_schmidt(np.concatenate([m[..., 0], m[..., 1]], -1)), m, atol=1e-12)
    assert np.allclose(np.linalg.det(m), 1)


def test_robot_round_trip_and_velocities():
    n = 6
    yaw = np.arange(n) * 0.14
    q = np.stack([0 * yaw, np.sin(yaw / 2), 0 * yaw, np.cos(yaw / 2)], 1)
    root = np.stack([0.1 * np.arange(n), np.full(n, 0.8), 0.02 * np.arange(n) ** 2], 1)
    dof = np.outer(np.linspace(0, 1, n), np.ones(29))
    features, anchor = K.robot_features(root, q, dof, np.zeros((n, 2)), 20.0)
    assert features.shape == (n, 75) and not features[0, 38:73].any()
    np.testing.assert_allclose(features[1:, 41:44], np.tile([0, 2.8, 0], (n - 1, 1)), atol=1e-9)
    back = K.robot_motion(features, anchor)
    np.testing.assert_allclose(back[0], root, atol=1e-10)
    np.testing.assert_allclose(back[1], q, atol=1e-10)
    assert K.integration_error(features, 20.0) < 1e-9
    with pytest.raises(ValueError):
        K.robot_features(root, 2 * q, dof, np.zeros((n, 2)), 20.0)


def test_column_expressions_agree_with_kernels(spark):
    q, p = random_rotations(20, 1), random_rotations(20, 2)
    df = spark.createDataFrame([(q[k].tolist(), p[k].tolist()) for k in range(20)], "q array<double>, p array<double>")
    rows = df.select("q", "p", G.to_matrix(F.col("q")).alias("m"), G.slerp(F.col("q"), F.col("p"), F.lit(0.25)).alias("s")).withColumn("b", G.from_matrix(F.col("m"))).withColumn("v", G.rotvec(F.col("b"))).collect()
    for r in rows:
        m = K.matrices(np.array(r.q))
        np.testing.assert_allclose(np.reshape(r.m, (3, 3)), m, atol=1e-12)
        np.testing.assert_allclose(r.b, r.q, atol=1e-10)
        np.testing.assert_allclose(r.v, K.rotation_vectors(m[None])[0], atol=1e-9)
        assert abs(np.linalg.norm(r.s) - 1) < 1e-12


def test_body_tree():
    xml = "<m><worldbody><body name='pelvis'><body name='a' pos='1 0 0'><joint name='j' axis='0 0 1'/><body name='b' pos='1 0 0'/></body></body></worldbody></m>"
    tree = K.BodyTree.parse(xml, ("j",))
    at = tree.positions(np.zeros((2, 3)), np.tile([0, 0, 0, 1.0], (2, 1)), np.array([[0.0], [np.pi / 2]]))
    np.testing.assert_allclose(at["b"], [[2, 0, 0], [1, 1, 0]], atol=1e-12)
    with pytest.raises(ValueError):
        K.BodyTree.parse(xml, ("k",))


def test_convolutions_are_causal_and_aligned():
    from strideflow.plans.kernels import _weights

    w = _weights(3, 8, 4, 2)
    x = np.random.default_rng(0).standard_normal((16, 3))
    whole, part = K.conv_encode(x, w), K.conv_encode(x[:8], w)
    assert whole.shape == (4, 4)
    np.testing.assert_allclose(whole[:2], part, atol=1e-12)
    later = x.copy()
    later[8:] += 17.0
    np.testing.assert_allclose(K.conv_encode(later, w)[:2], part, atol=1e-12)
    assert K.receptive_field(3) == 332
    assert K.nearest_codes(np.zeros((1, 2)), np.array([[1.0, 0], [0, 1], [-1, 0]])).tolist() == [0]
