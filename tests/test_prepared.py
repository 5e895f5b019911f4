"""Prepared archives: the round trip, each refusal in order, and damaged files in every loader."""

import io

import numpy as np
import pytest

from strideflow.operators import containers
from strideflow.sources import motion, prepared


def tracks(n, seed=0):
    rng = np.random.default_rng(seed)
    return {k: rng.normal(size=(n, w)) for k, w in prepared.WIDTHS.items()}


def archive(n=6, **changes):
    content = prepared.encode("s", tracks(n), np.zeros(3), np.eye(3), 50.0, "safe_npz")
    with np.load(io.BytesIO(content)) as z:
        members = {k: z[k] for k in z.files}
    members |= changes
    out = io.BytesIO()
    np.savez_compressed(out, **{k: v for k, v in members.items() if v is not None})
    return out.getvalue()


def test_round_trip(spark, tmp_path):
    t = {f"s{n}": tracks(n, n) for n in (1, 4, 7)}
    rows = [(s, 50.0, "trusted_pickle", *[v[k].ravel().tolist() for k in prepared.WIDTHS], [1.0, 2.0, 3.0], np.eye(3).ravel().tolist()) for s, v in t.items()]
    schema = "sequence_id string, source_fps double, source_format string, " + ", ".join(f"{k} array<double>" for k in prepared.WIDTHS) + ", anchor_origin array<double>, anchor_basis array<double>"
    df = spark.createDataFrame(rows, schema)
    at = str(tmp_path / "p")
    prepared.write(df, at)
    loaded = prepared.load(spark.read.parquet(at))
    for r in loaded.collect():
        v, n = t[r.sequence_id], len(t[r.sequence_id]["g1_features"])
        assert (r.reason, r.valid_frames, r.frames, r.frame_mask) == (None, n, n + -n % 4, [True] * n + [False] * (-n % 4))
        for k, w in prepared.WIDTHS.items():
            got = np.array(r[k]).reshape(-1, w)
            np.testing.assert_array_equal(got[:n], v[k].astype(np.float32).astype(float))
            assert (got[n:] == got[n - 1]).all()
    assert prepared.selected(loaded, "s4").count() == 1
    with pytest.raises(ValueError, match="no such sequence"):
        prepared.selected(loaded, "s5")
    with pytest.raises(ValueError, match="several"):
        prepared.selected(loaded.union(loaded), "s4")
    with pytest.raises(Exception, match="already exists"):
        prepared.write(df, at)
    with pytest.raises(ValueError, match="unique"):
        prepared.write(df.union(df), str(tmp_path / "q"))


U = np.asarray
BAD = np.full((8, 75), np.nan)


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ({}, None), ({"fps": None}, "fields"), ({"more": U(1)}, "fields"), ({"fps": U([20.0, 20.0])}, "scalar"), ({"sequence_id": U(3)}, "scalar"), ({"valid_frames": U("6")}, "scalar"), ({"g1_features": np.zeros((8, 74))}, "shape"),
        ({"human_mask": np.ones(8)}, "shape"), ({"anchor_basis": np.zeros(9)}, "shape"), ({"valid_frames": U(4)}, "frames"), ({"valid_frames": U(0)}, "frames"), ({"g1_features": BAD}, "nonfinite"), ({"g1_mask": np.ones(8, bool)}, "mask"),
        ({"human_mask": np.ones(8, bool), "g1_mask": np.ones(8, bool)}, "mask"), ({"fps": U(30.0)}, "fps"), ({"target_fps": U(30.0)}, "fps"), ({"source_fps": U(np.inf)}, "source_fps"), ({"source_format": U("pickle")}, "source_format"),
        ({"g1_features": BAD, "fps": U(30.0)}, "nonfinite"),
    ],
)
def test_the_first_broken_rule_is_the_reason(changes, reason):
    assert prepared.decode(archive(**changes))[0] == reason


def test_what_is_no_archive_is_refused():
    whole, bare = archive(), io.BytesIO()
    np.save(bare, np.zeros(3))
    pickled = io.BytesIO()
    np.savez(pickled, **{k: U([object()], dtype=object) if k == "fps" else U(1) for k in prepared.MEMBERS})
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 255
    for content in (b"", b"text", whole[: len(whole) // 2], bare.getvalue(), pickled.getvalue()):
        assert prepared.decode(content) == ("unreadable", {})
    assert prepared.decode(bytes(flipped))[0] is not None


def test_a_damaged_file_does_not_fail_the_other_loaders(spark, tmp_path):
    good = io.BytesIO()
    np.savez_compressed(good, joints=np.arange(6.0))
    (tmp_path / "good.npz").write_bytes(good.getvalue())
    (tmp_path / "cut.npz").write_bytes(good.getvalue()[:60])
    (tmp_path / "empty.npz").write_bytes(b"PK")
    got = {r.path.rsplit("/", 1)[-1]: r.arrays for r in containers.npz_containers(spark, str(tmp_path)).collect()}
    assert got == {"good.npz": {"joints": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]}, "cut.npz": {}, "empty.npz": {}}
    assert motion._half(good.getvalue()[:60], "actor")[3] == "unreadable"
