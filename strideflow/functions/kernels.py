"""Matrix-valued kernels of one sequence, in NumPy, for applyInPandas: what column expressions cannot express well.

The human kernels compute in float32 with scalar-first quaternions, as the stored features demand; the robot kernels in float64.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np

#: Rest direction of each of the 22 joints from its parent, the chains of joints, and the feet.
REST_DIRECTIONS = [
    (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, -1, 0), (0, 1, 0), (0, -1, 0), (0, -1, 0), (0, 1, 0), (0, 0, 1),
    (0, 0, 1), (0, 1, 0), (1, 0, 0), (-1, 0, 0), (0, 0, 1), (0, -1, 0), (0, -1, 0), (0, -1, 0), (0, -1, 0), (0, -1, 0), (0, -1, 0),
]
CHAINS = ((0, 2, 5, 8, 11), (0, 1, 4, 7, 10), (0, 3, 6, 9, 12, 15), (9, 14, 17, 19, 21), (9, 13, 16, 18, 20))
RIGHT_HIP, LEFT_HIP, RIGHT_SHOULDER, LEFT_SHOULDER = 2, 1, 17, 16
FEET = [7, 10, 8, 11]
SMOOTHING = 20.0

F4 = np.float32


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(-1, keepdims=True))


def hamilton(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quaternion product, scalar first: real parts and vector parts apart."""
    s, v = a[..., :1], a[..., 1:]
    t, u = b[..., :1], b[..., 1:]
    real = s * t - (v * u).sum(-1, keepdims=True)
    return np.concatenate([real, s * u + t * v + np.cross(v, u)], -1)


def conjugate(q: np.ndarray) -> np.ndarray:
    return q * np.array([1, -1, -1, -1], q.dtype)


def turn(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """v rotated by q."""
    t = 2 * np.cross(q[..., 1:], v)
    return v + q[..., :1] * t + np.cross(q[..., 1:], t)


def arc(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation from direction a to direction b by the half-way rule; undefined (NaN) for opposite ones."""
    real = np.sqrt((a * a).sum(-1, keepdims=True) * (b * b).sum(-1, keepdims=True)) + (a * b).sum(-1, keepdims=True)
    return _unit(np.concatenate([real, np.cross(a, b)], -1))


def smooth(values: np.ndarray, sigma: float = SMOOTHING) -> np.ndarray:
    """Gaussian filter along time to four deviations, with edge values repeated."""
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights = (weights / weights.sum()).astype(values.dtype)
    padded = np.pad(values, ((radius, radius), (0, 0)), mode="edge")
    return np.stack([np.convolve(c, weights, mode="valid") for c in padded.T], 1).astype(values.dtype)


def facing(joints: np.ndarray) -> np.ndarray:
    """Unit facing of each frame from the hips: up crossed with right minus left."""
    across = joints[:, RIGHT_HIP] - joints[:, LEFT_HIP]
    if (np.linalg.norm(across, axis=1) <= np.finfo(F4).eps).any():
        raise ValueError("hip direction must be non-degenerate")
    return _unit(np.cross(np.array([0, 1, 0], joints.dtype), _unit(across)))


def joint_rotations(joints: np.ndarray) -> np.ndarray:
    """Local rotation of each joint (T, 22, 4): along each chain, the turn from the rest direction to the bone, relative to the parent.

    The root's facing mixes hips (left minus right) with shoulders (right minus left) and is smoothed; the first frame is not turned.
    """
    p = np.asarray(joints, F4)
    across = _unit(p[:, LEFT_HIP] - p[:, RIGHT_HIP] + p[:, RIGHT_SHOULDER] - p[:, LEFT_SHOULDER])
    forward = _unit(smooth(np.cross(np.array([0, 1, 0], F4), across)))
    root = arc(forward, np.broadcast_to(np.array([0, 0, 1], F4), forward.shape))
    root[0] = (1, 0, 0, 0)
    out = np.zeros((*p.shape[:2], 4), F4)
    out[:, 0] = root
    for chain in CHAINS:
        world = root
        for parent, child in zip(chain[:-1], chain[1:], strict=True):
            rest = np.broadcast_to(np.array(REST_DIRECTIONS[child], F4), (len(p), 3))
            local = hamilton(conjugate(world), arc(rest, _unit(p[:, child] - p[:, parent])))
            out[:, child] = local
            world = hamilton(world, local)
    return out


def rotation_columns(q: np.ndarray) -> np.ndarray:
    """The images of the x and y axes, (…, 6)."""
    x = turn(_unit(q), np.broadcast_to(np.array([1, 0, 0], q.dtype), (*q.shape[:-1], 3)))
    y = turn(_unit(q), np.broadcast_to(np.array([0, 1, 0], q.dtype), (*q.shape[:-1], 3)))
    return np.concatenate([x, y], -1)


def place_human(joints: np.ndarray) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Joints on the floor, with the first root over the origin and facing +z; and (x, z, yaw) that this took away."""
    p = np.asarray(joints, F4).copy()
    p[..., 1] -= p[..., 1].min()
    x, z = float(p[0, 0, 0]), float(p[0, 0, 2])
    ahead = facing(p[:1])
    p -= np.array([x, 0, z], F4)
    q = arc(ahead, np.array([[0, 0, 1]], F4))
    return turn(np.broadcast_to(q, (*p.shape[:2], 4)), p).astype(F4), (x, z, float(np.arctan2(ahead[0, 2], ahead[0, 0])))


def unplace_human(joints: np.ndarray, state: tuple[float, float, float]) -> np.ndarray:
    """The inverse of place_human, but for the floor height."""
    x, z, yaw = state
    q = arc(np.array([[0, 0, 1]], F4), np.array([[np.cos(yaw), 0, np.sin(yaw)]], F4))
    p = np.asarray(joints, F4)
    return turn(np.broadcast_to(q, (*p.shape[:2], 4)), p) + np.array([x, 0, z], F4)


def human_features(joints: np.ndarray, foot_threshold: float = 0.002) -> np.ndarray:
    """(T, 262): positions, displacement to the next frame, rotations of 21 joints, contacts of four foot joints; tails repeat."""
    p = np.asarray(joints, F4)
    if p.ndim != 3 or p.shape[1:] != (22, 3) or len(p) < 2 or not np.isfinite(p).all():
        raise ValueError("joints have to be two finite frames of 22 x 3 at least")
    step = p[1:] - p[:-1]
    still = ((step[:, FEET] ** 2).sum(-1) < foot_threshold).astype(F4)
    last = lambda a: np.concatenate([a, a[-1:]])
    t = len(p)
    return np.concatenate([p.reshape(t, 66), last(step).reshape(t, 66), rotation_columns(joint_rotations(p))[:, 1:].reshape(t, 126), last(still)], 1)


def human_positions(features: np.ndarray) -> np.ndarray:
    return np.asarray(features, F4)[..., :66].reshape(*np.shape(features)[:-1], 22, 3)


# ---- robot, scalar last, float64


def matrices(q: np.ndarray) -> np.ndarray:
    """Rotation matrices of unit (x, y, z, w) quaternions: the images of the axes as columns."""
    q = np.asarray(q, float)
    first = np.concatenate([q[..., 3:], q[..., :3]], -1)
    return np.stack([turn(first, np.broadcast_to(axis, (*q.shape[:-1], 3))) for axis in np.eye(3)], -1)


def quaternions(m: np.ndarray) -> np.ndarray:
    """(x, y, z, w) with w >= 0 of rotation matrices: the dominant eigenvector of Bar-Itzhack's symmetric matrix."""
    m = np.asarray(m, float)
    k = np.zeros((*m.shape[:-2], 4, 4))
    trace = m[..., 0, 0] + m[..., 1, 1] + m[..., 2, 2]
    k[..., :3, :3] = m + np.swapaxes(m, -1, -2) - trace[..., None, None] * np.eye(3)
    for i, (a, b) in enumerate(((2, 1), (0, 2), (1, 0))):
        k[..., i, 3] = k[..., 3, i] = m[..., a, b] - m[..., b, a]
    k[..., 3, 3] = trace
    q = np.linalg.eigh(k)[1][..., -1]
    return np.where(q[..., 3:] < 0, -q, q)


def rotation_vectors(m: np.ndarray) -> np.ndarray:
    q = quaternions(m)
    length = np.linalg.norm(q[..., :3], axis=-1, keepdims=True)
    small = length < 1e-12
    return q[..., :3] * np.where(small, 2.0, 2 * np.arctan2(length, q[..., 3:]) / np.where(small, 1.0, length))


def gram_schmidt(six: np.ndarray) -> np.ndarray:
    """Matrices of (…, 6) column pairs."""
    x = _unit(six[..., :3])
    z = np.cross(x, six[..., 3:])
    if (np.linalg.norm(z, axis=-1) < 1e-12).any():
        raise ValueError("degenerate axes")
    z = _unit(z)
    return np.stack([x, np.cross(z, x), z], -1)


@dataclass(frozen=True)
class Anchor:
    """A frame on the floor under the first root, z along its forward direction."""

    origin: np.ndarray
    basis: np.ndarray  # columns are the axes

    @classmethod
    def of(cls, position: np.ndarray, rotation: np.ndarray) -> Anchor:
        ahead = rotation[:, 0] * (1, 0, 1)
        if np.linalg.norm(ahead) <= 1e-8:
            raise ValueError("the root's forward direction is upright")
        z = _unit(ahead)
        return cls(position * (1, 0, 1), np.stack([np.cross((0, 1, 0), z), (0.0, 1.0, 0.0), z], 1))

    def local(self, points: np.ndarray) -> np.ndarray:
        return (points - self.origin) @ self.basis

    def world(self, points: np.ndarray) -> np.ndarray:
        return points @ self.basis.T + self.origin


def robot_features(root: np.ndarray, rotation: np.ndarray, dof: np.ndarray, contact: np.ndarray, fps: float) -> tuple[np.ndarray, Anchor]:
    """(T, 75): position, rotation columns and joints in the anchored frame, causal velocities in the axes of the frame before, contacts."""
    if not (np.abs(np.linalg.norm(rotation, axis=1) - 1) <= 1e-8).all() or not np.isin(contact, (0, 1)).all() or not fps > 0:
        raise ValueError("rotations have to be unit quaternions, contacts binary and fps positive")
    m = matrices(rotation)
    anchor = Anchor.of(root[0], m[0])
    p, r = anchor.local(root), anchor.basis.T @ m
    inverse = np.swapaxes(r[:-1], -1, -2)
    zero = np.zeros((1, 3))
    linear = np.concatenate([zero, (inverse @ np.diff(p, axis=0)[..., None])[..., 0] * fps])
    angular = np.concatenate([zero, rotation_vectors(inverse @ r[1:]) * fps]) if len(p) > 1 else zero
    joints = np.concatenate([np.zeros((1, dof.shape[1])), np.diff(dof, axis=0) * fps])
    return np.concatenate([p, r[..., 0], r[..., 1], dof, linear, angular, joints, contact], 1), anchor


def robot_motion(features: np.ndarray, anchor: Anchor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Root positions, rotations (x, y, z, w), joints and contacts of features; velocities are not read."""
    r = anchor.basis @ gram_schmidt(features[:, 3:9])
    return anchor.world(features[:, :3]), quaternions(r), features[:, 9:38].copy(), features[:, 73:75].copy()


def integration_error(features: np.ndarray, fps: float) -> float:
    """How far the integral of the local velocity leaves the stored positions."""
    r = gram_schmidt(features[:, 3:9])
    step = (r[:-1] @ features[1:, 38:41, None])[..., 0] / fps
    path = features[:1, :3] + np.concatenate([np.zeros((1, 3)), np.cumsum(step, 0)])
    return float(np.linalg.norm(path - features[:, :3], axis=1).max())


def deployment_motion(features: np.ndarray, anchor: Anchor, axes: np.ndarray) -> dict[str, np.ndarray]:
    """Root, rotation, joints and axis-angle pose in z-up coordinates. axes: one row for each joint."""
    root, rotation, dof, _ = robot_motion(features, anchor)
    x, y, z, w = rotation.T
    turned = np.stack([x, -z, y, w], 1)
    pose = np.concatenate([rotation_vectors(matrices(turned))[:, None], dof[:, :, None] * np.asarray(axes, float)], 1)
    return {"root_trans_offset": np.stack([root[:, 0], -root[:, 2], root[:, 1]], 1), "root_rot": turned, "dof": dof, "pose_aa": pose}


@dataclass(frozen=True)
class BodyTree:
    """Bodies in depth-first order: name, parent, offset, rotation, joint (or -1) and its axis."""

    names: tuple[str, ...]
    parents: tuple[int, ...]
    offsets: np.ndarray
    rotations: np.ndarray
    joints: tuple[int, ...]
    axes: np.ndarray

    @classmethod
    def parse(cls, xml: str, joint_order: tuple[str, ...], root: str = "pelvis") -> BodyTree:
        """Reads a body tree; its joints have to come in the given order."""
        top = ET.fromstring(xml).find(f"worldbody/body[@name='{root}']")
        if top is None:
            raise ValueError(f"no body {root}")
        numbers = lambda e, k, d: np.array((e.get(k) or d).split(), float)
        rows, order, stack = [], [], [(top, -1)]
        while stack:
            body, parent = stack.pop()
            joint = body.find("joint")
            named = joint is not None and joint.get("name")
            if named:
                order.append(joint.get("name"))
            q = numbers(body, "quat", "1 0 0 0")
            rows.append((body.get("name", ""), parent, numbers(body, "pos", "0 0 0"), matrices(np.roll(q, -1)), len(order) - 1 if named else -1, numbers(joint, "axis", "0 0 1") if named else np.array([0.0, 0, 1])))
            stack += [(child, len(rows) - 1) for child in reversed(body.findall("body"))]
        if tuple(order) != tuple(joint_order):
            raise ValueError("joints are not in the expected order")
        names, parents, offsets, rotations, joints, axes = zip(*rows, strict=True)
        return cls(names, parents, np.array(offsets), np.array(rotations), joints, _unit(np.array(axes)))

    def positions(self, root: np.ndarray, rotation: np.ndarray, dof: np.ndarray, names: tuple[str, ...] | None = None) -> dict[str, np.ndarray]:
        """World position of each body in each frame, or of those named and the bodies above them."""
        at, turned = [np.asarray(root, float)], [matrices(rotation)]
        wanted = set(range(len(self.names))) if names is None else {self.names.index(n) for n in names}
        for k in reversed(range(1, len(self.names))):
            if k in wanted:
                wanted.add(self.parents[k])
        for k in range(1, len(self.names)):
            if k not in wanted:
                at.append(None)
                turned.append(None)
                continue
            up = self.parents[k]
            at.append(at[up] + turned[up] @ self.offsets[k])
            m = turned[up] @ self.rotations[k]
            if self.joints[k] >= 0:
                half = dof[:, self.joints[k], None] / 2
                m = m @ matrices(np.concatenate([np.sin(half) * self.axes[k], np.cos(half)], 1))
            turned.append(m)
        return {n: p for n, p in zip(self.names, at, strict=True) if p is not None}


# ---- causal convolution


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def causal_conv(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, stride: int = 1, dilation: int = 1, left: int | None = None) -> np.ndarray:
    """(T, in) to (T', out): output t reads inputs up to its own right edge. weight: (out, in, k)."""
    k = weight.shape[2]
    padded = np.pad(x, ((dilation * (k - 1) if left is None else left, 0), (0, 0)))
    n = (len(padded) - dilation * (k - 1) - 1) // stride + 1
    taps = np.arange(n)[:, None] * stride + np.arange(k) * dilation
    return np.einsum("tki,oik->to", padded[taps], weight) + bias


def residuals(x: np.ndarray, blocks: list[dict]) -> np.ndarray:
    """Blocks of two dilated convolutions (1, 3, 9) added to their input."""
    for k, b in enumerate(blocks):
        hidden = silu(causal_conv(x, *b["first"], dilation=3**k))
        x = x + causal_conv(hidden, *b["second"], dilation=3**k)
    return x


def conv_encode(features: np.ndarray, weights: dict) -> np.ndarray:
    """(T, F) to (T / 4, C): two stages of stride two, each aligned to the right edge of its group."""
    x = silu(causal_conv(features, *weights["input"]))
    for stage in weights["stages"]:
        x = residuals(causal_conv(x, *stage["down"], stride=2, left=2), stage["blocks"])
    return causal_conv(x, *weights["output"])


def conv_decode(latents: np.ndarray, weights: dict) -> np.ndarray:
    """(L, C) to (4L, F): each token is repeated to four frames, in two steps."""
    x = residuals(silu(causal_conv(latents, *weights["input"])), weights["blocks"])
    for name in ("first", "second"):
        x = silu(causal_conv(np.repeat(x, 2, axis=0), *weights[name]))
    return causal_conv(x, *weights["output"])


def receptive_field(depth: int) -> int:
    """Frames that a latent of the encoder reads at most."""
    return 20 + 24 * sum(3**k for k in range(depth))


def nearest_codes(latents: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Nearest code by squared distance, the lowest on ties."""
    d = (latents**2).sum(1, keepdims=True) - 2 * latents @ codebook.T + (codebook**2).sum(1)
    return d.argmin(1)
