"""Prepared motion: one archive for each aligned pair, written and read on executors under one strict contract.

An archive is a deflated .npz without pickles that has just the members of `MEMBERS`. Features and tracks of both sides are padded to whole tokens with their last
frame; robot values pass through single precision before they are stored in double. Reading states the first rule that an archive breaks, in the order of `RULES`:

    unreadable     no archive, a damaged member, or one that would need a pickle
    fields         a member is missing or unexpected
    scalar         a member that should hold one value does not, or holds none of its type
    shape          widths, or numbers of frames that differ between members
    frames         no frames, a part of a token, or valid_frames that does not fit
    nonfinite      a feature that is not finite
    mask           masks that differ, or are not set for just the valid frames
    fps            a rate other than 20
    source_fps     not finite or not positive
    source_format  neither safe_npz nor trusted_pickle

A pair is a row, and its archive one value of a row, so nothing is shuffled. Pairs are encoded and decoded one at a time, as NumPy arrays over Arrow's buffers, and leave the worker in batches of
about `SLICE` bytes: what a worker holds depends on the longest pair, not on how many pairs come to it.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow import constants as C

#: Widths of the frame members, and the other members.
WIDTHS = {"human_features": C.HUMAN_WIDTH, "g1_features": C.G1_WIDTH, "human_space": 3, "g1_space": 3}
SCALARS = ["sequence_id", "fps", "source_fps", "source_format", "target_fps", "valid_frames"]
MEMBERS = {*WIDTHS, "human_mask", "g1_mask", "anchor_origin", "anchor_basis", *SCALARS}
FORMATS = ("safe_npz", "trusted_pickle")
RULES = ["unreadable", "fields", "scalar", "shape", "frames", "nonfinite", "mask", "fps", "source_fps", "source_format"]

FLAT = ", ".join(f"{k} array<{'float' if k.startswith('human') else 'double'}>" for k in WIDTHS)
LOADED = f"sequence_id string, reason string, valid_frames int, frames int, source_fps double, source_format string, {FLAT}, frame_mask array<boolean>, anchor_origin array<double>, anchor_basis array<double>"
ARCHIVE_ERRORS = (ValueError, OSError, KeyError, EOFError, zipfile.BadZipFile, zlib.error, NotImplementedError, AttributeError, TypeError)
#: Bytes of archives or frames after which a worker hands on a batch.
SLICE = 8 << 20


def padded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames with the last one repeated to whole tokens, and the mask of the real ones."""
    more = -len(values) % C.FRAMES_PER_TOKEN
    return np.concatenate([values, np.repeat(values[-1:], more, 0)]), np.arange(len(values) + more) < len(values)


def encode(sequence_id: str, tracks: dict[str, np.ndarray], origin: np.ndarray, basis: np.ndarray, source_fps: float, source_format: str) -> bytes:
    """The archive of unpadded frame members."""
    members: dict[str, object] = {"sequence_id": sequence_id, "fps": float(C.TARGET_FPS), "source_fps": float(source_fps), "source_format": source_format, "target_fps": float(C.TARGET_FPS), "valid_frames": np.int64(len(tracks["g1_features"]))}
    for name, values in tracks.items():
        frames, mask = padded(values.astype(np.float32))
        side = name.split("_")[0]
        members |= {name: frames.astype(np.float64) if side == "g1" else frames, f"{side}_mask": mask}
    out = io.BytesIO()
    np.savez_compressed(out, anchor_origin=origin, anchor_basis=basis, **{k: np.asarray(v) for k, v in members.items()})
    return out.getvalue()


def decode(content: bytes) -> tuple[str | None, dict]:
    """(reason, members) of an archive."""
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            if set(z.files) != MEMBERS:
                return "fields", {}
            data = {k: z[k] for k in z.files}
    except ARCHIVE_ERRORS:  # the last two are of a bare array, which is no archive
        return "unreadable", {}
    numbers = [data[k] for k in SCALARS if k not in ("sequence_id", "source_format")]
    if any(data[k].size != 1 for k in SCALARS) or any(x.dtype.kind not in "iuf" for x in numbers) or any(data[k].dtype.kind != "U" for k in ("sequence_id", "source_format")):
        return "scalar", {}
    frames, valid = len(data["human_mask"]) if data["human_mask"].ndim == 1 else -1, int(data["valid_frames"].item())
    masks = [data[f"{s}_mask"] for s in ("human", "g1")]
    basis_fits = data["anchor_origin"].shape == (3,) and data["anchor_basis"].shape == (3, 3)
    if not basis_fits or any(data[k].shape != (frames, w) for k, w in WIDTHS.items()) or any(m.shape != (frames,) or m.dtype != np.bool_ for m in masks):
        return "shape", {}
    if frames <= 0 or frames % C.FRAMES_PER_TOKEN or not 0 < valid <= frames or frames != valid + -valid % C.FRAMES_PER_TOKEN:
        return "frames", {}
    if not all(np.isfinite(data[k]).all() for k in ("human_features", "g1_features")):
        return "nonfinite", {}
    if any((m != (np.arange(frames) < valid)).any() for m in masks):
        return "mask", {}
    if float(data["fps"].item()) != C.TARGET_FPS or float(data["target_fps"].item()) != C.TARGET_FPS:
        return "fps", {}
    source = float(data["source_fps"].item())
    if not np.isfinite(source) or source <= 0:
        return "source_fps", {}
    return (None if data["source_format"].item() in FORMATS else "source_format"), data


def archives(pairs: DataFrame) -> DataFrame:
    """(sequence_id, content) of pairs: sequence_id, source_fps, source_format, the four frame members (flat, row-major, not padded), anchor_origin and anchor_basis (flat)."""
    columns = ["sequence_id", "source_fps", "source_format", *WIDTHS, "anchor_origin", "anchor_basis"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {k: batch.column(k) for k in columns}
            made, first, size = [], 0, 0
            for i in range(batch.num_rows):
                values = {k: _numbers(held[k], i) for k in (*WIDTHS, "anchor_origin", "anchor_basis")}
                tracks = {k: values[k].reshape(-1, w) for k, w in WIDTHS.items()}
                made.append(encode(held["sequence_id"][i].as_py(), tracks, values["anchor_origin"], values["anchor_basis"].reshape(3, 3), held["source_fps"][i].as_py(), held["source_format"][i].as_py()))
                size += len(made[-1])
                if i + 1 == batch.num_rows or size >= SLICE:
                    yield pa.RecordBatch.from_arrays([held["sequence_id"].slice(first, len(made)), pa.array(made, pa.binary())], ["sequence_id", "content"])
                    made, first, size = [], i + 1, 0

    return pairs.select(*columns).mapInArrow(run, "sequence_id string, content binary")


def _numbers(column: pa.Array, i: int) -> np.ndarray:
    """Row i of a column of arrays, without a Python object for each value; NaN for nulls."""
    return column[i].values.to_numpy(zero_copy_only=False).astype(float)


def _row(name: str | None, content: bytes | None) -> tuple:
    """The values of LOADED for an archive."""
    reason, d = decode(content if content is not None else b"")
    if reason:
        return (name, reason, *[None] * 11)
    tracks = [d[k].astype(np.float32 if k.startswith("human") else np.float64).ravel() for k in WIDTHS]
    scalars = int(d["valid_frames"].item()), len(d["human_mask"]), float(d["source_fps"].item()), str(d["source_format"].item())
    return (str(d["sequence_id"].item()), None, *scalars, *tracks, d["human_mask"], d["anchor_origin"].astype(float), d["anchor_basis"].astype(float).ravel())


def load(contents: DataFrame) -> DataFrame:
    """LOADED of (sequence_id, content), such as `archives` gives or Spark's binaryFile reads: an archive's members, flat, or the reason why it is refused.

    The sequence_id of an archive that is read is its own; a refused one keeps that of its row.
    """
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}
    names = {k: kinds[kind] for k, kind in (c.split(" ") for c in LOADED.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), names.values(), strict=True)], [*names])

        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                rows.append(_row(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                size += sum(x.nbytes for x in rows[-1] if isinstance(x, np.ndarray)) + 200
                if size >= SLICE:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    return contents.select("sequence_id", "content").mapInArrow(run, LOADED)


def write(pairs: DataFrame, path: str) -> None:
    """Archives as a Parquet table of (sequence_id, content), which Spark can put into any store; an existing one fails, and so does a sequence_id that is blank or repeated."""
    made = archives(pairs)
    ids = pairs.groupBy("sequence_id").count()
    if not ids.where("count > 1 OR sequence_id IS NULL OR trim(sequence_id) = ''").isEmpty():
        raise ValueError("sequence_id has to be unique and not blank")
    made.write.mode("errorifexists").parquet(path)


def selected(loaded: DataFrame, sequence_id: str) -> DataFrame:
    """The one sequence that a job asks for; none, several or a refused one raises."""
    own = loaded.where(F.col("sequence_id") == sequence_id)
    found = [r.reason for r in own.select("reason").limit(2).collect()]
    if len(found) != 1 or found[0]:
        raise ValueError(f"{sequence_id}: " + (f"refused, {found[0]}" if len(found) == 1 else "several sequences" if found else "no such sequence"))
    return own
