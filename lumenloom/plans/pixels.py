"""Jobs that touch pixels. Each is one mapInPandas over Arrow batches: pixels go
in once and leave as a table. Joins happen on ids before or beside the pixels.

Set ``spark.sql.execution.arrow.maxRecordsPerBatch`` to 8-64 for big images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import pixels as P
from lumenloom.functions.hashing import primary_method, secondary_method
from lumenloom.functions.tags import display_name, stem, thumbnail_key
from lumenloom.params import THUMB_QUALITY, THUMB_SIDE, SimilarityOptions
from lumenloom.runtime import broadcast_if_small

MODEL_SIDE = 448
LETTERBOX_SIDE = 512
PIECE = 64  # finished images handed on at a time
TENSOR_BYTES = 32 << 20


def _rgb(image: dict | None) -> np.ndarray:
    """RGB pixels of an image struct."""
    if image is None:
        raise ValueError("no pixels")
    if image["width"] is None or image["width"] <= 0:
        raise ValueError("cannot decode image")
    return P.from_spark_image(image["height"], image["width"], image["nChannels"], image["data"])


def _with_image(df: DataFrame) -> DataFrame:
    """Only the fields of the image struct that are used; rows without one get an error later."""
    return df.withColumn("image", F.when(F.col("image").isNotNull(), F.struct("image.height", "image.width", "image.nChannels", "image.data")))


def per_image(df: DataFrame, keep: list[str], schema: str, work: Callable[[pd.Series, np.ndarray], tuple]) -> DataFrame:
    """Run ``work`` on the RGB pixels of every row; failures become rows with ``error``.

    ``schema`` names the columns ``work`` returns, in order.
    """
    src = _with_image(df).select(*dict.fromkeys([*keep, "image"]))
    kept_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema)
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                if len(rows) >= PIECE:
                    yield pd.DataFrame(rows, columns=[*keep, *names, "error"], dtype=object)
                    rows = []
                r = row._asdict()
                image = r["image"]
                if image is not None and not isinstance(image, dict):
                    image = image.asDict()
                try:
                    out, error = work(r, _rgb(image)), None
                except Exception as e:  # noqa: BLE001 - one bad image must not stop the job
                    out, error = (None,) * len(names), f"{type(e).__name__}: {e}"
                rows.append([*[r[k] for k in keep], *out, error])
            yield pd.DataFrame(rows, columns=[*keep, *names, "error"], dtype=object)

    return src.mapInPandas(run, f"{kept_fields}, {schema}, error string")


def fingerprints(images: DataFrame, o: SimilarityOptions = SimilarityOptions()) -> DataFrame:
    """One decode per image (image_id, uri): both hashes, colour signature, size."""
    first, second = primary_method(o.method), secondary_method(o.method)
    dual, color = o.require_dual_hash, o.color_distance_max is not None

    def work(_: pd.Series, rgb: np.ndarray) -> tuple:
        h, w = rgb.shape[:2]
        return (
            P.image_hash(rgb, first),
            P.image_hash(rgb, second) if dual else None,
            P.color_bins(rgb).tolist() if color else None,
            w / max(1, h),
            w,
            h,
        )

    out = per_image(images, ["image_id", "uri"], "h1 bigint, h2 bigint, color array<double>, aspect double, width int, height int", work)
    return out.withColumn("name", display_name(F.col("uri")))


def render(images: DataFrame, plan: DataFrame, keep: list[str]) -> DataFrame:
    """Cut, resize and encode every planned file (image_id, cut, out_w, out_h, action).

    ``resize`` is plain Lanczos, ``downsample`` works in linear light, everything
    else copies pixels. A small plan is broadcast so pixels are never shuffled.
    """
    needed = plan.select(*dict.fromkeys(["image_id", *keep, "out_w", "out_h", "action"]), F.col("cut.x").alias("cx"), F.col("cut.y").alias("cy"), F.col("cut.w").alias("cw"), F.col("cut.h").alias("ch"))
    joined = images.select("image_id", "image").join(broadcast_if_small(needed, 100_000), "image_id")

    def work(r: dict, rgb: np.ndarray) -> tuple:
        cut = P.crop(rgb, int(r["cx"]), int(r["cy"]), int(r["cw"]), int(r["ch"]))
        size = (int(r["out_w"]), int(r["out_h"]))
        if cut.shape[0] <= 0 or cut.shape[1] <= 0:
            raise ValueError("empty crop")
        if r["action"] == "resize":
            cut = P.resize(cut, size)
        elif r["action"] == "downsample":
            cut = P.shrink_in_linear_light(cut, size)
        if cut.shape[:2] != (size[1], size[0]):
            raise ValueError(f"crop is {cut.shape[1]}x{cut.shape[0]}, planned {size[0]}x{size[1]}")
        return (P.encode_png(np.ascontiguousarray(cut)),)

    cols = list(dict.fromkeys([*keep, "out_w", "out_h", "action"]))
    return per_image(joined, ["image_id", *[c for c in cols if c != "image_id"], "cx", "cy", "cw", "ch"], "png binary", work)


def render_textures(images: DataFrame, plan: DataFrame, keep: list[str]) -> DataFrame:
    """Native pixels of planned texture crops; a size mismatch is an error row."""
    native = plan.where("status = 'ok'").withColumns({"cut": F.col("snap"), "out_w": F.col("snap.w"), "out_h": F.col("snap.h"), "action": F.lit("native")})
    return render(images, native, keep)


def thumbnail_size(w: int, h: int, side: int) -> tuple[int, int]:
    """Within side x side: the longer edge becomes ``side``, the other the whole number whose ratio is nearest."""
    if max(w, h) <= side:
        return w, h
    if w > h:
        low = side * h // w
        return side, max(1, min((low, low + 1), key=lambda n: abs(Fraction(w, h) - Fraction(side, n)) if n else Fraction(0)))
    low = side * w // h
    return max(1, min((low, low + 1), key=lambda n: abs(Fraction(w, h) - Fraction(n, side)))), side


def thumbnails(images: DataFrame, existing: DataFrame | None = None, side: int = THUMB_SIDE, quality: int = THUMB_QUALITY) -> DataFrame:
    """Missing thumbnails (thumb_key, png) of images (uri, mtime, pixels).

    Keys that exist are anti-joined away before any pixel is decoded.
    """
    keyed = images.withColumn("thumb_key", thumbnail_key(F.col("uri"), F.unix_seconds("mtime"), side, quality))
    if existing is not None:
        keyed = keyed.join(existing.select("thumb_key"), "thumb_key", "left_anti")

    def work(_: pd.Series, rgb: np.ndarray) -> tuple:
        h, w = rgb.shape[:2]
        return (P.encode_png(P.resize(rgb, thumbnail_size(w, h, side))),)

    return per_image(keyed, ["uri", "thumb_key"], "png binary", work)


def frame_thumbnails(frames: DataFrame, side: int = 512) -> DataFrame:
    """Previews of frames (video_id, frame_idx, pixels), averaged down by area."""

    def work(_: pd.Series, rgb: np.ndarray) -> tuple:
        h, w = rgb.shape[:2]
        scale = min(1.0, side / max(h, w))
        size = (max(1, int(w * scale)), max(1, int(h * scale))) if scale < 1 else (w, h)
        return (P.encode_png(P.resize_area(rgb, size)),)

    return per_image(frames, ["video_id", "frame_idx"], "png binary", work)


def squared_input(rgb: np.ndarray, side: int = MODEL_SIDE, layout: str = "NHWC") -> np.ndarray:
    """White square, averaged down, BGR; NCHW inputs are scaled to 0..1."""
    h, w = rgb.shape[:2]
    edge = max(h, w, side)
    canvas = np.full((edge, edge, 3), 255, np.uint8)
    top, left = (edge - h) // 2, (edge - w) // 2
    canvas[top : top + h, left : left + w] = rgb[:, :, ::-1]
    small = P.resize_area(canvas, (side, side)).astype(np.float32)
    return small.transpose(2, 0, 1) / np.float32(255.0) if layout == "NCHW" else small


def letterboxed_input(rgb: np.ndarray, side: int = LETTERBOX_SIDE) -> np.ndarray:
    """Channels first: the picture centred on black, each channel centred and scaled by fixed statistics."""
    longest = max(rgb.shape[:2])
    tall, wide = (max(1, int(n * (side / longest))) for n in rgb.shape[:2])
    top, left = (side - tall) // 2, (side - wide) // 2
    picture = P.resize(rgb, (wide, tall)).astype(np.float32) / np.float32(255)
    tensor = np.empty((3, side, side), np.float32)
    for channel, mean, spread in zip(range(3), P.IMAGENET_MEAN, P.IMAGENET_STD):
        tensor[channel] = np.float32(-mean) / np.float32(spread)
        tensor[channel, top : top + tall, left : left + wide] = (picture[:, :, channel] - np.float32(mean)) / np.float32(spread)
    return tensor


INPUTS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "square": lambda rgb, side: squared_input(rgb, side),
    "square_nchw": lambda rgb, side: squared_input(rgb, side, "NCHW"),
    "letterbox": letterboxed_input,
}


def model_inputs(images: DataFrame, kind: str = "square", side: int = MODEL_SIDE) -> DataFrame:
    """Input tensors, flattened row-major: (image_id, tensor, error).

    Tensors leave a task as flat buffers of about ``TENSOR_BYTES``, never as lists of numbers.
    """
    make = INPUTS[kind]
    step = max(1, TENSOR_BYTES // (12 * side * side))
    src = _with_image(images).select("image_id", "image")
    kept = src.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                tensors, errors = [], []
                for image in part.column(1).to_pylist():
                    try:
                        tensors.append(np.ascontiguousarray(make(_rgb(image), side), np.float32).ravel())
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001 - one bad image must not stop the job
                        tensors.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                sizes = [0 if t is None else len(t) for t in tensors]
                ends = pa.array([None if t is None else int(n) for t, n in zip(tensors, np.cumsum([0, *sizes[:-1]]))] + [sum(sizes)], pa.int32())
                flat = np.concatenate([np.zeros(0, np.float32), *[t for t in tensors if t is not None]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(errors, pa.string())], names=["image_id", "tensor", "error"])

    return src.mapInArrow(run, f"image_id {kept}, tensor array<float>, error string")


def pick_output(names: list[str]) -> str:
    """A refined output first, then one named logit or output, then the last."""
    refined = [n for n in names if "refined" in n.lower()]
    plain = [n for n in names if "logit" in n.lower() or "output" in n.lower()]
    return (refined or plain or names[-1:])[0]


def onnx_scorer(model: bytes, kind: str = "square", side: int = MODEL_SIDE, batch: int = 8, choose_output: bool = True) -> Callable[[DataFrame], DataFrame]:
    """A scorer DataFrame -> (image_id, logits, error): one model session per task.

    The model travels once per executor as a broadcast. A bad image is its own
    error row; a failing batch is scored again image by image.
    """
    make = INPUTS[kind]

    def score(images: DataFrame) -> DataFrame:
        shared = images.sparkSession.sparkContext.broadcast(model)
        src = _with_image(images).select("image_id", "image")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import onnxruntime as ort

            opts = ort.SessionOptions()
            opts.intra_op_num_threads = 1
            session = ort.InferenceSession(shared.value, opts, providers=["CPUExecutionProvider"])
            source = session.get_inputs()[0].name
            outputs = [o.name for o in session.get_outputs()]
            target = pick_output(outputs) if choose_output else outputs[0]

            def infer(tensors: list[np.ndarray]) -> np.ndarray:
                return session.run([target], {source: np.stack(tensors)})[0].reshape(len(tensors), -1)

            for pdf in batches:
                for start in range(0, len(pdf), batch):
                    part = pdf.iloc[start : start + batch]
                    ids, tensors, rows = [], [], []
                    for r in part.to_dict("records"):
                        image = r["image"]
                        image = image if image is None or isinstance(image, dict) else image.asDict()
                        try:
                            tensors.append(make(_rgb(image), side))
                            ids.append(r["image_id"])
                        except Exception as e:  # noqa: BLE001
                            rows.append((r["image_id"], None, f"open: {e}"))
                    try:
                        rows += [(i, v.tolist(), None) for i, v in zip(ids, infer(tensors))] if ids else []
                    except Exception:  # noqa: BLE001
                        for i, t in zip(ids, tensors):
                            try:
                                rows.append((i, infer([t])[0].tolist(), None))
                            except Exception as e:  # noqa: BLE001
                                rows.append((i, None, f"inference: {e}"))
                    yield pd.DataFrame(rows, columns=["image_id", "logits", "error"])

        return src.mapInPandas(run, "image_id bigint, logits array<float>, error string")

    return score


def caption_key(images: DataFrame) -> DataFrame:
    return images.withColumn("uri_stem", stem(F.col("uri")))
