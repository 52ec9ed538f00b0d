"""The views of an image that detectors look at: one row of pixels in, a row for each view out.

Pictures come as rows (scan_id, artifact_id, width, height, pixels: four bytes for each pixel), from
``pixels_of`` for PNG files or from another decoder. An image is one row's work, in Arrow batches, so views are
made where the picture is and nothing is shuffled. Views: ``plans.modes`` names those of each mode. Lossy
ones need a JPEG encoder, which isn't there (``canonical_lossy`` is given as unsupported). The blur is a true
Gaussian and the skew comes from the lines' profile, so those two views differ from other tools' in some pixels.

Defined cases: a null picture or one whose pixels don't fit its size gives no views; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as X
from ..plans.modes import ANGLES, Mode

MOST_TRIPLED = 400_000
UNSUPPORTED = ("canonical_lossy",)


def _bottom(image: np.ndarray) -> np.ndarray:
    return image[max(0, int(image.shape[0] * (1.0 - 0.45))) :]


def _bottom_contrast(image: np.ndarray) -> np.ndarray:
    return X.sharpened(X.sharpness(X.contrast(X.stretched(X.grey(_bottom(image)), 1), 4.0), 2.0))


def _light(size: int, gain: float) -> Callable[[np.ndarray], np.ndarray]:
    def view(image: np.ndarray) -> np.ndarray:
        seen = np.clip(X.tophat(X.grey(image), size).astype(np.float32) * gain, 0, 255).astype(np.uint8)
        return 255 - X.over(seen, X.otsu(seen))

    return view


def _difference(a: int, b: int, sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    def view(image: np.ndarray) -> np.ndarray:
        d = image[..., a].astype(np.float32) - image[..., b].astype(np.float32)
        return X.enlarged(X.over(d, d.mean() + sigma * d.std()), 2)

    return view


def _normalised(image: np.ndarray) -> np.ndarray:
    g = X.grey(image)
    return np.clip(g / (np.rint(X.blurred(g, 25)) + 1.0) * 175, 0, 255).astype(np.uint8)


def _straight(image: np.ndarray) -> np.ndarray:
    g = X.grey(image)
    angle = X.skew(g)
    return X.equalized(X.turned(g, angle, grow=False) if abs(angle) > 0.3 else g)


def _times(view: Callable[[np.ndarray], np.ndarray], factor: int) -> Callable[[np.ndarray], np.ndarray | None]:
    """The view enlarged; three times only for few pixels."""

    def larger(image: np.ndarray) -> np.ndarray | None:
        seen = view(image)
        return X.enlarged(seen, factor) if factor < 3 or seen.shape[0] * seen.shape[1] <= MOST_TRIPLED else None

    return larger


VIEWS: dict[str, Callable[[np.ndarray], np.ndarray | None]] = {
    "canonical_lossless": lambda i: i,
    "flattened_white": lambda i: X.flattened(i, 255),
    "flattened_black": lambda i: X.flattened(i, 0),
    "grayscale": X.grey,
    "otsu-threshold": lambda i: X.over(X.grey(i), X.otsu(X.grey(i))),
    "inverted-grayscale": lambda i: 255 - X.grey(i),
    **{f"{name}-channel": lambda i, k=k: i[..., k] for k, name in enumerate(("red", "green", "blue", "alpha"))},
    "2x-enlargement": lambda i: X.enlarged(i, 2, "cubic"),
    "ocr-small-3x": _times(lambda i: i, 3),
    "bottom-region": _bottom,
    "bottom-region-2x": _times(_bottom, 2),
    "bottom-region-3x": _times(_bottom, 3),
    "bottom-region-contrast": _bottom_contrast,
    "bottom-region-contrast-2x": _times(_bottom_contrast, 2),
    "bottom-region-contrast-3x": _times(_bottom_contrast, 3),
    "white-text-extract": lambda i: X.over(255 - X.grey(i), 60),
    "light-text-tophat": _light(9, 3.0),
    "light-text-tophat-2x": _times(_light(9, 3.0), 2),
    "light-text-tophat-wide": _light(15, 1.0),
    "light-text-tophat-wide-2x": _times(_light(15, 1.0), 2),
    "bg-normalised": _normalised,
    "sharpen-contrast": lambda i: X.contrast(X.sharpness(X.grey(i), 2.0), 3.0),
    "alpha-amplified": lambda i: X.stretched(255 - X.grey(i), 2),
    "clahe": lambda i: X.equalized(X.grey(i)),
    "deskew": _straight,
    **{f"rotation-candidate-{a}": lambda i, a=a: X.turned(X.grey(i), a) for a in ANGLES},
    **{f"{n}-difference{hi}": _difference(a, b, s) for n, a, b in (("rg", 0, 1), ("rb", 0, 2), ("gb", 1, 2)) for hi, s in (("", 1.5), ("-hi", 2.0))},
}


def _view_batches(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                scan, artifact, width, height, raw = (batch.column(c)[row].as_py() for c in range(5))
                if raw is None or not width or not height or len(raw) != 4 * width * height:
                    continue
                image, out = np.frombuffer(raw, np.uint8).reshape(height, width, 4), []
                for name in names:
                    if (seen := VIEWS[name](image)) is not None and seen.size:
                        out.append((scan, artifact, name, seen.shape[1], seen.shape[0], 1 if seen.ndim == 2 else seen.shape[2], np.ascontiguousarray(seen).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["scan_id", "derived_from", "role", "width", "height", "channels", "pixels"])

    return run


def views(pictures: DataFrame, mode: Mode) -> DataFrame:
    """(scan_id, artifact_id, derived_from, role, width, height, channels, pixels): a row for each view of the mode."""
    rows = pictures.select(F.col("scan_id").cast("string"), F.col("artifact_id").cast("string"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels")
    got = rows.mapInArrow(_view_batches([v for v in VIEWS if v in mode.transforms]), "scan_id string, derived_from string, role string, width int, height int, channels int, pixels binary")
    return got.select("scan_id", F.concat(F.lit("artifact:"), "scan_id", F.lit(":"), "role").alias("artifact_id"), "derived_from", "role", "width", "height", "channels", "pixels")


def unsupported_views(scans: DataFrame, mode: Mode) -> DataFrame:
    """(scan_id, role, state): the views of the mode that can't be made here."""
    return scans.select("scan_id", F.explode(F.array(*(F.lit(v) for v in UNSUPPORTED if v in mode.transforms))).alias("role"), F.lit("UNSUPPORTED").alias("state"))


def _pixel_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            image = X.read_png(one.column(2)[0].as_py() or b"")
            shape, raw = ((None, None), None) if image is None else (image.shape, image.tobytes())
            yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([shape[1]], pa.int32()), pa.array([shape[0]], pa.int32()), pa.array([raw], pa.binary())], ["scan_id", "artifact_id", "width", "height", "pixels"])


def pixels_of(files: DataFrame) -> DataFrame:
    """(scan_id, artifact_id, width, height, pixels) of (scan_id, artifact_id, content): decoded PNG files; nulls where the content isn't one that can be read."""
    rows = files.select(F.col("scan_id").cast("string"), F.col("artifact_id").cast("string"), "content")
    return rows.mapInArrow(_pixel_batches, "scan_id string, artifact_id string, width int, height int, pixels binary")


def _png_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            artifact, width, height, channels, raw = (batch.column(c)[row].as_py() for c in range(5))
            yield pa.RecordBatch.from_arrays([pa.array([artifact]), pa.array([X.png_bytes(np.frombuffer(raw, np.uint8).reshape(height, width, channels))], pa.binary())], ["artifact_id", "content"])


def encoded(seen: DataFrame) -> DataFrame:
    """(artifact_id, content): views as PNG files."""
    return seen.select("artifact_id", "width", "height", "channels", "pixels").mapInArrow(_png_batches, "artifact_id string, content binary")
