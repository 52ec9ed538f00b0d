"""What runs in each mode: fast within deep within forensic."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Mode(NamedTuple):
    name: str
    detectors: frozenset[str]
    transforms: frozenset[str]


def _named(prefix: str, names: str) -> frozenset[str]:
    return frozenset(prefix + n for n in names.split())


ANGLES = tuple(range(30, 360, 30))
_VIEWS = "canonical_lossless canonical_lossy flattened_white flattened_black grayscale red-channel green-channel blue-channel alpha-channel alpha-amplified ocr-small-3x white-text-extract bg-normalised sharpen-contrast clahe deskew"
_BOTTOM = " ".join(f"bottom-region{contrast}{size}" for contrast in ("", "-contrast") for size in ("", "-2x", "-3x"))
_LIGHT = " ".join(f"light-text-tophat{wide}{size}" for wide in ("", "-wide") for size in ("", "-2x"))
_DIFFERENCES = " ".join(f"{pair}-difference{hi}" for pair in ("rg", "rb", "gb") for hi in ("", "-hi"))
_TURNS = " ".join(f"rotation-candidate-{a}" for a in ANGLES)

FAST = Mode(
    "fast",
    _named("detector:", "metadata-builtin exiftool tesseract qr-pyzbar prompt-rules semantic-scorer malware-clamav malware-yara embedded-binwalk privacy-rules phishing-rules visible-watermark-rules steganalysis-statistics vlm-caption"),
    _named("", f"{_VIEWS} {_BOTTOM} {_LIGHT} {_DIFFERENCES} {_TURNS}"),
)
DEEP = Mode("deep", FAST.detectors | _named("detector:", "easyocr decoder-differential trailing-bytes release-candidate-validation"), FAST.transforms | _named("", "otsu-threshold inverted-grayscale 2x-enlargement"))
FORENSIC = Mode("forensic", DEEP.detectors | _named("detector:", "zsteg c2pa adversarial-stability redaction-analysis watermark-registry paddleocr"), DEEP.transforms)
MODES = {m.name: m for m in (FAST, DEEP, FORENSIC)}


def plan_for(name: str) -> Mode:
    if name not in MODES:
        raise ValueError(f"unknown mode {name!r}: one of {', '.join(MODES)}")
    return MODES[name]


def union(*names: str) -> Mode:
    """What runs when several modes are asked for."""
    chosen = [plan_for(n) for n in names]
    return Mode("+".join(names), frozenset().union(*(m.detectors for m in chosen)), frozenset().union(*(m.transforms for m in chosen)))


def active(rows: DataFrame, mode: Mode, detector_col: str = "detector_id") -> DataFrame:
    """The rows (executions, findings) of detectors that run in the mode."""
    return rows.where(F.col(detector_col).isin(*sorted(mode.detectors)))
