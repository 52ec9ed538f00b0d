"""Image arithmetic on NumPy arrays: PNG in and out, grey values, resampling, filters, rotations.

Grey images are (height, width) arrays of bytes, others (height, width, channels).
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_bytes(image: np.ndarray) -> bytes:
    """An image of 1, 3 or 4 channels as PNG."""
    image = image[..., None] if image.ndim == 2 else image
    height, width, channels = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], 1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png(content: bytes, most_pixels: int = 50_000_000) -> np.ndarray | None:
    """(height, width, 4) of a PNG of 8 bits a channel that isn't interlaced; None for all others and for broken ones."""
    if content[:8] != _SIGNATURE:
        return None
    at, packed, palette, alpha, head = 8, [], None, None, None
    while at + 12 <= len(content):
        size = struct.unpack_from(">I", content, at)[0]
        kind, data = content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        if len(data) < size or at + 12 + size > len(content) or zlib.crc32(kind + data) != struct.unpack_from(">I", content, at + 8 + size)[0]:
            return None
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data) if size == 13 else None
        elif kind == b"PLTE" and size % 3 == 0:
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(data, np.uint8)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6] or not 0 < head[0] * head[1] <= most_pixels:
        return None
    width, height, channels = head[0], head[1], _CHANNELS[head[3]]
    need = height * (width * channels + 1)
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), need)
    except zlib.error:
        return None
    if len(raw) < need:
        return None
    lines = _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, -1), channels)
    if lines is None:
        return None
    flat = lines.reshape(height, width, channels)
    full = np.full((height, width, 1), 255, np.uint8)
    if head[3] == 3:
        if palette is None or flat.max(initial=0) >= len(palette):
            return None
        see = np.full(len(palette), 255, np.uint8)
        if alpha is not None:
            see[: len(alpha)] = alpha[: len(palette)]
        return np.concatenate([palette[flat[..., 0]], see[flat]], 2)
    if channels in (1, 2):
        return np.concatenate([np.repeat(flat[..., :1], 3, 2), flat[..., 1:] if channels == 2 else full], 2)
    return np.ascontiguousarray(flat) if channels == 4 else np.concatenate([flat, full], 2)


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray | None:
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(lines.shape[1] - 1, np.uint8)
    for y, line in enumerate(lines):
        kind, now = line[0], line[1:]
        if kind == 0:
            out[y] = now
        elif kind == 1:
            out[y] = np.add.accumulate(now.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[y] = now + above
        elif kind in (3, 4):
            row, up = [0] * step + now.tolist(), [0] * step + above.tolist()
            for x in range(step, len(row)):
                left, top, corner = row[x - step], up[x], up[x - step]
                if kind == 3:
                    guess = (left + top) // 2
                else:
                    p = left + top - corner
                    a, b, c = abs(p - left), abs(p - top), abs(p - corner)
                    guess = left if a <= b and a <= c else top if b <= c else corner
                row[x] = (row[x] + guess) & 255
            out[y] = row[step:]
        else:
            return None
        above = out[y]
    return out


# ---------------------------------------------------------------- point operations
def grey(image: np.ndarray) -> np.ndarray:
    """Luma of ITU-R 601."""
    r, g, b = (image[..., i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def bytes_of(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def otsu(g: np.ndarray) -> int:
    """The grey value that best parts dark from light: the greatest variance between the two, the least such value."""
    counts = np.bincount(g.reshape(-1), minlength=256).astype(float)
    below, mass = counts.cumsum(), (counts * np.arange(256)).cumsum()
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return 127
    between = np.where(ok, below * above * (mass / np.maximum(below, 1) - (mass[-1] - mass) / np.maximum(above, 1)) ** 2, -1)
    return int(between.argmax())


def over(g: np.ndarray, threshold: float) -> np.ndarray:
    return np.where(g > threshold, 255, 0).astype(np.uint8)


def stretched(g: np.ndarray, cut: float = 0) -> np.ndarray:
    """Grey values stretched to the whole range, without the ``cut`` per cent at each end."""
    counts = np.bincount(g.reshape(-1), minlength=256)
    drop = int(g.size * cut // 100)
    low, high = int(np.searchsorted(counts.cumsum(), drop, "right")), 255 - int(np.searchsorted(counts[::-1].cumsum(), drop, "right"))
    if high <= low:
        return g
    return np.clip((np.arange(256) - low) * (255.0 / (high - low)), 0, 255).astype(np.uint8)[g]


def contrast(g: np.ndarray, factor: float) -> np.ndarray:
    mean = int(g.mean() + 0.5)
    return np.clip(mean + factor * (g.astype(float) - mean), 0, 255).astype(np.uint8)


def flattened(image: np.ndarray, ground: int) -> np.ndarray:
    """The colours over a ground of one grey value."""
    a = image[..., 3:].astype(np.uint32)
    return ((image[..., :3] * a + ground * (255 - a) + 127) // 255).astype(np.uint8)


# ---------------------------------------------------------------- neighbourhoods
def convolved(g: np.ndarray, kernel: np.ndarray, scale: float) -> np.ndarray:
    """A 3 by 3 filter; the outermost pixels stay."""
    out = g.copy()
    if min(g.shape) < 3:
        return out
    near = np.lib.stride_tricks.sliding_window_view(g.astype(float), (3, 3))
    out[1:-1, 1:-1] = bytes_of((near * kernel).sum((2, 3)) / scale)
    return out


_SMOOTH = np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]])
_SHARP = np.array([[-2, -2, -2], [-2, 32, -2], [-2, -2, -2]])


def sharpness(g: np.ndarray, factor: float) -> np.ndarray:
    soft = convolved(g, _SMOOTH, 13).astype(float)
    return np.clip(soft + factor * (g - soft), 0, 255).astype(np.uint8)


def sharpened(g: np.ndarray) -> np.ndarray:
    return convolved(g, _SHARP, 16)


def _running(g: np.ndarray, size: int, pick, fill: int) -> np.ndarray:
    for axis in (0, 1):
        pad = [(size // 2, size // 2) if i == axis else (0, 0) for i in range(2)]
        g = pick(np.lib.stride_tricks.sliding_window_view(np.pad(g, pad, constant_values=fill), size, axis), -1)
    return g


def tophat(g: np.ndarray, size: int) -> np.ndarray:
    """What is lighter than its neighbourhood: the image less its opening by a square."""
    return g - _running(_running(g, size, np.min, 255), size, np.max, 0)


def blurred(g: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = g.astype(float)
    for axis in (0, 1):
        pad = [(reach, reach) if i == axis else (0, 0) for i in range(2)]
        out = np.apply_along_axis(np.convolve, axis, np.pad(out, pad, mode="edge"), kernel, "valid")
    return out


def equalized(g: np.ndarray, limit: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Adaptive equalization of the contrast, limited: a curve for each tile, blended between the tiles' centres."""
    height, width = g.shape
    th, tw = -(-height // tiles), -(-width // tiles)
    full = np.pad(g, ((0, th * tiles - height), (0, tw * tiles - width)), mode="reflect" if height > th * tiles - height and width > tw * tiles - width else "edge")
    curves = np.zeros((tiles, tiles, 256))
    most = max(int(limit * th * tw / 256), 1)
    for i in range(tiles):
        for j in range(tiles):
            counts = np.bincount(full[i * th : (i + 1) * th, j * tw : (j + 1) * tw].reshape(-1), minlength=256)
            spare = int(np.maximum(counts - most, 0).sum())
            counts = np.minimum(counts, most) + spare // 256
            rest = spare % 256
            if rest:
                counts[:: max(256 // rest, 1)][:rest] += 1
            curves[i, j] = np.clip(np.rint(counts.cumsum() * 255.0 / (th * tw)), 0, 255)
    y, x = (np.arange(height) + 0.0) / th - 0.5, (np.arange(width) + 0.0) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda a, b: curves[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None], g]
    return bytes_of((at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy)


# ---------------------------------------------------------------- geometry
def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


@cache
def _weights(n: int, factor: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    kernel, reach = {"cubic": (_cubic, 2), "lanczos": (_lanczos, 3)}[kind]
    centre = (np.arange(n * factor) + 0.5) / factor
    first = np.floor(centre - reach + 0.5).astype(int)
    at = first[:, None] + np.arange(2 * reach + 1)
    w = np.where((at >= 0) & (at < n), kernel(at + 0.5 - centre[:, None]), 0)
    return np.clip(at, 0, n - 1), w / w.sum(1, keepdims=True)


def enlarged(image: np.ndarray, factor: int, kind: str = "lanczos") -> np.ndarray:
    """Resampled to ``factor`` times the size, first along rows, then along columns."""
    at, w = _weights(image.shape[1], factor, kind)
    extra = (1,) * (image.ndim - 2)
    wide = bytes_of(sum(image[:, at[:, k]] * w[None, :, k].reshape(1, -1, *extra) for k in range(at.shape[1])))
    at, w = _weights(image.shape[0], factor, kind)
    return bytes_of(sum(wide[at[:, k]] * w[:, k].reshape(-1, 1, *extra) for k in range(at.shape[1])))


def turned(g: np.ndarray, degrees: float, grow: bool = True) -> np.ndarray:
    """Rotated against the clock about the centre, bilinear, the border's values beyond it; the canvas grows to hold it all."""
    height, width = g.shape
    cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    w, h = (int(height * abs(sin) + width * abs(cos)), int(height * abs(cos) + width * abs(sin))) if grow else (width, height)
    y, x = np.mgrid[0 : max(h, 1), 0 : max(w, 1)].astype(float)
    x, y = x - w / 2, y - h / 2
    sx, sy = np.clip(cos * x - sin * y + width / 2, 0, width - 1), np.clip(sin * x + cos * y + height / 2, 0, height - 1)
    x0, y0 = np.minimum(sx.astype(int), max(width - 2, 0)), np.minimum(sy.astype(int), max(height - 2, 0))
    fx, fy, v = sx - x0, sy - y0, g.astype(float)
    x1, y1 = np.minimum(x0 + 1, width - 1), np.minimum(y0 + 1, height - 1)
    return bytes_of((v[y0, x0] * (1 - fx) + v[y0, x1] * fx) * (1 - fy) + (v[y1, x0] * (1 - fx) + v[y1, x1] * fx) * fy)


def skew(g: np.ndarray, most: float = 15.0, step: float = 0.25) -> float:
    """The angle within ``most`` degrees at which the edges' sums along the lines differ most; 0 where no angle stands out."""
    v = g.astype(float)
    edge = np.zeros(g.shape, bool)
    edge[1:-1] = np.abs(v[2:] - v[:-2]) > 50
    y, x = np.nonzero(edge)
    if len(y) < 20:
        return 0.0
    angles = np.arange(-most + step, most, step)
    scores = [np.bincount(np.rint(y - x * np.tan(np.radians(a))).astype(int) + g.shape[1], minlength=g.shape[0] + 2 * g.shape[1]).astype(float) @ np.bincount(np.rint(y - x * np.tan(np.radians(a))).astype(int) + g.shape[1], minlength=g.shape[0] + 2 * g.shape[1]) for a in angles]
    best = int(np.argmax(scores))
    flat = scores[int(np.abs(angles).argmin())]
    return float(angles[best]) if scores[best] > 1.05 * flat else 0.0
