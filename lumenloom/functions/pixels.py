"""Small numpy helpers that run inside tasks: resampling, hashes, PNG bytes."""

from __future__ import annotations

import math
import struct
import zlib
from typing import BinaryIO

import numpy as np

# --- fixed values: image-file and colour-space constants ---------------------
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
PNG_LEVEL = 6
SRGB_KNEE = 0.04045
LUMA_WEIGHTS = (19595, 38470, 7471)  # of 65536
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)
# ----------------------------------------------------------------------------

_FIXED_POINT = 1 << 22


def _light_of(share: float) -> float:
    """Linear light of a display value between 0 and 1 (IEC 61966-2-1)."""
    return share / 12.92 if share <= SRGB_KNEE else math.pow((share + 0.055) / 1.055, 2.4)


# light of each byte, and the light at which each byte but 0 begins when light is stored as bytes again
BYTE_LIGHT = np.array([_light_of(b / 255) for b in range(256)])
BYTE_BEGINS = np.array([_light_of((b - 0.5) / 255) for b in range(1, 256)])


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.clip(1.0 - np.abs(x), 0.0, None)


def _lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)


_KERNELS = {"bilinear": (_triangle, 1.0), "lanczos": (_lanczos3, 3.0)}


def resample_weights(n_in: int, n_out: int, kernel: str) -> np.ndarray:
    """(n_out, n_in) weights of an antialiased separable filter."""
    shape, reach = _KERNELS[kernel]
    ratio = n_in / n_out
    stretch = max(1.0, ratio)
    centres = (np.arange(n_out) + 0.5) * ratio
    first = np.maximum(0, np.floor(centres - reach * stretch + 0.5))
    last = np.minimum(n_in, np.floor(centres + reach * stretch + 0.5))
    at = np.arange(n_in)
    weights = shape((at[None, :] + 0.5 - centres[:, None]) / stretch)
    weights = np.where((at >= first[:, None]) & (at < last[:, None]), weights, 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, size: tuple[int, int], kernel: str = "lanczos") -> np.ndarray:
    """Separable resize to (w, h): across, then down. Bytes stay bytes, rounded after each pass."""
    h, w = img.shape[:2]
    out_w, out_h = size
    as_bytes = img.dtype == np.uint8
    work = img.astype(np.float64)
    for axis, n_in, n_out in ((1, w, out_w), (0, h, out_h)):
        if n_in == n_out:
            continue
        weights = resample_weights(n_in, n_out, kernel)
        if as_bytes:
            weights = np.rint(weights * _FIXED_POINT) / _FIXED_POINT
        work = np.moveaxis(np.tensordot(weights, work, axes=(1, axis)), 0, axis)
        if as_bytes:
            work = np.clip(np.floor(work + 0.5), 0, 255)
    return work.astype(np.uint8) if as_bytes else work


def shrink_in_linear_light(img: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Gamma-correct shrink of an RGB byte image; other resizes are plain Lanczos.

    Averaged light goes back to bytes by looking up where each byte begins.
    """
    shape = (size[1], size[0])
    if img.shape[:2] == shape:
        return img.copy()
    shrinks = img.ndim == 3 and img.shape[2] == 3 and shape[0] < img.shape[0] and shape[1] < img.shape[1]
    if not shrinks:
        return resize(img, size)
    return np.searchsorted(BYTE_BEGINS, resize(BYTE_LIGHT[img], size), side="right").astype(np.uint8)


def luma(rgb: np.ndarray) -> np.ndarray:
    parts = rgb.astype(np.int64) @ np.array(LUMA_WEIGHTS)
    return ((parts + 32768) >> 16).astype(np.uint8)


def on_white(channels: np.ndarray) -> np.ndarray:
    """Grey, grey+alpha, RGB or RGBA bytes to RGB over a white background."""
    if channels.ndim == 2:
        channels = channels[:, :, None]
    n = channels.shape[2]
    color = channels[:, :, :3] if n >= 3 else np.repeat(channels[:, :, :1], 3, axis=2)
    if n in (1, 3):
        return np.ascontiguousarray(color)
    alpha = channels[:, :, -1:].astype(np.int64)
    mixed = color.astype(np.int64) * alpha + 255 * (255 - alpha) + 128
    return (((mixed >> 8) + mixed) >> 8).astype(np.uint8)


def from_spark_image(height: int, width: int, n_channels: int, data: bytes) -> np.ndarray:
    """Bytes of Spark's image source (BGR order) as RGB over white."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, n_channels)
    if n_channels >= 3:
        a = a[:, :, [2, 1, 0, *range(3, n_channels)]]
    return on_white(a)


def perceptual_bits(planes: np.ndarray) -> np.ndarray:
    """DCT-II of (n, 32, 32) planes, low 8x8 block above its median, packed.

    Coefficients are rounded to 1e-6 first: flat images then hash the same
    whatever the order of summation.
    """
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    basis = 2.0 * np.cos(np.pi * k * (2 * x + 1) / 64.0)
    low = np.einsum("ux,nxy,vy->nuv", basis, planes, basis, optimize=True).round(6).reshape(-1, 64)
    return pack(low > np.median(low, axis=1, keepdims=True))


def pack(bits: np.ndarray) -> np.ndarray:
    """(n, up to 64) booleans to signed 64-bit, first element most significant."""
    out = np.zeros(bits.shape[0], dtype=np.uint64)
    for i in range(bits.shape[1]):
        out = (out << np.uint64(1)) | bits[:, i].astype(np.uint64)
    return out.view(np.int64)


def image_hash(rgb: np.ndarray, method: str) -> int:
    grey = luma(rgb)
    if method == "average":
        small = resize(grey, (8, 8)).astype(np.float64)
        return int(pack((small > small.mean()).reshape(1, -1))[0])
    if method == "dhash":
        small = resize(grey, (9, 8))
        return int(pack((small[:, 1:] > small[:, :-1]).reshape(1, -1))[0])
    if method == "whash":
        side = max(8, 1 << int(math.log2(min(grey.shape))))
        block = side // 8
        small = resize(grey, (side, side)).astype(np.float64)
        low = small.reshape(8, block, 8, block).mean(axis=(1, 3))
        return int(pack((low > np.median(low)).reshape(1, -1))[0])
    return int(perceptual_bits(resize(grey, (32, 32)).astype(np.float64)[None])[0])


def color_bins(rgb: np.ndarray, bins: int = 4) -> np.ndarray:
    small = resize(rgb, (32, 32), "bilinear").reshape(-1, 3) // (256 // bins)
    levels = np.minimum(small, bins - 1).astype(np.int64)
    index = (levels[:, 0] * bins + levels[:, 1]) * bins + levels[:, 2]
    return np.bincount(index, minlength=bins**3) / len(index)


def crop(img: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return img[y : y + h, x : x + w]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(img: np.ndarray) -> bytes:
    """8-bit lossless PNG of a grey, grey+alpha, RGB or RGBA array."""
    if img.ndim == 2:
        img = img[:, :, None]
    h, w, n = img.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, w * n)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), PNG_LEVEL)) + _chunk(b"IEND", b"")


def is_plain_png(file: BinaryIO) -> bool:
    """Is an open file a PNG that ``decode_png`` reads: 8 bits, grey, RGB or RGBA, not interlaced, and nothing that changes colours?"""
    if file.read(8) != PNG_MAGIC:
        return False
    kind, seen = b"", False
    while kind != b"IEND":
        head = file.read(8)
        if len(head) < 8:
            return False
        size, kind = int.from_bytes(head[:4], "big"), head[4:]
        if not seen:
            about = file.read(17)  # header and checksum
            if kind != b"IHDR" or size != 13 or about[8:13] not in (b"\x08\0\0\0\0", b"\x08\2\0\0\0", b"\x08\6\0\0\0"):
                return False
            seen = True
        elif kind in (b"IDAT", b"IEND", b"tEXt", b"tIME", b"pHYs"):
            file.seek(size + 4, 1)
        else:
            return False
    return True


def decode_png(data: bytes) -> np.ndarray:
    """Channels (h, w, n) of a plain PNG.

    Rows without a filter are taken as they are. Others are restored along the
    diagonals: a byte needs those to its left, above, and above to the left,
    which lie on the two diagonals before its own.
    """
    at, parts, head = 8, [], b""
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    n = {0: 1, 2: 3, 6: 4}[head[9]]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)[: h * (1 + w * n)].reshape(h, 1 + w * n)
    kinds, img = raw[:, 0], raw[:, 1:].reshape(h, w, n)
    if not kinds.any():
        return img
    if kinds.max() > 4:
        raise ValueError("unknown filter")
    out = np.zeros((h + 1, w + 1, n), np.int32)  # an empty row above, an empty column to the left
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        near = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        base = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) // 2, paeth])
        out[y + 1, x + 1] = (img[y, x] + base) & 255
    return out[1:, 1:].astype(np.uint8)


def _area_weights(n_in: int, n_out: int) -> np.ndarray:
    """Share of every input pixel in every output pixel."""
    edges = np.arange(n_out + 1) * (n_in / n_out)
    at = np.arange(n_in)
    overlap = np.minimum(edges[1:, None], at[None, :] + 1) - np.maximum(edges[:-1, None], at[None, :])
    return np.clip(overlap, 0.0, None) * (n_out / n_in)


def resize_area(img: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Shrink a byte image to (w, h) by averaging the covered area."""
    h, w = img.shape[:2]
    if (w, h) == tuple(size):
        return img
    rows, cols = _area_weights(h, size[1]), _area_weights(w, size[0])
    mixed = np.einsum("yh,hwc,xw->yxc", rows, img.astype(np.float64), cols, optimize=True)
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)
