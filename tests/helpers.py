from __future__ import annotations

import numpy as np

from lumenloom.functions.pixels import encode_png


def spotted(w, h, n=60):
    """High-frequency colour squares, so any resampling would show."""
    img = np.full((h, w, 3), 30, np.uint8)
    for i in range(n):
        x, y = i * 53 % max(1, w - 50), i * 31 % max(1, h - 50)
        img[y : y + 46, x : x + 46] = (i * 7 % 256, i * 15 % 256, i * 23 % 256)
    return img


def write_png(path, img):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(encode_png(img))
    return str(path)


def _varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def _field(no, body):
    if isinstance(body, int):
        return _varint(no << 3) + _varint(body)
    body = body.encode() if isinstance(body, str) else body
    return _varint(no << 3 | 2) + _varint(len(body)) + body


def pooling_model():
    """A tiny model: global average per channel of an NCHW input, named ``logits``."""
    def value(name):
        dims = b"".join(_field(1, _field(2, d)) for d in ("n", "c", "h", "w"))
        return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, dims)))

    node = _field(1, "pixels") + _field(2, "logits") + _field(4, "GlobalAveragePool")
    graph = _field(1, node) + _field(2, "pool") + _field(11, value("pixels")) + _field(12, value("logits"))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))
