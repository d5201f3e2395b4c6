"""Image decoders to inject where no codec library is at hand."""

from __future__ import annotations

import re

import numpy as np

_HEADER = re.compile(rb"(P[56])(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)\s")


def netpbm():
    """Binary PGM and PPM files of 8 bits: (h, w, 1) grey, (h, w, 3) BGR."""

    def decode(raw: bytes) -> np.ndarray | None:
        head = _HEADER.match(raw)
        if head is None or not 0 < int(head[4]) <= 255:
            return None
        w, h, channels = int(head[2]), int(head[3]), 3 if head[1] == b"P6" else 1
        body = np.frombuffer(raw, np.uint8, offset=head.end())
        if len(body) < w * h * channels or not w * h:
            return None
        image = body[: w * h * channels].reshape(h, w, channels)
        return image[:, :, ::-1] if channels == 3 else image

    return decode
