"""Lexical tokens of many texts at once, by whole arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of TOKEN in functions.text; those of other signs in UTF-8 are none of them.
IN_TOKEN = np.zeros(256, bool)
IN_TOKEN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of texts in lower case, none of them null, and the place of each token's text."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = IN_TOKEN[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    starts[first] = inside[first]
    offsets = np.append(np.flatnonzero(starts[inside]), np.count_nonzero(inside)).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside])))
    return tokens, np.searchsorted(ends, np.flatnonzero(starts), "right") - 1
