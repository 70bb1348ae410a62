"""Seeded random columns that depend on (seed, tag, id) alone.

Partitioning, retries and lost executors do not change a value, unlike
``rand(seed)``. ``md5`` values can be recomputed by any SQL engine; ``fast``
values come from ``xxhash64`` and stay inside code generation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 4294967296  # 2**32, one md5 word


def _digest(seed: int, tag: str, row_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{tag}:"), row_id.cast("string")))


def _word(digest: Column, index: int) -> Column:
    return F.conv(F.substring(digest, 8 * index + 1, 8), 16, 10).cast("bigint")


def word(seed: int, tag: str, row_id: Column, mode: str = "md5") -> Column:
    """Uniform integer in [0, 2**32)."""
    if mode == "fast":
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tag), row_id), 32)
    return _word(_digest(seed, tag, row_id), 0)


def uniform(seed: int, tag: str, row_id: Column, mode: str = "md5") -> Column:
    """Uniform double in [0, 1)."""
    return word(seed, tag, row_id, mode) / F.lit(float(WORD))


def normal(seed: int, tag: str, row_id: Column, mode: str = "md5") -> Column:
    """Standard normal double, by the Box-Muller transform of two words."""
    if mode == "fast":
        first, second = word(seed, tag, row_id, mode), word(seed, tag + "'", row_id, mode)
    else:
        digest = _digest(seed, tag, row_id)
        first, second = _word(digest, 0), _word(digest, 1)
    radius = F.sqrt(F.lit(-2.0) * F.ln((first + 1) / F.lit(float(WORD + 1))))
    return radius * F.cos(F.lit(2.0 * math.pi) * (second / F.lit(float(WORD))))


def draws(seed: int, tags: Sequence[str], row_id: Column, mode: str = "md5") -> Column:
    """The words of many tags as one column, to be read by :func:`drawn` in batches: a digest
    costs some microseconds as SQL once its words are to be numbers."""
    if mode == "fast":
        return F.array(*[word(seed, t, row_id, mode) for tag in tags for t in (tag, f"{tag}'")])
    return F.concat(*[F.unhex(_digest(seed, tag, row_id)) for tag in tags])


def drawn(column: pa.Array, n_tags: int) -> np.ndarray:
    """Two words of every row and tag, ``[row, tag, word]``; zeros for a missing md5 id."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        digests = b"".join(column.fill_null(bytes(16 * n_tags)).to_pylist())
        return np.frombuffer(digests, ">u4").reshape(-1, n_tags, 4)[:, :, :2].astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_tags, 2)


def uniforms(words: np.ndarray) -> np.ndarray:
    """:func:`uniform` of words ``[..., word]``."""
    return words[..., 0] / float(WORD)


def normals(words: np.ndarray) -> np.ndarray:
    """:func:`normal` of words ``[..., word]``."""
    radius = np.sqrt(-2.0 * np.log((words[..., 0] + 1) / float(WORD + 1)))
    return radius * np.cos(2.0 * math.pi * (words[..., 1] / float(WORD)))


def literal_uniform(seed: int, tag: str, index: int) -> float:
    """The md5 uniform of one id, computed on the driver for coefficients."""
    text = f"{seed}:{tag}:{index}".encode()
    return int(hashlib.md5(text).hexdigest()[:8], 16) / float(WORD)


def literal_uniforms(seed: int, tag: str, indices: np.ndarray) -> np.ndarray:
    """:func:`literal_uniform` of many ids, whose common prefix is digested once."""
    prefix, digests = hashlib.md5(f"{seed}:{tag}:".encode()), []
    for index in indices.tolist():
        one = prefix.copy()
        one.update(b"%d" % index)
        digests.append(one.digest())
    return np.frombuffer(b"".join(digests), ">u4")[::4] / float(WORD)
