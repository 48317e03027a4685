"""The bit-exact chunk codec.

A chunk is the raw bytes of some rows, or their difference, modulo the width, from
a base of equal size; its bytes are transposed plane by plane and compressed.
Differences of two-byte numbers may go as zigzag values of one byte with an
escape plane of two for the rest, where few need it and the stream is shorter.
A chunk's name is the digest of the stream before compression, so it doesn't
depend on the level.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import zstandard

from ckptlake.types import STORED, IntegrityError, UsageError, width_of

RAW, DELTA, ZIGZAG = "raw-shuffle", "delta-shuffle", "delta-zigzag-escape"
STORED_AS_IS = "raw"
MARK = 255
MOST_ESCAPES = 0.5


class Encoded(NamedTuple):
    encoding: str
    object: str
    checksum: str
    payload: bytes
    plain_len: int
    identical: bool


def shuffle(data: np.ndarray) -> bytes:
    """Byte planes of the numbers, one after the other."""
    width = data.dtype.itemsize
    return np.ascontiguousarray(data.view(np.uint8).reshape(-1, width).T).tobytes()


def unshuffle(stream: bytes, width: int) -> np.ndarray:
    if len(stream) % width:
        raise IntegrityError(f"{len(stream)} bytes aren't numbers of {width}")
    return np.ascontiguousarray(np.frombuffer(stream, np.uint8).reshape(width, -1).T).reshape(-1).view(f"<u{width}")


def zigzag(delta: np.ndarray) -> np.ndarray:
    bits = delta.dtype.itemsize * 8
    sign = delta >> (bits - 1)
    return (delta << 1) ^ (np.zeros_like(delta) - sign)


def unzigzag(z: np.ndarray) -> np.ndarray:
    return (z >> 1) ^ (np.zeros_like(z) - (z & 1))


def escape_stream(z: np.ndarray) -> bytes:
    """Count, a byte for each value or a mark, and the planes of the marked values."""
    wide = z >= MARK
    return len(z).to_bytes(8, "little") + np.where(wide, MARK, z).astype(np.uint8).tobytes() + shuffle(z[wide].astype("<u2"))


def unescape_stream(stream: bytes) -> np.ndarray:
    n = int.from_bytes(stream[:8], "little")
    if len(stream) < 8 or len(stream) < 8 + n:
        raise IntegrityError("the escape stream is cut short")
    out = np.frombuffer(stream, np.uint8, n, 8).astype("<u2")
    wide = out == MARK
    rest = stream[8 + n :]
    if len(rest) != 2 * int(wide.sum()):
        raise IntegrityError("the escape plane has another length than its marks need")
    out[wide] = unshuffle(rest, 2)
    return out


def _finish(encoding: str, stream: bytes, level: int, identical: bool, compress: bool = True) -> Encoded:
    payload = zstandard.compress(stream, level) if compress else stream
    return Encoded(encoding, hashlib.sha256(stream).hexdigest(), hashlib.sha256(payload).hexdigest()[:16], payload, len(stream), identical)


def encode_chunk(target: bytes, base: bytes | None, dtype: str, level: int = 1, compress_raw: bool = True, raw_fallback: bool = True) -> Encoded:
    """The chunk in the form that is shortest: as it is, or against base."""
    if dtype not in STORED:
        raise UsageError(f"numbers of {dtype} aren't stored")
    width = width_of(dtype)
    t = np.frombuffer(target, f"<u{width}")
    if base is None:
        return _finish(RAW, shuffle(t), level, False) if compress_raw else _finish(STORED_AS_IS, target, level, False, False)
    if len(base) != len(target):
        raise UsageError("a base of another size")
    delta = t - np.frombuffer(base, f"<u{width}")
    identical = not delta.any()
    encoding, stream = DELTA, shuffle(delta)
    if width == 2 and len(delta):
        z = zigzag(delta)
        if (z >= MARK).mean() < MOST_ESCAPES and len(own := escape_stream(z)) < len(stream):
            encoding, stream = ZIGZAG, own
    best = _finish(encoding, stream, level, identical)
    if raw_fallback and not identical:
        plain = _finish(RAW, shuffle(t), level, False) if compress_raw else _finish(STORED_AS_IS, target, level, False, False)
        if len(plain.payload) < len(best.payload):
            return plain
    return best


def plain_stream(encoding: str, payload: bytes) -> bytes:
    """What was there before compression."""
    if encoding == STORED_AS_IS:
        return payload
    if encoding not in (RAW, DELTA, ZIGZAG):
        raise IntegrityError(f"unknown encoding {encoding!r}")
    try:
        return zstandard.decompress(payload)
    except zstandard.ZstdError as e:
        raise IntegrityError(f"can't be decompressed: {e}") from None


def decode_chunk(encoding: str, payload: bytes, base: bytes | None, dtype: str) -> bytes:
    width = width_of(dtype)
    stream = plain_stream(encoding, payload)
    if encoding == STORED_AS_IS:
        return stream
    if encoding == RAW:
        return unshuffle(stream, width).tobytes()
    if base is None:
        raise IntegrityError("a residual without its base")
    delta = unzigzag(unescape_stream(stream)) if encoding == ZIGZAG else unshuffle(stream, width)
    b = np.frombuffer(base, f"<u{width}")
    if len(b) != len(delta):
        raise IntegrityError(f"a base of {len(b)} numbers for {len(delta)}")
    return (b + delta).tobytes()
