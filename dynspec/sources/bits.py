"""Packed samples: 1, 2 or 4 bits a sample in bytes, either order, and the levels of a bit depth."""

from __future__ import annotations

import numpy as np

from ..functions.columns import DIGI_SIGMA

# Sample types by bits, and the order of sub-byte samples in files.
DTYPES = {1: "<u1", 2: "<u1", 4: "<u1", 8: "<u1", 16: "<u2", 32: "<f4"}
ORDERS = {1: "little", 2: "big", 4: "big"}


def _shifts(nbits: int, order: str) -> np.ndarray:
    if nbits not in (1, 2, 4) or order not in ("big", "little"):
        raise ValueError("samples of 1, 2 or 4 bits, in big or little order")
    s = np.arange(0, 8, nbits)
    return (s[::-1] if order == "big" else s).astype(np.uint8)


def unpack(data: np.ndarray, nbits: int, order: str = "big") -> np.ndarray:
    return ((data[:, None] >> _shifts(nbits, order)) & (2**nbits - 1)).astype(np.uint8).ravel()


def pack(samples: np.ndarray, nbits: int, order: str = "big") -> np.ndarray:
    s = _shifts(nbits, order)
    if len(samples) % len(s):
        raise ValueError("samples must fill whole bytes")
    return np.bitwise_or.reduce(samples.astype(np.uint8).reshape(-1, len(s)) << s, axis=1)


def decode(data: bytes, nbits: int) -> np.ndarray:
    """Samples of a file's bytes."""
    if nbits not in DTYPES:
        raise ValueError(f"no samples of {nbits} bits")
    raw = np.frombuffer(data, DTYPES[nbits])
    return unpack(raw, nbits, ORDERS[nbits]) if nbits < 8 else raw


def encode(samples: np.ndarray, nbits: int) -> bytes:
    if nbits not in DTYPES:
        raise ValueError(f"no samples of {nbits} bits")
    if nbits < 8:
        return pack(samples, nbits, ORDERS[nbits]).tobytes()
    return samples.astype(DTYPES[nbits]).tobytes()


def quantize(z: np.ndarray, nbits: int) -> np.ndarray:
    """Levels of normalised samples."""
    if nbits == 32:
        return np.asarray(z, np.float32)
    mean = 2 ** (nbits - 1) - 0.5
    return np.clip(np.trunc(np.asarray(z) * (mean / DIGI_SIGMA[nbits]) + mean + 0.5), 0, 2**nbits - 1).astype(DTYPES[nbits])
