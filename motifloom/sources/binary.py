"""Numeric arrays of binary files: npz, version 5 mat, and the loudness of a band of frequencies in wav files."""

from __future__ import annotations

import io
import struct
import wave
import zlib

import numpy as np

#: Element types of the version 5 mat format.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_PACKED = 14, 15


def array_of(file: str, content: bytes, name: str) -> np.ndarray:
    kind = file.rsplit(".", 1)[-1].lower()
    if kind == "npz":
        return np.load(io.BytesIO(content), allow_pickle=False)[name].astype(float).reshape(-1)
    if kind == "mat":
        return mat_arrays(content)[name].astype(float).reshape(-1)
    if kind == "wav":
        low, high = (float(x) for x in name.split("-"))
        return band_loudness(content, low, high)
    raise ValueError(f"no reader for {kind!r} files")


def _elements(data: bytes, order: str):  # noqa: ANN202
    """(type, body) of the elements of a mat file's part."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: its size and type share four bytes
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == MAT_PACKED else -size % 8)


def mat_arrays(content: bytes) -> dict[str, np.ndarray]:
    """Numeric arrays of a mat file by name, in column order."""
    order = "<" if content[126:128] == b"IM" else ">"
    out = {}
    for kind, body in _elements(content[128:], order):
        if kind == MAT_PACKED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind != MAT_MATRIX:
            continue
        parts = list(_elements(body, order))
        if len(parts) >= 4 and parts[3][0] in MAT_TYPES:
            out[parts[2][1].decode()] = np.frombuffer(parts[3][1], order + MAT_TYPES[parts[3][0]])
    return out


def band_loudness(content: bytes, low: float, high: float, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """Decibels, against the loudest frame, of the mean amplitude between two frequencies in frames of the first channel."""
    with wave.open(io.BytesIO(content)) as file:
        rate, width, channels = file.getframerate(), file.getsampwidth(), file.getnchannels()
        raw = np.frombuffer(file.readframes(file.getnframes()), {1: "u1", 2: "<i2", 4: "<i4"}[width])
    x = raw[::channels].astype(float) - (128 if width == 1 else 0)
    if len(x) < frame:
        return np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop] * np.hanning(frame)
    frequency = np.fft.rfftfreq(frame, 1 / rate)
    own = (frequency >= low) & (frequency <= high)
    loud = np.abs(np.fft.rfft(frames, axis=1))[:, own].mean(axis=1) if own.any() else np.zeros(len(frames))
    return 20 * np.log10(np.maximum(loud, 1e-10) / max(float(loud.max(initial=0)), 1e-10))
