"""Colour-space conversions as column expressions: everything stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polynomial from CMYK to RGB by channel: coefficient of each product of inks (fixed values).
CMYK = {
    "red": {"c": -1.0131, "cc": -0.0474, "ccc": -0.0701, "cm": 0.3576, "cy": 0.0042, "ck": 0.7488, "m": 0.0252, "mm": -0.1693, "mmm": 0.0704, "my": -0.0409, "mk": 0.0333, "y": 0.0388, "yy": 0.03, "yyy": -0.0248, "yk": 0.0028, "k": -0.7428, "kk": -0.1789, "kkk": -0.0285},
    "green": {"c": -0.3344, "cc": 0.0548, "ccc": -0.0408, "cm": 0.3254, "cy": 0.0079, "ck": 0.185, "m": -0.6792, "mm": -0.2034, "mmm": 0.0367, "my": 0.0646, "mk": 0.5394, "y": -0.0247, "yy": -0.0727, "yyy": 0.0328, "yk": 0.042, "k": -0.6876, "kk": -0.2106, "kkk": -0.0134},
    "blue": {"c": -0.1558, "cc": 0.0928, "ccc": -0.0163, "cm": 0.0723, "cy": 0.1612, "ck": 0.0176, "m": -0.4502, "mm": -0.0255, "mmm": 0.0337, "my": 0.2973, "mk": 0.2174, "y": -0.6536, "yy": -0.2041, "yyy": 0.057, "yk": 0.4823, "k": -0.6077, "kk": -0.1838, "kkk": -0.1004},
}
#: Matrices by row (fixed values): XYZ (D65) to linear RGB, the Bradford cone response and its inverse, the D65 white.
XYZ_TO_RGB = ((3.2406255, -1.5372080, -0.4986286), (-0.9689307, 1.8757561, 0.0415175), (0.0557101, -0.2040211, 1.0569959))
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
BRADFORD_INVERSE = ((0.9870, -0.1471, 0.1600), (0.4323, 0.5184, 0.0493), (-0.0085, 0.0400, 0.9685))
D65 = (0.3127 / 0.3290, 1.0, 0.3583 / 0.3290)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, wrap(low)), wrap(high))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> dict[str, Column]:
    """Red, green and blue, not clamped."""
    inks = {"c": c, "m": m, "y": y, "k": k}
    out = {}
    for channel, terms in CMYK.items():
        total = F.lit(1.0)
        for product, factor in terms.items():
            term = F.lit(factor)
            for ink in product:
                term = term * inks[ink]
            total = total + term
        out[channel] = total
    return out


def gray_to_rgb(g: Column) -> dict[str, Column]:
    return {"red": g, "green": g, "blue": g}


def srgb(v: Column) -> Column:
    """The sRGB transfer of a linear component."""
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def cal_gray(a: Column, gamma: float = 1.0) -> Column:
    return srgb(F.pow(a, F.lit(gamma)) if gamma != 1 else a)


def scaling(source: Sequence[float], target: Sequence[float]) -> np.ndarray:
    return np.diag(np.asarray(target, float) / np.asarray(source, float))


def bradford(source: Sequence[float], target: Sequence[float] = D65) -> np.ndarray:
    """Adaptation of XYZ values from one white point to another."""
    cone = np.array(BRADFORD)
    return np.array(BRADFORD_INVERSE) @ scaling(cone @ np.asarray(source), cone @ np.asarray(target)) @ cone


def _apply(matrix: np.ndarray, parts: Sequence[Column]) -> list[Column]:
    return [sum((F.lit(float(f)) * p for f, p in zip(row[1:], parts[1:])), F.lit(float(row[0])) * parts[0]) for row in matrix]


def cal_rgb(parts: Sequence[Column], gamma: Sequence[float] = (1, 1, 1), matrix: Sequence[Sequence[float]] | None = None, white: Sequence[float] | None = None) -> dict[str, Column]:
    """Calibrated RGB: gamma, a matrix to XYZ, adaptation to D65 where a white point is given. The matrices are multiplied once, here."""
    whole = np.array(XYZ_TO_RGB) @ (bradford(white) if white else np.eye(3)) @ (np.array(matrix, float) if matrix else np.eye(3))
    powered = [F.pow(p, F.lit(float(g))) if g != 1 else p for p, g in zip(parts, gamma)]
    return dict(zip(("red", "green", "blue"), map(srgb, _apply(whole, powered))))


def lab_matrix(white: Sequence[float] | None) -> np.ndarray:
    unit = (1.0, 1.0, 1.0)
    return np.array(XYZ_TO_RGB) @ (scaling(unit, D65) if white is None else bradford(white) @ scaling(unit, white))


def lab(lightness: Column, a: Column, b: Column, white: Sequence[float] | None = None, range_: Sequence[float] = (-100, 100, -100, 100)) -> dict[str, Column]:
    a, b = clamp(a, float(range_[0]), float(range_[1])), clamp(b, float(range_[2]), float(range_[3]))
    middle = (lightness + 16) / 116
    unfold = lambda x: F.when(x >= 6 / 29, x * x * x).otherwise(108 / 841 * (x - 4 / 29))
    xyz = [unfold(middle + a / 500), unfold(middle), unfold(middle - b / 200)]
    return dict(zip(("red", "green", "blue"), map(srgb, _apply(lab_matrix(white), xyz))))


def indexed(index: Column, palette: Sequence[int]) -> Column:
    """Palette entry of a rounded (half to even) index; out of the table, black (0)."""
    table = F.array(*map(F.lit, palette))
    at = F.bround(index).cast("int")
    return F.when((at >= 0) & (at < len(palette)), F.get(table, at)).otherwise(F.lit(0))


def icc_space(components: Column, alternate: Column | None = None) -> Column:
    """Profiles are not read: the alternate space, else one by the number of components."""
    own = F.when(components == 1, "DeviceGray").when(components == 4, "DeviceCMYK").otherwise("DeviceRGB")
    return F.coalesce(alternate, own) if alternate is not None else own


def decode(sample: Column, bits: int, low: Column | float, high: Column | float) -> Column:
    """A sample of so many bits on the range low..high."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return low + sample * (high - low) / float((1 << bits) - 1)


def to_8bit(v: Column) -> Column:
    """Rounded and clamped to 0..255."""
    return clamp((v * 255 + 0.5).cast("int"), 0, 255)


def to_hex(red: Column, green: Column, blue: Column) -> Column:
    """Channels truncated (not rounded) to eight bits: #rgb where all are doubled digits, else #rrggbb."""
    part = lambda v: F.lower(F.lpad(F.hex((clamp(v, 0.0, 1.0) * 255).cast("int")), 2, "0"))
    parts = [part(v) for v in (red, green, blue)]
    doubled = None
    for p in parts:
        own = F.substring(p, 1, 1) == F.substring(p, 2, 1)
        doubled = own if doubled is None else doubled & own
    return F.concat(F.lit("#"), F.when(doubled, F.concat(*(F.substring(p, 1, 1) for p in parts))).otherwise(F.concat(*parts)))


def ycc_to_rgb(y: Column, cb: Column, cr: Column) -> dict[str, Column]:
    """JPEG's luma and chroma (0..255) to RGB."""
    return {"red": y + 1.402 * (cr - 128), "green": y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), "blue": y + 1.772 * (cb - 128)}
