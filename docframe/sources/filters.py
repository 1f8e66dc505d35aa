"""Stream filters: bytes to bytes, chained in the order of a stream's /Filter entry."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Full names of the filters that inline images abbreviate (fixed values).
ABBREVIATIONS = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}


class FilterError(ValueError):
    pass


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">", 1)[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~", 1)[0]:
        if c in b" \t\r\n\f\0":
            continue
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _base85(group)
                group = []
        else:
            raise FilterError("bad character in ASCII85 data")
    if len(group) > 1:
        out += _base85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _base85(group: list[int]) -> bytes:
    value = 0
    for digit in group:
        value = value * 85 + digit
    return (value & 0xFFFFFFFF).to_bytes(4, "big")


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes grow from 9 to 12 bits, one code early if ``early``; 256 clears the table, 257 ends."""
    out, table, width, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
    buffer = bits = 0
    for byte in data:
        buffer, bits = (buffer << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = buffer >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last:
            entry = last + last[:1]
        else:
            raise FilterError("bad LZW code")
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + early).bit_length()))
    return bytes(out)


def flate(data: bytes) -> bytes:
    """Inflated data; what can be read of a damaged or cut stream, without its checksum."""
    raw = data[2:] if len(data) > 1 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0 else data
    reader, out = zlib.decompressobj(-15), bytearray()
    try:
        out += reader.decompress(raw)
        out += reader.flush()
    except zlib.error:
        if not out:
            reader = zlib.decompressobj(-15)
            for i in range(len(raw)):
                try:
                    out += reader.decompress(raw[i : i + 1])
                except zlib.error:
                    break
    return bytes(out)


def _undo_tiff(data: bytes, stride: int, colors: int, bits: int, columns: int) -> bytes:
    """Each sample is a difference to the one of its colour on its left; rows start anew."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, stride)
    if bits in (8, 16):
        samples = rows if bits == 8 else rows.view(">u2")
        return np.cumsum(samples.reshape(len(rows), columns, colors), axis=1, dtype=f"u{bits // 8}").astype(f">u{bits // 8}").tobytes()
    if bits not in (1, 2, 4):
        raise FilterError("TIFF predictor for samples of 1, 2, 4, 8 and 16 bits only")
    single = np.unpackbits(rows, axis=1)[:, : columns * colors * bits].reshape(len(rows), columns, colors, bits)
    weights = 1 << np.arange(bits - 1, -1, -1)
    whole = np.cumsum((single * weights).sum(axis=3), axis=1) % (1 << bits)
    return np.packbits((whole[..., None] & weights > 0).reshape(len(rows), -1), axis=1).tobytes()


def unpredict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Undo a PNG (10 and above) or TIFF (2) predictor."""
    unit, stride = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if predictor < 2:
        return data
    if predictor == 2:
        return _undo_tiff(data[: len(data) // stride * stride], stride, colors, bits, columns)
    out, above = bytearray(), bytearray(stride)
    for at in range(0, len(data), stride + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + stride])
        for i in range(len(row)):
            left, up = row[i - unit] if i >= unit else 0, above[i]
            if kind == 1:
                row[i] = row[i] + left & 255
            elif kind == 2:
                row[i] = row[i] + up & 255
            elif kind == 3:
                row[i] = row[i] + (left + up) // 2 & 255
            elif kind == 4:
                corner = above[i - unit] if i >= unit else 0
                guess = left + up - corner
                near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))
                row[i] = row[i] + near[2] & 255
        out += row
        above = row + bytes(stride - len(row))
    return bytes(out)


def decode(data: bytes, names: list[str], parameters: list[dict | None]) -> bytes:
    for i, name in enumerate(names):
        own = (parameters[i] if i < len(parameters) else None) or {}
        name = ABBREVIATIONS.get(name, name)
        if name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "ASCII85Decode":
            data = ascii85(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        elif name in ("LZWDecode", "FlateDecode"):
            data = lzw(data, own.get("EarlyChange", 1)) if name == "LZWDecode" else flate(data)
            data = unpredict(data, own.get("Predictor", 1), own.get("Colors", 1), own.get("BitsPerComponent", 8), own.get("Columns", 1))
        elif name != "Crypt":  # undone with the object's key, before the other filters
            raise FilterError(f"unsupported filter {name}")
    return data
