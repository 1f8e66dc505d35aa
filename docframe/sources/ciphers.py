"""RC4 and AES on bytes. Decryption of AES-CBC works on all blocks of a stream at once; encryption goes block by block."""

from __future__ import annotations

import numpy as np


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = j + state[i] + key[i % len(key)] & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, byte in enumerate(data):
        i = i + 1 & 255
        a = state[i]
        j = j + a & 255
        b = state[j]
        state[i], state[j] = b, a
        out[n] = byte ^ state[a + b & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    """The product in GF(256) modulo x^8 + x^4 + x^3 + x + 1."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _sbox() -> list[int]:
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if _times(a, b) == 1)
            inverse[a], inverse[b] = b, a
    spun = lambda x, n: (x << n | x >> 8 - n) & 255
    return [x ^ spun(x, 1) ^ spun(x, 2) ^ spun(x, 3) ^ spun(x, 4) ^ 0x63 for x in inverse]


_S = _sbox()
_S_BACK = np.argsort(np.array(_S)).astype(np.uint8)
_BY = {n: np.array([_times(x, n) for x in range(256)], np.uint8) for n in (9, 11, 13, 14)}
#: Substitution and column mixing of one byte as a word, by the byte's row.
_MIX = [[int.from_bytes(bytes(np.roll([_times(s, 2), s, s, _times(s, 3)], row).tolist()), "big") for s in _S] for row in range(4)]
_ROWS_BACK = np.array([(4 * ((i // 4 - i % 4) % 4)) + i % 4 for i in range(16)])


def _round_keys(key: bytes) -> list[int]:
    n = len(key) // 4
    words, constant = [int.from_bytes(key[i : i + 4], "big") for i in range(0, len(key), 4)], 1
    sub = lambda w: int.from_bytes(bytes(_S[b] for b in w.to_bytes(4, "big")), "big")
    for i in range(n, 4 * (n + 7)):
        last = words[-1]
        if i % n == 0:
            last = sub((last << 8 | last >> 24) & 0xFFFFFFFF) ^ constant << 24
            constant = _times(constant, 2)
        elif n > 6 and i % n == 4:
            last = sub(last)
        words.append(words[i - n] ^ last)
    return words


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, without padding."""
    keys, (t0, t1, t2, t3), s, out = _round_keys(key), _MIX, _S, bytearray()
    last = len(keys) - 4
    a, b, c, d = (int.from_bytes(iv[i : i + 4], "big") for i in (0, 4, 8, 12))
    for at in range(0, len(data), 16):
        block = int.from_bytes(data[at : at + 16], "big")
        a, b, c, d = a ^ block >> 96 ^ keys[0], b ^ block >> 64 & 0xFFFFFFFF ^ keys[1], c ^ block >> 32 & 0xFFFFFFFF ^ keys[2], d ^ block & 0xFFFFFFFF ^ keys[3]
        for k in range(4, last, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ keys[k],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ keys[k + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ keys[k + 2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ keys[k + 3],
            )
        w = (a, b, c, d)
        a, b, c, d = (
            (s[w[i] >> 24] << 24 | s[w[(i + 1) % 4] >> 16 & 255] << 16 | s[w[(i + 2) % 4] >> 8 & 255] << 8 | s[w[(i + 3) % 4] & 255]) ^ keys[last + i]
            for i in range(4)
        )
        out += (a << 96 | b << 64 | c << 32 | d).to_bytes(16, "big")
    return bytes(out)


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, with the padding left in place."""
    data = data[: len(data) // 16 * 16]
    if not data:
        return b""
    keys = np.frombuffer(b"".join(w.to_bytes(4, "big") for w in _round_keys(key)), np.uint8).reshape(-1, 16)
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    state = blocks ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        state = _S_BACK[state[:, _ROWS_BACK]] ^ keys[k]
        if k:
            c = state.reshape(-1, 4, 4)
            r = [c[:, :, i] for i in range(4)]
            state = np.stack([_BY[14][r[i]] ^ _BY[11][r[(i + 1) % 4]] ^ _BY[13][r[(i + 2) % 4]] ^ _BY[9][r[(i + 3) % 4]] for i in range(4)], axis=2).reshape(-1, 16)
    before = np.vstack([np.frombuffer(iv, np.uint8)[None], blocks[:-1]])
    return (state ^ before).tobytes()


def pad(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def unpad(data: bytes) -> bytes:
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= 16 and n <= len(data) else data
