"""The standard security handler: passwords to file keys (revisions 2 to 6), and decryption of strings and streams."""

from __future__ import annotations

import hashlib
import secrets
from dataclasses import dataclass

from .ciphers import aes_cbc_decrypt, aes_cbc_encrypt, pad, rc4, unpad
from .syntax import Name, Ref, Stream

#: Padding of passwords up to revision 4 (a fixed value).
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _md5(x: bytes) -> bytes:
    return hashlib.md5(x, usedforsecurity=False).digest()


def _padded(password: bytes) -> bytes:
    return (password + PADDING)[:32]


def _chained_rc4(key: bytes, data: bytes, steps) -> bytes:
    for i in steps:
        data = rc4(bytes(b ^ i for b in key), data)
    return data


def legacy_key(password: bytes, owner: bytes, permissions: int, file_id: bytes, revision: int, size: int, metadata: bool) -> bytes:
    digest = _md5(_padded(password) + owner[:32] + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"" if metadata or revision < 4 else b"\xff" * 4))
    for _ in range(50 if revision >= 3 else 0):
        digest = _md5(digest[:size])
    return digest[:size]


def legacy_user(key: bytes, file_id: bytes, revision: int) -> bytes:
    """The check value that the /U entry starts with."""
    return rc4(key, PADDING) if revision == 2 else _chained_rc4(key, _md5(PADDING + file_id), range(20))


def _owner_key(password: bytes, revision: int, size: int) -> bytes:
    digest = _md5(_padded(password))
    for _ in range(50 if revision >= 3 else 0):
        digest = _md5(digest)
    return digest[:size]


def legacy_owner(owner_password: bytes, user_password: bytes, revision: int, size: int) -> bytes:
    return _chained_rc4(_owner_key(owner_password, revision, size), _padded(user_password), range(20 if revision >= 3 else 1))


def hardened(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    """SHA-256 for revision 5, the iterated hash for revision 6."""
    key = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return key
    step = 0
    while True:
        encrypted = aes_cbc_encrypt(key[:16], key[16:32], (password + key + user) * 64)
        kind = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(encrypted[:16]) % 3]
        key = kind(encrypted).digest()
        step += 1
        if step >= 64 and encrypted[-1] <= step - 32:
            return key[:32]


@dataclass
class Security:
    key: bytes
    strings: str
    streams: str
    filters: dict[str, str]
    is_owner: bool

    def _apply(self, method: str, data: bytes, number: int, generation: int) -> bytes:
        if method == "None":
            return data
        if method == "AESV3":
            return unpad(aes_cbc_decrypt(self.key, data[:16], data[16:])) if len(data) >= 32 else b""
        own = _md5(self.key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if method == "AESV2" else b""))[: min(len(self.key) + 5, 16)]
        if method == "V2":
            return rc4(own, data)
        return unpad(aes_cbc_decrypt(own, data[:16], data[16:])) if len(data) >= 32 else b""

    def decrypt(self, value, number: int, generation: int):
        """The value with its strings, and its data if it is a stream, in the clear."""
        if isinstance(value, bytes):
            return self._apply(self.strings, value, number, generation)
        if isinstance(value, dict):
            return {k: self.decrypt(v, number, generation) for k, v in value.items()}
        if isinstance(value, list):
            return [self.decrypt(v, number, generation) for v in value]
        if isinstance(value, Stream):
            if value.entries.get("Type") == "XRef":
                return value
            method, names, parameters = self.streams, value.entries.get("Filter"), value.entries.get("DecodeParms")
            if (names[0] if isinstance(names, list) and names else names) == "Crypt":
                own = (parameters[0] if isinstance(parameters, list) and parameters else parameters) or {}
                method = self.filters.get(own.get("Name", "Identity") if isinstance(own, dict) else "Identity", "None")
            return Stream(self.decrypt(value.entries, number, generation), self._apply(method, value.data, number, generation))
        return value


def unlock(entries: dict, file_id: bytes, password: bytes) -> Security | None:
    """The handler for an /Encrypt dictionary (values resolved), or None if the password is wrong or the method unknown. The owner is tried first."""
    version, revision = entries.get("V", 0), entries.get("R", 0)
    owner, user, permissions = entries.get("O"), entries.get("U"), entries.get("P")
    if entries.get("Filter") != "Standard" or not (isinstance(owner, bytes) and isinstance(user, bytes) and isinstance(permissions, int | float)):
        return None
    filters = {"Identity": "None"}
    strings = streams = "V2"
    if version in (4, 5):
        known = {"None", "V2", "AESV2", "AESV3"}
        filters |= {k: v["CFM"] for k, v in (entries.get("CF") or {}).items() if isinstance(v, dict) and v.get("CFM") in known}
        strings, streams = (filters.get(entries.get(k, "Identity")) for k in ("StrF", "StmF"))
    if version not in (1, 2, 4, 5) or strings is None or streams is None:
        return None
    if revision >= 5:
        password = password[:127]
        for is_owner in (True, False):
            check, wrapped, extra = (owner, entries.get("OE"), user[:48]) if is_owner else (user, entries.get("UE"), b"")
            if isinstance(wrapped, bytes) and hardened(password, check[32:40], extra, revision) == check[:32]:
                key = aes_cbc_decrypt(hardened(password, check[40:48], extra, revision), bytes(16), wrapped[:32])
                return Security(key, strings, streams, filters, is_owner)
        return None
    size = 5 if revision == 2 else 16 if version == 4 else int(entries.get("Length", 40)) // 8
    if not 5 <= size <= 16:
        return None
    inner = _chained_rc4(_owner_key(password, revision, size), owner[:32], range(19, -1, -1) if revision >= 3 else range(1))
    for is_owner, tried in ((True, inner), (False, password)):
        key = legacy_key(tried, owner, int(permissions), file_id, revision, size, entries.get("EncryptMetadata", True) is not False)
        check = legacy_user(key, file_id, revision)
        if user[: len(check)] == check:
            return Security(key, strings, streams, filters, is_owner)
    return None


def protect(objects: dict[int, object], method: str, file_id: bytes, user_password: bytes = b"", owner_password: bytes = b"owner", permissions: int = -4) -> tuple[dict[int, object], dict]:
    """Objects encrypted by RC4 (V2), AESV2 or AESV3, and the /Encrypt dictionary; for files this library writes."""
    if method == "AESV3":
        key, salts = secrets.token_bytes(32), [secrets.token_bytes(8) for _ in range(4)]
        user = hardened(user_password, salts[0], b"", 6) + salts[0] + salts[1]
        owner = hardened(owner_password, salts[2], user, 6) + salts[2] + salts[3]
        wrapped = {
            "UE": aes_cbc_encrypt(hardened(user_password, salts[1], b"", 6), bytes(16), key),
            "OE": aes_cbc_encrypt(hardened(owner_password, salts[3], user, 6), bytes(16), key),
        }
        entries = {"V": 5, "R": 6, "Length": 256, "O": owner, "U": user} | wrapped
    else:
        revision = 4 if method == "AESV2" else 3
        owner = legacy_owner(owner_password, user_password, revision, 16)
        key = legacy_key(user_password, owner, permissions, file_id, revision, 16, True)
        entries = {"V": 4 if method == "AESV2" else 2, "R": revision, "Length": 128, "O": owner, "U": legacy_user(key, file_id, revision) + bytes(16)}
    entries |= {"Filter": Name("Standard"), "P": permissions}
    if method != "V2":
        entries |= {"CF": {"StdCF": {"CFM": Name(method)}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def sealed(value, number: int):
        if isinstance(value, dict) and not isinstance(value, Ref):
            return {k: sealed(v, number) for k, v in value.items()}
        if isinstance(value, list):
            return [sealed(v, number) for v in value]
        if isinstance(value, Stream):
            return Stream(sealed(value.entries, number), _seal(value.data, number))
        return _seal(value, number) if isinstance(value, bytes) else value

    def _seal(data: bytes, number: int) -> bytes:
        if method == "AESV3":
            iv = secrets.token_bytes(16)
            return iv + aes_cbc_encrypt(key, iv, pad(data))
        own = _md5(key + number.to_bytes(3, "little") + bytes(2) + (b"sAlT" if method == "AESV2" else b""))
        if method == "V2":
            return rc4(own, data)
        iv = secrets.token_bytes(16)
        return iv + aes_cbc_encrypt(own, iv, pad(data))

    return {n: sealed(v, n) for n, v in objects.items()}, entries
