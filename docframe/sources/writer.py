"""Writes PDF files from objects, for round trips and for packing texts of a table into files."""

from __future__ import annotations

import hashlib
import re
import zlib

from . import encoders, security
from .syntax import Name, Ref, Stream


def serialize(value) -> bytes:
    if value is None or isinstance(value, bool):
        return {None: b"null", True: b"true", False: b"false"}[value]
    if isinstance(value, Ref):
        return b"%d %d R" % (value.number, value.generation)
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".").encode()
    if isinstance(value, str):
        return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m.group()[0], value.encode("latin-1"))
    if isinstance(value, bytes):
        return b"<" + value.hex().upper().encode() + b">"
    if isinstance(value, list):
        return b"[" + b" ".join(map(serialize, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(serialize(Name(k)) + b" " + serialize(v) for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return serialize(value.entries | {"Length": len(value.data)}) + b"\nstream\n" + value.data + b"\nendstream"
    raise TypeError(type(value).__name__)


def flate(entries: dict, data: bytes) -> Stream:
    return Stream(entries | {"Filter": Name("FlateDecode")}, zlib.compress(data))


def write(objects: dict[int, object], root: int = 1, info: int | None = None, encrypt: str | None = None, user_password: bytes = b"", permissions: int = -4) -> bytes:
    """A file of numbered objects with one cross-reference table; encrypted by V2, AESV2 or AESV3 if asked for."""
    file_id = hashlib.sha256(b"".join(serialize(v) for v in objects.values())).digest()[:16]
    trailer = {"Root": Ref(root, 0), "ID": [file_id, file_id], "Size": max(objects) + 2}
    if info:
        trailer["Info"] = Ref(info, 0)
    if encrypt:
        number = max(objects) + 1
        objects, entries = security.protect(objects, encrypt, file_id, user_password, permissions=permissions)
        objects, trailer["Encrypt"] = objects | {number: entries}, Ref(number, 0)
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for n, value in sorted(objects.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + serialize(value) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in at.items())
    return bytes(out + b"trailer\n" + serialize(trailer) + b"\nstartxref\n%d\n%%%%EOF" % start)


def unicode_map(text: str) -> tuple[dict[str, int], bytes]:
    """Two-byte codes for the distinct characters of a text, and the ToUnicode program that leads back."""
    codes = {c: i + 1 for i, c in enumerate(sorted(set(text)))}
    lines = [f"<{n:04X}> <{c.encode('utf-16-be').hex().upper()}>" for c, n in codes.items()]
    chars = "\n".join(f"{len(lines[i : i + 100])} beginbfchar\n" + "\n".join(lines[i : i + 100]) + "\nendbfchar" for i in range(0, len(lines), 100))
    program = f"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n{chars}\nendcmap end"
    return codes, program.encode("ascii")


def write_compressed(objects: dict[int, object], root: int = 1) -> bytes:
    """The same objects with all but streams in one object stream, and a cross-reference stream with a predictor."""
    inner = {n: v for n, v in sorted(objects.items()) if not isinstance(v, Stream)}
    holder, table = max(objects) + 1, max(objects) + 2
    head, body = b"", b""
    for n, v in inner.items():
        head += b"%d %d " % (n, len(body))
        body += serialize(v) + b" "
    outer = {n: v for n, v in objects.items() if isinstance(v, Stream)}
    outer[holder] = flate({"Type": Name("ObjStm"), "N": len(inner), "First": len(head)}, head + body)
    out, rows = bytearray(b"%PDF-1.5\n"), {n: (2, holder, i) for i, n in enumerate(inner)}
    for n, v in sorted(outer.items()):
        rows[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + serialize(v) + b"\nendobj\n"
    start = rows_at = len(out)
    rows[table] = (1, rows_at, 0)
    plain = b"".join(bytes([k]) + a.to_bytes(4, "big") + i.to_bytes(2, "big") for k, a, i in (rows.get(n, (0, 0, 0)) for n in range(table + 1)))
    entries = {"Type": Name("XRef"), "W": [1, 4, 2], "Size": table + 1, "Root": Ref(root, 0), "DecodeParms": {"Predictor": 12, "Columns": 7}}
    out += b"%d 0 obj\n" % table + serialize(flate(entries, encoders.png_predicted(plain, 7, kinds=(2,)))) + b"\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF" % start)


def update(data: bytes, objects: dict[int, object], root: int = 1) -> bytes:
    """A file with newer objects after its end, whose cross references lead back to the older ones."""
    before = int(re.findall(rb"startxref\s+(\d+)", data)[-1])
    out, at = bytearray(data + b"\n"), {}
    for n, value in sorted(objects.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + serialize(value) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in at.items())
    return bytes(out + b"trailer\n" + serialize({"Root": Ref(root, 0), "Size": max(objects) + 1, "Prev": before}) + b"\nstartxref\n%d\n%%%%EOF" % start)


def text_file(text: str, lines_per_page: int = 50, encrypt: str | None = None, user_password: bytes = b"") -> bytes:
    """A text as pages of one shown string a line (split at \\n), in a two-byte font with a ToUnicode map."""
    return write(text_objects(text, lines_per_page), encrypt=encrypt, user_password=user_password)


def text_objects(text: str, lines_per_page: int = 50) -> dict[int, object]:
    """The objects of text_file()."""
    lines = text.split("\n")
    codes, program = unicode_map(text.replace("\n", ""))
    shown = [b"<" + b"".join(b"%04X" % codes[c] for c in line) + b"> Tj T*" for line in lines]
    chunks = [shown[i : i + lines_per_page] for i in range(0, len(shown), lines_per_page)]
    objects: dict[int, object] = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)},
        2: {"Type": Name("Pages"), "Count": len(chunks), "Kids": [Ref(5 + 2 * i, 0) for i in range(len(chunks))], "MediaBox": [0, 0, 595, 842], "Resources": {"Font": {"F1": Ref(3, 0)}}},
        3: {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Plain"), "Encoding": Name("Identity-H"), "ToUnicode": Ref(4, 0), "DescendantFonts": [{"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "DW": 500}]},
        4: flate({}, program),
    }
    for i, chunk in enumerate(chunks):
        objects[5 + 2 * i] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(6 + 2 * i, 0)}
        objects[6 + 2 * i] = flate({}, b"BT /F1 10 Tf 12 TL 1 0 0 1 40 800 Tm\n" + b"\n".join(chunk) + b"\nET")
    return objects
