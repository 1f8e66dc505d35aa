import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docframe.functions.charstrings import OPERATORS, CharStringError, Glyph, Machine, encode
from docframe.operators import svg
from docframe.sources import fonts, parts, pdf, programs, webfonts, writer
from docframe.sources.syntax import Name, Ref, Stream


def path(*values, **kw) -> str:
    return Machine(2, **kw).run(encode(values)).path()


@pytest.mark.parametrize(
    "values, expected",
    [
        ((10, 20, "rmoveto", 5, 5, "rlineto", "endchar"), "M10 20 L15 25 Z"),
        ((1, "hmoveto", 5, 6, 7, "hlineto", "endchar"), "M1 0 L6 0 L6 6 L13 6 Z"),
        ((1, "vmoveto", 5, 6, "vlineto", "endchar"), "M0 1 L0 6 L6 6 Z"),
        ((0, "hmoveto", 1, 2, 3, 4, 5, 6, "rrcurveto", "endchar"), "M0 0 C1 2 4 6 9 12 Z"),
        ((0, "hmoveto", 9, 1, 2, 3, 4, "hhcurveto", "endchar"), "M0 0 C1 9 3 12 7 12 Z"),
        ((0, "hmoveto", 9, 1, 2, 3, 4, "vvcurveto", "endchar"), "M0 0 C9 1 11 4 11 8 Z"),
        ((0, "hmoveto", 1, 2, 3, 4, 5, "hvcurveto", "endchar"), "M0 0 C1 0 3 3 8 7 Z"),
        ((0, "hmoveto", 1, 2, 3, 4, 1, 2, 3, 4, "vhcurveto", "endchar"), "M0 0 C0 1 2 4 6 4 C7 4 9 7 9 11 Z"),
        ((0, "hmoveto", 1, 1, 1, 1, 1, 1, 2, 2, "rcurveline", "endchar"), "M0 0 C1 1 2 2 3 3 L5 5 Z"),
        ((0, "hmoveto", 2, 2, 1, 1, 1, 1, 1, 1, "rlinecurve", "endchar"), "M0 0 L2 2 C3 3 4 4 5 5 Z"),
        ((0, "hmoveto", 1, 2, 3, 4, 5, 6, 7, "hflex", "endchar"), "M0 0 C1 0 3 3 7 3 C12 3 18 0 25 0 Z"),
        ((0, "hmoveto", 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 50, "flex", "endchar"), "M0 0 C1 1 2 2 3 3 C4 4 5 5 6 6 Z"),
        ((0, "hmoveto", 1, 1, 1, 1, 1, 1, 1, 1, 1, "hflex1", "endchar"), "M0 0 C1 1 2 2 3 2 C4 2 5 3 6 0 Z"),
        ((0, "hmoveto", 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 7, "flex1", "endchar"), "M0 0 C2 1 4 2 6 3 C8 4 10 5 17 0 Z"),
    ],
)
def test_outlines(values, expected):
    assert path(*values) == expected


@pytest.mark.parametrize(
    "values, top",
    [
        ((-3, "abs"), 3), ((2, 3, "add"), 5), ((2, 3, "sub"), -1), ((3, 2, "div"), 1.5), ((3, "neg"), -3), (("random",), 0.42), ((4, 3, "mul"), 12), ((9, "sqrt"), 3),
        ((7, 1, 2, 2, "drop"), 7), ((1, 2, "exch"), 1), ((5, 6, 7, 2, "index"), 5), ((5, 6, -1, "index"), 6), ((1, 2, 3, 3, 1, "roll"), 2), ((8, "dup", "add"), 16),
        ((9, 3, "put", 3, "get"), 9), ((99, "get"), 0), ((1, 2, "and"), 1), ((0, 0, "or"), 0), ((0, "not"), 1), ((2, 2, "eq"), 1), ((1, 2, 3, 4, "ifelse"), 1), ((1, 2, 5, 4, "ifelse"), 2),
    ],
)
def test_arithmetic(values, top):
    m = Machine()
    m.execute(encode(values), 0)
    assert m.stack[-1] == top


def test_widths_hints_and_subroutines():
    m = Machine(2, local=[encode((1, 1, "rlineto", "return"))])
    g = m.run(encode((55, 10, 20, "hstemhm", 1, 2, 3, 4, "hintmask")) + b"\xe0" + encode((5, 5, "rmoveto", -107, "callsubr", "endchar")))
    assert (g.width, g.path(), g.hints) == (55, "M5 5 L6 6 Z", [("h", 10, 20), ("v", 1, 2), ("v", 6, 4)])
    assert len(OPERATORS) == 57
    for bad in ((1, "rmoveto"), (5, "callsubr"), ("exch",), (1, 5, 1, "roll")):
        with pytest.raises(CharStringError):
            path(*bad)
    endless = Machine(2, local=[encode((-107, "callsubr"))])
    with pytest.raises(CharStringError):
        endless.run(encode((-107, "callsubr")))


def old(*values) -> bytes:
    return encode(values)


def test_type1_machine():
    flex = old(10, 500, "hsbw", 0, 1, "callothersubr")
    g = Machine(1).run(old(10, 500, "hsbw", 5, "hmoveto", 0, 1, "callothersubr") + b"".join(old(*p, "rmoveto", 0, 2, "callothersubr") for p in [(10, 0), (0, 5), (5, 5), (5, 0), (5, 0), (5, -5), (0, -5)])
        + old(50, 45, 0, 3, 0, "callothersubr", "pop", "pop", "setcurrentpoint", "closepath", "endchar"))
    assert flex and (g.width, g.path()) == (500, "M15 0 C25 5 30 10 35 10 C40 10 45 5 45 0 Z")
    g = Machine(1).run(old(1, 2, 600, 0, "sbw", 1, 2, 3, 4, 5, 6, "hstem3", "dotsection", 3, 4, "rmoveto", 1, 1, "rlineto", "closepath", "endchar"))
    assert (g.width, g.path(), len(g.hints)) == (600, "M4 6 L5 7 Z", 3)
    assert Machine(1).run(old(0, 500, "hsbw", 0, 10, 20, 65, 66, "seac")).seac == (10, 20, 65, 66)


def type1_file() -> bytes:
    sealed = lambda code: programs.encrypt(code, 4330)
    square = old(0, 500, "hsbw", 10, 0, "rmoveto", 0, "callsubr", "closepath", "endchar")
    accent = old(0, 300, "hsbw", 0, "hmoveto", 5, "hlineto", "closepath", "endchar")
    both = old(0, 500, "hsbw", 0, 100, 200, 65, 0xC2, "seac")
    entries = b"".join(b"/%s %d RD %s ND\n" % (n, len(sealed(c)), sealed(c)) for n, c in ((b"A", square), (b"acute", accent), (b"Aacute", both)))
    sub = sealed(old(10, 10, "rlineto", "return"))
    private = b"dup /Private 8 dict dup begin /lenIV 4 def /Subrs 1 array\ndup 0 %d RD %s NP\nND 2 index /CharStrings 3 dict dup begin\n%send" % (len(sub), sub, entries)
    return b"%!PS-AdobeFont-1.0\n/FontName /Test def /Encoding 256 array dup 65 /A put readonly def currentfile eexec\n" + programs.encrypt(private, 55665, b"\xf3\xf4\xf5\xf6")


def test_type1_file():
    p = programs.type1(type1_file())
    assert (p.name, p.codes, p.names) == ("Test", {65: 0}, ["A", "acute", "Aacute"])
    assert [g.path() for _, _, g in p.glyphs()] == ["M10 0 L20 10 Z", "M0 0 L5 0 Z", "M10 0 L20 10 Z M100 200 L105 200 Z"]


def index(items: list[bytes]) -> bytes:
    ends = [1]
    for i in items:
        ends.append(ends[-1] + len(i))
    return struct.pack(">H", len(items)) + (b"\x02" + b"".join(struct.pack(">H", e) for e in ends) + b"".join(items) if items else b"")


def cff_file() -> bytes:
    number = lambda v: b"\x1d" + struct.pack(">i", v)
    glyphs = index([encode(("endchar",)), encode((7, 1, 2, "rmoveto", -107, "callsubr", "endchar"))])
    private = number(400) + b"\x14" + number(600) + b"\x15" + number(18) + b"\x13"
    local = index([encode((3, 3, "rlineto", "return"))])
    head, names, own, shared = b"\1\0\4\1", index([b"Mine"]), index([b"star"]), index([])
    top = lambda a, b, c: number(a) + b"\x0f" + number(b) + b"\x11" + number(len(private)) + number(c) + b"\x12"
    at = len(head + names + index([top(0, 0, 0)]) + own + shared)
    charset = b"\0" + struct.pack(">H", 391)
    return head + names + index([top(at, at + len(charset), at + len(charset) + len(glyphs))]) + own + shared + charset + glyphs + private + local


def test_cff_file():
    p = programs.cff(cff_file())
    assert (p.name, p.names, p.units) == ("Mine", [".notdef", "star"], 1000)
    assert [(g.width, g.path()) for _, _, g in p.glyphs()] == [(400, ""), (607, "M1 2 L4 5 Z")]


def truetype_file() -> bytes:
    box = struct.pack(">hhhhhH", 1, 0, 0, 100, 100, 3) + struct.pack(">H", 0) + bytes([1, 1, 1, 1]) + struct.pack(">hhhh", 0, 100, 0, -100) + struct.pack(">hhhh", 0, 0, 100, 0)
    curve = struct.pack(">hhhhhH", 1, 0, 0, 100, 100, 2) + struct.pack(">H", 0) + bytes([1, 0, 1]) + struct.pack(">hhh", 0, 30, 30) + struct.pack(">hhh", 0, 60, -60)
    pair = struct.pack(">hhhhh", -1, 0, 0, 0, 0) + struct.pack(">HHbb", 2 | 32, 0, 5, 6) + struct.pack(">HHhhh", 1 | 2 | 8, 1, 200, 0, 8192)
    bodies = [b + bytes(-len(b) % 4) for b in (box, curve, pair)]
    places = [0]
    for b in bodies:
        places.append(places[-1] + len(b))
    return programs.open_type({
        "head": bytes(18) + struct.pack(">H", 2048) + bytes(30) + struct.pack(">hh", 1, 0), "maxp": struct.pack(">IH", 0x10000, 3), "hhea": bytes(34) + struct.pack(">H", 2),
        "hmtx": struct.pack(">HhHhh", 500, 0, 600, 0, 0), "loca": struct.pack(">4I", *places), "glyf": b"".join(bodies), "cmap": programs.character_map_table({65: 0, 66: 1, 0x1F600: 2}),
    })


def test_truetype_file():
    p = programs.truetype(truetype_file())
    assert (p.units, p.count, p.codes) == (2048, 3, {66: 1, 0x1F600: 2, 65: 0})
    box, curve, pair = [g for _, _, g in p.glyphs()]
    assert (box.width, box.path()) == (500, "M0 0 L100 0 L100 100 L0 100 L0 0 Z")
    assert curve.path() == "M0 0 C20 40 40 40 60 0 L0 0 Z"
    assert pair.width == 600 and len(pair.segments) == len(box.segments) + len(curve.segments)
    wrapped = programs.woff(truetype_file())
    assert wrapped[:4] == b"wOFF" and struct.unpack(">I", wrapped[8:12])[0] == len(wrapped)
    tag, at, packed, full, _ = struct.unpack(">4sIIII", wrapped[44:64])
    body = wrapped[at : at + packed]
    assert (zlib.decompress(body) if packed < full else body) == programs.tables(truetype_file())[tag.decode()]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.one_of(st.integers(1, 0xFFFE), st.integers(0x10000, 0x10FFFF)), st.integers(1, 0xFFFF), min_size=1, max_size=60))
def test_character_map_round_trip(codes):
    assert programs.character_map(programs.character_map_table(codes)) == codes


def test_glyph_rows(spark):
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)]},
        3: {"Type": Name("Page"), "Resources": {"Font": {n: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(n), "FontDescriptor": {k: Ref(r, 0)}} for n, k, r in (("A", "FontFile", 4), ("B", "FontFile3", 5), ("C", "FontFile2", 6), ("D", "FontFile2", 7))}}},
        4: Stream({}, type1_file()), 5: Stream({}, cff_file()), 6: Stream({}, truetype_file()), 7: Stream({}, b"broken")}
    files = spark.createDataFrame([("a", bytearray(writer.write(objects)))], "path string, content binary")
    assert parts.read(files, "glyphs").count() == 3 + 2 + 3


def test_fonts_built_from_outlines():
    rng = np.random.default_rng(1)
    glyphs = [(".notdef", Glyph(500.0))]
    for i in range(300):
        points = rng.integers(-2000, 2000, (6, 2)).tolist()
        p = [tuple(map(float, x)) for x in points]
        glyphs.append((f"n{i}", Glyph(float(rng.integers(0, 2000)), [("M", (p[0],)), ("L", (p[1],)), ("C", (p[2], p[3], p[4])), ("Z", ()), ("M", (p[5],)), ("Z", ())])))
    codes = {65 + i: i + 1 for i in range(300)}
    for units in (1000, 2048):
        data = webfonts.open_type("Made Up", glyphs, codes, units)
        found = programs.truetype(data)
        assert (found.units, found.count, found.codes, found.names[1:]) == (units, 301, codes, [n for n, _ in glyphs[1:]])
        assert [(g.width, g.path()) for _, _, g in found.glyphs()] == [(g.width, g.path()) for _, g in glyphs]
        t = programs.tables(data)
        assert [len(t[k]) for k in ("head", "hhea", "OS/2", "post", "maxp")] == [54, 36, 96, 32, 6] and "Made Up".encode("utf-16-be") in t["name"]
        assert programs._checksum(data) == 0xB1B0AFBA


def test_svg_with_embedded_fonts():
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "MediaBox": [0, 0, 99, 99]},
        3: {"Type": Name("Page"), "Contents": Ref(4, 0), "Resources": {"Font": {n: {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name(n), "Encoding": Name("WinAnsiEncoding"), "FontDescriptor": {"FontFile2": Ref(r, 0)}} for n, r in (("A", 5), ("B", 6))}}},
        4: Stream({}, b"BT /A 9 Tf (AB) Tj (B) Tj (Az) Tj /B 9 Tf (A) Tj ET"), 5: Stream({}, truetype_file()), 6: Stream({}, b"broken")}
    doc = pdf.Document(writer.write(objects))
    page = next(doc.pages())[1]
    plain = svg.svg(doc, page)
    assert "@font-face" not in plain and plain.count("sans-serif") == 1
    found = svg.svg(doc, page, embed_fonts=True)
    assert found.count("@font-face") == 1 and found.count('font-family="f1"') == 1 and ">AB</text>" in found and found.count("sans-serif") == 1
    asked = []
    assert "src:url(fonts/a.woff)" in svg.svg(doc, page, font_url=lambda kind, data: asked.append((kind, data)) or "fonts/a.woff") and asked[0][0] == "font/woff" and asked[0][1][:4] == b"wOFF"
    assert webfonts.WebFont(None, programs.truetype(truetype_file()), "f").text([fonts.Char(7, 1, 1, "fi", 1, False), fonts.Char(8, 1, 2, "xy", 1, False), fonts.Char(9, 1, 0, "\ufb01", 1, False)]) == "\ufb01\ue000\ue001"
