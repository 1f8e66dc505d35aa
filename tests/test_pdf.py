import base64
import zlib

import numpy as np
import pytest

from docframe.operators import content
from docframe.sources import filters, pdf
from docframe.streaming import ingest


def build(objects: dict[int, bytes], xref=True, lead=b"", root=1, extra=b"") -> bytes:
    out, at = bytearray(b"%PDF-1.4\n"), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    if xref:
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in at.items())
        out += b"trailer\n<< /Root %d 0 R %s>>\nstartxref\n%d\n%%%%EOF" % (root, extra, start)
    return lead + bytes(out)


def stream(data: bytes, entries: bytes = b"") -> bytes:
    return b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), entries, data)


TEXT = b"q 1 0 0 1 10 20 cm BT /F1 12 Tf 14 TL 1 0 0 1 5 6 Tm (Hello) Tj T* [(Wor) -1000 (ld)] TJ 3 Tr (x) ' ET Q Q BT (at \\(0\\)) Tj ET 5 Td"


def simple(**kw) -> bytes:
    return build({
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 2 0 R] /MediaBox [0 0 200 100] /Rotate 90 >>",
        3: b"<< /Type /Page /Contents [5 0 R 6 0 R] >>",
        4: b"<< /Type /Page /Rotate 0 /MediaBox [0 0 10 10] /Missing 99 0 R >>",
        5: stream(zlib.compress(TEXT[:40]), b"/Filter /FlateDecode "),
        6: stream(base64.a85encode(zlib.compress(TEXT[40:])) + b"~>", b"/Filter [/A85 /Fl] "),
        7: b"<< /Title <FEFF00C40062> /Author (A\\101) >>",
    }, extra=b"/Info 7 0 R ", **kw)


@pytest.mark.parametrize("kw", [{}, {"lead": b"garbage\n"}, {"xref": False}])
def test_pages_and_text(spark, kw):
    files = spark.createDataFrame([("a.pdf", bytearray(simple(**kw))), ("b.pdf", bytearray(b"no pdf")), ("c.pdf", None)], "path string, content binary")
    pages = pdf.read(files, "pages")
    rows = pages.orderBy("page_no").collect()
    assert [(r.page_no, r.num, r.media_box, r.rotate) for r in rows] == [(1, 3, [0, 0, 200, 100], 90), (2, 4, [0, 0, 10, 10], 0)]
    spans = [(r.text, r.x, r.y, r.size, r.visible) for r in content.text_spans(pages).where("page_no = 1").orderBy("seq").collect()]
    assert spans == [("Hello", 15, 26, 12, True), ("Wor", 15, 12, 12, True), ("ld", 27, 12, 12, True), ("x", 15, -2, 12, False), ("at (0)", 0, 0, 0, True)]
    assert content.content_operations(pages).where("op = 'Tj'").count() == 2
    info = pdf.read(files, "documents").first()
    assert (info.pdf_version, info.n_pages, info.is_recovered) == ("1.4", 2, not kw.get("xref", True))
    assert (info.title, info.author) == (("Äb", "AA") if kw.get("xref", True) else (None, None))


def test_references(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(simple()))], "path string, content binary")
    objects = pdf.read(files, "objects")
    assert objects.count() == 7
    assert [(r.num, r.target) for r in pdf.references(objects).where("is_dangling").collect()] == [(4, 99)]


def test_xref_and_object_streams():
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 6 0 R >>"}
    head, body = b"", b""
    for n, v in inner.items():
        head += b"%d %d " % (n, len(body))
        body += v + b" "
    packed = b"5 0 obj\n" + stream(zlib.compress(head + body), b"/Type /ObjStm /N 3 /First %d /Filter /FlateDecode " % len(head)) + b"\nendobj\n"
    out = b"%PDF-1.5\n" + packed
    at6 = len(out)
    out += b"6 0 obj\n" + stream(b"BT (ok) Tj ET") + b"\nendobj\n"
    at7 = len(out)
    rows = [(0, 0, 0), (2, 5, 0), (2, 5, 1), (2, 5, 2), (0, 0, 0), (1, 9, 0), (1, at6, 0), (1, at7, 0)]
    plain = b"".join(bytes([a]) + b.to_bytes(2, "big") + bytes([c]) for a, b, c in rows)
    predicted = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(plain[i : i + 4], plain[i - 4 : i] if i else bytes(4))) for i in range(0, len(plain), 4))
    out += b"7 0 obj\n" + stream(zlib.compress(predicted), b"/Type /XRef /W [1 2 1] /Size 8 /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> ") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at7
    doc = pdf.Document(out)
    assert not doc.recovered and [doc.contents(p) for _, p in doc.pages()] == [b"BT (ok) Tj ET"]


def lzw_encode(data: bytes, early: int) -> bytes:
    table, codes, width, current = {bytes([i]): i for i in range(256)}, [(256, 9)], 9, b""
    size = 258
    for byte in data:
        grown = current + bytes([byte])
        if grown in table:
            current = grown
            continue
        codes.append((table[current], width))
        if size < 4096:
            table[grown] = size
            size += 1
        width = min(12, max(9, (size - 1 + early).bit_length()))
        current = bytes([byte])
    codes += [(table[current], width)] if current else []
    width = min(12, max(9, (size + early).bit_length()))
    bits = "".join(f"{c:0{w}b}" for c, w in [*codes, (257, width)])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("early", [0, 1])
def test_lzw_round_trip(early):
    data = bytes((i * i // 7) % 251 for i in range(3000))
    assert filters.lzw(lzw_encode(data, early), early) == data


def test_other_filters():
    assert filters.ascii_hex(b"48 65 6C6c 7>zz") == b"Hellp"
    assert filters.ascii85(base64.a85encode(b"some \0\0\0\0 bytes") + b"~>") == b"some \0\0\0\0 bytes"
    assert filters.run_length(bytes([2, 65, 66, 67, 254, 90, 128, 1])) == b"ABCZZZ"
    assert filters.flate(zlib.compress(b"x" * 50)[:-6]).startswith(b"x")
    with pytest.raises(filters.FilterError):
        filters.decode(b"", ["JPXDecode"], [])


@pytest.mark.parametrize("bits, colors", [(1, 1), (2, 3), (4, 1), (4, 3), (8, 3), (16, 2)])
def test_tiff_predictor(bits, colors):
    columns, rows, top = 5, 3, 1 << bits
    whole = np.random.default_rng(bits).integers(0, top, (rows, columns, colors))
    change = np.diff(whole, axis=1, prepend=0) % top

    def packed(values) -> bytes:
        lines = ["".join(f"{v:0{bits}b}" for v in row.reshape(-1)) for row in values]
        return b"".join(int(t.ljust(-(-len(t) // 8) * 8, "0"), 2).to_bytes(-(-len(t) // 8), "big") for t in lines)

    assert filters.unpredict(packed(change), 2, colors, bits, columns) == packed(whole)


def test_streaming_reads_files_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(simple())
    query = ingest.stream(spark, str(folder), "pages").writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("landed").count() == 2
    query = ingest.stream(spark, str(folder), "svg").writeStream.format("memory").queryName("drawn").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("drawn").where("svg like '<svg%'").count() == 2
