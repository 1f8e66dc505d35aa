"""Damaged files: no exception leaves a file's rows, and each file has a status."""

import random

import pytest

from docframe.sources import pack, parts, pdf, writer
from docframe.sources.syntax import Name, Ref, Stream


def samples():
    note = [{"Subtype": Name("Link"), "Rect": [1, 2, 3, 4], "A": {"S": Name("URI"), "URI": b"http://a"}}, {"Subtype": Name("FileAttachment"), "FS": {"UF": b"n", "EF": {"UF": Ref(6, 0)}}}]
    rich = pack.one_page(
        b"q /G gs /F Do 1 0 0 rg 0 0 5 5 re f /I Do /OC /L BDC BT /T 9 Tf (ab) Tj ET EMC Q BI /W 1 /H 1 /CS /G /BPC 8 ID \x00 EI",
        {"Annots": note, "Rotate": 90, "Resources": {"ExtGState": {"G": {"LW": 2, "ca": 0.5}}, "XObject": {"F": Ref(7, 0), "I": Ref(8, 0)}, "Properties": {"L": Ref(9, 0)}, "Font": {"T": Ref(10, 0)}}},
        {
            6: writer.flate({}, b"body"), 7: Stream({"Subtype": Name("Form"), "BBox": [0, 0, 9, 9], "Matrix": [1, 0, 0, 1, 2, 2]}, b"0 0 m 5 5 l S"),
            8: writer.flate({"Subtype": Name("Image"), "Width": 1, "Height": 1, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8}, b"abc"), 9: {"Type": Name("OCG"), "Name": b"l"},
            10: {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("A"), "Encoding": {"Differences": [97, Name("b")]}, "Widths": [500, 500], "FirstChar": 97, "LastChar": 98},
        },
        {"Title": b"t"},
    )
    return [rich, writer.text_file("one\ntwo"), writer.text_file("x", encrypt="AESV2"), writer.text_file("x", encrypt="V2")]


def damaged(rng, data):
    data = bytearray(data)
    kind = rng.randrange(4)
    if kind == 0:
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
    elif kind == 1:
        a = rng.randrange(len(data))
        del data[a : a + rng.randrange(1, 60)]
    elif kind == 2:
        a, b = (rng.randrange(len(data)) for _ in range(2))
        data[a:a] = data[b : b + rng.randrange(1, 60)]
    else:  # a value of another kind
        words = [b"null", b"(s)", b"[1 2]", b"<</A 1>>", b"/N", b"-1", b"3 0 R", b"99999999999", b"true", b"1.5"]
        spots = [i for i in range(1, len(data) - 1) if data[i - 1 : i] in (b" ", b"[") and data[i : i + 1] in b"0123456789[/<("]
        a = rng.choice(spots)
        data[a : a + rng.randrange(1, 9)] = rng.choice(words)
    return bytes(data)


KINDS = {k: v[0] for k, v in (pdf._KINDS | parts.KINDS).items()}


def test_no_exception_leaves_a_document():
    """What rows() itself raises is counted too: only files that are unreadable as a whole may raise."""
    rng, raised = random.Random(1), {}
    for base in samples():
        for _ in range(150):
            data = damaged(rng, base)
            try:
                doc = pdf.Document(data)
            except ValueError:
                continue
            except Exception as e:
                raised["open"] = repr(e)
                continue
            for kind, rows in KINDS.items():
                try:
                    list(rows(doc))
                except Exception as e:
                    raised.setdefault(kind, repr(e))
    assert not raised


def test_every_file_has_one_status(spark):
    rng = random.Random(2)
    files = [damaged(rng, b) for b in samples() for _ in range(10)] + [b"", b"no pdf", None]
    frame = spark.createDataFrame([(str(i), f) for i, f in enumerate(files)], "path string, content binary")
    found = {r.path: r for r in pdf.read(frame, "files").collect()}
    assert set(found) == set(map(str, range(len(files)))) and found["40"].status == found["42"].status == "unreadable" and found["41"].error == "no PDF header"
    for kind in KINDS:
        (parts.read if kind in parts.KINDS else pdf.read)(frame, kind).collect()


@pytest.mark.parametrize("change, status", [(lambda d: d, "ok"), (lambda d: d[: d.index(b"xref")], "recovered"), (lambda d: d[d.index(b"1 0 obj") :], "unreadable"), (lambda d: d.replace(b"/Kids", b"/Kid_"), "empty"), (lambda d: d.replace(b"/FlateDecode", b"/FlateDecodx"), "damaged")])
def test_statuses(spark, change, status):
    frame = spark.createDataFrame([("a", change(writer.text_file("some text")))], "path string, content binary")
    assert pdf.read(frame, "files").first().status == status


def test_rows_of_a_large_file_come_in_batches(spark):
    frame = spark.createDataFrame([("a", writer.text_file("\n".join(f"l{i}" for i in range(3000))))], "path string, content binary")
    events = parts.read(frame, "events").where("kind = 'text'")
    assert [r.text for r in events.orderBy("page_no", "seq").collect()] == [f"l{i}" for i in range(3000)]
