import glob

import pytest
from pyspark.sql import functions as F

from docframe import convert, sinks
from docframe.functions import objects
from docframe.sources import parts, writer
from docframe.sources.syntax import Name, Ref


def test_job_script(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(writer.text_file("\n".join(map(str, range(9))), 2))
    (source / "b.pdf").write_bytes(writer.text_file("x"))
    args = convert.arguments([str(source), str(tmp_path / "out"), "--pages", "2..3,5"])
    assert convert.run(spark, args) == 0
    assert sorted(p.split("/")[-3:-1] for p in glob.glob(f"{tmp_path}/out/*/*/*.txt")) == [["file=a", f"page_no={n}"] for n in (2, 3, 5)]
    (source / "c.pdf").write_bytes(writer.text_file("y", encrypt="V2", user_password=b"p"))
    assert convert.run(spark, args) == 5
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "a.pdf").write_bytes(b"nothing")
    assert convert.run(spark, convert.arguments([str(empty), str(tmp_path / "out2")])) == 1


def test_extract_permission(spark):
    plain = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)]}, 3: {"Type": Name("Page")}}
    made = writer.write(plain, encrypt="V2", permissions=-4 & ~16)
    files = spark.createDataFrame([("a", bytearray(made))], "path string, content binary")
    assert [r.status for r in parts.svg_pages(files).collect()] == ["extraction is not permitted"]
    assert parts.svg_pages(files, "owner").first().svg.startswith("<svg")


@pytest.mark.parametrize(
    "value, expected",
    [
        ('{"A": {"B": [1, 2.9, "x"]}}', (2, 2.9, None, [1, 0, 0, 1, 0, 0])),
        ('{"A": {"B": [1, -2.9]}, "M": [1, 2, 3, 4, 5, 6], "R": {"$ref": [7, 0]}}', (-2, -2.9, 7, [1, 2, 3, 4, 5, 6])),
        ('{"A": {"B": [1, "2x"]}, "M": [1, 2], "R": 7}', (None, None, None, [1, 0, 0, 1, 0, 0])),
        ("null", (None, None, None, [1, 0, 0, 1, 0, 0])),
    ],
)
def test_projections(spark, value, expected):
    v = F.col("v")
    row = spark.createDataFrame([(value,)], "v string").select(
        objects.integer(objects.at(v, "A", "B", 1)), objects.real(objects.at(v, "A", "B", 1)), objects.reference(objects.at(v, "R")), objects.matrix(objects.at(v, "M"))
    )
    assert tuple(row.first()) == expected


def test_data_urls(spark):
    df = spark.createDataFrame([("image/png", bytearray(b"abc"))], "content_type string, content binary")
    assert sinks.data_urls(df).first().data_url == "data:image/png;base64,YWJj"
