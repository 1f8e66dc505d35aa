"""Queries over PDF files that are made of the tables' rows and read back; their SQL works on the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import objects
from ..operators import content
from ..sources import pack, parts, pdf
from .catalogue import Read, _query


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a table of few files dealt out to all cores, since making and reading files costs more than moving rows; many files stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def _joined_pages(files: DataFrame, password: str = "") -> DataFrame:
    """(path, text) of whole files: their pages in order."""
    pages = parts.page_text(files, password)
    whole = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("path").agg(F.array_join(F.transform(whole, lambda p: p["text"]), "\n").alias("text"))


def _documents(read: Read) -> DataFrame:
    return _spread(read("documents").select(F.col("doc_id").cast("string").alias("path"), "text"))


@_query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def q_pdf_text(read: Read) -> DataFrame:
    """Text through a writer, cross references, deflated streams, a two-byte font and its ToUnicode map."""
    return _joined_pages(pack.pack(_documents(read), pack.text_file)).select(F.col("path").cast("long").alias("doc_id"), "text")


@_query("SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations")
def q_pdf_protected(read: Read) -> DataFrame:
    """The same through a file protected by AES, opened with its password."""
    rows = _spread(read("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), "text"))
    found = _joined_pages(pack.pack(rows, pack.protected("AESV2", "pass")), "pass")
    at = F.split("path", "/")
    return found.select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), "text")


@_query("""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines FROM documents)
    SELECT doc_id, CAST((lines + 49) // 50 AS BIGINT) AS n_pages, CAST(4 + 2 * ((lines + 49) // 50) AS BIGINT) AS n_objects, CAST(lines AS BIGINT) AS n_shown FROM n""")
def q_pdf_inventory(read: Read) -> DataFrame:
    """Pages, objects and text operations of each file, from three scans that share nothing but the files."""
    files = pack.pack(_documents(read), pack.text_file)
    pages = pdf.read(files, "pages")
    shown = content.content_operations(pages).groupBy("path").agg(F.countDistinct("page_no").alias("n_pages"), F.count(F.when(F.col("op") == "Tj", 1)).alias("n_shown"))
    objects = pdf.read(files, "objects").groupBy("path").agg(F.count("*").alias("n_objects"))
    return shown.join(objects, "path").select(F.col("path").cast("long").alias("doc_id"), "n_pages", "n_objects", "n_shown")


@_query("""
    SELECT p_partkey, seq, CAST(CASE seq WHEN 0 THEN 105 ELSE 0 END AS DOUBLE) AS x0, CAST(CASE seq WHEN 0 THEN 890 - h / 2 ELSE 1000 - h END AS DOUBLE) AS y0,
           CAST(CASE seq WHEN 0 THEN 105 + w / 2 ELSE w END AS DOUBLE) AS x1, CAST(CASE seq WHEN 0 THEN 890 ELSE 1000 END AS DOUBLE) AS y1,
           CASE seq WHEN 0 THEN '#' || printf('%02x', CAST(floor(shade * 255) AS INT)) || '0000' END AS fill
    FROM (SELECT p_partkey, p_size AS w, p_size * 2 AS h, (p_size % 5) / 4.0 AS shade FROM part) CROSS JOIN (VALUES (0), (1)) s(seq)""")
def q_pdf_draw_events(read: Read) -> DataFrame:
    """Painted paths of each file: matrices, saved states, colours and boxes in the drawn page's coordinates."""
    rows = _spread(read("part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_size").alias("w"), (F.col("p_size") * 2).alias("h"), ((F.col("p_size") % 5) / 4.0).alias("shade")))
    events = parts.read(pack.pack(rows, pack.drawing_file), "events").where("kind = 'path'")
    box = [F.col("box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return events.select(F.col("path").cast("long").alias("p_partkey"), "seq", *box, "fill")


@_query("SELECT page_id, 'a' AS kind, page_id || '.html' AS name, sha256(coalesce(html, '')) AS digest FROM pages UNION ALL SELECT page_id, 'l', coalesce(url, ''), '10,20,110,40' FROM pages")
def q_pdf_attachments_links(read: Read) -> DataFrame:
    """Attached files by name and digest, links by address and rectangle."""
    rows = _spread(read("pages").select(F.col("page_id").cast("string").alias("path"), "url", "html"))
    files = pack.pack(rows, pack.attachment_file)
    attached = parts.read(files, "attachments").select("path", F.lit("a").alias("kind"), "name", F.sha2("content", 256).alias("digest"))
    linked = parts.read(files, "links").select("path", F.lit("l").alias("kind"), F.col("uri").alias("name"), F.array_join(F.transform("box", lambda v: v.cast("int").cast("string")), ",").alias("digest"))
    return attached.unionByName(linked).select(F.col("path").cast("long").alias("page_id"), "kind", "name", "digest")


@_query("SELECT c_custkey, c_name AS title, c_mktsegment AS author, '1.7' AS pdf_version, 1 AS n_pages FROM customer")
def q_pdf_info(read: Read) -> DataFrame:
    """Document information: UTF-16 and Latin text strings, version and page count."""
    rows = _spread(read("customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author")))
    found = pdf.read(pack.pack(rows, pack.titled_file), "documents")
    return found.select(F.col("path").cast("long").alias("c_custkey"), "title", "author", "pdf_version", "n_pages")


@_query("""
    SELECT p_partkey, 1 AS page_no, '1000' AS width, [concat('M105 ', 890, ' L', 105 + w, ' 890 L', 105 + w, ' ', 890 - h, ' L105 ', 890 - h, ' Z'), concat('M0 1000 L', 2 * w, ' ', 1000 - 2 * h)]::VARCHAR AS paths,
           printf('#%02x0000', CAST(floor(w % 5 / 4.0 * 255) AS INT)) AS fill
    FROM (SELECT p_partkey, CAST(p_size AS INT) AS w, CAST(p_partkey % 50 AS INT) AS h FROM part)""")
def q_pdf_svg(read: Read) -> DataFrame:
    """Pages as SVG: width, path data and colours, taken from the XML."""
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = _spread(read("part").select(key.cast("string").alias("path"), (size * 2).alias("w"), (key % 50 * 2).alias("h"), ((size % 5) / 4.0).alias("shade")))
    pages = parts.read(pack.pack(rows, pack.drawing_file), "svg")
    listed = F.concat(F.lit("["), F.array_join(F.regexp_extract_all("svg", F.lit(' d="([^"]*)"'), F.lit(1)), ", "), F.lit("]"))
    drawn = F.regexp_extract("svg", ' fill="(#[^"]*)"', 1)
    return pages.select(F.col("path").cast("long").alias("p_partkey"), "page_no", F.regexp_extract("svg", 'width="([^"]*)"', 1).alias("width"), listed.alias("paths"), drawn.alias("fill"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k_real, -1 AS missing FROM events")
def q_path_projection(read: Read) -> DataFrame:
    """Values at paths of names, coerced to a type, with a default where a step is missing."""
    props = F.col("props")
    k = objects.at(props, "k")
    return read("events").select("event_id", objects.integer(k).alias("k"), objects.either(objects.real(k), 0.0).alias("k_real"), objects.either(objects.integer(objects.at(props, "none", 0, "deeper")), -1).alias("missing"))


@_query("""
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'recovered' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'password required' ELSE 'damaged' END AS status,
           CASE WHEN doc_id % 5 IN (0, 1, 4) THEN CAST((length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 50) // 50 AS INT) END AS n_pages
    FROM documents""")
def q_pdf_status(read: Read) -> DataFrame:
    """The status of whole files, of files without cross references, without a header, locked ones and ones with pages that can't be read."""
    found = pdf.read(pack.pack(_documents(read), pack.damaged_file), "files")
    return found.select(F.col("path").cast("long").alias("doc_id"), "status", "n_pages")


@_query("SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 5 IN (0, 1)")
def q_pdf_recovered_text(read: Read) -> DataFrame:
    """Texts of the same files that can be read: whole ones and those whose objects are found by a scan."""
    return _joined_pages(pack.pack(_documents(read), pack.damaged_file)).select(F.col("path").cast("long").alias("doc_id"), "text")
