"""Strings, dates, identifiers and flags of documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def decode_text(raw: Column) -> Column:
    """Bytes by their mark: UTF-8, UTF-16 (big endian), else Latin text."""
    head = F.hex(F.substring(raw, 1, 3))
    text = F.when(head == "EFBBBF", F.decode(F.substring(raw, 4, 1 << 30), "UTF-8"))
    text = text.when(F.substring(head, 1, 4) == "FEFF", F.decode(F.substring(raw, 3, 1 << 30), "UTF-16BE"))
    return text.otherwise(F.decode(raw, "ISO-8859-1"))


def replace_invalid(text: Column) -> Column:
    """Control characters and the last two code points become U+FFFD; a soft hyphen becomes a hyphen."""
    clean = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "�")
    return F.regexp_replace(clean, "­", "-")


def might_be_rtl(text: Column) -> Column:
    return text.rlike("[\\u0590-\\u08FF\\uFB1D-\\uFDFF\\uFE70-\\uFEFF]")


def has_bidi_control(text: Column) -> Column:
    return text.rlike("[\\u061C\\u200E\\u200F\\u202A-\\u202E\\u2066-\\u2069]")


def parse_date(text: Column) -> tuple[Column, Column]:
    """UTC timestamp and offset minutes of ``D:YYYYMMDDHHmmSS+HH'mm'``; parts from the month on are optional; null if invalid."""
    pattern = "^D:([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?(?:([zZ])|([+-])([0-9]{2})(?:'([0-9]{2})?'?)?)?$"
    group = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")), F.lit(default))
    year, month, day = group(1, "0000"), group(2, "01"), group(3, "01")
    hour, minute, second = group(4, "00"), group(5, "00"), group(6, "00")
    offset = group(9, "00").cast("int") * 60 + group(10, "00").cast("int")
    offset = F.when(group(8, "+") == "-", -offset).otherwise(offset)
    good = text.rlike(pattern) & (F.length(text) < 24) & (group(9, "00") <= "23") & (group(10, "00") <= "59")
    local = F.try_to_timestamp(F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), hour, F.lit(":"), minute, F.lit(":"), second), F.lit("yyyy-MM-dd HH:mm:ss"))
    utc = F.timestamp_add("MINUTE", -offset, local)
    return F.when(good, utc), F.when(good & local.isNotNull(), offset)


def has_bit(mask: Column, bit: int) -> Column:
    """Bit numbers count from 1."""
    return mask.bitwiseAND(F.lit(1 << (bit - 1))) != 0


def permissions(mask: Column, revision: Column) -> dict[str, Column]:
    """Rights of a permission mask (bits 3, 4, 5, 6, 9, 10, 11, 12)."""
    names = {"modify": 4, "extract": 5, "annotate": 6, "fill_forms": 9, "accessibility": 10, "assemble": 11}
    out = {k: has_bit(mask, b) for k, b in names.items()}
    out["print_low"] = has_bit(mask, 3) | has_bit(mask, 12)
    out["print_full"] = F.when(revision < 3, has_bit(mask, 3)).otherwise(has_bit(mask, 12))
    return out


BASE62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stable_id(prefix: str, text: Column, charset: str = "UTF-16LE") -> Column:
    """Seven characters: the prefix, then a base-62 digit of the SHA-1 byte at each further place."""
    digest = F.sha1(F.encode(F.concat(text, F.lit("")), charset))
    digits = [F.substring(F.lit(BASE62), 1 + F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") % 62, F.lit(1)) for i in range(len(prefix), 7)]
    return F.concat(F.lit(prefix), *digits)


def data_url(content_type: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), content_type, F.lit(";base64,"), F.base64(content))


def number_text(value: Column, digits: int = 4) -> Column:
    """A number as SVG writes it: at most so many fraction digits, no trailing or leading zeros, no minus zero."""
    text = F.format_string(f"%.{digits}f", F.bround(value, digits))
    text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")
    text = F.regexp_replace(text, "^(-?)0\\.", "$1.")
    return F.when(text.isin("-0", "", "-"), "0").otherwise(text)


def page_numbers(spec: Column, total: Column) -> Column:
    """Sorted distinct page numbers of ``a, b..c, d.., ..e`` within 1..total; null if the text is no such list."""
    part = "\\s*(?:[0-9]{1,4}|[0-9]{1,4}\\s*\\.\\.\\s*[0-9]{0,4}|\\.\\.\\s*[0-9]{1,4})\\s*"
    def pages(x: Column) -> Column:
        low = F.regexp_extract(x, "^\\s*([0-9]*)", 1)
        ranged = F.instr(x, "..") > 0
        high = F.when(ranged, F.regexp_extract(x, "\\.\\.\\s*([0-9]*)", 1)).otherwise(low)
        first = F.greatest(F.when(low == "", 1).otherwise(low.cast("int")), F.lit(1))
        last = F.least(F.when(high == "", total).otherwise(high.cast("int")), total)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), pages))))
    return F.when(spec.rlike(f"^{part}(?:,{part})*$"), listed)
