"""Names, keys and label lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes that count as images when folders are walked, and member types read from shards.
WALKED = ("bmp", "jpeg", "jpg", "png", "webp")
READ = ("jpeg", "jpg", "png", "webp")


def padded(number: Column, width: int) -> Column:
    """Zero-padded, never cut."""
    return F.format_string(f"%0{width}d", number)


def member_key(name: Column) -> Column:
    """The name before its first dot."""
    return F.split_part(name, F.lit("."), F.lit(1))


def member_ext(name: Column) -> Column:
    """All after the first dot; null without one."""
    at = F.instr(name, ".")
    return F.when(at > 0, F.substring(name, at + 1, F.length(name)))


def stripped(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def suffix(path: Column) -> Column:
    """Lower-cased after the last dot of the last part; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*WALKED)


def yolo_line(class_id: Column, yolo: Column) -> Column:
    """`id cx cy w h` to six decimals, exact ties to even as in C."""
    six = lambda c: F.format_number(yolo[c], 6)  # noqa: E731  format_string would round ties up
    return F.concat_ws(" ", class_id.cast("string"), six("cx"), six("cy"), six("w"), six("h"))
