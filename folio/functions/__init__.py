"""Scalar functions on columns: carving, parsing, hexadecimal, colours, matrices, curves. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Characters that end a hyphenated line (fixed values): hyphen-minus and U+2010 to U+2015.
DASHES = "-‐‑‒–—―"


def carve_out(text: Column, left: str, right: str) -> Column:
    """What stands between the first ``left`` and the next ``right``; a missing one is the text's begin or end."""
    at = F.instr(text, left)
    rest = F.when(at > 0, F.substr(text, at + F.lit(len(left)))).otherwise(text)
    end = F.instr(rest, right)
    return F.when(end > 0, F.substr(rest, F.lit(1), end - F.lit(1))).otherwise(rest)


def multi_carve(text: Column, left: str, right: str) -> Column:
    """All pieces between ``left`` and ``right`` that do not overlap."""
    quoted = [re.escape(x).replace("\\ ", " ") for x in (left, right)]
    return F.regexp_extract_all(text, F.lit(f"(?s){quoted[0]}(.*?){quoted[1]}"), 1)


def byte_range(text: Column) -> Column:
    """The least and the greatest byte of a text, null if it has none."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(text.cast("binary"), i, F.lit(1))), 16, 10).cast("int"))
    codes = F.when(F.octet_length(text) > 0, codes)
    return F.struct(F.array_min(codes).alias("least"), F.array_max(codes).alias("greatest"))


def is_ascii(text: Column) -> Column:
    """True if all characters are between backspace and tilde and there is one."""
    return text.rlike(r"\A[\x08-\x7e]+\z")


def hex_to_bytes(text: Column) -> Column:
    """Pairs of hexadecimal digits, others ignored; an odd last digit is its byte's first half."""
    digits = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def int_to_hex(value: Column) -> Column:
    """Four digits; FFFF for what does not fit."""
    return F.when((value < 0) | (value > 0xFFFF), "FFFF").otherwise(F.lpad(F.hex(value.cast("long")), 4, "0"))


def hex_to_raw(text: Column) -> Column:
    """16-bit units of hexadecimal digits, padded on the left to whole units."""
    size = (F.ceil(F.length(text) / 4) * 4).cast("int")
    padded = F.concat(F.repeat(F.lit("0"), size - F.length(text)), text)
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), size - 3, F.lit(4)), lambda i: F.conv(F.substr(padded, i, F.lit(4)), 16, 10).cast("int")))


def string_to_raw(text: Column) -> Column:
    """The low byte of each character."""
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c).bitwiseAND(255)))


def parse_refs(text: Column) -> Column:
    """Object numbers of all references 'n g R'."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\d.])(\d+)\s\d+\sR(?![A-Za-z])"), 1), lambda x: x.cast("int"))


def parse_ints(text: Column) -> Column:
    """Whole numbers; a decimal gives its part before the point."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?\d+)(?:\.\d*)?"), 1), lambda x: x.try_cast("long"))


def parse_floats(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[-+]?(?:\d+\.?\d*|\.\d+)"), 0), lambda x: x.try_cast("double"))


def symbol_type(c: Column) -> Column:
    """L for a letter, D for a digit, a space for white space, else the character itself."""
    return F.when(c.rlike("^[A-Za-z]"), "L").when(c.rlike("^[0-9]"), "D").when(c.rlike(r"^\s"), " ").otherwise(F.substr(c, F.lit(1), F.lit(1)))


def font_name(name: Column) -> Column:
    """Without the slash and the six-letter prefix of a subset."""
    return F.regexp_replace(name, r"^/?(?:[A-Z]{6}\+)?", "")


def expand_ligatures(text: Column) -> Column:
    for one, two in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(two))
    return text


def line_ending(text: Column) -> Column:
    """How a line joins the next: a dash goes, a space stays, anything else gets a space."""
    last = F.right(text, F.lit(1))
    return F.when(last.isin(*DASHES), F.substr(text, F.lit(1), F.length(text) - 1)).when(last.isin(" ", " "), text).otherwise(F.concat(text, F.lit(" ")))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of components between 0 and 1; null outside."""
    each = [F.lower(F.lpad(F.hex(F.floor(255 * v).cast("long")), 2, "0")) for v in (r, g, b)]
    return F.when(F.least(r, g, b).between(0, 1) & F.greatest(r, g, b).between(0, 1), F.concat(F.lit("#"), *each))


def cmyk_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.array(*[(1 - v) * (1 - k) for v in (c, m, y)])


def matrix_multiply(p: Column, q: Column) -> Column:
    """Products of [a b c d e f] matrices: first ``p``, then ``q``."""
    g = lambda m, i: m[i]
    return F.array(
        g(p, 0) * g(q, 0) + g(p, 1) * g(q, 2), g(p, 0) * g(q, 1) + g(p, 1) * g(q, 3),
        g(p, 2) * g(q, 0) + g(p, 3) * g(q, 2), g(p, 2) * g(q, 1) + g(p, 3) * g(q, 3),
        g(p, 4) * g(q, 0) + g(p, 5) * g(q, 2) + g(q, 4), g(p, 4) * g(q, 1) + g(p, 5) * g(q, 3) + g(q, 5),
    )


def matrix_apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((x * m[0] + y * m[2] + m[4]).alias("x"), (x * m[1] + y * m[3] + m[5]).alias("y"))


def bezier(p0: Column, p1: Column, p2: Column, p3: Column, points: int = 100) -> Column:
    """One coordinate of a cubic curve at t = 1/points .. 1."""
    def at(i: Column) -> Column:
        t = i / float(points)
        return (1 - t) * (1 - t) * (1 - t) * p0 + 3 * (1 - t) * (1 - t) * t * p1 + 3 * (1 - t) * t * t * p2 + t * t * t * p3
    return F.transform(F.sequence(F.lit(1), F.lit(points)), at)


def is_pdf_path(path: Column) -> Column:
    return path.rlike(r"(?i)\.pdf\z")
