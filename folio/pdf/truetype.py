"""TrueType fonts as relations: each function takes a DataFrame with font_id and content. Tables that are missing or cannot
be read give no rows; ``font_errors`` tells them. Numbers follow the published font format."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encodings import ACCENTS, NAMES

#: Fields of the tables in order, with their types (fixed values of the format).
HEAD = "version:l fontRevision:l checksumAdjustment:L magicNumber:L flags:H unitsPerEm:H created:q modified:q xMin:h yMin:h xMax:h yMax:h macStyle:H lowestRecPPEM:H fontDirectionHint:h indexToLocFormat:h glyphDataFormat:h"
MAXP = "version:l numGlyphs:H maxPoints:H maxContours:H maxComponentPoints:H maxComponentContours:H maxZones:H maxTwilightPoints:H maxStorage:H maxFunctionDefs:H maxInstructionDefs:H maxStackElements:H maxSizeOfInstructions:H maxComponentElements:H maxComponentDepth:H"
OS2 = "version:H xAvgCharWidth:h usWeightClass:H usWidthClass:H fsType:H ySubscriptXSize:h ySubscriptYSize:h ySubscriptXOffset:h ySubscriptYOffset:h ySuperscriptXSize:h ySuperscriptYSize:h ySuperscriptXOffset:h ySuperscriptYOffset:h yStrikeoutSize:h yStrikeoutPosition:h sFamilyClass:h panose:10s ulUnicodeRange:16s achVendID:4s fsSelection:H usFirstCharIndex:H usLastCharIndex:H"
POST = "version:l italic_angle:l UnderlinePosition:h UnderlineThickness:h IsFixedPitch:L MinMemType42:L MaxMemType42:L MinMemType1:L MaxMemType1:L"
#: Seconds from the fonts' epoch (1904) to that of Unix (fixed value), and steps of a curve.
EPOCH, STEPS = 2082844800, 10
FIXED = ("version", "fontRevision", "italic_angle")
#: What reading a damaged or cut table may raise.
UNREADABLE = (ValueError, IndexError, TypeError, struct.error)


def record(layout: str, data: bytes) -> dict:
    """The fields of a table; a shorter table gives as many as it has, the others are null."""
    out, at = {}, 0
    for name, kind in (f.split(":") for f in layout.split()):
        size = struct.calcsize(">" + kind)
        value = struct.unpack_from(">" + kind, data, at)[0] if at + size <= len(data) else None
        out[name] = value / 65536 if name in FIXED and kind == "l" and value is not None else value
        at += size
    return out


class TrueType:
    """The tables of one font file."""

    def __init__(self, data: bytes) -> None:
        count = struct.unpack_from(">H", data, 4)[0]
        if data[:4] not in (b"\0\1\0\0", b"true") or len(data) < 12 + 16 * count:
            raise ValueError("no TrueType font")
        self.data, self.tables = data, {}
        for i in range(count):
            tag, checksum, offset, length = struct.unpack_from(">4sLLL", data, 12 + 16 * i)
            self.tables[tag.decode("latin-1")] = (offset, length, checksum)

    def table(self, tag: str) -> bytes:
        if tag not in self.tables:
            raise ValueError(f"no table {tag}")
        offset, length, _ = self.tables[tag]
        return self.data[offset : offset + length]

    def head(self) -> dict:
        return record(HEAD, self.table("head"))

    def maxp(self) -> dict:
        return record(MAXP, self.table("maxp"))

    def loca(self) -> list[int]:
        """Offsets of all glyphs, and the end of the last."""
        n, data = self.maxp()["numGlyphs"] + 1, self.table("loca")
        if self.head()["indexToLocFormat"]:
            return list(struct.unpack_from(f">{n}L", data))
        return [2 * x for x in struct.unpack_from(f">{n}H", data)]

    def cmaps(self) -> Iterator[tuple[int, int, int, dict[int, int]]]:
        """platform, encoding, format, and codes to glyphs of each subtable; formats 8 and 14 are left out."""
        data = self.table("cmap")
        for i in range(struct.unpack_from(">H", data, 2)[0]):
            platform, encoding, offset = struct.unpack_from(">HHL", data, 4 + 8 * i)
            form = struct.unpack_from(">H", data, offset)[0]
            if form in READERS:
                yield platform, encoding, form, {c: g for c, g in READERS[form](data[offset:]) if g}

    def codes(self) -> dict[int, int]:
        """The first subtable of format 4, else of format 0, else codes themselves."""
        found = {form: codes for _, _, form, codes in reversed(list(self.cmaps()))}
        return found.get(4) or found.get(0) or {i: i for i in range(256)}

    def post_names(self) -> dict[int, str]:
        data = self.table("post")
        version = struct.unpack_from(">L", data)[0]
        if version == 0x10000:
            return dict(enumerate(MAC_NAMES))
        if version != 0x20000:
            return {}
        n = struct.unpack_from(">H", data, 32)[0]
        index, at, own = struct.unpack_from(f">{n}H", data, 34), 34 + 2 * n, []
        while at < len(data):
            own.append(data[at + 1 : at + 1 + data[at]].decode("latin-1"))
            at += 1 + data[at]
        names = {g: MAC_NAMES[i] if i < len(MAC_NAMES) else own[i - len(MAC_NAMES)] for g, i in enumerate(index) if i - len(MAC_NAMES) < len(own)}
        return names

    def names(self) -> Iterator[tuple[int, int, int, int, str]]:
        data = self.table("name")
        _, count, start = struct.unpack_from(">HHH", data)
        for i in range(count):
            platform, specific, language, name, length, offset = struct.unpack_from(">HHHHHH", data, 6 + 12 * i)
            text = data[start + offset : start + offset + length]
            yield platform, specific, language, name, text.decode("utf-16-be" if platform in (0, 3) else "mac_roman", "replace")

    def outline(self, glyph: int, within: tuple[int, ...] = ()) -> list[list[tuple[float, float, bool]]]:
        """The contours of a glyph as points (x, y, on the curve); a glyph within itself is cut."""
        loca, data = self.loca(), self.table("glyf")
        if not 0 <= glyph < len(loca) - 1 or loca[glyph] == loca[glyph + 1] or glyph in within:
            return []
        data = data[loca[glyph] : loca[glyph + 1]]
        count = struct.unpack_from(">h", data)[0]
        return _simple(data, count) if count >= 0 else self._compound(data, (*within, glyph))

    def _compound(self, data: bytes, within: tuple[int, ...]) -> list[list[tuple[float, float, bool]]]:
        out, at, more = [], 10, True
        while more:
            flags, part = struct.unpack_from(">HH", data, at)
            words, values, scaled, each, full = flags & 1, flags & 2, flags & 8, flags & 64, flags & 128
            more, at = bool(flags & 32), at + 4
            kind = ("h" if values else "H") if words else ("b" if values else "B")
            dx, dy = struct.unpack_from(f">2{kind}", data, at)
            at += 4 if words else 2
            n = 1 if scaled else 2 if each else 4 if full else 0
            m = [x / 16384 for x in struct.unpack_from(f">{n}h", data, at)]
            at += 2 * n
            a, b, c, d = (m[0], 0, 0, m[0]) if n == 1 else (m[0], 0, 0, m[1]) if n == 2 else m if n else (1, 0, 0, 1)
            moved = [[(a * x + c * y, b * x + d * y, on) for x, y, on in contour] for contour in self.outline(part, within)]
            if not values:  # the part's point dy comes to lie on the point dx of what there is
                old, new = [p for k in out for p in k], [p for k in moved for p in k]
                dx, dy = (old[dx][0] - new[dy][0], old[dx][1] - new[dy][1]) if dx < len(old) and dy < len(new) else (0, 0)
            out += [[(x + dx, y + dy, on) for x, y, on in contour] for contour in moved]
        return out


def _simple(data: bytes, count: int) -> list[list[tuple[float, float, bool]]]:
    ends = struct.unpack_from(f">{count}H", data, 10)
    at = 10 + 2 * count
    at += 2 + struct.unpack_from(">H", data, at)[0]
    points, flags = (ends[-1] + 1 if ends else 0), []
    while len(flags) < points:
        flag = data[at]
        repeats = data[at + 1] if flag & 8 else 0
        flags += [flag] * (repeats + 1)
        at += 2 if flag & 8 else 1
    flags, sides = flags[:points], []
    for short, same in ((2, 16), (4, 32)):
        steps = []
        for flag in flags:
            if flag & short:
                steps.append(data[at] if flag & same else -data[at])
                at += 1
            elif flag & same:
                steps.append(0)
            else:
                steps.append(struct.unpack_from(">h", data, at)[0])
                at += 2
        sides.append(np.cumsum(steps).tolist())
    all_points = [(float(x), float(y), bool(f & 1)) for x, y, f in zip(*sides, flags, strict=True)]
    return [all_points[a:b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], [e + 1 for e in ends], strict=True)]


def smooth(contour: list[tuple[float, float, bool]], steps: int = STEPS) -> list[tuple[float, float]]:
    """A closed line: between two control points lies an implied point halfway, and each curve is drawn in ``steps`` steps."""
    full = []
    for i, (x, y, on) in enumerate(contour):
        px, py, before = contour[i - 1]
        if not on and not before:
            full.append(((x + px) / 2, (y + py) / 2, True))
        full.append((x, y, on))
    start = next((i for i, p in enumerate(full) if p[2]), None)
    if start is None:
        return []
    full = full[start:] + full[: start + 1]
    out, i = [full[0][:2]], 1
    while i < len(full):
        (x0, y0), (x1, y1, on) = out[-1], full[i]
        if on:
            out.append((x1, y1))
            i += 1
            continue
        x2, y2, _ = full[i + 1]
        for k in range(1, steps + 1):
            t = k / steps
            out.append(((1 - t) ** 2 * x0 + 2 * t * (1 - t) * x1 + t * t * x2, (1 - t) ** 2 * y0 + 2 * t * (1 - t) * y1 + t * t * y2))
        i += 2
    return out


def _bytes(data: bytes) -> Iterator[tuple[int, int]]:
    return enumerate(data[6:262])


def _high_bytes(data: bytes) -> Iterator[tuple[int, int]]:
    keys = struct.unpack_from(">256H", data, 6)
    for high, key in enumerate(keys):
        at = 518 + key
        first, count, delta, offset = struct.unpack_from(">HHhH", data, at)
        for i in range(count):
            where = at + 6 + offset + 2 * i
            code = first + i
            if where + 2 <= len(data) and (key or code == high):
                g = struct.unpack_from(">H", data, where)[0]
                yield (high << 8 | code) if key else code, (g + delta) & 0xFFFF if g else 0


def _segments(data: bytes) -> Iterator[tuple[int, int]]:
    n = struct.unpack_from(">H", data, 6)[0] // 2
    ends, starts = struct.unpack_from(f">{n}H", data, 14), struct.unpack_from(f">{n}H", data, 16 + 2 * n)
    deltas, offsets = struct.unpack_from(f">{n}H", data, 16 + 4 * n), struct.unpack_from(f">{n}H", data, 16 + 6 * n)
    for i in range(n):
        for code in range(starts[i], ends[i] + 1):
            if code == 0xFFFF:
                continue
            if not offsets[i]:
                yield code, (code + deltas[i]) & 0xFFFF
                continue
            at = 16 + 6 * n + 2 * i + offsets[i] + 2 * (code - starts[i])
            g = struct.unpack_from(">H", data, at)[0] if at + 2 <= len(data) else 0
            yield code, (g + deltas[i]) & 0xFFFF if g else 0


def _trimmed(data: bytes) -> Iterator[tuple[int, int]]:
    first, n = struct.unpack_from(">HH", data, 6)
    return ((first + i, g) for i, g in enumerate(struct.unpack_from(f">{n}H", data, 10)))


def _trimmed_long(data: bytes) -> Iterator[tuple[int, int]]:
    first, n = struct.unpack_from(">LL", data, 12)
    return ((first + i, g) for i, g in enumerate(struct.unpack_from(f">{n}H", data, 20)))


def _groups(step: int) -> Callable[[bytes], Iterator[tuple[int, int]]]:
    def read(data: bytes) -> Iterator[tuple[int, int]]:
        for i in range(struct.unpack_from(">L", data, 12)[0]):
            start, end, glyph = struct.unpack_from(">LLL", data, 16 + 12 * i)
            for code in range(start, min(end, 0x10FFFF) + 1):
                yield code, glyph + step * (code - start)

    return read


READERS = {0: _bytes, 2: _high_bytes, 4: _segments, 6: _trimmed, 10: _trimmed_long, 12: _groups(1), 13: _groups(0)}


def _mac_names() -> list[str]:
    """The standard order of names by its rule: ASCII, then the upper half of Mac Roman, then 32 others."""
    import unicodedata

    by_char = {c: n for n, c in NAMES.items()}
    ends = {v: k for k, v in ACCENTS.items() if k not in ("commaaccent", "croat")}

    def name(char: str) -> str:
        if char in by_char or char.isascii():
            return by_char.get(char, char)
        words = unicodedata.name(char, "").split(" WITH ")
        last = words[0].split(" ")[-1]
        letter = last if "CAPITAL" in words[0] else last.lower()
        return letter + ends.get(words[1], "") if len(words) > 1 else letter.capitalize() if "CAPITAL" in words[0] else letter

    upper = {"Ω": "Omega", "π": "pi", "∆": "Delta", "": "apple", "\xa0": "nonbreakingspace", "€": "currency", "µ": "mu"}
    more = "Lslash lslash Scaron scaron Zcaron zcaron brokenbar Eth eth Yacute yacute Thorn thorn minus multiply onesuperior twosuperior threesuperior onehalf onequarter threequarters franc Gbreve gbreve Idotaccent Scedilla scedilla Cacute cacute Ccaron ccaron dcroat"
    roman = [bytes([c]).decode("mac_roman") for c in range(0x80, 0x100)]
    return [".notdef", ".null", "nonmarkingreturn", *(name(chr(c)) for c in range(32, 127)), *(upper.get(c) or name(c) for c in roman), *more.split()]


MAC_NAMES = _mac_names()


def checksum(data: bytes) -> int:
    """The sum of big-endian 32-bit words, filled up with zeros."""
    data += bytes(-len(data) % 4)
    return int(np.frombuffer(data, ">u4").sum(dtype=np.uint64)) & 0xFFFFFFFF


def _read(fonts: DataFrame, rows: Callable[[object, TrueType], Iterable[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for font_id, content in zip(batch["font_id"], batch["content"], strict=True):
                try:
                    found = list(rows(font_id, TrueType(bytes(content or b""))))
                except UNREADABLE:
                    found = []
                if found:
                    yield pd.DataFrame(found, columns=names)

    return fonts.select("font_id", "content").mapInPandas(run, schema)


def _fields(layout: str, but: dict[str, str] | None = None) -> str:
    kinds = {"l": "double", "q": "long", "L": "long", "H": "int", "h": "int"}
    return ", ".join(f"{name} {(but or {}).get(name) or kinds.get(kind, 'string')}" for name, kind in (f.split(":") for f in layout.split()))


def font_tables(fonts: DataFrame) -> DataFrame:
    """The directory, with the checksum that it states and the one that the table has."""
    return _read(fonts, lambda i, f: [(i, tag, o, n, c, checksum(f.data[o : o + n])) for tag, (o, n, c) in f.tables.items()], "font_id long, table string, offset long, length long, checksum long, computed long")


def font_head(fonts: DataFrame) -> DataFrame:
    schema = f"font_id long, {_fields(HEAD)}"
    times = [F.timestamp_seconds(F.col(c) - EPOCH).alias(c) if c in ("created", "modified") else F.col(c) for c in (x.split()[0] for x in schema.split(", "))]
    return _read(fonts, lambda i, f: [(i, *f.head().values())], schema).select(*times)


def font_maxp(fonts: DataFrame) -> DataFrame:
    return _read(fonts, lambda i, f: [(i, *f.maxp().values())], f"font_id long, {_fields(MAXP)}")


def font_os2(fonts: DataFrame) -> DataFrame:
    def row(i: int, f: TrueType) -> list[tuple]:
        r = record(OS2, f.table("OS/2"))
        words = struct.unpack(">4L", r["ulUnicodeRange"] or bytes(16))
        r |= {"panose": list(r["panose"] or b""), "ulUnicodeRange": list(words), "achVendID": (r["achVendID"] or b"").decode("latin-1")}
        return [(i, *r.values())]

    return _read(fonts, row, f"font_id long, {_fields(OS2, {'panose': 'array<int>', 'ulUnicodeRange': 'array<long>'})}")


def font_loca(fonts: DataFrame) -> DataFrame:
    """glyph, offset, and length up to the next offset."""
    offsets = _read(fonts, lambda i, f: [(i, list(f.loca()))], "font_id long, offsets array<long>")
    each = offsets.select("font_id", F.posexplode("offsets").alias("glyph", "offset"), "offsets")
    return each.where(F.col("glyph") < F.size("offsets") - 1).select("font_id", "glyph", "offset", (F.get("offsets", F.col("glyph") + 1) - F.col("offset")).alias("length"))


def font_cmap(fonts: DataFrame) -> DataFrame:
    return _read(fonts, lambda i, f: [(i, p, e, form, c, g) for p, e, form, codes in f.cmaps() for c, g in codes.items()], "font_id long, platform int, encoding int, format int, first int, second int")


def font_post(fonts: DataFrame) -> DataFrame:
    return _read(fonts, lambda i, f: [(i, *record(POST, f.table("post")).values())], f"font_id long, {_fields(POST)}")


def font_post_names(fonts: DataFrame) -> DataFrame:
    return _read(fonts, lambda i, f: [(i, g, n) for g, n in f.post_names().items()], "font_id long, glyph_number int, glyph_name string")


def font_glyph_names(fonts: DataFrame) -> DataFrame:
    """code_point, glyph_number, glyph_name: names of glyphs joined to the codes that show them."""
    codes = _read(fonts, lambda i, f: [(i, c, g) for c, g in f.codes().items()], "font_id long, code_point int, glyph_number int")
    return font_post_names(fonts).join(codes, ["font_id", "glyph_number"]).select("font_id", "code_point", "glyph_number", "glyph_name")


def font_names(fonts: DataFrame) -> DataFrame:
    return _read(fonts, lambda i, f: [(i, *n) for n in f.names()], "font_id long, platformID int, platformSpecificID int, languageID int, nameID int, text string")


def font_glyphs(fonts: DataFrame) -> DataFrame:
    """Bounding box and number of contours (-1: a compound glyph) that the file states for each glyph that has an outline."""
    def rows(i: int, f: TrueType) -> Iterator[tuple]:
        loca, data = f.loca(), f.table("glyf")
        for g in range(len(loca) - 1):
            if loca[g] < loca[g + 1]:
                n, x0, y0, x1, y1 = struct.unpack_from(">5h", data, loca[g])
                yield i, g, n, x0, x1, y0, y1

    return _read(fonts, rows, "font_id long, glyph int, n_contours int, xmin int, xmax int, ymin int, ymax int")


def glyph_points(fonts: DataFrame) -> DataFrame:
    """The points of each glyph as the file has them, compound glyphs put together."""
    return _read(fonts, lambda i, f: [(i, g, c, s, *p) for g in range(len(f.loca()) - 1) for c, contour in enumerate(f.outline(g)) for s, p in enumerate(contour)], "font_id long, glyph int, contour int, seq int, x double, y double, on_curve boolean")


def glyph_outlines(fonts: DataFrame) -> DataFrame:
    """Closed lines that draw each glyph."""
    return _read(fonts, lambda i, f: [(i, g, c, s, *p) for g in range(len(f.loca()) - 1) for c, contour in enumerate(f.outline(g)) for s, p in enumerate(smooth(contour))], "font_id long, glyph int, contour int, seq int, x double, y double")


def font_errors(fonts: DataFrame) -> DataFrame:
    """font_id and error of what is no font, or of the first table that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for font_id, content in zip(batch["font_id"], batch["content"], strict=True):
                try:
                    font = TrueType(bytes(content or b""))
                    for part in (font.head, font.maxp, font.loca, lambda: list(font.cmaps()), font.post_names, lambda: list(font.names()), lambda: [font.outline(g) for g in range(len(font.loca()) - 1)]):
                        part()
                except UNREADABLE as e:
                    found.append((font_id, f"{type(e).__name__}: {e}"))
            if found:
                yield pd.DataFrame(found, columns=["font_id", "error"])

    return fonts.select("font_id", "content").mapInPandas(run, "font_id long, error string")
