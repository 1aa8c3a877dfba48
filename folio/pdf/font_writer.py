"""A small TrueType font for round trips, independent of the reader: a triangle, a compound of two of it, and a curve."""

from __future__ import annotations

import struct

#: The order of the tables in the file.
ORDER = ("OS/2", "cmap", "glyf", "head", "loca", "maxp", "name", "post")


def write_font(k: int, family: str, size: int) -> bytes:
    """Glyphs: 0 empty; 1 the triangle (0, 0) (100 + k, 0) (100 + k, 200); 2 that one and, 10 * k to the right and at half
    its size, another; 3 a curve from (0, 0) to (100, 0) with the control point (50, 100 + k), and back. A to C show 1 to 3."""
    triangle = struct.pack(">5h", 1, 0, 0, 100 + k, 200) + struct.pack(">HH", 2, 0) + bytes([1, 1, 1]) + struct.pack(">3h", 0, 100 + k, 0) + struct.pack(">3h", 0, 0, 200)
    parts = struct.pack(">HHhh", 1 | 2 | 32, 1, 0, 0) + struct.pack(">HHhhh", 1 | 2 | 8, 1, 10 * k, 20, 8192)
    compound = struct.pack(">5h", -1, 0, 0, 100 + 11 * k, 220) + parts
    curve = struct.pack(">5h", 1, 0, 0, 100, 100 + k) + struct.pack(">HH", 2, 0) + bytes([1 | 16 | 32, 2 | 16, 1 | 2 | 16]) + bytes([50, 50]) + struct.pack(">2h", 100 + k, -100 - k)
    glyphs = [b"", *(g + bytes(-len(g) % 4) for g in (triangle, compound, curve))]
    offsets = [sum(map(len, glyphs[:i])) for i in range(len(glyphs) + 1)]
    long = k % 2
    loca = struct.pack(f">{len(offsets)}{'L' if long else 'H'}", *(o if long else o // 2 for o in offsets))
    created = 2082844800 + 86400 * k
    head = struct.pack(">llLLHHqqhhhhHHhhh", 0x10000, 0x18000, 0, 0x5F0F3CF5, 3, size, created, created + 60, 0, 0, 100 + 11 * k, 220, k % 4, 8, 2, long, 0)
    maxp = struct.pack(">l14H", 0x10000, 4, 6, 2, 6, 2, 1, 0, 0, 0, 0, 0, 0, 2, 1)
    name = _names([(1, 0, 0, 1, family.encode("mac_roman")), (3, 1, 0x409, 2, f"Style {k}".encode("utf-16-be"))])
    own = f"glyph{k}".encode()
    post = struct.pack(">llhhLLLLL", 0x20000, -0x8000, -75, 50, k % 2, 0, 0, 0, 0) + struct.pack(">H4H", 4, 0, 36, 258, 259) + bytes([len(own)]) + own + bytes([3]) + b"arc"
    os2 = struct.pack(">HhHHH11h", 4, 500 + k, 400, 5, 0, *range(10, 20), 0) + bytes(range(10)) + struct.pack(">4L", 1, 2, 3, k) + b"FOLI" + struct.pack(">HHH", 64, 65, 67)
    tables = dict(zip(ORDER, (os2, _cmap(k), b"".join(glyphs), head, loca, maxp, name, post), strict=True))
    out, at, body = struct.pack(">LHHHH", 0x10000, len(ORDER), 128, 3, 0), 12 + 16 * len(ORDER), b""
    for tag in ORDER:
        data = tables[tag] + bytes(-len(tables[tag]) % 4)
        total = sum(struct.unpack(f">{len(data) // 4}L", data)) & 0xFFFFFFFF
        out += struct.pack(">4sLLL", tag.encode(), total, at + len(body), len(tables[tag]))
        body += data
    return out + body


def _names(rows: list[tuple[int, int, int, int, bytes]]) -> bytes:
    heads, texts = b"", b""
    for platform, specific, language, name, text in rows:
        heads += struct.pack(">HHHHHH", platform, specific, language, name, len(text), len(texts))
        texts += text
    return struct.pack(">HHH", 0, len(rows), 6 + len(heads)) + heads + texts


def _cmap(k: int) -> bytes:
    """Subtables of format 0, 6, 12 and 4; the last has a second segment through an array of glyphs."""
    zero = struct.pack(">HHH", 0, 262, 0) + bytes(c - 64 if 65 <= c <= 67 else 0 for c in range(256))
    six = struct.pack(">HHHHH3H", 6, 16, 0, 97 + k % 5, 3, 1, 2, 3)
    twelve = struct.pack(">HHLLL3L", 12, 0, 28, 0, 1, 0x1F600 + k, 0x1F602 + k, 1)
    ends, starts = (67, 300 + k, 0xFFFF), (65, 299 + k, 0xFFFF)
    four = struct.pack(">HHHHHHH", 4, 44, 0, 6, 4, 1, 2) + struct.pack(">3H", *ends) + struct.pack(">H", 0) + struct.pack(">3H", *starts) + struct.pack(">3H", (1 - 65) & 0xFFFF, 0, 1) + struct.pack(">3H", 0, 4, 0) + struct.pack(">2H", 3, 1)
    parts, at, heads = (zero, six, twelve, four), 4 + 8 * 4, b""
    for (platform, encoding), part in zip(((1, 0), (0, 3), (3, 10), (3, 1)), parts, strict=True):
        heads += struct.pack(">HHL", platform, encoding, at)
        at += len(part)
    return struct.pack(">HH", 0, 4) + heads + b"".join(parts)
