"""Codes, glyph names and characters: the standard encodings, names of glyphs by rule, and widths of the standard fonts."""

from __future__ import annotations

import functools
import re
import unicodedata

from .core_fonts import SYMBOLS, UPPER, UPPER_CODES, WIDTHS

#: Names of glyphs that no rule gives, with their characters (fixed values).
NAMES = dict(
    zip(
        "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde".split(),
        " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~",
        strict=True,
    )
) | dict(
    zip(
        "bullet endash emdash quoteleft quoteright quotedblleft quotedblright quotesinglbase quotedblbase ellipsis dagger daggerdbl perthousand guilsinglleft guilsinglright guillemotleft guillemotright fi fl ff ffi ffl Euro germandbls fraction florin exclamdown questiondown cent sterling yen currency section paragraph copyright registered trademark degree plusminus multiply divide minus mu periodcentered onequarter onehalf threequarters onesuperior twosuperior threesuperior ordfeminine ordmasculine logicalnot brokenbar acute dieresis macron cedilla circumflex tilde breve dotaccent ring ogonek caron hungarumlaut AE ae OE oe Oslash oslash Lslash lslash Eth eth Thorn thorn dotlessi infinity notequal lessequal greaterequal approxequal partialdiff summation product integral radical lozenge arrowleft arrowup arrowright arrowdown arrowboth element emptyset similar congruent equivalence therefore universal existential union intersection nbspace softhyphen".split(),
        "•–—‘’“”‚„…†‡‰‹›«»ﬁﬂﬀﬃﬄ€ß⁄ƒ¡¿¢£¥¤§¶©®™°±×÷−µ·¼½¾¹²³ªº¬¦´¨¯¸ˆ˜˘˙˚˛ˇ˝ÆæŒœØøŁłÐðÞþı∞≠≤≥≈∂∑∏∫√◊←↑→↓↔∈∅∼≅≡∴∀∃∪∩ ­",
        strict=True,
    )
)
#: Ends of names of letters with accents, and how Unicode names those (fixed values).
ACCENTS = {"grave": "GRAVE", "acute": "ACUTE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "breve": "BREVE", "macron": "MACRON", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE", "commaaccent": "CEDILLA", "slash": "STROKE", "croat": "STROKE"}
#: Cyrillic letters have numbers: from this one on they are in order of Unicode, but for IO at 10023 and 10071 (fixed values).
CYRILLIC = {10017: 0x410, 10065: 0x430}
#: Codes of PDFDocEncoding that are not Latin-1, with their characters (fixed values).
PDF_DOC = {0x18 + i: c for i, c in enumerate("˘ˇˆ˙˝˛˚˜")} | {0x80 + i: c for i, c in enumerate("•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž")} | {0xA0: "€"}
STANDARD = {c: chr(c) for c in range(32, 127)} | {0x27: "’", 0x60: "‘"} | dict(zip((int(c, 16) for c in UPPER_CODES.split()), UPPER, strict=True))


@functools.cache
def glyph_unicode(name: str) -> str | None:
    """The character of a glyph's name; None if it has none."""
    name = name.lstrip("/").split(".")[0]
    if len(name) == 1 or name in NAMES:
        return NAMES.get(name, name)
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})(?:[0-9A-Fa-f]{4})*|G([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4,6})", name):
        return chr(min(0x10FFFF, int(m[1] or m[2] or m[3], 16)))
    if m := re.fullmatch(r"afii(100\d\d)", name):
        number = int(m[1])
        if number in (10023, 10071):
            return "Ё" if number == 10023 else "ё"
        for first, code in CYRILLIC.items():
            if first <= number <= first + 32 + (first == 10017):
                return chr(code + number - first - (number > (10023 if first == 10017 else 10071)))
    for end, accent in ACCENTS.items():
        if name.endswith(end) and len(letter := name[: -len(end)]) == 1:
            return _named(f"LATIN {'CAPITAL' if letter.isupper() else 'SMALL'} LETTER {letter.upper()} WITH {accent}")
    return _named(f"GREEK {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {'FINAL SIGMA' if name == 'sigma1' else 'LAMDA' if name.lower() == 'lambda' else name.upper()}")


def _named(name: str) -> str | None:
    try:
        return unicodedata.lookup(name)
    except KeyError:
        return None


def encoding(name: str | None, symbolic: bool = False) -> dict[int, str]:
    """Codes to characters. Codes that cp1252 leaves undefined stand for themselves."""
    if name == "/WinAnsiEncoding":
        return {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(256)}
    if name == "/MacRomanEncoding":
        return {c: bytes([c]).decode("mac_roman") for c in range(256)}
    latin = {c: chr(c) for c in range(256)}
    if name == "/PDFDocEncoding":
        return latin | PDF_DOC
    return latin if symbolic or name != "/StandardEncoding" else latin | STANDARD


@functools.cache
def core_widths(font: str) -> dict[str, float] | None:
    """Widths by character of one of the standard fonts (by code of the symbol fonts), None for other fonts. An accented
    letter is as wide as the letter."""
    low = font.lower().replace("oblique", "").rstrip("-")
    if "courier" in low:
        return {c: 600.0 for c in [*map(chr, range(32, 256)), *UPPER]}
    for name, rows in SYMBOLS.items():
        if low == name.lower():
            return {chr(first + i): float(w) for first, row in rows.items() for i, w in enumerate(row.split())}
    for name, (lower, upper) in WIDTHS.items():
        if low == name.lower():
            widths = {chr(32 + i): float(w) for i, w in enumerate(lower.split())}
            widths |= {c: float(w) for c, w in zip(UPPER, upper.split(), strict=True) if c not in "'`"} | {"’": widths["'"], "‘": widths["`"]}
            for c in map(chr, range(0xA0, 0x180)):
                base = unicodedata.normalize("NFKD", c)[0]
                if c not in widths and base in widths:
                    widths[c] = widths[base]
            return widths
    return None


def type1_encoding(data: bytes) -> dict[int, str]:
    """Codes to characters of an embedded Type 1 font: its entries 'dup code /name put'."""
    start = data.find(b"/Encoding")
    end = data.find(b"currentdict end", start)
    part = data[start : end if end > 0 else len(data)] if start >= 0 else b""
    found = {int(c): glyph_unicode(n.decode("latin-1")) for c, n in re.findall(rb"dup\s+(\d+)\s*/(\S+)\s+put", part)}
    standard = STANDARD if re.match(rb"/Encoding\s+StandardEncoding", part) else {}
    return standard | {c: u for c, u in found.items() if u}
