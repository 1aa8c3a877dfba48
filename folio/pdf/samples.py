"""Sample files for round trips and first steps: each page uses some features of fonts, text state, forms or paths. ``k``
moves and numbers things, so that many different files can be made."""

from __future__ import annotations

import zlib

from .writer import _assembled

TO_UNICODE = b"/CMapName /Own def 1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0005> <0061> endbfrange endcmap"
TYPE1 = b"%!PS-AdobeFont-1.0: Own\n/Encoding 256 array 0 1 255 {1 index exch /.notdef put} for\ndup 65 /beta put\ndup 66 /Eacute put\nreadonly def currentdict end"
NAMES = ("standard fonts", "differences", "wide fonts", "forms", "text state", "boxes", "paths", "embedded encoding")


def sample(k: int, flate: bool = True, stream_xref: bool = True) -> bytes:
    """Eight pages, one for each of NAMES."""
    courier = "<< /F1 << /Type /Font /Subtype /Type1 /BaseFont /Courier >> >>"
    at = f"BT /F1 10 Tf {k} 700 Td"
    pages = [
        ("<< /F1 << /Type /Font /Subtype /Type1 /BaseFont /Times-Roman >> >>", "", f"{at} (Hello World) Tj ET"),
        ("<< /F1 << /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Own /FirstChar 65 /Widths [600 700 800] /Encoding << /Differences [65 /alpha /uni20AC /G41] >> >> >>", "", f"{at} (ABC) Tj ET"),
        ("<< /F1 << /Type /Font /Subtype /Type0 /BaseFont /Wide /Encoding /Identity-H /DescendantFonts [<< /DW 900 /W [1 [500 600] 3 4 700] >>] /ToUnicode 4 0 R >> >>", "", f"{at} <0001000200030005> Tj ET"),
        (courier, "/XObject << /X1 5 0 R >>", "q 2 0 0 2 10 20 cm /X1 Do Q BT /F1 10 Tf 0 0 Td (Z) Tj ET"),
        (courier, "", f"BT /F1 10 Tf 1 Tc 5 Tw 50 Tz 12 TL {k} 700 Td (A B) Tj T* (C) Tj (D) ' [(E) -1000 (F)] TJ ET BT /F1 10 Tf {k} 100 Td (G) Tj ET"),
        (courier, f"/TrimBox [{k} 0 300 400]", ""),
        (courier, "", f"1 0 0 RG 0 1 0 rg 2 w q 2 0 0 2 10 10 cm 0 0 {k + 1} 5 re B Q 0.5 G 0 0 m 10 0 l 10 {k + 10} l h S {at} (p) Tj ET 0 0 m 1 1 2 2 3 3 c f 0 0 0 1 k 900 900 m 950 950 l f 0 0 m 1 1 l n"),
        ("<< /F1 << /Type /Font /Subtype /Type1 /BaseFont /Embedded /FirstChar 65 /Widths [500 500] /FontDescriptor << /FontFile 6 0 R >> >> >>", "", f"{at} (AB) Tj ET"),
    ]
    form = f"/Type /XObject /Subtype /Form /Resources << /Font {courier} /XObject << /X1 5 0 R >> >>"
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Producer (folio) >>", "", form, ""]
    bodies = {4: TO_UNICODE, 5: f"BT /F1 10 Tf {k} 100 Td (Q) Tj ET /X1 Do".encode(), 6: TYPE1}
    kids = []
    for fonts, more, program in pages:
        kids.append(len(objects) + 1)
        objects.append(f"<< /Type /Page /Parent 2 0 R {more if 'Box' in more else ''} /Resources << /Font {fonts} {more if 'XObject' in more else ''} >> /Contents {len(objects) + 2} 0 R >>")
        objects.append("")
        bodies[len(objects)] = program.encode()
    half = len(kids) // 2  # two levels of pages, the second inherits its box from the first
    objects += [f"<< /Type /Pages /Parent 2 0 R /Count {half} /Kids [{' '.join(f'{n} 0 R' for n in kids[half:])}] >>"]
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /MediaBox [0 0 612 792] /Kids [{' '.join(f'{n} 0 R' for n in kids[:half])} {len(objects)} 0 R] >>"
    if flate:
        for n in bodies:
            objects[n - 1] += " /Filter /FlateDecode"
            bodies[n] = zlib.compress(bodies[n])
    return _assembled(objects, bodies, "", lambda _, b: b, stream_xref)


def updated(k: int) -> bytes:
    """A file of one page whose text, and a second xref section that replaces it and frees the object before."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Count 1 /Kids [3 0 R] >>", "<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Courier >> >> >> /Contents 5 0 R >>", "<< /Old true >>", ""]
    data = _assembled(objects, {5: b"BT /F1 10 Tf 0 0 Td (old) Tj ET"}, "", lambda _, b: b, False)
    before = int(data.rsplit(b"startxref", 1)[1].split()[0])
    body = f"BT /F1 10 Tf 0 0 Td (n{k}) Tj ET".encode()
    start = len(data)
    data += b"5 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(body), body)
    at = len(data)
    return data + b"xref\n4 2\n0000000000 00001 f \n%010d 00000 n \ntrailer\n<< /Size 6 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (start, before, at)


def damaged(k: int) -> bytes:
    """Every third file is no PDF, every third one's first page of two has a stream that is damaged; the others are sound."""
    if k % 3 == 1:
        return b"no file"
    page = "<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Courier >> >> >> /Contents {} 0 R >>"
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Count 2 /Kids [3 0 R 4 0 R] >>", page.format(5), page.format(6), "/Filter /FlateDecode", "/Filter /FlateDecode"]
    good = zlib.compress(f"BT /F1 10 Tf 0 0 Td (page{k}) Tj ET".encode())
    return _assembled(objects, {5: b"\xff" * 20 if k % 3 == 0 else good, 6: good}, "", lambda _, b: b, False)


def packed(k: int) -> bytes:
    """A file whose catalogue, page tree and page stand in an object stream; its xref stream has two ranges of numbers."""
    parts = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Count 1 /Kids [3 0 R] >>", "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 200 100] /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Courier >> >> >> /Contents 10 0 R >>"]
    offsets = [sum(len(p) + 1 for p in parts[:i]) for i in range(len(parts))]
    index = " ".join(f"{n} {o}" for n, o in enumerate(offsets, 1)) + " "
    inner = zlib.compress((index + "\n".join(parts)).encode())
    out, places = bytearray(b"%PDF-1.5\n"), {}
    program = f"BT /F1 10 Tf {k} 50 Td (pack) Tj ET".encode()
    for n, head, body in ((10, "", program), (11, f"/Type /ObjStm /N 3 /First {len(index)} /Filter /FlateDecode", inner)):
        places[n] = len(out)
        out += f"{n} 0 obj\n<< {head} /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream\nendobj\n"
    places[12] = len(out)
    rows = [(2, 11, 0), (2, 11, 1), (2, 11, 2), (1, places[10], 0), (1, places[11], 0), (1, places[12], 0)]
    table = zlib.compress(b"".join(bytes([a]) + b.to_bytes(3) + bytes([c]) for a, b, c in rows))
    out += f"12 0 obj\n<< /Type /XRef /Size 13 /W [1 3 1] /Index [1 3 10 3] /Root 1 0 R /Filter /FlateDecode /Length {len(table)} >>\nstream\n".encode() + table + b"\nendstream\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % places[12])
