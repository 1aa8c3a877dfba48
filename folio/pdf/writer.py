"""A plain PDF writer for round trips, independent of the reader: one content line for each row of positioned text."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

from .cos import PAD, object_key, rc4, user_entry


def write_pdf(pages: list[list[tuple[str, float, float]]], size: int = 10, flate: bool = False, stream_xref: bool = False, encrypt: int = 0) -> bytes:
    """``pages``: rows of (text, left, bottom). The font is 500 wide, its space 300. ``encrypt``: 0 or revision 2 or 3."""
    widths = " ".join(["300", *["500"] * 223])
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /MediaBox [0 0 612 792] /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] >>", f"<< /Type /Font /Subtype /TrueType /BaseFont /ABCDEF+Plain /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 255 /Widths [{widths}] >>"]
    bodies: dict[int, bytes] = {}
    for i, rows in enumerate(pages):
        objects.append(f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>")
        shown = b"".join(b"BT /F1 %d Tf %g %g Td (%s) Tj ET\n" % (size, x, y, t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")) for t, x, y in rows)
        bodies[len(objects) + 1] = zlib.compress(shown) if flate else shown
        objects.append("/Filter /FlateDecode" if flate else "")
    extra, change = "", lambda n, b: b
    if encrypt:
        file_id, owner = hashlib.md5(b"folio").digest(), rc4(b"owner", PAD)
        length = 5 if encrypt == 2 else 16
        key = hashlib.md5(PAD + owner + (0xFFFFFFFC).to_bytes(4, "little") + file_id).digest()
        for _ in range(50 if encrypt > 2 else 0):
            key = hashlib.md5(key[:length]).digest()
        key = key[:length]
        objects.append(f"<< /Filter /Standard /V {encrypt - 1} /R {encrypt} /Length {8 * length} /P -4 /O <{owner.hex()}> /U <{user_entry(key, encrypt, file_id).hex()}> >>")
        extra, change = f" /Encrypt {len(objects)} 0 R /ID [<{file_id.hex()}> <{file_id.hex()}>]", lambda n, b: rc4(object_key(key, n), b)
    return _assembled(objects, bodies, extra, change, stream_xref)


def _assembled(objects: list[str], bodies: dict[int, bytes], extra: str, change: Callable[[int, bytes], bytes], stream_xref: bool) -> bytes:
    out, offsets = bytearray(b"%PDF-1.5\n"), []
    for n, text in enumerate(objects, 1):
        offsets.append(len(out))
        body = change(n, bodies[n]) if n in bodies else None
        out += b"%d 0 obj\n" % n + (text.encode("latin-1") if body is None else b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), text.encode(), body)) + b"\nendobj\n"
    start, count = len(out), len(objects) + 1
    if stream_xref:
        rows = b"".join(bytes([k]) + o.to_bytes(4) + b"\0" for k, o in [(0, 0), *[(1, o) for o in offsets], (1, start)])
        up = b"".join(b"\x02" + bytes((c - p) & 255 for c, p in zip(rows[i : i + 6], rows[i - 6 : i] or bytes(6), strict=True)) for i in range(0, len(rows), 6))
        packed = zlib.compress(up)
        out += f"{count} 0 obj\n<< /Type /XRef /Size {count + 1} /W [1 4 1] /Root 1 0 R{extra} /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >> /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream\nendobj\n"
    else:
        out += f"xref\n0 {count}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % o for o in offsets) + f"trailer\n<< /Size {count} /Root 1 0 R{extra} >>\n".encode()
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)
