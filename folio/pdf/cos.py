"""Objects of PDF files: values, cross-references, object streams, filters, and the standard encryption with an empty password."""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

def spelt(value: object) -> str:
    """A value as a file spells it."""
    if isinstance(value, dict):
        return f"<< {' '.join(f'{k} {spelt(v)}' for k, v in value.items())} >>"
    if isinstance(value, list):
        return f"[{' '.join(map(spelt, value))}]"
    if isinstance(value, Ref):
        return f"{value.number} {value.generation} R"
    if isinstance(value, bytes):
        return "(" + value.decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"
    return {True: "true", False: "false", None: "null"}[value] if value is None or isinstance(value, bool) else f"{value:g}" if isinstance(value, float) else str(value)


#: The padding of passwords (fixed value).
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
SPACE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
NUMBER = re.compile(rb"[-+]*(?:\d+\.?\d*|\.\d+)\Z")
PLAIN = re.compile(rb"[^\\()]+")
REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
ESCAPES = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}


class Name(str):
    """A name with its slash."""


class Word(str):
    """An operator or keyword."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int = 0


@lru_cache(1 << 14)
def regular(token: bytes) -> int | float | bool | Word | None:
    """The number, constant or word that regular characters spell."""
    if NUMBER.match(token):
        text = token.lstrip(b"+-")
        sign = -1 if token.startswith(b"-") else 1
        return sign * (float(text) if b"." in text else int(text))
    word = token.decode("latin-1")
    return {"true": True, "false": False, "null": None}.get(word, Word(word))


class Lexer:
    """Reads values one after another; raises StopIteration at the end."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True) -> None:
        self.data, self.at, self.refs = data, at, refs

    def string(self) -> bytes:
        out, depth, d = bytearray(), 1, self.data
        while self.at < len(d):
            if m := PLAIN.match(d, self.at):
                out += m[0]
                self.at = m.end()
                continue
            c = d[self.at]
            self.at += 1
            if c == 92 and self.at < len(d):
                c = d[self.at]
                self.at += 1
                if 48 <= c <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(d, self.at - 1)
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                elif c == 13:
                    self.at += d[self.at : self.at + 1] == b"\n"
                elif c != 10:
                    out.append(ESCAPES.get(c, c))
                continue
            depth += (c == 40) - (c == 41)
            if not depth:
                break
            out.append(c)
        return bytes(out)

    def value(self):
        d = self.data
        self.at = SKIP.match(d, self.at).end()
        if self.at >= len(d):
            raise StopIteration
        c = d[self.at : self.at + 1]
        if not self.refs and c not in DELIMITERS:
            m = REGULAR.match(d, self.at)
            self.at = m.end()
            return regular(m[0])
        if c == b"/":
            m = REGULAR.match(d, self.at + 1)
            self.at = m.end() if m else self.at + 1
            return Name("/" + re.sub(r"#([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), m[0].decode("latin-1") if m else ""))
        if c == b"(":
            self.at += 1
            return self.string()
        if d[self.at : self.at + 2] == b"<<":
            self.at += 2
            return self.dictionary()
        if c == b"<":
            end = d.find(b">", self.at)
            end = len(d) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.at = SKIP.match(d, self.at).end()
                if self.at >= len(d) or d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.value())
        m = REGULAR.match(d, self.at)
        if not m:
            self.at += 1
            return Word(c.decode("latin-1"))
        if self.refs and (r := REFERENCE.match(d, self.at)):
            self.at = r.end()
            return Ref(int(r[1]), int(r[2]))
        self.at = m.end()
        return regular(m[0])

    def dictionary(self) -> dict:
        out = {}
        while True:
            self.at = SKIP.match(self.data, self.at).end()
            if self.at >= len(self.data) or self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.value()
            self.at = SKIP.match(self.data, self.at).end()
            if self.data[self.at : self.at + 2] == b">>":
                continue
            out[str(key)] = self.value()


def inflated(body: bytes) -> bytes:
    """A zlib stream's bytes. One that is cut short gives what it has; one that is damaged from its start raises ValueError."""
    inflate = zlib.decompressobj()
    try:
        return inflate.decompress(body) + inflate.flush()
    except zlib.error as e:
        out, inflate = bytearray(), zlib.decompressobj()
        try:
            for i in range(len(body)):
                out += inflate.decompress(body[i : i + 1])
        except zlib.error:
            pass
        if not out:
            raise ValueError(f"damaged stream: {e}") from e
        return bytes(out)


def rc4(key: bytes, data: bytes) -> bytes:
    s, j, k = list(range(256)), 0, len(key)
    for i in range(256):
        x = s[i]
        j = (j + x + key[i % k]) & 255
        s[i], s[j] = s[j], x
    # Two bytes are swapped for each that comes out; the stream of these is laid over the data at once.
    out, i, j = bytearray(len(data)), 0, 0
    for n in range(len(data)):
        i = (i + 1) & 255
        x = s[i]
        j = (j + x) & 255
        s[i] = y = s[j]
        s[j] = x
        out[n] = s[(x + y) & 255]
    return (int.from_bytes(out) ^ int.from_bytes(data)).to_bytes(len(data))


def file_key(encrypt: dict, file_id: bytes, password: bytes = b"") -> bytes:
    """The key of the empty (or given) user password, checked against /U."""
    revision, length = encrypt.get("/R", 2), encrypt.get("/Length", 40) // 8
    length = 5 if revision == 2 else length
    key = hashlib.md5((password + PAD)[:32] + encrypt["/O"][:32] + (encrypt["/P"] & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
    if revision > 2:
        for _ in range(50):
            key = hashlib.md5(key[:length]).digest()
    key = key[:length]
    if user_entry(key, revision, file_id)[: 32 if revision == 2 else 16] != encrypt["/U"][: 32 if revision == 2 else 16]:
        raise ValueError("the file needs a password")
    return key


def user_entry(key: bytes, revision: int, file_id: bytes) -> bytes:
    if revision == 2:
        return rc4(key, PAD)
    x = hashlib.md5(PAD + file_id).digest()
    for i in range(20):
        x = rc4(bytes(k ^ i for k in key), x)
    return x.ljust(32, b"\0")


def object_key(key: bytes, number: int, generation: int = 0) -> bytes:
    return hashlib.md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little")).digest()[: min(16, len(key) + 5)]


def unpredicted(data: bytes, parms: dict) -> bytes:
    """Undoes PNG predictors, row by row."""
    if parms.get("/Predictor", 1) < 10:
        return data
    size = max(1, parms.get("/Colors", 1) * parms.get("/BitsPerComponent", 8) // 8)
    width = (parms.get("/Columns", 1) * parms.get("/Colors", 1) * parms.get("/BitsPerComponent", 8) + 7) // 8
    if len(data) % (width + 1) == 0 and not set(data[:: width + 1]) - {2}:  # all rows differ from the one above: running sums
        rows = np.frombuffer(data, np.uint8).reshape(-1, width + 1)[:, 1:]
        return np.cumsum(rows, axis=0, dtype=np.uint8).tobytes()
    out, above = bytearray(), bytes(width)
    for i in range(0, len(data) - width, width + 1):
        kind, row = data[i], bytearray(data[i + 1 : i + 1 + width])
        for k in range(len(row)):
            left, up, corner = row[k - size] if k >= size else 0, above[k], above[k - size] if k >= size else 0
            if kind == 4:
                p = left + up - corner
                guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            else:
                guess = (0, left, up, (left + up) // 2)[kind]
            row[k] = (row[k] + guess) & 255
        out += row
        above = bytes(row)
    return bytes(out)


class Document:
    """Cross-references and objects of one file. Newer sections win; free entries are left out."""

    def __init__(self, data: bytes) -> None:
        self.data, self.xref, self.trailer, self.cache, self.key = data, {}, {}, {}, b""
        found = re.findall(rb"startxref\s+(\d+)", data[-2048:])
        if not data.lstrip()[:5].startswith(b"%PDF") or not found:
            raise ValueError("no PDF file")
        todo, seen = [int(found[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or at >= len(data):
                continue
            seen.add(at)
            trailer = self._table(at) if data[at : at + 20].lstrip().startswith(b"xref") else self._stream(at)
            self.trailer = trailer | self.trailer
            todo += [trailer[k] for k in ("/XRefStm", "/Prev") if isinstance(trailer.get(k), int)]
        if "/Encrypt" in self.trailer:
            encrypt = self.get(self.trailer["/Encrypt"])
            self.crypt = self.trailer["/Encrypt"].number if isinstance(self.trailer["/Encrypt"], Ref) else None
            self.cache.clear()
            self.key = file_key(encrypt, (self.trailer.get("/ID") or [b""])[0])

    def _table(self, at: int) -> dict:
        lex = Lexer(self.data, self.data.index(b"xref", at) + 4, refs=False)
        while (first := lex.value()) != "trailer":
            for number in range(first, first + lex.value()):
                offset, _, kind = lex.value(), lex.value(), lex.value()
                if kind == "n":
                    self.xref.setdefault(number, (offset, 0))
                else:
                    self.xref.setdefault(number, None)
        return Lexer(self.data, lex.at).value()

    def _stream(self, at: int) -> dict:
        header, body = self._indirect(at)
        data, w = self._decoded(header, body), header["/W"]
        index = header.get("/Index") or [0, header["/Size"]]
        numbers = [n for a, k in zip(index[::2], index[1::2], strict=False) for n in range(a, a + k)]
        for i, number in enumerate(numbers):
            row, fields = data[i * sum(w) : (i + 1) * sum(w)], []
            for size in w:
                fields.append(int.from_bytes(row[:size]) if size else None)
                row = row[size:]
            kind = 1 if fields[0] is None else fields[0]
            self.xref.setdefault(number, (fields[1], 0) if kind == 1 else (fields[2] or 0, fields[1]) if kind == 2 else None)
        return header

    def _indirect(self, at: int) -> tuple[object, bytes | None]:
        lex = Lexer(self.data, at, refs=False)
        lex.value(), lex.value(), lex.value()
        lex.refs = True
        value = lex.value()
        m = re.compile(rb"\s*stream\r?\n?").match(self.data, lex.at)
        if not isinstance(value, dict) or not m:
            return value, None
        size = value.get("/Length")
        size = self.get(size) if isinstance(size, Ref) else size
        end = m.end() + size if isinstance(size, int) else -1
        if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
            end = self.data.find(b"endstream", m.end())
        return value, self.data[m.end() : end]

    def _decoded(self, header: dict, body: bytes) -> bytes:
        filters, parms = self.get(header.get("/Filter")) or [], self.get(header.get("/DecodeParms")) or {}
        filters, parms = (x if isinstance(x, list) else [x] for x in (filters, parms))
        for i, f in enumerate(filters):
            if f in ("/FlateDecode", "/Fl"):
                body = inflated(body)
                body = unpredicted(body, (self.get(parms[i]) if i < len(parms) else None) or {})
            else:
                break  # image filters and others stay as they are
        return body

    def fetch(self, number: int) -> tuple[object, bytes | None]:
        """Value and decoded stream of an object; (None, None) if there is none."""
        if number not in self.cache:
            self.cache[number] = (None, None)
            try:
                self._read(number)
            except Exception:
                self.cache.pop(number, None)  # else it would count as absent from then on
                raise
        return self.cache[number]

    def _read(self, number: int) -> None:
        entry = self.xref.get(number)
        if entry and not entry[1]:
            value, body = self._indirect(entry[0])
            if body is not None:
                if self.key and number != self.crypt and value.get("/Type") != "/XRef":
                    body = rc4(object_key(self.key, number), body)
                body = self._decoded(value, body)
            self.cache[number] = (value, body)
        elif entry:
            header, body = self.fetch(entry[1])
            if isinstance(header, dict) and body is not None:
                lex = Lexer(body, 0, refs=False)
                pairs = [(lex.value(), lex.value()) for _ in range(header["/N"])]
                for n, offset in pairs:
                    if self.xref.get(n, (0, 0)) and self.xref[n][1] == entry[1]:
                        self.cache[n] = (Lexer(body, header["/First"] + offset).value(), None)

    def get(self, value: object) -> object:
        """The value that a reference stands for, else the value itself."""
        for _ in range(50):
            if not isinstance(value, Ref):
                break
            value = self.fetch(value.number)[0]
        return value

    def stream(self, value: object) -> bytes:
        return (self.fetch(value.number)[1] if isinstance(value, Ref) else None) or b""

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit; a page tree that leads back into itself is cut."""
        out, seen = [], set()

        def walk(ref: object, inherited: dict) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and ref.number in seen:
                return
            if isinstance(ref, Ref):
                seen.add(ref.number)
            own = inherited | {k: v for k, v in node.items() if k in ("/Resources", "/MediaBox", "/CropBox", "/BleedBox", "/ArtBox", "/TrimBox", "/Rotate")}
            if "/Kids" in node:
                for kid in self.get(node["/Kids"]) or []:
                    walk(kid, own)
            elif self.get(node.get("/Type")) in ("/Page", None):
                out.append(own | node)

        walk((self.get(self.trailer.get("/Root")) or {}).get("/Pages"), {})
        return out

    def program(self, page: dict) -> bytes:
        contents = page.get("/Contents")
        value = self.get(contents)
        parts = value if isinstance(value, list) else [contents]
        return b"".join(self.stream(p) + b"\n" for p in parts)

    def box(self, page: dict) -> list[float]:
        """Trim, art, media, crop or bleed box, the first that is given; US Letter if none is."""
        for k in ("/TrimBox", "/ArtBox", "/MediaBox", "/CropBox", "/BleedBox"):
            if box := self.get(page.get(k)):
                return [float(self.get(x)) for x in box]
        return [0.0, 0.0, 612.0, 792.0]
