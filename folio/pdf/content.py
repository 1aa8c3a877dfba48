"""Page programs to positioned glyphs and vector paths: fonts, graphics state, and the operators of text, paths and colour."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .cos import Document, Lexer, Name, Word
from .encodings import core_widths, encoding, glyph_unicode, type1_encoding

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

def times(p: tuple, q: tuple) -> tuple:
    return (p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3], p[4] * q[0] + p[5] * q[2] + q[4], p[4] * q[1] + p[5] * q[3] + q[5])


class Font:
    """Codes to (unicode, width in thousandths)."""

    def __init__(self, doc: Document, font: dict) -> None:
        get = doc.get
        self.known: dict[int, tuple[int, str, float]] = {}
        self.name = re.sub(r"^/?(?:[A-Z]{6}\+)?", "", str(get(font.get("/BaseFont")) or "/unknown"))
        self.wide = get(font.get("/Subtype")) == "/Type0"
        self.missing, self.widths, self.unicode = 500.0, {}, {}
        given, core = get(font.get("/Encoding")), core_widths(self.name)
        base = given if isinstance(given, Name) else (given or {}).get("/BaseEncoding")
        if not self.wide:
            self.unicode = encoding(base, self.name in ("Symbol", "ZapfDingbats"))
            descriptor = get(font.get("/FontDescriptor"))
            if given is None and isinstance(descriptor, dict) and "/FontFile" in descriptor:
                self.unicode |= type1_encoding(doc.stream(descriptor["/FontFile"]))
        if isinstance(given, dict):
            code = 0
            for x in get(given.get("/Differences")) or []:
                if isinstance(x, int):
                    code = x
                else:
                    self.unicode[code] = glyph_unicode(x) or self.unicode.get(code, chr(code))
                    code += 1
        if "/ToUnicode" in font:
            self._cmap(doc.stream(font["/ToUnicode"]))
        first = get(font.get("/FirstChar")) or 0
        self.widths = {first + i: float(get(w)) for i, w in enumerate(get(font.get("/Widths")) or [])}
        if self.wide and (below := get((get(font.get("/DescendantFonts")) or [None])[0])):
            self.missing = float(get(below.get("/DW")) or 1000)
            w = [get(x) for x in get(below.get("/W")) or []]
            while len(w) > 1:
                if isinstance(w[1], list):
                    self.widths |= {w[0] + i: float(get(x)) for i, x in enumerate(w[1])}
                    del w[:2]
                else:
                    self.widths |= dict.fromkeys(range(w[0], w[1] + 1), float(w[2]))
                    del w[:3]
        if core and not self.widths and not self.wide:
            self.widths = {code: core[char] for code, char in self.unicode.items() if char in core}

    def _cmap(self, data: bytes) -> None:
        text = lambda b: b.decode("utf-16-be", "ignore") if len(b) > 1 else b.decode("latin-1")
        for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", data, re.S):
            lex, x = Lexer(body, 0, refs=False), []
            try:
                while True:
                    x.append(lex.value())
            except StopIteration:
                pass
            if kind == b"char":
                self.unicode |= {int.from_bytes(a): text(b) for a, b in zip(x[::2], x[1::2], strict=False)}
            else:
                for lo, hi, to in zip(x[::3], x[1::3], x[2::3], strict=False):
                    for i, code in enumerate(range(int.from_bytes(lo), int.from_bytes(hi) + 1)):
                        self.unicode[code] = text(to[i]) if isinstance(to, list) else text(to)[:-1] + chr(ord(text(to)[-1]) + i)

    def glyphs(self, data: bytes) -> list[tuple[int, str, float]]:
        known, codes = self.known, [int.from_bytes(data[i : i + 2]) for i in range(0, len(data), 2)] if self.wide else data
        for code in set(codes).difference(known):
            known[code] = (code, self.unicode.get(code, chr(code)), self.widths.get(code, self.missing))
        return [known[code] for code in codes]


def interpret(doc: Document, page: dict, fonts: dict | None = None, marks: list | None = None) -> tuple[list[tuple], list[dict]]:
    """(text, left, right, bottom, top, font, size) of each glyph but spaces, in order, and the painted paths. ``marks`` is
    given (place in painting order, colour, fill) of each glyph."""
    out: list[tuple] = []
    paths: list[dict] = []
    fonts = {} if fonts is None else fonts
    state = {"ctm": IDENTITY, "font": None, "size": 1.0, "tc": 0.0, "tw": 0.0, "th": 100.0, "tl": 0.0, "lw": 1.0, "stroke": (0.0,), "fill": (0.0,)}
    stack: list[dict] = []
    text = {"tm": IDENTITY, "line": IDENTITY}
    points: list[tuple[int, float, float]] = []

    def show(data: bytes) -> None:
        font: Font | None = state["font"]
        if font is None:
            return
        # Within one string only the place changes, along the text's own direction.
        m, th, size, tc = times(text["tm"], state["ctm"]), state["th"] / 100, state["size"], state["tc"]
        scale = size * (m[0] ** 2 + m[1] ** 2) ** 0.5
        spacing, moved, name = tc * scale / (size or 1), 0.0, font.name
        x0, y0, mx, my, tw, steps = m[4], m[5], m[0], m[1], state["tw"], {}
        for glyph in font.glyphs(data):
            if glyph not in steps:
                _, char, width = glyph
                reach = (scale * width / 1000 + spacing) * th
                steps[glyph] = char, bool(char.strip()), reach, (size * width / 1000 + tc + (tw if char == " " else 0)) * th
            char, seen, reach, step = steps[glyph]
            if seen:
                if marks is not None:
                    marks.append((len(out) + len(paths), list(state["stroke"]), list(state["fill"])))
                x, y = x0 + moved * mx, y0 + moved * my
                out.append((char, x, x + reach, y, y + scale, name, scale))
            moved += step
        text["tm"] = times((1, 0, 0, 1, moved, 0), text["tm"])

    def at(x: float, y: float) -> tuple[float, float]:
        m = state["ctm"]
        return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]

    def add(x: float, y: float, new: bool = False) -> None:
        sub = points[-1][0] + new if points else 0
        points.append((sub, *at(x, y)))

    def paint(stroked: bool, filled: bool) -> None:
        if points and (stroked or filled):
            place = {"place": len(out) + len(paths), "x": [p[1] for p in points], "y": [p[2] for p in points], "subpath": [p[0] for p in points]}
            paths.append(place | {"filled": filled, "stroked": stroked, "colour": list(state["stroke"]), "fill": list(state["fill"]), "size": state["lw"] * state["ctm"][0]})
        points.clear()

    def close() -> None:
        if points:
            points.append(next(p for p in points if p[0] == points[-1][0]))

    def line(x: float, y: float) -> None:
        text["line"] = text["tm"] = times((1, 0, 0, 1, x, y), text["line"])

    def curve(a: list[float], here: tuple[float, float]) -> None:
        inverse = here
        for i in range(1, 101):
            t = i / 100
            c = [(1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t * t, t**3]
            add(*(c[0] * inverse[k] + c[1] * a[k] + c[2] * a[2 + k] + c[3] * a[4 + k] for k in (0, 1)))

    def run(program: bytes, resources: dict, within: tuple) -> None:
        nonlocal state
        lex, args, here = Lexer(program, 0, refs=False), [], (0.0, 0.0)
        while True:
            try:
                v = lex.value()
            except StopIteration:
                return
            if not isinstance(v, Word):
                args.append(v)
                continue
            n = [float(a) for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
            if v == "q":
                stack.append(dict(state))
            elif v == "Q":
                state = stack.pop() if stack else state
            elif v == "cm" and len(n) == 6:
                state["ctm"] = times(tuple(n), state["ctm"])
            elif v in ("BT", "ET"):
                text["tm"] = text["line"] = IDENTITY
                state |= {"tc": 0.0, "tw": 0.0, "th": 100.0}
            elif v == "Tf" and args:
                name = str(args[0])
                font = (doc.get(resources.get("/Font")) or {}).get(name)
                key = getattr(font, "number", id(resources)), name
                if key not in fonts:
                    found = doc.get(font)
                    fonts[key] = Font(doc, found) if isinstance(found, dict) else next(iter(fonts.values()), None)
                state["font"], state["size"] = fonts[key], n[-1] if n else 1.0
            elif v in ("Tc", "Tw", "TL", "Tz") and n:
                state[{"Tc": "tc", "Tw": "tw", "TL": "tl", "Tz": "th"}[v]] = n[0]
            elif v in ("Td", "TD") and len(n) == 2:
                state["tl"] = -n[1] if v == "TD" else state["tl"]
                line(*n)
            elif v == "T*":
                line(0, -state["tl"])
            elif v == "Tm" and len(n) == 6:
                text["tm"] = text["line"] = tuple(n)
            elif v in ("Tj", "'", '"') and args:
                if v != "Tj":
                    if v == '"' and len(n) > 1:
                        state["tw"], state["tc"] = n[:2]
                    line(0, -state["tl"])
                if isinstance(args[-1], bytes):
                    show(args[-1])
            elif v == "TJ" and args and isinstance(args[0], list):
                for x in args[0]:
                    if isinstance(x, bytes):
                        show(x)
                    elif isinstance(x, (int, float)):
                        text["tm"] = times((1, 0, 0, 1, -x / 1000 * state["size"] * state["th"] / 100, 0), text["tm"])
            elif v in ("m", "l") and len(n) == 2:
                add(*n, new=v == "m")
                here = tuple(n)
            elif v == "c" and len(n) == 6:
                curve(n, here)
                here = tuple(n[4:])
            elif v == "v" and len(n) == 4:
                curve([*here, *n], here)
                here = tuple(n[2:])
            elif v == "y" and len(n) == 4:
                curve([*n, *n[2:]], here)
                here = tuple(n[2:])
            elif v == "re" and len(n) == 4:
                x, y, w, h = n
                for i, p in enumerate(((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))):
                    add(*p, new=not i)
            elif v == "h":
                close()
            elif v == "w" and n:
                state["lw"] = n[0]
            elif v in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                if v in ("s", "b", "b*"):
                    close()
                paint(v[0] in "SsBb", v[0] in "fFBb")
            elif v in ("CS", "cs", "SC", "SCN", "G", "RG", "K", "sc", "scn", "g", "rg", "k"):
                if len(n) == 4:
                    n = [(1 - c) * (1 - n[3]) for c in n[:3]]
                state["stroke" if v[0].isupper() else "fill"] = tuple(n) if n else (0.0,)
            elif v == "Do" and args:
                ref = (doc.get(resources.get("/XObject")) or {}).get(str(args[0]))
                form = doc.get(ref)
                if isinstance(form, dict) and form.get("/Subtype") == "/Form" and ref not in within:  # a form within itself is cut
                    run(doc.stream(ref), doc.get(form.get("/Resources")) or resources, (*within, ref))
            elif v == "ID":
                end = re.compile(rb"\sEI(?=[\s]|\Z)").search(program, lex.at)
                lex.at = end.end() if end else len(program)
            args = []

    run(doc.program(page), doc.get(page.get("/Resources")) or {}, ())
    return out, paths


def content_tokens(program: bytes) -> Iterator[tuple[str, str]]:
    """Tokens of a program and what they are."""
    lex, todo = Lexer(program, 0, refs=False), []
    while True:
        if todo:
            v = todo.pop()
        else:
            try:
                v = lex.value()
            except StopIteration:
                return
        if isinstance(v, list):
            todo += [Word("]"), *reversed(v), Word("[")]
        elif isinstance(v, Word):
            yield str(v), "bracket" if v in ("[", "]") else "operator"
            if v == "ID":
                end = re.compile(rb"\sEI(?=[\s]|\Z)").search(program, lex.at)
                lex.at = end.end() if end else len(program)
        elif isinstance(v, dict):
            todo += [x for k, w in reversed(v.items()) for x in (w, Name(k))]
        else:
            yield (v.decode("latin-1") if isinstance(v, bytes) else f"{v:g}" if isinstance(v, float) else str(v)), ("name" if isinstance(v, Name) else "string" if isinstance(v, bytes) else "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else "value")
