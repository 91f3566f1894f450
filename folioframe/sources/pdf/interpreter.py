"""Content streams: a page's operators in order, giving text blocks, images and graphics."""

from __future__ import annotations

import re

from .filters import png
from .fonts import load_fonts
from .objects import END, Lexer, Op, PdfError, Stream

MOST_DEPTH, MOST_FORMS, LEAST_GRAPHIC = 32, 10_000, 5.0
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
ABBREVIATED = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "W": "Width", "G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}


def times(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def point(m, x, y):
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


class Interpreter:
    def __init__(self, doc, resources: dict):
        self.doc, self.blocks, self.images, self.graphics = doc, [], [], []
        self.ctm, self.stack, self.line_width = IDENTITY, [], 1.0
        self.text = {"font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Ts": 0.0, "Tr": 0}
        self.tm = self.tlm = IDENTITY
        self.path, self.here, self.forms = [], None, 0
        self.enter(resources)

    def enter(self, resources: dict) -> None:
        self.resources, self.fonts = resources, load_fonts(self.doc, resources)

    def run(self, content: bytes, depth: int = 0) -> None:
        lex, args = Lexer(content), []
        while (t := lex.token()) is not END:
            if isinstance(t, Op) and t not in ("[", "<<", "true", "false", "null"):
                if t == "BI":
                    self.inline_image(lex)
                else:
                    try:
                        self.operate(str(t), args, depth)
                    except (IndexError, TypeError, ValueError, KeyError, AttributeError) as e:
                        raise PdfError(f"operator {t}: {e}") from e
                args = []
            else:
                args.append(lex.object(t))

    def operate(self, op: str, a: list, depth: int) -> None:
        s = self.text
        if op in ("Tj", "'", '"', "TJ"):
            if op == '"':
                s["Tw"], s["Tc"] = a[0], a[1]
            if op in ("'", '"'):
                self.next_line(0, -s["TL"])
            self.show(a[-1] if op == "TJ" else [a[-1]], array=op == "TJ")
        elif op == "BT":
            self.tm = self.tlm = IDENTITY
        elif op == "Tf":
            s["font"], s["size"] = a[0], float(a[1])
        elif op in ("Tc", "Tw", "Tz", "TL", "Ts", "Tr"):
            s[op] = a[0]
        elif op in ("Td", "TD"):
            if op == "TD":
                s["TL"] = -a[1]
            self.next_line(a[0], a[1])
        elif op == "Tm":
            self.tm = self.tlm = tuple(map(float, a[:6]))
            if len(self.tm) != 6:
                raise ValueError("a matrix has six numbers")
        elif op == "T*":
            self.next_line(0, -s["TL"])
        elif op == "q":
            self.stack.append((self.ctm, dict(s), self.line_width))
        elif op == "Q":
            if self.stack:
                self.ctm, self.text, self.line_width = self.stack.pop()
        elif op == "cm":
            self.ctm = times(tuple(map(float, a[:6])), self.ctm)
        elif op == "w":
            self.line_width = float(a[0])
        elif op in ("m", "l"):
            self.here = (a[0], a[1])
            self.path.append(("M" if op == "m" else "L", [point(self.ctm, a[0], a[1])]))
        elif op in ("c", "v", "y"):
            p = [(a[i], a[i + 1]) for i in range(0, len(a), 2)]
            p = [self.here, *p] if op == "v" else [*p, p[-1]] if op == "y" else p
            self.here = p[-1]
            self.path.append(("C", [point(self.ctm, *q) for q in p]))
        elif op == "re":
            x, y, w, h = a[:4]
            self.path += [(k, [point(self.ctm, *q)]) for k, q in zip("MLLL", ((x, y), (x + w, y), (x + w, y + h), (x, y + h)))] + [("Z", [])]
            self.here = (x, y)
        elif op == "h":
            self.path.append(("Z", []))
        elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
            if op in ("s", "b", "b*"):
                self.path.append(("Z", []))
            self.paint(op[0] in "SsBb", op[0] in "fFBb")
        elif op == "Do":
            self.invoke(a[0], depth)

    def next_line(self, x: float, y: float) -> None:
        self.tm = self.tlm = times((1.0, 0.0, 0.0, 1.0, float(x), float(y)), self.tlm)

    def show(self, items: list, array: bool) -> None:
        s = self.text
        font, size, scale = self.fonts.get(s["font"]), s["size"], s["Tz"] / 100
        space = font.space_width() if font else 250.0
        text, moved, start, began = "", 0.0, self.tm, False
        for item in items:
            if isinstance(item, (int, float)):
                step = -item / 1000 * size * scale
                if not text:
                    start = times((1, 0, 0, 1, step, 0), start)  # before the first glyph: the block starts later
                else:
                    moved += step
                    if -item > 0.5 * space and not text.endswith(" "):
                        text += " "
            elif isinstance(item, bytes):
                began = True
                if font and not font.composite:  # a code is a byte
                    n, words = len(item), item.count(b" ")
                    text += "".join(map(font.texts.__getitem__, item))
                    advance = sum(map(font.advances.__getitem__, item))
                else:
                    codes = list(font.codes(item)) if font else [(c, 1) for c in item]
                    n, words = len(codes), sum([k == 1 and c == 32 for c, k in codes])
                    text += "".join([font.decode(c, k) if font else chr(c) for c, k in codes])
                    advance = sum([font.width(c) for c, _ in codes]) if font else 500.0 * n
                moved += (advance / 1000 * size + s["Tc"] * n + s["Tw"] * words) * scale
        if text or not array and began:
            m = times((1, 0, 0, 1, 0, s["Ts"]), times(start, self.ctm))
            full = times(start, self.ctm)
            x, y = point(full, 0, s["Ts"])
            x2, y2 = point(full, moved, s["Ts"])
            width = ((x2 - x) ** 2 + (y2 - y) ** 2) ** 0.5 if abs(full[1]) > 1e-9 and abs(full[0]) < 1e-9 else abs(x2 - x)
            em = lambda v: ((m[2] * v) ** 2 + (m[3] * v) ** 2) ** 0.5
            run = (full[0] ** 2 + full[1] ** 2) ** 0.5
            self.blocks.append({"text": text, "x": min(x, x2), "y": y, "width": width, "height": em(size), "font_size": em(size), "font_name": font.name if font else str(s["font"] or ""), "space_width": abs(space / 1000 * size * scale * run), "render_mode": int(s["Tr"])})
        self.tm = times((1, 0, 0, 1, moved, 0), start)

    def paint(self, stroked: bool, filled: bool) -> None:
        pts = [p for _, ps in self.path for p in ps]
        if pts and (stroked or filled):
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            w, h = max(xs) - min(xs), max(ys) - min(ys)
            if w >= LEAST_GRAPHIC and h >= LEAST_GRAPHIC:
                self.graphics.append({"id": f"Path{len(self.graphics) + 1}", "ops": [{"op": o, "points": [{"x": float(x), "y": float(y)} for x, y in ps]} for o, ps in self.path], "line_width": self.line_width, "is_stroked": stroked, "is_filled": filled, "x": min(xs), "y": min(ys), "width": w, "height": h})
        self.path = []

    def invoke(self, name: str, depth: int) -> None:
        x = self.doc.get((self.doc.get(self.resources.get("XObject")) or {}).get(name))
        if not isinstance(x, Stream):
            return
        kind = self.doc.get(x.dict.get("Subtype"))
        if kind == "Image":
            self.add_image(name, x)
        elif kind == "Form" and depth < MOST_DEPTH and self.forms < MOST_FORMS:
            self.forms += 1
            held = (self.ctm, dict(self.text), self.stack, self.resources, self.fonts, self.tm, self.tlm, self.line_width)
            try:
                self.ctm = times(tuple(float(self.doc.get(v)) for v in self.doc.get(x.dict.get("Matrix")) or IDENTITY), self.ctm)
                self.stack = []
                own = self.doc.get(x.dict.get("Resources"))
                if own:
                    self.enter(self.resources | own)
                self.run(self.doc.decoded(x), depth + 1)
            except ValueError:
                pass  # a damaged form loses itself, not the page
            finally:
                self.ctm, self.text, self.stack, self.resources, self.fonts, self.tm, self.tlm, self.line_width = held

    def add_image(self, name: str, s: Stream) -> None:
        try:
            data, kind = image_bytes(self.doc, s)
        except ValueError:
            return
        if data:
            self.images.append({"id": name, "data": data, "format": kind, "x": self.ctm[4], "y": self.ctm[5], "width": self.ctm[0], "height": self.ctm[3]})

    def inline_image(self, lex: Lexer) -> None:
        d = {}
        while (k := lex.token()) != "ID" or not isinstance(k, Op):
            if k is END:
                raise PdfError("an inline image has no data")
            v = lex.object()
            d[ABBREVIATED.get(k, k)] = ABBREVIATED.get(v, v) if isinstance(v, str) else v
        m = re.compile(rb"[\s]EI(?=[\s/\[<(]|$)").search(lex.data, lex.at)
        if not m:
            raise PdfError("an inline image does not end")
        raw, lex.at = lex.data[lex.at + 1 : m.start()], m.end()
        if d.get("Width", 0) > 2 or d.get("Height", 0) > 2:
            self.add_image(f"Inline{len(self.images) + 1}", Stream(d, raw))


def image_bytes(doc, s: Stream) -> tuple[bytes, str]:
    """An image's file bytes and format: JPEG kinds as they are, 8-bit and indexed ones as PNG, b'' for others."""
    get = doc.get
    names = get(s.dict.get("Filter"))
    last = names[-1] if isinstance(names, list) and names else names
    if get(last) in ("DCTDecode", "JPXDecode"):
        return doc.decoded(s), "jpg" if last == "DCTDecode" else "jp2"
    w, h, bits = (get(s.dict.get(k, 0)) or 0 for k in ("Width", "Height", "BitsPerComponent"))
    space = get(s.dict.get("ColorSpace"))
    kind = get(space[0]) if isinstance(space, list) else space
    data = doc.decoded(s)
    if w <= 0 or h <= 0:
        return b"", ""
    if kind == "Indexed" and bits in (1, 2, 4, 8):
        table = get(space[3])
        table = doc.decoded(table) if isinstance(table, Stream) else table
        base = get(space[1])
        n = {"DeviceGray": 1, "DeviceCMYK": 4}.get(get(base[0]) if isinstance(base, list) else base, 3)
        line, out = (w * bits + 7) // 8, bytearray()
        for y in range(h):
            row = data[y * line : (y + 1) * line]
            for x in range(w):
                at = x * bits
                v = (row[at // 8] >> 8 - bits - at % 8) & (1 << bits) - 1
                out += rgb(table[v * n : v * n + n])
        return png(w, h, 3, bytes(out)), "png"
    if bits != 8:
        return b"", ""
    n = {"DeviceGray": 1, "CalGray": 1, "Separation": 1, "DeviceN": 1, "DeviceCMYK": 4}.get(kind, 3)
    if len(data) < w * h * n:
        return b"", ""
    if trivial_image(data, w, h, n):
        return b"", ""
    if n == 4:
        return png(w, h, 3, b"".join(rgb(data[i : i + 4]) for i in range(0, w * h * 4, 4))), "png"
    return png(w, h, n, data[: w * h * n]), "png"


def rgb(v: bytes) -> bytes:
    if len(v) == 4:
        return bytes(int((1 - c / 255) * (1 - v[3] / 255) * 255) for c in v[:3])
    return v if len(v) == 3 else bytes(v[:1]) * 3


def trivial_image(data: bytes, w: int, h: int, n: int) -> bool:
    """Whether one colour makes up over 95 % of an image of 100 pixels or more (of a thousandth of them, beyond 10,000)."""
    total = w * h
    if total < 100:
        return False
    step = max(1, total // 1000) if total > 10_000 else 1
    seen: dict[bytes, int] = {}
    for i in range(0, total, step):
        c = data[i * n : i * n + n]
        seen[c] = seen.get(c, 0) + 1
    return max(seen.values()) > 0.95 * sum(seen.values())
