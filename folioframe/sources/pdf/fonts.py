"""Fonts: character codes to text and widths."""

from __future__ import annotations

import re

from .encodings import codes_of, glyph_text, texts_of
from .metrics import metrics
from .objects import Lexer, Ref, Stream


class Memo(dict):
    """What a function of a code gives, worked out once for each."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, code: int):
        self[code] = found = self.of(code)
        return found


class Font:
    def __init__(self, doc, spec: dict, resource: str):
        get = doc.get
        self.name = get(spec.get("BaseFont")) or resource
        self.kind = get(spec.get("Subtype"))
        self.composite = self.kind == "Type0"
        self.scale = 1.0
        if self.kind == "Type3":
            matrix = get(spec.get("FontMatrix")) or [0.001]
            self.scale = abs(get(matrix[0])) * 1000
        self.unicode, self.ranges = {}, []
        if isinstance(cmap := get(spec.get("ToUnicode")), Stream):
            self.read_cmap(doc.decoded(cmap))
        self.names: dict[int, str] = {}
        self.text: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.standard = None
        if self.composite:
            down = get((get(spec.get("DescendantFonts")) or [{}])[0])
            self.missing = float(get(down.get("DW", 1000)))
            self.read_widths([get(x) for x in get(down.get("W")) or []], get)
        else:
            enc = get(spec.get("Encoding"))
            base = enc if isinstance(enc, str) else get(enc.get("BaseEncoding")) if isinstance(enc, dict) else None
            self.names, self.text = dict(codes_of(base or "StandardEncoding")), dict(texts_of(base or "StandardEncoding"))
            code = 0
            for x in get(enc.get("Differences")) or [] if isinstance(enc, dict) else []:
                x = get(x)
                if isinstance(x, int):
                    code = x
                else:
                    self.named(code, x)
                    code += 1
            first, desc = get(spec.get("FirstChar", 0)) or 0, get(spec.get("FontDescriptor")) or {}
            self.widths = {first + i: float(get(w) if type(w) is Ref else w) * self.scale for i, w in enumerate(get(spec.get("Widths")) or [])}
            self.missing = float(get(desc.get("MissingWidth", 0)) or 0)
            self.standard = metrics(str(self.name)) if self.kind != "Type3" else None
            if not isinstance(enc, (str, dict)) and isinstance(program := get(desc.get("FontFile")), Stream):
                for m in re.finditer(rb"dup\s+(\d+)\s*/(\S+)\s+put", doc.decoded(program)):
                    self.named(int(m[1]), m[2].decode("latin-1"))
        self.texts, self.advances, self.space = Memo(self.decode), Memo(self.width), None

    def named(self, code: int, name: str) -> None:
        """A code's glyph; without a text if the name has none."""
        self.names[code] = name
        self.text.pop(code, None)
        if (t := glyph_text(name)) is not None:
            self.text[code] = t

    def read_widths(self, w: list, get) -> None:
        i = 0
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                self.widths |= {w[i] + k: float(get(v)) for k, v in enumerate(w[i + 1])}
                i += 2
            elif i + 2 < len(w):
                self.widths |= dict.fromkeys(range(w[i], min(w[i + 1], w[i] + 65535) + 1), float(w[i + 2]))
                i += 3
            else:
                break

    def read_cmap(self, data: bytes) -> None:
        lex, stack = Lexer(data), []
        number = lambda b: int.from_bytes(b, "big")
        text = lambda b: b.decode("utf-16-be", "ignore")
        while (t := lex.token()) != "" or not stack and lex.at < len(data):
            if t == "":
                break
            if t == "[":
                stack.append(lex.object(t))
            elif t in ("begincodespacerange", "beginbfchar", "beginbfrange"):
                stack = []
            elif t == "endcodespacerange":
                self.ranges += [(len(a), number(a), number(b)) for a, b in zip(stack[::2], stack[1::2])]
            elif t == "endbfchar":
                self.unicode |= {number(a): text(b) for a, b in zip(stack[::2], stack[1::2]) if isinstance(b, bytes)}
            elif t == "endbfrange":
                for a, b, to in zip(stack[::3], stack[1::3], stack[2::3]):
                    a, b = number(a), min(number(b), number(a) + 65535)
                    if isinstance(to, list):
                        self.unicode |= {a + i: text(x) for i, x in enumerate(to[: b - a + 1])}
                    else:
                        head, last = text(to)[:-1], text(to)[-1:]
                        if last:
                            self.unicode |= {a + i: head + chr(ord(last) + i) for i in range(b - a + 1) if ord(last) + i < 0x110000}
            else:
                stack.append(t)

    def codes(self, raw: bytes):
        """(code, bytes it took)."""
        if not self.composite:
            yield from ((c, 1) for c in raw)
            return
        i = 0
        while i < len(raw):
            for size, low, high in self.ranges or [(2, 0, 0xFFFF)]:
                code = int.from_bytes(raw[i : i + size], "big")
                if i + size <= len(raw) and low <= code <= high:
                    yield code, size
                    i += size
                    break
            else:
                yield raw[i], 1
                i += 1

    def width(self, code: int) -> float:
        """Declared, else missing, else of the standard font, else 500."""
        if code in self.widths:
            return self.widths[code]
        if self.missing > 0 or self.composite:
            return self.missing
        found = self.standard.width(self.names.get(code), code) if self.standard else None
        return 500.0 if found is None else found

    def space_width(self) -> float:
        """Of the lowest code that stands for a space, in thousandths; 250 where that makes no sense."""
        if self.space is None:
            code = min((c for c, t in (self.unicode or self.text).items() if t == " "), default=None)
            w = self.widths.get(code)
            if w is None:
                w = self.standard.by_name.get("space", 250.0) if self.standard else 250.0
            self.space = w if 0 < w <= 1000 else 250.0
        return self.space

    def decode(self, code: int, size: int = 1) -> str:
        """By ToUnicode, else by the encoding; of a code of several bytes what is printable ASCII; else the replacement character."""
        if code in self.unicode:
            return self.unicode[code]
        if size > 1:
            return "".join(chr(b) for b in code.to_bytes(size, "big") if 32 <= b < 127)
        return self.text.get(code) or (chr(code) if code < 128 else "\ufffd")


KNOWN: dict[tuple[str, str], Font] = {}
MOST_KNOWN = 64


def made_font(doc, spec: dict, name: str) -> Font:
    """A font; those that refer to nothing else in their file are kept for the next files."""
    told = repr(spec)
    if len(told) > 20_000 or "Ref(" in told or "Stream(" in told:
        return Font(doc, spec, name)
    if (name, told) not in KNOWN:
        if len(KNOWN) >= MOST_KNOWN:
            KNOWN.clear()
        KNOWN[name, told] = Font(doc, spec, name)
    return KNOWN[name, told]


def load_fonts(doc, resources: dict) -> dict[str, Font]:
    out = {}
    for name, ref in (doc.get(resources.get("Font")) or {}).items():
        key = ("font", ref) if isinstance(ref, Ref) else None
        if key and key in doc.cache:
            out[name] = doc.cache[key]
            continue
        spec = doc.get(ref)
        if isinstance(spec, dict):
            out[name] = made_font(doc, spec, name)
            if key:
                doc.cache[key] = out[name]
    return out
