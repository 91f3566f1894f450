"""PDF syntax: tokens, objects, cross references, object streams, encryption, the page tree.

Objects in Python: None, bool, int, float, str (names), bytes (strings), list, dict, Stream, Ref.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

from . import filters


class PdfError(ValueError):
    pass


class Ref(NamedTuple):
    num: int
    gen: int


class Stream(NamedTuple):
    dict: dict
    raw: bytes


class Op(str):
    """A bare word: an operator, or a keyword such as obj."""


SPACE, DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]*")
BLANKS = re.compile(rb"(?:[\0\t\n\f\r ]++|%[^\r\n]*+)*+")  # possessive: nothing to try again in a hostile file
REFERENCE = re.compile(BLANKS.pattern + rb"([0-9]+)(?![^\0\t\n\f\r ()<>\[\]{}/%])" + BLANKS.pattern + rb"R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
NUMBERS = re.compile(rb"[\t\n\f\r ]*+((?:-?[0-9]++(?:\.[0-9]++)?(?:[\t\n\f\r ]++|(?=\])))*+)\]")  # an array of plain numbers, up to its end
PLAIN = re.compile(rb"[^\\()]+")
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
END = Op("")


def plain_numbers(text: bytes) -> list:
    return [float(x) if b"." in x else int(x) for x in text.split()]


numbers = lru_cache(64)(plain_numbers)  # the same widths stand in many files


class Lexer:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self):
        d = self.data
        self.at = BLANKS.match(d, self.at).end()
        if self.at >= len(d):
            return END
        c = d[self.at]
        if c == 0x2F:
            m = REGULAR.match(d, self.at + 1)
            self.at = m.end()
            name = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0]) if b"#" in m[0] else m[0]
            return name.decode("latin-1")
        if c == 0x28:
            return self.string()
        if d[self.at : self.at + 2] in (b"<<", b">>"):
            self.at += 2
            return Op(d[self.at - 2 : self.at].decode())
        if c == 0x3C:
            end = d.find(b">", self.at)
            if end < 0:
                raise PdfError("a hex string does not end")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c in b"[]{}>)":
            self.at += 1
            return Op(chr(c))
        m = REGULAR.match(d, self.at)
        self.at = m.end()
        word = m[0]
        if c not in b"+-.0123456789":
            return Op(word.decode("latin-1"))
        try:
            return int(word)
        except ValueError:
            try:
                return float(word) if re.fullmatch(rb"[-+]?[0-9.]+", word) else Op(word.decode("latin-1"))
            except ValueError:
                return Op(word.decode("latin-1"))

    def string(self) -> bytes:
        d, i, depth, out = self.data, self.at + 1, 1, bytearray()
        while i < len(d):
            if m := PLAIN.match(d, i):
                out += m[0]
                i = m.end()
                continue
            c = d[i]
            if c == 0x5C:
                i += 1
                n = d[i] if i < len(d) else 0
                if n in ESCAPES:
                    out.append(ESCAPES[n])
                elif 48 <= n <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(d, i)
                    out.append(int(m[0], 8) & 255)
                    i = m.end() - 1
                elif n in b"\r\n":
                    i += n == 13 and d[i + 1 : i + 2] == b"\n"
                else:
                    out.append(n)
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = i + 1
                    return bytes(out)
                out.append(c)
            i += 1
        raise PdfError("a string does not end")

    def object(self, t=None, depth: int = 0):
        t = self.token() if t is None else t
        if depth > 100:
            raise PdfError("objects are nested too deeply")
        if not isinstance(t, Op):
            if type(t) is int and t >= 0:  # n g R
                if m := REFERENCE.match(self.data, self.at):
                    self.at = m.end()
                    return Ref(t, int(m[1]))
            return t
        if t == "[":
            if m := NUMBERS.match(self.data, self.at):  # as widths are: at once
                self.at = m.end()
                return list(numbers(m[1])) if len(m[1]) < 10_000 else plain_numbers(m[1])
            out = []
            while (t := self.token()) != "]" or not isinstance(t, Op):
                if t is END:
                    raise PdfError("an array does not end")
                out.append(self.object(t, depth + 1))
            return out
        if t == "<<":
            out = {}
            while (k := self.token()) != ">>" or not isinstance(k, Op):
                if k is END or isinstance(k, Op) or not isinstance(k, str):
                    raise PdfError("a dictionary's key is no name")
                out[k] = self.object(None, depth + 1)
            return out
        return {"true": True, "false": False, "null": None}.get(t, t)


class Document:
    """A file: cross references newest first, objects by number. Raises PdfError where it can't be read."""

    def __init__(self, data: bytes, password: str = ""):
        self.data, self.cache, self.open = data, {}, set()
        self.xref: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.security = None
        tail = data[-1024:]
        if b"%%EOF" not in tail:
            raise PdfError("no %%EOF at the end")
        m = re.findall(rb"startxref\s+(\d+)", tail[: tail.rindex(b"%%EOF")])
        if not m:
            raise PdfError("no startxref")
        todo, seen = [int(m[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                raise PdfError("cross references go in a circle")
            seen.add(at)
            trailer = self.section(at)
            self.trailer = self.trailer or trailer
            todo += [trailer[k] for k in ("XRefStm", "Prev") if type(trailer.get(k)) is int]
        if "Encrypt" in self.trailer:
            from .crypt import Security

            enc = self.get(self.trailer["Encrypt"])
            ids = self.get(self.trailer.get("ID")) or [b""]
            self.security = Security({k: self.get(v) for k, v in enc.items()}, ids[0], password)
            self.cache.clear()
        self.root = self.get(self.trailer.get("Root"))
        if not isinstance(self.root, dict):
            raise PdfError("no catalogue")

    def section(self, at: int) -> dict:
        lex = Lexer(self.data, at)
        if lex.token() != "xref":
            s = self.parsed(at)[1]
            if not isinstance(s, Stream) or s.dict.get("Type") != "XRef":
                raise PdfError("no cross references where they should be")
            body, w = self.decoded(s), s.dict["W"]
            index = s.dict.get("Index") or [0, s.dict["Size"]]
            p = 0
            for first, count in zip(index[::2], index[1::2]):
                for n in range(first, first + count):
                    f = []
                    for size in w:
                        f.append(int.from_bytes(body[p : p + size], "big"))
                        p += size
                    kind = f[0] if w[0] else 1
                    self.xref.setdefault(n, ("n", f[1]) if kind == 1 else ("o", f[1], f[2]) if kind == 2 else ("f",))
            return s.dict
        while True:
            t = lex.token()
            if t == "trailer":
                return lex.object()
            count = lex.token()
            if type(t) is not int or type(count) is not int:
                raise PdfError("a cross reference table is damaged")
            for n in range(t, t + count):
                offset, _, kind = lex.token(), lex.token(), lex.token()
                self.xref.setdefault(n, ("n", offset) if kind == "n" else ("f",))

    def parsed(self, at: int):
        """(number, object) at an offset; streams with their bytes."""
        lex = Lexer(self.data, at)
        num, gen, word = lex.token(), lex.token(), lex.token()
        if type(num) is not int or word != "obj":
            raise PdfError(f"no object at {at}")
        value = lex.object()
        back = lex.at
        if isinstance(value, dict) and lex.token() == "stream":
            i = lex.at
            i += 2 if self.data[i : i + 2] == b"\r\n" else 1
            size = value.get("Length")
            size = self.get(size) if isinstance(size, Ref) else size
            if type(size) is not int or not 0 <= size <= len(self.data) - i or b"endstream" not in self.data[i + size : i + size + 20]:
                end = self.data.find(b"endstream", i)
                if end < 0:
                    raise PdfError("a stream does not end")
                size = end - i
            return num, Stream(value, self.data[i : i + size])
        lex.at = back
        return num, value

    def get(self, x):
        """What a reference points to; other objects as they are."""
        hops = 0
        while isinstance(x, Ref):
            hops += 1
            if hops > 20:
                raise PdfError("references go in a circle")
            x = self.object(x.num)
        return x

    def object(self, num: int):
        if num in self.cache:
            return self.cache[num]
        entry = self.xref.get(num, ("f",))
        if entry[0] == "f" or num in self.open:
            return None
        self.open.add(num)
        try:
            if entry[0] == "n":
                found, value = self.parsed(entry[1])
                if found != num:
                    raise PdfError(f"object {num} is not where it should be")
                if self.security:
                    value = self.security.decrypted(value, num, 0)
            else:
                value = self.in_stream(entry[1], entry[2], num)
        finally:
            self.open.discard(num)
        self.cache[num] = value
        return value

    def in_stream(self, container: int, index: int, num: int):
        s = self.object(container)
        if not isinstance(s, Stream) or self.xref.get(container, ("f",))[0] != "n":
            raise PdfError("an object stream is missing")
        body = self.decoded(s)
        lex = Lexer(body)
        head = [(lex.token(), lex.token()) for _ in range(self.get(s.dict["N"]))]
        place = next((o for n, o in head if n == num), None)
        if place is None:
            raise PdfError("an object stream lacks an object")
        return Lexer(body, self.get(s.dict["First"]) + place).object()

    def decoded(self, s: Stream) -> bytes:
        names, params = self.get(s.dict.get("Filter")), self.get(s.dict.get("DecodeParms"))
        names = [] if names is None else [self.get(n) for n in names] if isinstance(names, list) else [names]
        params = params if isinstance(params, list) else [params]
        return filters.decode(s.raw, names, [{k: self.get(v) for k, v in (self.get(p) or {}).items()} for p in params])

    def pages(self):
        """Dictionaries of the pages in order, with what they inherit."""
        stack, seen = [(self.root.get("Pages"), {})], set()
        while stack:
            ref, inherited = stack.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    raise PdfError("the page tree goes in a circle")
                seen.add(ref)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.get(node.get("Kids"))
            if kids is not None:
                stack += [(k, own) for k in reversed(kids)]
            else:
                yield own | node


def digest(*parts: bytes) -> bytes:
    return hashlib.md5(b"".join(parts)).digest()
