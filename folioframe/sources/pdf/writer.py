"""A small PDF writer for tests and round trips: pages of text runs in WinAnsi fonts, and files put together from any objects."""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

from .crypt import PAD, cbc_encrypt, hardened, rc4
from .objects import digest

BASE = {"F1": "Helvetica", "F2": "Helvetica-Bold", "F3": "Courier"}


def escaped(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    return raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")


def write(pages: list[list[tuple[str, float, float, float, str]]], compress: bool = True, links: list[tuple[str, list[float]]] = ()) -> bytes:
    """pages: lists of runs (font, size, x, y, text); fonts are the names of BASE's values."""
    names = {v: k for k, v in BASE.items()}
    objects: list[bytes] = [b"", b""]
    fonts = b" ".join(f"/{k} {len(objects) + i + 1} 0 R".encode() for i, k in enumerate(BASE))
    widths = b"[" + b" ".join([b"500"] * 224) + b"]"
    for base in BASE.values():
        objects.append(f"<< /Type /Font /Subtype /Type1 /BaseFont /{base} /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 255 /Widths ".encode() + widths + b" >>")
    kids = []
    for runs in pages:
        body = b"\n".join(f"BT /{names.get(font, 'F1')} {size:g} Tf {x:g} {y:g} Td (".encode() + escaped(text) + b") Tj ET" for font, size, x, y, text in runs)
        extra = b""
        if compress:
            body, extra = zlib.compress(body), b" /Filter /FlateDecode"
        objects.append(b"<< /Length " + str(len(body)).encode() + extra + b" >>\nstream\n" + body + b"\nendstream")
        annots = b""
        if links:
            annots = b" /Annots [" + b" ".join(f"<< /Subtype /Link /Rect [{' '.join(map(str, r))}] /A << /S /URI /URI ({u}) >> >>".encode() for u, r in links) + b"]"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents {len(objects)} 0 R /Resources << /Font << ".encode() + fonts + b" >> >>" + annots + b" >>")
        kids.append(len(objects))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + o + b"\nendobj\n"
    at = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF\n".encode()
    return bytes(out)


def lzw_encoded(data: bytes) -> bytes:
    """The codes that lzw() reads, with the default early change."""
    table, width, bits, held, before = {bytes([i]): i for i in range(256)}, 9, 256, 9, b""
    size, out = 258, bytearray()

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
            bits &= (1 << held) - 1

    for byte in data:
        both = before + bytes([byte])
        if both in table:
            before = both
            continue
        put(table[before])
        table[both] = size
        size += 1
        # the reader knows one entry less
        width = min(12, max(9, size.bit_length()))
        if size == 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        before = bytes([byte])
    if before:
        put(table[before])
        width = min(12, max(9, (size + 1).bit_length()))
    put(257)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def predicted(data: bytes, columns: int) -> bytes:
    """PNG rows of so many bytes, with each kind of predictor in turn; the last row is filled with blanks."""
    out, above = bytearray(), bytes(columns)
    for n, i in enumerate(range(0, len(data), columns)):
        row, kind = data[i : i + columns].ljust(columns), n % 5
        out.append(kind)
        for k, v in enumerate(row):
            left, up, corner = row[k - 1] if k else 0, above[k], above[k - 1] if k else 0
            guess = (0, left, up, (left + up) // 2, min((left, up, corner), key=lambda x: abs(left + up - corner - x)))[kind]
            out.append(v - guess & 255)
        above = row
    return bytes(out)


class Lock:
    """The standard security handler's other side. kind: rc4-40, rc4-128, aes-128 or aes-256."""

    ID, OWNER, RIGHTS = bytes(range(16)), bytes(range(32, 64)), 0xFFFFFFFC

    def __init__(self, kind: str, password: str = ""):
        self.kind, word = kind, password.encode("latin-1")
        if kind == "aes-256":
            self.key, verify, salt = bytes(range(32)), bytes(range(8)), bytes(range(8, 16))
            user, wrapped = kept_hash(word, verify) + verify + salt, cbc_encrypt(kept_hash(word, salt), self.key, bytes(16))
            self.entries = f"/V 5 /R 6 /Length 256 /U <{user.hex()}> /UE <{wrapped.hex()}> /O <{bytes(48).hex()}> /OE <{bytes(32).hex()}> /Perms <{bytes(16).hex()}> /P -4 /CF << /StdCF << /CFM /AESV3 /Length 32 >> >> /StmF /StdCF /StrF /StdCF"
            return
        seed, n = digest((word + PAD)[:32], self.OWNER, self.RIGHTS.to_bytes(4, "little"), self.ID), 5 if kind == "rc4-40" else 16
        if kind == "rc4-40":
            self.key = seed[:n]
            user = rc4(self.key, PAD)
        else:
            for _ in range(50):
                seed = digest(seed[:n])
            self.key, user = seed[:n], digest(PAD, self.ID)
            for i in range(20):
                user = rc4(bytes(b ^ i for b in self.key), user)
            user += bytes(16)
        version = {"rc4-40": "/V 1 /R 2", "rc4-128": "/V 2 /R 3 /Length 128", "aes-128": "/V 4 /R 4 /Length 128 /CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF"}[kind]
        self.entries = f"{version} /U <{user.hex()}> /O <{self.OWNER.hex()}> /P -4"

    def closed(self, data: bytes, num: int) -> bytes:
        padded, iv = data + bytes([16 - len(data) % 16]) * (16 - len(data) % 16), hashlib.md5(data).digest()
        if self.kind == "aes-256":
            return iv + cbc_encrypt(self.key, padded, iv)
        own = digest(self.key, num.to_bytes(3, "little"), bytes(2), b"sAlT" if self.kind == "aes-128" else b"")[: min(16, len(self.key) + 5)]
        return iv + cbc_encrypt(own, padded, iv) if self.kind == "aes-128" else rc4(own, data)


@lru_cache(16)
def kept_hash(word: bytes, salt: bytes) -> bytes:
    return hardened(word, salt)


class Builder:
    """Objects by number, 1 the catalogue and 2 the page tree; a body is bytes, or entries and data of a stream."""

    def __init__(self):
        self.bodies: dict[int, bytes | tuple[bytes, bytes]] = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b""}
        self.kids: list[int] = []

    def add(self, body: bytes) -> int:
        self.bodies[len(self.bodies) + 1] = body
        return len(self.bodies)

    def stream(self, data: bytes, entries: str = "") -> int:
        self.bodies[len(self.bodies) + 1] = (entries.encode("latin-1"), data)
        return len(self.bodies)

    def page(self, content: int, resources: str, more: str = "", box: str = "0 0 612 792") -> int:
        self.kids.append(self.add(f"<< /Type /Page /Parent 2 0 R /MediaBox [{box}] /Contents {content} 0 R /Resources << {resources} >> {more} >>".encode("latin-1")))
        return self.kids[-1]

    def finished(self, packed: bool = False, lock: Lock | None = None, later: dict[int, tuple[bytes, bytes]] | None = None) -> bytes:
        """packed: all but streams in an object stream, cross references in a stream. later: objects that an update replaces."""
        self.bodies[2] = f"<< /Type /Pages /Count {len(self.kids)} /Kids [{' '.join(f'{k} 0 R' for k in self.kids)}] >>".encode()
        out, places, inside = bytearray(b"%PDF-1.7\n"), {}, [n for n, b in self.bodies.items() if packed and isinstance(b, bytes)]

        def put(num: int, body) -> None:
            places[num] = len(out)
            if isinstance(body, tuple):
                entries, data = body
                data = lock.closed(data, num) if lock else data
                body = b"<< " + entries + b" /Length " + str(len(data)).encode() + b" >>\nstream\n" + data + b"\nendstream"
            out.extend(f"{num} 0 obj\n".encode() + body + b"\nendobj\n")

        for num, body in self.bodies.items():
            if num not in inside:
                put(num, body)
        top = max(self.bodies) + 1
        extra = f" /Encrypt << /Filter /Standard {lock.entries} >> /ID [<{Lock.ID.hex()}> <{Lock.ID.hex()}>]" if lock else ""
        if packed:
            head, body = [], b""
            for n in inside:
                head.append(f"{n} {len(body)}")
                body += self.bodies[n] + b" "
            first = " ".join(head).encode() + b" "
            put(top, (f"/Type /ObjStm /N {len(inside)} /First {len(first)} /Filter /FlateDecode".encode(), zlib.compress(first + body)))
            at, rows = len(out), [(0, 0, 65535)]
            for n in range(1, top + 2):
                rows.append((2, top, inside.index(n)) if n in inside else (1, places.get(n, at), 0))
            data = b"".join(bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for kind, a, b in rows)
            entries = f"/Type /XRef /Size {top + 2} /W [1 4 2] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>{extra}"
            # each row after its predictor's kind: Up
            rows7 = [data[i : i + 7] for i in range(0, len(data), 7)]
            data = zlib.compress(b"".join(b"\2" + bytes(x - y & 255 for x, y in zip(r, up)) for r, up in zip(rows7, [bytes(7), *rows7])))
            lock, held = None, lock  # cross references are never encrypted
            put(top + 1, (entries.encode(), data))
            lock = held
        else:
            at = len(out)
            out += f"xref\n0 {top}\n0000000000 65535 f \n".encode() + b"".join(f"{places[n]:010d} 00000 n \n".encode() for n in range(1, top))
            out += f"trailer\n<< /Size {top} /Root 1 0 R{extra} >>\n".encode()
        out += f"startxref\n{at}\n%%EOF\n".encode()
        if later:
            for num, body in later.items():
                put(num, body)
            new = len(out)
            out += b"xref\n" + b"".join(f"{n} 1\n{places[n]:010d} 00000 n \n".encode() for n in later)
            out += f"trailer\n<< /Size {top} /Root 1 0 R /Prev {at}{extra} >>\nstartxref\n{new}\n%%EOF\n".encode()
        return bytes(out)


PLAIN = "/Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 255 /Widths [" + " ".join(["500"] * 224) + "]"


def lines_content(lines: list[str], top: float = 760, step: float = 14, size: float = 10) -> bytes:
    """A run for each line, in font F1."""
    return b"\n".join(f"BT /F1 {size:g} Tf 72 {top - step * k:g} Td (".encode() + escaped(x) + b") Tj ET" for k, x in enumerate(lines))
