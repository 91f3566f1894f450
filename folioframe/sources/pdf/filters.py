"""Stream filters. Every decoder has a cap on what it may produce; damaged input raises FilterError, never anything else."""

from __future__ import annotations

import struct
import zlib

CAP = 256 << 20


class FilterError(ValueError):
    pass


def flate(data: bytes, cap: int = CAP) -> bytes:
    try:
        d = zlib.decompressobj()
        out = d.decompress(data, cap + 1)
    except zlib.error as e:
        raise FilterError(f"flate: {e}") from e
    if len(out) > cap:
        raise FilterError("flate: more than the cap")
    if not d.eof:
        raise FilterError("flate: cut short")
    return out


def lzw(data: bytes, early: int = 1, cap: int = CAP) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; the width grows `early` codes before it must."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, before, bits, held, size = [], 9, b"", 0, 0, 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        while held >= width:
            held -= width
            code = bits >> held
            bits &= (1 << held) - 1
            if code == 256:
                del table[258:]
                width, before = 9, b""
                continue
            if code == 257:
                return b"".join(out)
            if code < len(table) and code not in (256, 257):
                entry = table[code]
            elif code == len(table) and before:
                entry = before + before[:1]
            else:
                raise FilterError("lzw: no such code")
            if before and len(table) < 4096:
                table.append(before + entry[:1])
            out.append(entry)
            size += len(entry)
            if size > cap:
                raise FilterError("lzw: more than the cap")
            before = entry
            width = min(12, max(9, (len(table) + early).bit_length() if len(table) + early >= 512 else 9))
    return b"".join(out)


def ascii_hex(data: bytes) -> bytes:
    digits = data.split(b">", 1)[0].translate(None, b" \t\n\r\f\0")
    if digits.translate(None, b"0123456789abcdefABCDEF"):
        raise FilterError("hex: not a digit")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii_85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~", 1)[0].translate(None, b" \t\n\r\f\0"):
        if c == 0x7A:
            if group:
                raise FilterError("ascii85: z inside a group")
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
        else:
            raise FilterError("ascii85: not a digit")
    if len(group) == 1:
        raise FilterError("ascii85: one digit left")
    if group:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def run_length(data: bytes, cap: int = CAP) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            if i + 2 + n > len(data):
                raise FilterError("run length: cut short")
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if i + 1 >= len(data):
                raise FilterError("run length: cut short")
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        if len(out) > cap:
            raise FilterError("run length: more than the cap")
    return bytes(out)


def unpredicted(data: bytes, predictor: int, columns: int = 1, colors: int = 1, bits: int = 8) -> bytes:
    """PNG predictors (10 to 15); a last partial row is dropped."""
    if predictor < 10:
        return data
    if predictor > 15 or not (0 < columns < 1 << 20 and 0 < colors <= 32 and bits in (1, 2, 4, 8, 16)):
        raise FilterError("predictor: bad parameters")
    step, width = max(1, colors * bits // 8), (columns * colors * bits + 7) // 8
    above, out = bytearray(width), bytearray()
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(width):
            left, up, corner = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            if kind == 1:
                add = left
            elif kind == 2:
                add = up
            elif kind == 3:
                add = (left + up) // 2
            elif kind == 4:
                p = left + up - corner
                add = min((left, up, corner), key=lambda v: abs(p - v))
            else:
                add = 0
            row[i] = row[i] + add & 255
        out += row
        above = row
    return bytes(out)


NAMES = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}


def decode(data: bytes, filters: list[str], params: list[dict] | None = None) -> bytes:
    """Filters in order. Image formats pass through; fax and JBIG2 are refused; unknown names pass."""
    for i, name in enumerate(filters):
        name, p = NAMES.get(name, name), (params[i] if params and i < len(params) else None) or {}
        if name in ("FlateDecode", "LZWDecode"):
            data = flate(data) if name == "FlateDecode" else lzw(data, int(p.get("EarlyChange", 1)))
            data = unpredicted(data, int(p.get("Predictor", 1)), int(p.get("Columns", 1)), int(p.get("Colors", 1)), int(p.get("BitsPerComponent", 8)))
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "ASCII85Decode":
            data = ascii_85(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        elif name in ("CCITTFaxDecode", "JBIG2Decode"):
            raise FilterError(f"{name} is not supported")
    return data


def png(width: int, height: int, channels: int, rows: bytes) -> bytes:
    """8-bit grey (1 channel) or RGB (3) as a PNG file."""
    line = width * channels
    raw = b"".join(b"\0" + rows[i * line : (i + 1) * line] for i in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
