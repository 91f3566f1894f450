"""The standard security handler: RC4 and AES, user password."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from .objects import PdfError, Stream, digest

PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def doubled(x: int) -> int:
    return (x << 1 ^ 0x11B) & 255 if x & 128 else x << 1


def boxes() -> tuple[list[int], list[int]]:
    """The substitution of AES and its inverse, from inverses in its field."""
    p = q = 1
    box = [0] * 256
    while True:
        p = p ^ doubled(p)
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 255
        q ^= 0x09 if q & 128 else 0
        r = lambda k: (q << k | q >> 8 - k) & 255
        box[p] = q ^ r(1) ^ r(2) ^ r(3) ^ r(4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


BOX, BACK = boxes()


def times(x: int, k: int) -> int:
    out = 0
    while k:
        out ^= x if k & 1 else 0
        x, k = doubled(x), k >> 1
    return out


MIX = {k: [times(x, k) for x in range(256)] for k in (2, 3, 9, 11, 13, 14)}


def schedule(key: bytes) -> list[bytes]:
    n = len(key) // 4
    words, rc = [list(key[i : i + 4]) for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = [BOX[x] for x in w[1:] + w[:1]]
            w[0] ^= rc
            rc = doubled(rc)
        elif n > 6 and i % n == 4:
            w = [BOX[x] for x in w]
        words.append([a ^ b for a, b in zip(words[i - n], w)])
    return [bytes(sum(words[i : i + 4], [])) for i in range(0, len(words), 4)]


def columns(s: list[int], rows: tuple[int, int, int, int]) -> list[int]:
    out = []
    for c in range(0, 16, 4):
        for r in range(4):
            v = 0
            for k in range(4):
                f = rows[(k - r) % 4]
                v ^= s[c + k] if f == 1 else MIX[f][s[c + k]]
            out.append(v)
    return out


def decrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = [a ^ b for a, b in zip(block, keys[-1])]
    for k in reversed(keys[:-1]):
        s = [BACK[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
        s = [a ^ b for a, b in zip(s, k)]
        if k is not keys[0]:
            s = columns(s, (14, 11, 13, 9))
    return bytes(s)


def encrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = [a ^ b for a, b in zip(block, keys[0])]
    for k in keys[1:]:
        s = [BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        if k is not keys[-1]:
            s = columns(s, (2, 3, 1, 1))
        s = [a ^ b for a, b in zip(s, k)]
    return bytes(s)


def cbc_decrypt(key: bytes, data: bytes, iv: bytes | None = None, padded: bool = True) -> bytes:
    keys = schedule(key)
    iv, data = (data[:16], data[16:]) if iv is None else (iv, data)
    out, before = [], iv
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out.append(bytes(a ^ b for a, b in zip(decrypt_block(keys, block), before)))
        before = block
    whole = b"".join(out)
    return whole[: -whole[-1]] if padded and whole and 1 <= whole[-1] <= 16 else whole


def cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    """Data in whole blocks."""
    keys, out = schedule(key), []
    for i in range(0, len(data), 16):
        iv = encrypt_block(keys, bytes(a ^ b for a, b in zip(data[i : i + 16], iv)))
        out.append(iv)
    return b"".join(out)


@lru_cache(64)
def hardened(password: bytes, salt: bytes, more: bytes = b"") -> bytes:
    """The hash of revision 6."""
    k, i = hashlib.sha256(password + salt + more).digest(), 0
    while True:
        e = cbc_encrypt(k[:16], (password + k + more) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Security:
    def __init__(self, enc: dict, file_id: bytes, password: str):
        v, r = enc.get("V", 0), enc.get("R", 0)
        if enc.get("Filter") != "Standard" or v not in (1, 2, 4, 5) or r == 5:
            raise PdfError("this encryption is not supported")
        self.aes = v >= 4
        if v >= 4:
            cf = (enc.get("CF") or {}).get(enc.get("StmF", "Identity")) or {}
            method = cf.get("CFM", "None")
            self.aes, self.plain = method in ("AESV2", "AESV3"), method == "None"
        else:
            self.plain = False
        self.keep_metadata = enc.get("EncryptMetadata") is False
        self.whole = v == 5
        for word in dict.fromkeys((b"", password.encode("utf-8"))):
            self.key = self.unlocked(enc, file_id, word, v, r)
            if self.key:
                return
        raise PdfError("the file needs another password")

    def unlocked(self, enc: dict, file_id: bytes, word: bytes, v: int, r: int) -> bytes | None:
        u, o = enc["U"], enc["O"]
        if v == 5:
            word = word[:127]
            if hardened(word, u[32:40]) != u[:32]:
                return None
            return cbc_decrypt(hardened(word, u[40:48]), enc["UE"][:32], bytes(16), padded=False)
        n = 5 if v == 1 else min(16, enc.get("Length", 128 if v == 4 else 40) // 8)
        word = word.decode("utf-8").encode("latin-1", "replace")
        seed = digest((word + PAD)[:32], o[:32], (enc["P"] & 0xFFFFFFFF).to_bytes(4, "little"), file_id, b"\xff" * 4 if r >= 4 and self.keep_metadata else b"")
        if r < 3:
            return seed[:n] if rc4(seed[:n], PAD) == u[:32] else None
        for _ in range(50):
            seed = digest(seed[:n])
        key, check = seed[:n], digest(PAD, file_id)
        for i in range(20):
            check = rc4(bytes(b ^ i for b in key), check)
        return key if check == u[:16] else None

    def opened(self, data: bytes, num: int, gen: int) -> bytes:
        if self.plain:
            return data
        if self.whole:
            return cbc_decrypt(self.key, data)
        tail = num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if self.aes else b"")
        key = digest(self.key, tail)[: min(16, len(self.key) + 5)]
        return cbc_decrypt(key, data) if self.aes else rc4(key, data)

    def decrypted(self, x, num: int, gen: int):
        if isinstance(x, bytes):
            return self.opened(x, num, gen)
        if isinstance(x, list):
            return [self.decrypted(v, num, gen) for v in x]
        if isinstance(x, Stream):
            if x.dict.get("Type") == "XRef" or x.dict.get("Type") == "Metadata" and self.keep_metadata:
                return x
            return Stream(self.decrypted(x.dict, num, gen), self.opened(x.raw, num, gen))
        if isinstance(x, dict):
            return {k: self.decrypted(v, num, gen) for k, v in x.items()}
        return x
