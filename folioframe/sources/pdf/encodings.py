"""Character codes to glyph names, and glyph names to text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# What glyph names stand for, where no rule gives it.
PUNCTUATION = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "'", "quoteleft": "`", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "bullet": "•", "endash": "–", "emdash": "—", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "quotereversed": "‛", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "section": "§", "paragraph": "¶", "periodcentered": "·", "exclamdown": "¡", "questiondown": "¿", "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "horizontalbar": "―", "figureminus": "−", "softhyphen": "­",
    "nbspace": " ", "nonbreakingspace": " ", "thinspace": " ", "hairspace": " ", "enspace": " ", "emspace": " ", "figurespace": " ", "zerowidthspace": "​",
}
LETTERS = {
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "lslash": "ł", "Lslash": "Ł", "dotlessi": "ı", "dotlessj": "ȷ", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "Dcroat": "Đ", "dcroat": "đ", "Hbar": "Ħ", "hbarsmall": "ħ", "Tbar": "Ŧ", "tbar": "ŧ", "Eng": "Ŋ", "eng": "ŋ", "Ldot": "Ŀ", "ldot": "ŀ", "IJ": "Ĳ", "ij": "ĳ", "kgreenlandic": "ĸ", "napostrophe": "ŉ", "mu": "µ",
    "ordfeminine": "ª", "ordmasculine": "º", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "onequarter": "¼", "onehalf": "½", "threequarters": "¾",
    "epsilon": "ϵ", "phi": "ϕ", "phi1": "φ", "varepsilon": "ε", "epsilon1": "ε", "vartheta": "ϑ", "theta1": "ϑ", "varpi": "ϖ", "omega1": "ϖ", "varrho": "ϱ", "rho1": "ϱ", "varsigma": "ς", "sigma1": "ς", "varphi": "φ",
}
SIGNS = {
    "copyright": "©", "registered": "®", "trademark": "™", "servicemark": "℠", "numero": "№", "estimated": "℮", "degree": "°", "brokenbar": "¦", "carriagereturn": "↵", "apple": "",
    "cent": "¢", "sterling": "£", "yen": "¥", "currency": "¤", "florin": "ƒ", "Euro": "€", "peseta": "₧", "dong": "₫", "won": "₩", "lira": "₤", "afii57636": "₤", "naira": "₦", "peso": "₱", "rupee": "₹", "sheqel": "₪", "baht": "฿", "colonmonetary": "₡", "afii00208": "—",
    "plusminus": "±", "multiply": "×", "divide": "÷", "fraction": "⁄", "logicalnot": "¬", "infinity": "∞", "lessequal": "≤", "lessorequal": "≤", "greaterequal": "≥", "greaterorequal": "≥", "muchgreater": "≫", "notequal": "≠", "equivalence": "≡", "approxequal": "≈", "congruent": "≅", "similar": "∼", "proportional": "∝", "perthousand": "‰", "lozenge": "◊",
    "partialdiff": "∂", "summation": "∑", "product": "∏", "integral": "∫", "integraltp": "⌠", "integralbt": "⌡", "integralex": "⎮", "radical": "√", "nabla": "∇", "gradient": "∇", "laplacian": "∇", "dotmath": "⋅", "prime": "′", "minute": "′", "second": "″", "dblprime": "″", "angle": "∠", "perpendicular": "⊥", "therefore": "∴", "because": "∵",
    "emptyset": "∅", "element": "∈", "notelement": "∉", "suchthat": "∋", "notsuchthat": "∌", "subset": "⊂", "superset": "⊃", "notsubset": "⊄", "subseteql": "⊆", "superseteql": "⊇", "circleplus": "⊕", "circlemultiply": "⊗", "existential": "∃", "universal": "∀", "aleph": "ℵ", "weierstrass": "℘", "Rfractur": "ℜ", "Ifractur": "ℑ", "hbar": "ℏ", "angbracketleft": "⟨", "angbracketright": "⟩",
    "arrowleft": "←", "arrowup": "↑", "arrowright": "→", "arrowdown": "↓", "arrowboth": "↔", "arrowdblleft": "⇐", "arrowdblup": "⇑", "arrowdblright": "⇒", "arrowdbldown": "⇓", "arrowdblboth": "⇔", "arrowvertex": "│", "arrowhorizex": "─",
    "openbullet": "◦", "triangleup": "▲", "triagup": "▲", "triangledown": "▼", "triagdn": "▼", "triangleleft": "◀", "triaglf": "◀", "triangleright": "▶", "triagrt": "▶", "blacksquare": "■", "filledbox": "■", "H18543": "■", "whitesquare": "□", "openbox": "□", "blackcircle": "●", "H18533": "●", "whitecircle": "○", "H18551": "○", "H17745": "◆", "shade": "░", "ltshade": "░", "dkshade": "▓", "block": "█",
    "star": "★", "blackstar": "★", "whitestar": "☆", "heart": "♥", "diamond": "♦", "club": "♣", "spade": "♠", "musicalnote": "♪", "musicalnotedbl": "♫", "female": "♀", "male": "♂", "checkmark": "✓", "crossmark": "✗", "maltesecross": "✠",
}
#: Accents that may follow a letter's name, as combining characters, and what they are alone.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "commaaccent": "̧", "ogonek": "̨"}
ALONE = {"acute": "´", "circumflex": "^", "tilde": "~", "macron": "¯", "breve": "˘", "dotaccent": "˙", "dieresis": "¨", "ring": "˚", "hungarumlaut": "˝", "caron": "ˇ", "cedilla": "¸", "ogonek": "˛"}
COMBINING = {"gravecomb": "̀", "acutecomb": "́", "tildecomb": "̃", "dieresiscomb": "̈", "hookabovecomb": "̉", "ringcomb": "̊", "dotbelowcomb": "̣", "cedillacomb": "̧"}
#: Sizes and pieces of a sign, and its form with serifs.
VARIANT = re.compile(r"(paren|bracket|brace)(left|right)(?:big|Big|bigg|Bigg|Ex|Mid)|(radical)(?:big|Big|bigg|Bigg|ex)|(summation)display|(copyright|trademark)serif|(register)serif")
NAMED = PUNCTUATION | LETTERS | SIGNS | ALONE | COMBINING

#: The standard encoding beyond ASCII: a first code and the names from there on.
STANDARD = """
161: exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl
177: endash dagger daggerdbl periodcentered
182: paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand
191: questiondown
193: grave acute circumflex tilde macron breve dotaccent dieresis
202: ring cedilla
205: hungarumlaut ogonek caron emdash
225: AE
227: ordfeminine
232: Lslash Oslash OE ordmasculine
241: ae
245: dotlessi
248: lslash oslash oe germandbls
"""
#: What the code pages call otherwise than the glyph names do.
ASCII_NAMES = {c: n for n, c in NAMED.items() if len(c) == 1 and c < "\x7f" and n not in ("nbspace", "nonbreakingspace", "circumflex", "tilde", "quoteright", "quoteleft")}
RENAMED = {"‘": "quoteleft", "’": "quoteright", "ˆ": "circumflex", "˜": "tilde", " ": "space", "­": "hyphen", "∆": "Delta", "Ω": "Omega", "π": "pi"}


@lru_cache(4096)
def glyph_text(name: str) -> str | None:
    """By list, by rule (a letter with an accent, a Greek letter, a variant of a sign, uniXXXX) or None."""
    base = name.split(".")[0]
    if base in NAMED:
        return NAMED[base]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", base):
        return chr(int(m[1] or m[2], 16))
    if (m := re.fullmatch(r"([A-Za-z])(\w+)", base)) and m[2] in ACCENTS:
        return unicodedata.normalize("NFC", m[1] + ACCENTS[m[2]])
    if m := VARIANT.fullmatch(base):
        return NAMED["registered" if m[6] else (m[1] or "") + (m[2] or "") + (m[3] or m[4] or m[5] or "")]
    for prefix in ("GREEK SMALL LETTER ", "GREEK CAPITAL LETTER "):
        if base.islower() == prefix.startswith("GREEK S"):
            try:
                return unicodedata.lookup(prefix + {"lambda": "LAMDA"}.get(base.lower(), base.upper()))
            except KeyError:
                pass
    return None


@lru_cache(4)
def name_of() -> dict[str, str]:
    """The glyph name of a character; the first one listed."""
    out: dict[str, str] = {}
    for n, c in NAMED.items():
        out.setdefault(c, n)
    for base in map(chr, range(0xC0, 0x180)):
        parts = unicodedata.normalize("NFD", base)
        accent = next((n for n, c in ACCENTS.items() if parts[1:] == c), None)
        if accent:
            out.setdefault(base, parts[0] + accent)
    return out


@lru_cache(8)
def codes_of(encoding: str) -> dict[int, str]:
    """Glyph names by code: StandardEncoding, WinAnsiEncoding or MacRomanEncoding."""
    ascii_part = {c: ASCII_NAMES.get(chr(c), chr(c)) for c in range(32, 127)}
    if encoding not in ("WinAnsiEncoding", "MacRomanEncoding"):
        out = ascii_part | {39: "quoteright", 96: "quoteleft"}
        for line in STANDARD.strip().split("\n"):
            first, _, names = line.partition(":")
            out |= {int(first) + i: n for i, n in enumerate(names.split())}
        return out
    out = dict(ascii_part)
    for code in range(128, 256):
        c = bytes([code]).decode("cp1252" if encoding == "WinAnsiEncoding" else "mac_roman", "ignore")
        if c:
            out[code] = RENAMED.get(c) or name_of().get(c) or ("currency" if c == "€" else c)
    if encoding == "MacRomanEncoding":
        out |= {0xDB: "currency", 0xDE: "fi", 0xDF: "fl"}
    return out


@lru_cache(8)
def texts_of(encoding: str) -> dict[int, str]:
    return {code: t for code, name in codes_of(encoding).items() if (t := glyph_text(name)) is not None}
