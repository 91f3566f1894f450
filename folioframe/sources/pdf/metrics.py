"""Widths of the fourteen standard fonts, in thousandths of the font size."""

from __future__ import annotations

import re
from functools import lru_cache

from .encodings import ACCENTS, codes_of

# Widths from Adobe's Core 14 font metrics, by code of the font's own encoding (a line gives a first code and
# the widths from there on), and by glyph name for glyphs without a code. Copyright (c) 1985, 1987, 1988, 1989, 1990, 1991,
# 1992, 1993, 1997 Adobe Systems Incorporated. All Rights Reserved. Of the metrics only codes, widths and names are kept.
HELVETICA = """
32: 278 278 355 556 556 889 667 222 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556
56: 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778
80: 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 222 556 556 500 556 556 278 556
104: 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584
161: 333 556 556 167 556 556 556 556 191 333 556 333 333 500 500
177: 556 556 556 278
182: 537 350 222 333 333 556 1000 1000
191: 611
193: 333 333 333 333 333 333 333 333
202: 333 333
205: 333 333 333 1000
225: 1000
227: 370
232: 556 778 1000 365
241: 889
245: 278
248: 222 611 944 611
"""
HELVETICA_BOLD = """
32: 278 333 474 556 556 889 722 278 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556
56: 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778
80: 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 278 556 611 556 611 556 333 611
104: 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584
161: 333 556 556 167 556 556 556 556 238 500 556 333 333 611 611
177: 556 556 556 278
182: 556 350 278 500 500 556 1000 1000
191: 611
193: 333 333 333 333 333 333 333 333
202: 333 333
205: 333 333 333 1000
225: 1000
227: 370
232: 611 778 1000 365
241: 889
245: 278
248: 278 611 944 611
"""
TIMES_ROMAN = """
32: 250 333 408 500 500 833 778 333 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500
56: 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722
80: 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500
104: 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541
161: 333 500 500 167 500 500 500 500 180 444 500 333 333 556 556
177: 500 500 500 250
182: 453 350 333 444 444 500 1000 1000
191: 444
193: 333 333 333 333 333 333 333 333
202: 333 333
205: 333 333 333 1000
225: 889
227: 276
232: 611 722 889 310
241: 667
245: 278
248: 278 500 722 500
"""
TIMES_BOLD = """
32: 250 333 555 500 500 1000 833 333 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500
56: 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778
80: 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500
104: 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520
161: 333 500 500 167 500 500 500 500 278 500 500 333 333 556 556
177: 500 500 500 250
182: 540 350 333 500 500 500 1000 1000
191: 500
193: 333 333 333 333 333 333 333 333
202: 333 333
205: 333 333 333 1000
225: 1000
227: 300
232: 667 778 1000 330
241: 722
245: 278
248: 278 500 722 556
"""
TIMES_ITALIC = """
32: 250 333 420 500 500 833 778 333 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500
56: 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722
80: 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500
104: 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541
161: 389 500 500 167 500 500 500 500 214 556 500 333 333 500 500
177: 500 500 500 250
182: 523 350 333 556 556 500 889 1000
191: 500
193: 333 333 333 333 333 333 333 333
202: 333 333
205: 333 333 333 889
225: 889
227: 276
232: 556 722 944 310
241: 667
245: 278
248: 278 500 667 500
"""
TIMES_BOLDITALIC = """
32: 250 389 555 500 500 833 778 333 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500
56: 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722
80: 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500
104: 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570
161: 389 500 500 167 500 500 500 500 278 500 500 333 333 556 556
177: 500 500 500 250
182: 500 350 333 500 500 500 1000 1000
191: 500
193: 333 333 333 333 333 333 333 333
202: 333 333
205: 333 333 333 1000
225: 944
227: 266
232: 611 722 944 300
241: 722
245: 278
248: 278 500 722 500
"""
SYMBOL = """
32: 250 333 713 500 549 833 778 439 333 333 500 549 250 549 250 278 500 500 500 500 500 500 500 500
56: 500 500 278 278 549 549 549 444 549 722 667 722 612 611 763 603 722 333 631 722 686 889 722 722
80: 768 741 556 592 611 690 439 768 645 795 611 333 863 333 658 500 500 631 549 549 494 439 521 411
104: 603 329 603 549 549 576 521 549 549 521 549 603 439 576 713 686 493 686 494 480 200 480 549
160: 750 620 247 549 167 713 500 753 753 753 753 1042 987 603 987 603 400 549 411 549 549 713 494 460
184: 549 549 549 549 1000 603 1000 658 823 686 795 987 768 768 823 768 768 713 713 713 713 713 713 713
208: 768 713 790 790 890 823 549 250 713 603 603 1042 987 603 987 603 494 329 790 790 786 713 384 384
232: 384 384 384 384 494 494 494 494
241: 329 274 686 686 686 384 384 384 384 384 384 494 494 494
"""
ZAPFDINGBATS = """
32: 278 974 961 974 980 719 789 790 791 690 960 939 549 855 911 933 911 945 974 755 846 762 761 571
56: 677 763 760 759 754 494 552 537 577 692 786 788 788 790 793 794 816 823 789 841 823 833 816 831
80: 923 744 723 749 790 792 695 776 768 792 759 707 708 682 701 826 815 789 789 707 687 696 689 786
104: 787 713 791 785 791 873 761 762 762 759 759 892 892 788 784 438 138 277 415 392 392 668 668
128: 390 390 317 317 276 276 509 509 410 410 234 234 334 334
161: 732 544 544 910 667 760 760 776 595 694 626 788 788 788 788 788 788 788 788 788 788 788 788 788
185: 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788
209: 788 788 788 894 838 1016 458 748 924 748 918 927 928 928 834 873 828 924 924 917 930 931 463 883
233: 836 836 867 867 696 696 874
241: 874 760 946 771 865 771 888 967 888 831 873 927 970 918
"""
#: name, then Helvetica, Helvetica-Bold, Times-Roman, Times-Bold, Times-Italic, Times-BoldItalic. Letters with accents, but for
#: those listed, are as wide as the letter.
UNCODED = """
Dcroat 722 722 722 722 722 722
Delta 612 612 612 612 612 612
Eth 722 722 722 722 722 722
Euro 556 556 500 500 500 500
Lcaron 556 611 611 667 611 611
Thorn 667 667 556 611 611 611
brokenbar 260 280 200 220 275 220
commaaccent 250 250 250 250 250 250
copyright 737 737 760 747 760 747
dcaron 643 743 588 672 544 608
dcroat 556 611 500 556 500 500
degree 400 400 400 400 400 400
divide 584 584 564 570 675 570
eth 556 611 500 500 500 500
greaterequal 549 549 549 549 549 549
iogonek 222 278 278 278 278 278
lcaron 299 400 344 394 300 382
lessequal 549 549 549 549 549 549
logicalnot 584 584 564 570 675 606
lozenge 471 494 471 494 471 494
minus 584 584 564 570 675 606
mu 556 611 500 556 500 576
multiply 584 584 564 570 675 570
notequal 549 549 549 549 549 549
onehalf 834 834 750 750 750 750
onequarter 834 834 750 750 750 750
onesuperior 333 333 300 300 300 300
partialdiff 476 494 476 494 476 494
plusminus 584 584 564 570 675 570
radical 453 549 453 549 453 549
registered 737 737 760 747 760 747
summation 600 600 600 600 600 600
tcaron 317 389 326 416 300 366
thorn 556 611 500 556 500 500
threequarters 834 834 750 750 750 750
threesuperior 333 333 300 300 300 300
trademark 1000 1000 980 1000 980 1000
twosuperior 333 333 300 300 300 300
"""
COURIER = 600

TABLES = {"Helvetica": HELVETICA, "Helvetica-Bold": HELVETICA_BOLD, "Times-Roman": TIMES_ROMAN, "Times-Bold": TIMES_BOLD, "Times-Italic": TIMES_ITALIC, "Times-BoldItalic": TIMES_BOLDITALIC, "Symbol": SYMBOL, "ZapfDingbats": ZAPFDINGBATS}
SAME = {"Helvetica-Oblique": "Helvetica", "Helvetica-BoldOblique": "Helvetica-Bold", "Arial": "Helvetica", "TimesNewRoman": "Times-Roman"}
COURIERS = ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique", "CourierNew")


class Metrics:
    """by_name: widths by glyph name; by_code: by code of the font's own encoding."""

    def __init__(self, by_name: dict[str, float], by_code: dict[int, float]):
        self.by_name, self.by_code = by_name, by_code

    def width(self, name: str | None, code: int) -> float | None:
        if name in self.by_name:
            return self.by_name[name]
        accented = re.fullmatch(r"([A-Za-z])([a-z]+)", name or "")
        if accented and accented[2] in ACCENTS:
            base = "dotlessi" if accented[1] == "i" else accented[1]
            if base in self.by_name:
                return self.by_name[base]
        return self.by_code.get(code)


@lru_cache(32)
def metrics(font: str) -> Metrics | None:
    """Of a font by its name, with or without the prefix of a subset; None if it is none of the fourteen."""
    font = re.sub(r"^.{6}\+", "", font)
    standard = codes_of("StandardEncoding")
    if font in COURIERS:
        return Metrics({n: float(COURIER) for n in standard.values()}, {c: float(COURIER) for c in standard})
    font = SAME.get(font, font)
    if font not in TABLES:
        return None
    by_code = {}
    for line in TABLES[font].strip().split("\n"):
        first, _, widths = line.partition(":")
        by_code |= {int(first) + i: float(w) for i, w in enumerate(widths.split())}
    if font in ("Symbol", "ZapfDingbats"):
        return Metrics({"space": by_code[32]}, by_code)
    column = list(TABLES).index(font)
    by_name = {name: by_code[code] for code, name in standard.items()}
    return Metrics(by_name | {r[0]: float(r[1 + column]) for r in map(str.split, UNCODED.strip().split("\n"))}, by_code)
