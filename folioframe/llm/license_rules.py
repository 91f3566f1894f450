"""Signature rules for licence scans, written over normalised words.

Each line: label | keyword | tier | regex. A text is matched as its lower-case words with one space between them, so
"CC BY-NC 4.0" is "cc by nc 4 0". A rule is tried only where its keyword occurs. Tiers, best first: n notice (a grant),
s short identifier or address, t title, g generic mention. Earlier lines win among equal tiers.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Priority and confidence of each tier.
TIERS = {"n": (0, 1.0), "s": (1, 0.9), "t": (2, 0.7), "g": (3, 0.4)}

TABLE = r"""
mit|mit licen|n|(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit licen[cs]e
mit|mit licen|n|subject to the (?:terms of the )?mit licen[cs]e
mit|permission is hereby granted|n|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|identifier mit|s|spdx licen[cs]e identifier mit
mit|opensource|s|opensource org licen[cs]es? mit
mit|mit licen|t|(?:the )?mit licen[cs]e(?: mit)?
mit|expat|t|expat licen[cs]e
mit|mit style licen|g|mit style licen[cs]e
mit-0|identifier mit 0|s|spdx licen[cs]e identifier mit 0
mit-0|mit no attribution|t|mit no attribution(?: licen[cs]e)?
x11|x11|t|x11 licen[cs]e
apache-2|apache|n|(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?apache licen[cs]e(?: version)? 2(?: 0)?
apache-2|except in compliance|n|you may not use this file except in compliance with the (?:apache )?licen[cs]e
apache-2|apache|s|spdx licen[cs]e identifier apache 2 0
apache-2|apache|s|(?:www )?apache org licen[cs]es licen[cs]e 2 0(?: txt| html)?
apache-2|apache|t|apache (?:software )?licen[cs]e(?: version| v)? 2(?: 0)?
apache-2|apache|t|apache 2 0(?: licen[cs]e)?
apache-2|asl|t|asl 2 0
apache-1.1|apache|t|apache (?:software )?licen[cs]e version 1 1
apache-1.1|apache|s|apache 1 1
apache-1.0|apache|t|apache (?:software )?licen[cs]e version 1 0
apache|apache|n|(?:licensed|released|distributed) under (?:the )?apache licen[cs]e
apache|apache|g|apache (?:style )?licen[cs]e
gpl-3|gnu|n|(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: as published by the free software foundation)? (?:version|v) 3(?: 0)?
gpl-3|gpl|n|(?:licensed|released|distributed) under (?:the )?(?:gnu )?gpl ?(?:version |v)?3(?: 0)?
gpl-3|gpl|s|spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
gpl-3|gpl|s|gpl 3 0(?: only| or later)?
gpl-3|gpl|t|(?:gnu )?gpl ?v?3(?: 0)?
gpl-3|gnu|t|gnu general public licen[cs]e (?:version |v)?3(?: 0)?
gpl-3|gnu|s|gnu org licen[cs]es gpl 3 0(?: html| txt)?
gpl-2|gnu|n|(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: as published by the free software foundation)? (?:version|v) 2(?: 0)?
gpl-2|gpl|n|(?:licensed|released|distributed) under (?:the )?(?:gnu )?gpl ?(?:version |v)?2(?: 0)?
gpl-2|gpl|s|spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
gpl-2|gpl|s|gpl 2 0(?: only| or later)?
gpl-2|gpl|t|(?:gnu )?gpl ?v?2(?: 0)?
gpl-2|gnu|t|gnu general public licen[cs]e (?:version |v)?2(?: 0)?
gpl-2|gnu|s|gnu org licen[cs]es old licen[cs]es gpl 2 0(?: html| txt)?
gpl-1|gpl|s|gpl 1 0(?: only| or later)?
gpl|gnu|n|(?:redistribute it and or modify it|licensed|distributed) under (?:the )?terms of the gnu general public licen[cs]e
gpl|gnu|t|gnu general public licen[cs]e
gpl|gpl|g|(?:gnu )?gpl
lgpl-3|lesser|n|(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu lesser general public licen[cs]e (?:version|v) 3(?: 0)?
lgpl-3|lgpl|s|lgpl 3 0(?: only| or later)?
lgpl-3|lgpl|t|(?:gnu )?lgpl ?v?3(?: 0)?
lgpl-3|lesser|t|gnu lesser general public licen[cs]e (?:version |v)?3(?: 0)?
lgpl-2.1|lesser|n|(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu lesser general public licen[cs]e (?:version|v) 2 1
lgpl-2.1|lgpl|s|lgpl 2 1(?: only| or later)?
lgpl-2.1|lgpl|t|(?:gnu )?lgpl ?v?2 1
lgpl-2.1|lesser|t|gnu lesser general public licen[cs]e (?:version |v)?2 1
lgpl-2|library|t|gnu library general public licen[cs]e(?: (?:version |v)?2(?: 0)?)?
lgpl-2|lgpl|s|lgpl 2 0(?: only| or later)?
lgpl|lesser|t|(?:gnu )?lesser general public licen[cs]e
lgpl|lgpl|g|(?:gnu )?lgpl
agpl-3|affero|n|(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu affero general public licen[cs]e(?: (?:version|v) 3(?: 0)?)?
agpl-3|agpl|s|agpl 3 0(?: only| or later)?
agpl-3|agpl|t|(?:gnu )?agpl ?v?3(?: 0)?
agpl-3|affero|t|gnu affero general public licen[cs]e (?:version |v)?3(?: 0)?
agpl|affero|t|(?:gnu )?affero general public licen[cs]e
agpl|agpl|g|(?:gnu )?agpl
gfdl|free documentation|n|(?:permission is granted to copy distribute and or modify this document )under the terms of the gnu free documentation licen[cs]e
gfdl|free documentation|t|gnu free documentation licen[cs]e(?: version 1 [123])?
gfdl|gfdl|s|gfdl(?: 1 [123])?(?: only| or later)?
bsd-3|bsd|n|(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:3 clause|three clause|new|modified|revised) bsd licen[cs]e
bsd-3|bsd|s|spdx licen[cs]e identifier bsd 3 clause
bsd-3|bsd|s|bsd 3 clause
bsd-3|bsd|t|(?:3 clause|three clause|new|modified|revised) bsd(?: licen[cs]e)?
bsd-3|endorse or promote|n|neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse or promote products
bsd-2|bsd|n|(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:2 clause|two clause|simplified|freebsd) bsd licen[cs]e
bsd-2|bsd|s|bsd 2 clause
bsd-2|bsd|t|(?:2 clause|two clause|simplified) bsd(?: licen[cs]e)?
bsd-2|freebsd|t|freebsd licen[cs]e
bsd-4|bsd|s|bsd 4 clause
bsd-4|bsd|t|(?:4 clause|four clause|original) bsd(?: licen[cs]e)?
bsd-4|all advertising materials|n|all advertising materials mentioning features or use of this software must display
bsd-0|bsd|s|0bsd
bsd-0|zero clause|t|zero clause bsd(?: licen[cs]e)?
bsd|bsd|n|(?:licensed|released|distributed) under (?:the )?(?:a )?bsd(?: style)? licen[cs]e
bsd|redistribution and use|n|redistribution and use in source and binary forms with or without modification are permitted
bsd|bsd|g|bsd(?: style)? licen[cs]e
isc|isc|n|(?:licensed|released|distributed) under (?:the )?isc licen[cs]e
isc|permission to use copy modify|n|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|isc|s|spdx licen[cs]e identifier isc
isc|isc|t|isc licen[cs]e
mpl-2|mozilla|n|(?:subject to|under) the terms of the mozilla public licen[cs]e(?: version| v)? 2 0
mpl-2|mpl|s|spdx licen[cs]e identifier mpl 2 0
mpl-2|mpl|s|mpl 2 0
mpl-2|mozilla|s|mozilla org mpl 2 0
mpl-2|mozilla|t|mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
mpl-1.1|mpl|s|mpl 1 1
mpl-1.1|mozilla|t|mozilla public licen[cs]e(?: version| v)? 1 1
mpl-1.0|mpl|s|mpl 1 0
mpl|mozilla|t|mozilla public licen[cs]e
mpl|mpl|g|mpl licensed
epl-2|eclipse|n|(?:made available|licensed|distributed) under (?:the )?(?:terms of the )?eclipse public licen[cs]e(?: version| v)? 2(?: 0)?
epl-2|epl|s|epl 2 0
epl-2|eclipse|t|eclipse public licen[cs]e(?: version| v)? 2(?: 0)?
epl-1|eclipse|n|(?:made available|licensed|distributed) under (?:the )?(?:terms of the )?eclipse public licen[cs]e(?: version| v)? 1(?: 0)?
epl-1|epl|s|epl 1 0
epl-1|eclipse|t|eclipse public licen[cs]e(?: version| v)? 1(?: 0)?
epl|eclipse|t|eclipse public licen[cs]e
edl-1|eclipse|t|eclipse distribution licen[cs]e(?: version| v)? 1(?: 0)?
cddl-1.1|cddl|s|cddl 1 1
cddl-1.0|cddl|s|cddl 1 0
cddl|common development|n|(?:subject to|under) the terms of the common development and distribution licen[cs]e
cddl|common development|t|common development and distribution licen[cs]e(?: version 1 [01])?
cddl|cddl|g|cddl
cpl-1|common public|t|common public licen[cs]e(?: version| v)?(?: 1 0)?
cpl-1|cpl|s|cpl 1 0
cpal-1|common public attribution|t|common public attribution licen[cs]e(?: version)?(?: 1 0)?
cpal-1|cpal|s|cpal 1 0
ipl-1|ibm public|t|ibm public licen[cs]e(?: version)?(?: 1 0)?
ipl-1|ipl|s|ipl 1 0
eupl-1.2|eupl|s|eupl 1 2
eupl-1.2|european union public|t|european union public licen[cs]e(?: version| v)? 1 2
eupl-1.1|eupl|s|eupl 1 1
eupl|european union public|t|european union public licen[cs]e
osl-3|open software licen|t|open software licen[cs]e(?: version| v)? 3(?: 0)?
osl-3|osl|s|osl 3 0
afl-3|academic free|t|academic free licen[cs]e(?: version| v)? 3(?: 0)?
afl-3|afl|s|afl 3 0
artistic-2|artistic|n|(?:licensed|released|distributed) under (?:the )?(?:terms of the )?artistic licen[cs]e(?: version)? 2(?: 0)?
artistic-2|artistic|t|artistic licen[cs]e(?: version)? 2(?: 0)?
artistic-2|artistic|s|artistic 2 0
artistic-1|artistic|s|artistic 1 0(?: perl| cl8)?
artistic|same terms as perl|n|under the same terms as perl(?: itself)?
artistic|artistic|t|artistic licen[cs]e
bsl-1|boost|n|(?:distributed|licensed) under the boost software licen[cs]e(?: version)? 1 0
bsl-1|boost|t|boost software licen[cs]e(?: version)?(?: 1 0)?
bsl-1|boost|s|boost org licen[cs]e 1 0(?: txt)?
bsl-1|bsl|s|bsl 1 0
busl-1.1|business source|n|(?:licensed|released) under (?:the )?business source licen[cs]e(?: 1 1)?
busl-1.1|business source|t|business source licen[cs]e(?: 1 1)?
busl-1.1|busl|s|busl 1 1
sspl-1|server side public|t|server side public licen[cs]e(?: version| v)?(?: 1)?
sspl-1|sspl|s|sspl 1 0
elastic-2|elastic licen|t|elastic licen[cs]e(?: version)? 2(?: 0)?
elastic-2|elastic|s|elastic 2 0
commons-clause|commons clause|t|commons clause(?: licen[cs]e condition)?
polyform-nc|polyform|t|polyform noncommercial(?: licen[cs]e)?(?: 1 0 0)?
polyform-sb|polyform|t|polyform small business(?: licen[cs]e)?(?: 1 0 0)?
zlib|zlib|n|(?:licensed|released|distributed) under (?:the )?zlib(?: libpng)? licen[cs]e
zlib|altered source versions|n|altered source versions must be plainly marked as such
zlib|zlib|t|zlib(?: libpng)? licen[cs]e
libpng|libpng|t|libpng licen[cs]e(?: version 2)?
unlicense|free and unencumbered|n|this is free and unencumbered software released into the public domain
unlicense|unlicense|s|spdx licen[cs]e identifier unlicense
unlicense|unlicense|s|unlicense org
unlicense|unlicense|t|(?:the )?unlicense
wtfpl|wtfpl|t|wtfpl(?: version 2)?
wtfpl|do what the|t|do what the [^ ]+ you want to public licen[cs]e
beerware|beer|t|beer ?ware(?: licen[cs]e)?
postgresql|postgresql|t|postgresql licen[cs]e
python-2|python|t|python software foundation licen[cs]e(?: version 2)?
python-2|psf|s|psf 2 0
python-2|python|s|python 2 0 licen[cs]e
php-3|php|t|php licen[cs]e(?: version)? 3(?: 01?)?
ruby|ruby|t|ruby licen[cs]e
openssl|openssl|t|openssl licen[cs]e
ncsa|ncsa|t|(?:university of illinois )?ncsa(?: open source)? licen[cs]e
w3c|w3c|t|w3c software(?: notice and)? licen[cs]e
ms-pl|microsoft public|t|microsoft public licen[cs]e
ms-pl|ms pl|s|ms pl
ms-rl|microsoft reciprocal|t|microsoft reciprocal licen[cs]e
ms-rl|ms rl|s|ms rl
ofl-1.1|open font|n|licensed under the sil open font licen[cs]e(?: version)?(?: 1 1)?
ofl-1.1|open font|t|(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?
ofl-1.1|ofl|s|ofl 1 1
upl-1|universal permissive|t|universal permissive licen[cs]e(?: version| v)?(?: 1 0)?
upl-1|upl|s|upl 1 0
mulan-2|mulan|t|mulan (?:psl|permissive software licen[cs]e)(?: v| version)? ?v?2
cecill-2.1|cecill|t|cecill (?:free software licen[cs]e agreement version )?2 1
cecill|cecill|g|cecill(?: [bc])?
qpl-1|q public|t|q public licen[cs]e(?: version 1 0)?
sleepycat|sleepycat|t|sleepycat licen[cs]e
vim|vim licen|t|vim licen[cs]e
json|shall be used for good|n|the software shall be used for good not evil
json|json licen|t|json licen[cs]e
ecl-2|educational community|t|educational community licen[cs]e(?: version| v)? 2(?: 0)?
ncsa|ncsa|g|ncsa
curl|curl licen|t|curl licen[cs]e
icu|icu licen|t|icu licen[cs]e
unicode|unicode|t|unicode(?: data files and software)? licen[cs]e(?: agreement)?(?: v3)?
blueoak|blue oak|t|blue oak model licen[cs]e(?: 1 0 0)?
hippocratic|hippocratic|t|hippocratic licen[cs]e(?: 2 1| 3 0)?
openrail|rail|t|(?:creativeml )?(?:big ?science )?open ?rail(?: [m])?(?: licen[cs]e)?
llama|llama|t|llama (?:2 |3 |3 1 )?community licen[cs]e(?: agreement)?
odbl|open database|n|(?:made available|licensed) under the open database licen[cs]e
odbl|open database|t|open (?:data commons )?open database licen[cs]e
odbl|odbl|s|odbl(?: 1 0)?
odc-by|open data commons attribution|t|open data commons attribution licen[cs]e
odc-by|odc by|s|odc by(?: 1 0)?
pddl|public domain dedication|t|(?:open data commons )?public domain dedication (?:and|&) licen[cs]e
pddl|pddl|s|pddl(?: 1 0)?
cdla-permissive|community data|t|community data licen[cs]e agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing|community data|t|community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?
ogl-uk|open government|t|open government licen[cs]e(?: v| version)? ?v?[123](?: 0)?
ogl-uk|open government|t|open government licen[cs]e
etalab-2|etalab|t|(?:licence ouverte )?(?:open licence )?etalab 2 0
dl-de-by|datenlizenz|t|datenlizenz deutschland namensnennung (?:version )?2 0
cc0|cc0|n|(?:released|dedicated|licensed) (?:under|to|with) (?:the )?(?:public domain under )?(?:creative commons )?cc0(?: 1 0)?
cc0|cc0|s|spdx licen[cs]e identifier cc0 1 0
cc0|cc0|s|cc0(?: 1 0)?(?: universal)?
cc0|creativecommons|s|creativecommons org publicdomain zero 1 0
cc0|creative commons zero|t|creative commons zero(?: licen[cs]e)?
cc-pdm|creativecommons|s|creativecommons org publicdomain mark 1 0
cc-by-nc-nd|cc by nc nd|s|cc by nc nd(?: [1234] [05])?
cc-by-nc-nd|creativecommons|s|creativecommons org licen[cs]es by nc nd [1234] [05]
cc-by-nc-nd|noncommercial noderiv|t|(?:creative commons )?attribution noncommercial noderiv(?:s|atives)(?: [1234] [05])?
cc-by-nc-nd|non commercial no deriv|t|(?:creative commons )?attribution non commercial no deriv(?:s|atives|ative works)(?: [1234] [05])?
cc-by-nc-sa|cc by nc sa|s|cc by nc sa(?: [1234] [05])?
cc-by-nc-sa|creativecommons|s|creativecommons org licen[cs]es by nc sa [1234] [05]
cc-by-nc-sa|noncommercial sharealike|t|(?:creative commons )?attribution noncommercial sharealike(?: [1234] [05])?
cc-by-nc-sa|non commercial share alike|t|(?:creative commons )?attribution non commercial share alike(?: [1234] [05])?
cc-by-nc|cc by nc|n|(?:licensed|released|available) under (?:a )?(?:the )?(?:creative commons )?cc by nc(?: [1234] [05])?
cc-by-nc|cc by nc|s|cc by nc(?: [1234] [05])?
cc-by-nc|creativecommons|s|creativecommons org licen[cs]es by nc [1234] [05]
cc-by-nc|attribution noncommercial|t|(?:creative commons )?attribution noncommercial(?: [1234] [05])?
cc-by-nc|attribution non commercial|t|(?:creative commons )?attribution non commercial(?: [1234] [05])?
cc-by-nd|cc by nd|s|cc by nd(?: [1234] [05])?
cc-by-nd|creativecommons|s|creativecommons org licen[cs]es by nd [1234] [05]
cc-by-nd|attribution noderiv|t|(?:creative commons )?attribution noderiv(?:s|atives)(?: [1234] [05])?
cc-by-sa|cc by sa|n|(?:licensed|released|available) under (?:a )?(?:the )?(?:creative commons )?cc by sa(?: [1234] [05])?
cc-by-sa|cc by sa|s|cc by sa(?: [1234] [05])?
cc-by-sa|creativecommons|s|creativecommons org licen[cs]es by sa [1234] [05]
cc-by-sa|attribution sharealike|t|(?:creative commons )?attribution sharealike(?: [1234] [05])?
cc-by-sa|attribution share alike|t|(?:creative commons )?attribution share alike(?: [1234] [05])?
cc-by|cc by|n|(?:licensed|released|available) under (?:a )?(?:the )?(?:creative commons )?cc by(?: [1234] [05])?
cc-by|cc by|s|cc by(?: [1234] [05])?
cc-by|creativecommons|s|creativecommons org licen[cs]es by [1234] [05]
cc-by|creative commons attribution|t|creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc|creative commons|g|creative commons(?: licen[cs]e)?
public-domain|public domain|n|(?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain|public domain|n|this work is in the public domain
public-domain|public domain|g|public domain
proprietary|all rights reserved|n|(?:copyright|copr) (?:c )?(?:[12][0-9]{3} )?[^ ]+(?: [^ ]+){0,6} all rights reserved
proprietary|all rights reserved|g|all rights reserved
proprietary|proprietary|t|proprietary (?:and confidential|software|licen[cs]e)
proprietary|prior written|n|may not be reproduced (?:in any form )?without (?:the )?(?:express )?prior written (?:permission|consent)
proprietary|internal use only|n|for internal use only
no-license|unlicensed|s|unlicensed
"""


class Rule(NamedTuple):
    rank: int  #: 0 is the best; no two rules share it
    label: str
    keyword: str
    confidence: float
    pattern: str


def rules(table: str = TABLE) -> list[Rule]:
    rows = [x.split("|", 3) for x in table.strip().splitlines()]
    order = sorted(range(len(rows)), key=lambda i: (TIERS[rows[i][2]][0], i))
    return [Rule(k, rows[i][0], spaced(rows[i][1]), TIERS[rows[i][2]][1], f" ({spaced_pattern(rows[i][3])}) ") for k, i in enumerate(order)]


def spaced(words: str) -> str:
    return words.replace(" ", "  ")


def spaced_pattern(regex: str) -> str:
    """From one space between words to two, but for the space in a class such as [^ ] and the optional one in 'gpl ?v'."""
    regex = regex.replace(" ?", "(?:  )?")
    return re.sub(r"\[[^\]]*\]|\(\?:  \)\?| ", lambda m: "  " if m[0] == " " else m[0], regex)


def anchors(of: list[Rule]) -> list[str]:
    """A cheap gate for whole documents: one of these occurs wherever any rule matches."""
    found = {"licen" if "licen" in mandatory(r.pattern) else r.keyword for r in of}
    return sorted(a for a in found if not any(b != a and b in a for b in found))


def mandatory(pattern: str) -> str:
    """A pattern without its optional groups and without alternatives."""
    while (less := re.sub(r"\(\?:[^()]*\)(?:\?|\{0,\d+\})", "", pattern)) != pattern:
        pattern = less
    return re.sub(r"\(\?:[^()]*\)", "", pattern)
