"""Licence statements in texts, by ordered signature rules.

A text becomes its words (lower case, runs of digits, a to z and other letters). A rule is a regular expression over
words. Rules are gated by keywords: one is tried only on texts that hold one of its keywords as a word. Rules are ordered by
kind, from passages of a licence's own text down to mere hints. Detections are intervals of words; one goes if a detection of the
same or a better kind contains it (of equal intervals of one kind, the earlier rule stays). The base phrases are rules
of their own: all their places count and none goes.

A licence has a row of ``LICENSES``; ``rules`` makes its signatures for names, notices, identifiers and addresses. The
Creative Commons and GNU families follow from their parts and versions. ``PASSAGES`` are sentences of licence texts.

Gaps in expressions are bounded, so a text costs time in proportion to its length, and containment is found by one sweep.

Edge cases: a null text is an empty one: no word, no label, score 0; equal rows stay equal rows; null ids stay; an empty
table gives an empty result; ties are settled by the rules' order; columns of any name are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds, best first, and what the surest detection of a text scores.
KINDS = {"passage": 1.0, "notice": 0.95, "identifier": 0.9, "address": 0.9, "name": 0.8, "phrase": 0.6, "hint": 0.4}
#: Fixed by the contract: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label | keywords | names | identifiers | addresses; alternatives by ";", blanks between words.
LICENSES = """
apache-1.0 | apache | apache licen[sc]e(?: version)? 1 0 | apache 1 0 |
apache-1.1 | apache | apache software licen[sc]e(?: version)? 1 1;apache licen[sc]e(?: version)? 1 1 | apache 1 1 | apache org licenses license 1 1
apache-2.0 | apache asl2 | apache(?: software)? licen[sc]e(?: version| v)? 2(?: 0)?;apache licen[sc]e v2(?: 0)? | apache 2 0;asl 2 0 | apache org licenses license 2 0;opensource org licenses apache 2 0
apache | apache | apache(?: software)? licen[sc]e;apache style licen[sc]e | |
mit | mit expat | mit x11 licen[sc]e;mit licen[sc]e;expat licen[sc]e;licen[sc]e mit | mit | opensource org licenses mit;mit license org
mit-0 | mit | mit no attribution(?: licen[sc]e)?;mit zero licen[sc]e | mit 0 | opensource org licenses mit 0
x11 | x11 | x11 licen[sc]e;x consortium licen[sc]e | x11 |
isc | isc | isc licen[sc]e;internet systems consortium licen[sc]e | isc | opensource org licenses isc
bsd-2-clause | bsd freebsd | (?:2|two) clause bsd(?: licen[sc]e)?;bsd (?:2|two) clause(?: licen[sc]e)?;simplified bsd licen[sc]e;freebsd licen[sc]e | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | (?:3|three) clause bsd(?: licen[sc]e)?;bsd (?:3|three) clause(?: licen[sc]e)?;(?:new|modified|revised) bsd licen[sc]e | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4-clause | bsd | (?:4|four) clause bsd(?: licen[sc]e)?;original bsd licen[sc]e | bsd 4 clause |
0bsd | 0bsd bsd | zero clause bsd(?: licen[sc]e)?;free public licen[sc]e 1 0 0 | 0bsd | opensource org licenses 0bsd
bsd | bsd | bsd(?: style)? licen[sc]e;berkeley software distribution licen[sc]e | |
mpl-1.0 | mozilla mpl | mozilla public licen[sc]e(?: version| v)? 1 0 | mpl 1 0 | mozilla org mpl 1 0
mpl-1.1 | mozilla mpl | mozilla public licen[sc]e(?: version| v)? 1 1 | mpl 1 1 | mozilla org mpl 1 1;mozilla org mpl mpl 1 1
mpl-2.0 | mozilla mpl | mozilla public licen[sc]e(?: version| v)? 2(?: 0)? | mpl 2 0 | mozilla org mpl 2 0;mozilla org en us mpl 2 0
mpl | mozilla | mozilla public licen[sc]e | |
epl-1.0 | eclipse epl | eclipse public licen[sc]e(?: version| v)? 1 0 | epl 1 0 | eclipse org legal epl v10
epl-2.0 | eclipse epl | eclipse public licen[sc]e(?: version| v)? 2 0 | epl 2 0 | eclipse org legal epl 2 0;eclipse org legal epl v20
epl | eclipse | eclipse public licen[sc]e | |
edl-1.0 | eclipse | eclipse distribution licen[sc]e | | eclipse org org documents edl v10
cpl-1.0 | common cpl | common public licen[sc]e(?: version| v)? 1 0 | cpl 1 0 | opensource org licenses cpl1 0
ipl-1.0 | ibm ipl | ibm public licen[sc]e | ipl 1 0 | opensource org licenses ipl 1 0
cddl-1.0 | cddl common | common development and distribution licen[sc]e(?: version| v)? 1 0 | cddl 1 0 | opensource org licenses cddl1
cddl-1.1 | cddl common | common development and distribution licen[sc]e(?: version| v)? 1 1 | cddl 1 1 |
cddl | cddl common | common development and distribution licen[sc]e | |
unlicense | unlicense unlicence | the unlicen[sc]e | unlicense | unlicense org
wtfpl | wtfpl fuck | do what the fuck you want to public licen[sc]e;wtfpl licen[sc]e | wtfpl | wtfpl net
zlib | zlib | zlib libpng licen[sc]e;zlib licen[sc]e | zlib | opensource org licenses zlib;zlib net zlib license
libpng | libpng | libpng licen[sc]e | libpng | libpng org pub png src libpng license
bsl-1.0 | boost bsl | boost software licen[sc]e(?:(?: version)? 1 0)? | bsl 1 0 | boost org license 1 0
busl-1.1 | business busl | business source licen[sc]e(?: 1 1)? | busl 1 1 | mariadb com bsl11
sspl-1.0 | sspl server | server side public licen[sc]e | sspl 1 0 | mongodb com licensing server side public license
elastic-2.0 | elastic | elastic licen[sc]e(?: version| v)? 2(?: 0)?;elastic licen[sc]e | elastic 2 0 | elastic co licensing elastic license
artistic-1.0 | artistic | artistic licen[sc]e 1 0 | artistic 1 0 | opensource org licenses artistic license 1 0
artistic-2.0 | artistic | artistic licen[sc]e(?: version)? 2 0 | artistic 2 0 | opensource org licenses artistic license 2 0
artistic | artistic | artistic licen[sc]e | |
python-2.0 | python psf | python software foundation licen[sc]e(?: version 2)?;psf licen[sc]e | psf 2 0;python 2 0 | python org psf license;docs python org 3 license
ruby | ruby | ruby licen[sc]e | ruby | ruby lang org en about license
php-3.01 | php | php licen[sc]e(?: version)?(?: 3 01)? | php 3 01 | php net license 3 01
ofl-1.1 | ofl sil | sil open font licen[sc]e(?:(?: version)? 1 1)?;open font licen[sc]e 1 1 | ofl 1 1 | scripts sil org ofl;openfontlicense org
eupl-1.1 | eupl european | european union public licen[sc]e(?: version| v)? 1 1 | eupl 1 1 |
eupl-1.2 | eupl european | european union public licen[sc]e(?: version| v)? 1 2 | eupl 1 2 | joinup ec europa eu [^ ]+ eupl
eupl | european | european union public licen[sc]e | |
cecill | cecill | cecill(?: free software)? licen[sc]e(?: agreement)? | cecill 2 1;cecill b;cecill c | cecill info licences
osl-3.0 | osl open | open software licen[sc]e(?: version| v)? 3 0 | osl 3 0 | opensource org licenses osl 3 0
afl-3.0 | afl academic | academic free licen[sc]e(?: version| v)? 3 0 | afl 3 0 | opensource org licenses afl 3 0
afl | academic | academic free licen[sc]e | afl 2 1 |
ms-pl | microsoft ms | microsoft public licen[sc]e | ms pl | opensource org licenses ms pl
ms-rl | microsoft ms | microsoft reciprocal licen[sc]e | ms rl | opensource org licenses ms rl
ncsa | ncsa illinois | university of illinois ncsa open source licen[sc]e;ncsa open source licen[sc]e | ncsa | opensource org licenses ncsa
upl-1.0 | upl universal | universal permissive licen[sc]e(?:(?: version| v)? 1 0)? | upl 1 0 | opensource org licenses upl
postgresql | postgresql | postgresql licen[sc]e | postgresql | opensource org licenses postgresql
openssl | openssl | openssl licen[sc]e;openssl and ssleay licenses | openssl | openssl org source license
curl | curl | curl licen[sc]e | curl | curl se docs copyright
ftl | freetype ftl | freetype(?: project)? licen[sc]e | ftl | freetype org license
ijg | jpeg ijg | independent jpeg group licen[sc]e | ijg | ijg org
vim | vim | vim licen[sc]e | vim | vimdoc sourceforge net htmldoc uganda
unicode-dfs | unicode | unicode(?: inc)? licen[sc]e agreement;unicode licen[sc]e v3 | unicode dfs 2016;unicode 3 0 | unicode org copyright;unicode org license
w3c | w3c | w3c(?: software)?(?: notice and)? licen[sc]e;w3c document licen[sc]e | w3c | w3 org consortium legal
zpl-2.1 | zope zpl | zope public licen[sc]e(?:(?: version)? 2 1)? | zpl 2 1 | opensource org licenses zpl
sleepycat | sleepycat | sleepycat licen[sc]e | sleepycat |
lppl-1.3c | latex lppl | latex project public licen[sc]e(?:(?: version)? 1 3c?)? | lppl 1 3c;lppl 1 3a | latex project org lppl
json | json | json licen[sc]e | json | json org license
beerware | beerware beer | beer ?ware licen[sc]e | beerware |
naist-2003 | naist nara | nara institute of science and technology licen[sc]e | naist 2003 |
icu | icu | icu licen[sc]e | icu |
imagemagick | imagemagick | imagemagick licen[sc]e | imagemagick | imagemagick org script license
mulanpsl-2.0 | mulan mulanpsl2 | mulan permissive software licen[sc]e(?: version| v)? ?2 | mulanpsl 2 0 | license coscl org cn mulanpsl2
bluoak-1.0.0 | blue | blue oak model licen[sc]e | blueoak 1 0 0 | blueoakcouncil org license 1 0 0
cal-1.0 | cryptographic | cryptographic autonomy licen[sc]e | cal 1 0 |
parity | parity | parity public licen[sc]e | parity 7 0 0 | paritylicense com
polyform-noncommercial | polyform | polyform noncommercial licen[sc]e(?: 1 0 0)? | polyform noncommercial 1 0 0 | polyformproject org licenses noncommercial
polyform-small-business | polyform | polyform small business licen[sc]e(?: 1 0 0)? | polyform small business 1 0 0 | polyformproject org licenses small business
commons-clause | commons | commons clause(?: licen[sc]e condition)? | | commonsclause com
odbl-1.0 | odbl open | open database licen[sc]e(?: v?1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1.0 | odc open | open data commons attribution licen[sc]e(?: v?1 0)? | odc by 1 0 | opendatacommons org licenses by
pddl-1.0 | pddl open public | open data commons public domain dedication and licen[sc]e;public domain dedication and licen[sc]e | pddl 1 0 | opendatacommons org licenses pddl
ogl-uk | ogl open | open government licen[sc]e(?: v?[123](?: 0)?)? | ogl uk 3 0;ogl uk 2 0;ogl uk 1 0 | nationalarchives gov uk doc open government licen[sc]e
dl-de-by-2.0 | datenlizenz dl | datenlizenz deutschland namensnennung(?: version)? 2 0 | dl de by 2 0 | govdata de dl de by 2 0
etalab-2.0 | etalab licence | licence ouverte(?: open licence)?;etalab open licence | etalab 2 0 | etalab gouv fr licence ouverte
cdla-permissive | cdla community | community data licen[sc]e agreement permissive | cdla permissive 1 0;cdla permissive 2 0 | cdla dev permissive
cdla-sharing | cdla community | community data licen[sc]e agreement sharing | cdla sharing 1 0 | cdla dev sharing
openrail-m | openrail rail | openrail m? ?licen[sc]e;responsible ai licen[sc]e;open rail m licen[sc]e | openrail | licenses ai
bigscience-rail | bigscience | bigscience rail licen[sc]e | bigscience bloom rail 1 0 |
fair-source | fair | fair source licen[sc]e | fsl 1 1 mit | fair io
functional-source | functional | functional source licen[sc]e | fsl 1 1 apache 2 0 | fsl software
gfdl-1.1 | gfdl documentation | gnu free documentation licen[sc]e(?: version| v)? 1 1 | gfdl 1 1 |
gfdl-1.2 | gfdl documentation | gnu free documentation licen[sc]e(?: version| v)? 1 2 | gfdl 1 2 | gnu org licenses old licenses fdl 1 2
gfdl-1.3 | gfdl documentation | gnu free documentation licen[sc]e(?: version| v)? 1 3 | gfdl 1 3 | gnu org licenses fdl 1 3;gnu org copyleft fdl
gfdl | gfdl documentation | gnu free documentation licen[sc]e | |
gpl-classpath | classpath | classpath exception | classpath exception 2 0 |
gpl-linking | linking | linking exception | gcc exception 3 1 |
proprietary | proprietary confidential | proprietary and confidential(?: information)?;proprietary licen[sc]e;commercial licen[sc]e agreement | licenseref proprietary |
eula | eula user | end user licen[sc]e agreement | licenseref eula |
public-domain | domain | (?:dedicated to|in|into|released into) the public domain;public domain dedication;public domain mark | licenseref public domain | creativecommons org publicdomain mark 1 0
cc0-1.0 | cc0 zero creativecommons | cc0(?: 1 0)?(?: universal)?;creative commons zero(?: v?1 0)?(?: universal)?;cc zero | cc0 1 0 | creativecommons org publicdomain zero 1 0
"""

#: Label | keyword | words of the licence's own text.
PASSAGES = """
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | software | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | endorse | neither the name of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledg
warranty-disclaimer | warranties | is provided by(?: [^ ]+){1,10} as is and any express or implied warranties
warranty-disclaimer | warranty | the software is provided as is without warranty of any kind express or implied
warranty-disclaimer | warranty | without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
apache-2.0 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
gpl-2.0-or-later | redistribute | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
gpl-3.0-or-later | redistribute | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
lgpl-2.1-or-later | redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version
lgpl-3.0-or-later | redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
agpl-3.0-or-later | affero | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
gpl | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | eclipse | made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse | made available under the terms of the eclipse public license(?: v)? 2 0
cddl-1.0 | cddl | the contents of this file are subject to the terms of the common development and distribution license
bsl-1.0 | boost | distributed under the boost software license version 1 0
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | you just do what the fuck you want to
artistic-2.0 | artistic | the intent is that the copyright holder maintains some artistic control over the development of that package
ofl-1.1 | font | this font software is licensed under the sil open font license version 1 1
cc0-1.0 | waived | has waived all copyright and related or neighboring rights to
cc-by-4.0 | attribution | this work is licensed under(?: the)?(?: a)? creative commons attribution 4 0 international licen[sc]e
cc-by-sa-4.0 | sharealike | this work is licensed under(?: the)?(?: a)? creative commons attribution sharealike 4 0 international licen[sc]e
cc-by-nc-4.0 | noncommercial | this work is licensed under(?: the)?(?: a)? creative commons attribution noncommercial 4 0 international licen[sc]e
gfdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
json | evil | the software shall be used for good not evil
commons-clause | commons | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
elastic-2.0 | hosted | you may not provide the software to third parties as a hosted or managed service
ms-pl | microsoft | this license governs use of the accompanying software if you use the software you accept this license
proprietary | reproduced | no part of this (?:publication|book|document|work) may be reproduced(?: [^ ]+){0,3} (?:stored|distributed|or transmitted)
proprietary | unauthorized | unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|document|material)
proprietary | confidential | this (?:file|software|document) is proprietary and confidential
"""

#: Label | keyword | words that hint at a licence.
HINTS = """
copyright-notice | copyright | copyright(?: c)? (?:19|20)[0-9]{2}
copyright-notice | copyrighted | copyrighted (?:material|work|by)
license-notice | license licence | (?:see|read) the licen[sc]e(?: file)?(?: for)?
license-notice | license licence | subject to the (?:following|terms of this|license) (?:license|licence|terms|conditions)
license-notice | licensed | (?:dual|jointly|multi) licensed
license-notice | spdx | spdx license identifier
rights-granted | permission | (?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission
rights-granted | royalty | royalty free licen[sc]e
public-domain | domain | public domain
reserved | rechte | alle rechte vorbehalten
reserved | droits | tous droits réservés
reserved | derechos | todos los derechos reservados
"""

CC_PARTS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0", "")
GNU = {"gpl": ("general", ("1.0", "2.0", "3.0", "")), "lgpl": ("(?:lesser|library)(?: general)?", ("2.0", "2.1", "3.0", "")), "agpl": ("affero(?: general)?", ("1.0", "3.0", ""))}
NOTICE = "(?:licen[sc]ed|released|distributed|published|provided|covered|(?:made )?available|shared)(?: [^ ]+){0,2}? under(?: the)?(?: terms of)?(?: the)?(?: an?)? "


class Rule(NamedTuple):
    order: int
    kind: str
    label: str
    keywords: tuple[str, ...]
    pattern: str  # of words between blanks


def _families() -> Iterator[tuple[str, str, list[str], list[str], list[str]]]:
    """Label, keywords, names, identifiers, addresses of the families that follow from their parts."""
    for kind in CC_KINDS:
        parts = kind.split("-")
        short, full = " ".join(parts), " ".join(CC_PARTS[p] for p in parts)
        for v in CC_VERSIONS:
            words = v.replace(".", " ")
            tail = f" {words}" if v else ""
            label = f"cc-{kind}{'-' + v if v else '-any'}"
            yield label, "cc creative creativecommons", [f"creative commons {full}(?: licen[sc]e)?{tail}", f"(?:creative commons|cc) {short}{tail}"], [f"cc {short}{tail}"] if v else [], [f"creativecommons org licenses {short}{tail}"]
    for short, (full, versions) in GNU.items():
        for v in versions:
            number = v.removesuffix(".0").replace(".", " ") + ("(?: 0)?" if v.endswith(".0") else "")
            name = rf"(?:gnu )?{full} public licen[sc]e" if full != "general" else "gnu general public licen[sc]e"
            if not v:
                yield f"{short}-any", f"gnu affero {short}", [name, f"gnu {short}(?: licen[sc]e)?"], [], [f"gnu org licenses {short}", f"gnu org copyleft {short}"]
                continue
            at = f"(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?{number}"
            base = [f"{name}{at}", f"gnu {short} v?{number}", f"{short} ?v{number}"]
            yield f"{short}-{v}-or-later", f"gnu affero {short} {short}v{v[0]}", [f"{x}(?: of the licen[sc]e)? or(?: at your option)?(?: any)? later(?: version)?" for x in base], [f"{short} {v.replace('.', ' ')} or later"], []
            yield f"{short}-{v}", f"gnu affero {short} {short}v{v[0]}", base, [f"{short} {v.replace('.', ' ')}(?: only)?"], [f"gnu org licenses (?:old licenses )?{short} {number}", f"opensource org licenses {short} {number}"]


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, best kind first; within a kind in the order in which they are written."""
    found: list[tuple[str, str, tuple[str, ...], str]] = []
    for line in PASSAGES.strip().split("\n"):
        label, keys, words = (x.strip() for x in line.split(" | "))
        found.append(("passage", label, tuple(keys.split()), words))
    listed = [[x.strip() for x in line.split(" |")] for line in LICENSES.strip().split("\n")]
    several = [(label, keys, *([y.strip() for y in x.split(";") if y.strip()] for x in rest)) for label, keys, *rest in listed]
    for label, keys, names, ids, urls in [*_families(), *several]:
        keywords = tuple(keys.split())
        for x in names:
            found += [("notice", label, keywords, NOTICE + x), ("name", label, keywords, x)]
        for x in ids:
            found += [("notice", label, keywords, f"{NOTICE}{x}(?: licen[sc]e)?"), ("identifier", label, ("spdx",), f"spdx licen[sc]e identifier {x}"), ("identifier", label, keywords, f"licen[sc]e(?: is| id| type)? {x}")]
        for x in urls:
            found.append(("address", label, ("org", "com", "net", "co", "io", "ai", "dev", "eu", "info", "se", "de", "fr", "uk", "cn", "software"), x))
    for line in HINTS.strip().split("\n"):
        label, keys, words = (x.strip() for x in line.split(" | "))
        found.append(("hint", label, tuple(keys.split()), words))
    for phrase, label in BASE.items():
        found.append(("phrase", label, (phrase.split()[0],), phrase))
    found.sort(key=lambda x: list(KINDS).index(x[0]))
    return tuple(Rule(i, *x) for i, x in enumerate(found))


def expression(rule: Rule) -> str:
    """Over words that each stand between two blanks of their own."""
    words = rule.pattern.replace("[^ ]", "\0").replace(" ?", "(?: )?").replace(" ", "  ").replace("\0", "[^ ]")
    return f" {words} "


#: Bytes of no word become blanks.
_BLANKS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LEVEL = {k: i for i, k in enumerate(KINDS)}
_PHRASE = _LEVEL["phrase"]


class Scanner:
    """The rules, compiled, by keyword."""

    def __init__(self) -> None:
        self.rules = rules()
        self.compiled = [re.compile(expression(r).encode()) for r in self.rules]
        self.by_word: dict[bytes, list[int]] = {}
        for r in self.rules:
            for k in r.keywords:
                self.by_word.setdefault(k.encode(), []).append(r.order)
        self.keywords = frozenset(self.by_word)
        self.level = np.array([_LEVEL[r.kind] for r in self.rules])

    def found(self, text: str) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words, and (first word, end, rule) of every match, whatever contains it."""
        words = text.encode().lower().translate(_BLANKS).split()
        if self.keywords.isdisjoint(words):
            return len(words), []
        tried = sorted({o for w in self.keywords.intersection(words) for o in self.by_word[w]})
        joined = b" " + b"  ".join(words) + b" "
        blanks = None
        out = []
        for o in tried:
            spans = [m.span() for m in self.compiled[o].finditer(joined)]
            if spans:
                blanks = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32) if blanks is None else blanks
                at = np.searchsorted(blanks, np.array(spans)) // 2
                out += [(s, e, o) for s, e in at.tolist()]
        return len(words), out

    def kept(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Without what a detection of the same or a better kind contains; by first word."""
        if not found:
            return []
        s, e, o = np.array(found, dtype=np.int64).T
        level = self.level[o]
        order = np.lexsort((o, level, -e, s))
        s, e, o, level = s[order], e[order], o[order], level[order]
        keep = level == _PHRASE
        for k in np.unique(level):
            reach = np.maximum.accumulate(np.where((level <= k) & (level != _PHRASE), e, -1))
            before = np.concatenate([[-1], reach[:-1]])
            keep |= (level == k) & (level != _PHRASE) & (before < e)
        return list(zip(s[keep].tolist(), e[keep].tolist(), o[keep].tolist(), strict=True))


_FOUND = "struct<n_words: bigint, found: array<struct<rule: int, kind: string, label: string, start: int, end: int>>>"
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("found", pa.list_(pa.struct([("rule", pa.int32()), ("kind", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        out = []
        for t in batch["text"]:
            n, found = scanner.found(t.as_py() or "")
            rows = [(scanner.rules[o], s, e) for s, e, o in scanner.kept(found)]
            out.append({"n_words": n, "found": [{"rule": r.order, "kind": r.kind, "label": r.label, "start": s, "end": e} for r, s, e in rows]})
        yield pa.record_batch([batch["row"], pa.array(out, _FOUND_ARROW)], names=["row", "licenses"])


def detect(docs: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` with ``out``: the number of words and the detections that stay, by first word."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    rows = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    got = rows.mapInArrow(_scan, f"row {rows.schema['row'].dataType.simpleString()}, licenses {_FOUND}")
    return got.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c != out), F.col("licenses").alias(out))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found, spans of every row."""
    got = detect(docs.select("doc_id", "text")).select("doc_id", "licenses")
    all_ = F.col("licenses.found")
    base = F.filter(all_, lambda x: x["kind"] == "phrase")
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    label = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    weight = F.lit(0.0)
    for kind, w in KINDS.items():
        weight = F.when(F.exists(all_, lambda x: x["kind"] == kind), F.greatest(weight, F.lit(w))).otherwise(weight)  # noqa: B023
    span = F.array_join(F.transform(all_, lambda x: F.concat_ws(":", x["label"], x["start"], x["end"])), ",")
    return got.select(
        "doc_id", F.col("licenses.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label(base).alias("base_labels"), label(all_).alias("labels"), weight.alias("score"), F.size(all_).cast("long").alias("n_found"), span.alias("spans"),
    )


def oracle() -> str:
    """DuckDB SQL for :func:`report`: every rule on every text that holds a keyword, containment by comparison."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n".join(f"({r.order}, {_LEVEL[r.kind]}, '{r.kind}', {quoted(r.label)}, {quoted(k)}, {quoted(expression(r))}, {KINDS[r.kind]}::DOUBLE)" for r in rules() for k in r.keywords)
    blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    return f"""
WITH k(ord, level, kind, label, word, expr, weight) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
t AS (SELECT doc_id, rid, len(words) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS t, words FROM d),
w AS (SELECT DISTINCT rid, unnest(words) AS word FROM t),
g AS (SELECT DISTINCT rid, ord, level, kind, label, expr, weight FROM w JOIN k USING (word)),
m AS (SELECT rid, ord, level, kind, label, weight, regexp_extract_all(t, expr) AS ms, string_split_regex(t, expr) AS gs FROM g JOIN t USING (rid)),
u AS (SELECT rid, ord, level, kind, label, weight, unnest(range(1, len(ms) + 1)) AS i, ms, gs FROM m WHERE len(ms) > 0),
p AS (SELECT rid, ord, level, kind, label, weight, {blanks("ms[i]")} AS n, sum({blanks("gs[i]")} + {blanks("ms[i]")}) OVER (PARTITION BY rid, ord ORDER BY i) AS upto FROM u),
f AS (SELECT rid, ord, level, kind, label, weight, CAST((upto - n) // 2 AS BIGINT) AS s, CAST(upto // 2 AS BIGINT) AS e FROM p),
z AS (SELECT * FROM f WHERE kind = 'phrase' OR NOT EXISTS (SELECT 1 FROM f o WHERE o.rid = f.rid AND o.kind <> 'phrase' AND o.s <= f.s AND o.e >= f.e
  AND (o.level < f.level OR (o.level = f.level AND (o.e - o.s > f.e - f.s OR (o.e - o.s = f.e - f.s AND o.ord < f.ord)))))),
a AS (SELECT rid, count(*) FILTER (WHERE kind = 'phrase') AS n_base, min(s) FILTER (WHERE kind = 'phrase') AS first_word, max(s) FILTER (WHERE kind = 'phrase') AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE kind = 'phrase'))), ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels,
  max(weight) AS score, count(*) AS n_found, string_agg(label || ':' || s || ':' || e, ',' ORDER BY s, e DESC, level, ord) AS spans FROM z GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_found, 0) AS n_found, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (rid)
"""
