"""Signature rules of license texts over lower-case words with single blanks between them.

A line of ``PLAIN`` is ``label; priority; confidence; keyword; pattern``. Priority 3 is a notice or a
sentence of the license's own text, 2 a full name or an identifier, 1 a bare mention. A rule is
tried where its keyword occurs: part of every match of the pattern, with one of ``ANCHORS`` in it. Families add one
rule per license version and wording.
"""

from __future__ import annotations

import re
from typing import NamedTuple

ANCHORS = (
    "licen", "copyright", "copyleft", "spdx", "gpl", "cc by", "cc0", "creative commons", "public domain",
    "redistribut", "warrant", "all rights reserved", "hereby granted", "mit no attribution", "to endorse",
    "advertising materials", "bsd ", "perl itself", "for good not evil", "commons clause", "publicdomain", "gemma ",
    "confidential", "distributed",
)


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


PLAIN = r"""
mit; 3; 0.99; permission is hereby granted; permission is hereby granted free of charge to any person obtaining a copy of this software
mit; 3; 0.98; warrant; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit; 3; 0.97; copyright notice; the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies
mit; 2; 0.95; mit license; (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit license
mit; 2; 0.93; spdx; spdx license identifier mit
mit; 2; 0.9; mit license; the mit license(?: mit)?
mit; 1; 0.8; mit licen; mit licen[sc]ed?
mit; 2; 0.9; opensource org licenses mit; opensource org licenses mit(?: license php)?
mit-0; 2; 0.95; spdx; spdx license identifier mit 0
mit-0; 2; 0.9; mit no attribution; mit no attribution(?: license)?
x11; 2; 0.9; x11 license; (?:the )?x11 license
x11; 2; 0.93; spdx; spdx license identifier x11
expat; 2; 0.9; expat license; (?:the )?expat license
apache-2; 3; 0.99; apache license; licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license
apache-2; 3; 0.96; apache license; licensed under the apache license version 2(?: 0)?
apache-2; 3; 0.95; licenses license 2 0; www apache org licenses license 2 0
apache-2; 3; 0.95; warrant; distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-2; 2; 0.95; spdx; spdx license identifier apache 2 0
apache-2; 2; 0.92; apache license; apache license (?:version )?2(?: 0)?
apache-2; 2; 0.92; apache 2 0 licen; apache 2 0 licen[sc]ed?
apache-2; 1; 0.85; licen; (?:apl|asl|apache)(?: v)? ?2(?: 0)? licen[sc]ed?
apache-1.1; 2; 0.9; licen; apache (?:software )?license (?:version )?1 1
apache-1.1; 2; 0.93; spdx; spdx license identifier apache 1 1
apache-1.0; 2; 0.9; licen; apache (?:software )?license (?:version )?1 0
apache; 1; 0.7; licen; apache (?:software )?licen[sc]ed?
bsd-3-clause; 3; 0.98; may be used to endorse; neither the name of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote products
bsd-2-clause; 3; 0.95; redistribut; redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause; 3; 0.93; redistribut; redistributions of source code must retain the above copyright notice this list of conditions
bsd-2-clause; 3; 0.93; redistribut; redistributions in binary form must reproduce the above copyright notice
bsd-4-clause; 3; 0.97; all advertising materials; all advertising materials mentioning features or use of this software must display
bsd-3-clause; 2; 0.93; licen; (?:3|three) clause bsd licen[sc]e
bsd-3-clause; 2; 0.93; bsd ; bsd (?:3|three) clause(?: licen[sc]e)?
bsd-3-clause; 2; 0.9; licen; (?:new|modified|revised) bsd licen[sc]e
bsd-2-clause; 2; 0.93; licen; (?:2|two) clause bsd licen[sc]e
bsd-2-clause; 2; 0.93; bsd ; bsd (?:2|two) clause(?: licen[sc]e)?
bsd-2-clause; 2; 0.9; licen; (?:simplified|freebsd) (?:bsd )?licen[sc]e
bsd-4-clause; 2; 0.9; licen; (?:original|old) bsd licen[sc]e
bsd-4-clause; 2; 0.93; bsd ; bsd (?:4|four) clause(?: licen[sc]e)?
bsd-0; 2; 0.93; spdx; spdx license identifier 0bsd
bsd-0; 2; 0.9; licen; (?:zero|0) clause bsd licen[sc]e
bsd; 1; 0.75; licen; bsd (?:style )?licen[sc]ed?
isc; 3; 0.98; is hereby granted; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc; 2; 0.9; isc license; (?:the )?isc license
isc; 2; 0.93; spdx; spdx license identifier isc
zlib; 3; 0.97; warrant; this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib; 2; 0.9; licen; (?:the )?zlib(?: libpng)? licen[sc]e
zlib; 2; 0.93; spdx; spdx license identifier zlib
libpng; 2; 0.9; libpng license; (?:the )?libpng license(?: version 2)?
boost-1.0; 2; 0.95; boost software license; boost software license (?:version )?1(?: 0)?
boost-1.0; 2; 0.93; spdx; spdx license identifier bsl 1 0
boost-1.0; 1; 0.85; licen; boost (?:software )?licen[sc]e
unlicense; 3; 0.98; public domain; this is free and unencumbered software released into the public domain
unlicense; 2; 0.93; unlicense; (?:the )?unlicense(?: org)?
public-domain; 2; 0.9; public domain; (?:released|dedicated|placed|put|donated) (?:in|into|to) the public domain
public-domain; 1; 0.7; public domain; public domain
wtfpl; 3; 0.97; public license; do what the fuck you want to public license
wtfpl; 2; 0.93; spdx; spdx license identifier wtfpl
artistic-2.0; 2; 0.95; artistic license; artistic license (?:version )?2(?: 0)?
artistic-1.0; 2; 0.9; artistic license; artistic license (?:version )?1(?: 0)?
artistic; 1; 0.8; artistic license; (?:the )?artistic license
perl; 2; 0.9; perl itself; (?:under )?the same terms as perl itself
ruby; 2; 0.85; ruby license; (?:the )?ruby license
php-3.01; 2; 0.95; php license; php license (?:version )?3 01
php-3.0; 2; 0.9; php license; php license (?:version )?3(?: 0)?
python-2.0; 2; 0.93; python software foundation license; python software foundation license(?: (?:version )?2)?
python-2.0; 2; 0.9; psf licen; psf licen[sc]e
openssl; 2; 0.9; openssl license; (?:the )?openssl license
postgresql; 2; 0.93; postgresql licen; (?:the )?postgresql licen[sc]e
ofl-1.1; 2; 0.95; open font license; (?:sil )?open font license(?: (?:version )?1 1)?
ofl-1.1; 2; 0.93; spdx; spdx license identifier ofl 1 1
vim; 2; 0.85; vim license; (?:the )?vim license
beerware; 2; 0.9; licen; (?:the )?beer ?ware licen[sc]e(?: revision 42)?
json; 3; 0.93; for good not evil; the software shall be used for good not evil
curl; 2; 0.9; curl license; (?:the )?curl license
unicode; 2; 0.9; unicode licen; unicode licen[sc]e(?: v3)?
upl-1.0; 2; 0.93; universal permissive license; universal permissive license(?: (?:v|version )?1 0)?
ncsa; 2; 0.9; licen; (?:university of illinois )?ncsa (?:open source )?licen[sc]e
bsl-1.1; 2; 0.93; business source license; business source license(?: 1 1)?
sspl-1; 2; 0.93; server side public license; server side public license(?: (?:v|version )?1)?
elastic-2.0; 2; 0.93; elastic license; elastic license(?: (?:v|version )?2(?: 0)?)?
commons-clause; 2; 0.93; commons clause; commons clause (?:license )?condition
gfdl-1.3; 2; 0.95; free documentation license; gnu free documentation license (?:version )?1 3
gfdl-1.2; 2; 0.95; free documentation license; gnu free documentation license (?:version )?1 2
gfdl; 1; 0.85; free documentation license; (?:gnu )?free documentation license
odbl-1.0; 2; 0.95; open database license; open database license(?: odbl)?(?: (?:v|version )?1 0)?
odc-by; 2; 0.93; licen; open data commons attribution licen[sc]e
pddl; 2; 0.93; public domain; open data commons public domain dedication(?: and licen[sc]e)?
ogl-uk; 2; 0.93; open government licen; open government licen[sc]e(?: v[123](?: 0)?)?
cc0-1.0; 3; 0.97; cc0; (?:to the extent possible under law .{1,80}? has waived all copyright .{1,60}?)?cc0 1 0(?: universal)?
cc0-1.0; 2; 0.9; cc0; cc0(?: license| licence)?
cc0-1.0; 3; 0.97; publicdomain; creativecommons org publicdomain zero 1 0
cc-pdm; 2; 0.9; public domain; public domain mark(?: 1 0)?
cc; 1; 0.6; creative commons; (?:a )?creative commons(?: licen[sc]e)?
openrail; 2; 0.93; licen; (?:creativeml )?open ?rail(?:\+\+)?(?: m)? licen[sc]e
llama-community; 2; 0.93; community license; llama (?:[23](?: \d)? )?community license(?: agreement)?
gemma; 2; 0.85; gemma ; gemma (?:terms of use|licen[sc]e)
copyright-reserved; 2; 0.8; all rights reserved; (?:copyright (?:c )?(?:\d{4} )?.{0,60}?)?all rights reserved
copyright-notice; 1; 0.4; copyright; copyright (?:c )?\d{4}(?: \d{4})?
proprietary; 2; 0.85; confidential; (?:proprietary and confidential|confidential and proprietary)(?: licen[sc]e)?
proprietary; 2; 0.85; distributed; (?:may not be|no part may be) (?:copied|reproduced) (?:or )?(?:redistributed|distributed)
proprietary; 2; 0.85; license agreement; end user license agreement
commercial; 1; 0.6; commercial licen; commercial licen[sc]e
copyleft; 1; 0.5; copyleft; copyleft(?: licen[sc]e)?
other; 1; 0.3; licen; (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?[^ ]{1,40} licen[sc]e
other; 1; 0.2; spdx; spdx license identifier [^ ]{1,40}"""

#: Identifier, words of the name, versions.
NAMED = (
    ("mpl", "mozilla public license", "1.0 1.1 2.0"),
    ("epl", "eclipse public license", "1.0 2.0"),
    ("cddl", "common development and distribution license", "1.0 1.1"),
    ("cpl", "common public license", "1.0"),
    ("eupl", "european union public licence", "1.0 1.1 1.2"),
    ("osl", "open software license", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free license", "1.1 1.2 2.0 2.1 3.0"),
    ("lppl", "latex project public license", "1.0 1.1 1.2 1.3"),
    ("cecill", "cecill free software license agreement", "1.0 1.1 2.0 2.1"),
    ("ms-pl", "microsoft public license", ""),
    ("ms-rl", "microsoft reciprocal license", ""),
    ("ipl", "ibm public license", "1.0"),
    ("npl", "netscape public license", "1.0 1.1"),
    ("qpl", "q public license", "1.0"),
    ("apsl", "apple public source license", "1.0 1.1 1.2 2.0"),
    ("w3c", "w3c software notice and license", ""),
    ("zpl", "zope public license", "1.1 2.0 2.1"),
    ("sleepycat", "sleepycat license", ""),
    ("mulanpsl", "mulan permissive software license", "1.0 2.0"),
    ("blueoak", "blue oak model license", "1.0.0"),
    ("ecl", "educational community license", "1.0 2.0"),
    ("cpal", "common public attribution license", "1.0"),
    ("rpl", "reciprocal public license", "1.1 1.5"),
    ("efl", "eiffel forum license", "1.0 2.0"),
)
GNU = (
    ("gpl", "general public license", "1 2 3"),
    ("lgpl", "(?:lesser|library) general public license", "2 2.1 3"),
    ("agpl", "affero general public license", "1 3"),
)
CC_PARTS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative|ative work)?s?", "nc": "non ?commercial"}


def _words(text: str) -> str:
    return re.sub(r"[^0-9a-z]+", " ", text).strip()


def _version(version: str) -> str:
    """A pattern for a version number in words; a final zero may be missing."""
    parts = version.split(".")
    return f"{parts[0]}(?: 0)?" if parts[1:] in ([], ["0"]) else " ".join(parts)


def _named() -> list[Rule]:
    rules = []
    for code, name, versions in NAMED:
        spoken = name.replace("license", "licen[sc]e").replace("licence", "licen[sc]e")
        key = "licen"
        for v in versions.split():
            rules.append(Rule(f"{code}-{v}", 2, 0.95, key, rf"{spoken}(?: {_words(code)})?(?: v| version)? ?{_version(v)}"))
            rules.append(Rule(f"{code}-{v}", 2, 0.93, "spdx", f"spdx license identifier {_words(code)} {_words(v)}"))
        rules.append(Rule(code, 1, 0.8, key, spoken))
    return rules


def _gnu() -> list[Rule]:
    rules = []
    for code, name, versions in GNU:
        for v in versions.split():
            n, later = _version(v), r"(?: of the license)?(?: published by the free software foundation)? or (?:\(?at your option\)? )?any later version"
            rules += [
                Rule(f"{code}-{v}-or-later", 3, 0.97, "public license", rf"gnu {name}(?: v| version)? ?{n}{later}"),
                Rule(f"{code}-{v}-or-later", 2, 0.95, "spdx", rf"spdx license identifier {code} {n}(?: or later| only or later)"),
                Rule(f"{code}-{v}-only", 2, 0.95, "spdx", rf"spdx license identifier {code} {n}(?: only)?"),
                Rule(f"{code}-{v}", 2, 0.93, "public license", rf"(?:gnu )?{name}(?: {code})?(?: as published by the free software foundation)?(?: either)?(?: v| version)? ?{n}"),
                Rule(f"{code}-{v}", 2, 0.9, "gpl", rf"{code}(?: v| version)? ?{n}"),
            ]
        rules.append(Rule(code, 1, 0.8, "public license", rf"gnu {name}"))
        rules.append(Rule(code, 1, 0.7, "gpl", rf"{code}(?: licen[sc]ed?)?"))
    return rules


def _creative() -> list[Rule]:
    rules = []
    for part in CC_PARTS:
        short = part.replace("-", " ")
        long = " ".join(CC_WORDS[p] for p in part.split("-"))
        for v in CC_VERSIONS.split():
            n = _words(v)
            rules += [
                Rule(f"cc-{part}-{v}", 2, 0.95, "cc by", rf"(?:licensed under )?cc {short} {n}"),
                Rule(f"cc-{part}-{v}", 2, 0.95, "creative commons", rf"creative commons {long} {n}(?: international| unported| generic)?"),
                Rule(f"cc-{part}-{v}", 3, 0.97, "licen", rf"creativecommons org licenses {short} {n}"),
            ]
        rules.append(Rule(f"cc-{part}", 1, 0.8, "cc by", rf"cc {short}"))
        rules.append(Rule(f"cc-{part}", 1, 0.8, "creative commons", rf"creative commons {long}"))
    return rules


def rules() -> list[Rule]:
    """All rules, in order; equal detections go to the rule that comes first."""
    plain = []
    for line in filter(None, PLAIN.strip().splitlines()):
        label, priority, confidence, keyword, pattern = line.split("; ", 4)
        plain.append(Rule(label, int(priority), float(confidence), keyword, pattern))
    return [*plain, *_named(), *_gnu(), *_creative()]
