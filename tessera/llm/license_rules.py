"""The signature rules of the license scan, written over normalised words.

A text is normalised to its words (runs of digits, letters a-z and non-ASCII characters) with one blank
between them, so "Apache-2.0" reads ``apache 2 0`` and "http://gnu.org/licenses" reads ``http gnu org licenses``.

Each line of a table is ``label | kind | required words | expression``.  A rule is tried only on texts
that hold all its required words (``a/b`` is either of the two).  ``{v}`` in a label is the version
that the group ``v`` matched ("4 0" gives "-4.0", no match gives nothing).  ``~`` is a gap of up to six words, ``#`` a version
("2", "2 0", "v2 1").  The order of the kinds is the order of priority.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: kind -> (priority, probability that a text with such a match carries the license)
KINDS = {"tag": (90, 0.99), "text": (80, 0.97), "url": (70, 0.9), "notice": (60, 0.9), "title": (50, 0.75), "name": (40, 0.6), "family": (30, 0.5),
         "rights": (20, 0.5), "base": (10, 0.5), "hint": (5, 0.2)}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    needs: tuple[frozenset[bytes], ...]
    pattern: re.Pattern

    @property
    def priority(self) -> int:
        return KINDS[self.kind][0]

    @property
    def weight(self) -> float:
        return KINDS[self.kind][1]


#: The phrases whose places are always counted and whose labels always stay.
BASE = """
cc-by | base | cc by | cc by
gpl | base | general public license | general public license
reserved | base | all rights reserved | all rights reserved
"""

RULES = """
mit | text | permission hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | text | permission notice copies | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | notice | mit licen/license/licence/licenses | (?:licensed|released|distributed|available|published|provided|covered|governed) (?:under|by|with) (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit | title | mit license/licence | (?:the )?mit licen[sc]e
mit | title | expat license/licence | expat licen[sc]e
mit | title | mit style license/licence | mit style licen[sc]e
mit | url | opensource mit | opensource org licen[sc]es? mit(?: license(?: php)?)?
mit | notice | license mit | license mit(?: license)?
mit-0 | title | mit no attribution | mit no attribution
mit-0 | name | mit 0 license/licensed | mit 0 licen[sc]ed?
x11 | title | x11 license/licence | x11 licen[sc]e
x11 | text | consortium advertising dealings | the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings
json | text | good evil software | the software shall be used for good not evil
jsr-mit-modern | name | mit modern variant | mit license modern variant
isc | text | permission fee granted | permission to use copy modify (?:and )?(?:or )?distribute this software for any purpose with or without fee is hereby granted
isc | title | isc license/licence | isc licen[sc]e
isc | notice | isc licensed/released | (?:licensed|released) under (?:the )?isc
0bsd | title | bsd zero clause/0 | (?:bsd zero clause|zero clause bsd|0 clause bsd|0bsd)(?: licen[sc]e)?
0bsd | name | 0bsd | 0bsd
bsd-2-clause | title | bsd 2/two clause/simplified | (?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: simplified)?(?: licen[sc]e)?
bsd-2-clause | title | simplified bsd | simplified bsd licen[sc]e
bsd-2-clause | title | freebsd license/licence | freebsd licen[sc]e
bsd-3-clause | title | bsd 3/three clause | (?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: new| revised)?(?: licen[sc]e)?
bsd-3-clause | title | bsd new/modified/revised | (?:new|modified|revised) bsd licen[sc]e
bsd-3-clause | text | neither endorse contributors | neither the name of ~(?:the )?[^ ]+ nor the names of (?:its|any|other|their) ~contributors may be used to endorse or promote products
bsd-3-clause | url | opensource bsd 3 | opensource org licen[sc]es? bsd 3 clause
bsd-2-clause | url | opensource bsd 2 | opensource org licen[sc]es? bsd 2 clause
bsd-4-clause | title | bsd 4/four clause | (?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: original| old)?(?: licen[sc]e)?
bsd-4-clause | title | original bsd | original bsd licen[sc]e
bsd-4-clause | text | advertising acknowledgement features | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause-clear | title | clear bsd | clear bsd licen[sc]e
bsd-patent | title | bsd patent | bsd (?:2 clause )?plus patent(?: licen[sc]e)?
bsd-protection | title | bsd protection | bsd protection licen[sc]e
bsd | text | redistribution binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd | text | redistributions binary reproduce | redistributions in binary form must reproduce the above copyright notice
bsd | family | bsd license/licence/licensed | bsd(?: style)? licen[sc]ed?
apache-2.0 | text | apache license compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | text | compliance license file | you may not use this (?:file|work) except in compliance with the license you may obtain a copy of the license
apache-2.0 | notice | apache 2 | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?(?:licen[sc]e )?(?:version |v )?(?:2 0|2|v2)
apache-2.0 | title | apache 2 license/licence | apache (?:software )?licen[sc]e (?:version |v )?(?:2 0|2)
apache-2.0 | title | apache v2 | apache (?:licen[sc]e )?v2(?: 0)?
apache-2.0 | title | apache 2 | apache 2 0(?: licen[sc]e)?
apache-2.0 | name | asl 2 | asl 2 0
apache-2.0 | url | apache licenses 2 | apache org licenses licen[sc]e 2 0(?: txt| html)?
apache-2.0 | url | opensource apache | opensource org licen[sc]es? apache 2 0
apache-1.1 | title | apache 1 license/licence | apache (?:software )?licen[sc]e (?:version |v )?1 1
apache-1.0 | title | apache 1 license/licence | apache (?:software )?licen[sc]e (?:version |v )?1 0
apache | family | apache license/licence/licensed | apache (?:software |public )?licen[sc]ed?
llvm-exception | title | llvm exception/exceptions | (?:apache (?:licen[sc]e )?(?:v2 0|2 0) )?with llvm exceptions?
mpl{v} | notice | mozilla public license | (?:subject to|under) the terms of the mozilla public licen[sc]e(?: version| v)?(?: (?P<v>#))?
mpl{v} | title | mozilla public license | mozilla public licen[sc]e(?: version| v)?(?: (?P<v>#))?
mpl{v} | name | mpl | mpl(?: v)? (?P<v>#)
mpl{v} | url | mozilla mpl | mozilla org mpl(?: (?P<v>#))?
npl{v} | title | netscape public license | netscape public licen[sc]e(?: version| v)?(?: (?P<v>#))?
epl{v} | title | eclipse public license | eclipse public licen[sc]e(?: version| v)?(?: (?P<v>#))?
epl{v} | name | epl | epl(?: v)? (?P<v>#)
epl{v} | url | eclipse legal | eclipse org (?:legal|org documents) epl(?: v(?P<v>#))?
edl{v} | title | eclipse distribution license | eclipse distribution licen[sc]e(?: version| v)?(?: (?P<v>#))?
cpl{v} | title | common public license | common public licen[sc]e(?: version| v)?(?: (?P<v>#))?
ipl{v} | title | ibm public license | ibm public licen[sc]e(?: version| v)?(?: (?P<v>#))?
cddl{v} | title | common development distribution | common development and distribution licen[sc]e(?: cddl)?(?: version| v)?(?: (?P<v>#))?
cddl{v} | name | cddl | cddl(?: (?P<v>#))?
eupl{v} | title | european union public | european union public licen[sc]e(?: version| v)?(?: (?P<v>#))?
eupl{v} | name | eupl | eupl(?: v)?(?: (?P<v>#))?
osl{v} | title | open software license | open software licen[sc]e(?: version| v)? (?P<v>#)
afl{v} | title | academic free license | academic free licen[sc]e(?: version| v)?(?: (?P<v>#))?
artistic{v} | title | artistic license | artistic licen[sc]e(?: version| v)?(?: (?P<v>#))?
artistic | url | perl artistic | perl org licenses artistic
artistic | notice | perl terms | (?:under|on) the same terms as perl(?: itself)?
python-2.0 | title | python license psf/foundation | (?:python software foundation|psf) licen[sc]e
python-2.0 | text | psf making python available | psf is making python available to licensee
cnri | title | cnri license | cnri (?:open source )?licen[sc]e
php{v} | title | php license | php licen[sc]e(?: version| v)?(?: (?P<v>#))?
ruby | title | ruby license | ruby (?:s )?licen[sc]e
zpl{v} | title | zope public license | zope public licen[sc]e(?: version| v)?(?: (?P<v>#))?
w3c | title | w3c software | w3c software (?:notice and )?licen[sc]e
w3c | title | w3c document | w3c document licen[sc]e
openssl | title | openssl license | openssl licen[sc]e
openssl | text | openssl toolkit | this product includes software developed by the openssl project
ssleay | title | ssleay license | ssleay licen[sc]e
zlib | text | provided warranty authors liable | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | title | zlib license/licence | zlib (?:libpng )?licen[sc]e
libpng | title | libpng license/licence | libpng licen[sc]e
bsl-1.0 | title | boost software license | boost software licen[sc]e(?: version| v)?(?: 1 0)?
bsl-1.0 | url | boost license | boost org license 1 0 txt
bsl-1.0 | text | permission granted organization obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy
unlicense | text | free unencumbered software | this is free and unencumbered software released into the public domain
unlicense | name | unlicense | (?:the )?unlicense
unlicense | url | unlicense org | unlicense org
wtfpl | title | fuck public license | do what the fuck you want to public licen[sc]e
wtfpl | name | wtfpl | wtfpl
beerware | title | beerware/beer license | (?:the )?beer ?ware licen[sc]e
beerware | text | buy beer return | you can buy me a beer in return
ms-pl | title | microsoft public license | microsoft public licen[sc]e
ms-pl | name | ms pl license | ms pl licen[sc]e
ms-rl | title | microsoft reciprocal license | microsoft reciprocal licen[sc]e
ms-eula | title | microsoft software terms | microsoft software licen[sc]e terms
ncsa | title | illinois ncsa license | university of illinois ncsa open source licen[sc]e
ncsa | name | ncsa license | ncsa (?:open source )?licen[sc]e
postgresql | title | postgresql license | postgresql licen[sc]e
curl | title | curl license | curl licen[sc]e
vim | title | vim license | vim licen[sc]e
ofl{v} | title | sil open font license | sil open font licen[sc]e(?: version| v)?(?: (?P<v>#))?
ofl{v} | name | ofl | ofl(?: (?P<v>#))?
ofl | url | scripts sil ofl | scripts sil org ofl
ufl{v} | title | ubuntu font licence/license | ubuntu font licen[sc]e(?: version| v)?(?: (?P<v>#))?
ftl | title | freetype license/project | freetype (?:project )?licen[sc]e
ijg | title | jpeg group license | independent jpeg group (?:s )?licen[sc]e
ijg | text | independent jpeg group software | this software is based in part on the work of the independent jpeg group
info-zip | title | zip license info | info zip licen[sc]e
icu | title | icu license | icu licen[sc]e
unicode | title | unicode license | unicode (?:inc )?licen[sc]e(?: agreement)?
unicode | title | unicode terms | unicode terms of use
lppl{v} | title | latex project public | latex project public licen[sc]e(?: version| v)?(?: (?P<v>#))?
lppl{v} | name | lppl | lppl(?: (?P<v>#))?
sleepycat | title | sleepycat license | sleepycat licen[sc]e
qpl{v} | title | q public license | q public licen[sc]e(?: version| v)?(?: (?P<v>#))?
cecill{v} | name | cecill | cecill(?: (?:b|c))?(?: v)?(?: (?P<v>#))?
upl | title | universal permissive license | universal permissive licen[sc]e(?: version| v)?(?: 1 0)?
ecl{v} | title | educational community license | educational community licen[sc]e(?: version| v)?(?: (?P<v>#))?
rpl{v} | title | reciprocal public license | reciprocal public licen[sc]e(?: version| v)?(?: (?P<v>#))?
apsl{v} | title | apple public source | apple public source licen[sc]e(?: version| v)?(?: (?P<v>#))?
sissl | title | sun industry standards | sun industry standards source licen[sc]e
nasa | title | nasa open source | nasa open source agreement(?: 1 3)?
intel | title | intel open source license | intel (?:open source|simplified software) licen[sc]e
mulan{v} | title | mulan license | mulan (?:psl|permissive software licen[sc]e)(?: v)?(?: ?(?P<v>#))?
hpnd | title | historical permission notice | historical permission notice and disclaimer
blueoak | title | blue oak model | blue oak model licen[sc]e(?: 1 0 0)?
opl{v} | title | open publication license | open publication licen[sc]e(?: version| v)?(?: (?P<v>#))?
ogl-uk{v} | title | open government licence/license | open government licen[sc]e(?: version| v)?(?: ?(?P<v>#))?
etalab | title | licence ouverte/etalab | (?:licence ouverte|etalab)(?: open licence)?(?: (?:v )?2 0)?
dl-de | title | datenlizenz deutschland | datenlizenz deutschland(?: namensnennung| zero)?
odbl{v} | title | open database license | open (?:data commons open )?database licen[sc]e(?: version| v)?(?: (?P<v>#))?
odbl{v} | name | odbl | odbl(?: (?P<v>#))?
odc-by{v} | title | open data commons attribution | open data commons attribution licen[sc]e(?: version| v)?(?: (?P<v>#))?
odc-by | name | odc by | odc by(?: 1 0)?
pddl | title | public domain dedication pddl/commons | open data commons public domain dedication(?: and)?(?: licen[sc]e)?
pddl | name | pddl | pddl
cdla-permissive{v} | title | community data license permissive | community data licen[sc]e agreement permissive(?: version| v)?(?: (?P<v>#))?
cdla-sharing{v} | title | community data license sharing | community data licen[sc]e agreement sharing(?: version| v)?(?: (?P<v>#))?
cdla-permissive{v} | name | cdla permissive | cdla permissive(?: (?P<v>#))?
cc0{v} | title | cc0 | cc0(?: (?P<v>#))?(?: universal)?
cc0{v} | title | creative commons zero | creative commons zero(?: v?(?P<v>#))?(?: universal)?
cc0 | url | creativecommons publicdomain zero | creativecommons org publicdomain zero(?: 1 0)?
cc-pdm | url | creativecommons publicdomain mark | creativecommons org publicdomain mark(?: 1 0)?
cc | family | creative commons | creative commons(?: licen[sc]ed?)?
openrail | name | openrail/rail license/licence | (?:creativeml |bigscience |bigcode )?(?:open ?rail)(?: ?m)?(?: licen[sc]e)?
bigscience-rail | title | bigscience rail license | bigscience rail licen[sc]e(?: v?1 0)?
llama-community | title | llama community license | llama (?:[23](?: [0-9])? )?community licen[sc]e(?: agreement)?
gemma | title | gemma terms | gemma (?:terms of use|licen[sc]e)
sspl{v} | title | server side public | server side public licen[sc]e(?: version| v)?(?: ?(?P<v>#))?
sspl{v} | name | sspl | sspl(?: v)?(?: ?(?P<v>#))?
busl{v} | title | business source license | business source licen[sc]e(?: version| v)?(?: (?P<v>#))?
elastic{v} | title | elastic license | elastic licen[sc]e(?: version| v)?(?: ?(?P<v>#))?
confluent | title | confluent community license | confluent community licen[sc]e
timescale | title | timescale license | timescale licen[sc]e
commons-clause | title | commons clause | commons clause(?: licen[sc]e)?(?: condition)?
polyform | title | polyform license | polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) licen[sc]e(?: 1 0 0)?
parity | title | parity public license | parity public licen[sc]e
prosperity | title | prosperity public license | prosperity public licen[sc]e
hippocratic | title | hippocratic license | hippocratic licen[sc]e(?: 2 1| 3 0)?
nvidia-eula | title | nvidia software license | nvidia (?:software )?licen[sc]e(?: agreement)?
oracle-otn | title | oracle technology network | oracle technology network licen[sc]e(?: agreement)?
adobe-eula | title | adobe license agreement | adobe ~software licen[sc]e agreement
classpath-exception | title | classpath exception | (?:gnu )?classpath (?:linking )?exception
gcc-exception | title | gcc runtime exception | gcc runtime library exception
font-exception | title | font exception | font (?:embedding )?exception
linking-exception | title | linking exception | (?:special )?linking exception
public-domain | notice | public domain released/dedicated/placed | (?:released|dedicated|placed|put) (?:in|into|to) the public domain
public-domain | title | public domain | (?:in|is) the public domain
public-domain | title | no known copyright restrictions | no known copyright restrictions
proprietary | text | confidential proprietary information | confidential and proprietary(?: information)?
proprietary | notice | unauthorized copying prohibited | unauthorized (?:copying|reproduction|use|distribution) ~(?:is )?(?:strictly )?prohibited
proprietary | notice | reproduced permission written | (?:may not|must not|cannot) be ~(?:reproduced|copied|distributed|republished) ~without (?:the )?(?:prior |express |explicit )*(?:written )?(?:permission|consent)
proprietary | notice | reproduced form transmitted | no part of this ~may be (?:reproduced|copied|stored|transmitted)
proprietary | title | proprietary license/licence | proprietary (?:software )?licen[sc]e
eula | title | end user agreement | end user licen[sc]e agreement
eula | name | eula | eula
non-commercial | notice | commercial use only/non/noncommercial | for (?:personal(?: and| or)? )?(?:non ?commercial|research|academic|educational)(?: or educational| and research)? (?:use|purposes?) only
non-commercial | notice | commercial use permitted/allowed/prohibited | (?:no commercial use|commercial use is (?:not permitted|not allowed|prohibited|forbidden))
freeware | title | freeware | freeware(?: licen[sc]e)?
shareware | title | shareware | shareware
reserved | rights | rights reserved | (?:all|some|certain|no other) rights (?:are )?(?:expressly )?reserved
reserved | rights | rechte vorbehalten | alle rechte vorbehalten
reserved | rights | droits | tous droits r(?:e|\\xc3\\xa9)serv(?:e|\\xc3\\xa9)s
reserved | rights | derechos reservados | todos los derechos reservados
reserved | rights | direitos reservados | todos os direitos reservados
reserved | rights | diritti riservati | tutti i diritti riservati
copyright | rights | copyright | copyright (?:c |\\xc2\\xa9 )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright | rights | copyright | copyright (?:c |\\xc2\\xa9 )?(?:by|holders?|notice|owners?)
copyright | rights | copr | copr (?:19|20)[0-9][0-9]
no-warranty | hint | warranty express/any | without (?:any )?warrant(?:y|ies) (?:of any kind|express)
no-warranty | hint | warranties conditions | without warranties or conditions of any kind
license-file | hint | license file see | see (?:the )?(?:accompanying )?(?:file )?(?:licen[sc]e|copying)(?: md| txt| file)? (?:file )?(?:for|in)
license-reference | hint | license/licence terms | (?:under|subject to|governed by) the (?:terms|conditions) (?:and conditions )?of (?:the|this|its) licen[sc]e
license-reference | hint | licensed under | licensed under
"""

#: Families that differ only by variant and version are written from their parts.
CC_VARIANTS = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
               "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
GNU = {"gpl": "general public", "lgpl": "(?:lesser|library) general public", "agpl": "affero general public", "gfdl": "free documentation"}


def _families() -> str:
    out = []
    for short, words in CC_VARIANTS.items():
        label, last = "cc-" + short.replace(" ", "-") + "{v}", short.split()[-1]
        out += [f"{label} | title | cc {last} | (?:cc|creative commons) {short}(?: licen[sc]e)?(?: v)?(?: (?P<v>#))?(?: international| unported| generic)?",
                f"{label} | notice | creative commons attribution | creative commons {words}(?: licen[sc]e)?(?: v)?(?: (?P<v>#))?(?: international| unported| generic)?(?: (?:public )?licen[sc]e)?",
                f"{label} | notice | cc {last} licensed/released/under/available | (?:licensed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?cc {short}(?: (?P<v>#))?",
                f"{label} | url | creativecommons licenses {last} | creativecommons org licenses {short}(?: (?P<v>#))?(?: legalcode| deed(?: [a-z]+)?)?"]
    for short, words in GNU.items():
        last = words.split()[-1]
        label = short + "{v}"
        out += [f"{label}-or-later | notice | {last} license/licence version later | (?:gnu )?{words} licen[sc]e (?:as published by the free software foundation )?(?:either )?version (?P<v>#) (?:of the licen[sc]e )?or (?:at your option )?any later version",
                f"{label}-or-later | title | {short} later | {short}(?: v)? ?(?P<v>#) or later",
                f"{label}-only | title | {short} only | {short}(?: v)? ?(?P<v>#) only",
                f"{label} | notice | {last} license/licence licensed/released/terms | (?:licensed|released|distributed|available|published|redistribute ~|modify it) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?{words} licen[sc]e(?: {short})?(?:(?: as published by the free software foundation)?(?: either)? version| v)?(?: (?P<v>#))?",
                f"{label} | title | {last} license/licence | (?:gnu )?{words} licen[sc]e(?: {short})?(?: version| v)?(?: (?P<v>#))?",
                f"{label} | name | {short} | (?:gnu )?{short}(?: version| v)? ?(?P<v>#)",
                f"{label} | name | gnu {short} | gnu {short}",
                f"{label} | url | gnu licenses {short} | gnu org (?:licenses|copyleft) {short}(?: (?P<v>#))?(?: (?:html|txt))?"]
    ids = sorted({line.split("|")[0].strip().split("{")[0] for line in (RULES + "\n".join(out)).splitlines() if line.strip()})
    for name in ids:  # machine-readable tags name a license by its identifier
        words = name.replace("-", " ").replace(".", " ")
        out.append(f"{name}{{v}} | tag | spdx identifier | spdx licen[sc]e identifier {words}(?: (?P<v>#))?(?: only| or later)?")
    return "\n".join(out)


def _compiled(line: str) -> Rule:
    label, kind, needs, expression = (part.strip() for part in line.split(" | ", 3))
    expression = expression.replace("~", "(?:[^ ]+ ){0,6}").replace("#", "v?[0-9]{1,2}(?: [0-9]{1,2})?")
    groups = tuple(frozenset(w.encode() for w in alternatives.split("/")) for alternatives in needs.split())
    return Rule(label, kind, groups, re.compile(b" (?:" + expression.encode() + b")(?= )"))


def rules(table: str | None = None) -> tuple[Rule, ...]:
    """All rules in order: the base phrases, then the table (this module's own unless one is given)."""
    lines = (BASE + (RULES + _families() if table is None else table)).splitlines()
    return tuple(_compiled(line) for line in lines if line.strip())
