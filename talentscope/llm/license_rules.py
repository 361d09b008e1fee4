"""Signature rules of the license scan.

A rule is written over the word stream of a text (lower case, one space between
words, no punctuation: ``GPL-2.0+`` reads ``gpl 2 0``): literal words, ``(?:...)``
groups that are not nested, ``?`` behind a group and character classes. The literal
words outside of groups are the rule's keywords; a text without all of them is never
searched for it. Levels order the rules: 1 identifies a license with its version, 2
a license, 3 is a mention or an address, 4 a notice that names none.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Base phrases; their labels are never suppressed.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: How sure a detection of each level is, in hundredths; the base phrases' is ``BASE_SURE``.
SURE = {1: 95, 2: 85, 3: 70, 4: 50}
BASE_SURE = 60

# Lines: label, colon, pattern.
LEVEL_1 = """
apache-1.0: apache (?:software )?license (?:version )?1 0
apache-1.0: spdx license identifier apache 1 0
apache-1.1: apache (?:software )?license (?:version )?1 1
apache-1.1: spdx license identifier apache 1 1
apache-2.0: apache (?:software )?license (?:version |v )?2 0
apache-2.0: apache (?:software )?license v2(?: 0)?
apache-2.0: apache (?:public )?licence (?:version )?2(?: 0)?
apache-2.0: spdx license identifier apache 2 0
apache-2.0: apache org licenses license 2 0
apache-2.0: licensed under (?:the )?apache 2(?: 0)?
agpl-1.0: affero general public license (?:version |v )?1(?: 0)?
agpl-3.0: (?:gnu )?affero general public license (?:version |v )?3(?: 0)?
agpl-3.0: spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0: gnu agpl (?:version )?(?:3|v3)
agpl-3.0: licensed under (?:the )?agplv3
artistic-1.0: artistic license (?:version )?1 0
artistic-2.0: artistic license (?:version )?2 0
artistic-2.0: spdx license identifier artistic 2 0
blueoak-1.0.0: blue oak model license (?:version )?1 0 0
bsd-2-clause: (?:simplified|freebsd) bsd license
bsd-2-clause: bsd 2 clause
bsd-2-clause: 2 clause bsd
bsd-2-clause: two clause bsd
bsd-2-clause: spdx license identifier bsd 2 clause
bsd-3-clause: (?:new|modified|revised) bsd license
bsd-3-clause: bsd 3 clause
bsd-3-clause: 3 clause bsd
bsd-3-clause: three clause bsd
bsd-3-clause: spdx license identifier bsd 3 clause
bsd-4-clause: (?:original|old) bsd license
bsd-4-clause: bsd 4 clause
bsd-4-clause: four clause bsd
0bsd: zero clause bsd
0bsd: spdx license identifier 0bsd
bsl-1.0: boost software license (?:version )?1 0
bsl-1.0: spdx license identifier bsl 1 0
busl-1.1: business source license (?:version )?1 1
cc0-1.0: cc0 1 0(?: universal)?
cc0-1.0: spdx license identifier cc0 1 0
cc0-1.0: creative commons zero(?: v1 0| 1 0)?
cc0-1.0: creativecommons org publicdomain zero 1 0
cc-by-1.0: cc by 1 0
cc-by-2.0: cc by 2 0
cc-by-2.5: cc by 2 5
cc-by-3.0: cc by 3 0
cc-by-4.0: cc by 4 0
cc-by-sa-1.0: cc by sa 1 0
cc-by-sa-2.0: cc by sa 2 0
cc-by-sa-2.5: cc by sa 2 5
cc-by-sa-3.0: cc by sa 3 0
cc-by-sa-4.0: cc by sa 4 0
cc-by-nc-1.0: cc by nc 1 0
cc-by-nc-2.0: cc by nc 2 0
cc-by-nc-2.5: cc by nc 2 5
cc-by-nc-3.0: cc by nc 3 0
cc-by-nc-4.0: cc by nc 4 0
cc-by-nd-1.0: cc by nd 1 0
cc-by-nd-2.0: cc by nd 2 0
cc-by-nd-2.5: cc by nd 2 5
cc-by-nd-3.0: cc by nd 3 0
cc-by-nd-4.0: cc by nd 4 0
cc-by-nc-sa-2.0: cc by nc sa 2 0
cc-by-nc-sa-2.5: cc by nc sa 2 5
cc-by-nc-sa-3.0: cc by nc sa 3 0
cc-by-nc-sa-4.0: cc by nc sa 4 0
cc-by-nc-nd-2.0: cc by nc nd 2 0
cc-by-nc-nd-2.5: cc by nc nd 2 5
cc-by-nc-nd-3.0: cc by nc nd 3 0
cc-by-nc-nd-4.0: cc by nc nd 4 0
cc-by-3.0: creative commons attribution 3 0
cc-by-4.0: creative commons attribution 4 0
cc-by-sa-3.0: creative commons attribution share ?alike 3 0
cc-by-sa-4.0: creative commons attribution share ?alike 4 0
cc-by-nc-3.0: creative commons attribution non ?commercial 3 0
cc-by-nc-4.0: creative commons attribution non ?commercial 4 0
cc-by-nd-3.0: creative commons attribution no ?deriv(?:s|atives) 3 0
cc-by-nd-4.0: creative commons attribution no ?deriv(?:s|atives) 4 0
cc-by-nc-sa-3.0: creative commons attribution non ?commercial share ?alike 3 0
cc-by-nc-sa-4.0: creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-nd-3.0: creative commons attribution non ?commercial no ?deriv(?:s|atives) 3 0
cc-by-nc-nd-4.0: creative commons attribution non ?commercial no ?deriv(?:s|atives) 4 0
cc-by-3.0: creativecommons org licenses by 3 0
cc-by-4.0: creativecommons org licenses by 4 0
cc-by-sa-3.0: creativecommons org licenses by sa 3 0
cc-by-sa-4.0: creativecommons org licenses by sa 4 0
cc-by-nc-4.0: creativecommons org licenses by nc 4 0
cc-by-nd-4.0: creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0: creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0: creativecommons org licenses by nc nd 4 0
cddl-1.0: common development and distribution license (?:cddl )?(?:version )?1 0
cddl-1.0: cddl 1 0
cddl-1.1: common development and distribution license (?:cddl )?(?:version )?1 1
cddl-1.1: cddl 1 1
cecill-2.1: cecill (?:free software license agreement |version )?2 1
cpl-1.0: common public license (?:version |v )?1 0
ecl-2.0: educational community license (?:version )?2 0
epl-1.0: eclipse public license (?:version |v |epl )?1 0
epl-1.0: epl 1 0
epl-2.0: eclipse public license (?:version |v |epl )?2 0
epl-2.0: epl 2 0
eupl-1.1: european union public licence (?:version |v )?1 1
eupl-1.2: european union public licence (?:version |v )?1 2
eupl-1.2: eupl 1 2
gfdl-1.2: gnu free documentation license version 1 2(?: or any later version)?
gfdl-1.3: gnu free documentation license version 1 3(?: or any later version)?
gpl-1.0: gpl (?:version |v )?1 0
gpl-2.0: (?:gnu )?general public license (?:gpl )?(?:version |v )?2(?: 0)?
gpl-2.0: (?:gnu )?general public license v2
gpl-2.0: (?:gnu )?general public license as published by the free software foundation (?:either )?version 2
gpl-2.0: gpl (?:version |v )?2 0(?: only| or later)?
gpl-2.0: spdx license identifier gpl 2 0(?: only| or later)?
gpl-2.0: gplv2
gpl-3.0: (?:gnu )?general public license (?:gpl )?(?:version |v )?3(?: 0)?
gpl-3.0: (?:gnu )?general public license v3
gpl-3.0: (?:gnu )?general public license as published by the free software foundation (?:either )?version 3
gpl-3.0: gpl (?:version |v )?3 0(?: only| or later)?
gpl-3.0: spdx license identifier gpl 3 0(?: only| or later)?
gpl-3.0: gplv3
lgpl-2.0: (?:gnu )?library general public license (?:version |v )?2(?: 0)?
lgpl-2.0: lgpl 2 0(?: only| or later)?
lgpl-2.1: (?:gnu )?lesser general public license (?:lgpl )?(?:version |v )?2 1
lgpl-2.1: lgpl 2 1(?: only| or later)?
lgpl-2.1: spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0: (?:gnu )?lesser general public license (?:lgpl )?(?:version |v )?3(?: 0)?
lgpl-3.0: lgpl 3 0(?: only| or later)?
lgpl-3.0: spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0: lgplv3
lppl-1.3c: latex project public license (?:version )?1 3c
mpl-1.0: mozilla public license (?:version |v )?1 0
mpl-1.1: mozilla public license (?:version |v )?1 1
mpl-2.0: mozilla public license (?:version |v )?2 0
mpl-2.0: mozilla org mpl 2 0
mpl-2.0: spdx license identifier mpl 2 0
ms-pl: microsoft public license(?: ms pl)?
ms-rl: microsoft reciprocal license(?: ms rl)?
odbl-1.0: open database license (?:odbl )?(?:version |v )?1 0
odc-by-1.0: open data commons attribution license(?: v1 0| 1 0)?
ofl-1.1: sil open font license (?:version |v )?1 1
ofl-1.1: spdx license identifier ofl 1 1
openrail-m: creativeml open rail m
osl-3.0: open software license (?:version |v )?3 0
php-3.01: php license (?:version )?3 01
psf-2.0: (?:python software foundation|psf) license (?:agreement )?(?:version )?2
qpl-1.0: q public license (?:version )?1 0
sspl-1.0: server side public license (?:version |v )?1
unicode-dfs-2016: unicode license agreement data files and software 2016
zpl-2.1: zope public license (?:version )?2 1
"""

LEVEL_2 = """
apache: apache (?:software )?license
apache: apache (?:software )?licence
agpl: affero general public license
aladdin: aladdin free public license
apsl: apple public source license
artistic: artistic license
beerware: the beer ware license
boost: boost software license
bsd: bsd style license
bsd: bsd license
bsd: berkeley software distribution license
bsd: redistribution and use in source and binary forms with or without modification are permitted
cc0: creative commons zero
cc-by-sa: cc by sa
cc-by-nc: cc by nc
cc-by-nd: cc by nd
cc-by-nc-sa: cc by nc sa
cc-by-nc-nd: cc by nc nd
cc-by: creative commons attribution(?: license| licence)?
cc-by-sa: creative commons attribution share ?alike(?: license| licence)?
cc-by-nc: creative commons attribution non ?commercial(?: license| licence)?
cc-by-nd: creative commons attribution no ?deriv(?:s|atives)(?: license| licence)?
cc-by-nc-sa: creative commons attribution non ?commercial share ?alike(?: license| licence)?
cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: license| licence)?
cddl: common development and distribution license
commons-clause: commons clause license condition
curl: curl license
elastic-2.0: elastic license(?: 2 0| v2)?
epl: eclipse public license
eupl: european union public licence
ftl: freetype project license
gfdl: gnu free documentation license
gpl: gnu gpl
gpl: gnu public license
hpnd: historical permission notice and disclaimer
icu: icu license
ijg: independent jpeg group s (?:software|license)
imagemagick: imagemagick license
ipl: ibm public license
isc: isc license
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
json: json license
json: the software shall be used for good not evil
lgpl: (?:gnu )?lesser general public license
lgpl: (?:gnu )?library general public license
libpng: libpng license
lppl: latex project public license
llama: llama (?:2|3|community) license(?: agreement)?
mit: (?:the )?mit license
mit: (?:the )?mit licence
mit: spdx license identifier mit
mit: expat license
mit: permission is hereby granted free of charge to any person obtaining a copy of this software
mit-0: mit no attribution
mpl: mozilla public license
ncsa: university of illinois ncsa open source license
npl: netscape public license
odbl: open database license
ofl: sil open font license
openssl: openssl license
openssl: this product includes software developed by the openssl project
perl: same terms as perl(?: itself)?
php: php license
postgresql: postgresql license
psf: python software foundation license
public-domain: dedicated to the public domain
public-domain: released into the public domain
public-domain: placed in the public domain
public-domain: public domain dedication
ruby: ruby license
ruby: same terms as ruby
sleepycat: sleepycat license
sspl: server side public license
unicode: unicode license agreement
unlicense: this is free and unencumbered software released into the public domain
unlicense: the unlicense
unlicense: unlicense org
vim: vim license
w3c: w3c software notice and license
w3c: w3c software and document notice and license
wtfpl: do what the fuck you want to public license
wtfpl: wtfpl
x11: x11 license
zlib: zlib(?: libpng)? license
zlib: this software is provided as is without any express or implied warranty
zpl: zope public license
"""

LEVEL_3 = """
apache: apache org licenses
apache: apache licensed
apache-2.0: apache 2 0
agpl: agpl
agpl-3.0: agplv3
bsd: bsd licensed
bsd: opensource org licenses bsd license
cc: creative commons(?: license| licence| licensed)?
cc: creativecommons org licenses
cc0: cc0
cddl: cddl
epl: eclipse org legal epl
eupl: eupl
gfdl: gfdl
gpl: gpl licensed
gpl: gpl
gpl: gnu org licenses(?: gpl)?
gpl: free software foundation inc
lgpl: lgpl
lgpl: gnu org licenses lgpl
mit: mit licensed
mit: opensource org licenses mit(?: license)?
mit: licensed under (?:the )?mit
mpl: mozilla org mpl
ofl: scripts sil org ofl
isc: opensource org licenses isc(?: license)?
spdx: spdx license identifier
spdx: spdx filecopyrighttext
open-source: osi approved
open-source: open source license
open-source: open source licence
free-software: free software license
copyleft: copyleft
public-domain: public domain
dual: dual licensed
"""

LEVEL_4 = """
as-is: provided as is
as-is: without warranty of any kind
as-is: without warranties or conditions of any kind
attribution: attribution required
attribution: the above copyright notice and this permission notice shall be included
commercial: commercial license
commercial: for commercial use contact
confidential: confidential and proprietary
confidential: strictly confidential
copyright: copyright (?:c |by )?(?:19|20)[0-9][0-9]
copyright: copyright (?:c )[a-z]+
copyright: copyrighted material
copyright: copyright holders? (?:and contributors|or contributors)
eula: end user license agreement
eula: software license agreement
liability: in no event shall the (?:authors|copyright holders?|regents|contributors)
licensed: licensed under (?:the )?(?:terms of )?[a-z0-9]+
licensed: released under (?:the )?(?:terms of )?[a-z0-9]+
licensed: distributed under (?:the )?(?:terms of )?[a-z0-9]+
licensed: available under (?:the )?(?:terms of )?[a-z0-9]+ licen[cs]e
licensed: see the license file
licensed: license file for details
no-redistribution: not be (?:copied|reproduced|redistributed|republished)
no-redistribution: unauthorized (?:copying|reproduction|use|distribution)
no-redistribution: reproduction (?:in whole or in part )?(?:is )?prohibited
non-commercial: non commercial use only
non-commercial: for personal use only
non-commercial: for academic use only
non-commercial: for research purposes only
permission: reprinted with permission
permission: used with permission
permission: with the permission of the (?:author|publisher|copyright holder)
proprietary: proprietary software
proprietary: proprietary and confidential
reserved: some rights reserved
reserved: no rights reserved
reserved: rights reserved
terms: subject to (?:the )?terms (?:of use|and conditions)
trademark: registered trademarks? of
trademark: trademarks? are the property of
"""


class Rule(NamedTuple):
    label: str
    level: int                  # 0 for base phrases
    sure: int
    needs: tuple[str, ...]
    pattern: str                # over a stream in which every word has a space on each side


def _rule(label: str, level: int, sure: int, text: str) -> Rule:
    fixed = re.sub(r"\(\?:[^()]*\)\??|[^ ]+ \?[^ ]+", " ", text)
    needs = tuple(w for w in fixed.split() if w.isalnum())
    if not needs:
        raise ValueError(f"a rule needs a literal word: {text}")
    return Rule(label, level, sure, needs, " " + _spaced(text) + " ")


def _spaced(text: str) -> str:
    """The pattern with a space behind and before every word; ``non ?commercial``
    (one word or two) becomes a choice of both."""
    return text.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")


def _rules() -> list[Rule]:
    out = [_rule(label, 0, BASE_SURE, text) for label, text in BASE]
    for level, lines in ((1, LEVEL_1), (2, LEVEL_2), (3, LEVEL_3), (4, LEVEL_4)):
        for line in lines.strip().split("\n"):
            label, text = line.split(": ", 1)
            out.append(_rule(label, level, SURE[level], text))
    return out


#: In order: of detections of one place and level the earlier rule's stays.
RULES = _rules()
