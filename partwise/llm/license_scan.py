"""Operator 4, license scans: ordered signature rules behind a keyword prefilter, in DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions.text import let
from partwise.llm.shared import table, typed

#: Phrases that count as base places, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

V = r"(?:version |v |ver )?"
NUM = r"(?: [1-4] 0)?(?: (?:international|unported|igo|us|de|fr|es))?"

#: (label, keyword, name, SPDX words); a name before those that it contains or could be taken for.
#: Names are regexes over lower-case words with one space between; the keyword is in every text that the name matches.
LICENSES = [
    ("cc-by-nc-sa", "cc", r"cc (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)" + NUM, r"cc by nc sa [1-4] 0"),
    ("cc-by-nc-sa", "creative commons", r"creative commons (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)" + NUM, r"cc by nc sa [1-4] 0"),
    ("cc-by-nc-nd", "cc", r"cc (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?derivs|no ?derivatives)" + NUM, r"cc by nc nd [1-4] 0"),
    ("cc-by-nc-nd", "creative commons", r"creative commons (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?derivs|no ?derivatives)" + NUM, r"cc by nc nd [1-4] 0"),
    ("cc-by-nc", "cc", r"cc (?:by|attribution) (?:nc|non ?commercial)" + NUM, r"cc by nc [1-4] 0"),
    ("cc-by-nc", "creative commons", r"creative commons (?:by|attribution) (?:nc|non ?commercial)" + NUM, r"cc by nc"),
    ("cc-by-sa", "cc", r"cc (?:by|attribution) (?:sa|share ?alike)" + NUM, r"cc by sa [1-4] 0"),
    ("cc-by-sa", "creative commons", r"creative commons (?:by|attribution) (?:sa|share ?alike)" + NUM, r"cc by sa [1-4] 0"),
    ("cc-by-nd", "cc", r"cc (?:by|attribution) (?:nd|no ?derivs|no ?derivatives)" + NUM, r"cc by nd [1-4] 0"),
    ("cc-by-nd", "creative commons", r"creative commons (?:by|attribution) (?:nd|no ?derivs|no ?derivatives)" + NUM, r"cc by nd [1-4] 0"),
    ("cc-by", "cc by", r"cc by" + NUM, r"cc by [1-4] 0"),
    ("cc-by", "creative commons", r"creative commons (?:by|attribution)" + NUM, r"cc by"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc0", "creative commons", r"creative commons (?:zero|0)(?: 1 0)?(?: universal)?", r"cc0"),
    ("agpl-3", "affero", r"(?:gnu )?affero (?:general public license|gpl) ?" + V + r"3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?v?3(?: 0)?", r"agpl 3 0"),
    ("agpl", "affero", r"(?:gnu )?affero (?:general public license|gpl)", r"agpl 1 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser (?:general public license|gpl) ?" + V + r"2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser (?:general public license|gpl) ?" + V + r"3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl-2", "library", r"(?:gnu )?library (?:general public license|gpl) ?" + V + r"2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2 1", r"lgpl 2 1"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?", r"lgpl 3 0"),
    ("lgpl", "lesser", r"(?:gnu )?lesser (?:general public license|gpl)", r"lgpl"),
    ("gpl-3", "general public license", r"(?:gnu )?general public license ?" + V + r"3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl-2", "general public license", r"(?:gnu )?general public license ?" + V + r"2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-1", "general public license", r"(?:gnu )?general public license ?" + V + r"1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?", r"gpl 3"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?", r"gpl 2"),
    ("gpl", "general public license", r"(?:gnu )?general public license", r"gpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation license(?: " + V + r"1 [1-3])?", r"gfdl 1 [1-3](?: only| or later)?"),
    ("apache-2", "apache", r"apache (?:software )?license ?" + V + r"2(?: 0)?", r"apache 2 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license ?" + V + r"1 1", r"apache 1 1"),
    ("apache-1", "apache", r"apache (?:software )?license ?" + V + r"1(?: 0)?", r"apache 1 0"),
    ("apache", "apache", r"apache (?:software )?license", r"apache"),
    ("mit-0", "mit", r"mit (?:no attribution|0) license", r"mit 0"),
    ("mit", "mit", r"mit (?:style )?license", r"mit"),
    ("mit", "expat", r"expat license", r"expat"),
    ("x11", "x11", r"x11 license", r"x11"),
    ("bsd-0", "bsd", r"(?:0|zero) clause bsd license", r"0bsd"),
    ("bsd-2", "bsd", r"(?:2|two) clause bsd license", r"bsd 2 clause"),
    ("bsd-2", "bsd", r"(?:simplified|free) ?bsd license", r"bsd 2"),
    ("bsd-3", "bsd", r"(?:3|three) clause bsd license", r"bsd 3 clause"),
    ("bsd-3", "bsd", r"(?:new|modified|revised) bsd license", r"bsd 3"),
    ("bsd-4", "bsd", r"(?:4 clause|four clause|original) bsd license", r"bsd 4 clause"),
    ("bsd", "bsd", r"bsd (?:style )?license", r"bsd"),
    ("mpl-2", "mozilla", r"mozilla public license ?" + V + r"2(?: 0)?", r"mpl 2 0"),
    ("mpl-1.1", "mozilla", r"mozilla public license ?" + V + r"1 [01]", r"mpl 1 [01]"),
    ("mpl", "mozilla", r"mozilla public license", r"mpl"),
    ("epl-2", "eclipse", r"eclipse public license ?" + V + r"2(?: 0)?", r"epl 2 0"),
    ("epl-1", "eclipse", r"eclipse public license ?" + V + r"1(?: 0)?", r"epl 1 0"),
    ("epl", "eclipse", r"eclipse public license", r"epl"),
    ("eupl", "european union", r"european union public licen[cs]e(?: " + V + r"1 [0-2])?", r"eupl 1 [0-2]"),
    ("cddl", "common development", r"common development and distribution license(?: " + V + r"1 [01])?", r"cddl 1 [01]"),
    ("cpl-1", "common public", r"common public license(?: " + V + r"1(?: 0)?)?", r"cpl 1 0"),
    ("cecill", "cecill", r"cecill (?:free software )?license(?: agreement)?", r"cecill [12](?: [01])?"),
    ("isc", "isc", r"isc license", r"isc"),
    ("zlib", "zlib", r"zlib (?:libpng )?license", r"zlib"),
    ("libpng", "libpng", r"libpng license", r"libpng"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: license)?", r"wtfpl"),
    ("beerware", "beer", r"beer ?ware license", r"beerware"),
    ("artistic-2", "artistic", r"artistic license ?" + V + r"2(?: 0)?", r"artistic 2 0"),
    ("artistic", "artistic", r"artistic license", r"artistic 1 0"),
    ("boost", "boost", r"boost software license(?: " + V + r"1(?: 0)?)?", r"bsl 1 0"),
    ("busl", "business source", r"business source license(?: " + V + r"1 [01])?", r"busl 1 1"),
    ("sspl", "server side", r"server side public license(?: " + V + r"1)?", r"sspl 1 0"),
    ("elastic-2", "elastic", r"elastic license(?: " + V + r"2(?: 0)?)?", r"elastic 2 0"),
    ("ofl", "open font", r"(?:sil )?open font license(?: " + V + r"1 [01])?", r"ofl 1 [01]"),
    ("postgresql", "postgresql", r"postgresql license", r"postgresql"),
    ("python", "python", r"python (?:software foundation )?license(?: " + V + r"2)?", r"psf 2 0"),
    ("ruby", "ruby", r"ruby license", r"ruby"),
    ("php", "php", r"php license(?: " + V + r"3(?: 0[01]?)?)?", r"php 3 0"),
    ("openssl", "openssl", r"openssl license", r"openssl"),
    ("ms-pl", "microsoft public", r"microsoft public license", r"ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license", r"ms rl"),
    ("osl-3", "open software", r"open software license(?: " + V + r"3(?: 0)?)?", r"osl 3 0"),
    ("afl-3", "academic free", r"academic free license(?: " + V + r"3(?: 0)?)?", r"afl 3 0"),
    ("odbl", "open database", r"open database license", r"odbl 1 0"),
    ("odc-by", "open data commons", r"open data commons attribution license", r"odc by 1 0"),
    ("pddl", "public domain dedication", r"public domain dedication(?: and)? license", r"pddl 1 0"),
    ("upl", "universal permissive", r"universal permissive license", r"upl 1 0"),
    ("ncsa", "ncsa", r"ncsa (?:open source )?license", r"ncsa"),
    ("w3c", "w3c", r"w3c software(?: notice and)? license", r"w3c"),
    ("zpl", "zope", r"zope public license", r"zpl 2 [01]"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software license)", r"mulanpsl 2 0"),
    ("blue-oak", "blue oak", r"blue oak model license", r"blueoak 1 0 0"),
    ("vim", "vim", r"vim license", r"vim"),
]

#: How a name is led up to, and what that says of it.
UNDER = r"(?:dual )?(?:licensed|released|distributed|available|provided|published|offered|redistributed) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
SEE = r"(?:see|read|subject to|covered by|governed by|terms of|copy of|accordance with|compliance with) (?:the )?"

#: (label, keyword, pattern): sentences of the licences themselves.
TEXTS = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "publish distribute", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("x11", "x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("isc", "with or without fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims all warranties", r"the author disclaims all warranties with regard to this software"),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "neither the name", r"neither the name of [a-z0-9 ]{1,80}?nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg"),
    ("apache-2", "except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2", "basis without warranties", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", "grant of patent license", r"grant of patent license subject to the terms and conditions of this license"),
    ("gpl", "this program is free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "version 2 of the license", r"gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "version 3 of the license", r"gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl", "received a copy of the gnu", r"you should have received a copy of the gnu general public license"),
    ("lgpl", "this library is free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "gnu lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl-2.1", "version 2 1 of the license", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("agpl-3", "gnu affero", r"gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl", "remotely through a computer network", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "permission is granted to copy", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", "this source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", "this program and the accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0"),
    ("epl-2", "this program and the accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?2 0"),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compiled binary", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("wtfpl", "do what the", r"do what the fuck you want to public license"),
    ("wtfpl", "verbatim or modified", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("zlib", "express or implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", "machine executable object", r"in the form of machine executable object code generated by a source language processor"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("ofl", "this font software", r"this font software is licensed under the sil open font license"),
    ("ofl", "reserved font name", r"no modified version of the font software may use the reserved font name"),
    ("artistic", "standard version", r"you may distribute (?:verbatim copies of the source form|your modified version as source) of the standard version"),
    ("postgresql", "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", "php software", r"this product includes php software freely available from"),
    ("python", "python software foundation", r"copyright c [0-9 ]+ python software foundation all rights reserved"),
    ("python", "psf hereby grants", r"psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("ruby", "make and give away", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("cc0", "no copyright", r"to the extent possible under law [a-z0-9 ]{1,80}?waived all copyright and related or neighboring rights"),
    ("cc-by", "share and adapt", r"you are free to share and adapt the material for any purpose even commercially"),
    ("cc-by-sa", "same license", r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", "for commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "modified material", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("ncsa", "deal with the software", r"to deal with the software without restriction including without limitation the rights to use"),
    ("upl", "larger works", r"the rights to copy use sublicense and distribute the larger works"),
    ("elastic-2", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl", "service source code", r"you must make the service source code available via network download"),
    ("busl", "change date", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("odbl", "database contents", r"this database is made available under the open database license"),
]

#: (label, pattern): addresses of licence texts, as words; the keyword is the pattern up to its first optional part.
ADDRESSES = [
    ("apache-2", "apache org licenses license 2 0"), ("apache", "apache org licenses"), ("mit", "opensource org licenses mit"), ("bsd-2", "opensource org licenses bsd 2 clause"), ("bsd-3", "opensource org licenses bsd 3 clause"),
    ("isc", "opensource org licenses isc"), ("zlib", "opensource org licenses zlib"), ("epl-1", "eclipse org legal epl v10"), ("epl-2", "eclipse org legal epl 2 0"), ("mpl-2", "mozilla org mpl 2 0"), ("mpl-1.1", "mozilla org mpl mpl 1 1"),
    ("gpl-2", "gnu org licenses old licenses gpl 2 0"), ("gpl-3", "gnu org licenses gpl 3 0"), ("gpl", "gnu org licenses gpl"), ("lgpl-2.1", "gnu org licenses old licenses lgpl 2 1"), ("lgpl-3", "gnu org licenses lgpl 3 0"), ("lgpl", "gnu org licenses lgpl"),
    ("agpl-3", "gnu org licenses agpl 3 0"), ("gfdl", "gnu org licenses fdl"), ("cc-by-nc-sa", "creativecommons org licenses by nc sa"), ("cc-by-nc-nd", "creativecommons org licenses by nc nd"), ("cc-by-nc", "creativecommons org licenses by nc"),
    ("cc-by-sa", "creativecommons org licenses by sa"), ("cc-by-nd", "creativecommons org licenses by nd"), ("cc-by", "creativecommons org licenses by"), ("cc0", "creativecommons org publicdomain zero"), ("unlicense", "unlicense org"), ("wtfpl", "wtfpl net"),
    ("boost", "boost org license 1 0"), ("ofl", "scripts sil org ofl"), ("artistic-2", "opensource org licenses artistic license 2 0"), ("eupl", "joinup ec europa eu software page eupl"), ("cecill", "cecill info licences"), ("cddl", "opensource org licenses cddl"), ("postgresql", "postgresql org about licence"), ("python", "docs python org license"),
]

#: Identifiers of SPDX and the labels of those that have another name here (fixed values of the standard's list).
IDENTIFIERS = """
0BSD AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-1.0 APSL-2.0 Artistic-1.0 Artistic-2.0
Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CAL-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
CDDL-1.0 CDDL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1-only GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later
GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU ImageMagick IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later
Libpng LPL-1.02 LPPL-1.3c MirOS MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NTP ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0
Ruby SGI-B-2.0 Sleepycat SPL-1.0 SSPL-1.0 TCL Unicode-3.0 Unlicense UPL-1.0 Vim W3C Watcom-1.0 WTFPL X11 Xnet Zend-2.0 Zlib ZPL-2.0 ZPL-2.1
""".split()
LABEL_OF = {"0bsd": "bsd-0", "bsl-1": "boost", "psf-2": "python", "python-2": "python", "odc-by-1": "odc-by", "odbl-1": "odbl", "mulanpsl-2": "mulan", "blueoak-1": "blue-oak"}
FAMILIES_OF_ONE = ("cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "cc0", "gfdl", "ofl", "cddl", "cecill", "eupl", "php", "busl", "sspl", "elastic-2", "artistic-2", "artistic", "upl", "zpl", "w3c", "vim", "pddl")


def label_of(identifier: str) -> str:
    """The label of an SPDX identifier: without -only and -or-later, clauses and a last .0; families that have one label, by that."""
    name = identifier.lower().removesuffix("-only").removesuffix("-or-later").removesuffix("-clause").removesuffix(".0").removesuffix(".0")
    for family in FAMILIES_OF_ONE:
        if name.startswith(family):
            return family
    return LABEL_OF.get(name, name)


def as_words(identifier: str) -> str:
    return " ".join(x for x in "".join(c if c.isalnum() else " " for c in identifier.lower()).split())


#: Rules that name no licence.
OTHERS = [("public-domain", "public domain", r"(?:released|placed|dedicated|is|are) (?:in |into |to )?(?:the )?public domain", 0.7), ("proprietary", "rights reserved", r"all rights reserved", 0.5)]
#: Every rule matches only texts with one of these words in them.
GATE = ["licen", "spdx", "cc by", "cc attribution", "cc0", "creative commons", "creativecommons org", "eclipse org", "sil org", "europa eu", "gpl", "wtfpl", "mulan psl", "public domain", "rights reserved", "hereby granted", "copyright", "source and binary", "redistributions", "mozilla", "unlicense", "sublicense",
        "warrant", "misrepresented", "buy me a beer", "good not evil", "font software", "standard version", "openssl", "php software", "the material", "larger works", "without restriction", "managed service", "service source code", "change date", "advertising", "computer network", "published", "invariant sections", "object code", "altered source", "compiled binary", "contributors may be used", "verbatim", "do what the", "cecill"]


SPDX = "spdx license identifier"


def rules() -> list[dict]:
    """All rules in order of priority: sentences, addresses and identifiers, then names, the more special first. also: a second keyword."""
    out = [{"label": label, "keyword": keyword, "also": "", "pattern": pattern, "score": 1.0} for label, keyword, pattern in TEXTS]
    out += [{"label": label, "keyword": words, "also": "", "pattern": words, "score": 0.9} for label, words in ADDRESSES]
    # Every identifier of an expression: the first one, and those behind an operator.
    place = rf"(?:(?<={SPDX} )|(?<={SPDX} [a-z0-9 ]{{1,160}} or )|(?<={SPDX} [a-z0-9 ]{{1,160}} and )|(?<={SPDX} [a-z0-9 ]{{1,160}} with ))"
    out += [{"label": label_of(i), "keyword": SPDX, "also": as_words(i), "pattern": rf"{place}{as_words(i)}(?! [0-9])", "score": 1.0} for i in sorted(IDENTIFIERS, key=lambda i: (-len(i), i))]
    out += [{"label": label, "keyword": keyword, "also": "", "pattern": rf"(?:{UNDER}|{SEE})?{name}", "score": 0.6} for label, keyword, name, _ in LICENSES]
    out += [{"label": label, "keyword": keyword, "also": "", "pattern": pattern, "score": score} for label, keyword, pattern, score in OTHERS]
    return [r | {"priority": i, "pattern": rf"(?<![^ ])(?:{r['pattern']}) "} for i, r in enumerate(out)]


def words_of(text: Column) -> Column:
    """The text's words, each with a space behind it. Lower-casing other letters than A-Z changes no boundary and no match."""
    spaced = F.ltrim(F.concat(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" ")))
    return F.regexp_replace(spaced, "  $", " ")


def n_words(words: Column) -> Column:
    return (F.char_length(words) - F.char_length(F.replace(words, F.lit(" "), F.lit("")))).cast("long")


def license_scan(docs: DataFrame) -> DataFrame:
    """Licences named in the whole text of every row of docs (doc_id, text).

    Base places are those of PHRASES. The method's rules are tried where their
    keywords are in the text; each match is an interval of words. An interval
    that another one contains is suppressed, be it longer or, of equal ones, of
    higher priority; of two that overlap otherwise, that of lower priority.
    Labels of base places always stay. score is that of the best detection (a
    base place: 0.9; a name that is led up to by words of licensing: 0.95, by
    words of reference: 0.85), 0 without any.

    A null text counts as empty: no words, labels '' and null positions.
    Repeated rows give equal results; an empty table gives none.
    """
    kinds = "array<struct<label:string,keyword:string,also:string,pattern:string,score:double,priority:int>>"
    rule_list = F.from_json(F.lit(json.dumps(rules())), kinds)
    docs = typed(docs, doc_id="long", text="string").select("doc_id", words_of(F.col("text")).alias("words"))
    gated = docs.select("doc_id", "words", n_words(F.col("words")).alias("n_words"), F.greatest(*[F.contains("words", F.lit(k)) for k in GATE]).alias("gate"))

    starts = F.split("words", rf"(?<![^ ])(?=(?:{'|'.join(PHRASES)}) )")

    def label_of(piece: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            out = F.when(F.startswith(piece, F.lit(f"{phrase} ")), label).otherwise(out)
        return out

    pieces = F.transform(starts, lambda p: F.struct(n_words(p).alias("n"), label_of(p).alias("label")))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    begin = F.struct(zero.alias("at"), none.alias("first"), none.alias("last"), zero.alias("places"))

    def step(acc: Column, p: Column) -> Column:
        place = p["label"].isNotNull()
        return F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(place & acc["first"].isNull(), acc["at"]).otherwise(acc["first"]).alias("first"),
            F.when(place, acc["at"]).otherwise(acc["last"]).alias("last"),
            (acc["places"] + F.when(place, 1).otherwise(0)).cast("long").alias("places"),
        )

    def intervals(r: Column) -> Column:
        """The matches of a rule as structs of start, end, priority, score and label; words are counted from 0."""
        parts = F.split(F.regexp_replace("words", r["pattern"], F.lit("\x01$0\x02")), "[\x01\x02]")
        nothing = F.array().cast("array<struct<start:bigint,end:bigint,priority:int,score:double,label:string>>")

        def add(acc: Column, part: Column) -> Column:
            end = acc["at"] + n_words(part)
            score = F.when(r["score"] != 0.6, r["score"]).when(part.rlike(f"^{UNDER}"), 0.95).when(part.rlike(f"^{SEE}"), 0.85).otherwise(0.6)
            one = F.struct(acc["at"].alias("start"), end.alias("end"), r["priority"].alias("priority"), score.alias("score"), r["label"].alias("label"))
            return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

        begin = F.struct(zero.alias("at"), F.lit(False).alias("inside"), nothing.alias("found"))
        return F.aggregate(parts, begin, add, lambda acc: acc["found"])

    def stays(found: Column, d: Column) -> Column:
        size = d["end"] - d["start"]

        def beats(o: Column) -> Column:
            contains = (o["start"] <= d["start"]) & (o["end"] >= d["end"])
            longer = (o["end"] - o["start"]) > size
            contained = (o["start"] >= d["start"]) & (o["end"] <= d["end"]) & ~((o["start"] == d["start"]) & (o["end"] == d["end"]))
            overlaps = (o["start"] < d["end"]) & (o["end"] > d["start"])
            return (contains & longer) | (overlaps & ~contained & (o["priority"] < d["priority"]))

        return ~F.exists(found, beats)

    tried = F.filter(rule_list, lambda r: F.contains("words", r["keyword"]) & F.contains("words", r["also"]) & F.rlike("words", r["pattern"]))
    detected = let(F.flatten(F.transform(tried, intervals)), lambda found: F.filter(found, lambda d: stays(found, d)))
    scanned = gated.select(
        "doc_id",
        "n_words",
        F.when(F.col("gate"), F.array_compact(F.array_distinct(F.transform(pieces, lambda p: p["label"])))).alias("base"),
        F.when(F.col("gate"), F.aggregate(pieces, begin, step)).alias("found"),
        F.when(F.col("gate"), detected).alias("method"),
    )
    empty = F.array().cast("array<string>")
    places = F.coalesce("found.places", zero)
    return scanned.select(
        "doc_id",
        "n_words",
        places.alias("n_base"),
        F.col("found.first").alias("first_word"),
        F.col("found.last").alias("last_word"),
        F.array_join(F.array_sort(F.coalesce("base", empty)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base", empty), F.coalesce(F.array_distinct(F.col("method.label")), empty))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.col("method.score")), F.lit(0.0)), F.when(places > 0, 0.9).otherwise(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
