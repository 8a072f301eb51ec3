"""The ordered licence signatures.

A family is a label with hand-written patterns over a text's words (lower
case, one space between words; see ``licenses``). Each pattern stands with a
keyword that every match contains from the start of a word; a pattern runs
only on texts that hold its keyword. A smaller tier has priority.
"""

from __future__ import annotations

#: label; keyword and pattern of its full name; its SPDX identifier in words; its page's address in words
FAMILIES = (
    ("agpl-3.0", "affero", r"(?:gnu )?affero (?:general public )?licen[cs]e (?:as published by the free software foundation )?(?:version |v)?3(?: 0)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl(?: 3 0)?"),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e (?:version |v)?1(?: 0)?", r"agpl 1 0(?: only| or later)?", r"affero org oagpl"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)2(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v)1(?: 0)?", r"gpl 1 0(?: only| or later)?", r"gnu org licenses old licenses gpl 1 0"),
    ("lgpl-3.0", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)2 1", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-2.0", "library general public", r"(?:gnu )?library general public licen[cs]e(?: (?:version |v)2(?: 0)?)?", r"lgpl 2 0(?: only| or later)?", r"gnu org licenses old licenses lgpl 2 0"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: (?:version |v)1 [123])?", r"gfdl 1 [123](?: only| or later)?", r"gnu org licenses fdl(?: 1 [123])?"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?", r"apache 2 0", r"apache org licenses license 2 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?1 1", r"apache 1 1", r"apache org licenses license 1 1"),
    ("apache-1.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?1 0", r"apache 1 0", r"apache org licenses license 1 0"),
    ("mit", "mit licen", r"(?:the )?mit licen[cs]e", r"mit", r"opensource org licenses? mit"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?", r"mit 0", r"opensource org licenses? mit 0"),
    ("x11", "x11", r"x11 licen[cs]e", r"x11", r"xfree86 org 3 3 6 copyright2"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", r"bsd 4 clause", r"directory fsf org wiki license bsd 4clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|revised|modified) bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", r"bsd 3 clause", r"opensource org licenses? bsd 3 clause"),
    ("bsd-2-clause", "bsd", r"(?:(?:simplified|free) bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?", r"bsd 2 clause", r"opensource org licenses? bsd 2 clause"),
    ("0bsd", "bsd", r"(?:bsd zero clause|zero clause bsd)(?: licen[cs]e)?", r"0bsd", r"opensource org licenses? 0bsd"),
    ("isc", "isc", r"isc licen[cs]e", r"isc", r"opensource org licenses? isc"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v)?2(?: 0)?", r"mpl 2 0", r"mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v)?1 1", r"mpl 1 1", r"mozilla org mpl mpl 1 1"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e (?:version |v)?1 0", r"mpl 1 0", r"mozilla org mpl mpl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?2(?: 0)?", r"epl 2 0", r"eclipse org legal epl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?1(?: 0)?", r"epl 1 0", r"eclipse org legal epl v10"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: (?:version |v)?1(?: 0)?)?", r"bsd 3 clause eclipse", r"eclipse org org documents edl v10"),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e (?:version |v)?1 1", r"cddl 1 1", r"glassfish java net public cddl gpl 1 1"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: (?:version |v)?1 0)?", r"cddl 1 0", r"opensource org licenses? cddl(?:1| 1 0)"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: (?:version |v)?1 0)?", r"cpl 1 0", r"opensource org licenses? cpl1"),
    ("ipl-1.0", "ibm public", r"ibm public licen[cs]e(?: (?:version |v)?1 0)?", r"ipl 1 0", r"opensource org licenses? ipl 1 0"),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e (?:version |v)?1 2", r"eupl 1 2", r"eupl eu 1 2"),
    ("eupl-1.1", "european union public", r"european union public licen[cs]e (?:version |v)?1 1", r"eupl 1 1", r"eupl eu 1 1"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:version |v)?2(?: 0)?", r"artistic 2 0", r"opensource org licenses? artistic(?: license)? 2 0"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e (?:version |v)?1(?: 0)?", r"artistic 1 0(?: perl| cl8)?", r"opensource org licenses? artistic(?: license)? 1 0"),
    ("boost-1.0", "boost", r"boost software licen[cs]e(?: (?:version |v)?1 0)?", r"bsl 1 0", r"boost org license 1 0"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?: (?:version |v)?1 1)?", r"busl 1 1", r"mariadb com bsl11"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib", r"zlib net zlib license"),
    ("libpng", "libpng", r"libpng licen[cs]e(?: version 2)?", r"libpng(?: 2 0)?", r"libpng org pub png src libpng license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", "want to public", r"do what the f[a-z]* you want to public licen[cs]e", r"wtfpl", r"wtfpl net"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0 (?:1 0(?: universal)?|public domain dedication)", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "public domain mark", r"(?:creative commons )?public domain mark(?: 1 0)?", r"cc pdm 1 0", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", r"cc by nc nd (?:v ?)?4 0", r"cc by nc nd 4 0", r"creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nc-nd-3.0", "cc by nc nd", r"cc by nc nd (?:v ?)?3 0", r"cc by nc nd 3 0", r"creativecommons org licenses by nc nd 3 0"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd", r"cc by nc nd [12] [05]", r"creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", r"cc by nc sa (?:v ?)?4 0", r"cc by nc sa 4 0", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-sa-3.0", "cc by nc sa", r"cc by nc sa (?:v ?)?3 0", r"cc by nc sa 3 0", r"creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa", r"cc by nc sa [12] [05]", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-4.0", "cc by nc", r"cc by nc (?:v ?)?4 0", r"cc by nc 4 0", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-3.0", "cc by nc", r"cc by nc (?:v ?)?3 0", r"cc by nc 3 0", r"creativecommons org licenses by nc 3 0"),
    ("cc-by-nc", "cc by nc", r"cc by nc", r"cc by nc [12] [05]", r"creativecommons org licenses by nc"),
    ("cc-by-nd-4.0", "cc by nd", r"cc by nd (?:v ?)?4 0", r"cc by nd 4 0", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nd-3.0", "cc by nd", r"cc by nd (?:v ?)?3 0", r"cc by nd 3 0", r"creativecommons org licenses by nd 3 0"),
    ("cc-by-nd", "cc by nd", r"cc by nd", r"cc by nd [12] [05]", r"creativecommons org licenses by nd"),
    ("cc-by-sa-4.0", "cc by sa", r"cc by sa (?:v ?)?4 0", r"cc by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "cc by sa", r"cc by sa (?:v ?)?3 0", r"cc by sa 3 0", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-sa", "cc by sa", r"cc by sa", r"cc by sa [12] [05]", r"creativecommons org licenses by sa"),
    ("cc-by-4.0", "cc by", r"cc by (?:v ?)?4 0", r"cc by 4 0", r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "cc by", r"cc by (?:v ?)?3 0", r"cc by 3 0", r"creativecommons org licenses by 3 0"),
    ("cc-by-2.x", "cc by", r"cc by (?:v ?)?2 [05]", r"cc by 2 [05]", r"creativecommons org licenses by 2 [05]"),
    ("cc-by-long", "attribution", r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", r"cc by 1 0", r"creativecommons org licenses by 1 0"),
    ("cc-by-sa-long", "sharealike", r"creative commons attribution sharealike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", r"cc by sa 1 0", r"creativecommons org licenses by sa 1 0"),
    ("cc-by-nc-long", "attribution non", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", r"cc by nc 1 0", r"creativecommons org licenses by nc 1 0"),
    ("cc-by-nd-long", "noderiv", r"creative commons attribution noderiv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", r"cc by nd 1 0", r"creativecommons org licenses by nd 1 0"),
    ("odbl-1.0", "open database", r"open database licen[cs]e(?: (?:version |v)?1 0)?", r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e(?: (?:version |v)?1 0)?", r"odc by 1 0", r"opendatacommons org licenses by"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e", r"pddl 1 0", r"opendatacommons org licenses pddl"),
    ("ogl-uk-3.0", "open government", r"open government licen[cs]e(?: (?:version |v)?3 0)?", r"ogl uk 3 0", r"nationalarchives gov uk doc open government licence"),
    ("cdla-permissive", "community data", r"community data licen[cs]e agreement permissive", r"cdla permissive [12] 0", r"cdla (?:dev|io) permissive"),
    ("cdla-sharing", "community data", r"community data licen[cs]e agreement sharing", r"cdla sharing 1 0", r"cdla (?:dev|io) sharing"),
    ("python-2.0", "python", r"python (?:software foundation )?licen[cs]e(?: version 2)?", r"python 2 0(?: 1)?", r"docs python org 3 license"),
    ("php-3.01", "php", r"php licen[cs]e(?: (?:version |v)?3 0?1?)?", r"php 3 01", r"php net license"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby", r"ruby lang org en about license"),
    ("perl-5", "perl itself", r"same terms as perl itself", r"perl 5", r"dev perl org licenses"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql", r"postgresql org about licence"),
    ("sqlite-blessing", "sqlite", r"sqlite blessing", r"blessing", r"sqlite org copyright"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl", r"openssl org source license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: (?:version |v)?1 [01])?", r"ofl 1 1(?: rfn| no rfn)?", r"scripts sil org ofl"),
    ("lppl-1.3c", "latex project", r"latex project public licen[cs]e(?: (?:version |v)?1 [0-3][ac]?)?", r"lppl 1 [0-3][ac]?", r"latex project org lppl"),
    ("w3c", "w3c", r"w3c (?:software (?:notice and )?|document )?licen[cs]e", r"w3c(?: 20150513| 19980720)?", r"w3 org consortium legal"),
    ("unicode", "unicode", r"unicode(?: inc)? licen[cs]e(?: agreement)?", r"unicode (?:dfs 201[56]|3 0|tou)", r"unicode org (?:license|copyright)"),
    ("icu", "icu", r"icu licen[cs]e", r"icu", r"source icu project org repos icu icu trunk license"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[cs]e", r"ncsa", r"opensource org licenses? ncsa"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", r"ms pl", r"opensource org licenses? ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", r"ms rl", r"opensource org licenses? ms rl"),
    ("apsl-2.0", "apple public", r"apple public source licen[cs]e(?: (?:version |v)?2 0)?", r"apsl 2 0", r"opensource apple com apsl"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: (?:version |v)?3 0)?", r"osl 3 0", r"opensource org licenses? osl 3 0"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: (?:version |v)?3 0)?", r"afl 3 0", r"opensource org licenses? afl 3 0"),
    ("ecl-2.0", "educational community", r"educational community licen[cs]e(?: (?:version |v)?2 0)?", r"ecl 2 0", r"opensource org licenses? ecl 2 0"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: (?:version |v)?1 0)?", r"upl 1 0", r"oss oracle com licenses upl"),
    ("qpl-1.0", "q public", r"q public licen[cs]e(?: (?:version |v)?1 0)?", r"qpl 1 0", r"opensource org licenses? qpl 1 0"),
    ("sspl-1.0", "server side public", r"server side public licen[cs]e(?: (?:version |v)?1)?", r"sspl 1 0", r"mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: (?:version |v)?2 0)?", r"elastic 2 0", r"elastic co licensing elastic license"),
    ("commons-clause", "commons clause", r"commons clause (?:licen[cs]e )?condition(?: (?:version |v)?1 0)?", r"commons clause", r"commonsclause com"),
    ("polyform-nc", "polyform", r"polyform noncommercial licen[cs]e(?: 1 0 0)?", r"polyform noncommercial 1 0 0", r"polyformproject org licenses noncommercial"),
    ("beerware", "beer", r"beer ?ware licen[cs]e", r"beerware", r"fedoraproject org wiki licensing beerware"),
    ("json", "good not evil", r"software shall be used for good not evil", r"json", r"json org license"),
    ("openrail-m", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", r"openrail m?", r"huggingface co spaces compvis stable diffusion license"),
    ("llama-community", "llama", r"llama (?:[23] (?:[0-9] )?)?community licen[cs]e(?: agreement)?", r"llama [23](?: [0-9])? community", r"llama meta com llama[23] license"),
    ("mulan-psl-2.0", "mulan", r"mulan p(?:ermissive )?s(?:oftware )?l(?:icense)?(?: (?:version |v)?2)?", r"mulanpsl 2 0", r"license coscl org cn mulanpsl2"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?(?: (?:version |v)?2 1)?", r"cecill 2 1", r"cecill info licences"),
    ("vim", "vim", r"vim licen[cs]e", r"vim", r"vimhelp org uganda"),
    ("curl", "curl", r"curl licen[cs]e", r"curl", r"curl se docs copyright"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", r"hpnd", r"opensource org licenses? hpnd"),
    ("fsf-all-permissive", "without any warranty", r"offered as is without any warranty", r"fsfap", r"gnu org prep maintain html node license notices for other files"),
    ("imagemagick", "imagemagick", r"imagemagick licen[cs]e", r"imagemagick", r"imagemagick org script license"),
    ("ftl", "freetype", r"freetype (?:project )?licen[cs]e", r"ftl", r"freetype org license"),
    ("ijg", "jpeg group", r"independent jpeg group(?: s)?(?: licen[cs]e)?", r"ijg", r"ijg org"),
    ("tcl", "tcl", r"tcl(?: tk)? licen[cs]e", r"tcl", r"tcl tk software tcltk license"),
    ("watcom-1.0", "watcom", r"(?:sybase )?open watcom public licen[cs]e", r"watcom 1 0", r"opensource org licenses? watcom 1 0"),
    ("rpl-1.5", "reciprocal public", r"reciprocal public licen[cs]e(?: (?:version |v)?1 5)?", r"rpl 1 5", r"opensource org licenses? rpl 1 5"),
    ("nasa-1.3", "nasa open", r"nasa open source agreement(?: (?:version |v)?1 3)?", r"nasa 1 3", r"opensource org licenses? nasa1 3"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?: (?:version |v)?2 [01])?", r"zpl 2 [01]", r"zope org resources zpl"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", r"sleepycat", r"opensource org licenses? sleepycat"),
    ("simpl-2.0", "simple public", r"simple public licen[cs]e(?: (?:version |v)?2 0)?", r"simpl 2 0", r"opensource org licenses? simpl 2 0"),
    ("ntp", "ntp", r"ntp licen[cs]e", r"ntp", r"opensource org licenses? ntp"),
    ("miros", "miros", r"miros licen[cs]e", r"miros", r"mirbsd org miros license"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?", r"blueoak 1 0 0", r"blueoakcouncil org license 1 0 0"),
    ("hippocratic-2.1", "hippocratic", r"hippocratic licen[cs]e(?: (?:version |v)?[23] [01])?", r"hippocratic 2 1", r"firstdonoharm dev version"),
    ("parity-7.0.0", "parity public", r"parity public licen[cs]e(?: [67] 0 0)?", r"parity [67] 0 0", r"paritylicense com"),
    ("etalab-2.0", "etalab", r"etalab open licen[cs]e(?: 2 0)?", r"etalab 2 0", r"etalab gouv fr licence ouverte"),
    ("dl-de-by-2.0", "datenlizenz", r"datenlizenz deutschland namensnennung(?: (?:version )?2 0)?", r"dl de by 2 0", r"govdata de dl de by 2 0"),
)

#: Notices without a versioned family: label, keyword, pattern.
NOTICES = (
    ("agpl", "affero", r"(?:gnu )?affero (?:general public )?licen[cs]e"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e"),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("eupl", "european union public", r"european union public licen[cs]e"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("creative-commons", "creative commons", r"creative commons(?: licen[cs]e)?"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"(?:is|are) in the public domain"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|document|text)"),
    ("proprietary", "may not be reproduced", r"may not be reproduced (?:in any form )?without (?:prior )?(?:written )?permission"),
    ("non-commercial", "commercial use", r"(?:not for|non|no) commercial use"),
    ("non-commercial", "commercial use", r"commercial use is (?:strictly )?prohibited"),
    ("fair-use", "fair use", r"(?:claimed |used )?under (?:the )?fair use"),
    ("copyright-notice", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
    ("mit-text", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc-text", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd-text", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-text", "you may not use this file", r"you may not use this file except in compliance with the license"),
    ("gpl-text", "free software you can redistribute", r"this (?:program|library) is free software you can redistribute it and or modify"),
    ("zlib-text", "provided as is", r"this software is provided as is without any express or implied warranty"),
    ("mit", "mit x11 licen", r"mit x11 licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("unlicense", "free and unencumbered", r"free and unencumbered software released into the public domain"),
    ("etalab-2.0", "licence ouverte", r"licence ouverte(?: (?:version )?2 0)?"),
    ("spdx-unknown", "spdx license identifier", r"spdx license identifier licenseref [^ ]+"),
)

#: Tier of each kind of pattern (smaller has priority) and its confidence.
TIERS = {"identifier": (0, 0.99), "address": (1, 0.95), "name": (2, 0.9), "notice": (3, 0.6)}


def signatures() -> list[tuple[str, str, str, str]]:
    """All rules in order of priority: kind, label, keyword, pattern."""
    out = [("identifier", label, "spdx license identifier", f"spdx license identifier {spdx}") for label, _, _, spdx, _ in FAMILIES]
    for label, _, _, _, page in FAMILIES:
        out.append(("address", label, page.split("(")[0].split("[")[0].split("?")[0].rsplit(" ", 1)[0], page))
    out += [("name", label, keyword, name) for label, keyword, name, _, _ in FAMILIES]
    return out + [("notice", *n) for n in NOTICES]
