"""Ordered signature rules for licences, matched against words joined by one space.

Each family is one hand-written pattern, more than two hundred in all; `{v}` stands for a
version in words ("2 0", or "2" where the family allows its short form), for which it gives a
rule each.  A rule's keyword must occur in a text before
its pattern is tried.  Higher priority wins where detections overlap.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rule_id: int
    label: str
    priority: int
    keyword: str
    pattern: str
    weight: float


#: The four base phrases and labels (fixed by the query's contract).
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

GPL, LGPL, AGPL = ("1.0", "2.0", "3.0"), ("2.0", "2.1", "3.0"), ("1.0", "3.0")
CC, CC0 = ("1.0", "2.0", "2.5", "3.0", "4.0"), ("1.0",)
CC_PARTS = {"": "", "-sa": " sharealike", "-nc": " noncommercial", "-nd": " noderivatives", "-nc-sa": " noncommercial sharealike", "-nc-nd": " noncommercial noderivatives"}

# (label, pattern, keyword, priority, weight, versions)
FAMILIES: list[tuple[str, str, str, int, float, tuple[str, ...]]] = [
    # GNU family: grants, then names with a version, then bare names
    ("gpl-{v}-or-later", r"gnu general public license (?:as published by the free software foundation )?(?:either )?version {v} (?:of the license )?or (?:at your option )?any later version", "general public license", 95, 1.0, GPL),
    ("gpl-{v}-or-later", r"gnu gpl (?:version |v)?{v} or later", "gnu gpl", 94, 0.95, GPL),
    ("gpl-{v}-only", r"gnu general public license (?:version |v){v} only", "general public license", 94, 0.95, GPL),
    ("gpl-{v}", r"gnu general public license (?:as published by the free software foundation )?(?:version |v){v}", "general public license", 90, 0.95, GPL),
    ("gpl-{v}", r"version {v} of the gnu general public license", "general public license", 90, 0.95, GPL),
    ("gpl-{v}", r"(?:gnu )?gpl ?(?:version |v )?{v}", "gpl", 80, 0.85, GPL),
    ("lgpl-{v}-or-later", r"gnu (?:lesser|library) general public license (?:as published by the free software foundation )?(?:either )?version {v} (?:of the license )?or (?:at your option )?any later version", "general public license", 96, 1.0, LGPL),
    ("lgpl-{v}", r"gnu (?:lesser|library) general public license (?:version |v){v}", "general public license", 92, 0.95, LGPL),
    ("lgpl-{v}", r"(?:gnu )?lgpl ?(?:version |v )?{v}", "lgpl", 82, 0.85, LGPL),
    ("agpl-{v}-or-later", r"gnu affero general public license (?:as published by the free software foundation )?(?:either )?version {v} (?:of the license )?or (?:at your option )?any later version", "general public license", 96, 1.0, AGPL),
    ("agpl-{v}", r"gnu affero general public license (?:version |v){v}", "general public license", 92, 0.95, AGPL),
    ("agpl-{v}", r"(?:gnu )?agpl ?(?:version |v )?{v}", "agpl", 82, 0.85, AGPL),
    ("gfdl-{v}", r"gnu free documentation license version {v}", "free documentation license", 90, 0.95, ("1.1", "1.2", "1.3")),
    ("lgpl", r"gnu (?:lesser|library) general public license", "general public license", 70, 0.8, ("",)),
    ("agpl", r"gnu affero general public license", "general public license", 70, 0.8, ("",)),
    ("gfdl", r"gnu free documentation license", "free documentation license", 70, 0.8, ("",)),
    ("gpl", r"gnu general public license", "general public license", 60, 0.8, ("",)),
    # permissive
    ("apache-{v}", r"apache license version {v}", "apache license", 90, 0.98, ("1.0", "1.1", "2.0")),
    ("apache-{v}", r"apache (?:software )?license {v}", "apache", 88, 0.95, ("1.0", "1.1", "2.0")),
    ("apache-{v}", r"apache {v}", "apache", 78, 0.7, ("1.0", "1.1", "2.0")),
    ("apache-2.0", r"www apache org licenses license 2 0", "apache org licenses", 85, 0.95, ("",)),
    ("apache", r"apache license", "apache license", 60, 0.8, ("",)),
    ("apache", r"apache software license", "apache software license", 62, 0.8, ("",)),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?", "permission is hereby granted", 95, 1.0, ("",)),
    ("mit", r"(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?mit license", "mit license", 85, 0.95, ("",)),
    ("mit", r"mit license", "mit license", 60, 0.8, ("",)),
    ("mit-0", r"mit no attribution(?: license)?", "mit no attribution", 85, 0.9, ("",)),
    ("x11", r"x11 license", "x11 license", 60, 0.8, ("",)),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify", 92, 0.95, ("",)),
    ("isc", r"isc license", "isc license", 60, 0.8, ("",)),
    ("bsd-{v}-clause", r"bsd {v} clause(?: license)?", "bsd", 88, 0.9, ("0", "1", "2", "3", "4")),
    ("bsd-{v}-clause", r"{v} clause bsd(?: license)?", "clause bsd", 88, 0.9, ("0", "1", "2", "3", "4")),
    ("bsd-2-clause", r"(?:simplified|freebsd) bsd license", "bsd license", 86, 0.9, ("",)),
    ("bsd-3-clause", r"(?:new|modified|revised) bsd license", "bsd license", 86, 0.9, ("",)),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 84, 0.95, ("",)),
    ("bsd", r"bsd (?:style )?license", "bsd", 60, 0.7, ("",)),
    ("zlib", r"zlib(?: libpng)? license", "zlib", 60, 0.8, ("",)),
    ("boost-1.0", r"boost software license(?: version 1 0)?", "boost software license", 80, 0.9, ("",)),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered software", 95, 1.0, ("",)),
    ("unlicense", r"the unlicense", "the unlicense", 60, 0.8, ("",)),
    ("wtfpl", r"do what the fuck you want to public license", "you want to public license", 85, 0.95, ("",)),
    ("artistic-{v}", r"artistic license {v}", "artistic license", 86, 0.9, ("1.0", "2.0")),
    ("artistic", r"artistic license", "artistic license", 60, 0.75, ("",)),
    ("python-2.0", r"python software foundation license(?: version 2)?", "python software foundation", 80, 0.9, ("",)),
    ("php-{v}", r"php license version {v}", "php license", 86, 0.9, ("3.0", "3.01")),
    ("postgresql", r"postgresql license", "postgresql license", 60, 0.85, ("",)),
    ("openssl", r"openssl license", "openssl license", 60, 0.85, ("",)),
    # weak copyleft
    ("mpl-{v}", r"mozilla public license (?:version |v)?{v}", "mozilla public license", 90, 0.95, ("1.0", "1.1", "2.0")),
    ("mpl-{v}", r"mpl ?(?:version |v )?{v}", "mpl", 78, 0.8, ("1.0", "1.1", "2.0")),
    ("mpl", r"mozilla public license", "mozilla public license", 60, 0.8, ("",)),
    ("epl-{v}", r"eclipse public license (?:version |v)?{v}", "eclipse public license", 90, 0.95, ("1.0", "2.0")),
    ("epl", r"eclipse public license", "eclipse public license", 60, 0.8, ("",)),
    ("cddl-{v}", r"common development and distribution license (?:version )?{v}", "common development and distribution", 90, 0.95, ("1.0", "1.1")),
    ("cddl", r"common development and distribution license", "common development and distribution", 60, 0.8, ("",)),
    ("cpl-1.0", r"common public license(?: version 1 0)?", "common public license", 80, 0.85, ("",)),
    ("eupl-{v}", r"european union public licen[cs]e (?:version |v)?{v}", "european union public", 90, 0.95, ("1.0", "1.1", "1.2")),
    ("osl-{v}", r"open software license (?:version )?{v}", "open software license", 88, 0.9, ("1.0", "2.0", "2.1", "3.0")),
    ("afl-{v}", r"academic free license (?:version )?{v}", "academic free license", 88, 0.9, ("1.1", "2.0", "2.1", "3.0")),
    ("apsl-{v}", r"apple public source license (?:version )?{v}", "apple public source", 88, 0.9, ("1.0", "1.1", "2.0")),
    ("ofl-{v}", r"sil open font license version {v}", "open font license", 88, 0.95, ("1.0", "1.1")),
    ("ms-pl", r"microsoft public license", "microsoft public license", 60, 0.85, ("",)),
    ("odbl-1.0", r"open database license(?: v?1 0)?", "open database license", 70, 0.85, ("",)),
    ("odc-by-1.0", r"open data commons attribution license(?: v?1 0)?", "open data commons", 75, 0.85, ("",)),
    # Creative Commons: addresses, names, short forms
    *((f"cc-by{k}" + "-{v}", rf"creative commons attribution{w} {{v}}(?: international| generic| unported)?(?: licen[cs]e)?", "creative commons", 90, 0.95, CC) for k, w in CC_PARTS.items()),
    *((f"cc-by{k}" + "-{v}", rf"creativecommons org licenses by{k.replace('-', ' ')} {{v}}", "creativecommons org", 88, 0.95, CC) for k in CC_PARTS),
    *((f"cc-by{k}" + "-{v}", rf"cc by{k.replace('-', ' ')} {{v}}", "cc by", 86, 0.9, CC) for k in CC_PARTS),
    *((f"cc-by{k}", rf"cc by{k.replace('-', ' ')}", "cc by", 60 + 2 * len(k), 0.75, ("",)) for k in CC_PARTS),
    *((f"cc-by{k}", rf"creative commons attribution{w}(?: licen[cs]e)?", "creative commons", 60 + 2 * len(k), 0.75, ("",)) for k, w in CC_PARTS.items()),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?", "cc0", 80, 0.85, ("",)),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", "creativecommons org", 88, 0.95, ("",)),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", "public domain", 70, 0.8, ("",)),
    ("creative-commons", r"creative commons licen[cs]e", "creative commons", 50, 0.6, ("",)),
    # general notices
    ("proprietary", r"proprietary and confidential", "proprietary and confidential", 50, 0.6, ("",)),
    ("all-rights-reserved", r"all rights reserved", "all rights reserved", 20, 0.3, ("",)),
    ("copyright-notice", r"copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright", 10, 0.2, ("",)),
    ("see-license", r"see the license file", "license file", 15, 0.3, ("",)),
    ("license-unknown", r"licensed under the", "licensed under the", 5, 0.2, ("",)),
    # texts of permissive licences, clause by clause
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice", 93, 0.95, ("",)),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", "to deal in the software", 92, 0.95, ("",)),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "the software is provided", 66, 0.7, ("",)),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "authors or copyright holders", 65, 0.7, ("",)),
    ("mit", r"(?:the )?mit expat license", "expat license", 84, 0.9, ("",)),
    ("mit", r"expat license", "expat license", 70, 0.85, ("",)),
    ("mit", r"opensource org licenses mit", "opensource org", 84, 0.95, ("",)),
    ("mit", r"license mit(?: license)?", "license mit", 58, 0.7, ("",)),
    ("mit", r"mit licen[cs]ed", "mit licen", 64, 0.8, ("",)),
    ("mit-advertising", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "hereby granted without fee", 90, 0.9, ("",)),
    ("mit-modern-variant", r"permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute", "without written agreement", 91, 0.95, ("",)),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used", "x consortium", 90, 0.95, ("",)),
    ("x11", r"except as contained in this notice the names? of (?:the )?(?:above )?copyright holders? shall not be used in advertising", "contained in this notice", 82, 0.85, ("",)),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", "permission notice appear", 90, 0.95, ("",)),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", "disclaims all warranties", 88, 0.9, ("",)),
    ("isc", r"opensource org licenses isc", "opensource org", 84, 0.95, ("",)),
    ("bsd-2-clause", r"opensource org licenses bsd 2 clause", "opensource org", 84, 0.95, ("",)),
    ("bsd-3-clause", r"opensource org licenses bsd 3 clause", "opensource org", 84, 0.95, ("",)),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code", 80, 0.9, ("",)),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form", 80, 0.9, ("",)),
    ("bsd-3-clause", r"neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products", "names of its contributors", 87, 0.95, ("",)),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "all advertising materials", 89, 0.95, ("",)),
    ("bsd-4-clause-uc", r"this product includes software developed by the university of california berkeley and its contributors", "university of california", 91, 0.95, ("",)),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license", "patent rights are granted", 88, 0.9, ("",)),
    ("bsd-2-clause-patent", r"bsd (?:2 clause )?plus patent license", "plus patent license", 88, 0.9, ("",)),
    ("0bsd", r"zero clause bsd(?: license)?", "zero clause", 89, 0.9, ("",)),
    ("0bsd", r"bsd zero clause(?: license)?", "bsd zero clause", 90, 0.9, ("",)),
    ("0bsd", r"free public license 1 0 0", "free public license", 89, 0.9, ("",)),
    ("bsd", r"bsd licen[cs]ed", "bsd licen", 64, 0.75, ("",)),
    ("bsd", r"berkeley software distribution licen[cs]e", "berkeley software distribution", 70, 0.8, ("",)),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "will the authors be held liable", 90, 0.95, ("",)),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented", "altered source versions", 90, 0.95, ("",)),
    ("libpng", r"png reference library license", "png reference library", 86, 0.9, ("",)),
    ("boost-1.0", r"distributed under the boost software license version 1 0", "boost software license", 88, 0.95, ("",)),
    ("boost-1.0", r"www boost org license 1 0 txt", "boost org", 87, 0.95, ("",)),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy", 94, 0.95, ("",)),
    ("unlicense", r"unlicense org", "unlicense org", 75, 0.85, ("",)),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "changing it is allowed", 90, 0.95, ("",)),
    ("wtfpl", r"wtfpl(?: version 2)?", "wtfpl", 72, 0.85, ("",)),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "you can do whatever you want", 92, 0.95, ("",)),
    ("beerware", r"beer ?ware license(?: revision 42)?", "ware license", 76, 0.85, ("",)),
    ("ncsa", r"university of illinois ncsa open source license", "ncsa open source license", 90, 0.95, ("",)),
    ("ncsa", r"ncsa open source license", "ncsa open source license", 78, 0.85, ("",)),
    ("curl", r"curl (?:and libcurl )?(?:are |is )?licensed under", "curl", 70, 0.75, ("",)),
    ("fair", r"usage of the works is permitted provided that this instrument is retained with the works", "usage of the works", 92, 0.95, ("",)),
    ("hpnd", r"historical permission notice and disclaimer", "historical permission notice", 84, 0.9, ("",)),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", "with or without fee", 90, 0.9, ("",)),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation", "authors hereby grant permission", 91, 0.95, ("",)),
    ("vim", r"vim is charityware", "charityware", 86, 0.9, ("",)),
    ("vim", r"vim license", "vim license", 66, 0.8, ("",)),
    ("w3c", r"w3c software notice and license", "w3c software notice", 86, 0.95, ("",)),
    ("w3c", r"w3c software and document (?:notice and )?license", "w3c software and document", 86, 0.95, ("",)),
    ("unicode-dfs", r"unicode inc license agreement data files and software", "unicode inc license", 88, 0.95, ("",)),
    ("icu", r"icu license", "icu license", 64, 0.8, ("",)),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "independent jpeg group", 90, 0.95, ("",)),
    ("ftl", r"freetype project license", "freetype project license", 82, 0.9, ("",)),
    ("ftl", r"portions of this software are copyright (?:[^ ]+ ){0,4}the freetype project", "the freetype project", 84, 0.9, ("",)),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "the openssl project", 92, 0.95, ("",)),
    ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic software written by", 92, 0.95, ("",)),
    ("php-3.01", r"this product includes php software freely available from", "php software", 90, 0.95, ("",)),
    ("python-2.0", r"psf license agreement", "psf license agreement", 82, 0.9, ("",)),
    ("python-2.0", r"psf is making python available to licensee on an as is basis", "making python available", 92, 0.95, ("",)),
    ("cnri-python", r"cnri open source license agreement", "cnri open source", 86, 0.9, ("",)),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "without a written agreement", 93, 0.95, ("",)),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction", "give away verbatim copies", 90, 0.9, ("",)),
    ("ruby", r"ruby s license", "ruby s license", 72, 0.8, ("",)),
    ("perl", r"(?:under )?the same terms as perl itself", "terms as perl itself", 86, 0.9, ("",)),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "conditions under which a package", 91, 0.95, ("",)),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms", "this license establishes the terms", 91, 0.95, ("",)),
    ("clarified-artistic", r"clarified artistic license", "clarified artistic", 84, 0.9, ("",)),
    ("afl", r"academic free license", "academic free license", 62, 0.8, ("",)),
    ("ecl-2.0", r"educational community license(?: version 2 0)?", "educational community license", 84, 0.9, ("",)),
    ("upl-1.0", r"universal permissive license(?: v(?:ersion )?1 0)?", "universal permissive license", 84, 0.9, ("",)),
    ("blueoak-1.0.0", r"blue oak model license(?: 1 0 0)?", "blue oak model", 86, 0.95, ("",)),
    ("mulan-psl", r"mulan (?:permissive software license|psl)(?: v(?:ersion )?[12])?", "mulan", 86, 0.9, ("",)),
    ("ms-pl", r"microsoft permissive license", "microsoft permissive", 64, 0.85, ("",)),
    ("json", r"the software shall be used for good not evil", "for good not evil", 94, 0.95, ("",)),
    ("apache-2.0", r"you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license", 83, 0.9, ("",)),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements", "apache software foundation", 89, 0.95, ("",)),
    ("apache-2.0", r"distributed on an as is basis without warranties or conditions of any kind either express or implied", "warranties or conditions of any kind", 74, 0.8, ("",)),
    ("apache-2.0", r"(?:the )?asl ?(?:version |v)?2(?: 0)?", "asl", 74, 0.75, ("",)),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache software foundation", 80, 0.8, ("",)),
    ("apache-2.0-llvm", r"apache license v?2 0 with llvm exceptions", "llvm exceptions", 94, 0.98, ("",)),
    # copyleft: notices and exceptions
    ("gpl-or-later", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public", 78, 0.9, ("",)),
    ("lgpl-or-later", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation", "redistribute it and or modify it", 81, 0.9, ("",)),
    ("agpl-or-later", r"you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public", 81, 0.9, ("",)),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program", "copy of the gnu general public", 76, 0.85, ("",)),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library", "received a copy of the gnu", 77, 0.85, ("",)),
    ("gpl-2.0-classpath", r"(?:gnu )?gpl(?: version)? 2(?: 0)? with (?:the )?classpath exception", "classpath exception", 93, 0.95, ("",)),
    ("classpath-exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules", "link this library with independent modules", 90, 0.9, ("",)),
    ("gcc-exception", r"gcc runtime library exception", "gcc runtime library", 84, 0.9, ("",)),
    ("font-exception", r"as a special exception if you create a document which uses this font", "document which uses this font", 88, 0.9, ("",)),
    ("bison-exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "bison parser skeleton", 90, 0.9, ("",)),
    ("openssl-exception", r"permission to link (?:the code of portions of )?this program with the openssl library", "with the openssl library", 86, 0.85, ("",)),
    ("linux-syscall-note", r"linux syscall note", "linux syscall note", 86, 0.9, ("",)),
    ("gpl", r"gpl compatible", "gpl compatible", 40, 0.4, ("",)),
    ("gpl", r"gpl licen[cs]ed", "gpl licen", 64, 0.75, ("",)),
    ("copyleft", r"copyleft licen[cs]e", "copyleft licen", 45, 0.5, ("",)),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", "no invariant sections", 86, 0.9, ("",)),
    ("gnu-all-permissive", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "in any medium without royalty", 90, 0.95, ("",)),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form", 94, 0.98, ("",)),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "contents of this file are subject", 94, 0.98, ("",)),
    ("mpl", r"mozilla org mpl", "mozilla org mpl", 82, 0.9, ("",)),
    ("epl", r"the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials", 88, 0.95, ("",)),
    ("edl-1.0", r"eclipse distribution license(?: v(?:ersion )?1 0)?", "eclipse distribution license", 84, 0.9, ("",)),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution", 93, 0.95, ("",)),
    ("cecill", r"cecill(?: [abc])?(?: license)?", "cecill", 70, 0.8, ("",)),
    ("cecill", r"ce ?a cnrs inria logiciel libre", "cnrs inria", 72, 0.8, ("",)),
    ("eupl", r"licensed under the eupl", "under the eupl", 76, 0.85, ("",)),
    ("osl-3.0", r"licensed under the open software license version 3 0", "open software license", 92, 0.95, ("",)),
    ("qpl-1.0", r"q public license(?: version 1 0)?", "q public license", 80, 0.85, ("",)),
    ("ms-rl", r"microsoft reciprocal license", "microsoft reciprocal", 76, 0.85, ("",)),
    ("sissl", r"sun industry standards source license", "sun industry standards", 84, 0.9, ("",)),
    ("spl-1.0", r"sun public license(?: version 1 0)?", "sun public license", 82, 0.9, ("",)),
    ("npl-1.1", r"netscape public license(?: version 1 [01])?", "netscape public license", 82, 0.9, ("",)),
    ("ipl-1.0", r"ibm public license(?: version 1 0)?", "ibm public license", 82, 0.9, ("",)),
    ("nokos", r"nokia open source license", "nokia open source", 82, 0.9, ("",)),
    ("rpl", r"reciprocal public license", "reciprocal public license", 82, 0.9, ("",)),
    ("sleepycat", r"sleepycat license", "sleepycat license", 78, 0.85, ("",)),
    ("cpal-1.0", r"common public attribution license(?: version 1 0)?", "common public attribution", 84, 0.9, ("",)),
    ("erlpl-1.1", r"erlang public license(?: version 1 1)?", "erlang public license", 84, 0.9, ("",)),
    ("zpl", r"zope public license(?: zpl)?(?: version [12] [01])?", "zope public license", 84, 0.9, ("",)),
    ("gl2ps", r"gl2ps license", "gl2ps license", 78, 0.85, ("",)),
    ("lppl", r"latex project public license(?: version 1 [0-3])?", "latex project public license", 86, 0.95, ("",)),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", "this font software", 92, 0.95, ("",)),
    ("ofl", r"scripts sil org ofl", "sil org ofl", 84, 0.9, ("",)),
    ("bitstream-vera", r"bitstream vera (?:fonts? )?(?:copyright|license)", "bitstream vera", 78, 0.85, ("",)),
    # source-available and model licences
    ("bsl-1.1", r"business source license(?: 1 1)?", "business source license", 84, 0.9, ("",)),
    ("sspl-1.0", r"server side public license(?: v(?:ersion )?1)?", "server side public license", 86, 0.95, ("",)),
    ("elastic-2.0", r"elastic license(?: v(?:ersion )?)?(?: ?2(?: 0)?)?", "elastic license", 82, 0.9, ("",)),
    ("commons-clause", r"commons clause license condition", "commons clause", 86, 0.9, ("",)),
    ("polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|free trial) license(?: 1 0 0)?", "polyform", 88, 0.95, ("",)),
    ("parity", r"parity public license", "parity public license", 82, 0.9, ("",)),
    ("prosperity", r"prosperity public license", "prosperity public license", 82, 0.9, ("",)),
    ("openrail", r"(?:creativeml |bigscience )?openrail(?: [m s]+)?(?: license)?", "openrail", 80, 0.85, ("",)),
    ("openrail", r"open rail license", "open rail license", 80, 0.85, ("",)),
    ("community-model", r"community license agreement", "community license agreement", 60, 0.7, ("",)),
    ("hippocratic", r"hippocratic license(?: (?:version )?[123] [01])?", "hippocratic license", 84, 0.9, ("",)),
    # content and data
    ("cc-by", r"creative commons attribution licensed", "attribution licensed", 66, 0.75, ("",)),
    ("creative-commons", r"(?:this work|content|text) is (?:available|licensed|released) under (?:a|the) creative commons", "creative commons", 54, 0.65, ("",)),
    ("cc-pd", r"creative commons public domain mark(?: 1 0)?", "public domain mark", 80, 0.85, ("",)),
    ("cc0-1.0", r"to the extent possible under law (?:[^ ]+ ){1,8}has waived all copyright and related or neighboring rights", "neighboring rights", 90, 0.95, ("",)),
    ("cc-by-sa", r"attribution share ?alike licen[cs]e", "attribution share", 64, 0.75, ("",)),
    ("cc-by-nc", r"attribution non ?commercial licen[cs]e", "attribution non", 64, 0.75, ("",)),
    ("cc-by-nd", r"attribution no ?deriv(?:ative)?s licen[cs]e", "attribution no", 64, 0.75, ("",)),
    ("pddl-1.0", r"public domain dedication and licen[cs]e", "public domain dedication", 84, 0.9, ("",)),
    ("cdla-permissive", r"community data license agreement permissive", "community data license", 86, 0.95, ("",)),
    ("cdla-sharing", r"community data license agreement sharing", "community data license", 86, 0.95, ("",)),
    ("ogl-uk", r"open government licen[cs]e(?: v[123] 0)?", "open government licen", 84, 0.9, ("",)),
    ("public-domain", r"this (?:work|file|software|code|book|text) is in the public domain", "is in the public domain", 78, 0.85, ("",)),
    ("public-domain", r"no copyright is claimed", "no copyright is claimed", 60, 0.6, ("",)),
    ("public-domain", r"work of the united states government", "united states government", 62, 0.65, ("",)),
    ("gutenberg", r"project gutenberg license", "project gutenberg license", 84, 0.95, ("",)),
    ("gutenberg", r"this ebook is for the use of anyone anywhere", "this ebook is for the use", 90, 0.95, ("",)),
    ("opl", r"open publication license(?: v(?:ersion )?1 0)?", "open publication license", 82, 0.9, ("",)),
    ("design-science", r"design science license", "design science license", 80, 0.9, ("",)),
    ("free-art", r"free art license", "free art license", 80, 0.9, ("",)),
    ("free-art", r"licence art libre", "licence art libre", 80, 0.9, ("",)),
    # restrictions
    ("proprietary", r"unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited", "unauthorized copying", 70, 0.8, ("",)),
    ("proprietary", r"(?:may|must) not be reproduced without (?:the )?(?:prior )?(?:written )?permission", "not be reproduced", 42, 0.5, ("",)),
    ("proprietary", r"(?:may|must) not be copied without (?:the )?(?:prior )?(?:written )?permission", "not be copied", 42, 0.5, ("",)),
    ("proprietary", r"for internal use only", "for internal use only", 35, 0.4, ("",)),
    ("proprietary", r"end user licen[cs]e agreement", "end user licen", 48, 0.6, ("",)),
    ("non-commercial", r"for noncommercial (?:use|purposes) only", "noncommercial", 44, 0.5, ("",)),
    ("non-commercial", r"for non commercial (?:use|purposes) only", "non commercial", 44, 0.5, ("",)),
    ("non-commercial", r"not for commercial use", "not for commercial use", 43, 0.5, ("",)),
    ("academic-only", r"for (?:academic|research|educational) use only", "use only", 44, 0.5, ("",)),
    ("academic-only", r"for (?:academic|research|educational) purposes only", "purposes only", 44, 0.5, ("",)),
    ("freeware", r"(?:this (?:program|software) is freeware|freeware license)", "freeware", 42, 0.5, ("",)),
    ("shareware", r"(?:this (?:program|software) is shareware|shareware version)", "shareware", 42, 0.5, ("",)),
    ("trademark-notice", r"(?:is a|are) registered trademarks? of", "registered trademark", 12, 0.2, ("",)),
    ("copyright-notice", r"copyright holders? and contributors", "and contributors", 14, 0.25, ("",)),
    ("license-reference", r"for (?:the )?full (?:copyright and )?license information please (?:view|see) the license", "license information", 18, 0.3, ("",)),
    ("license-reference", r"(?:see|refer to) (?:the )?(?:file )?(?:license|copying)(?: (?:txt|md))? for details", "for details", 17, 0.3, ("",)),
    ("license-reference", r"(?:see|refer to) (?:the )?(?:file )?(?:license|copying)(?: (?:txt|md))? for more details", "for more details", 17, 0.3, ("",)),
]
#: Identifiers after "SPDX-License-Identifier:", in words; the label is the identifier.
SPDX = """mit mit-0 isc zlib unlicense x11 apache-1.1 apache-2.0 bsd-2-clause bsd-3-clause bsd-4-clause 0bsd
gpl-1.0-only gpl-1.0-or-later gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later gpl-2.0 gpl-3.0
lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later agpl-3.0-only agpl-3.0-or-later
mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cddl-1.1 eupl-1.1 eupl-1.2 osl-3.0 afl-3.0 artistic-1.0 artistic-2.0 bsl-1.0 python-2.0
php-3.01 postgresql openssl ncsa cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 wtfpl ofl-1.1
ms-pl odbl-1.0 upl-1.0 ecl-2.0 vim curl blueoak-1.0.0""".split()


def _words(version: str) -> str:
    """A version in words; ".0" may be missing."""
    own = version.replace(".", " ")
    return rf"{own.removesuffix(' 0')}(?: 0)?" if own.endswith(" 0") else own


def rules() -> list[Rule]:
    """All rules in their order."""
    out = [("spdx", x, 99, "spdx license identifier", "spdx license identifier " + x.replace("-", " ").replace(".", " "), 1.0) for x in SPDX]
    for label, pattern, keyword, priority, weight, versions in FAMILIES:
        for v in versions:
            out.append(("family", label.replace("{v}", v), priority, keyword, pattern.replace("{v}", _words(v)), weight))
    return [Rule(i, *x[1:3], x[3], f"(?<= )(?:{x[4]})(?= )", x[5]) for i, x in enumerate(out)]
