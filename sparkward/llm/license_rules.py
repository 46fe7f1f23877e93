"""Signatures of licenses, over the stream of a text's lower-case words with one space between them.

``SIGNATURES`` are written by hand: what licenses, notices and headers say, and the
addresses they point to. ``FAMILIES`` are names with their versions and identifiers, for
which ``TEMPLATES`` say how a license is granted, named or cited.
"""

from __future__ import annotations

# label, priority (3 is the most telling), confidence, keyword that every match holds, regular expression
SIGNATURES = [
    ("mit", 3, 0.98, "free of charge to any person obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 2, 0.9, "this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", 1, 0.6, "without warranty of any kind express", "the software is provided as is without warranty of any kind express or implied"),
    ("mit-0", 3, 0.95, "mit no attribution", "mit no attribution(?: licen[cs]e)?"),
    ("ncsa", 3, 0.98, "deal with the software without restriction", "obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("ncsa", 2, 0.9, "ncsa", "university of illinois(?: urbana champaign)? ncsa open source licen[cs]e"),
    ("x11", 3, 0.95, "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", 3, 0.98, "appear in all copies", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", 3, 0.95, "hereby granted the software is provided", "with or without fee is hereby granted the software is provided as is"),
    ("0bsd", 3, 0.95, "zero clause", "(?:bsd )?zero clause(?: bsd)? licen[cs]e"),
    ("bsd", 2, 0.9, "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 1, 0.7, "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice"),
    ("bsd-2-clause", 3, 0.9, "provided with the distribution this software", "materials provided with the distribution this software is provided by"),
    ("bsd-3-clause", 3, 0.97, "nor the names of its contributors", "nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 3, 0.97, "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", 2, 0.9, "simplified bsd", "simplified bsd licen[cs]e"),
    ("bsd-2-clause", 2, 0.9, "freebsd licen", "freebsd licen[cs]e"),
    ("bsd-3-clause", 2, 0.9, "revised bsd", "revised bsd licen[cs]e"),
    ("bsd-3-clause", 2, 0.9, "modified bsd", "modified bsd licen[cs]e"),
    ("bsd-3-clause", 2, 0.9, "new bsd", "new bsd licen[cs]e"),
    ("bsd-4-clause", 2, 0.9, "original bsd", "original bsd licen[cs]e"),
    ("bsd", 2, 0.8, "bsd style licen", "governed by a bsd style licen[cs]e that can be found in the licen[cs]e file"),
    ("bsd-3-clause-clear", 3, 0.95, "no express or implied licenses to any party", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2.0", 3, 0.99, "apache license version 2 0 the license", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", 3, 0.98, "apache org licenses license 2 0", "(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", 2, 0.8, "distributed on an as is basis", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", 2, 0.9, "asl 2 0", "asl 2 0"),
    ("apache-1.1", 3, 0.95, "software developed by the apache", "this product includes software developed by the apache (?:software foundation|group)"),
    ("apache", 2, 0.85, "licensed to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("gpl", 2, 0.95, "terms of the gnu general public license as", "under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2", 3, 0.98, "version 2 of the licen", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2", 3, 0.97, "version 2 as", "gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3", 3, 0.98, "version 3 of the licen", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3", 3, 0.97, "version 3 as", "gnu general public license version 3 as published by the free software foundation"),
    ("gpl", 2, 0.9, "a copy of the gnu general", "you should have received a copy of the gnu general public license along with"),
    ("gpl", 1, 0.7, "in the hope that it will be useful", "distributed in the hope that it will be useful but without any warranty"),
    ("gpl-3", 2, 0.9, "gnu org licenses gpl 3 0", "gnu org licenses gpl 3 0(?: html| txt)?"),
    ("gpl-2", 2, 0.9, "gnu org licenses", "gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"),
    ("gpl", 1, 0.8, "gnu org licenses gpl", "gnu org licenses gpl(?: html| txt)?"),
    ("gpl", 2, 0.85, "may be distributed under the terms of the gpl", "may be distributed under the terms of the gpl"),
    ("gpl-2-classpath", 3, 0.95, "linking this library statically or dynamically", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-3-gcc-exception", 3, 0.95, "gcc runtime library exception", "gcc runtime library exception"),
    ("lgpl", 2, 0.95, "gnu lesser general", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl-2.1", 3, 0.97, "version 2 1 of the licen", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", 3, 0.97, "version 3 of the licen", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2", 3, 0.97, "gnu library general", "gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", 2, 0.9, "a copy of the gnu l", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", 2, 0.9, "gnu org licenses lgpl", "gnu org licenses lgpl(?: html| txt)?"),
    ("agpl", 2, 0.95, "gnu affero general", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3", 3, 0.97, "version 3 of the licen", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl", 2, 0.9, "a copy of the gnu affero", "you should have received a copy of the gnu affero general public license"),
    ("agpl", 2, 0.9, "gnu org licenses agpl", "gnu org licenses agpl(?: html| txt)?"),
    ("gfdl", 3, 0.97, "modify this document under the terms", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 1, 0.8, "no front cover texts", "with no invariant sections no front cover texts and no back cover texts"),
    ("fsf-all-permissive", 3, 0.95, "in any medium without royalty", "with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("mpl-2.0", 3, 0.99, "this source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 2, 0.95, "mozilla org mpl 2 0", "mozilla org mpl 2 0"),
    ("mpl-1.1", 3, 0.97, "mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0-no-copyleft", 3, 0.95, "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses"),
    ("npl", 3, 0.95, "netscape public licen", "netscape public licen[cs]e(?: version 1 [01])?"),
    ("epl-2.0", 3, 0.97, "eclipse public license", "accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0"),
    ("epl-1.0", 3, 0.97, "eclipse public license", "accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl", 2, 0.9, "eclipse org legal epl", "eclipse org legal epl(?: v10| v20| 2 0)?(?: html)?"),
    ("edl-1.0", 3, 0.95, "eclipse distribution licen", "eclipse distribution licen[cs]e(?: v(?:ersion)?)?(?: ?1 0)?"),
    ("cddl", 3, 0.95, "common development and distribution license the", "subject to the terms of the common development and distribution license the license"),
    ("cddl", 2, 0.9, "opensolaris license", "usr src opensolaris license"),
    ("ipl-1.0", 3, 0.95, "ibm public licen", "ibm public licen[cs]e(?: version)?(?: 1 0)?"),
    ("zlib", 3, 0.97, "in no event will the authors be held liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 3, 0.97, "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", 3, 0.95, "png reference library", "the png reference library is supplied as is"),
    ("ijg", 3, 0.95, "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("ftl", 3, 0.95, "freetype project", "(?:the freetype project licen[cs]e|copyright (?:[a-z0-9]+ ){0,3}the freetype project)"),
    ("bsl-1.0", 3, 0.98, "person or organization obtaining", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", 3, 0.98, "boost org license 1 0", "(?:www )?boost org license 1 0(?: txt)?"),
    ("unlicense", 3, 0.99, "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 2, 0.9, "unlicense org", "unlicense org"),
    ("unlicense", 1, 0.8, "anyone is free to copy modify", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", 3, 0.97, "to the extent possible under law", "to the extent possible under law(?: [a-z0-9]+){1,12} ha(?:s|ve) waived all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", 3, 0.99, "publicdomain zero 1 0", "creativecommons org publicdomain zero 1 0(?: legalcode)?"),
    ("public-domain", 3, 0.97, "publicdomain mark 1 0", "creativecommons org publicdomain mark 1 0"),
    ("public-domain", 2, 0.9, "in the public domain", "(?:is|are|placed|put|lies?) (?:hereby )?in the public domain"),
    ("public-domain", 3, 0.95, "not subject to copyright", "work of the (?:u s|united states) government and is not subject to copyright protection"),
    ("public-domain", 2, 0.9, "dedicated to the public domain", "dedicated to the public domain"),
    ("cc-by-4.0", 3, 0.99, "org licenses by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", 3, 0.99, "org licenses by 3 0", "creativecommons org licenses by 3 0"),
    ("cc-by-2.5", 3, 0.99, "org licenses by 2 5", "creativecommons org licenses by 2 5"),
    ("cc-by-2.0", 3, 0.99, "org licenses by 2 0", "creativecommons org licenses by 2 0"),
    ("cc-by-sa-4.0", 3, 0.99, "org licenses by sa 4 0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", 3, 0.99, "org licenses by sa 3 0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-2.5", 3, 0.99, "org licenses by sa 2 5", "creativecommons org licenses by sa 2 5"),
    ("cc-by-nc-4.0", 3, 0.99, "org licenses by nc 4 0", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-3.0", 3, 0.99, "org licenses by nc 3 0", "creativecommons org licenses by nc 3 0"),
    ("cc-by-nd-4.0", 3, 0.99, "org licenses by nd 4 0", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nd-3.0", 3, 0.99, "org licenses by nd 3 0", "creativecommons org licenses by nd 3 0"),
    ("cc-by-nc-sa-4.0", 3, 0.99, "org licenses by nc sa 4 0", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-sa-3.0", 3, 0.99, "org licenses by nc sa 3 0", "creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-nd-4.0", 3, 0.99, "org licenses by nc nd 4 0", "creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nc-nd-3.0", 3, 0.99, "org licenses by nc nd 3 0", "creativecommons org licenses by nc nd 3 0"),
    ("cc", 1, 0.5, "creativecommons org licenses", "creativecommons org licenses"),
    ("cc", 1, 0.5, "creative commons licen", "creative commons licen[cs]e"),
    ("cc", 1, 0.6, "some rights reserved", "some rights reserved"),
    ("odbl-1.0", 3, 0.97, "opendatacommons org licenses odbl", "opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1.0", 3, 0.97, "opendatacommons org licenses by", "opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1.0", 3, 0.97, "opendatacommons org licenses pddl", "opendatacommons org licenses pddl(?: 1 0)?"),
    ("pddl-1.0", 2, 0.9, "public domain dedication and licen", "public domain dedication and licen[cs]e"),
    ("cdla-permissive-2.0", 3, 0.95, "community data licen", "community data licen[cs]e agreement permissive version 2 0"),
    ("ogl-uk-3.0", 3, 0.95, "open government licen", "open government licen[cs]e v(?:ersion)? ?3 0"),
    ("ogl-uk", 2, 0.85, "open government licen", "open government licen[cs]e"),
    ("wtfpl", 3, 0.98, "you just do what", "you just do what the fuck you want to"),
    ("beerware", 3, 0.97, "whatever you want with this stuff", "you can do whatever you want with this stuff"),
    ("beerware", 2, 0.9, "beer", "the beer ?ware licen[cs]e"),
    ("json", 3, 0.97, "good not evil", "the software shall be used for good not evil"),
    ("vim", 3, 0.95, "vim is charityware", "vim is charityware"),
    ("psf-2", 3, 0.97, "psf is making python available", "psf is making python available to licensee on an as is basis"),
    ("cnri-python", 3, 0.95, "cnri", "cnri (?:open source )?licen[cs]e agreement"),
    ("zpl", 3, 0.95, "zope public licen", "zope public licen[cs]e(?: zpl)?(?: version)?(?: 2 [01])?"),
    ("artistic-1.0", 3, 0.95, "the conditions under which a package may be copied", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-1.0-or-gpl", 3, 0.95, "same terms as perl", "under the same terms as perl(?: itself)?"),
    ("ruby", 3, 0.95, "under either the terms of the 2 clause bsdl", "under either the terms of the 2 clause bsdl"),
    ("ofl-1.1", 3, 0.98, "this font software is licensed", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 2, 0.95, "scripts sil org ofl", "scripts sil org ofl"),
    ("openssl", 3, 0.97, "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 3, 0.97, "eric young", "this product includes cryptographic software written by eric young"),
    ("postgresql", 3, 0.97, "without a written agreement", "for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", 3, 0.9, "and without fee is hereby granted", "to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("curl", 3, 0.9, "for any purpose with or without fee is hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("openldap", 3, 0.95, "openldap public licen", "openldap public licen[cs]e(?: version)?(?: 2 [0-9])?"),
    ("sleepycat", 3, 0.97, "information on how to obtain complete source code", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("w3c", 3, 0.95, "w3c software", "w3c software (?:notice|and document notice) and licen[cs]e"),
    ("unicode", 3, 0.95, "unicode inc licen", "unicode inc licen[cs]e agreement data files and software"),
    ("icu", 3, 0.95, "icu licen", "icu licen[cs]e icu 1 8 1 and later"),
    ("ms-pl", 3, 0.9, "if you use the software you accept this license", "if you use the software you accept this license if you do not accept the license do not use the software"),
    ("ms-rl", 3, 0.95, "microsoft reciprocal licen", "microsoft reciprocal licen[cs]e"),
    ("afl", 2, 0.9, "academic free licen", "academic free licen[cs]e(?: version| v)?(?: [0-9] [0-9])?"),
    ("osl", 2, 0.9, "open software licen", "open software licen[cs]e(?: version| v)?(?: [0-9] [0-9])?"),
    ("ecl-2.0", 2, 0.9, "educational community licen", "educational community licen[cs]e(?: version)?(?: 2 0)?"),
    ("upl-1.0", 2, 0.9, "universal permissive licen", "universal permissive licen[cs]e(?: v(?:ersion)?)?(?: ?1 0)?"),
    ("apsl-2.0", 2, 0.9, "apple public source licen", "apple public source licen[cs]e(?: version)?(?: 2 0)?"),
    ("rpl", 2, 0.9, "reciprocal public licen", "reciprocal public licen[cs]e(?: 1 [0-9])?"),
    ("qpl-1.0", 2, 0.9, "q public licen", "q public licen[cs]e(?: version)?(?: 1 0)?"),
    ("lpl-1.02", 2, 0.9, "lucent public licen", "lucent public licen[cs]e(?: version)?(?: 1 02)?"),
    ("sissl", 2, 0.9, "sun industry standards source licen", "sun industry standards source licen[cs]e"),
    ("nasa-1.3", 2, 0.9, "nasa open source agreement", "nasa open source agreement(?: version)?(?: 1 3)?"),
    ("mulan-psl-2", 2, 0.95, "mulan", "mulan (?:permissive software licen[cs]e|psl) (?:version |v)?2"),
    ("cecill", 2, 0.9, "cecill", "cecill(?: [bc])?(?: free software licen[cs]e agreement)?"),
    ("blueoak-1.0.0", 2, 0.9, "blue oak model licen", "blue oak model licen[cs]e(?: 1 0 0)?"),
    ("hippocratic", 2, 0.9, "hippocratic licen", "hippocratic licen[cs]e"),
    ("sspl-1.0", 2, 0.95, "server side public licen", "server side public licen[cs]e"),
    ("busl-1.1", 2, 0.95, "business source licen", "business source licen[cs]e(?: 1 1)?"),
    ("elastic-2.0", 2, 0.95, "elastic licen", "elastic licen[cs]e(?: v)?(?: ?2 0)?"),
    ("commons-clause", 3, 0.95, "commons clause", "commons clause(?: licen[cs]e condition)?"),
    ("polyform", 2, 0.9, "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter) licen[cs]e"),
    ("fsl", 2, 0.9, "functional source licen", "functional source licen[cs]e"),
    ("openrail", 2, 0.9, "rail", "(?:bigscience |creativeml )?open ?rail(?: [ms]| plus plus m)?"),
    ("apache-2.0-or-mit", 3, 0.97, "licensed under either of", "licensed under either of apache license version 2 0"),
    ("mit-or-gpl", 3, 0.95, "dual licensed under the mit", "dual licensed under the mit (?:licen[cs]e )?(?:and|or) gpl(?: licen[cs]es?)?"),
    ("proprietary", 3, 0.95, "strictly prohibited", "unauthori[sz]ed copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited"),
    ("proprietary", 2, 0.9, "confidential and proprietary information of", "confidential and proprietary information of"),
    ("proprietary", 2, 0.85, "without the prior written permission", "may (?:not )?be (?:copied|reproduced|used|distributed) (?:or (?:copied|reproduced|used|distributed) )?without the prior written permission"),
    ("proprietary", 1, 0.5, "all rights reserved", "all rights reserved"),
    ("proprietary", 3, 0.95, "retain all intellectual property", "and its licensors retain all intellectual property and proprietary rights"),
    ("oracle-bcl", 3, 0.95, "binary code licen", "oracle binary code licen[cs]e agreement"),
    ("eula", 2, 0.85, "end user licen", "end user licen[cs]e agreement"),
]

# identifier, name in the word stream, versions as words, keywords of which every match of the name holds one
FAMILIES = [
    ("gpl", "(?:gnu )?(?:general public licen[cs]e|gpl)", ("1 0", "2", "2 0", "3", "3 0"), ("general public licen", "gpl")),
    ("lgpl", "(?:gnu )?(?:lesser general public licen[cs]e|library general public licen[cs]e|lgpl)", ("2", "2 0", "2 1", "3", "3 0"), ("lesser general", "library general", "lgpl")),
    ("agpl", "(?:gnu )?(?:affero general public licen[cs]e|agpl)", ("1 0", "3", "3 0"), ("affero general", "agpl")),
    ("gfdl", "(?:gnu )?(?:free documentation licen[cs]e|gfdl)", ("1 1", "1 2", "1 3"), ("free documentation", "gfdl")),
    ("apache", "apache(?: software)?(?: licen[cs]e)", ("1 0", "1 1", "2", "2 0"), ("apache",)),
    ("mit", "(?:mit|expat|x11) licen[cs]e", (), ("mit licen", "expat licen", "x11 licen")),
    ("bsd", "bsd(?: style)?(?: licen[cs]e)?", ("2 clause", "3 clause", "4 clause", "0 clause"), ("bsd",)),
    ("mpl", "mozilla public licen[cs]e", ("1 0", "1 1", "2 0"), ("mozilla",)),
    ("epl", "eclipse public licen[cs]e", ("1 0", "2 0"), ("eclipse",)),
    ("cddl", "common development and distribution licen[cs]e", ("1 0", "1 1"), ("distribution",)),
    ("cpl", "common public licen[cs]e", ("1 0",), ("common",)),
    ("eupl", "european union public licen[cs]e", ("1 1", "1 2"), ("european",)),
    ("artistic", "artistic licen[cs]e", ("1 0", "2 0"), ("artistic",)),
    ("isc", "isc licen[cs]e", (), ("isc",)),
    ("zlib", "zlib(?: libpng)? licen[cs]e", (), ("zlib",)),
    ("bsl", "boost software licen[cs]e", ("1 0",), ("boost",)),
    ("ofl", "sil open font licen[cs]e", ("1 0", "1 1"), ("font",)),
    ("wtfpl", "(?:do what the fuck you want to public licen[cs]e|wtfpl)", ("2",), ("do what the", "wtfpl")),
    ("unlicense", "(?:the )?unlicense", (), ("unlicense",)),
    ("cc0", "(?:cc0|creative commons zero|cc zero)", ("1 0",), ("cc0", "creative commons zero", "cc zero")),
    ("cc-by", "(?:cc by|creative commons attribution)", ("2 0", "2 5", "3 0", "4 0"), ("cc by", "commons attribution")),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)", ("2 0", "2 5", "3 0", "4 0"), ("cc by sa", "commons attribution share")),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)", ("2 0", "2 5", "3 0", "4 0"), ("cc by nc", "commons attribution non")),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", ("2 0", "3 0", "4 0"), ("cc by nd", "commons attribution no")),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", ("2 0", "2 5", "3 0", "4 0"), ("cc by nc sa", "commons attribution non")),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)", ("2 0", "2 5", "3 0", "4 0"), ("cc by nc nd", "commons attribution non")),
    ("public-domain", "public domain", (), ("public domain",)),
    ("odbl", "open (?:data commons )?(?:open )?database licen[cs]e", ("1 0",), ("database",)),
    ("psf", "python software foundation licen[cs]e", ("2", "2 0"), ("python",)),
    ("ms-pl", "microsoft public licen[cs]e", (), ("microsoft",)),
    ("php", "php licen[cs]e", ("3 0", "3 01"), ("php",)),
    ("postgresql", "postgresql licen[cs]e", (), ("postgresql",)),
    ("proprietary", "(?:proprietary|commercial) licen[cs]e", (), ("proprietary licen", "commercial licen")),
]
# template, priority, confidence, needs a version; {n} is the name, {v} the version, {i} the identifier as words
TEMPLATES = [
    ("spdx licen[cs]e identifier {i}(?: {v})?(?: (?:only|or later))?", 3, 0.99, False),
    ("(?:licensed|released|distributed|available|published|provided|covered|issued|offered) (?:to you )?(?:under|by) (?:the terms (?:and conditions )?of )?(?:the |a )?{n}(?: (?:version |v ?)?{v})(?: or (?:any )?later(?: version)?)?", 3, 0.97, True),
    ("(?:licensed|released|distributed|available|published|provided|covered|issued|offered) (?:to you )?(?:under|by) (?:the terms (?:and conditions )?of )?(?:the |a )?{n}", 2, 0.9, False),
    ("{n} (?:version |v ?)?{v}(?: or (?:any )?later(?: version)?)?", 2, 0.85, True),
    ("{n}", 1, 0.6, False),
]


def rules() -> list[dict]:
    """All signatures, then every family and version in every template; the order is fixed and plays no part in the outcome."""
    out = [{"label": label, "keywords": [keyword], "regex": f"(?<= ){regex}(?= )", "priority": priority, "confidence": confidence} for label, priority, confidence, keyword, regex in SIGNATURES]
    for ident, name, versions, keywords in FAMILIES:
        for version in ("", *versions):
            for template, priority, confidence, versioned in TEMPLATES:
                if versioned and not version or version and not versioned and "{v}" not in template:
                    continue
                body = template.replace("{n}", name).replace("{i}", ident.replace("-", " "))
                body = body.replace("(?: {v})?", f" {version}" if version else "").replace("{v}", version)
                label = ident + ("-" + version.replace(" ", "-" if "clause" in version else ".") if version else "")
                # a template without the name holds the identifier instead
                words = list(keywords) if "{n}" in template else ["identifier " + ident.replace("-", " ")]
                out.append({"label": label, "keywords": words, "regex": f"(?<= ){body}(?= )", "priority": priority, "confidence": confidence})
    return out
