"""Phrases of license texts, file headers and notices, written by hand.

Each is (label, pattern, keyword, priority). Patterns are for normalised text: lower case, words only, one
space between, so "author's" is "author s" and "v2.0" is "v2 0". A keyword occurs in all that its pattern
matches, and is rare enough in other texts to be worth a look. Priority 1 is wording that only this license
has, 2 a name with its version, 3 a notice that goes with the license, 4 a bare mention.
"""

from __future__ import annotations

ANY = "(?s:.)"

#: Fixed values, as said above.
PHRASES = (
    # MIT and its kin
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted", 1),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", "sublicense", 1),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial portions", 1),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "noninfringement", 2),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "copyright holders be liable", 2),
    ("mit", "(?:the )?(?:expat|mit expat) licen[cs]e", "expat", 2),
    ("mit", "mit style licen[cs]e", "mit style", 3),
    ("mit", "mit licen[cs]ed", "mit licen", 3),
    ("mit", "(?:see|read) (?:the )?(?:file )?licen[cs]e(?: txt| md)? for (?:the )?mit terms", "mit terms", 3),
    ("mit-modern-variant", "permission to use copy modify and distribute this software and its documentation for any purpose without fee is hereby granted", "hereby granted", 2),
    ("mit-cmu", "by obtaining using and or copying this software and or its associated documentation you agree that you have read understood and will comply with", "associated documentation", 1),
    ("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", "otherwise to promote", 1),
    ("x11", "x window system is a trademark of", "x window system", 3),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "hereby granted", 2),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted", 1),
    ("isc", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "author disclaims all warranties", 1),
    ("isc", "in no event shall the author be liable for any special direct indirect or consequential damages", "author be liable", 2),
    ("isc", "isc style licen[cs]e", "isc style", 3),
    ("0bsd", "(?:bsd zero clause|zero clause bsd|0bsd|bsd 0 clause) licen[cs]e", "bsd", 2),
    ("icu", "icu licen[cs]e icu 1 8 1 and later", "icu 1 8 1", 1),
    ("unicode", "unicode inc licen[cs]e agreement data files and software", "unicode inc", 1),
    ("unicode", "terms of use of unicode data files", "unicode data files", 3),
    ("hpnd", "historical permission notice and disclaimer", "historical permission", 2),
    ("smlnj", "standard ml of new jersey copyright notice licen[cs]e and disclaimer", "standard ml", 1),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and licen[cs]e this software and its documentation for any purpose", "authors hereby grant", 1),
    ("tcl", "government use if you are acquiring this software on behalf of the u s government", "acquiring this software", 2),
    ("blessing", "may you do good and not evil", "good and not evil", 1),
    ("blessing", "may you share freely never taking more than you give", "share freely", 1),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "hereby granted", 1),
    ("bsl-1.0", "distributed under the boost software licen[cs]e version 1 0", "boost software", 1),
    ("bsl-1.0", "solely in the form of machine executable object code generated by a source language processor", "source language processor", 1),
    # BSD
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 1),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source", 2),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary", 2),
    ("bsd-3", f"neither the name of {ANY}{{1,80}} nor the names of its contributors may be used to endorse", "endorse", 1),
    ("bsd-3", "the names? of the authors? may not be used to endorse or promote products derived from this software", "endorse or promote", 1),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display", "advertising materials", 1),
    ("bsd-4", "this product includes software developed by the university of california", "university of california", 2),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", "holders and contributors", 2),
    ("bsd", "in no event shall the (?:copyright (?:holder|owner)|regents) or contributors be liable", "contributors be liable", 2),
    ("bsd-2", "(?:bsd 2 clause|simplified bsd|freebsd|two clause bsd) licen[cs]e", "bsd", 2),
    ("bsd-3", "(?:bsd 3 clause|(?:new|modified|revised|three clause) bsd) licen[cs]e", "bsd", 2),
    ("bsd-4", "(?:bsd 4 clause|original bsd|four clause bsd) licen[cs]e", "bsd", 2),
    ("bsd-3-clear", "no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e", "s patent rights", 1),
    ("bsd-3-lbnl", "you are under no obligation whatsoever to provide any bug fixes patches or upgrades", "bug fixes patches", 1),
    ("bsd-nuclear", "not designed licen[cs]ed or intended for use in the design construction operation or maintenance of any nuclear facility", "nuclear facility", 1),
    ("bsd-patent", "bsd 2 clause plus patent licen[cs]e", "bsd", 2),
    ("bsd-source-code", "bsd source code attribution", "bsd", 2),
    ("bsd", "bsd(?: style| like)? licen[cs]e", "bsd", 4),
    ("bsd", "use of this source code is governed by a bsd style licen[cs]e", "governed by a bsd", 2),
    ("bsd", "berkeley software distribution licen[cs]e", "berkeley software", 3),
    ("ncsa", f"permission is hereby granted {ANY}{{0,120}}subject to the following conditions redistributions of source code must", "redistributions of source", 2),
    # Apache
    ("apache-2", "you may not use this file except in compliance with the license", "except in compliance", 3),
    ("apache-2", "you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0", "www apache org", 1),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "required by applicable law", 2),
    ("apache-2", "without warranties or conditions of any kind either express or implied", "warranties or conditions", 3),
    ("apache-2", "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements", "apache software foundation", 1),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", "contributor hereby grants", 1),
    ("apache-2", "apache (?:2|2 0) licen[cs]ed?", "apache 2", 2),
    ("apache-2", "asl 2 0 licen[cs]ed?", "asl 2 0", 2),
    ("apache-2-llvm", "apache licen[cs]e v2 0 with llvm exceptions", "llvm exceptions", 1),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache software foundation", 2),
    ("apache-1.1", "products derived from this software may not be called apache", "called apache", 1),
    ("apache-1", "this product includes software developed by the apache group", "apache group", 1),
    # GNU
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute it", 1),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "redistribute it", 1),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu library general public license", "redistribute it", 1),
    ("agpl", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "redistribute it", 1),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e along with this program", "gnu general public", 2),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this library", "general public", 2),
    ("agpl", "you should have received a copy of the gnu affero general public licen[cs]e along with this program", "gnu affero", 2),
    ("gpl", "distributed in the hope that it will be useful but without any warranty", "hope that it will be useful", 3),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose", "even the implied warranty", 3),
    ("gpl", "the licen[cs]es for most software are designed to take away your freedom to share and change it", "freedom to share and change", 1),
    ("gpl-3", "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works", "free copyleft", 1),
    ("gpl-2", "either version 2 of the licen[cs]e or at your option any later version", "at your option", 3),
    ("gpl-3", "either version 3 of the licen[cs]e or at your option any later version", "at your option", 3),
    ("gpl-2", "gplv2(?: or later| only)?", "gplv2", 2),
    ("gpl-3", "gplv3(?: or later| only)?", "gplv3", 2),
    ("lgpl-2.1", "lgplv2 1(?: or later| only)?", "lgplv2 1", 2),
    ("lgpl-3", "lgplv3(?: or later| only)?", "lgplv3", 2),
    ("agpl-3", "agplv3(?: or later| only)?", "agplv3", 2),
    ("gpl", "gnu gpl", "gnu gpl", 4),
    ("lgpl", "gnu lgpl", "gnu lgpl", 4),
    ("agpl", "gnu agpl", "gnu agpl", 4),
    ("gpl", "gpl compatible", "gpl compatible", 4),
    ("gpl-classpath", "linking this library statically or dynamically with other modules is making a combined work based on this library", "linking this library", 1),
    ("gpl-classpath", "(?:with )?(?:the )?classpath exception", "classpath exception", 2),
    ("gpl-autoconf", "(?:with )?(?:the )?autoconf exception", "autoconf exception", 2),
    ("gpl-bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "bison parser skeleton", 1),
    ("gpl-gcc", "gcc runtime library exception", "gcc runtime", 2),
    ("gpl-linking", "(?:with )?(?:a |the )?linking exception", "linking exception", 2),
    ("gpl-font", "font (?:embedding )?exception", "font e", 3),
    ("gpl-syscall", "this copyright does not cover user programs that use kernel services by normal system calls", "kernel services", 1),
    ("lgpl", "this licen[cs]e the lesser general public licen[cs]e applies to some specially designated software packages", "specially designated", 1),
    ("agpl", "the gnu affero general public licen[cs]e is designed specifically to ensure that", "gnu affero", 1),
    ("agpl", "remote network interaction use with the gnu general public licen[cs]e", "remote network interaction", 1),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "free documentation", 1),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "invariant sections", 2),
    ("fsf-all-permissive", "copying and distribution of this file with or without modification are permitted in any medium without royalty", "medium without royalty", 1),
    ("fsf-unlimited", "this file is free software the free software foundation gives unlimited permission to copy and or distribute it", "gives unlimited permission", 1),
    # Mozilla, Eclipse, Sun, IBM and other weak copyleft
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form", 1),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl", 1),
    ("mpl-2", "this source code form is incompatible with secondary licen[cs]es", "secondary licen", 1),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "contents of this file", 1),
    ("mpl-1.1", "alternatively the contents of this file may be used under the terms of either the gnu general public licen[cs]e", "contents of this file", 2),
    ("mpl", "mpl 2 0 licen[cs]ed?", "mpl 2 0", 2),
    ("npl", "netscape public licen[cs]e", "netscape public", 3),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0", "accompanying materials", 1),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e 2 0", "accompanying materials", 1),
    ("edl-1", "this program and the accompanying materials are made available under the terms of the eclipse distribution licen[cs]e v1 0", "accompanying materials", 1),
    ("epl", "the accompanying program is provided under the terms of this eclipse public licen[cs]e", "accompanying program", 1),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "contents of this file", 1),
    ("cddl", "you can obtain a copy of the licen[cs]e at usr src opensolaris licen[cs]e", "opensolaris", 1),
    ("spl", "sun public licen[cs]e", "sun public", 3),
    ("sissl", "sun industry standards source licen[cs]e", "sun industry", 2),
    ("cpl-1", "the accompanying program is provided under the terms of this common public licen[cs]e", "accompanying program", 1),
    ("ipl-1", "the accompanying program is provided under the terms of this ibm public licen[cs]e", "accompanying program", 1),
    ("apsl", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[cs]e", "apple public source", 1),
    ("qpl", "q public licen[cs]e", "q public", 3),
    ("cpal", "common public attribution licen[cs]e", "public attribution", 3),
    ("rpl", "reciprocal public licen[cs]e", "reciprocal public", 3),
    ("osl-3", "licen[cs]ed under the open software licen[cs]e version 3 0", "open software licen", 1),
    ("afl-3", "licen[cs]ed under the academic free licen[cs]e version 3 0", "academic free", 1),
    ("ms-pl", "this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e", "accompanying software", 2),
    ("ms-pl", "if you bring a patent claim against any contributor over patents that you claim are infringed by the software", "bring a patent claim", 2),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "package may be copied", 1),
    ("artistic", "the same terms as perl(?: itself)?", "as perl", 2),
    ("artistic-2", "this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "given free software package", 1),
    ("clarified-artistic", "clarified artistic licen[cs]e", "artistic licen", 2),
    ("eupl", "licen[cs]ed under the eupl", "eupl", 2),
    ("eupl", f"unless required by applicable law {ANY}{{0,40}}software distributed under the licence is distributed on an as is basis", "required by applicable law", 3),
    ("cecill-b", "cecill b(?: free software)?(?: licen[cs]e)?(?: agreement)?", "cecill b", 2),
    ("cecill-c", "cecill c(?: free software)?(?: licen[cs]e)?(?: agreement)?", "cecill c", 2),
    ("cecill", "this software is governed by the cecill licen[cs]e under french law", "under french law", 1),
    ("erlpl", "erlang public licen[cs]e", "erlang public", 3),
    ("ypl", "yahoo public licen[cs]e", "yahoo public", 3),
    ("sgi-b", "sgi free software licen[cs]e b", "sgi free", 2),
    ("nposl", "non profit open software licen[cs]e", "non profit open", 3),
    ("oclc", "oclc research public licen[cs]e", "oclc research", 3),
    ("nasa", "nasa open source agreement", "nasa open source", 3),
    ("lucent", "lucent public licen[cs]e", "lucent public", 3),
    ("intel", "intel open source licen[cs]e", "intel open source", 3),
    ("nokia", "nokia open source licen[cs]e", "nokia open source", 3),
    ("vovida", "vovida software licen[cs]e", "vovida", 3),
    ("watcom", "sybase open watcom public licen[cs]e", "open watcom", 3),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "obtain complete source", 1),
    ("sleepycat", "(?:the )?sleepycat licen[cs]e", "sleepycat", 3),
    ("motosoto", "motosoto open source licen[cs]e", "motosoto", 3),
    ("frameworx", "frameworx open licen[cs]e", "frameworx", 3),
    ("real", "realnetworks public source licen[cs]e", "realnetworks", 3),
    ("ricoh", "ricoh source code public licen[cs]e", "ricoh source", 3),
    ("sugarcrm", "sugarcrm public licen[cs]e", "sugarcrm", 3),
    # Short permissive texts
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "held liable", 1),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "redistribute it", 1),
    ("zlib", "the origin of this software must not be misrepresented", "be misrepresented", 1),
    ("zlib", "altered source versions must be plainly marked as such", "plainly marked", 1),
    ("zlib", "zlib libpng licen[cs]e", "zlib libpng", 2),
    ("libpng", "the png reference library is supplied as is", "png reference library", 1),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "independent jpeg", 1),
    ("libtiff", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "hereby granted", 2),
    ("freetype", f"portions of this software are copyright {ANY}{{0,40}}the freetype project", "freetype project", 1),
    ("bzip2", "bzip2 and libbzip2 licen[cs]e", "libbzip2", 2),
    ("info-zip", "info zip licen[cs]e", "info zip", 3),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl toolkit", 1),
    ("ssleay", "this product includes cryptographic software written by eric young", "cryptographic software written", 1),
    ("openldap", "openldap public licen[cs]e", "openldap", 3),
    ("php", "this product includes php software freely available from", "php software", 1),
    ("psf-2", "python software foundation licen[cs]e version 2", "python software foundation", 1),
    ("cnri", "cnri (?:open source )?licen[cs]e(?: agreement)?(?: for python)?", "cnri", 3),
    ("w3c", "w3c software notice and licen[cs]e", "w3c software", 2),
    ("json", "software shall be used for good not evil", "good not evil", 1),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", "buy me a beer", 1),
    ("beerware", "the beer ?ware licen[cs]e", "ware licen", 2),
    ("wtfpl", "you just do what the fuck you want to", "what the fuck you want", 1),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed", "changing it is allowed", 1),
    ("fair", "usage of the works is permitted provided that this instrument is retained with the works", "this instrument is retained", 1),
    ("naumen", "naumen public licen[cs]e", "naumen", 3),
    ("entessa", "entessa public licen[cs]e", "entessa", 3),
    ("xnet", "x net licen[cs]e", "x net", 3),
    ("afm", f"this file and the {ANY}{{0,20}}postscript r afm files it accompanies may be used copied and distributed for any purpose and without charge", "afm files", 1),
    ("bitstream-vera", "bitstream vera is a trademark of bitstream inc", "bitstream vera", 1),
    ("ofl-1.1", "this font software is licen[cs]ed under the sil open font licen[cs]e version 1 1", "open font", 1),
    ("ofl", "with reserved font name", "reserved font name", 3),
    ("ofl", "the goals of the open font licen[cs]e ofl are to stimulate worldwide development of collaborative font projects", "collaborative font", 1),
    ("ubuntu-font", "ubuntu font licen[cs]e", "ubuntu font", 3),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public licen[cs]e", "latex project", 1),
    ("lppl", "this work has the lppl maintenance status", "lppl maintenance", 2),
    ("knuth", "this file may be freely copied and distributed provided that no changes whatsoever are made", "no changes whatsoever", 1),
    ("mulanpsl-2", "licen[cs]ed under mulan psl v2", "mulan psl", 1),
    ("mulanpsl-2", "you can use this software according to the terms and conditions of the mulan psl v2", "mulan psl", 1),
    ("upl-1", "licen[cs]ed under the universal permissive licen[cs]e v 1 0", "universal permissive", 1),
    ("postgresql", "provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", "following two paragraphs", 1),
    ("ruby", "the same terms as ruby(?: itself)?", "as ruby", 2),
    ("vim", "vim licen[cs]e", "vim licen", 3),
    ("vim", "there are no restrictions on distributing unmodified copies of vim", "copies of vim", 1),
    ("spencer", "this software is not subject to any licen[cs]e of the american telephone and telegraph company", "telegraph company", 1),
    ("hylafax", "hylafax facsimile software licen[cs]e", "hylafax", 3),
    ("jasper", "jasper licen[cs]e version 2 0", "jasper licen", 2),
    ("gd", "permission has been granted to copy distribute and modify gd in any context", "modify gd", 1),
    ("torque", "torque v2 5 software licen[cs]e", "torque v2", 2),
    # Public domain and equivalents
    ("unlicense", "(?:the )?unlicense", "unlicense", 2),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 1),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy", 1),
    ("unlicense", "for more information please refer to (?:http|https) unlicense org", "unlicense", 1),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0", 2),
    ("cc0", "creative commons zero", "creative commons", 2),
    ("cc0", f"to the extent possible under law {ANY}{{1,80}} has waived all copyright and related or neighboring rights", "has waived all copyright", 1),
    ("cc0", "creativecommons org publicdomain zero 1 0", "publicdomain zero", 1),
    ("public-domain", "creativecommons org publicdomain mark 1 0", "publicdomain mark", 2),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to|in to) the public domain", "public domain", 2),
    ("public-domain", "in the public domain", "public domain", 4),
    ("public-domain", "public domain mark", "public domain", 3),
    ("public-domain", "the author disclaims copyright to this source code", "disclaims copyright", 1),
    ("public-domain", "no copyright is claimed", "copyright is claimed", 3),
    ("public-domain", "not subject to copyright protection(?: (?:in|within) the united states)?", "copyright protection", 2),
    ("us-government", "this is a work of the (?:u s|united states) government", "is a work of the", 2),
    ("pddl", "public domain dedication and licen[cs]e", "public domain", 2),
    # Content, data and models
    ("cc", "creative commons licen[cs]e", "creative commons", 4),
    ("cc", "this work is licen[cs]ed under a creative commons", "creative commons", 3),
    ("cc", "some rights reserved", "rights reserved", 4),
    ("cc", "you are free to share copy and redistribute the material in any medium or format", "free to share", 2),
    ("cc-by", "you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made", "appropriate credit", 2),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e", "build upon the material", 2),
    ("cc-by-nc", "you may not use the material for commercial purposes", "material for commercial", 2),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", "build upon the material", 2),
    ("cc-by-sa-3", "text is available under the creative commons attribution share ?alike licen[cs]e", "creative commons", 2),
    ("odbl", f"contains information from {ANY}{{1,60}} which is made available here under the open database licen[cs]e", "open database", 1),
    ("odbl", "openstreetmap contributors", "openstreetmap contributors", 3),
    ("odc-by", f"contains information from {ANY}{{1,60}} which is made available under the odc attribution licen[cs]e", "odc attribution", 1),
    ("ogl-uk", "contains public sector information licen[cs]ed under the open government licen[cs]e v(?:1|2|3) 0", "public sector information", 1),
    ("ogl-uk", "open government licen[cs]e", "open government", 3),
    ("dl-de", "data licence germany (?:attribution|zero)", "licence germany", 2),
    ("dl-de", "datenlizenz deutschland (?:namensnennung|zero)", "datenlizenz", 2),
    ("etalab", "licence ouverte(?: open licen[cs]e)?", "licence ouverte", 3),
    ("cdla-permissive", "community data licen[cs]e agreement permissive", "community data", 2),
    ("cdla-sharing", "community data licen[cs]e agreement sharing", "community data", 2),
    ("free-art", "free art licen[cs]e", "free art", 3),
    ("free-art", "licence art libre", "art libre", 3),
    ("ogl-game", "open game licen[cs]e(?: version 1 0a?)?", "open game", 3),
    ("openrail", "use based restrictions as referenced in paragraph 5", "use based restrictions", 1),
    ("openrail", "bigscience rail licen[cs]e", "rail licen", 2),
    ("openrail", "creativeml open rail m(?: licen[cs]e)?", "creativeml", 2),
    ("llama", "llama (?:2|3|3 1|3 2|3 3) community licen[cs]e(?: agreement)?", "community licen", 2),
    ("gemma", "gemma terms of use", "gemma terms", 2),
    ("hippocratic", "hippocratic licen[cs]e", "hippocratic", 3),
    ("ethical", "ethical source licen[cs]e", "ethical source", 3),
    # Source available and closed
    ("busl-1.1", "the business source licen[cs]e this document or the licen[cs]e is not an open source licen[cs]e", "business source", 1),
    ("busl", f"change date {ANY}{{1,60}} change licen[cs]e", "change licen", 2),
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service", "third parties as a service", 1),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service", "hosted or managed service", 1),
    ("commons-clause", "commons clause licen[cs]e condition", "commons clause", 2),
    ("commons-clause", "the licen[cs]e does not grant to you the right to sell the software", "right to sell the software", 2),
    ("confluent", "confluent community licen[cs]e", "community licen", 3),
    ("timescale", "timescale licen[cs]e", "timescale licen", 3),
    ("redis", "redis source available licen[cs]e", "source available", 3),
    ("fsl", "functional source licen[cs]e", "functional source", 3),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) licen[cs]e", "polyform", 2),
    ("prosperity", "prosperity public licen[cs]e", "prosperity public", 3),
    ("parity", "parity public licen[cs]e", "parity public", 3),
    ("jrl", "java research licen[cs]e", "java research", 3),
    ("bcl", "binary code licen[cs]e agreement", "binary code", 3),
    ("proprietary", "all rights reserved", "all rights reserved", 4),
    ("proprietary", "proprietary and confidential", "proprietary", 2),
    ("proprietary", "confidential and proprietary", "proprietary", 2),
    ("proprietary", f"(?:unauthori[sz]ed|no) (?:copying|reproduction|redistribution) (?:of this {ANY}{{1,40}} )?(?:is )?(?:strictly )?prohibited", "prohibited", 3),
    ("proprietary", f"(?:unauthori[sz]ed|no) (?:copying|reproduction|redistribution) (?:of this {ANY}{{1,40}} )?(?:is )?(?:strictly )?permitted", "permitted", 3),
    ("proprietary", "unpublished proprietary source code", "proprietary", 2),
    ("proprietary", "contains trade secrets of", "trade secrets", 3),
    ("proprietary", "contains proprietary information of", "proprietary", 3),
    ("proprietary", "no part of this (?:publication|book|document|software|work) may be reproduced", "may be reproduced", 2),
    ("proprietary", "without the (?:prior |express |prior express |express prior )?written permission of the (?:author|publisher|copyright (?:holder|owner))", "written permission", 3),
    ("proprietary", "without the (?:prior |express |prior express |express prior )?written consent of the (?:author|publisher|copyright (?:holder|owner))", "written consent", 3),
    ("proprietary", "may not be published broadcast rewritten or redistributed", "rewritten or redistributed", 2),
    ("proprietary", "not for redistribution", "not for redistribution", 3),
    ("proprietary", "for internal use only", "internal use only", 4),
    ("proprietary", "for evaluation purposes only", "evaluation purposes", 3),
    ("proprietary", "reverse engineering decompil(?:ing|ation) (?:and|or) disassembl(?:ing|y)", "reverse engineering", 3),
    ("eula", "end user licen[cs]e agreement", "end user", 3),
    ("eula", "by installing (?:or using )?this software you agree to be bound by the terms", "by installing", 2),
    ("shareware", "this (?:program|software) is shareware", "is shareware", 3),
    ("freeware", "this (?:program|software) is freeware", "is freeware", 3),
    # Mentions and terms that go with any license
    ("dual", "dual(?:ly)? licen[cs]ed", "dual", 4),
    ("dual", "licen[cs]ed under either of", "under either of", 3),
    ("non-commercial", "(?:for )?non ?commercial (?:use|purposes)(?: only)?", "commercial", 4),
    ("non-commercial", "free for (?:personal|academic|educational) use(?: only)?", "free for", 4),
    ("non-commercial", "for (?:research|academic) use only", "use only", 4),
    ("non-commercial", "for (?:research|academic) purposes only", "purposes only", 4),
    ("no-derivatives", "no deriv(?:ative|ative work)s(?: allowed)?", "no deriv", 4),
    ("share-alike", "share ?alike", "alike", 4),
    ("royalty-free", "royalty free licen[cs]e", "royalty free", 4),
    ("spdx", "spdx license identifier", "spdx", 4),
    ("notice", "for (?:licen[cs]e|licen[cs]ing|copying) details see (?:the )?(?:accompanying )?(?:file )?(?:licen[cs]e|copying)(?: txt| md)?", "details see", 4),
    ("notice", "see (?:the )?(?:accompanying )?(?:file )?(?:licen[cs]e|copying)(?: txt| md)? for details", "for details", 4),
    ("notice", "third party (?:licen[cs]es|notices)", "third party", 4),
)
