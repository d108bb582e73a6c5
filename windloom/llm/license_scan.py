"""Operator 4: license scan by ordered signature rules, in DataFrame functions only.

A text is reduced to its words, joined by single spaces. A keyword prefilter lets most texts pass untouched; on the rest
each rule whose own keyword occurs is matched as a regular expression over whole words, giving word intervals. A
detection gives way to one of higher priority that contains its interval, and to a longer one of equal priority. Three
base phrases are matched on their own and never give way.

Everything happens within a row: no shuffle, no gathering, rows without or with equal doc_id are no special case.

Defined results: a null, empty or wordless text has no words, no labels, score 0, null first and last word; very long texts
are scanned whole; repeated rows and rows of one or no doc_id get their own text's result; of detections of one interval
and priority all stand; an empty table gives an empty one; other input columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Phrases that count as base places, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Hand-written names: label, keyword that any match contains, regular expression over space-joined lower-case words.
NAMES = [
    ("apache-1.1", "apache", "apache (?:software )?licen[sc]e(?: version)? 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?licen[sc]e(?: version)? 2(?: 0)?|apache 2 0"),
    ("mit", "mit licen", "(?:the )?mit licen[sc]e"),
    ("mit", "expat licen", "(?:the )?expat licen[sc]e"),
    ("x11", "x11 licen", "x11 licen[sc]e"),
    ("isc", "isc licen", "isc licen[sc]e"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?"),
    ("bsd", "bsd licen", "bsd licen[sc]e"),
    ("bsd", "bsd style licen", "bsd style licen[sc]e"),
    ("gpl-1.0", "gpl", "gpl v?1(?: 0)?"),
    ("gpl-2.0", "gpl", "gpl ?v?2(?: 0)?(?: only| or later)?|gplv2"),
    ("gpl-3.0", "gpl", "gpl ?v?3(?: 0)?(?: only| or later)?|gplv3"),
    ("gpl-2.0", "general public licen", "(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?"),
    ("gpl-3.0", "general public licen", "(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?"),
    ("gpl-any", "gnu general public licen", "gnu general public licen[sc]e"),
    ("lgpl-2.1", "lgpl", "lgpl ?v?2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", "lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-any", "lesser general public licen", "(?:gnu )?lesser general public licen[sc]e(?:(?: version| v)? [23](?: [01])?)?"),
    ("agpl-3.0", "agpl", "agpl ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl-any", "affero general public licen", "(?:gnu )?affero general public licen[sc]e(?:(?: version| v)? 3(?: 0)?)?"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e(?: version| v)? 1 1"),
    ("mpl-1.1", "mpl 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("epl-1.0", "eclipse public", "eclipse public licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("epl-2.0", "eclipse public", "eclipse public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("cddl-1.0", "common development", "common development and distribution licen[sc]e(?:(?: version| v)? 1(?: 0)?)?"),
    ("eupl-1.2", "european union public", "european union public licen[sc]e(?:(?: version| v)? 1 2)?"),
    ("cc-by-3.0", "cc by 3", "cc by 3 0(?: unported)?"),
    ("cc-by-4.0", "cc by 4", "cc by 4 0(?: international)?"),
    ("cc-by-sa-3.0", "cc by sa", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "cc by nd", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", "cc by nc sa(?: 4 0)?"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", "cc by nc nd(?: 4 0)?"),
    ("cc-by-any", "creative commons attribution", "creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?"),
    ("cc-by-sa-any", "creative commons attribution", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?"),
    ("cc-by-nc-any", "creative commons attribution", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: v?2)?"),
    ("zlib", "zlib licen", "zlib licen[sc]e"),
    ("zlib", "zlib libpng licen", "zlib libpng licen[sc]e"),
    ("bsl-1.0", "boost software licen", "boost software licen[sc]e(?:(?: version| v)? 1(?: 0)?)?"),
    ("artistic-2.0", "artistic licen", "artistic licen[sc]e(?:(?: version| v)? 2(?: 0)?)?"),
    ("ofl-1.1", "open font licen", "(?:sil )?open font licen[sc]e(?:(?: version| v)? 1 1)?"),
    ("ms-pl", "microsoft public licen", "microsoft public licen[sc]e"),
    ("psf-2.0", "python software foundation licen", "python software foundation licen[sc]e(?: version 2)?"),
    ("php-3.01", "php licen", "php licen[sc]e(?:(?: version| v)? 3 01)?"),
    ("postgresql", "postgresql licen", "postgresql licen[sc]e"),
    ("ncsa", "ncsa open source licen", "(?:university of illinois )?ncsa open source licen[sc]e"),
    ("afl-3.0", "academic free licen", "academic free licen[sc]e(?:(?: version| v)? 3(?: 0)?)?"),
    ("osl-3.0", "open software licen", "open software licen[sc]e(?:(?: version| v)? 3(?: 0)?)?"),
    ("ecl-2.0", "educational community licen", "educational community licen[sc]e(?:(?: version| v)? 2(?: 0)?)?"),
    ("odbl-1.0", "open database licen", "open database licen[sc]e"),
    ("odbl-1.0", "odbl", "odbl"),
    ("public-domain", "public domain", "(?:in|into|to) the public domain"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
]

#: Hand-written signatures of license texts and notices: label, keyword that any match contains, pattern. They stand alone.
CLAUSES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission notice shall be included", "(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit-0", "deal in the software without restriction", "deal in the software without restriction including without limitation the rights to use copy modify merge"),
    ("x11", "x consortium shall", "(?:the )?name of the x consortium shall not be used in advertising"),
    ("isc", "permission to use copy modify", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "zero clause", "(?:bsd )?zero clause (?:bsd )?licen[sc]e"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote products", "(?:may|must not) be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("warranty-disclaimer", "provided as is", "(?:the )?software is provided as is without warranty of any kind"),
    ("warranty-disclaimer", "without any warranty", "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("warranty-disclaimer", "in no event shall", "in no event shall the (?:authors?|copyright holders?|regents)(?: or (?:contributors|copyright holders))? be liable"),
    ("apache-2.0", "you may not use this file except", "you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", "obtain a copy of the licen", "you may obtain a copy of the licen[sc]e at http(?:s)? www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e"),
    ("apache-2.0", "grant of patent licen", "grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor"),
    ("gpl-any", "you can redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-any", "received a copy of the gnu general public", "you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl-2.0", "51 franklin", "free software foundation inc 51 franklin (?:street|st) fifth floor boston"),
    ("gpl-2.0", "59 temple place", "free software foundation inc 59 temple place suite 330 boston"),
    ("gpl-3.0", "any later version", "either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl-2.0", "any later version", "either version 2 of the licen[sc]e or at your option any later version"),
    ("lgpl-2.1", "any later version", "either version 2 1 of the licen[sc]e or at your option any later version"),
    ("gpl-linking-exception", "as a special exception", "as a special exception the copyright holders? (?:of this library )?give you permission to link"),
    ("gpl-classpath-exception", "classpath", "(?:gnu )?classpath exception"),
    ("gcc-exception-3.1", "runtime library exception", "(?:gcc )?runtime library exception(?: version)?(?: 3 1)?"),
    ("lgpl-any", "library general public", "(?:gnu )?library general public licen[sc]e(?:(?: version| v)? 2(?: 0)?)?"),
    ("agpl-any", "remote network interaction", "remote network interaction use with the gnu general public licen[sc]e"),
    ("gfdl-1.3", "free documentation licen", "(?:gnu )?free documentation licen[sc]e(?: version| v)? 1 3"),
    ("gfdl-any", "free documentation licen", "(?:gnu )?free documentation licen[sc]e"),
    ("mpl-2.0", "subject to the terms of the mozilla", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-any", "mozilla public licen", "mozilla public licen[sc]e"),
    ("npl-1.1", "netscape public", "netscape public licen[sc]e(?:(?: version| v)? 1 [01])?"),
    ("epl-any", "eclipse public licen", "eclipse public licen[sc]e"),
    ("edl-1.0", "eclipse distribution licen", "eclipse distribution licen[sc]e(?:(?: version| v)? 1 0)?"),
    ("cpl-1.0", "common public licen", "common public licen[sc]e(?:(?: version| v)? 1 0)?"),
    ("ipl-1.0", "ibm public licen", "ibm public licen[sc]e(?:(?: version| v)? 1 0)?"),
    ("cddl-any", "cddl", "cddl(?: 1 [01])?"),
    ("cpal-1.0", "common public attribution", "common public attribution licen[sc]e(?:(?: version| v)? 1 0)?"),
    ("eupl-any", "eupl", "eupl(?: v?1 [012])?"),
    ("cecill-2.1", "cecill", "cecill(?: free software)?(?: licen[sc]e)?(?:(?: version| v)? 2 1)?"),
    ("cecill-b", "cecill b", "cecill b(?: licen[sc]e)?"),
    ("cecill-c", "cecill c", "cecill c(?: licen[sc]e)?"),
    ("artistic-1.0", "artistic licen", "artistic licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("perl", "same terms as perl", "under the same terms as perl itself"),
    ("ruby", "ruby licen", "(?:the )?ruby licen[sc]e"),
    ("psf-2.0", "psf licen", "psf licen[sc]e agreement"),
    ("zpl-2.1", "zope public", "zope public licen[sc]e(?:(?: version| v)? 2 1)?"),
    ("w3c", "w3c software", "w3c software (?:notice and )?(?:and document )?licen[sc]e"),
    ("openssl", "openssl licen", "openssl licen[sc]e"),
    ("openssl", "openssl toolkit", "software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "ssleay licen", "(?:original )?ssleay licen[sc]e"),
    ("curl", "curl licen", "curl licen[sc]e"),
    ("libpng-2.0", "png reference library licen", "png reference library licen[sc]e(?: version 2)?"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software", "(?:the )?origin of this software must not be misrepresented"),
    ("ijg", "independent jpeg group", "based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", "(?:the )?freetype (?:project )?licen[sc]e"),
    ("imagemagick", "imagemagick licen", "imagemagick licen[sc]e"),
    ("unicode", "unicode licen", "unicode licen[sc]e (?:agreement|v3)"),
    ("icu", "icu licen", "icu licen[sc]e(?: icu 1 8 1 and later)?"),
    ("ntp", "ntp licen", "ntp licen[sc]e"),
    ("hpnd", "historical permission notice", "historical permission notice and disclaimer"),
    ("naist-2003", "nara institute", "nara institute of science and technology"),
    ("bsl-1.1", "business source licen", "business source licen[sc]e(?:(?: version| v)? 1 1)?"),
    ("sspl-1.0", "server side public", "server side public licen[sc]e(?:(?: version| v)? 1)?"),
    ("elastic-2.0", "elastic licen", "elastic licen[sc]e(?: 2 0)?"),
    ("commons-clause", "commons clause", "commons clause licen[sc]e condition"),
    ("polyform-nc-1.0.0", "polyform noncommercial licen", "polyform noncommercial licen[sc]e(?: 1 0 0)?"),
    ("polyform-small-business-1.0.0", "polyform small business licen", "polyform small business licen[sc]e"),
    ("upl-1.0", "universal permissive licen", "universal permissive licen[sc]e(?:(?: version| v)? 1 0)?"),
    ("blueoak-1.0.0", "blue oak model licen", "blue oak model licen[sc]e(?: 1 0 0)?"),
    ("mulan-psl-2.0", "mulan psl", "mulan psl ?v2"),
    ("wtfpl", "want to public licen", "do what the fuck you want to public licen[sc]e"),
    ("beerware", "beer ware licen", "(?:the )?beer ware licen[sc]e"),
    ("json", "good not evil", "(?:the )?software shall be used for good not evil"),
    ("unlicense", "released into the public domain", "free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived all copyright", "waived all copyright and related or neighbou?ring rights"),
    ("pddl-1.0", "public domain dedication", "(?:open data commons )?public domain dedication and licen[sc]e"),
    ("odc-by-1.0", "open data commons attribution", "open data commons attribution licen[sc]e"),
    ("cdla-permissive-2.0", "community data licen", "community data licen[sc]e agreement permissive(?: (?:version )?2 0)?"),
    ("cdla-sharing-1.0", "community data licen", "community data licen[sc]e agreement sharing(?: (?:version )?1 0)?"),
    ("ogl-uk-3.0", "open government licen", "open government licen[sc]e(?:(?: version| v)? ?3(?: 0)?)?"),
    ("etalab-2.0", "licence ouverte", "(?:etalab )?licence ouverte(?: open licen[sc]e)?"),
    ("etalab-2.0", "etalab", "etalab(?: 2 0)?"),
    ("dl-de-by-2.0", "datenlizenz deutschland", "datenlizenz deutschland namensnennung(?: version 2 0)?"),
    ("cc-by-nd-any", "creative commons attribution", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: licen[sc]e)?"),
    ("cc-by-nc-sa-any", "creative commons attribution", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: licen[sc]e)?"),
    ("cc-by-nc-nd-any", "creative commons attribution", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: licen[sc]e)?"),
    ("cc-by-sa-any", "creativecommons org licen", "creativecommons org licenses by sa"),
    ("cc-by-nc-any", "creativecommons org licen", "creativecommons org licenses by nc"),
    ("cc-by-any", "creativecommons org licen", "creativecommons org licenses by"),
    ("openrail-m", "openrail", "(?:bigscience |creativeml )?(?:bloom )?openrail ?m?"),
    ("llama-community", "community licen", "llama [23](?: [0-9])? community licen[sc]e(?: agreement)?"),
    ("ofl-1.1", "reserved font name", "with reserved font name"),
    ("gust-font", "gust font licen", "gust font licen[sc]e"),
    ("bitstream-vera", "bitstream vera", "bitstream vera (?:fonts )?copyright"),
    ("lppl-1.3c", "latex project public", "latex project public licen[sc]e(?:(?: version| v)? 1 3c?)?"),
    ("sleepycat", "sleepycat", "sleepycat (?:public )?licen[sc]e"),
    ("vim", "vim licen", "vim licen[sc]e"),
    ("tcl", "tcl tk licen", "tcl tk licen[sc]e"),
    ("nokia-qt", "q public licen", "q public licen[sc]e(?: version)?(?: 1 0)?"),
    ("rpl-1.5", "reciprocal public", "reciprocal public licen[sc]e(?:(?: version| v)? 1 5)?"),
    ("ms-rl", "microsoft reciprocal licen", "microsoft reciprocal licen[sc]e"),
    ("watcom-1.0", "sybase open watcom public", "sybase open watcom public licen[sc]e"),
    ("apsl-2.0", "apple public source", "apple public source licen[sc]e(?:(?: version| v)? 2(?: 0)?)?"),
    ("nasa-1.3", "nasa open source", "nasa open source agreement(?: version)?(?: 1 3)?"),
    ("intel", "intel simplified software licen", "intel simplified software licen[sc]e"),
    ("oracle-bcl", "oracle binary code", "oracle binary code licen[sc]e agreement"),
    ("sun-bcl", "sun microsystems inc binary", "sun microsystems inc binary code licen[sc]e agreement"),
    ("eula", "end user licen", "end user licen[sc]e agreement"),
    ("proprietary", "trade secret", "(?:confidential|proprietary) (?:and )?trade secret(?:s)?"),
    ("proprietary", "unauthori", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this (?:file|software|document))?(?: via any medium)? is strictly prohibited"),
    ("proprietary", "may not be reproduced", "may not be reproduced(?: or transmitted)? in any form"),
    ("reserved-rights", "some rights reserved", "some rights reserved"),
    ("no-commercial-use", "commercial use", "(?:for )?non ?commercial use only|not for commercial use"),
    ("academic-use", "research purposes only", "(?:for )?(?:academic|non commercial) research purposes only"),
    ("dual-license", "dual licen", "dual licen[sc]ed under"),
    ("see-license", "see the licen", "see the licen[sc]e file(?: for details| for more information)?"),
    ("copyright", "copyrighted", "copyrighted (?:material|work)"),
]
CLAUSE_RANK = (4, 0.9)

#: SPDX identifiers: label, pattern after "spdx license identifier".
SPDX = [
    *[(label, label.replace("-", " ").replace(".", " ")) for label in (
        "apache-1.1 apache-2.0 mit mit-0 x11 isc bsd-2-clause bsd-3-clause bsd-4-clause mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 eupl-1.2 "
        "cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 cc0-1.0 unlicense wtfpl zlib "
        "bsl-1.0 artistic-2.0 ofl-1.1 ms-pl psf-2.0 php-3.01 postgresql ncsa afl-3.0 osl-3.0 ecl-2.0 odbl-1.0").split()],
    *[(f"{kind}-{version}", f"{kind} {version.replace('.', ' ')}(?: only| or later)?") for kind, version in (("gpl", "1.0"), ("gpl", "2.0"), ("gpl", "3.0"), ("lgpl", "2.1"), ("lgpl", "3.0"), ("agpl", "3.0"))],
]

#: Ways in which a name is stated: pattern around it, priority, confidence.
FORMS = [
    ("{}", 1, 0.6),
    ("copy of (?:the )?(?:{})", 2, 0.8),
    ("(?:subject to|governed by) (?:the )?(?:terms of )?(?:the )?(?:{})", 3, 0.9),
    ("(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:{})", 4, 0.95),
    ("spdx license identifier (?:{})", 5, 1.0),
]
SPDX_FORM = ("spdx license identifier", *FORMS[-1][1:])

#: A text without any of these holds no keyword of any rule.
GATES = ["licen", "gpl", "cc by", "cc0", "bsd", "apache", "mozilla", "public", "creative commons", "copyright", "rights reserved", "proprietary", "wtfpl", "common development", "mpl 1 1", "odbl", "permission", "redistribution", "warranty", "without", "provided as is", "shall", "advertising materials", "franklin", "temple place", "later version", "special exception", "classpath", "remote network", "library exception", "cddl", "eupl", "cecill", "same terms", "openssl toolkit", "altered source", "misrepresented", "origin of this", "jpeg group", "zero clause", "nara institute", "commons clause", "good not evil", "etalab", "freetype", "sleepycat", "applicable law", "datenlizenz", "openrail", "font name", "bitstream", "open source agreement", "nasa open", "oracle binary", "binary", "trade secret", "unauthori", "reproduced", "commercial use", "research purposes", "historical", "mulan", "modify", "restriction", "endorse", "file except", "open data commons", "w3c software"]

_NON_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"  # no word holds them


def rules() -> list[tuple[str, str, str, int, float]]:
    """label, keyword, pattern, priority, confidence of every rule: each name in each form, in that order, SPDX identifiers, signatures."""
    phrase, *rank = SPDX_FORM
    assert all(any(g in keyword for g in GATES) for keyword in (phrase, *(keyword for _, keyword, _ in (*NAMES, *CLAUSES))))
    named = [(label, keyword, form.format(name if form != "{}" else f"(?:{name})"), priority, confidence) for form, priority, confidence in FORMS for label, keyword, name in NAMES]
    spdx = [(label, phrase, f"{phrase} {pattern}", *rank) for label, pattern in SPDX]
    return named + spdx + [(label, keyword, pattern, *CLAUSE_RANK) for label, keyword, pattern in CLAUSES]


def whole_words(pattern: str) -> str:
    """ASCII letters in either case, at word boundaries of space-joined words."""
    return f"(?i)(?<= )(?:{pattern})(?= )"


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ ]+"))


def places(padded: Column, pattern: Column) -> Column:
    """The (start, end) word intervals of a pattern's matches, in order."""
    cut = F.split(F.regexp_replace(padded, pattern, F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN)
    begin = F.struct(count_words(cut[0]).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        inside = count_words(F.substring_index(part, _CLOSE, 1))
        return F.struct((state["at"] + count_words(F.translate(part, _CLOSE, " "))).cast("long").alias("at"), F.concat(state["found"], F.array(F.struct(state["at"].alias("start"), (state["at"] + inside).cast("long").alias("end")))).alias("found"))

    return F.aggregate(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), begin, step)["found"]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (intervals and labels) and detections (label, priority, confidence, start, end) that stand."""
    words = F.trim(F.regexp_replace(text_or_empty(), _NON_WORD, " "))
    rows = docs.select("doc_id", words.alias("words"))
    n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    low = F.lower("words")
    gate = F.lit(False)
    for g in GATES:
        gate |= F.contains(low, F.lit(g))
    rows = rows.select("doc_id", n_words.cast("long").alias("n_words"), F.when(gate, F.concat(F.lit(" "), "words", F.lit(" "))).alias("padded"), F.when(gate, F.concat(F.lit(" "), low, F.lit(" "))).alias("low"))

    def base_places(phrase: str, label: str) -> Column:
        found = F.transform(places(F.col("padded"), F.lit(whole_words(phrase))), lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(F.contains(F.col("low"), F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<struct<label:string,start:long,end:long>>"))

    base = F.flatten(F.array(*[base_places(p, label) for p, label in BASE.items()]))
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(whole_words(pattern)).alias("pattern"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence")) for label, keyword, pattern, priority, confidence in rules()])
    alive = F.filter(table, lambda r: F.contains(F.col("low"), r["keyword"]))
    found = F.flatten(F.transform(alive, lambda r: F.transform(places(F.col("padded"), r["pattern"]), lambda s: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), s["start"].alias("start"), s["end"].alias("end")))))
    rows = rows.select("doc_id", "n_words", F.when(F.col("padded").isNotNull(), base).alias("base"), F.when(F.col("padded").isNotNull(), found).alias("found"))

    def stands(d: Column) -> Column:
        longer = lambda e: (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (e["end"] - e["start"] > d["end"] - d["start"]))
        return ~F.exists("found", lambda e: (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & longer(e))

    return rows.select("doc_id", "n_words", F.coalesce("base", F.array().cast("array<struct<label:string,start:long,end:long>>")).alias("base"), F.coalesce(F.array_distinct(F.filter("found", stands)), F.array().cast("array<struct<label:string,priority:int,confidence:double,start:long,end:long>>")).alias("detections"))


def labels(scanned: DataFrame) -> DataFrame:
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    sure = F.greatest(F.coalesce(F.array_max(F.col("detections")["confidence"]), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base")["start"]).alias("first_word"),
        F.array_max(F.col("base")["start"]).alias("last_word"),
        listed(F.col("base")["label"]).alias("base_labels"),
        listed(F.concat(F.col("base")["label"], F.col("detections")["label"])).alias("labels"),
        sure.alias("score"),
    )
