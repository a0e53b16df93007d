"""Licence recognition by sentences and ordered rules.

A text loses its comment and list markers and is cut into pieces at full stops and line feeds; a
sentence is a run of pieces, as lines may be wrapped. Each sentence is normalised (case, signs, and
the ways to say "this work is licensed under the ...") and mapped to the identifier of the known
licence sentence it equals, the longest run first. The sequence of identifiers is then matched
against licence rules in order: a rule takes the identifiers it matches, so that a longer text comes
before what its parts alone would mean. SPDX tags name their licences themselves, as an expression. "All
rights reserved" is no licence where another one is found. Everything is an
expression over the row: nothing is shuffled or sent to Python, and texts without a licence word
are passed by after one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences by identifier. Variable parts are not in them.
SENTENCES: dict[str, list[str]] = {
    "ApacheRef": [
        "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "licensed under the apache license 2 0", "licensed under the apache 2 0 license",
        "apache license version 2 0", "apache license version 2 0 january 2004", "apache license 2 0",
    ],
    "ApacheHead": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "ApacheAsIs": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied"
    ],
    "ApacheSee": ["see the license for the specific language governing permissions and limitations under the license"],
    "MITRef": ["licensed under the mit license", "mit license", "the mit license", "the mit license mit"],
    "MITGrant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
        "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "MITNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MITAsIs": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness "
        "for a particular purpose and noninfringement"
    ],
    "ISCGrant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
        "notice and this permission notice appear in all copies"
    ],
    "BSDGrant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSDSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSDBinary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution"
    ],
    "BSDNames": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission"
    ],
    "BSD2Ref": ["licensed under the bsd 2 clause license", "bsd 2 clause license", "licensed under the simplified bsd license"],
    "BSD3Ref": ["licensed under the bsd 3 clause license", "bsd 3 clause license", "licensed under the new bsd license", "licensed under the revised bsd license"],
    "ISCRef": ["licensed under the isc license", "isc license"],
    "GPLFree": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version"
    ],
    "GPL2Free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 2 of the license or at your option any later version"
    ],
    "GPL3Ref": ["licensed under the gnu general public license version 3", "licensed under the gnu gpl version 3", "licensed under the gpl version 3", "gnu general public license version 3 29 june 2007"],
    "GPL2Ref": ["licensed under the gnu general public license version 2", "licensed under the gnu gpl version 2", "licensed under the gpl version 2", "gnu general public license version 2 june 1991"],
    "GPL3Only": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"],
    "GPL2Only": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    ],
    "LGPL21Free": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
        "software foundation either version 2 1 of the license or at your option any later version"
    ],
    "LGPL3Free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version"
    ],
    "LGPL3Ref": ["licensed under the gnu lesser general public license version 3", "licensed under the gnu lgpl version 3", "licensed under the lgpl version 3", "gnu lesser general public license version 3 29 june 2007"],
    "LGPL21Ref": ["licensed under the gnu lesser general public license version 2 1", "licensed under the gnu lgpl version 2 1", "licensed under the lgpl version 2 1", "gnu lesser general public license version 2 1 february 1999"],
    "AGPL3Free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version"
    ],
    "AGPL3Ref": ["licensed under the gnu affero general public license version 3", "licensed under the gnu agpl version 3", "licensed under the agpl version 3", "gnu affero general public license version 3 19 november 2007"],
    "GPLHope": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
        "fitness for a particular purpose"
    ],
    "GPLSee": ["see the gnu general public license for more details"],
    "LGPLSee": ["see the gnu lesser general public license for more details"],
    "AGPLSee": ["see the gnu affero general public license for more details"],
    "BoostGrant": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use "
        "reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all "
        "subject to the following"
    ],
    "BoostRef": ["licensed under the boost software license version 1 0", "boost software license version 1 0", "boost software license version 1 0 august 17th 2003"],
    "ZlibAsIs": ["this software is provided as is without any express or implied warranty"],
    "ZlibLiable": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "ZlibGrant": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
    ],
    "ZlibRef": ["licensed under the zlib license", "zlib license"],
    "ZeroGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "ZeroRef": ["licensed under the zero clause bsd license", "zero clause bsd license", "bsd zero clause license"],
    "EPL2": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        "licensed under the eclipse public license 2 0", "licensed under the eclipse public license version 2 0", "licensed under the eclipse public license v 2 0", "eclipse public license v 2 0",
    ],
    "EPL1": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at "
        "http www eclipse org legal epl v10 html",
        "licensed under the eclipse public license 1 0", "licensed under the eclipse public license version 1 0", "licensed under the eclipse public license v1 0", "eclipse public license v 1 0",
    ],
    "CDDL1": ["licensed under the common development and distribution license version 1 0", "licensed under the cddl 1 0", "common development and distribution license cddl version 1 0"],
    "Artistic2": ["licensed under the artistic license 2 0", "the artistic license 2 0", "artistic license 2 0"],
    "EUPL12": ["licensed under the eupl 1 2", "licensed under the eupl", "licensed under the european union public license version 1 2", "european union public license v 1 2"],
    "MSPL": ["licensed under the microsoft public license", "licensed under the ms pl", "microsoft public license ms pl"],
    "OFL11": ["this font software is licensed under the sil open font license version 1 1", "licensed under the sil open font license version 1 1", "sil open font license version 1 1 26 february 2007"],
    "WTFPL": ["do what the fuck you want to public license", "licensed under the wtfpl", "licensed under the do what the fuck you want to public license"],
    "PSF2": ["licensed under the python software foundation license version 2", "python software foundation license version 2"],
    "MPLHead": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "mozilla public license version 2 0"],
    "CCBY": ["licensed under the cc by 4 0", "licensed under the creative commons attribution 4 0 international license"],
    "CCBYSA": ["licensed under the cc by sa 4 0", "licensed under the creative commons attribution sharealike 4 0 international license"],
    "CCBYNC": ["licensed under the cc by nc 4 0", "licensed under the creative commons attribution noncommercial 4 0 international license"],
    "CCBYND": ["licensed under the cc by nd 4 0", "licensed under the creative commons attribution noderivatives 4 0 international license"],
    "CC0": ["licensed under the cc0 1 0", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "AllRights": ["all rights reserved"],
}
# Licence rules in order; a pattern is a sequence of identifiers.
RULES: list[tuple[str, str]] = [
    ("Apache-2.0", "ApacheHead ApacheCopy ApacheAsIs ApacheSee"),
    ("BSD-3-Clause", "BSDGrant BSDSource BSDBinary BSDNames"),
    ("BSD-2-Clause", "BSDGrant BSDSource BSDBinary"),
    ("MIT", "MITGrant MITNotice MITAsIs"),
    ("GPL-3.0-or-later", "GPLFree GPLHope GPLSee"),
    ("GPL-2.0-or-later", "GPL2Free GPLHope GPLSee"),
    ("GPL-3.0-only", "GPL3Only GPLHope GPLSee"),
    ("GPL-2.0-only", "GPL2Only GPLHope GPLSee"),
    ("LGPL-2.1-or-later", "LGPL21Free GPLHope LGPLSee"),
    ("LGPL-3.0-or-later", "LGPL3Free GPLHope LGPLSee"),
    ("AGPL-3.0-or-later", "AGPL3Free GPLHope AGPLSee"),
    ("Zlib", "ZlibAsIs ZlibLiable ZlibGrant"),
    ("BSD-1-Clause", "BSDGrant BSDSource"),
    ("MIT", "MITGrant"),
    ("ISC", "ISCGrant"),
    ("0BSD", "ZeroGrant"),
    ("BSL-1.0", "BoostGrant"),
    ("Zlib", "ZlibGrant"),
    ("GPL-3.0-or-later", "GPLFree"),
    ("GPL-2.0-or-later", "GPL2Free"),
    ("GPL-3.0-only", "GPL3Only"),
    ("GPL-2.0-only", "GPL2Only"),
    ("LGPL-2.1-or-later", "LGPL21Free"),
    ("LGPL-3.0-or-later", "LGPL3Free"),
    ("AGPL-3.0-or-later", "AGPL3Free"),
    ("LicenseRef-BSD", "BSDGrant"),
    ("Apache-2.0", "ApacheHead"),
    ("Apache-2.0", "ApacheRef"),
    ("MIT", "MITRef"),
    ("ISC", "ISCRef"),
    ("BSD-3-Clause", "BSD3Ref"),
    ("BSD-2-Clause", "BSD2Ref"),
    ("GPL-3.0-only", "GPL3Ref"),
    ("GPL-2.0-only", "GPL2Ref"),
    ("LGPL-2.1-only", "LGPL21Ref"),
    ("LGPL-3.0-only", "LGPL3Ref"),
    ("AGPL-3.0-only", "AGPL3Ref"),
    ("MPL-2.0", "MPLHead"),
    ("EPL-2.0", "EPL2"),
    ("EPL-1.0", "EPL1"),
    ("BSL-1.0", "BoostRef"),
    ("Zlib", "ZlibRef"),
    ("0BSD", "ZeroRef"),
    ("CDDL-1.0", "CDDL1"),
    ("Artistic-2.0", "Artistic2"),
    ("EUPL-1.2", "EUPL12"),
    ("MS-PL", "MSPL"),
    ("OFL-1.1", "OFL11"),
    ("WTFPL", "WTFPL"),
    ("PSF-2.0", "PSF2"),
    ("CC-BY-SA-4.0", "CCBYSA"),
    ("CC-BY-NC-4.0", "CCBYNC"),
    ("CC-BY-ND-4.0", "CCBYND"),
    ("CC-BY-4.0", "CCBY"),
    ("CC0-1.0", "CC0"),
    ("Unlicense", "Unlicense"),
    ("All-rights-reserved", "AllRights"),
]
#: Every known sentence and tag holds one of these, in any case.
LICENCE_WORDS = "licen|copyright|held liable|permission|redistribut|warrant|public domain|all rights reserved|free software|font software|eupl|wtfpl|cddl|ms-pl|lgpl|agpl"
#: A piece that holds one of these and is part of no known sentence is an unknown licence sentence.
UNKNOWN_WORDS = "licen|copyright|permission is (?:hereby )?granted|redistribution and use|is free software|public domain"
#: A rule of this name is a notice, no licence, where another licence is found.
NOTICE = "All-rights-reserved"
#: Marks at the start of a line: of comments, list items and quotes.
MARKERS = r"(?m)^[ \t]*(?:(?:/\*+|\*+/|\*|//+|#+|--|;+|>|<!--|-->|-|\u2022|\(?[0-9a-z][.)])(?=[ \t]|$)[ \t]*)+"
#: Pieces end after a full stop, at line feeds, and where another thing's licence is named in the same sentence.
PIECE_END = r"(?i)(?<=[.!?])\s+|\s*\n\s*|(?:[,;]\s+|\s)(?:and|while|but)\s+(?=(?:the|this|our|all)\s+(?:\w+\s+){1,3}?(?:(?:is|are)\s+(?:\w+\s+)?(?:licensed|released|distributed|published)|under)\s)"
#: Pieces that a sentence may be wrapped to.
WRAPPED = 10
_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?\)*"
#: A tag and its expression: identifiers joined by AND, OR and WITH.
TAG = rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"
#: Ways to say the same, on normalised sentences.
UNDER = r"^(?:(?:this|the|our|all) (?:\w+ ){1,3}(?:is|are) )?(?:(?:dual |made |also )?(?:licensed|released|distributed|available|provided|published) under|(?:this|the|our|all) \w+ under) (?:the |a |an )?(?:terms of )?(?:the )?"
SEE = r" see (?:the )?license(?: file)?(?: in [a-z ]+| for (?:more |further |full |the )*(?:details|information|terms|text))?\z"
NAMES = r"^neither the name of .{1,100}? nor the names of its contributors"


def normalised(sentence: Column) -> Column:
    """Lower case, and one space for each run of other characters than letters and digits."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def canonical(sentence: Column) -> Column:
    """A normalised sentence in the words of the table."""
    plain = F.regexp_replace(F.replace(sentence, F.lit("licence"), F.lit("license")), UNDER, "licensed under the ")
    plain = F.regexp_replace(F.replace(plain, F.lit("this library is distributed in the hope"), F.lit("this program is distributed in the hope")), r"^copyright (?:c )?[0-9].{0,200}? (?=all rights reserved\z)", "")
    return F.regexp_replace(F.regexp_replace(plain, SEE, ""), NAMES, "neither the name of the copyright holder nor the names of its contributors")


def expression(tag: Column) -> Column:
    """A tag's expression with single spaces, without brackets around the whole of it."""
    plain = F.regexp_replace(tag, r"\s+", " ")
    return F.regexp_replace(plain, r"^\(([^()]*)\)\z", "$1")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, license (the found ones in rule order, then tags, joined by a comma; UNKNOWN where only
    unrecognised licence sentences stand; NONE), sentence_ids (in text order), n_known and n_unknown.

    n_known counts recognised sentences and tags, n_unknown pieces that speak of licences or copyright
    and belong to none. Null and empty texts have none; repeated rows give repeated results; a very long
    text is an array of its pieces within its row; an empty table gives no rows. Other columns, of any
    name, are not read.
    """
    words = F.lit(f"(?i){LICENCE_WORDS}")
    none = F.array().cast("array<string>")
    known = F.create_map(*[F.lit(x) for i, sentences in SENTENCES.items() for s in sentences for x in (s, i)])
    starts = F.lit(UNDER.replace("^", "^(?:", 1) + ")|^(?:" + "|".join(sorted({" ".join(s.split()[:2]) for group in SENTENCES.values() for s in group})) + r")\b")
    found = docs.select(F.col(key).alias("k"), F.when(F.regexp(F.col(text), words), F.col(text)).alias("t"))
    pieces = F.when(F.col("t").isNotNull(), F.filter(F.transform(F.split(F.regexp_replace("t", MARKERS, ""), PIECE_END), normalised), lambda p: p != "")).otherwise(none)
    found = found.select("k", F.coalesce(F.transform(F.regexp_extract_all("t", F.lit(TAG), 1), expression), none).alias("tags"), pieces.alias("p"))

    def sentence(piece: Column, i: Column) -> Column:
        """The known sentence that begins here, of as many pieces as it can have."""
        runs = [F.array_join(F.slice("p", i + 1, n), " ") for n in range(WRAPPED, 0, -1)]
        fits = [F.when(F.element_at(known, canonical(r)).isNotNull(), F.struct(F.element_at(known, canonical(r)).alias("id"), F.least(F.lit(n), F.size("p") - i).alias("n"))) for n, r in zip(range(WRAPPED, 0, -1), runs, strict=True)]
        return F.when(F.regexp(piece, starts), F.coalesce(*fits))

    found = found.withColumn("hits", F.transform("p", sentence))
    inside = lambda j, least=0: F.exists(F.array(*[F.coalesce(F.get("hits", j - back)["n"] > back, F.lit(False)) for back in range(least, WRAPPED)]), lambda x: x)
    unknown = F.filter("p", lambda p, j: p.rlike(UNKNOWN_WORDS) & ~p.rlike("^spdx license identifier") & ~inside(j))
    found = found.select("k", "tags", F.transform(F.filter("hits", lambda h, j: h.isNotNull() & ~inside(j, 1)), lambda h: h["id"]).alias("ids"), F.size(unknown).cast("long").alias("n_unknown"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {pattern} ").alias("pattern")) for name, pattern in RULES])
    start = F.struct(F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("left"), none.alias("names"))
    # identifiers are parted by two spaces, so that each rule's own spaces are taken with it
    pattern = lambda r: F.concat(F.lit(" "), F.replace(F.trim(r["pattern"]), F.lit(" "), F.lit("  ")), F.lit(" "))
    step = lambda acc, r: F.struct(
        F.replace(acc["left"], pattern(r), F.lit("")).alias("left"),
        F.when(F.contains(acc["left"], pattern(r)), F.array_append(acc["names"], r["name"])).otherwise(acc["names"]).alias("names"),
    )
    matched = found.select("k", "ids", "tags", "n_unknown", F.when(F.size("ids") > 0, F.aggregate(rules, start, step)["names"]).otherwise(none).alias("names"))
    names = F.array_distinct(F.concat("names", "tags"))
    names = F.when(F.size(names) > 1, F.filter(names, lambda n: n != NOTICE)).otherwise(names)
    label = F.when(F.size(names) > 0, F.array_join(names, ",")).when(F.col("n_unknown") > 0, "UNKNOWN").otherwise("NONE")
    return matched.select(F.col("k").alias(key), label.alias("license"), F.array_join("ids", ",").alias("sentence_ids"), (F.size("ids") + F.size("tags")).cast("long").alias("n_known"), "n_unknown")
