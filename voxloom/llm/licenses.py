"""Licence scans by sentence rules.

Texts are cut into sentences, sentences are normalised, and the known ones
become identifiers; a licence is found where its rule, an ordered list of
identifiers, occurs in the sequence of a document.  SPDX tags name licences
themselves.  All steps are DataFrame functions on single rows: no shuffle, no
Python on the executors.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences, normalised, and their identifiers.
SENTENCES = {
    "released under the mit license": "MIT-REF",
    "licensed under the mit license": "MIT-REF",
    "this project is licensed under the mit license": "MIT-REF",
    "this software is released under the mit license": "MIT-REF",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT-WARRANTY",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT-LIABILITY",
    "licensed under the apache license version 2 0": "APACHE2-REF",
    "licensed under the apache license version 2 0 the license": "APACHE2-HEAD",
    "you may not use this file except in compliance with the license": "APACHE2-COMPLY",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "APACHE2-URL",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE2-WARRANTY",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE2-LANGUAGE",
    "this work is licensed under the gnu general public license version 3": "GPL3-REF",
    "licensed under the gnu general public license version 3": "GPL3-REF",
    "this work is licensed under the gnu general public license version 2": "GPL2-REF",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPL-HOPE",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GPL-FITNESS",
    "see the gnu general public license for more details": "GPL-DETAILS",
    "you should have received a copy of the gnu general public license along with this program": "GPL-COPY",
    "licensed under cc by nc 4 0": "CC-BY-NC-4-REF",
    "licensed under cc by 4 0": "CC-BY-4-REF",
    "licensed under cc by sa 4 0": "CC-BY-SA-4-REF",
    "this work is licensed under a creative commons attribution 4 0 international license": "CC-BY-4-REF",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CC-BY-NC-4-REF",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CC-BY-SA-4-REF",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-NAME",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-NAME",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2-REF",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2-REF",
    "this source code form is subject to the terms of the mozilla public license version 2 0": "MPL2-REF",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSD-GRANT",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC-WARRANTY",
    "the software is provided as is and isc disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC-WARRANTY",
    "this is free and unencumbered software released into the public domain": "UNLICENSE-REF",
    "this software is provided as is without any express or implied warranty": "ZLIB-WARRANTY",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZLIB-LIABILITY",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB-GRANT",
    "the origin of this software must not be misrepresented": "ZLIB-ORIGIN",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0-GRANT",
    "you should have received a copy of the cc0 public domain dedication along with this software": "CC0-COPY",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2-REF",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2-REF",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at https www eclipse org legal epl 2 0": "EPL2-REF",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "EPL1-REF",
}

#: The licences of the Free Software Foundation, their names and versions.
GNU = {"GPL": ("gnu general public license", ("2", "3")), "LGPL": ("gnu lesser general public license", ("2.1", "3")), "AGPL": ("gnu affero general public license", ("3",))}


def _gnu() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Sentences and rules of the GNU notices, cut where a notice may have a semicolon or a comma."""
    table, rules = {}, []
    for name, (title, versions) in GNU.items():
        grant = f"you can redistribute it and or modify it under the terms of the {title}"
        published = f"{grant} as published by the free software foundation"
        table[published] = f"{name}-GRANT"
        for version in versions:
            v, id_, spdx = version.replace(".", " "), f"{name}{version}", f"{name}-{version}" + ("" if "." in version else ".0")
            for free in ("", "this program is free software ", "this library is free software "):
                table[f"{free}{published} either version {v} of the license or at your option any later version"] = f"{id_}-GRANT-LATER"
                table[f"{free}{published} version {v}"] = table[f"{free}{published} version {v} of the license"] = f"{id_}-GRANT"
                table[f"{free}{grant} version {v} as published by the free software foundation"] = f"{id_}-GRANT"
            table[f"either version {v} of the license or at your option any later version"] = f"GNU{version}-LATER"
            table[f"version {v}"] = table[f"version {v} of the license"] = f"GNU{version}-ONLY"
            rules += [(f"{spdx}-or-later", (f"{id_}-GRANT-LATER",)), (f"{spdx}-or-later", (f"{name}-GRANT GNU{version}-LATER",))]
            rules += [(f"{spdx}-only", (f"{id_}-GRANT",)), (f"{spdx}-only", (f"{name}-GRANT GNU{version}-ONLY",))]
            rules += [(f"{spdx}-only", (f"{id_}-REF",)), (f"{spdx}-or-later", (f"{id_}-REF-LATER",))]
    return table, rules


#: What a sentence of reference calls a licence.
NAMES = {
    "MIT-REF": ("the mit license", "mit license"),
    "APACHE2-REF": ("the apache license version 2 0", "the apache license 2 0", "the apache 2 0 license", "apache 2 0"),
    "MPL2-REF": ("the mozilla public license 2 0", "the mozilla public license version 2 0"),
    "EPL2-REF": ("the eclipse public license 2 0", "the eclipse public license version 2 0"),
    "EPL1-REF": ("the eclipse public license 1 0", "the eclipse public license version 1 0"),
    "CC0-REF": ("cc0 1 0", "cc0", "cc0 1 0 universal", "the cc0 1 0 universal license"),
    "ISC-REF": ("the isc license",),
    "ZLIB-REF": ("the zlib license",),
    "UNLICENSE-REF": ("the unlicense",),
    "BSD2-REF": ("the bsd 2 clause license", "the 2 clause bsd license"),
    "BSD3-REF": ("the bsd 3 clause license", "the 3 clause bsd license"),
    "CC-BY-4-REF": ("cc by 4 0", "a creative commons attribution 4 0 international license"),
    "CC-BY-NC-4-REF": ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-SA-4-REF": ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"),
}
for _name, (_title, _versions) in GNU.items():
    for _v in _versions:
        _said = [f"{t} {n}{_v.replace('.', ' ')}{z}" for t in (f"the {_title}", f"the gnu {_name.lower()}", f"the {_name.lower()}") for n in ("version ", "v") for z in ("", " 0")[: 1 + ("." not in _v)]]
        NAMES[f"{_name}{_v}-REF"] = tuple(_said)
        NAMES[f"{_name}{_v}-REF-LATER"] = tuple(f"{x} {y}" for x in _said for y in ("or later", "or any later version"))
_SUBJECTS = ("", "this work is ", "this project is ", "this software is ", "this program is ")

GNU_SENTENCES, GNU_RULES = _gnu()
SENTENCES |= GNU_SENTENCES
SENTENCES |= {f"{a}{b} under {name}": id_ for id_, names in NAMES.items() for name, a, b in product(names, _SUBJECTS, ("licensed", "released"))}

#: Ordered rules; other known sentences may stand between the named ones, but not where a blank joins two.
RULES = (
    ("MIT", ("MIT-REF",)),
    ("MIT", ("MIT-GRANT", "MIT-NOTICE", "MIT-WARRANTY")),
    ("Apache-2.0", ("APACHE2-REF",)),
    ("Apache-2.0", ("APACHE2-HEAD", "APACHE2-COMPLY", "APACHE2-WARRANTY")),
    *GNU_RULES,
    ("CC-BY-4.0", ("CC-BY-4-REF",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4-REF",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4-REF",)),
    ("BSD-3-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAME")),
    ("BSD-2-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY")),
    ("MPL-2.0", ("MPL2-REF",)),
    ("BSD-3-Clause", ("BSD3-REF",)),
    ("BSD-2-Clause", ("BSD2-REF",)),
    ("ISC", ("ISC-REF",)),
    ("ISC", ("ISC-GRANT", "ISC-WARRANTY")),
    ("0BSD", ("0BSD-GRANT", "ISC-WARRANTY")),
    ("Unlicense", ("UNLICENSE-REF",)),
    ("Zlib", ("ZLIB-REF",)),
    ("Zlib", ("ZLIB-WARRANTY", "ZLIB-GRANT")),
    ("CC0-1.0", ("CC0-REF",)),
    ("CC0-1.0", ("CC0-GRANT",)),
    ("EPL-2.0", ("EPL2-REF",)),
    ("EPL-1.0", ("EPL1-REF",)),
)

#: Every known sentence holds one of these, so texts without any are done at once.
HINT = r"(?i)licen[sc]e|released|copyright|warrant|redistribut|permission|public[\s\p{Punct}]+domain|liable|gnu"
LINE_ENDS = r"\s*\n\s*"

_TERM = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX = rf"(?i:SPDX-License-Identifier):[ \t]*\(*({_TERM}(?:[ \t]*\)*[ \t]+(?:AND|OR|WITH)[ \t]+\(*{_TERM})*)"
SPDX_CUT = r"\s+WITH\s+[A-Za-z0-9.+-]+|[.-]+(?=[\s)]|$)|[()]"


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _known(sentences: Column) -> Column:
    """Identifiers of the known sentences, in order."""
    table = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    return F.filter(F.transform(sentences, lambda s: F.element_at(table, _normal(s))), lambda x: x.isNotNull())


def _tags(text: Column) -> Column:
    """The licences that SPDX tags name, in order; old GNU names are given as the present ones."""
    listed = F.transform(F.regexp_extract_all(text, F.lit(SPDX), 1), lambda x: F.split(F.regexp_replace(x, SPDX_CUT, ""), r"\s+(?:AND|OR)\s+"))
    known = F.create_map(*[F.lit(x) for name in sorted({name for name, _ in RULES}) for x in (name.lower(), name)])
    old = r"(?i)^([AL]?GPL-[0-9.]+)"
    present = lambda x: F.regexp_replace(F.regexp_replace(x, old + r"\+$", "$1-or-later"), old + "$", "$1-only")
    return F.transform(F.flatten(listed), lambda x: F.coalesce(F.element_at(known, F.lower(present(x))), present(x)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids and licenses (sorted, distinct) of every row.

    Sentences end with a mark before white space; as notices are also broken
    over lines or stand on lines of their own, a line is tried as a sentence,
    too, where it differs.  Licences of SPDX tags come last as SPDX:name.  A null text is an empty one and has none; rows are
    judged one by one.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    likely = text.rlike(HINT)
    marks = F.split(text, r"(?<=[.!?;:])\s+|\n\s*\n")
    # pieces of lines: those that the first cut would join to a neighbour
    parts = F.flatten(F.transform(marks, lambda s: F.when(F.instr(s, "\n") > 0, F.concat(F.array(s), F.split(s, LINE_ENDS))).otherwise(F.array(s))))
    tags = F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), _tags(text)).otherwise(none)
    ids = F.concat(_known(parts), F.transform(tags, lambda x: F.concat(F.lit("SPDX:"), x)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(likely, ids).otherwise(none).alias("sentence_ids"))
    listed = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" "))
    found = [F.when(listed.rlike(" " + " (?:.* )?".join(ids) + " "), F.lit(name)) for name, ids in RULES]
    tagged = F.transform(F.filter("sentence_ids", lambda x: x.startswith("SPDX:")), lambda x: F.substring(x, 6, 2**31 - 1))
    names = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*found)), tagged)))
    # the longer BSD rule holds the shorter
    names = F.when(F.array_contains(names, "BSD-3-Clause"), F.array_remove(names, "BSD-2-Clause")).otherwise(names)
    return rows.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, names).otherwise(none).alias("licenses"))
