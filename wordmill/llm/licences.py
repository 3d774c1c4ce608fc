"""Licence statements in texts, with column functions only: known sentences, then ordered rules over their sequence.

A text is cut into sentences at line ends and after closing punctuation. Sentences with a cue word are normalised (small
letters, everything but letters, digits, dots and plus signs as one blank, no dot at the end) and looked up among the known licence
sentences; those that are not known get ``?``, lines that state a copyright get ``copyright``. The identifiers of a
text, in order, are matched against the rules from the most specific to the least; a matched stretch is used up.

Before that, sentences of ``WORDING`` and known ones are found in the whole text, however they are wrapped: between two words may stand
line ends, comment marks and punctuation. They begin at a line or after closing punctuation (at most 200 marks before the first word)
and end likewise. Sentences of a notice that name no licence by themselves (``PLAIN``) are left out.

The SQL has the lines only, so texts with wrapped or full notices are covered by the tests alone.

Every known sentence holds a cue word (tested), so nothing is lost by looking only at sentences that do.

Defined cases: a null or empty text, or one without cue words, has no identifiers and no licences; a statement that occurs more than
once names its licence once; licences are listed in the order of the rules; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUES = ("licen", "copyright", "permission", "redistribut", "warrant", "public domain", "spdx", "as is")
#: Known sentences, normalised. Wording of public licences and of the notices that refer to them.
SENTENCES = {
    "apache2-ref": "licensed under the apache license version 2.0",
    "apache2-see": "you may not use this file except in compliance with the license",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-limits": "see the license for the specific language governing permissions and limitations under the license",
    "mit-ref": "released under the mit license",
    "mit-ref2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl2-ref": "this work is licensed under the gnu general public license version 2",
    "gpl-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-ref": "this library is licensed under the gnu lesser general public license",
    "agpl-ref": "this work is licensed under the gnu affero general public license version 3",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-ref": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "cc-by-nc-ref": "licensed under cc by nc 4.0",
    "cc-by-ref": "licensed under cc by 4.0",
    "cc-by-sa-ref": "licensed under cc by sa 4.0",
    "cc0-ref": "this work is dedicated to the public domain",
    "unlicense-ref": "this is free and unencumbered software released into the public domain",
    "spdx-apache2": "spdx license identifier apache 2.0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-gpl3": "spdx license identifier gpl 3.0 or later",
    "rights": "all rights reserved under copyright law",
}
#: Ordered rules: the first that matches a stretch of identifiers uses it up.
RULES = (
    ("Apache-2.0", ("apache2-ref", "apache2-see", "apache2-asis", "apache2-limits")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-grant", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty")),
    ("Apache-2.0", ("apache2-ref",)),
    ("Apache-2.0", ("spdx-apache2",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref2",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("GPL-3.0-or-later", ("gpl-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("GPL-3.0-or-later", ("spdx-gpl3",)),
    ("LGPL", ("lgpl-ref",)),
    ("AGPL-3.0", ("agpl-ref",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Unlicense", ("unlicense-ref",)),
    ("proprietary", ("rights",)),
)
#: Full sentences of the notices, as they are published, by identifier; an asterisk stands for one to eight words.
WORDING = (
    ("apache2-ref", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("mit-ref2", "This * is licensed under the MIT License"),
    ("mit-ref", "This * is released under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-asis", "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("gpl-grant", "This * is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl2-grant", "This * is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl3-ref", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("gpl2-ref", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("gpl-warranty", "This * is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl-ref", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-ref", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl-ref", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd-names", "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-ref", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-ref", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-ref", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
#: Sentences that belong to a notice and name no licence.
PLAIN = (
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    "This software is provided by * as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "In no event shall * be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage",
    "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "See the GNU General Public License for more details",
    "See the GNU Lesser General Public License for more details",
    "See the GNU Affero General Public License for more details",
    "You should have received a copy of the GNU * License along with this *. If not, see http://www.gnu.org/licenses",
    "You should have received a copy of the GNU * License along with this *. If not, see https://www.gnu.org/licenses",
    "You should have received a copy of the GNU * License along with this *",
)
ENDS = r"[\n\r]+|[.!?;]+[ \t]+"
COPYRIGHT = r"^copyright( c)? [0-9]{4}"
USED = "|"
#: Private character before the identifier of a sentence that was found; in a text it counts as a mark like others.
MARK = "\ue000"


def tag(name: str) -> str:
    return f"<{name}>"


def normal(sentence: Column) -> Column:
    kept = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9.+]+", " "))
    return F.regexp_replace(kept, "[. ]+$", "")


def identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence."""
    known = F.create_map(*[F.lit(x) for name, words in SENTENCES.items() for x in (words, name)])
    return F.coalesce(known[sentence], F.when(sentence.rlike(COPYRIGHT), "copyright").otherwise("?"))


def wrapped(wording: str) -> str:
    """Pattern of a sentence with anything but letters and digits between its words."""
    first, *others = re.findall(r"[a-z0-9]+|\*", wording.lower())
    apart, word = "[^A-Za-z0-9]++", "[A-Za-z0-9]++"
    begin = rf"(?<![A-Za-z0-9]){first}(?<=(?:^|[\n\r]|[.!?;:][^A-Za-z0-9\n\r])[^A-Za-z0-9\n\r]{{0,200}}{first})"
    end = r"(?![A-Za-z0-9])(?=[^A-Za-z0-9\n\r.!?;:]*+(?:[\n\r]|[.!?;:]++[^A-Za-z0-9]|[.!?;:]*+\z))"
    return "(?i)" + begin + "".join(apart + (f"{word}(?:{apart}{word}){{0,7}}?" if w == "*" else w) for w in others) + end


def marked(text: Column) -> Column:
    """The text with every sentence found, longest wordings first, as a line of its own: ``MARK``, a cue word and its identifier."""
    every = [*WORDING, *SENTENCES.items(), *[("", x) for x in PLAIN]]
    every.sort(key=lambda x: -len(x[1].split()))
    clean = F.replace(text, F.lit(MARK), F.lit("*"))
    return reduce(lambda t, x: F.regexp_replace(t, wrapped(x[1]), f"\n{MARK}{CUES[0]}{x[0]}\n" if x[0] else "\n"), every, clean)


def cued(text: Column) -> Column:
    small = F.lower(text)
    return reduce(or_, [F.contains(small, F.lit(cue)) for cue in CUES])


def identifiers(text: Column) -> Column:
    """Identifiers of the sentences with a cue word, in order, each in angle brackets."""
    known = lambda s: F.when(F.startswith(s, F.lit(MARK)), F.substr(s, F.lit(len(MARK + CUES[0]) + 1))).otherwise(identifier(normal(s)))
    named = F.transform(F.filter(F.split(marked(text), ENDS), cued), lambda s: F.concat(F.lit("<"), known(s), F.lit(">")))
    return F.when(cued(text), F.array_join(named, "")).otherwise("")


def licences(sequence: Column) -> Column:
    """Names of the matched rules, in their order."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(map(tag, ids))).alias("ids")) for name, ids in RULES])
    none = F.expr("cast(array() as array<string>)")

    def step(acc: Column, rule: Column) -> Column:
        return F.struct(
            F.replace(acc["left"], rule["ids"], F.lit(USED)).alias("left"),
            F.when(F.contains(acc["left"], rule["ids"]), F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"),
        )

    found = F.aggregate(rules, F.struct(sequence.alias("left"), none.alias("found")), step, lambda acc: F.array_distinct(acc["found"]))
    return F.when(sequence != "", found).otherwise(none)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: identifiers in order, licences, and the number of sentences that are not known."""
    seen = docs.select(F.col(key), F.coalesce(identifiers(F.col(text)), F.lit("")).alias("identifiers"))
    unknown = (F.length("identifiers") - F.length(F.replace("identifiers", F.lit("<?>"), F.lit("")))) / 3
    return seen.select(key, "identifiers", F.array_join(licences(F.col("identifiers")), ";").alias("licences"), unknown.cast("long").alias("n_unknown"))


def _sql() -> str:
    known = ", ".join(f"'{words}': '{name}'" for name, words in SENTENCES.items())
    steps, last = [], "named"
    for i, (name, ids) in enumerate(RULES):
        stretch = "".join(map(tag, ids))
        steps.append(f"r{i} AS (SELECT doc_id, identifiers, replace(rest, '{stretch}', '{USED}') AS rest, CASE WHEN contains(rest, '{stretch}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"r{i}"
    return f"""
        WITH sentences AS (
            SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '{ENDS}'), lambda s: regexp_matches(lower(s), '{"|".join(CUES)}')), []) AS s FROM documents),
        normal AS (
            SELECT doc_id, list_transform(s, lambda x: regexp_replace(trim(regexp_replace(lower(x), '[^a-z0-9.+]+', ' ', 'g')), '[. ]+$', '')) AS s FROM sentences),
        named AS (
            SELECT doc_id, array_to_string(list_transform(s, lambda x: '<' || coalesce(MAP {{{known}}}[x], CASE WHEN regexp_matches(x, '{COPYRIGHT}') THEN 'copyright' ELSE '?' END) || '>'), '') AS identifiers,
                identifiers AS rest, []::VARCHAR[] AS found FROM normal),
        {", ".join(steps)}
        SELECT doc_id, identifiers, array_to_string(found, ';') AS licences,
            ((length(identifiers) - length(replace(identifiers, '<?>', ''))) // 3)::BIGINT AS n_unknown
        FROM {last}"""


SQL = _sql()
