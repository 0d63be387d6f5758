"""Operator 5: licence scans by sentence rules.

A text's sentences are normalised and mapped to identifiers of known licence sentences, which may go over
several pieces (wrapped lines, colons and semicolons inside of a sentence); the sequence
of identifiers is then matched against ordered rules, longer ones first, and what a rule matches is
taken out before the next. One projection: nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised (lower case, letters and digits, single spaces), and their identifiers.
SENTENCES = {
    "released under the mit license": "MIT-name",
    "licensed under the mit license": "MIT-name",
    "this project is licensed under the mit license": "MIT-name",
    "spdx license identifier mit": "MIT-name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT-as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT-liable",
    "licensed under the apache license version 2 0": "Apache-2-name",
    "licensed under the apache license version 2 0 the license": "Apache-2-name",
    "spdx license identifier apache 2 0": "Apache-2-name",
    "you may not use this file except in compliance with the license": "Apache-comply",
    "you may obtain a copy of the license at": "Apache-obtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "Apache-see",
    "this work is licensed under the gnu general public license version 3": "GPL-3-name",
    "licensed under the gnu general public license version 3": "GPL-3-name",
    "spdx license identifier gpl 3 0 only": "GPL-3-name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL-3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL-2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL-warranty",
    "see the gnu general public license for more details": "GPL-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-endorse",
    "licensed under cc by nc 4 0": "CC-BY-NC-4-name",
    "licensed under cc by 4 0": "CC-BY-4-name",
    "licensed under cc by sa 4 0": "CC-BY-SA-4-name",
    "all rights reserved": "all-rights",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "Apache-obtain",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "Apache-obtain",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "GPL-2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL-3-later",
    "see the gnu affero general public license for more details": "AGPL-see",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL-2.1-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL-3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL-3-later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL-warranty",
    "see the gnu lesser general public license for more details": "LGPL-see",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL-2-name",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL-2-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL-2-obtain",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC-as-is",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "ISC-liable",
    "this is free and unencumbered software released into the public domain": "Unlicense-name",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0-dedicated",
    "licensed under cc0 1 0": "CC0-dedicated",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at https www eclipse org legal epl v20 html": "EPL-2-name",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL-2-name",
}
#: Licences that an SPDX tag may name.
TAGGED = (
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later "
    "BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0"
).split()
SENTENCES |= {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower()): f"{x}-tag" for x in TAGGED}
#: Ordered rules: a licence and the identifiers that stand for it, one after the other.
RULES = [
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-as-is", "MIT-liable"]),
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-as-is"]),
    ("Apache-2.0", ["Apache-2-name", "Apache-comply", "Apache-obtain", "Apache-as-is", "Apache-see"]),
    ("Apache-2.0", ["Apache-2-name", "Apache-comply"]),
    ("GPL-3.0-or-later", ["GPL-3-later", "GPL-warranty", "GPL-see"]),
    ("GPL-3.0-or-later", ["GPL-3-later"]),
    ("GPL-2.0-or-later", ["GPL-2-later", "GPL-warranty", "GPL-see"]),
    ("GPL-2.0-or-later", ["GPL-2-later"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse"]),
    ("BSD-2-Clause", ["BSD-grant", "BSD-source", "BSD-binary"]),
    ("MIT", ["MIT-name"]),
    ("Apache-2.0", ["Apache-2-name"]),
    ("GPL-3.0-only", ["GPL-3-name"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-4-name"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-4-name"]),
    ("CC-BY-4.0", ["CC-BY-4-name"]),
    ("AGPL-3.0-or-later", ["AGPL-3-later", "GPL-warranty", "AGPL-see"]),
    ("AGPL-3.0-or-later", ["AGPL-3-later"]),
    ("LGPL-2.1-or-later", ["LGPL-2.1-later", "GPL-warranty", "LGPL-see"]),
    ("LGPL-2.1-or-later", ["LGPL-2.1-later"]),
    ("LGPL-3.0-or-later", ["LGPL-3-later", "GPL-warranty", "LGPL-see"]),
    ("LGPL-3.0-or-later", ["LGPL-3-later"]),
    ("GPL-2.0-only", ["GPL-2-only", "GPL-warranty", "GPL-see"]),
    ("GPL-2.0-only", ["GPL-2-only"]),
    ("MPL-2.0", ["MPL-2-name", "MPL-2-obtain"]),
    ("MPL-2.0", ["MPL-2-name"]),
    ("ISC", ["ISC-grant", "ISC-as-is", "ISC-liable"]),
    ("ISC", ["ISC-grant"]),
    ("Unlicense", ["Unlicense-name"]),
    ("CC0-1.0", ["CC0-dedicated"]),
    ("EPL-2.0", ["EPL-2-name"]),
    ("LicenseRef-all-rights-reserved", ["all-rights"]),
]
RULES += [(x, [f"{x}-tag"]) for x in TAGGED]
#: Where sentences end; what normalising turns into a space.
SENTENCE_END, NOT_WORD = "[.!?;:]+[ \\t\\r\\n]+|\\n+", "[^\\p{L}\\p{N}]+"


def _known() -> str:
    """Pattern of a known sentence that begins and ends where pieces do, the longest first."""
    keys = sorted(SENTENCES, key=lambda k: (-len(k), k))
    return "(?<=\\|)(?:" + "|".join(k.replace(" ", "[ |]") for k in keys) + ")(?=\\|)"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses, unmatched of each document that holds a known sentence.

    ``sentence_ids``: identifiers in text order; ``licenses``: each licence found once, in order of the
    rules; ``unmatched``: identifiers that no rule took. All three are joined by "|". Null and empty
    texts give no row; repeated rows and ids give a row each; other columns are ignored.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    normal = lambda s: F.trim(F.lower(F.regexp_replace(s, NOT_WORD, " ")))
    pieces = F.array_join(F.array_remove(F.transform(F.split("text", SENTENCE_END), normal), ""), "|")
    sentences = F.regexp_extract_all(F.concat(F.lit("|"), pieces, F.lit("|")), F.lit(_known()), F.lit(0))
    ids = F.transform(sentences, lambda s: F.element_at(known, F.translate(s, "|", " ")))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids")).where(F.size("ids") > 0)
    left, named = F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|")), []
    for license_, sequence in RULES:
        mark = "".join(f"|{x}|" for x in sequence)
        named.append(F.when(F.contains(left, F.lit(mark)), F.lit(license_)))
        left = F.replace(left, F.lit(mark), F.lit("#"))
    found = found.select("doc_id", F.array_join("ids", "|").alias("sentence_ids"), F.array_join(F.array_distinct(F.array_compact(F.array(*named))), "|").alias("licenses"), F.replace(left, F.lit("#"), F.lit("")).alias("left"))
    return found.select("doc_id", "sentence_ids", "licenses", F.replace(F.expr("trim(BOTH '|' FROM left)"), F.lit("||"), F.lit("|")).alias("unmatched"))


def sql() -> str:
    """The same result in DuckDB SQL. Pieces stand between two bars, so that sentences side by side share none; its
    pattern for the ends of pieces is its own."""
    quoted = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    keys = "|".join(k.replace(" ", "(?: |[|][|])") for k in sorted(SENTENCES, key=lambda k: (-len(k), k)))
    steps, last = [], "found"
    for i, (license_, sequence) in enumerate(RULES):
        mark = "".join(f"|{x}|" for x in sequence)
        steps.append(f"r{i} as (select nr, doc_id, ids, case when contains(rest, '{mark}') and not list_contains(named, '{license_}') then list_append(named, '{license_}') else named end as named, replace(rest, '{mark}', '#') as rest from {last})")
        last = f"r{i}"
    return f"""with known(sentence, id) as (values {quoted}),
rows as (select row_number() over () as nr, doc_id, regexp_replace(text, '([.!?;:]+)([ \t\r\n]+)', chr(10), 'g') as text from documents where text is not null),
plain as (select nr, doc_id, '|' || array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))), lambda x: x <> ''), '||') || '|' as text from rows),
met as (select nr, doc_id, regexp_extract_all(text, '[|]({keys})[|]', 1) as s from plain),
parts as (select nr, doc_id, replace(unnest(s), '||', ' ') as sentence, generate_subscripts(s, 1) as pos from met where len(s) > 0),
ids as (select nr, doc_id, list(id order by pos) as ids from parts join known using (sentence) group by nr, doc_id),
found as (select nr, doc_id, ids, cast([] as varchar[]) as named, '|' || array_to_string(ids, '||') || '|' as rest from ids),
{", ".join(steps)}
select doc_id, array_to_string(ids, '|') as sentence_ids, array_to_string(named, '|') as licenses, replace(trim(replace(rest, '#', ''), '|'), '||', '|') as unmatched from {last}"""
