import os
import random
import textwrap
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from pagefacts.llm import licenses as L
from pagefacts.llm import line_dedup as N
from pagefacts.llm import substring_dedup as S
from pagefacts.llm.queries import ORACLES, QUERIES

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."


def test_licenses(spark):
    rows = [(1, BSD + " All rights reserved."), (2, "Released under the MIT license. released UNDER the MIT  License"), (3, None), (4, ""), (5, "permitted"), (None, "All rights reserved."), (6, "x " * 90_000 + ".\nLicensed under the Apache License, Version 2.0."), (2, "See the License for the specific language governing permissions and limitations under the License.")]
    out = [tuple(r) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as licenses")).collect()]
    assert sorted(out, key=str) == sorted([
        (1, "BSD-grant|BSD-source|BSD-binary|all-rights", "BSD-2-Clause|LicenseRef-all-rights-reserved", ""), (2, "MIT-name|MIT-name", "MIT", ""), (2, "Apache-see", "", "Apache-see"),
        (None, "all-rights", "LicenseRef-all-rights-reserved", ""), (6, "Apache-2-name", "Apache-2.0", ""),
    ], key=str)
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
BSD_3 = BSD + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
NOTICES = [
    ("MIT", MIT), ("Apache-2.0", APACHE), ("GPL-3.0-or-later", GPL.format(":", ",", 3)), ("GPL-2.0-or-later", GPL.format(";", ";", 2)), ("BSD-2-Clause", BSD), ("BSD-3-Clause", BSD_3),
    ("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", GPL.format(";", ";", 2).replace("License as published", "License version 2 as published").replace("Foundation; either version 2 of the License, or (at your option) any later version.", "Foundation.")),
    ("AGPL-3.0-or-later", GPL.format(":", ",", 3).replace("GNU General", "GNU Affero General")),
    ("LGPL-2.1-or-later", GPL.format(";", ";", 2.1).replace("GNU General", "GNU Lesser General").replace("This program", "This library")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", ISC), ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify and so on."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at\nhttps://www.eclipse.org/legal/epl-v20.html"),
    ("LGPL-3.0-only", "/* SPDX-License-Identifier: LGPL-3.0-only */"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("LicenseRef-all-rights-reserved", "All rights reserved\nCopyright 2020"),
]


@pytest.mark.parametrize("width,comment", [(10**6, ""), (72, ""), (72, " * "), (30, "# ")])
def test_original_notices(spark, width, comment):
    wrap = lambda x: "\n".join(comment + line for part in x.split("\n") for line in textwrap.wrap(part, width) or [""])
    rows = [(i, f"Title\n{wrap(x)}\n\nint main() {{}}\n") for i, (_, x) in enumerate(NOTICES)]
    out = {x.doc_id: (x.licenses, x.unmatched) for x in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: (name, "") for i, (name, _) in enumerate(NOTICES)}


@pytest.mark.parametrize("leader", ["", "# ", " * ", "// "])
def test_every_known_sentence_is_reached(spark, leader):
    """Each sentence, capitalised, wrapped at 40 columns and behind a comment leader, gives its identifier; SQL agrees."""
    rows = [(i, "Heading\n" + "\n".join(leader + x for x in textwrap.wrap(k[0].upper() + k[1:] + ".", 40)) + "\nother text", v) for i, (k, v) in enumerate(L.SENTENCES.items())]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = L.scan(df).collect()
    assert {x.doc_id: x.sentence_ids for x in got} == {i: v for i, _, v in rows}
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    assert sorted(c.sql(L.sql()).fetchall()) == sorted(map(tuple, got))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        path = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*' if os.path.isdir(path) else path}'")
    df, want = QUERIES[name](spark, sf), c.sql(ORACLES[name])
    pick = [want.columns.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in pick) for r in want.fetchall())


PAGES = "page_id long, url string, html string, lines string, host int"


def boilerplate(rows):
    lines = lambda h: [x.strip() for x in (h or "").replace("<br>", "\n").split("\n") if x.strip()]
    total, held = defaultdict(int), defaultdict(int)
    for _, host, h in rows:
        total[host] += 1
        for x in set(lines(h)):
            held[host, x] += 1
    return sorted(((p, len(lines(h)), "\n".join(x for x in lines(h) if not (held[host, x] >= N.LEAST_PAGES and 100 * held[host, x] >= N.PERCENT * total[host]))) for p, host, h in rows), key=str)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_boilerplate(spark, monkeypatch, broadcast):
    monkeypatch.setattr(N, "BROADCAST_ROWS", broadcast)
    r = random.Random(3)
    rows = []
    for i in range(120):
        host = r.choice(["a.org", "a.org", "b.org", ""])
        rows.append((i, host, "<br>".join(r.choice([["Menu"], ["Footer", "Menu"], []]) + [f"text {r.randrange(60)}" for _ in range(4)])))
    rows += [(200, "a.org", None), (201, "", ""), (None, "b.org", "Menu"), (202, "one.org", "Menu<br>Menu"), (202, "one.org", "Menu")]
    urls = {"": [None, "", "nonsense"]}
    df = spark.createDataFrame([(p, r.choice(urls.get(h, [f"https://{h}/x", f"http://u@{h.upper()}:80?q"])), t, "x", 1) for p, h, t in rows], PAGES)
    out = sorted(((x.page_id, x.n_lines, x.text) for x in N.without_boilerplate(df).collect()), key=str)
    assert out == boilerplate(rows)
    assert N.without_boilerplate(df.limit(0)).count() == 0


def test_cuts_follow_content():
    r = np.random.default_rng(2)
    text = ("".join(map(chr, r.choice([*range(97, 123), 32, 233, 0x1F600], 4000)))).encode()
    ends = S.cuts(np.frombuffer(text, np.uint8)).tolist()
    assert ends[-1] == len(text) and all(S.LEAST <= b - a <= S.MOST for a, b in zip([0, *ends][:-2], ends[:-1], strict=False))
    for a in ends:
        text[:a].decode()
    moved = S.cuts(np.frombuffer(b"inserted " + text, np.uint8)).tolist()
    assert len({x - 9 for x in moved} & set(ends)) > 0.9 * len(ends)
    assert S.cuts(np.frombuffer(b"z" * 1000, np.uint8)).tolist()[-1] == 1000 and S.cuts(np.frombuffer(b"a", np.uint8)).tolist() == [1]


def test_repeated_passages(spark):
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))
    passage, docs = words(80), {i: words(r.choice((20, 100, 300))) for i in range(60)}
    sharing = [3, 10, 11, 40]
    for i in sharing:
        docs[i] = docs[i][:50] + passage + docs[i][50:]
    docs[59] = docs[5]
    rows = [(i, t, "x", 1) for i, t in docs.items()] + [(100, None, "x", 1), (101, "", "x", 1), (None, "é" * 200 + passage, "x", 1), (102, words(5) + " ", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, run string, d1 int")
    out = S.repeated_passages(df).collect()
    whole = {59} if len(docs[5].encode()) >= S.LEAST_RUN else set()
    assert {x.doc_id for x in out} == {10, 11, 40, None} | whole
    for x in out:
        mine = "é" * 200 + passage if x.doc_id is None else docs[x.doc_id]
        assert len(mine[x.from_char : x.to_char].encode()) == x.n_bytes >= S.LEAST_RUN
        assert mine[x.from_char : x.to_char] in docs[x.keeper_id] or x.doc_id in whole
    cut = {x.doc_id: x.text for x in S.without_passages(df.where("doc_id is not null"), S.repeated_passages(df.where("doc_id is not null"))).collect()}
    assert cut[3] == docs[3] and len(cut[10]) < len(docs[10]) - S.LEAST_RUN and cut[100] is None
    assert S.repeated_passages(df.limit(0)).count() == 0


def test_every_passage_of_51_short_words(spark):
    r = random.Random(51)
    words = lambda n: ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randrange(1, 5))) for _ in range(n)]
    rows = []
    for i in range(400):
        passage = words(51) if i % 8 else [f"w{i}"] * 30 + words(21)
        rows += [(k * 1000 + i, " ".join(words(r.randrange(1, 90)) + passage + words(r.randrange(1, 90)))) for k in (0, 1)]
    rows += [(5000 + i, " ".join(words(150))) for i in range(100)]
    out = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in out} == {1000 + i for i in range(400)}
    assert all(x.keeper_id == x.doc_id - 1000 for x in out if x.doc_id % 8)
    few = [(1, "start la la la end of it"), (2, "other " + "la " * 60 + "more of this")]
    assert S.repeated_passages(spark.createDataFrame(few, "doc_id long, text string")).count() == 0


def plain_passages(rows, within=True):
    """Runs of repeated chunks by a table of all chunks in memory; rows are (doc_id, text) with ids of their own."""
    places, chunks = {}, {}
    for d, text in sorted(rows):
        data = text.encode()
        ends = S.cuts(np.frombuffer(data, np.uint8)).tolist() if data else []
        chunks[d] = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k, c in enumerate(chunks[d]):
            places.setdefault(c, (d, k))
    found = set()
    for d, own in chunks.items():
        for kept_here, floor in ((False, None), (True, S.LEAST_WITHIN)):
            run, at = [], 0
            for k, c in enumerate([*own, None]):
                gone = c is not None and places[c] != (d, k) and (places[c][0] == d) == kept_here
                if gone:
                    run.append((at, c, places[c][0]))
                elif run:
                    text = b"".join(x for _, x, _ in run)
                    n_words = int(S.word_starts(np.frombuffer(b"".join(own), np.uint8))[run[0][0] : run[0][0] + len(text)].sum())
                    if n_words >= floor if floor else len(text) >= S.LEAST_RUN or n_words >= S.LEAST_WORDS:
                        start = len(b"".join(own)[: run[0][0]].decode())
                        found.add((d, start, start + len(text.decode()), len(text), len(run), min(x for _, _, x in run)))
                    run = []
                at += len(c or b"")
    return found


@pytest.mark.parametrize("heavy", [200_000, 3])
def test_passages_equal_the_plain_table(spark, monkeypatch, heavy):
    monkeypatch.setattr(S, "MOST_HEAVY", heavy)
    r = random.Random(31)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))
    shared = [words(n) for n in (20, 55, 70, 200)]
    rows = []
    for i in range(120):
        parts = [words(r.randrange(5, 60)) for _ in range(3)]
        for _ in range(r.choice((0, 0, 1, 2))):
            parts.insert(r.randrange(4), r.choice(shared))
        rows.append((i, " ".join(parts)))
    rows.append((500, shared[3] + " mid " + shared[3] + " é " + words(9)))
    out = {tuple(x) for x in S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == plain_passages(rows) and len(out) > 40
    assert any(d == k == 500 for d, *_, k in plain_passages([rows[-1]])) and {x.keeper_id for x in S.repeated_passages(spark.createDataFrame(rows[-1:], "doc_id long, text string")).collect()} == {500}


def test_rows_that_share_an_id_or_have_none(spark):
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))
    same, other, long_ = words(80), words(80), "la " * 60_000 + words(80)
    rows = [(1, same), (1, same), (None, other), (None, other), (None, other), (2, long_), (3, long_)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((str(x.doc_id), str(x.keeper_id)) for x in S.repeated_passages(df.repartition(3)).collect())
    assert [x for x in out if x[0] != "3"] == [("1", "1"), ("None", "None"), ("None", "None")] and ("3", "2") in out
    odd = spark.createDataFrame([(1, same, 5, "x", None), (2, "é" + same, 6, "y", 1), (None, same, 7, "z", 2)], "doc_id long, text string, _spans int, _ends string, spans int")
    cut = S.without_passages(odd, S.repeated_passages(odd))
    assert cut.schema == odd.schema and sorted((str(x.doc_id), x.text == same, len(x.text) < 60, x._spans, x._ends) for x in cut.collect()) == [("1", True, False, 5, "x"), ("2", False, True, 6, "y"), ("None", True, False, 7, "z")]
