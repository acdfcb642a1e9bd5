"""Fingerprints, suffix-tree scores and licence scans against plain versions."""

import collections
import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
from cases import edge_rows, frame

from curator.llm import fingerprints as fp
from curator.llm import licenses
from curator.llm import suffix_tree as st
from curator.llm.common import remainder


def jaccard(a, b):
    return 1.0 if not (a or b) else len(a & b) / len(a | b)


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edits_and_neighbours_match_brute_force(spark):
    rows = [(d, t) for d, t in edge_rows() if d is not None and (d, t) != (8, "tie of ids")]
    rows.sort(key=lambda r: r[0])
    for buckets in (1, 4, 40):
        got = sorted(fp.with_edits(frame(spark, rows), buckets=buckets).collect(), key=lambda r: r.doc_id)
        assert [r.doc_id for r in got] == [d for d, _ in rows]
        for i, (r, (_, text)) in enumerate(zip(got, rows)):
            text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
            n = len(text) // 4
            edited = text[: len(text) - n] + following[:n]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert abs(r.near_edited - jaccard(plain_shingles(text), plain_shingles(edited))) < 0.2
            assert abs(r.near_next - jaccard(plain_shingles(text), plain_shingles(following))) < 0.2
    prints = {}
    for r, (_, text) in zip(got, rows):
        assert prints.setdefault(text or "", r.fingerprint) == r.fingerprint


def test_all_rows_have_an_edit_even_with_null_and_repeated_ids(spark):
    got = fp.with_edits(frame(spark), buckets=5).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in edge_rows())
    one = fp.with_edits(frame(spark, [(7, "only one text here now")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fp.with_edits(frame(spark, [])).collect() == []


def test_near_duplicates_match_brute_force(spark):
    base = [f"t{i}" for i in range(200)]
    rows = edge_rows() + [(50 + k, " ".join(base[: 200 - 4 * k] + [f"z{k}-{j}" for j in range(4 * k)])) for k in range(8)]
    rows.remove((8, "tie of ids"))
    members, pairs = fp.near_duplicates(frame(spark, rows))
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(frozenset(plain_shingles(t)), set()).add(d)
    classes = {min(ids): s for s, ids in sets.items()}
    by_set = {s: i for i, s in classes.items()}
    want = sorted((d, by_set[frozenset(plain_shingles(t))]) for d, t in rows if d is not None)
    assert sorted((r.doc_id, r.class_id) for r in members.collect()) == want
    near = {(a, b) for a in classes for b in classes if a < b and classes[a] and classes[b] and jaccard(classes[a], classes[b]) >= 0.8}
    assert near and {(r.a, r.b) for r in pairs.collect()} == near


def plain_tree_score(found, line, seen):
    """Interpolated probability of every byte after the longest retained context, by dictionaries."""

    def share(context, byte):
        if context == b"":
            lower = 1 / 256
        else:
            base = context[1:]
            while base not in found:
                base = base[1:]
            lower = share(base, byte)
        row = found[context]
        return (row.get(byte, 0) + len(row) * lower) / (sum(row.values()) + len(row))

    total, text = 0.0, bytes([st.END] * st.DEPTH) + line
    for i in range(st.DEPTH, len(text)):
        context = text[i - st.DEPTH : i]
        while context not in found:
            context = context[1:]
        total += math.log10(share(context, text[i]))
    return total


def as_table(found):
    rows = [(len(c), int.from_bytes(c, "big"), byte, n) for c, row in found.items() for byte, n in row.items()]
    return st._table(*(np.array(x, np.int64) for x in zip(*rows)))


def test_a_tree_scores_by_longest_retained_contexts():
    lines = [b"abab abba baab\n", b"abc abc\n" * 30, b"", b"zz\n", b"\xff\xfe a\n"]
    counts = collections.Counter(w for line in lines[:2] for w in st.windows(line).tolist())
    found = {b"": collections.Counter()}
    for w, n in counts.items():
        raw = w.to_bytes(st.DEPTH + 1, "big")
        found[b""][raw[-1]] += n
        for context in (raw[-2:-1], raw[-3:-1], raw[-4:-1]):
            if context in (b"b", b"ab", b" ab", b"a", b"c\n"):
                found.setdefault(context, collections.Counter())[raw[-1]] += n
    tree = as_table(found)
    want = [plain_tree_score(found, line, None) for line in lines]
    assert np.allclose(tree.score(lines), want, rtol=1e-5)
    share = 10 ** tree.log.astype(float)
    assert np.allclose(share[:, 1:-1].sum(axis=1) + share[:, -1] * (256 - tree.log.shape[1] + 2), 1, atol=1e-5)


def test_pieces_of_long_texts_keep_their_context(monkeypatch):
    lines = [bytes(np.random.default_rng(i).integers(97, 101, 3000).astype(np.uint8)) + b"\n" for i in range(3)]
    counts = collections.Counter(w for line in lines for w in st.windows(line).tolist())
    found = {b"": collections.Counter()}
    for w, n in counts.items():
        raw = w.to_bytes(st.DEPTH + 1, "big")
        for k in range(3):
            found.setdefault(raw[st.DEPTH - k : st.DEPTH], collections.Counter())[raw[-1]] += n
    tree = as_table(found)
    whole = tree.score(lines)
    monkeypatch.setattr(st, "PIECE", 7)
    assert np.allclose(tree.score(lines), whole)


def test_contexts_beyond_the_state_table_score_alike(spark, monkeypatch):
    docs = frame(spark, [(i, " ".join(f"{chr(97 + i % 7)}{j % (i + 3)}{chr(97 + j % 5)}" for j in range(400))) for i in range(12)])
    counts = st.materialize(st.count_windows(docs), "windows")
    table, lists = st.grow(counts), st.grow(counts, max_states=5)
    assert isinstance(table, st.Tree) and sum(map(len, lists.contexts)) > 50
    lines = [b" ".join(st.words_of(r.text)) + b"\n" for r in docs.collect()] + [b"", b"zz\xff a\n", b"a0a b1b\n"]
    want = table.score(lines)
    assert np.allclose(lists.score(lines), want, rtol=1e-5)
    monkeypatch.setattr(st, "COUNTED", 100)
    assert np.allclose(lists.score(lines), want, rtol=1e-5)
    monkeypatch.setattr(st, "BROADCAST", 0)
    assert np.allclose(st.grow(counts, max_states=0).score(lines), want, rtol=1e-5)
    none = st.count_windows(frame(spark, []))
    assert np.allclose(st.grow(none, max_states=-1).score([b"ab\n"]), st.grow(none).score([b"ab\n"]))


def test_window_counts_do_not_depend_on_blocks(spark, monkeypatch):
    docs = frame(spark)
    want = collections.Counter(w for _, t in edge_rows() for w in st.windows(b" ".join(st.words_of(t)) + b"\n").tolist())
    assert {r.window: r.n for r in st.count_windows(docs).collect()} == dict(want)


def test_base_scores_are_exact(spark):
    rows = edge_rows()
    docs = frame(spark, rows)
    got = st.score_documents(docs, remainder("doc_id", 5) != 1).collect()
    import zlib

    train = [t for d, t in rows if zlib.crc32((str(d) if d is not None else "").encode()) % 5 != 1]
    c = collections.Counter(w for t in train for w in [*st.words_of(t), b"\n"])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for d, t in rows:
        w = [*st.words_of(t), b"\n"]
        want[(d, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert st.score_documents(frame(spark, []), remainder("doc_id", 5) != 1).collect() == []


def test_many_chunks_give_the_same_sums(spark, monkeypatch):
    docs = frame(spark).coalesce(1)
    tree = st.grow(st.count_windows(docs))
    sums = []
    for tokens in (1 << 22, 50):
        shape = st._word_posts(docs.withColumn("train", remainder("doc_id", 3) != 1).select("doc_id", "text", "train"), tree)
        if tokens == 50:
            # The same rows dealt over more tasks make more chunks.
            shape = st._word_posts(docs.repartition(7).withColumn("train", remainder("doc_id", 3) != 1).select("doc_id", "text", "train"), tree)
        rows = shape.collect()
        totals = collections.Counter()
        for r in rows:
            if r.word is not None:
                totals[bytes(r.word)] += r.train
        out = []
        for chunk in {r.chunk for r in rows}:
            own = [r for r in rows if r.chunk == chunk]
            table = pa.table({"chunk": [chunk] * len(own), "c": pa.array([None if r.word is None else totals[bytes(r.word)] for r in own], pa.int64()), "posts": pa.array([bytes(r.posts) for r in own], pa.binary())})
            out += [(str(x["doc_id"]), x["n_tokens"], x["n_known"], round(x["log_sum"], 6), round(x["score"], 4)) for x in st._sum_chunk(table).to_pylist()]
        sums.append(sorted(out))
    assert sums[0] == sums[1]


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

The software is provided "as is", without warranty of any kind, express or
implied, including but not limited to the warranties of merchantability,
fitness for a particular purpose and noninfringement. And more."""

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""

NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior
written permission."""


def license_rows():
    backwards = "\n\n".join(reversed(MIT.split("\n\n")))
    return edge_rows() + [
        (100, MIT), (101, backwards), (102, BSD), (103, BSD + NAMES), (104, "Text\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\nall rights reserved"),
        (105, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."), (106, "I like the MIT License more than others."), (107, f"{MIT}\n{BSD}"),
        (108, "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ]


def test_licenses_and_their_sql(spark):
    rows = [r for r in license_rows() if r[0] is not None]
    seen, unique = set(), []
    for d, t in rows:
        if d not in seen:
            seen.add(d)
            unique.append((d, t))
    docs = frame(spark, unique)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[100].licenses == ["MIT"] and got[100].identifiers == ["mit-grant", "mit-notice", "as-is"]
    assert got[101].licenses == [] and set(got[101].identifiers) == {"mit-grant", "mit-notice", "as-is"}
    assert got[102].licenses == ["BSD-2-Clause"] and got[103].licenses == ["BSD-3-Clause"]
    assert got[104].licenses == ["MIT", "CC-BY-NC-4.0", "LicenseRef-all-rights-reserved"]
    assert got[105].licenses == ["Apache-2.0"] and got[106].licenses == []
    assert got[107].licenses == ["MIT", "BSD-2-Clause"] and got[108].licenses == ["GPL-3.0-or-later"]
    assert got[3].n_sentences == got[4].n_sentences == 0
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d for d, _ in unique], "text": [t for _, t in unique]}))
    want = {r[0]: r[1:] for r in con.execute(licenses.oracle()).fetchall()}
    assert {d: (r.n_sentences, " ".join(r.identifiers), ",".join(r.licenses)) for d, r in got.items()} == want
    assert licenses.scan(frame(spark, [])).collect() == []
    assert licenses.scan(frame(spark, license_rows())).count() == len(license_rows())


WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"""

APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

BSD_FILE = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""


def test_licence_files_as_they_are_published(spark):
    mit = "MIT License\n\n" + MIT[: MIT.index("The software is provided")] + WARRANTY
    texts = {"MIT": [mit, mit[13:], "About\n\nMIT License\n\nmore"], "Apache-2.0": [APACHE], "BSD-3-Clause": [BSD_FILE, BSD_FILE.replace("1. ", "a) ").replace("2. ", "(b) ")]}
    rows, want = [], {}
    for name, some in texts.items():
        for text in some:
            for lead in ("", "# ", " * ", "// ", "dnl "):
                want[len(rows)] = [name]
                rows.append((len(rows), f"x = 1\n{lead}" + text.replace("\n", f"\n{lead}") if lead else text))
    glued = APACHE.replace("at\n\n    http", "at http")
    want[len(rows)] = ["Apache-2.0"]
    rows.append((len(rows), glued))
    assert {r.doc_id: r.licenses for r in licenses.scan(frame(spark, rows)).collect()} == want


def test_sentences_are_written_as_they_are_compared(spark):
    rows = spark.createDataFrame([(s,) for s in licenses.SENTENCES], "s string")
    assert all(r.s == r.n and r.h for r in rows.select("s", licenses.normalised(rows["s"]).alias("n"), licenses.hinted(rows["s"]).alias("h")).collect())
    known = set(licenses.SENTENCES.values())
    assert all(i in known for _, ids in licenses.RULES for i in ids)


def test_every_sentence_holds_a_hint_inside_a_word():
    for sentence in licenses.SENTENCES:
        assert any(h in word for h in licenses.HINTS for word in sentence.split()), sentence
    assert {i for ids in licenses.RULES for i in ids[1]} <= set(licenses.SENTENCES.values())


def test_licences_over_line_ends_and_more_of_them(spark):
    texts = {
        "LicenseRef-all-rights-reserved": "Copyright X.\nAll rights\nreserved.",
        "GPL-2.0-or-later": " * This program is free  software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
                            " * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n",
        "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the "
                             "Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n",
        "AGPL-3.0-or-later": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as published by\n"
                             "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n",
        "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n"
               "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS. IN NO EVENT",
        "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\n"
                     "binary, for any purpose, commercial or non-commercial, and by any\nmeans.\n",
        "EPL-2.0": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttp://www.eclipse.org/legal/epl-2.0.",
        "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty.  In no event\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\n"
                "freely, subject to the following restrictions:\n",
        "BSL-1.0": "// Distributed under the Boost Software License, Version 1.0.\n",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    }
    rows = spark.createDataFrame([*enumerate(texts.values())], "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(rows).collect()}
    assert {name: got[i] for i, name in enumerate(texts)} == {name: [name] for name in texts}
