"""Each operator against a brute-force form on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import binascii
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from windrow.llm import byte_bpe, digest_index, harmonic_packing, kd_search, license_rules, line_templates, nb_linear, queries, secret_ledger, simhash_anchors, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox number 17 jumps over the lazy dog near the old mill again today"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kauri larch maple nutmeg oak pine quince rowan spruce teak".split()


def texts():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    long = prose(9000)
    one = "\n".join(prose(12) for _ in range(5))
    rows = [None, "", " \t\n", one, one, one.replace("\n", " \n"), long, long + " end", "x" * 50_000, "é ß – 中文 ١٢ x\u0085y\u00a0z\x1cq  \U0001f600!", "a", "a b", "A b", "aaaaaaaa enenenen 'S it's 12345 <|endoftext|> end   ",
            PROSE, PROSE.replace("17", "29") + "\nown line of this document here", PROSE.replace("jumps over", "leaps past") + "\n\n" + prose(9), "api_key: 'abcdefgh' and TOKEN=abc and password = x\nsecret:token:longer.value",
            "AKIA" + "A1" * 10 + " AKIA1 " + "0123456789abcdef" * 3 + " \u017fecret=notthisone é token=\"zzzzzz\"", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License!",
            "ALL RIGHTS-RESERVED.", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 10]
    rows += [prose(40) for _ in range(30)]
    return rows


def documents(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


def odd(docs):
    """Repeated rows, rows without an id, and columns whose names the operators use inside."""
    more = docs.union(docs.where("doc_id IN (3, 14)")).union(docs.where("doc_id IN (0, 4)").withColumn("doc_id", F.lit(None).cast("long")))
    clash = ["_t", "_h", "_k", "line", "key", "fp", "blob", "spans", "path", "score", "digest", "shard", "class", "_dropped", "_own", "n_lines", "anchor", "ids", "tokens"]
    return more.select("*", *[F.lit(7).alias(c) for c in clash])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return sorted(con.execute(sql).fetchall(), key=repr)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_line_templates_match_sql_and_keep_first_lines(spark):
    docs = documents(spark)
    got = line_templates.drop_repeated_lines(docs, exact=True).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("text"))
    want = in_duckdb(line_templates.SQL, documents=docs.select("doc_id", "text").toArrow())
    assert [(r[0], r[2], r[3]) for r in rows(got)] == [(r[0], r[2], r[3]) for r in want]
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[3].n_dropped == 0 and by_id[4].n_dropped == 5 and by_id[4].text == ""
    assert by_id[15].text == "own line of this document here" and by_id[15].n_dropped == 1  # the number is a variable field
    assert by_id[16].n_dropped == 1  # one field of the tail is
    strange = odd(docs)
    out = line_templates.drop_repeated_lines(strange)
    assert out.columns == [c for c in strange.columns if c != "n_lines"] + ["n_lines", "n_dropped"] and out.count() == strange.count()
    assert all(r.n_dropped == 0 for r in out.where("doc_id IS NULL").collect()) and len({r.text for r in out.where("doc_id = 14").collect()}) == 1
    assert line_templates.drop_repeated_lines(docs.limit(0)).count() == 0


def test_pipeline_line_dedup_drops_exact_copies_of_any_line(spark):
    short, digits, unspaced = "All rights reserved.", "2024-01-01 17 23 42 99 ok", "\u8fd9\u662f\u4e00\u6bb5\u6ca1\u6709\u7a7a\u683c\u7684\u6587\u5b57"
    data = ["\n".join([short, digits, unspaced, "", "own one"]), "\n".join(["own two", short, "", digits, unspaced]), None, "", "2024-01-01 17 23 42 98 ok\nAll rights reserved", "once\nonce", " \n "]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(data)], SCHEMA)
    got = {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == dict(enumerate([data[0], "own two\n", *data[2:]]))


def test_byte_bpe_equals_tiktoken_and_decodes(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd(documents(spark))
    got = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    source = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == sorted((str(i), library.encode_ordinary(t), t.encode()) for i, t in source)
    assert byte_bpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([60000],)], "ids array<int>"), ranks).collect()


def test_merge_replay_on_an_unruly_vocabulary():
    # 'abc' ranks below 'ab': a merge then makes a pair of a lower rank than its own
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 258, b"aa": 259, b"aaa": 260, b"cab": 261, b"abcab": 262}
    library = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    words = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 30))) for _ in range(3000)] + [b"", b"abcab", b"a" * 999]
    ids, counts = byte_bpe.replay(words, ranks, byte_bpe.PairTable(ranks))
    pieces = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in pieces] == [library.encode_ordinary(w.decode()) for w in words]


def test_word_splitting_covers_all_scripts():
    import regex

    split = byte_bpe.word_splitter(public_tokenizers.PATTERN)
    for text in (t or "" for t in texts()):
        if "\x1c" not in text:
            assert split(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_kd_search_is_exact(spark):
    r = random.Random(1)
    base = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    base += [(1000 + i, [0.5] * 6) for i in range(120)]  # ties
    base += [(2000, None), (2050, [float("nan")] * 6), (2100, [None] * 6), (2150, [1.0] * 6), (2200, [1e300] * 6), (2250, [2.0, 1.0]), (2251, [1.0, 1.0]), (2300, []), (None, [1.0] * 6), (2350, [1e12] * 6)]
    frame = spark.createDataFrame(base, "vec_id long, embedding array<double>")
    got = kd_search.top_products(frame, frame.where("vec_id % 50 = 0"), shard_rows=60, query_rows=5).collect()
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in base if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, a in use:
        if q % 50 == 0:
            scored = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in use if i != q and len(a) == len(b))[:5]  # saturated before ranking
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    assert {(x.query_id, x.rank, x.vec_id, x.score) for x in got} == want
    assert kd_search.top_products(frame.limit(0), frame.limit(0)).count() == 0
    assert kd_search.top_products(frame.where("vec_id = 50"), frame.where("vec_id = 50")).count() == 0


def brute_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_ledger_scans_only_what_is_new(spark, tmp_path):
    docs = odd(documents(spark))
    ledger = secret_ledger.BlobLedger.open(spark, str(tmp_path / "ledger"))
    got = secret_ledger.secret_scan(docs, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    found = sorted(((r.path, [tuple(s) for s in r.b]) for r in got.select("path", base.alias("b")).collect()), key=repr)
    assert found == sorted(((r.doc_id, brute_spans(r.text or "")) for r in docs.collect()), key=repr)
    assert any(k == "private_key" for r in got.collect() for _, _, k, _ in r.spans) and any(k == "github" for r in got.collect() for _, _, k, _ in r.spans)
    scanned = ledger.rows().count()
    secret_ledger.secret_scan(docs, ledger).count()
    assert ledger.rows().count() == scanned  # every pair was seen
    newer = [*secret_ledger.RULES[:-1], secret_ledger.Rule("url_login", r"://x", version=2)]
    secret_ledger.secret_scan(docs, ledger, newer).count()
    added = ledger.rows().where("version = 2")
    assert added.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count() and ledger.rows().count() == scanned + added.count()
    assert secret_ledger.secret_scan(docs.limit(0), ledger).count() == 0


def test_redaction_replaces_every_finding(spark, tmp_path):
    docs = odd(documents(spark))
    out = secret_ledger.redact(docs, secret_ledger.BlobLedger.open(spark, str(tmp_path / "ledger")))
    assert out.columns == docs.columns and out.count() == docs.count()
    clean = {r.doc_id: r.text for r in out.collect()}
    plain = {r.doc_id: r.text for r in docs.collect()}
    assert all(brute_spans(t or "") == [] for t in clean.values())
    assert all(clean[i] == plain[i] for i in plain if plain[i] is None or not re.search("key|token|AKIA|PRIVATE|gh[pousr]_", plain[i]))
    assert clean[18].startswith("[SECRET] AKIA1 [SECRET]") and clean[17].endswith("secret:token:longer.value")


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://net", "http://net/", "HTTP://A.B.NET/x?y#z", "http://EXAMPLE.net/en/1", "http://m.example.net/en", "http://example.com/de/", "http://example.com#/de/", "http://x.org/fr/?a=1&b", "http://notnet/x", "a://b://net/", "http://É.org/FR/"]
    r = random.Random(2)
    urls += [f"http://spam{i}.casino.net/win/{i}" for i in range(40)] + [f"https://w{i}.casino.com/win/{i}?ref=x" for i in range(20)] + [f"http://site{r.randint(1, 9)}.org/fr/{i}" for i in range(40)] + ["http://example.com/other"] * 5
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)] + [(None, "http://net/a", 1, "x")], "page_id long, url string, tokens int, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, min_support=0.05).collect()}
    listed = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for page, host, path, rule, verdict in got:
        url = "http://net/a" if page is None else urls[page]
        h = p = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            h = re.match("[^/?#]*", rest)[0]
            p = re.match("[^?#]*", rest[len(h):])[0]
            h = re.sub("[A-Z]", lambda m: m[0].lower(), h)
        fits = [x for x in listed if (h == x[1] or h.endswith("." + x[1])) and p.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        assert (host, path, rule) == (h, p, best and best[1] + best[2])
        assert best is None or verdict == best[0]
    assert all(v == "block" for i, _, _, _, v in got if i is not None and urls[i] and "casino.com" in urls[i])  # carried over by mined tokens
    assert len(got) == len(urls) + 1 and url_rules.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("quick", [True, False])
def test_packing_is_lossless_and_tight(spark, quick):
    docs = odd(documents(spark)).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        vocabulary = f.read()
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")) if quick else None
    out = harmonic_packing.pack(docs.repartition(3), harmonic_packing.byte_bpe_tokens(vocabulary, ranks, public_tokenizers.PATTERN)).collect()
    library = Tokenizer.from_file(path)
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    at = dict.fromkeys(want, 0)
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        part = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.start == at[r.doc_id] and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in want.items()} and any(50256 in x for x in want.values())  # one text holds an added token
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and len(ends) <= sum(ends.values()) / 1024 + 2
    assert harmonic_packing.pack(docs.limit(0), harmonic_packing.byte_bpe_tokens(vocabulary, ranks, public_tokenizers.PATTERN)).count() == 0


def test_packing_keeps_repeated_rows_and_rows_without_id(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d e"), (None, None)], "doc_id long, text string")
    assert queries.pack_documents(docs).count() == 4


def test_cuts_cover_every_length():
    for n in (1, 63, 64, 65, 1023, 1024, 1025, 5000):
        found = harmonic_packing.cuts(n)
        assert sum(length for _, length in found) == n and all(a + b == c for (a, b), (c, _) in zip(found, found[1:], strict=False))


def test_licences_match_sql(spark):
    docs = documents(spark)
    assert rows(license_rules.licence_scan(docs)) == in_duckdb(license_rules.SQL, documents=docs.select("doc_id", "text").toArrow())
    by_id = {r.doc_id: r for r in license_rules.licence_scan(docs).collect()}
    assert by_id[19].sequence == "mit apache2 apache2use" and by_id[19].licences == "Apache-2.0 MIT" and by_id[20].licences == "proprietary" and by_id[0].n_known == 0
    assert license_rules.licence_scan(odd(docs)).count() == odd(docs).count() and license_rules.licence_scan(docs.limit(0)).count() == 0
    every = spark.createDataFrame([(1, ". ".join(license_rules.SENTENCES))], "doc_id long, text string")
    assert license_rules.licence_scan(every).first().n_known == len(license_rules.SENTENCES)


MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD2 = """Copyright (c) 2020, A. Author
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")


def test_wrapped_licence_texts_are_known(spark):
    comment = "\n".join(("# " + x).rstrip() for x in APACHE.split("\n"))
    data = [(MIT, "MIT"), (BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (BSD3.replace("All rights reserved.\n", ""), "BSD-3-Clause"), (APACHE, "Apache-2.0"), (comment, "Apache-2.0"),
            (GPL3, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), (MIT.replace("\n", " "), "MIT"), (GPL3.replace("\n", "\r\n"), "GPL-3.0-or-later"), (MIT.replace("\n\n", "\n"), "MIT"), (LGPL, "LGPL-2.1-or-later"), (LGPL.replace("2.1", "3"), "LGPL-3.0-or-later"), (GPL3.replace("GNU General", "GNU Lesser General"), "LGPL-3.0-or-later"), (MPL, "MPL-2.0"), (GPL3.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"), (ISC, "ISC"), ("Title\n\n \n. \n\n" + ISC, "ISC"), ("Copyright 2020 A. Author\n" + APACHE, "Apache-2.0"), ("Some prose\nReleased under the MIT License\nmore", "MIT")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_rules.licence_scan(docs).collect()}
    assert [got[i].licences for i in range(len(data))] == [x for _, x in data]
    assert rows(license_rules.licence_scan(docs)) == in_duckdb(license_rules.SQL, documents=docs.toArrow())
    assert got[0].sequence == "mitgrant mitnotice mitasis" and got[4].sequence == got[5].sequence == "apache2 apache2use apache2copy apache2asis apache2see"


def test_classifier_learns_held_out_labels_and_leaks_nothing(spark):
    r = random.Random(4)
    bad = ["grumpfle", "snarkoid", "vexbuldge"]
    data = []
    for i in range(600):
        words = [r.choice(WORDS) + r.choice(WORDS) for _ in range(30)]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words[r.randrange(30)] = r.choice(bad)
        data.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([d[:2] for d in data] + [(9000, None), (9001, ""), (None, "grumpfle"), (9002, "z" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (9000, None), (77777, 1)], "doc_id long, toxic int")
    model = nb_linear.train(docs, labels)
    out = {r.doc_id: r.score for r in model.score(docs).collect()}
    held = [(i, y) for i, _, y in data if binascii.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == y for i, y in held]) > 0.97 and all(0 <= s <= 1 for s in out.values()) and out[9000] == out[9001] < 0.5
    turned = labels.withColumn("toxic", F.when(nb_linear.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(nb_linear.train(docs, turned).weights, model.weights)  # held-out labels change nothing
    clash = model.score(odd(documents(spark)))
    assert clash.count() == odd(documents(spark)).count() and clash.columns[-1] == "score"
    none = nb_linear.train(docs, labels.limit(0))
    assert {r.score < 0.5 for r in none.score(docs).collect()} == {True} and none.score(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def brute_components(ids, fps):
    root = {i: i for i in ids}
    for a, fa in zip(ids, fps, strict=True):
        for b, fb in zip(ids, fps, strict=True):
            if a < b and (fa ^ fb).bit_count() <= 3 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_simhash_fingerprints_and_components(spark):
    docs = documents(spark)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash_anchors.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts())}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute_components(list(fps), list(fps.values()))
    strange = odd(docs)
    assert simhash_anchors.near_duplicates(strange).count() == strange.count()
    kept = simhash_anchors.drop_near_duplicates(strange)
    assert kept.columns == strange.columns and {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}
    assert simhash_anchors.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [4096, 7])
def test_anchors_lose_no_link(spark, chunk):
    r = random.Random(8)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 40)):  # chains and dense groups
            fps.add(x)
            y = x
            for b in r.sample(range(64), r.randint(1, 4)):
                y ^= 1 << b
            x = y if r.random() < 0.6 else x
            fps.add(y)
    ids = sorted(fps)
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in ids], "fp long")
    found = {r.node % 2**64: r.root for r in simhash_anchors.components(simhash_anchors.links(frame, chunk=chunk)).collect()}
    groups = {}
    for f in ids:
        groups.setdefault(found.get(f, f"alone {f}"), set()).add(f)
    want = {}
    for f, root in brute_components(ids, ids).items():
        want.setdefault(root, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def five_word_sets(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_pipeline_near_dedup_finds_planted_copies(spark):
    r = random.Random(11)
    data, pairs = [], []
    for n_words, changed in ((100, 1), (100, 2), (300, 5), (300, 6), (1000, 8), (1000, 15), (1000, 20)):
        for _ in range(40):
            words = [r.choice(WORDS) + r.choice(WORDS) for _ in range(n_words)]
            copy = list(words)
            for at in r.sample(range(n_words), changed):
                copy[at] = "other" + str(r.randrange(10**6))
            pairs.append(len(data))
            data += [" ".join(words), " ".join(copy)]
    # one group too large to compare all pairs at an anchor, and exact copies
    base = [r.choice(WORDS) + r.choice(WORDS) for _ in range(200)]
    group = range(len(data), len(data) + 90)
    for i in range(90):
        data.append(" ".join(base[:5 + i] + [f"new{i}"] + base[6 + i:]))
    data += [data[0], data[0].upper(), "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(data)], SCHEMA)
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    sets = [five_word_sets(t or "") for t in data]
    wanted = [i for i in pairs if jaccard(sets[i], sets[i + 1]) >= 0.8]
    assert len(wanted) > 200 and min(jaccard(sets[i], sets[i + 1]) for i in wanted) < 0.82
    assert sum(i + 1 not in kept for i in wanted) >= 0.99 * len(wanted)
    assert all(i + 1 in kept for i in pairs if i not in wanted) and all(i in kept for i in pairs)
    assert kept & set(group) == {group[0]}
    assert [i in kept for i in range(len(data) - 4, len(data))] == [False, False, True, False]
    strange = odd(documents(spark))
    assert simhash_anchors.near_copies(strange).count() == strange.count() and simhash_anchors.near_copies(strange.limit(0)).count() == 0
    assert simhash_anchors.drop_near_copies(strange).columns == strange.columns


def test_near_copies_of_a_dense_family_equal_brute_force(spark):
    """Cells of over 32 sets whose spanning trees do not hold every link."""
    r = random.Random(21)
    base = [r.choice(WORDS) + r.choice(WORDS) + str(i) for i in range(200)]
    data = []
    for _ in range(300):
        words = list(base)
        for at in r.sample(range(200), r.randrange(2, 6)):
            words[at] = "other" + str(r.randrange(10**6))
        data.append(" ".join(words))
    sets = [five_word_sets(t) for t in data]
    root = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(data)], SCHEMA)
    for chunk in (4096, 50):  # also with cells cut in parts
        got = {x.doc_id: x.component_id for x in simhash_anchors.near_copies(docs, chunk=chunk).collect()}
        assert sum(got[i] != root[i] for i in range(len(data))) <= 3 and all(root[got[i]] == root[i] for i in range(len(data)))  # found links are true; recall at 0.8 exactly is 0.995
        assert len(set(root)) > 20


def test_classifier_counts_ratios_and_scores_equal_brute_force(spark, tmp_path):
    r = random.Random(4)
    data = [" ".join(r.choice(WORDS[:6] if i % 3 else WORDS[8:]) for _ in range(r.randrange(0, 12))) + ("" if i % 5 else " Ünïcode 99") for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "doc_id long, text string").repartition(3)
    marks = [(i, int(i % 3 == 0)) for i in range(0, 80, 1) if i % 4]
    fitted = nb_linear.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), bits=12)

    def grams(text):
        """Buckets of every gram, one gram at a time."""
        b = b" " + b" ".join(text.encode().translate(nb_linear.FOLD).split()) + b" "
        g, out = nb_linear.Grams(12), set()
        cut = {b[i:i + n] for n in nb_linear.ORDERS for i in range(len(b) - n + 1) if 32 not in b[i + 1:i + n - 1]}
        cut |= {b" " + w + b" " for w in b.split() if len(w) + 2 <= g.longest} | ({b} if len(b) == 2 else set())  # no word: its two blanks
        for gram in cut:
            h = len(gram)
            for k, c in enumerate(gram):
                h += int(g.values[c]) * int(nb_linear.HASH) ** k
            out.add(h * int(nb_linear.HASH) % 2**64 >> 52)
        return out

    train = [(i, y) for i, y in marks if zlib.crc32(str(i).encode()) % 5]
    count = np.zeros((2, 1 << 12), int)
    for i, y in train:
        count[y, list(grams(data[i]))] += 1
    rows = np.bincount([y for _, y in train])
    labelled = spark.createDataFrame([(i, y, data[i]) for i, y in train], "h long, y int, _t string")
    read = nb_linear.read_rows(labelled, {0: 0.0, 1: 0.0}, 12, nb_linear.ORDERS, 10**9).where("kind = 0").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).collect()
    assert {x.bucket: (x.zeros, x.ones) for x in read} == {-1: tuple(rows)} | {int(b): tuple(count[:, b]) for b in np.flatnonzero(count.sum(axis=0))}
    a = nb_linear.SMOOTHING
    ratio = np.log(((count[1] + a * rows[1] / rows.sum()) / rows[1]) / ((count[0] + a * rows[0] / rows.sum()) / rows[0])) * (count.sum(axis=0) >= nb_linear.LEAST_ROWS)
    samples = sorted([(np.array(sorted(grams(data[i])), np.int64), y) for i, y in train], key=lambda s: s[1])
    weights, bias = nb_linear.fit_weights(samples, ratio, rows[1] / rows.sum())
    np.testing.assert_allclose(fitted.weights, weights, atol=1e-6)
    assert abs(fitted.bias - bias) < 1e-6
    got = {x.doc_id: x.score for x in fitted.score(docs).collect()}
    for i, t in enumerate(data):
        z = weights.astype(np.float32)[sorted(grams(t))].sum(dtype=float) + bias
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-5


def test_label_bitmap_loses_no_row(spark, monkeypatch):
    monkeypatch.setattr(nb_linear, "ID_BITS", 16)
    rows = spark.range(-50, 5000).selectExpr("id AS k", "id AS _bits").union(spark.sql("SELECT CAST(NULL AS BIGINT), 1L"))
    ids = spark.range(0, 5000, 7).selectExpr("id AS i")
    kept = [x.k for x in nb_linear.maybe_in(rows, "k", ids, "i").collect()]
    assert set(range(0, 5000, 7)) <= set(kept) and len(kept) == len(set(kept)) < 1200 and nb_linear.maybe_in(rows, "k", ids.limit(0), "i").count() == 0


def test_digest_index_matches_sql_and_lasts(spark):
    docs = documents(spark)
    index = digest_index.DigestIndex.open(spark, buckets=3)
    assert rows(digest_index.exact_dedup(docs, index, "one")) == in_duckdb(digest_index.SQL, documents=docs.select("doc_id", "text").toArrow())
    size = index.rows().count()
    later = docs.withColumn("doc_id", F.col("doc_id") + 1000).union(spark.createDataFrame([(5000, "something new", "en", "s", 1)], SCHEMA))
    again = digest_index.exact_dedup(later, digest_index.DigestIndex.open(spark, index.path, 3), "two")
    kept = again.where("kept").collect()
    assert [r.doc_id for r in kept] == [5000] and spark.read.parquet(index.path).count() == size + 1
    assert "SortMergeJoin" in index.unseen(digest_index.digests(docs))._jdf.queryExecution().toString()
    small = digest_index.DigestIndex.open(spark, index.path, 3).compact()
    assert small.rows().count() == size + 1
    strange = odd(docs)
    out = digest_index.exact_dedup(strange, digest_index.DigestIndex.open(spark), "odd")
    assert out.count() == strange.count() and out.where("doc_id = 14 AND kept").count() == 2
    assert digest_index.exact_dedup(docs.limit(0), digest_index.DigestIndex.open(spark), "none").count() == 0


def test_pipeline_decisions_take_effect(spark, tmp_path):
    r = random.Random(6)
    data, labels = [], []
    for i in range(800):
        words = [r.choice(WORDS) + r.choice(WORDS) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(6):
                words[r.randrange(60)] = "grumpfle"
        if i == 7:
            words.append("api_key=abcdef123456")
        data.append((i, " ".join(words), "en", "s", 0))
        if i < 700:
            labels.append((i, 1, int(i % 5 == 0)))
    data.append((9000, data[11][1], "en", "s", 0))
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != names[-1]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {x.doc_id for x in docs.select("doc_id").distinct().collect()}
        if name == "toxicity":
            assert ids == {d[0] for d in data if d[0] % 5 or d[0] == 9000}
        if name == "line_dedup":
            assert docs.where("doc_id = 9000").first().text == "" and docs.where("doc_id = 11").first().text == data[11][1]
        if name == "secrets":
            assert docs.where("doc_id = 7").first().text.endswith("[SECRET]")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_replicas_of_fingerprints_are_never_broadcast(spark, tmp_path):
    """A plan counts the 32 replicas of a fingerprint as one row of its size, so a table near the limit would be sent whole to the driver."""
    spark.range(500).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    found = simhash_anchors.links(spark.read.parquet(str(tmp_path / "fps")))
    found.count()
    assert "Broadcast" not in found._jdf.queryExecution().toString()
