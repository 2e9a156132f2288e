"""Operators on documents against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lapidary.llm import bpe, common, fingerprints, licenses, mixing, quality, queries, sharding, similarity

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
#: id, text, source and columns whose names clash with those the operators make
SCHEMA = "doc_id long, text string, source string, row int, size string, Path string, bucket int, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None, None, 1, "a", "p", 2, "x"),
        (2, "", "s", 1, "a", "p", 2, "x"),
        (3, " \n\t ", "s", 1, "a", "p", 2, "x"),
        (4, long, None, None, None, None, None, None),
        (5, "one two", "é", 1, "a", "p", 2, "x"),
        (5, "one two", "é", 1, "a", "p", 2, "x"),
        (None, "one two", "s", 1, "a", "p", 2, "x"),
        (7, "a\nb\n\na\nb c\r\n", "s", 1, "a", "p", 2, "x"),
        (8, "naïve 漢字 \U0001f600 <|endoftext|> x", "漢", 1, "a", "p", 2, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- sharding


def test_sharding_contract(spark, texts):
    got = [r.asDict() for r in queries.op1_sharding(spark, SF).collect()]
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert r["grown_shard"] in (r["shard"], 24)
    for s in range(24):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    again = [r.asDict() for r in queries.op1_sharding(spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sharding_grows_as_told(spark, docs):
    at = lambda n: {r.doc_id: r.s for r in docs.select("doc_id", sharding.shard_of(F.col("doc_id"), n, 20)["s"].alias("s")).collect()}
    got = {r.doc_id: r.grown_shard for r in queries.op1_sharding(spark, SF).collect()}
    assert got == at(25)
    assert all(b in (a, 25) for a, b in zip(at(25).values(), at(26).values(), strict=True))


def test_sharding_is_a_shuffle_of_many_buckets(spark, docs):
    w = sharding.write_shards(docs, common.new_path(spark, "t"), shards=3, bucket_bytes=20_000)
    rows = sharding.slots(w, F.col("row.doc_id").alias("doc_id")).orderBy("shard", "slot").collect()
    assert w.select("bucket").distinct().count() > 6
    ids = [r.doc_id for r in rows if r.shard == 0]
    assert len(rows) == docs.count() and ids != sorted(ids)


def test_sharding_edges(spark, odd, empty):
    w = sharding.write_shards(odd, common.new_path(spark, "t"), shards=4)
    got = sharding.slots(w, "row").collect()
    assert Counter(map(repr, (r.row for r in got))) == Counter(map(repr, odd.collect()))
    assert len({r.shard for r in got if r.row.doc_id == 5}) == 1
    assert sharding.slots(sharding.write_shards(empty, common.new_path(spark, "t")), "row").count() == 0


# ---- mixing


def filled(sizes, weights, total, most):
    """Targets by repeated resharing."""
    caps = {s: most * n for s, n in sizes.items()}
    got, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        rest, w = total - sum(caps[s] for s in sizes if s not in open_), sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / w > caps[s]}
        if not over:
            for s in open_:
                got[s] = rest * weights[s] / w
            break
        open_ -= over
    return {s: got[s] if s in open_ else float(caps[s]) for s in sizes}


def test_mixing_contract(spark, docs, texts):
    got = queries.op2_mixing(spark, SF).collect()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    order = sorted(sizes)
    want = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 1 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, queries.op2_mixing(spark, SF).collect()))


@pytest.mark.parametrize("words", [1, 2, 5])
def test_mixing_of_short_documents_reaches_its_targets(spark, words):
    short = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("w " * words).alias("text"), F.lit("a").alias("source"))
    long = spark.range(20_000, 20_400).select(F.col("id").alias("doc_id"), F.lit("w " * 100).alias("text"), F.lit("b").alias("source"))
    got = mixing.mix(short.unionByName(long)).groupBy("row.source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"))
    for r in got.collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target


def test_sainte_lague_is_by_highest_quotients(spark):
    import random

    rng = random.Random(4)
    for _ in range(6):
        w = [rng.choice([0, 1, 1, 5, 100, 1000]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(0, 60)
        df = spark.createDataFrame([(f"{i:02d}", float(x)) for i, x in enumerate(w)], "k string, w double")
        got = {r.k: r.n for r in mixing.sainte_lague(df, F.lit(seats), "w", [], ["k"], "n").collect()}
        won = Counter()
        quotients = sorted(((-x / (2 * j + 1), i) for i, x in enumerate(w) if x for j in range(seats)))
        for _, i in quotients[:seats]:
            won[f"{i:02d}"] += 1
        assert got == {f"{i:02d}": won[f"{i:02d}"] for i in range(len(w))}, (w, seats)


def test_mixed_texts_have_the_words_taken(docs):
    m = mixing.mix(docs, block_words=7, shard_rows=10).cache()
    words = mixing.mixed_texts(m).groupBy("doc_id").agg(F.sum(common.word_count(F.col("text"))).alias("n"))
    want = {r.doc_id: r.taken for r in m.select("row.doc_id", "taken").collect() if r.taken}
    assert {r.doc_id: r.n for r in words.collect()} == want
    assert m.where("part > 0").count() > 1


def test_mixing_edges(odd, empty):
    m = mixing.mix(odd).cache()
    assert m.count() == odd.count()
    assert {r.taken for r in m.where("size = 0").collect()} == {0}
    assert mixing.mixed_texts(m).columns == odd.columns
    assert mixing.mix(empty).count() == 0


# ---- BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_contract(spark, texts, tokenizer):
    for r in queries.op3_bpe(spark, SF).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_joins_are_exact(tokenizer):
    import random

    rng = random.Random(2)
    kinds = ["ab c\n", "  \n\t x", "é漢 \U0001f600 ", "'s 't 're a", "1234 ", "\x1c\x1d a ", "!?#  a", "ab"]
    odd = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([0, 1, 40, 700, 5000]))) for _ in range(300)]
    odd += ["".join(rng.choice(["<|endoftext|>", "<|endo", "ftext|>", " ", "a\n", "x"]) for _ in range(400)) for _ in range(50)]
    odd += ["a" * 40_000, " " * 5_000 + "x"]
    c = bpe.Codec(queries.vocabulary(), cache_chars=100_000)
    for at in range(0, len(odd), 40):
        part = odd[at : at + 40]
        for t, ids in zip(part, c.encode(part), strict=True):
            assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
            assert c.decode(ids) == t


def test_bpe_encodes_shared_passages_once():
    passage = " ".join(f"shared{i}" for i in range(3_000))
    c = bpe.Codec(queries.vocabulary())
    c.encode([f"{i} start {passage} end {i}" for i in range(20)])
    assert c.encoded < 3 * len(passage)


def test_bpe_edges(odd, empty, tokenizer):
    got = bpe.decode(bpe.encode(odd, queries.vocabulary()), queries.vocabulary()).collect()
    assert Counter(r.decoded for r in got) == Counter(r.text or "" for r in odd.collect())
    assert bpe.encode(empty, queries.vocabulary()).count() == 0


# ---- licenses


def test_licenses(spark):
    rows = [
        (1, "Hello.\nReleased under the MIT License."),
        (2, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
        (3, "You may obtain a copy of the License at"),
        (4, None),
        (5, ""),
        (6, "x " * 5_000 + "\nLICENSED under CC BY-NC 4.0!\nThis work is licensed under the GNU General Public License, version 3."),
    ]
    got = {r.doc_id: list(r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "licenses").collect()}
    assert got == {1: ["MIT"], 2: ["Apache-2.0"], 3: [], 4: [], 5: [], 6: ["CC-BY-NC-4.0", "GPL-3.0-only"]}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
BSD2 = BSD.replace(BSD[BSD.index("3. N") : BSD.index("THIS")], "")
PUBLISHED = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "BSD-3-Clause": BSD, "BSD-2-Clause": BSD2, "MPL-2.0": MPL}


def test_licenses_published_texts_however_laid_out(spark):
    layouts = {
        "wrapped": lambda t: t,
        "hash": lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")),
        "star": lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */\nint main() {}",
        "unwrapped": lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")),
        "one line": lambda t: " ".join(t.split()),
        "crlf": lambda t: t.replace("\n", "\r\n"),
    }
    rows = [(f"{name}|{how}", "Copyright (c) 2020 A. Person\n\n" + lay(t) + "\n") for name, t in PUBLISHED.items() for how, lay in layouts.items()]
    got = licenses.scan(spark.createDataFrame(rows, "doc string, text string")).select("row.doc", "licenses", "sentence_ids").collect()
    wrong = [(r.doc, list(r.licenses), list(r.sentence_ids)) for r in got if list(r.licenses) != [r.doc.split("|")[0]]]
    assert not wrong
    assert all(any(m in s for m in licenses.MARKS) for s in licenses.SENTENCES)


def test_licenses_oracle(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = set(map(tuple, c.execute(queries.ORACLES["op5_license_scan"]).fetchall()))
    assert {tuple(r) for r in queries.op5_license_scan(spark, SF).collect()} == want


def test_licenses_edges(odd, empty):
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(empty).count() == 0


# ---- fingerprints


def units(s):
    whole = re.split(fingerprints.BREAK, s)
    parts = [x for p in whole for x in (re.split(fingerprints.FINE, p) if len(p) > fingerprints.LONG else [p])]
    return {p for p in parts if re.search("[^\x20\x09-\x0d]", p)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_contract(spark, texts):
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, SF).collect()}
    ids, same = sorted(texts, reverse=True), {}
    assert sorted(got) == sorted(texts)
    for i, k in enumerate(ids):
        x, y = texts[k], texts[ids[(i + 1) % len(ids)]]
        half = len(x) // 2
        edited, r = x[: len(x) - half] + y[:half], got[k]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(units(x), units(edited))) < 1e-12
        assert abs(r.near_next - jaccard(units(x), units(y))) < 1e-12
        assert same.setdefault(x, r.fingerprint) == r.fingerprint


def test_half_edited_texts_of_one_line_stay_alike(spark):
    words = "the old stone bridge was built in an age of trade and it still carries a road to both towns "
    kinds = {
        "consonants": " ".join(f"Part {i} had its end." for i in range(20)),
        "accents": " ".join(f"Era {i} já acabó allí." for i in range(20)),
        "chinese": "".join(f"第{i}章到此结束。" for i in range(20)),
        "no ends": "".join(words.replace("old", f"old {i}") for i in range(20)),
    }
    rows = [(k, v, v[: len(v) - len(v) // 2] + "Z" * (len(v) // 2)) for k, v in kinds.items()]
    df = spark.createDataFrame(rows, "kind string, a string, b string")
    both = F.size(F.array_intersect(fingerprints.digests(F.col("a")), fingerprints.digests(F.col("b"))))
    assert {r.kind: r.both >= 8 for r in df.select("kind", both.alias("both")).collect()} == dict.fromkeys(kinds, True)


def test_sketches_of_very_long_texts(spark):
    text = "\n".join(f"line {i} of a log" for i in range(40_000))
    rows = spark.createDataFrame([(text, text.replace("line 7 ", "LINE 7 "))], "a string, b string")
    rows = fingerprints.fingerprint(fingerprints.fingerprint(rows, "a"), "b", "b_")
    big = F.size(fingerprints.sketch(F.col("digests"), F.lit(10_000)))
    near = fingerprints.difference(F.col("digests"), F.col("b_digests"), F.col("base"), F.col("b_base"))
    assert rows.select(big, F.size(near)).first()[:] == (240_000, 2)


def test_peeling_needs_no_fallback(spark):
    rows = [(n, list(range(n)), list(range(n // 2, n + n // 2))) for n in (0, 1, 2, 5, 40, 300)]
    df = spark.createDataFrame(rows, "n long, a array<long>, b array<long>")
    for c in "ab":
        df = df.withColumn(c, F.transform(c, lambda x: common.let(F.xxhash64(x).bitwiseAND(F.lit(-65536)), lambda h: h.bitwiseOR(F.xxhash64(h).bitwiseAND(F.lit(65535))))))
    many = F.greatest(F.lit(1), F.size("a"))
    cells = fingerprints.subtract(fingerprints.sketch(F.col("a"), many, 3), fingerprints.sketch(F.col("b"), many, 3))
    df = df.withColumn("m", many).withColumn("cells", cells).withColumn("d", fingerprints.peel(F.col("cells"), F.col("m"), 3))
    done = 0
    for r in df.collect():
        if r.d is not None:
            done += 1
            assert sorted(r.d) == sorted(set(r.a) ^ set(r.b))
    assert done >= 5


def test_a_text_is_digested_once(spark):
    """Its own and its edited text: the next document's digests come with the next document."""
    plan = queries.op6_fingerprints(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[abist]") == 2


def test_breaks_by_replacement(spark):
    import random

    rng = random.Random(3)
    rows = [("".join(rng.choices(" .!?…。！؟\n,;:，、abehinst\t\U0001f600", k=n)),) for n in [0, 1, 2, 3, 5, 8, 40, 299, 301, 2_000] * 20]
    rows += [("".join(rng.choices(" ,;:，、aeinst", k=n)),) for n in (300, 301, 302, 900) * 20]
    for r in spark.createDataFrame(rows, "text string").select("text", F.size(fingerprints.digests(F.col("text"))).alias("n")).collect():
        assert r.n == len(units(r.text))


def test_differences_of_any_size(spark):
    def checked(x):
        return common.let(F.xxhash64(x).bitwiseAND(F.lit(-65536)), lambda h: h.bitwiseOR(F.xxhash64(h).bitwiseAND(F.lit(65535))))

    rows = [(k, list(range(n)), list(range(n - k, n - k + m))) for n, m in ((0, 0), (1, 0), (9, 9), (40, 3), (700, 300)) for k in (0, n // 2, n)]
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>").withColumns({c: F.transform(c, checked) for c in "ab"})
    a, b, one = F.col("a"), F.col("b"), F.lit(1)
    both = fingerprints.sketch(F.concat(a, b), F.lit(50), 7)
    apart = fingerprints.subtract(fingerprints.sketch(a, F.lit(50), 7), fingerprints.sketch(b, F.lit(50), 7))
    near = fingerprints.difference(a, b, fingerprints.sketch(a, one), fingerprints.sketch(b, one))
    # a base that peels to a digest of neither set is no result
    false = fingerprints.difference(a, b, fingerprints.sketch(F.array(checked(F.lit(-5).cast("long"))), one), fingerprints.sketch(F.array().cast("array<long>"), one))
    for r in df.select("a", "b", (both == apart).alias("same"), near.alias("near"), false.alias("false")).collect():
        assert r.same and sorted(r.near) == sorted(r.false) == sorted(set(r.a) ^ set(r.b))


def test_next_rows_over_many_ranges(spark):
    import random

    rng = random.Random(1)
    ids = rng.sample(range(10**6), 500) + [10**12]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "none")], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, "doc_id", ["text"], bucket_rows=20).collect()}
    line = sorted(ids, reverse=True)
    assert len(got) == 502
    assert all(got[a] == f"t{b}" for a, b in zip(line, line[1:], strict=False))
    assert got[line[-1]] == "none" and got[None] == f"t{line[0]}"


def test_fingerprints_edges(odd, empty):
    led = fingerprints.with_next(odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"])
    assert led.count() == odd.count()
    got = fingerprints.fingerprint(odd, "text").select("text", "fingerprint").collect()
    assert len({r.fingerprint for r in got if r.text == "one two"}) == 1
    assert fingerprints.with_next(empty.select("doc_id", "text"), "doc_id", ["text"]).count() == 0


# ---- similarity


def brute_links(texts, width=5):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    ids = sorted(sets)
    near = {i: set() for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < 0.8 * max(len(x), len(y)):
                continue
            if (5 * len(x & y) >= 4 * len(x | y)) if x and y else texts[a] == texts[b] and not x and not y:
                near[a].add(b)
                near[b].add(a)
    label = {}
    for i in ids:
        if i not in label:
            wave = [i]
            while wave:
                j = wave.pop()
                if j not in label:
                    label[j] = i
                    wave += near[j]
    return near, label


def test_similarity_contract(spark, texts):
    near, label = brute_links(texts)
    got = {r.doc_id: r for r in queries.op7_ngram_jaccard_join(spark, SF).collect()}
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (label[i], len(near[i])) for i in texts}


def test_similarity_of_large_near_groups_and_common_passages(spark):
    import random

    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(150):  # one group of near copies
        w = list(base)
        w[rng.randrange(120)] = f"e{i}"
        texts[i] = " ".join(w)
    for i in range(150, 300):  # a common passage in texts that differ
        texts[i] = " ".join(passage + [f"x{rng.randrange(10**9)}" for _ in range(60)])
    for i in range(300, 330):  # pairs of near copies with the passage
        texts[i] = texts[i - 150].replace(" ", "  ", 3) + " end"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    near, label = brute_links(texts)
    got = {r.doc_id: r for r in similarity.join(df, bucket=16, block=32).collect()}
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (label[i], len(near[i])) for i in texts}


def test_similarity_edges(odd, empty):
    got = similarity.join(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[1].n_links == 0 and by[2].n_links == 0 and by[3].n_links == 0  # null, empty and blank differ
    assert by[5].n_links == 1 and by[5].class_id == by[None].class_id
    assert similarity.join(empty).count() == 0
    kept = similarity.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("text = 'one two'").count() == 1


# ---- quality


def stats(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_contract(spark, texts):
    for r in queries.op8_quality_rules(spark, SF).collect():
        n, *rest = stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_keeps_good_documents_it_has_not_seen(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, d, "documents"), queries.table(spark, d, "labels")
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judge(docs, rules).select("row.doc_id", "kept", "base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert bad.where("NOT kept").count() >= 0.9 * bad.count()


def test_decision_lists_find_conjunctions():
    rows = [({f: 0.0 for f in quality.FEATURES} | {"n_words": float(i % 50), "symbols_per_word": (i * 7 % 40) / 40}, False) for i in range(2_000)]
    rows = [(x, x["n_words"] < 10 and x["symbols_per_word"] > 0.5) for x, _ in rows]
    rules = quality.learn(rows)
    wrong = sum(any(r.covers(x) for r in rules) != bad for x, bad in rows)
    assert wrong <= 20 and any(len(r.tests) > 1 for r in rules)
    assert quality.learn([]) == [] and quality.learn([(x, False) for x, _ in rows]) == []


def test_quality_edges(odd, empty):
    got = {r.doc_id: r for r in quality.judge(odd, []).select("row.doc_id", "n_words", "n_dup_lines", "n_repeat_words").collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0
    assert got[7].n_dup_lines == 1 and got[4].n_repeat_words == stats(next(r.text for r in odd.collect() if r.doc_id == 4))[4]
    assert quality.judge(empty, []).count() == 0
    many = odd.sparkSession.createDataFrame([(1, " ".join(f"{i % 60}" for i in range(4_000)))], "doc_id long, text string")
    assert quality.judge(many, []).first().n_repeat_words == 4_000
