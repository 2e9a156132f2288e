"""The pipeline's stages, each on its own input, against brute-force versions."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from test_documents import WORD, brute_links, filled, stats

from lapidary.llm import common, queries, quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(common.stage(stage(spark, docs[-1], SF), f"test-{name}"))
    return [d.collect() for d in docs]


def test_stages_return_the_columns_of_documents(steps):
    assert all(list(rows[0].asDict()) == COLUMNS for rows in steps[:-1])


def test_quality_stage(spark, steps):
    rules = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), queries.table(spark, SF, "labels"))
    want = set()
    for r in steps[0]:
        n, chars, symbols, lines, repeats = stats(r.text or "")
        m = max(n, 1)
        x = {"n_words": n, "mean_word_chars": chars / m, "symbols_per_word": symbols / m, "dup_line_share": lines / m, "repeat_share": repeats / m}
        if n >= 50 and 100 * repeats <= 50 * n and not any(rule.covers(x) for rule in rules):
            want.add(r)
    assert set(steps[1]) == want and len(steps[1]) == len(want)


def test_quality_stage_keeps_good_labels(spark, steps):
    good = {r.doc_id for r in queries.table(spark, SF, "labels").where("quality = 1").collect()}
    fine = {r.doc_id for r in steps[0] if stats(r.text or "")[0] >= 50 and 2 * stats(r.text or "")[4] <= stats(r.text or "")[0]}
    assert len(good & fine - {r.doc_id for r in steps[1]}) <= 0.02 * len(good & fine)


def test_near_duplicates_stage(steps):
    _, label = brute_links({r.doc_id: r.text or "" for r in steps[1]})
    assert Counter(steps[2]) == Counter(r for r in steps[1] if label[r.doc_id] == r.doc_id)
    assert len(steps[2]) < len(steps[1])


def test_mixing_stage(steps):
    words = lambda rows: {s: sum(len(WORD.findall(r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}}
    have, got = words(steps[2]), words(steps[3])
    want = filled(have, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(have))}, 1.5 * sum(have.values()), 2)
    assert all(abs(got.get(s, 0) - want[s]) <= 0.04 * want[s] + 1 for s in want)
    texts = {r.doc_id: r.text for r in steps[2]}
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in steps[3])
    assert max(Counter(r.doc_id for r in steps[3]).values()) == 2


def test_bpe_stage(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    want = Counter()
    for r in steps[3]:
        ids = t.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, r.source, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, steps[4])) == want


def test_run_applies_the_stages(spark, steps):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, steps[4]))
