import random
import re

import corpus_pipeline as pipeline
from lignum.llm import bpe, ngram_join
from tests.llm.test_ngram_join import brute

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    draw = random.Random(8)
    words = {"en": ["the", "of", "and", "that", "house", "when"], "de": ["der", "und", "nicht", "haus", "wenn", "für"]}
    out = []
    for i in range(120):
        lang = draw.choice(["en", "de"])
        text = " ".join(draw.choice(words[lang]) + str(draw.randint(0, 30) or "") for _ in range(draw.randint(8, 60)))
        out.append((i, text, lang, f"s{i % 3}", len(text)))
    out += [(200 + i, out[i][1], out[i][2], "s1", 1) for i in range(15)] + [(300 + i, out[20 + i][1] + " more", "en", None, 1) for i in range(10)]
    return out + [(400, None, "en", "s1", 0), (401, "", "en", "s1", 0), (402, "12 34", None, "s1", 5), (403, "Öl", "de", "s2", 2), out[0], (None, "the house", "en", "s1", 9)]


def test_stages(spark):
    docs = spark.createDataFrame(rows(), DDL)
    _, stage = pipeline.STAGES[0]
    first = stage(spark, docs, "")
    assert first.columns == list(pipeline.COLUMNS)
    assert sorted(map(tuple, first.collect()), key=str) == sorted([r for r in rows() if r[1] and re.search(r"[^\W\d_]", r[1])], key=str)

    second = pipeline.STAGES[1][1](spark, first, "")
    near = brute([(r.doc_id, r.text) for r in first.collect() if r.doc_id is not None], 5, 80)
    kept = second.collect()
    assert second.columns == list(pipeline.COLUMNS)
    assert sorted([r.doc_id for r in kept], key=str) == sorted([i for i, (_, root) in near.items() if root == i] + [None], key=str)

    third = pipeline.STAGES[2][1](spark, second, "")
    copies = {}
    for r in third.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert third.columns == list(pipeline.COLUMNS) and set(copies) <= {r.doc_id for r in kept} and max(copies.values()) <= 3

    last = pipeline.STAGES[3][1](spark, third, "").collect()
    assert len(last) == sum(copies.values()) and ngram_join.N_WORDS == 4 and bpe.LEXICON


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0
    assert [f.__name__ for _, f in pipeline.STAGES] == ["identify_language", "drop_near_copies", "mix_sources", "encode_tokens"]
