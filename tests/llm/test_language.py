import math
import random
import zlib

import numpy as np
import pytest

from lignum.llm import language


def brute_bits(texts, text, order, least):
    """Code length by counting contexts one by one."""
    counts = {}
    for t in texts:
        for i, b in enumerate(t):
            for k in range(min(i, order) + 1):
                counts.setdefault(t[i - k : i], {}).setdefault(b, 0)
                counts[t[i - k : i]][b] += 1
    counts = {c: f for c, f in counts.items() if len(c) < order or sum(f.values()) >= least}
    bits = 0.0
    for i, b in enumerate(text):
        for k in range(min(i, order), -2, -1):
            follow = counts.get(text[i - k : i]) if k >= 0 else None
            if k < 0:
                bits += 8
            elif follow:
                total = sum(follow.values()) + len(follow)
                if b in follow:
                    bits -= math.log2(follow[b] / total)
                    break
                bits -= math.log2(len(follow) / total)
    return bits


@pytest.mark.parametrize("slice_", [7, 1 << 20])
def test_code_lengths_are_exact(monkeypatch, slice_):
    monkeypatch.setattr(language, "SLICE", slice_)
    draw = random.Random(1)
    make = lambda pool, n: bytes(draw.choice(pool) for _ in range(n))
    train = {"xx": [make(b"abcd ", 40) for _ in range(8)], "yy": [make(b"bcdef ", 30) for _ in range(9)]}
    model = language.Model(train)
    texts = [b"", b"a", *[make(b"abcdefgz ", draw.randint(0, 25)) for _ in range(30)], b""]
    got = model.lengths(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts]))
    for i, lang in enumerate(model.langs):
        for j, t in enumerate(texts):
            assert abs(got[i, j] - brute_bits(train[lang], t, language.ORDER, language.LEAST)) < 1e-3 * max(1, len(t)), (lang, t)


@pytest.mark.parametrize("states", [1, 2, 40, 100])
def test_models_keep_to_their_size(states):
    """Of too many contexts the frequent ones stay, and code lengths are those of the trees without the others."""
    draw = random.Random(2)
    train = {c: [bytes(draw.choice(b"abcd" + c.encode()) for _ in range(60)) for _ in range(4)] for c in "xyz"}
    size = language.Model(train).size
    model = language.Model(train, most_bytes=states * 4 * size * 3)
    assert model.bits.nbytes <= states * 4 * size * 3
    assert model.bits.nbytes < language.Model(train).bits.nbytes
    text = np.frombuffer(b"abxdcba", dtype=np.uint8)
    if states == 1:  # the empty context alone
        got = model.lengths(text, np.array([len(text)]))
        assert np.allclose(got[:, 0], [brute_bits(train[c], text.tobytes(), 0, 1) for c in "xyz"], atol=1e-3)


def test_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ALL", 12)
    df = spark.range(40).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 4) AS lang")
    assert all(0 < len(v) <= 3 for v in language.sample(df).values())
    monkeypatch.setattr(language, "LANGUAGES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        language.sample(df)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = [r for r in docs.collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(got) == docs.count() and all(got[r.doc_id].held_out for r in rows)
    known = [r for r in rows if got[r.doc_id].lang_pred != "und"]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in known) >= 0.97 * len(known)


def test_odd_rows(spark):
    rows = [(1, "der die das und", "de", "x"), (2, "the of and", "en", "x"), (3, None, "en", "x"), (4, "", None, "x"), (5, "12 --", "de", "x"), (None, "the", "en", "x"), (6, "the " * 40_000, None, "x")]
    df = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string, lang string, score string")
    got = language.identify(df).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[3].score == 0 and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    assert language.identify(df.limit(0)).count() == 0


def test_languages_of_long_texts_only_are_learned(spark):
    import corpus_pipeline

    draw = random.Random(2)
    make = lambda words, n: " ".join(draw.choice(words) for _ in range(n))
    de, en = "der die das und nicht ein werden über zwischen".split(), "the of and with which their would through".split()
    ddl = "doc_id long, text string, lang string, source string, n_chars int"
    long = [(i, make(de, 3000), "de", "s", 1) for i in range(6)]
    short = [(100 + i, make(en, 20), "en", "s", 1) for i in range(20)]
    assert min(len(r[1]) for r in long) > language.SAMPLE_CHARS > max(len(r[1]) for r in short)
    for rows in (long + short, long):
        df = spark.createDataFrame(rows, ddl)
        assert {r.doc_id: r.lang_pred for r in language.identify(df).collect()} == {r[0]: r[2] for r in rows}
        assert corpus_pipeline.identify_language(spark, df, "").count() == len(rows)


def test_sample_is_bounded_and_prefers_short_texts(spark):
    rows = [(i, f"short {i}", "a") for i in range(40)] + [(100 + i, "é" * 50 + "long" * 100, "a") for i in range(40)]
    rows += [(200, "once " * 3, "b"), (203, "".join(chr(97 + i % 26) for i in range(1000)), "b"), (203, "x" * 1000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.sample(df, rows=12, chars=90)
    assert {k: len(v) for k, v in found.items()} == {"a": 12, "b": 12} and all(t.startswith(b"short") for t in found["a"])
    assert all(len(t.decode()) <= 90 for t in found["b"])
    whole = language.sample(df, rows=1000, chars=90)
    kept = {t[0] for t in rows if zlib.crc32(str(t[0]).encode()) % 3 != 1}
    for lang in "ab":
        assert sum(map(len, whole[lang])) == sum(len(t.encode()) for i, t, k in rows if k == lang and i in kept)
