"""Every operator on documents, with columns whose names clash with its own, and on tables without rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lignum.llm import bpe, chat, importance, language, licenses, mixing, ngram_join, pitman_yor, prefix_trie

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use within or give out.
CLASHES = ("label", "size", "held_out", "slot", "n", "key", "weight", "score", "rank", "copies", "tokens", "words", "node", "a", "b", "h", "hash", "block", "part", "seq", "target", "n_words", "lang_pred", "component_id", "codes")
OPERATORS = {
    "language": language.identify,
    "mixing": mixing.mix,
    "ngram_join": ngram_join.join,
    "pitman_yor": lambda d: pitman_yor.score(d, 1, 1),
    "bpe": lambda d: bpe.digests(d, bpe.default_path()),
    "licenses": licenses.scan,
    "importance": lambda d: importance.resample(d, d.select("text")),
}


def documents(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["the", "of", "haus", "mit", "license", "und", "apache"]) for _ in range(draw.randrange(60))), draw.choice(["en", "de"]), f"s{i % 3}", 1) for i in range(40)]
    return spark.createDataFrame(rows + [(90, None, None, None, None), rows[3], (None, "the", "en", "s1", 3)], DDL)


def shown(df):
    return sorted((str(r) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(spark, name):
    docs = documents(spark).coalesce(1)
    clashing = docs.withColumns({c: F.lit("x") for c in CLASHES})
    assert shown(OPERATORS[name](clashing)) == shown(OPERATORS[name](docs)) != []


def test_clashing_columns_of_conversations(spark):
    rows = [(i % 4, i, "user", f"t{i % 3}") for i in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = turns.withColumns({c: F.lit("x") for c in (*CLASHES, "pos", "depth", "message", "kind", "own", "k", "piece", "bytes")})
    assert shown(chat.formatted(chat.log_of(clashing))) == shown(chat.formatted(chat.log_of(turns)))
    tries = [prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered_turns(t))) for t in (clashing, turns)]
    assert shown(tries[0]) == shown(tries[1]) != []


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_without_rows(spark, name, stage):
    empty = documents(spark).limit(0).withColumns({c: F.lit("x") for c in CLASHES})
    found = stage(spark, empty, "")
    assert found.count() == 0
    if name != pipeline.STAGES[-1][0]:
        assert found.columns == list(pipeline.COLUMNS)
