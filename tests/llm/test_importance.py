"""Importance resampling against the same sums one document at a time."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lignum.llm import importance

SCHEMA = "doc_id long, text string, weight string, buckets long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def bag(text, longest, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)


def drawn(docs, target, percent, least, longest, buckets):
    s, t = Counter(), Counter()
    for _, text in docs:
        s += bag(text, longest, buckets)[1]
    for text in target:
        t += bag(text, longest, buckets)[1]
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, counts = bag(text, longest, buckets)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain[b] for b, k in counts.items())
        rows.append([doc_id, counts.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    entered = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[5]))
    for k, r in enumerate(entered[: percent * len(entered) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("longest,buckets,piece", [(1, 10_000, 1 << 20), (1, 7, 64), (3, 50, 40)])
def test_against_sums_by_document(spark, monkeypatch, longest, buckets, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    monkeypatch.setattr(importance, "ENTRIES", 60)
    draw = random.Random(buckets)
    words = ["the", "The", "É", "é9", "x1", "--", "日本", "it's", "\x7f", "a" * 90]
    docs = [(draw.choice([i, i, None]), " ".join(draw.choices(words, k=draw.choice([0, 3, 30])))) for i in range(80)]
    docs += [(500, None), (501, ""), (502, "...")] + [docs[5]] * 30 + [(503, "w" * 300 + " " + "b c " * 5000)]
    target = ["the É", None, "x1 x1 the"]
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in docs], SCHEMA)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, aims, 40, 3, longest=longest, buckets=buckets).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn(docs, target, 40, 3, longest, buckets)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b", "w", 3)], SCHEMA)
    assert importance.resample(none, some).count() == 0
    assert [tuple(r) for r in importance.resample(some, none, 100, 1).select("doc_id", "n_features", "rank").collect()] == [(1, 2, 1)]


def test_blocks_hold_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(importance, "ENTRIES", 3)
    docs = spark.createDataFrame([(i, f"a b{i} b{i}", "w", 3) for i in range(6)], SCHEMA).coalesce(1)
    blocks = importance.csr_blocks(docs).collect()
    assert len(blocks) == 3 and all(r.bounds == [0, 2, 4] and sorted(r.counts) == [1, 1, 2, 2] for r in blocks)
    assert sorted(i for r in blocks for i in r.doc_ids) == list(range(6))
