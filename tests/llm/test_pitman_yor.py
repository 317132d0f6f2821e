import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lignum.llm import pitman_yor as py

LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def texts():
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "É"]
    rows = [(i, " ".join(draw.choice(words[: draw.choice([5, 20, 63])]) for _ in range(draw.randint(0, 40)))) for i in range(300)]
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (None, "the w1"), (1003, "the " * 5000), rows[3], (1004, "never seen words")]


@pytest.mark.parametrize("small", [True, False])
def test_contract_columns(spark, monkeypatch, small):
    if small:
        for name, value in (("HEAVY", 30), ("BUCKET_TOKENS", 700), ("PACK_TOKENS", 400), ("PACK_DOCS", 50), ("SUMMED", 3)):
            monkeypatch.setattr(py, name, value)
    rows = texts()
    got = py.score(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS chunk")).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = {(i, held(i), len(w := tokens(t)), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows}
    assert len(got) == len(rows) and {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got} == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    order = lambda pairs: [x for *_, x in sorted((i is None, i or 0, x) for i, x in pairs)]
    assert np.allclose(order([(r.doc_id, r.score) for r in got]), order(zip([i for i, _ in rows], brute(rows, held), strict=True)), atol=1e-5)


def hashes(text):
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    words, _ = py.word_hashes(data, np.array([len(data)]))
    return [int(w) for w in words] + [int(py.END)]


def seat(c, s, d, key, sweep, n=1, t=1):
    """One customer after another, by the chance that none has opened a table since the last one did."""
    opened, nth, none = [], 0, 1.0
    while n < c:
        draw = float(py.uniform(np.array([key], dtype=np.uint64), sweep, nth)[0])
        none *= (n - d * t) / (s + n - d * t)
        if none < draw:
            opened.append(n)
            t, nth, none = t + 1, nth + 1, 1.0
        n += 1
    return opened


def weight(c, s, d, opened):
    total, t = 0.0, 1
    for n in range(1, c):
        total += math.log(s + n - d * t)
        t += n in opened
    return total


def step(c, s, d, key, sweep, old):
    if c < 2:
        return []
    place = c ** float(py.uniform(np.array([key], dtype=np.uint64), 2 * sweep + 1, 1)[0])
    stay = min(c - 1, max(1, math.floor(max(place, c * math.exp(-py.OPENINGS / s)))))
    new = [n for n in old if n < stay]
    new += seat(c, s, d, key, 2 * sweep, stay, 1 + len(new))
    draw = float(py.uniform(np.array([key], dtype=np.uint64), 2 * sweep + 1, 0)[0])
    return new if math.log(draw) < weight(c, s, d, new) - weight(c, s, d, old) else old


def brute(rows, held, sweeps=3, samples=2):
    """The model with plain dictionaries, customer by customer: log10 scores in order of rows."""
    texts = [hashes(t) for _, t in rows]
    tokens = sum(map(len, texts))
    contexts = max(1 << 12, 1 << (tokens // 32).bit_length())
    restaurant = lambda before: int(py.mixed(np.array([before * 3 % 2**64], dtype=np.uint64))[0]) >> 32 & (contexts - 1)
    pairs = [[(restaurant(b), w) for b, w in zip([int(py.START), *t[:-1]], t, strict=True)] for t in texts]
    c = Counter(p for (i, _), ps in zip(rows, pairs, strict=True) if not held(i) for p in ps)
    key = {(u, w): int(py.mixed(np.array([(w + u * 0xA0761D6478BD642F) % 2**64], dtype=np.uint64))[0]) for u, w in c}
    once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
    d = once / (once + 2 * twice) if once and twice else 0.5
    vocabulary, customers = {w for _, w in c}, Counter()
    for (u, _), n in c.items():
        customers[u] += n

    def given(opened, parent):
        sent, tables = Counter(), Counter()
        for (u, w) in c:
            sent[w] += 1 + len(opened[u, w])
            tables[u] += 1 + len(opened[u, w])
        t1 = {w: 1 + len(parent[w]) for w in sent}
        base = (py.THETA_PARENT + py.DISCOUNT_PARENT * sum(t1.values())) / (len(vocabulary) + 1)
        above = lambda w: (sent[w] - py.DISCOUNT_PARENT * t1.get(w, 0) + base) / (py.THETA_PARENT + sum(sent.values()))
        return sent, tables, t1, above

    opened, parent = {p: [] for p in c}, {w: [] for w in vocabulary}
    chance = Counter()
    for number in range(sweeps):
        sent, tables, t1, above = given(opened, parent)
        strength = {(u, w): (py.THETA + d * max(0, tables[u] - 1 - len(opened[u, w]))) * above(w) for u, w in c}
        if not number:
            opened = {p: [min(n - 1, math.floor((strength[p] + 1) * math.exp(j / strength[p]) - strength[p])) for j in range(1, int(strength[p] * math.log((strength[p] + n - 1) / (strength[p] + 1))) + 1)] if n > 1 else [] for p, n in c.items()}
        new = {p: step(n, strength[p], d, key[p], number, opened[p]) for p, n in c.items()}
        after, _, _, _ = given(new, parent)
        for w in parent:
            s = (py.THETA_PARENT + py.DISCOUNT_PARENT * (sum(t1.values()) - t1[w])) / (len(vocabulary) + 1)
            stay = [n for n in parent[w] if n < after[w]]
            stay += seat(after[w], s, py.DISCOUNT_PARENT, w, py.JOINED + number, min(sent[w], after[w]), 1 + len(stay))
            parent[w] = step(after[w], s, py.DISCOUNT_PARENT, w, number, stay)
        opened = new
        if number >= sweeps - samples:
            _, tables, _, above = given(opened, parent)
            for u, w in {p for ps in pairs for p in ps}:
                own = c[u, w] - d * (1 + len(opened[u, w])) if (u, w) in c else 0
                chance[u, w] += (own + (py.THETA + d * tables[u]) * above(w)) / (py.THETA + customers[u]) / samples
    return [sum(math.log10(chance[p]) for p in ps) for ps in pairs]


def test_order_is_learned(spark):
    """Held-out texts of a language in which each word goes before few others."""
    draw = random.Random(3)
    follow = {i: draw.sample(range(300), 4) for i in range(300)}
    rows = []
    for i in range(400):
        at, words = draw.randrange(300), []
        for _ in range(60):
            words.append(f"w{at}")
            at = draw.choice(follow[at])
        rows.append((i, " ".join(words)))
    got = [r for r in py.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got) and all(r.score > r.base_score for r in got)


def test_probabilities_sum_to_one():
    """Over the vocabulary and one unknown word, after sweeps, in every context."""
    draw = np.random.default_rng(2)
    words = np.sort(draw.integers(1, 2**62, 40).astype(np.uint64))
    c = draw.poisson(1.2, size=(40, 8)) * (draw.random((40, 1)) < 0.9)
    model = py._pack(words, np.full(40, 8, np.uint32), np.tile(np.arange(8, dtype=np.uint32), 40), c.ravel().astype(np.uint32))
    b = py.Bucket(model, np.zeros(0, np.uint64))
    fixed = {"C": c.sum(axis=0).astype(float), "V": int((c.sum(axis=1) > 0).sum()), "discount": 0.6, "heavy_sent": np.zeros(0), "heavy_t1": np.zeros(0)}
    state = b.start()
    for number in range(3):
        v = b.totals(state, 0, 8)
        given = fixed | {"T": v[:8], "N1": v[-2], "T1": v[-1]}
        p = b.probability(state, given).reshape(40, 8)
        known = c.sum(axis=1) > 0
        unknown = (py.THETA + 0.6 * given["T"]) * ((py.THETA_PARENT + py.DISCOUNT_PARENT * given["T1"]) / (given["V"] + 1) / (py.THETA_PARENT + given["N1"])) / (py.THETA + fixed["C"])
        assert np.allclose(p[known].sum(axis=0) + unknown, 1)
        assert np.allclose(p[~known], unknown)
        state = b.sweep(state, given, number)
        t = state["seats"].t
        assert ((t <= b.c) & (t >= (b.c > 0))).all()


def test_log_gamma():
    x = np.concatenate([np.linspace(0.01, 20, 500), [1e3, 1e6, 1e9]])
    want = np.array([math.lgamma(v) for v in x])
    assert np.allclose(py.log_gamma(x), want, rtol=1e-12, atol=1e-11)


@pytest.mark.parametrize(("c", "s", "d"), [(2, 0.7, 0.4), (12, 0.7, 0.4), (60, 1.5, 0.5)])
def test_seating_follows_its_law(c, s, d):
    """Tables of many items after Gibbs steps, against the law that weighs a seating by s for each new table and n - d * t for the others."""
    items = 6000
    law = {(1, 1): 1.0}  # (customers, tables): summed weight of the ways to seat them, scaled
    for n in range(1, c):
        for t in range(1, n + 1):
            w = law.get((n, t), 0)
            law[n + 1, t] = law.get((n + 1, t), 0) + w * (n - d * t) / n
            law[n + 1, t + 1] = law.get((n + 1, t + 1), 0) + w * s / n
    want = np.array([law.get((c, t), 0) for t in range(c + 1)])
    want /= want.sum()
    seats, key = py.Seats(np.full(items, c)), py.mixed(np.arange(items, dtype=np.uint64))
    for sweep in range(120 if c > 20 else 25):
        seats = seats.again(np.full(items, s), d, key, sweep)
    got = np.bincount(seats.t.astype(int), minlength=c + 1) / items
    assert np.abs(got - want).max() < 0.03
    # Customers who join and leave: the first ones stay as they sat.
    more = seats.resized(np.full(items, c + 8), np.full(items, s), d, key, 50)
    assert (more.t >= seats.t).all() and (more.resized(np.full(items, c), np.full(items, s), d, key, 51).t == seats.t).all()
    assert (more.resized(np.zeros(items), np.full(items, s), d, key, 52).t == 0).all()


def test_a_pair_of_any_number_of_customers_takes_few_draws():
    many, key = py.Seats(np.full(500, 10**9)), py.mixed(np.arange(500, dtype=np.uint64))
    for sweep in range(6):
        many = many.again(np.full(500, 3.0), 0.4, key, sweep)
    assert 1.5 < many.t.mean() < 50 and (many.before < 10**9).all()


def test_empty_table(spark):
    assert py.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_buckets_share_no_file(spark):
    """Hashed to few partitions, several buckets would be read, and so held, by one task."""
    rows = spark.createDataFrame([(i, " ".join(f"w{i * k % 211}" for k in range(1, 60))) for i in range(100)], "doc_id long, text string")
    dealt = py._dealt(rows, np.zeros(0, np.uint64), 40, 4096).filter("bucket >= 0")
    files = dealt.selectExpr("input_file_name() AS file", "bucket").collect()
    assert len({r.bucket for r in files}) == len({r.file for r in files}) == len(files) > 30
