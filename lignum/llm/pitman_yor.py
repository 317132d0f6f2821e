"""Language-model scoring by a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Each token follows a context, the word before it, which has a restaurant. There word w has c customers
at t tables; every table sends one customer to a parent restaurant that all contexts share, whose own
tables draw from a uniform base over the vocabulary and one unknown word. A word's probability is

    (c - d * t + (theta + d * T) * parent(w)) / (theta + C)

with the context's totals C and T, likewise one level up. Restaurants are as many as the input has room
for (one in ``TOKENS_EACH`` tokens, ``MOST_CONTEXTS`` at most, since their totals are broadcast); contexts
are hashed to them, and share one where there are more.

A Gibbs sweep takes the customers of each (context, word) out and seats them again given all others, for
which it needs only the totals of the sweep before, its own tables taken out of them. With the others
fixed, a seating's weight is the product of what each customer's choice weighs: s = (theta + d * T) *
parent(w) for a new table, n - d * t for the old ones. Customers seated one after another propose a
seating, and a Metropolis step accepts it or keeps the old one, so that the conditional law is kept
exactly. The customers who stand up are those after a place in the queue that is drawn first, evenly on
a logarithmic scale, as a pair with many customers would hardly ever accept a wholly new seating, and no
sooner than ``OPENINGS`` new tables are to be expected. The first sweep starts from seatings near their
expectation. Only customers who open a table are drawn, by the waiting time to the next one, so a pair takes
as many draws as it has tables, whatever its customers. When a word's customers in the parent change,
the last leave or new ones join before the step. The scores average the predictive probabilities of the
last sweeps.

Data is dealt by word. One shuffle brings every occurrence, packed in four bytes, to its word's
bucket; there counts are made, seats drawn, and the occurrences scored in place. Words above one in
``HEAVY`` tokens, of which there can be no more than ``HEAVY``, are dealt by word and context instead,
and their totals travel with the vectors. Buckets hold about as many tokens at any size of input, and no
two share a partition or a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm.common import fold_of, map_batches, table, written
from lignum.llm.vectors import groups
from lignum.llm.words import chunks, mixed, word_hashes

FOLDS, HELD_OUT = 7, 2
#: An occurrence packs its context, whether it is held out, and its text within the chunk, into 32 bits.
CONTEXT_BITS, DOC_BITS = 20, 11
TOKENS_EACH, LEAST_CONTEXTS, MOST_CONTEXTS = 32, 1 << 12, 1 << CONTEXT_BITS
HEAVY = 4096
BUCKET_TOKENS = 700_000
#: Texts and tokens that a task packs at a time.
PACK_DOCS, PACK_TOKENS = 1 << DOC_BITS, 250_000
SWEEPS, SAMPLES = 3, 2
THETA, THETA_PARENT, DISCOUNT_PARENT = 1.0, 1.0, 0.5
#: Sweep number from which draws of customers that join count.
JOINED = 1 << 20
DOC_MASK = np.uint32((1 << DOC_BITS) - 1)
#: Tables that one step opens anew, about, at most.
OPENINGS = 16
#: Sums of base scores travel in steps of one in this.
SUM_UNIT = float(1 << 30)
#: Vectors that are added up in one task.
SUMMED = 32
END = np.uint64(0xE7D0_0000_0000_0001)
START = np.uint64(0x57A7_0000_0000_0001)
_U = np.uint64


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, words and end, their contexts) of each text."""
    with np.errstate(over="ignore"):
        for low, high, data, ends in chunks(batch["text"]):
            words, at = word_hashes(data, ends)
            n = np.diff(at)
            out = np.insert(words, at[1:], END)
            stops = at[1:] + np.arange(1, high - low + 1)
            before = np.concatenate([[START], out[:-1]]) if len(out) else out
            before[stops - n - 1] = START
            context = (mixed(before * _U(3)) >> _U(32)).astype(np.uint32)
            for i, (a, b) in enumerate(zip(stops - n - 1, stops, strict=True)):
                yield low + i, out[a:b], context[a:b]


def _heavy(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of words that make up more than one in HEAVY tokens, sorted, and the number of tokens.

    Such a word is as frequent in at least one part of the data, so parts report only theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def report(parts: list) -> dict:
            word, n = np.unique(np.concatenate(parts), return_counts=True)
            often = n * HEAVY > n.sum()
            return {"word": [None, *word[often].view(np.int64).tolist()], "n": [int(n.sum()), *n[often].tolist()]}

        waiting, held = [], 0
        for batch in batches:
            for _, words, _ in _tokens(batch):
                waiting.append(words)
                held += len(words)
                if held >= PACK_TOKENS:
                    yield report(waiting)
                    waiting, held = [], 0
        if waiting:
            yield report(waiting)

    found = map_batches(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = found.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    # At most HEAVY of them pass.
    rows = found.filter(F.col("word").isNotNull() & (F.col("n") * HEAVY > total)).select("word").collect()
    return np.sort(np.array([r.word for r in rows], dtype=np.int64).view(np.uint64)), int(total)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([len(a).to_bytes(8, "little") + np.ascontiguousarray(a).tobytes() for a in arrays])


def _unpack(blob, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(np.frombuffer(blob, dtype=kind, count=n, offset=at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


def _dealt(docs: DataFrame, heavy: np.ndarray, buckets: int, contexts: int) -> DataFrame:
    """One row per bucket with its words, pairs, counts and occurrences, and one per chunk of texts (negative buckets)."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        heavy, part, k = shared.value, TaskContext.get().partitionId(), 0

        def flush(ids, held, texts) -> Iterator[dict]:
            sizes = np.array([len(w) for w, _ in texts])
            word, context = np.concatenate([w for w, _ in texts]), np.concatenate([c for _, c in texts]) & np.uint32(contexts - 1)
            doc = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
            with np.errstate(over="ignore"):
                home = mixed(word + _U(11))
                if len(heavy):
                    spread = heavy[np.minimum(np.searchsorted(heavy, word), len(heavy) - 1)] == word
                    home = np.where(spread, mixed(home + context), home)
            bucket = (home % _U(buckets)).astype(np.int64)
            order = np.lexsort((word, bucket))
            word, bucket = word[order], bucket[order]
            packed = context[order] << np.uint32(DOC_BITS + 1) | np.array(held, dtype=np.uint32)[doc[order]] << np.uint32(DOC_BITS) | doc[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            chunk = part << 24 | k
            blobs, names = [], []
            for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True):
                first = np.concatenate([[0], np.flatnonzero(np.diff(word[a:b])) + 1])
                names.append(int(bucket[a]))
                blobs.append(_pack(word[a:b][first], np.diff(np.append(first, b - a)).astype(np.uint32), packed[a:b]))
            yield {"bucket": names, "chunk": [chunk] * len(names), "blob": blobs, "ids": [None] * len(names), "held": [None] * len(names), "n": [None] * len(names)}
            yield {"bucket": [-1 - chunk % 1024], "chunk": [chunk], "blob": [None], "ids": [ids], "held": [held], "n": [sizes.tolist()]}

        ids, held, texts, tokens = [], [], [], 0
        for batch in batches:
            own_ids, own_held = batch["doc_id"].to_pylist(), batch["held_out"].to_pylist()
            for row, words, context in _tokens(batch):
                if texts and (len(texts) == PACK_DOCS or tokens + len(words) > PACK_TOKENS):
                    yield from flush(ids, held, texts)
                    ids, held, texts, tokens, k = [], [], [], 0, k + 1
                ids.append(own_ids[row])
                held.append(own_held[row])
                texts.append((words.copy(), context.copy()))
                tokens += len(words)
        if texts:
            yield from flush(ids, held, texts)

    ready = docs.select("doc_id", "text", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.col("doc_id").isNull()).alias("held_out"))
    ddl = "bucket long, chunk long, blob binary, ids array<long>, held array<boolean>, n array<long>"
    # Each bucket is one partition and so one file: buckets are large rows, and tasks hold those that they read together.
    sent = map_batches(ready, deal, ddl).repartitionById(buckets, F.pmod("bucket", F.lit(buckets)).cast("int")).sortWithinPartitions("bucket", "chunk")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for group in groups(batches, ["bucket"]):
            bucket = group["bucket"][0].as_py()
            if bucket < 0:
                yield {"bucket": group["bucket"].combine_chunks(), "chunk": group["chunk"].combine_chunks()} | {c: group[c].combine_chunks() for c in ("ids", "held", "n")} | dict.fromkeys(("model", "uses"), [None] * group.num_rows)
                continue
            word, packed, chunk = [], [], []
            for i, blob in enumerate(group["blob"].to_pylist()):
                w, n, p = _unpack(blob, np.uint64, np.uint32, np.uint32)
                word.append(np.repeat(w, n))
                packed.append(p)
                chunk.append(np.full(len(p), i, dtype=np.uint32))
            word, packed, chunk = map(np.concatenate, (word, packed, chunk))
            context = packed >> np.uint32(DOC_BITS + 1)
            order = np.lexsort((context, word))
            word, context, packed, chunk = word[order], context[order], packed[order], chunk[order]
            fresh = np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])])
            first = np.flatnonzero(fresh)
            uses = np.diff(np.append(first, len(word)))
            learned = np.add.reduceat(1 - (packed >> np.uint32(DOC_BITS) & np.uint32(1)).astype(np.int64), first)
            pair_word = word[first]
            lead = np.concatenate([[0], np.flatnonzero(pair_word[1:] != pair_word[:-1]) + 1])
            pairs = np.diff(np.append(lead, len(first))).astype(np.uint32)
            model = _pack(pair_word[lead], pairs, context[first], learned.astype(np.uint32))
            used = _pack(uses.astype(np.uint32), chunk << np.uint32(DOC_BITS) | packed & DOC_MASK, group["chunk"].to_numpy().astype(np.int64))
            yield {"bucket": [bucket], "chunk": [None], "ids": [None], "held": [None], "n": [None], "model": [model], "uses": [used]}

    out = map_batches(sent, merge, "bucket long, chunk long, ids array<long>, held array<boolean>, n array<long>, model binary, uses binary")
    return written(out, "pitman-yor")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers, by Stirling's series beyond 8."""
    below = x.copy()
    for i in range(1, 8):
        below *= x + i
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(below)


def uniform(key: np.ndarray, sweep: int, nth: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the arguments alone."""
    with np.errstate(over="ignore"):
        x = mixed(key + _U(nth + 1) * _U(0x9E3779B97F4A7C15) + _U(sweep + 1) * _U(0xD6E8FEB86659FD93))
    return ((x >> _U(11)).astype(np.float64) + 0.5) / 2**53


def seated(customers: np.ndarray, strength: np.ndarray, discount: float, key: np.ndarray, sweep: int, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seats customers after the first ``n`` at ``t`` tables: (item, customers before it) of each table opened.

    The next customer opens a table with probability strength / (strength + n - discount * t). That none of
    the next k does has a closed form in gamma functions, in which a uniform draw is looked up.
    """
    n, t, items, before, nth = n.astype(np.float64), t.astype(np.float64), [], [], 0
    live = np.flatnonzero(customers > n)
    while len(live):
        s, at, rest = strength[live], n[live] - discount * t[live], customers[live] - n[live]
        draw = uniform(key[live], sweep, nth)
        # That none of them does is at least this likely, which settles most without logarithms.
        maybe = 1 - rest * s / (s + at) < draw
        live, s, at, rest, draw = live[maybe], s[maybe], at[maybe], rest[maybe], np.log(draw[maybe])
        start = log_gamma(at) - log_gamma(s + at)
        hit = log_gamma(at + rest) - log_gamma(s + at + rest) - start < draw
        live, s, at, draw, start, high = live[hit], s[hit], at[hit], draw[hit], start[hit], rest[hit]
        low = np.zeros(len(live))
        while (high - low > 1).any():
            middle = np.where(high - low > 1, np.floor((low + high) / 2), high)
            opened = log_gamma(at + middle) - log_gamma(s + at + middle) - start < draw
            high, low = np.where(opened, middle, high), np.where(opened, low, middle)
        items.append(live)
        before.append(n[live] + high - 1)
        n[live] += high
        t[live] += 1
        live = live[customers[live] > n[live]]
        nth += 1
    return (np.concatenate(items), np.concatenate(before)) if items else (np.zeros(0, np.int64), np.zeros(0))


def log_weight(customers: np.ndarray, strength: np.ndarray, discount: float, item: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How much likelier each item's seating is than it was to be proposed, as a logarithm: the product of strength + n - discount * t over its customers."""
    n = len(customers)
    all_items, at = np.concatenate([np.arange(n), item]), np.concatenate([np.zeros(n), before + 1])
    order = np.lexsort((at, all_items))
    all_items, at = all_items[order], at[order]
    first = np.flatnonzero(np.diff(all_items, prepend=-1))
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) + 1
    # From one opening to the next, customers meet the same number of tables; the first customer counts for nothing.
    low = np.maximum(at, 1)
    high = np.append(at, 0)[1:]
    high[np.append(first, len(at))[1:] - 1] = np.maximum(customers, 1)
    s = strength[all_items] - discount * nth
    return np.bincount(all_items, weights=log_gamma(s + high) - log_gamma(s + low), minlength=n)


class Seats:
    """The tables of many items: how many, and after how many customers each beyond the first was opened."""

    def __init__(self, customers: np.ndarray):
        self.customers = customers.astype(np.float64)
        self.t = (customers > 0).astype(np.float64)
        self.item, self.before = np.zeros(0, np.int64), np.zeros(0)

    @classmethod
    def expected(cls, customers: np.ndarray, strength: np.ndarray) -> Seats:
        """A seating to begin with: the j-th further table is opened where about j are expected, that is (s + 1) * exp(j / s) - s."""
        out = cls(customers)
        s = strength
        more = np.where(customers > 1, np.floor(np.maximum(0, s * np.log((s + np.maximum(customers, 2) - 1) / (s + 1)))), 0).astype(np.int64)
        out.item = np.repeat(np.arange(len(more)), more)
        nth = np.arange(len(out.item)) - np.repeat(np.cumsum(more) - more, more) + 1
        out.before = np.minimum(np.floor((s[out.item] + 1) * np.exp(nth / s[out.item]) - s[out.item]), out.customers[out.item] - 1)
        out.t = out.t + more
        return out

    def resized(self, customers: np.ndarray, strength: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> Seats:
        """The last customers leave, or more join, where their number has changed."""
        out = Seats(customers)
        stay = self.before < out.customers[self.item]
        item, before = self.item[stay], self.before[stay]
        t = out.t + np.bincount(item, minlength=len(out.t))
        more = seated(out.customers, strength, discount, key, sweep, np.minimum(np.maximum(self.customers, 1), out.customers), t)
        out.item, out.before = np.concatenate([item, more[0]]), np.concatenate([before, more[1]])
        out.t = out.t + np.bincount(out.item, minlength=len(out.t))
        return out

    def again(self, strength: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> Seats:
        """A Gibbs step for every item: its customers after a place drawn at random are seated anew, or as they were."""
        live = np.flatnonzero(self.customers > 1)
        c, s, k = self.customers[live], strength[live], key[live]
        at = np.full(len(self.t), -1)
        at[live] = np.arange(len(live))
        item = at[self.item]
        stay = np.clip(np.floor(np.maximum(c ** uniform(k, 2 * sweep + 1, 1), c * np.exp(-OPENINGS / s))), 1, c - 1)
        kept = self.before < stay[item]
        tables = 1 + np.bincount(item[kept], minlength=len(live))
        new = seated(c, s, discount, k, 2 * sweep, stay, tables)
        # Where nobody opens a table, before or after, nothing changes.
        changed = np.zeros(len(live), dtype=bool)
        changed[new[0]] = changed[item[~kept]] = True
        among = np.cumsum(changed) - 1
        old = changed[item]
        tried = np.concatenate([among[item[old & kept]], among[new[0]]]), np.concatenate([self.before[old & kept], new[1]])
        c, s = c[changed], s[changed]
        gain = log_weight(c, s, discount, *tried) - log_weight(c, s, discount, among[item[old]], self.before[old])
        accepted = np.log(uniform(k[changed], 2 * sweep + 1, 0)) < gain
        take, keep = accepted[tried[0]], np.ones(len(item), dtype=bool)
        keep[old] = ~accepted[among[item[old]]]
        out = Seats(self.customers)
        out.item, out.before = np.concatenate([live[changed][tried[0][take]], self.item[keep]]), np.concatenate([tried[1][take], self.before[keep]])
        out.t = out.t + np.bincount(out.item, minlength=len(out.t))
        return out


def parent_seats(seats: Seats, customers: np.ndarray, given: dict, key: np.ndarray, sweep: int) -> Seats:
    """The next tables of words in the shared restaurant, with the customers that contexts now send."""
    strength = (THETA_PARENT + DISCOUNT_PARENT * np.maximum(0, given["T1"] - seats.t)) / (given["V"] + 1)
    return seats.resized(customers, strength, DISCOUNT_PARENT, key, JOINED + sweep).again(strength, DISCOUNT_PARENT, key, sweep)


class Bucket:
    """A bucket's words and pairs, and the sweeps over them."""

    def __init__(self, model: bytes, heavy: np.ndarray):
        self.word, pairs, self.context, self.c = _unpack(model, np.uint64, np.uint32, np.uint32, np.uint32)
        self.c = self.c.astype(np.int64)
        self.of = np.repeat(np.arange(len(self.word)), pairs)
        at = np.searchsorted(heavy, self.word)
        self.heavy = np.minimum(at, max(0, len(heavy) - 1))
        self.is_heavy = (heavy[self.heavy] == self.word) if len(heavy) else np.zeros(len(self.word), bool)
        with np.errstate(over="ignore"):
            self.key = mixed(self.word[self.of] + self.context.astype(np.uint64) * _U(0xA0761D6478BD642F))

    def per_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=x, minlength=len(self.word))

    def sweep(self, state: dict, given: dict, number: int) -> dict:
        """The next state from this one and the totals it had."""
        seats = state["seats"]
        strength = (THETA + given["discount"] * np.maximum(0, given["T"][self.context] - seats.t)) * self.parent(state, given)[self.of]
        seats = (seats if number else Seats.expected(self.c, strength)).again(strength, given["discount"], self.key, number)
        sent = self.per_word(seats.t)
        return {"seats": seats, "sent": sent, "parent": parent_seats(state["parent"], sent, given, self.word, number)}

    def start(self) -> dict:
        """One table for each pair, one for each word."""
        seats = Seats(self.c)
        sent = self.per_word(seats.t)
        return {"seats": seats, "sent": sent, "parent": Seats(sent)}

    def parent(self, state: dict, given: dict) -> np.ndarray:
        """The shared restaurant's probability of each word."""
        sent = np.where(self.is_heavy, given["heavy_sent"][self.heavy] if len(given["heavy_sent"]) else 0, state["sent"])
        t1 = np.where(self.is_heavy, given["heavy_t1"][self.heavy] if len(given["heavy_t1"]) else 0, state["parent"].t)
        base = (THETA_PARENT + DISCOUNT_PARENT * given["T1"]) / (given["V"] + 1)
        return (sent - DISCOUNT_PARENT * t1 + base) / (THETA_PARENT + given["N1"])

    def probability(self, state: dict, given: dict) -> np.ndarray:
        """The predictive probability of each pair."""
        d = given["discount"]
        rest = (THETA + d * given["T"][self.context]) * self.parent(state, given)[self.of]
        return (np.where(self.c > 0, self.c - d * state["seats"].t, 0) + rest) / (THETA + given["C"][self.context])

    def totals(self, state: dict, heavies: int, contexts: int) -> np.ndarray:
        """What others need of a state, as one vector: T, what heavy words sent, and sums."""
        light, t = ~self.is_heavy, state["seats"].t
        out = np.zeros(contexts + heavies + 2)
        out[:contexts] = np.bincount(self.context, weights=t, minlength=contexts)
        out[contexts : contexts + heavies] = np.bincount(self.heavy[self.is_heavy], weights=state["sent"][self.is_heavy], minlength=heavies)
        out[-2:] = state["sent"].sum(), state["parent"].t[light].sum()
        return out

    def counts(self, heavies: int, contexts: int) -> np.ndarray:
        """C, customers of heavy words, V of the others, N, and numbers of pairs seen once and twice."""
        c = self.per_word(self.c)
        out = np.zeros(contexts + heavies + 4)
        out[:contexts] = np.bincount(self.context, weights=self.c, minlength=contexts)
        out[contexts : contexts + heavies] = np.bincount(self.heavy[self.is_heavy], weights=c[self.is_heavy], minlength=heavies)
        out[-4:] = ((c > 0) & ~self.is_heavy).sum(), self.c.sum(), (self.c == 1).sum(), (self.c == 2).sum()
        return out


def _summed(vectors: DataFrame, length: int, rows: int) -> np.ndarray:
    """The sum of packed vectors of a fixed length, of which there are ``rows``, in a tree."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(length)
        for batch in batches:
            for blob in batch["vector"]:
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_buffer()), dtype=np.float64)
        if total.any():
            yield {"vector": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]}

    while rows > SUMMED:
        rows = -(-rows // SUMMED)
        vectors = map_batches(vectors.repartition(rows), add, "vector binary")
    total = np.zeros(length)
    for r in vectors.collect():  # SUMMED vectors at most
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.vector)), dtype=np.float64)
    return total


def _sums(doc: np.ndarray, score: np.ndarray, base: np.ndarray, known: np.ndarray) -> bytes:
    """What a bucket adds to the texts of a chunk."""
    gaps = np.diff(doc.astype(np.int64), prepend=0).astype(np.uint16)
    return zstandard.ZstdCompressor(level=1).compress(_pack(gaps, score.astype(np.float32), np.rint(base * SUM_UNIT).astype(np.int64), known.astype(np.uint32)))


def score(docs: DataFrame, sweeps: int = SWEEPS, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Words part at ASCII white space, A-Z
    count as a-z, and an end follows the last; null text counts as empty and has the end alone. The model
    learns from documents whose fold isn't held out; a row without an id is scored, counts as held out
    and isn't learned from. Repeated rows each count and each give a row; an empty table gives none.
    Words are told apart by 64-bit hashes. A very long text is one entry of a chunk and is held whole by one
    task. The score is the log10 probability of the text, its words
    and end; ``base_score`` is that of a smoothed unigram model.
    """
    spark = docs.sparkSession
    heavy, tokens = _heavy(docs)
    heavies = len(heavy)
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    contexts = min(MOST_CONTEXTS, max(LEAST_CONTEXTS, 1 << (tokens // TOKENS_EACH).bit_length()))
    dealt = _dealt(docs, heavy, buckets, contexts)
    models = dealt.filter("bucket >= 0")
    words = spark.sparkContext.broadcast(heavy)

    def gather(what, length: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for model in batch["model"]:
                    vector = what(Bucket(model.as_buffer(), words.value))
                    yield {"vector": [zstandard.ZstdCompressor(level=1).compress(vector.tobytes())]}

        return _summed(map_batches(models.select("model"), run, "vector binary"), length, buckets)

    counts = gather(lambda b: b.counts(heavies, contexts), contexts + heavies + 4)
    heavy_c = counts[contexts : contexts + heavies]
    vocabulary, n, once, twice = (int(x) for x in counts[-4:])
    fixed = {"C": counts[:contexts].astype(np.float32), "V": vocabulary + int((heavy_c > 0).sum()), "discount": once / (once + 2 * twice) if 0 < twice and 0 < once else 0.5}

    def totals(vector: np.ndarray, seats: Seats) -> dict:
        """Of a state: the restaurants' tables, and heavy words in the parent, whose seats the driver draws: HEAVY words at most."""
        return fixed | {"T": vector[:contexts].astype(np.float32), "heavy_sent": vector[contexts : contexts + heavies], "heavy_t1": seats.t, "N1": vector[-2], "T1": vector[-1] + seats.t.sum()}

    def state_after(b: Bucket, given: list[dict]) -> dict:
        """A bucket's state is drawn again from the totals of all sweeps, so none is stored."""
        state = b.start()
        for number, g in enumerate(given):
            state = b.sweep(state, g, number)
        return state

    length = contexts + heavies + 2
    vector = gather(lambda b: b.totals(b.start(), heavies, contexts), length)
    seats = Seats(vector[contexts : contexts + heavies])
    history = [totals(vector, seats)]
    for number in range(sweeps):
        shared = spark.sparkContext.broadcast(history)
        vector = gather(lambda b, s=shared: b.totals(state_after(b, s.value), heavies, contexts), length)
        seats = parent_seats(seats, vector[contexts : contexts + heavies], history[-1], heavy, number)
        history.append(totals(vector, seats))
    given = spark.sparkContext.broadcast((history, heavy_c, n, fixed["V"]))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        history, heavy_c, n, size = given.value
        for batch in batches:
            for model, used in zip(batch["model"], batch["uses"], strict=True):
                b = Bucket(model.as_buffer(), words.value)
                state, p = b.start(), np.zeros(len(b.c))
                for number in range(len(history) - 1):
                    state = b.sweep(state, history[number], number)
                    if number >= len(history) - 1 - samples:
                        p += b.probability(state, history[number + 1]) / samples
                c = np.where(b.is_heavy, heavy_c[b.heavy] if len(heavy_c) else 0, b.per_word(b.c))
                base = np.log10((c + 1) / (n + size + 1))
                uses, where, chunk = _unpack(used.as_buffer(), np.uint32, np.uint32, np.int64)
                pair = np.repeat(np.arange(len(uses)), uses)
                doc, at = np.unique(where, return_inverse=True)
                total = lambda x: np.bincount(at, weights=x, minlength=len(doc))
                sums = [total(np.log10(p)[pair]), total(base[b.of][pair]), total((c > 0)[b.of][pair].astype(np.float64))]
                owner = doc >> np.uint32(DOC_BITS)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(doc)]])
                blobs = [_sums(doc[i:j] & DOC_MASK, *(x[i:j] for x in sums)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                names = chunk[owner[cuts[:-1]]].tolist()
                yield {"chunk": names, "sums": blobs} | dict.fromkeys(("ids", "held", "n"), [None] * len(names))

    ddl = "chunk long, sums binary, ids array<long>, held array<boolean>, n array<long>"
    scored = map_batches(models.select("model", "uses"), evaluate, ddl)
    texts = dealt.filter("bucket < 0").select("chunk", F.lit(None).cast("binary").alias("sums"), "ids", "held", "n")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for group in groups(batches, ["chunk"]):
            about = group.filter(group["ids"].is_valid())
            ids = about["ids"][0].as_py()
            score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
            for blob in group["sums"].to_pylist():
                if blob is not None:
                    gaps, s, b, k = _unpack(zstandard.ZstdDecompressor().decompress(blob), np.uint16, np.float32, np.int64, np.uint32)
                    at = np.cumsum(gaps)
                    score[at] += s
                    base[at] += b / SUM_UNIT
                    known[at] += k
            size = [n] * len(ids)
            yield {"doc_id": ids, "held_out": about["held"][0].as_py(), "n_tokens": about["n"][0].as_py(), "n_known": known, "train_tokens": size, "base_score": base, "score": score}

    both = scored.union(texts).repartition("chunk").sortWithinPartitions("chunk")
    return map_batches(both, add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with production parameters."""
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op8_pitman_yor": op8_pitman_yor}
ORACLE_SQL: dict[str, str] = {}
