"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

A Spark job counts the pieces (what the pre-tokenizer's pattern cuts a text into) of all documents;
the most frequent ones, with their ids by the merge rules, are compiled into a minimal acyclic
automaton whose paths number its words: the sum of counts along a path indexes the ids. Shared
suffixes keep it small. It is a file in the shared folder, which Spark hands to each executor; the executor's
Python workers map it into memory, and a piece is then one walk. A piece that the automaton lacks is merged exactly,
so the lexicon changes how fast ids are found but never which. Digests take the pieces that a worker hasn't met
together: all walk the automaton in step, a byte at a time, and what it lacks is merged in step, a pair of each at a time.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm.common import map_batches, scratch, table, written

#: Fixed value: the pre-tokenizer's published pattern, white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Texts whose characters all come before this one are cut by the standard library, which takes half the time.
LATIN_END = 0x250
#: Words in the lexicon at most; it fixes the size of the file.
LEXICON = 30_000
#: Longest word of the lexicon, in bytes.
LONGEST = 64
#: Pieces that a worker keeps beside the lexicon before it starts anew; longer ones aren't kept.
KEPT, KEPT_BYTES = 400_000, 100
#: Distinct pieces that a task counts before it hands them on.
COUNTED = 1 << 17
#: Pieces of so many bytes at most are merged from a plain list of ranks, or in step with others.
SHORT = 48
#: Characters of the texts whose pieces are held together, longer texts alone, and pieces that are looked up in step.
HELD, STEP = 1 << 18, 4096
ID_BITS = 32
ID_MASK, NONE = (1 << ID_BITS) - 1, 1 << 62


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else the next free one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


def splitter() -> Callable[[str], list[str]]:
    """Cuts a text into its pieces; the same pattern, with its classes spelled out, serves Latin texts."""
    of = lambda kind: "".join(rf"\u{c:04x}" for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == kind)
    letter, number, space = of("L"), of("N"), r"\t-\r \x85\xa0"
    latin = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    beyond = re.compile(rf"[^\x00-\u{LATIN_END - 1:04x}]").search
    every = regex.compile(PATTERN).findall
    return lambda text: every(text) if beyond(text) else latin(text)


class Vocabulary:
    """What the merges need, read from a tokenizer's JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ids = spec["model"]["vocab"]
        self.of_byte = [ids[c] for c in byte_symbols()]
        #: (left id, right id) -> rank and merged id in one number
        self.merges = {(ids[a], ids[b]): rank << ID_BITS | ids[a + b] for rank, (a, b) in enumerate(spec["model"]["merges"])}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        pairs = sorted((a << ID_BITS | b, found) for (a, b), found in self.merges.items())
        #: Pairs of ids as numbers in order, and what they merge to; beyond the last one nothing.
        self.pairs = np.array([x[0] for x in pairs] + [(1 << 63) - 1], dtype=np.int64)
        self.merged = np.array([x[1] for x in pairs] + [NONE], dtype=np.int64)
        of_byte = np.array(self.of_byte, dtype=np.int64)
        self.of_bytes = self.found(of_byte[:, None], of_byte)

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair, or ``NONE``."""
        pair = left << ID_BITS | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.merged[at], NONE)

    def merge_all(self, data: np.ndarray, length: np.ndarray) -> list[list[int]]:
        """``merge`` of pieces of at least one byte; ``data`` has a row for each, of which the first ``length`` bytes count."""
        m, w = data.shape
        ids, n = np.array(self.of_byte, dtype=np.int64)[data], length.astype(np.int64)
        out: list = [None] * m
        rows, at = np.arange(m), np.arange(w)
        # ranks[:, i] is of the pair that begins at i; the last column belongs to no pair.
        ranks = np.full((m, w), NONE, dtype=np.int64)
        ranks[:, :-1] = np.where(at[1:] < n[:, None], self.of_bytes[data[:, :-1], data[:, 1:]], NONE)
        while len(rows):
            i = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), i]
            done = best == NONE
            if done.any():
                for row, now, size in zip(rows[done].tolist(), ids[done].tolist(), n[done].tolist(), strict=True):
                    out[row] = now[:size]
                live = ~done
                rows, ids, ranks, n, i, best = rows[live], ids[live], ranks[live], n[live], i[live], best[live]
            if not len(rows):
                break
            each = np.arange(len(rows))
            ids[each, i] = best & ID_MASK
            # What follows the pair moves up by one.
            w -= 1
            gone = at[:w] > i[:, None]
            ids, ranks = np.where(gone, ids[:, 1:], ids[:, :-1]), np.where(at[:w] >= i[:, None], ranks[:, 1:], ranks[:, :-1])
            n -= 1
            for j in (i - 1, i):
                held = (j >= 0) & (j + 1 < n)
                ranks[each[held], j[held]] = self.found(ids[each[held], j[held]], ids[each[held], j[held] + 1])
            ranks[each, n - 1] = NONE
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: of all neighbours, the pair of the lowest rank merges first, the leftmost of equals."""
        ids, find = [self.of_byte[b] for b in piece], self.merges.get
        n = len(ids)
        if n <= SHORT:  # finding the lowest rank anew costs less than a heap
            ranks = [find(p, NONE) for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < NONE:
                at = ranks.index(best)
                ids[at] = best & ID_MASK
                del ids[at + 1], ranks[at]
                if at:
                    ranks[at - 1] = find((ids[at - 1], ids[at]), NONE)
                if at < len(ranks):
                    ranks[at] = find((ids[at], ids[at + 1]), NONE)
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.merges[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merges]
        heapq.heapify(heap)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != pair[0] or ids[j] != pair[1]:
                continue  # one of them has been merged meanwhile
            ids[i], ids[j] = best & ID_MASK, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in self.merges:
                    heapq.heappush(heap, (self.merges[p], a, p))
        return [i for i in ids if i >= 0]


# The automaton's file: a header (root, nodes, edges, words, outputs); for each node its first edge
# and a final flag; for each edge a target and how many words its node has before it; for each word the
# first of its ids; all ids, all of these in 32 bits; and each edge's byte.
HEADER = struct.Struct("<5I")


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, their ids in order of the words."""
    ordered = sorted(words)
    register: dict[tuple, int] = {}
    finished: list[tuple[bool, tuple]] = []

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(finished)
            finished.append(key)
        return register[key]

    stack = [[False, []]]
    last = b""
    for word in ordered:
        common = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), common, -1):
            stack[depth - 1][1].append((last[depth - 1], freeze(stack.pop())))
        stack += [[False, []] for _ in word[common:]]
        stack[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        stack[depth - 1][1].append((last[depth - 1], freeze(stack.pop())))
    root = freeze(stack[0])

    below = [0] * len(finished)
    for i, (final, edges) in enumerate(finished):  # targets come first
        below[i] = final + sum(below[t] for _, t in edges)
    nodes, edges, labels = [], [], bytearray()
    for final, out in finished:
        nodes += [len(labels), int(final)]
        before = int(final)
        for byte, target in out:
            labels.append(byte)
            edges += [target, before]
            before += below[target]
    nodes += [len(labels), 0]
    starts, outputs = [0], []
    for word in ordered:
        outputs += words[word]
        starts.append(len(outputs))
    pack = lambda xs: struct.pack(f"<{len(xs)}I", *xs)
    return HEADER.pack(root, len(finished), len(labels), len(ordered), len(outputs)) + pack(nodes) + pack(edges) + pack(starts) + pack(outputs) + bytes(labels)


class Lexicon:
    """A compiled lexicon, memory-mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, nodes, edges, words, outputs = HEADER.unpack_from(self.map)
        at, parts = HEADER.size, []
        for n in (2 * (nodes + 1), 2 * edges, words + 1, outputs):
            parts.append(memoryview(self.map)[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.labels = at
        self.nodes, self.edges, self.starts, self.outputs = parts
        of = lambda x: np.frombuffer(x, dtype=np.uint32).astype(np.int64)
        first = of(self.nodes)[::2]
        self.final, self.targets, self.before = of(self.nodes)[1::2] > 0, of(self.edges)[::2], of(self.edges)[1::2]
        #: Each edge's node and byte in one number, in order; beyond the last one nothing.
        keys = np.repeat(np.arange(nodes), np.diff(first)) << 8 | np.frombuffer(self.map, dtype=np.uint8, count=edges, offset=self.labels)
        self.keys = np.append(keys, (1 << 63) - 1)

    def find_all(self, data: np.ndarray, length: np.ndarray) -> list[list[int] | None]:
        """``find`` of many words; ``data`` has a row for each, of which the first ``length`` bytes count."""
        node, index = np.full(len(data), self.root), np.zeros(len(data), dtype=np.int64)
        rows = np.arange(len(data))
        for i in range(data.shape[1]):
            rows = rows[(length[rows] > i) & (node[rows] >= 0)]
            key = node[rows] << 8 | data[rows, i]
            edge = np.searchsorted(self.keys, key)
            has = self.keys[edge] == key
            node[rows[~has]] = -1
            rows, edge = rows[has], edge[has]
            index[rows] += self.before[edge]
            node[rows] = self.targets[edge]
        out: list = [None] * len(data)
        for row in np.flatnonzero((node >= 0) & self.final[node]).tolist():
            out[row] = self.outputs[self.starts[index[row]] : self.starts[index[row] + 1]].tolist()
        return out

    def find(self, word: bytes) -> list[int] | None:
        nodes, edges, labels, find = self.nodes, self.edges, self.labels, self.map.find
        node = 2 * self.root
        index = 0
        for i in range(len(word)):
            e = find(word[i : i + 1], labels + nodes[node], labels + nodes[node + 2]) - labels
            if e < 0:
                return None
            index += edges[2 * e + 1]
            node = 2 * edges[2 * e]
        if not nodes[node + 1]:
            return None
        return self.outputs[self.starts[index] : self.starts[index + 1]].tolist()


class Codec:
    """Encodes and decodes in a Python worker."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.pieces = splitter()
        self.marks = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.texts = {i: str(i) for i in vocabulary.bytes_of}
        self.specials = {i: (str(i), 1, t.encode()) for t, i in vocabulary.special.items()}
        self.kept: dict[str | int, tuple[str, int, bytes]] = dict(self.specials)

    def piece_ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        return (self.lexicon.find(raw) if self.lexicon else None) or self.vocabulary.merge(raw)

    def learn(self, pieces: list[str]) -> None:
        """Keeps the ids of these pieces as text, how many, and what they decode to."""
        raws = sorted(((x.encode(), x) for x in pieces), key=lambda x: len(x[0]))
        short = bisect.bisect_right(raws, SHORT, key=lambda x: len(x[0]))
        for low in range(0, short, STEP):
            part = raws[low : min(short, low + STEP)]
            length = np.array([len(raw) for raw, _ in part])
            data = np.zeros((len(part), length[-1]), dtype=np.uint8)
            data[np.arange(length[-1]) < length[:, None]] = np.frombuffer(b"".join([raw for raw, _ in part]), dtype=np.uint8)
            found = self.lexicon.find_all(data, length) if self.lexicon else [None] * len(part)
            lacking = np.array([k for k, ids in enumerate(found) if not ids], dtype=np.int64)
            for k, ids in zip(lacking.tolist(), self.vocabulary.merge_all(data[lacking], length[lacking]), strict=True):
                found[k] = ids
            for (_, piece), ids in zip(part, found, strict=True):
                self.keep(piece, ids)
        for _, piece in raws[short:]:
            self.keep(piece, self.piece_ids(piece))

    def keep(self, piece: str, ids: list[int]) -> None:
        self.kept[piece] = (",".join([self.texts[i] for i in ids]), len(ids), b"".join([self.vocabulary.bytes_of[i] for i in ids]))

    def runs(self, text: str) -> Iterator[str | int]:
        """Pieces, and the ids of special tokens that the text spells out."""
        for k, run in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                yield self.vocabulary.special[run]
            else:
                yield from self.pieces(run)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for x in self.runs(text):
            ids += [x] if isinstance(x, int) else self.piece_ids(x)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.vocabulary.bytes_of[i] for i in ids]).decode(errors="replace")

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, sha256 of them as text, sha256 of what they decode to."""
        low = 0
        while low < len(texts):
            high, held = low + 1, len(texts[low])
            while high < len(texts) and (held := held + len(texts[high])) <= HELD:
                high += 1
            yield from self.part(texts[low:high])
            low = high

    def part(self, texts: list[str]) -> list[tuple[int, str, str]]:
        # A text that spells out special tokens has their ids among its pieces; they are known as such.
        runs = [self.pieces(t) if self.marks is None or not self.marks.search(t) else list(self.runs(t)) for t in texts]
        if len(self.kept) >= KEPT:
            self.kept = dict(self.specials)
        kept = self.kept
        new = list(set().union(*runs).difference(kept))
        self.learn(new)
        out = []
        for run in runs:
            found = [kept[x] for x in run]
            ids = ",".join([x[0] for x in found])
            decoded = b"".join([x[2] for x in found]).decode(errors="replace")
            out.append((sum([x[1] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        for x in new:
            if len(x) > KEPT_BYTES:
                del kept[x]
        return out


_codecs: dict = {}


def _codec(key: str, vocabulary, lexicon: str) -> Codec:
    """One codec per Python worker, from the broadcast vocabulary and the lexicon's file; ``key`` tells what is in them."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Vocabulary(vocabulary.value), Lexicon(SparkFiles.get(lexicon)))
    return _codecs[key]


def frequent_pieces(docs: DataFrame, most: int = LEXICON) -> list[str]:
    """The most frequent pieces of all texts, ``most`` at most; single bytes, single occurrences and very long ones aside."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces, total = splitter(), Counter()
        out = lambda c: {"piece": list(c.keys()), "n": list(c.values())}
        for batch in batches:
            for text in batch["text"].to_pylist():
                total.update(pieces(text))
                if len(total) >= COUNTED:  # what a task holds stays bounded
                    yield out(total)
                    total = Counter()
        yield out(total)

    counted = map_batches(docs.select("text").filter(F.col("text").isNotNull()), count, "piece string, n long")
    size = F.octet_length("piece")
    pieces = counted.filter((size > 1) & (size <= LONGEST)).groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1")
    # Classes of counts, of which there are some thousand at most, tell from which count on there are few enough.
    pieces = written(pieces.withColumn("class", F.floor(F.log2("n") * 16).cast("int")), "bpe-pieces")
    found, least = 0, None
    for r in sorted(pieces.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        found += r["count"]
        if found > most:
            break
        least = r["class"]
    if least is None:
        return []
    return [r.piece for r in pieces.filter(F.col("class") >= least).select("piece").collect()]


def prepared(docs: DataFrame, path: str, most: int = LEXICON) -> tuple:
    """A key, a broadcast of the vocabulary's text, and the name of the file of the lexicon compiled from ``docs``."""
    sc = docs.sparkSession.sparkContext
    with open(path, encoding="utf-8") as f:
        text = f.read()
    vocabulary = Vocabulary(text)
    words = {p.encode(): vocabulary.merge(p.encode()) for p in frequent_pieces(docs, most)}
    data = compile_lexicon(words)
    return hashlib.sha256(text.encode() + data).hexdigest(), sc.broadcast(text), _shared_file(docs.sparkSession, data)


def _shared_file(spark: SparkSession, data: bytes) -> str:
    """Writes ``data`` to the shared folder, for each executor to fetch when it starts; a name for ``SparkFiles``."""
    path = scratch(spark, "lexicon")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def digests(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """Encodes and decodes every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Null text counts as empty: no ids.
    Special tokens spelled out in a text get their id, as the tokenizers library does by default.
    Repeated rows each give a row; an empty table gives none. A very long run without a break is one
    piece, merged in n log n steps.
    """
    key, vocabulary, lexicon = prepared(docs, path, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        codec = _codec(key, vocabulary, lexicon)
        for batch in batches:
            n, ids, decoded = zip(*codec.digests([t or "" for t in batch["text"].to_pylist()]), strict=True) if batch.num_rows else ((), (), ())
            yield {"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text; null text gives an empty array."""
    key, vocabulary, lexicon = prepared(docs, path, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        codec = _codec(key, vocabulary, lexicon)
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "ids": [codec.encode(t or "") for t in batch["text"].to_pylist()]}

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give null text, bytes that aren't UTF-8 the replacement character."""
    with open(path, encoding="utf-8") as f:
        table_of = encoded.sparkSession.sparkContext.broadcast(Vocabulary(f.read()).bytes_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [None if ids is None else b"".join([table_of.value[i] for i in ids]).decode(errors="replace") for ids in batch["ids"].to_pylist()]
            yield {"doc_id": batch["doc_id"], "text": texts}

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


@cache
def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the public byte-level vocabulary."""
    return digests(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op9_bpe": op9_bpe}
ORACLE_SQL: dict[str, str] = {}
