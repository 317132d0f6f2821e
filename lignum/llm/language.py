"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts, up to ``ORDER`` bytes long, counts which byte follows. A
byte's probability comes from the longest context that the tree holds: its share there, or else the
escape probability (method C: distinct followers / (followers + distinct)) times what the next
shorter context gives, down to one in 256. The statistics are frozen after training, so the code
length of a text is a sum of table entries: one entry for each (longest known context, byte), kept
for all languages in one dense table. The language that codes the whole text shortest is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lignum.llm.common import fold_of, map_batches, table

#: Longest context, in bytes.
ORDER = 3
#: Training takes of each language the SAMPLE_ROWS first texts of at most SAMPLE_CHARS characters by a hash of the id; if there
#: are fewer, also pieces of that size of its longer texts.
SAMPLE_ROWS, SAMPLE_CHARS = 250, 8192
#: Texts and pieces of all languages together at most, and languages: what the driver and the model hold is bounded.
SAMPLE_ALL, LANGUAGES = 10_000, 1_000
#: Contexts of full length that occur less often are left out of the trees.
LEAST = 2
#: Bytes of the table that is broadcast, at most: of too many contexts, those that no language meets often are left out.
MODEL_BYTES = 1 << 28
UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1
SLICE = 1 << 20


class Model:
    """Code lengths in bits of every byte after every context, for all languages."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, most_bytes: int = MODEL_BYTES):
        self.langs = sorted(texts)
        self.order = order
        joined = {lang: np.frombuffer(b"".join(ts), dtype=np.uint8) for lang, ts in texts.items()}
        seen = np.unique(np.concatenate(list(joined.values()))) if joined else np.zeros(0, np.uint8)
        #: Classes of bytes: those seen in training, and one for all others, which also stands before a text.
        self.other = other = len(seen)
        self.size = size = other + 1
        self.classes = np.full(256, other, dtype=np.int32)
        self.classes[seen] = np.arange(other)

        counts = []  # by language, by order: contexts, distinct followers, followers; then (context, byte) and counts
        for lang in self.langs:
            parts = [self.classes[np.frombuffer(t, dtype=np.uint8)] for t in texts[lang] if t]
            by_order = []
            for k in range(order + 1):
                grams = [self._grams(p, k) for p in parts if len(p) > k]
                gram, n = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.int64), return_counts=True)
                context, at = np.unique(gram // size, return_index=True)
                total = np.add.reduceat(n, at) if len(at) else n
                distinct = np.diff(np.append(at, len(gram)))
                if k == order:
                    keep = total >= LEAST
                    kept = np.repeat(keep, distinct)
                    gram, n, context, total, distinct = gram[kept], n[kept], context[keep], total[keep], distinct[keep]
                by_order.append((context, distinct, total, gram, n))
            counts.append(by_order)
        counts = self._fitted(counts, most_bytes // (4 * size * max(1, len(self.langs))))

        # A state is a context that some language knows; state_of[k] leads from the last k classes to the longest one.
        state_of = np.zeros(1, dtype=np.int32)
        rows = np.full((1, size, len(self.langs)), 8.0)
        tables = [rows]
        found = 1
        for k in range(order + 1):
            known = np.unique(np.concatenate([c[k][0] for c in counts])) if counts else np.zeros(0, np.int64)
            if k:
                shorter = np.tile(state_of, size)
                fresh = np.arange(found, found + len(known), dtype=np.int32)
                below = shorter[known]
                start = np.concatenate(tables)[below]
                found += len(known)
                state_of = shorter
                state_of[known] = fresh
            else:
                start = rows.copy()
            for i, by_order in enumerate(counts):
                context, distinct, total, gram, n = by_order[k]
                if not len(context):
                    continue
                at = np.searchsorted(known, context)
                start[at, :, i] -= np.log2(distinct / (total + distinct))[:, None]
                of = np.searchsorted(context, gram // size)
                start[at[of], gram % size, i] = -np.log2(n / (total[of] + distinct[of]))
            if k:
                tables.append(start)
            else:
                tables = [start]
        self.state_of = state_of
        self.bits = np.concatenate(tables).astype(np.float32).transpose(2, 0, 1).reshape(len(self.langs), found * size)

    @staticmethod
    def _fitted(counts: list, states: int) -> list:
        """The trees with ``states`` contexts at most, the empty one included: the rarest, by the language that meets them most, go."""
        most = {}  # by order: contexts that some language knows, and how often the one that meets them most does
        for k in range(1, len(counts[0]) if counts else 1):
            known, at = np.unique(np.concatenate([c[k][0] for c in counts]), return_inverse=True)
            often = np.zeros(len(known), dtype=np.int64)
            np.maximum.at(often, at, np.concatenate([c[k][2] for c in counts]))
            most[k] = known, often
        every = np.sort(np.concatenate([often for _, often in most.values()]))[::-1] if most else np.zeros(0, np.int64)
        if len(every) < states or not len(every):
            return counts
        least = every[max(0, states - 1)] + 1
        out = []
        for by_order in counts:
            fitted = [by_order[0]]
            for k, (context, distinct, total, gram, n) in enumerate(by_order[1:], 1):
                known, often = most[k]
                keep = often[np.searchsorted(known, context)] >= least
                kept = np.repeat(keep, distinct)
                fitted.append((context[keep], distinct[keep], total[keep], gram[kept], n[kept]))
            out.append(fitted)
        return out

    def _grams(self, x: np.ndarray, k: int) -> np.ndarray:
        """k classes and the one that follows, as one number."""
        out = np.zeros(len(x) - k, dtype=np.int64)
        for j in range(k + 1):
            out = out * self.size + x[j : len(x) - k + j]
        return out

    def lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length of each text by language; ``data`` holds the texts one after another, ``ends`` where they end."""
        starts = np.concatenate([[0], ends[:-1]])
        total = np.zeros((len(self.langs), len(ends)))
        for low in range(0, len(data), SLICE):
            high, back = min(len(data), low + SLICE), min(low, self.order)
            x = self.classes[data[low - back : high]]
            first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(starts, high, side="left")
            begins = starts[first:last]
            context = np.zeros(high - low, dtype=np.int64)
            for j in range(self.order, 0, -1):
                before = np.full(high - low, self.other, dtype=np.int64)
                lead = max(0, j - back)
                before[lead:] = x[back - j + lead : len(x) - j]
                for d in range(j):  # the first j bytes of a text have no byte so far back
                    p = begins + d - low
                    before[p[(p >= 0) & (p < high - low)]] = self.other
                context = context * self.size + before
            at = self.state_of[context].astype(np.int64) * self.size + x[back:]
            texts = np.flatnonzero((ends[first:last] > np.maximum(begins, low)) & (begins < high)) + first
            cuts = np.maximum(starts[texts], low) - low
            for i in range(len(self.langs)):
                total[i, texts] += np.add.reduceat(self.bits[i][at], cuts, dtype=np.float64)
        return total


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, list[bytes]]:
    """Texts to learn from by language: a bounded sample of the rows that aren't held out.

    Longer texts than ``chars`` count as pieces of ``chars``, the last one shorter, each with a hash of its own. They
    come after all short texts, so a language that has ``rows`` short ones learns from whole texts only. Where there are
    more languages than ``SAMPLE_ALL`` texts and pieces allow ``rows`` for, each has fewer; more than ``LANGUAGES`` raise.
    """
    usable = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & (F.length("text") > 0) & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    usable = usable.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chars).cast("int"))))
    long = F.length("text") > chars
    usable = usable.withColumn("at", F.struct(long.alias("long"), F.when(long, F.xxhash64("doc_id", "piece")).otherwise(F.xxhash64("doc_id")).alias("h")))
    # The limit on row_number is applied within each task before anything is shuffled.
    within = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("k") <= rows)

    def last_of() -> dict:
        return {r.lang: r["at"] for r in within(usable.select("lang", "at"), "at").groupBy("lang").agg(F.max("at").alias("at")).limit(LANGUAGES + 1).collect()}

    cuts = last_of()
    if not cuts:
        return {}
    if len(cuts) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    if len(cuts) * rows > SAMPLE_ALL:
        rows = SAMPLE_ALL // len(cuts)
        cuts = last_of()
    last = lambda at: F.struct(F.lit(at.long).alias("long"), F.lit(at.h).cast("long").alias("h"))
    cut = F.create_map(*[x for lang, at in cuts.items() for x in (F.lit(lang), last(at))])
    taken = usable.filter(F.col("at") <= cut[F.col("lang")]).select("lang", "at", F.expr(f"substring(text, piece * {chars} + 1, {chars})").alias("text"))
    out: dict[str, list[bytes]] = {lang: [] for lang in cuts}
    for r in within(taken, "at", "text").orderBy("lang", "at", "text").collect():
        out[r.lang].append(r.text.encode())
    return out


def identify(docs: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` and ``bits_per_byte`` of every whole text, with the columns of ``keep`` for ``doc_id``.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; other columns are ignored, and ``lang`` is read for
    training only. ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or if
    there was nothing to learn from. The score is the winner's share of 2 ** -(code length); of equal
    lengths the language first by code point wins. Rows with a null id count as not held out, and
    nothing is learned from them. Repeated rows each give a row; an empty table gives none. A very long
    text is coded whole, ``SLICE`` bytes at a time.
    """
    model = model or Model(sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = shared.value
        for batch in batches:
            n = batch.num_rows
            text = batch["text"].cast(pa.large_binary()).fill_null(b"")
            ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
            data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]] if n else np.zeros(0, np.uint8)
            ends = ends[1:] - ends[0] if n else np.zeros(0, np.int64)
            letters = np.array(batch["letters"].to_pylist(), dtype=bool)
            pred, score, rate = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.zeros(n)
            if n and langs:
                bits = own.lengths(data, ends)
                best = bits.argmin(axis=0)
                share = 1 / np.exp2(np.maximum(-1000, bits.min(axis=0) - bits)).sum(axis=0)
                pred[letters] = np.array(langs, dtype=object)[best[letters]]
                score[letters] = share[letters]
                rate = bits.min(axis=0) / np.maximum(1, ends - np.concatenate([[0], ends[:-1]]))
            yield {c: batch[c] for c in keep} | {"held_out": batch["held_out"], "lang_pred": pred.tolist(), "score": score, "bits_per_byte": rate}

    kinds = dict(docs.dtypes)
    ready = docs.select(
        *dict.fromkeys([*keep, "text"]),
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    return map_batches(ready, run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", held_out boolean, lang_pred string, score double, bits_per_byte double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with production parameters."""
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op2_language": op2_language}
ORACLE_SQL: dict[str, str] = {}
