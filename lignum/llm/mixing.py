"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source should be taken ``target / source_size`` times. The whole part of that
number is taken for certain; the fraction is a probability of one more copy. Independent coin flips
would scatter a source's total, so fractions are rounded in pairs: two documents hold some words of
mass each (fraction x size), and a random amount moves from one to the other, by a fair rule, until
one of them holds nothing or its whole size. That one is decided; the other goes on to meet the next
document. Words are conserved by each move, so a source misses its target by one document at most.

Rows that are alike in source, id and size are counted first. Of m such rows with the fraction f,
pairing leaves floor(m * f) with one more copy, one undecided with what remains, and the rest without;
so they enter as one document, and no number of repeated or missing ids makes a large block.

The pairs are the steps of a reduction tree: documents are hashed into blocks of about ``fan``, a
block is folded to one undecided document, and the undecided ones of all blocks form the next level.
A source of any size thus takes log_fan(n) levels of small, equal tasks; no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lignum.llm.common import WORD, let, table, written

#: Weights of sources in order, repeated.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
FAN = 64
SEED = 20_240_731
#: Blocks that a task folds, as long as there aren't more tasks than the session's shuffles have, or else many more.
TASK_BLOCKS, MANY_BLOCKS = 64, 20_000
#: Rows of equal documents that are made from one row at a time.
REPEATS = 10_000
#: A mass this close to 0 or to the size, relative to the size, is integral.
EPS = 1e-9


def size_of(text: str) -> Column:
    """The number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: ``source, source_size, n, target``.

    ``sized`` has ``source``, ``size`` and how many ``rows`` are like it; ``n`` counts kinds. Sources in code point order, null last, get the weights in
    turn and share the sum of all sizes by weight. A target stops at ``most`` times its source's
    size; what it gives up is shared again by weight among the rest, until none is above its limit.
    That is a filling to a common level: order sources by limit / weight, and the level is the
    greatest (total - limits before) / (weights from here on).
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    # One row per source from here on: these windows order sources, not documents.
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    per = per.withColumn("limit", F.col("source_size") * float(most))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - before) / onward)
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", "n", F.least("limit", F.col("weight") * F.col("level")).alias("target"))


def _integral(x: Column) -> Column:
    size = x["size"].cast("double")
    return (x["mass"] <= size * EPS) | (x["mass"] >= size * (1 - EPS))


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _item(doc_id: Column, key: Column, size: Column, mass: Column) -> Column:
    return F.struct(size.alias("size"), doc_id.alias("doc_id"), key.alias("key"), mass.alias("mass"))


def _repeated(df: DataFrame, times: str, most: int, tasks: int) -> DataFrame:
    """Each row as often as its column ``times`` says, which is ``most`` at most; in steps, so that no row grows long."""
    chunks = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / REPEATS))))
    chunks = chunks.repartition(tasks) if most > REPEATS else chunks
    return chunks.withColumn("nth", F.explode(F.sequence(F.lit(1), F.least(F.lit(REPEATS), F.col(times) - F.col("chunk") * REPEATS)))).drop("chunk", "nth")


def _fold(items: Column, level: int, seed: int, id_type: str) -> Column:
    """Fold a block: ``left`` (the undecided document or null) and ``done`` (decided, with mass 0 or size)."""
    item = f"struct<size:bigint,doc_id:{id_type},key:string,mass:double>"
    start = F.struct(F.lit(None).cast(item).alias("left"), F.array().cast(f"array<{item}>").alias("done"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["left"]

        def moved(move: Column) -> Column:
            pair = F.array(
                _item(a["doc_id"], a["key"], a["size"], a["mass"] + move),
                _item(b["doc_id"], b["key"], b["size"], b["mass"] - move),
            )
            return let(
                pair,
                lambda p: F.struct(
                    F.get(F.filter(p, lambda x: ~_integral(x)), F.lit(0)).alias("left"),
                    F.concat(acc["done"], F.filter(p, _integral)).alias("done"),
                ),
            )

        to_a = F.least(a["size"].cast("double") - a["mass"], b["mass"])
        to_b = F.least(a["mass"], b["size"].cast("double") - b["mass"])
        draw = _unit(a["doc_id"], b["doc_id"], a["key"], b["key"], a["size"], b["size"], F.lit(level), F.lit(seed))
        # Towards a with probability to_b / (to_a + to_b): the expected mass of both stays as it is.
        move = F.when(draw * (to_a + to_b) < to_b, to_a).otherwise(-to_b)
        return F.when(a.isNull(), F.struct(b.alias("left"), acc["done"].alias("done"))).otherwise(let(move, moved))

    # Largest first: what is left undecided at the end then tends to be a small document.
    return F.aggregate(F.sort_array(items, asc=False), start, step)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, fan: int = FAN, seed: int = SEED, key: str | None = None) -> DataFrame:
    """How often the mix takes each document.

    ``docs`` has ``doc_id``, ``text`` and ``source``; other columns are ignored. Returns one row for
    each input row: ``doc_id, size`` (words), ``source_size, target, copies, taken``. Where ``key``
    names a string column, rows that differ in it are told apart, and the result has it as ``key``.

    The same rows give the same mix, however they are partitioned. Null or empty text has size 0 and
    is taken 0 times; a null source is a source of its own, last in order. Rows with the same or a
    null ``doc_id`` are documents of their own; those of equal size and source are taken equally often
    but for one copy. An empty table gives no rows. A very long text is one large document: it costs
    its source at most its own size of error.
    """
    spark = docs.sparkSession
    own = (F.col(key) if key else F.lit(None)).cast("string").alias("key")
    sized = docs.select("doc_id", "source", size_of("text").alias("size"), own).groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("rows"))
    sized = written(sized, "mix-sizes")
    id_type = dict(sized.dtypes)["doc_id"]
    targets = source_targets(sized, weights, most).withColumnRenamed("source", "of")
    # One row per source.
    per = sized.groupBy("source").agg(F.count("*").alias("kinds"), F.max("rows").alias("rows"))
    widest, kinds, sources, repeats = per.agg(F.max("kinds"), F.sum("kinds"), F.count("*"), F.max("rows")).first()
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))

    keys = ["source_size", "target", "whole"]
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("ratio", F.least(ratio, F.lit(float(most)))).withColumn("whole", F.floor(F.col("ratio") + EPS).cast("long"))
    # Of rows alike: so many take one copy more for certain, one may, the rest don't.
    share = F.when(F.col("size") > 0, F.col("rows") * F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("share", share).withColumn("more", F.least(F.floor(F.col("share") + EPS).cast("long"), F.col("rows")))
    left = F.greatest(F.lit(0.0), F.col("share") - F.col("more"))
    rows = rows.withColumn("item", _item(F.col("doc_id"), F.col("key"), F.col("size"), F.col("size") * left))

    columns = ["doc_id", "key", "size", "source_size", "target", "copies"]

    def result(df: DataFrame, done: str) -> DataFrame:
        d = F.col(done)
        extra = F.when(d["mass"] * 2 > d["size"], F.lit(1)).otherwise(F.lit(0))
        return df.select(d["doc_id"].alias("doc_id"), d["key"].alias("key"), d["size"].alias("size"), "source_size", "target", (F.col("whole") + extra).alias("copies"))

    undecided = (F.col("more") < F.col("rows")) & ~_integral(F.col("item"))
    certain = F.array(
        F.struct(F.col("more").alias("times"), (F.col("whole") + 1).alias("copies")),
        F.struct((F.col("rows") - F.col("more") - undecided.cast("long")).alias("times"), F.col("whole").alias("copies")),
    )
    settled = rows.select("doc_id", "key", "size", "source_size", "target", F.explode(certain).alias("c")).filter("c.times > 0")
    out = _repeated(settled.select("doc_id", "key", "size", "source_size", "target", "c.copies", "c.times"), "times", repeats or 0, shuffle).select(*columns)
    current = rows.filter(undecided).select(*keys, "source", "n", "item")
    level, width, total = 0, widest or 0, (kinds or 0) // fan + (sources or 0)
    while width > 0:
        last = width <= fan
        width = 0 if last else -(-width // fan)
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / float(fan))).cast("long")
        block = F.pmod(F.xxhash64(F.col("item")["doc_id"], F.col("item")["key"], F.col("item")["size"], F.lit(level), F.lit(seed)), blocks)
        tasks = max(1, min(-(-total // TASK_BLOCKS), max(shuffle, -(-total // MANY_BLOCKS))))
        grouped = current.withColumn("n", blocks).withColumn("block", block).repartition(tasks, "source", "block")
        folded = grouped.groupBy(*keys, "source", "n", "block").agg(F.collect_list("item").alias("items"))
        folded = written(folded.select(*keys, "source", "n", _fold(F.col("items"), level, seed, id_type).alias("f")), f"mix-level{level}")
        out = out.unionByName(result(folded.select(*keys, F.explode("f.done").alias("d")), "d"))
        current = folded.filter(F.col("f.left").isNotNull()).select(*keys, "source", "n", F.col("f.left").alias("item"))
        level, total = level + 1, total // fan + sources
    # What the roots leave: one document per source, decided by its own mass.
    root = F.col("item")
    drawn = F.when(_unit(root["doc_id"], F.lit(level), F.lit(seed)) * root["size"] < root["mass"], root["size"].cast("double")).otherwise(F.lit(0.0))
    current = current.withColumn("item", _item(root["doc_id"], root["key"], root["size"], drawn))
    out = out.unionByName(result(current, "item"))
    return (out if key else out.drop("key")).withColumn("taken", F.col("copies") * F.col("size"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with production parameters."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLE_SQL: dict[str, str] = {}
