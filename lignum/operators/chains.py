"""Chains of links, each to one other: fates of created entries, and moves that wait for one another's names.

Chains are followed by doubling: each round every link reaches twice as far, so a chain of any length takes as many
rounds as its length has binary digits, and so does a ring, whatever the number of rows. Rounds are stored, and rows that have
reached their end are set aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lignum.operators.log import change_log
from lignum.session import stored
from lignum.sources.relations import with_views


def ends(links: DataFrame) -> DataFrame:
    """``id, end, steps, low`` of ``links`` (``id, next``; ids once each): where each chain ends, how far that is, and the least id on the way.

    A ``next`` that is null, or no id of ``links``, ends a chain. On a cycle, or on the way to one, ``end`` and ``steps`` are null; ``low`` is the
    least id that is reached.
    """
    ids = links.select(F.col("id").alias("next"), F.lit(True).alias("there"))
    first = links.join(ids, "next", "left").select("id", F.when(F.col("there"), F.col("next")).alias("jump"), F.col("id").alias("end"), F.lit(0).cast("long").alias("steps"), F.col("id").alias("low"))
    walk = stored(first.withColumn("hop", F.col("jump").isNotNull().cast("long")), "chains")
    # Until its end is known a row holds: where it has jumped to, over how many steps, and the least id before that.
    done = walk.filter("jump IS NULL").select("id", "end", "steps", "low")
    going = walk.filter("jump IS NOT NULL")
    while not going.isEmpty():
        far = going.select(F.col("id").alias("jump"), F.col("jump").alias("to"), F.col("hop").alias("more"), F.col("low").alias("least"), F.lit(None).cast(dict(links.dtypes)["id"]).alias("at_end"), F.lit(None).cast("long").alias("left"))
        far = far.unionByName(done.select(F.col("id").alias("jump"), F.lit(None).cast(dict(links.dtypes)["id"]).alias("to"), F.lit(None).cast("long").alias("more"), F.col("low").alias("least"), F.col("end").alias("at_end"), F.col("steps").alias("left")))
        step = going.join(far, "jump").select(
            "id", F.col("to").alias("jump"), F.col("at_end").alias("end"), (F.col("hop") + F.col("left")).alias("steps"), F.least("low", "least").alias("low"), (F.col("hop") + F.col("more")).alias("hop"),
            (F.col("least") < F.col("low")).alias("lower"),
        )
        step = stored(step, "chains")
        more, going = step.filter("jump IS NULL").drop("lower"), step.filter("jump IS NOT NULL")
        # A round that ends no chain leaves only rings and what leads into them; once no least id falls either, none ever will.
        if more.isEmpty() and going.filter("lower").isEmpty():
            break
        done = done.unionByName(more.select("id", "end", "steps", "low"))
    kind = dict(links.dtypes)["id"]
    return done.unionByName(going.select("id", F.lit(None).cast(kind).alias("end"), F.lit(None).cast("long").alias("steps"), "low"))


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """``id`` of all links of ``links`` (``id, next``) on the chains from ``starts`` (``id``), once each."""
    ids = links.select(F.col("id").alias("next"))
    jumps = stored(links.join(ids, "next", "left_semi").select("id", "next"), "jumps")
    found = stored(starts.select("id").distinct().join(links.select("id"), "id", "left_semi"), "reached")
    n = found.count()
    while not jumps.isEmpty():
        more = jumps.join(found, "id", "left_semi").select(F.col("next").alias("id"))
        found = stored(found.unionByName(more).distinct(), "reached")
        before, n = n, found.count()
        if n == before:
            break  # whatever follows has been reached, rings included
        jumps = stored(jumps.join(jumps.select(F.col("id").alias("next"), F.col("next").alias("far")), "next").select("id", F.col("far").alias("next")), "jumps")
    return found


def created_fates(events: DataFrame) -> DataFrame:
    """``batch, name, fate``: names that a created entry was lost under, and names that one is held at when its batch ends.

    ``events`` has ``batch, pos, name, cookie`` and booleans ``create, folder, left, came, gone`` (created, of a folder, moved from here, moved
    to here, deleted); ``pos`` orders the rows of all batches. An entry created at a name and moved from it goes to where its cookie's last
    arrival is, if that is later; from there the next event of the name decides: none, and it is held there; a
    departure, and it goes on; anything else, and it is lost, as it is where no arrival follows. A lost entry's names are
    all it had. An entry that its name's later events leave alone is held there. A name can be both.
    """
    by_name = Window.partitionBy("batch", "name").orderBy("pos")
    before = by_name.rowsBetween(Window.unboundedPreceding, -1)
    after = by_name.rowsBetween(1, Window.unboundedFollowing)
    moves = F.col("left") | F.col("came") | F.col("gone")
    seen = events.withColumns({
        "made": F.coalesce(F.max("create").over(before), F.lit(False)), "was_folder": F.coalesce(F.max("folder").over(before), F.lit(False)) | F.col("folder"),
        "next": F.min(F.when(moves, F.struct("pos", "left"))).over(after),
    })
    seen = stored(seen, "fates")
    arrivals = seen.filter("came").groupBy("batch", "cookie").agg(F.max(F.struct("pos", "name", "next")).alias("to"))
    # One link for each departure: to the departure from where it arrives.
    departures = seen.filter("left").select("batch", F.col("pos").alias("id"), "name", "cookie", (F.col("made") & ~F.col("was_folder")).alias("starts"))
    gone = departures.join(arrivals, ["batch", "cookie"], "left").withColumn("to", F.when(F.col("to.pos") > F.col("id"), F.col("to")))
    gone = stored(gone.select("batch", "id", "name", "starts", F.col("to.name").alias("landed"), F.when(F.col("to.next.left"), F.col("to.next.pos")).alias("next"), (F.col("to").isNotNull() & F.col("to.next").isNull()).alias("stays")), "departures")
    starts = gone.filter("starts").select("id")
    last = ends(gone.select("id", "next")).select("id", "end").join(gone.select(F.col("id").alias("end"), F.col("stays").alias("safe"), F.col("landed").alias("at_last")), "end")
    held = last.join(starts, "id", "left_semi").filter("safe").join(gone.select("id", "batch"), "id").select("batch", F.col("at_last").alias("name"))
    lost = reached(gone.select("id", "next"), last.filter("NOT safe").select("id").join(starts, "id", "left_semi"))
    rows = gone.join(lost, "id", "left_semi")
    # A start's own name, and all that are landed on from there.
    names = rows.filter("starts").select("batch", "name").unionByName(rows.filter("landed IS NOT NULL").select("batch", F.col("landed").alias("name")))
    quiet = seen.filter(F.col("create") & ~F.col("folder") & F.col("next").isNull()).select("batch", "name")
    return names.withColumn("fate", F.lit("lost")).unionByName(held.unionByName(quiet).withColumn("fate", F.lit("held"))).distinct()


def settled(moves: DataFrame, tree: DataFrame) -> DataFrame:
    """``id, round, outcome, spare`` of moves that are made together: when each can be made, as names become free.

    ``moves`` has ``id, parent, name`` (where to; ids once each), ``tree`` ``id, parent, name``. A move whose name is free is made in round 1, one
    whose name is left in round n in round n + 1. Moves that wait in a ring are ``swapped``: the least id of the ring steps aside
    to a spare name in round 0 and takes its place in the last round, and the others follow. A name held by an
    item that stays, or that cannot leave, makes a move ``blocked`` (round null), as does one that a smaller id moves to as well; unknown items are ``gone``;
    an item that is there already has ``stays``, and keeps its name.
    """
    known = moves.select("id", F.col("parent").alias("to"), F.col("name").alias("as")).join(tree.select("id", "parent", "name"), "id", "left")
    stays = F.col("to").eqNullSafe(F.col("parent")) & (F.col("as") == F.col("name"))
    known = stored(known.withColumn("kind", F.when(F.col("name").isNull(), "gone").when(stays, "stays").otherwise("moves")), "moves")
    going = known.filter("kind = 'moves'")
    first = going.groupBy("to", "as").agg(F.min("id").alias("first"))
    there = tree.select(F.col("parent").alias("to"), F.col("name").alias("as"), F.col("id").alias("holder"))
    waits = going.join(first, ["to", "as"]).join(there, ["to", "as"], "left")
    leaves = going.select(F.col("id").alias("holder"), F.lit(True).alias("leaves"))
    waits = stored(waits.join(leaves, "holder", "left").select("id", "holder", ((F.col("first") != F.col("id")) | (F.col("holder").isNotNull() & F.col("leaves").isNull())).alias("stuck")), "waits")
    # One that is stuck ends the chain of those that wait for it.
    chain = ends(waits.select("id", F.when(~F.col("stuck"), F.col("holder")).alias("next")))
    chain = stored(chain.join(waits.select(F.col("id").alias("end"), F.col("stuck").alias("blocked")), "end", "left"), "chain")
    ring = chain.filter("end IS NULL").select("low").distinct().select(F.col("low").alias("id"))
    # A ring is cut at its least id; those that lead into a ring want a name that is taken again by then, and are behind a smaller id or a stayer, so a chain to a ring is the ring.
    cut = waits.join(chain.filter("end IS NULL").select("id"), "id", "left_semi").join(ring.withColumn("leader", F.lit(True)), "id", "left")
    order = ends(cut.select("id", F.when(F.col("leader").isNull(), F.col("holder")).alias("next")))
    length = order.groupBy("end").agg((F.max("steps") + 1).alias("ring"))
    order = order.join(length, "end").select("id", F.when(F.col("steps") == 0, F.col("ring")).otherwise(F.col("steps")).alias("turn"), (F.col("steps") == 0).alias("aside"))
    out = known.select("id", "kind").join(chain.select("id", "steps", "blocked"), "id", "left").join(order, "id", "left")
    outcome = F.when(F.col("kind") != "moves", F.col("kind")).when(F.col("turn").isNotNull(), "swapped").when(F.col("blocked"), "blocked").otherwise("moved")
    turn = F.when(outcome == "moved", F.col("steps") + 1).when(outcome == "swapped", F.col("turn"))
    return out.select("id", turn.cast("long").alias("round"), outcome.alias("outcome"), F.coalesce("aside", F.lit(False)).alias("spare"))


def _entries(s: SparkSession, d: str) -> DataFrame:
    k = F.coalesce("content", F.lit(7)) % 8
    return change_log(s, d).select(
        F.floor(F.col("seq") / 3000).alias("batch"), F.col("seq").alias("pos"), ((F.col("id") * 7 + F.col("seq")) % 90).alias("name"), F.floor(F.col("seq") / 6).alias("cookie"),
        (k < 2).alias("create"), (F.col("id") % 11 == 0).alias("folder"), ((k == 2) | (k == 3)).alias("left"), ((k == 4) | (k == 5)).alias("came"), (k == 6).alias("gone"),
    )


def _asked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files that take one another's names in rings of 2 to 5, chains to a free name, and chains to a name that stays."""
    e = change_log(s, d).select("seq")
    block, at = F.floor(F.col("seq") / 12), F.col("seq") % 12
    rows = e.select(F.col("seq").alias("id"), block.alias("parent"), F.concat(F.lit("n"), at.cast("string")).alias("name"), at.alias("at"), block.alias("block"))
    size = 2 + F.col("block") % 4
    to = F.when(F.col("at") < size, (F.col("at") + 1) % size).when(F.col("at") < 11, F.col("at") + 1).when(F.col("block") % 3 == 0, F.lit(11)).when(F.col("block") % 3 == 1, F.lit(40)).otherwise(F.lit(8))
    moves = rows.filter("at <> 10 OR block % 5 <> 0").select("id", "parent", F.concat(F.lit("n"), to.cast("string")).alias("name"))
    return moves, rows.select("id", "parent", "name")


QUERIES = {"created_fates": lambda s, d: created_fates(_entries(s, d)), "settled_moves": lambda s, d: settled(*_asked(s, d))}
_E = """, e AS MATERIALIZED (SELECT seq // 3000 AS batch, seq AS pos, (id * 7 + seq) % 90 AS name, seq // 6 AS cookie, k < 2 AS made, id % 11 = 0 AS folder, k IN (2, 3) AS lft, k IN (4, 5) AS came, k = 6 AS gone
  FROM (SELECT *, coalesce(content, 7) % 8 AS k FROM change_log)),
a AS MATERIALIZED (SELECT e.*, (SELECT min(x.pos) FROM e x WHERE x.batch = e.batch AND x.name = e.name AND x.pos > e.pos AND (x.lft OR x.came OR x.gone)) AS nxt FROM e),
toward AS MATERIALIZED (SELECT batch, cookie, max(pos) AS q FROM e WHERE came GROUP BY 1, 2),
starts AS (SELECT a.* FROM a WHERE lft AND EXISTS (SELECT 1 FROM e x WHERE x.batch = a.batch AND x.name = a.name AND x.pos < a.pos AND x.made) AND NOT EXISTS (SELECT 1 FROM e x WHERE x.batch = a.batch AND x.name = a.name AND x.pos <= a.pos AND x.folder)),
walk AS (SELECT pos AS start, batch, pos, cookie, name, 'goes' AS state FROM starts
  UNION ALL SELECT w.start, w.batch, coalesce(r.pos, q.pos), coalesce(r.cookie, -1), q.name, CASE WHEN q.pos IS NULL THEN 'lost' WHEN q.nxt IS NULL THEN 'held' WHEN r.lft THEN 'goes' ELSE 'lost' END
  FROM walk w LEFT JOIN toward t ON t.batch = w.batch AND t.cookie = w.cookie AND t.q > w.pos LEFT JOIN a q ON q.batch = t.batch AND q.pos = t.q LEFT JOIN a r ON r.batch = q.batch AND r.pos = q.nxt WHERE w.state = 'goes'),
over AS (SELECT start, max(state) FILTER (WHERE state <> 'goes') AS fate FROM walk GROUP BY 1)
SELECT DISTINCT batch, name, 'lost' AS fate FROM walk JOIN over USING (start) WHERE fate = 'lost' AND name IS NOT NULL
UNION SELECT batch, name, 'held' FROM walk WHERE state = 'held' UNION SELECT batch, name, 'held' FROM a WHERE made AND NOT folder AND nxt IS NULL"""
_M = """, t AS MATERIALIZED (SELECT seq AS id, seq // 12 AS block, seq % 12 AS place FROM change_log),
m AS MATERIALIZED (SELECT id, block, place, CASE WHEN place < 2 + block % 4 THEN (place + 1) % (2 + block % 4) WHEN place < 11 THEN place + 1 WHEN block % 3 = 0 THEN 11 WHEN block % 3 = 1 THEN 40 ELSE 8 END AS dest FROM t WHERE place <> 10 OR block % 5 <> 0),
g AS MATERIALIZED (SELECT m.*, h.id AS holder, x.id IS NOT NULL AS leaves, min(m.id) OVER (PARTITION BY m.block, m.dest) AS first FROM (SELECT * FROM m WHERE place <> dest) m LEFT JOIN t h ON h.block = m.block AND h.place = m.dest LEFT JOIN (SELECT id FROM m WHERE place <> dest) x ON x.id = h.id),
walk AS (SELECT id, id AS at_id, id AS low, 0 AS steps, CASE WHEN first <> id OR (holder IS NOT NULL AND NOT leaves) THEN 'blocked' WHEN holder IS NULL THEN 'moved' ELSE 'waits' END AS state, holder FROM g
  UNION ALL SELECT w.id, g.id, least(w.low, g.id), w.steps + 1, CASE WHEN g.id = w.id THEN 'swapped' WHEN g.first <> g.id OR (g.holder IS NOT NULL AND NOT g.leaves) THEN 'blocked' WHEN g.holder IS NULL THEN 'moved' ELSE 'waits' END, g.holder
  FROM walk w JOIN g ON g.id = w.holder WHERE w.state = 'waits'),
fin AS (SELECT * FROM walk WHERE state <> 'waits'),
aside AS (SELECT w.id, min(w.steps) FILTER (WHERE w.at_id = f.low) AS away FROM walk w JOIN fin f ON f.id = w.id AND f.state = 'swapped' GROUP BY 1)
SELECT m.id, CASE WHEN state = 'moved' THEN steps + 1 WHEN state = 'swapped' THEN CASE WHEN low = m.id THEN steps ELSE away END END::BIGINT AS round, coalesce(state, 'stays') AS outcome, coalesce(state = 'swapped' AND low = m.id, false) AS spare
FROM m LEFT JOIN fin USING (id) LEFT JOIN aside USING (id)"""
ORACLE_SQL = {k: with_views(q, "change_log").replace(")\n, ", "),\n").replace("WITH ", "WITH RECURSIVE ", 1) for k, q in (("created_fates", _E), ("settled_moves", _M))}
