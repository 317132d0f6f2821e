"""Conversations from logs of events, as training text with a loss mask, in DataFrame functions only.

A log has one row an event: ``conv_id, message, seq, part, kind, role, text``. ``seq`` (null first), then ``part``
(any type that sorts), order a conversation's events; ``message`` (any type) says which message an event is about. Kinds:

- ``begin``: the message is there, in ``role``, with ``text`` so far;
- ``delta``: ``text`` is added to its end;
- ``edit``: ``text`` takes the place of all its text so far;
- ``regenerate``: ``text`` takes the place of its text, and every message begun after it and before this
  event is no longer in the conversation.

Nulls are empty texts. Events of a message before it begins count for nothing, as do other kinds; a second
``begin`` is an ``edit``. A message that has been dropped stays so, and its own regenerations still drop others.

The fold is in three steps, each a shuffle: a message from its events, a block of messages, the conversation. So
tasks of the last step get a row for 64 numbers of ``seq``, and not each event of a long conversation.

Template: each turn is ``<s>[ROLE]role[/ROLE]text</s>``. In roles and texts, what looks like one of the control
strings gets a backslash after its first sign, as do those that have some already; taking one away undoes it.
The loss mask has a run for each turn: how many code points are outside it, inside, outside again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lignum.llm.common import table

OPEN, ROLE, BODY, CLOSE = "<s>", "[ROLE]", "[/ROLE]", "</s>"
#: What texts must not hold, control strings of other templates of this kind among them.
_CONTROL = r"(/?(?:s>|ROLE\]|INST\]))"
#: Whose texts are learned.
LEARNED = "assistant"
#: Messages whose ``seq`` agrees but for so many bits are put together first.
BLOCK = 6
#: Code points of a streamed delta, where a table of turns is taken as a log.
DELTA = 2048


def escape(text: Column) -> Column:
    """Text without control strings; ``unescape`` undoes it."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def messages(log: DataFrame) -> DataFrame:
    """Each message as its events leave it: ``conv_id, seq, part`` (of its beginning), ``role, text``, and in ``last`` when it was regenerated last, or null."""
    event = F.struct("seq", "part", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = log.filter(F.col("kind").isin("begin", "delta", "edit", "regenerate"))
    found = known.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("events"))
    first = F.array_position(F.transform("events", lambda e: e["kind"]), "begin").cast("int")
    found = found.withColumn("first", first).filter("first > 0").withColumn("events", F.expr("slice(events, first, size(events))"))
    resets = F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i))
    start = F.array_max(resets) + 1
    text = F.array_join(F.transform(F.slice("events", start, F.size("events")), lambda e: e["text"]), "")
    again = F.filter("events", lambda e: e["kind"] == "regenerate")
    last = F.when(F.size(again) > 0, F.element_at(again, -1))
    begun = F.get("events", F.lit(0))
    return found.select("conv_id", begun["seq"].alias("seq"), begun["part"].alias("part"), begun["role"].alias("role"), text.alias("text"), F.when(last.isNotNull(), F.struct(last["seq"].alias("seq"), last["part"].alias("part"))).alias("last"))


def formatted(log: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, loss_runs`` of each conversation of a log that has a message left.

    ``loss_runs`` has ``before, inside, after`` for each turn, in code points; they add up to the whole text. A null
    ``conv_id`` is a conversation of its own; events that are alike are events each; messages that begin at
    the same place go by role and text. Empty texts are turns; an empty log gives no rows; other columns are ignored.
    """
    found = messages(log)
    at = F.struct("seq", "part")
    shown, said = escape(F.col("role")), escape(F.col("text"))
    turn = F.concat(F.lit(OPEN + ROLE), shown, F.lit(BODY), said, F.lit(CLOSE))
    inside = F.when(F.col("role") == LEARNED, F.length(said)).otherwise(F.lit(0))
    before = F.length(shown) + len(OPEN + ROLE + BODY)
    run = F.struct((before + F.when(F.col("role") == LEARNED, F.lit(0)).otherwise(F.length(said))).alias("before"), inside.alias("inside"), F.lit(len(CLOSE)).alias("after"))
    rows = found.select("conv_id", F.shiftright("seq", BLOCK).alias("block"), F.struct(at.alias("at"), turn.alias("turn"), run.alias("run"), "last").alias("m"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    regenerated = F.filter("ms", lambda m: m["last"].isNotNull())
    blocks = blocks.withColumn("again", F.transform(regenerated, lambda m: F.struct(m["at"].alias("at"), m["last"].alias("last"))))
    # The furthest regeneration of a message in an earlier block drops what begins before it.
    earlier = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("reach", F.max(F.array_max(F.transform("again", lambda m: m["last"]))).over(earlier))
    own = F.filter("ms", lambda m: ~F.exists("again", lambda a: (a["at"] < m["at"]) & (m["at"] < a["last"])))
    left = F.when(F.size("again") > 0, own).otherwise(F.col("ms"))
    left = F.when(F.col("reach").isNull(), left).otherwise(F.filter(left, lambda m: m["at"] > F.col("reach")))
    blocks = blocks.select("conv_id", "block", left.alias("ms")).filter(F.size("ms") > 0)
    piece = F.struct("block", F.array_join(F.transform("ms", lambda m: m["turn"]), "").alias("text"), F.transform("ms", lambda m: m["run"]).alias("runs"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("bs"))
    runs = F.flatten(F.transform("bs", lambda b: b["runs"]))
    return whole.select("conv_id", F.size(runs).cast("long").alias("n_turns"), F.array_join(F.transform("bs", lambda b: b["text"]), "").alias("formatted"), runs.alias("loss_runs"))


def read_back(out: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, learned``: roles and texts of the turns, and the texts under the loss mask, from the output alone."""
    pieces = F.split("formatted", CLOSE, -1)
    shown = out.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, BODY, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN + ROLE) + 1))).alias("role"), unescape(F.substr(p, F.length(head) + len(BODY) + 1)).alias("text"))

    under = F.zip_with("pieces", "loss_runs", lambda p, r: F.when(r["before"] + r["inside"] == F.length(p), unescape(F.substr(p, r["before"] + 1, r["inside"]))))
    return shown.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), under.alias("learned"))


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of turns (``conv_id, turn, role, text``) as the log that streaming them leaves: each begins empty and gets its text in deltas.

    ``turn`` is the sequence number; turns that have the same go by role and the text's MD5, and
    repeated rows are messages of their own.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.struct(F.coalesce("role", F.lit("")).alias("r"), F.md5(text.cast("binary")).alias("t"), F.monotonically_increasing_id().alias("k")).alias("own"))
    pieces = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)))
    events = rows.select("conv_id", "seq", "own", "role", F.posexplode(pieces).alias("k", "piece"))
    begin = F.col("k") == 0
    return events.select(
        "conv_id", F.struct("seq", "own").alias("message"), "seq", F.struct("own", "k").alias("part"), F.when(begin, "begin").otherwise("delta").alias("kind"),
        F.when(begin, F.col("role")).alias("role"), F.col("piece").alias("text"),
    )


TRICKY_ID, TRICKY_TEXT = -7, "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that is full of control strings, formatted; all columns are read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(TRICKY_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(TRICKY_TEXT).alias("text"))
    found = read_back(formatted(log_of(rows.unionByName(tricky))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(x: str) -> str:
    return rf"regexp_replace({x}, '([<\[])(\\*)(/?(?:s>|ROLE\]|INST\]))', '\1\\\2\3', 'g')"


QUERIES = {"op13_chat_format": op13_chat_format}
ORACLE_SQL = {
    "op13_chat_format": f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT {TRICKY_ID}, 0, 'user', '{TRICKY_TEXT}' UNION ALL SELECT {TRICKY_ID}, 1, '{LEARNED}', '{TRICKY_TEXT}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LEARNED}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + ROLE + BODY + CLOSE)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
}
