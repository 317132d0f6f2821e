"""Benchmark measurements: percentiles, verdicts, speedups, regressions, scorecards, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lignum.operators.ranks import nearest_ranks, same
from lignum.sources.relations import measurements, read, with_views

#: Differences below these are noise, by unit.
NOISE = {"us": 5.0, "ms": 0.25, "s": 0.05, "B/entry": 10.0, "bytes": 4096.0, "Mbit/s": 1.0}
#: Limits that hold on any link, by id and metric.
LIMITS = {
    ("T1", "list_1000_p50_ms"): 0.5,
    ("T2", "stat_p50_us"): 20.0,
    ("T6", "open_small_warm_p50_ms"): 1.0,
    ("T12", "daemon_rss_bytes_per_entry"): 250.0,
    ("T14", "bytes_moved_ratio"): 2.0,
    ("T16", "restart_welcome_ms"): 200.0,
    ("T16", "restart_snapshot_bytes"): 0.0,
}
#: Fixed values: (id, metrics, share of the round trip, milliseconds added).
ROUND_TRIP_LIMITS = (
    ("T4", ("visible_p50_ms", "visible_readdir_p50_ms", "visible_event_p50_ms"), 0.5, 15.0),
    ("T5", ("burst_all_visible_ms",), 1.0, 300.0),
    ("T7", ("open_4k_cold_ms", "open_4k_cold_idle_ms"), 1.0, 5.0),
    ("T9", ("upload_4k_p50_ms",), 1.0, 5.0),
    ("T13", ("p99_interactive_under_load_ms", "p99_pong_under_load_ms", "p99_listdir_under_load_ms"), 1.0, 30.0),
)
WINDOW_BYTES = 14.6 * 1024


def summary(df: DataFrame, by: list[str], value: str, at: str) -> DataFrame:
    """Number, least, percentiles, greatest, mean and last value of each group; non-finite values are left out.

    Percentiles are nearest ranks, elements of the data, found by numbering all values in ranges.
    """
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    whole = ok.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.avg(value), 6).alias("mean"), F.max_by(value, F.col(at)).alias("last"))
    found = same(whole, nearest_ranks(ok, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), by)
    return found.select(*by, "n", "least", "p50", "p95", "p99", "greatest", "mean", "last")


def worse_probe(df: DataFrame, by: list[str], value: str, probe: str, one: str, other: str, p: float = 0.99) -> DataFrame:
    """``by, worse``: the greater of the same percentile of two probes; of one, where a group has only that."""
    both = nearest_ranks(df.filter(F.col(probe).isin(one, other)), [*by, probe], value, {"p": p}).groupBy(*by).agg(F.max("p").alias("worse"))
    return same(df.select(*by).distinct(), both, by, "left")


def link(profile: Column) -> Column:
    """``rtt<ms>[-bw<mbit>][-fqcodel][-ssh]`` as a struct; null if it isn't one, or its queue needs a rate that it lacks."""
    good = profile.rlike("^rtt(0|[1-9][0-9]{0,3}|10000)(-bw[1-9][0-9]{0,8})?(-fqcodel)?(-ssh)?$") & (~profile.contains("-fqcodel") | profile.contains("-bw"))
    rate = F.expr("1L") * F.nullif(F.regexp_extract(profile, "-bw([0-9]+)", 1), F.lit("")).cast("long")
    return F.when(
        good,
        F.struct(
            F.regexp_extract(profile, "^rtt([0-9]+)", 1).cast("long").alias("rtt_ms"), rate.alias("mbit"), (rate * 125_000).alias("bytes_per_s"),
            profile.contains("-fqcodel").alias("fair_queue"), profile.endswith("-ssh").alias("ssh"),
        ),
    )


def cold_limit(size: float, rtt_ms: Column, bytes_per_s: Column) -> Column:
    """Milliseconds that a cold fetch may take: rounds of a growing window, and the line rate."""
    rounds = F.lit(1.0) + F.ceil(F.log2(F.lit(size / WINDOW_BYTES)))
    return rounds * rtt_ms + F.coalesce(F.lit(size) / bytes_per_s * 1e3, F.lit(0.0)) + 5.0


def both_known(a: Column, b: Column) -> Column:
    """And if both are known, else whichever is."""
    return F.when(a.isNotNull() & b.isNotNull(), a & b).otherwise(F.coalesce(a, b))


def verdicts(m: DataFrame) -> DataFrame:
    """Adds ``pass`` to the engine's own rows: by fixed limits, by the link, or by peers on the same link.

    ``m`` has ``id, metric, system, profile, status, value``. Null where no target applies or a peer is unknown.
    """
    peers = m.filter("status = 'ok' AND system <> 'own'").groupBy("id", "profile").agg(
        F.max(F.when((F.col("system") == "local") & (F.col("metric") == "ls_la_ms"), F.col("value"))).alias("local_ls"),
        F.max(F.when((F.col("system") == "sshfs") & (F.col("metric") == "ls_la_cold_ms"), F.col("value"))).alias("sshfs_ls"),
        F.max(F.when((F.col("system") == "raw") & (F.col("metric") == "throughput_mbit"), F.col("value"))).alias("raw_rate"),
    )
    own = m.filter("system = 'own'").join(peers, ["id", "profile"], "left").withColumn("link", link(F.col("profile")))
    v, rtt = F.col("value"), F.col("link.rtt_ms")
    is_ = lambda i, *metrics: (F.col("id") == i) & F.col("metric").isin(*metrics)
    verdict = F.when(v.isNull(), F.lit(None).cast("boolean"))
    for (i, metric), limit in LIMITS.items():
        verdict = verdict.when(is_(i, metric), v <= limit)
    for i, metrics, share, more in ROUND_TRIP_LIMITS:
        verdict = verdict.when(is_(i, *metrics), v <= rtt * share + more)
    verdict = verdict.when(is_("T7", "open_256k_cold_ms", "open_256k_cold_idle_ms"), v <= cold_limit(256 * 1024.0, rtt, F.col("link.bytes_per_s")))
    local, sshfs = v <= 2 * F.col("local_ls"), F.when(rtt == 40, F.col("sshfs_ls") >= 10 * v)
    verdict = verdict.when(is_("T3", "ls_la_ms"), both_known(local, sshfs)).when(is_("T8", "throughput_mbit"), v >= 0.8 * F.col("raw_rate"))
    verdict = verdict.when(is_("T10", "reconnect_catchup_ms") & (rtt <= 40), v <= 1500.0).when(is_("T11", "full_tree_known_s") & (rtt <= 40), v <= 3.0)
    verdict = verdict.when(is_("T17", "rewrite_new_version_pct"), v >= 100.0)
    return own.select("id", "metric", "profile", "value", verdict.alias("pass"))


def speedups(m: DataFrame, peer: str = "sshfs") -> DataFrame:
    """How many times better the engine is than a peer; null unless both were measured and are positive."""
    key = ["id", "metric", "profile"]
    other = m.filter(F.col("system") == peer).select(*key, F.col("value").alias("theirs"), F.col("status").alias("their_status"))
    both = m.filter("system = 'own'").join(other, key, "left")
    ok = (F.col("status") == "ok") & (F.col("their_status") == "ok") & (F.col("value") > 0) & (F.col("theirs") > 0)
    ratio = F.when(F.col("better") == "lower", F.col("theirs") / F.col("value")).otherwise(F.col("value") / F.col("theirs"))
    return both.select(*key, F.when(ok, F.round(ratio, 6)).alias("speedup"))


def noise(unit: Column) -> Column:
    out = F.lit(0.0)
    for name, floor in NOISE.items():
        out = F.when(unit == name, floor).otherwise(out)
    return out


def regressions(base: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``new`` that got worse: no longer measured, target lost, or worse by more than noise and threshold, in that order.

    Both have ``id, metric, system, profile, value, unit, better, status, pass``. Rows that one side lacks are ignored.
    """
    key = ["id", "metric", "system", "profile"]
    old = base.select(*key, F.col("value").alias("before"), F.col("status").alias("old_status"), F.col("pass").alias("old_pass"))
    both = new.join(old, key)
    worse = F.when(F.col("better") == "lower", F.col("value") - F.col("before")).otherwise(F.col("before") - F.col("value"))
    share = F.when(F.col("before") != 0, worse / F.abs("before")).otherwise(float("inf"))
    measured = (F.col("status") == "ok") & (F.col("old_status") == "ok")
    reason = (
        F.when((F.col("old_status") == "ok") & ~F.col("status").isin("ok", "skipped"), F.concat(F.lit("was measured, now "), "status"))
        .when(F.coalesce(F.col("old_pass") & ~F.col("pass"), F.lit(False)), "target passed before, fails now")
        .when(F.coalesce(measured & (worse > noise(F.col("unit"))) & (share > threshold), F.lit(False)), F.concat(F.format_number(share * 100, 1), F.lit("% worse")))
    )
    return both.withColumn("reason", reason).filter("reason IS NOT NULL").select(*key, "before", F.col("value").alias("after"), "reason")


def shown_value(status: Column, value: Column) -> Column:
    """A cell of the scorecard: digits by magnitude, or why there is no value."""
    size = F.abs(value)
    text = F.when(value == 0, "0").when(size >= 100, F.format_string("%.0f", value)).when(size >= 10, F.format_string("%.1f", value)).when(size >= 0.1, F.format_string("%.2f", value)).otherwise(F.format_string("%.4f", value))
    return F.when((status == "ok") & value.isNotNull(), text).when(status == "ok", "-").when(status == "unavailable", "n/a").when(status == "skipped", "skip").otherwise(status)


def id_order(i: Column) -> Column:
    """NET first, then T1, T2, ... T10; others last."""
    return F.when(i == "NET", 0).when(i.rlike("^T+[0-9]{1,9}$"), F.regexp_extract(i, "([0-9]+)$", 1).cast("int") + 1).otherwise(1000)


def scorecard(m: DataFrame) -> DataFrame:
    """One row per id, metric and link with a cell for each system, in order of the ids."""
    cells = m.withColumn("cell", shown_value(F.col("status"), F.col("value")))
    wide = cells.groupBy("profile", "id", "metric").pivot("system", ["own", "sshfs", "local"]).agg(F.first("cell"))
    return wide.withColumn("at", id_order(F.col("id")))


def rendered(m: DataFrame) -> DataFrame:
    """``profile, at, line``: the scorecard of each link as lines of a Markdown table, numbered from 1; the first two are its head."""
    card = scorecard(m).filter("profile IS NOT NULL")
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = card.select("profile", "at", "id", "metric", F.concat(F.lit("| "), F.concat_ws(" | ", "id", "metric", cell("own"), cell("sshfs"), cell("local")), F.lit(" |")).alias("line"))
    at = F.row_number().over(Window.partitionBy("profile").orderBy("at", "id", "metric")) + 2  # a link has some dozens of rows
    heads = card.select("profile").distinct().select("profile", F.posexplode(F.array(F.lit("| id | metric | own | sshfs | local |"), F.lit("|---|---|---|---|---|"))).alias("k", "line"))
    return heads.select("profile", (F.col("k") + 1).cast("int").alias("at"), "line").unionByName(rows.select("profile", at.cast("int").alias("at"), "line"))


def counts(m: DataFrame) -> DataFrame:
    v = verdicts(m)
    return v.agg(F.count_if(F.col("pass").isNotNull()).alias("judged"), F.count_if(F.col("pass") == F.lit(False)).alias("failed"), F.count_if(F.col("value").isNull()).alias("unavailable"))


def reasons(m: DataFrame) -> DataFrame:
    """Why values lack, with the ids concerned, each once, in order."""
    lacking = m.filter("status <> 'ok'").select("status", F.struct(id_order(F.col("id")).alias("at"), "id").alias("x"))
    ids = F.transform(F.array_sort(F.collect_set("x")), lambda x: x["id"])
    return lacking.groupBy("status").agg(F.array_join(ids, ", ").alias("ids"))


def first_seen(m: DataFrame, at: str) -> DataFrame:
    """(id, metric) pairs in the order of their first appearance within each id's place."""
    return m.groupBy("id", "metric").agg(F.min(at).alias("first"), F.min(id_order(F.col("id"))).alias("place"))


def extrapolated(df: DataFrame) -> DataFrame:
    """Time for all entries from the time for those seen: elapsed * total / seen."""
    return df.agg(F.count("*").alias("seen"), F.sum("elapsed").alias("elapsed"), F.max("total").alias("total")).select(F.round(F.col("elapsed") * F.col("total") / F.col("seen"), 6).alias("estimate"))


def _targets(s: SparkSession, d: str) -> DataFrame:
    """Measurements under the names that have targets."""
    m = measurements(s, d)
    names = {"T1": "list_1000_p50_ms", "T2": "stat_p50_us", "T4": "visible_p50_ms", "T5": "burst_all_visible_ms", "T6": "open_small_warm_p50_ms", "T7": "open_256k_cold_ms"}
    metric = F.when((F.col("id") == "T3") & (F.col("system") == "sshfs"), "ls_la_cold_ms").when(F.col("id") == "T3", "ls_la_ms")
    for i, name in names.items():
        metric = metric.when(F.col("id") == i, name)
    return m.withColumn("metric", metric).withColumn("value", F.col("value") * 3)


def _runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = measurements(s, d)
    base = m.withColumn("pass", F.col("value") < 100)
    new = m.withColumn("value", F.when(F.col("samples") % 2 == 0, F.col("value") * 1.2).otherwise(F.col("value") * 0.7))
    new = new.withColumn("status", F.when(F.col("samples") % 5 == 0, "error").otherwise(F.col("status"))).withColumn("pass", F.col("value") < 90)
    return base, new


def _links(s: SparkSession) -> DataFrame:
    texts = ["rtt40-bw50", "rtt0", "rtt100-bw20-fqcodel-ssh", "rtt040", "rtt5-fqcodel", "bw50", "rtt40-ssh-bw50", "rtt10001", "rtt10000-ssh", ""]
    return s.createDataFrame([(t,) for t in texts], "profile string")


def _flat_links(s: SparkSession, d: str) -> DataFrame:
    return _links(s).select("profile", link(F.col("profile")).alias("l")).select("profile", "l.rtt_ms", "l.mbit", "l.bytes_per_s", "l.fair_queue", "l.ssh")


QUERIES = {
    "summary": lambda s, d: summary(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_orderkey").drop("last"),
    "nearest_rank_edges": lambda s, d: nearest_ranks(read(s, d, "orders"), ["o_orderpriority"], "o_totalprice", {"p0": 0, "p1": 0.01, "p100": 1}),
    "worse_probe_p99": lambda s, d: worse_probe(read(s, d, "events"), ["user_id"], "value", "event_type", "view", "click"),
    "link_profiles": _flat_links,
    "verdicts": lambda s, d: verdicts(_targets(s, d)),
    "failed_targets": lambda s, d: verdicts(_targets(s, d)).filter("NOT pass").select("id", "profile"),
    "verdict_counts": lambda s, d: counts(_targets(s, d)),
    "speedups": lambda s, d: speedups(measurements(s, d)),
    "regressions": lambda s, d: regressions(*_runs(s, d), 0.1).select("id", "system", "profile", "reason"),
    "scorecard": lambda s, d: scorecard(measurements(s, d)),
    "scorecard_lines": lambda s, d: rendered(measurements(s, d)),
    "lacking_reasons": lambda s, d: reasons(measurements(s, d)),
    "first_seen": lambda s, d: first_seen(measurements(s, d), "samples"),
    "extrapolated": lambda s, d: extrapolated(read(s, d, "events").filter("event_type = 'view'").select(F.col("value").alias("elapsed"), (F.col("user_id") * 100).alias("total"))),
}
_MEASURES = ("measurements",)
_T = """, t AS (SELECT * REPLACE (CASE WHEN id = 'T3' AND system = 'sshfs' THEN 'ls_la_cold_ms' WHEN id = 'T3' THEN 'ls_la_ms' WHEN id = 'T1' THEN 'list_1000_p50_ms' WHEN id = 'T2' THEN 'stat_p50_us'
  WHEN id = 'T4' THEN 'visible_p50_ms' WHEN id = 'T5' THEN 'burst_all_visible_ms' WHEN id = 'T6' THEN 'open_small_warm_p50_ms' WHEN id = 'T7' THEN 'open_256k_cold_ms' END AS metric, value * 3 AS value) FROM measurements),
p AS (SELECT id, profile, max(value) FILTER (WHERE system = 'local' AND metric = 'ls_la_ms') AS local_ls, max(value) FILTER (WHERE system = 'sshfs' AND metric = 'ls_la_cold_ms') AS sshfs_ls FROM t WHERE status = 'ok' GROUP BY 1, 2),
o AS (SELECT t.*, local_ls, sshfs_ls, CASE WHEN profile LIKE 'rtt40%' THEN 40 ELSE 0 END AS rtt, CASE WHEN profile LIKE '%bw50' THEN 6250000 ELSE 25000000 END AS bps FROM t LEFT JOIN p USING (id, profile) WHERE system = 'own'),
l AS (SELECT *, value <= 2 * local_ls AS ok1, CASE WHEN rtt = 40 THEN sshfs_ls >= 10 * value END AS ok2 FROM o),
v AS (SELECT id, metric, profile, value, CASE WHEN value IS NULL THEN NULL WHEN id = 'T1' THEN value <= 0.5 WHEN id = 'T2' THEN value <= 20 WHEN id = 'T4' THEN value <= rtt / 2 + 15 WHEN id = 'T5' THEN value <= 300 + rtt
  WHEN id = 'T6' THEN value <= 1 WHEN id = 'T7' THEN value <= (1 + ceil(log2(262144 / (14.6 * 1024)))) * rtt + 262144.0 / bps * 1000 + 5
  WHEN id = 'T3' THEN CASE WHEN ok1 IS NOT NULL AND ok2 IS NOT NULL THEN ok1 AND ok2 ELSE coalesce(ok1, ok2) END END AS pass FROM l)"""
_CELL = """CASE WHEN status = 'ok' AND value IS NOT NULL THEN CASE WHEN value = 0 THEN '0' WHEN abs(value) >= 100 THEN printf('%.0f', value) WHEN abs(value) >= 10 THEN printf('%.1f', value) WHEN abs(value) >= 0.1 THEN printf('%.2f', value) ELSE printf('%.4f', value) END
  WHEN status = 'ok' THEN '-' WHEN status = 'unavailable' THEN 'n/a' WHEN status = 'skipped' THEN 'skip' ELSE status END"""
_ORDER = "CASE WHEN id = 'NET' THEN 0 ELSE CAST(substr(id, 2) AS INTEGER) + 1 END"
ORACLE_SQL = {
    "summary": """SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_extendedprice) AS least, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95,
  quantile_disc(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS greatest, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1, 2""",
    "nearest_rank_edges": "SELECT o_orderpriority, min(o_totalprice) AS p0, quantile_disc(o_totalprice, 0.01) AS p1, max(o_totalprice) AS p100 FROM orders GROUP BY 1",
    "worse_probe_p99": "SELECT user_id, greatest(quantile_disc(value, 0.99) FILTER (WHERE event_type = 'view'), quantile_disc(value, 0.99) FILTER (WHERE event_type = 'click')) AS worse FROM events GROUP BY 1",
    "link_profiles": """SELECT * FROM (VALUES ('rtt40-bw50', CAST(40 AS BIGINT), CAST(50 AS BIGINT), CAST(6250000 AS BIGINT), false, false), ('rtt0', 0, NULL, NULL, false, false), ('rtt100-bw20-fqcodel-ssh', 100, 20, 2500000, true, true),
  ('rtt040', NULL, NULL, NULL, NULL, NULL), ('rtt5-fqcodel', NULL, NULL, NULL, NULL, NULL), ('bw50', NULL, NULL, NULL, NULL, NULL), ('rtt40-ssh-bw50', NULL, NULL, NULL, NULL, NULL), ('rtt10001', NULL, NULL, NULL, NULL, NULL),
  ('rtt10000-ssh', 10000, NULL, NULL, false, true), ('', NULL, NULL, NULL, NULL, NULL)) t(profile, rtt_ms, mbit, bytes_per_s, fair_queue, ssh)""",
    "verdicts": with_views(_T + " SELECT * FROM v", *_MEASURES),
    "failed_targets": with_views(_T + " SELECT id, profile FROM v WHERE NOT pass", *_MEASURES),
    "verdict_counts": with_views(_T + " SELECT count(*) FILTER (WHERE pass IS NOT NULL) AS judged, count(*) FILTER (WHERE NOT pass) AS failed, count(*) FILTER (WHERE value IS NULL) AS unavailable FROM v", *_MEASURES),
    "speedups": with_views(
        """SELECT a.id, a.metric, a.profile, CASE WHEN a.status = 'ok' AND b.status = 'ok' AND a.value > 0 AND b.value > 0 THEN round(CASE WHEN a.better = 'lower' THEN b.value / a.value ELSE a.value / b.value END, 6) END AS speedup
FROM measurements a LEFT JOIN measurements b ON a.id = b.id AND a.metric = b.metric AND a.profile = b.profile AND b.system = 'sshfs' WHERE a.system = 'own'""", *_MEASURES
    ),
    "regressions": with_views(
        """, n AS (SELECT *, CASE WHEN samples % 2 = 0 THEN value * 1.2 ELSE value * 0.7 END AS nv, CASE WHEN samples % 5 = 0 THEN 'error' ELSE status END AS ns FROM measurements),
w AS (SELECT *, CASE WHEN better = 'lower' THEN nv - value ELSE value - nv END AS worse FROM n),
r AS (SELECT id, system, profile, CASE WHEN status = 'ok' AND ns NOT IN ('ok', 'skipped') THEN 'was measured, now ' || ns WHEN value < 100 AND NOT nv < 90 THEN 'target passed before, fails now'
  WHEN status = 'ok' AND ns = 'ok' AND worse > CASE unit WHEN 'us' THEN 5 ELSE 0.25 END AND worse / abs(value) > 0.1 THEN printf('%.1f', worse / abs(value) * 100) || '% worse' END AS reason FROM w)
SELECT * FROM r WHERE reason IS NOT NULL""", *_MEASURES
    ),
    "scorecard": with_views(
        f"""SELECT profile, id, metric, max(c) FILTER (WHERE system = 'own') AS own, max(c) FILTER (WHERE system = 'sshfs') AS sshfs, max(c) FILTER (WHERE system = 'local') AS local, {_ORDER} AS at
FROM (SELECT *, {_CELL} AS c FROM measurements) GROUP BY profile, id, metric""", *_MEASURES
    ),
    "scorecard_lines": with_views(
        f""", c AS (SELECT profile, id, metric, max(c) FILTER (WHERE system = 'own') AS own, max(c) FILTER (WHERE system = 'sshfs') AS sshfs, max(c) FILTER (WHERE system = 'local') AS local FROM (SELECT *, {_CELL} AS c FROM measurements) GROUP BY profile, id, metric)
SELECT profile, CAST(row_number() OVER (PARTITION BY profile ORDER BY {_ORDER}, id, metric) + 2 AS INTEGER) AS at, '| ' || id || ' | ' || metric || ' | ' || coalesce(own, '') || ' | ' || coalesce(sshfs, '') || ' | ' || coalesce(local, '') || ' |' AS line FROM c
UNION ALL SELECT DISTINCT profile, 1, '| id | metric | own | sshfs | local |' FROM measurements UNION ALL SELECT DISTINCT profile, 2, '|---|---|---|---|---|' FROM measurements""", *_MEASURES
    ),
    "lacking_reasons": with_views(f"SELECT status, string_agg(id, ', ' ORDER BY {_ORDER}) AS ids FROM (SELECT DISTINCT status, id FROM measurements WHERE status <> 'ok') GROUP BY 1", *_MEASURES),
    "first_seen": with_views(f"SELECT id, metric, min(samples) AS first, min({_ORDER}) AS place FROM measurements GROUP BY 1, 2", *_MEASURES),
    "extrapolated": "SELECT round(sum(value) * max(user_id * 100) / count(*), 6) AS estimate FROM events WHERE event_type = 'view'",
}
ORACLE_SQL = {k: q.replace(")\n, ", "),\n") for k, q in ORACLE_SQL.items()}
