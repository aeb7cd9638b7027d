"""Queries over access logs, run metrics, result tables and windows of events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import access, batching, cache, gather, metrics, temporal
from ..sources import market
from .declare import query
from .sql import with_
from .storage import shared_root

#: Runs made of line items: flags as applications, states as datasets, the number of lines as policies.
RUN_SQL = "(SELECT l_returnflag || l_linestatus || l_linenumber run_id, l_returnflag app, l_linestatus AS dataset, 'policy' || l_linenumber AS policy, round(sum(l_quantity), 2) val FROM lineitem GROUP BY ALL) runs"
POLICIES = [f"policy{n}" for n in range(1, 8)]


LOG_SQL = "(SELECT CASE event_id % 3 WHEN 0 THEN 'sample' WHEN 1 THEN 'feat_bytes' ELSE 'miss_bytes' END item, event_id // 300 AS key, event_id // 300 // 10 epoch, CASE WHEN event_id % 3 = 1 THEN 100.0::DOUBLE ELSE (event_id % 50) * 1.0::DOUBLE END val FROM events) log"


def _runs(spark, sf_dir):
    items = market.read(spark, sf_dir, "lineitem")
    keys = (F.col("l_returnflag").alias("app"), F.col("l_linestatus").alias("dataset"), F.concat(F.lit("policy"), "l_linenumber").alias("policy"))
    run = F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("run_id")
    return items.groupBy(run, *keys).agg(F.round(F.sum("l_quantity"), 2).alias("val"))


def _log(spark, sf_dir):
    """A metric log made of events: three items, 300 events to a key, ten keys to an epoch."""
    e = market.read(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("id"))
    item = F.when(F.col("id") % 3 == 0, "sample").when(F.col("id") % 3 == 1, "feat_bytes").otherwise("miss_bytes")
    key = F.floor(F.col("id") / 300).cast("long")
    return e.select(item.alias("item"), key.alias("key"), F.floor(key / 10).cast("long").alias("epoch"), F.when(F.col("id") % 3 == 1, 100.0).otherwise((F.col("id") % 50).cast("double")).alias("val"))


def _access(spark, sf_dir):
    return market.access_log(spark, sf_dir)


def _users(spark, sf_dir):
    """Degrees of users in the access graph: in-degree, batches; out-degree, event types."""
    e = market.read(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("node_id"), "event_type", "event_id")
    return e.groupBy("node_id").agg(F.count("*").alias("in_degree"), F.countDistinct("event_type").alias("out_degree"))


USERS = "SELECT CAST(user_id AS BIGINT) node_id, count(*) in_degree, count(DISTINCT event_type) out_degree FROM events GROUP BY 1"


@query(with_(["freq"], "SELECT node_id, freq FROM freq"))
def g7_access_counts(spark, sf_dir):
    return access.access_counts(_access(spark, sf_dir))


SIMILAR = "SELECT a.batch_key, count(*) num_node, count(b.node_id) similar FROM access a LEFT JOIN access b ON b.batch_key = a.batch_key - 1 AND b.node_id = a.node_id GROUP BY 1"


@query(with_(["access"], SIMILAR.replace("similar FROM", "\"similar\" FROM")))
def g8_step_similarity(spark, sf_dir):
    return access.step_similarity(_access(spark, sf_dir))


EPOCHS_SQL = {
    "ranked": "SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY freq DESC, node_id DESC) - 1 AS rank FROM (SELECT epoch, node_id, count(*) freq FROM access GROUP BY 1, 2)",
    "hot": "SELECT epoch, node_id, freq FROM ranked WHERE rank < (SELECT count(DISTINCT user_id) FROM events) * 0.1",
    "sim": "SELECT a.epoch, round(sum(least(a.freq, coalesce(b.freq, 0))) * 100.0::DOUBLE / sum(a.freq), 6) similarity FROM hot a LEFT JOIN hot b ON b.epoch = a.epoch - 1 AND b.node_id = a.node_id GROUP BY 1",
}


def _similarity(spark, sf_dir):
    n = market.read(spark, sf_dir, "events").select("user_id").distinct().count()
    return access.epoch_similarity(_access(spark, sf_dir), n)


@query(with_(["access"], "SELECT epoch, similarity FROM sim", **EPOCHS_SQL))
def g9_epoch_similarity(spark, sf_dir):
    return _similarity(spark, sf_dir)


@query(with_(["access"], "SELECT round(avg(similarity), 6) mean_similarity FROM sim WHERE epoch >= 1", **EPOCHS_SQL))
def g10_mean_similarity(spark, sf_dir):
    return access.mean_similarity(_similarity(spark, sf_dir))


@query(with_(["freq"], "SELECT row_number() OVER (ORDER BY freq DESC, node_id DESC) - 1 place, node_id, freq, in_degree, out_degree FROM freq JOIN users USING (node_id)", users=USERS))
def g11_access_report(spark, sf_dir):
    return access.access_report(_access(spark, sf_dir), _users(spark, sf_dir))


@query(with_(["freq"], """SELECT freq, num_node, num_access, min_in, avg_in, max_in, min_out, avg_out, max_out, round(num_node * 100.0::DOUBLE / sum(num_node) OVER (), 6) node_pct, round(sum(num_node) OVER w * 100.0::DOUBLE / sum(num_node) OVER (), 6) cum_node_pct,
 round(num_access * 100.0::DOUBLE / sum(num_access) OVER (), 6) access_pct, round(sum(num_access) OVER w * 100.0::DOUBLE / sum(num_access) OVER (), 6) cum_access_pct FROM t WINDOW w AS (ORDER BY freq DESC ROWS UNBOUNDED PRECEDING)""",
             users=USERS, t="SELECT freq, count(*) num_node, CAST(sum(freq) AS BIGINT) num_access, min(in_degree) min_in, round(avg(in_degree), 6) avg_in, max(in_degree) max_in, min(out_degree) min_out, round(avg(out_degree), 6) avg_out, max(out_degree) max_out FROM freq JOIN users USING (node_id) GROUP BY 1"))
def g12_frequency_table(spark, sf_dir):
    return access.frequency_table(_access(spark, sf_dir), _users(spark, sf_dir))


@query(with_(["access"], f"SELECT batch_key, round(s / num_node::DOUBLE, 6) ratio FROM ({SIMILAR.replace('similar FROM', 's FROM')})"))
def g13_step_ratio(spark, sf_dir):
    return access.step_ratio(access.step_similarity(_access(spark, sf_dir)))


@query(with_(["freq"], "SELECT CAST(r AS BIGINT) percent, round(coalesce((SELECT sum(freq) FROM k WHERE rk < r * n // 100), 0) / t::DOUBLE, 6) hit FROM (SELECT unnest(range(101)) r), (SELECT count(*) n, sum(freq) t FROM freq)",
             k="SELECT freq, row_number() OVER (ORDER BY freq DESC, node_id DESC) - 1 rk FROM freq"))
def g14_hit_curve(spark, sf_dir):
    freq = access.access_counts(_access(spark, sf_dir))
    return access.hit_curve(freq, freq.count())


@query(with_(["access", "freq"], "SELECT row_number() OVER (ORDER BY presampled DESC, node_id DESC) - 1 AS rank, node_id, presampled, real FROM (SELECT f.node_id, (SELECT count(*) FROM access a WHERE a.node_id = f.node_id AND a.epoch = 0) presampled, (SELECT count(*) FROM access a WHERE a.node_id = f.node_id AND a.epoch > 0) \"real\" FROM freq f)"))
def g15_presample_report(spark, sf_dir):
    a = _access(spark, sf_dir)
    ranking = cache.rank_presample(a.select("node_id").distinct(), a.where("epoch = 0"))
    return access.presample_report(ranking, a.where("epoch > 0"))


@query(f"SELECT item, epoch, round(sum(val), 6) total, count(DISTINCT key) num_key FROM {LOG_SQL} GROUP BY 1, 2")
def g16_metric_log(spark, sf_dir):
    return metrics.log_summary(_log(spark, sf_dir), "epoch")


@query(f"SELECT item, round(sum(CASE WHEN key > 0 THEN val ELSE 0 END) / greatest(count(DISTINCT key) - 1, 1), 6) AS mean FROM {LOG_SQL} GROUP BY 1")
def g17_mean_after_first(spark, sf_dir):
    return metrics.mean_after_first(_log(spark, sf_dir))


@query(f"SELECT key, round((f - m) / f, 6) hit_rate FROM (SELECT key, sum(val) FILTER (item = 'feat_bytes') f, sum(val) FILTER (item = 'miss_bytes') m FROM {LOG_SQL} GROUP BY 1)")
def g18_byte_hit_rate(spark, sf_dir):
    return metrics.byte_hit_rate(_log(spark, sf_dir))


@query(f"SELECT key, printf('sample %.4f | miss_bytes %.4f', coalesce(sum(val) FILTER (item = 'sample'), 0), coalesce(sum(val) FILTER (item = 'miss_bytes'), 0)) line FROM {LOG_SQL} GROUP BY 1")
def g19_step_report(spark, sf_dir):
    return metrics.step_report(_log(spark, sf_dir), ["sample", "miss_bytes"])


@query(f"SELECT app, dataset, {', '.join(f'max(val) FILTER (policy = {chr(39)}{p}{chr(39)}) AS {p}' for p in POLICIES)} FROM {RUN_SQL} GROUP BY 1, 2")
def g20_result_pivot(spark, sf_dir):
    return metrics.pivot_results(_runs(spark, sf_dir), ["app", "dataset"], "policy", POLICIES)


LAYOUT = {1: ["sample"], 2: ["feat_bytes", "miss_bytes"], 3: ["none_such"]}


@query(f"SELECT key, unnest([1, 2, 3]) AS level, unnest([printf('L1 sample %.4f', coalesce(sum(val) FILTER (item = 'sample'), 0)), printf('L2 feat_bytes %.4f | miss_bytes %.4f', coalesce(sum(val) FILTER (item = 'feat_bytes'), 0), coalesce(sum(val) FILTER (item = 'miss_bytes'), 0)), 'L3 none_such 0.0000']) AS line FROM {LOG_SQL} GROUP BY 1")
def g19_level_report(spark, sf_dir):
    return metrics.level_report(_log(spark, sf_dir), LAYOUT, 3)


@query("SELECT event_type, sum(1) FILTER (user_id % 2 = 0)::BIGINT AS even, sum(1) FILTER (user_id % 2 = 1)::BIGINT AS odd FROM events GROUP BY 1")
def g21_count_pivot(spark, sf_dir):
    e = market.read(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("side"))
    return metrics.count_pivot(e, "event_type", "side", ["even", "odd"])


@query("""SELECT k, pct, round(5120 * 128 * 100.0::DOUBLE / 54228 / nullif(pct, 0), 6) dim, round(5120 * 128 * 100.0::DOUBLE / 54228 / nullif(pct, 0) * num_input * 4 / 1073741824, 9) copy_gb
 FROM (SELECT p_partkey k, (p_size % 51) * 2.0::DOUBLE pct, p_retailprice num_input FROM part)""")
def g22_dimension_simulation(spark, sf_dir):
    """Each part's size as a cached share, its price as the inputs of a batch."""
    part = market.read(spark, sf_dir, "part")
    points = part.select(F.col("p_partkey").alias("k"), (F.col("p_size") % 51 * 2).cast("double").alias("pct"), F.col("p_retailprice").alias("num_input"))
    return metrics.dimension_simulation(points, keep=["k"])


@query("SELECT CAST(sum(CASE WHEN best = label THEN 1 ELSE 0 END) AS BIGINT) correct, count(*) total, round(avg(CASE WHEN best = label THEN 1.0::DOUBLE ELSE 0 END), 6) accuracy FROM (SELECT label, list_position(e, list_max(e)) - 1 best FROM (SELECT label, embedding[1:10] e FROM embeddings))")
def g23_accuracy(spark, sf_dir):
    v = market.read(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 10).alias("scores"), "label")
    return metrics.accuracy(v)


@query(f"SELECT key, round(coalesce(sum(val) FILTER (item = 'sample'), 0) + coalesce(sum(val) FILTER (item = 'miss_bytes'), 0), 6) epoch_time FROM {LOG_SQL} GROUP BY 1")
def g24_derived_metrics(spark, sf_dir):
    wide = _log(spark, sf_dir).groupBy("key").pivot("item", ["sample", "miss_bytes"]).agg(F.sum("val"))
    return metrics.derive(wide, {"epoch_time": ["sample", "miss_bytes"]}).select("key", "epoch_time")


@query("""SELECT app, dataset, CASE WHEN app = 'R' THEN 8 ELSE cache END AS cache FROM (SELECT DISTINCT l_returnflag app FROM lineitem), (SELECT DISTINCT l_linestatus AS dataset FROM lineitem),
 (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS cache FROM lineitem) WHERE cache IN (1, 3)""")
def g25_config_combos(spark, sf_dir):
    """Every combination of the flags, states and numbers that line items have, selected and overridden."""
    items = market.read(spark, sf_dir, "lineitem")
    options = items.select(F.col("l_returnflag").alias("app"), F.col("l_linestatus").alias("dataset"), F.col("l_linenumber").cast("int").alias("cache"))
    return metrics.ConfigList.combo_of(options, "app", "dataset", "cache").select("cache", 1, 3).override("cache", 8, F.col("app") == "R").df


@query(f"SELECT app, dataset, policy, run_id, count(run_id) OVER (PARTITION BY app, dataset, policy) AS matches FROM (SELECT DISTINCT l_returnflag app, l_linestatus AS dataset, 'policy' || (l_linenumber + 3) AS policy FROM lineitem) d LEFT JOIN {RUN_SQL} USING (app, dataset, policy)")
def e12_match_configs(spark, sf_dir):
    """Wanted configurations, some of which no run has, with their runs."""
    items = market.read(spark, sf_dir, "lineitem")
    wanted = items.select(F.col("l_returnflag").alias("app"), F.col("l_linestatus").alias("dataset"), F.concat(F.lit("policy"), F.col("l_linenumber") + 3).alias("policy")).distinct()
    return gather.match_runs(wanted, _runs(spark, sf_dir).select("run_id", "app", "dataset", "policy"), ["app", "dataset", "policy"])


@query(with_(["freq"], """SELECT p.percent, h.hit FROM (SELECT CAST(p_partkey AS BIGINT) % 400 / 400.0::DOUBLE percent FROM part) p LEFT JOIN (SELECT r / 100.0::DOUBLE percent, round(coalesce((SELECT sum(freq) FROM k WHERE rk < r * n // 100), 0) / t::DOUBLE, 6) hit FROM (SELECT unnest(range(101)) r), (SELECT count(*) n, sum(freq) t FROM freq)) h ON round(h.percent * 10000) = round(p.percent * 10000)""",
             k="SELECT freq, row_number() OVER (ORDER BY freq DESC, node_id DESC) - 1 rk FROM freq"))
def e13_curve_lookup(spark, sf_dir):
    """Places on the hit curve of the events' accesses: only whole percents lie on it."""
    freq = access.access_counts(_access(spark, sf_dir))
    curve = access.hit_curve(freq, freq.count()).select((F.col("percent") / 100).alias("percent"), "hit")
    points = market.read(spark, sf_dir, "part").select(((F.col("p_partkey") % 400) / 400).alias("percent"))
    return gather.curve_lookup(points, curve)


TRACE = "SELECT event_type item, event_id AS key, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id * 10 END b, event_id * 10 + 5 e FROM events"


@query(f"""SELECT key, item, ph, '{{"name":"' || item || '_' || key || '","ph":"' || ph || '","pid":0,"tid":' || tid || ',"ts":' || ts || '}}' "event" FROM (SELECT key, item, coalesce(list_position(['click', 'purchase'], item), 0) tid, unnest(['B', 'E']) ph, unnest([b, e]) ts FROM ({TRACE}) WHERE b <> 0)""")
def a19_chrome_trace(spark, sf_dir):
    e = market.read(spark, sf_dir, "events").select(F.col("event_type").alias("item"), F.col("event_id").cast("long").alias("key"))
    trace = e.select("item", "key", F.when(F.col("key") % 7 == 0, 0).otherwise(F.col("key") * 10).alias("begin_us"), (F.col("key") * 10 + 5).alias("end_us"))
    return metrics.chrome_trace(trace, ["click", "purchase"])


def _lines(spark, lines):
    """Lines written as text files and read back."""
    path = f"{shared_root(spark)}/lines-{uuid.uuid4().hex}"
    lines.select("value").write.text(path)
    return spark.read.text(path)


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 'test_result' ELSE 'config' END kind, event_type || '=' || user_id AS key, event_id || '' AS val FROM events WHERE event_id % 4 < 2")
def a20_log_lines(spark, sf_dir):
    """Log lines of four kinds, of which two are read; a key may hold the sign that ends it."""
    e, n = market.read(spark, sf_dir, "events"), F.col("event_id")
    head = F.when(n % 4 == 0, "test_result:").when(n % 4 == 1, "config:").when(n % 4 == 2, " config:").otherwise("noise ")
    return metrics.parse_log(_lines(spark, e.select(F.concat(head, "event_type", F.lit("="), "user_id", F.lit("="), "event_id").alias("value"))))


@query("SELECT (event_id % 101)::DOUBLE + 0.5 AS accuracy, event_id * 0.25::DOUBLE AS seconds FROM events WHERE event_id % 3 < 2")
def a21_accuracy_lines(spark, sf_dir):
    """Lines of validation accuracy in two forms, among lines of test accuracy."""
    e, n = market.read(spark, sf_dir, "events"), F.col("event_id")
    acc, took = F.concat((n % 101).cast("string"), F.lit(".5%")), F.format_string("%.2f", n * F.lit(0.25))
    line = F.when(n % 3 == 0, F.concat(F.lit("Epoch 3 | Valid Acc: "), acc, F.lit(" | Time Cost: "), took)).when(n % 3 == 1, F.concat(F.lit("Valid Acc: "), acc, F.lit(" , Total Time Cost: "), took)).otherwise(F.concat(F.lit("Test Acc: "), acc))
    return metrics.parse_accuracy(_lines(spark, e.select(line.alias("value"))))


@query("SELECT date_trunc('hour', ts) AS start, CAST(user_id AS BIGINT) node_id, count(*) freq FROM events GROUP BY 1, 2")
def n1_windowed_access(spark, sf_dir):
    from ..streaming.access import windowed_access

    return windowed_access(market.read(spark, sf_dir, "events"))


@query("""SELECT CAST(user_id AS BIGINT) node_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) freq FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END fresh FROM events)) GROUP BY user_id, s""")
def n2_session_access(spark, sf_dir):
    from ..streaming.access import session_access

    return session_access(market.read(spark, sf_dir, "events"))


@query(with_(["access"], "SELECT a.batch_key, a.node_id, b.node_id IS NOT NULL again FROM access a LEFT JOIN access b ON b.batch_key = a.batch_key - 1 AND b.node_id = a.node_id"))
def n3_repeats_batch_form(spark, sf_dir):
    """What the keyed-state stream must equal once all batches are in."""
    a = _access(spark, sf_dir)
    before = a.select((F.col("batch_key") + 1).alias("batch_key"), "node_id", F.lit(True).alias("again"))
    return a.join(before, ["batch_key", "node_id"], "left").select("batch_key", "node_id", F.coalesce("again", F.lit(False)).alias("again"))


#: Files of a micro-batch.
FILES = 4


def _in_quarters(rows, order, folder):
    """Write rows in four steps by order, each of FILES files, for a stream that takes a step a micro-batch."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.floor((order - low) * 4 / (high - low + 1))
    for k in range(4):
        rows.where(part == k).repartition(FILES).write.mode("append").parquet(folder)


@query(with_(["access"], "SELECT a.batch_key, a.node_id, b.node_id IS NOT NULL again FROM access a LEFT JOIN access b ON b.batch_key = a.batch_key - 1 AND b.node_id = a.node_id"))
def o1_repeats_stream(spark, sf_dir):
    """The access log as a stream of four quarters in order, each some files and one micro-batch, with state by node, into a table."""
    from ..streaming.access import read_events, repeats_across_batches

    folder = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    log = _access(spark, sf_dir).select("batch_key", "node_id")
    _in_quarters(log, F.col("batch_key"), f"{folder}/in")
    stream = repeats_across_batches(read_events(spark, f"{folder}/in", "batch_key long, node_id long", FILES))
    done = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT date_trunc('hour', ts) AS start, CAST(user_id AS BIGINT) node_id, count(*) freq FROM events GROUP BY 1, 2")
def o2_windows_stream(spark, sf_dir):
    """Windowed access counts of a stream, each micro-batch replacing the counts it changed."""
    from ..streaming.access import latest_counts

    folder = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    events = market.read(spark, sf_dir, "events")
    _in_quarters(events, F.unix_micros(F.col("ts").cast("timestamp")), f"{folder}/in")
    return latest_counts(spark, f"{folder}/in", events.schema, f"{folder}/out", f"{folder}/state", "1 hour", FILES)


@query("SELECT user_id AS k, CAST(coalesce(sum(1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) before_, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def h1_prefix_and_topk(spark, sf_dir):
    """Exclusive running counts, compaction and the last three events of each user."""
    e = market.read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id")
    return access.prefix_and_last(e, "k", "event_id", 3).select("k", "before_", "event_id")


@query("""SELECT o_custkey k, n steps, CAST(w AS INTEGER) worker, w * (n // 3) first_step, CASE WHEN w = 2 THEN n ELSE (w + 1) * (n // 3) END end_step, (n + 2) // 3 needed
 FROM (SELECT o_custkey, count(*) n FROM orders GROUP BY 1), (SELECT unnest(range(3)) w)""")
def j6_step_shares(spark, sf_dir):
    """Shares of three workers in as many steps as a customer has orders."""
    steps = market.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("steps"))
    return batching.step_shares(steps, 3)


@query("""SELECT e.event_id, e.user_id, p.event_id last_id, p.value last_value FROM events e
 ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON p.user_id = e.user_id AND p.ts <= e.ts""")
def n4_as_of(spark, sf_dir):
    """Each event with the last purchase of its user as of its time."""
    e = market.read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    return temporal.as_of_join(e.select("event_id", "user_id", "ts"), bought, "user_id", "ts", "last_id", "last_value", tie=F.col("last_id")).drop("ts")


@query("""SELECT a.event_id, b.event_id cause_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts >= b.ts AND a.ts < b.ts + to_microseconds(CAST(round(b.value * 600000000) AS BIGINT)) WHERE b.event_type = 'error'""")
def n5_within_intervals(spark, sf_dir):
    """Each event with the errors of its user that are not over: one lasts ten minutes for each unit of its value."""
    e = market.read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    until = F.col("at") + F.round(F.col("value") * 600000000).cast("long")
    errors = e.where("event_type = 'error'").select("user_id", F.col("at").alias("since"), until.alias("until"), F.col("event_id").alias("cause_id"))
    return temporal.interval_join(e.select("event_id", "user_id", "at"), errors, "user_id", "at", "since", "until").select("event_id", "cause_id")
