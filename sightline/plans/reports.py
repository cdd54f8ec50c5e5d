"""Queries of the evaluation and profiler reports, on the events table.

An event is an evaluation value: its type is the algorithm, its user modulo five the commit; and a profiler
checkpoint: its user is the session, its type the stage. Its props are the notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.parsing import aliased, format_value, label_of, listed, option, option_bool, parse_intrinsics
from sightline.operators import evaluation as ev
from sightline.operators import profiling as prof
from sightline.runtime import table

COMMITS = [0, 1, 2, 3, 4]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation values in long form."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.col("event_type").alias("algorithm"), (F.col("user_id") % 5).cast("int").alias("eval_commit"), "value", "props", "ts", "user_id")


RESULTS_SQL = "(SELECT event_id, event_type AS algorithm, (user_id % 5)::INT AS eval_commit, value, props, ts, user_id FROM events)"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def eval_all_stats(spark, sf_dir):
    out = ev.all_stats(results(spark, sf_dir), ["algorithm", "eval_commit"], "value")
    return _rounded(out, "mean", "median", "min", "max", "stddev")


def eval_comparison_pivot(spark, sf_dir):
    out = ev.comparison_pivot(results(spark, sf_dir), "algorithm", "eval_commit", "value", COMMITS)
    return out.select("algorithm", *[F.round(str(c), 6).alias(f"commit_{c}") for c in COMMITS])


def eval_best_second_best(spark, sf_dir):
    means = results(spark, sf_dir).groupBy("eval_commit", "algorithm").agg(F.round(F.avg("value"), 6).alias("mean"))
    return ev.best_and_second(means, ["eval_commit"], "algorithm", "mean")


def eval_raw_notes(spark, sf_dir):
    raw = results(spark, sf_dir).withColumn("notes", F.from_json("props", "map<string,string>"))
    return ev.expand_notes(raw.select("event_id", "algorithm", "eval_commit", F.round("value", 6).alias("value"), "notes"), "notes", "k")


def eval_smart_commit(spark, sf_dir):
    named = results(spark, sf_dir).select("event_id", F.concat_ws("_", "algorithm", F.when(F.col("event_id") % 7 != 0, F.col("eval_commit").cast("string"))).alias("commit"))
    return ev.with_smart_commit(named, "commit").select("event_id", "commit", "commit_prefix", F.col("commit_number").cast("double").alias("commit_number"))


def eval_note_validation(spark, sf_dir):
    users = results(spark, sf_dir).groupBy("algorithm", "user_id").agg(F.count("value").alias("n_values"), F.count_if(F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("n_notes"))
    return ev.check_notes(users, F.col("n_values"), F.col("n_notes"))


def eval_success_ratio(spark, sf_dir):
    return _rounded(ev.success_ratio(results(spark, sf_dir), ["algorithm"], F.col("value") > 50), "ratio")


def eval_failure_reasons(spark, sf_dir):
    reason = F.when(F.col("value").isNull(), "no_value").when(F.col("value") < 1, "too_small").when(F.col("value") > 200, "too_large")
    return ev.counts_by_reason(results(spark, sf_dir), reason)


def summary_union_datasets(spark, sf_dir):
    parts = {
        "orders": table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("amount")),
        "customer": table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("amount"), F.col("c_nationkey").alias("nation")),
    }
    out = ev.union_datasets(parts).groupBy("dataset", "name").agg(F.count(F.lit(1)).alias("n"), F.count("nation").alias("n_nation"), F.round(F.avg("amount"), 4).alias("mean_amount"))
    return out


def summary_all_metrics(spark, sf_dir):
    long = results(spark, sf_dir).select(
        F.lit("events").alias("eval_type"), "algorithm", "eval_commit",
        F.explode(F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.get_json_object("props", "$.k").cast("double"))).alias("metric", "value"),
    )
    return _rounded(ev.summary_over_metrics(long), "mean", "median", "min", "max", "stddev")


def csv_na_cleaner(spark, sf_dir):
    d = results(spark, sf_dir)
    cell = [F.when(F.col("event_id") % k == 0, "N/A").otherwise(F.format_string("%d", F.col("event_id"))) for k in (2, 3, 5, 7)]
    lines = d.select("event_id", F.concat_ws(",", F.when(F.col("event_id") % 11 == 0, "N/A").otherwise("row"), *cell).alias("line"))
    return ev.drop_unavailable_lines(lines, "line")


def pipeline_pivot(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).cast("int").alias("dataset"), F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("pipeline"), "o_totalprice")
    names = {"1-urgent": "urgent", "2-high": "high", "3-medium": "medium", "4-not specified": "none", "5-low": "low"}
    out = ev.pipeline_table(runs, "dataset", "pipeline", "o_totalprice", names, ["urgent", "high", "low"], "urgent")
    return _rounded(out, "urgent", "high", "low")


def pipeline_list_parse(spark, sf_dir):
    known = ["furniture", "building", "machinery"]
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), "c_mktsegment", F.lit(" , ,Unknown")).alias("text"))
    name = asked.select("c_custkey", F.explode(listed(F.col("text"))).alias("pipeline"))
    return name.withColumn("is_known", F.col("pipeline").isin(*known))


def drop_commit_column(spark, sf_dir):
    return results(spark, sf_dir).drop("eval_commit", "props", "ts", "user_id").withColumn("value", F.round("value", 6))


def profile_sessions(spark, sf_dir):
    by_session = results(spark, sf_dir).groupBy("algorithm", "user_id").agg(F.sum("value").alias("ms"), F.max("value").alias("memory"), (F.sum("value") / 2).alias("cpu"))
    out = prof.session_summary(by_session, "algorithm", "ms", "memory", "cpu")
    return out.select("algorithm", "n_sessions", *[F.round(c, 4).alias(c) for c in ("total_ms", "mean_ms", "min_ms", "max_ms", "peak_memory", "cpu_percent")])


def profile_intervals(spark, sf_dir):
    found = prof.intervals(results(spark, sf_dir).withColumn("label", F.lit("all")), ["label", "user_id"], "algorithm", "ts", "event_id")
    return _rounded(prof.interval_summary(found, "label"), "total_ms", "average_ms").withColumn("total_ms", F.round("total_ms", 3))


def profile_core_time(spark, sf_dir):
    return prof.core_time(results(spark, sf_dir), "algorithm", "value")


def profile_label_concat(spark, sf_dir):
    return results(spark, sf_dir).select("event_id", label_of({"algorithm": F.col("algorithm"), "commit": F.col("eval_commit")}).alias("label"))


def option_cast(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("event_id"))).when(F.col("event_id") % 3 == 1, F.lit("oops"))
    flag = F.element_at(F.array(*[F.lit(x) for x in ("Yes", "off", "1", "maybe", "TRUE")]), (F.col("event_id") % 5 + 1).cast("int"))
    return results(spark, sf_dir).select("event_id", option(text, "bigint", -1).alias("as_index"), option(text, "double", 0.5).alias("as_double"), option_bool(flag, True).alias("as_bool"))


def intrinsics_parse(spark, sf_dir):
    parts = [F.col("event_id").cast("string"), *[F.lit(str(i)) for i in range(1, 8)]]
    text = F.concat(F.concat_ws(",", *parts[:5]), F.lit(" ; "), F.concat_ws(";", *parts[5:]), F.when(F.col("event_id") % 2 == 0, F.lit(", 9")).when(F.col("event_id") % 3 == 0, F.lit(",x")).otherwise(F.lit("")))
    return results(spark, sf_dir).select("event_id", parse_intrinsics(text).alias("k")).select("event_id", F.size(F.coalesce("k", F.array())).alias("n"), F.element_at("k", 1).alias("first"), F.element_at("k", 9).alias("ninth"))


def number_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", format_value(F.col("o_totalprice").cast("double")).alias("shown"))


def pipeline_alias(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", aliased(F.col("c_mktsegment"), {"building": "house", "machinery": "machine"}).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (
        eval_all_stats, eval_comparison_pivot, eval_best_second_best, eval_raw_notes, eval_smart_commit, eval_note_validation, eval_success_ratio, eval_failure_reasons, summary_union_datasets,
        summary_all_metrics, csv_na_cleaner, pipeline_pivot, pipeline_list_parse, drop_commit_column, profile_sessions, profile_intervals, profile_core_time, profile_label_concat, option_cast,
        intrinsics_parse, number_format, pipeline_alias,
    )
}

_STATS = "round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_samp(value), 6) AS stddev, count(value) AS count"
_MEANS = f"(SELECT eval_commit, algorithm, round(avg(value), 6) AS mean FROM {RESULTS_SQL} GROUP BY ALL)"

SQL = {
    "eval_all_stats": f"SELECT algorithm, eval_commit, {_STATS} FROM {RESULTS_SQL} GROUP BY algorithm, eval_commit",
    "eval_comparison_pivot": "SELECT algorithm, " + ", ".join(f"round(avg(value) FILTER (eval_commit = {c}), 6) AS commit_{c}" for c in COMMITS) + f" FROM {RESULTS_SQL} GROUP BY algorithm",
    "eval_best_second_best": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY eval_commit ORDER BY mean, algorithm) AS n FROM {_MEANS})
        SELECT a.eval_commit, a.algorithm AS best, a.mean AS best_value, b.algorithm AS second, b.mean AS second_value FROM r a JOIN r b ON a.eval_commit = b.eval_commit AND a.n = 1 AND b.n = 2""",
    "eval_raw_notes": f"SELECT event_id, algorithm, eval_commit, round(value, 6) AS value, json_extract_string(props, '$.k') AS k FROM {RESULTS_SQL}",
    "eval_smart_commit": f"""SELECT event_id, c AS commit, CASE WHEN regexp_matches(c, '^.*_[0-9]+$') THEN regexp_extract(c, '^(.*)_[0-9]+$', 1) END AS commit_prefix,
        CASE WHEN regexp_matches(c, '^.*_[0-9]+$') THEN regexp_extract(c, '_([0-9]+)$', 1)::DOUBLE END AS commit_number
        FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN algorithm || '_' || eval_commit ELSE algorithm END AS c FROM {RESULTS_SQL})""",
    "eval_note_validation": f"""SELECT *, n_notes = n_values OR n_notes <= 1 AS notes_ok FROM
        (SELECT algorithm, user_id, count(value) AS n_values, count(*) FILTER (json_extract_string(props, '$.k')::INT % 2 = 0) AS n_notes FROM {RESULTS_SQL} GROUP BY ALL)""",
    "eval_success_ratio": f"SELECT algorithm, count(*) AS total, count(*) FILTER (value > 50) AS successful, round(count(*) FILTER (value > 50) / count(*), 6) AS ratio FROM {RESULTS_SQL} GROUP BY algorithm",
    "eval_failure_reasons": f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN value IS NULL THEN 'no_value' WHEN value < 1 THEN 'too_small' WHEN value > 200 THEN 'too_large' END AS reason FROM {RESULTS_SQL}) WHERE reason IS NOT NULL GROUP BY reason",
    "summary_union_datasets": """SELECT dataset, name, count(*) AS n, count(nation) AS n_nation, round(avg(amount), 4) AS mean_amount FROM (
        SELECT 'orders' AS dataset, o_orderstatus AS name, o_totalprice AS amount, NULL::INT AS nation FROM orders UNION ALL SELECT 'customer', c_mktsegment, c_acctbal, c_nationkey FROM customer) GROUP BY ALL""",
    "summary_all_metrics": f"""SELECT 'events' AS eval_type, metric, algorithm, eval_commit, {_STATS} FROM (
        SELECT algorithm, eval_commit, 'value' AS metric, value FROM {RESULTS_SQL} UNION ALL SELECT algorithm, eval_commit, 'k', json_extract_string(props, '$.k')::DOUBLE FROM {RESULTS_SQL}) GROUP BY ALL""",
    "csv_na_cleaner": f"""SELECT event_id, line FROM (SELECT event_id, concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'N/A' ELSE 'row' END,
        {", ".join(f"CASE WHEN event_id % {k} = 0 THEN 'N/A' ELSE event_id::VARCHAR END" for k in (2, 3, 5, 7))}) AS line FROM {RESULTS_SQL}) WHERE (length(line) - length(replace(line, 'N/A', ''))) / 3 < 4""",
    "pipeline_pivot": """SELECT (o_custkey % 20)::INT AS dataset, round(avg(o_totalprice) FILTER (o_orderpriority ILIKE '1-urgent'), 6) AS urgent, round(avg(o_totalprice) FILTER (o_orderpriority ILIKE '2-high'), 6) AS high,
        round(avg(o_totalprice) FILTER (o_orderpriority ILIKE '5-low'), 6) AS low FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderpriority ILIKE '1-urgent') > 0""",
    "pipeline_list_parse": "SELECT c_custkey, p AS pipeline, p IN ('furniture', 'building', 'machinery') AS is_known FROM (SELECT c_custkey, unnest([lower(c_mktsegment), 'unknown']) AS p FROM customer)",
    "drop_commit_column": f"SELECT event_id, algorithm, round(value, 6) AS value FROM {RESULTS_SQL}",
    "profile_sessions": f"""SELECT algorithm, count(ms) AS n_sessions, round(sum(ms), 4) AS total_ms, round(avg(ms), 4) AS mean_ms, round(min(ms), 4) AS min_ms, round(max(ms), 4) AS max_ms,
        round(max(memory), 4) AS peak_memory, round(100 * sum(cpu) / sum(ms), 4) AS cpu_percent
        FROM (SELECT algorithm, user_id, sum(value) AS ms, max(value) AS memory, sum(value) / 2 AS cpu FROM {RESULTS_SQL} GROUP BY ALL) GROUP BY algorithm""",
    "profile_intervals": f"""SELECT 'all' AS label, interval, round(sum(ms), 3) AS total_ms, round(avg(ms), 6) AS average_ms, count(*) AS count FROM (
        SELECT algorithm || '->' || lead(algorithm) OVER w AS interval, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000.0 AS ms FROM {RESULTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE interval IS NOT NULL GROUP BY interval""",
    "profile_core_time": f"SELECT algorithm, round(sum(value))::BIGINT AS core_time_ms FROM {RESULTS_SQL} GROUP BY algorithm",
    "profile_label_concat": f"SELECT event_id, 'algorithm=' || algorithm || '_commit=' || eval_commit AS label FROM {RESULTS_SQL}",
    "option_cast": f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE -1 END AS as_index, CASE WHEN event_id % 3 = 0 THEN event_id::DOUBLE ELSE 0.5 END AS as_double, event_id % 5 <> 1 AS as_bool FROM {RESULTS_SQL}""",
    "intrinsics_parse": f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 9 ELSE 0 END::INT AS n, CASE WHEN event_id % 2 = 0 THEN event_id::DOUBLE END AS first, CASE WHEN event_id % 2 = 0 THEN 9.0::DOUBLE END AS ninth FROM {RESULTS_SQL}""",
    "number_format": "SELECT o_orderkey, CASE WHEN abs(o_totalprice) >= 10000 THEN format('{:,.4f}', o_totalprice) ELSE format('{:.4f}', o_totalprice) END AS shown FROM orders",
    "pipeline_alias": "SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'house' WHEN 'machinery' THEN 'machine' ELSE lower(c_mktsegment) END AS name FROM customer",
}
