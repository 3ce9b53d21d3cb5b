"""Tables, joins, changes, configurations, catalogs and file lists over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.functions.names import basename, config_path, gpu_arch, model_epoch, model_id, model_iteration, percent
from runledger.operators.best import merge_metadata
from runledger.operators.catalog import cheapest, eligible_instances
from runledger.operators.tables import (
    attached, delete_rows, entity_counts as counts_of, get_one as first_match, job_tree as tree, lookup, migrate, semi,
    update_rows, upsert, where_eq as equal_rows,
)
from runledger.plans.config import DEFAULTS, SETTINGS, TASKS, derive_config, validate_requests, write_configs
from runledger.plans.jobs import apply_transitions, jobs_from_requests
from runledger.schemas import TABLES
from runledger.session import shared_dir, spread, stored
from runledger.sources.datasets import load_dataset
from runledger.sources.objects import list_objects, sync_plan as missing_objects, transfer_plan
from runledger.sources.requests import read_requests, sound_envelope, unwrap_request
from runledger.plans.layers import folded_settings, read_layers
from runledger.sources.store import append, change_table, create_tables, drop_tables, list_tables, sql as run_sql, write_folder
from workload.registry import query, table


@query("""
SELECT user_id, event_id, id, CAST(regexp_extract(id, '^iteration_([0-9]+)_', 1) AS INTEGER) AS iteration,
       CASE WHEN id LIKE '%\\_epoch\\_%' ESCAPE '\\' AND event_type NOT IN ('error', 'view') THEN CAST(floor(value) AS INTEGER) END AS epoch
FROM (SELECT *, 'iteration_' || user_id || '_' || CASE event_type WHEN 'view' THEN 'step' ELSE 'epoch' END || '_' ||
             CASE event_type WHEN 'error' THEN '' ELSE CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) END AS id FROM events)""")
def model_ids(spark, sf):
    """Model ids made and taken apart again; errors have no epoch and views another third part."""
    epoch = F.when(F.col("event_type") != "error", F.floor("value").cast("int"))
    made = model_id(F.col("user_id"), epoch)
    broken = F.when(F.col("event_type") == "view", F.replace(made, F.lit("_epoch_"), F.lit("_step_"))).otherwise(made)
    rows = table(spark, sf, "events").select("user_id", "event_id", broken.alias("id"))
    return rows.select("*", model_iteration(F.col("id")).alias("iteration"), model_epoch(F.col("id")).alias("epoch"))


@query("""
SELECT p_name || ' ' || p_type AS name, p_brand AS region FROM part
WHERE NOT (lower(p_name) LIKE '%ring%' AND p_brand = 'Brand#2') AND p_size > 5
ORDER BY p_retailprice, p_partkey LIMIT 1""")
def cheapest_part(spark, sf):
    """Parts as a machine catalog: some are ARM types by name, small ones have no capacity."""
    return cheapest(_catalog(spark, sf), "position").select("name", "region")


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_type")
    arm = F.contains(F.lower("p_name"), F.lit("ring")) & (F.col("p_brand") == "Brand#2")
    regions = F.when(F.col("p_size") > 5, F.array(F.struct(F.col("p_brand").alias("name")))).otherwise(
        F.array().cast("array<struct<name:string>>")
    )
    return table(spark, sf, "part").select(
        F.when(arm, F.concat(name, F.lit(" GH200"))).otherwise(name).alias("name"),
        regions.alias("regions"),
        F.col("p_retailprice").alias("price_cents"),
        F.col("p_size").alias("gpus"),
        F.col("p_partkey").alias("position"),
    )


@query("""
SELECT p_partkey AS position, p_brand AS region, 'x86' AS arch FROM part
WHERE NOT (lower(p_name) LIKE '%ring%' AND p_brand = 'Brand#2') AND p_size = 8""")
def eligible_parts(spark, sf):
    found = eligible_instances(_catalog(spark, sf), gpus=8)
    return found.select("position", F.get("regions", 0)["name"].alias("region"), gpu_arch(F.col("name")).alias("arch"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_keys(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return semi(table(spark, sf, "customer"), keys, ["c_custkey"]).select("c_custkey", "c_name")


@query("""
SELECT s.s_suppkey, n.n_nationkey FROM supplier s
JOIN nation n ON s.s_acctbal >= 0 AND n.n_name IN ('NATION_' || s.s_nationkey, 'NATION_' || ((s.s_nationkey + 1) % 25))""")
def member_join(spark, sf):
    """Nations a supplier lists by name; one in debt lists none."""
    own, other = F.col("s_nationkey"), (F.col("s_nationkey") + 1) % 25
    names = F.array(F.concat(F.lit("NATION_"), own), F.concat(F.lit("NATION_"), other))
    owners = table(spark, sf, "supplier").withColumn("names", F.when(F.col("s_acctbal") >= 0, names))
    return attached(owners, "s_suppkey", "names", table(spark, sf, "nation"), "n_name").select("s_suppkey", "n_nationkey")


@query("""
SELECT * FROM (SELECT p_partkey, p_name, p_brand, 'id' AS found_by FROM part WHERE p_partkey = 100)
UNION ALL
SELECT * FROM (SELECT p_partkey, p_name, p_brand, 'name' AS found_by FROM part WHERE p_brand = 'Brand#7' ORDER BY p_partkey LIMIT 1)""")
def lookups(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    by_id = lookup(parts, 100, id_col="p_partkey", name_col="p_brand").withColumn("found_by", F.lit("id"))
    by_name = lookup(parts, "Brand#7", by_name=True, id_col="p_partkey", name_col="p_brand")
    return by_id.unionByName(by_name.withColumn("found_by", F.lit("name")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def where_eq(spark, sf):
    rows = equal_rows(table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT")
    return rows.select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1")
def get_one(spark, sf):
    return first_match(table(spark, sf, "orders"), ["o_orderkey"], o_orderstatus="P").select("o_orderkey", "o_custkey")


@query("""
SELECT 'customer' AS entity, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def entity_counts(spark, sf):
    return counts_of(**{name: table(spark, sf, name) for name in ("customer", "orders", "lineitem")})


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS job_uuid, c_mktsegment AS status, CAST(o_orderkey AS VARCHAR) AS iteration_uuid,
       CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS epoch_number,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_suppkey AS VARCHAR) END AS model_id, count(*) AS n
FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5""")
def job_tree(spark, sf):
    """Customers, their orders and the lines of those, as jobs, steps, epochs and, where returned, results."""
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uuid"), F.col("c_mktsegment").alias("status"))
    steps = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("uuid"), F.col("o_custkey").cast("string").alias("training_job_uuid"),
        F.col("o_orderstatus").alias("step_type"), F.lit(1).alias("iteration_number"),
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("iteration_uuid"), F.col("l_linenumber").alias("epoch_number"),
        F.col("l_partkey").cast("string").alias("uuid"), F.col("l_suppkey").cast("string").alias("model_id"), F.lit("eval").alias("dataset"),
        "l_returnflag",
    )
    joined = tree(jobs, steps, lines.where("l_returnflag <> 'R'"), lines.where("l_returnflag = 'R'"))
    return joined.groupBy("job_uuid", "status", "iteration_uuid", "epoch_number", "model_id").agg(F.count(F.lit(1)).alias("n"))


_CHANGES_SQL = """changes AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice FROM (
    SELECT CASE WHEN l_tax = 0 THEN -l_orderkey ELSE l_orderkey END AS o_orderkey, l_returnflag AS o_orderstatus, l_extendedprice AS o_totalprice,
           row_number() OVER (PARTITION BY CASE WHEN l_tax = 0 THEN -l_orderkey ELSE l_orderkey END ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC) AS rn
    FROM lineitem) WHERE rn = 1)"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of orders: their lines, in the order shipped; untaxed ones change orders that are not there."""
    key = F.when(F.col("l_tax") == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    return table(spark, sf, "lineitem").select(
        key.alias("o_orderkey"), F.col("l_returnflag").alias("o_orderstatus"),
        F.col("l_extendedprice").alias("o_totalprice"), F.struct("l_shipdate", "l_extendedprice", "l_partkey").alias("seq"),
    )


@query(f"""WITH {_CHANGES_SQL}
SELECT o.o_orderkey, coalesce(c.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
       coalesce(c.o_totalprice, o.o_totalprice) AS o_totalprice
FROM orders o LEFT JOIN changes c ON c.o_orderkey = o.o_orderkey""")
def update_latest(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return update_rows(orders, _changes(spark, sf), ["o_orderkey"], "seq")


@query(f"""WITH {_CHANGES_SQL}
SELECT o_orderkey, o_orderstatus, o_totalprice FROM changes
UNION ALL
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)""")
def upsert_latest(spark, sf):
    """Changes into the orders: some replace a row, some are new."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return upsert(orders, _changes(spark, sf), ["o_orderkey"], "seq")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_keys(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return delete_rows(table(spark, sf, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS note FROM customer")
def schema_change(spark, sf):
    return migrate(table(spark, sf, "customer"), {"score": "double", "note": "string"}, ["c_acctbal", "c_nationkey", "c_mktsegment"])


@query("""
SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders
WHERE o_totalprice > 100000 GROUP BY 1""")
def sql_with_parameters(spark, sf):
    text = """SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM {orders}
              WHERE o_totalprice > :least GROUP BY 1"""
    return run_sql(spark, text, {"least": 100000}, orders=table(spark, sf, "orders"))


@query("SELECT count(*) AS appended, count(*) AS kept FROM supplier")
def appended_rows(spark, sf):
    """Rows written, as counted while writing, and as found when read back."""
    root = shared_dir(spark, "supplier")
    written = write_folder(table(spark, sf, "supplier"), root, partition_by=["s_nationkey"])
    kept = spark.read.parquet(root).agg(F.count(F.lit(1)).alias("kept"))
    return kept.select(F.lit(written).cast("long").alias("appended"), "kept")


@query("""
SELECT c_custkey, '{"priority":' || CAST(c_nationkey AS VARCHAR) || CASE WHEN n IS NULL THEN '' ELSE ',"orders":' || n END || '}' AS metadata
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def metadata_merge(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.to_json(F.struct(F.col("c_nationkey").alias("priority"))).alias("metadata")
    )
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return merge_metadata(customers, orders, ["c_custkey"], "orders", F.col("n").cast("string"), "metadata")


_TRANSITIONS_SQL = """
WITH t AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) * 10000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq,
                  CASE l_linenumber WHEN 1 THEN 'running' WHEN 2 THEN 'running' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'failed'
                       WHEN 5 THEN 'cancelled' WHEN 6 THEN 'completed' ELSE 'cancelled' END AS status, l_shipdate AS done,
                  l_partkey FROM lineitem),
b AS (SELECT *, lag(status) OVER (PARTITION BY k ORDER BY seq) AS prev FROM t),
e AS (SELECT * FROM b WHERE NOT (status = 'cancelled' AND coalesce(prev, 'pending') IN ('completed', 'failed', 'cancelled'))),
a AS (SELECT k, max_by(status, seq) AS status, max_by(done, seq) FILTER (WHERE status = 'running') AS started,
             max_by(done, seq) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS completed,
             max_by(l_partkey, seq) FILTER (WHERE status = 'failed') AS part FROM e GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS uuid, coalesce(a.status, 'pending') AS status,
       strftime(started, '%Y-%m-%d') AS started_at, strftime(completed, '%Y-%m-%d') AS completed_at,
       CASE WHEN completed IS NOT NULL THEN (epoch_us(completed) - epoch_us(o_orderdate)) / 6e7 END AS time_taken,
       CASE WHEN part IS NOT NULL THEN '{"error":"part ' || part || '"}' END AS job_metadata
FROM orders LEFT JOIN a ON a.k = o_orderkey"""


@query(_TRANSITIONS_SQL)
def transitions(spark, sf):
    """Orders as jobs whose lines start, cancel, fail and complete them."""
    status = """CASE l_linenumber WHEN 1 THEN 'running' WHEN 2 THEN 'running' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'failed'
                WHEN 5 THEN 'cancelled' WHEN 6 THEN 'completed' ELSE 'cancelled' END"""
    rows = table(spark, sf, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS uuid",
        "CAST(l_linenumber AS BIGINT) * 10000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq",
        f"{status} AS status", "CAST(l_shipdate AS TIMESTAMP_NTZ) AS at", "concat('part ', l_partkey) AS error",
    )
    jobs = table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS uuid", "'pending' AS status", "CAST(o_orderdate AS TIMESTAMP_NTZ) AS created_at",
        "CAST(NULL AS TIMESTAMP_NTZ) AS started_at", "CAST(NULL AS TIMESTAMP_NTZ) AS completed_at",
        "CAST(NULL AS DOUBLE) AS time_taken", "CAST(NULL AS STRING) AS job_metadata",
    )
    dates = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("started_at", "completed_at")]
    return apply_transitions(jobs, rows).select("uuid", "status", *dates, "time_taken", "job_metadata")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Request documents from orders: urgent ones have no project, others lack a dataset or its images."""
    text = """to_json(named_struct('success', o_orderstatus <> 'O', 'data', named_struct('request_data', named_struct(
        'training_run_id', CAST(o_orderkey AS STRING),
        'project', CASE WHEN o_orderpriority <> '1-URGENT' THEN named_struct('id', CAST(o_custkey AS STRING),
            'name', concat('p', o_custkey), 'task_type', CASE o_orderpriority WHEN '2-HIGH' THEN 'image_classification'
            WHEN '3-MEDIUM' THEN 'entity_extraction' WHEN '5-LOW' THEN 'unheard_of' END) END,
        'prompt', named_struct('id', CAST(o_custkey AS STRING), 'content', concat('classify ', o_orderkey)),
        'train_dataset', CASE WHEN o_totalprice > 50000 THEN named_struct('id', CAST(o_orderkey AS STRING),
            'file_name', concat('projects/', o_custkey, '/train/', o_orderkey, '.csv'), 'input_col', 'text',
            'output_cols', array('label'), 'image_root', CASE WHEN o_orderpriority = '2-HIGH' THEN concat('img/', o_custkey) END) END,
        'eval_dataset', named_struct('id', CAST(o_orderkey AS STRING), 'file_name', concat('e', o_orderkey, '.csv'))))))"""
    rows = spread(table(spark, sf, "orders")).selectExpr("o_orderkey", f"{text} AS text")
    return rows.select("o_orderkey", F.try_parse_json("text").alias("document"))


def _valid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    requests = _requests(spark, sf)
    return validate_requests(requests.select("*", unwrap_request(F.col("document")).alias("request")))


_VALID = "o_orderpriority <> '1-URGENT' AND o_totalprice > 50000"


@query("""
SELECT o_orderkey, o_orderstatus <> 'O' AS sound,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'Invalid data: ''project'' key is missing or empty'
            WHEN o_totalprice <= 50000 THEN 'Invalid data: ''train_dataset'' key is missing or empty' END AS reason
FROM orders""")
def request_validation(spark, sf):
    good, bad = _valid(spark, sf)
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return both.select("o_orderkey", sound_envelope(F.col("document")).alias("sound"), "reason")


_CONFIG_COLUMNS = (
    "project_name", "project_id", "task_type", "training_run_id", "config_s3_path", "system_prompt", "think_flag",
    "train_s3_path", "train_file_name", "train_file_path", "train_input_col", "train_output_cols", "train_image_root",
    "train_image_root_s3_path", "train_image_root_path", "eval_file_path", "eval_image_root", *SETTINGS,
)


def _setting_sql(name: str) -> str:
    number = str(DEFAULTS.get(name, SETTINGS[name])).isdigit()

    def literal(value: str) -> str:
        return value if number else f"'{value}'"

    base = DEFAULTS.get(name, SETTINGS[name])
    cases = " ".join(f"WHEN task_type = '{t}' THEN {literal(m[name])}" for t, m in TASKS.items() if name in m)
    return f"CASE {cases} ELSE {literal(base)} END AS {name}" if cases else f"{literal(base)} AS {name}"


@query(f"""
WITH r AS (SELECT *, CASE o_orderpriority WHEN '2-HIGH' THEN 'image_classification' WHEN '3-MEDIUM' THEN 'entity_extraction'
                     WHEN '5-LOW' THEN 'unheard_of' ELSE 'text_classification' END AS task_type
           FROM orders WHERE {_VALID})
SELECT o_orderkey, 'p' || o_custkey AS project_name, CAST(o_custkey AS VARCHAR) AS project_id, task_type,
       CAST(o_orderkey AS VARCHAR) AS training_run_id,
       'media/projects/' || o_custkey || '/' || o_orderkey || '/config.yaml' AS config_s3_path,
       'classify ' || o_orderkey AS system_prompt, true AS think_flag,
       'media/projects/' || o_custkey || '/train/' || o_orderkey || '.csv' AS train_s3_path, o_orderkey || '.csv' AS train_file_name,
       'data/' || o_orderkey || '.csv' AS train_file_path, 'text' AS train_input_col, '["label"]' AS train_output_cols,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 'img/' || o_custkey ELSE '' END AS train_image_root,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 'media/img/' || o_custkey END AS train_image_root_s3_path,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 'data/train_images' END AS train_image_root_path,
       'data/e' || o_orderkey || '.csv' AS eval_file_path, '' AS eval_image_root,
       {", ".join(_setting_sql(name) for name in SETTINGS)}
FROM r""")
def derived_configs(spark, sf):
    return derive_config(_valid(spark, sf)[0], ["o_orderkey"]).select("o_orderkey", *_CONFIG_COLUMNS)


@query(f"""
WITH r AS (SELECT * FROM orders WHERE {_VALID})
SELECT o_orderkey, 'train dataset' AS kind, 'media/projects/' || o_custkey || '/train/' || o_orderkey || '.csv' AS source,
       'data/' || o_orderkey || '.csv' AS target, false AS recursive FROM r
UNION ALL SELECT o_orderkey, 'eval dataset', 'media/e' || o_orderkey || '.csv', 'data/e' || o_orderkey || '.csv', false FROM r
UNION ALL SELECT o_orderkey, 'config', 'media/projects/' || o_custkey || '/' || o_orderkey || '/config.yaml',
                 'projects_yaml/config.yaml', false FROM r
UNION ALL SELECT o_orderkey, 'training images', 'media/img/' || o_custkey, 'data/train_images', true FROM r
          WHERE o_orderpriority = '2-HIGH'""")
def transfers(spark, sf):
    return transfer_plan(derive_config(_valid(spark, sf)[0], ["o_orderkey"]), "o_orderkey")


@query("""
SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS uuid, '2024-01-01 00:00:00' AS created_at,
       CAST(o_orderkey AS VARCHAR) AS request_run, CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_custkey AS VARCHAR) END AS project_id,
       CAST(o_orderkey AS VARCHAR) AS training_run_id, 'pending' AS status FROM orders""")
def pending_jobs(spark, sf):
    now = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    jobs = jobs_from_requests(_requests(spark, sf), now, F.col("o_orderkey").cast("string"))
    run = F.get_json_object("training_request", "$.data.request_data.training_run_id").alias("request_run")
    return jobs.select("uuid", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), run, "project_id", "training_run_id", "status")


@query("""
SELECT page_id, basename AS file, 'media/projects/' || page_id || '/' || basename || '/config.yaml' AS config
FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS basename FROM pages)""")
def derived_paths(spark, sf):
    file = basename(F.col("url"))
    return table(spark, sf, "pages").select(
        "page_id", file.alias("file"), config_path(F.col("page_id").cast("string"), file).alias("config")
    )


@query("""
WITH src AS (SELECT url AS name, length(html) AS size FROM pages),
dst AS (SELECT url AS name, CASE WHEN url LIKE '%.html' THEN 0 ELSE length(html) END AS size FROM pages WHERE url LIKE 'https%')
SELECT name, CAST(size AS INTEGER) AS size FROM src WHERE NOT regexp_matches(name, '#top$')
  AND (name, size) NOT IN (SELECT name, size FROM dst)""")
def sync_plan(spark, sf):
    """Pages missing from a copy that has the https ones only, with some of another size."""
    source = table(spark, sf, "pages").select(F.col("url").alias("name"), F.length("html").alias("size"))
    size = F.when(F.endswith("name", F.lit(".html")), 0).otherwise(F.col("size"))
    target = source.where(F.startswith("name", F.lit("https"))).select("name", size.alias("size"))
    return missing_objects(source, target, "#top$")


@query("""
SELECT user_id, round(count(*) FILTER (WHERE event_type = 'purchase') * 100.0
                      / nullif(count(*) FILTER (WHERE event_type = 'signup'), 0), 6) AS percent
FROM events GROUP BY 1""")
def percent_done(spark, sf):
    counted = table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "signup").alias("all")
    )
    return counted.select("user_id", F.round(percent(F.col("done"), F.col("all")), 6).alias("percent"))


@query("SELECT text AS input, lang AS label, source AS think FROM documents")
def labelled_dataset(spark, sf):
    """Documents written as CSV, line breaks and quotes included, and loaded by column mapping."""
    root = shared_dir(spark, "dataset")
    documents = table(spark, sf, "documents").select("text", "lang", "source")
    documents.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
    rows = load_dataset(spark, root, "text", ["lang"], "source")
    return rows.select("input", F.col("outputs.lang").alias("label"), "think")


@query("""
SELECT c_mktsegment AS task_type, c_mktsegment || '_' || c_custkey AS name, 'p' || c_custkey AS project FROM customer""")
def written_configs(spark, sf):
    """Configurations written one document each, by task type, and read back."""
    text = """to_json(named_struct('project', named_struct('name', concat('p', c_custkey), 'task_type', c_mktsegment),
        'prompt', named_struct('id', '1'), 'train_dataset', named_struct('id', '1'), 'eval_dataset', named_struct('id', '1')))"""
    customers = spread(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    requests = customers.selectExpr("CAST(c_custkey AS STRING) AS stem", f"parse_json({text}) AS request")
    root = shared_dir(spark, "configs")
    write_configs(derive_config(validate_requests(requests)[0], ["stem"]), "stem", root)
    written = spark.read.schema("name string, config string, task_type string").json(root)
    return written.select("task_type", "name", F.get_json_object("config", "$.project_name").alias("project"))


@query("""
WITH said AS (
  SELECT c_custkey AS customer, place, unnest(['reward', 'model', 'note', 'own_' || place]) AS setting,
         unnest(CASE place WHEN 0 THEN ['0.5', 'base', NULL, 'default'] WHEN 1 THEN [NULL, c_mktsegment, 'text', c_mktsegment]
                           WHEN 2 THEN ['{"n":' || c_nationkey || '}', NULL, 'x', 'n' || c_nationkey]
                           ELSE [NULL, 'c' || c_custkey, NULL, 'c' || c_custkey] END) AS value,
         unnest(CASE place WHEN 0 THEN [true, true, true, true] WHEN 1 THEN [false, true, true, true]
                           WHEN 2 THEN [true, false, c_nationkey % 2 = 0, true] ELSE [false, c_custkey % 3 = 0, c_custkey % 5 = 0, true] END) AS there
  FROM customer, range(4) t(place) WHERE place < 3 OR c_custkey % 2 = 0)
SELECT customer, setting, value, ['0_default', '1_segment', '2_nation', '3_customer'][place + 1] AS origin
FROM (SELECT *, row_number() OVER (PARTITION BY customer, setting ORDER BY place DESC) AS n FROM said WHERE there) WHERE n = 1""")
def layered_settings(spark, sf):
    """Settings of customers from four layers of documents: default, segment, nation, and their own, which half of them have."""
    customers, root = table(spark, sf, "customer"), shared_dir(spark, "layers")
    nation = customers.select("c_nationkey").distinct()
    layers = {
        "0_default": customers.limit(1).selectExpr("'default' AS name", """'{"reward":0.5,"model":"base","note":null,"own_0":"default"}' AS value"""),
        "1_segment": customers.select("c_mktsegment").distinct().selectExpr(
            "c_mktsegment AS name", "to_json(map('model', c_mktsegment, 'note', 'text', 'own_1', c_mktsegment)) AS value"),
        "2_nation": nation.selectExpr(
            "CAST(c_nationkey AS STRING) AS name",
            """concat('{"reward":{"n":', c_nationkey, '},', CASE WHEN c_nationkey % 2 = 0 THEN '"note":"x",' ELSE '' END, '"own_2":"n', c_nationkey, '"}') AS value"""),
        "3_customer": customers.where("c_custkey % 2 = 0").selectExpr(
            "CAST(c_custkey AS STRING) AS name",
            """concat('{', CASE WHEN c_custkey % 3 = 0 THEN concat('"model":"c', c_custkey, '",') ELSE '' END,
               CASE WHEN c_custkey % 5 = 0 THEN '"note":null,' ELSE '' END, '"own_3":"c', c_custkey, '"}') AS value"""),
    }
    for layer, documents in layers.items():
        _write_documents(documents, f"{root}/{layer}")
    names = {"0_default": F.lit("default"), "1_segment": F.col("c_mktsegment"), "2_nation": F.col("c_nationkey"), "3_customer": F.col("c_custkey")}
    return folded_settings(customers, "c_custkey", names, read_layers(spark, root)).withColumnRenamed("c_custkey", "customer")


def _write_documents(documents: DataFrame, folder: str) -> None:
    """A file for each row, by the task that has it."""

    def write(rows):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        for row in rows:
            with system.open_output_stream(f"{path}/{row.name}.json") as out:
                out.write(row.value.encode())

    spread(documents).foreachPartition(write)


@query("""
SELECT c_mktsegment || '-' || c_nationkey AS run, c_mktsegment || ' ' || count(*) AS name
FROM customer GROUP BY c_mktsegment, c_nationkey HAVING min(c_acctbal) < 0""")
def request_files(spark, sf):
    """A request per segment and nation, each a file, read back as whole documents."""
    root = shared_dir(spark, "requests")
    text = """to_json(named_struct('success', least < 0, 'data', named_struct('request_data', named_struct(
        'training_run_id', concat_ws('-', c_mktsegment, c_nationkey),
        'project', named_struct('name', concat_ws(' ', c_mktsegment, n))))))"""
    groups = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.min("c_acctbal").alias("least"), F.count(F.lit(1)).alias("n")
    )
    rows = groups.selectExpr("c_mktsegment", "c_nationkey", f"{text} AS value")
    rows.write.partitionBy("c_mktsegment", "c_nationkey").text(root)
    request = unwrap_request(F.col("document"))
    return read_requests(spark, f"{root}/*/*").select(
        F.try_variant_get(request, "$.training_run_id", "string").alias("run"),
        F.try_variant_get(request, "$.project.name", "string").alias("name"),
    )


def _landed(customers: DataFrame, name: str) -> DataFrame:
    """Customers written as text, a folder for each segment and a file for each nation in it, and listed."""
    root = shared_dir(customers.sparkSession, name)
    folder = F.concat("c_mktsegment", F.lit(" + 100%")).alias("segment")
    text = F.concat(F.lit("{"), "c_custkey", F.lit("}")).alias("value")
    customers.select(folder, F.col("c_nationkey").alias("nation"), text).write.partitionBy("segment", "nation").text(root)
    listed = list_objects(customers.sparkSession, root)
    # A nation's customers may be in several files, of names that Spark makes up.
    return listed.groupBy(F.regexp_extract("name", "^(.*)/[^/]*$", 1).alias("name")).agg(F.sum("size").alias("size"))


_LANDED_SQL = """SELECT 'segment=' || c_mktsegment || ' + 100%25/nation=' || c_nationkey AS name,
                        sum(length(CAST(c_custkey AS VARCHAR)) + 3)::BIGINT AS size FROM customer"""


@query(f"{_LANDED_SQL} GROUP BY 1")
def listed_objects(spark, sf):
    """Files with blanks, plus and percent signs in their names, by folder."""
    return _landed(table(spark, sf, "customer"), "objects")


@query(f"""{_LANDED_SQL} GROUP BY 1 EXCEPT {_LANDED_SQL} WHERE c_acctbal >= 0 OR c_nationkey < 5 GROUP BY 1""")
def synced_objects(spark, sf):
    """What a copy lacks that has the customers of some nations and those in credit only."""
    customers = table(spark, sf, "customer")
    copied = customers.where("c_acctbal >= 0 OR c_nationkey < 5")
    return missing_objects(_landed(customers, "objects"), _landed(copied, "copied"))


@query("""
SELECT p_partkey AS position, CASE WHEN lower(p_name) LIKE '%ring%' AND p_brand = 'Brand#2' THEN 'ARM' ELSE 'x86' END AS arch
FROM part""")
def part_architectures(spark, sf):
    return _catalog(spark, sf).select("position", gpu_arch(F.col("name")).alias("arch"))


@query("""
SELECT place, o_orderkey, o_totalprice FROM (
  SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS place,
         row_number() OVER (ORDER BY o_orderkey DESC) AS back FROM orders) WHERE place <= 5 OR back = 1""")
def head_and_cell(spark, sf):
    """The first five orders and the last one, with their places."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    head = orders.orderBy("o_orderkey").limit(5).withColumn("place", F.row_number().over(Window.orderBy("o_orderkey")).cast("long"))
    last = orders.orderBy(F.desc("o_orderkey")).limit(1).crossJoin(F.broadcast(orders.agg(F.count(F.lit(1)).alias("place"))))
    return head.unionByName(last).distinct()


def _stored_orders(spark: SparkSession, sf: str) -> str:
    """Orders as a table of the catalog, partitioned by priority."""
    name = f"orders_{uuid.uuid4().hex}"
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    orders.write.format("parquet").partitionBy("o_orderpriority").saveAsTable(name)
    return name


def _read_and_drop(spark: SparkSession, name: str) -> DataFrame:
    rows = stored(spark.table(name), "read")
    spark.sql(f"DROP TABLE {name}")
    return rows


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' AND o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice, o_orderpriority FROM orders""")
def stored_update(spark, sf):
    """Rows of one partition updated in place."""
    name = _stored_orders(spark, sf)
    dear = table(spark, sf, "orders").where("o_orderpriority = '2-HIGH' AND o_totalprice > 200000")
    changes = stored(dear.select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(1).alias("seq")), "changes")
    change_table(spark, name, "o_orderpriority", changes, ["o_orderkey"], lambda rows: update_rows(rows, changes, ["o_orderkey"], "seq"))
    return _read_and_drop(spark, name)


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN '9-LAST' ELSE o_orderpriority END AS o_orderpriority
FROM orders UNION ALL SELECT -o_orderkey - 1, 'N', o_totalprice, '0-NEW' FROM orders WHERE o_orderstatus = 'F'""")
def stored_upsert(spark, sf):
    """Rows moved to a new partition, and others added in one more."""
    name, orders = _stored_orders(spark, sf), table(spark, sf, "orders")
    moved = orders.where("o_orderstatus = 'P'").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "'9-LAST' AS o_orderpriority", "1 AS seq")
    new = orders.where("o_orderstatus = 'F'").selectExpr("-o_orderkey - 1 AS o_orderkey", "'N' AS o_orderstatus", "o_totalprice", "'0-NEW' AS o_orderpriority", "1 AS seq")
    changes = stored(moved.union(new), "changes")
    change_table(spark, name, "o_orderpriority", changes, ["o_orderkey"], lambda rows: upsert(rows, changes, ["o_orderkey"], "seq"))
    return _read_and_drop(spark, name)


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
          WHERE o_orderpriority <> '1-URGENT' AND NOT (o_orderpriority = '5-LOW' AND o_totalprice < 100000)""")
def stored_delete(spark, sf):
    """Rows deleted, among them all of a partition."""
    name = _stored_orders(spark, sf)
    gone = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' OR o_orderpriority = '5-LOW' AND o_totalprice < 100000")
    keys = stored(gone.select("o_orderkey"), "keys")
    change_table(spark, name, "o_orderpriority", keys, ["o_orderkey"], lambda rows: delete_rows(rows, keys, ["o_orderkey"]))
    return _read_and_drop(spark, name)


@query("SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS uuid, 'pending' AS status, (SELECT count(*) FROM orders) AS appended, 4 AS tables FROM orders")
def entity_tables(spark, sf):
    """The entity tables created in a database of their own, jobs appended, read back and dropped."""
    database = f"runs_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    tables = len(create_tables(spark, database))
    now = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    jobs = jobs_from_requests(_requests(spark, sf), now, F.col("o_orderkey").cast("string"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["training_job"] if f.name not in jobs.columns]
    appended = append(jobs.select("*", *empty), f"{database}.training_job")
    rows = stored(spark.table(f"{database}.training_job").select("uuid", "status"), "read")
    drop_tables(spark, database)
    left = list_tables(spark, database)
    spark.sql(f"DROP DATABASE {database}")
    return rows.select("uuid", "status", F.lit(appended).cast("long").alias("appended"), F.lit(tables - len(left)).alias("tables"))
