"""Queries of the loading steps: evolving files, stamped partitions, packed metrics,
monthly appends, full replaces, forecast and completeness checks, control texts.

Every function takes ``(spark, sf_dir)``; ``ORACLE`` has the DuckDB SQL of each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import dates as D
from furrow.functions import text as TX
from furrow.operators import merge, quality
from furrow.session import scratch_path
from furrow.sinks import align, evolving, partitioned, upsert
from furrow.sources import files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def evolving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 2.9: loads with other metrics and types in one folder, read as one table;
    a load that is replayed counts once."""
    ev, path = _table(spark, sf_dir, "events"), scratch_path(spark, "evolving")
    whole = F.floor("value").cast("int")
    loads = {"a": ev.where("event_id % 4 = 0").select("event_id", F.to_date("ts").alias("at"), whole.alias("v")),
             "b": ev.where("event_id % 4 = 1").select("event_id", F.col("value").alias("v"), F.col("event_type").alias("label")),
             "c": ev.where("event_id % 4 = 2").select("event_id", F.col("ts").alias("at"), F.lit(None).alias("label"), (whole.cast("long") * 2).alias("V")),
             "d": ev.where("event_id % 4 = 3").select("event_id", F.col("user_id").alias("n"))}
    for name in "abcbd":
        evolving.append_evolving(loads[name], path, name)
    return evolving.read_evolving(spark, path)


def stamped_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1.4: landed partitions read strictly and stamped with their source; an
    extraction date that is there stays."""
    o, path = _table(spark, sf_dir, "orders"), scratch_path(spark, "landed")
    landed = o.select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 2 == 0, F.to_date("o_orderdate")).alias("extraction_date"))
    partitioned.write_partitioned(landed, path, "o_orderdate", ("year",), ["o_orderkey"], dynamic=False)
    return files.stamp_source(files.read_partition(spark, path, strict=True), "openmeteo", "2024-01-01").drop("o_orderdate")


def metrics_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 2.3: metric columns packed to JSON without nulls and upserted on the key."""
    o = _table(spark, sf_dir, "orders")
    current = o.where("o_orderstatus <> 'O'").select("o_orderkey", F.lit("2024-01-01").cast("date").alias("extraction_date"),
                                                     F.to_json(F.struct(F.col("o_custkey").alias("t"))).alias("metrics"))
    incoming = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.lit("2024-01-02").cast("date").alias("extraction_date"), (F.col("o_custkey") + 1).alias("t"),
                                                      F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("p"))
    return upsert.pack_metrics_upsert(current, incoming, ["o_orderkey"], ["t", "p"])


def monthly_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 2.8, 2.11, 9.7: hourly facts coerced to the wide layout, written by yyyymm
    and appended to."""
    ev, path = _table(spark, sf_dir, "events"), scratch_path(spark, "hourly")
    reading = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.floor("value").cast("string"))
    raw = ev.select("event_id", F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))).alias("date"), reading.alias("temperature_2m_mean"))
    cols = ["date_mesure", "city_name", "latitude", "longitude", "temperature_2m_mean", "precipitation_sum"]
    facts = raw.withColumn("date", D.drop_zone("date"))
    for k, write in ((0, lambda df: partitioned.write_partitioned(df, path, "date_mesure", ("yyyymm",), dynamic=False)),
                     (1, lambda df: partitioned.append(partitioned.with_date_parts(df, "date_mesure", ("yyyymm",)), path, ("yyyymm",)))):
        write(align.prepare_wide_append(facts.where(F.col("event_id") % 2 == k), "Sousse", 35.5, 10.5, columns=cols))
    return spark.read.parquet(path)


def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 2.10: a catalog table replaced whole, with other columns than before."""
    o, name = _table(spark, sf_dir, "orders"), f"furrow_replaced_{uuid.uuid4().hex[:12]}"
    partitioned.replace_table(o.select("o_orderkey"), name)
    partitioned.replace_table(o.select("o_orderkey", "o_custkey", "o_orderstatus"), name)
    return spark.table(name)


def forecast_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.20: the checks that a forecast passes before it is loaded, with its counts."""
    o = _table(spark, sf_dir, "orders")
    fc = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("total"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("pending"))
    return quality.validate_forecast(fc, ["date", "total"], ["total", "pending"])


def forecast_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 9.8, 9.9: how many runs ask for each day, and from where it is served."""
    runs = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("run"))
    days = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).select("run", "n", F.explode(D.forecast_days("run")).alias("day"))
    return days.groupBy("day", D.source_for_window("day", D.history_target("run", -3)).alias("served")).agg(F.sum("n").alias("n_runs"))





def parameter_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.19, 8.2: expected parameters that a key has no row of."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"))
    return quality.missing_parameters(li, ["l_orderkey"], "flag", ["A", "N", "R", "X"])


def completeness_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.19: rows, days and parameters of a key against what is expected."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    return quality.completeness_report(li, ["l_orderkey"], "l_shipdate", 4, param_col="l_returnflag")


def control_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 9.29: the control prefix of a message and what follows it."""
    c = _table(spark, sf_dir, "conversations")
    head = F.when(F.col("turn") % 3 == 0, F.lit(f"  {TX.FINAL_PREFIX.lower()}  ")).when(F.col("turn") % 3 == 1, F.lit(TX.CONTINUE_PREFIX)).otherwise(F.lit(""))
    said = c.select("conv_id", "turn", F.concat(head, F.coalesce("text", F.lit(""))).alias("t"))
    return said.select("conv_id", "turn", TX.control_kind("t").alias("kind"), TX.control_body("t").alias("body"))


def source_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.18, 5.9: three sources in one shuffle; what the first lacks on a day
    comes from the next."""
    o, li, ev = (_table(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    day = lambda df, c, ext, *aggs: df.groupBy(F.to_date(c).alias("date")).agg(*aggs, F.lit(ext).cast("date").alias("extraction_date"))
    first = day(o, "o_orderdate", "2024-01-01", F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n"), F.count(F.lit(1)).alias("orders")) \
        .withColumn("n", F.nullif("n", F.lit(0)))
    second = day(li, "l_shipdate", "2024-01-03", F.count(F.lit(1)).alias("n"))
    third = day(ev, "ts", "2024-01-02", F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return merge.source_priority_merge([("o", first), ("li", second), ("ev", third)], mode="coalesce")


REGISTRY = {f.__name__: f for f in (evolving_files, stamped_partitions, metrics_upsert, monthly_append, replaced_table, forecast_checks, forecast_horizon,
                                    parameter_gaps, completeness_rows, control_texts, source_fill)}

_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"
ORACLE = {
    "evolving_files": """
select event_id,
       case event_id % 4 when 0 then date_trunc('day', ts)::timestamp when 2 then ts end as at,
       case event_id % 4 when 0 then floor(value) when 1 then value when 2 then floor(value) * 2 end as v,
       case when event_id % 4 = 1 then event_type end as label,
       case when event_id % 4 = 3 then user_id end as n
from events
""",
    "stamped_partitions": """
select o_orderkey, cast(extract(year from o_orderdate) as integer) as year, 'openmeteo' as source,
       case when o_orderkey % 2 = 0 then cast(o_orderdate as date) else date '2024-01-01' end as extraction_date
from orders
""",
    "metrics_upsert": """
select o_orderkey,
       case when o_orderstatus <> 'P' then date '2024-01-02' else date '2024-01-01' end as extraction_date,
       case when o_orderstatus = 'P' then '{"t":' || o_custkey || '}'
            when o_orderkey % 3 = 0 then '{"t":' || (o_custkey + 1) || ',"p":' || o_orderkey || '}'
            else '{"t":' || (o_custkey + 1) || '}' end as metrics
from orders
""",
    "monthly_append": """
with e as (select *, date_trunc('second', ts) - interval 2 hour as d from events)
select d as date_mesure, 'Sousse' as city_name, 35.5::double as latitude, 10.5::double as longitude,
       case when event_type <> 'error' then floor(value) end as temperature_2m_mean, cast(null as double) as precipitation_sum,
       cast(extract(year from d) * 100 + extract(month from d) as integer) as yyyymm
from e
""",
    "replaced_table": "select o_orderkey, o_custkey, o_orderstatus from orders",
    "forecast_checks": """
with d as (select cast(o_orderdate as date), sum(o_totalprice) as total, max(case when o_orderstatus = 'P' then o_totalprice end) as pending from orders group by 1)
select count(*) as n_rows, count(total) as nonnull_total, count(pending) as nonnull_pending, cast(0 as bigint) as all_null_rows from d
""",
    "forecast_horizon": """
with r as (select cast(o_orderdate as date) as run, count(*) as n from orders group by 1),
d as (select n, run, cast(run + to_days(cast(k as integer)) as date) as day from r, range(8) t(k))
select day, case when day <= run + 3 then 'archive' else 'forecast' end as served, cast(sum(n) as bigint) as n_runs from d group by all
""",
    "parameter_gaps": """
select k.l_orderkey, f.flag from (select distinct l_orderkey from lineitem) k, (values ('A'), ('N'), ('R'), ('X')) f(flag)
where not exists (select 1 from lineitem l where l.l_orderkey = k.l_orderkey and l.l_returnflag = f.flag)
""",
    "completeness_rows": """
select l_orderkey, count(*) as n_rows, count(distinct cast(l_shipdate as date)) as n_days, count(distinct l_returnflag) as n_params,
       cast(4 as bigint) as expected_rows, count(*) = 4 as complete
from lineitem group by 1
""",
    "control_texts": f"""
select conv_id, turn, case turn % 3 when 0 then 'final' when 1 then 'continue' end as kind, trim(coalesce(text, ''), {_WS}) as body from conversations
""",
    "source_fill": """
with o as (select cast(o_orderdate as date) as date, nullif(count(*) filter (where o_orderstatus = 'F'), 0) as n, count(*) as orders from orders group by 1),
l as (select cast(l_shipdate as date) as date, count(*) as n from lineitem group by 1),
e as (select cast(ts as date) as date, count(*) as n, count(distinct user_id) as users from events group by 1),
d as (select date from o union select date from l union select date from e)
select d.date, coalesce(o.n, l.n, e.n) as n, o.orders, e.users,
       case when l.date is not null then date '2024-01-03' when e.date is not null then date '2024-01-02' else date '2024-01-01' end as extraction_date
from d left join o on o.date = d.date left join l on l.date = d.date left join e on e.date = d.date
""",
}
