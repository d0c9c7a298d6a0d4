"""Queries of the loading lifecycle: versioned increments, fills over batches, the
location dimension, counts taken during a write, metrics as VARIANT, SQL tools.

Every function takes ``(spark, sf_dir)``; ``ORACLE`` has the DuckDB SQL of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import jsonx as J
from furrow.operators import dimension
from furrow.session import scratch_path
from furrow.streaming import versions


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _landed_orders(spark: SparkSession, sf_dir: str) -> tuple[str, T.StructType]:
    """Order files landed per year; AQE splits a large year over several files."""
    landing = scratch_path(spark, "landing")
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    o.withColumn("y", F.year("o_orderdate")).hint("rebalance", "y").write.partitionBy("y").parquet(landing)
    return landing + "/*", o.schema


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 10.1: order files landed per year, three a batch, merged by customer
    (latest order wins) into a versioned table by bucket of the customer."""
    from furrow.streaming.incremental import key_bucket

    landing, schema = _landed_orders(spark, sf_dir)
    path = scratch_path(spark, "orders-latest")
    versions.stream_merge(spark, landing, schema, path, ["o_custkey"], ["o_orderdate", "o_orderkey"], "bucket",
                          clean=lambda b: b.withColumn("bucket", key_bucket(["o_custkey"], 16)), max_files_per_trigger=3)
    return versions.read_version(spark, path).drop("bucket")


def stream_daily_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 10.1: the last order of a customer and day, in a versioned table by
    month: a batch of one year's files reads and writes that year's months only."""
    landing, schema = _landed_orders(spark, sf_dir)
    path = scratch_path(spark, "daily-facts")
    versions.stream_merge(spark, landing, schema, path, ["o_custkey", "o_orderdate"], ["o_orderkey"], "month",
                          clean=lambda b: b.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), max_files_per_trigger=3)
    return versions.read_version(spark, path, parts=lambda p: p >= "1997-01").drop("month")


def stream_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 6.5, 10.1: values per user forward-filled batch by batch, the last known
    ones carried in a state table; equal to the fill of all rows."""
    landing, path = scratch_path(spark, "increments"), scratch_path(spark, "filled")
    ev = _table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") <= 100, F.col("value")).alias("v"), F.to_date("ts").alias("day"))
    ev.withColumn("part", F.floor((F.dayofmonth("day") - 1) / 11)).hint("rebalance", "part").write.partitionBy("part").parquet(landing)
    versions.stream_merge(spark, landing + "/*", ev.schema, path, [], [], "day", max_files_per_trigger=1,
                          each=lambda b, n: versions.fill_batch(b.withColumn("block", F.col("user_id") % 16), path, ["user_id"], "event_id", ["v"], "block", number=n))
    return versions.read_version(spark, path + "/facts").select("user_id", "event_id", "v", "v_filled")


def location_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 12.1: customers' places (six decimals) with city names; a first load of
    one segment, a second of all, a third that adds nothing."""
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    places = c.select((F.floor(F.col("c_acctbal") / 100) / 7 + 20).alias("latitude"), (F.col("c_nationkey") / 3).alias("longitude"),
                      F.concat_ws(" ", "n_name", F.floor(F.col("c_acctbal") / 100)).alias("city_name"), "c_mktsegment")
    path = scratch_path(spark, "location")
    for load in (places.where("c_mktsegment = 'BUILDING'"), places, places):
        out = dimension.get_or_create_locations(load, path)
    return out.select("id", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), "city_name")


def write_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 5.8, 5.15: what the daily normaliser repairs and how many values there
    are, counted by the job that writes its result."""
    from furrow.operators.normalize import openmeteo_daily
    from furrow.operators.quality import nonnull_counts, observe

    daily = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("location"), F.to_date("l_shipdate").alias("date")).agg(
        (F.avg("l_discount") * 1000 - 30).alias("temperature_2m_mean"), (F.max("l_tax") * 1000 - 20).alias("temperature_2m_max"),
        (F.min("l_discount") * 1000).alias("temperature_2m_min"), (F.sum("l_quantity") - 100).alias("precipitation_sum"))
    before, after = Observation("before"), Observation("after")
    metrics = ["temperature_2m_mean", "precipitation_sum"]
    out = observe(openmeteo_daily(daily, "2024-01-01", ["location"], counts=before), after, nonnull_counts(metrics))
    out.write.parquet(scratch_path(spark, "normalized"))
    got = {**before.get, **{f"written_{k}": v for k, v in after.get.items()}}
    ints = [k for k in got if not k.startswith(("min_", "max_"))]
    return spark.createDataFrame([tuple(int(got[k]) for k in ints) + (round(got["min_precipitation_sum"], 6), round(got["max_precipitation_sum"], 6))],
                                 ", ".join(f"{k} bigint" for k in ints) + ", min_precipitation_sum double, max_precipitation_sum double")


def metrics_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 2.13, 9.20: metrics of mixed types as VARIANT, written, read back and
    taken out by type, with the schema that each kind of row turns out to have."""
    ev = _table(spark, sf_dir, "events")
    kind, n = F.col("event_id") % 4, F.floor("value").cast("long")
    text = F.when(kind == 0, F.to_json(F.struct(n.alias("n"), F.col("event_type").alias("t")))) \
        .when(kind == 1, F.to_json(F.struct(n.cast("string").alias("n"), F.col("event_type").alias("t")))) \
        .when(kind == 2, F.to_json(F.struct(F.lit(None).cast("string").alias("n"), F.col("event_type").alias("t")), {"ignoreNullFields": "false"})) \
        .otherwise(F.lit("{no json"))
    path = scratch_path(spark, "variant")
    ev.select("event_id", kind.alias("kind"), J.metrics_variant(text).alias("m")).write.parquet(path)
    back = spark.read.parquet(path)
    # per kind of row (four): one schema each
    found = back.groupBy("kind").agg(J.discovered_schema("m").alias("found"))
    return back.join(F.broadcast(found), "kind").select(
        "event_id", J.variant_field("m", "n", "bigint").alias("n"), J.variant_field("m", "n", "string").alias("n_text"),
        J.variant_field("m", "t", "string").alias("t"), F.col("m").isNotNull().alias("parsed"), "found")


# The reading of orders as one station's hours, 30 years back from this day.
SQL_TOOL_REF_DATE = "2025-07-01"


def planting_sql_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 11.2: the planting tool asked through SQL, with its 30 years of history
    and names in any case."""
    from furrow.plans import sqltools
    from furrow.plans.proxies import PROXY_PLANT
    from furrow.sources.reference import plants

    hourly = _table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey").isNotNull(), F.lit("Orders")).alias("city_name"), F.col("o_orderdate").alias("date_mesure"),
        F.col("o_totalprice").alias("temperature_2m_mean"), (F.col("o_totalprice") / 100000).alias("precipitation_sum"))
    noon = hourly.withColumn("date_mesure", F.col("date_mesure") + F.expr("INTERVAL 12 HOURS"))
    sqltools.register_tools(noon, plants(spark, [PROXY_PLANT]), ref_date=SQL_TOOL_REF_DATE)
    return spark.sql("SELECT * FROM planting_window('ORDERS', 'Proxy')")


# Keywords of the indexed search over documents.
INDEX_KEYWORDS = ["License", "error", "42", "@example.com", "zzzqqq"]


def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.22, 3.26: documents by keyword through a trigram index of whole texts."""
    from furrow.operators.search_index import build_index, search_index

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = build_index(docs, scratch_path(spark, "trigrams"), "doc_id", ["text", "source"])
    return search_index(docs, path, "doc_id", ["text", "source"], INDEX_KEYWORDS).select("keyword", "doc_id")


def catalog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 5.10, 5.11: countries, creators and totals of the catalogue in one pass;
    documents as records, too short ids without a country."""
    from furrow.plans import catalog

    docs = _table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.concat(F.upper("lang"), F.lit("-"), F.col("doc_id"))).alias("id"),
        F.col("source").alias("creator"), F.when(F.col("n_chars") > 1000, F.col("source")).alias("download_url"))
    records = docs.withColumn("country", catalog.country_of("id"))
    return catalog.catalog_report(records, {"country": catalog.TOP_COUNTRIES, "creator": catalog.TOP_CREATORS},
                                  {"n_with_url": F.col("download_url") != ""})


REGISTRY = {f.__name__: f for f in (stream_upsert, stream_daily_facts, stream_fill, location_dimension, write_counts, metrics_variant, planting_sql_tool,
                                    keyword_index, catalog_report)}

ORACLE = {
    "keyword_index": "select k as keyword, doc_id from documents, (values " + ", ".join(f"('{k.lower()}')" for k in INDEX_KEYWORDS) + """) t(k)
where contains(lower(coalesce(text, '')), k) or contains(lower(coalesce(source, '')), k)
""",
    "catalog_report": """
with d as (select case when doc_id % 7 = 0 then 'Unknown' else substr(upper(lang), 1, 2) end as country, source as creator, n_chars > 1000 and source <> '' as url from documents)
(select 'country' as dim, country as value, count(*) as n from d group by country order by n desc, value limit 20)
union all
(select 'creator', creator, count(*) as n from d group by creator order by n desc, creator limit 10)
union all select 'distinct', 'country', count(distinct country) from d
union all select 'distinct', 'creator', count(distinct creator) from d
union all select 'summary', 'n_records', count(*) from d
union all select 'summary', 'n_with_url', count(*) filter (where url) from d
""",
    "stream_daily_facts": """
select o_custkey, o_orderkey, o_orderdate, o_totalprice from (
  select *, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey desc) as rn from orders)
where rn = 1 and o_orderdate >= date '1997-01-01'
""",
    "stream_fill": """
select user_id, event_id, v, last_value(v ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as v_filled
from (select user_id, event_id, case when value <= 100 then value end as v from events)
""",
    "location_dimension": """
with p as (select cast(floor(c_acctbal / 100) / 7 + 20 as decimal(9,6)) as latitude, cast(c_nationkey / 3 as decimal(9,6)) as longitude,
                  n_name || ' ' || cast(floor(c_acctbal / 100) as bigint) as city_name, c_mktsegment
           from customer join nation on c_nationkey = n_nationkey),
a as (select latitude, longitude, min(city_name) as city_name from p where c_mktsegment = 'BUILDING' group by 1, 2),
b as (select latitude, longitude, min(city_name) as city_name from p group by 1, 2),
n as (select * from b where not exists (select 1 from a where a.latitude = b.latitude and a.longitude = b.longitude))
select row_number() over (order by latitude, longitude) as id, cast(latitude as double) as latitude, cast(longitude as double) as longitude, city_name from a
union all
select (select count(*) from a) + row_number() over (order by latitude, longitude), cast(latitude as double), cast(longitude as double), city_name from n
""",
    "write_counts": """
with d as (select avg(l_discount) * 1000 - 30 as temperature_2m_mean, max(l_tax) * 1000 - 20 as temperature_2m_max,
                  min(l_discount) * 1000 as temperature_2m_min, sum(l_quantity) - 100 as precipitation_sum
           from lineitem group by l_returnflag, cast(l_shipdate as date))
select count(*) as n_rows,
       count(*) filter (where not temperature_2m_mean between -50 and 60) as n_temperature_2m_mean_outside,
       count(*) filter (where not temperature_2m_max between -50 and 60) as n_temperature_2m_max_outside,
       count(*) filter (where not temperature_2m_min between -50 and 60) as n_temperature_2m_min_outside,
       count(*) filter (where temperature_2m_min > temperature_2m_max) as n_temperature_swapped,
       count(*) filter (where precipitation_sum < 0) as n_precipitation_negative,
       count(*) filter (where precipitation_sum > 500) as n_precipitation_high,
       count(*) as written_n_rows,
       count(*) as written_nonnull_temperature_2m_mean,
       count(case when precipitation_sum is not null then 1 end) as written_nonnull_precipitation_sum,
       cast(0 as bigint) as written_all_null_rows,
       round(min(precipitation_sum), 6) as min_precipitation_sum, round(max(precipitation_sum), 6) as max_precipitation_sum
from d
""",
    "metrics_variant": """
select event_id,
       case when event_id % 4 < 2 then cast(floor(value) as bigint) end as n,
       case when event_id % 4 < 2 then cast(cast(floor(value) as bigint) as varchar) end as n_text,
       case when event_id % 4 < 3 then event_type end as t,
       event_id % 4 < 3 as parsed,
       case event_id % 4 when 0 then 'OBJECT<n: BIGINT, t: STRING>' when 1 then 'OBJECT<n: STRING, t: STRING>'
                         when 2 then 'OBJECT<n: VOID, t: STRING>' else 'VOID' end as found
from events
""",
    "planting_sql_tool": """
with r as (select cast(o_orderdate as date) d, avg(o_totalprice) a, min(o_totalprice) mn,
                  max(o_totalprice) mx, sum(o_totalprice/100000) rain from orders where o_orderdate >= date '1995-07-01' group by 1),
f as (select d, case when a>=200000 and a<=300000 then 1 else 0 end p,
             case when mn<1500 or mx>497500 then 1 else 0 end x, coalesce(rain,0) rain from r),
w as (select d, sum(p) over g germ, sum(p) over c perf, sum(x) over c fat, sum(rain) over c tot from f
      window g as (order by d rows between current row and 6 following),
             c as (order by d rows between current row and 10 following)),
s as (select d, case when germ>=5 and perf>=4 and fat=0 and tot<=1500 then 1 else 0 end ok, tot,
             1.0E0/sqrt(2025-extract(year from d)) wt
      from w where d <= date '2025-06-21')
select 'Orders' as city_name, 'proxy' as nom_du_plante, cast(extract(month from d) as integer) as month, cast(extract(day from d) as integer) as day,
       count(*) as years_analyzed, round(sum(wt),2) as weighted_years_analyzed,
       round(sum(ok*wt),2) as weighted_successful_years,
       round(sum(ok*wt)/sum(wt)*100,1) as success_probability_pct,
       round(sum(tot*wt)/sum(wt),1) as expected_rainfall_mm
from s group by all having count(*)>=5
order by success_probability_pct desc, weighted_successful_years desc, month, day limit 30
""",
}
