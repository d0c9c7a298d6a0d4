"""Proxy queries: each library operator run on the driver's tables.

A user is read as a station, an event type as a weather parameter, ``value``
as a measure and ``ts`` as the hour; ``orders`` gives one daily series.
Every function takes ``(spark, sf_dir)`` and returns a DataFrame whose work
grows with the input tables.  The matching DuckDB SQL lives in
``furrow.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import agronomy as AG
from furrow.functions import cleaning as C
from furrow.functions import dates as D
from furrow.functions import jsonx as J
from furrow.functions import text as TX
from furrow.operators import dedup, fill, keys, merge, quality, reshape, search
from furrow.plans import catalog, conversations, lifecycle, loads, planting
from furrow.session import scratch_path, spread
from furrow.sinks import align, partitioned, upsert
from furrow.sources import payloads
from furrow.sources.files import param_sql as _param_sql
from furrow.sources.files import read_partition, read_years


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------- planting
# The orders reading of the planting query (FIXTURES section 4).
PROXY_PLANT = ("proxy", 200000.0, 300000.0, 1500.0, 497500.0, None, None, None, 10, 10)
PROXY_REF_DATE = "2001-08-01"


def planting_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from furrow.sources.reference import plants
    orders = table(spark, sf_dir, "orders")
    hourly = orders.select(F.lit("orders").alias("location"), "o_orderdate",
                           "o_totalprice", (F.col("o_totalprice") / 100000).alias("rain"))
    daily = planting.daily_rollup(hourly, "o_orderdate", "o_totalprice", "rain",
                                  ["location"], daytime_hours=None)
    dim = plants(spark, [PROXY_PLANT])
    requests = dim.select(F.lit("orders").alias("location"), "nom_du_plante")
    out = planting.planting_windows(daily, dim, requests, ["location"], ref_date=PROXY_REF_DATE)
    return out.select("month", "day", "years_analyzed", "weighted_years_analyzed",
                      "weighted_successful_years", "success_probability_pct",
                      "expected_rainfall_mm")


# The lineitem reading of the all-plants planting query.
ALL_PLANTS_REF_DATE = "2001-11-04"
TEMP_OFFSET = 10.123456


def planting_all_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planting windows for every (location, plant) pair in one plan: lineitem
    as three stations (return flag), a daily temperature-like measure, the
    nine reference crops with their own thresholds and cycle lengths."""
    from furrow.sources.reference import PLANT_ROWS, plants
    li = table(spark, sf_dir, "lineitem")
    hourly = li.select(F.col("l_returnflag").alias("location"), "l_shipdate",
                       (F.lit(TEMP_OFFSET) + F.col("l_discount") * 150 + F.col("l_tax") * 100).alias("t"),
                       (F.col("l_quantity") / 1000).alias("rain"))
    daily = planting.daily_rollup(hourly, "l_shipdate", "t", "rain", ["location"], daytime_hours=None)
    # every station asks for every crop: a fan-out over the fixed crop list, no join
    # the station list from a one-column distinct of the raw table (not from the
    # rollup, which would aggregate lineitem a second time)
    requests = li.select(F.col("l_returnflag").alias("location")).distinct().select(
        "location", F.explode(F.array(*[F.lit(r[0]) for r in PLANT_ROWS])).alias("nom_du_plante"))
    out = planting.planting_windows(daily, plants(spark), requests, ["location"], ref_date=ALL_PLANTS_REF_DATE)
    return out.select("location", "nom_du_plante", "month", "day", "years_analyzed", "weighted_years_analyzed",
                      "weighted_successful_years", "success_probability_pct", "expected_rainfall_mm")


# --------------------------------------------------------------------------- rollup / reshape
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5.1 on events: per user and day, daytime (06-18 h) mean, min, max, sum."""
    daily = planting.daily_rollup(_events(spark, sf_dir), "ts", "value", "value", ["user_id"])
    return daily.select("user_id", "day_date", *[F.round(c, 6).alias(c) for c in
                        ("daytime_temp_avg", "daily_temp_min", "daily_temp_max", "daily_rain")])


def _first_events(spark, sf_dir):
    ev = _events(spark, sf_dir).select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "value")
    return dedup.first_by_key(ev, ["user_id", "day", "event_type"], ["event_id"])


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5.5: the first event (smallest id) per (user, day, type)."""
    return _first_events(spark, sf_dir).select("event_id", "user_id", "day", "event_type", "value")


def pivot_long_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.1/5.5: dedup then pivot the 5 event types to columns."""
    return reshape.pivot_long_wide(_first_events(spark, sf_dir), ["user_id", "day"], "event_type", "value",
                                   EVENT_TYPES)


def _daily_sums(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return ev.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


def _point_payloads(spark, sf_dir):
    """One point-series payload per user: ``type -> {yyyyMMdd: daily sum}``
    (bounded: event types x calendar days)."""
    sums = _daily_sums(spark, sf_dir)
    inner = sums.groupBy("user_id", "event_type").agg(
        F.map_from_entries(F.collect_list(F.struct(F.date_format("day", "yyyyMMdd"), F.col("v")))).alias("series"))
    return inner.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "series"))).alias("parameter"))


def map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1.5: payload ``parameter -> {yyyyMMdd: value}`` per user, exploded back to rows."""
    payload = _point_payloads(spark, sf_dir)
    long = payloads.point_series_to_long(payload, "parameter", ["user_id"])
    return long.select("user_id", "date", "parameter", F.round("value", 6).alias("value"))


def point_series_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1.8: the same payloads straight to a date-indexed wide frame, sorted."""
    wide = payloads.point_series_to_wide(_point_payloads(spark, sf_dir), EVENT_TYPES, "parameter", ["user_id"])
    return wide.select("user_id", "date", *[F.round(c, 6).alias(c) for c in EVENT_TYPES])


def arrays_zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1.6: parallel-array payloads (one per user and id block) to rows."""
    ev = _events(spark, sf_dir)
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    # one payload per user and block of 1,000 event ids: bounded by construction
    pl = (ev.groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("block")).agg(rows.alias("r"))
          .select("user_id", F.transform("r", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm:ss")).alias("time"),
                  F.col("r.event_id").alias("event_id"), F.col("r.value").alias("value")))
    return payloads.arrays_to_rows(pl, "time", ["event_id", "value"], ["user_id"])


def sequence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 1.7/9.6: regular daily series from (start, end, step) per user,
    end excluded, joined to the day's totals (0 events on empty days)."""
    ev = _events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day"), "value")
    bounds = ev.groupBy("user_id").agg(
        F.unix_timestamp(F.min("day").cast("timestamp")).alias("start"),
        F.unix_timestamp(F.date_add(F.max("day"), 1).cast("timestamp")).alias("end"))
    days = payloads.regular_series_to_rows(bounds.withColumn("slot", F.array()), "start", "end", 86400, [],
                                           ["user_id"], time_name="t")
    days = days.select("user_id", F.to_date("t").alias("day"))
    tot = ev.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    out = days.join(tot, ["user_id", "day"], "left")
    return out.select("user_id", "day", F.coalesce("n_events", F.lit(0)).cast("bigint").alias("n_events"),
                      F.round(F.coalesce("total", F.lit(0.0)), 6).alias("total"))


# --------------------------------------------------------------------------- cleaning rules
def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def sentinel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.3: -999 markers (line 7) to null."""
    li = _lineitem(spark, sf_dir)
    raw = F.when(F.col("l_linenumber") == 7, F.lit(-999.0)).otherwise(F.col("l_quantity"))
    return li.select("l_orderkey", "l_linenumber", C.sentinel_to_null(raw).alias("q"))


def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.4: text with junk and NaN to DOUBLE."""
    li = _lineitem(spark, sf_dir)
    txt = (F.when(F.col("l_returnflag") == "R", F.lit("n/a"))
           .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), F.lit("NaN"))
           .otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "))))
    return li.select("l_orderkey", "l_linenumber", C.coerce_numeric(txt).alias("q"))


def bounds_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.5: temperature outside [-50, 60] to null."""
    ev = _events(spark, sf_dir)
    return ev.select("event_id", F.round(C.null_outside(F.col("value") - 100, *C.TEMPERATURE_BOUNDS), 6).alias("t"))


def precip_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.8: precipitation < 0 or > 500 to 0."""
    li = _lineitem(spark, sf_dir)
    p = F.col("l_quantity") * 12.5 - 100
    return li.select("l_orderkey", "l_linenumber", F.round(C.precipitation_rule(p), 6).alias("p"))


def clip_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.10/3.12: humidity clipped to [0, 100], wind to [0, 150]; nulls kept."""
    ev = _events(spark, sf_dir)
    v = F.when(F.col("event_type") != "error", F.col("value"))
    return ev.select("event_id",
                     F.round(C.clip(v / 3 - 10, *C.HUMIDITY_BOUNDS), 6).alias("humidity"),
                     F.round(C.clip(v / 2 - 5, 0.0, C.FORECAST_WIND_MAX), 6).alias("wind"))


def floor_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.11: negative to 0."""
    ev = _events(spark, sf_dir)
    return ev.select("event_id", F.round(C.floor_zero(F.col("value") - 50), 6).alias("w"))


def cap_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.9: all-sky capped at clear-sky; null all-sky stays null, null cap leaves it."""
    li = _lineitem(spark, sf_dir)
    a = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") / 1000)
    c = F.when(F.col("l_linestatus") != "F", F.col("l_quantity") * 1.2)
    return li.select("l_orderkey", "l_linenumber", F.round(C.cap_by(a, c), 6).alias("all_sky"))


def _minmax(li):
    mn, mx = C.swap_min_max(F.col("l_tax") * 100, F.col("l_discount") * 100)
    return li.select("l_orderkey", "l_linenumber", mn.alias("mn"), mx.alias("mx"), (F.col("l_quantity") / 5).alias("mean"))


def swap_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.6: min and max swapped where min > max."""
    mm = _minmax(_lineitem(spark, sf_dir))
    return mm.select("l_orderkey", "l_linenumber", F.round("mn", 6).alias("mn"), F.round("mx", 6).alias("mx"))


def mean_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.7: mean outside [min, max] (after the swap) to the midpoint."""
    mm = _minmax(_lineitem(spark, sf_dir))
    return mm.select("l_orderkey", "l_linenumber", F.round(C.repair_mean("mean", "mn", "mx"), 6).alias("mean"))


def nearest_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.13: value modulo 100 snapped to the 28 weather codes (nulls kept)."""
    ev = _events(spark, sf_dir)
    raw = F.when(F.col("event_type") != "error", F.col("value") % 100)
    return ev.select("event_id", C.nearest_code(raw).alias("code"))


def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5.15: per event type, rows breaking each rule and the range before cleaning."""
    ev = _events(spark, sf_dir).select("event_type", (F.col("value") - 100).alias("t"),
                                       (F.col("value") * 1.2 - 20).alias("p"),
                                       (F.col("value") / 3 - 10).alias("h"))
    rules = {"t_out": ~F.col("t").between(-50, 60), "p_neg": F.col("p") < 0, "p_high": F.col("p") > 500,
             "h_out": (F.col("h") < 0) | (F.col("h") > 100)}
    rep = quality.violation_counts(ev, rules, ["t", "p", "h"], by=["event_type"])
    return rep.select(*[F.round(c, 6).alias(c) if c.startswith(("min_", "max_")) else F.col(c) for c in rep.columns])


def nonnull_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5.8: per event type, non-null count per metric and all-null rows."""
    ev = _events(spark, sf_dir).select(
        "event_type",
        F.when(F.col("value") <= 400, F.col("value")).alias("m1"),
        F.when(F.col("value") <= 100, F.col("value") * 2).alias("m2"),
        F.when(F.hour("ts") >= 12, F.col("value")).alias("m3"))
    return quality.nonnull_report(ev, ["m1", "m2", "m3"], by=["event_type"])


# --------------------------------------------------------------------------- fills
def _gappy(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return ev.select("event_id", "user_id", "ts", F.when(F.col("value") <= 100, F.col("value")).alias("v"))


def _fill_out(df):
    return df.select("event_id", "user_id", F.round("v", 6).alias("v"))


def interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6.3: per user by (ts, event_id), segmented by day."""
    return _fill_out(fill.interpolate_linear(_gappy(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["v"],
                                             chunk=F.to_date("ts")))


def ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6.5: forward fill only."""
    return _fill_out(fill.ffill(_gappy(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["v"], chunk=F.to_date("ts")))


def ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6.4: forward then backward fill."""
    return _fill_out(fill.ffill_bfill(_gappy(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["v"],
                                      chunk=F.to_date("ts")))


# --------------------------------------------------------------------------- merges
def daily_to_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 4.1: the day's aggregate spread on every event of that day."""
    ev = _events(spark, sf_dir)
    hourly = ev.select("user_id", "ts", "event_id", "value", F.lit("2024-01-31").cast("date").alias("extraction_date"))
    daily = (ev.groupBy("user_id", F.to_date("ts").alias("date"))
             .agg(F.avg("value").alias("day_avg"), F.count(F.lit(1)).alias("day_n"))
             .withColumn("extraction_date", F.lit("2024-02-01").cast("date")))
    out = merge.spread_daily_on_hourly(hourly, daily, ["user_id"], ts_col="ts", day_col="date")
    return out.select("user_id", "ts", "event_id", "value", F.round("day_avg", 6).alias("day_avg"), "day_n",
                      "extraction_date")


def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.18/5.9/8.3: orders (priority) and lineitem daily frames; the
    overlapping metric comes from orders only; latest extraction date."""
    o = (table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"))
         .agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders"))
         .withColumn("extraction_date", F.lit("2024-01-01").cast("date")))
    li = (_lineitem(spark, sf_dir).groupBy(F.to_date("l_shipdate").alias("date"))
          .agg(F.sum("l_extendedprice").alias("total"), F.sum("l_quantity").alias("quantity"))
          .withColumn("extraction_date", F.lit("2024-01-02").cast("date")))
    out = merge.source_priority_merge([("orders", o), ("lineitem", li)], [], "date")
    return out.select("date", F.round("total", 4).alias("total"), "n_orders",
                      F.round("quantity", 4).alias("quantity"), "extraction_date")


# --------------------------------------------------------------------------- completeness / batches
def completeness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.19/4.6/8.2: calendar days between first and last order with no order."""
    return quality.missing_dates(table(spark, sf_dir, "orders"), [], "o_orderdate")


def year_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.21: per year, first and last order day."""
    return quality.year_batches(table(spark, sf_dir, "orders"), "o_orderdate")


def _orders_store(spark, sf_dir, parts):
    path = scratch_path(spark, "orders-" + "-".join(parts))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    # a fresh folder: no partitions to preserve, so no dynamic-overwrite staging
    partitioned.write_partitioned(orders, path, "o_orderdate", parts, sort_cols=["o_orderkey"], dynamic=False)
    return path


def partition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 2.1/2.11: write year/month/day partitions, read everything back."""
    path = _orders_store(spark, sf_dir, ("year", "month", "day"))
    return spark.read.parquet(path).select("o_orderkey", "o_orderdate", "o_totalprice", "year", "month", "day")


def partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 1.1/1.2: read one partition of a year/month layout (pruned)."""
    path = _orders_store(spark, sf_dir, ("year", "month"))
    part = read_partition(spark, path, strict=True, year=1997, month=6)
    return part.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


def year_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 1.3/8.1: one pruned scan over three yearly partitions, per-year totals."""
    path = _orders_store(spark, sf_dir, ("year",))
    df = read_years(spark, path, [1996, 1997, 1998], ts_col="o_orderdate", floor_day=True)
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("n_orders"),
                                  F.round(F.sum("o_totalprice"), 4).alias("revenue"),
                                  F.countDistinct("o_orderdate").alias("n_days"))


# --------------------------------------------------------------------------- schema alignment
def align_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 2.7-2.9: two frames with different metric sets aligned to the wide fact layout."""
    ev = _events(spark, sf_dir)
    f1 = ev.where(F.col("event_type").isin("click", "view")).select(
        F.col("ts").alias("date"), F.col("value").alias("temperature_2m_mean"))
    f2 = ev.where(~F.col("event_type").isin("click", "view")).select(
        F.col("ts").alias("date"), F.col("value").alias("precipitation_sum"),
        F.when(F.col("event_type") != "error", F.col("value").cast("string")).otherwise(F.lit("bad"))
        .alias("temperature_2m_max"))
    both = align.union_evolving([f1, f2])
    from pyspark.sql import types as T
    return align.prepare_wide_append(both, "Sousse", 35.8256, 10.6411,
                                     metric_types={"extraction_date": T.DateType()})


# --------------------------------------------------------------------------- keyed loads
def _order_facts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    current = o.select("o_orderkey", F.col("o_totalprice").alias("price"),
                       F.lit("2024-01-01").cast("date").alias("extraction_date"))
    updates = o.where(F.col("o_orderstatus") == "F").select(
        "o_orderkey", (F.col("o_totalprice") + 100.0).alias("price"),
        F.lit("2024-01-02").cast("date").alias("extraction_date"))
    inserts = o.where(F.col("o_orderstatus") == "O").select(
        (F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), F.col("o_totalprice").alias("price"),
        F.lit("2024-01-02").cast("date").alias("extraction_date"))
    return current, updates.unionByName(inserts)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 2.3/2.4/5.4: keyed upsert; incoming rows win, also with an older date
    or none (a null date becomes the load's)."""
    current, incoming = _order_facts(spark, sf_dir)
    third = F.col("o_orderkey") % 3
    incoming = incoming.withColumn("extraction_date", F.when(F.col("o_orderkey") >= 10_000_000, F.col("extraction_date"))
                                   .when(third == 0, F.lit("2023-12-01").cast("date")).when(third == 1, F.col("extraction_date")))
    return upsert.upsert(current, incoming, ["o_orderkey"], as_of="2024-01-03").select("o_orderkey", "price", "extraction_date")


def upsert_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 2.5: forecast vintages kept; invalid incoming rows rejected."""
    o = table(spark, sf_dir, "orders")
    daily = o.groupBy("o_custkey", F.to_date("o_orderdate").alias("target_date")).agg(
        F.sum("o_totalprice").alias("metric"), F.max("o_orderpriority").alias("prio"),
        F.max("o_orderstatus").alias("status"))
    current = daily.select("o_custkey", "target_date", F.lit("2024-01-01").cast("date").alias("extraction_date"),
                           F.round("metric", 4).alias("metric"))
    incoming = daily.where(F.col("prio") == "1-URGENT").select(
        "o_custkey", "target_date", F.lit("2024-01-02").cast("date").alias("extraction_date"),
        F.when(F.col("status") != "P", F.round(F.col("metric") * 0.9, 4)).alias("metric"))
    out = upsert.versioned_upsert(current, incoming, ["o_custkey", "target_date"], "extraction_date",
                                  ["metric"], "target_date", strict=False)
    return out.select("o_custkey", "target_date", "extraction_date", "metric")


def upsert_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 2.6: existing customers keep name and first day; only order count
    and last day are updated; new customers are inserted whole.  The incoming
    side holds each customer twice (the later load counts) and a new column."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"))
    current = o.where(F.col("d") < "1998-01-01").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    current = current.withColumn("name", F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")))
    incoming = o.where(F.col("d") >= "1997-01-01").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    incoming = incoming.withColumn("name", F.concat(F.lit("new-"), F.col("o_custkey").cast("string")))
    incoming = incoming.withColumns({"label": F.col("name"), "load": F.lit(2)})
    early = incoming.withColumns({"n_orders": F.col("n_orders") + 1000, "label": F.lit("early"), "load": F.lit(1)})
    out = upsert.partial_upsert(current, incoming.unionByName(early), ["o_custkey"], ["n_orders", "last_day"], order=["load"])
    return out.select("o_custkey", "n_orders", "first_day", "last_day", "name", "label")


def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 2.12/1.9: orders exported as CSV (header) and JSON lines below the
    shared folder, read back with an explicit schema (no inference pass);
    ``json_same`` says the JSON copy holds the same row."""
    from furrow.sources.files import read_csv
    schema = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                              "o_orderdate")
    path = scratch_path(spark, "export")
    partitioned.export(o, path + "/csv", "csv")
    partitioned.export(o, path + "/json", "json")
    a = read_csv(spark, path + "/csv", schema)
    b = spark.read.schema(schema).json(path + "/json").select(
        *[F.col(c).alias("j_" + c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                             "o_orderdate")])
    j = a.join(b, a.o_orderkey == b.j_o_orderkey, "left")
    same = ((F.col("o_custkey") == F.col("j_o_custkey")) & (F.col("o_orderstatus") == F.col("j_o_orderstatus"))
            & (F.col("o_totalprice") == F.col("j_o_totalprice")) & (F.col("o_orderdate") == F.col("j_o_orderdate")))
    return j.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                    F.coalesce(same, F.lit(False)).alias("json_same"))


def csv_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1.10: station-style CSV exports (two metadata lines, then a header
    with unit suffixes) built from orders, one file per scan partition, read
    back by dropping the preamble, renaming headers and casting the date."""
    from furrow.sources.files import read_csv_skip_preamble
    cols = ["o_orderkey", "o_totalprice", "o_orderdate"]
    o = table(spark, sf_dir, "orders").select(*cols)
    head = ["latitude,longitude,elevation", "35.8256,10.6411,12.0", "time_key,price (TND),time"]
    # the first row of every scan partition brings the head of its file
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    path = scratch_path(spark, "csv-export")
    o.select(F.concat(F.when(first, F.lit("\n".join(head) + "\n")).otherwise(F.lit("")),
                      F.concat_ws(",", *[F.col(c).cast("string") for c in cols])).alias("line")).write.text(path)
    back = read_csv_skip_preamble(spark, path, "time_key bigint, price double, time string",
                                  skip_lines=2, renames={"time_key": "o_orderkey", "price": "o_totalprice",
                                                         "time": "o_orderdate"},
                                  date_cols=["o_orderdate"])
    return back.select("o_orderkey", "o_totalprice", "o_orderdate")


def get_or_create_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 12.1/12.2/4.5: nation ids kept, event types and regions numbered after them."""
    existing = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    cand = (_events(spark, sf_dir).select(keys.source_name("event_type").alias("name"))
            .unionByName(table(spark, sf_dir, "region").select(keys.source_name("r_name").alias("name")))
            .unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))))
    return keys.get_or_create(existing, cand, ["name"], "id")


# --------------------------------------------------------------------------- unpivot / joins / sql
def price_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.15-3.17/4.2: filter, pattern column selection, value+flag unpivot."""
    li = _lineitem(spark, sf_dir).where(F.col("l_returnflag") == "R")
    wide = li.select("l_orderkey", "l_linenumber",
                     F.col("l_quantity").alias("Y1991"), F.col("l_linestatus").alias("Y1991F"),
                     F.col("l_discount").alias("Y1992"), F.col("l_returnflag").alias("Y1992F"),
                     F.col("l_tax").alias("Y1993"),
                     F.when(F.col("l_tax") > 0.04, F.lit("E")).alias("Y1993F"))
    vals = reshape.columns_matching(wide, r"Y\d{4}")
    flags = reshape.columns_matching(wide, r"Y\d{4}F")
    long = reshape.unpivot_value_flag(wide, ["l_orderkey", "l_linenumber"], vals,
                                      {v: v + "F" for v in vals if v + "F" in flags})
    return long.select("l_orderkey", "l_linenumber", reshape.year_from_header("Year").alias("year"),
                       "Value", "Flag")


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 4.3: fact to dimension joins (Spark's own size check decides what is broadcast)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_customers"),
                                             F.round(F.sum("c_acctbal"), 2).alias("acctbal"))


PARAM_SQL = """
SELECT n.n_name AS n_name, COUNT(*) AS n, MIN(c.c_acctbal) AS min_bal, MAX(c.c_acctbal) AS max_bal,
       ROUND(AVG(c.c_acctbal), 6) AS avg_bal, ROUND(SUM(c.c_acctbal), 2) AS sum_bal
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name ILIKE :region AND c.c_acctbal > :min_bal
GROUP BY n.n_name
"""


def param_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 1.14/3.27/5.14: bound parameters, ILIKE name match, ad hoc aggregates."""
    views = {t: table(spark, sf_dir, t) for t in ("customer", "nation", "region")}
    return _param_sql(spark, PARAM_SQL, {"region": "europe", "min_bal": 0.0}, views)


# --------------------------------------------------------------------------- search
def soil_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.28/9.21: is the requested soil among the part's words (normalised)?"""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("nom_du_plante"),
        F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("nature_des_sols"))
    li = _lineitem(spark, sf_dir)
    req = li.select("l_orderkey", "l_linenumber",
                    F.when(F.col("l_linenumber") == 1, F.col("l_partkey") + 1_000_000)
                    .otherwise(F.col("l_partkey")).alias("plant"),
                    F.when(F.col("l_returnflag") == "R", F.lit(" Small "))
                    .when(F.col("l_returnflag") == "A", F.lit("ECONOMY"))
                    .otherwise(F.lit("red ")).alias("soil_type"))
    out = search.soil_compatibility(req, part, plant_col="plant")
    return out.select("l_orderkey", "l_linenumber", "compatible", "message")


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.22/3.23/7.5: case-insensitive substring on name or type, first 10."""
    part = table(spark, sf_dir, "part")
    return search.search_contains(part, ["p_name", "p_type"], "ReD", ["p_partkey"], limit=10).select(
        "p_partkey", "p_name", "p_type")


def kc_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.24/9.24: range text lower bound within [10, 30]; unparsable skipped."""
    part = table(spark, sf_dir, "part")
    txt = (F.when(F.col("p_size") < 5, F.lit("n/a"))
           .when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("-"),
                                                    (F.col("p_size") + 5).cast("string")))
           .otherwise(F.col("p_size").cast("string")))
    kc = part.select("p_partkey", txt.alias("kc_text"))
    return search.search_range(kc, "kc_text", 10, 30).select(
        "p_partkey", "kc_text", search.range_lower_bound("kc_text").alias("kc_lo"))


KEYWORDS = ["license", "token", "@", "und"]


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 3.26/5.12: documents matching any keyword, once each."""
    docs = table(spark, sf_dir, "documents")
    return search.keyword_filter(docs, ["text", "source"], KEYWORDS, "doc_id", ["doc_id", "lang", "source", "n_chars"])


def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5.12: per keyword, documents matching it."""
    docs = table(spark, sf_dir, "documents")
    _, counts = dedup.any_match_dedup(docs.select("doc_id", "text"), "doc_id", {k: TX.contains_ci("text", k) for k in KEYWORDS})
    return counts.select("keyword", "n")


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 5.10/5.11/7.4: records per source (top 20) and per language (top 10)."""
    docs = table(spark, sf_dir, "documents")
    by_src = catalog.count_top(docs, "source", catalog.TOP_COUNTRIES).select(
        F.lit("source").alias("dim"), F.col("source").alias("value"), "n")
    by_lang = catalog.count_top(docs, "lang", catalog.TOP_CREATORS).select(
        F.lit("lang").alias("dim"), F.col("lang").alias("value"), "n")
    summary = docs.agg(F.count_if(F.col("n_chars") > 1000).alias("n")).select(
        F.lit("summary").alias("dim"), F.lit("long_docs").alias("value"), "n")
    return by_src.unionByName(by_lang).unionByName(summary)


def catalog_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3.25: catalogue records whose id starts with a prefix (documents as records)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.upper("lang"), F.lit("-"), F.col("source")).alias("id"), "lang")
    return search.filter_prefix(docs, "id", "EN-src1")


def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 9.31: farm context block from optional fields (customers as farms)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    farms = c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("governorate"),
        F.when(F.col("c_acctbal") > 0, F.round("c_acctbal", 0)).alias("farm_size"),
        F.when(F.col("c_acctbal") > 5000, F.lit("ha")).otherwise(F.lit("")).alias("farm_size_unit"),
        F.when(F.col("c_acctbal") > -500, F.col("n_name")).alias("soil_type"))
    return farms.select("c_custkey", TX.context_block("governorate", "farm_size", "farm_size_unit",
                                                      "soil_type").alias("context"))


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 1.13/6.6: coefficient-style HTML tables built from ``part`` and read
    back to rows.  One page per block of 50 part keys: a header; a bold "a. Size
    .." row per size bucket, spanning the table or (odd buckets) with a value,
    each followed by a variant without a crop; parts with the name in the
    first, the spanning first or the second cell, some with character
    references, some short of a cell; a variant under each "red" part."""
    letters = F.array(*[F.lit(chr(ord("a") + i)) for i in range(16)])
    p = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 50).alias("page_id"), F.floor(F.col("p_size") / 10).alias("cat"),
        "p_partkey", "p_size", "p_retailprice",
        F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, " &amp;&nbsp;Co&#46;").otherwise("")).alias("name"),
        F.col("p_name").startswith("red").alias("red"))

    def row(*cells):
        return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))

    def cell(x, attrs: str = ""):
        return F.concat(F.lit(f"<td{attrs}>"), x, F.lit("</td>"))

    blank, key = cell(F.lit("")), F.col("p_partkey")
    title = F.when(key % 7 == 0, F.concat(blank, cell(F.col("name")))) \
        .when(key % 2 == 1, cell(F.col("name"), ' colspan="2"')).otherwise(F.concat(cell(F.col("name")), blank))
    crop = p.select("page_id", "cat", key.cast("double").alias("ord"),
                    row(title, cell(F.col("p_size").cast("string")),
                        F.when(key % 11 == 0, "").otherwise(cell(F.col("p_retailprice").cast("string")))).alias("tr"))
    variant = p.where("red").select(
        "page_id", "cat", (key + 0.5).alias("ord"),
        row(blank, cell(F.concat(F.lit("- variant "), key.cast("string"))),
            cell((F.col("p_size") + 1).cast("string")), cell(F.col("p_retailprice").cast("string"))).alias("tr"))
    size = (F.col("cat") * 10).cast("string")
    label = F.concat(F.lit("<b>"), F.element_at(letters, (F.col("cat") + 1).cast("int")), F.lit(". Size "), size, F.lit("</b>"))
    buckets = p.select("page_id", "cat").distinct()
    category = buckets.select("page_id", "cat", F.lit(-1.0).alias("ord"),
                              F.when(F.col("cat") % 2 == 1, row(cell(label, " colspan='2'"), cell(size), cell(F.lit("-"))))
                              .otherwise(row(cell(label, ' colspan="4"'))).alias("tr"))
    orphan = buckets.select("page_id", "cat", F.lit(-0.5).alias("ord"),
                            row(blank, cell(F.lit("- orphan")), cell(F.lit("1")), cell(F.lit("2"))).alias("tr"))
    # at most 50 parts (+ variants, + categories) per page: a bounded collect
    header = "<html><body><table><tr><td>Crop</td><td></td><td>Kc ini</td><td>Kc mid</td></tr>"
    pages = (crop.unionByName(variant).unionByName(category).unionByName(orphan).groupBy("page_id")
             .agg(F.array_sort(F.collect_list(F.struct("cat", "ord", "tr"))).alias("r"))
             .select("page_id", F.concat(F.lit(header), F.array_join(F.transform("r", lambda x: x["tr"]), ""),
                                         F.lit("</table></body></html>")).alias("html")))
    rows = catalog.html_table_rows(pages, "page_id", "html", value_cols=("value_1", "value_2"))
    return rows.select("page_id", "category", "crop", "variant", "value_1", "value_2")


def catalog_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1.12: documents written as a dataset catalogue (XML records with the
    whole text as description, no id for Spanish records, no download link for
    German ones) and read back with the XML reader.  Characters that XML cannot
    hold count as white space, and runs of white space as one space."""
    from furrow.sources.files import read_catalog_xml
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source",
        TX.collapse_ws(F.regexp_replace("text", "[\\x00-\\x1F\\x{FFFE}\\x{FFFF}]", " ")).alias("description"))
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        d = d.withColumn("description", F.replace("description", F.lit(raw), F.lit(name)))
    attr = F.when(F.col("lang") != "es", F.concat(F.lit(' xml:id="D'), F.col("doc_id").cast("string"), F.lit('"')))
    dist = F.when(F.col("lang") != "de", F.concat(
        F.lit("<dcat:distribution><dcat:Distribution><dcat:downloadURL>http://data.example/"),
        F.col("doc_id").cast("string"), F.lit("</dcat:downloadURL></dcat:Distribution></dcat:distribution>")))
    rec = d.select(F.floor(F.col("doc_id") / 2000).alias("block"), F.lit(1).alias("part"), F.concat(
        F.lit("<dcat:Dataset"), F.coalesce(attr, F.lit("")), F.lit("><dc:title>Document "), F.col("doc_id").cast("string"),
        F.lit("</dc:title><dc:description>"), F.coalesce("description", F.lit("")), F.lit("</dc:description><dc:creator>"), F.col("source"), F.lit("</dc:creator><dc:subject>"), F.col("lang"),
        F.lit("</dc:subject><dc:subject>"), F.col("source"), F.lit("</dc:subject>"),
        F.coalesce(dist, F.lit("")), F.lit("</dcat:Dataset>")).alias("value"))
    # a file per block: its records, one a line, between the root's two ends
    root = ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dcat="http://www.w3.org/ns/dcat#" '
            'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dct="http://purl.org/dc/terms/">')
    ends = F.inline(F.array(F.struct(F.lit(0).alias("part"), F.lit(root).alias("value")),
                            F.struct(F.lit(2).alias("part"), F.lit("</rdf:RDF>").alias("value"))))
    lines = rec.unionByName(rec.select("block").distinct().select("block", ends))
    path = scratch_path(spark, "catalog-xml")
    lines.repartition("block").sortWithinPartitions("block", "part").select("block", "value").write.partitionBy("block").text(path)
    cat = read_catalog_xml(spark, path + "/block=*")
    return cat.select("id", "title", "creator", "description", F.array_join("subjects", ",").alias("subjects"),
                      "download_url")


def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 9.22-9.30 over whole documents."""
    from furrow.operators.textstats import text_profile
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    prof = text_profile(docs, "text")
    t = F.col("text")
    return prof.select(
        "doc_id", "n_words", "n_sentences", "n_digit_tokens", "unit_hits", "caution_hits", "dense", "too_long",
        F.md5(TX.truncate(t).cast("binary")).alias("truncated_md5"),
        F.md5(F.col("norm").cast("binary")).alias("collapsed_md5"),
        F.coalesce(TX.control_kind(t), F.lit("none")).alias("kind"),
        F.md5(TX.after_marker(t, "|").cast("binary")).alias("after_bar_md5"),
        F.md5(TX.strip_list_prefix("norm").cast("binary")).alias("unprefixed_md5"))


# --------------------------------------------------------------------------- json / dates / math
def json_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 2.13/9.19: non-null metrics packed as JSON."""
    ev = _events(spark, sf_dir).select("event_id", "user_id", "event_type",
                                       F.when(F.col("value") <= 100, F.col("value")).alias("value"))
    return ev.select("event_id", J.pack_metrics(["user_id", "event_type", "value"]).alias("metrics"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 9.20: ``props->>'k'``."""
    ev = _events(spark, sf_dir)
    return ev.select("event_id", J.json_field("props", "k", "int").alias("k"))


def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 9.1-9.5, 9.7, 9.9."""
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    txt = F.date_format(d, "yyyyMMdd")
    iso = F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return o.select(
        "o_orderkey",
        F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("dd"), F.hour(d).alias("h"),
        D.yyyymm(d).alias("yyyymm"),
        D.parse_compact_date(txt).alias("parsed"),
        D.parse_iso_timestamp(iso).alias("from_iso"),
        D.day_of(D.day_floor(d)).alias("day"),
        D.history_target(D.day_of(d)).alias("history_day"),
        D.shift_years(D.day_of(d), -30).alias("minus_30y"),
        D.epoch_to_timestamp(F.unix_timestamp(d.cast("timestamp"))).alias("roundtrip"),
        D.source_for_window(F.date_add(D.day_of(d), 7), F.lit("2000-01-01").cast("date")).alias("src"))


def math_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 9.10: abs, sqrt, half-even rounding, midpoint, nearest distance."""
    ev = _events(spark, sf_dir)
    v = F.col("value")
    return ev.select("event_id",
                     F.round(F.abs(v - 50), 6).alias("dist"),
                     F.round(F.sqrt(v), 6).alias("root"),
                     F.bround(v * 2, 0).alias("half_even"),
                     F.round((v + F.col("user_id")) / 2, 6).alias("mid"),
                     F.least(F.abs(v - 10), F.abs(v - 100)).alias("nearest"))


def distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 5.6/5.7/7.3: distinct (user, type) pairs and per-user distinct types."""
    # one shuffle: the distinct set per user is built by a partial aggregate
    # (bounded by the number of event types), not by distinct + regroup
    per_user = _events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    return per_user.select("user_id", F.size("types").cast("bigint").alias("n_types"),
                           F.array_join("types", ",").alias("types"))


# --------------------------------------------------------------------------- agronomy
def _et0_inputs(li):
    return li.select("l_orderkey", "l_linenumber",
                     (F.col("l_quantity") / 2).alias("rs"),
                     (F.col("l_discount") * 500 + 30).alias("rh"),
                     (F.col("l_tax") * 300 + 5).alias("tmean"),
                     F.dayofyear("l_shipdate").alias("doy"), F.year("l_shipdate").alias("yr"),
                     (F.col("l_linenumber") * 0.5).alias("u2"), (F.col("l_linenumber") * 10.0).alias("alt"))


def et0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 9.14-9.16: FAO-56 Penman-Monteith ET0 on scaled lineitem inputs."""
    x = _et0_inputs(_lineitem(spark, sf_dir))
    x = x.withColumn("ra", AG.extraterrestrial_radiation("doy", "yr", F.lit(36.0)))
    tm = F.col("tmean")
    e = AG.et0_penman_monteith("rs", "rh", tm, tm - 5, tm + 6, "u2", "alt", "doy", "yr", F.lit(36.0), ra="ra")
    return x.select("l_orderkey", "l_linenumber", F.round(e, 5).alias("et0"), F.round("ra", 5).alias("ra"))


def _pixels(li):
    nir = F.col("l_tax") * 100
    red = F.col("l_discount") * 100
    raw = F.when(F.col("l_linenumber") == 1, F.lit(0.0)).otherwise(F.col("l_extendedprice") / 10 + 13000)
    return li.select("l_orderkey", "l_linenumber", "l_returnflag",
                     F.round(AG.ndvi(nir, red), 6).alias("ndvi"),
                     F.round(AG.land_surface_temperature(raw), 4).alias("lst"))


def pixel_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops 9.17/9.18: NDVI and land-surface temperature per pixel row."""
    return _pixels(_lineitem(spark, sf_dir)).drop("l_returnflag")


def pixel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5.13: mean over non-null pixels, per return flag."""
    return _pixels(_lineitem(spark, sf_dir)).groupBy("l_returnflag").agg(
        F.round(F.avg("ndvi"), 6).alias("mean_ndvi"), F.round(F.avg("lst"), 4).alias("mean_lst"))


# --------------------------------------------------------------------------- conversations
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6.7: last 6 visible turns per conversation, rendered in order."""
    return conversations.last_turns(table(spark, sf_dir, "conversations"))


def retry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6.8: per user turn, retry flag and the latest earlier non-retry request."""
    return conversations.previous_requests(table(spark, sf_dir, "conversations"))


# --------------------------------------------------------------------------- normaliser pipelines
AS_OF = "2024-06-01"


def normalize_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily normaliser on a lineitem daily series per
    return flag: swap, mean repair, bounds, interpolation, precipitation."""
    from furrow.operators.normalize import openmeteo_daily
    daily = _lineitem(spark, sf_dir).groupBy(F.col("l_returnflag").alias("location"),
                                             F.to_date("l_shipdate").alias("date")).agg(
        (F.avg("l_discount") * 1000 - 30).alias("temperature_2m_mean"),
        (F.max("l_tax") * 1000 - 20).alias("temperature_2m_max"),
        (F.min("l_discount") * 1000).alias("temperature_2m_min"),
        (F.sum("l_quantity") - 100).alias("precipitation_sum"))
    out = openmeteo_daily(daily, AS_OF, ["location"])
    return out.select("location", "date", *[F.round(c, 6).alias(c) for c in
                      ("temperature_2m_mean", "temperature_2m_max", "temperature_2m_min", "precipitation_sum")],
                      "extraction_date", "source")


def normalize_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly normaliser: pressure bounds then forward fill per station-year."""
    from furrow.operators.normalize import openmeteo_hourly
    ev = _events(spark, sf_dir).select(F.col("user_id").alias("location"), F.col("ts").alias("date"),
                                       (F.col("value") * 2 + 850).alias("surface_pressure"))
    out = openmeteo_hourly(ev, AS_OF, ["location"])
    return out.select("location", "date", F.round("surface_pressure", 6).alias("surface_pressure"),
                      "extraction_date", "source")


def normalize_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast normaliser: temperature bounds and interpolation, precipitation,
    wind clip [0, 150], weather-code snap, on a daily forecast per user."""
    from furrow.operators.normalize import openmeteo_forecast
    v = F.col("value")
    fc = _events(spark, sf_dir).groupBy(F.col("user_id").alias("location"), F.to_date("ts").alias("date")).agg(
        ((F.max(v) + F.min(v)) % 100).alias("weather_code"),
        (F.max(v) / 5 - 20).alias("temperature_2m_max"),
        (F.min(v) / 5 - 20).alias("temperature_2m_min"),
        (F.sum(v) / 10 - 20).alias("precipitation_sum"),
        (F.max(v) / 2).alias("wind_speed_10m_max"))
    out = openmeteo_forecast(fc, AS_OF, ["location"])
    return out.select("location", "date", "weather_code",
                      *[F.round(c, 6).alias(c) for c in ("temperature_2m_max", "temperature_2m_min",
                                                         "precipitation_sum", "wind_speed_10m_max")],
                      "extraction_date", "source")


# Event types read as point-series parameter codes in this proxy.
EVENT_CODES = {"click": "T2M", "error": "PRECTOTCORR", "purchase": "RH2M", "signup": "WS2M",
               "view": "ALLSKY_SFC_SW_DWN"}


def normalize_point_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-series normaliser: dedup, pivot, rename, sentinel, bounds,
    interpolation, precipitation, radiation cap, humidity clip, floors."""
    from furrow.operators.normalize import nasapower_daily
    ev = _events(spark, sf_dir)
    code = F.create_map(*[x for k, v in EVENT_CODES.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    v = F.col("value")
    scaled = (F.when(v > 450, F.lit(-999.0))
              .when(F.col("event_type") == "click", v - 40)
              .when(F.col("event_type") == "error", v * 1.5 - 30)
              .when(F.col("event_type") == "signup", v - 20)
              .when(F.col("event_type") == "view", v / 10)
              .otherwise(v))
    long = ev.select(F.col("user_id").alias("location"), F.to_date("ts").alias("date"),
                     code.alias("parameter"), scaled.alias("value"), "event_id")
    out = nasapower_daily(long, AS_OF, ["location"], order_col="event_id")
    metrics = list(reshape.POINT_SERIES_NAMES.values())
    return out.select("location", "date", *[F.round(c, 6).alias(c) for c in metrics], "extraction_date", "source")


REGISTRY = {
    "planting_window": planting_window,
    "planting_all_plants": planting_all_plants,
    "hourly_rollup": hourly_rollup,
    "pivot_long_wide": pivot_long_wide,
    "dedup_first": dedup_first,
    "map_explode": map_explode,
    "point_series_wide": point_series_wide,
    "arrays_zip_rows": arrays_zip_rows,
    "sequence_rows": sequence_rows,
    "sentinel_null": sentinel_null,
    "numeric_coerce": numeric_coerce,
    "bounds_null": bounds_null,
    "precip_rule": precip_rule,
    "clip_range": clip_range,
    "floor_zero": floor_zero,
    "cap_by_column": cap_by_column,
    "swap_minmax": swap_minmax,
    "mean_repair": mean_repair,
    "nearest_code": nearest_code,
    "violation_counts": violation_counts,
    "nonnull_report": nonnull_report,
    "interpolate_linear": interpolate_linear,
    "ffill": ffill,
    "ffill_bfill": ffill_bfill,
    "daily_to_hourly": daily_to_hourly,
    "source_priority": source_priority,
    "completeness_gaps": completeness_gaps,
    "year_batches": year_batches,
    "partition_roundtrip": partition_roundtrip,
    "partition_scan": partition_scan,
    "year_range_scan": year_range_scan,
    "align_schema": align_schema,
    "upsert_latest": upsert_latest,
    "upsert_versioned": upsert_versioned,
    "upsert_partial": upsert_partial,
    "export_roundtrip": export_roundtrip,
    "csv_preamble": csv_preamble,
    "get_or_create_keys": get_or_create_keys,
    "price_unpivot": price_unpivot,
    "star_join": star_join,
    "param_sql": param_sql,
    "soil_match": soil_match,
    "text_search": text_search,
    "kc_range": kc_range,
    "keyword_search": keyword_search,
    "keyword_counts": keyword_counts,
    "catalog_stats": catalog_stats,
    "text_flags": text_flags,
    "catalog_prefix": catalog_prefix,
    "catalog_xml": catalog_xml,
    "html_tables": html_tables,
    "context_block": context_block,
    "json_pack": json_pack,
    "json_extract": json_extract,
    "date_parts": date_parts,
    "math_mix": math_mix,
    "distinct_sorted": distinct_sorted,
    "et0": et0,
    "pixel_index": pixel_index,
    "pixel_mean": pixel_mean,
    "last_turns": last_turns,
    "retry_resolve": retry_resolve,
    "normalize_daily": normalize_daily,
    "normalize_hourly": normalize_hourly,
    "normalize_point_series": normalize_point_series,
    "normalize_forecast": normalize_forecast,
}

REGISTRY |= lifecycle.REGISTRY | loads.REGISTRY
