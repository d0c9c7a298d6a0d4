"""DuckDB SQL equivalent of every proxy in ``furrow.plans.proxies``.

Tables are the driver's views (region nation customer supplier part orders
lineitem events documents embeddings pages benchmark labels conversations).
Column names and types are aligned with the Spark output: integer sums and
counts as BIGINT, date parts as INTEGER, doubles rounded.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["planting_window"] = """
with r as (select cast(o_orderdate as date) d, avg(o_totalprice) a, min(o_totalprice) mn,
                  max(o_totalprice) mx, sum(o_totalprice/100000) rain from orders group by 1),
f as (select d, case when a>=200000 and a<=300000 then 1 else 0 end p,
             case when mn<1500 or mx>497500 then 1 else 0 end x, coalesce(rain,0) rain from r),
w as (select d, sum(p) over g germ, sum(p) over c perf, sum(x) over c fat, sum(rain) over c tot from f
      window g as (order by d rows between current row and 6 following),
             c as (order by d rows between current row and 10 following)),
s as (select d, case when germ>=5 and perf>=4 and fat=0 and tot<=1500 then 1 else 0 end ok, tot,
             case when 2001-extract(year from d)<=5 then 1.0E0 else 1.0E0/sqrt(2001-extract(year from d)) end wt
      from w where d <= date '2001-07-22')
select cast(extract(month from d) as integer) as month, cast(extract(day from d) as integer) as day,
       count(*) as years_analyzed, round(sum(wt),2) as weighted_years_analyzed,
       round(sum(ok*wt),2) as weighted_successful_years,
       round(sum(ok*wt)/sum(wt)*100,1) as success_probability_pct,
       round(sum(tot*wt)/sum(wt),1) as expected_rainfall_mm
from s group by 1,2 having count(*)>=5
order by success_probability_pct desc, weighted_successful_years desc, month, day limit 30
"""

# Whitespace class shared with furrow.functions.text.WS; strip = both ends.
_WS = r"[\t\n\x0B\f\r ]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _after(x: str, marker: str) -> str:
    return (f"case when instr({x}, '{marker}') > 0 then {_strip(f'substr({x}, instr({x}, {chr(39)}{marker}{chr(39)}) + {len(marker)})')}"
            f" else {_strip(x)} end")


def _hits(low: str, markers) -> str:
    return " + ".join(f"cast((length({low}) - length(replace({low}, '{m}', ''))) // length('{m}') as integer)"
                      for m in markers)


ORACLE["hourly_rollup"] = """
select user_id, cast(ts as date) as day_date,
       round(avg(value) filter (where hour(ts) between 6 and 18), 6) as daytime_temp_avg,
       round(min(value), 6) as daily_temp_min, round(max(value), 6) as daily_temp_max,
       round(sum(value), 6) as daily_rain
from events group by 1, 2
"""

_FIRST = """
select event_id, user_id, day, event_type, value from (
  select event_id, user_id, cast(ts as date) as day, event_type, value,
         row_number() over (partition by user_id, cast(ts as date), event_type order by event_id) as rn
  from events) where rn = 1
"""

ORACLE["dedup_first"] = _FIRST

ORACLE["pivot_long_wide"] = f"""
with f as ({_FIRST})
select user_id, day,
  max(value) filter (where event_type = 'click') as click,
  max(value) filter (where event_type = 'error') as error,
  max(value) filter (where event_type = 'purchase') as purchase,
  max(value) filter (where event_type = 'signup') as signup,
  max(value) filter (where event_type = 'view') as view
from f group by 1, 2
"""

ORACLE["map_explode"] = """
select user_id, cast(ts as date) as date, event_type as parameter, round(sum(value), 6) as value
from events group by 1, 2, 3
"""

ORACLE["arrays_zip_rows"] = """
select user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as time, event_id, value from events
"""

ORACLE["sequence_rows"] = """
with b as (select user_id, min(cast(ts as date)) s, max(cast(ts as date)) e from events group by 1),
d as (select user_id, cast(unnest(generate_series(cast(s as timestamp), cast(e as timestamp), interval 1 day)) as date) as day from b),
t as (select user_id, cast(ts as date) as day, count(*) n, sum(value) tot from events group by 1, 2)
select d.user_id, d.day, cast(coalesce(t.n, 0) as bigint) as n_events, round(coalesce(t.tot, 0.0), 6) as total
from d left join t on d.user_id = t.user_id and d.day = t.day
"""

ORACLE["sentinel_null"] = """
select l_orderkey, l_linenumber, case when l_linenumber = 7 then null else l_quantity end as q from lineitem
"""

ORACLE["numeric_coerce"] = """
select l_orderkey, l_linenumber, case when isnan(x) then null else x end as q from (
  select l_orderkey, l_linenumber,
         try_cast(trim(case when l_returnflag = 'R' then 'n/a'
                            when l_returnflag = 'A' and l_linestatus = 'F' then 'NaN'
                            else ' ' || cast(cast(trunc(l_quantity) as integer) as varchar) || ' ' end) as double) as x
  from lineitem)
"""

ORACLE["bounds_null"] = """
select event_id, round(case when value - 100 between -50 and 60 then value - 100 end, 6) as t from events
"""

ORACLE["precip_rule"] = """
select l_orderkey, l_linenumber, round(case when p < 0 or p > 500 then 0.0 else p end, 6) as p
from (select l_orderkey, l_linenumber, l_quantity * 12.5 - 100 as p from lineitem)
"""

ORACLE["clip_range"] = """
select event_id,
       round(case when h < 0 then 0.0 when h > 100 then 100.0 else h end, 6) as humidity,
       round(case when w < 0 then 0.0 when w > 150 then 150.0 else w end, 6) as wind
from (select event_id, (case when event_type <> 'error' then value end) / 3 - 10 as h,
             (case when event_type <> 'error' then value end) / 2 - 5 as w from events)
"""

ORACLE["floor_zero"] = """
select event_id, round(case when value - 50 < 0 then 0.0 else value - 50 end, 6) as w from events
"""

ORACLE["cap_by_column"] = """
select l_orderkey, l_linenumber, round(case when a > c then c else a end, 6) as all_sky from (
  select l_orderkey, l_linenumber, case when l_returnflag <> 'N' then l_extendedprice / 1000 end as a,
         case when l_linestatus <> 'F' then l_quantity * 1.2 end as c from lineitem)
"""

_MINMAX = """
select l_orderkey, l_linenumber, case when a > b then b else a end as mn, case when a > b then a else b end as mx,
       l_quantity / 5 as mean
from (select l_orderkey, l_linenumber, l_quantity, l_tax * 100 as a, l_discount * 100 as b from lineitem)
"""

ORACLE["swap_minmax"] = f"""
select l_orderkey, l_linenumber, round(mn, 6) as mn, round(mx, 6) as mx from ({_MINMAX})
"""

ORACLE["mean_repair"] = f"""
select l_orderkey, l_linenumber, round(case when mean < mn or mean > mx then (mn + mx) / 2 else mean end, 6) as mean
from ({_MINMAX})
"""

ORACLE["nearest_code"] = """
with e as (select event_id, round_even(case when event_type <> 'error' then value % 100 end, 0) as r from events),
c as (select unnest([0, 1, 2, 3, 45, 48, 51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 71, 73, 75, 77, 80, 81, 82, 85, 86, 95, 96, 99]) as code)
select e.event_id, cast(arg_min(c.code, abs(c.code - e.r) * 1000 + c.code) as double) as code
from e, c group by e.event_id
"""

ORACLE["violation_counts"] = """
select event_type,
  count(*) filter (where not (t between -50 and 60)) as n_t_out,
  count(*) filter (where p < 0) as n_p_neg,
  count(*) filter (where p > 500) as n_p_high,
  count(*) filter (where h < 0 or h > 100) as n_h_out,
  round(min(t), 6) as min_t, round(max(t), 6) as max_t,
  round(min(p), 6) as min_p, round(max(p), 6) as max_p,
  round(min(h), 6) as min_h, round(max(h), 6) as max_h
from (select event_type, value - 100 as t, value * 1.2 - 20 as p, value / 3 - 10 as h from events)
group by 1
"""

ORACLE["nonnull_report"] = """
select event_type, count(*) as n_rows, count(m1) as nonnull_m1, count(m2) as nonnull_m2, count(m3) as nonnull_m3,
       count(*) filter (where coalesce(m1, m2, m3) is null) as all_null_rows
from (select event_type, case when value <= 400 then value end as m1,
             case when value <= 100 then value * 2 end as m2,
             case when hour(ts) >= 12 then value end as m3 from events)
group by 1
"""

_NEIGH = """
with b as (select event_id, user_id, ts, case when value <= 100 then value end as v from events),
p as (select *, row_number() over (partition by user_id order by ts, event_id) as pos from b),
q as (select *,
        last_value(v ignore nulls) over w1 as pv,
        last_value(case when v is not null then pos end ignore nulls) over w1 as pp,
        first_value(v ignore nulls) over w2 as nv,
        first_value(case when v is not null then pos end ignore nulls) over w2 as np
      from p
      window w1 as (partition by user_id order by ts, event_id rows between unbounded preceding and current row),
             w2 as (partition by user_id order by ts, event_id rows between current row and unbounded following))
"""

ORACLE["interpolate_linear"] = _NEIGH + """
select event_id, user_id,
       round(case when v is not null then v when pv is null then nv when nv is null then pv
                  else pv + (nv - pv) / (np - pp) * (pos - pp) end, 6) as v
from q
"""

ORACLE["ffill"] = _NEIGH + "select event_id, user_id, round(pv, 6) as v from q"

ORACLE["ffill_bfill"] = _NEIGH + "select event_id, user_id, round(coalesce(pv, nv), 6) as v from q"

ORACLE["daily_to_hourly"] = """
with d as (select user_id, cast(ts as date) as d, avg(value) as day_avg, count(*) as day_n from events group by 1, 2)
select e.user_id, e.ts, e.event_id, e.value, round(d.day_avg, 6) as day_avg, d.day_n,
       case when d.d is null then date '2024-01-31' else date '2024-02-01' end as extraction_date
from events e left join d on e.user_id = d.user_id and cast(e.ts as date) = d.d
"""

ORACLE["source_priority"] = """
with o as (select cast(o_orderdate as date) as date, sum(o_totalprice) as total, count(*) as n_orders from orders group by 1),
l as (select cast(l_shipdate as date) as date, sum(l_quantity) as quantity from lineitem group by 1)
select coalesce(o.date, l.date) as date, round(o.total, 4) as total, o.n_orders, round(l.quantity, 4) as quantity,
       case when l.date is not null then date '2024-01-02' else date '2024-01-01' end as extraction_date
from o full outer join l on o.date = l.date
"""

ORACLE["completeness_gaps"] = """
with b as (select min(cast(o_orderdate as date)) as s, max(cast(o_orderdate as date)) as e from orders),
x as (select cast(unnest(generate_series(cast(s as timestamp), cast(e as timestamp), interval 1 day)) as date) as missing_date from b)
select missing_date from x where missing_date not in (select cast(o_orderdate as date) from orders)
"""

ORACLE["year_batches"] = """
select cast(year(o_orderdate) as integer) as year, min(cast(o_orderdate as date)) as first_day,
       max(cast(o_orderdate as date)) as last_day
from orders group by 1
"""

ORACLE["partition_roundtrip"] = """
select o_orderkey, o_orderdate, o_totalprice, cast(year(o_orderdate) as integer) as year,
       cast(month(o_orderdate) as integer) as month, cast(day(o_orderdate) as integer) as day
from orders
"""

ORACLE["partition_scan"] = """
select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders
where year(o_orderdate) = 1997 and month(o_orderdate) = 6
"""

ORACLE["year_range_scan"] = """
select cast(year(o_orderdate) as integer) as year, count(*) as n_orders, round(sum(o_totalprice), 4) as revenue,
       count(distinct date_trunc('day', o_orderdate)) as n_days
from orders where year(o_orderdate) in (1996, 1997, 1998) group by 1
"""

ORACLE["align_schema"] = """
select ts as date_mesure, cast(null as date) as extraction_date, 'Sousse' as city_name,
       cast(35.8256 as double) as latitude, cast(10.6411 as double) as longitude,
       case when event_type in ('click', 'view') then value end as temperature_2m_mean,
       case when event_type in ('click', 'view') then null when event_type <> 'error' then value end as temperature_2m_max,
       cast(null as double) as temperature_2m_min,
       case when event_type not in ('click', 'view') then value end as precipitation_sum
from events
"""

ORACLE["upsert_latest"] = """
with cur as (select o_orderkey, o_totalprice as price, date '2024-01-01' as extraction_date, 0 as seq from orders),
inc as (select o_orderkey, o_totalprice + 100.0 as price,
               case o_orderkey % 3 when 0 then date '2023-12-01' when 1 then date '2024-01-02' else date '2024-01-03' end as extraction_date, 1 as seq
        from orders where o_orderstatus = 'F'
        union all
        select o_orderkey + 10000000, o_totalprice, date '2024-01-02', 1 from orders where o_orderstatus = 'O'),
u as (select * from cur union all select * from inc)
select o_orderkey, price, extraction_date from (
  select *, row_number() over (partition by o_orderkey order by seq desc) as rn from u)
where rn = 1
"""

ORACLE["upsert_versioned"] = """
with d as (select o_custkey, cast(o_orderdate as date) as target_date, sum(o_totalprice) as metric,
                  max(o_orderpriority) as prio, max(o_orderstatus) as status from orders group by 1, 2),
cur as (select o_custkey, target_date, date '2024-01-01' as extraction_date, round(metric, 4) as metric, 0 as seq from d),
inc as (select o_custkey, target_date, date '2024-01-02' as extraction_date,
               case when status <> 'P' then round(metric * 0.9, 4) end as metric, 1 as seq
        from d where prio = '1-URGENT'),
u as (select * from cur union all select * from inc where target_date is not null and metric is not null)
select o_custkey, target_date, extraction_date, metric from (
  select *, row_number() over (partition by o_custkey, target_date, extraction_date
                               order by extraction_date desc, seq desc) as rn from u)
where rn = 1
"""

ORACLE["upsert_partial"] = """
with o as (select o_custkey, cast(o_orderdate as date) as d from orders),
cur as (select o_custkey, count(*) as n_orders, min(d) as first_day, max(d) as last_day,
               'cust-' || cast(o_custkey as varchar) as name from o where d < date '1998-01-01' group by 1),
inc as (select o_custkey, count(*) as n_orders, min(d) as first_day, max(d) as last_day,
               'new-' || cast(o_custkey as varchar) as name from o where d >= date '1997-01-01' group by 1)
select coalesce(c.o_custkey, i.o_custkey) as o_custkey,
       case when i.o_custkey is not null then i.n_orders else c.n_orders end as n_orders,
       case when c.o_custkey is not null then c.first_day else i.first_day end as first_day,
       case when i.o_custkey is not null then i.last_day else c.last_day end as last_day,
       case when c.o_custkey is not null then c.name else i.name end as name,
       'new-' || cast(i.o_custkey as varchar) as label
from cur c full outer join inc i on c.o_custkey = i.o_custkey
"""

ORACLE["stream_upsert"] = """
select o_custkey, o_orderkey, o_orderdate, o_totalprice from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders)
where rn = 1
"""

ORACLE["get_or_create_keys"] = """
with cand as (select distinct name from (
        select coalesce(nullif(event_type, ''), 'unknown') as name from events
        union all select coalesce(nullif(r_name, ''), 'unknown') from region
        union all select n_name from nation)),
new as (select name from cand where name not in (select n_name from nation)),
m as (select max(n_nationkey) as mx from nation)
select n_nationkey as id, n_name as name from nation
union all
select cast(mx + row_number() over (order by name) as integer) as id, name from new, m
"""

ORACLE["price_unpivot"] = """
select l_orderkey, l_linenumber, 1991 as year, l_quantity as Value, l_linestatus as Flag from lineitem where l_returnflag = 'R'
union all
select l_orderkey, l_linenumber, 1992, l_discount, l_returnflag from lineitem where l_returnflag = 'R'
union all
select l_orderkey, l_linenumber, 1993, l_tax, case when l_tax > 0.04 then 'E' end from lineitem where l_returnflag = 'R'
"""

ORACLE["star_join"] = """
select r_name, n_name, count(*) as n_customers, round(sum(c_acctbal), 2) as acctbal
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by 1, 2
"""

ORACLE["param_sql"] = """
select n.n_name as n_name, count(*) as n, min(c.c_acctbal) as min_bal, max(c.c_acctbal) as max_bal,
       round(avg(c.c_acctbal), 6) as avg_bal, round(sum(c.c_acctbal), 2) as sum_bal
from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
where r.r_name ilike 'europe' and c.c_acctbal > 0
group by n.n_name
"""

ORACLE["soil_match"] = """
with p as (select p_partkey, string_split(concat_ws(' ', p_type, p_name), ' ') as soils from part),
r as (select l_orderkey, l_linenumber,
             case when l_linenumber = 1 then l_partkey + 1000000 else l_partkey end as plant,
             case when l_returnflag = 'R' then ' Small ' when l_returnflag = 'A' then 'ECONOMY' else 'red ' end as soil
      from lineitem),
j as (select r.*, p.p_partkey is not null as found, p.soils from r left join p on r.plant = p.p_partkey),
k as (select *, found and coalesce(list_contains(list_transform(soils, lambda x: lower(trim(x))), lower(trim(soil))), false) as ok,
             array_to_string(soils, ', ') as allowed from j)
select l_orderkey, l_linenumber, ok as compatible,
       case when not found then 'Aucune exigence de sol trouvée pour ' || cast(plant as varchar) || '.'
            when ok then 'Le sol ''' || soil || ''' est compatible avec ' || cast(plant as varchar) || '.'
            else 'Le sol ''' || soil || ''' n''est pas listé comme compatible avec ' || cast(plant as varchar)
                 || '. Sols compatibles: ' || case when allowed = '' then 'aucun' else allowed end || '.' end as message
from k
"""

ORACLE["text_search"] = """
select p_partkey, p_name, p_type from part
where contains(lower(p_name), 'red') or contains(lower(p_type), 'red')
order by p_partkey limit 10
"""

ORACLE["kc_range"] = """
with k as (select p_partkey,
                  case when p_size < 5 then 'n/a'
                       when p_size % 2 = 0 then cast(p_size as varchar) || '-' || cast(p_size + 5 as varchar)
                       else cast(p_size as varchar) end as kc_text from part),
l as (select *, try_cast(trim(split_part(kc_text, '-', 1)) as double) as kc_lo from k)
select p_partkey, kc_text, kc_lo from l where kc_lo between 10 and 30
"""

_KW = ["license", "token", "@", "und"]

ORACLE["keyword_search"] = "select doc_id, lang, source, n_chars from documents where " + " or ".join(
    f"contains(lower(coalesce({f}, '')), '{k}')" for f in ("text", "source") for k in _KW)

ORACLE["keyword_counts"] = ("select k as keyword, count(*) as n from documents, (values "
                            + ", ".join(f"('{k}')" for k in _KW)
                            + ") t(k) where contains(lower(text), k) group by k")

ORACLE["catalog_stats"] = """
(select 'source' as dim, source as value, count(*) as n from documents group by source order by n desc, value limit 20)
union all
(select 'lang' as dim, lang as value, count(*) as n from documents group by lang order by n desc, value limit 10)
union all
select 'summary' as dim, 'long_docs' as value, count(*) filter (where n_chars > 1000) as n from documents
"""

_UNITS = ["%", "mm", "cm", "kg", "ha", "m2", "m²", "jours", "semaines", "mois", "ans"]
_CAUTION = ["si", "sauf", "mais", "cependant", "en revanche", "selon", "probable", "risque", "incertain"]

ORACLE["text_flags"] = f"""
with a as (select doc_id, text, {_collapse('text')} as n from documents),
b as (select *, case when n = '' then []::varchar[] else string_split(n, ' ') end as w, lower(n) as low from a),
c as (select *, cast(len(w) as integer) as n_words,
             cast(case when n = '' then 0 else greatest(length(n) - length(translate(n, '.!?', '')), 1) end as integer) as n_sentences,
             cast(len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) as integer) as n_digit_tokens,
             {_hits('low', _UNITS)} as unit_hits,
             {_hits('low', _CAUTION)} as caution_hits
      from b),
d as (select *, n_digit_tokens >= 3 or unit_hits >= 2 or caution_hits >= 3 as dense, {_strip('text')} as s from c)
select doc_id, n_words, n_sentences, n_digit_tokens, unit_hits, caution_hits, dense,
       n <> '' and not dense and (n_sentences > 3 or n_words > 90) as too_long,
       md5(case when length(text) > 4000 then substr(text, 1, 4000) || '... [truncated]' else text end) as truncated_md5,
       md5(n) as collapsed_md5,
       case when starts_with(upper(s), 'FINAL:') then 'final' when starts_with(upper(s), 'CONTINUE:') then 'continue'
            else 'none' end as kind,
       md5({_after('text', '|')}) as after_bar_md5,
       md5(regexp_replace(n, '^(?:[a-pA-P]\\.|-)\\s+', '')) as unprefixed_md5
from d
"""

ORACLE["json_pack"] = """
select event_id, '{"user_id":' || cast(user_id as varchar) || ',"event_type":"' || event_type || '"'
       || coalesce(',"value":' || cast(case when value <= 100 then value end as varchar), '') || '}' as metrics
from events
"""

ORACLE["json_extract"] = """
select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events
"""

ORACLE["date_parts"] = """
select o_orderkey,
       cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m,
       cast(day(o_orderdate) as integer) as dd, cast(hour(o_orderdate) as integer) as h,
       cast(year(o_orderdate) * 100 + month(o_orderdate) as integer) as yyyymm,
       cast(o_orderdate as date) as parsed,
       timezone('UTC', cast(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00' as timestamptz)) as from_iso,
       cast(date_trunc('day', o_orderdate) as date) as day,
       cast(o_orderdate as date) - 2 as history_day,
       cast(cast(o_orderdate as date) - interval 30 year as date) as minus_30y,
       o_orderdate as roundtrip,
       case when cast(o_orderdate as date) + 7 <= date '2000-01-01' then 'archive' else 'forecast' end as src
from orders
"""

ORACLE["math_mix"] = """
select event_id, round(abs(value - 50), 6) as dist, round(sqrt(value), 6) as root,
       round_even(value * 2, 0) as half_even, round((value + user_id) / 2, 6) as mid,
       least(abs(value - 10), abs(value - 100)) as nearest
from events
"""

ORACLE["distinct_sorted"] = """
select user_id, count(*) as n_types, array_to_string(list_sort(list(event_type)), ',') as types
from (select distinct user_id, event_type from events) group by 1
"""

ORACLE["et0"] = """
with x as (select l_orderkey, l_linenumber, l_quantity / 2 as rs, l_discount * 500 + 30 as rh,
                  l_tax * 300 + 5 as tm, cast(dayofyear(l_shipdate) as integer) as doy,
                  cast(year(l_shipdate) as integer) as yr, l_linenumber * 0.5 as u2, l_linenumber * 10.0 as alt
           from lineitem),
a as (select *, tm - 5 as tn, tm + 6 as tx, 36.0 * (pi() / 180.0) as phi,
             case when (yr % 4 = 0 and yr % 100 <> 0) or yr % 400 = 0 then 366.0 else 365.0 end as nd from x),
b as (select *, (2 * pi()) * doy / nd as ang from a),
c as (select *, 1 + 0.033 * cos(ang) as dr, 0.409 * sin(ang - 1.39) as dl from b),
d as (select *, acos(-tan(phi) * tan(dl)) as ws from c),
e as (select *, (1440 / pi()) * 0.0820 * dr * (ws * sin(phi) * sin(dl) + cos(phi) * cos(dl) * sin(ws)) as ra,
             (0.6108 * exp((17.27 * tx) / (tx + 237.3)) + 0.6108 * exp((17.27 * tn) / (tn + 237.3))) / 2 as es,
             0.6108 * exp((17.27 * tm) / (tm + 237.3)) as esm,
             101.3 * pow((293 - 0.0065 * alt) / 293, 5.26) as press from d),
f as (select *, es * rh / 100 as ea, (0.75 + 2e-5 * alt) * ra as rso, 0.000665 * press as gamma from e),
g as (select *, case when rs / rso > 1.0 then 1.0 else rs / rso end as ratio from f),
h as (select *, 4.903e-9 * ((pow(tx + 273.15, 4) + pow(tn + 273.15, 4)) / 2) * (0.34 - 0.14 * sqrt(ea)) * (1.35 * ratio - 0.35) as rnl,
             0.77 * rs as rns, 4098 * esm / pow(tm + 237.3, 2) as delta from g)
select l_orderkey, l_linenumber,
       round((0.408 * (rns - rnl) + gamma * (900 / (tm + 273.15)) * ((es - ea) * u2)) / (delta + gamma * (1 + 0.34 * u2)), 5) as et0,
       round(ra, 5) as ra
from h
"""

_PIXELS = """
select l_orderkey, l_linenumber, l_returnflag,
       round(case when (l_tax * 100 + l_discount * 100) <> 0
                  then (l_tax * 100 - l_discount * 100) / (l_tax * 100 + l_discount * 100) end, 6) as ndvi,
       round(case when raw <> 0 then raw * 0.02 - 273.15 end, 4) as lst
from (select *, case when l_linenumber = 1 then 0.0 else l_extendedprice / 10 + 13000 end as raw from lineitem)
"""

ORACLE["pixel_index"] = f"select l_orderkey, l_linenumber, ndvi, lst from ({_PIXELS})"

ORACLE["pixel_mean"] = f"""
select l_returnflag, round(avg(ndvi), 6) as mean_ndvi, round(avg(lst), 4) as mean_lst from ({_PIXELS}) group by 1
"""

ORACLE["last_turns"] = f"""
with v as (select conv_id, turn, role,
                  case when role = 'user' then {_after('text', 'USER MESSAGE:')} else {_strip('text')} end as body,
                  coalesce(max(case when role = 'user' then turn end) over (partition by conv_id order by turn), -1) as inv,
                  max(case when role = 'user' then turn end) over (partition by conv_id) as cur
           from conversations where role in ('user', 'assistant')),
g as (select conv_id, inv,
             (max({{'t': turn, 'b': body}}) filter (where role = 'user' and body <> '')).b as u,
             (max({{'t': turn, 'b': body}}) filter (where role = 'assistant' and body <> '')).b as a
      from v where cur is null or inv <> cur group by conv_id, inv),
t as (select *, row_number() over (partition by conv_id order by inv desc) as rn from g where u is not null or a is not null),
r as (select *, cast(row_number() over (partition by conv_id order by inv) as varchar) as i from t where rn <= 6)
select conv_id, cast(count(*) as integer) as n_turns,
       'Conversation history from this same session:' || chr(10)
       || string_agg(concat_ws(chr(10), 'Turn ' || i || ' user: ' || u, 'Turn ' || i || ' assistant: ' || a), chr(10) order by inv) as history
from r group by conv_id
"""

_RETRY = ["retry", "try again", "again", "reessaye", "reessaie", "réessaye", "réessaie"]

ORACLE["retry_resolve"] = f"""
with u as (select conv_id, turn, text,
                  lower({_collapse(_after('text', 'USER MESSAGE:'))}) in ({", ".join(f"'{m}'" for m in _RETRY)}) as retry
           from conversations where role = 'user'),
c as (select *, case when not retry and {_strip('text')} <> '' then {_strip('text')} end as cand from u)
select conv_id, turn, retry,
       last_value(cand ignore nulls) over (partition by conv_id order by turn
                                           rows between unbounded preceding and 1 preceding) as previous_request
from c
"""


def _fill_ctes(src: str, part: str, order: str, cols, name: str) -> str:
    """CTEs ``{name}_p`` / ``{name}`` adding, per column c: __pv_c, __pp_c, __nv_c, __np_c and __pos."""
    nb = []
    for c in cols:
        nb += [f"last_value({c} ignore nulls) over wb as __pv_{c}",
               f"last_value(case when {c} is not null then __pos end ignore nulls) over wb as __pp_{c}",
               f"first_value({c} ignore nulls) over wf as __nv_{c}",
               f"first_value(case when {c} is not null then __pos end ignore nulls) over wf as __np_{c}"]
    return (f"{name}_p as (select *, row_number() over (partition by {part} order by {order}) as __pos from {src}),\n"
            f"{name} as (select *, {', '.join(nb)} from {name}_p\n"
            f"  window wb as (partition by {part} order by {order} rows between unbounded preceding and current row),\n"
            f"         wf as (partition by {part} order by {order} rows between current row and unbounded following))")


def _interp(c: str) -> str:
    return (f"case when {c} is not null then {c} when __pv_{c} is null then __nv_{c} when __nv_{c} is null then __pv_{c} "
            f"else __pv_{c} + (__nv_{c} - __pv_{c}) / (__np_{c} - __pp_{c}) * (__pos - __pp_{c}) end")


ORACLE["normalize_daily"] = f"""
with d as (select l_returnflag as location, cast(l_shipdate as date) as date,
                  avg(l_discount) * 1000 - 30 as m, max(l_tax) * 1000 - 20 as x, min(l_discount) * 1000 as n,
                  sum(l_quantity) - 100 as p from lineitem group by 1, 2),
s as (select location, date, m, p, case when n > x then x else n end as n2, case when n > x then n else x end as x2 from d),
r as (select location, date, p, n2, x2, case when m < n2 or m > x2 then (n2 + x2) / 2 else m end as m2 from s),
b as (select location, date, year(date) as yr, p,
             case when m2 between -50 and 60 then m2 end as tm,
             case when x2 between -50 and 60 then x2 end as tx,
             case when n2 between -50 and 60 then n2 end as tn from r),
{_fill_ctes("b", "location, yr", "date", ["tm", "tx", "tn"], "q")}
select location, date, round({_interp("tm")}, 6) as temperature_2m_mean,
       round({_interp("tx")}, 6) as temperature_2m_max, round({_interp("tn")}, 6) as temperature_2m_min,
       round(case when p < 0 or p > 500 then 0.0 else p end, 6) as precipitation_sum,
       date '2024-06-01' as extraction_date, 'openmeteo' as source
from q
"""

ORACLE["normalize_hourly"] = f"""
with b as (select user_id as location, ts as date, year(ts) as yr,
                  case when value * 2 + 850 between 870 and 1090 then value * 2 + 850 end as sp from events),
{_fill_ctes("b", "location, yr", "date", ["sp"], "q")}
select location, date, round(__pv_sp, 6) as surface_pressure, date '2024-06-01' as extraction_date,
       'openmeteo' as source
from q
"""

ORACLE["normalize_point_series"] = f"""
with l as (select user_id as location, cast(ts as date) as date, event_type, event_id,
                  case when value > 450 then -999.0
                       when event_type = 'click' then value - 40
                       when event_type = 'error' then value * 1.5 - 30
                       when event_type = 'signup' then value - 20
                       when event_type = 'view' then value / 10
                       else value end as v from events),
f as (select * from (select *, row_number() over (partition by location, date, event_type order by event_id) as rn from l)
      where rn = 1),
w as (select location, date,
             max(v) filter (where event_type = 'click') as t2m,
             max(v) filter (where event_type = 'error') as prec,
             max(v) filter (where event_type = 'purchase') as rh,
             max(v) filter (where event_type = 'signup') as ws,
             max(v) filter (where event_type = 'view') as asky,
             cast(null as double) as csky
      from f group by 1, 2),
s as (select location, date, year(date) as yr,
             case when t2m <> -999 and t2m between -50 and 60 then t2m end as t2m,
             case when prec <> -999 then prec end as prec, case when rh <> -999 then rh end as rh,
             case when ws <> -999 then ws end as ws, case when asky <> -999 then asky end as asky, csky from w),
{_fill_ctes("s", "location, yr", "date", ["t2m"], "q")},
c as (select location, date, {_interp("t2m")} as t2m,
             case when prec < 0 or prec > 500 then 0.0 else prec end as prec,
             case when rh < 0 then 0.0 when rh > 100 then 100.0 else rh end as rh,
             ws, case when asky > csky then csky else asky end as asky, csky from q)
select location, date, round(t2m, 6) as temperature_2m_mean, round(prec, 6) as precipitation_sum,
       round(rh, 6) as relative_humidity_2m, round(case when ws < 0 then 0.0 else ws end, 6) as wind_speed_2m,
       round(case when asky < 0 then 0.0 else asky end, 6) as all_sky_surface_shortwave_radiation_downward,
       round(case when csky < 0 then 0.0 else csky end, 6) as clear_sky_surface_shortwave_radiation_downward,
       date '2024-06-01' as extraction_date, 'nasapower' as source
from c
"""


def _planting_all_plants() -> str:
    from furrow.sources.reference import PLANT_ROWS
    parts = []
    for name, cmin, cmax, amin, amax, _pmin, _pmax, _soils, cycle, _cmax in PLANT_ROWS:
        qn = name.replace("'", "''")
        parts.append(f"""
select * from (
  select *, row_number() over (partition by location order by success_probability_pct desc,
                               weighted_successful_years desc, month, day) as rk from (
    select location, '{qn}' as nom_du_plante, cast(month(d) as integer) as month, cast(day(d) as integer) as day,
           count(*) as years_analyzed, round(sum(wt), 2) as weighted_years_analyzed,
           round(sum(ok * wt), 2) as weighted_successful_years,
           round(sum(ok * wt) / sum(wt) * 100, 1) as success_probability_pct,
           round(sum(tot * wt) / sum(wt), 1) as expected_rainfall_mm
    from (
      select location, d, tot,
             case when germ >= 5 and perf >= {cycle} * 0.4 and fat = 0 and tot <= 1500 then 1 else 0 end as ok,
             case when 2001 - year(d) <= 5 then 1.0 else 1.0 / sqrt(2001 - year(d)) end as wt
      from (
        select location, d,
               sum(p) over (partition by location order by d rows between current row and 6 following) as germ,
               sum(p) over c as perf, sum(x) over c as fat, sum(rain) over c as tot
        from (
          select location, d, case when a >= {cmin} and a <= {cmax} then 1 else 0 end as p,
                 case when mn < {amin} or mx > {amax} then 1 else 0 end as x, coalesce(rain, 0) as rain
          from r)
        window c as (partition by location order by d rows between current row and {cycle} following))
      where d <= date '2001-11-04' - {cycle})
    group by location, month(d), day(d) having count(*) >= 5))
where rk <= 30""")
    body = "\nunion all\n".join(parts)
    return f"""
with r as (select l_returnflag as location, cast(l_shipdate as date) as d, avg(t) as a, min(t) as mn, max(t) as mx,
                  sum(rain) as rain
           from (select l_returnflag, l_shipdate, 10.123456 + l_discount * 150 + l_tax * 100 as t,
                        l_quantity / 1000 as rain from lineitem)
           group by 1, 2)
select location, nom_du_plante, month, day, years_analyzed, weighted_years_analyzed, weighted_successful_years,
       success_probability_pct, expected_rainfall_mm
from ({body})
"""


ORACLE["planting_all_plants"] = _planting_all_plants()

ORACLE["normalize_forecast"] = f"""
with d as (select user_id as location, cast(ts as date) as date, (max(value) + min(value)) % 100 as wc,
                  max(value) / 5 - 20 as tx0, min(value) / 5 - 20 as tn0, sum(value) / 10 - 20 as p,
                  max(value) / 2 as w
           from events group by 1, 2),
b as (select location, date, year(date) as yr, round_even(wc, 0) as r, p, w,
             case when tx0 between -50 and 60 then tx0 end as tx,
             case when tn0 between -50 and 60 then tn0 end as tn from d),
{_fill_ctes("b", "location, yr", "date", ["tx", "tn"], "q")},
c as (select unnest([0, 1, 2, 3, 45, 48, 51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 71, 73, 75, 77, 80, 81, 82, 85,
                     86, 95, 96, 99]) as code),
s as (select q.location, q.date, cast(arg_min(c.code, abs(c.code - q.r) * 1000 + c.code) as double) as weather_code
      from q, c group by q.location, q.date)
select q.location, q.date, s.weather_code,
       round({_interp("tx")}, 6) as temperature_2m_max, round({_interp("tn")}, 6) as temperature_2m_min,
       round(case when p < 0 or p > 500 then 0.0 else p end, 6) as precipitation_sum,
       round(case when w < 0 then 0.0 when w > 150 then 150.0 else w end, 6) as wind_speed_10m_max,
       date '2024-06-01' as extraction_date, 'openmeteo' as source
from q join s on q.location = s.location and q.date = s.date
"""

ORACLE["point_series_wide"] = "select user_id, cast(ts as date) as date, " + ", ".join(
    f"round(sum(value) filter (where event_type = '{t}'), 6) as {t}"
    for t in ("click", "error", "purchase", "signup", "view")) + " from events group by 1, 2"

ORACLE["export_roundtrip"] = """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, true as json_same from orders
"""

ORACLE["csv_preamble"] = """
select o_orderkey, o_totalprice, cast(o_orderdate as date) as o_orderdate from orders
"""

ORACLE["catalog_prefix"] = """
select doc_id, upper(lang) || '-' || source as id, lang from documents
where starts_with(upper(lang) || '-' || source, 'EN-src1')
"""

ORACLE["context_block"] = """
with f as (
  select c_custkey,
         case when c_mktsegment <> 'BUILDING' then c_mktsegment end as g,
         case when c_acctbal > 0 then round(c_acctbal, 0) end as fs,
         case when c_acctbal > 5000 then 'ha' else '' end as fu,
         case when c_acctbal > -500 then n_name end as st
  from customer left join nation on c_nationkey = n_nationkey)
select c_custkey,
       case when coalesce(g, '') <> '' or fs is not null or coalesce(fu, '') <> '' or coalesce(st, '') <> ''
            then 'FARM CONTEXT:' || chr(10) || '- governorate: ' || (case when coalesce(g, '') <> '' then g else 'unknown' end)
                 || chr(10) || '- farm_size: ' || coalesce(cast(fs as varchar), 'null')
                 || chr(10) || '- farm_size_unit: ' || (case when coalesce(fu, '') <> '' then fu else 'unknown' end)
                 || chr(10) || '- soil_type: ' || (case when coalesce(st, '') <> '' then st else 'unknown' end)
       end as context
from f
"""

ORACLE["html_tables"] = """
with p as (select cast(floor(p_partkey / 50) as bigint) as page_id, cast(floor(p_size / 10) as integer) as cat,
                  p_partkey, p_name, p_name || case when p_partkey % 5 = 0 then ' & Co.' else '' end as name,
                  p_size, p_retailprice from part)
select page_id, 'Size ' || cast(cat * 10 as varchar) as category, name as crop, cast(null as varchar) as variant,
       cast(p_size as varchar) as value_1, case when p_partkey % 11 <> 0 then cast(p_retailprice as varchar) end as value_2
from p
union all
select page_id, 'Size ' || cast(cat * 10 as varchar), name, 'variant ' || cast(p_partkey as varchar),
       cast(p_size + 1 as varchar), cast(p_retailprice as varchar)
from p where starts_with(p_name, 'red')
union all
select distinct page_id, 'Size ' || cast(cat * 10 as varchar), 'Size ' || cast(cat * 10 as varchar), cast(null as varchar),
       cast(cat * 10 as varchar), cast(null as varchar)
from p where cat % 2 = 1
"""

ORACLE["catalog_xml"] = f"""
select case when lang <> 'es' then 'D' || cast(doc_id as varchar) else 'Unknown' end as id,
       'Document ' || cast(doc_id as varchar) as title,
       source as creator, {_collapse(r"regexp_replace(text, '[\x00-\x1F\x{FFFE}\x{FFFF}]', ' ', 'g')")} as description, lang || ',' || source as subjects,
       case when lang <> 'de' then 'http://data.example/' || cast(doc_id as varchar) end as download_url
from documents
"""

from furrow.plans import lifecycle as _lifecycle  # noqa: E402
from furrow.plans import loads as _loads  # noqa: E402

ORACLE |= _lifecycle.ORACLE | _loads.ORACLE
