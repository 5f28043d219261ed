"""The registered queries of the operators and their SQL twins, over whole tables of the driver's data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import calendar, stats, text
from tarnwork.functions.quantiles import exact_quantiles
from tarnwork.operators import guards, models, quality, relational, splits, timeseries
from tarnwork.operators.guards import one_to_one
from tarnwork.operators.vision import bounding_box
from tarnwork.plans import pipeline
from tarnwork.sources import readers, rest, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clicks_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return clicks, events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))


# --- time series ---------------------------------------------------------------------------------------------------------


@query("""
with c as (select event_id, user_id, ts from events where event_type = 'click'),
v as (select user_id, ts as view_ts, value as view_value from events where event_type = 'view'),
p as (select c.*, v.view_ts as pt, v.view_value as pv from c asof left join v on c.user_id = v.user_id and c.ts >= v.view_ts),
n as (select c.event_id, v.view_ts as nt, v.view_value as nv from c asof left join v on c.user_id = v.user_id and c.ts <= v.view_ts),
g as (select p.*, n.nt, n.nv, case when epoch_us(ts) - epoch_us(pt) <= 36000000000 then epoch_us(ts) - epoch_us(pt) end as gp,
    case when epoch_us(nt) - epoch_us(ts) <= 36000000000 then epoch_us(nt) - epoch_us(ts) end as gn from p join n using (event_id))
select event_id, user_id, ts, case when gp is not null and (gn is null or gp <= gn) then pt when gn is not null then nt end as matched_time,
    case when gp is not null and (gn is null or gp <= gn) then pv when gn is not null then nv end as view_value from g
""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, views = clicks_views(spark, sf_dir)
    return timeseries.asof_nearest(clicks, views, ["user_id"], "ts", "view_ts", ["view_value"], 600.0)


INTERPOLATED = """
with c as (select event_id, user_id, ts from events where event_type = 'click'),
v as (select user_id, ts as view_ts, value as view_value from events where event_type = 'view'),
p as (select c.*, v.view_ts as pt, v.view_value as pv from c asof left join v on c.user_id = v.user_id and c.ts > v.view_ts),
n as (select c.event_id, v.view_ts as nt, v.view_value as nv from c asof left join v on c.user_id = v.user_id and c.ts <= v.view_ts),
g as (select p.*, n.nt, n.nv, coalesce((epoch_us(ts) - epoch_us(pt)) / 6e7::double, 'inf'::double) as gap_prev_min,
    coalesce((epoch_us(nt) - epoch_us(ts)) / 6e7::double, 'inf'::double) as gap_next_min from p join n using (event_id)),
r as (select event_id, user_id, ts,
    case when gap_next_min = 0 then nv when pt is not null and nt is not null then pv + (nv - pv) * gap_prev_min / (gap_prev_min + gap_next_min) end as view_value,
    case when gap_prev_min <= gap_next_min then pt else nt end as nearest_time, gap_prev_min, gap_next_min,
    least(gap_prev_min, gap_next_min) <= 90 as valid_interpolation from g)
"""


@query(INTERPOLATED + "select * from r")
def interpolate_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, views = clicks_views(spark, sf_dir)
    return timeseries.interpolate_at(clicks, views, ["user_id"], "ts", "view_ts", "view_value", 90.0)


@query(INTERPOLATED + "select * from r")
def interpolate_at_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with readings dealt by user and day, as for keys with very many rows."""
    clicks, views = clicks_views(spark, sf_dir)
    return timeseries.interpolate_at(clicks, views, ["user_id"], "ts", "view_ts", "view_value", 90.0, slice_seconds=86400)


@query(INTERPOLATED + "select * from r where valid_interpolation")
def valid_match_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.valid_matches(interpolate_at(spark, sf_dir))


@query(INTERPOLATED + """select event_id, user_id, ts, view_value, gap_prev_min, gap_next_min, valid_interpolation, ts as hydro_time,
    coalesce(strftime(nearest_time, '%Y-%m-%dT%H:%M:%SZ'), '') as nearest_obs_time from r""")
def align_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, views = clicks_views(spark, sf_dir)
    return timeseries.align_images(clicks, views, ["user_id"], 90.0, "ts", "view_ts", "view_value")


TYPES = ("click", "error", "purchase", "signup", "view")


@query("select user_id, ts::date as day, " + ", ".join(f'arg_max(value, (ts, event_id)) filter (where event_type = \'{t}\') as "{t}"' for t in TYPES) + " from events where value is not null group by all")
def pivot_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return timeseries.pivot_last(events, ["user_id", "day"], "event_type", "value", ["ts", "event_id"], list(TYPES))


@query("select * from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@query("select user_id, min(ts) - interval 2 days as start, max(ts) + interval 2 days as \"end\" from events group by 1")
def request_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.request_window(table(spark, sf_dir, "events"), ["user_id"], "ts", 2)


@query("select ts as time from events union select o_orderdate from orders")
def time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.time_axis((table(spark, sf_dir, "events"), "ts"), (table(spark, sf_dir, "orders"), "o_orderdate"))


# --- calendars and texts -------------------------------------------------------------------------------------------------

WY = "year(o_orderdate) + (month(o_orderdate) >= 10)::int"


@query(f"""
with o as (select *, {WY} as water_year, ((month(o_orderdate) + 2) % 12) + 1 as m from orders)
select water_year, count(*) as n_images, array_to_string(list_transform(list_sort(list(distinct m)), lambda x: x::varchar), '|') as months_present,
    count(distinct m) as n_months_present, count(distinct m) = 12 and count(*) >= 1 as is_complete_water_year, min(o_orderdate) as image_time_min, max(o_orderdate) as image_time_max
from o group by 1
""")
def water_year_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.water_year_summary(table(spark, sf_dir, "orders"), [], "o_orderdate")


@query(f"""
select o_orderkey, {WY} as water_year, ((month(o_orderdate) + 2) % 12) + 1 as water_month, (month(o_orderdate) % 12) // 3 + 1 as met_season,
    case when month(o_orderdate) in (10, 11, 12) then 'fall' when month(o_orderdate) in (1, 2, 3) then 'winter' when month(o_orderdate) in (4, 5, 6) then 'spring' else 'summer' end as season,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') || '.jpg' as image_name, date_trunc('month', o_orderdate)::timestamp as month_start
from orders
""")
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", calendar.water_year(d).alias("water_year"), calendar.water_month(d).alias("water_month"), calendar.met_season(F.month(d)).alias("met_season"), calendar.hydro_season(F.month(d)).alias("season"),
        calendar.iso_z(d).alias("iso"), calendar.local_image_name(d).alias("image_name"), calendar.month_floor(calendar.iso_z(d)).alias("month_start"),
    )


@query("""
with u as (select user_id, date_trunc('month', min(ts))::timestamp as lo, max(ts) + interval 31 days as hi from events group by 1),
w as (select user_id, unnest(generate_series(lo, hi, interval 1 month)) as start from u)
select user_id, start, start + interval 1 month as "end" from w
""")
def month_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return users.select("user_id", F.explode(calendar.month_windows(F.col("lo"), F.col("hi"))).alias("w")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"))


@query("""
with e as (select event_id, ts, case user_id % 3 when 0 then 'America/New_York' when 1 then 'America/Chicago' end as zone, case user_id % 3 when 0 then 8.0 else 9.0 end as a, case user_id % 3 when 0 then 18.5 else 18.0 end as b, user_id % 3 as s from events),
l as (select *, timezone(zone, timezone('UTC', ts)) as t from e),
h as (select event_id, hour(t) + minute(t) / 60.0::double + floor(second(t)) / 3600.0::double as quality_local_hour, month(t) as quality_local_month,
    case when s = 2 then 8.0 else a end::double as quality_day_start_hour, case when s = 2 then 18.0 else b end::double as quality_day_end_hour from l)
select event_id, round(quality_local_hour, 9) as quality_local_hour, quality_local_month, quality_day_start_hour, quality_day_end_hour,
    coalesce(quality_local_hour < quality_day_start_hour or quality_local_hour >= quality_day_end_hour, false) as flag_time_night from h
""")
def local_hour_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = spark.createDataFrame([("0", "America/New_York", 8.0, 18.5), ("1", "America/Chicago", 9.0, 18.0)], "site string, zone string, day_start double, day_end double")
    events = table(spark, sf_dir, "events").withColumn("site_id", (F.col("user_id") % 3).cast("string"))
    out = calendar.with_local_clock(events, zones, "site_id", "ts").withColumn("flag_time_night", quality.time_night(quality.limits()))
    return out.select("event_id", F.round("quality_local_hour", 9).alias("quality_local_hour"), "quality_local_month", "quality_day_start_hour", "quality_day_end_hour", "flag_time_night")


@query("""
select page_id, regexp_replace(regexp_replace(regexp_replace(url, '[:/ ]', '-', 'g'), '[^\\p{L}\\p{N}_.-]', '', 'g'), '^-+|-+$', '', 'g') as token, regexp_replace(url, '[^\\p{L}\\p{N}_.-]', '_', 'g') as id,
    list_last(string_split(url, '/')) as name from pages
""")
def safe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.safe_token(u).alias("token"), text.safe_id(u).alias("id"), text.basename(u).alias("name"))


@query("""
with s as (select s_suppkey, case s_suppkey % 4 when 0 then s_suppkey::varchar when 1 then s_suppkey || '.0' when 2 then ' 0131' || s_suppkey || ' ' else s_name end as raw from supplier),
t as (select *, regexp_replace(trim(raw), '\\.0$', '') as x from s)
select s_suppkey, case when regexp_full_match(x, '\\d{1,7}') then lpad(x, 8, '0') else x end as site_id from t
""")
def site_id_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".0"))).when(k % 4 == 2, F.concat(F.lit(" 0131"), k.cast("string"), F.lit(" "))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.normal_site_id(raw).alias("site_id"))


@query("""
select event_id, case when event_id % 5 = 0 then null else date_trunc('second', ts) end as camera_time, date_trunc('second', ts) as stamped_time from events
""")
def parse_filename_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", calendar.STAMP)
    name = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("cam_"), stamp, F.lit(".png"))).otherwise(F.concat(F.lit("cam___"), stamp, F.lit("Z.jpg")))
    return table(spark, sf_dir, "events").select("event_id", calendar.camera_time(name).alias("camera_time"), calendar.stamped_time(name).alias("stamped_time"))


@query("select user_id::varchar as cam_id, date_trunc('second', ts) as timestamp_utc, 'c___' || strftime(ts, '%Y-%m-%dT%H-%M-%S') || 'Z.jpg' as source_filename, "
       "'s3://x/' || user_id || '/c___' || strftime(ts, '%Y-%m-%dT%H-%M-%S') || 'Z.jpg' as url from events group by all")  # fmt: skip
def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as JSON, in three shapes, read back as image rows."""
    name = F.concat(F.lit("dir/c___"), F.date_format("ts", calendar.STAMP), F.lit("Z.jpg"))
    item = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(name.alias("key")))).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    lists = table(spark, sf_dir, "events").select("user_id", item.alias("item")).groupBy(F.col("user_id").cast("string").alias("key"), (F.col("user_id") % 3).alias("shape"))
    whole = lists.agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit(', "notes.txt", {"x": 1}]')).alias("list"))
    shaped = F.when(F.col("shape") == 0, F.col("list")).when(F.col("shape") == 1, F.concat(F.lit('{"items": '), "list", F.lit("}"))).otherwise(F.concat(F.lit('{"items": [], "value": '), "list", F.lit("}")))
    return rest.listed_images(whole.select("key", shaped.alias("payload")), "s3://x/")


@query("""
select ts::timestamp as datetime_utc, 'S' || user_id as site_no, '00060' as variable_cd, 'flow' as variable_name, 'ft3/s' as unit, value, 'P,Provisional' as qualifiers, 'm' as method, 'test' as source
from (select date_trunc('second', ts) as ts, user_id, value from events where event_type = 'view')
""")
def gauge_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings nested as a gauge service sends them, flattened again."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    point = F.struct(F.date_format("ts", calendar.ISO).alias("dateTime"), F.col("value").cast("string").alias("value"))
    block = views.groupBy("user_id").agg(F.to_json(F.collect_list(point)).alias("v"))
    payload = F.concat(
        F.lit('{"value":{"timeSeries":[{"variable":{"variableCode":[{"value":"00060"}],"variableName":"flow","unit":{"unitCode":"ft3/s"}},"sourceInfo":{"siteCode":[{"value":"S'), F.col("user_id").cast("string"),
        F.lit('"}]},"values":[{"qualifier":["P",{"qualifierDescription":"Provisional"},{"x":1}],"method":[{"methodDescription":"m"}],"value":'), "v", F.lit("}]}]}}"),
    )
    return rest.gauge_readings(block.select(F.lit("k").alias("key"), payload.alias("payload")), "test")


# --- relational ----------------------------------------------------------------------------------------------------------


def urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")


@query("select event_type, count(*) as n from events group by 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("select user_id, array_to_string(list_sort(list(distinct event_type)), '|') as joined from events group by 1")
def distinct_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct_joined(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""
select c_custkey, n, n is not null as matched from customer left join (select o_custkey, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1) o on c_custkey = o_custkey
""")
def matched_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = urgent(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    joined = one_to_one(table(spark, sf_dir, "customer").select("c_custkey"), n, ["c_custkey"])
    yes, no = relational.matched_unmatched(joined, "n")
    return yes.withColumn("matched", F.lit(True)).unionByName(no.withColumn("matched", F.lit(False)))


@query("""
select 'img' || c_custkey || '.jpg' as image_path, case when c_custkey % 3 = 0 then 'quality_filter' else 'not_in_kept_matched' end as reason, case when c_custkey % 3 = 0 then 'dark' else '' end as quality_reasons
from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')
""")
def quarantine_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    def path(c: str):
        return F.concat(F.lit("img"), F.col(c).cast("string"), F.lit(".jpg")).alias("image_path")

    files = table(spark, sf_dir, "customer").select(path("c_custkey"))
    kept = urgent(spark, sf_dir).select(path("o_custkey"))
    audit = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(path("c_custkey"), F.lit(False).alias("quality_keep"), F.lit("dark").alias("quality_reasons"))
    return relational.quarantine(files, kept, audit)


@query("select n_nationkey, p_path, case when k = 0 then name else regexp_replace(name, '\\.jpg$', '') || '__filtered_' || k || '.jpg' end as target from (select n_nationkey, 'd' || n_nationkey || '/' || name as p_path, name, "
       "row_number() over (partition by name order by 'd' || n_nationkey || '/' || name) - 1 as k from (select n_nationkey, n_regionkey || '.jpg' as name from nation))")  # fmt: skip
def quarantine_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("d"), F.col("n_nationkey").cast("string"), F.lit("/"), F.col("n_regionkey").cast("string"), F.lit(".jpg"))
    return relational.quarantine_names(table(spark, sf_dir, "nation").select("n_nationkey", path.alias("p_path")), "p_path")


TASKS = "select n_name as site_id, v as variant, row_number() over (order by n_name, v) - 1 as task_index from nation, (values ('p05'), ('p50'), ('p95')) t(v)"


@query(TASKS)
def cross_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "nation").select(F.col("n_name").alias("site_id"))
    return relational.task_indexed(relational.cross_tasks(sites, ["p05", "p50", "p95"]), "site_id", "variant")


@query(f"select site_id, variant from ({TASKS}) where task_index = 7")
def task_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.pick_task(cross_tasks(spark, sf_dir).drop("task_index"), 7, "site_id", "variant")


@query("select c_nationkey, c_mktsegment, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal desc, c_custkey) = 1")
def best_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")
    return relational.best_per(customers, ["c_nationkey", "c_mktsegment"], "c_acctbal", ["c_custkey"])


@query("select c_nationkey, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) <= 3")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_k(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], F.col("c_acctbal"), 3, ["c_custkey"])


@query("""
with b as (select o_custkey, o_orderkey, o_totalprice, max(o_totalprice) over (partition by o_custkey order by o_orderkey) as best_so_far from orders)
select *, o_orderkey - max(case when o_totalprice >= best_so_far then o_orderkey end) over (partition by o_custkey order by o_orderkey) as epochs_since_best from b
""")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.running_best(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.difference(table(spark, sf_dir, "customer").select("c_custkey"), urgent(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""
with p as (select l_orderkey, l_linenumber, l_extendedprice / 100 as x, l_quantity as y from lineitem)
select l_orderkey, l_linenumber, greatest(0, floor(least(x, y)))::int as x1, greatest(0, floor(y))::int as y1, least(640, ceil(greatest(x, y)))::int as x2, least(480, ceil(greatest(y, y + 7)))::int as y2 from p
""")
def roi_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_extendedprice") / 100, F.col("l_quantity")
    box = bounding_box(F.array(F.struct(x.alias("x"), y.alias("y")), F.struct(y.alias("x"), (y + 7).alias("y"))), F.lit(640), F.lit(480))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


# --- splits and selection ------------------------------------------------------------------------------------------------

HASH = "md5('{seed}|' || {parts})"


def holdout_sql(source: str, strata: str, parts: str, key: str, ratio: str, seed: int = 42) -> str:
    n = f"count(*) over (partition by {strata})"
    size = f"case when {n} <= 1 then 0 else least({n} - 1, greatest(1, round_even({n} * {ratio}, 0)::bigint)) end"
    return f"select *, row_number() over (partition by {strata} order by {HASH.format(seed=seed, parts=parts)}, {key}) <= {size} as is_val from {source}"


@query("with o as (select o_orderkey, c_nationkey, case when month(o_orderdate) in (10, 11, 12) then 'fall' when month(o_orderdate) in (1, 2, 3) then 'winter' when month(o_orderdate) in (4, 5, 6) then 'spring' else 'summer' end as season "
       "from orders join customer on o_custkey = c_custkey) " + holdout_sql("o", "c_nationkey, season", "c_nationkey || '|' || season || '|' || o_orderkey", "o_orderkey", "0.2::double"))  # fmt: skip
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").join(customers, "o_custkey").select("o_orderkey", "c_nationkey", calendar.hydro_season(F.month("o_orderdate")).alias("season"))
    return splits.stratified_holdout(orders, ["c_nationkey", "season"], "o_orderkey", 0.2)


YEARS = f"""
with o as (select o_orderkey, o_orderpriority, o_orderdate, {WY} as water_year, ((month(o_orderdate) + 2) % 12) + 1 as m,
    case when month(o_orderdate) in (10, 11, 12) then 'fall' when month(o_orderdate) in (1, 2, 3) then 'winter' when month(o_orderdate) in (4, 5, 6) then 'spring' else 'summer' end as season from orders),
y as (select o_orderpriority, water_year, count(*) as n, count(distinct m) as months from o group by all),
"""


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")


@query(YEARS + """p as (select o_orderpriority, max(water_year) filter (where water_year < 2001 and months >= 10) as v from y group by 1)
select o.o_orderkey, o.o_orderpriority, o.o_orderdate, o.water_year, case when o.water_year = 2001 then 'test' when y.months < 10 then 'unused' when o.water_year = p.v then 'val' else 'train' end as split
from o join y using (o_orderpriority, water_year) join p using (o_orderpriority) where o.water_year <= 2001""")
def rough_year_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.rough_year_split(orders_of(spark, sf_dir), ["o_orderpriority"], "o_orderdate", "o_orderkey", 2001)


@query(YEARS + "q as (select * from o where water_year < 2001), s as (" + holdout_sql("q", "o_orderpriority, season", "o_orderpriority || '|' || season || '|' || o_orderkey", "o_orderkey", "0.2::double", 7) + ") "
       "select o_orderkey, o_orderpriority, o_orderdate, water_year, case when is_val then 'val' else 'train' end as split from s "
       "union all select o_orderkey, o_orderpriority, o_orderdate, water_year, 'test' from o where water_year = 2001")  # fmt: skip
def season_fallback_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No year before the test year has 13 months, so a share of each season is held out."""
    return splits.rough_year_split(orders_of(spark, sf_dir), ["o_orderpriority"], "o_orderdate", "o_orderkey", 2001, least_months=13, seed=7)


@query(YEARS + """f as (select * from y where months = 12 and water_year <= 2000), p as (select o_orderpriority, max(water_year) filter (where water_year < 2000) as v from f group by 1 having max(water_year) = 2000 and count(*) > 1)
select o.o_orderkey, o.o_orderpriority, o.o_orderdate, o.water_year, case when o.water_year = 2000 then 'test' when o.water_year = p.v then 'val' else 'train' end as split
from o join f using (o_orderpriority, water_year) join p using (o_orderpriority)""")
def strict_year_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.strict_year_split(orders_of(spark, sf_dir), ["o_orderpriority"], "o_orderdate", "o_orderkey", 2000)


@query("""select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= greatest(1, ceil(count(*) over (partition by o_custkey) * 0.2::double)) as is_val from orders""")
def tail_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.tail_holdout(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", 0.2).select("o_orderkey", "o_custkey", "is_val")


@query("select o_orderkey, case when (('0x' || substr(md5('3|' || o_orderkey), 1, 8))::bigint / 4294967296::double) < 0.25 then 'val' else 'train' end as split from orders")
def random_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_holdout(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.25, 3)


REFERENCES = """
with q as (select o_orderpriority, unnest([{'variant': 'p05', 'quantile': 0.05::double}, {'variant': 'p50', 'quantile': 0.5::double}, {'variant': 'p95', 'quantile': 0.95::double}]) as v,
    unnest(quantile_cont(o_totalprice, [0.05, 0.5, 0.95])) as target from orders group by 1)
select o_orderpriority, v.variant as variant, v.quantile as quantile, round(target, 6) as target, o_orderkey, o_orderdate, o_totalprice from q join orders using (o_orderpriority)
qualify row_number() over (partition by o_orderpriority, v.variant order by abs(o_totalprice - q.target), o_orderdate, o_orderkey) = 1
"""


@query(REFERENCES)
def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate", "o_totalprice")
    out = splits.nearest_to_quantiles(orders, ["o_orderpriority"], "o_totalprice", ["o_orderdate", "o_orderkey"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return out.withColumn("target", F.round("target", 6))


@query(f"""with r as ({REFERENCES}) select o_orderkey, variant, o_orderpriority || '_' || variant || '__target_' || round(target, 3)::varchar || '__actual_' || round(o_totalprice, 3)::varchar || '__' ||
    strftime(o_orderdate, '%Y-%m-%dT%H-%M-%SZ') || '.jpg' as reference_name, o_orderpriority || '_' || variant || '.json' as roi_name from r""")
def reference_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reference_rows(spark, sf_dir).withColumns({"image_path": F.concat(F.lit("a/"), F.col("o_orderkey").cast("string"), F.lit(".JPG")), "image_time": calendar.iso_z(F.col("o_orderdate"))})
    return sinks.reference_names(out, "o_orderpriority", "o_totalprice").select("o_orderkey", "variant", "reference_name", "roi_name")


# --- quality -------------------------------------------------------------------------------------------------------------


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as images with metrics; every seventh line lacks them."""
    q, x, d, t, n = (F.col(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax", "linenumber"))
    known = n != 7
    values = {
        "gray_mean": q * 4, "gray_std": d * 700, "entropy": t, "lap_var": x / 50, "grayscale_score": t, "colorfulness": t * 400, "brightness_peak_v": d * 10, "bright_low_sat_ratio": t * 2,
        "glare_very_bright_low_sat_ratio": d * 2, "glare_saturated_ratio": t * 3, "snow_white_low_sat_ratio": d * 5, "snow_bright_loose_ratio": t * 10, "snow_cool_bright_ratio": d * 8,
        "snow_blue_dominant_ratio": t * 12, "gray_ice_low_sat_ratio": d * 7, "raindrop_blob_count": n.cast("double") * 2, "raindrop_blob_area_ratio": d / 10, "raindrop_circularity_mean": t,
    }
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *[F.when(known, v).alias(k) for k, v in values.items()], known.alias("read_ok"), (q % 24).alias("quality_local_hour"), F.month("l_shipdate").alias("quality_local_month"))
    return out.withColumns({"quality_day_start_hour": F.lit(8.0), "quality_day_end_hour": F.lit(18.0)})


MEASURED = """
with i as (select l_orderkey, l_linenumber, l_returnflag, l_linenumber <> 7 as ok, l_quantity * 4 as mean, l_discount * 700 as std, l_extendedprice / 50 as lap, l_tax as score, l_tax * 400 as colour, l_discount * 10 as peak,
    l_tax * 2 as bright, l_discount * 2 as glare, l_tax * 3 as sat, l_discount * 5 as white, l_tax * 10 as loose, l_discount * 8 as cool, l_tax * 12 as blue, l_discount * 7 as ice, l_linenumber::double * 2 as blobs, l_discount / 10 as area,
    l_quantity % 24 as hour, month(l_shipdate) as month from lineitem),
m as (select l_orderkey, l_linenumber, l_returnflag, ok, hour < 8 or hour >= 18 as tn, hour, month, """ + ", ".join(f"case when ok then {c} end as {c}" for c in "mean std lap score colour peak bright glare sat white loose cool blue ice blobs area".split()) + """ from i),
c as (select *, coalesce(ok and score >= 0.02 and not tn and not (coalesce(mean, 0) < 75 and coalesce(peak, 0) < 0.42), false) as clean from m),
t as (select l_returnflag, greatest(85::double, quantile_cont(mean, 0.05) filter (where clean) * 0.9::double) as dark_threshold, greatest(26::double, quantile_cont(std, 0.05) filter (where clean) * 0.75::double) as contrast_threshold,
    greatest(250::double, quantile_cont(lap, 0.10) filter (where clean) * 0.65::double) as blur_threshold, greatest(7::double, least(10::double, quantile_cont(colour, 0.10) filter (where clean))) as low_colorfulness_threshold,
    greatest(32::double, greatest(26::double, quantile_cont(std, 0.05) filter (where clean) * 0.75::double) * 1.05::double) as fog_contrast_threshold,
    greatest(35::double, greatest(26::double, quantile_cont(std, 0.05) filter (where clean) * 0.75::double) * 1.10::double) as wet_lens_contrast_threshold from c group by 1)
"""


@query(MEASURED + "select l_returnflag, round(dark_threshold, 6) as dark_threshold, round(contrast_threshold, 6) as contrast_threshold, round(blur_threshold, 6) as blur_threshold, round(low_colorfulness_threshold, 6) as low_colorfulness_threshold, "
       "round(fog_contrast_threshold, 6) as fog_contrast_threshold, round(wet_lens_contrast_threshold, 6) as wet_lens_contrast_threshold from t")  # fmt: skip
def adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = quality.limits()
    out = quality.thresholds(measured(spark, sf_dir).withColumn("flag_time_night", quality.time_night(c)), ["l_returnflag"], c)
    return out.select("l_returnflag", *[F.round(x, 6).alias(x) for x in out.columns if x != "l_returnflag"])


@query(MEASURED + """,
z as (select *, coalesce(mean, 0) as mean0, coalesce(std, 0) as std0, coalesce(std, 'inf'::double) as stdi, coalesce(colour, 0) as colour0, coalesce(colour, 'inf'::double) as colouri, coalesce(peak, 0) as peak0, coalesce(bright, 0) as bright0,
    coalesce(area, 0) as area0, coalesce(blobs, 0) as blobs0 from c join t using (l_returnflag)),
f as (select *, not ok as unreadable, coalesce(score, 0) < 0.02 as pixel_night, mean0 < 75 and peak0 < 0.42 as dark_night, mean0 < dark_threshold as dark, mean0 < 55 as severe_dark, std0 < contrast_threshold as low_contrast,
    coalesce(lap, 0) < blur_threshold as blurry, coalesce(lap, 0) < 160 as severe_blurry, colour0 < low_colorfulness_threshold as low_colour,
    peak0 > 0.60 and blobs0 >= 6 and area0 >= 0.0008 and area0 <= 0.06 and bright0 >= 0.0015 as rain,
    blobs0 >= 6 and area0 >= 0.0008 and bright0 >= 0.0015 and (peak0 > 0.60 or stdi < wet_lens_contrast_threshold) as wet, mean0 >= 60 and stdi < fog_contrast_threshold and colouri < 14 as fog,
    bright0 >= 0.10 and stdi < 42 and colouri < 18 as obscured, (coalesce(glare, 0) >= 0.16 and peak0 >= 0.88) or (coalesce(sat, 0) >= 0.15 and bright0 >= 0.16) as glared,
    month in (11, 12, 1, 2, 3, 4) and ((coalesce(white, 0) >= 0.30 and mean0 >= 105 and colouri <= 22) or (coalesce(white, 0) >= 0.25 and mean0 >= 105 and colouri <= 28) or (coalesce(loose, 0) >= 0.65 and mean0 >= 90 and stdi <= 35)
        or (coalesce(cool, 0) >= 0.55 and mean0 >= 95 and stdi <= 42) or (coalesce(blue, 0) >= 0.85 and mean0 >= 80 and stdi <= 40) or (coalesce(ice, 0) >= 0.55 and mean0 >= 95 and stdi <= 38 and colouri <= 35)) as snow from z),
s as (select *, dark::int + low_contrast::int + blurry::int + low_colour::int + rain::int + wet::int + fog::int + obscured::int + glared::int + snow::int as soft_flag_count from f),
r as (select *, concat_ws('|', case when unreadable then 'unreadable' end, case when tn then 'local_night_time' end, case when pixel_night then 'night_or_near_grayscale' end, case when dark_night then 'night_dark_scene' end,
    case when severe_dark then 'severe_dark' end, case when severe_blurry then 'severe_blurry' end, case when dark then 'dark_candidate' end, case when blurry then 'blurry_candidate' end, case when rain then 'rain_or_wet_lens_candidate' end,
    case when wet then 'wet_lens_or_water_drops' end, case when fog then 'fog_haze_or_water_vapor' end, case when obscured then 'obscured_or_washed_out' end, case when glared then 'strong_glare_or_overexposure' end,
    case when snow then 'snow_or_ice_candidate' end, case when dark and low_contrast then 'dark_and_low_contrast' end, case when blurry and low_contrast then 'blurry_and_low_contrast' end,
    case when low_colour and dark then 'low_colorfulness_and_dark' end, case when soft_flag_count >= 3 then 'too_many_soft_quality_flags' end) as d,
    concat_ws('|', case when low_colour and not dark then 'review_low_colorfulness' end) as v from s)
select l_orderkey, l_linenumber, soft_flag_count, d = '' as quality_keep, d = '' and v <> '' as quality_review, case when d = '' then v else d end as quality_reasons from r
""")
def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(measured(spark, sf_dir), ["l_returnflag"]).select("l_orderkey", "l_linenumber", "soft_flag_count", "quality_keep", "quality_review", "quality_reasons")


# --- statistics ----------------------------------------------------------------------------------------------------------


@query("""
with c as (select doc_id, unnest(string_split(text, '')) as ch from documents), n as (select doc_id, ch, count(*) as n from c group by all),
p as (select doc_id, n / (sum(n) over (partition by doc_id) + 1e-8::double) as p from n) select doc_id, round(-sum(p * log2(p)), 6) as entropy from p group by 1
""")
def entropy_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(stats.text_entropy_bits(F.col("text")), 6).alias("entropy"))


@query("""
with r as (select min(value) as lo, max(value) as hi from events), b as (select event_type, least(floor((value - lo) / (hi - lo) * 50), 49)::bigint as bin from events, r), n as (select event_type, bin, count(*) as n from b group by all)
select event_type, (arg_max(bin, n * 100 - bin) + 0.5::double) / 50 as peak from n group by 1
""")
def hist_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    span = events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = events.crossJoin(F.broadcast(span)).withColumn("v", (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))  # one row on the right
    return stats.histogram_peak(scaled, ["event_type"], F.col("v"))


DIMS = "with x as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings)"


@query(DIMS + ", s as (select dim, quantile_cont(x, 0.5) as c, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as q from x where label < 8 group by 1) "
       "select vec_id, dim, round((x - c) / case when q = 0 then 1 else q end, 6) as z from x join s using (dim)")  # fmt: skip
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_long(spark, sf_dir, stats.robust_scaler)


@query(DIMS + ", s as (select dim, avg(x) as c, stddev_pop(x) as q from x where label < 8 group by 1) select vec_id, dim, round((x - c) / case when q = 0 then 1 else q end, 6) as z from x join s using (dim)")
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_long(spark, sf_dir, stats.standard_scaler)


def scaled_long(spark: SparkSession, sf_dir: str, scaler: Callable) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    z = stats.scaled(e, "embedding", "vec_id", scaler(e.where("label < 8"), "embedding"))
    return z.select("vec_id", F.posexplode("scaled").alias("dim", "z")).withColumn("z", F.round("z", 6))


@query("""
with o as (select o_orderkey, case when o_orderkey % 11 <> 0 then month(o_orderdate) end as m from orders), i as (select o_orderkey, unnest(generate_series(0, 15)) as i, coalesce(m, 1) as m, case when m is null then 4 else (m % 12) // 3 + 1 end as s from o)
select o_orderkey, i, (case when i < 12 then i + 1 = m else i - 11 = s end)::float as flag from i
""")
def one_hot_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.when(F.col("o_orderkey") % 11 != 0, F.month("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(calendar.month_season_one_hot(month)).alias("i", "flag"))


def five_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five predictors of the order price, off by multiples and turns."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"))
    k = F.explode(F.sequence(F.lit(1), F.lit(5)))
    return orders.withColumn("k", k).withColumn("pred", F.col("y") * (1 + (F.col("k") - 3) * 0.1) + F.pmod(F.col("o_orderkey") * F.col("k"), F.lit(7)) * 1000)


MODELS = "m as (select o_orderkey, o_totalprice as y, k, o_totalprice * (1 + (k - 3) * 0.1::double) + ((o_orderkey * k) % 7) * 1000 as pred from orders, (values (1), (2), (3), (4), (5)) t(k))"
SCORES = f"with {MODELS}, s as (select k, 1 - sum((pred - y) * (pred - y)) / (count(*) * var_pop(y)) as r2 from m group by 1)"


@query(f"with {MODELS} select k, round(avg(abs(pred - y)), 3) as \"MAE\", round(sqrt(avg((pred - y) * (pred - y))), 3) as \"RMSE\", round(1 - sum((pred - y) * (pred - y)) / (count(*) * var_pop(y)), 6) as \"R2\", round(avg(pred - y), 3) as \"Bias\" from m group by 1")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = five_models(spark, sf_dir).groupBy("k").agg(*stats.regression_metrics(F.col("y"), F.col("pred")))
    return out.select("k", *[F.round(c, 6 if c == "R2" else 3).alias(c) for c in ("MAE", "RMSE", "R2", "Bias")])


@query(SCORES + """, b as (select k, r2, greatest(r2, 0) + 1e-6::double as b, row_number() over (order by r2 desc, k desc) as place from s),
w as (select k, 'uniform' as mode, 1.0::double as w from b union all select k, 'weighted', b * b from b union all select k, 'topk', case when place <= 3 then b * b else 0 end from b union all select k, 'softmax', exp(2 * (b - (select max(b) from b))) from b)
select k, mode, round(w / sum(w) over (partition by mode), 6) as weight from w""")
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = five_models(spark, sf_dir).groupBy("k").agg(stats.regression_metrics(F.col("y"), F.col("pred"))[2])
    modes = [stats.with_ensemble_weights(scores, "R2", m, 2.0, 3, (), "k").select("k", F.lit(m).alias("mode"), F.round("weight", 6).alias("weight")) for m in ("uniform", "weighted", "topk", "softmax")]
    out = modes[0]
    for m in modes[1:]:
        out = out.unionByName(m)
    return out


@query(SCORES + """, w as (select k, r2, (greatest(r2, 0) + 1e-6::double) as w from s)
select round(sum(r2 * w) / sum(w), 6) as weighted_mean, round(avg(r2), 6) as mean, round(stddev_pop(r2), 6) as std, round(max(r2), 6) as best from w""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = five_models(spark, sf_dir).groupBy("k").agg(stats.regression_metrics(F.col("y"), F.col("pred"))[2])
    return scores.agg(*stats.score_summary(F.col("R2"), F.greatest("R2", F.lit(0.0)) + 1e-6)).select(*[F.round(c, 6).alias(c) for c in ("weighted_mean", "mean", "std", "best")])


@query(f"""with {MODELS}, x as (select o_orderkey, y, max(pred) filter (where k = 2) as low, max(pred) filter (where k = 4) as high, ((o_orderkey % 10) / 10.0)::double as gate from m group by all), h as (select quantile_cont(y, 0.55) as t from orders_y)
select o_orderkey, round((1 - gate) * low + gate * high, 3) as pred_soft, round(case when gate >= 0.5 then high else low end, 3) as pred_hard, (gate >= 0.5)::int as seg_pred, (y > t)::int as seg_true,
    round(case when y > t then high else low end, 3) as pred_seg_oracle, round(case when abs(low - y) < abs(high - y) then low else high end, 3) as pred_expert_oracle from x, h""".replace("orders_y", "(select o_totalprice as y from orders)"))  # fmt: skip
def moe_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = five_models(spark, sf_dir).groupBy("o_orderkey", "y").agg(F.max(F.when(F.col("k") == 2, F.col("pred"))).alias("low"), F.max(F.when(F.col("k") == 4, F.col("pred"))).alias("high"))
    limit = exact_quantiles(table(spark, sf_dir, "orders"), [], {"t": (F.col("o_totalprice"), 0.55)})
    made = stats.mixture(F.col("low"), F.col("high"), F.col("o_orderkey") % 10 / 10.0, F.col("y"), F.col("t"))
    out = wide.crossJoin(F.broadcast(limit)).select("o_orderkey", *[v.alias(k) for k, v in made.items()])  # one row on the right
    return out.select("o_orderkey", "seg_pred", "seg_true", *[F.round(c, 3).alias(c) for c in made if c.startswith("pred_")])


@query(f"with {MODELS}, w as (select k, k / 15.0::double as weight from (values (1), (2), (3), (4), (5)) t(k)) select o_orderkey, round(sum(weight * pred), 3) as pred from m join w using (k) group by 1")
def ensemble_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.range(1, 6).select(F.col("id").cast("int").alias("k"), (F.col("id") / 15.0).alias("weight"))
    return stats.ensemble(five_models(spark, sf_dir), weights, ("k",), ("o_orderkey",), ("pred",)).withColumn("pred", F.round("pred", 3))


@query("select l_orderkey, l_linenumber, case when n <= 1 then 0 else least(n - 1, greatest(1, round_even(n * 0.25::double, 0)::bigint)) end as val_n, greatest(0, least(20000, x)) as clamped from (select l_orderkey, l_linenumber, l_quantity::bigint as n, l_extendedprice - 100 as x from lineitem)")
def holdout_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, x = F.col("l_quantity").cast("long"), F.col("l_extendedprice") - 100
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", stats.holdout_size(n, 0.25).alias("val_n"), stats.clamp_prediction(x).alias("clamped"))


@query()
def site_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", text.crc(F.col("n_name")).alias("crc"))


# --- compositions and readers --------------------------------------------------------------------------------------------


def camera_sites(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Users as cameras with a gauge each: clicks are images, views are readings."""
    clicks, views = clicks_views(spark, sf_dir)
    name = F.col("user_id").cast("string")
    sites = table(spark, sf_dir, "events").select(F.concat(F.lit("g"), name).alias("river_group"), F.concat(F.lit("s"), name).alias("site_folder"), name.alias("cam_id"), F.concat(F.lit("n"), name).alias("nwis_id")).distinct()
    images = clicks.select(name.alias("cam_id"), F.col("ts").alias("image_time"), F.col("event_id"))
    readings = views.select(F.concat(F.lit("n"), name).alias("nwis_id"), F.col("view_ts").alias("time"), F.col("view_value").alias("discharge"))
    return pipeline.prepare(sites, images, readings)


@query(INTERPOLATED + """select event_id, 'g' || user_id as river_group, 's' || user_id as site_folder, user_id::varchar as cam_id, 'n' || user_id as nwis_id, ts as image_time, ts as hydro_time, view_value as discharge,
    gap_prev_min, gap_next_min, valid_interpolation, coalesce(strftime(nearest_time, '%Y-%m-%dT%H:%M:%SZ'), '') as nearest_obs_time from r where valid_interpolation""")
def prepare_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camera_sites(spark, sf_dir)["matched"]


@query("select 'n' || user_id as nwis_id, min(ts) - interval 2 days as start, max(ts) + interval 2 days as \"end\" from events where event_type = 'click' group by 1")
def prepare_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camera_sites(spark, sf_dir)["windows"]


DATASET = """
with c as (select event_id, user_id, ts from events where event_type = 'click'),
v as (select user_id, ts as view_ts, value as view_value from events where event_type = 'view'),
p as (select c.*, v.view_ts as pt, v.view_value as pv from c asof left join v on c.user_id = v.user_id and c.ts >= v.view_ts),
n as (select c.event_id, v.view_ts as nt, v.view_value as nv from c asof left join v on c.user_id = v.user_id and c.ts <= v.view_ts),
g as (select p.*, n.nt, n.nv, epoch_us(ts) - epoch_us(pt) as gp, epoch_us(nt) - epoch_us(ts) as gn from p join n using (event_id)),
m as (select event_id, user_id, ts, case when gp <= 1800000000 and (gn is null or gn > 1800000000 or gp <= gn) then pv when gn <= 1800000000 then nv end as discharge,
    case when gp <= 1800000000 and (gn is null or gn > 1800000000 or gp <= gn) then pt when gn <= 1800000000 then nt end as hydro_time from g)
"""


def dataset_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    clicks, views = clicks_views(spark, sf_dir)
    site = F.col("user_id").cast("string").alias("site_id")
    images = clicks.select(site, F.concat(F.lit("i/"), "event_id").alias("image_path"), F.col("ts").alias("image_time"), F.year("ts").alias("year"), F.month("ts").alias("month"))
    labels = views.select(site, F.col("view_ts").alias("time"), F.col("view_value").alias("discharge"), (F.col("view_value") / 10).alias("gauge_height"))
    return pipeline.build_dataset(images, labels, ["site_id"])


@query(DATASET + "select user_id::varchar as site_id, 'i/' || event_id as image_path, ts as image_time, year(ts) as year, month(ts) as month, hydro_time, discharge, discharge / 10 as gauge_height from m where discharge is not null")
def build_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_parts(spark, sf_dir)[0]


@query(DATASET + "select user_id::varchar as site_id, 'i/' || event_id as image_path from m where discharge is null")
def build_dataset_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_parts(spark, sf_dir)[1].select("site_id", "image_path")


@query("select n_name as site_id, null as variant, n_nationkey as n from nation union all select r_name, 'p05', r_regionkey from region")
def build_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("site_id"), F.col("n_nationkey").alias("n"))
    return pipeline.build_sites([nation, table(spark, sf_dir, "region").select(F.col("r_name").alias("site_id"), F.lit("p05").alias("variant"), F.col("r_regionkey").alias("n"))])


def origin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long readings: views are discharge, signups gauge heights, under two codes each."""
    code = F.when(F.col("event_type") == "view", F.when(F.col("event_id") % 2 == 0, "00060").otherwise("60")).otherwise("00065")
    events = table(spark, sf_dir, "events").where("event_type in ('view', 'signup')")
    return events.select(F.col("user_id").alias("site_no"), F.col("ts").alias("datetime_utc"), code.alias("variable_cd"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))


@query("select user_id as site_no, ts as time, value as discharge from events where event_type = 'view' and event_id % 5 <> 0")
def wide_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.wide_readings(origin_rows(spark, sf_dir), ["site_no"])


@query("""select user_id as site_no, count(*) filter (where event_type = 'view' and event_id % 2 = 0) as n_padded, count(*) filter (where event_type = 'signup') as n_height,
    bool_or(event_type = 'view') as has_discharge from events where event_type in ('view', 'signup') group by 1""")
def hydro_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("counts")
    out = pipeline.hydro_summary(origin_rows(spark, sf_dir))
    return out.select("site_no", F.coalesce(n["00060"], F.lit(0)).alias("n_padded"), F.coalesce(n["00065"], F.lit(0)).alias("n_height"), "has_discharge")


@query("select date_trunc('second', ts) as time, value as discharge, null::double as gauge_height from events where event_id % 3 <> 0 and event_id % 4 <> 0")
def hydro_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as text, some without a time, some without a number."""
    iso = F.when(F.col("event_id") % 3 != 0, calendar.iso_z(F.col("ts"))).otherwise("never")
    number = F.when(F.col("event_id") % 4 != 0, F.col("value").cast("string")).otherwise("Ice")
    return readers.hydro_table(table(spark, sf_dir, "events").select(iso.alias("datetime_utc"), number.alias("discharge")))


@query("""select o_orderkey || '.jpg' as filename, o_orderdate as image_time, o_orderdate as hydro_time, o_totalprice as discharge, o_custkey::double as gauge_height from orders where o_orderkey % 6 <> 0""")
def direct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for each image, as text, with paths in place of names and some without a number."""
    iso = calendar.iso_z(F.col("o_orderdate"))
    number = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice").cast("string")).otherwise("")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("a/b/"), "o_orderkey", F.lit(".jpg")).alias("path"), iso.alias("image_time"), iso.alias("hydro_time"), number.alias("discharge"), F.col("o_custkey").cast("string").alias("gauge_height"))
    return readers.direct_labels(rows)


FEATURES = """
with f as (select o_orderkey, case when o_orderkey % 5 = 0 then -999999.0 when o_orderkey % 7 <> 0 then o_totalprice end::double as discharge, case o_orderkey % 3 when 0 then 'train' when 1 then 'test' else 'val' end as split, year(o_orderdate) as year from orders)
select *, case when discharge > -1 then round(ln(1 + discharge), 9) end as log_discharge from f where discharge is not null
"""


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 0, "-999999.0").when(k % 7 != 0, F.col("o_totalprice").cast("string")).otherwise("Eqp")
    split = F.when(k % 3 == 0, " Train").when(k % 3 == 1, "TEST ").otherwise("val")
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("discharge"), split.alias("split"), F.year("o_orderdate").alias("year"))


@query(FEATURES + "and discharge <> -999999 and year in (1996, 1998)")
def features_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.features(feature_rows(spark, sf_dir), years=(1996, 1998)).withColumn("log_discharge", F.round("log_discharge", 9))


@query(FEATURES)
def features_with_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.features(feature_rows(spark, sf_dir), drop_sentinel=False).withColumn("log_discharge", F.round("log_discharge", 9))


@query("select vec_id, label, " + ", ".join(f"embedding[{i + 1}] as emb_{i:03d}" for i in range(64)) + " from embeddings")
def vector_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as columns, as one vector, and as columns again."""
    wide = guards.as_columns(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return guards.as_columns(guards.as_vector(wide), "embedding", 64)


@query("select l_orderkey, l_linenumber, l_returnflag from lineitem")
def without_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.without_quality(measured(spark, sf_dir))


@query("select 'first' as first, o_custkey as cust, o_orderkey as key from orders")
def ordered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional columns that are there come first; columns are renamed; the first known name is taken."""
    orders = table(spark, sf_dir, "orders").withColumn("first", F.lit("first")).withColumnsRenamed({"o_custkey": "cust", "o_orderkey": "key"})
    return guards.ordered(orders, ("absent", "first"), (guards.first_column(orders, ("nothing", "cust", "key")), "key"))


@query("select count(*) filter (where o_orderpriority = '1-URGENT') / greatest(1, count(*)) as keep_ratio, o_orderstatus from orders group by o_orderstatus")
def keep_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("k"), F.count("*").alias("n"))
    return orders.select("o_orderstatus", stats.keep_ratio(F.col("k"), F.col("n")).alias("keep_ratio"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split from orders")
def explicit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderkey") % 3 == 0, " TRAIN").when(F.col("o_orderkey") % 3 == 1, "Val ").otherwise("test")
    return splits.explicit_split(table(spark, sf_dir, "orders").select("o_orderkey", label.alias("split")))


@query("select c_nationkey, count(*) as n, any_value(n_regionkey) as n_regionkey from customer join nation on c_nationkey = n_nationkey group by 1")
def single_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's customers have one region."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    joined = table(spark, sf_dir, "customer").join(nation, "c_nationkey")
    return guards.single_value(joined, "c_nationkey", "n_regionkey").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.first("n_regionkey").alias("n_regionkey"))


@query("select 'images/' || n_name || '.jpg' as image_path, 'out/' || case when n_nationkey % 2 = 0 then 'train' else 'val' end || '/' || n_name || '.jpg' as link_path from nation")
def split_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("images/"), "n_name", F.lit(".jpg")).alias("image_path"), F.when(F.col("n_nationkey") % 2 == 0, "train").otherwise("val").alias("split"))
    return sinks.split_links(rows, "out")


# --- models (no SQL) -----------------------------------------------------------------------------------------------------


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    truth = F.lit(100.0) + F.col("label") * 40 + F.aggregate(F.slice("embedding", 1, 8), F.lit(0.0), lambda a, x: a + x.cast("double")) * 50
    split = F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "val").otherwise("train")
    return e.select(F.col("vec_id").cast("string").alias("image_path"), F.lit("s1").alias("site_id"), truth.alias("discharge"), split.alias("split"), "embedding")


@query()
def moe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.evaluate_mixture(labelled_vectors(spark, sf_dir), ["site_id"])


@query()
def svr_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.svr_baseline(labelled_vectors(spark, sf_dir), ["site_id"])


@query()
def rf_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.forest_baseline(labelled_vectors(spark, sf_dir), ["site_id"])


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small pictures made of part numbers; every tenth has broken bytes."""
    side = F.expr("transform(sequence(0, 16 * 16 * 3 - 1), i -> pmod(xxhash64(p_partkey, i), 256))")
    data = F.unhex(F.array_join(F.transform(side, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    size = F.when(F.col("p_partkey") % 10 == 0, 17).otherwise(16)
    image = F.struct(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("origin"), size.alias("height"), F.lit(16).alias("width"), F.lit(3).alias("nChannels"), data.alias("data"))
    return table(spark, sf_dir, "part").select(image.alias("image"))


@query()
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.operators.pixels import image_metrics as measure

    return measure(image_rows(spark, sf_dir))
