"""Reshaping, joins, gaps and windows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarncast import fixtures as fx
from tarncast.catalog.registry import query
from tarncast.catalog.roles import r, rs, with_
from tarncast.functions import optics, seasons
from tarncast.operators import daily, grid, lookup, records, reshape, series
from tarncast.plans import evaluation, provenance

NOISE_FREE = ["rain", "shortwave", "water_temp"]


# --- reshape ---------------------------------------------------------------------------------


@query(f"""select cast(l_shipdate as date) as datetime, {r("avg(case when l_returnflag = 'A' then l_quantity end)", 'A')},
    {r("avg(case when l_returnflag = 'N' then l_quantity end)", 'N')},
    {r("avg(case when l_returnflag = 'R' then l_quantity end)", 'R')} from lineitem group by 1""")
def pivot_variables(spark, folder):
    means = fx.table(spark, folder, "lineitem").groupBy(
        F.to_date("l_shipdate").alias("datetime"), F.col("l_returnflag").alias("variable")
    )
    long = means.agg(F.avg("l_quantity").alias("observation"))
    return reshape.widen(long, ["datetime"], "variable", "observation", ["A", "N", "R"])


@query(with_("history", f"""select datetime, variable, {r('observation')} from (
    select datetime, 'rain' as variable, rain as observation from history
    union all select datetime, 'shortwave', shortwave from history
    union all select datetime, 'water_temp', water_temp from history)"""))
def unpivot_variables(spark, folder):
    return reshape.lengthen(fx.driver_history(spark, folder), ["datetime"], NOISE_FREE, "variable", "observation")


@query("""select split_part(o_orderpriority, '-', 1) as rank, split_part(o_orderpriority, '-', 2) as label, count(*) as n
    from orders group by 1, 2""")
def separate_labels(spark, folder):
    orders = reshape.split_label(fx.table(spark, folder, "orders"), "o_orderpriority", ["rank", "label"], "-")
    return orders.groupBy("rank", "label").agg(F.count(F.lit(1)).alias("n"))


SEASON = """case when month(datetime) in (3, 4, 5) then 'Spring' when month(datetime) in (6, 7, 8) then 'Summer'
    when month(datetime) in (9, 10, 11) then 'Fall' else 'Winter' end"""


@query(with_("targets", f"""select site_id, statistic, max(case when season = 'Winter' then v end) as "Winter",
    max(case when season = 'Spring' then v end) as "Spring", max(case when season = 'Summer' then v end) as "Summer",
    max(case when season = 'Fall' then v end) as "Fall" from (
      select site_id, {SEASON} as season, 'days' as statistic, cast(count(*) as varchar) as v from targets group by 1, 2
      union all select site_id, {SEASON}, 'last_day', cast(max(datetime) as varchar) from targets group by 1, 2)
    group by 1, 2"""))
def season_transpose(spark, folder):
    rows = fx.targets(spark, folder).withColumn("season", seasons.season_by_month(F.col("datetime")))
    table = rows.groupBy("site_id", "season").agg(F.count(F.lit(1)).alias("days"), F.max("datetime").alias("last_day"))
    return evaluation.season_columns(table, ["days", "last_day"])


@query(f"""select l_orderkey as case_id, {r("max(case when parameter = 'mu' then prediction end)", 'mu')},
    {r("max(case when parameter = 'sigma' then prediction end)", 'sigma')} from (
    select l_orderkey, 'mu' as parameter, sum(l_quantity) as prediction from lineitem group by 1
    union all select l_orderkey, 'sigma', sum(l_tax) + 1 from lineitem group by 1) group by 1""")
def parameter_columns(spark, folder):
    lines = fx.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"))
    wide = lines.agg(F.sum("l_quantity").alias("mu"), (F.sum("l_tax") + 1).alias("sigma"))
    long = reshape.lengthen(wide, ["case_id"], ["mu", "sigma"], "parameter", "prediction")
    return reshape.parameters_wide(long, ["case_id"])


@query(f"""select vec_id, cast(position as varchar) as parameter, {r('cast(prediction as double)', 'prediction')} from (
    select vec_id, unnest(embedding) as prediction, generate_subscripts(embedding, 1) as position from embeddings)""")
def list_to_members(spark, folder):
    return reshape.explode_members(fx.table(spark, folder, "embeddings"), "embedding", ["vec_id"])


@query(f"""select cast(o_orderdate as date) as datetime, {r("avg(case when o_orderstatus = 'F' then o_totalprice / 10000 end)", 'mu_F')},
    {r("stddev_samp(case when o_orderstatus = 'F' then o_totalprice / 10000 end)", 'sigma_F')},
    {r("avg(case when o_orderstatus = 'O' then o_totalprice / 10000 end)", 'mu_O')},
    {r("stddev_samp(case when o_orderstatus = 'O' then o_totalprice / 10000 end)", 'sigma_O')},
    {r("avg(case when o_orderstatus = 'P' then o_totalprice / 10000 end)", 'mu_P')},
    {r("stddev_samp(case when o_orderstatus = 'P' then o_totalprice / 10000 end)", 'sigma_P')} from orders group by 1""")
def models_side_by_side(spark, folder):
    price = F.col("o_totalprice") / 10000
    moments = (
        fx.table(spark, folder, "orders")
        .groupBy(F.to_date("o_orderdate").alias("datetime"), F.col("o_orderstatus").alias("model_id"))
        .agg(F.avg(price).alias("mu"), F.stddev_samp(price).alias("sigma"))
    )
    return reshape.models_wide(moments, ["datetime"], ["F", "O", "P"], ["mu", "sigma"])


# --- joins -----------------------------------------------------------------------------------


@query(with_("frame", f"""select site_id, datetime, {rs('observation rain shortwave water_temp observation_lag1 rain_lag1')} from frame"""))
def lag_join(spark, folder):
    from tarncast.plans.regressions import calibration_frame

    frame = calibration_frame(fx.targets(spark, folder), fx.driver_history(spark, folder))
    return frame.drop("rain_10")


@query(with_("targets history", f"""select t.site_id, t.datetime, {r('t.observation', 'observation')},
    {r('lag(t.observation) over (partition by t.site_id order by t.datetime)', 'observation_lag1')},
    {r('h.rain', 'rain')} from targets t left join history h on h.datetime = t.datetime"""))
def lag_by_row(spark, folder):
    from tarncast.plans.regressions import calibration_frame

    frame = calibration_frame(fx.targets(spark, folder), fx.driver_history(spark, folder), by_row=True)
    return frame.select("site_id", "datetime", "observation", "observation_lag1", "rain")


@query(with_("targets", f"""select coalesce(a.doy, b.doy) as doy, {r('a.m', 'one')}, {r('b.m', 'other')} from
    (select dayofyear(datetime) as doy, avg(observation) as m from targets where site_id = '1-URGENT' group by 1) a
    full join (select dayofyear(datetime) as doy, avg(observation) as m from targets where site_id = '5-LOW' group by 1) b
    on a.doy = b.doy"""))
def full_join_by_doy(spark, folder):
    rows = fx.targets(spark, folder)

    def doy_mean(site, name):
        one = rows.filter(F.col("site_id") == site)
        return one.groupBy(F.dayofyear("datetime").alias("doy")).agg(F.avg("observation").alias(name))

    return doy_mean("1-URGENT", "one").join(doy_mean("5-LOW", "other"), "doy", "full")


@query(with_("refs_day targets", f"""select d.site_id, d.reference_datetime as datetime, {r('t.observation', 'observation')}
    from targets t right join refs_day d on t.site_id = d.site_id and t.datetime = d.reference_datetime"""))
def scaffold(spark, folder):
    return series.scaffold(fx.targets(spark, folder).select("site_id", "datetime", "observation"), ["site_id"], "observation")


@query(f"""with past as (select cast(o_orderdate as date) as datetime, avg(o_totalprice) / 10000 as rain from orders group by 1),
    ahead as (select cast(l_shipdate as date) as datetime, avg(l_quantity) as rain from lineitem group by 1)
    select coalesce(a.datetime, p.datetime) as datetime, {r('coalesce(p.rain, a.rain)', 'rain')}
    from ahead a full join past p on a.datetime = p.datetime""")
def splice(spark, folder):
    past = fx.table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("datetime"))
    ahead = fx.driver_history(spark, folder).select("datetime", F.col("shortwave").alias("rain"))
    return lookup.splice(past.agg((F.avg("o_totalprice") / 10000).alias("rain")), ahead, ["datetime"], "rain")


@query(f"""select o_orderkey, {r('coalesce(v, 0.0)', 'value')} from (select o_orderkey, case when n > 0 then v
    else o_totalprice end as v from orders left join (select l_orderkey, count(*) as n, sum(l_extendedprice) as v
    from lineitem group by 1) on l_orderkey = o_orderkey)""", digits=4)
def upsert(spark, folder):
    base = fx.table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    lines = fx.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    return lookup.upsert(base, lines.agg(F.sum("l_extendedprice").alias("value")), ["o_orderkey"], "value")


@query("""select c_custkey, c_name, c_mktsegment from customer
    where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')""")
def semi(spark, folder):
    done = fx.table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F")
    done = done.select(F.col("o_custkey").alias("c_custkey"))
    return lookup.known(fx.table(spark, folder, "customer"), done, ["c_custkey"]).select("c_custkey", "c_name", "c_mktsegment")


@query("""select o_orderkey, o_custkey from orders
    where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def anti(spark, folder):
    seen = fx.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookup.unknown(fx.table(spark, folder, "orders"), seen, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query(with_("targets refs_day", f"""select r.site_id, r.reference_datetime, t.datetime as last_date, {r('t.observation', 'last_value')}
    from refs_day r asof left join targets t on t.site_id = r.site_id and t.datetime < r.reference_datetime"""))
def asof_last(spark, folder):
    return lookup.last_before(fx.targets(spark, folder), fx.daily_refs(spark, folder), ["site_id"], "observation")


@query(with_("targets refs_day", f"""select r.site_id, r.reference_datetime, {r('t.observation', 'observation')}
    from refs_day r left join targets t on t.site_id = r.site_id and t.datetime = r.reference_datetime"""))
def ic_lookup(spark, folder):
    return lookup.value_at(fx.targets(spark, folder), fx.daily_refs(spark, folder), ["site_id"], "observation")


@query(with_("refs_day", """select site_id, reference_datetime, cast(horizon as int) as horizon, reference_datetime + cast(horizon as int) as datetime,
    count(*) as members, cast(sum(member) as bigint) as numbers
    from refs_day, (select unnest(range(1, 32)) as member) m, (select unnest(range(0, 36)) as horizon) h group by 1, 2, 3, 4"""))
def forecast_grid(spark, folder):
    """Every issue day's grid of days and members, the members of a day counted and their numbers added."""
    rows = grid.each_member(grid.each_horizon(fx.daily_refs(spark, folder), 0, 35), 31)
    return rows.groupBy("site_id", "reference_datetime", "horizon", "datetime").agg(F.count("member").alias("members"), F.sum("member").alias("numbers"))


@query(with_("drivers", f"""select site_id, reference_datetime, horizon, {r('avg(rain_lag1)', 'rain_lag1')}, count(rain_lag1) as members
    from (select *, lag(rain) over (partition by site_id, reference_datetime, member order by horizon) as rain_lag1 from drivers)
    group by 1, 2, 3"""))
def lagged_driver(spark, folder):
    from tarncast.plans.common import driver_rows

    drivers = fx.driver_ensemble(spark, folder, fx.daily_refs(spark, folder), ("rain",))
    path = W.partitionBy("site_id", "reference_datetime", "member").orderBy("horizon")
    rows = driver_rows(drivers, {"rain": fx.DRIVER_NAMES["rain"]}).withColumn("rain_lag1", F.lag("rain").over(path))
    return rows.groupBy("site_id", "reference_datetime", F.col("horizon").cast("long").alias("horizon")).agg(
        F.avg("rain_lag1").alias("rain_lag1"), F.count("rain_lag1").alias("members")
    )


@query(with_("sensor targets", f"""select s.site_id, count(*) as n, {r('avg(s.fdom)', 'fdom')} from sensor s
    join (select distinct cast(ts as date) as day from events where event_type = 'error' and value > 200) d
    on s.datetime >= d.day and s.datetime < d.day + interval 1 day group by 1"""))
def day_interval(spark, folder):
    feed = fx.sensor(spark, folder)
    days = feed.filter((F.col("site_id") == "error") & (F.col("fdom") > 200))
    days = days.select(F.to_date("datetime").alias("day")).distinct()
    hits = feed.withColumn("day", F.to_date("datetime")).join(days, "day", "left_semi")
    return hits.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.avg("fdom").alias("fdom"))


CHEM = """chem as (select p_brand as site_id, avg(p_size) / 10 as secchi, avg(p_retailprice) / 100 as chla, count(*) as tp
    from part group by 1)"""


@query(f"""with {CHEM}, tsi as (select site_id, 60 - 14.41 * ln(secchi) as tsi_secchi, 9.81 * ln(chla) + 30.6 as tsi_chla,
    14.42 * ln(tp) + 4.15 as tsi_tp from chem)
    select site_id, {rs('tsi_secchi tsi_chla tsi_tp')}, {r('(tsi_secchi + tsi_tp) / 2', 'tsi_mean')} from tsi""")
def trophic_index(spark, folder):
    part = fx.table(spark, folder, "part").withColumnRenamed("p_brand", "site_id")

    def mean(column, name):
        return part.groupBy("site_id").agg(F.avg(column).alias(name))

    sites = part.select("site_id").distinct()
    chem = lookup.attach_all(
        sites,
        [
            mean(F.col("p_size") / 10, "secchi"),
            mean(F.col("p_retailprice") / 100, "chla"),
            part.groupBy("site_id").agg(F.count(F.lit(1)).cast("double").alias("tp")),
        ],
        ["site_id"],
    )
    tsi = chem.select(
        "site_id",
        optics.tsi_secchi(F.col("secchi")).alias("tsi_secchi"),
        optics.tsi_chlorophyll(F.col("chla")).alias("tsi_chla"),
        optics.tsi_phosphorus(F.col("tp")).alias("tsi_tp"),
    )
    means = reshape.lengthen(tsi, ["site_id"], ["tsi_secchi", "tsi_tp"]).groupBy("site_id")
    return tsi.join(means.agg(F.avg("value").alias("tsi_mean")), "site_id")


# --- windows and series ----------------------------------------------------------------------


@query(with_("frame", f"select site_id, datetime, {r('rain_10')} from frame"))
def rolling10(spark, folder):
    from tarncast.plans.regressions import calibration_frame

    frame = calibration_frame(fx.targets(spark, folder), fx.driver_history(spark, folder))
    return frame.select("site_id", "datetime", "rain_10")


@query(with_("scaffold", f"""select site_id, datetime, {r('''coalesce(observation,
    v0 + (v1 - v0) * ((datetime - d0) / (d1 - d0)::double), v0, v1)''', 'observation')} from (select *,
    last_value(observation ignore nulls) over b as v0,
    last_value(case when observation is not null then datetime end ignore nulls) over b as d0,
    first_value(observation ignore nulls) over a as v1,
    first_value(case when observation is not null then datetime end ignore nulls) over a as d1 from (
        select site_id, datetime, observation from scaffold union all
        select site_id, cast(unnest(generate_series(last_day + 1, date '2001-12-31', interval 1 day)) as date), null from span)
    window b as (partition by site_id order by datetime rows between unbounded preceding and current row),
           a as (partition by site_id order by datetime rows between current row and unbounded following))"""))
def interpolate(spark, folder):
    from tarncast.plans.neural import filled_series

    return filled_series(fx.targets(spark, folder).select("site_id", "datetime", "observation"), "2001-12-31")


@query(with_("targets", f"""select site_id, min(datetime) as datetime, {r('arg_min(observation, datetime)', 'observation')}
    from targets where observation is not null group by 1"""))
def first_known(spark, folder):
    return series.first_known(fx.targets(spark, folder), ["site_id"], "observation")


@query(with_("sensor", f"""select site_id, event_id, row, fdom as reading from (select *, cast(row_number()
    over (partition by site_id, cast(datetime as date) order by datetime, event_id) as int) as row from sensor)
    where row between 20 and 200"""))
def row_slice(spark, folder):
    feed = fx.sensor(spark, folder).withColumn("day", F.to_date("datetime"))
    rows = series.rows_between(feed, ["site_id", "day"], ["datetime", "event_id"], 20, 200)
    return rows.select("site_id", "event_id", "row", F.col("fdom").alias("reading"))


@query(with_("sensor", f"""select site_id, event_id, row, fdom as reading from (select *, row_number()
    over (partition by site_id order by datetime, event_id) as row from sensor) where row between 20 and 200"""))
def record_slice(spark, folder):
    """Rows 20 to 200 of each site's whole record."""
    rows = records.record_slice(fx.sensor(spark, folder), ["site_id"], ["datetime", "event_id"], 20, 200)
    return rows.select("site_id", "event_id", "row", F.col("fdom").alias("reading"))


@query(with_("sensor", f"""select date '2024-01-15' as event_date, site_id, {r('max(case when k = -1 then fdom end)', 'before')},
    {r('max(case when k = 10 then fdom end)', 'after')}, {r('max(fdom)', 'highest')}, {r('min(fdom)', 'lowest')},
    {r('max(case when k = 10 then fdom end) - max(case when k = -1 then fdom end)', 'change')}
    from (select site_id, cast(datetime as date) - date '2024-01-15' as k, avg(fdom) as fdom from sensor group by 1, 2)
    where k between -1 and 10 group by 2"""))
def event_impact(spark, folder):
    means = daily.daily_mean(fx.sensor(spark, folder), ["fdom"])
    storm = means.agg(F.lit("2024-01-15").cast("date").alias("event_date"))
    return series.event_response(means, storm, ["site_id"], "fdom")


@query(with_("sensor", f"""select *, {r('t - b', 'diff')} from (select site_id, cast(datetime as date) as datetime,
    avg(case when depth_m = 0.1 then fdom end) as t, avg(case when depth_m = 9 then fdom end) as b from sensor group by 1, 2)"""
    .replace("select *,", "select site_id, datetime, round(t + 1e-9, 6) + 0.0 as top, round(b + 1e-9, 6) + 0.0 as bottom,", 1)))
def stratification(spark, folder):
    return series.depth_difference(fx.sensor(spark, folder), "fdom", 0.1, 9.0)


@query(with_("sensor", """select site_id, min(case when t - b < 0 then datetime end) as first_below from (
    select site_id, cast(datetime as date) as datetime, avg(case when depth_m = 0.1 then fdom end) as t,
    avg(case when depth_m = 9 then fdom end) as b from sensor group by 1, 2) group by 1"""))
def turnover_date(spark, folder):
    diff = series.depth_difference(fx.sensor(spark, folder), "fdom", 0.1, 9.0)
    return series.first_date_below(diff, ["site_id"], "diff", 0.0)


@query(with_("sensor", f"""select site_id, {r('corr(fdom, temp)', 'same_day')}, {r('corr(fdom, temp_lag1)', 'one_day_lag')}, count(*) as days
    from (select *, lag(temp) over (partition by site_id order by datetime) as temp_lag1 from (
        select site_id, cast(datetime as date) as datetime, avg(fdom) as fdom, avg(temp_c) as temp from sensor group by 1, 2))
    where temp_lag1 is not null and fdom is not null group by 1"""))
def lag_correlation(spark, folder):
    means = daily.daily_mean(fx.sensor(spark, folder), ["fdom", "temp_c"])
    return evaluation.lagged_correlation(means, ["site_id"], "fdom", "temp_c")


@query("""with g as (select distinct o_orderpriority as model_id, cast(o_orderdate as date) as date,
    cast(date_trunc('month', o_orderdate) as date) as ref, o_orderstatus as pub from orders)
    select model_id, date, string_agg(distinct cast(ref as varchar), ',' order by cast(ref as varchar)) as reference_date,
    string_agg(distinct pub, ',' order by pub) as pub_date from g group by 1, 2""")
def provenance_collapse(spark, folder):
    rows = fx.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("model_id"),
        F.col("o_orderdate").alias("datetime"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("reference_datetime"),
        F.col("o_orderstatus").alias("pub_datetime"),
    )
    return provenance.forecast_groups(rows)
