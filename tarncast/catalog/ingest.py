"""Sources, daily aggregation, filters and projections."""

from pyspark.sql import functions as F

from tarncast import fixtures as fx
from tarncast.catalog.registry import query
from tarncast.catalog.roles import r, with_
from tarncast.functions import optics
from tarncast.operators import daily, grid, lookup, reshape
from tarncast.plans.common import default_depth, standard_format
from tarncast.session import work_path
from tarncast.sources import scan, sinks

SPLIT = "cast('2024-01-20' as timestamp_ntz)"


@query(with_("sensor", f"""select site_id, cast(datetime as date) as datetime, {r('avg(fdom)', 'fdom')}
    from sensor group by 1, 2"""))
def daily_targets(spark, folder):
    return daily.daily_mean(fx.sensor(spark, folder), ["fdom"])


@query(with_("sensor", f"""select site_id, cast(datetime as date) as datetime,
    {r('avg(fdom / (1 + -0.01 * (temp_c - 20)))', 'fdom')} from sensor group by 1, 2"""))
def temp_compensated_daily(spark, folder):
    return daily.compensated_daily_mean(fx.sensor(spark, folder))


@query(with_("sensor", f"""select site_id, rho, {r('avg(fdom / (1 + rho * (temp_c - 20)))', 'fdom')}
    from sensor, (values (-0.008::double), (-0.010::double), (-0.012::double)) p(rho) group by 1, 2"""))
def rho_sweep(spark, folder):
    swept = grid.each_value(fx.sensor(spark, folder), "rho", optics.RHO_SWEEP)
    curve = optics.compensate(F.col("fdom"), F.col("temp_c"), F.col("rho"))
    return swept.groupBy("site_id", "rho").agg(F.avg(curve).alias("fdom"))


@query(with_("sensor", f"""select site_id, cast(datetime as date) as datetime,
    {r('avg(fdom * (1 + -0.01 * (temp_c - 20)))', 'raw')},
    {r('avg(fdom - fdom * (1 + -0.01 * (temp_c - 20)))', 'residual')} from sensor group by 1, 2"""))
def uncompensated_daily(spark, folder):
    raw = optics.uncompensate(F.col("fdom"), F.col("temp_c"))
    rows = fx.sensor(spark, folder).withColumn("raw", raw).withColumn("residual", F.col("fdom") - F.col("raw"))
    return daily.daily_mean(rows, ["raw", "residual"])


@query(with_("sensor", f"""select site_id, cast(datetime as date) as datetime, {r('avg(fdom)', 'fdom')}, count(*) as readings
    from sensor where datetime < timestamp '2024-01-20' or (fdom > 10 and fdom < 300) group by 1, 2"""))
def qc_union(spark, folder):
    feed = fx.sensor(spark, folder)
    both = daily.union_feeds(
        [(feed.filter(f"datetime < {SPLIT}"), None), (feed.filter(f"datetime >= {SPLIT}"), ("fdom", 10, 300))]
    )
    return both.groupBy("site_id", F.to_date("datetime").alias("datetime")).agg(
        F.avg("fdom").alias("fdom"), F.count(F.lit(1)).alias("readings")
    )


@query(f"""select version, depth_m, count(*) as n, {r('avg(prediction)', 'prediction')}, min(datetime) as first_day,
    max(datetime) as last_day from (
    select 'old' as version, 1.5::double as depth_m, l_quantity as prediction, cast(l_shipdate as date) as datetime
      from lineitem where l_returnflag = 'A' and l_shipdate < timestamp '1996-06-17'
    union all select 'middle', 1.5, l_quantity, cast(l_shipdate as date) from lineitem
      where l_returnflag = 'N' and l_shipdate >= timestamp '1996-06-17' and l_shipdate < timestamp '1998-01-01'
    union all select 'new', 1.5, l_quantity, cast(l_shipdate as date) from lineitem
      where l_returnflag = 'R' and l_shipdate >= timestamp '1998-01-01') group by 1, 2""")
def source_stitch(spark, folder):
    lines = fx.table(spark, folder, "lineitem")
    cuts = [F.lit(d).cast("timestamp_ntz") for d in ("1996-06-17", "1998-01-01")]
    ship, flag = F.col("l_shipdate"), F.col("l_returnflag")

    def columns(name):
        return {
            "version": F.lit(name),
            "depth_m": F.lit(1.5),
            "prediction": F.col("l_quantity"),
            "datetime": F.to_date(ship),
        }

    whole = daily.stitch_versions(
        [
            (lines, (flag == "A") & (ship < cuts[0]), columns("old")),
            (lines, (flag == "N") & (ship >= cuts[0]) & (ship < cuts[1]), columns("middle")),
            (lines, (flag == "R") & (ship >= cuts[1]), columns("new")),
        ]
    )
    return whole.groupBy("version", "depth_m").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("prediction").alias("prediction"),
        F.min("datetime").alias("first_day"),
        F.max("datetime").alias("last_day"),
    )


def sub_daily_ensemble(spark, folder):
    return fx.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("site_id"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("reference_datetime"),
        F.col("l_shipdate").alias("datetime"),
        F.col("l_linestatus").alias("variable"),
        F.col("l_linenumber").alias("parameter"),
        F.col("l_quantity").alias("prediction"),
    )


@query(f"""select l_returnflag as site_id, cast(date_trunc('month', l_shipdate) as date) as reference_datetime,
    cast(l_shipdate as date) as datetime, l_linestatus as variable, l_linenumber as parameter,
    {r('avg(l_quantity)', 'prediction')} from lineitem group by 1, 2, 3, 4, 5""")
def ensemble_daily(spark, folder):
    return daily.ensemble_daily_mean(sub_daily_ensemble(spark, folder))


@query(with_("drivers", f"""select site_id, datetime, {r('avg(rain)', 'precipitation_flux')},
    {r('avg(shortwave)', 'surface_downwelling_shortwave_flux_in_air')}, {r('avg(water_temp)', 'temperature')}
    from drivers where datetime = reference_datetime group by 1, 2"""))
def ensemble_collapse(spark, folder):
    drivers = fx.driver_ensemble(spark, folder, fx.daily_refs(spark, folder))
    return daily.issue_day_history(drivers, list(fx.DRIVER_NAMES.values()))


@query(with_("sensor", f"""select s.site_id, s.datetime, s.fdom as reading, {r('d.m', 'daily_mean')}, {r('s.fdom - d.m', 'diff')}
    from sensor s join (select site_id, cast(datetime as date) as day, avg(fdom) as m from sensor group by 1, 2) d
    on d.site_id = s.site_id and d.day = cast(s.datetime as date)
    where hour(s.datetime) = 0 and minute(s.datetime) < 30"""))
def midnight_vs_mean(spark, folder):
    first_half_hour = (F.hour("datetime") == 0) & (F.minute("datetime") < 30)
    out = daily.deviation_from_daily_mean(fx.sensor(spark, folder), "fdom", first_half_hour)
    return out.select("site_id", "datetime", F.col("fdom").alias("reading"), "daily_mean", "diff")


@query(with_("sensor", f"""select site_id, cast(datetime as date) as datetime, {r('avg(fdom)', 'fdom')}, {r('avg(temp_c)', 'temp_c')},
    {r('avg(depth_m)', 'depth_m')} from sensor group by 1, 2"""))
def several_daily_means(spark, folder):
    return daily.daily_mean(fx.sensor(spark, folder), ["fdom", "temp_c", "depth_m"])


@query(f"""select p_brand as site_id, p_type as variable, p_size as depth_m, {r('avg(p_retailprice)', 'observation')}
    from part group by 1, 2, 3""")
def repeated_samples(spark, folder):
    samples = fx.table(spark, folder, "part").select(
        F.col("p_brand").alias("site_id"),
        F.col("p_type").alias("variable"),
        F.col("p_size").alias("depth_m"),
        F.col("p_retailprice").alias("observation"),
    )
    return daily.average_repeats(samples, ["site_id", "variable", "depth_m"], "observation")


@query(f"""select c_mktsegment as site_id, {r('avg(water_level)', 'water_level')}, count(*) as days, min(datetime) as first_day
    from (select c_mktsegment, cast(o_orderdate as date) as datetime, avg(o_totalprice) / 10000 as water_level
          from orders join customer on c_custkey = o_custkey
          where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '2000-01-01' group by 1, 2) group by 1""")
def water_level(spark, folder):
    readings = fx.table(spark, folder, "orders").join(
        fx.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    levels = daily.daily_mean(
        readings.select(
            F.col("c_mktsegment").alias("site_id"),
            F.col("o_orderdate").alias("datetime"),
            (F.col("o_totalprice") / 10000).alias("water_level"),
        ),
        ["water_level"],
    )
    period = levels.filter(F.col("datetime").between("1996-01-01", "1999-12-31"))
    return period.groupBy("site_id").agg(
        F.avg("water_level").alias("water_level"), F.count(F.lit(1)).alias("days"), F.min("datetime").alias("first_day")
    )


# --- predicates and projections --------------------------------------------------------------


@query(f"""select site_id, count(*) as n, {r('avg(fdom)', 'fdom')} from (
    select event_type as site_id, value as fdom from events
    where event_type in ('click', 'view') and value > 10 and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25')
    group by 1""")
def conjunctive_filter(spark, folder):
    rows = fx.sensor(spark, folder).filter(
        F.col("site_id").isin("click", "view")
        & (F.col("fdom") > 10)
        & (F.col("datetime") >= F.lit("2024-01-05").cast("timestamp_ntz"))
        & (F.col("datetime") < F.lit("2024-01-25").cast("timestamp_ntz"))
    )
    return rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.avg("fdom").alias("fdom"))


NULL_DEPTH = "case when l_tax = 0 then null when l_tax < 0.03 then 1.5 when l_tax < 0.06 then 1.6 else 9.0 end"


@query(f"""select depth_m, count(*) as n, cast(sum(case when coalesce(depth_m in (1.5, 1.6), false) then 1 else 0 end) as bigint) as strict
    from (select cast({NULL_DEPTH} as double) as depth_m from lineitem) where depth_m in (1.5, 1.6) or depth_m is null group by 1""")
def null_safe_in(spark, folder):
    depths = fx.table(spark, folder, "lineitem").select(F.expr(NULL_DEPTH).cast("double").alias("depth_m"))
    kept = depths.filter(lookup.in_or_null(F.col("depth_m"), [1.5, 1.6]))
    strict = F.sum(lookup.in_strict(F.col("depth_m"), [1.5, 1.6]).cast("int"))
    return kept.groupBy("depth_m").agg(F.count(F.lit(1)).alias("n"), strict.alias("strict"))


@query("""select case o_orderpriority when '1-URGENT' then 'UPPER' when '5-LOW' then 'LOWER' else o_orderpriority end as site_id,
    case when o_orderstatus in ('F', 'O') then 'Baseline' else 'Data Driven' end as model_type, count(*) as n
    from orders group by 1, 2""")
def recode_labels(spark, folder):
    site = reshape.recode(F.col("o_orderpriority"), {"1-URGENT": "UPPER", "5-LOW": "LOWER"})
    kind = F.when(F.col("o_orderstatus").isin("F", "O"), "Baseline").otherwise("Data Driven")
    orders = fx.table(spark, folder, "orders")
    return orders.groupBy(site.alias("site_id"), kind.alias("model_type")).agg(F.count(F.lit(1)).alias("n"))


@query(with_("targets", """select site_id, depth_m, count(*) as days from targets group by 1, 2"""))
def default_depths(spark, folder):
    depth = default_depth(F.col("site_id"), fx.FOCAL_DEPTHS, fx.OTHER_DEPTH)
    days = fx.targets(spark, folder).drop("depth_m").withColumn("depth_m", depth)
    return days.groupBy("site_id", "depth_m").agg(F.count(F.lit(1)).alias("days"))


@query(f"""select l_linestatus as status, count(*) as n, {r("avg(case when l_discount > 0 then l_tax / l_discount end)", 'ratio')}
    from lineitem where l_discount > 0 group by 1""")
def nan_to_null(spark, folder):
    """The division gives real NaN values: 0 / 0 as floating-point numbers do."""
    ratio = daily.not_nan(F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(F.lit(float("nan"))))
    lines = fx.table(spark, folder, "lineitem").withColumn("ratio", ratio).dropna(subset=["ratio"])
    return lines.groupBy(F.col("l_linestatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("ratio")
    )


@query("""select l_linestatus as family, l_returnflag as variable, count(*) as n from lineitem
    where not (l_linestatus = 'F' and l_returnflag = 'A') group by 1, 2""")
def exclude_combination(spark, folder):
    lines = fx.table(spark, folder, "lineitem")
    kept = lines.filter(~((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")))
    return kept.groupBy(F.col("l_linestatus").alias("family"), F.col("l_returnflag").alias("variable")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(f"""select l_returnflag, {r('avg(l_quantity)', 'l_quantity')}, {r('avg(l_extendedprice)', 'l_extendedprice', 4)},
    {r('avg(l_discount)', 'l_discount')}, {r('avg(l_tax)', 'l_tax')} from lineitem group by 1""")
def across_columns(spark, folder):
    lines = fx.table(spark, folder, "lineitem")
    names = reshape.present(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_absent"])
    means = reshape.summarize_columns(lines, ["l_returnflag"], names)
    return means.withColumn("l_extendedprice", F.round(F.col("l_extendedprice") + 1e-9, 4))


@query(with_("targets", f"""select datetime, datetime as reference_datetime, 'observed' as model_id, site_id,
    '1' as parameter, 'ensemble' as family, {r('observation', 'prediction')}, variable, depth_m, 'P1D' as duration,
    'demo' as project_id from targets"""))
def forecast_format(spark, folder):
    rows = fx.targets(spark, folder).select(
        "datetime",
        F.col("datetime").alias("reference_datetime"),
        "site_id",
        F.lit(1).alias("parameter"),
        F.col("observation").alias("prediction"),
        "depth_m",
    )
    return standard_format(rows, "observed", "ensemble", fx.VARIABLE, project_id="demo")


# --- sources and sinks -----------------------------------------------------------------------


@query(f"""select site_id, month, count(*) as n, {r('avg(observation)', 'observation')} from (
    select o_orderpriority as site_id, cast(date_trunc('month', o_orderdate) as date) as month, o_totalprice / 10000 as observation
    from orders) where site_id = '2-HIGH' and month >= date '1997-01-01' group by 1, 2""")
def hive_scan(spark, folder):
    path = work_path(spark, "readings")
    rows = fx.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("site_id"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"),
        (F.col("o_totalprice") / 10000).alias("observation"),
    )
    sinks.write_dataset(rows, path, ["site_id"], spread=4)
    one_site = scan.open_dataset(
        spark, f"{path}/site_id=2-HIGH", [F.col("month") >= "1997-01-01"], ["site_id", "month", "observation"], path
    )
    return one_site.groupBy("site_id", "month").agg(
        F.count(F.lit(1)).alias("n"), F.avg("observation").alias("observation")
    )


CSV_SQL = with_("targets", f"""select site_id, variable, count(*) as days, {r('avg(observation)', 'observation')},
    max(datetime) as last_day from targets group by 1, 2""")


def _target_table(rows):
    return rows.groupBy("site_id", "variable").agg(
        F.count(F.lit(1)).alias("days"), F.avg("observation").alias("observation"), F.max("datetime").alias("last_day")
    )


def _target_csv(spark, folder, **options):
    from tarncast.schemas import TARGETS

    path = work_path(spark, "targets-csv")
    sinks.write_csv(fx.targets(spark, folder).select(*TARGETS.fieldNames()), path, **options)
    return path, TARGETS


@query(CSV_SQL)
def csv_scan(spark, folder):
    path, schema = _target_csv(spark, folder)
    return _target_table(scan.read_csv(spark, f"{path}/*.csv", schema))


@query(CSV_SQL)
def gzip_csv_scan(spark, folder):
    path, schema = _target_csv(spark, folder, compression="gzip")
    return _target_table(scan.read_csv(spark, path, schema))


@query(with_("targets", f"""select site_id, variable, count(*) as days, {r('avg(observation)', 'observation')},
    max(datetime) as last_day from targets where site_id <> '5-LOW' and depth_m = 1.5 group by 1, 2"""))
def csv_dataset_scan(spark, folder):
    path, schema = _target_csv(spark, folder)
    where = [F.col("site_id") != "5-LOW", F.col("depth_m") == 1.5]
    return _target_table(scan.read_csv_dataset(spark, path, schema, where))


@query(with_("targets", f"""select site_id, variable, count(*) as days, {r('avg(observation * case when year(datetime) >= 1999 then 2 else 1 end)', 'observation')},
    max(datetime) as last_day from targets group by 1, 2"""))
def partition_replacement(spark, folder):
    path = work_path(spark, "replaced")
    rows = fx.targets(spark, folder).withColumn("year", F.year("datetime"))
    sinks.write_dataset(rows, path, ["site_id", "year"])
    changed = rows.filter(F.col("year") >= 1999).withColumn("observation", F.col("observation") * 2)
    sinks.replace_partitions(changed, path, ["site_id", "year"])
    return _target_table(scan.open_dataset(spark, path))


@query("""select column_name as "column", n as rows, missing, mean, low, high from (
    select 'fdom' as column_name, count(value) as n, count(*) - count(value) as missing, round(avg(value) + 1e-9, 6) + 0.0 as mean,
           min(value) as low, max(value) as high from events
    union all select 'temp_c', count(*), 0, round(avg(cast(5 + user_id % 25 as double)) + 1e-9, 6) + 0.0,
           min(cast(5 + user_id % 25 as double)), max(cast(5 + user_id % 25 as double)) from events)""")
def source_profile(spark, folder):
    return scan.profile(fx.sensor(spark, folder), ["fdom", "temp_c"])


@query()
def source_summary(spark, folder):
    """Quartiles and distinct counts of the readings of each site and of all, the latter merged from the former."""
    sites = scan.sketch(fx.sensor(spark, folder), ["fdom", "temp_c", "datetime"], ["site_id"])
    whole = scan.merge_sketches(sites).withColumn("site_id", F.lit("all"))
    return scan.read_sketches(sites.unionByName(whole))


@query(with_("targets", f"select site_id, datetime, {r('observation')} from (select * from targets order by datetime, site_id limit 6)"))
def preview_targets(spark, folder):
    return scan.preview(fx.targets(spark, folder).select("site_id", "datetime", "observation"), ["datetime", "site_id"])


@query("select distinct event_type as site_id, cast(ts as date) as datetime from events")
def distinct_site_days(spark, folder):
    rows = fx.sensor(spark, folder).withColumn("datetime", F.to_date("datetime"))
    return scan.distinct_values(rows, ["site_id", "datetime"])


@query(with_("targets", f"select site_id, count(*) as n, {r('avg(observation)', 'observation')} from targets group by 1"))
def forecast_files(spark, folder):
    path = work_path(spark, "forecasts")
    sinks.write_forecasts(forecast_format(spark, folder).withColumn("reference_datetime", F.trunc("datetime", "year")), path)
    rows = scan.open_dataset(spark, path)
    return rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("observation"))
