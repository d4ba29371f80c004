"""Scores of single forecasts and the one-pass scorer."""

import math

from pyspark.sql import functions as F

from tarncast import fixtures as fx
from tarncast.catalog.models import model_inputs
from tarncast.catalog.registry import query
from tarncast.catalog.roles import (
    MET,
    RAIN,
    ar_ctes,
    big,
    climatology_ctes,
    crps_normal as crps_normal_sql,
    logs_normal as logs_normal_sql,
    normal_scores,
    persistence_ctes,
    quantile,
    r,
    rs,
    sample_ctes,
    with_,
)
from tarncast.functions import scores
from tarncast.operators.ranks import ranked
from tarncast.plans import baselines, scoring
from tarncast.plans.campaign import BASELINE_MODELS, DRIVER_MODELS, campaign_sums, forecast_all, open_slices, run_slices
from tarncast.plans.common import standard_format
from tarncast.session import work_path

NORMAL = """(select l_orderkey, l_linenumber, l_quantity as mu, 1 + 100 * l_tax as sigma,
    l_quantity + 100 * (l_discount - 0.05) as observation from lineitem)"""


@query(f"select l_orderkey, l_linenumber, {r(crps_normal_sql('observation', 'mu', 'sigma'), 'crps')} from {NORMAL}")
def crps_normal(spark, folder):
    cases = fx.normal_cases(spark, folder)
    crps = scores.crps_normal(F.col("observation"), F.col("mu"), F.col("sigma"))
    return cases.select("l_orderkey", "l_linenumber", crps.alias("crps"))


@query(f"select l_orderkey, l_linenumber, {r(logs_normal_sql('observation', 'mu', 'sigma'), 'logs')} from {NORMAL}")
def logs_normal(spark, folder):
    cases = fx.normal_cases(spark, folder)
    logs = scores.logs_normal(F.col("observation"), F.col("mu"), F.col("sigma"))
    return cases.select("l_orderkey", "l_linenumber", logs.alias("logs"))


@query(f"select l_orderkey, l_linenumber, {r('mu - 1.959963984540054 * sigma', 'low')}, {r('mu + 1.959963984540054 * sigma', 'high')} from {NORMAL}")
def normal_interval(spark, folder):
    low, high = scoring.normal_interval(F.col("mu"), F.col("sigma"))
    return fx.normal_cases(spark, folder).select("l_orderkey", "l_linenumber", low.alias("low"), high.alias("high"))


ORDERS = [
    (
        "members",
        """select l_orderkey as case_id, l_extendedprice as prediction, o_totalprice as observation
        from lineitem join orders on o_orderkey = l_orderkey""",
    )
]


@query(with_("", f"select case_id, {r('crps', digits=4)} from sampled", ORDERS + sample_ctes("members", "case_id", logs=False)), digits=4)
def crps_sample(spark, folder):
    out = scoring.score_samples(fx.order_ensembles(spark, folder), ["case_id"], summaries=False, logs=False, bounded=True)
    return out.select("case_id", "crps")


@query(with_("", f"select case_id, {r('sign(logs) * ln(1 + abs(logs))', 'logs_scaled')} from sampled", ORDERS + sample_ctes("members", "case_id")))
def logs_sample(spark, folder):
    """Kernel log scores on a signed log scale: a tight ensemble far from its observation scores in the billions."""
    out = scoring.score_samples(fx.order_ensembles(spark, folder), ["case_id"], summaries=False, bounded=True)
    logs = F.col("logs")
    return out.select("case_id", (F.signum(logs) * F.log1p(F.abs(logs))).alias("logs_scaled"))


SUMMARY = "mean median sd quantile97_5 quantile02_5 q95 q05"


@query(with_("", f"select case_id, {rs(SUMMARY, 4)} from sampled", ORDERS + sample_ctes("members", "case_id", logs=False)), digits=4)
def ensemble_summary(spark, folder):
    out = scoring.score_samples(fx.order_ensembles(spark, folder), ["case_id"], y=None, logs=False, bounded=True)
    return out.select("case_id", *SUMMARY.split())


FLAGS = [("members", "select l_returnflag as case_id, l_extendedprice as prediction, 30000.0::double as observation from lineitem")]


@query(with_("", f"select case_id, {rs('crps logs ' + SUMMARY, 3)} from sampled", FLAGS + sample_ctes("members", "case_id")), digits=3)
def crps_sample_hot(spark, folder):
    """Three groups with a third of all rows each: ranked in slices, never in one task."""
    out = scoring.score_samples(fx.flag_ensembles(spark, folder), ["case_id"])
    return out.select("case_id", "crps", "logs", *SUMMARY.split())


@query("""select l_returnflag as case_id, l_quantity as prediction, cast(min(i) as bigint) as rank_lo, cast(max(i) as bigint) as rank_hi
    from (select *, row_number() over (partition by l_returnflag order by l_quantity) as i from lineitem) group by 1, 2""")
def ranks_in_hot_groups(spark, folder):
    rows = fx.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("case_id"), F.col("l_quantity").alias("prediction")
    )
    out = ranked(rows, ["case_id"], "prediction")
    return out.groupBy("case_id", "prediction").agg(F.min("rank_lo").alias("rank_lo"), F.max("rank_hi").alias("rank_hi"))


FAMILY_ROWS = """(select l_suppkey, l_quantity as y, case when l_returnflag = 'R' then 1.0::double else 0.0::double end as hit,
    0.5 + 5 * l_tax as spread, 1 + 100 * l_tax as scale, 0.02 + l_discount as rate, 0.05 + 5 * l_discount as prob,
    50 + 100 * l_tax as high from lineitem)"""


def _phi(x):
    from tarncast.catalog.roles import phi

    return phi(x)


LOGNORMAL_Z = "((ln(y) - 3) / spread)"
FAMILY_SQL = f"""
    select l_suppkey, 'lognormal' as family,
      y * (2 * {_phi(LOGNORMAL_Z)} - 1) - 2 * exp(3 + spread * spread / 2)
        * ({_phi(f'({LOGNORMAL_Z} - spread)')} + {_phi('(spread / sqrt(2))')} - 1) as crps,
      ln(spread) + 0.9189385332046727 + {LOGNORMAL_Z} ^ 2 / 2 + ln(y) as logs from {FAMILY_ROWS}
    union all
    select l_suppkey, 'logistic', scale * (a + 2 * ln(1 + exp(-a)) - 1), ln(scale) + a + 2 * ln(1 + exp(-a))
      from (select *, abs((y - 25) / scale) as a from {FAMILY_ROWS})
    union all
    select l_suppkey, 'exponential', abs(y) - (2 * (1 - exp(-rate * y)) - 0.5) / rate, rate * y - ln(rate) from {FAMILY_ROWS}
    union all
    select l_suppkey, 'uniform', high * (abs(y / high - c) + c * c - c + 1.0 / 3), ln(high)
      from (select *, least(greatest(y / high, 0), 1) as c from {FAMILY_ROWS})
    union all
    select l_suppkey, 'bernoulli', (hit - prob) ^ 2, -ln(case when hit = 1 then prob else 1 - prob end) from {FAMILY_ROWS}"""


def family_cases(spark, folder):
    """Each row of the order lines as an observation of five parametric families."""
    lines = fx.table(spark, folder, "lineitem").select(
        "l_suppkey",
        F.col("l_quantity").alias("y"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("hit"),
        (0.5 + 5 * F.col("l_tax")).alias("spread"),
        (1 + 100 * F.col("l_tax")).alias("width"),
        (0.02 + F.col("l_discount")).alias("hazard"),
        (0.05 + 5 * F.col("l_discount")).alias("chance"),
        (50 + 100 * F.col("l_tax")).alias("top"),
    )

    parameters = {
        "mu": ("lognormal", F.lit(3.0)),
        "sigma": ("lognormal", F.col("spread")),
        "location": ("logistic", F.lit(25.0)),
        "scale": ("logistic", F.col("width")),
        "rate": ("exponential", F.col("hazard")),
        "min": ("uniform", F.lit(0.0)),
        "max": ("uniform", F.col("top")),
        "prob": ("bernoulli", F.col("chance")),
    }
    families = ["lognormal", "logistic", "exponential", "uniform", "bernoulli"]
    cases = lines.withColumn("family", F.explode(F.array(*[F.lit(family) for family in families])))
    observation = F.when(F.col("family") == "bernoulli", F.col("hit")).otherwise(F.col("y"))
    own = [F.when(F.col("family") == family, value).alias(name) for name, (family, value) in parameters.items()]
    return cases.select("l_suppkey", "family", observation.alias("observation"), *own)


@query(f"select l_suppkey, family, {r('avg(crps)', 'crps')}, {r('avg(logs)', 'logs')} from ({FAMILY_SQL}) group by 1, 2")
def crps_families(spark, folder):
    scored = scoring.score_parametric(
        family_cases(spark, folder), ["lognormal", "logistic", "exponential", "uniform", "bernoulli"]
    )
    return scored.groupBy("l_suppkey", "family").agg(F.avg("crps").alias("crps"), F.avg("logs").alias("logs"))


def special_cases(spark, folder):
    """Distinct observations and parameters of the gamma, beta and Poisson families in the order lines."""
    lines = fx.table(spark, folder, "lineitem").groupBy(
        F.col("l_quantity").alias("y"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t")
    )
    rows = lines.agg(F.count(F.lit(1)).alias("n"))

    def case(family, observation, **parameters):
        names = ["shape", "rate", "shape1", "shape2", "lambda"]
        values = [parameters.get(p, F.lit(None)).cast("double").alias(p) for p in names]
        return F.struct(F.lit(family).alias("family"), observation.alias("observation"), *values)

    cases = F.array(
        case("gamma", F.col("y"), shape=2 + 100 * F.col("d"), rate=0.2 + F.col("t")),
        case("beta", F.col("y") / 51, shape1=1 + 10 * F.col("d"), shape2=1 + 20 * F.col("t")),
        case("poisson", F.col("y"), **{"lambda": 10 + 300 * F.col("d")}),
    )
    return rows.select("y", "d", "t", "n", F.explode(cases).alias("c")).select("y", "d", "t", "n", "c.*")


SPECIAL = "(select l_quantity as y, l_discount as d, l_tax as t, count(*) as n from lineitem group by 1, 2, 3)"
LOGS_SPECIAL = f"""
    select family, n, y, -(a * ln(b) + (a - 1) * ln(y) - b * y - lgamma(a)) as logs
      from (select 'gamma' as family, *, 2 + 100 * d as a, 0.2 + t as b from {SPECIAL})
    union all
    select family, n, y, -((a - 1) * ln(y / 51) + (b - 1) * ln(1 - y / 51) - lgamma(a) - lgamma(b) + lgamma(a + b))
      from (select 'beta' as family, *, 1 + 10 * d as a, 1 + 20 * t as b from {SPECIAL})
    union all
    select family, n, y, a - y * ln(a) + lgamma(y + 1) from (select 'poisson' as family, *, 10 + 300 * d as a from {SPECIAL})"""


@query(f"select family, y, cast(sum(n) as bigint) as n, {r('sum(n * logs) / sum(n)', 'logs')} from ({LOGS_SPECIAL}) group by 1, 2")
def logs_special_families(spark, folder):
    scored = scoring.score_parametric(special_cases(spark, folder))
    return scored.groupBy("family", "y").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("logs")) / F.sum("n")).alias("logs")
    )


@query(f"""select y, d, {r('sum((cdf - case when k >= y then 1 else 0 end) ^ 2)', 'crps')} from (
    select y, d, k, sum(exp(k * ln(a) - a - lgamma(k + 1))) over (partition by y, d order by k
        rows between unbounded preceding and current row) as cdf
    from (select distinct l_quantity as y, l_discount as d, 10 + 300 * l_discount as a from lineitem),
         (select unnest(range(0, 400)) as k)) group by 1, 2""")
def crps_poisson(spark, folder):
    cases = special_cases(spark, folder).filter(F.col("family") == "poisson")
    return scoring.score_parametric(cases).groupBy("y", "d").agg(F.first("crps").alias("crps"))


@query()
def crps_special_families(spark, folder):
    """Rows only: the incomplete gamma and beta functions have no SQL twin; tests integrate them."""
    scored = scoring.score_parametric(special_cases(spark, folder))
    return scored.groupBy("family", "y").agg((F.sum(F.col("n") * F.col("crps")) / F.sum("n")).alias("crps"))


# --- one pass over all models ----------------------------------------------------------------


def all_forecasts(spark, folder):
    """Both baselines and the three driver models in the shared long table, issued every day."""
    return forecast_all(*model_inputs(spark, folder), fx.VARIABLE, (*BASELINE_MODELS, *DRIVER_MODELS))


ALL_MODELS = persistence_ctes() + climatology_ctes() + MET + RAIN + ar_ctes(True) + [
    (
        "normals",
        """select p.*, t.observation from (select 'Persistence' as model_id, site_id, reference_datetime, datetime, mu, sigma from persistence
        union all select 'DOY', site_id, reference_datetime, datetime, mu, sigma from climatology) p
        left join targets t on t.site_id = p.site_id and t.datetime = p.datetime""",
    ),
    ("scored_normals", normal_scores("normals")),
    (
        "ensembles",
        """select p.*, t.observation from (
        select 'TS_Met' as model_id, site_id, reference_datetime, datetime, prediction from met
        union all select 'TS_Rain', site_id, reference_datetime, datetime, prediction from rain
        union all select 'TS_AR', site_id, reference_datetime, datetime, prediction from ar) p
        left join targets t on t.site_id = p.site_id and t.datetime = p.datetime""",
    ),
    # An ensemble is one sorted list; its scores are folds over the list.
    (
        "lists",
        """select model_id, site_id, reference_datetime, datetime, any_value(observation) as observation,
        count(*) = count(prediction) as whole, list(prediction order by prediction) as p
        from ensembles group by all""",
    ),
    (
        "listed",
        f"""select *, list_avg(p) as mean, sqrt(list_var_samp(p)) as sd, {quantile(0.5)} as median,
        {quantile(0.025)} as quantile02_5, {quantile(0.975)} as quantile97_5, {quantile(0.25)} as lower, {quantile(0.75)} as upper,
        list_min(list_transform(p, lambda x: abs(x - observation))) as nearest,
        2 * (len(p) * list_sum(list_transform(p, lambda x: greatest(x - observation, 0)))
             - list_sum(list_transform(p, lambda x, i: (x - observation) * (i - 0.5)))) / len(p) / len(p) as crps
        from lists where whole""",
    ),
    ("banded", "select *, nullif(1.06 * least(sd, (upper - lower) / 1.34) * len(p) ^ (-0.2), 0) as width from listed"),
    (
        "sampled",
        f"""select *, (nearest / width) ^ 2 / 2 + ln(width) + {0.5 * math.log(2 * math.pi)!r}
        - ln(list_sum(list_transform(p, lambda x: exp((nearest ^ 2 - (x - observation) ^ 2) / (2 * width ^ 2)))) / len(p)) as logs
        from banded""",
    ),
    (
        "all_scored",
        """select model_id, site_id, reference_datetime, datetime, observation, true as whole, crps, logs, mean, median, sd, quantile97_5, quantile02_5
        from scored_normals
        union all select model_id, site_id, reference_datetime, datetime, observation, true, crps, logs, mean, median, sd, quantile97_5, quantile02_5 from sampled
        union all select model_id, site_id, reference_datetime, datetime, observation, false, null, null, null, null, null, null, null from lists where not whole""",
    ),
]

CASE = ["model_id", "site_id", "reference_datetime", "datetime"]
#: A score beyond this bound counts as the bound in the sums: one diverging ensemble would otherwise hide all others.
MOST = 1e6


def clipped(name: str) -> str:
    return f"sum(greatest(least({name}, {MOST!r}), {-MOST!r}))"


def sums(names: list[str]) -> str:
    counts = ", ".join(f"count({name}) as {name}_known" for name in names)
    added = ", ".join(f"{clipped(name)} as {name}_sum" for name in names)
    shown = ", ".join(big(f"{name}_sum", f"{name}_sum") for name in names)
    known = ", ".join(f"{name}_known" for name in names)
    return f"""select model_id, site_id, horizon, cases, {known}, {shown} from (
        select model_id, site_id, datetime - reference_datetime as horizon, count(*) as cases, {counts}, {added} from all_scored group by 1, 2, 3)"""


def summed(scores, names: list[str]):
    """Cases, known values and their sums for each model, site and horizon."""
    within = lambda name: F.greatest(F.least(F.col(name), F.lit(MOST)), F.lit(-MOST))
    return scores.groupBy("model_id", "site_id", F.datediff("datetime", "reference_datetime").cast("bigint").alias("horizon")).agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.count(name).alias(f"{name}_known") for name in names],
        *[F.sum(within(name)).alias(f"{name}_sum") for name in names],
    )


SCORED = ["observation", "crps", "logs"]
SUMMARIZED = ["mean", "median", "sd", "quantile97_5", "quantile02_5"]


@query(with_("frame drivers targets", sums(SCORED), ALL_MODELS), digits=3, large=True)
def score_all(spark, folder):
    """Five models, every day of every site's record an issue: the scores of all cases, added for each horizon."""
    # The members of these models are numbered 1 to 31, so no group can be hot.
    return summed(scoring.score(all_forecasts(spark, folder), fx.targets(spark, folder), families=["normal"], bounded=True), SCORED)


@query(with_("frame drivers targets", sums(SUMMARIZED), ALL_MODELS), digits=3, large=True)
def forecast_summary(spark, folder):
    return summed(scoring.summarize(all_forecasts(spark, folder), families=["normal"], bounded=True), SUMMARIZED)


@query(with_("targets refs_day", f"""select model_id, site_id, datetime - reference_datetime as horizon, count(*) as cases, count(crps) as scored,
    {big('sum(crps)', 'crps_sum')}, {big('sum(logs)', 'logs_sum')}, 0::bigint as left_over from scored_normals group by 1, 2, 3""",
    [step for step in ALL_MODELS if step[0] in {name for name, _ in persistence_ctes() + climatology_ctes()} | {"normals", "scored_normals"}]), digits=3, large=True)
def campaign_resumed(spark, folder):
    """Both baselines for every issue day in slices of a month, killed after some slices and run again."""
    targets, refs, root = fx.targets(spark, folder), fx.daily_refs(spark, folder), work_path(spark, "campaign")

    def forecast(issues):
        return forecast_all(targets, None, None, None, issues, fx.VARIABLE, BASELINE_MODELS)

    def kill(step, slices):
        if step == "scores" and done:
            raise InterruptedError
        done.extend(slices)

    done = []
    try:
        run_slices(forecast, targets, refs, root, at_once=24, after_store=kill)
    except InterruptedError:
        pass
    run_slices(forecast, targets, refs, root, at_once=24)
    return campaign_sums(spark, root).withColumn("left_over", F.lit(open_slices(refs, root).count()).cast("bigint"))


@query(with_("targets refs_day", f"""select site_id, depth_m, reference_datetime, datetime, {r('crps', digits=4)} from (select * from scored_normals)""",
    persistence_ctes() + [("normals", """select p.*, t.observation, t.depth_m from (select p.*, case when site_id = '1-URGENT' then 1.6::double
        else 1.5::double end as d from persistence p) p left join targets t on t.site_id = p.site_id and t.datetime = p.datetime and t.depth_m = p.d"""),
     ("scored_normals", normal_scores("(select * exclude (depth_m), d as depth_m from normals)"))]), digits=4)
def score_by_depth(spark, folder):
    targets, refs = fx.targets(spark, folder), fx.daily_refs(spark, folder)
    walk = baselines.persistence(targets, refs)
    depth = fx.default_depth(F.col("site_id"), fx.FOCAL_DEPTHS, fx.OTHER_DEPTH)
    rows = standard_format(baselines.normal_rows(walk), "Persistence", "normal", fx.VARIABLE, depth)
    out = scoring.score(rows, targets, ["depth_m"], summaries=False, families=["normal"], bounded=True)
    return out.select("site_id", "depth_m", "reference_datetime", "datetime", "crps")


@query("""select o_orderpriority as site_id, cast(o_orderdate as date) as datetime, count(distinct o_totalprice) as observations
    from orders group by 1, 2 having count(distinct o_totalprice) > 1""")
def observation_conflicts(spark, folder):
    raw = fx.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("site_id"),
        F.to_date("o_orderdate").alias("datetime"),
        F.lit(fx.VARIABLE).alias("variable"),
        F.col("o_totalprice").alias("observation"),
    )
    forecast = raw.drop("observation").withColumn("model_id", F.lit("m"))
    out = scoring.single_observation_violations(forecast, raw)
    return out.select("site_id", "datetime", "observations")
