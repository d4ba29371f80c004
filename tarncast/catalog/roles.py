"""SQL of the test tables in their roles, and SQL text builders for the query twins."""

from __future__ import annotations

import math

from tarncast.catalog.registry import BEYOND, LARGE
from tarncast.functions.noise import PRIME
from tarncast.functions.special import (
    SQRT_2PI,
    TAIL_DENOMINATOR,
    TAIL_NUMERATOR,
    TAIL_SWITCH,
)

MEMBERS = 31
#: As in ``operators.regress``.
SINGULAR = 1e-12


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Settled float, see ``registry.settle``."""
    return f"round(({expr}) + 1e-9, {digits}) + 0.0 as {name or expr}"


def big(expr: str, name: str, digits: int = 3) -> str:
    """Settled float that may be very large, see ``registry.settle``."""
    v = f"greatest(least({expr}, {BEYOND!r}), {-BEYOND!r})"
    scale = f"(case when abs({v}) < {LARGE!r} then 1.0::double else pow(10.0::double, floor(log10(abs({v}))) - 2) end)"
    return f"case when ({expr}) is not null then round({v} / {scale} + 1e-9, {digits}) * {scale} + 0.0 end as {name}"


def rs(names: str, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names.split())


def u(key: str) -> str:
    return f"((('0x' || substr(md5({key}), 1, 8))::bigint + 0.5) / 4294967296.0)"


def z(key: str) -> str:
    return f"(sqrt(-2 * ln({u(f'{key} || {chr(39)}A{chr(39)}')})) * cos(2 * pi() * {u(f'{key} || {chr(39)}B{chr(39)}')}))"


def zkey(*parts: str) -> str:
    """Draw for a key made of SQL parts."""
    return z(f"concat_ws('|', {', '.join(parts)})")


def horner(x: str, coefficients) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def phi(x: str) -> str:
    """Normal distribution function."""
    a = f"abs({x})"
    e = f"exp(-{a} * {a} / 2)"
    tail = (
        f"case when {a} < {TAIL_SWITCH} then {e} * {horner(a, TAIL_NUMERATOR)} / {horner(a, TAIL_DENOMINATOR)}"
        f" else {e} / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / {SQRT_2PI} end"
    )
    return f"(case when {x} > 0 then 1 - ({tail}) else ({tail}) end)"


def crps_normal(y: str, mu: str, sigma: str) -> str:
    t = f"(({y} - {mu}) / {sigma})"
    density = f"(exp(-{t} * {t} / 2) / {math.sqrt(2 * math.pi)!r})"
    return (
        f"(case when {sigma} > 0 then {sigma} * ({t} * (2 * {phi(t)} - 1) + 2 * {density}"
        f" - {1 / math.sqrt(math.pi)!r}) end)"
    )


def logs_normal(y: str, mu: str, sigma: str) -> str:
    return (
        f"(case when {sigma} > 0 then ln({sigma}) + {0.5 * math.log(2 * math.pi)!r}"
        f" + (({y} - {mu}) / {sigma}) ^ 2 / 2 end)"
    )


VARIABLE = "'fdom_mean'"

CTES: dict[str, str] = {
    "sensor": """select event_type as site_id, ts as datetime, value as fdom, cast(5 + user_id % 25 as double) as temp_c,
        case when user_id % 2 = 0 then 0.1::double else 9.0::double end as depth_m, event_id from events""",
    "targets": f"""select o_orderpriority as site_id, cast(o_orderdate as date) as datetime,
        avg(o_totalprice) / 10000 as observation, {VARIABLE} as variable,
        case when o_orderpriority = '1-URGENT' then 1.6::double else 1.5::double end as depth_m
        from orders group by o_orderpriority, cast(o_orderdate as date)""",
    "history": """select cast(l_shipdate as date) as datetime, avg(l_discount) as rain, avg(l_quantity) as shortwave,
        avg(l_tax) as water_temp from lineitem group by cast(l_shipdate as date)""",
    "span": "select site_id, min(datetime) as first_day, max(datetime) as last_day from targets group by site_id",
    "refs_day": """select site_id, cast(unnest(generate_series(first_day, last_day, interval 1 day)) as date)
        as reference_datetime from span""",
    "refs_month": """select site_id,
        cast(unnest(generate_series(cast(date_trunc('month', first_day) as date), last_day, interval 1 month)) as date)
        as reference_datetime from span""",
    "scaffold": """select d.site_id, d.reference_datetime as datetime, t.observation from refs_day d
        left join targets t on t.site_id = d.site_id and t.datetime = d.reference_datetime""",
    "frame": """select s.*, h.rain, h.shortwave, h.water_temp,
        lag(s.observation) over w as observation_lag1, lag(h.rain) over w as rain_lag1,
        case when count(h.rain) over w10 = 10 then sum(h.rain) over w10 end as rain_10
        from scaffold s left join history h on h.datetime = s.datetime
        window w as (partition by s.site_id order by s.datetime),
               w10 as (partition by s.site_id order by s.datetime rows between 9 preceding and current row)""",
}


def _driver(column: str, number: int) -> str:
    key = f"((((g.reference_datetime - date '1970-01-01') * 31 + g.member) * 37 + g.horizon) * 7 + {number} + ascii(g.site_id)::bigint * 1000003)"
    for _ in range(2):
        key = f"(({key} % {PRIME} * ({key} % {PRIME} + 12345)) % {PRIME})"
    return f"coalesce(h.{column}, a.{column}) + 0.01 * g.horizon * ({key} / {PRIME} - 0.5) * {math.sqrt(12)!r} as {column}"


CTES["drivers"] = f"""select g.site_id, g.reference_datetime, g.member, g.horizon, g.datetime,
        {_driver('rain', 0)}, {_driver('shortwave', 1)}, {_driver('water_temp', 2)}
        from (select r.site_id, r.reference_datetime, m.member, k.horizon,
                     r.reference_datetime + cast(k.horizon as int) as datetime
              from refs_day r, (select unnest(range(1, {MEMBERS + 1})) as member) m,
                   (select unnest(range(0, 36)) as horizon) k) g
        left join history h on h.datetime = g.datetime,
        (select avg(rain) as rain, avg(shortwave) as shortwave, avg(water_temp) as water_temp from history) a"""

NEEDS = {
    "span": ["targets"],
    "refs_day": ["span"],
    "refs_month": ["span"],
    "scaffold": ["refs_day"],
    "frame": ["scaffold", "history"],
    "drivers": ["refs_day", "history"],
}


def with_(names: str, final: str, extra: list[tuple[str, str]] = (), recursive: bool = False) -> str:
    """``final`` preceded by the named roles, what they need, and the extra expressions."""
    order: list[str] = []

    def visit(name):
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} as ({CTES[n]})" for n in order] + [f"{n} as ({sql})" for n, sql in extra]
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {final}" if parts else final


def fit_ctes(xs: list[str], refs: str = "refs_day", frame: str = "frame", name: str = "fit", days: int | None = None,
             min_rows: int | None = None):
    """One regression for each (site, reference date), by sweeping the covariance matrix.

    A predictor of which the ones before leave nothing has no coefficient; with too few rows there are none.
    """
    k = len(xs)
    min_rows = min_rows or k + 2
    variables = [*xs, "observation"]
    complete = " and ".join(f"f.{v} is not null" for v in variables)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    moments = [f"avg(f.{v}) as m{i}" for i, v in enumerate(variables)]
    moments += [f"covar_samp(f.{variables[i]}, f.{variables[j]}) as a{i}_{j}" for i, j in pairs]
    limit = f"and f.datetime >= r.reference_datetime - {days}" if days else ""
    steps = [
        (
            f"{name}_0",
            f"""select r.site_id, r.reference_datetime, count(f.observation) as n, {', '.join(moments)}
            from {refs} r left join {frame} f on f.site_id = r.site_id and f.datetime < r.reference_datetime {limit}
            and {complete} group by r.site_id, r.reference_datetime""",
        )
    ]
    keep = ", ".join(f"m{i}" for i in range(k + 1))
    own = ", ".join(f"v{i}" for i in range(k + 1))

    def a(i, j):
        return f"a{min(i, j)}_{max(i, j)}"

    for p in range(k):
        d = a(p, p)
        used = f"coalesce({d} > {SINGULAR!r} * {f'v{p}' if p else d}, false)"
        cells = []
        for i, j in pairs:
            if (i, j) == (p, p):
                swept = f"-1 / {d}"
            elif p in (i, j):
                swept = f"{a(i, j)} / {d}"
            else:
                swept = f"{a(i, j)} - {a(i, p)} * {a(j, p)} / {d}"
            cells.append(f"case when {used} then {swept} else {a(i, j)} end as {a(i, j)}")
        before = [f"u{i}" for i in range(p)] + [own if p else ", ".join(f"{a(i, i)} as v{i}" for i in range(k + 1))]
        steps.append((f"{name}_{p + 1}", f"select site_id, reference_datetime, n, {keep}, {', '.join(before)}, {used} as u{p}, {', '.join(cells)} from {name}_{p}"))
    rss = f"greatest({a(k, k)}, 0)"
    long = f"n >= {min_rows}"
    rank = " + ".join(f"u{j}::int" for j in range(k))
    intercept = f"m{k} - ({' + '.join(f'case when u{j} then {a(j, k)} * m{j} else 0 end' for j in range(k))})"
    lever = " + ".join(f"case when u{i} and u{j} then m{i} * (-{a(i, j)}) * m{j} else 0 end" for i in range(k) for j in range(k))
    s2 = f"({rss} * (n - 1) / (n - ({rank}) - 1))"
    ses = [f"case when {long} then sqrt({s2} * (1.0 / n + ({lever}) / (n - 1))) end as se0"]
    ses += [f"case when {long} and u{j} then sqrt({s2} * (-{a(j, j)}) / (n - 1)) end as se{j + 1}" for j in range(k)]
    betas = [f"case when {long} then {intercept} end as b0", *[f"case when {long} and u{j} then {a(j, k)} end as b{j + 1}" for j in range(k)]]
    steps.append(
        (
            name,
            f"""select site_id, reference_datetime, n, {', '.join(betas)}, {', '.join(ses)},
            case when {long} then sqrt({rss}) end as sigma, case when {long} then {rss} * (n - 1) end as rss,
            case when {long} then 1 - {rss} / v{k} end as r2, case when {long} then {rank} end as rank,
            case when n < {min_rows} then 'short' when {rank} < {k} then 'collinear' else 'ok' end as status from {name}_{k}""",
        )
    )
    return steps


def draw(j: int) -> str:
    key = zkey("x.site_id", "x.reference_datetime", "x.member", f"'p{j}'")
    return f"(case when f.status <> 'short' then coalesce(f.b{j} + f.se{j} * {key}, 0) end)"


def members_of(source: str) -> str:
    """What the queries show of an ensemble: all members counted, the known ones, the outer ones and the one in the middle."""
    middle = f"any_value(case when parameter = '{MEMBERS // 2 + 1}' then prediction end)"
    shown = ", ".join(big(expr, name) for expr, name in (("low", "low"), ("middle", "middle"), ("high", "high")))
    return f"""select site_id, reference_datetime, datetime, members, known, {shown} from (
        select site_id, reference_datetime, datetime, count(*) as members, count(prediction) as known, min(prediction) as low,
        {middle} as middle, max(prediction) as high from {source} group by 1, 2, 3)"""


def quantile(q: float) -> str:
    """Linear quantile of a sorted list ``p``."""
    at = f"({q!r} * (len(p) - 1))"
    return f"(p[floor({at})::bigint + 1] + ({at} - floor({at})) * (p[ceil({at})::bigint + 1] - p[floor({at})::bigint + 1]))"


def noise() -> str:
    return f"f.sigma * {zkey('x.site_id', 'x.reference_datetime', 'x.member', chr(39) + 'proc' + chr(39), 'x.horizon')}"


MET = fit_ctes(["shortwave", "rain", "rain_lag1"], name="fit_met") + [
    (
        "met",
        f"""select x.site_id, x.reference_datetime, x.datetime, cast(x.member as varchar) as parameter,
        {draw(0)} + {draw(1)} * x.shortwave + {draw(2)} * x.rain + {draw(3)} * x.rain_lag1 + {noise()} as prediction
        from (select *, lag(rain) over (partition by site_id, reference_datetime, member order by horizon) as rain_lag1
              from drivers) x
        join fit_met f on f.site_id = x.site_id and f.reference_datetime = x.reference_datetime
        where x.horizon between 1 and 35""",
    )
]

RAIN = fit_ctes(["rain_10"], name="fit_rain") + [
    (
        "spliced",
        f"""select site_id, reference_datetime, member, horizon, datetime, rain from drivers
        union all
        select r.site_id, r.reference_datetime, m.member, -k.back, r.reference_datetime - cast(k.back as int), h.rain
        from refs_day r, (select unnest(range(1, {MEMBERS + 1})) as member) m,
        (select unnest(range(1, 11)) as back) k
        left join history h on h.datetime = r.reference_datetime - cast(k.back as int)""",
    ),
    (
        "rain",
        f"""select x.site_id, x.reference_datetime, x.datetime, cast(x.member as varchar) as parameter,
        {draw(0)} + {draw(1)} * x.rain_10 + {noise()} as prediction
        from (select *, case when count(rain) over w = 10 then sum(rain) over w end as rain_10 from spliced
              window w as (partition by site_id, reference_datetime, member order by horizon
                           rows between 9 preceding and current row)) x
        join fit_rain f on f.site_id = x.site_id and f.reference_datetime = x.reference_datetime
        where x.horizon between 1 and 35""",
    ),
]

# Each site's own driver history: the issue-day ensemble, which falls back on the mean of all days.
SITE_FRAME = [
    (
        "site_days",
        """select s.*, coalesce(h.rain, a.rain) as rain, coalesce(h.shortwave, a.shortwave) as shortwave,
        coalesce(h.water_temp, a.water_temp) as water_temp
        from scaffold s left join history h on h.datetime = s.datetime,
        (select avg(rain) as rain, avg(shortwave) as shortwave, avg(water_temp) as water_temp from history) a""",
    ),
    (
        "site_frame",
        """select *, lag(observation) over w as observation_lag1, lag(rain) over w as rain_lag1
        from site_days window w as (partition by site_id order by datetime)""",
    ),
]

AR_XS = ["observation_lag1", "shortwave", "rain", "rain_lag1", "water_temp"]


def ar_ctes(full: bool = True, frame: str = "frame"):
    b = [draw(j) if full else f"(case when f.status <> 'short' then coalesce(f.b{j}, 0) end)" for j in range(6)]
    eps = f" + {noise()}" if full else ""
    state = "t.observation"
    if full:
        ic = zkey("p.site_id", "p.reference_datetime", "p.member", "'ic'")
        state = f"t.observation + 0.07 * {ic}"
    return fit_ctes(AR_XS, name="fit_ar", frame=frame) + [
        (
            "forcing",
            f"""select x.site_id, x.reference_datetime, x.member, any_value({b[1]}) as slope,
            list({b[0]} + {b[2]} * x.shortwave + {b[3]} * x.rain + {b[4]} * x.rain_lag1
                 + {b[5]} * x.water_temp{eps} order by x.horizon) as f
            from (select *, lag(rain) over (partition by site_id, reference_datetime, member order by horizon) as rain_lag1
                  from drivers) x
            join fit_ar f on f.site_id = x.site_id and f.reference_datetime = x.reference_datetime
            where x.horizon between 1 and 34 group by x.site_id, x.reference_datetime, x.member""",
        ),
        (
            "walk",
            f"""select p.site_id, p.reference_datetime, p.member, list_reduce(list_transform(p.f, lambda x: [x]),
                lambda track, x: list_append(track, x[1] + p.slope * track[len(track)]), [{state}]) as track
            from forcing p left join targets t on t.site_id = p.site_id and t.datetime = p.reference_datetime""",
        ),
        (
            "ar",
            """select site_id, reference_datetime, reference_datetime + cast(horizon as int) as datetime,
            cast(member as varchar) as parameter, track[horizon + 1] as prediction
            from (select *, unnest(range(0, 35)) as horizon from walk)""",
        ),
    ]


def persistence_ctes(refs: str = "refs_day"):
    return [
        (
            "changes",
            """select *, case when datetime - lag(datetime) over w = 1 then observation - lag(observation) over w end as change
            from targets window w as (partition by site_id order by datetime)""",
        ),
        (
            "running",
            f"""select site_id, reference_datetime, last_value(day ignore nulls) over w as last_date,
            last_value(observation ignore nulls) over w as mu, avg(change * change) over w as step_variance,
            count(change) over w as changes
            from (select site_id, datetime as seen_on, 1 as turn, null as reference_datetime, datetime as day, observation, change
                  from changes
                  union all
                  select site_id, reference_datetime, 0, reference_datetime, null, null, null from {refs})
            window w as (partition by site_id order by seen_on, turn rows between unbounded preceding and current row)""",
        ),
        ("state", "select * from running where reference_datetime is not null and mu is not null"),
        (
            "persistence",
            """select s.site_id, s.reference_datetime, s.reference_datetime + cast(k.h as int) as datetime, s.mu,
            sqrt(s.step_variance * (s.reference_datetime + cast(k.h as int) - s.last_date)) as sigma
            from state s, (select unnest(range(1, 35)) as h) k""",
        ),
    ]


def climatology_ctes(refs: str = "refs_day"):
    return [
        (
            "by_doy",
            f"""select site_id, reference_datetime, datetime, avg(observation) over w as mu,
            stddev_samp(observation) over w as clim_sd
            from (select site_id, dayofyear(datetime) as doy, datetime as seen_on, 1 as turn, null as reference_datetime,
                         null as datetime, observation from targets
                  union all
                  select r.site_id, dayofyear(r.reference_datetime + cast(k.h as int)), r.reference_datetime, 0,
                         r.reference_datetime, r.reference_datetime + cast(k.h as int), null
                  from {refs} r, (select unnest(range(1, 36)) as h) k)
            window w as (partition by site_id, doy order by seen_on, turn rows between unbounded preceding and current row)""",
        ),
        (
            "climatology",
            """select site_id, reference_datetime, datetime, mu, sigma from (
                select *, count(*) over i as dates, median(clim_sd) over i as sigma from by_doy
                where reference_datetime is not null and mu is not null
                window i as (partition by site_id, reference_datetime)) where dates >= 3""",
        ),
    ]


def sample_ctes(source: str, keys: str, name: str = "sampled", logs: bool = True):
    """Scores and summaries of the ensembles in ``source`` (keys, prediction, observation).

    An ensemble with a missing member keeps its row, unscored.
    """
    d = "(prediction - observation)"
    results = ["crps", "mean", "median", "sd", "quantile97_5", "quantile02_5", "q95", "q05"] + (["logs"] if logs else [])
    whole = ", ".join(f"case when whole then {c} end as {c}" for c in results)
    last = [
        (
            f"{name}_groups",
            f"""select {keys}, any_value(observation) as observation, count(*) = count(prediction) as whole
            from {source} group by {keys}""",
        ),
        (
            name,
            f"""select {keys}, g.observation, {whole} from {name}_groups g left join {name}_known k using ({keys})""",
        ),
    ]
    steps = [
        (
            f"{name}_stats",
            f"""select {keys}, any_value(observation) as observation, count(*) as n, avg(prediction) as mean,
            median(prediction) as median, stddev_samp(prediction) as sd, quantile_cont(prediction, 0.975) as quantile97_5,
            quantile_cont(prediction, 0.025) as quantile02_5, quantile_cont(prediction, 0.95) as q95,
            quantile_cont(prediction, 0.05) as q05, quantile_cont(prediction, 0.75) - quantile_cont(prediction, 0.25) as iqr,
            min(abs{d}) as nearest from {source} where prediction is not null group by {keys}""",
        ),
        (
            f"{name}_crps",
            f"""select {keys}, 2 * (count(*) * sum(greatest({d}, 0)) - sum({d} * (i - 0.5))) / count(*) / count(*) as crps
            from (select *, row_number() over (partition by {keys} order by prediction) as i from {source}
                  where prediction is not null)
            group by {keys}""",
        ),
    ]
    if not logs:
        return steps + [(f"{name}_known", f"select * from {name}_stats join {name}_crps using ({keys})")] + last
    return steps + [
        (
            f"{name}_width",
            f"select *, nullif(1.06 * least(sd, iqr / 1.34) * n ^ (-0.2), 0) as width from {name}_stats",
        ),
        (
            f"{name}_kernels",
            f"""select {keys}, sum(exp((nearest ^ 2 - (x.prediction - x.observation) ^ 2) / (2 * width ^ 2))) as kernels
            from {source} x join (select {keys}, nearest, width from {name}_width) using ({keys})
            where x.prediction is not null group by {keys}""",
        ),
        (
            f"{name}_known",
            f"""select *, (nearest / width) ^ 2 / 2 - ln(kernels / n) + ln(width) + {0.5 * math.log(2 * math.pi)!r} as logs
            from {name}_width join {name}_crps using ({keys}) join {name}_kernels using ({keys})""",
        ),
    ] + last


Z_975, Z_95 = 1.959963984540054, 1.644853626951472


def normal_scores(source: str) -> str:
    """Scores and summaries of normal forecasts in ``source`` (mu, sigma, observation)."""
    return f"""select *, {crps_normal('observation', 'mu', 'sigma')} as crps, {logs_normal('observation', 'mu', 'sigma')} as logs,
        mu as mean, mu as median, sigma as sd, mu + {Z_975} * sigma as quantile97_5, mu - {Z_975} * sigma as quantile02_5,
        mu + {Z_95} * sigma as q95, mu - {Z_95} * sigma as q05 from {source}"""


MODELS = persistence_ctes() + climatology_ctes() + [
    (
        "both_models",
        """select p.site_id, p.reference_datetime, p.datetime, p.mu, p.sigma, c.mu as mu_c, c.sigma as sigma_c
        from persistence p join climatology c on c.site_id = p.site_id and c.reference_datetime = p.reference_datetime
        and c.datetime = p.datetime""",
    ),
    (
        "model_rows",
        """select m.*, t.observation, m.datetime - m.reference_datetime as horizon,
        case when model_id in ('Persistence', 'DOY') then 'Baseline' else 'Data Driven' end as model_type from (
          select site_id, reference_datetime, datetime, 'Persistence' as model_id, mu, sigma from both_models
          union all select site_id, reference_datetime, datetime, 'DOY', mu_c, sigma_c from both_models
          union all select site_id, reference_datetime, datetime, 'Shifted', mu + 0.5, sigma from both_models
          union all select site_id, reference_datetime, datetime, 'Blend', (mu + mu_c) / 2,
            sqrt((sigma * sigma + sigma_c * sigma_c) / 2) from both_models) m
        left join targets t on t.site_id = m.site_id and t.datetime = m.datetime""",
    ),
    ("scored", normal_scores("model_rows")),
]
