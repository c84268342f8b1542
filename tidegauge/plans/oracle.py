"""The catalogue's queries once more, as SQL for an independent engine."""

from __future__ import annotations

from ..functions.frequency import TENTS

ORACLE_SQL: dict[str, str] = {}


def _panel(name: str, select: str) -> str:
    """CTEs: ``name`` (period, series_id, value) and ``name``_full, complete with t."""
    return f"""
        {name} as ({select}),
        {name}_full as (
            select g.period, s.series_id, (datediff('month', b.low, g.period))::bigint as t, p.value
            from (select distinct series_id from {name}) s
            cross join (select min(period) as low, max(period) as high from {name}) b
            cross join lateral (select unnest(generate_series(b.low::timestamp, b.high::timestamp, interval 1 month))::date as period) g
            left join {name} p on p.series_id = s.series_id and p.period = g.period)"""


PRIO = _panel("prio", "select date_trunc('month', o_orderdate)::date as period, o_orderpriority as series_id, sum(o_totalprice) as value from orders group by 1, 2")
LINE = _panel(
    "line",
    "select date_trunc('month', l_shipdate)::date as period, l_returnflag || l_linestatus as series_id, sum(l_extendedprice * (1 - l_discount)) as value from lineitem group by 1, 2",
)
NATION = (
    _panel(
        "nat",
        """select date_trunc('month', o_orderdate)::date as period, n_name as series_id, sum(o_totalprice) as value
           from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""",
    )
    + """,
        spec as (
            select n_name as series_id, case when k % 5 = 0 then 'q' else 'm' end as frequency,
                   (['lin', 'chg', 'ch1', 'pch', 'pc1', 'pca', 'cch', 'cca', 'log'])[k % 9 + 1] as transformation,
                   ['Block_Global', 'Block_' || r_name] as blocks,
                   case when k % 4 = 2 then -(k % 20 + 1) when k % 4 <> 3 then k % 28 + 1 end as release_day, k as ord
            from (select *, n_nationkey::bigint as k from nation) join region on n_regionkey = r_regionkey),
        panel as (
            select f.period, f.series_id, f.t, frequency, transformation, blocks, release_day, ord,
                   case when frequency = 'm' or month(f.period) % 3 = 0 then value end as value
            from nat_full f join spec using (series_id)),
        released as (
            select *, case when release_day is null then period
                when release_day > 0 then (date_trunc('month', period) + to_days((least(release_day, day(last_day(period))) - 1)::int))::date
                when release_day < 0 then greatest((last_day(period - interval 1 month) + to_days((release_day + 1)::int))::date, (date_trunc('month', period) - interval 1 month)::date)
                end as release_date
            from panel),
        views as (
            select v.view_date, r.* exclude (value),
                   case when release_day is null or v.view_date >= release_date then value end as value
            from released r cross join (values (date '2001-03-10'), (date '2001-04-10'), (date '2001-05-10'), (date '2001-06-10'), (date '2001-07-10'), (date '2001-08-10')) v(view_date))"""
)
GAP = PRIO + """,
        gap as (
            select * exclude (value), case when (12 * year(period) + month(period) + ascii(series_id)) % 7 <> 0 then value end as value from prio_full)"""


def _z(name: str, source: str, clip: str = "value") -> str:
    return f""",
        {name} as (
            select *, (value - m) / case when s < 1e-8 then 1.0 else s end as z, m as mean, case when s < 1e-8 then 1.0 else s end as std
            from (select *, avg({clip}) over (partition by series_id) as m, stddev_pop({clip}) over (partition by series_id) as s from {source}))"""


def add(name: str, ctes: str, select: str, recursive: bool = False) -> None:
    ORACLE_SQL[name] = f"with {'recursive ' if recursive else ''}{ctes}\n        {select}" if ctes else select


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


CELL = f"period::varchar as period, series_id, {r('value')} as value"

add("panel_build", PRIO, f"select {CELL} from prio")
WIDE = ", ".join(f"{r(f'max(case when series_id = {q!r} then value end)')} as p{q[0]}" for q in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
add("panel_pivot_wide", PRIO, f"select period::varchar as period, {WIDE} from prio group by period")
add(
    "panel_unpivot",
    PRIO,
    f"""select p.period::varchar as period, 'p' || s.series_id[1] as series_id, {r('q.value')} as value
        from (select distinct period from prio) p cross join (values ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) s(series_id)
        left join prio q on q.period = p.period and q.series_id = s.series_id""",
)
add("panel_calendar_complete", NATION, f"select {CELL}, t from nat_full")
add("panel_date_filter", LINE, f"select {CELL} from line where period between date '1996-01-01' and date '1997-12-01'")
add("align_to_spec", NATION, f"select {CELL}, frequency, ord from nat join spec using (series_id) where ord % 2 = 0")
add("align_missing", NATION, "select series_id, ord from spec where series_id not in (select series_id from nat where series_id < 'NATION_2')")

EPS = "1e-10"
LAG = "lag(value, {}) over (partition by series_id order by t)"


def _transform(code: str, before: str, year: str, factor: str) -> str:
    def pct(b: str) -> str:
        return f"100.0 * (value - {b}) / nullif(abs({b} + {EPS}), 0)"

    def log(x: str) -> str:
        return f"ln(abs({x}) + {EPS})"

    return {
        "lin": "value",
        "chg": f"value - {before}",
        "ch1": f"value - {year}",
        "pch": pct(before),
        "pc1": pct(year),
        "pca": f"{factor} * {pct(before)}",
        "cch": f"100.0 * ({log('value')} - {log(before)})",
        "cca": f"{factor} * (100.0 * ({log('value')} - {log(before)}))",
        "log": log("value"),
    }[code]


CODES = ("lin", "chg", "ch1", "pch", "pc1", "pca", "cch", "cca", "log")
for _code in CODES:
    add(f"tf_{_code}", PRIO, f"select period::varchar as period, series_id, {r(_transform(_code, LAG.format(1), LAG.format(12), '12.0'))} as value from prio_full")

_CASES = " ".join(
    f"when frequency = '{f}' and transformation = '{c}' then {_transform(c, LAG.format(step), LAG.format(year), factor)}"
    for f, step, year, factor in (("m", 1, 12, "12.0"), ("q", 3, 4, "(4.0 / 3.0)"))
    for c in CODES
)
MIXED = NATION + f", mixed as (select period, series_id, t, transformation, frequency, case {_CASES} end as value from panel)"
add("tf_mixed_spec", MIXED, f"select {CELL}, transformation, frequency from mixed")
add(
    "drop_leading_null_rows",
    MIXED + ", chg_only as (select * exclude (value), case when transformation = 'chg' then value end as value from mixed)",
    f"select {CELL} from chg_only where t >= (select min(t) from chg_only where value is not null)",
)
add(
    "quality_obs_ratio",
    NATION,
    f"""select series_id, count(*) as n_periods, count(value) as n_obs, {r('1 - count(value) / count(*)')} as missing_share,
        1 - count(value) / count(*) > 0.9 as mostly_missing, count(value) < (select count(distinct series_id) from panel) as fewer_obs_than_series
        from panel group by series_id""",
)
add(
    "trim_sparse_rows",
    NATION + ", full_rows as (select t from nat_full group by t having count(*) - count(value) <= 0.8 * count(*))",
    f"select {CELL} from nat_full where t between (select min(t) from full_rows) and (select max(t) from full_rows)",
)
add("fill_median", NATION, f"select period::varchar as period, series_id, {r('coalesce(value, median(value) over (partition by series_id))')} as value from panel")



def _spline(source: str) -> str:
    """CTEs that fill ``source`` (series_id, period, t, value): inside has the curve, filled also the median at the ends, average the moving one."""
    return f""",
        k as (
            select series_id, t, value as y, row_number() over w as i, count(*) over (partition by series_id) as n,
                   (lead(t) over w - t)::double as h, (lead(value) over w - value) / (lead(t) over w - t) as s
            from {source} where value is not null window w as (partition by series_id order by t)),
        g as (
            select *, lag(h) over w as h1, lag(s) over w as s1, lag(h, 2) over w as h0, lag(s, 2) over w as s0, lead(h) over w as h2, lead(s) over w as s2
            from k window w as (partition by series_id order by i)),
        eq as (
            select series_id, i, n, case when i = 1 then 0 when i = n then h1 + h0 else h end as a,
                   case when i = 1 then h2 when i = n then h0 else 2 * (h1 + h) end as b, case when i = 1 then h + h2 when i = n then 0 else h1 end as c,
                   case when i = 1 then ((h + 2 * (h + h2)) * h2 * s + h * h * s2) / (h + h2) when i = n then ((h1 + 2 * (h1 + h0)) * h0 * s1 + h1 * h1 * s0) / (h1 + h0)
                        else 3 * (h * s1 + h1 * s) end as r from g),
        down as (
            select series_id, i, n, c / b as c, r / b as r from eq where i = 1
            union all
            select eq.series_id, eq.i, eq.n, eq.c / (eq.b - eq.a * down.c), (eq.r - eq.a * down.r) / (eq.b - eq.a * down.c)
            from down join eq on eq.series_id = down.series_id and eq.i = down.i + 1),
        up as (
            select series_id, i, r as d from down where i = n
            union all select down.series_id, down.i, down.r - down.c * up.d from up join down on down.series_id = up.series_id and down.i = up.i - 1),
        curve as (
            select k.series_id, k.t as t0, lead(k.t) over w as t1, y, up.d, h, (3 * s - 2 * up.d - lead(up.d) over w) / h as c2, (up.d + lead(up.d) over w - 2 * s) / (h * h) as c3
            from k join up on up.series_id = k.series_id and up.i = k.i window w as (partition by k.series_id order by k.t)),
        inside as (
            select p.series_id, p.period, p.t, p.value, coalesce(p.value, y + (p.t - t0) * (d + (p.t - t0) * (c2 + (p.t - t0) * c3))) as x
            from {source} p left join curve on curve.series_id = p.series_id and p.t > t0 and p.t < t1),
        filled as (
            select *, coalesce(x, median(x) over (partition by series_id)) as f, median(x) over (partition by series_id) as m,
                   min(t) over (partition by series_id) as low, max(t) over (partition by series_id) as high from inside),
        averaged as (
            select a.series_id, a.t, avg(b.f) as average from filled a cross join (select unnest(range(-3, 4)) as j)
            join filled b on b.series_id = a.series_id and b.t = least(greatest(a.t + j, a.low), a.high) where a.value is null group by all),
        done as (select filled.*, average from filled left join averaged using (series_id, t))"""


def _method(n: int, value: str, most: str) -> str:
    """One method over the gap panel: rows whose share of missing cells passes ``most`` bound the cut."""
    cut = f", full_rows as (select t from gap group by t having count(*) - count(value) <= {most} * count(*)), cut as (select * from gap where t between (select min(t) from full_rows) and (select max(t) from full_rows))"
    return f"(with recursive {GAP}{cut}{_spline('cut')} select period::varchar as period, series_id, {r(value, 2)} as value, {n}::bigint as method from done)"


ORACLE_SQL["missing_treated"] = " union all ".join(
    _method(*x) for x in ((1, "coalesce(value, average)", "1"), (2, "coalesce(value, m)", "0.8"), (3, "value", "0.8"), (4, "coalesce(x, average)", "(1 - 1e-9)"), (5, "coalesce(x, average)", "1"))
)
add("fill_spline", NATION + _spline("panel"), f"select period::varchar as period, series_id, {r('coalesce(x, average)', 2)} as value from done", True)
add("standardize", PRIO + _z("zs", "prio_full"), f"select period::varchar as period, series_id, {r('z')} as z from zs")
add("standardize_clipped", PRIO + _z("zs", "prio_full", "least(greatest(value, case when value is null then null else -2e6 end), case when value is null then null else 2e6 end)"), f"select period::varchar as period, series_id, {r('z')} as z from zs")
add("unstandardize", PRIO + _z("zs", "prio_full"), f"select period::varchar as period, series_id, {r('z * std + mean', 3)} as value from zs")

NZ = NATION + _z("zs0", "nat_full") + ", zs as (select period, t, series_id, z as value from zs0)"
PAIRS = ", pairs as (select x.series_id as a, y.series_id as b, x.t, x.value as x, y.value as y from zs x join zs y on x.t = y.t and x.series_id <= y.series_id where x.value is not null and y.value is not null)"
add(
    "cov_listwise",
    NZ + PAIRS + ", whole as (select t from zs group by t having count(value) = (select count(distinct series_id) from zs))",
    f"select a, b, {r('covar_samp(x, y)')} as covariance from pairs where t in (select t from whole) group by a, b",
)
add(
    "cov_pairwise",
    NZ + PAIRS,
    f"""select a, b, {r("case when count(x) < 2 then case when a = b then 1.0 else 0.0 end when a = b then greatest(covar_pop(x, y), 1e-10) else covar_pop(x, y) end")} as covariance
        from (select s.series_id as a, u.series_id as b from spec s join spec u on s.series_id <= u.series_id
              where s.series_id in (select series_id from zs) and u.series_id in (select series_id from zs)) left join pairs using (a, b) group by a, b""",
)
add(
    "var_safe",
    NZ + ", v as (select series_id, var_pop(case when series_id < 'C' then 1.0 else value end) as v from zs group by 1)",
    f"select series_id, {r('case when v >= 1e-10 then v else 1.0 end')} as variance from v",
)
add(
    "var_clean",
    NZ + ", v as (select series_id, case when series_id < 'C' then -1.0 when series_id < 'F' then null else var_pop(value) end as v from zs where t < 24 group by 1)",
    f"select series_id, {r('greatest(coalesce(case when v >= 0 then v end, (select median(v) from v where v >= 0), 1.0), 1e-8)')} as cleaned from v",
)

for _name, _where in (("release_date_pos", "release_day > 0"), ("release_date_neg", "release_day < 0 or release_day is null")):
    add(_name, NATION, f"select series_id, period::varchar as period, release_date::varchar as release_date from released where {_where}")
add("vintage_view", NATION, f"select {CELL} from views where view_date = date '2001-06-10'")
add("vintage_multi", NATION, f"select view_date::varchar as view_date, {CELL} from views")
add("vintage_availability", NATION, "select view_date::varchar as view_date, count(value) as n_available, count(*) - count(value) as n_missing from views group by 1")
add(
    "vintage_new_cells",
    NATION,
    f"select {CELL} from released where value is not null and release_day is not null and release_date > date '2001-05-10' and release_date <= date '2001-06-10'",
)
add(
    "period_parse",
    PRIO,
    """select distinct period::varchar as period, period::varchar as month,
        make_date(year(period), quarter(period) * 3, 1)::varchar as quarter, make_date(year(period), case when month(period) <= 6 then 1 else 7 end, 1)::varchar as half,
        make_date(year(period), 1, 1)::varchar as year, period::varchar as day, null::varchar as wrong from prio""",
)


def _end(f: str, d: str = "period") -> str:
    months = {"m": 1, "q": 3, "sa": 6, "a": 12}
    if f == "w":
        return f"(date_trunc('week', {d}) + interval 6 day)::date"
    n = months[f]
    return f"last_day(({d} + to_months(({n - 1} - (month({d}) - 1) % {n})::int))::date)"


def _next(f: str) -> str:
    if f == "d":
        return "(period + interval 1 day)::date"
    if f == "w":
        return f"({_end('w')} + interval 7 day)::date"
    return f"last_day(({_end(f)} + interval {dict(m=1, q=3, sa=6, a=12)[f]} month)::date)"


add(
    "period_end",
    PRIO,
    "select distinct period::varchar as period, "
    + ", ".join(f"{_end(f)}::varchar as end_{f}" for f in ("w", "m", "q", "sa", "a"))
    + ", "
    + ", ".join(f"{_next(f)}::varchar as next_{f}" for f in ("d", "w", "m", "q", "sa", "a"))
    + " from prio",
)
add(
    "date_range",
    PRIO + ", b as (select min(period)::timestamp as low, max(period)::timestamp as high from prio)",
    " union all ".join(
        f"select '{f}' as frequency, unnest(generate_series(low, high, interval {i}))::date::varchar as period from b" for f, i in (("w", "7 day"), ("m", "1 month"), ("q", "3 month"), ("a", "12 month"))
    ),
)
add(
    "backward_dates",
    PRIO + ", l as (select d, unnest(range(1, 15))::bigint as step from (select last_day(max(period)) as d from prio))",
    "select step, "
    + ", ".join(f"(d - {u}((step * {n})::int))::date::varchar as back_{f}" for f, u, n in (("d", "to_days", 1), ("w", "to_days", 7), ("m", "to_months", 1), ("q", "to_months", 3), ("sa", "to_months", 6), ("a", "to_months", 12)))
    + " from l",
)
add("freq_group", NATION, "select frequency, count(*) as n_series, min(ord) as first_ord, case frequency when 'm' then 3 else 4 end as freq_rank from spec group by frequency")
add("idio_chain_lengths", NATION, "select series_id, case frequency when 'm' then 1 else 5 end as chain from spec")
add("annual_factor", NATION, f"select series_id, case frequency when 'm' then 12 else 4 end as periods, {r('case frequency when $m$m$m$ then 12.0 else 4.0 / 3.0 end')} as factor from spec")
add("quarter_downsample", NATION, f"select {CELL}, frequency from panel")
add(
    "tent_aggregate",
    NATION + _z("zs", "nat_full"),
    "select period::varchar as period, series_id, round(("
    + " + ".join(f"{w}.0 * lag(z, {k}) over (partition by series_id order by t)" for k, w in enumerate((1, 2, 3, 2, 1)))
    + ") / 9.0, 6) + 0.0 as aggregate from zs",
)
add("block_membership", NATION, "select series_id, unnest(blocks) as block from spec")
add(
    "config_validate",
    NATION
    + """, m as (select series_id, unnest(blocks) as block, case when ord % 6 = 0 then 'w' when ord % 6 = 1 then 'x' else frequency end as f from spec)""",
    """select series_id, block, case when block = 'Block_ASIA' then 'unknown block' when f = 'x' then 'unknown frequency' when f = 'w' then 'faster than block clock'
        when block = 'Block_EUROPE' then 'no factors' end as issue from m where issue is not null""",
)

AR = GAP + _z("zs", "gap") + """,
        lagged as (select * from (select series_id, t, z, lag(z) over (partition by series_id order by t) as b from zs) where z is not null and b is not null),
        fit as (select series_id, sum(z * b) / sum(b * b) as phi, count(*) as n from lagged group by 1),
        noise as (select l.series_id, var_pop(z - phi * b) as q from lagged l join fit using (series_id) group by 1)"""
add("ar1_ols", AR, f"select series_id, {r('phi')} as phi, n from fit")
add("innovation_var", AR, f"select series_id, {r('q')} as q from noise")
add("stationary_var", AR, f"select series_id, {r('q / (1 - phi * phi)')} as stationary from noise join fit using (series_id)")
FACTOR = PRIO + _z("zs", "prio_full") + """,
        f as (select t, avg(z) as f from zs group by t having avg(z) is not null),
        rows_ as (select zs.series_id, zs.t, zs.z, f.f from zs join f using (t) where z is not null),
        loads as (select series_id, sum(z * f) / sum(f * f) as loading from rows_ group by 1),
        fits as (select rows_.*, loading, loading * f as fit from rows_ join loads using (series_id))"""
add("eligible_rows", GAP, "select t, count(value) as n_observed from gap group by t having count(value) >= greatest(2.0, 0.9 * count(*))")
add(
    "transition_from_sums",
    FACTOR + ", s as (select sum(a.f * a.f) as s11, sum(b.f * b.f) as s00, sum(a.f * b.f) as s10 from f a join f b on a.t = b.t + 1)",
    f"select {r('s10 / s00')} as a, {r('(s11 - s10 / s00 * s10) / ((select count(*) from f) - 1)')} as q from s",
)
add("suff_stats", FACTOR, f"select {r('sum(a.f * a.f)')} as s11, {r('sum(b.f * b.f)')} as s00, {r('sum(a.f * b.f)')} as s10 from f a join f b on a.t = b.t + 1")
add("loading_ls", FACTOR, f"select series_id, {r('loading')} as loading from loads")
add("obs_var", FACTOR, f"select series_id, {r('avg((z - fit) * (z - fit))')} as variance from fits group by 1")
add(
    "explained_variance",
    FACTOR,
    f"select series_id, {r('1 - avg((z - fit) * (z - fit)) / (avg((z - fit) * (z - fit)) + var_pop(fit))')} as explained from fits group by 1",
)
add(
    "reconstruction_corr",
    FACTOR,
    f"select series_id, {r('corr(z, fit)')} as correlation, {r('sqrt(avg((z - fit) * (z - fit)))')} as rmse, {r('avg(abs(z - fit))')} as mae from fits group by 1",
)
add("factor_stats", FACTOR, f"select 'F1' as factor, {r('avg(f)')} as mean, {r('stddev_pop(f)')} as std, {r('min(f)')} as low, {r('max(f)')} as high from f")

KALMAN = GAP + _z("zs", "gap") + """,
        k as (
            select series_id, -1::bigint as t, 0.0::double as z, 1.0::double as v, 0.0::double as zp, 1.0::double as vp, 0.0::double as loglik from (select distinct series_id from zs)
            union all
            select series_id, t, case when y is null then zp else zp + vp / (vp + 0.5) * (y - zp) end, case when y is null then vp else vp - vp / (vp + 0.5) * vp end, zp, vp,
                   loglik + case when y is null then 0.0 else -0.5 * (ln(vp + 0.5) + (y - zp) * (y - zp) / (vp + 0.5)) end
            from (select k.series_id, zs.t, zs.z as y, 0.8 * k.z as zp, 0.8 * 0.8 * k.v + 0.1 as vp, k.loglik from k join zs on zs.series_id = k.series_id and zs.t = k.t + 1)),
        last_ as (select * from k where t = (select max(t) from zs))"""
add("kalman_scalar", KALMAN, f"select series_id, {r('z')} as z, {r('v')} as v from last_", True)
add("kalman_loglik", KALMAN, f"select series_id, {r('loglik')} as loglik from last_", True)
add(
    "smoother_scalar",
    KALMAN
    + """,
        s as (
            select series_id, t, z, v from last_
            union all
            select k.series_id, k.t, k.z + k.v * 0.8 / n.vp * (s.z - n.zp), k.v + (k.v * 0.8 / n.vp) * (k.v * 0.8 / n.vp) * (s.v - n.vp)
            from s join k n on n.series_id = s.series_id and n.t = s.t join k on k.series_id = s.series_id and k.t = s.t - 1 where s.t > 0)""",
    f"select series_id, t, {r('z')} as z, {r('v')} as v from s",
    True,
)
add(
    "forecast_scalar",
    PRIO + _z("zs", "prio_full") + ", e as (select series_id, arg_max(z, t) as z, any_value(mean) as mean, any_value(std) as std from zs where z is not null group by 1)",
    f"select series_id, h, {r('z * pow(0.8, h)', 3)} as z_forecast, {r('z * pow(0.8, h) * std + mean', 3)} as forecast from e cross join (select unnest(range(1, 13))::bigint as h)",
)
add(
    "backtest_metrics",
    NATION
    + """, g as (
            select view_date, series_id, period, last_value(value ignore nulls) over (partition by view_date, series_id order by t rows between unbounded preceding and 1 preceding) as p from views),
        e as (select g.view_date, panel.value - p as e from g join panel using (series_id, period) where period = date '2001-06-01')""",
    f"select view_date::varchar as view_date, {r('avg(abs(e))', 3)} as mae, {r('avg(e * e)', 3)} as mse, {r('sqrt(avg(e * e))', 3)} as rmse, count(e) as n, count(*) - count(e) as n_failed from e group by 1",
)
add(
    "rmse_series_overall",
    PRIO + ", g as (select series_id, value - last_value(value ignore nulls) over (partition by series_id order by t rows between unbounded preceding and 1 preceding) as e from prio_full)",
    f"select series_id, count(*) as n, {r('sqrt(avg(e * e))', 3)} as rmse, {r('avg(abs(e))', 3)} as mae from g where e is not null group by rollup (series_id)",
)
add(
    "news_topk",
    NATION + ", c as (select series_id, t, value - lag(value) over (partition by series_id order by t) as change from nat_full where period <= date '2001-06-01')",
    f"select series_id, {r('change', 3)} as change from c where t = (select max(t) from c) order by abs(change) desc nulls last, series_id limit 5",
)
add(
    "state_lookback",
    GAP,
    "select period::varchar as period, series_id, " + ", ".join(f"{r(f'lag(value, {3 - k}) over (partition by series_id order by t)')} as h{k}" for k in range(4)) + " from gap",
)
add("latest_period", NATION, "select series_id, max(period)::varchar as latest, min(t) as first_t from nat_full where value is not null group by 1")
add(
    "horizon_extend",
    PRIO,
    f"""select {CELL}, t from prio_full
        union all select (max(period) + to_months(k::int))::date::varchar, series_id, null, max(t) + k from prio_full cross join (values (1), (2), (3)) h(k) group by series_id, k""",
)
add("period_lookup", PRIO, "select min(t) as t from prio_full where date_trunc('month', period) = date '2000-07-01'")
add("block_pattern_groups", NATION, "select array_to_string(list_sort(blocks), ',') as pattern, count(*) as n_series, string_agg(series_id, ',' order by series_id) as series from spec group by 1")
add("slower_series_count", NATION, "select sum(case frequency when 'q' then 1 else 0 end)::bigint as n_slower from spec")
add(
    "factor_recovery",
    PRIO
    + _z("zs", "prio_full")
    + ", x as (select t, avg(z) as a, avg(case when series_id > '1-V' then z end) as b from zs group by t), y as (select 'F1' as factor, * from x where a is not null and b is not null)",
    f"select factor, {r('corr(a, b)')} as correlation, {r('sqrt(avg((a - b) * (a - b)))')} as rmse from y group by rollup (factor)",
)
add(
    "covariance_top",
    NZ + PAIRS + ", c as (select a, b, covar_pop(x, y) as v from pairs where a < b group by a, b)",
    f"select a, b, {r('v')} as covariance from c order by abs(v) desc, a, b limit 5",
)
add(
    "events_daily_panel",
    """e as (select ts::date as period, event_type as series_id, sum(value) as value from events group by 1, 2)""",
    f"""select g.period::varchar as period, s.series_id, {r('e.value')} as value from (select distinct series_id from e) s
        cross join (select unnest(generate_series((select min(period) from e)::timestamp, (select max(period) from e)::timestamp, interval 1 day))::date as period) g
        left join e on e.series_id = s.series_id and e.period = g.period""",
)
add(
    "events_weekly_clock",
    "e as (select date_trunc('week', ts)::date as period, event_type as series_id, sum(value) as value from events group by 1, 2)",
    f"select {CELL}, datediff('day', (select min(period) from e), period) // 7 as t from e",
)

# a model whose parameters are given: one state, so a period's observations enter by two sums
LOADINGS = "(case series_id[1] when '1' then 1.0 when '2' then 0.9 when '3' then 0.8 when '4' then 0.7 else 0.6 end)"
FIXED = (
    GAP
    + _z("zs", "gap")
    + f""",
        known as (
            select *, {LOADINGS} as c,
                   case series_id[1] when '1' then (date_trunc('month', period) + to_days(4))::date when '2' then (date_trunc('month', period) + to_days(11))::date
                        when '3' then (last_day(period - interval 1 month) - 2)::date when '5' then (date_trunc('month', period) + to_days(least(25, day(last_day(period))) - 1))::date end as release_date
            from zs),
        target as (select t, z, value, mean, std from known where period = date '2001-06-01' and series_id = '5-LOW')"""
)


def _fixed(cells: str, a: str = "0.8", before: str = "") -> str:
    """Filter and smoother of ``cells`` (v, t, c, z; perhaps a): states f (v, t, z, p, zp, pp, ll) and s (v, t, z, p, j)."""
    return f"""{before or FIXED},
        cells as ({cells}),
        sums as (select v, t, {a}::double as a, count(z) as n, coalesce(sum(c * c / 0.5) filter (z is not null), 0.0) as w, coalesce(sum(c * z / 0.5), 0.0) as wy, coalesce(sum(z * z / 0.5), 0.0) as yy from cells group by v, t),
        f as (
            select v, -1::bigint as t, 0::bigint as n, 0.0::double as z, 1.0::double as p, 0.0::double as zp, 1.0::double as pp, 0.0::double as ll, 0.0::double as a from (select distinct v from sums)
            union all
            select v, t, n, (zp / pp + wy) / (1 / pp + w), 1 / (1 / pp + w), zp, pp,
                   ll - 0.5 * (n * ln(0.5) + ln(1 + pp * w) + (yy - 2 * zp * wy + zp * zp * w) - (wy - zp * w) * (wy - zp * w) / (1 / pp + w)), a
            from (select sums.*, sums.a * f.z as zp, sums.a * sums.a * f.p + 0.1 as pp, f.ll from f join sums on sums.v = f.v and sums.t = f.t + 1)),
        ends as (select v, max(t) as last_t from sums group by v),
        s as (
            select f.v, f.t, f.z, f.p, null::double as j from f join ends on f.v = ends.v and f.t = last_t
            union all
            select k.v, k.t, k.z + k.p * m.a / m.pp * (s.z - m.zp), k.p + (k.p * m.a / m.pp) * (k.p * m.a / m.pp) * (s.p - m.pp), k.p * m.a / m.pp
            from s join f m on m.v = s.v and m.t = s.t join f k on k.v = s.v and k.t = s.t - 1 where s.t >= 0)"""


WHOLE = _fixed("select 0 as v, t, c, z from known")
VIEWED = _fixed(
    "select d as v, t, c, case when release_date is null or d >= release_date then z end as z from known cross join (values "
    + ", ".join(f"(date '2001-{m:02d}-10')" for m in range(3, 9))
    + ") d(d)"
)
NOWCASTS = """,
        seen as (select v, n as n_available, total - n as n_missing from (select v, count(z) as n, count(*) as total from cells group by v)),
        own as (select cells.v, cells.z from cells join target using (t) where c = 0.6),
        now as (
            select s.v, case when own.z is not null then target.value else 0.6 * s.z * std + mean end as y, own.z is not null as observed, n_available, n_missing, target.value as actual
            from s join target using (t) join own using (v) join seen using (v))"""
add("fixed_filter", WHOLE, f"select t, n as n_observed, {r('z')} as z_filtered, {r('p')} as v_filtered from f", True)
add("fixed_smoother", WHOLE, f"select t, {r('z')} as z, {r('p')} as v from s", True)
add("fixed_loglik", WHOLE, f"select {r('max_by(ll, t)')} as loglik from f", True)
add(
    "fixed_em_step",
    WHOLE
    + """,
        pair as (select a.z, a.p, b.z as z0, b.p as p0, a.p * b.j as lag from s a join s b on a.t = b.t + 1),
        e as (select sum(z * z + p) as s11, sum(z0 * z0 + p0) as s00, sum(z * z0 + lag) as s10, count(*) as n from pair),
        x as (select series_id, c as c0, k.z as y, s.z, s.p from known k join s using (t) where k.z is not null),
        loads as (select series_id, sum(y * z) / sum(z * z + p) as c from x group by 1)""",
    f"""select name, i::bigint as i, {r('value', 5)} as value from (
            select 'a' as name, 0 as i, s10 / s00 as value from e
            union all select 'q', 0, (s11 - s10 * s10 / s00) / n from e
            union all select 'c', series_id[1]::int - 1, c from loads
            union all select 'r', series_id[1]::int - 1, avg((y - c * z) * (y - c * z) + c * c * p) from x join loads using (series_id) group by series_id
            union all select 'z0', 0, z from s where t = -1 union all select 'v0', 0, p from s where t = -1
            union all select 'loglik', 0, max_by(ll, t) from f)""",
    True,
)
add(
    "fixed_forecast",
    WHOLE,
    f"""select series_id, h, f.t + h as t, {r('c * f.z * pow(0.8, h) * std + mean', 2)} as value
        from f join ends on f.t = last_t cross join (select distinct series_id, c, std, mean from known) cross join (select unnest(range(1, 7))::bigint as h)""",
    True,
)
add("fixed_nowcast", VIEWED + NOWCASTS, f"select v::varchar as view_date, '5-LOW' as series_id, (select t from target) as t, {r('y', 2)} as nowcast, observed, n_available, n_missing from now", True)
#: What the target owes to each period of a view (owed forward along the gains, back through the filter), and the parts of new cells.
PARTS = """,
        pair as (select v, lag(v) over (order by v) as v0 from ends),
        owed as (
            select ends.v, target.t, 0.6::double as o from ends cross join target
            union all select owed.v, owed.t + 1, o * s.j from owed join s on s.v = owed.v and s.t = owed.t join ends on ends.v = owed.v where owed.t < last_t),
        back as (
            select v, last_t + 1 as t, 0.0::double as d, 0.0::double as ahead from ends
            union all
            select x.v, x.t, f.p * u, u - sums.w * f.p * u - case when x.t > target.t then o else 0 end
            from (select back.v, back.t - 1 as t, 0.8 * ahead + coalesce(o, 0) as u, coalesce(o, 0) as o
                  from back left join owed on owed.v = back.v and owed.t = back.t - 1) x
            join f on f.v = x.v and f.t = x.t join sums on sums.v = x.v and sums.t = x.t cross join target),
        fresh as (
            select pair.v, n.t, n.c, known.series_id, known.value as actual, n.c * s.z * known.std + known.mean as expected,
                   case when own0.z is not null then 0 when own.z is not null then (n.t = target.t and n.c = 0.6)::int
                        else n.c / 0.5 * d * target.std / known.std end as weight
            from pair join cells n on n.v = pair.v and n.z is not null join cells o on o.v = v0 and o.t = n.t and o.c = n.c and o.z is null
            join s on s.v = v0 and s.t = n.t join back on back.v = pair.v and back.t = n.t join known on known.t = n.t and known.c = n.c
            join own on own.v = pair.v join own own0 on own0.v = v0 cross join target),
        parts as (
            select v, series_id as news_series, count(*) as n_cells, avg(actual) as actual, avg(expected) as expected, avg(weight) as weight, sum(weight * (actual - expected)) as news
            from fresh group by v, series_id)"""
ERRORS = NOWCASTS + ", errors as (select v, y, actual, y - actual as e from now)"
add(
    "fixed_news",
    VIEWED + NOWCASTS + PARTS,
    f"""select pair.v::varchar as view_date, v0::varchar as before_date, {r('b.y', 2)} as y_old, {r('now.y', 2)} as y_new, news_series, coalesce(n_cells, 0) as n_cells,
               {r('parts.actual', 2)} as actual, {r('expected', 2)} as expected, {r('weight', 2)} as weight, {r('coalesce(news, 0)', 2)} as news
        from pair join now on now.v = pair.v join now b on b.v = v0 left join parts on parts.v = pair.v where v0 is not null""",
    True,
)
add(
    "fixed_backtest",
    VIEWED + ERRORS + PARTS,
    f"""select dense_rank() over (order by v) - 1 as step, v::varchar as view_date, {r('y', 2)} as nowcast, {r('actual', 2)} as actual, {r('e', 2)} as error, {r('abs(e)', 2)} as abs_error,
               null::varchar as failed, news_series, {r('news', 2)} as news
        from errors left join (select v, news_series, news from parts) using (v)""",
    True,
)
add("fixed_backtest_summary", VIEWED + ERRORS, f"select {r('avg(abs(e))', 2)} as mae, {r('sqrt(avg(e * e))', 2)} as rmse, count(e) as n, count(*) - count(e) as n_failed from errors", True)


def _blind(back: str) -> str:
    """The panel up to each target period, without the target's own last cell."""
    return _fixed(f"select target.t - k as v, known.t, c, case when known.t < target.t - k or series_id <> '5-LOW' then known.z end as z from known cross join target cross join ({back}) b(k) where known.t <= target.t - k")


add(
    "fixed_dataset",
    _blind("values (0), (1), (2), (3)"),
    f"""select f.t, '5-LOW' as series_id, {r('0.6 * f.z * std + mean', 2)} as baseline, {r('known.value', 2)} as actual, {r('known.value - (0.6 * f.z * std + mean)', 2)} as target, {r('f.z', 2)} as factor
        from f join known on known.t = f.t and known.series_id = '5-LOW' where f.v = f.t""",
    True,
)
add(
    "fixed_dataset_weeks",
    _fixed(
        """select b.p * 100 + step as v, known.t, c, case when known.period <= d and (release_date is null or release_date <= d) and not (known.t = b.p and series_id = '5-LOW') then known.z end as z
           from known cross join (select target.t - k as p, (date '2001-06-01' - to_months(k::int) - to_days((42 - 7 * step)::int))::date as d, step
                                  from target cross join (values (0), (1)) x(k) cross join (select unnest(range(0, 7)) as step)) b"""
    ),
    f"select s.t, s.v % 100 as step, {r('0.6 * s.z * std + mean', 2)} as nowcast from s cross join target where s.t = s.v // 100",
    True,
)
add(
    "fixed_state",
    _blind("values (0), (12)") + ", h as (select t, value as h3, lag(value) over (order by t) as h2, lag(value, 2) over (order by t) as h1, mean, std from known where series_id = '5-LOW')",
    f"select f.t, '5-LOW' as series_id, {r('0.6 * f.z * std + mean', 2)} as nowcast, {r('h1', 2)} as h1, {r('h2', 2)} as h2, {r('h3', 2)} as h3, {r('h3 - (0.6 * f.z * std + mean)', 2)} as residual from f join h using (t) where f.v = f.t",
    True,
)

# a model a nation: the same recursion for 25 of them, each with its own coefficient
MODELS = _fixed(
    f"select v, t, {LOADINGS} as c, z, a from zs",
    "max(a)",
    _panel("np", """select date_trunc('month', o_orderdate)::date as period, n_name || '|' || o_orderpriority as series_id, sum(o_totalprice) as value
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""")
    + _z("zn", "np_full")
    + """, zs as (
            select split_part(series_id, '|', 1) as v, split_part(series_id, '|', 2) as series_id, t, z, 0.5 + 0.01 * n_nationkey as a
            from zn join nation on n_name = split_part(series_id, '|', 1))""",
)
add("wide_states", MODELS, f"select f.v as model, t, n as n_observed, {r('f.z')} as z_filtered, {r('f.p')} as v_filtered, {r('s.z')} as z, {r('s.p')} as v from f join s using (v, t)", True)
add(
    "wide_em_step",
    MODELS
    + """,
        pair as (select a.v, a.z, a.p, b.z as z0, b.p as p0, a.p * b.j as lag from s a join s b on a.v = b.v and a.t = b.t + 1),
        e as (select v, sum(z * z + p) as s11, sum(z0 * z0 + p0) as s00, sum(z * z0 + lag) as s10, count(*) as n from pair group by v),
        x as (select k.v, series_id, k.z as y, s.z, s.p from zs k join s using (v, t) where k.z is not null),
        loads as (select v, series_id, sum(y * z) / sum(z * z + p) as c from x group by all)""",
    f"""select v as model, name, series_id, {r('value', 5)} as value from (
            select v, 'a' as name, '' as series_id, s10 / s00 as value from e
            union all select v, 'q', '', (s11 - s10 * s10 / s00) / n from e
            union all select v, 'c', series_id, c from loads
            union all select v, 'r', series_id, avg((y - c * z) * (y - c * z) + c * c * p) from x join loads using (v, series_id) group by v, series_id
            union all select v, 'z0', '', z from s where t = -1 union all select v, 'v0', '', p from s where t = -1
            union all select v, 'loglik', '', max_by(ll, t) from f group by v)""",
    True,
)
add(
    "wide_weights",
    MODELS
    + """,
        owed as (
            select v, 40::bigint as t, 0.6::double as o from ends
            union all select owed.v, owed.t + 1, o * s.j from owed join s on s.v = owed.v and s.t = owed.t join ends on ends.v = owed.v where owed.t < last_t),
        back as (
            select v, last_t + 1 as t, 0.0::double as d, 0.0::double as ahead, 0.0::double as a from ends
            union all
            select x.v, x.t, f.p * u, u - sums.w * f.p * u - case when x.t > 40 then o else 0 end, f.a
            from (select back.v, back.t - 1 as t, back.a * ahead + coalesce(o, 0) as u, coalesce(o, 0) as o
                  from back left join owed on owed.v = back.v and owed.t = back.t - 1) x
            join f on f.v = x.v and f.t = x.t join sums on sums.v = x.v and sums.t = x.t)""",
    f"select v as model, t, series_id, {r(f'{LOADINGS} / 0.5 * d')} as weight from zs join back using (v, t) where z is not null",
    True,
)

# result tables, recovery, small linear algebra
add("wide_factors", FACTOR, f"select t, {r('f')} as F1 from f")
FITTED = FACTOR + ", whole as (select t, series_id, loading * f * std + mean as x, loading, std, value from zs z join f using (t) join loads using (series_id))"
add("wide_smoothed", FITTED, "select t, " + ", ".join(f"{r(f'max(case when series_id[1] = {k!r} then x end)', 3)} as p{k}" for k in "12345") + " from whole group by t")
add(
    "series_report",
    FITTED,
    f"select series_id, {r('any_value(abs(loading))', 5)} as largest, {r('any_value(loading * loading)', 5)} as squares, {r('100 * sqrt(avg((x - value) * (x - value))) / any_value(std)', 5)} as rmse_percent from whole group by series_id",
)
add("diagnose_top", FACTOR, f"select * from (select row_number() over (order by abs(loading) desc, series_id) as rank, series_id, 'Block_Global' as block, {r('loading')} as value from loads) where rank <= 3")
add(
    "factor_recovery_rotated",
    FACTOR + ", x as (select 0 as k, f as a, (0.5 - f) * (select case when sum(f * (0.5 - f)) < 0 then -1 else 1 end from f) as b from f)",
    f"select k::bigint as k, {r('corr(a, b)')} as correlation, {r('sqrt(avg((a - b) * (a - b)))')} as rmse from x group by rollup (k)",
)
add(
    "loading_recovery",
    FACTOR
    + _z("zp", "(select * from prio_full where t < 40)")
    + """,
        g as (select t, avg(z) as f from zp group by t having avg(z) is not null),
        part as (select series_id, sum(z * f) / sum(f * f) as loading from zp join g using (t) where z is not null group by 1),
        y as (select 0 as k, loads.loading as a, part.loading * (select case when sum(l.loading * p.loading) < 0 then -1 else 1 end from loads l join part p using (series_id)) as b from loads join part using (series_id))""",
    f"select k::bigint as k, {r('corr(a, b)')} as correlation, {r('sqrt(avg((a - b) * (a - b)))')} as rmse from y group by rollup (k)",
)
add(
    "pca_pair",
    PRIO
    + _z("zs", "(select * from prio_full where series_id < '3')")
    + """,
        w as (select t, max(case when series_id[1] = '1' then z end) as x, max(case when series_id[1] = '2' then z end) as y from zs group by t),
        m as (select var_samp(x) as a, var_samp(y) as d, covar_samp(x, y) as b from w where x is not null and y is not null),
        top as (select *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) as e from m),
        v as (select sign(b) * b / sqrt(b * b + (e - a) * (e - a)) as v1, sign(b) * (e - a) / sqrt(b * b + (e - a) * (e - a)) as v2 from top)""",
    f"""select 'loading' as kind, '1-URGENT' as series_id, null::bigint as t, {r('v1')} as value from v union all select 'loading', '2-HIGH', null, {r('v2')} from v
        union all select 'factor', null, t, {r('case when x is not null or y is not null then coalesce(x * v1, 0) + coalesce(y * v2, 0) end')} from w cross join v""",
)
add(
    "constrained_pair",
    PRIO
    + _z("zs", "prio_full")
    + ", w as (select t, max(case when series_id[1] = '1' then z end) as a, max(case when series_id[1] = '2' then z end) as b, max(case when series_id[1] = '3' then z end) as y from zs group by t), l as (select sum((a + b) * y) / sum((a + b) * (a + b)) as l from w where a is not null and b is not null and y is not null)",
    f"select x, {r('l')} as loading from l cross join (values ('a'), ('b')) n(x)",
)

# sources and small relational operators
ORACLE_SQL["csv_dates_down"] = ORACLE_SQL["panel_unpivot"]
add("csv_dates_across", LINE, f"select {CELL} from line_full where period between date '1996-01-01' and date '1996-12-01' and series_id in (select series_id from line where period between date '1996-01-01' and date '1996-12-01')")
ORACLE_SQL["parquet_years"] = ORACLE_SQL["panel_date_filter"]
CUT = NATION.replace("on c_nationkey = n_nationkey group by 1, 2", "on c_nationkey = n_nationkey where o_orderdate >= date '1996-01-01' and o_orderdate < date '2001-01-01' group by 1, 2").replace(
    "case when frequency = 'm' or month(f.period) % 3 = 0 then value end as value", "value"
)
add(
    "load_pipeline",
    CUT + f", mixed as (select period, series_id, t, value as raw_value, case {_CASES} end as value from panel)",
    f"select {CELL}, t, {r('raw_value')} as raw_value from mixed where t >= (select min(t) from mixed where value is not null)",
)
add("result_store", FACTOR, f"select 'loading:Block_Global' as kind, series_id as name, {r('loading')} as value, 2::bigint as stored from loads")
add("views_newest_first", NATION, "select row_number() over (order by view_date desc) - 1 as place, view_date::varchar as view_date, count(value) as n_available from views where month(view_date) in (4, 5, 7) group by view_date")
add("view_latest", NATION, f"select {CELL} from views where view_date = date '2001-06-10'")
add("appended_columns", GAP, f"select period::varchar as period, series_id, {r(LAG.format(1))} as lag1, {r(LAG.format(12))} as lag12 from gap")
add("distinct_codes", NATION, "select distinct frequency, transformation from spec")
add(
    "spec_from_flags",
    NATION,
    "select series_id, frequency, transformation, array_to_string(list_sort([b for b in blocks if b in ('Block_Global', 'Block_ASIA', 'Block_EUROPE')]), ',') as blocks, release_day from spec",
)
add("config_merged", NATION, "select series_id, ord, 9::bigint as max_iter, 0.25::double as threshold, 6::bigint as n_blocks, 2::bigint as global_factors from spec where ord < 3")
add("config_yaml", NATION, "select series_id, frequency, transformation, release_day, array_to_string(blocks, ',') as blocks, 3::bigint as max_iter from spec where ord % 3 = 0")

# calendar and frequencies once more
add(
    "timestamp_forms",
    PRIO,
    "select distinct (period + 9)::date::varchar as day, " + ", ".join(f"(period + 9)::date::varchar as {n}" for n in ("iso", "time", "letter", "slashes", "american", "european", "seconds")) + ", null::varchar as wrong from prio",
)
add(
    "calendar_parts",
    PRIO,
    """select distinct period::varchar as period, day(last_day(period)) as days, case when day(last_day(period)) = 31 then last_day(period)::varchar end as day31,
        strftime(period, '%m/%Y') as label, period::varchar as same from prio""",
)
add(
    "date_range_periods",
    PRIO + ", b as (select last_day(min(period)) as low from prio)",
    " union all ".join(
        f"select '{f}' as frequency, (low + {u}((k * {n})::int))::date::varchar as period from b cross join (select unnest(range(0, 7)) as k)"
        for f, u, n in (("d", "to_days", 1), ("w", "to_days", 7), ("m", "to_months", 1), ("q", "to_months", 3), ("sa", "to_months", 6), ("a", "to_months", 12))
    ),
)


def _power(name: str, matrix: str, steps: int = 600) -> str:
    """The vector of the largest eigenvalue of a matrix held as a list of rows, by repeated multiplication."""
    return f"""
        {name}_steps as (
            select 0 as k, m, list_transform(m, lambda x, i: 1.0 + i / 7.0) as v from {matrix}
            union all
            select k + 1, m, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
            from (select k, m, list_transform(m, lambda x: list_dot_product(x, v)) as w from {name}_steps where k < {steps})),
        {name} as (select m, list_transform(v, lambda x: x * sign(v[1])) as v, list_dot_product(v, list_transform(m, lambda x: list_dot_product(x, v))) as e from {name}_steps where k = {steps})"""


PCA = (
    LINE
    + _z("zs0", "line_full")
    + ", zs as (select t, series_id, z as value from zs0)"
    + PAIRS
    + """,
        whole as (select t from zs group by t having count(value) = (select count(distinct series_id) from zs)),
        c as (select a, b, covar_samp(x, y) as v from pairs where t in (select t from whole) group by a, b),
        cells as (select a, b, v from c union all select b, a, v from c where a < b),
        m1 as (select list(x order by a) as m from (select a, list(v order by b) as x from cells group by a)),
        names as (select list(series_id order by series_id) as names from (select distinct series_id from zs)),"""
    + _power("p1", "m1")
    + ", m2 as (select list_transform(m, lambda x, i: list_transform(x, lambda y, j: y - e * v[i] * v[j])) as m from p1),"
    + _power("p2", "m2")
    + """,
        loads as (
            select unnest(names) as series_id, 0 as k, unnest(v) as w from p1, names
            union all select unnest(names), 1, unnest(v) from p2, names)"""
)
add("pca_loadings", PCA, f"select series_id, k::bigint as k, {r('w')} as value from loads", True)
add("pca_factor", PCA, f"select t, k::bigint as k, {r('sum(value * w)')} as value from zs join loads using (series_id) group by t, k", True)

# frequencies, clocks and tents by nation
CLOCKS = (
    NATION
    + """, clocks as (
            select series_id, ord, (['d', 'w', 'm', 'q', 'sa', 'a'])[ord % 6 + 1] as clock, (['d', 'w', 'm', 'q', 'sa', 'a'])[ord % 6 + ord % 3 + 2] as slow, ord % 6 + 1 as place from spec),
        pairs(slow, clock, w) as (values """
    + ", ".join(f"('{s}', '{c}', {list(w)})" for (s, c), w in TENTS.items())
    + """),
        tents as (
            select series_id, c.slow, c.clock, coalesce(w, [least(k, ord % 3 + 3 - k)::int for k in range(1, ord % 3 + 3)]) as w
            from clocks c left join pairs p on p.slow = c.slow and p.clock = c.clock where c.slow is not null)"""
)
add(
    "clock_table",
    CLOCKS,
    """select series_id, clock, place as freq_rank, ([365, 52, 12, 4, 2, 1])[place]::bigint as periods, case when place > 1 then (['d', 'w', 'm', 'q', 'sa'])[place - 1] end as higher,
              case when clock = 'sa' then 6 else 1 end * (ord % 4 + 1) as horizon, (['D', 'W', 'ME', 'QE', 'ME', 'YE'])[place] as alias from clocks""",
)
add("tent_weights", CLOCKS, "select series_id, slow, clock, k - 1 as k, w[k]::bigint as weight from tents cross join lateral (select unnest(range(1, len(w) + 1)) as k)")
add(
    "tent_constraint_matrix",
    CLOCKS,
    """select series_id, i, j, case when j = 0 then w[1]::double when j = i + 1 then -w[j + 1]::double else 0.0 end as value
       from tents cross join lateral (select unnest(range(0, len(w) - 1)) as i) cross join lateral (select unnest(range(0, len(w))) as j)""",
)
add(
    "tent_shapes",
    NATION + ", p as (select series_id, ord % 12 + 1 as n, unnest(range(0, ord % 12 + 1)) as k from spec), e as (select series_id, n, k, exp(-4.0 * abs(k - n / 2.0) / n) as x from p)",
    """select series_id, 'symmetric' as shape, k, least(k, n - 1 - k) + 1 as weight from p union all select series_id, 'linear', k, 1 from p
        union all select series_id, 'exponential', k, floor(x * n / sum(x) over (partition by series_id))::bigint from e""",
)
add("aggregation_structure", CLOCKS, "select clock, slow as frequency, count(*) as n_series, len(w)::bigint as n, array_to_string(w, ',') as weights from tents group by clock, slow, w")
add(
    "em_convergence",
    PRIO
    + _z("zs", "prio_full")
    + """, l as (select series_id as run, t as iteration, avg(-0.5 * (ln(6.283185307179586) + z * z)) over (partition by series_id order by t rows unbounded preceding) as loglik from zs where z is not null),
        m as (select *, lag(loglik) over (partition by run order by iteration) as before, lag(iteration) over (partition by run order by iteration) as prior from l)""",
    f"""select run, iteration, {r('2 * abs(loglik - before) / (abs(loglik) + abs(before) + 2.220446049250313e-16)')} as change,
               2 * abs(loglik - before) / (abs(loglik) + abs(before) + 2.220446049250313e-16) < 5e-3 as converged, loglik - before < -1e-3 as decreased
        from m where before is not null and prior = iteration - 1""",
)
add(
    "stationary_pair",
    NATION
    + """, v as (
            select series_id, ord / 100.0::double as x, 0 as k, 1.0::double as a, 0.0::double as b, 1.0::double as d from spec
            union all
            select series_id, x, k + 1, (0.5 + x) * (0.5 + x) * a + 2 * (0.5 + x) * 0.1 * b + 0.01 * d + 1, (0.3 + 2 * x) * ((0.5 + x) * b + 0.1 * d), (0.3 + 2 * x) * (0.3 + 2 * x) * d + 1
            from v where k < 400)""",
    f"select series_id as model, i::bigint as i, j::bigint as j, {r('case when i + j = 0 then a when i + j = 1 then b else d end')} as value from v cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) p(i, j) where k = 400",
    True,
)
add(
    "in_memory_panel",
    PRIO + ", y as (select *, dense_rank() over (order by period) - 1 as n, series_id[1]::int - 1 as k from prio_full where period between date '1996-01-01' and date '1996-12-01')",
    f"select (date '1996-01-01' + to_months(n::int))::date::varchar as period, series_id, case when (n + k) % 5 <> 0 then {r('value')} end as value from y",
)


# mixed frequencies: a vector state held as lists, one observation at a time, so that no matrix is ever inverted
# states: five lags of the factor; each monthly series' own term and its lag; five lags of the quarterly one's
_SOURCE = [0, 0, 1, 2, 3, 5, 5, 7, 7, 9, 9, 10, 11, 12]
_COEF = [0.7, 1, 1, 1, 1, 0.3, 1, 0.3, 1, 0.3, 1, 1, 1, 1]
_NOISE = {0: 0.3, 5: 0.2, 7: 0.2, 9: 0.2}
_M = len(_SOURCE)
_TENT = [w / 9 for w in (1, 2, 3, 2, 1)]
_LOADS = [
    [1.0] + [0.0] * 4 + [1.0] + [0.0] * 8,
    [0.8] + [0.0] * 6 + [1.0] + [0.0] * 6,
    [0.9 * w for w in _TENT] + [0.0] * 4 + _TENT,
]
_FREE = {"0": 0, "5": 5, "6": 7, "7": 9}


def _list(x: list, kind: str = "double") -> str:
    return f"[{', '.join(map(str, x))}]::{kind}[]"


def _each(body: str, n: int = _M, k: str = "i") -> str:
    return f"[{body} for {k} in range({n})]"


def _flat(body: str) -> str:
    """A matrix row by row; ``body`` has i and j."""
    return f"[{body.replace('{i}', f'(u // {_M})').replace('{j}', f'(u % {_M})')} for u in range({_M * _M})]"


def _dot(x: str, y: str) -> str:
    return f"list_dot_product({x}, {y})"


def _row(matrix: str, i: str) -> str:
    return f"{matrix}[{i} * {_M} + 1:{i} * {_M} + {_M}]"


MIXED = (
    _panel("np", """select date_trunc('month', o_orderdate)::date as period, n_name || '|' || o_orderpriority as series_id, sum(o_totalprice) as value
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""")
    + _z("zn", "np_full")
    + f""", obs as (
            select split_part(series_id, '|', 1) as v, t, case split_part(series_id, '|', 2)[1] when '1' then 1 when '2' then 2 else 3 end as n,
                   case when split_part(series_id, '|', 2)[1] <> '5' or (t + 1) % 3 = 0 then z end as y
            from zn where split_part(series_id, '|', 2)[1] in ('1', '2', '5')),
        plan as (select v, t, k.n, max(y) filter (obs.n = k.n) as y from obs cross join (values (0), (1), (2), (3)) k(n) group by v, t, k.n),
        steps as (
            select *, t * 4 + n + 1 as s, {_list(_SOURCE, 'int')} as src, {_list(_COEF)} as coef, {_list([_NOISE.get(i, 0.0) for i in range(_M)])} as noise,
                   case n when 1 then {_list(_LOADS[0])} when 2 then {_list(_LOADS[1])} when 3 then {_list(_LOADS[2])} else {_list([0.0] * _M)} end as c from plan),
        fw as (
            select distinct v, 0::bigint as s, {_list([0.0] * _M)} as z, {_list([float(i == j) for i in range(_M) for j in range(_M)])} as p, 0.0::double as ll,
                   {_list([0.0] * _M)} as k, null::double as f, null::double as e from obs
            union all
            select v, s,
                   case when n = 0 then {_each("coef[i + 1] * z[src[i + 1] + 1]")} when y is null then z else {_each("z[i + 1] + pc[i + 1] * e / f")} end,
                   case when n = 0 then {_flat("coef[{i} + 1] * coef[{j} + 1] * m[src[{i} + 1] * " + str(_M) + " + src[{j} + 1] + 1] + case when {i} = {j} then noise[{i} + 1] else 0 end")}
                        when y is null then m else {_flat("m[u + 1] - pc[{i} + 1] * pc[{j} + 1] / f")} end,
                   case when n = 0 or y is null then ll else ll - 0.5 * (ln(f) + e * e / f) end,
                   [x / f for x in pc], f, e
            from (select *, {_dot("c", "pc")} + 0.05 as f, y - {_dot("c", "z")} as e
                  from (select steps.*, fw.z, fw.p as m, fw.ll, {_each(_dot(_row("fw.p", "i"), "c"))} as pc
                        from fw join steps on steps.v = fw.v and steps.s = fw.s + 1))),
        ends as (select v, max(s) as last_s from fw group by v),
        bw as (
            select v, last_s as s, {_list([0.0] * _M)} as r, {_list([0.0] * _M * _M)} as b from ends
            union all
            select v, s - 1,
                   case when n = 0 then {_each("list_sum([case when src[x + 1] = i then coef[x + 1] * r[x + 1] else 0 end for x in range(" + str(_M) + ")])")}
                        when y is null then r else {_each("c[i + 1] * (e / f - kr) + r[i + 1]")} end,
                   case when n = 0 then {_flat("list_sum([case when src[x + 1] = {i} then coef[x + 1] * list_sum([case when src[w + 1] = {j} then coef[w + 1] * b[x * " + str(_M) + " + w + 1] else 0 end for w in range(" + str(_M) + ")]) else 0 end for x in range(" + str(_M) + ")])")}
                        when y is null then b else {_flat("b[u + 1] - c[{i} + 1] * nk[{j} + 1] - nk[{i} + 1] * c[{j} + 1] + c[{i} + 1] * c[{j} + 1] * (knk + 1 / f)")} end
            from (select *, {_dot("k", "nk")} as knk
                  from (select steps.*, bw.r, bw.b, fw.k, fw.f, fw.e, {_dot("fw.k", "bw.r")} as kr, {_each(_dot(_row("bw.b", "i"), "fw.k"))} as nk
                        from bw join steps on steps.v = bw.v and steps.s = bw.s join fw on fw.v = bw.v and fw.s = bw.s where bw.s > 0))),
        smooth as (
            select fw.v, case when fw.s = 0 then -1 else (fw.s - 1) // 4 end as t, fw.z, fw.p as m, bw.r, bw.b
            from fw join bw on bw.v = fw.v and bw.s = fw.s where fw.s = 0 or fw.s % 4 = 1),
        var as (
            select v, t, {_each("z[i + 1] + " + _dot(_row("m", "i"), "r"))} as z,
                   {_flat("m[u + 1] - " + _dot("mb[{i} + 1]", _row("m", "{j}")))} as p
            from (select *, {_each("[" + _dot(_row("m", "i"), _row("b", "j")) + f" for j in range({_M})]")} as mb from smooth))"""
)
add(
    "mixed_states",
    MIXED,
    f"""select v as model, t, i::bigint as k, {r('fw.z[x + 1]', 5)} as z_filtered, {r('fw.p[x * ' + str(_M) + ' + x + 1]', 5)} as v_filtered, {r('var.z[x + 1]', 5)} as z, {r('var.p[x * ' + str(_M) + ' + x + 1]', 5)} as v
        from var join fw using (v) cross join (values (0, 0), (2, 2), (5, 5), (6, 7), (7, 9)) k(i, x) where t >= 0 and fw.s = 4 * t + 4""",
    True,
)
_SECOND = f"(z[x + 1] * z[y + 1] + p[x * {_M} + y + 1])"
MIXED_STEP = (
    MIXED
    + f""",
        own as (
            select v, i, sum({_SECOND.replace('y', 'x')}) filter (t >= 0) as now, sum({_SECOND.replace('y', 'x')}) filter (t < (select max(t) from var)) as before,
                   sum({_SECOND.replace('y', '(x + 1)')}) filter (t >= 0) as lagged, count(*) - 1 as n
            from var cross join (values {', '.join(f"({i}, {x})" for i, x in _FREE.items())}) k(i, x) group by v, i),
        eff(n, e, own) as (values {', '.join(f"({n + 1}, {_list(_TENT + [0.0] * 9 if n == 2 else [1.0] + [0.0] * 13)}, {_list([0.0] * 5 + _LOADS[n][5:])})" for n in range(3))}),
        seen as (select *, {_each(_dot(_row("p", "i"), "e"))} as pe from obs join var using (v, t) join eff using (n) where y is not null),
        loads as (
            select v, n, sum({_dot("e", "z")} * y - {_dot("e", "z")} * {_dot("own", "z")} - {_dot("pe", "own")}) / sum({_dot("e", "z")} * {_dot("e", "z")} + {_dot("pe", "e")}) as load
            from seen group by v, n)"""
)
add(
    "mixed_em_step",
    MIXED_STEP,
    f"""select v as model, name, i::bigint as i, {r('value', 5)} as value from (
            select v, 'a' as name, i, least(greatest(lagged / before, -0.99), 0.99) as value from own
            union all select v, 'q', i, (now - 2 * rho * lagged + rho * rho * before) / n from (select *, least(greatest(lagged / before, -0.99), 0.99) as rho from own)
            union all select v, 'c', n - 1, coalesce(load, given) * case n when 3 then {1 / 9} else 1 end
            from ends cross join (values (1, 1.0), (2, 0.8), (3, 0.9)) g(n, given) left join loads using (v, n)
            union all select v, 'loglik', 0, max_by(ll, s) from fw group by v)""",
    True,
)
_RHO = "least(greatest(lagged / before, -0.99), 0.99)"
_NAMES = "(values (1, 1.0, 5, '1-URGENT'), (2, 0.8, 6, '2-HIGH'), (3, 0.9, 7, '5-LOW')) g(n, given, i, name)"
add(
    "result_tables",
    MIXED_STEP,
    f"""select v as model, section, name, 0::bigint as factor, lag::bigint as lag, {r('value', 5)} as value from (
            select v, case n when 3 then 'slow loading' else 'loading' end as section, name, lag, coalesce(load, given) * w as value
            from ends cross join {_NAMES} left join loads using (v, n)
            join (values {', '.join(f"({n}, {lag}, {w})" for n, weights in ((1, [1.0]), (2, [1.0]), (3, _TENT)) for lag, w in enumerate(weights))}) w(n, lag, w) using (n)
            union all select v, case i when 0 then 'factor' else 'own' end || ' transition', coalesce(name, 'Block_Global'), 0, {_RHO} from own left join {_NAMES} using (i)
            union all select v, case i when 0 then 'factor' else 'own' end || ' variance', coalesce(name, 'Block_Global'), 0, (now - 2 * {_RHO} * lagged + {_RHO} * {_RHO} * before) / own.n from own left join {_NAMES} using (i)
            union all select v, 'observation variance', name, 0, 0.05 from ends cross join {_NAMES})""",
    True,
)
add(
    "factors_recovery_rotated",
    PRIO
    + _z("zs", "prio_full")
    + """, m as (select t, avg(z) as f, avg(z) filter (series_id < '3') as g, avg(z) filter (series_id > '5') as h from zs group by t),
        x as (select f as t0, g as t1, 0.6 * g - 0.8 * f as e0, 0.8 * g + 0.6 * f + 0.1 * h as e1 from m where f is not null and g is not null and h is not null),
        c as (select sum(e0 * t0) as a, sum(e0 * t1) as b, sum(e1 * t0) as c, sum(e1 * t1) as d from x),
        o as (select case when a * d >= b * c then a + d else a - d end as p, case when a * d >= b * c then b - c else b + c end as q, case when a * d >= b * c then 1 else -1 end as s from c),
        n as (select p / sqrt(p * p + q * q) as p, q / sqrt(p * p + q * q) as q, s from o),
        y as (select t0, t1, e0 * p - s * e1 * q as x0, e0 * q + s * e1 * p as x1 from x cross join n),
        l as (select 0 as k, t0 as y, x0 as x from y union all select 1, t1, x1 from y)""",
    f"""select k::bigint as k, {r('corr(y, x)')} as correlation, {r('sqrt(avg((y - x) * (y - x)))')} as rmse from l group by rollup (k)""",
)
add(
    "infinite_missing",
    PRIO,
    f"select period::varchar as period, series_id, case when t % 9 <> 4 then {r('value / sum(value) over (partition by t)')} end as value from prio_full where value is not null",
)
ORACLE_SQL["spec_from_csv"] = ORACLE_SQL["spec_from_flags"]
add(
    "target_positions",
    NATION,
    """select name, datediff('month', (select min(period) from nat join spec using (series_id) where ord < 4 and (frequency = 'm' or month(period) % 3 = 0)), day) as t
       from (values ('2000-03-01', date '2000-03-01'), ('2000-03-15', date '2000-03-15'), ('2000m7', date '2000-07-01'), ('1999q2', date '1999-06-01'), ('2000s2', date '2000-07-01'), ('1998', date '1998-01-01')) n(name, day)""",
)
add("config_drift", NATION, "select 'series ' || series_id || ': frequency ' || frequency as drift from spec where ord % 3 = 0 and frequency <> 'q'")
add("dfm_fit_nations", MIXED, "select v as model, 0::bigint as falls, true as unit_innovation, true as lead_positive, count(distinct t) as n_periods from obs group by v")
