"""The query catalogue of the panel engine: each operator on the star-schema tables.

Dates leave as ISO text and doubles rounded, so a result can be compared with another engine's.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import frequency as Q
from ..functions.transforms import CODES
from ..operators import evaluation as E
from ..operators import missing as X
from ..operators import models as G
from ..operators import moments as M
from ..operators import panel as P
from ..operators import scalar as S
from ..operators import vintage as V
from ..operators import wide as W
from ..session import FactorSession
from ..sources import scratch, tables
from ..sources.config import MappingSource, MergedSource, ModelConfig, issues, spec_mapping, write_yaml
from ..sources.config import load as load_config
from . import fixtures as T
from .kernel import Layout
from .oracle import ORACLE_SQL as ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6


def out(df: DataFrame, *columns: str | Column, digits: int = DIGITS) -> DataFrame:
    """The chosen columns, ready to compare."""
    df = df.select(*columns) if columns else df
    kinds = dict(df.dtypes)

    def shown(name: str) -> Column:
        c = F.col(f"`{name}`")
        if kinds[name] == "date":
            c = c.cast("string")
        elif kinds[name] in ("double", "float"):
            c = F.round(c, digits) + F.lit(0.0)
        elif kinds[name] in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        return c.alias(name)

    return df.select(*[shown(c) for c in df.columns])


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed factor of a one-factor model of the monthly shipment panel."""
    return out(G.factors(_line_fit(spark, sf_dir)).join(_calendar(T.line_full(spark, sf_dir)), "t"), "period", "block", "k", "value")


def _calendar(panel: DataFrame) -> DataFrame:
    return panel.select("t", "period").distinct()


# panels


@query
def panel_build(spark, sf_dir):
    return out(T.prio(spark, sf_dir))


@query
def panel_pivot_wide(spark, sf_dir):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return out(P.pivot(T.prio(spark, sf_dir), names).withColumnsRenamed({n: "p" + n[0] for n in names}))


@query
def panel_unpivot(spark, sf_dir):
    return out(P.unpivot(panel_pivot_wide(spark, sf_dir)))


@query
def panel_calendar_complete(spark, sf_dir):
    return out(T.nation_full(spark, sf_dir))


@query
def panel_date_filter(spark, sf_dir):
    return out(P.between(T.line(spark, sf_dir), "1996-01-01", "1997-12-01"))


@query
def align_to_spec(spark, sf_dir):
    spec = T.nation_spec(spark, sf_dir).where("ord % 2 = 0")
    return out(P.align(T.nation(spark, sf_dir), spec), "period", "series_id", "value", "frequency", "ord")


@query
def align_missing(spark, sf_dir):
    panel = T.nation(spark, sf_dir).where(F.col("series_id") < "NATION_2")
    return out(P.unmatched(panel, T.nation_spec(spark, sf_dir)), "series_id", "ord")


def _one_code(code: str) -> Query:
    def f(spark, sf_dir):
        spec = T.prio_full(spark, sf_dir).withColumns({"transformation": F.lit(code), "frequency": F.lit("m")})
        return out(P.transform(spec), "period", "series_id", "value")

    return f


QUERIES |= {f"tf_{code}": _one_code(code) for code in CODES}


@query
def tf_mixed_spec(spark, sf_dir):
    return out(P.transform(T.nation_panel(spark, sf_dir)), "period", "series_id", "transformation", "frequency", "value")


@query
def drop_leading_null_rows(spark, sf_dir):
    changed = P.transform(T.nation_panel(spark, sf_dir)).withColumn("value", F.when(F.col("transformation") == "chg", F.col("value")))
    return out(P.drop_leading_empty(changed), "period", "series_id", "value")


@query
def quality_obs_ratio(spark, sf_dir):
    return out(P.quality(T.nation_panel(spark, sf_dir)))


# missing data and moments


@query
def trim_sparse_rows(spark, sf_dir):
    return out(X.trim(T.nation_full(spark, sf_dir)), "period", "series_id", "value")


@query
def fill_median(spark, sf_dir):
    return out(X.fill_median(T.nation_panel(spark, sf_dir)), "period", "series_id", "value")


@query
def fill_spline(spark, sf_dir):
    return out(X.fill_spline(T.nation_panel(spark, sf_dir)), "period", "series_id", "value", digits=2)


@query
def missing_treated(spark, sf_dir):
    modes = [(1, "smooth"), (2, "median"), (3, "spline"), (4, "spline"), (5, "spline")]
    return T.union([out(X.treat(T.prio_gap(spark, sf_dir), n, mode=m), "period", "series_id", "value", digits=2).withColumn("method", F.lit(n).cast("long")) for n, m in modes])


@query
def standardize(spark, sf_dir):
    return out(M.standardise(T.prio_full(spark, sf_dir)), "period", "series_id", "z")


@query
def standardize_clipped(spark, sf_dir):
    return out(M.standardise(T.prio_full(spark, sf_dir), 2e6), "period", "series_id", "z")


@query
def unstandardize(spark, sf_dir):
    return out(M.unstandardise(M.standardise(T.prio_full(spark, sf_dir))), "period", "series_id", "value", digits=3)


def _nation_z(spark, sf_dir):
    z = M.standardise(T.nation_full(spark, sf_dir))
    return z.select("period", "t", "series_id", F.col("z").alias("value"))


@query
def cov_listwise(spark, sf_dir):
    return out(M.covariance_listwise(_nation_z(spark, sf_dir)))


@query
def cov_pairwise(spark, sf_dir):
    return out(M.covariance_pairwise(_nation_z(spark, sf_dir)))


@query
def var_safe(spark, sf_dir):
    panel = _nation_z(spark, sf_dir).withColumn("value", F.when(F.col("series_id") < "C", F.lit(1.0)).otherwise(F.col("value")))
    return out(M.safe_variance(panel))


@query
def var_clean(spark, sf_dir):
    v = _nation_z(spark, sf_dir).where("t < 24").groupBy("series_id").agg(F.var_pop("value").alias("variance"))
    bad = F.when(F.col("series_id") < "C", F.lit(-1.0)).when(F.col("series_id") < "F", F.lit(None)).otherwise(F.col("variance"))
    return out(M.clean_variance(v.withColumn("variance", bad)), "series_id", "cleaned")


# calendar and vintages


@query
def release_date_pos(spark, sf_dir):
    rows = V.released(T.nation_panel(spark, sf_dir).where("release_day > 0"))
    return out(rows, "series_id", "period", "release_date")


@query
def release_date_neg(spark, sf_dir):
    rows = V.released(T.nation_panel(spark, sf_dir).where("release_day < 0 or release_day is null"))
    return out(rows, "series_id", "period", "release_date")


@query
def vintage_view(spark, sf_dir):
    return out(V.view(T.nation_panel(spark, sf_dir), "2001-06-10"), "series_id", "period", "value")


@query
def vintage_multi(spark, sf_dir):
    return out(V.views(T.nation_panel(spark, sf_dir), T.VIEWS), "view_date", "series_id", "period", "value")


@query
def vintage_availability(spark, sf_dir):
    return out(V.availability(V.views(T.nation_panel(spark, sf_dir), T.VIEWS)))


@query
def vintage_new_cells(spark, sf_dir):
    return out(V.new_cells(T.nation_panel(spark, sf_dir), "2001-05-10", "2001-06-10"), "series_id", "period", "value")


@query
def period_parse(spark, sf_dir):
    month = T.prio(spark, sf_dir).select("period").distinct()
    y, m = F.year("period").cast("string"), F.month("period")
    q, s = F.ceil(m / 3).cast("string"), F.ceil(m / 6).cast("string")
    return out(
        month,
        "period",
        D.parse_period(F.concat(y, F.lit("m"), m.cast("string")), "m").alias("month"),
        D.parse_period(F.concat(y, F.lit("Q"), q), "q").alias("quarter"),
        D.parse_period(F.concat(y, F.lit("s"), s), "sa").alias("half"),
        D.parse_period(y, "a").alias("year"),
        D.parse_period(F.date_format("period", "yyyy-MM-dd"), "d").alias("day"),
        D.parse_period(F.concat(y, F.lit("q9")), "q").alias("wrong"),
    )


@query
def period_end(spark, sf_dir):
    month = T.prio(spark, sf_dir).select("period").distinct()
    ends = [D.period_end("period", f).alias(f"end_{f}") for f in ("w", "m", "q", "sa", "a")]
    return out(month, "period", *ends, *[D.next_period_end("period", f).alias(f"next_{f}") for f in ("d", "w", "m", "q", "sa", "a")])


@query
def date_range(spark, sf_dir):
    bounds = T.prio(spark, sf_dir).agg(F.min("period").alias("low"), F.max("period").alias("high"))
    frames = [D.date_range(bounds, F.col("low"), F.col("high"), f).select(F.lit(f).alias("frequency"), "period") for f in ("w", "m", "q", "a")]
    return out(T.union(frames))


@query
def backward_dates(spark, sf_dir):
    last = T.prio(spark, sf_dir).agg(F.last_day(F.max("period")).alias("last"))
    steps = last.select("last", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("step"))
    return out(steps, "step", *[D.step_back("last", F.col("step"), f).alias(f"back_{f}") for f in Q.FREQUENCIES])


# mixed frequency


@query
def freq_group(spark, sf_dir):
    groups = T.nation_spec(spark, sf_dir).groupBy("frequency").agg(F.count(F.lit(1)).alias("n_series"), F.min("ord").alias("first_ord"))
    return out(groups, "frequency", "n_series", "first_ord", Q.rank_column("frequency").alias("freq_rank"))


@query
def idio_chain_lengths(spark, sf_dir):
    chains = Q.case_of("frequency", {f: Q.chain_length(f, "m") for f in ("m", "q", "sa", "a")})
    return out(T.nation_spec(spark, sf_dir), "series_id", chains.alias("chain"))


@query
def annual_factor(spark, sf_dir):
    factor = Q.periods_column("frequency") / Q.step_column("frequency")
    return out(T.nation_spec(spark, sf_dir), "series_id", Q.periods_column("frequency").alias("periods"), factor.alias("factor"))


@query
def quarter_downsample(spark, sf_dir):
    return out(T.nation_panel(spark, sf_dir), "period", "series_id", "frequency", "value")


@query
def tent_aggregate(spark, sf_dir):
    w = Window.partitionBy("series_id").orderBy("t")
    weights = Q.tent_for("q", "m")
    terms = [F.lag("z", k).over(w) * F.lit(float(x)) for k, x in enumerate(weights)]
    total = sum(terms[1:], terms[0]) / F.lit(float(sum(weights)))
    return out(M.standardise(T.nation_full(spark, sf_dir)).withColumn("aggregate", total), "period", "series_id", "aggregate")


def _clocks(spark, sf_dir) -> DataFrame:
    """Each nation with a clock, all six in turn, and a slower frequency where there is one."""
    f = F.array(*[F.lit(x) for x in Q.FREQUENCIES])
    rows = T.nation_spec(spark, sf_dir).select("series_id", "ord", F.get(f, F.col("ord") % 6).alias("clock"))
    return rows.withColumn("slow", F.get(f, F.col("ord") % 6 + 1 + F.col("ord") % 3))


@query
def clock_table(spark, sf_dir):
    periods = F.col("ord") % 4 + 1
    columns = [Q.rank_column("clock").alias("freq_rank"), Q.periods_column("clock").alias("periods"), Q.higher_column("clock").alias("higher")]
    return out(_clocks(spark, sf_dir), "series_id", "clock", *columns, Q.horizon_column("clock", periods).alias("horizon"), Q.alias_column("clock").alias("alias"))


@query
def tent_weights(spark, sf_dir):
    """The tent that ties a nation's slow series to its clock."""
    return out(_clocks(spark, sf_dir).where("slow is not null"), "series_id", "slow", "clock", F.posexplode(Q.tent_of_pair("slow", "clock")).alias("k", "weight"))


@query
def tent_constraint_matrix(spark, sf_dir):
    rows = _clocks(spark, sf_dir).where("slow is not null").withColumn("w", Q.tent_of_pair("slow", "clock"))
    rows = rows.select("series_id", F.posexplode(Q.constraint_column(F.col("w"))).alias("i", "row"))
    return out(rows, "series_id", "i", F.posexplode("row").alias("j", "value"))


@query
def block_membership(spark, sf_dir):
    return out(T.nation_spec(spark, sf_dir).select("series_id", F.explode("blocks").alias("block")))


@query
def config_validate(spark, sf_dir):
    spec = T.nation_spec(spark, sf_dir)
    wrong = F.when(F.col("ord") % 6 == 0, "w").when(F.col("ord") % 6 == 1, "x").otherwise(F.col("frequency"))
    blocks = spec.select(F.explode("blocks").alias("block")).distinct().where("block <> 'Block_ASIA'")
    blocks = blocks.select("block", F.when(F.col("block") == "Block_EUROPE", 0).otherwise(1).alias("factors"), F.lit("m").alias("clock"))
    return out(issues(spec.withColumn("frequency", wrong), blocks))


# estimation


@query
def ar1_ols(spark, sf_dir):
    return out(M.ar1(T.prio_gap(spark, sf_dir)), "series_id", "phi", "n")


@query
def innovation_var(spark, sf_dir):
    return out(M.ar1(T.prio_gap(spark, sf_dir)), "series_id", "q")


@query
def stationary_var(spark, sf_dir):
    return out(M.ar1(T.prio_gap(spark, sf_dir)), "series_id", "stationary")


@query
def eligible_rows(spark, sf_dir):
    return out(X.eligible(T.prio_gap(spark, sf_dir), 0.9))


@query
def transition_from_sums(spark, sf_dir):
    return out(M.transition_update(T.prio_full(spark, sf_dir)))


@query
def suff_stats(spark, sf_dir):
    return out(M.sufficient_sums(T.prio_full(spark, sf_dir)))


@query
def loading_ls(spark, sf_dir):
    return out(M.loadings_ls(T.prio_full(spark, sf_dir)))


@query
def obs_var(spark, sf_dir):
    return out(M.observation_variance(T.prio_full(spark, sf_dir)))


@query
def pca_loadings(spark, sf_dir):
    return out(G.principal_components(T.line_full(spark, sf_dir), 2)[0])


@query
def pca_factor(spark, sf_dir):
    return out(G.principal_components(T.line_full(spark, sf_dir), 2)[1])


def _arrays(spark, sf_dir):
    return S.as_arrays(M.standardise(T.prio_gap(spark, sf_dir)))


@query
def kalman_scalar(spark, sf_dir):
    return out(S.kalman(_arrays(spark, sf_dir)), "series_id", "z", "v")


@query
def kalman_loglik(spark, sf_dir):
    return out(S.kalman(_arrays(spark, sf_dir)), "series_id", "loglik")


@query
def smoother_scalar(spark, sf_dir):
    return out(S.smoothed(_arrays(spark, sf_dir)))


@query
def forecast_scalar(spark, sf_dir):
    panel = M.standardise(T.prio_full(spark, sf_dir))
    last = panel.where("z is not null").groupBy("series_id", "mean", "std").agg(F.max_by("z", "t").alias("z"))
    return out(S.forecast(last, 12), "series_id", "h", "z_forecast", "forecast", digits=3)


@query
def em_convergence(spark, sf_dir):
    """The mean log-likelihood of ever more periods of each standardised priority, step by step."""
    z = M.standardise(T.prio_full(spark, sf_dir)).where("z is not null")
    so_far = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    runs = z.select(F.col("series_id").alias("run"), F.col("t").alias("iteration"), F.avg(-0.5 * (F.log(F.lit(6.283185307179586)) + F.col("z") * F.col("z"))).over(so_far).alias("loglik"))
    return out(E.convergence(runs, 5e-3), "run", "iteration", "change", "converged", "decreased")


# factor models


def _line_spec() -> G.ModelSpec:
    series = ("AF", "NF", "NO", "RF")
    return G.ModelSpec(series, Layout(("m",) * 4, ((1,),) * 4), max_iter=30, threshold=1e-4)


def _line_panel(spark, sf_dir):
    """The shipment series that are long enough to fit."""
    return T.line_full(spark, sf_dir).where(F.col("series_id").isin(*_line_spec().series))


def _line_fit(spark, sf_dir):
    return G.fit(_line_panel(spark, sf_dir), _line_spec())


@query
def dfm_fit_factors(spark, sf_dir):
    return out(G.factors(_line_fit(spark, sf_dir)), digits=4)


@query
def dfm_fit_loadings(spark, sf_dir):
    return out(G.loadings(_line_fit(spark, sf_dir)), digits=4)


def _nation_spec(spark, sf_dir, blocks: bool, mixed: bool) -> G.ModelSpec:
    names, layout, block_names = T.nation_layout(spark, sf_dir)
    frequencies = layout.frequencies if mixed else ("m",) * len(names)
    members = layout.blocks if blocks else ((1,),) * len(names)
    n = len(block_names) if blocks else 1
    return G.ModelSpec(tuple(names), Layout(frequencies, members, (1,) * n), tuple(block_names[:n]), max_iter=10, threshold=1e-4)


@query
def dfm_fit_blocks(spark, sf_dir):
    return out(G.loadings(G.fit(T.nation_full(spark, sf_dir), _nation_spec(spark, sf_dir, True, False))), digits=4)


@query
def dfm_fit_mixed(spark, sf_dir):
    return out(G.factors(G.fit(T.nation_panel(spark, sf_dir), _nation_spec(spark, sf_dir, False, True))), digits=4)


@query
def dfm_fit_many(spark, sf_dir):
    """One model for each half of the sample and for all of it, in one job."""
    panel = _line_panel(spark, sf_dir)
    cut = panel.select("*", F.explode(F.array(F.lit("all"), F.when(F.col("t") < 40, "early").otherwise("late"))).alias("model"))
    return out(G.logliks(G.fit(cut, _line_spec())).groupBy("run").agg(F.count(F.lit(1)).alias("iterations"), F.max_by("loglik", "iteration").alias("loglik")), digits=3)


def _nation_model(spark, sf_dir) -> G.Model:
    """Fitted here and now; a session that uses a model several times keeps it in a ``ParquetStore`` instead."""
    spec = _nation_spec(spark, sf_dir, False, True)
    return G.Model.from_table(G.fit(T.nation_panel(spark, sf_dir), spec), spec)


@query
def dfm_fit_nations(spark, sf_dir):
    """A model for each nation in one job, and what must hold of any: no step lowers the likelihood, innovations have variance 1, the first loading is positive."""
    spec = G.ModelSpec(T.FIXED_SERIES, Layout(("m",) * 5, ((1,),) * 5), max_iter=15, threshold=1e-4)
    fits = scratch.written(G.fit(T.nation_models(spark, sf_dir)[0].withColumnRenamed("z", "value"), spec))
    steps = Window.partitionBy("run").orderBy("iteration")
    fell = F.col("loglik") < F.lag("loglik").over(steps) - 1e-6 * F.abs("loglik")
    path = G.logliks(fits).withColumn("fell", fell).groupBy("run").agg(F.count_if("fell").alias("falls")).withColumnRenamed("run", "model")
    unit = fits.where("kind = 'matrix' and name = 'q' and i = 0 and j = 0").select("model", (F.abs(F.col("value") - 1) < 1e-9).alias("unit_innovation"))
    lead = G.loadings(fits).where(F.abs("value") > 1e-9).groupBy("model").agg((F.min_by("value", "series_id") > 0).alias("lead_positive"))
    periods = G.factors(fits).groupBy("model").agg(F.count(F.lit(1)).alias("n_periods"))
    return out(path.join(unit, "model").join(lead, "model").join(periods, "model"))


@query
def dfm_forecast(spark, sf_dir):
    return out(G.forecast(spark, _nation_model(spark, sf_dir), T.nation_panel(spark, sf_dir), 6), digits=2)


@query
def dfm_nowcast(spark, sf_dir):
    name, t = T.target(spark, sf_dir)
    return out(G.nowcasts(_nation_model(spark, sf_dir), T.nation_panel(spark, sf_dir), T.VIEWS, name, t), digits=2)


@query
def dfm_news(spark, sf_dir):
    name, t = T.target(spark, sf_dir)
    return out(G.news(_nation_model(spark, sf_dir), T.nation_panel(spark, sf_dir), T.VIEWS, name, t), digits=2)


@query
def dfm_backtest(spark, sf_dir):
    name, t = T.target(spark, sf_dir)
    dates = G.view_dates(spark, T.TARGET_PERIOD, 4, "m")
    rows = G.backtest(_nation_model(spark, sf_dir), T.nation_panel(spark, sf_dir), dates, name, t)
    return out(rows.withColumn("n_parts", F.size("parts")).drop("parts"), digits=2)


@query
def dfm_dataset(spark, sf_dir):
    name, t = T.target(spark, sf_dir)
    rows = G.dataset(_nation_model(spark, sf_dir), T.nation_panel(spark, sf_dir), name, [t - k for k in (1, 2, 3, 4)])
    return out(rows, "t", "series_id", "baseline", "actual", "target", digits=2)


@query
def dfm_states(spark, sf_dir):
    name, t = T.target(spark, sf_dir)
    rows = G.states(_nation_model(spark, sf_dir), T.nation_panel(spark, sf_dir), name, [t - 12, t], 4)
    return out(rows.select("t", "series_id", "nowcast", F.element_at("history", -1).alias("last"), F.element_at("factors", 1).alias("factor")), digits=2)


@query
def dfm_news_summary(spark, sf_dir):
    name, t = T.target(spark, sf_dir)
    rows = G.news_summary(G.news(_nation_model(spark, sf_dir), T.nation_panel(spark, sf_dir), T.VIEWS, name, t), 3)
    return out(rows, "view_date", "rank", "news_series", "news", "total", digits=2)


@query
def dfm_factors_wide(spark, sf_dir):
    return out(G.wide_factors(_line_fit(spark, sf_dir), ["Block_Global"]), digits=4)


@query
def dfm_smoothed_wide(spark, sf_dir):
    return out(G.wide_smoothed(_line_fit(spark, sf_dir), list(_line_spec().series)), digits=2)


@query
def dfm_diagnose(spark, sf_dir):
    return out(G.diagnose(_line_fit(spark, sf_dir), 3), digits=4)


@query
def dfm_series_report(spark, sf_dir):
    return out(G.series_report(_line_fit(spark, sf_dir), _line_panel(spark, sf_dir)), digits=3)


@query
def dfm_spectral_radius(spark, sf_dir):
    return out(G.transition_radius(_line_fit(spark, sf_dir)), digits=4)


# evaluation


@query
def backtest_metrics(spark, sf_dir):
    viewed = V.views(T.nation_panel(spark, sf_dir), T.VIEWS)
    w = Window.partitionBy("view_date", "series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    guess = viewed.withColumn("prediction", F.last("value", ignorenulls=True).over(w)).where(F.col("period") == F.lit(T.TARGET_PERIOD).cast("date"))
    actual = T.nation_panel(spark, sf_dir).select("period", "series_id", "value")
    return out(E.step_metrics(guess.drop("value").join(actual, P.KEYS), ["view_date"]), digits=3)


@query
def rmse_series_overall(spark, sf_dir):
    return out(E.rmse(E.naive(T.prio_full(spark, sf_dir))), digits=3)


@query
def news_topk(spark, sf_dir):
    panel = T.nation_full(spark, sf_dir)
    return out(E.top_changes(panel.where(F.col("period") <= F.lit(T.TARGET_PERIOD).cast("date")), 5), digits=3)


@query
def explained_variance(spark, sf_dir):
    return out(M.explained(T.prio_full(spark, sf_dir)), "series_id", "explained")


@query
def reconstruction_corr(spark, sf_dir):
    return out(M.explained(T.prio_full(spark, sf_dir)), "series_id", "correlation", "rmse", "mae")


@query
def factor_stats(spark, sf_dir):
    f = M.common_factor(T.prio_full(spark, sf_dir)).withColumn("factor", F.lit("F1"))
    return out(E.summary(f, "factor", "f"))


@query
def state_lookback(spark, sf_dir):
    rows = P.lookback(T.prio_gap(spark, sf_dir), 4)
    return out(rows, "period", "series_id", *[F.element_at("history", k + 1).alias(f"h{k}") for k in range(4)])


@query
def latest_period(spark, sf_dir):
    panel = T.nation_full(spark, sf_dir).where("value is not null")
    return out(panel.groupBy("series_id").agg(F.max("period").alias("latest"), F.min_by("t", "t").alias("first_t")))


@query
def horizon_extend(spark, sf_dir):
    return out(P.extend(T.prio_full(spark, sf_dir), 3), "period", "series_id", "t", "value")


@query
def period_lookup(spark, sf_dir):
    return out(P.find_period(T.prio_full(spark, sf_dir), "2000-07-19"))


@query
def block_pattern_groups(spark, sf_dir):
    return out(P.block_patterns(T.nation_spec(spark, sf_dir)))


@query
def slower_series_count(spark, sf_dir):
    return out(P.slower_count(T.nation_spec(spark, sf_dir)))


@query
def factor_recovery(spark, sf_dir):
    """How near the common factor without the first series comes to that of all."""
    full, part = T.prio_full(spark, sf_dir), T.prio_full(spark, sf_dir).where(F.col("series_id") > "1-V")
    rows = M.common_factor(full).withColumnRenamed("f", "true").join(M.common_factor(part).withColumnRenamed("f", "estimate"), "t")
    return out(E.recovery(rows.withColumn("factor", F.lit("F1")), "factor"))


@query
def covariance_top(spark, sf_dir):
    """The five pairs of nations that covary most."""
    pairs = M.covariance_pairwise(_nation_z(spark, sf_dir)).where("a < b")
    return out(pairs.orderBy(F.abs("covariance").desc(), "a", "b").limit(5))


@query
def events_daily_panel(spark, sf_dir):
    return out(P.complete(T.events(spark, sf_dir), "d"), "period", "series_id", "value")


@query
def events_weekly_clock(spark, sf_dir):
    return out(P.with_t(T.events(spark, sf_dir, "w"), "w"))


def default_config(spark: SparkSession, sf_dir: str) -> ModelConfig:
    """The nation specification as a configuration."""
    rows = T.nation_spec(spark, sf_dir).orderBy("ord").collect()
    return ModelConfig.from_mapping({"series": [r.asDict() for r in rows], "max_iter": 10, "threshold": 1e-4})


# a model whose parameters are given: filter, smoother, EM step, forecast, nowcast, news, backtest


def _fixed(spark, sf_dir):
    return T.fixed_model(spark, sf_dir), T.prio_released(spark, sf_dir)


def _fixed_target(spark, sf_dir) -> int:
    return P.find_period(T.prio_full(spark, sf_dir), T.TARGET_PERIOD).first()["t"]


@query
def fixed_filter(spark, sf_dir):
    return out(G.fixed_states(*_fixed(spark, sf_dir)), "t", "n_observed", "z_filtered", "v_filtered")


@query
def fixed_smoother(spark, sf_dir):
    return out(G.fixed_states(*_fixed(spark, sf_dir)), "t", "z", "v")


@query
def fixed_loglik(spark, sf_dir):
    return out(G.fixed_states(*_fixed(spark, sf_dir)).agg(F.max("loglik").alias("loglik")))


@query
def fixed_em_step(spark, sf_dir):
    rows = G.em_update(*_fixed(spark, sf_dir)).where("name <> 'r' or i = j")
    return out(rows, "name", F.when(F.col("name") == "z0", 0).otherwise(F.col("i")).alias("i"), "value", digits=5)


@query
def fixed_forecast(spark, sf_dir):
    return out(G.forecast(spark, *_fixed(spark, sf_dir), 6), "series_id", "h", "t", "value", digits=2)


@query
def fixed_nowcast(spark, sf_dir):
    return out(G.nowcasts(*_fixed(spark, sf_dir), T.VIEWS, "5-LOW", _fixed_target(spark, sf_dir)), digits=2)


@query
def fixed_news(spark, sf_dir):
    rows = G.news(*_fixed(spark, sf_dir), T.VIEWS, "5-LOW", _fixed_target(spark, sf_dir))
    return out(rows, "view_date", "before_date", "y_old", "y_new", "news_series", "n_cells", "actual", "expected", "weight", "news", digits=2)


@query
def fixed_backtest(spark, sf_dir):
    """Every step with its error and, a row each, the series whose new cells moved it."""
    rows = G.backtest(*_fixed(spark, sf_dir), T.VIEWS, "5-LOW", _fixed_target(spark, sf_dir))
    return out(rows.select("step", "view_date", "nowcast", "actual", "error", "abs_error", "failed", F.explode_outer("parts").alias("p")).select("*", "p.news_series", "p.news").drop("p"), digits=2)


@query
def fixed_backtest_summary(spark, sf_dir):
    steps = G.backtest(*_fixed(spark, sf_dir), T.VIEWS, "5-LOW", _fixed_target(spark, sf_dir))
    return out(G.backtest_summary(steps), "mae", "rmse", "n", "n_failed", digits=2)


@query
def fixed_dataset(spark, sf_dir):
    t = _fixed_target(spark, sf_dir)
    return out(G.dataset(*_fixed(spark, sf_dir), "5-LOW", [t - k for k in range(4)]), "t", "series_id", "baseline", "actual", "target", F.element_at("features", 1).alias("factor"), digits=2)


@query
def fixed_dataset_weeks(spark, sf_dir):
    t = _fixed_target(spark, sf_dir)
    rows = G.dataset(*_fixed(spark, sf_dir), "5-LOW", [t - 1, t], 6)
    return out(rows.select("t", F.posexplode("path").alias("step", "nowcast")), digits=2)


@query
def fixed_state(spark, sf_dir):
    t = _fixed_target(spark, sf_dir)
    rows = G.states(*_fixed(spark, sf_dir), "5-LOW", [t - 12, t], 3)
    return out(rows, "t", "series_id", "nowcast", *[F.element_at("history", k).alias(f"h{k}") for k in (1, 2, 3)], F.element_at("residuals", 3).alias("residual"), digits=2)


# wide panels: a model a nation, collapsed by period


@query
def wide_states(spark, sf_dir):
    rows = W.states(*T.nation_models(spark, sf_dir), 1)
    one = {c: F.element_at(c, 1).alias(c) for c in ("z_filtered", "v_filtered", "z", "v")}
    return out(rows, "model", "t", "n_observed", *one.values())


@query
def wide_em_step(spark, sf_dir):
    loadings, transitions, loglik = W.em_step(*T.nation_models(spark, sf_dir), 1, 1)
    first = lambda c: F.element_at(F.element_at(c, 1), 1)
    rows = [("c", loadings, F.element_at("c", 1)), ("r", loadings, F.col("r")), ("loglik", loglik, F.col("loglik")), ("z0", transitions, F.element_at("z0", 1))]
    rows += [(k, transitions, first(k)) for k in ("a", "q", "v0")]
    return out(T.union([df.select("model", F.lit(k).alias("name"), (F.col("series_id") if df is loadings else F.lit("")).alias("series_id"), v.alias("value")) for k, df, v in rows]), digits=5)


@query
def wide_weights(spark, sf_dir):
    return out(W.news_weights(*T.nation_models(spark, sf_dir), 1, "5-LOW", 40), "model", "t", "series_id", "weight")


# mixed frequencies with idiosyncratic chains, parameters given: a model a nation


@query
def mixed_states(spark, sf_dir):
    """The factor's lags and the three idiosyncratic terms."""
    rows = G.fixed_states(T.mixed_model(), T.mixed_panel(spark, sf_dir), "model").where("t >= 0 and k in (0, 2, 5, 6, 7)")
    return out(rows, "model", "t", "k", "z_filtered", "v_filtered", "z", "v", digits=5)


@query
def mixed_em_step(spark, sf_dir):
    rows = G.em_update(T.mixed_model(), T.mixed_panel(spark, sf_dir), "model")
    free = "name = 'loglik' or name in ('a', 'q') and i = j and i in (0, 5, 6, 7) or name = 'c' and j = 0"
    return out(rows.where(free), "model", "name", "i", "value", digits=5)


@query
def result_tables(spark, sf_dir):
    """What the step has estimated for each nation, by section."""
    model = T.mixed_model()
    return out(G.result_tables(G.em_update(model, T.mixed_panel(spark, sf_dir), "model"), model.spec), digits=5)


# result tables of a factor that needs no iteration


@query
def wide_factors(spark, sf_dir):
    return out(G.wide_factors(T.common_fits(spark, sf_dir), ["Block_Global"]), "t", "F1")


@query
def wide_smoothed(spark, sf_dir):
    wide = G.wide_smoothed(T.common_fits(spark, sf_dir), list(T.FIXED_SERIES)).withColumnsRenamed({n: "p" + n[0] for n in T.FIXED_SERIES})
    return out(wide, "t", *["p" + n[0] for n in T.FIXED_SERIES], digits=3)


@query
def series_report(spark, sf_dir):
    return out(G.series_report(T.common_fits(spark, sf_dir), T.prio_full(spark, sf_dir)), "series_id", "largest", "squares", "rmse_percent", digits=5)


@query
def diagnose_top(spark, sf_dir):
    return out(G.diagnose(T.common_fits(spark, sf_dir), 3), "rank", "series_id", "block", "value")


@query
def factor_recovery_rotated(spark, sf_dir):
    """The common factor against its negative: the rotation turns it round."""
    f = M.common_factor(T.prio_full(spark, sf_dir)).select("t", F.lit(0).alias("k"), F.col("f").alias("true"), (F.lit(0.5) - F.col("f")).alias("estimate"))
    return out(E.recovery(E.rotated(f, "t"), "k"), "k", "correlation", "rmse")


@query
def factors_recovery_rotated(spark, sf_dir):
    """Two factors, the mean of all priorities and that of the first two, from a mixture of both with a share of another series."""
    z = M.standardise(T.prio_full(spark, sf_dir))
    mean = lambda c: F.avg(F.when(c, F.col("z")))
    f = z.groupBy("t").agg(mean(F.lit(True)).alias("f"), mean(F.col("series_id") < "3").alias("g"), mean(F.col("series_id") > "5").alias("h")).where("f is not null and g is not null and h is not null")
    mixed = [F.struct(F.lit(k).alias("k"), F.col(true).alias("true"), estimate.alias("estimate")) for k, true, estimate in ((0, "f", 0.6 * F.col("g") - 0.8 * F.col("f")), (1, "g", 0.8 * F.col("g") + 0.6 * F.col("f") + 0.1 * F.col("h")))]
    rows = f.select("t", F.inline(F.array(*mixed)))
    return out(E.recovery(E.rotated(rows, "t"), "k"), "k", "correlation", "rmse")


@query
def infinite_missing(spark, sf_dir):
    """Shares of a total that is 0 in some months: infinite ones count as missing, and so do those that are no number."""
    total = F.when(F.col("t") % 9 == 4, F.lit(0.0)).otherwise(F.sum("value").over(Window.partitionBy("t")))
    share = F.expr("case when total = 0 and t % 2 = 0 then double('infinity') when total = 0 then double('nan') else value / total end")
    rows = T.prio_full(spark, sf_dir).where("value is not null").withColumn("total", total).withColumn("value", share)
    return out(rows.select("period", "series_id", P.finite("value").alias("value")))


@query
def loading_recovery(spark, sf_dir):
    part = M.loadings_ls(T.prio_full(spark, sf_dir).where("t < 40")).withColumnRenamed("loading", "estimate")
    rows = M.loadings_ls(T.prio_full(spark, sf_dir)).withColumnRenamed("loading", "true").join(part, "series_id").withColumn("k", F.lit(0))
    return out(E.recovery(E.rotated(rows, "series_id"), "k"), "k", "correlation", "rmse")


@query
def pca_pair(spark, sf_dir):
    """First principal component of two series, whose eigenvector has a closed form."""
    two = T.prio_full(spark, sf_dir).where(F.col("series_id") < "3")
    loads, scores = G.principal_components(two, 1)
    return out(T.union([loads.select(F.lit("loading").alias("kind"), "series_id", F.lit(None).cast("int").alias("t"), "value"), scores.select(F.lit("factor").alias("kind"), F.lit(None).cast("string").alias("series_id"), "t", "value")]))


@query
def constrained_pair(spark, sf_dir):
    """Least squares of the third series on the first two, held to equal loadings."""
    z = M.standardise(T.prio_full(spark, sf_dir))
    wide = z.groupBy("t").pivot("series_id", list(T.FIXED_SERIES[:3])).agg(F.first("z")).toDF("t", "a", "b", "y").where("a is not null and b is not null and y is not null")
    return out(G.equal_loadings(wide, "y", ["a", "b"]))


@query
def stationary_pair(spark, sf_dir):
    """V with V = A V A' + Q for a chain of two states in each nation."""
    k = F.col("ord") / 100
    row = lambda *x: F.array(*[F.lit(v) if isinstance(v, float) else v for v in x])
    chains = T.nation_spec(spark, sf_dir).select(
        F.col("series_id").alias("model"), F.array(row(0.5 + k, 0.1), row(0.0, 0.3 + 2 * k)).alias("a"), F.array(row(1.0, 0.0), row(0.0, 1.0)).alias("q"), row(0.0, 0.0).alias("z0"), F.array(row(1.0, 0.0), row(0.0, 1.0)).alias("v0")
    )
    rows = W.stationary(chains).select("model", F.posexplode("v0").alias("i", "row"))
    return out(rows, "model", "i", F.posexplode("row").alias("j", "value"))


# sources and small relational operators


@query
def csv_dates_down(spark, sf_dir):
    """The wide panel through a CSV file whose first column holds dates."""
    path = scratch.fresh(spark, "dates_down")
    wide = panel_pivot_wide(spark, sf_dir)
    wide.write.csv(path, header=True)
    return out(tables.read_csv(spark, path))


@query
def csv_dates_across(spark, sf_dir):
    """The panel through a CSV file with a row a series and a column a date."""
    path, line = scratch.fresh(spark, "dates_across"), T.line(spark, sf_dir).where("period between date '1996-01-01' and date '1996-12-01'")
    dates = [f"1996-{m:02d}-01" for m in range(1, 13)]
    wide = line.withColumn("period", F.col("period").cast("string")).groupBy("series_id").pivot("period", dates).agg(F.first("value"))
    wide.write.csv(path, header=True)
    return out(tables.read_csv(spark, path))


@query
def parquet_years(spark, sf_dir):
    """The panel through a folder a year, read back for two of them."""
    path = scratch.fresh(spark, "years")
    tables.write(T.line(spark, sf_dir), path)
    return out(P.between(tables.read_parquet(spark, path), "1996-01-01", "1997-12-01"))


@query
def load_pipeline(spark, sf_dir):
    spec = T.nation_spec(spark, sf_dir)
    return out(P.load(T.nation(spark, sf_dir), spec, "1996-01-01", "2000-12-01"), "period", "series_id", "t", "value", "raw_value")


@query
def in_memory_panel(spark, sf_dir):
    """A year of the priorities as rows of numbers on the driver, twelve of them, and back."""
    year = P.pivot(P.between(T.prio(spark, sf_dir), "1996-01-01", "1996-12-01"), list(T.FIXED_SERIES)).orderBy("period").drop("period")
    rows = [[None if v is None else v if k % 5 else float("nan") for k, v in enumerate(r, n)] for n, r in enumerate(year.limit(12).collect())]
    return out(tables.in_memory(spark, rows, list(T.FIXED_SERIES), "1996-01-01"))


@query
def result_store(spark, sf_dir):
    store = tables.ParquetStore(spark, scratch.fresh(spark, "store"))
    fits, spec = T.common_fits(spark, sf_dir), G.ModelSpec(T.FIXED_SERIES, Layout(("m",) * 5, ((1,),) * 5))
    store.save(fits.where("kind = 'mean'"), spec)
    newest = store.save(fits.where("kind like 'loading%'"), spec, "second")
    return out(store.load(newest)[0], "kind", "name", "value", F.lit(len(store.list())).alias("stored"))


@query
def views_newest_first(spark, sf_dir):
    catalogue = tables.ViewCatalogue(T.nation_panel(spark, sf_dir))
    for d in (T.VIEWS[1], T.VIEWS[4], T.VIEWS[2]):
        catalogue.get(d)
    rows = [catalogue.get(d).agg(F.lit(k).alias("place"), F.lit(d).alias("view_date"), F.count("value").alias("n_available")) for k, d in enumerate(catalogue.list())]
    return out(T.union(rows))


@query
def view_latest(spark, sf_dir):
    catalogue = tables.ViewCatalogue(T.nation_panel(spark, sf_dir))
    catalogue.get(T.VIEWS[0])
    catalogue.get(T.VIEWS[3])
    return out(catalogue.latest().drop("transformation", "blocks", "release_day", "release_date", "ord", "frequency"), "series_id", "period", "value")


@query
def appended_columns(spark, sf_dir):
    lags = T.prio_gap(spark, sf_dir).withColumns({f"lag{k}": F.lag("value", k).over(Window.partitionBy("series_id").orderBy("t")) for k in (1, 12)})
    return out(lags, "period", "series_id", "lag1", "lag12")


@query
def distinct_codes(spark, sf_dir):
    return out(T.nation_spec(spark, sf_dir).select("frequency", "transformation").distinct())


@query
def spec_from_flags(spark, sf_dir):
    """The configuration of a spec table with a 0/1 column a block, as a table again."""
    spec = T.nation_spec(spark, sf_dir).orderBy("ord")
    blocks = ["Block_Global", "Block_ASIA", "Block_EUROPE"]
    flags = spec.select("series_id", "frequency", "transformation", F.col("release_day").alias("Release"), *[F.array_contains("blocks", b).cast("int").alias(b) for b in blocks])
    config = ModelConfig.from_mapping(spec_mapping(flags))
    rows = config.series_table(spark).withColumn("blocks", F.array_join(F.array_sort("blocks"), ","))
    return out(rows, "series_id", "frequency", "transformation", "blocks", "release_day")


@query
def spec_from_csv(spark, sf_dir):
    """The spec table with a 0/1 column a block as a CSV file, read by a session."""
    path, spec = scratch.fresh(spark, "spec"), T.nation_spec(spark, sf_dir)
    blocks = ["Block_Global", "Block_ASIA", "Block_EUROPE"]
    flags = [F.array_contains("blocks", b).cast("int").alias(b) for b in blocks]
    spec.select("series_id", "frequency", "transformation", F.col("release_day").alias("Release"), *flags).write.csv(path, header=True)
    rows = FactorSession(spark).from_spec(path).config.series_table(spark)
    return out(rows, "series_id", "frequency", "transformation", F.array_join(F.array_sort("blocks"), ",").alias("blocks"), "release_day")


@query
def target_positions(spark, sf_dir):
    """Where the calendar of the loaded panel has a period, by any of its names."""
    spec = T.nation_spec(spark, sf_dir).where("ord < 4")
    session = FactorSession(spark).from_dict({"series": [r.asDict() for r in spec.orderBy("ord").collect()]})
    # a quarterly series has cells at the ends of quarters only
    session.load_data(P.align(T.nation(spark, sf_dir), spec).where("frequency = 'm' or month(period) % 3 = 0").select("period", "series_id", "value"))
    rows = [(name, session.position(name)) for name in ("2000-03-01", "2000-03-15", "2000m7", "1999q2", "2000s2", "1998")]
    return out(spark.createDataFrame(rows, "name string, t int"))


@query
def config_drift(spark, sf_dir):
    """What a result fitted on the nations' own frequencies says of a configuration that makes every third one quarterly."""
    rows = [r.asDict() for r in T.nation_spec(spark, sf_dir).orderBy("ord").collect()]
    config = ModelConfig.from_mapping({"series": [r | {"frequency": "q" if r["ord"] % 3 == 0 else r["frequency"]} for r in rows]})
    fitted = ModelConfig.from_mapping({"series": rows}).model()
    return out(spark.createDataFrame([(x,) for x in config.drift_from(fitted)], "drift string"))


@query
def config_merged(spark, sf_dir):
    """A base with an override: its series win, blocks of both stay, settings of both count."""
    base = {"series": {"x": {}}, "blocks": {"Block_Global": {"factors": 2}}, "max_iter": 9, "threshold": 0.5}
    over = {"series": [r.asDict() for r in T.nation_spec(spark, sf_dir).where("ord < 3").orderBy("ord").collect()], "blocks": {b: {} for b in ("Block_AFRICA", "Block_AMERICA", "Block_ASIA", "Block_EUROPE", "Block_MIDDLE EAST")}, "threshold": 0.25}
    config = ModelConfig.from_mapping(MergedSource(MappingSource(base), MappingSource(over)).mapping())
    rows = config.series_table(spark).crossJoin(spark.createDataFrame([(config.settings.max_iter, config.settings.threshold, len(config.blocks), config.blocks["Block_Global"].factors)], "max_iter int, threshold double, n_blocks int, global_factors int"))
    return out(rows, "series_id", "ord", "max_iter", "threshold", "n_blocks", "global_factors")


@query
def config_yaml(spark, sf_dir):
    """A configuration written as YAML and read back."""
    rows = [r.asDict() for r in T.nation_spec(spark, sf_dir).where("ord % 3 = 0").orderBy("ord").collect()]
    mapping = ModelConfig.from_mapping({"series": rows}).to_mapping()
    with tempfile.TemporaryDirectory() as folder:
        write_yaml(mapping, folder, "nation")
        with open(f"{folder}/model.yaml", "w") as f:
            f.write("defaults:\n- series: nation\n- blocks: nation\nmax_iter: 3\n")
        config = load_config(f"{folder}/model.yaml")
    return out(config.series_table(spark), "series_id", "frequency", "transformation", "release_day", F.array_join("blocks", ",").alias("blocks"), F.lit(config.settings.max_iter).alias("max_iter"))


# calendar and frequencies once more


@query
def timestamp_forms(spark, sf_dir):
    """One date written in every form that is read."""
    days = T.prio(spark, sf_dir).select(F.date_add("period", 9).alias("day")).distinct()
    forms = {"iso": "yyyy-MM-dd", "time": "yyyy-MM-dd HH:mm:ss", "letter": "yyyy-MM-dd'T'HH:mm:ss", "slashes": "yyyy/MM/dd", "american": "MM/dd/yyyy", "european": "dd-MM-yyyy"}
    read = [D.parse_timestamp(D.written("day", p)).cast("date").alias(n) for n, p in forms.items()]
    seconds = D.parse_timestamp(F.unix_timestamp(F.col("day").cast("timestamp")).cast("string")).cast("date").alias("seconds")
    return out(days, "day", *read, seconds, D.parse_timestamp(F.lit("no date")).cast("date").alias("wrong"))


@query
def calendar_parts(spark, sf_dir):
    month = T.prio(spark, sf_dir).select("period").distinct()
    made = D.make_date(F.year("period"), F.month("period"), F.lit(31)).alias("day31")
    start = F.lit("1995-01-01").cast("date")
    at = F.months_between("period", start).cast("int")
    return out(month, "period", D.days_in_month("period").alias("days"), made, D.written("period", "MM/yyyy").alias("label"), D.at_position(at, start, "m").alias("same"))


@query
def date_range_periods(spark, sf_dir):
    start = T.prio(spark, sf_dir).agg(F.last_day(F.min("period")).alias("low"))
    frames = [D.date_range_of(start, F.col("low"), 7, f).select(F.lit(f).alias("frequency"), "period") for f in Q.FREQUENCIES]
    return out(T.union(frames))


@query
def tent_shapes(spark, sf_dir):
    """Every shape, as long as the nation's place says."""
    spec, n = T.nation_spec(spark, sf_dir), F.col("ord") % 12 + 1
    return out(T.union([spec.select("series_id", F.lit(s).alias("shape"), F.posexplode(Q.tent_column(n, s)).alias("k", "weight")) for s in ("symmetric", "linear", "exponential")]))


@query
def aggregation_structure(spark, sf_dir):
    """The slower frequencies on each clock, their series and their tents."""
    rows = _clocks(spark, sf_dir).where("slow is not null").withColumn("weights", Q.tent_of_pair("slow", "clock"))
    found = rows.groupBy("clock", "slow", "weights").agg(F.count(F.lit(1)).alias("n_series"))
    return out(found, "clock", F.col("slow").alias("frequency"), "n_series", F.size("weights").alias("n"), F.array_join(F.transform("weights", lambda w: w.cast("string")), ",").alias("weights"))
