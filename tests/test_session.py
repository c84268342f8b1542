"""The facade from a file to news, and the stores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import FactorSession
from tidegauge.sources import tables

NAMES = ["a", "b", "c", "q"]


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    rng = np.random.default_rng(7)
    f = np.zeros(72)
    for k in range(1, 72):
        f[k] = 0.6 * f[k - 1] + rng.normal()
    rows = ["Date," + ",".join(NAMES) + ",extra"]
    for k in range(72):
        cells = [f"{100 + f[k] + 0.3 * rng.normal():.4f}" if rng.random() > 0.05 else "" for _ in range(3)]
        rows.append(f"{2015 + k // 12}-{k % 12 + 1:02d}-01," + ",".join(cells) + f",{f'{50 + f[k]:.3f}' if k % 3 == 2 else ''},x")
    path = tmp_path_factory.mktemp("csv") / "panel.csv"
    path.write_text("\n".join(rows))
    return str(path)


CONFIG = {"series": {"a": {"release_date": 10}, "b": {"release_date": -5}, "c": {}, "q": {"frequency": "q", "release": 25}}, "threshold": 1e-3, "max_iter": 8}


@pytest.fixture(scope="module")
def trained(spark, csv):
    return FactorSession(spark).from_dict(CONFIG).load_data(csv, "2015-01-01", "2020-12-01").train()


def test_data(trained):
    assert trained.data().count() == 4 * 72 and trained.original_data().where("series_id = 'q' and value is not null").count() == 24
    assert {r["series_id"]: r["n_obs"] for r in trained.quality().collect()}["q"] == 24
    assert trained.factors().count() == 72 and trained.loadings().count() == 4 and trained.smoothed().count() == 4 * 72
    assert trained.diagnose(2).count() == 2 and trained.history("a").count() == 72


def test_predict_and_plot(trained):
    assert trained.predict().count() == 4 * 12 and trained.predict(3).where("value is null").count() == 0
    assert trained.plot_data(2).groupBy("kind").count().count() == 2


def test_states_and_report(trained):
    s = trained.state("a", ["2015-02-01", "2020-12-01"], 3).orderBy("t").collect()
    assert len(s[0]["history"]) == 3 and s[0]["history"][0] is None and len(s[1]["features"]) == 1 + 3 + 3 + 1
    assert trained.report().where("largest > 0 and std > 0").count() == 4


def test_nowcast_news_update(trained):
    rows = trained.nowcast("q", ["2020-11-20", "2020-12-20"], "2020-12-01").orderBy("view_date").collect()
    assert [r["observed"] for r in rows] == [False, False] and rows[0]["n_available"] < rows[1]["n_available"]
    later = trained.nowcast("q", "2020-12-26", "2020-12-01").first()
    assert later["observed"] and later["nowcast"] == pytest.approx(trained.original_data().where("series_id = 'q'").orderBy(F.desc("period")).first()["value"])
    news = trained.decompose("q", "2020-11-20", "2020-12-20", "2020-12-01").collect()
    assert sum(r["news"] for r in news) == pytest.approx(news[0]["y_new"] - news[0]["y_old"], abs=1e-6)
    assert rows[1]["nowcast"] - rows[0]["nowcast"] == pytest.approx(news[0]["y_new"] - news[0]["y_old"], abs=1e-6)
    seen = []
    found = trained.update("q", "2020-11-20", "2020-12-20", "2020-12-01", lambda df: seen.append(df.count()))
    assert seen == [found.count()]
    trained.update("q", "2020-11-20", "2020-12-20", "2020-12-01", lambda df: 1 / 0)


def test_backtest_and_dataset(trained):
    steps = trained.backtest("q", "2020-12-01", 2)
    assert steps.count() == 2 and steps.where("error is null").count() == 0
    assert trained.dataset("q", ["2020-09-01", "2020-12-01"]).where("target is not null").count() == 2
    with pytest.raises(ValueError):
        trained.nowcast("q", "2020-12-01", "2010-01-01")
    with pytest.raises(KeyError):
        trained.nowcast("zz", "2020-12-01", "2020-12-01")


def test_dataset_by_weeks(trained):
    rows = trained.dataset("q", ["2020-12-01"], 3).collect()
    assert len(rows[0]["path"]) == 4 and rows[0]["path"][-1] == rows[0]["baseline"] and rows[0]["path"][0] != rows[0]["path"][-1]


def test_targets_views_and_summary(trained):
    from datetime import date

    assert trained._target("2020q4") == trained._target("2020-12-01") == trained._target(date(2020, 12, 1)) == trained._target(71) == 71
    assert trained._target("2016") == trained._target("2016s1") == 12 and trained._target("2015m3") == 2
    assert trained.view("2020-11-20") is trained.view("2020-11-20") and trained.time().count() == 72
    told = trained.summary().first()
    assert told["iterations"] == len(trained.model.fitted.logliks) and told["loglik"] == pytest.approx(trained.model.fitted.logliks[-1])
    lines = trained.backtest_lines(trained.backtest("q", "2020-12-01", 2))
    assert lines.count() == 6 and {r["kind"] for r in lines.collect()} == {"nowcast", "actual", "error"}


def test_functions_of_the_package(spark, csv, caplog):
    import tidegauge

    tidegauge.reset()
    assert tidegauge.config() is None and tidegauge.result() is None
    tidegauge.from_dict(CONFIG)
    tidegauge.load_data(csv, "2015-01-01", "2020-12-01")
    tidegauge.train(max_iter=2, idio_rho0=0.3, ar_clip_max=0.05, ar_clip_min=-0.05)
    assert tidegauge.default().model.spec.options.rho0 == 0.3 and tidegauge.predict(2).count() == 8 and tidegauge.config().series_ids() == NAMES
    assert "not converged" in caplog.text and "ar clip" in caplog.text
    assert tidegauge.result().count() > 0 and tidegauge.kalman_filter is not None and tidegauge.rmse is not None
    tidegauge.reset()
    with pytest.raises(AttributeError):
        tidegauge.no_such_thing


def test_store_tells_of_other_configurations(trained, spark, tmp_path, csv, caplog):
    store = tables.ParquetStore(spark, str(tmp_path))
    saved = store.save(trained.fits, trained.model.spec)
    FactorSession(spark).from_dict({"series": {"a": {}, "zz": {}}}).load_result(store, saved)
    assert "series zz is new" in caplog.text


def test_database(spark):
    panel = tables.in_memory(spark, [[1.0, None], [2.0, 3.0]], ["a", "b"])
    db = tables.JdbcDatabase(spark, "jdbc:derby:memory:panels;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    db.write(panel, "cells")
    key = lambda r: (r["period"], r["series_id"])
    assert sorted(db.read("cells").collect(), key=key) == sorted(panel.collect(), key=key)


def test_store(trained, spark, tmp_path, csv):
    store = tables.ParquetStore(spark, str(tmp_path))
    assert store.list() == []
    first, second = store.save(trained.fits, trained.model.spec), store.save(trained.fits, trained.model.spec, "again")
    assert [m["result_id"] for m in store.list()] == [second, first] and store.list()[0]["note"] == "again"
    other = FactorSession(spark).from_dict(CONFIG).load_data(csv, "2015-01-01", "2020-12-01").load_result(store, first)
    assert np.allclose(other.model.fitted.params.a, trained.model.fitted.params.a)
    a, b = (sorted(map(tuple, s.predict(2).collect())) for s in (trained, other))
    assert a == b


def test_layouts_and_errors(spark, csv, tmp_path):
    wide = tmp_path / "rows.csv"
    wide.write_text("id,2020-01-01,2020-02-01\na,1,2\nb,,x\n")
    got = sorted(map(str, (tuple(r) for r in tables.read_csv(spark, str(wide)).collect())))
    assert len(got) == 4 and sum("None" in g for g in got) == 2
    with pytest.raises(RuntimeError):
        FactorSession(spark).load_data(csv)
    with pytest.raises(ValueError, match="none of"):
        FactorSession(spark).from_dict({"series": {"nope": {}}}).load_data(csv)
    with pytest.raises(RuntimeError):
        FactorSession(spark).from_dict(CONFIG).predict()
    panel = tables.in_memory(spark, [[1.0, None], [2.0, float("nan")]], ["a", "b"])
    assert panel.count() == 4 and panel.where("value is not null").count() == 2
    tables.write(panel, str(tmp_path / "p"))
    assert tables.read_parquet(spark, str(tmp_path / "p")).count() == 4
    views = tables.ViewCatalogue(panel.withColumn("release_day", F.lit(1)))
    assert views.latest() is None
    views.get("2000-01-05")
    views.get("2000-03-05")
    assert views.list() == ["2000-03-05", "2000-01-05"] and views.latest().where("value is not null").count() == 2


def test_spec_table(spark, tmp_path):
    (tmp_path / "spec.csv").write_text("series_id,frequency,transformation,Block_Global,Block_X,Release\na,m,lin,1,0,10\nb,m,pch,1,1,\n")
    s = FactorSession(spark).from_spec(str(tmp_path / "spec.csv"), max_iter=5)
    assert s.config.settings.max_iter == 5 and s.config.series[0].release_day == 10 and list(s.config.blocks) == ["Block_Global", "Block_X"]
