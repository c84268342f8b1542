"""Configuration sources, merging, validation."""

import pytest
import yaml

from tidegauge.sources import config as C

LISTED = {
    "series": [{"series_id": "a", "frequency": "m", "blocks": ["Block_Global"]}, {"frequency": "q", "transformation": "PCA", "blocks": ["Block_Global", "Block_X"], "release_date": 25}],
    "max_iter": 7,
}
KEYED = {"series": {"a": {"frequency": "m"}, "b": {"frequency": "q", "blocks": ["Block_X"]}}, "blocks": {"Block_X": {"factors": 2}, "Block_Global": {"factors": 1}}}


def test_mappings():
    c = C.load(LISTED)
    assert list(c.blocks) == ["Block_Global", "Block_X"] and c.series[1].series_id == "series_1"
    assert c.series[1].transformation == "pca" and c.series[1].release_day == 25 and c.settings.max_iter == 7
    k = C.load(KEYED)
    assert list(k.blocks)[0] == "Block_Global" and k.series[1].blocks == ("Block_Global", "Block_X") and k.blocks["Block_X"].factors == 2
    assert C.load(c) == c or C.load(c).to_mapping() == c.to_mapping()
    flags = C.ModelConfig.from_mapping({"series": [{"series_id": "a", "blocks": [1, 0]}, {"series_id": "b", "blocks": [1, 1]}], "blocks": {"Block_Global": {}, "Z": {}}})
    assert flags.series[0].blocks == ("Block_Global",) and flags.series[1].blocks == ("Block_Global", "Z")


@pytest.mark.parametrize(
    "raw,word",
    [
        ({"series": []}, "no series"),
        ({"series": [{"series_id": "a", "frequency": "w"}]}, "faster"),
        ({"series": [{"series_id": "a"}], "blocks": {"Block_Global": {"clock": "d"}}}, "faster than the global clock"),
        ({"series": [{"series_id": "a"}], "blocks": {"Block_Global": {"factors": 0}}}, "0 factors"),
        ({"series": [{"series_id": "a", "blocks": ["B"]}, {"series_id": "b"}], "blocks": {"Block_Global": {}, "B": {}}}, "does not load"),
        ({"series": [{"series_id": "a", "frequency": "z"}]}, "unknown frequency"),
        ({"series": [{"series_id": "a"}, {"series_id": "a"}]}, "twice"),
    ],
)
def test_validation(raw, word):
    with pytest.raises(ValueError, match=word):
        C.load(raw)
    report = C.ModelConfig.from_mapping(raw, check=False).report()
    assert not report["valid"] and len(report["errors"]) == len(report["suggestions"])


def test_merge():
    src = C.MergedSource(C.MappingSource(KEYED | {"threshold": 0.5}), C.MappingSource({"max_iter": 3, "blocks": {"Block_X": {"factors": 3}}}))
    c = C.load(src)
    assert c.settings.max_iter == 3 and c.settings.threshold == 0.5 and c.blocks["Block_X"].factors == 3 and len(c.series) == 2
    replaced = C.load(C.MergedSource(C.MappingSource(KEYED), C.MappingSource({"series": {"z": {}}})))
    assert [s.series_id for s in replaced.series] == ["z"]


def test_factory():
    assert isinstance(C.source("x.yaml"), C.YamlSource) and isinstance(C.source(mapping={}), C.MappingSource)
    with pytest.raises(ValueError):
        C.source("spec.csv")
    with pytest.raises(ValueError):
        C.source({}, yaml_path="x.yaml")
    with pytest.raises(TypeError):
        C.source(3)


def test_yaml_with_defaults(tmp_path, spark):
    spec = spark.createDataFrame(
        [("a", "A", "m", "pch", "1", "0", "25"), ("b", "B", "q", "lin", "1", "1", None)],
        "series_id string, series_name string, frequency string, transformation string, Block_Global string, `Block-X` string, Release string",
    )
    mapping = C.spec_mapping(spec)
    assert mapping["series"]["b"]["blocks"] == ["Block_Global", "Block-X"] and mapping["series"]["a"]["release"] == 25
    C.write_yaml(mapping, str(tmp_path), "mine")
    (tmp_path / "nested").mkdir()
    (tmp_path / "nested" / "main.yaml").write_text(yaml.safe_dump({"defaults": [{"series": "mine"}, {"blocks": "mine"}, {"experiment": None}, "_self_"], "max_iter": 9}))
    c = C.load(str(tmp_path / "nested" / "main.yaml"))
    assert c.settings.max_iter == 9 and [s.series_id for s in c.series] == ["a", "b"] and c.series[0].release_day == 25
    assert sorted(tuple(r) for r in C.block_membership(spec.selectExpr("series_id", "int(Block_Global) Block_Global", "int(`Block-X`) `Block-X`"), ["Block_Global", "Block-X"]).collect()) == [
        ("a", "Block_Global"), ("b", "Block-X"), ("b", "Block_Global")]
    listed = C.spec_mapping(spark.createDataFrame([("a", "G, H")], "series_id string, blocks string"))
    assert listed["series"]["a"]["blocks"] == ["G", "H"]


def test_tables(spark):
    c = C.load(KEYED)
    assert c.series_table(spark).count() == 2 and c.block_table(spark).count() == 2
    assert C.issues(c.series_table(spark), c.block_table(spark)).count() == 0
    spec = c.model(max_iter=4)
    assert spec.series == ("a", "b") and spec.layout.depth == 5
    assert type(spec).from_json(spec.json()) == spec


def test_settings_reach_the_estimation():
    raw = LISTED | {
        "nan_method": 3, "nan_k": 5, "ar_clip_min": -0.5, "ar_clip_max": 0.6, "regularization_scale": 0.1, "min_eigenvalue": 1e-3,
        "max_eigenvalue": 10, "damping_factor": 0.5, "idio_rho0": 0.2, "idio_min_var": 1e-4, "data_clip_threshold": 7,
    }
    o = C.load(raw).model().options
    assert (o.nan_method, o.nan_k, o.ar_clip, o.ridge, o.least_eigenvalue, o.most_eigenvalue) == (3, 5, (-0.5, 0.6), 0.1, 1e-3, 10)
    assert (o.damping, o.rho0, o.least_idio, C.load(raw).model().clip) == (0.5, 0.2, 1e-4, 7)
    off = C.load(raw | {"clip_ar_coefficients": False, "use_regularization": False, "use_damped_updates": False, "clip_data_values": False})
    assert (off.model().options.ar_clip, off.model().options.ridge, off.model().options.damping, off.model().clip) == (None, None, None, None)
    spec = C.load(raw).model(max_iter=2, idio_rho0=0.3, augment_idio=False)
    assert spec.max_iter == 2 and spec.options.rho0 == 0.3 and not spec.layout.idio and type(spec).from_json(spec.json()) == spec
    with pytest.raises(TypeError, match="unknown"):
        C.load(raw).model(no_such=1)
    lags = C.load({"series": {"a": {}, "b": {"blocks": ["X"]}}, "blocks": {"Block_Global": {}, "X": {"ar_lag": 2}}}).model()
    assert [lags.layout.lags_of(b) for b in (0, 1)] == [1, 2]


def test_warnings_drift_and_lookups():
    c = C.load(LISTED | {"warn_on_ar_clip": False})
    assert c.warnings({"ar_clip": 3, "data_clip": 2, "damped_update": 1}) == ["data clip: 2 times", "damped update: 1 times"]
    assert c.series_index("series_1") == 1 and c.units() == [None, None] and c.series_names()[0] == "a"
    with pytest.raises(KeyError, match="known: a"):
        c.series_index("zz")
    assert c.series_name(0) == c.series_name("a") == "a" and c.unit("a") == "" and c.unit(1, "none") == "none" and c.ids_named("a") == ["a"]
    with pytest.raises(IndexError, match="0 to 1"):
        c.series_at(2)
    assert c.drift_from(c.model()) == []
    other = C.load({"series": {"series_1": {"frequency": "m"}, "c": {}}})
    assert other.drift_from(c.model()) == ["series a is gone", "series c is new", "series series_1: frequency q", "blocks Block_Global, Block_X"]
