import pytest

from tidewake import config


def test_limits_reject_and_accept():
    with pytest.raises(ValueError):
        config.drift_params({"hindcast_hours": 200})
    with pytest.raises(ValueError):
        config.drift_params({"windage_range": [0.05, 0.01]})
    p = config.drift_params({"hindcast_hours": 12, "probability_mass": 5})
    assert p.n_steps == 48 and p.probability_mass == 0.99 and p.dt == -900


def test_weights_are_normalised_and_checked():
    assert abs(sum(config.weights({"proximity": 3.0}).values()) - 1) < 1e-12
    for bad in ({"luck": 1.0}, {"proximity": -1.0}, dict.fromkeys(config.DEFAULTS["attribution"]["weights"], 0.0)):
        with pytest.raises(ValueError):
            config.weights(bad)


def test_snapshot_hash_follows_overrides():
    a, b = config.snapshot(), config.snapshot({"ais": {"live": {"provider": "x"}}})
    assert a["config_hash"] != b["config_hash"] and len(a["config_hash"]) == 16
    assert b["ais"]["csv"] == a["ais"]["csv"] and config.lookup(b, "ais.live.provider") == "x"


def test_requests():
    assert config.detection_overrides(prob_threshold=0.4, land_mask=None) == {"prob_threshold": 0.4}
    for bad in ({"prob_threshold": 2}, {"adapter": "torch"}, {"colour": 1}):
        with pytest.raises(ValueError):
            config.detection_overrides(**bad)
    with pytest.raises(ValueError):
        config.bbox([0, 0, 3, 3], 4.0)
