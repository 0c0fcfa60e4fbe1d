import pytest

from eventloom.config import TokenizerConfig


@pytest.mark.parametrize("bad", [
    {"text_mode_default": "x"}, {"num_type": "x"}, {"num_seq": "x"}, {"time_scales": [2, 1]}, {"time_scales": [0]}, {"time_scales": [1], "time_scale_names": ["a"]}, {"time_scale_names": ["a", "b"]},
    {"milestone_per_state": {"s": "yearly"}}, {"text_mode_overrides": {"lab": "auto"}}, {"distributions": {"x": ["lab"]}},
    {"concept_splitters": {"d": ""}}, {"concept_splitters": {"d": (2, 1)}}, {"concept_splitters": {"d": (2, None, None)}}, {"concept_splitters": {"d": (0, None)}}, {"concept_splitters": {"d": (True, None)}}, {"concept_splitters": {"d": (None,)}}, {"concept_splitters": {"d": ()}},
])
def test_value_errors(bad):
    with pytest.raises(ValueError):
        TokenizerConfig(**bad)


@pytest.mark.parametrize("bad", [["x"], {1: "//"}, {"d": object()}, {"d": b"x"}])
def test_type_errors(bad):
    with pytest.raises(TypeError):
        TokenizerConfig(concept_splitters=bad)


def test_json_round_trip_and_older_files():
    c = TokenizerConfig(text_mode_overrides={"lab": "bpe", ("note", "x"): "concept"}, concept_splitters={"d": (1, None)}, time_scales=[60.0])
    d = TokenizerConfig.from_json(c.to_json())
    assert d.pair_overrides() == {("note", "x"): "concept"} and d.bands == ["0", "1"] and d.splitters == {"d": (1, None)}
    assert TokenizerConfig.from_json('{"n_bins": 4, "gone": 1}') == TokenizerConfig(n_bins=4)


def test_last_trigger_wins():
    assert TokenizerConfig(state_transitions={"a": ["x", "y"], "b": ["x"]}).triggers == {"x": "b", "y": "a"}
