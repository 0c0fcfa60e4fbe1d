"""Settings of an event tokenizer, checked when they are made."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

TEXT_MODES = ("auto", "bpe", "concept")
MILESTONES = ("none", "week", "month", "daily", "12hr", "8hr")
DISTRIBUTIONS = ("normal", "lognormal", "gamma", "minmax")

# Fixed value: the pre-tokenizer pattern that byte-pair training uses unless another is given.
SPLIT_PATTERN = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
)


def _one_of(name: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}, not {value!r}")


def checked_splitters(rules: dict | None) -> dict[str, str | tuple]:
    """Splitting rules by class: a delimiter, or widths that end in None. TypeError for other
    containers, keys and rules; ValueError for an empty delimiter or widths that aren't positive
    integers before one final None."""
    if rules is None:
        return {}
    if not isinstance(rules, dict):
        raise TypeError("concept_splitters must map classes to rules")
    out: dict[str, str | tuple] = {}
    for cls, rule in rules.items():
        if not isinstance(cls, str):
            raise TypeError(f"concept_splitters: {cls!r} is no class name")
        if isinstance(rule, str):
            if rule == "":
                raise ValueError(f"concept_splitters: the delimiter of {cls!r} is empty")
            out[cls] = rule
        elif isinstance(rule, (bytes, bytearray)) or not isinstance(rule, Sequence):
            raise TypeError(f"concept_splitters: the rule of {cls!r} is neither a delimiter nor widths")
        else:
            *widths, last = rule if len(rule) else [0]
            if last is not None or not widths or not all(type(w) is int and w > 0 for w in widths):
                raise ValueError(f"concept_splitters: the widths of {cls!r} must be positive integers and a final None")
            out[cls] = (*widths, None)
    return out


@dataclass(frozen=True)
class TokenizerConfig:
    """How events become tokens. See the README for what each setting does."""

    text_mode_default: str = "auto"
    text_mode_overrides: dict | None = None
    text_mode_threshold: int = 64
    concept_splitters: dict | None = None
    fuse_class_to_concept: bool = False
    namespace_concepts_by_class: bool = False
    num_type: str = "discrete"
    num_seq: str = "factored"
    n_bins: int = 10
    level_threshold: int = 10
    bin_clip_min: float = 1.0
    bin_clip_max: float = 99.0
    continuous_clip_min: float = 1.0
    continuous_clip_max: float = 99.0
    continuous_clip_values: bool = True
    distributions: dict | None = None
    final_vocab_size: int = 4096
    split_pattern: str = SPLIT_PATTERN
    time_scales: Sequence[float] | None = None
    time_scale_names: Sequence[str] | None = None
    state_transitions: dict | None = None
    initial_state: str = "default"
    milestone_per_state: dict | None = None
    milestone_shift_start: int = 7
    birth_date_class: str = "demographic"
    birth_date_text_value: str = "birth_date"
    #: Ours: share of the byte-pair texts that is read for training, and its seed.
    bpe_training_sample: float | None = None
    bpe_training_seed: int = 0
    splitters: dict = field(default=None, init=False, repr=False, compare=False)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        _one_of("text_mode_default", self.text_mode_default, TEXT_MODES)
        _one_of("num_type", self.num_type, ("discrete", "continuous"))
        _one_of("num_seq", self.num_seq, ("fused", "factored"))
        for key, mode in (self.text_mode_overrides or {}).items():
            _one_of(f"text_mode_overrides[{key!r}]", mode, TEXT_MODES[1:])
        for kind in (self.milestone_per_state or {}).values():
            _one_of("milestone_per_state", kind, MILESTONES)
        for name in self.distributions or {}:
            _one_of("distributions", name, DISTRIBUTIONS)
        scales = list(self.time_scales or [])
        if any(s <= 0 for s in scales):
            raise ValueError("time_scales must be positive")
        if any(b <= a for a, b in zip(scales, scales[1:])):
            raise ValueError("time_scales must ascend")
        if self.time_scale_names is not None and len(self.time_scale_names) != len(scales) + 1:
            raise ValueError(f"time_scale_names needs {len(scales) + 1} names, one for each band")
        object.__setattr__(self, "splitters", checked_splitters(self.concept_splitters))

    @property
    def bands(self) -> list[str]:
        """Names of the time bands, the shortest first."""
        return list(self.time_scale_names or map(str, range(len(self.time_scales or []) + 1)))

    @property
    def triggers(self) -> dict[str, str]:
        """Class -> the state it leads to; of several states the last named counts."""
        return {c: s for s, classes in (self.state_transitions or {}).items() for c in classes}

    def class_overrides(self) -> dict[str, str]:
        return {k: v for k, v in (self.text_mode_overrides or {}).items() if not isinstance(k, tuple)}

    def pair_overrides(self) -> dict[tuple[str, str], str]:
        return {k: v for k, v in (self.text_mode_overrides or {}).items() if isinstance(k, tuple)}

    def to_json(self) -> str:
        d = asdict(self)
        d.pop("splitters")
        d["text_mode_overrides"] = [[list(k) if isinstance(k, tuple) else k, v] for k, v in (self.text_mode_overrides or {}).items()] or None
        return json.dumps(d)

    @classmethod
    def from_json(cls, text: str) -> TokenizerConfig:
        """Settings that an older file lacks take their defaults; unknown ones are left out."""
        d = json.loads(text)
        if d.get("text_mode_overrides"):
            d["text_mode_overrides"] = {tuple(k) if isinstance(k, list) else k: v for k, v in d["text_mode_overrides"]}
        known = {f for f, x in cls.__dataclass_fields__.items() if x.init}
        return cls(**{k: v for k, v in d.items() if k in known})
