"""Parameters of a run: sections, defaults from a table of data, overrides, and checks before anything runs."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any, get_args, get_type_hints


@dataclass(frozen=True)
class Settings:
    """What the queries take as parameters; every field has a default."""

    source_column: str = "text_whisper"
    target_column: str = "text"
    punctuated: bool = False
    seed: int = 42
    assembled_ratio: float = 0.5
    most_wer: float = 1.0
    least_overlap: float = 30.0
    entity_share: float = 0.3
    most_repeats: int = 3
    train_fraction: float | None = None
    held_out_fraction: float | None = None
    window_words: int = 50
    window_stride: int = 25
    least_window_words: int = 40
    thresholds: tuple[float, ...] = (0.3, 0.5, 0.7, 0.8, 0.9, 0.95)
    most_calls: int | None = None


#: Sections of a settings table, and the fields they may hold.
SECTIONS = {
    "data": ("source_column", "target_column", "punctuated", "train_fraction", "held_out_fraction", "most_calls"),
    "build": ("seed", "assembled_ratio", "most_wer", "least_overlap", "entity_share", "most_repeats"),
    "windows": ("window_words", "window_stride", "least_window_words"),
    "eval": ("thresholds",),
}
PUNCTUATED_COLUMNS, PLAIN_COLUMNS = ("text_raw", "text_soniox"), ("text", "text_whisper")


def flat(raw: Mapping[str, Any]) -> dict[str, Any]:
    """A table of sections and plain fields as plain fields; an unknown field of a section raises."""
    inside = [(f"{k}.{f}", f, v, SECTIONS[k]) for k, part in raw.items() if k in SECTIONS and isinstance(part, Mapping) for f, v in part.items()]
    if unknown := [name for name, f, _, known in inside if f not in known]:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    plain = {k: v for k, v in raw.items() if not (k in SECTIONS and isinstance(v, Mapping))}
    return plain | {f: v for _, f, v, _ in inside}


def cast(value: Any, kind: Any) -> Any:
    """Texts as the type they stand for ("1e-4", "false"), lists as tuples; other values as they are."""
    if isinstance(value, list):
        return tuple(value)
    if not isinstance(value, str):
        return value
    kinds = [k for k in get_args(kind) if k is not type(None)] or [kind]
    if len(kinds) != 1 or kinds[0] not in (bool, int, float):
        return value
    if kinds[0] is bool:
        words = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}
        if value.lower() not in words:
            raise ValueError(f"{value!r} is neither true nor false")
        return words[value.lower()]
    return kinds[0](value)


def load(own: Mapping[str, Any], data: Mapping[str, Any] | None = None, overrides: Mapping[str, Any] | None = None) -> Settings:
    """Settings from a run's own table, over those that a data table gives, under overrides; unknown fields raise."""
    merged = flat(data or {}) | flat(own) | flat(overrides or {})
    if unknown := set(merged) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    kinds = get_type_hints(Settings)
    out = Settings(**{k: cast(v, kinds[k]) for k, v in merged.items()})
    check(out)
    return out


def check(s: Settings) -> list[str]:
    """Warns of columns whose names speak against the punctuation flag, and returns what it warned of."""
    odd = PLAIN_COLUMNS if s.punctuated else PUNCTUATED_COLUMNS
    said = [f"target_column {s.target_column!r} looks {'plain' if s.punctuated else 'punctuated'}, but punctuated is {s.punctuated}"] if s.target_column in odd else []
    for text in said:
        warnings.warn(text, UserWarning, stacklevel=3)
    return said
