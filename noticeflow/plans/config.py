"""Checked settings of a collection run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from ..functions.dates import check_range
from ..spec import BUSINESS_TYPES, MODE_ALIASES

FIRST_DAY = date(2015, 1, 1)  # fixed value: start when none is configured


@dataclass(frozen=True)
class CollectConfig:
    begin: date
    end: date
    modes: tuple[str, ...]
    business_types: tuple[str, ...]
    resume: bool = True


def collect_config(raw: dict, today: date) -> CollectConfig:
    """Defaults filled in; unknown modes and types dropped; dates checked."""
    begin = date.fromisoformat(raw["begin"]) if raw.get("begin") else FIRST_DAY
    end = date.fromisoformat(raw["end"]) if raw.get("end") else today
    check_range(begin, end)
    modes = [MODE_ALIASES[m] for m in raw.get("modes") or ("pre", "bid") if m in MODE_ALIASES]
    types = [t for t in raw.get("businessTypes") or BUSINESS_TYPES if t in BUSINESS_TYPES]
    return CollectConfig(
        begin=begin,
        end=end,
        modes=tuple(dict.fromkeys(modes)),
        business_types=tuple(dict.fromkeys(types)),
        resume=raw.get("resume") is not False,
    )
