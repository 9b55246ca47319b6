"""Settings in layers: defaults, then the environment, then what the caller says."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from sablefin.errors import SourceError
from sablefin.functions.patterns import PatternSet, default_pii, load_patterns

PREFIX = "SABLEFIN_"


@dataclass(frozen=True)
class Config:
    """What a run needs to know; the key never shows."""

    endpoint: str = ""
    api_key: str = field(default="", repr=False)
    calls_per_second: float = 3.0
    batch_size: int = 10
    rules: PatternSet = field(default_factory=default_pii)


def load_config(rule_file: str | None = None, environment: Mapping[str, str] | None = None, **given: object) -> Config:
    """Defaults, overridden by ``SABLEFIN_<NAME>`` variables, a rule file, and arguments that are not None.

    Raises :class:`SourceError` for values that do not fit, unknown names and rule files that cannot be read.
    """
    environment = os.environ if environment is None else environment
    config, kinds = Config(), {f.name: type(getattr(Config(), f.name)) for f in fields(Config) if f.name != "rules"}
    try:
        found = {n: kind(environment[PREFIX + n.upper()]) for n, kind in kinds.items() if PREFIX + n.upper() in environment}
        found |= {n: kinds[n](v) for n, v in given.items() if v is not None}
        if rule_file:
            found["rules"] = load_patterns(rule_file)
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise SourceError(f"configuration: {e!r}") from e
    return replace(config, **found)
