"""The parameters of a replay: thresholds, snapshot instants and claims."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import datetime, timezone
import json
import math
from pathlib import Path
import re


class ReplayError(ValueError):
    """An input, a policy or an artifact breaks its contract."""


# Fixed values of the protocol.
PROTOCOL = "synthetic-process-stream-v1"
STAGES = ("ISSUED", "NOTIFIED", "VISITED", "REPORTED", "DECIDED")
GROUPS = ("FLOW_A", "FLOW_B")
LATE_POLICY = "retain_and_revise"

_INSTANT = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:Z|([+-])([0-9]{2}):([0-9]{2}))")


def instant(text: object) -> int:
    """Epoch seconds of an instant with whole seconds and an explicit offset."""
    found = _INSTANT.fullmatch(text) if isinstance(text, str) else None
    if not found:
        raise ReplayError(f"not an instant with an offset: {text!r}")
    sign, hours, minutes = found.group(2), int(found.group(3) or 0), int(found.group(4) or 0)
    if hours > 23 or minutes > 59:
        raise ReplayError(f"offset out of range: {text}")
    try:
        wall = datetime.fromisoformat(found.group(1)).replace(tzinfo=timezone.utc)
    except ValueError as error:
        raise ReplayError(str(error)) from error
    at = int(wall.timestamp()) - (-1 if sign == "-" else 1) * (hours * 3600 + minutes * 60)
    if not -62135596800 <= at <= 253402300799:
        raise ReplayError(f"beyond the years 1 to 9999: {text}")
    return at


def instant_text(at: int | None) -> str:
    if at is None:
        return ""
    moment = datetime.fromtimestamp(at, timezone.utc)
    return f"{moment.year:04d}-{moment:%m-%dT%H:%M:%SZ}"


def _rule(default: object, **bounds: object):
    """A field whose value :func:`check` holds to its bounds."""
    return field(default=default, metadata=bounds)


def check(name: str, value: object, bounds: Mapping[str, object]) -> None:
    """Raise unless a value keeps its bounds.

    ``only`` names the one value allowed, of the same type. All other bounds are
    of numbers: ``above`` and ``least`` from below, ``whole`` for integers, and
    ``grain`` for numbers that so many make whole.
    """
    if "only" in bounds:
        sound = type(value) is type(bounds["only"]) and value == bounds["only"]
    elif bounds:
        kinds = {int} if bounds.get("whole") else {int, float}
        sound = type(value) in kinds and abs(value) < math.inf
        sound = sound and value > bounds.get("above", -math.inf) and value >= bounds.get("least", -math.inf)
        sound = sound and (value * bounds.get("grain", 0)) % 1 == 0
    else:
        sound = True
    if not sound:
        raise ReplayError(f"{name} is out of its bounds {dict(bounds)}: {value!r}")


@dataclass(frozen=True)
class Policy:
    """A checked policy; the defaults are those of the published contract."""

    protocol: str = _rule(PROTOCOL, only=PROTOCOL)
    seed: int = _rule(20261006, whole=True, least=0)
    synthetic_only: bool = _rule(True, only=True)
    establishes_legal_breach: bool = _rule(False, only=False)
    establishes_wrongdoing: bool = _rule(False, only=False)
    stages: tuple[str, ...] = _rule(STAGES, only=STAGES)
    service_groups: tuple[str, ...] = _rule(GROUPS, only=GROUPS)
    late_policy: str = _rule(LATE_POLICY, only=LATE_POLICY)
    allowed_lateness_hours: float = _rule(24, above=0, grain=3600)
    baseline_cutoff: str = "2026-01-15T00:00:00Z"
    observed_at: str = "2026-02-01T00:00:00Z"
    minimum_baseline_cases: int = _rule(12, whole=True, least=3)
    mad_scale_floor: float = _rule(0.1, above=0)
    duration_score_threshold: float = _rule(3.5, above=0)
    absolute_duration_hours: float = _rule(72, above=0)
    open_age_hours: float = _rule(72, above=0)
    notification_wait_hours: float = _rule(96, above=0)
    training_cases: int = _rule(60, whole=True, least=1)
    monitoring_cases: int = _rule(36, whole=True, least=1)

    def __post_init__(self) -> None:
        for f in fields(self):
            check(f.name, getattr(self, f.name), f.metadata)
        if not self.cutoff < self.observed:
            raise ReplayError("the snapshot must be after the baseline cutoff")

    @property
    def observed(self) -> int:
        return instant(self.observed_at)

    @property
    def cutoff(self) -> int:
        return instant(self.baseline_cutoff)

    @property
    def lateness(self) -> int:
        return lateness_seconds(self.allowed_lateness_hours)

    def with_(self, **changes: object) -> Policy:
        return replace(self, **changes)

    def to_json(self) -> str:
        made = asdict(self)
        made["generation"] = {k: made.pop(k) for k in ("training_cases", "monitoring_cases")}
        return json.dumps(made, sort_keys=True, separators=(",", ":"), allow_nan=False)


def lateness_seconds(hours: object) -> int:
    """The lateness allowance in whole seconds."""
    bounds = next(f.metadata for f in fields(Policy) if f.name == "allowed_lateness_hours")
    check("allowed_lateness_hours", hours, bounds)
    return int(hours * bounds["grain"])


def parse_policy(made: object) -> Policy:
    """A policy from its JSON object, which must have exactly the declared keys."""
    names = {f.name for f in fields(Policy)} - {"training_cases", "monitoring_cases"} | {"generation"}
    if not isinstance(made, dict) or set(made) != names:
        raise ReplayError("the policy's keys are not the declared ones")
    generation = made["generation"]
    if not isinstance(generation, dict) or set(generation) != {"training_cases", "monitoring_cases"}:
        raise ReplayError("the policy's generation keys are not the declared ones")
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in made.items() if k != "generation"}
    return Policy(**values, **generation)


def load_policy(path: str | Path | None = None) -> Policy:
    return Policy() if path is None else parse_policy(json.loads(Path(path).read_text()))
