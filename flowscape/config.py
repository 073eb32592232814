"""The configuration of a run: frozen, with unknown keys rejected."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Flow:
    protocols: tuple[str, ...] = ("tcp", "udp")
    inactivity_timeout_seconds: float | None = None


@dataclass(frozen=True)
class Scan:
    window_seconds: float = 60.0
    step_seconds: float = 10.0
    strict: bool = True
    min_syn_to_rst: int = 3
    min_targets: int = 2
    broad: bool = True


@dataclass(frozen=True)
class Prefix:
    min_length: int = 24
    percent: int = 1


@dataclass(frozen=True)
class Config:
    flow: Flow = field(default_factory=Flow)
    scan: Scan = field(default_factory=Scan)
    prefix: Prefix = field(default_factory=Prefix)

    def as_dict(self) -> dict:
        return asdict(self)


def _made(kind, values, where: str):
    if not isinstance(values, dict):
        raise ConfigError(f"{where}: not a mapping")
    if unknown := set(values) - {f.name for f in fields(kind)}:
        raise ConfigError(f"{where}: unknown keys {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def parse(values: dict) -> Config:
    """A configuration from nested values; ranges and combinations are checked."""
    if not isinstance(values, dict) or (unknown := set(values) - {"flow", "scan", "prefix"}):
        raise ConfigError(f"unknown sections {sorted(unknown) if isinstance(values, dict) else values}")
    c = Config(_made(Flow, values.get("flow", {}), "flow"), _made(Scan, values.get("scan", {}), "scan"), _made(Prefix, values.get("prefix", {}), "prefix"))
    if not c.flow.protocols or set(c.flow.protocols) - {"tcp", "udp"}:
        raise ConfigError("flow: protocols are tcp and udp, one at least")
    if c.flow.inactivity_timeout_seconds is not None and c.flow.inactivity_timeout_seconds <= 0:
        raise ConfigError("flow: the timeout must be over 0")
    if not 0 < c.scan.step_seconds <= c.scan.window_seconds:
        raise ConfigError("scan: 0 < step <= window")
    if c.scan.strict and (c.scan.min_syn_to_rst < 1 or c.scan.min_targets < 1):
        raise ConfigError("scan: strict needs its thresholds")
    if c.scan.broad and not c.scan.strict:
        raise ConfigError("scan: broad labels build on strict ones")
    if c.prefix.min_length != 24 or not 1 <= c.prefix.percent <= 100:
        raise ConfigError("prefix: min_length is 24 and percent 1 to 100")
    return c


def load(text: str) -> Config:
    """A configuration from JSON, or from YAML where a reader for it is installed."""
    try:
        return parse(json.loads(text))
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("not JSON, and no YAML reader is installed") from e
        return parse(yaml.safe_load(text))
