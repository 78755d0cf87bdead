"""Settings: defaults, what overrides them, and checks before anything runs."""

from __future__ import annotations

import copy


class ConfigError(ValueError):
    """Settings that cannot be used."""


def merged(defaults: dict, given: dict, where: str = "") -> dict:
    """defaults with the values of given, section by section; keys that the defaults lack are an error."""
    out = copy.deepcopy(defaults)
    for k, v in given.items():
        name = f"{where}.{k}" if where else k
        if k not in defaults:
            raise ConfigError(f"unknown setting {name}")
        if isinstance(defaults[k], dict):
            if not isinstance(v, dict):
                raise ConfigError(f"{name} is a section")
            out[k] = merged(defaults[k], v, name)
        else:
            out[k] = copy.deepcopy(v)
    return out


def checked(settings: dict, rules: dict) -> dict:
    """settings, if each rule holds: {"section.key": (type, least, most)}; None bounds nothing."""
    for name, (kind, least, most) in rules.items():
        value = settings
        for part in name.split("."):
            if not isinstance(value, dict) or part not in value:
                raise ConfigError(f"missing setting {name}")
            value = value[part]
        if isinstance(value, bool) != (kind is bool) or not isinstance(value, (int, float) if kind is float else kind):
            raise ConfigError(f"{name} is not a {kind.__name__}")
        if (least is not None and value < least) or (most is not None and value > most):
            raise ConfigError(f"{name} = {value} is not within {least} and {most}")
    return settings
