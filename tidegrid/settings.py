"""Settings of a run: defaults, a file's values on top, and checks of the whole."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from pathlib import Path

from tidegrid.functions.scalar import PATCH

# The defaults.
DEFAULTS: dict[str, dict] = {
    "run": {"seed": 0, "steps": 100, "out": ""},
    "model": {"patches": list(PATCH), "tier_prior": [2, 2, 2, 2, 2, 1], "out_patch": 16},
    "data": {"loader": "corpus", "series": 4096, "channels": [1, 21], "length": [64, 100_000], "gap_share": 0.3, "mixture": {"shared_factor": 0.5, "univariate": 0.4, "lag_probe": 0.1}, "terms": ["short", "medium", "long"], "horizon": 32, "root": ""},
    "packing": {"length": 1024, "query_tokens": 256, "per_step": 8, "reservoir": 1000, "window": 128, "tolerance": 0.05},
    "loss": {"aux_weights": [0.2, 0.2, 0.2, 0.2, 0.1, 0.1]},
    "eval": {"loader": "windows", "windows": 100, "items_per_config": 10},
    "tracking": {"sink": "none", "mode": "auto"},
}
Rule = tuple[str, Callable[[dict], bool]]
RULES: list[Rule] = [
    ("model.patches are fixed", lambda s: s["model"]["patches"] == list(PATCH)),
    ("model.tier_prior has a positive number for each patch", lambda s: len(s["model"]["tier_prior"]) == len(PATCH) and all(w > 0 for w in s["model"]["tier_prior"])),
    ("model.out_patch is one of the patches", lambda s: s["model"]["out_patch"] in PATCH),
    ("loss.aux_weights has a number for each patch", lambda s: len(s["loss"]["aux_weights"]) == len(PATCH)),
    ("packing.query_tokens, reservoir, window and per_step are 1 or more", lambda s: min(s["packing"][k] for k in ("query_tokens", "reservoir", "window", "per_step")) >= 1),
    ("packing.tolerance lies in [0, 1)", lambda s: 0 <= s["packing"]["tolerance"] < 1),
    ("data.terms are some of short, medium and long", lambda s: bool(s["data"]["terms"]) and set(s["data"]["terms"]) <= {"short", "medium", "long"}),
    ("data.mixture has a positive total", lambda s: sum(s["data"]["mixture"].values()) > 0),
    ("eval.items_per_config is -1 (all) or 1 or more", lambda s: s["eval"]["items_per_config"] == -1 or s["eval"]["items_per_config"] >= 1),
    ("tracking.sink is none or table", lambda s: s["tracking"]["sink"] in ("none", "table")),
    ("tracking.mode is auto, online, offline or disabled", lambda s: s["tracking"]["mode"] in ("auto", "online", "offline", "disabled")),
]


def merged(base: dict, values: dict, at: str = "") -> dict:
    """values on top of base; a name that base doesn't have, or another type, is an error. Mappings of free names are replaced."""
    out = copy.deepcopy(base)
    for name, value in values.items():
        if name not in base:
            raise KeyError(f"unknown setting {at}{name}")
        if at == "" and isinstance(value, dict):
            out[name] = merged(base[name], value, f"{name}.")
        elif isinstance(base[name], float) and isinstance(value, int) and not isinstance(value, bool):
            out[name] = float(value)
        elif type(value) is not type(base[name]):
            raise TypeError(f"{at}{name} must be of type {type(base[name]).__name__}")
        else:
            out[name] = copy.deepcopy(value)
    return out


def checked(values: dict | None = None) -> dict:
    """Defaults with values on top; all rules that don't hold are named in one error."""
    out = merged(DEFAULTS, values or {})
    broken = [text for text, holds in RULES if not holds(out)]
    if broken:
        raise ValueError("; ".join(broken))
    return out


def load(path: str) -> dict:
    """Settings from a JSON or YAML file; YAML where the yaml module is there."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return checked(yaml.safe_load(text))
    return checked(json.loads(text or "{}"))


def read_environment(path: str, known: dict[str, str]) -> dict[str, str]:
    """known with the KEY=VALUE lines of a file that it lacks; a file that isn't there adds nothing."""
    out = dict(known)
    try:
        lines = Path(path).read_text().splitlines()
    except OSError:
        return out
    for line in (x.strip() for x in lines):
        key, equals, value = line.partition("=")
        if equals and key.strip() and not line.startswith("#"):
            out.setdefault(key.strip(), value.strip().strip('"').strip("'"))
    return out
