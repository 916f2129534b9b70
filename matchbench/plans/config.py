"""Experiment files: loading, merging over defaults, resolving."""

from __future__ import annotations

import json
from pathlib import Path

from .experiments import EXPERIMENTS, MATCHER_PARAMETERS, PARAMETERS, Arm, Experiment, arguments

#: Defaults that files are merged over.
PREPROCESS_2D = {"detector": {"method": "landmarks"}, "align": {"size_112": 112, "size_64": 64}, "illum": {"method": "none", "params": {}}}
PREPROCESS_3D = {"range": {"size": 64, "fill": "nearest", "z_norm": "std"}}
#: What differs by dataset: photos that are cropped already need no detection.
DATASETS = {"toy": {}, "yaleb": {"preprocess_2d": {"detector": {"method": "whole"}, "illum": {"method": "clahe", "params": {"clip_limit": 2.0, "grid": 8}}}}, "tufts3d": {}}
_KNOWN = {"id", "name", "dataset", "protocols", "seeds", "arms", "preprocess", "evaluate", "robustness", "report"}
_REQUIRED = ("id", "dataset", "protocols", "seeds", "arms")


def load(path: str | Path) -> dict:
    """A mapping from a YAML or JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix == ".json":
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold a mapping")
    return found


def merged(base: dict, over: dict) -> dict:
    """``over`` wins; mappings under one key are merged likewise."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def settings(dataset: str, over: dict | None = None) -> dict:
    """Preprocessing settings of a dataset: ``2d`` and ``3d``."""
    if dataset not in DATASETS:
        raise KeyError(f"unknown dataset {dataset!r}; known: {', '.join(sorted(DATASETS))}")
    base = merged({"preprocess_2d": PREPROCESS_2D, "preprocess_3d": PREPROCESS_3D}, DATASETS[dataset])
    return merged({"2d": base["preprocess_2d"], "3d": base["preprocess_3d"]}, over or {})


def named(kind: str, name: str, root: str | Path | None) -> dict:
    """The mapping of ``<root>/<kind>/<name>.yaml`` (or .json)."""
    for suffix in (".yaml", ".json"):
        if root and (path := Path(root) / kind / f"{name}{suffix}").is_file():
            return load(path)
    raise FileNotFoundError(f"there is no {kind} file {name!r} below {root}")


def preprocessing(raw: dict, root: str | Path | None) -> dict:
    """Settings of an experiment: under ``preprocess`` a side is a mapping, or the name of a file in ``preprocess``; else the
    dataset's file (``datasets``) names it, if there is one. All are merged over ``base`` (its ``preprocess``) and the built-in ones."""
    if unknown := sorted(set(raw.get("preprocess", {})) - {"2d", "3d"}):
        raise ValueError(f"the experiment's preprocess has unknown keys {unknown}")
    there = lambda kind, name: root and any((Path(root) / kind / f"{name}{x}").is_file() for x in (".yaml", ".json"))
    base = named(".", "base", root) if there(".", "base") else {}
    dataset = named("datasets", raw["dataset"], root) if there("datasets", raw["dataset"]) else {}
    over = {}
    for side, known in (("2d", PREPROCESS_2D), ("3d", PREPROCESS_3D)):
        common = {k: v for k, v in base.get("preprocess", {}).items() if k in known}
        chosen = raw.get("preprocess", {}).get(side, dataset.get(f"preprocess_{side}", {}))
        over[side] = merged(common, chosen if isinstance(chosen, dict) else named("preprocess", chosen, root))
    return settings(raw["dataset"], over)


def _arm(raw: dict) -> Arm:
    if missing := [k for k in ("key", "feature", "matcher") if k not in raw]:
        raise ValueError(f"an arm lacks {missing}")
    if unknown := sorted(set(raw) - {"key", "feature", "matcher", "feature_params", "matcher_params"}):
        raise ValueError(f"the arm {raw['key']} has unknown keys {unknown}")
    arm = Arm(raw["key"], raw["feature"], raw["matcher"], raw.get("feature_params") or {}, raw.get("matcher_params") or {})
    arguments(PARAMETERS, arm.feature, arm.feature_params)
    arguments(MATCHER_PARAMETERS, arm.matcher, arm.matcher_params)
    return arm


def resolve(raw: dict, root: str | Path | None = None) -> Experiment:
    """An experiment from its file's mapping; missing and unknown keys, unknown parameters and absent named files are errors.
    Without a ``root``, sides must be mappings."""
    if missing := [k for k in _REQUIRED if k not in raw]:
        raise ValueError(f"the experiment lacks {missing}")
    if unknown := sorted(set(raw) - _KNOWN):
        raise ValueError(f"the experiment has unknown keys {unknown}")
    evaluate, robust = raw.get("evaluate", {}), raw.get("robustness", {})
    return Experiment(
        raw["id"], raw["dataset"], tuple(raw["protocols"]), tuple(raw["seeds"]), tuple(map(_arm, raw["arms"])),
        tuple((c["name"], c["kind"], float(c.get("fraction", 0.2))) for c in robust.get("conditions", ())), evaluate.get("verification", True),
        {"name": raw.get("name", raw["id"]), "identification": evaluate.get("identification", True), "timing": evaluate.get("timing", False), "robustness": robust.get("type", "unknown"),
         "preprocess": preprocessing(raw, root), "tables": raw.get("report", {}).get("tables", []), "figures": raw.get("report", {}).get("figures", [])},
    )


def experiment(name: str, root: str | None = None) -> Experiment:
    """The experiment of a file ``<root>/experiments/<name>.yaml`` (or .json), else the built-in one."""
    for suffix in (".yaml", ".json"):
        if root and (path := Path(root) / "experiments" / f"{name}{suffix}").is_file():
            return resolve(load(path), root)
    if name not in EXPERIMENTS:
        raise KeyError(f"unknown experiment {name!r}; known: {', '.join(sorted(EXPERIMENTS))}")
    return EXPERIMENTS[name]
