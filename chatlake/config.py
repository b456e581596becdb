"""Read an existing YAML configuration (sources, prices, teams) into arguments.

Keys used: ``sources.claude_code.path``, ``sources.cowork.path`` (``auto``
means: not given), ``pricing`` (a ``default`` row is skipped, quirk Q5) and
``analysis.teams`` for the team consolidation (S12). Database settings
(``backend``, ``db_path``) have no meaning here: tables live under a root.
"""

from __future__ import annotations

import os

from .functions.pricing import merge_prices


def load_config(path: str) -> dict:
    try:
        import yaml
    except ImportError as exc:  # optional dependency
        raise RuntimeError("reading a YAML config needs PyYAML") from exc
    with open(path, encoding="utf-8") as f:
        cfg = yaml.safe_load(f) or {}
    sources = cfg.get("sources") or {}

    def src_path(key):
        p = (sources.get(key) or {}).get("path")
        return None if p in (None, "", "auto") else os.path.expanduser(str(p))

    return {
        "claude_dir": src_path("claude_code"),
        "cowork_dir": src_path("cowork"),
        "prices": merge_prices(cfg.get("pricing") or {}),
        "teams": (cfg.get("analysis") or {}).get("teams") or {},
    }
