"""What is remembered between scans of a target: when it was last scanned, and how often in a row without a baseline."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

DEFAULT_PATH = os.path.join(os.path.expanduser("~"), ".sparkward", "state.json")


def _load(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        return told if isinstance(told, dict) else {}
    except (OSError, ValueError):
        return {}


def read_state(target: str, path: str = DEFAULT_PATH) -> dict | None:
    """None if there is no sound state of this target."""
    s = _load(path).get(os.path.abspath(target))
    return s if isinstance(s, dict) and s.get("lastRunAt") and isinstance(s.get("withoutBaselineRuns"), int) else None


def write_state(target: str, with_baseline: bool, path: str = DEFAULT_PATH) -> None:
    """A state that can't be written is no error."""
    before = read_state(target, path)
    told = _load(path)
    told[os.path.abspath(target)] = {"lastRunAt": datetime.now(timezone.utc).isoformat(), "withoutBaselineRuns": 0 if with_baseline else (before or {}).get("withoutBaselineRuns", 0) + 1}
    try:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(told, f, indent=2)
    except OSError:
        pass
