"""Settings: a file's values with ``${NAME}`` replaced from the environment, over defaults."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULTS = {"chunker": {"size": 500, "overlap": 50, "least": 100}, "tables": {"format": "markdown", "rows": "full_only"}, "images": {"attach": "separate_block", "window": 2}, "answer": {"hits": 8, "budget": 32_768}}
_VAR = re.compile(r"\$\{(\w+)\}")


def expand(value, env: dict[str, str] | None = None):
    """Strings in nested lists and dicts with their variables replaced; an unknown variable stays as it is."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return _VAR.sub(lambda m: env.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    return [expand(v, env) for v in value] if isinstance(value, list) else value


def merged(base: dict, over: dict) -> dict:
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(path: str | None, env: dict[str, str] | None = None) -> dict:
    """Defaults under the file's settings (JSON, or YAML where a parser is installed); a missing file gives the defaults."""
    if path is None or not Path(path).exists():
        return merged(DEFAULTS, {})
    text = Path(path).read_text(encoding="utf-8")
    try:
        got = json.loads(text)
    except ValueError:
        import yaml

        got = yaml.safe_load(text)
    return merged(DEFAULTS, expand(got or {}, env))


def expanded(text: Column, values: dict[str, str]) -> Column:
    """The same replacement as a column."""
    for k, v in values.items():
        text = F.replace(text, F.lit("${" + k + "}"), F.lit(v))
    return text
