"""Settings with their origins: defaults, the nearest settings file, the environment, then what a caller gives; unknown names are refused."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from difflib import get_close_matches
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from mosaica import dims
from mosaica.errors import ContractError
from mosaica.operators import convert, corpus

FILE, TABLE, PREFIX = "mosaica.toml", "mosaica", "MOSAICA_"

#: name: (type, default, choices)
OPTIONS: dict[str, tuple[type, object, tuple[str, ...]]] = {
    "source": (str, "obsidian", ("fetched", "filesystem", "notion", "obsidian")),
    "into": (str, "synced", ()),
    "screener": (str, "signatures", ("signatures", "signatures+entropy")),
    "rules": (str, "core", tuple(dims.PACKS)),
    "converters": (dict, {}, ()),
    "allow": (list, [], ()),
    "pdf-word-gap": (float, -180.0, ()),
    "pdf-reading-order": (str, "stream", ("stream", "columns", "rows")),
    "encoding": (str, "strict", ("strict", "detect")),
}


@dataclass(frozen=True)
class Setting:
    """A value and what decided it."""

    value: object
    origin: str


def _sound(name: str, value: object, origin: str) -> object:
    kind, _, choices = OPTIONS[name]
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    parts = value if isinstance(value, list) else [x for kv in value.items() for x in kv] if isinstance(value, dict) else []
    if not isinstance(value, kind) or isinstance(value, bool) or not all(isinstance(x, str) for x in parts):
        raise ContractError(f"{origin}: {name} is a {kind.__name__}, not {value!r}")
    if choices and value not in choices:
        raise ContractError(f"{origin}: {name} is one of {', '.join(choices)}, not {value!r}")
    return value


def _named(name: str, origin: str) -> str:
    if name not in OPTIONS:
        near = get_close_matches(name, OPTIONS, 1)
        raise ContractError(f"{origin}: no setting is called {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    return name


def _from_file(path: Path) -> dict | None:
    """A settings file's table; None for a pyproject.toml that says nothing of the engine."""
    try:
        body = tomllib.loads(path.read_text())
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ContractError(f"{path}: {e}") from e
    return body.get("tool", {}).get(TABLE) if path.name == "pyproject.toml" else body


def load(start: str | None = None, environ: dict[str, str] | None = None, **given: object) -> dict[str, Setting]:
    """All settings of a run that starts in a folder; of the files at or above it, the nearest counts whole."""
    found = {k: Setting(default, "default") for k, (_, default, _) in OPTIONS.items()}
    here = Path(start or ".").resolve()
    for path in (p / name for p in (here, *here.parents) for name in (FILE, "pyproject.toml")):
        table = _from_file(path) if path.is_file() else None
        if table is not None:
            found |= {_named(k, str(path)): Setting(_sound(k, v, str(path)), path.name) for k, v in table.items()}
            break
    for name, (kind, _, _) in OPTIONS.items():
        variable = PREFIX + name.upper().replace("-", "_")
        raw = (os.environ if environ is None else environ).get(variable)
        if raw is None:
            continue
        if kind is dict:
            raise ContractError(f"{variable}: a table can't be set from the environment")
        try:
            value = [x.strip() for x in raw.split(",") if x.strip()] if kind is list else kind(raw)
        except ValueError as e:
            raise ContractError(f"{variable}: {raw!r} is no number") from e
        found[name] = Setting(_sound(name, value, variable), variable)
    for name, value in given.items():
        name = _named(name.replace("_", "-"), "argument")
        if value is not None:
            found[name] = Setting(_sound(name, value, "argument"), "argument")
    return found


def table(spark: SparkSession, settings: dict[str, Setting]) -> DataFrame:
    """name, value, origin: one row a setting."""
    return spark.createDataFrame([(k, str(s.value), s.origin) for k, s in settings.items()], "name string, value string, origin string")


def of_run(settings: dict[str, Setting]) -> corpus.Settings:
    """What a run needs of them."""
    v = {k: s.value for k, s in settings.items()}
    registry = convert.standard(v["encoding"], v["pdf-reading-order"], v["pdf-word-gap"]).chosen(v["converters"])
    return corpus.Settings(dims.PACKS[v["rules"]], tuple(v["screener"].split("+")), registry, tuple(v["allow"]))
