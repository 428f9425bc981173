"""A tree's own settings: `.quarrystone.json` in its folder, JSON with comments.

Keys, all optional: ``ignore`` (names of further folders to pass over), ``max_file_bytes``, ``rules`` (limits
of the general rules), ``smells`` (limits of the smells), ``arch`` (glob rules), ``aliases`` (prefix to
replacement) and ``gate`` (thresholds).  Arguments of a call go before the file, the file before the defaults.
An unknown key or a value of the wrong kind is an error, so that a misspelling isn't passed over.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from quarrystone.sources.languages import MAX_BYTES
from quarrystone.sources.manifests import read_jsonc

NAME = ".quarrystone.json"


@dataclass(frozen=True)
class Config:
    ignore: list = field(default_factory=list)
    max_file_bytes: int = MAX_BYTES
    rules: dict = field(default_factory=dict)
    smells: dict = field(default_factory=dict)
    arch: list = field(default_factory=list)
    aliases: dict = field(default_factory=dict)
    gate: dict = field(default_factory=dict)


def read_config(folder: str | None) -> Config:
    """The settings of a folder on a mounted disk; the defaults if it has no file, or there is no folder."""
    if folder is None or "://" in folder or not (path := Path(folder) / NAME).is_file():
        return Config()
    data = read_jsonc(path.read_text(encoding="utf-8"))
    default, known = Config(), {f.name for f in fields(Config)}
    for key, value in data.items():
        if key not in known:
            raise ValueError(f"{path}: unknown key {key}")
        if not isinstance(value, type(getattr(default, key))) or isinstance(value, bool):
            raise ValueError(f"{path}: {key} should be a {type(getattr(default, key)).__name__}")
    return Config(**data)
