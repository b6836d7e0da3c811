"""Settings: model names, paths and stage folders from an INI file, environment variables first."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    model: dict[str, str] = field(default_factory=dict)
    path: dict[str, str] = field(default_factory=dict)
    dir: dict[str, str] = field(default_factory=dict)

    def stage(self, name: str) -> str:
        return self.dir[name]


def load_settings(file: str | None = None, prefix: str = "CALEMBOUR_") -> Settings:
    """``[model]``, ``[path]`` and ``[dir]`` of ``file``; a variable CALEMBOUR_PATH_X overrides ``x`` of ``[path]``. A missing file gives empty sections."""
    read = configparser.ConfigParser()
    if file:
        read.read(file)
    parts: dict[str, dict[str, str]] = {s: dict(read[s]) if read.has_section(s) else {} for s in ("model", "path", "dir")}
    for k, v in os.environ.items():
        section, _, name = k.removeprefix(prefix).lower().partition("_")
        if k.startswith(prefix) and section in parts and name:
            parts[section][name] = v
    return Settings(**parts)
