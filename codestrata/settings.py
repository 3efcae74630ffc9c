"""Settings out of the environment and a file of NAME=value lines; the environment counts before the file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "CODESTRATA_"


@dataclass(frozen=True)
class Settings:
    """Defaults of the command line."""

    store: str | None = None
    main_branch: str | None = None
    base_branch: str | None = None
    batch_size: int = 0


def read(path: str | None = ".env", environment: dict[str, str] | None = None) -> Settings:
    """Settings from CODESTRATA_STORE and so on. Lines of other names and comments don't count; a number that is none is told."""
    given: dict[str, str] = {}
    if path and os.path.isfile(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, sign, value = line.strip().partition("=")
                if sign and not name.startswith("#"):
                    given[name.strip().removeprefix("export ").strip()] = value.strip().strip("'\"")
    given |= os.environ if environment is None else environment
    found = {f.name: given[PREFIX + f.name.upper()] for f in fields(Settings) if given.get(PREFIX + f.name.upper())}
    if "batch_size" in found:
        if not found["batch_size"].isdigit():
            raise ValueError(f"{PREFIX}BATCH_SIZE must be a number, not {found['batch_size']!r}")
        found["batch_size"] = int(found["batch_size"])
    return Settings(**found)
