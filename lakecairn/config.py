"""Where a repository lies: given, or found by looking upwards from the working folder."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path

from lakecairn.errors import NotFound

FOLDER, WORKSPACE = ".lakecairn", "default"


@dataclass(frozen=True)
class Config:
    """Settings that may be left open; what is set in ``over`` wins in ``merge``."""

    base: Path | None = None
    folder: str | None = None
    workspace: str | None = None

    def merge(self, over: Config) -> Config:
        return replace(self, **{k: v for k, v in vars(over).items() if v is not None})

    @property
    def name(self) -> str:
        return self.workspace or WORKSPACE

    def locate(self, start: Path | str = ".") -> Path:
        """The repository's folder."""
        folder = self.folder or FOLDER
        if self.base is not None:
            return Path(self.base) / folder
        for at in (here := Path(start).resolve(), *here.parents):
            if (at / folder).is_dir():
                return at / folder
        raise NotFound(folder, str(start))
