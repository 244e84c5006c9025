"""Settings of the command line, read from YAML; unknown keys are errors."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml

from .sources.generator import LedgerConfig


@dataclass(frozen=True)
class LandingConfig:
    n_folds: int = 3
    val_months: int = 3
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)
    grid_end: str = "data"

    def __post_init__(self) -> None:
        if self.n_folds < 1 or self.val_months < 1:
            raise ValueError("n_folds and val_months are at least 1")
        if 0.5 not in self.quantiles or not all(0 < q < 1 for q in self.quantiles):
            raise ValueError("quantiles lie between 0 and 1 and hold 0.5")
        if self.grid_end not in ("data", "month_end"):
            raise ValueError("grid_end is data or month_end")


@dataclass(frozen=True)
class Paths:
    """Where commands read and write if they are not told."""

    raw_dir: str = "data/raw"
    processed_dir: str = "data/processed"
    model_dir: str = "models"
    reports_dir: str = "reports"


@dataclass(frozen=True)
class Config:
    paths: Paths = field(default_factory=Paths)
    landing: LandingConfig = field(default_factory=LandingConfig)
    ledger: LedgerConfig = field(default_factory=LedgerConfig)
    seed: int = 42


def _known(kind: type, data: dict, where: str) -> dict:
    extra = set(data) - {f.name for f in fields(kind)}
    if extra:
        raise ValueError(f"unknown keys in {where}: {', '.join(sorted(extra))}")
    return data


#: Read if no file is named and this one exists.
DEFAULT_FILE = "conf/config.yaml"


def load_config(path: str | None = None) -> Config:
    if path is None and not Path(DEFAULT_FILE).exists():
        return Config()
    file = Path(path or DEFAULT_FILE)
    if not file.exists():
        raise FileNotFoundError(file)
    data = _known(Config, yaml.safe_load(file.read_text()) or {}, "the configuration")
    made = LedgerConfig(**_known(LedgerConfig, data.get("ledger") or {}, "ledger"))
    section = dict(_known(LandingConfig, data.get("landing") or {}, "landing"))
    if "quantiles" in section:
        section["quantiles"] = tuple(section["quantiles"])
    paths = Paths(**{k: str(v) for k, v in _known(Paths, data.get("paths") or {}, "paths").items()})
    return Config(paths, LandingConfig(**section), made, int(data.get("seed", 42)))
