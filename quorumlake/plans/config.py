"""Static configuration: normalisation divisors and merchant category risk."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

# Fixed values of the published configuration.
NORMALIZATION = {
    "max_amount": 10000.0,
    "max_installments": 12.0,
    "amount_vs_avg_ratio": 10.0,
    "max_minutes": 1440.0,
    "max_km": 1000.0,
    "max_tx_count_24h": 20.0,
    "max_merchant_avg_amount": 10000.0,
}
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
DEFAULT_RISK = 0.5


@dataclass(frozen=True)
class Normalization:
    """The seven divisors; all must be positive and finite."""

    max_amount: float = NORMALIZATION["max_amount"]
    max_installments: float = NORMALIZATION["max_installments"]
    amount_vs_avg_ratio: float = NORMALIZATION["amount_vs_avg_ratio"]
    max_minutes: float = NORMALIZATION["max_minutes"]
    max_km: float = NORMALIZATION["max_km"]
    max_tx_count_24h: float = NORMALIZATION["max_tx_count_24h"]
    max_merchant_avg_amount: float = NORMALIZATION["max_merchant_avg_amount"]

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v <= 0:
                raise ValueError(f"normalization {f.name} must be greater than zero")


@dataclass(frozen=True)
class Config:
    """Everything the vectorizer needs besides the request."""

    normalization: Normalization = field(default_factory=Normalization)
    mcc_risk: Mapping[str, float] = field(default_factory=lambda: dict(MCC_RISK))
    default_risk: float = DEFAULT_RISK

    def __post_init__(self) -> None:
        if not isinstance(self.mcc_risk, Mapping):
            raise ValueError("mcc risk must be an object")
        for mcc, risk in self.mcc_risk.items():
            if isinstance(risk, bool) or not isinstance(risk, (int, float)) or not 0 <= risk <= 1:
                raise ValueError(f"mcc risk of {mcc} must be between 0 and 1")


def read_json(path: str) -> object:
    """One JSON value; anything after it is an error."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_config(mcc_path: str, normalization_path: str) -> Config:
    """Both files are below a few KB and are read on the driver."""
    given = read_json(normalization_path)
    if not isinstance(given, dict):
        raise ValueError("normalization must be an object")
    for f in fields(Normalization):
        if f.name not in given:
            raise ValueError(f"normalization {f.name} is missing")
    return Config(Normalization(**{f.name: given[f.name] for f in fields(Normalization)}), read_json(mcc_path))


def setting(name: str, fallback: str) -> str:
    """An environment setting; empty counts as unset."""
    return os.environ.get(name) or fallback
