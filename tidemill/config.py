"""Parameters of the queries, with their defaults, as one frozen object that a file may override."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Bounds, windows and shares; ``read`` overrides them by name from a JSON or YAML file."""

    first_year: int = 2020
    most_amount: float = 10_000_000
    duplicate_minutes: float = 10
    near_limit: tuple[float, float] = (0.8, 1.0)
    near_limit_least_24h: int = 3
    burst_1h: int = 80
    new_beneficiary_ratio: float = 1.0
    night: tuple[int, int] = (0, 7)
    night_zscore: float = 3.0
    relay_ratio: tuple[float, float] = (0.9, 1.1)
    relay_minutes: float = 30
    least_rules: int = 2
    levels: tuple[float, ...] = (0.5, 0.8, 0.95, 1.0)
    days_per_month: float = 30
    recent_days: int = 30
    pass_ratio: tuple[float, float] = (0.7, 1.3)
    pass_minutes: float = 30
    circuit_days: int = 7
    circuit_most_per_pair: int = 50
    top_degrees: int = 200
    folds: int = 3
    embargo_days: float = 7
    holdout_share: float = 0.05
    seed: int = 42
    conduct_weight: float = 300
    evasion_weight: float = 250
    network_weight: float = 200
    alerts_weight: float = 150
    newness_weight: float = 100

    @classmethod
    def read(cls, path: str) -> Settings:
        """The defaults with what the file names; a name that is none of the settings is an error."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            said = yaml.safe_load(text) or {}
        else:
            said = json.loads(text)
        unknown = set(said) - {x.name for x in fields(cls)}
        if unknown:
            raise ValueError(f"no such settings: {sorted(unknown)}")
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in said.items()})

    def composites(self) -> dict[str, tuple[str, dict[str, float]]]:
        """Which scaled metrics of a customer make which component of its score."""
        return {
            "conduct": ("greatest", {"rank_z": 1, "x_r4_share": 1, "x_r6_share": 1}),
            "evasion": ("greatest", {"x_near_share": 1, "x_r3_share": 1, "x_r1_share": 1, "x_r2_share": 1, "x_partner_share": 1}),
            "network": ("greatest", {"x_n_targets": 1, "x_r7_share": 1, "y_n_senders": 1}),
            "alerts": ("mean", {"x_n_alerts": 1, "x_n_recent": 1.5, "x_worst_rank": 1}),
            "newness": ("greatest", {"rank_new": 1}),
        }

    def rules(self) -> dict[str, str]:
        """The rules over the features of a transaction, as predicates."""
        begin, end = self.night
        hour = f"hour(transaction_date) >= {begin} and hour(transaction_date) < {end}" if begin <= end else f"(hour(transaction_date) >= {begin} or hour(transaction_date) < {end})"
        return {
            "r1": "ratio > 1",
            "r2": "day_ratio > 1",
            "r3": f"ratio between {self.near_limit[0]} and {self.near_limit[1]} and n_24h >= {self.near_limit_least_24h}",
            "r4": f"n_1h > {self.burst_1h}",
            "r5": f"is_new and max_ratio > {self.new_beneficiary_ratio}",
            "r6": f"{hour} and abs(zscore) > {self.night_zscore}",
            "r7": f"received_to_sent between {self.relay_ratio[0]} and {self.relay_ratio[1]} and minutes_since_received between 0 and {self.relay_minutes}",
        }


DEFAULTS = Settings()
