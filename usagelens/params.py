"""Query parameters and the table bundle passed to every analytic."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Filters:
    """Request filters. ``users``/``teams`` None = no audience filter; an
    empty resolved audience means "nobody". ``to`` is inclusive."""

    from_: dt.datetime | str | None = None
    to: dt.datetime | str | None = None
    users: tuple[str, ...] | None = None
    teams: tuple[int, ...] | None = None
    source: str | None = None
    masked: bool = False


@dataclass(frozen=True)
class PlanConfig:
    """The one-row plan configuration, with the write-path clamps applied."""

    billing_cycle_day: int = 1
    standard_seat_cost_usd: float = 20.0
    premium_seat_cost_usd: float = 100.0
    standard_seat_included_usd: float | None = None
    standard_seat_overage_pct: float = 0.0
    premium_seat_included_usd: float | None = None
    premium_seat_overage_pct: float = 0.0
    commitment_amount_usd: float | None = None
    commitment_start_date: str | None = None
    commitment_end_date: str | None = None
    commitment_discount_pct: float = 0.0

    def __post_init__(self):
        object.__setattr__(self, "billing_cycle_day", min(28, max(1, int(self.billing_cycle_day))))
        for f in ("commitment_discount_pct", "standard_seat_overage_pct", "premium_seat_overage_pct"):
            object.__setattr__(self, f, min(100.0, max(0.0, float(getattr(self, f) or 0))))

    @property
    def discount_factor(self) -> float:
        return 1 - self.commitment_discount_pct / 100


@dataclass
class Tables:
    """Fact and dimension DataFrames. Dimensions may be None (= empty)."""

    api_requests: DataFrame
    tool_uses: DataFrame
    user_prompts: DataFrame
    api_errors: DataFrame
    tool_decisions: DataFrame
    org_members: DataFrame | None = None
    user_aliases: DataFrame | None = None
    teams: DataFrame | None = None
    team_members: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "Tables":
        return replace(self, **kw)
