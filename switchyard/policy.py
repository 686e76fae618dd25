"""Routing policy: every constant an operator needs, in one object.

Operators never embed policy literals; they take a ``Policy`` and turn its
small maps into map literals (``F.create_map``), which stay inside
whole-stage codegen and need no join at all.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_literal(mapping: dict) -> Column:
    """A constant map column; lookups on it return null for absent keys."""
    if not mapping:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


@dataclass(frozen=True)
class Policy:
    category_owner: dict            # intake category -> owning specialist team
    channel_frontline: dict         # channel -> frontline team
    sla_minutes: dict               # channel -> first-response target (minutes)
    legacy_source: str              # source_system value of the legacy helpdesk
    current_source: str             # source_system value of the current helpdesk
    legacy_shift_minutes: int       # clock repair added to legacy resolved times
    window_start: dt.datetime       # reporting window, half open [start, end)
    window_end: dt.datetime
    focus_first_team: str           # queue-leakage focus pair
    focus_resolving_team: str
    closed_statuses: tuple = ("resolved", "closed")
    transfer_cost: float = 305.0
    sla_breach_credit: float = 350.0
    weekly_volume: int = 650
    headcount_cost: float = 900_000.0
    relative_saving: float = 0.20
    auto_route_confidence: float = 0.70
    target_handoff_rate: float = 0.134
    review_label: str = "Human review"
    tier_two: int = 2
    channels: tuple = ()            # channels a ticket may arrive on (empty: those with a target)
    extra: dict = field(default_factory=dict)

    @property
    def known_channels(self) -> list:
        return sorted(self.channels or self.sla_minutes)

    @property
    def owner_category(self) -> dict:
        """Inverse of ``category_owner``: specialist team -> category it owns."""
        return {team: cat for cat, team in self.category_owner.items()}

    def with_(self, **kw) -> "Policy":
        return replace(self, **kw)

    # Column helpers -------------------------------------------------------
    def sla_target(self, channel: Column) -> Column:
        return F.try_element_at(map_literal({k: int(v) for k, v in self.sla_minutes.items()}), channel)

    def owner_of(self, category: Column) -> Column:
        return F.try_element_at(map_literal(self.category_owner), category)

    def category_owned_by(self, team: Column) -> Column:
        return F.try_element_at(map_literal(self.owner_category), team)

    def frontline_of(self, channel: Column) -> Column:
        return F.try_element_at(map_literal(self.channel_frontline), channel)

    # Presets ----------------------------------------------------------------
    @classmethod
    def reference(cls) -> "Policy":
        # The published routing policy of the original ticket
        # analysis (team ownership, frontline mapping, SLA minutes, costs).
        return cls(
            category_owner={
                "Billing & Payments": "Billing",
                "Delivery & Shipping": "Logistics",
                "Returns & Refunds": "Returns Desk",
                "Warranty & Repair": "Escalations & Warranty",
            },
            channel_frontline={
                "chat": "Chat Frontline",
                "social": "Chat Frontline",
                "email": "Email Frontline",
                "voice": "Voice Frontline",
            },
            sla_minutes={"chat": 15, "voice": 120, "social": 240, "email": 480},
            legacy_source="legacy_fd",
            current_source="helpdesk",
            legacy_shift_minutes=5 * 60 + 30,
            window_start=dt.datetime(2025, 1, 1),
            window_end=dt.datetime(2026, 7, 1),
            focus_first_team="Billing",
            focus_resolving_team="Logistics",
        )

    @classmethod
    def fixture(cls) -> "Policy":
        # The policy used over the driver's TPC-H-shaped tables.
        # 3-MEDIUM is deliberately absent from both channel maps and
        # AUTOMOBILE deliberately has no owner.
        return cls(
            category_owner={
                "BUILDING": "ASIA",
                "MACHINERY": "EUROPE",
                "HOUSEHOLD": "AFRICA",
                "FURNITURE": "AMERICA",
            },
            channel_frontline={
                "1-URGENT": "Frontline A",
                "2-HIGH": "Frontline A",
                "5-LOW": "Frontline B",
                "4-NOT SPECIFIED": "Frontline C",
            },
            sla_minutes={
                "1-URGENT": 43_200,
                "2-HIGH": 86_400,
                "4-NOT SPECIFIED": 259_200,
                "5-LOW": 525_600,
            },
            legacy_source="legacy",
            current_source="helpdesk",
            legacy_shift_minutes=5 * 60 + 30,
            window_start=dt.datetime(1996, 1, 1),
            window_end=dt.datetime(2000, 7, 1),
            focus_first_team="AFRICA",
            focus_resolving_team="AMERICA",
            channels=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
        )


# The eleven intake categories of the original ticket export.
REFERENCE_CATEGORIES = (
    "Account & Login", "App & Firmware", "Audio Quality", "Billing & Payments",
    "Charging & Battery", "Connectivity", "Delivery & Shipping", "Other",
    "Product Enquiry", "Returns & Refunds", "Warranty & Repair",
)

# Repeated-holdout seeds, holdout share and split seed.
REPEATED_SEEDS = (7, 19, 42, 73, 101)
HOLDOUT_FRACTION = 0.20
SPLIT_SEED = 42
