"""What a curation run is asked to do; checked on the driver before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, field

FIELDS = ("record_id", "cas", "dtxsid", "npid", "smiles", "inchi", "species", "route", "endpoint", "value", "unit", "relation", "test_material", "reference", "source_url", "sex")
POLICIES = ("exact_only", "reported_numeric")


class ContractError(ValueError):
    """A contract that can't be carried out as it stands."""


@dataclass(frozen=True)
class Task:
    id: str
    species: str
    route: str
    endpoint: str


@dataclass(frozen=True)
class CurationContract:
    """Column mapping, constants, exact aliases, filters and policy of one source."""

    mapping: dict[str, str]
    tasks: tuple[Task, ...]
    relation_policy: str = "exact_only"
    constants: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    native_filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    administrative_routes: dict[str, str] = field(default_factory=dict)
    test_materials: tuple[str, ...] | None = None
    weight: str | None = None

    def __post_init__(self) -> None:
        for kind, names in (("mapping", self.mapping), ("constant", self.constants), ("alias", self.aliases)):
            if unknown := set(names) - set(FIELDS):
                raise ContractError(f"unknown {kind} fields: {sorted(unknown)}")
        if self.relation_policy not in POLICIES:
            raise ContractError(f"relation_policy must be one of {POLICIES}")
        if not self.tasks or len({t.id for t in self.tasks}) < len(self.tasks):
            raise ContractError("declare at least one task, each with an id of its own")
