"""Roles that do tasks, and how many do one at a time."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Role:
    """What a role is for, and the operators that it runs."""

    name: str
    purpose: str
    operators: tuple[str, ...]
    temperature: float | None = None


ROLES: dict[str, Role] = {
    r.name: r
    for r in (
        Role("data_analyst", "Counts, distributions and data quality of each resource.", ("context_overview", "list_resources", "resource_info", "item_count", "field_names", "field_statistics", "missing_values")),
        Role("schema_expert", "Columns, types and structure.", ("context_schema", "field_names", "field_types", "sample_items")),
        Role("metadata_specialist", "Metadata as pairs of field and value.", ("context_overview", "context_schema"), 0.3),
        Role("critic", "Flaws, gaps and contradictions in the work of others.", (), 0.4),
        Role("relationship_analyst", "Keys and relations between resources.", ("relationships", "context_overview", "resource_info", "field_names", "unique_values"), 0.3),
        Role("metadata_generator", "A value for every field of the metadata standard, or null where nothing is known.", ("context_overview", "context_schema"), 0.2),
        Role("spatial_temporal_specialist", "Time and place: columns, granularity and extents.", ("context_overview", "resource_info", "field_names", "field_types", "sample_items", "detect_temporal_columns", "analyze_temporal_column", "detect_spatial_columns", "analyze_spatial_column", "spatial_extent", "temporal_extent"), 0.3),
    )
}


@dataclass(frozen=True)
class Topology:
    """players: how many do each task; rounds: of debate (one less is the number of critique-and-revise cycles)."""

    name: str
    players: int
    rounds: int
    pool: tuple[str, ...]

    @property
    def cycles(self) -> int:
        return max(0, self.rounds - 1)


# The named ways of running a plan.
TOPOLOGIES: dict[str, Topology] = {
    "default": Topology("default", 3, 2, ("data_analyst", "schema_expert", "metadata_specialist")),
    "fast": Topology("fast", 2, 1, ("data_analyst", "schema_expert")),
    "thorough": Topology("thorough", 4, 3, ("data_analyst", "schema_expert", "metadata_specialist", "critic")),
    "single": Topology("single", 1, 0, ("data_analyst",)),
}


def topology(name: str) -> Topology:
    if name not in TOPOLOGIES:
        raise ValueError(f"no topology {name!r}; there are {sorted(TOPOLOGIES)}")
    return TOPOLOGIES[name]


def effective_pool(chosen: Topology, several_resources: bool) -> set[str]:
    """The topology's roles, the one that writes the record, and with several resources the one for relations."""
    return {*chosen.pool, "metadata_generator", "spatial_temporal_specialist", *(["relationship_analyst"] if several_resources else [])}
