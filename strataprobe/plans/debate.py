"""Several players on one task: work, critique, revision, synthesis.

Facts come from operators and are the same for every player, so they are worked
out once a step and shared.  Without a text generator a player's work is those
facts and there is nothing to debate.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from ..catalog import Context
from ..operators import spatial, temporal
from ..operators.registry import REGISTRY, as_dict
from .roles import ROLES, Role, Topology
from .synthesis import TextGenerator

#: Beginnings of the names of operators that run once for every target resource.
_PER_RESOURCE = ("resource_info", "item_count", "field", "sample", "missing", "detect")
#: Operators that run for columns of every target resource.
_NEED_COLUMN = ("unique_values", "analyze_temporal_column", "analyze_spatial_column", "spatial_extent", "temporal_extent")


@dataclass
class DebateEntry:
    round: int
    player: str
    kind: str
    content: str


@dataclass
class Player:
    role: Role
    number: int = 1
    writer: TextGenerator | None = None
    debate: list[DebateEntry] = field(default_factory=list)

    @property
    def name(self) -> str:
        return f"{self.role.name}_{self.number}"

    def tool_manifest(self) -> str:
        return "\n".join(f"{n}: {REGISTRY[n].summary}" for n in self.role.operators if n in REGISTRY)

    def say(self, prompt: str) -> str:
        return self.writer.generate(f"{self.role.purpose}\n{prompt}", self.role.temperature) if self.writer else ""

    def work(self, task: str, facts: dict) -> str:
        return self.say(f"Task: {task}\nFacts: {facts}") or str(facts)

    def critique(self, task: str, others: list[str]) -> str:
        return self.say(f"Task: {task}\nName flaws and gaps in: {others}")

    def revise(self, task: str, own: str, critiques: list[str]) -> str:
        return self.say(f"Task: {task}\nRevise: {own}\nCritiques: {critiques}") or own

    def synthesise(self, task: str, works: list[str], artifacts: list[str] | None = None) -> str | dict:
        """One text; with several artifacts a value for each by name, from a JSON object if the answer is one, else the text for all."""
        several = artifacts if artifacts and len(artifacts) > 1 else None
        shape = f"\nGive a JSON object with: {', '.join(several)}" if several else ""
        answer = self.say(f"Task: {task}\nMake one answer of: {works}{shape}") or works[0]
        if several is None:
            return answer
        try:
            told = json.loads(answer)
        except ValueError:
            told = None
        return {a: told.get(a) if isinstance(told, dict) else answer for a in several}


def create_player(config: dict, writer: TextGenerator | None = None) -> Player:
    """A player of a role by name ('role'), with its own 'number', 'purpose', 'operators' and 'temperature' where given."""
    own = {k: tuple(v) if k == "operators" else v for k, v in config.items() if k in ("purpose", "operators", "temperature")}
    return Player(replace(ROLES[config["role"]], **own), config.get("number", 1), writer)


def column_parameters(name: str, context: Context, resource: str) -> list[dict]:
    """What an operator that needs columns is run with: keys of relationships, columns that hold times or places, the pair of coordinates."""
    df = context.table(resource)
    if name == "unique_values":
        keys = {c for e in context.get_relationships() for r, c in ((e.from_resource, e.from_field), (e.to_resource, e.to_field)) if r == resource}
        return [{"field": c} for c in df.columns if c in keys]
    if name == "spatial_extent":
        pair = spatial.named_pair(df)
        return [{"lat_column": pair[0], "lon_column": pair[1]}] if pair else []
    if name == "analyze_spatial_column":
        return [{"column": r.field} for r in spatial.detect_spatial_columns(df, 0).where("detected_type = 'wkt_geometry' OR name_suggests_spatial AND detected_type IS NOT NULL").collect()]
    key = "time_column" if name == "temporal_extent" else "column"
    return [{key: r.field} for r in temporal.detect_temporal_columns(df, 0).where("detected_type IN ('datetime64', 'datetime_string')").collect()]


def gather(context: Context, role: Role, targets: list[str] | None = None, operators: list[str] | None = None) -> dict:
    """Results of a role's operators, by operator and, where it runs for each, by resource, then by column for those that need one.  Frames stay lazy."""
    facts: dict = {}
    for name in operators or role.operators:
        if name not in REGISTRY or context.context_type not in REGISTRY[name].kinds:
            continue
        if name in _NEED_COLUMN:
            for resource in targets or context.resources:
                found = {", ".join(p.values()): REGISTRY[name](context, resource=resource, **p) for p in column_parameters(name, context, resource)}
                facts |= {f"{resource}:{name}": found} if found else {}
        elif name.startswith(_PER_RESOURCE):
            for resource in targets or context.resources:
                facts[f"{resource}:{name}"] = REGISTRY[name](context, resource=resource)
        else:
            facts[name] = REGISTRY[name](context)
    return facts


def run_step(context: Context, task: str, role_name: str, chosen: Topology, targets: list[str] | None = None, operators: list[str] | None = None, writer: TextGenerator | None = None, artifacts: list[str] | None = None) -> tuple[dict, str | dict | None, list[DebateEntry]]:
    """Facts, what the players agreed on (a text, a dict by artifact if there are several, None without a writer), and the debate."""
    role = ROLES[role_name]
    facts = gather(context, role, targets, operators)
    if writer is None:
        return facts, None, []
    shown = {k: {c: as_dict(x) for c, x in v.items()} if isinstance(v, dict) else as_dict(v) for k, v in facts.items()}
    players = [Player(role, i + 1, writer) for i in range(max(1, chosen.players))]
    works, debate = [p.work(task, shown) for p in players], []
    for cycle in range(1, chosen.cycles + 1):
        critiques = [p.critique(task, [w for q, w in zip(players, works, strict=True) if q is not p]) for p in players]
        debate += [DebateEntry(cycle, p.name, "critique", c) for p, c in zip(players, critiques, strict=True)]
        works = [p.revise(task, w, [c for q, c in zip(players, critiques, strict=True) if q is not p]) for p, w in zip(players, works, strict=True)]
        debate += [DebateEntry(cycle, p.name, "revision", w) for p, w in zip(players, works, strict=True)]
    return facts, players[0].synthesise(task, works, artifacts), debate
