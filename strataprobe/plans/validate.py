"""Checks of a plan before any Spark job runs."""

from __future__ import annotations

from collections.abc import Iterable

from ..catalog import ContextType
from ..errors import PlanError
from ..operators.registry import operators_for
from .roles import ROLES

#: Artifacts that exist before the first step.
INITIAL_ARTIFACTS = frozenset({"metadata_standard", "_context_key", "_context_info", "_schema"})


def validate_plan_dataflow(plan: Iterable[dict], initial_artifacts: Iterable[str] | None = None) -> tuple[bool, str]:
    """Whether every input is there from the start or left by an earlier step; the first that is not is named."""
    there = set(INITIAL_ARTIFACTS if initial_artifacts is None else initial_artifacts)
    for number, step in enumerate(plan, 1):
        for parameter, artifact in (step.get("inputs") or {}).items():
            if artifact not in there:
                return False, f"Step {number} ('{step.get('task', '<unknown>')}'): input '{parameter}' needs artifact '{artifact}', but no earlier step leaves it."
        there.update(step.get("outputs") or [])
    return True, "Plan dataflow is valid."


def validate_plan_operators(plan: Iterable[dict], kind: ContextType, allowed: set[str] | None = None) -> tuple[bool, str]:
    """Whether every role exists, may be used, and has an operator for the kind of context (roles without operators may be used)."""
    faults = []
    for number, step in enumerate(plan, 1):
        where, name = f"Step {number} ('{step.get('task', '<unknown>')}')", step.get("player", "")
        if name not in ROLES:
            faults.append(f"{where}: unknown player '{name}'.")
        elif allowed is not None and name not in allowed:
            faults.append(f"{where}: player '{name}' is not in the player pool.")
        elif ROLES[name].operators and not operators_for(kind, list(ROLES[name].operators)):
            faults.append(f"{where}: no operator of player '{name}' takes contexts of type '{kind.value}'.")
    return (False, " | ".join(faults)) if faults else (True, "Plan operators are valid.")


def check_plan(plan: list[dict], kind: ContextType, allowed: set[str] | None = None, initial_artifacts: Iterable[str] | None = None) -> None:
    for ok, message in (validate_plan_dataflow(plan, initial_artifacts), validate_plan_operators(plan, kind, allowed)):
        if not ok:
            raise PlanError(message)
