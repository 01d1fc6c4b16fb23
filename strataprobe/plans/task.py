"""Tasks, plans and their results."""

from __future__ import annotations

import logging
from dataclasses import asdict, dataclass, field


@dataclass
class Task:
    """One step: a role does it with artifacts that it names by parameter, and leaves artifacts by name."""

    task: str
    player: str = "data_analyst"
    rationale: str = ""
    inputs: dict[str, str] = field(default_factory=dict)
    outputs: list[str] = field(default_factory=list)
    target_resources: list[str] | None = None
    operators: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class Plan:
    steps: list[Task] = field(default_factory=list)

    def __post_init__(self) -> None:
        for place, task, missing in self.unmet_dependencies():
            logging.getLogger(__name__).warning("step %d (%r) takes artifacts that no step before it gives: %s", place, task, ", ".join(missing))

    def unmet_dependencies(self) -> list[tuple[int, str, list[str]]]:
        """(place from 0, task, artifacts) of the steps that take what no earlier step gives; a remark, not a fault, as artifacts may be there from the start."""
        there: set[str] = set()
        out = []
        for place, step in enumerate(self.steps):
            missing = sorted(set((step.inputs or {}).values()) - there)
            if missing:
                out.append((place, step.task, missing))
            there.update(step.outputs or [])
        return out

    def to_dict_list(self) -> list[dict]:
        return [s.to_dict() for s in self.steps]

    @classmethod
    def from_dict_list(cls, steps: list[dict]) -> Plan:
        known = set(Task.__dataclass_fields__)
        return cls([Task(**{k: v for k, v in s.items() if k in known}) for s in steps])

    def pretty_print(self) -> str:
        lines = []
        for i, s in enumerate(self.steps, 1):
            takes = ", ".join(f"{k}={v}" for k, v in s.inputs.items()) or "nothing"
            lines.append(f"{i}. {s.task} [{s.player}] takes {takes}; gives {', '.join(s.outputs) or 'nothing'}")
        return "\n".join(lines)


@dataclass
class StepResult:
    task: str
    player: str
    success: bool
    outputs: dict = field(default_factory=dict)
    error: str | None = None
    seconds: float = 0.0

    def to_dict(self) -> dict:
        return {"task": self.task, "player": self.player, "success": self.success, "outputs": list(self.outputs), "error": self.error, "seconds": self.seconds}


@dataclass
class ExecutionResult:
    success: bool
    workspace: dict = field(default_factory=dict)
    steps: list[StepResult] = field(default_factory=list)
    final_metadata: dict | None = None
    error: str | None = None

    def log_rows(self) -> list[tuple]:
        """(step, task, player, success, error, seconds), for a DataFrame."""
        return [(i, s.task, s.player, s.success, s.error, s.seconds) for i, s in enumerate(self.steps, 1)]

    def log(self, spark):
        return spark.createDataFrame(self.log_rows(), "step int, task string, player string, success boolean, error string, seconds double")
