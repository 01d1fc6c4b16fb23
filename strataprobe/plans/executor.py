"""Running a plan over a context."""

from __future__ import annotations

import time

from ..catalog import Context, forget_context, register_new
from .debate import run_step
from .roles import Topology, effective_pool, topology
from .standards import load_metadata_standard
from .synthesis import TextGenerator, synthesise
from .task import ExecutionResult, Plan, StepResult, Task
from .validate import check_plan

# Names under which a step may leave the final record, first match first; and keys that show a dict to be one.
FINAL_NAMES = ("final_metadata", "metadata", "generated_metadata", "metadata_output", "final_output")
RECORD_KEYS = ("title", "description", "dataset", "dataset_name")


def default_plan(context: Context) -> Plan:
    """Overview, schema, statistics, relations where there are several resources, time and place, record."""
    steps = [
        Task("Survey the resources", "data_analyst", outputs=["overview"], operators=["context_overview"]),
        Task("Describe the schema", "schema_expert", inputs={"overview": "overview"}, outputs=["schema"], operators=["field_types"]),
        Task("Profile the columns", "data_analyst", inputs={"schema": "schema"}, outputs=["statistics"], operators=["field_statistics", "missing_values"]),
    ]
    if len(context.resources) > 1:
        steps.append(Task("Find relations", "relationship_analyst", inputs={"schema": "schema"}, outputs=["relationships"], operators=["relationships"]))
    steps.append(Task("Find time and place", "spatial_temporal_specialist", inputs={"schema": "schema"}, outputs=["extents"], operators=["detect_temporal_columns", "detect_spatial_columns"]))
    steps.append(Task("Write the record", "metadata_generator", inputs={"standard": "metadata_standard", "overview": "overview", "extents": "extents"}, outputs=["metadata_output"], operators=[]))
    return Plan(steps)


class PlanExecutor:
    """Runs the steps in order; one that fails is recorded and the rest still run."""

    def __init__(self, context: Context, topology_name: str = "default", standard: str = "spatial_ecological", writer: TextGenerator | None = None):
        self.context, self.topology, self.standard, self.writer = context, topology(topology_name), standard, writer

    def execute(self, plan: Plan) -> ExecutionResult:
        context = self.context
        workspace = {"metadata_standard": load_metadata_standard(self.standard), "_context_key": register_new(context), "_context_info": context.to_dict(), "_schema": {r: context.table(r).columns for r in context.resources}}
        try:
            return self._execute(plan, workspace)
        finally:
            forget_context(workspace["_context_key"])

    def _execute(self, plan: Plan, workspace: dict) -> ExecutionResult:
        check_plan(plan.to_dict_list(), self.context.context_type, pool_of(self.topology, self.context), workspace)
        done = []
        for task in plan.steps:
            began = time.monotonic()
            try:
                outputs = self._run(task, dict(workspace))
                workspace.update(outputs)
                done.append(StepResult(task.task, task.player, True, outputs, None, time.monotonic() - began))
            except Exception as e:  # noqa: BLE001  a step's failure is part of the result
                done.append(StepResult(task.task, task.player, False, {}, f"{type(e).__name__}: {e}", time.monotonic() - began))
        good = all(s.success for s in done)
        return ExecutionResult(good, workspace, done, final_metadata(workspace), None if good else "; ".join(s.error for s in done if s.error))

    def _run(self, task: Task, workspace: dict) -> dict:
        if any(name in FINAL_NAMES for name in task.outputs):
            record = synthesise(self.context, self.standard, None, self.writer)
            return dict.fromkeys(task.outputs, record)
        facts, text, debate = run_step(self.context, task.task, task.player, self.topology, task.target_resources, task.operators or None, self.writer, task.outputs)
        by_name = text if isinstance(text, dict) else dict.fromkeys(task.outputs, text)
        outputs = {name: facts if text is None else {"facts": facts, "text": by_name[name], "debate": debate} for name in task.outputs}
        for resource in task.target_resources or []:
            own = {k.partition(":")[2]: v for k, v in facts.items() if k.startswith(f"{resource}:")}
            outputs |= {f"{resource}:{name}": own for name in task.outputs}
        return outputs


def pool_of(chosen: Topology, context: Context) -> set[str]:
    return effective_pool(chosen, len(context.resources) > 1)


def final_metadata(workspace: dict) -> dict | None:
    """The record: by name, else the first dict that looks like one, else all artifacts, by resource where they have one."""
    shown = {k: v for k, v in workspace.items() if not k.startswith("_") and k != "metadata_standard"}
    for name in FINAL_NAMES:
        if isinstance(shown.get(name), dict):
            return shown[name]
    for value in shown.values():
        if isinstance(value, dict) and any(k in value for k in RECORD_KEYS):
            return value
    out: dict = {}
    for name, value in shown.items():
        resource, mark, artifact = name.partition(":")
        if mark:
            out.setdefault(resource, {})[artifact] = value
        else:
            out[name] = value
    return out or None


def execute_plan(context: Context, plan: Plan | list[dict] | None = None, topology_name: str = "default", standard: str = "spatial_ecological", writer: TextGenerator | None = None) -> ExecutionResult:
    """Run a plan, the default one if none is given."""
    plan = default_plan(context) if plan is None else plan if isinstance(plan, Plan) else Plan.from_dict_list(plan)
    return PlanExecutor(context, topology_name, standard, writer).execute(plan)
