"""From a source to a record: context, plan, checks, execution."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession

from ..catalog import Context
from ..operators.registry import REGISTRY, as_dict
from ..sources import create_context
from .executor import PlanExecutor, default_plan, pool_of
from .roles import ROLES, TOPOLOGIES, topology
from .synthesis import TextGenerator, describe
from .task import ExecutionResult, Plan
from .validate import check_plan

log = logging.getLogger("strataprobe")


def logged(what: str) -> Callable:
    """Log when a function begins, ends and how long it took."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(*args, **kw):
            began = time.monotonic()
            log.info("%s", what)
            try:
                return f(*args, **kw)
            finally:
                log.info("%s: %.3f s", what, time.monotonic() - began)

        return run

    return wrap


class Orchestrator:
    """Plans and runs; a planner may be given as a function from a prompt to a list of steps in JSON."""

    def __init__(self, spark: SparkSession, topology_name: str = "default", standard: str = "spatial_ecological", writer: TextGenerator | None = None):
        self.spark, self.topology, self.standard, self.writer = spark, topology(topology_name), standard, writer

    def pool_text(self, context: Context) -> str:
        return "\n".join(f"{n}: {ROLES[n].purpose} ({', '.join(ROLES[n].operators) or 'no operators'})" for n in sorted(pool_of(self.topology, context)))

    def manifest(self, context: Context) -> str:
        return "\n".join(f"{o.name}: {o.summary}" for o in REGISTRY.values() if context.context_type in o.kinds)

    def planning_prompt(self, context: Context) -> str:
        return f"Context: {describe(context)}\nPlayers:\n{self.pool_text(context)}\nOperators:\n{self.manifest(context)}\nGive a JSON list of steps with task, player, inputs and outputs; the last leaves metadata_output."

    @logged("plan")
    def generate_plan(self, context: Context) -> Plan | None:
        """The writer's plan if there is a writer (None if it gives no valid one), else the default plan."""
        if self.writer is None:
            return default_plan(context)
        try:
            plan = Plan.from_dict_list(json.loads(self.writer.generate(self.planning_prompt(context))))
            check_plan(plan.to_dict_list(), context.context_type, pool_of(self.topology, context))
        except (ValueError, TypeError, AttributeError) as e:
            log.warning("no valid plan: %s", e)
            return None
        return plan

    @logged("run")
    def run(self, source, name: str = "dataset", plan: Plan | None = None) -> ExecutionResult | None:
        context = create_context(self.spark, source, name)
        context.validate()
        plan = plan or self.generate_plan(context)
        if plan is None:
            return None
        return PlanExecutor(context, self.topology.name, self.standard, self.writer).execute(plan)


def result_key(data: bytes, standard: str, topology_name: str = "default") -> str:
    """A key for caching a result: of the data, the standard and the topology."""
    return hashlib.sha256(b"\0".join((data, standard.encode(), topology_name.encode()))).hexdigest()


def config_summary() -> dict:
    return {"topologies": {n: {"players": t.players, "rounds": t.rounds, "pool": list(t.pool)} for n, t in TOPOLOGIES.items()}, "roles": list(ROLES), "operators": list(REGISTRY)}


def result_details(result: ExecutionResult) -> dict:
    """A result with its frames as plain values."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        return as_dict(v) if hasattr(v, "collect") else v

    return {"success": result.success, "metadata": plain(result.final_metadata), "steps": [s.to_dict() for s in result.steps], "error": result.error}
