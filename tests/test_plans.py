import json

import pytest

from strataprobe.catalog import ContextType
from strataprobe.errors import PlanError
from strataprobe.operators.registry import REGISTRY, as_dict, operators_for, run
from strataprobe.plans.debate import create_player, gather
from strataprobe.plans.executor import execute_plan, final_metadata
from strataprobe.plans.orchestrator import Orchestrator, config_summary, result_details, result_key
from strataprobe.plans.roles import ROLES, topology
from strataprobe.plans.standards import load_metadata_standard, schema_for_standard
from strataprobe.plans.task import Plan, Task
from strataprobe.plans.validate import check_plan, validate_plan_dataflow, validate_plan_operators
from strataprobe.sources import create_context


def step(task, inputs=None, outputs=(), player="data_analyst"):
    return {"task": task, "player": player, "inputs": inputs or {}, "outputs": list(outputs)}


def test_chain():
    assert validate_plan_dataflow([step("a", {}, ["x"]), step("b", {"p": "x"}, ["y"])]) == (True, "Plan dataflow is valid.")


def test_missing_input():
    ok, message = validate_plan_dataflow([step("a", {"p": "ghost"})])
    assert not ok and "'ghost'" in message and "no earlier step leaves it" in message


def test_producer_after_consumer():
    ok, message = validate_plan_dataflow([step("get_schemas", {"p": "x"}), step("b", {}, ["x"])])
    assert not ok and message.startswith("Step 1 ('get_schemas')")


def test_independent_empty_and_several_inputs():
    assert validate_plan_dataflow([step("a", {}, ["x"]), step("b", {}, ["y"])])[0]
    assert validate_plan_dataflow([])[0]
    assert validate_plan_dataflow([step("a", {}, ["x"]), step("b", {}, ["y"]), step("c", {"p": "x", "q": "y", "s": "metadata_standard"})])[0]
    assert not validate_plan_dataflow([step("c", {"s": "metadata_standard"})], [])[0]


def test_operators_of_players():
    kind = ContextType.SINGLE_CSV
    assert validate_plan_operators([step("a"), step("b", player="critic")], kind)[0]
    ok, message = validate_plan_operators([step("a", player="nobody"), step("b", player="critic")], kind, {"data_analyst"})
    assert not ok and "unknown player 'nobody'" in message and " | " in message
    with pytest.raises(PlanError):
        check_plan([step("a", player="nobody")], kind)
    assert "relationships" not in operators_for(kind) and "relationships" in operators_for(ContextType.SQLITE)
    assert operators_for(kind, ["something_else"]) == ["something_else"]
    assert all(o in REGISTRY for r in ROLES.values() for o in r.operators)


def test_topologies():
    assert (topology("default").players, topology("default").cycles, topology("fast").cycles, topology("thorough").cycles, topology("single").cycles) == (3, 1, 0, 2, 0)
    with pytest.raises(ValueError):
        topology("huge")


def test_standards(tmp_path):
    assert json.loads(load_metadata_standard("spatial_ecological"))["title"]
    (tmp_path / "s.txt").write_text("my standard")
    assert load_metadata_standard(str(tmp_path / "s.txt")) == "my standard"
    with pytest.raises(ValueError):
        load_metadata_standard("basic")
    assert schema_for_standard("basic") is None


def test_final_metadata():
    assert final_metadata({"_x": {}, "metadata": {"a": 1}, "final_metadata": {"b": 2}}) == {"b": 2}
    assert final_metadata({"work": {"title": "t"}}) == {"title": "t"}
    assert final_metadata({"r:stats": 1, "r:nulls": 2, "s:stats": 3}) == {"r": {"stats": 1, "nulls": 2}, "s": {"stats": 3}}
    assert final_metadata({"n": 1}) == {"n": 1} and final_metadata({"_only": 1}) is None


@pytest.fixture()
def survey(tmp_path, spark):
    (tmp_path / "samples.csv").write_text("sample_id,date,lat,lon\n1,2008-05-01,53.1,5.0\n2,2024-06-01,53.4,5.5\n")
    (tmp_path / "catches.csv").write_text("sample_id,species,abundance\n1,a,3\n1,b,4\n2,a,5\n")
    return create_context(spark, str(tmp_path), "shore_survey")


def test_default_plan(survey):
    result = execute_plan(survey)
    assert result.success, result.error
    record = result.final_metadata
    assert record["title"] == "Shore Survey" and record["format"] == "CSV"
    assert record["temporal_coverage"] == "2008-05-01 to 2024-06-01" and record["methods"] is None
    assert record["spatial_coverage"] == {"min_lat": 53.1, "min_lon": 5.0, "max_lat": 53.4, "max_lon": 5.5}
    assert "catches.sample_id -> samples.sample_id (many-to-one)" in record["description"]
    assert [r[0] for r in result.log_rows()] == list(range(1, len(result.steps) + 1))
    assert result_details(result)["metadata"]["format"] == "CSV"


def test_a_failing_step_does_not_stop_the_rest(survey):
    plan = Plan([Task("bad", outputs=["x"], operators=["item_count"], target_resources=["nope"]), Task("good", outputs=["y"], operators=["item_count"], target_resources=["catches"])])
    result = execute_plan(survey, plan)
    assert not result.success and [s.success for s in result.steps] == [False, True]
    assert as_dict(result.workspace["catches:y"]["item_count"]) == [{"item_count": 3}]
    with pytest.raises(PlanError):
        execute_plan(survey, [step("a", {"p": "ghost"})])


class Echo:
    def __init__(self, answer):
        self.answer, self.asked = answer, []

    def generate(self, prompt, temperature=None):
        self.asked.append(prompt)
        return self.answer


def test_writer_debates_and_plans(spark, survey):
    writer = Echo("noted")
    result = execute_plan(survey, [step("count", {}, ["x"])], writer=writer)
    assert result.workspace["x"]["text"] == "noted" and [e.kind for e in result.workspace["x"]["debate"]] == ["critique"] * 3 + ["revision"] * 3
    assert Orchestrator(spark, writer=Echo("not json")).generate_plan(survey) is None
    planned = Orchestrator(spark, writer=Echo(json.dumps([step("a", {}, ["x"])]))).generate_plan(survey)
    assert planned.steps[0].task == "a" and "1. a" in planned.pretty_print()


def test_several_artifacts_get_their_own_values(survey):
    plan = [step("count", {}, ["x", "y"])]
    told = execute_plan(survey, plan, "single", writer=Echo('{"x": "rows", "z": 1}')).workspace
    assert (told["x"]["text"], told["y"]["text"]) == ("rows", None)
    told = execute_plan(survey, plan, "single", writer=Echo("[1]")).workspace
    assert (told["x"]["text"], told["y"]["text"]) == ("[1]", "[1]")


def test_operators_that_need_columns_run_for_those_that_fit(survey):
    facts = gather(survey, ROLES["spatial_temporal_specialist"])
    assert set(facts["samples:analyze_temporal_column"]) == {"date"} and "catches:analyze_temporal_column" not in facts
    assert facts["samples:temporal_extent"]["date"].first().valid_timestamps == 2
    assert set(facts["samples:analyze_spatial_column"]) == {"lat", "lon"}
    assert facts["samples:spatial_extent"]["lat, lon"].first().valid_point_count == 2
    facts = gather(survey, ROLES["relationship_analyst"], ["catches"])
    assert [r.value for r in facts["catches:unique_values"]["sample_id"].orderBy("value").collect()] == [1, 2] and set(facts["catches:unique_values"]) == {"sample_id"}


def test_players_from_settings():
    writer = Echo("seen")
    player = create_player({"role": "critic", "number": 2, "purpose": "Look closely.", "operators": ["item_count"]}, writer)
    assert player.name == "critic_2" and player.tool_manifest().startswith("item_count: ") and player.critique("t", ["a"]) == "seen"
    assert writer.asked[0].startswith("Look closely.") and create_player({"role": "critic"}).role == ROLES["critic"]


def test_orchestrator(spark, survey):
    result = Orchestrator(spark, "fast").run(survey)
    assert result.final_metadata["format"] == "CSV"
    assert result_key(b"x", "s", "fast") != result_key(b"x", "s") and "fast" in config_summary()["topologies"]


def test_operators_by_name(survey):
    assert run("list_resources", survey) == ["catches", "samples"]
    assert run("context_overview", survey)["relationship_count"] == 1
    assert run("resource_info", survey, resource="samples")["item_count"] == 2
    assert run("spatial_extent", survey, resource="samples", lat_column="lat", lon_column="lon").first().valid_point_count == 2
    with pytest.raises(KeyError):
        run("nothing", survey)


def test_command_line(spark, tmp_path, capsys):
    from strataprobe.__main__ import main

    (tmp_path / "a.csv").write_text("id,day\n1,2020-01-01\n2,2020-01-03\n")
    assert main([str(tmp_path / "a.csv"), "--name", "small_table"]) == 0
    assert json.loads(capsys.readouterr().out)["temporal_coverage"] == "2020-01-01 to 2020-01-03"
    assert main([str(tmp_path / "gone.csv")]) == 2


def test_generators():
    from types import SimpleNamespace as N

    from strataprobe.plans.generators import ChatGenerator, ContentGenerator, create_generator

    asked = []
    chat = N(chat=N(completions=N(create=lambda **kw: asked.append(kw) or N(choices=[N(message=N(content="yes"))]))))
    assert ChatGenerator(chat, "m").generate("q", 0.3) == "yes" and asked[0]["temperature"] == 0.3
    assert ContentGenerator(N(models=N(generate_content=lambda **kw: N(text="ok"))), "m").generate("q") == "ok"
    with pytest.raises(ValueError):
        create_generator("nobody", "m", "k")


def test_unmet_dependencies_are_remarks(caplog):
    with caplog.at_level("WARNING"):
        plan = Plan([Task("a", outputs=["x"]), Task("b", inputs={"p": "x", "q": "ghost", "r": "later"}), Task("c", outputs=["later"])])
    assert plan.unmet_dependencies() == [(1, "b", ["ghost", "later"])] and "ghost" in caplog.text
