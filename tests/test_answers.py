import os
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.functions.text import NO_ANSWER
from tidewell.operators.chatlog import append_exchanges, new_turns
from tidewell.operators.generate import generate_distinct, generated_answer
from tidewell.plans import agent, faq
from tidewell.plans.layers import build_layers
from tidewell.plans.retrieval import retrieve
from tidewell.sources.tables import RAW_DOCUMENT_SCHEMA, inline_rows, values_view
from tidewell.workspace import Workspace, shared_root

DOCUMENTS = [
    ("lake.txt", "The <b>lake</b> freezes in  January and thaws in March."),
    ("mill.txt", "The mill grinds wheat; the mill was built by the river."),
    ("copy.txt", "the mill grinds wheat; the mill was built by the river."),
    ("bare.txt", None),
]
QUESTIONS = [(1, "What does the mill grind?"), (2, "Lake freezes in January")]


@pytest.fixture(scope="module")
def layers(spark):
    workspace = Workspace(spark, "answers")
    return build_layers(
        spark, inline_rows(spark, DOCUMENTS), f"s{uuid.uuid4().hex}", workspace,
        dense=True, location=workspace.path("tables"),
    )


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id BIGINT, question STRING")


def test_layers(layers):
    assert layers.raw.columns == ["source_file", "raw_content", "ingestion_time"]
    assert inline_rows(layers.raw.sparkSession, DOCUMENTS).schema == RAW_DOCUMENT_SCHEMA
    found = sorted((r.chunk_id, r.source_file) for r in layers.chunks.collect())
    assert found == [(0, "copy.txt"), (1, "lake.txt"), (2, "mill.txt")]
    assert layers.vectors.columns == ["source_file", "chunk_text", "chunk_id", "embedding"]


def test_unique_ids_serve_as_well(spark):
    workspace = Workspace(spark, "unique")
    built = build_layers(
        spark, inline_rows(spark, DOCUMENTS), f"s{uuid.uuid4().hex}", workspace,
        location=workspace.path("tables"),
    )
    assert built.vectors.select("chunk_id").distinct().count() == 3


def test_retrieval_ranks_and_breaks_ties_by_id(layers, questions):
    hits = retrieve(questions, layers.vectors, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.source_file) for r in hits] == [
        (1, 1, "copy.txt"), (1, 2, "mill.txt"), (2, 1, "lake.txt"), (2, 2, "copy.txt")]
    assert hits[0].squared_l2 == hits[1].squared_l2


def test_answers_and_sources(layers, questions):
    hits = retrieve(questions, layers.vectors, 2)
    answers = {r.query_id: r for r in agent.answer_with_sources(questions, hits).collect()}
    mill = "the mill grinds wheat; the mill was built by the river."
    assert answers[1].answer == mill
    assert answers[1].context == f"[copy.txt] {mill}\n\n[mill.txt] {mill}"
    assert answers[1].response == mill + "\n\n**Sources:**\n- *copy.txt*\n- *mill.txt*"
    plain = {r.query_id: r for r in agent.answer_questions(questions, hits).collect()}
    assert f"Context:\n{mill}\n\n{mill}\n\nQuestion:\nWhat does the mill grind?" in plain[1].prompt


def test_nothing_retrieved(layers, questions):
    hits = retrieve(questions, layers.vectors.where("false"), 2)
    rows = agent.answer_with_sources(questions, hits).collect()
    assert {r.answer for r in rows} == {"I don't know"} and {r.context for r in rows} == {""}
    assert {r.response for r in rows} == {"I don't know\n\n**Sources:**"}


def test_any_generator_fits(layers, questions):
    class Shouting:
        def generate(self, prompts, max_length):
            return [p.split("\n")[-3].upper()[:max_length] for p in prompts]

    hits = retrieve(questions, layers.vectors, 1)
    found = agent.answer_questions(questions, hits, Shouting).collect()
    assert {r.answer for r in found} == {q.upper() for _, q in QUESTIONS}
    cited = agent.answer_with_sources(questions, hits, Shouting)
    assert all(r.response.startswith(r.answer + "\n\n**Sources:**\n- *") for r in cited.collect())
    plan = cited._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(concat_ws") == 1


def test_answered_questions_continue_the_log(spark, layers, questions):
    log = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "hello")],
        "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    hits = retrieve(questions, layers.vectors, 1)
    asked = agent.answer_with_sources(questions, hits).selectExpr(
        "query_id AS conv_id", "question", "response AS answer")
    found = append_exchanges(log, asked).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role) for r in found] == [
        (1, 0, "user"), (1, 1, "assistant"), (1, 2, "user"), (1, 3, "assistant"),
        (2, 0, "user"), (2, 1, "assistant")]


def test_several_exchanges_of_one_conversation(spark):
    log = spark.createDataFrame([(7, 4, "user", "x")], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    more = spark.createDataFrame(
        [(7, "q0", "a0", 0), (7, "q1", "a1", 1)],
        "conv_id BIGINT, question STRING, answer STRING, exchange_no INT")
    found = append_exchanges(log, more).orderBy("turn").collect()
    assert [(r.turn, r.text) for r in found] == [(4, "x"), (5, "q0"), (6, "a0"), (7, "q1"), (8, "a1")]
    added = new_turns(log, more).orderBy("turn").collect()
    assert [r.turn for r in added] == [5, 6, 7, 8]
    with pytest.raises(ValueError, match="exchange_no"):
        append_exchanges(log, more.drop("exchange_no"))


def test_nearest_entry(spark, questions):
    entries = values_view(
        spark, "entries", ("id", "topic", "content"),
        [(1, "it's", "the lake"), (2, "back\\slash", "the mill"), (3, None, "other words")])
    assert entries.schema["id"].dataType.simpleString() == "int"
    found = {r.query_id: r for r in faq.nearest_entry(questions, entries).collect()}
    assert found[1].content == "the mill" and found[1].topic == "back\\slash"
    assert found[2].topic == "it's"


def test_shared_root_is_the_one_the_session_names(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_root(spark) == configured.rstrip("/")
    assert Workspace(spark).root != Workspace(spark).root


def test_generation_asks_each_prompt_once_bounds_it_and_keeps_failures(spark, workspace):
    log = workspace.path("asked")
    os.makedirs(log)

    class Careful:
        def generate(self, prompts, max_length):
            if any("bad" in prompt for prompt in prompts):
                raise ValueError("no")
            for prompt in prompts:
                open(os.path.join(log, uuid.uuid4().hex), "w").write(prompt)
            return [None if "none" in prompt else prompt * 100 for prompt in prompts]

    prompts = ["same"] * 2000 + ["bad one", "none", None, "other", "other"]
    rows = [(i, p) for i, p in enumerate(prompts)]
    asked = workspace.stage(spark.createDataFrame(rows, "id INT, p STRING").repartition(5), "asked-rows")
    found = {r["id"]: r for r in generate_distinct(asked, "p", workspace, Careful, 30).collect()}
    texts = sorted(open(os.path.join(log, name)).read() for name in os.listdir(log))
    assert texts == ["", "none", "other", "same"]
    assert len(found) == len(rows) and found[7]["answer"] == ("same" * 100)[:30]
    assert found[2000]["answer"] is None and found[2000]["failure"] == "ValueError: no"
    assert found[2001]["answer"] is None and found[2001]["failure"] is None
    assert found[2004]["answer"] == ("other" * 100)[:30] and found[2004]["failure"] is None
    texts = asked.limit(1).select(generated_answer(F.lit("bad"), Careful)).first()
    assert texts[0] == NO_ANSWER


def test_a_model_of_too_few_answers_is_a_failure(spark, workspace):
    class Short:
        def generate(self, prompts, max_length):
            return []

    asked = workspace.stage(spark.createDataFrame([("a",), ("b",)], "p STRING"), "short")
    found = generate_distinct(asked, "p", workspace, Short).collect()
    assert {r["failure"] for r in found} == {"ValueError: 0 answers to 1 prompts"}
