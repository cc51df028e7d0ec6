import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from tarn import cli
from tarn.config import Config
from tarn.operators import answering, evaluation
from tarn.plans.ingest import ingest
from tarn.sources.store import ChunkStore

TIERED = "question_id long, document_url string, document_title string, chunk_index int, text string, rank int, tier string"


def tiered(spark, rows):
    return spark.createDataFrame(rows, TIERED)


def asked(spark, *ids):
    return spark.createDataFrame([(i, f"what about {i}?") for i in ids], "question_id long, question string")


def says(text):
    def load():
        return lambda system, prompt: json.dumps({"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}})

    return load


def test_prompt_order(spark):
    rows = [(1, "u2", "T2", 0, "second", 2, "accepted"), (1, "u1", "T1", 0, "first", 1, "accepted"), (1, "u3", "T3", 0, "never", 3, "related"), (2, "u4", None, 0, None, 4, "related")]
    got = {r["question_id"]: r for r in answering.prompts(tiered(spark, rows), asked(spark, 1, 2)).collect()}
    prompt = got[1]["prompt"]
    assert '[1] (from "T1")\n<excerpt>\nfirst\n</excerpt>\n\n[2] (from "T2")\n<excerpt>\nsecond\n</excerpt>' in prompt
    assert "never" not in prompt and prompt.endswith("Question: what about 1?")
    assert prompt.rindex("</excerpt>") < prompt.index(answering.REMINDER["accepted"]) < prompt.index("Question:")
    assert got[1]["system"] == answering.SYSTEM_DIRECT and got[2]["system"] == answering.SYSTEM_RELATED
    assert answering.GUARD in got[1]["system"] and answering.GUARD in got[2]["system"]


def test_three_tiers(spark):
    rows = [(1, "u", "T", 0, "x", 1, "accepted"), (1, "u", "T", 1, "y", 2, "accepted"), (2, "v", "V", 0, "z", 1, "related")]
    got = {r["question_id"]: r for r in answering.ask(tiered(spark, rows), asked(spark, 1, 2, 3), says("Fact [1][2].")).collect()}
    assert got[1]["answer"] == "Fact [1][2]." and [tuple(c) for c in got[1]["citations"]] == [("T", "u")]
    assert got[2]["answer"] == answering.RELATED_PREFIX + "Fact [1][2]." and [tuple(c) for c in got[2]["citations"]] == [("V", "v")]
    assert (got[3]["answer"], got[3]["citations"], tuple(got[3]["usage"]), got[3]["outcome"]) == (answering.NO_ANSWER, [], (0, 0), "no evidence")
    assert tuple(got[1]["usage"]) == (7, 2)


def test_model_refusals_clear_citations(spark):
    rows = [(1, "u", "T", 0, "x", 1, "accepted"), (2, "v", "V", 0, "z", 1, "related")]
    for text in ("I don't know", "i don't know.", "I DO NOT KNOW."):
        for r in answering.ask(tiered(spark, rows), asked(spark, 1, 2), says(text)).collect():
            assert (r["answer"], r["citations"], tuple(r["usage"])) == (text, [], (7, 2))


def test_no_call_without_evidence(spark):
    def never():
        raise AssertionError("called")

    got = answering.ask(tiered(spark, []), asked(spark, 1), never).collect()
    assert [r["answer"] for r in got] == [answering.NO_ANSWER]


def test_response_parsing(spark):
    rows = [('{"choices":[{"message":{"content":" a \\n"}}],"usage":{"prompt_tokens":3,"total_tokens":9}}',), ('{"choices":[{"message":{"content":"b"}}]}',)]
    got = spark.createDataFrame(rows, "r string").select(answering.parse_response(F.col("r")).alias("p")).collect()
    assert [(r["p"]["content"], tuple(r["p"]["usage"])) for r in got] == [("a", (3, 0)), ("b", (0, 0))]


def test_http_client_retries_429():
    config = Config(llm_key="k", llm_url="http://x.example/", llm_model="m")
    sent, waits = [], []

    def send(request, timeout):
        sent.append(json.loads(request.data))
        if len(sent) < 3:
            raise urllib.error.HTTPError("u", 429, "slow", {}, io.BytesIO())
        return b"{}"

    assert answering.http_client(config, send, waits.append)("s", "p") == "{}"
    assert waits == [15.0, 30.0]
    sent.clear()
    waits.clear()

    def asks(request, timeout):
        sent.append(json.loads(request.data))
        if len(sent) < 3:
            raise urllib.error.HTTPError("u", 429, "slow", {"Retry-After": "20"}, io.BytesIO())
        return b"{}"

    assert answering.http_client(config, asks, waits.append)("s", "p") == "{}" and waits == [20.0, 30.0]
    waits.clear()

    def always(request, timeout):
        raise urllib.error.HTTPError("u", 429, "slow", {}, io.BytesIO())

    with pytest.raises(urllib.error.HTTPError):
        answering.http_client(config, always, waits.append)("s", "p")
    assert waits == [15.0, 30.0, 60.0, 120.0]
    assert sent[0]["temperature"] == 0 and [m["role"] for m in sent[0]["messages"]] == ["system", "user"]

    def fail(request, timeout):
        raise urllib.error.HTTPError("u", 500, "down", {}, io.BytesIO())

    with pytest.raises(urllib.error.HTTPError):
        answering.http_client(config, fail, waits.append)("s", "p")
    with pytest.raises(RuntimeError):
        answering.http_client(Config())


def test_evaluation(spark):
    questions = spark.createDataFrame(
        [(1, ["a"], ["1939"], "single"), (2, [], [], "unanswerable"), (3, ["c", "d"], [], "multi"), (4, ["e"], [], "vague")],
        "question_id long, expect_article_ids array<string>, must_contain array<string>, type string",
    )
    answers = spark.createDataFrame(
        [(1, "In 1939", (1_000_000, 1_000_000)), (2, "I don't know.", None), (3, "x", (None, 5)), (4, None, None)], "question_id long, answer string, token_usage struct<prompt_tokens:bigint,completion_tokens:bigint>"
    )
    row = evaluation.answer_metrics(evaluation.grades(answers, questions)).first()
    assert (row["total"], row["answer_hits"], row["unanswerable_total"], row["refusal_hits"], row["cost_usd"]) == (4, 4, 1, 1, round(0.75 + 3e-6, 8))
    places = spark.createDataFrame([(1, "a", 1), (3, "x", 1), (3, "d", 5)], "question_id long, document_url string, place int")
    assert sorted(tuple(r) for r in evaluation.retrieval_hits(places, questions).collect()) == [(1, True, True), (3, False, True), (4, False, False)]
    assert evaluation.mean_seconds(spark.createDataFrame([], "seconds double")).first()[0] == 0.0


def test_cli(spark, tmp_path):
    assert list(cli.typed(["", "  ", " one ", "two", "QUIT", "three"])) == ["one", "two"] and list(cli.typed([])) == []
    lines = iter(["one", "two"])

    def read(prompt):
        try:
            return next(lines)
        except StopIteration:
            raise EOFError from None

    assert list(cli.prompted(read)) == ["one", "two"]
    answers = spark.createDataFrame([(0, "A", []), (1, "B", [("T", "U"), (None, "V")])], "question_id long, answer string, citations array<struct<title:string,url:string>>")
    assert [r["text"] for r in cli.rendered(answers).orderBy("question_id").collect()] == ["A", "B\n  1. T <U>\n  2. V <V>"]
    assert Config.from_env({"TARN_TOP_K": "9", "TARN_RETRIEVAL_MODE": "hybrid"}).top_k == 9
    with pytest.raises(ValueError):
        Config.from_env({"TARN_TOP_K": "x"})
    with pytest.raises(SystemExit):
        cli.main([])


def test_cli_asks_a_store(spark, tmp_path):
    store, shown = ChunkStore(spark, f"{tmp_path}/s"), []
    ingest(store, spark.createDataFrame([("u1", "Tigers", "tigers live in Nepal"), ("u2", "Kale", "kale is green")], "url string, title string, text string"))
    cli.main([f"{tmp_path}/s", "tigers", "Nepal"], shown.append)
    assert shown == ["tigers live in Nepal [1]\n  1. Tigers <u1>"]


def test_pacing_and_timing(spark):
    waits, load = [], answering.paced(says("x"), 5.0, lambda s: waits.append(s))
    client = load()
    for _ in range(3):
        client.before()
        client("s", "p")
    assert waits == [5.0, 5.0]
    prompts = spark.createDataFrame([(i, "s", f"p{i}") for i in range(20)], "question_id long, system string, prompt string").repartition(6)
    plan = answering.complete(prompts, answering.paced(says("x"), 0.0))
    assert plan.select(F.spark_partition_id()).distinct().count() == 1 and plan.count() == 20  # one task: the pace is the job's
    rows = [(1, "u", "T", 0, "x", 1, "accepted")]
    got = {r["question_id"]: r["seconds"] for r in answering.ask(tiered(spark, rows), asked(spark, 1, 2), says("Fact [1].")).collect()}
    assert got[2] == 0.0 and 0 <= got[1] < 5


def test_whole_evaluation(spark):
    corpus = spark.createDataFrame(
        [(1, "u1", "A", 0, "tigers live in 1939", [1.0, 0.0]), (2, "u2", "B", 0, "kale", [0.0, 1.0])],
        "chunk_no long, document_url string, document_title string, chunk_index int, text string, embedding array<float>",
    )
    questions = spark.createDataFrame(
        [(1, "tigers", ["u1"], ["1939"], "single", [1.0, 0.1]), (2, "kale?", [], [], "unanswerable", [-1.0, -1.0]), (3, "kale", ["u1"], ["no"], "single", [0.0, 1.0])],
        "question_id long, question string, expect_article_ids array<string>, must_contain array<string>, type string, embedding array<float>",
    )
    calls = spark.sparkContext.accumulator(0)

    def counted():
        ask = answering.first_excerpt_client()
        return lambda system, prompt: calls.add(1) or ask(system, prompt)

    row = evaluation.evaluate(corpus, questions, dim=2, client=counted).first().asDict()
    assert calls.value == 2  # one a question with evidence
    assert (row["total"], row["retrieval_graded"], row["top1_hits"], row["top5_hits"]) == (3, 2, 1, 2)
    assert (row["answer_hits"], row["unanswerable_total"], row["refusal_hits"]) == (2, 1, 1)
    hybrid = evaluation.evaluate(corpus, questions, dim=2, mode="keyword").first()
    assert (hybrid["top1_hits"], hybrid["top5_hits"]) == (1, 2)  # graded by vectors whatever mode answers
    lines = evaluation.report(row)
    assert lines[1] == "First document expected: 1/2 (50%)" and lines[3] == "Answers correct: 2/3 (67%)"
    empty = evaluation.evaluate(corpus, questions.limit(0), dim=2).first()
    assert (empty["total"], empty["retrieval_graded"], empty["avg_seconds_per_query"]) == (0, 0, 0.0)
