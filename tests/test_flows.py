"""Flows, converters, recipes, documents and streams."""

import json
import threading
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
import yaml

from corpusloom.functions.template import TemplateError
from corpusloom.operators import models
from corpusloom.plans import catalog, convert, mix
from corpusloom.plans.flow import FLOWS, Context, EmptyResult, FlowError, Step, generate, read_flow
from corpusloom.plans.run import Generator, cut, finished, without
from corpusloom.sources import files, ingest
from corpusloom.streaming.seeds import generate_stream


@pytest.mark.parametrize("path", sorted(p.name for p in FLOWS.glob("*.yaml") if p.name != "recipe.yaml"))
def test_packaged_flows_can_be_read(path):
    assert read_flow(path)


def test_every_prompt_of_a_flow_exists():
    for p in FLOWS.glob("*.yaml"):
        for step in yaml.safe_load(p.read_text()) if p.name != "recipe.yaml" else []:
            config = step["block_config"]
            for path in [config.get("config_path"), *(config.get("config_paths") or {} if isinstance(config.get("config_paths"), dict) else {}).values(), *(config.get("config_paths") if isinstance(config.get("config_paths"), list) else [])]:
                assert path is None or (FLOWS / path).is_file(), path


@dataclass(frozen=True)
class Anything(models.StubBackend):
    """Answers every prompt with all pairs of tags that the packaged prompts ask for, around what passes the filters."""

    def complete(self, prompts, ids, model, options):
        return [[self.one(p, k) for k in range(options.n)] for p in prompts]

    @staticmethod
    def one(prompt, sample):
        if "_A_ to _H_" in prompt:
            return "_A_"
        if "Say what kind of document" in prompt:
            return "A"
        text = "".join(f"[QUESTION] What{k}? A) a [ANSWER] A) It is {k}. [END]" for k in (1, 2))
        text += "".join(f"[Start of {t}] {v} [End of {t}]" for t, v in (("Question", "Do this"), ("Context", f"ctx {sample}"), ("Response", "Done"), ("Evaluation", "x"), ("Explanation", "x"), ("Feedback", "x"), ("Answer", "YES"), ("Rating", "1.0"), ("Verdict", "Response B")))
        score = "2.0" if "1 to 3" in prompt or "0, 1 or 2" in prompt else "1.0"
        return f"<think>so</think>{text}[Start of Score] {score} [End of Score]"


SEED = {"document": "A text.", "document_outline": "T", "domain": "d", "task_description": "t", "simple_task_description": "s", "prompt": "p", "question": "q", "response": "r", "seed_question": "sq", "seed_response": "sr", "seed_context": "sc", **catalog.EXAMPLE}


@pytest.mark.parametrize("path", sorted(p.name for p in FLOWS.glob("*.yaml") if p.name != "recipe.yaml"))
def test_packaged_flows_run(spark, path):
    steps = read_flow(path)
    made = [c for s in steps for c in (*(s.config.get("output_cols") or ()), s.config.get("output_col"))]
    # What a flow makes itself is no seed, but for the pair that the improvement flow begins with.
    seed = {k: v for k, v in SEED.items() if k not in made or (path == "skills_improved.yaml" and k in ("question", "response"))}
    df = spark.createDataFrame([seed | {"document": f"A text {k}.", "prompt": f"p{k}"} for k in range(2)] if "document" in seed else [seed])
    out = generate(df, steps, Context(Anything()))
    last = [c for s in steps for c in s.config.get("output_cols") or () if c in out.columns]
    assert last
    assert out.count() > 0
    assert all(v is not None for r in out.select(*last).collect() for v in r)


def test_flow_errors(spark):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(FlowError, match="no block"):
        generate(df, [Step("Nope", {})])
    with pytest.raises(TemplateError, match="no column"):
        generate(df, read_flow("knowledge_simple.yaml"), Context(models.StubBackend()))
    none = Step("FilterByValueBlock", {"filter_column": "a", "filter_value": "y", "operation": "operator.eq"})
    ask = Step("LLMBlock", {"config_path": "ask", "output_cols": ["b"]})
    config = {"ask": {"system": "", "introduction": "", "principles": "", "examples": "", "generation": "{{ a }}", "start_tags": [""], "end_tags": [""]}}
    with pytest.raises(EmptyResult, match="flow gave no rows"):
        generate(df, [none])
    assert generate(df, [none], fail_on_empty=False).count() == 0
    with pytest.raises(EmptyResult, match="step LLMBlock gave no rows"):
        generate(df, [ask], Context(models.StubBackend(), configs={"ask": config["ask"] | {"start_tags": ["<t>"], "end_tags": ["</t>"]}}))
    with pytest.raises(EmptyResult, match="no rows for step LLMBlock"):
        generate(df, [ask, none, ask], Context(models.StubBackend("x"), configs=config))
    for model in ({"model_id": "unknown-7b"}, {"model_prompt": "nope"}):
        with pytest.raises(FlowError, match="no chat template"):
            generate(df, [Step("LLMBlock", {**ask.config, **model})], Context(models.StubBackend(), configs=config))


@dataclass(frozen=True)
class Counting(models.StubBackend):
    """Appends to a file whenever it is called."""

    path: str = ""

    def complete(self, prompts, ids, model, options):
        with open(self.path, "a") as f:
            f.write("x\n" * len(prompts))
        return [["A" if k % 2 else "B" for _ in range(options.n)] for k in range(len(prompts))]


def test_a_model_is_called_once_a_row(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "'t' as document")
    log = tmp_path / "calls"
    steps = [Step("LLMBlock", {"config_path": "prompts/knowledge_plain.yaml", "output_cols": ["output"]}), Step("SetToMajorityValue", {"col_name": "output"}), Step("FilterByValueBlock", {"filter_column": "output", "filter_value": ["A", "B"], "operation": "contains"})]
    out = generate(df, steps, Context(Counting(path=str(log))))
    assert out.count() == 20
    assert out.count() == 20
    assert log.read_text().count("x") == 20


@dataclass(frozen=True)
class Failing(models.StubBackend):
    """Fails on a prompt until a file is there."""

    path: str = ""

    def complete(self, prompts, ids, model, options):
        if any((self.answer if self.answer != "{prompt}" else "t7") in p for p in prompts) and not Path(self.path).exists():
            raise RuntimeError("no answer")
        return [[p] for p in prompts]


def test_batches_resume(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "concat('t', id) as document")
    steps = [Step("LLMBlock", {"config_path": "prompts/knowledge_plain.yaml", "output_cols": ["output"]})]
    run = Generator([steps], Context(Failing(path=str(tmp_path / "go"))), batch_size=3, key=["id"])
    where = f"file://{tmp_path}/out"
    assert sorted(r["id"] for r in run.generate(df, where).collect()) == [0, 1, 2, 3, 4, 5, 9]
    assert finished(spark, where) == {0, 1, 3}
    (tmp_path / "go").touch()
    assert run.generate(df, where).count() == 10
    assert finished(spark, where) == {0, 1, 2, 3}


def test_waves_are_few_jobs_and_failures_are_found_by_halves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corpusloom.plans.run.WAVES", 2)
    df = spark.range(40).selectExpr("id", "concat('t', id, '.') as document")
    steps = [Step("LLMBlock", {"config_path": "prompts/knowledge_plain.yaml", "output_cols": ["output"]})]
    log = tmp_path / "calls"
    where = f"file://{tmp_path}/out"
    whole = Generator([steps], Context(Counting(path=str(log))), batch_size=2, key=["id"]).generate(df, where)
    assert whole.count() == 40
    assert log.read_text().count("x") == 40
    assert len(list((tmp_path / "out").glob("rows=*"))) == 2
    where = f"file://{tmp_path}/again"
    run = Generator([steps], Context(Failing(answer="t7.", path=str(tmp_path / "go"))), batch_size=2, key=["id"])
    assert run.generate(df, where).count() == 38
    assert finished(spark, where) == set(range(20)) - {3}
    (tmp_path / "go").touch()
    assert run.generate(df, where).count() == 40


def test_waves_without_rows_are_not_halved(spark, tmp_path, monkeypatch, caplog):
    monkeypatch.setattr("corpusloom.plans.run.WAVES", 2)
    df = spark.range(16).selectExpr("id", "'t' as document")
    keep = Step("FilterByValueBlock", {"filter_column": "id", "filter_value": 8, "operation": "operator.ge"})
    out = Generator([[keep]], batch_size=2, key=["id"]).generate(df, f"file://{tmp_path}/out")
    assert sorted(r["id"] for r in out.collect()) == list(range(8, 16))
    assert len([r for r in caplog.records if "gave no rows" in r.getMessage()]) == 1


def test_spans():
    assert without(0, 9, [(2, 3, ""), (5, 5, ""), (20, 30, "")]) == [(0, 1), (4, 4), (6, 9)]
    assert without(0, 3, [(0, 9, "")]) == []
    assert cut([(0, 3), (6, 9)], 2, 7) == [(2, 3), (6, 7)]


def test_resume_by_value(spark, tmp_path):
    run = Generator([[Step("DuplicateColumns", {"columns_map": {"document": "copy"}})]])
    where = f"file://{tmp_path}/out"
    assert run.generate(spark.range(3).selectExpr("id", "'t' as document"), where).count() == 3
    assert run.generate(spark.range(5).selectExpr("id", "'t' as document"), where).count() == 5


def test_conditional_iteration_and_more_blocks(spark):
    df = spark.createDataFrame([("A", "x</think> y"), ("B", "z")], "route string, t string")
    configs = {"a": {"system": "", "introduction": "", "principles": "", "examples": "", "generation": "a {{ t }}", "start_tags": [""], "end_tags": [""]}, "b": {"system": "", "introduction": "", "principles": "", "examples": "", "generation": "b {{ t }}"}}
    ctx = Context(models.StubBackend(), configs=configs)
    out = generate(df, [Step("PostProcessThinkingBlock", {"column_name": "t"}), Step("ConditionalLLMBlock", {"config_paths": {"A": "a", "All": "b"}, "selector_column_name": "route", "output_cols": ["out"]})], ctx)
    assert sorted(r["out"] for r in out.collect()) == ["a y", "b z"]
    twice = generate(df, [Step("IterBlock", {"num_iters": 2, "block_type": "LLMBlock", "block_kwargs": {"config_path": "a", "output_cols": ["out"]}})], ctx)
    assert twice.count() == 4
    parsed = generate(df, [Step("RegexParserBlock", {"column_name": "t", "parsing_pattern": "([a-z])", "output_cols": ["c"]})], ctx)
    assert sorted(r["c"] for r in parsed.collect())[-2:] == ["y", "z"]


class Server(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("chat/completions"):
            out = {"choices": [{"message": {"content": f"t{body['temperature']}"}} for _ in range(body["n"])]}
        elif self.path.endswith("pooling"):
            out = {"data": [{"data": [[0.1, 0.9], [0.2, 0.8]]}]}
        elif body.get("logprobs"):
            out = {"choices": [{"logprobs": {"top_logprobs": [{"a": -0.1}]}}]}
        else:
            prompts = body["prompt"] if isinstance(body["prompt"], list) else [body["prompt"]]
            out = {"choices": [{"text": f" {p} {k}"} for p in prompts for k in range(body["n"])]}
        data = json.dumps(out).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


def test_http_backend():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        b = models.HttpBackend(f"http://127.0.0.1:{server.server_port}")
        assert b.takes_batches("m")
        assert b.complete(["p", "q"], ["1", "2"], "m", models.Options(n=2)) == [[" p 0", " p 1"], [" q 0", " q 1"]]
        assert models.HttpBackend(b.url, batched=False).complete(["p"], ["1"], "m", models.Options(n=2)) == [[" p 0", " p 1"]]
        assert b.chat([[{"role": "user", "content": "x"}]], ["1"], "m", models.Options(n=2)) == [["t0.7", "t0.7"]]
        assert b.logprobs(["p"], ["1"], "m", models.Options()) == [[{"a": -0.1}]]
        assert b.rewards([[{"role": "user", "content": "x"}]], "m") == [[0.9, 0.8]]
    finally:
        server.shutdown()
    assert models.HttpBackend("http://127.0.0.1:9", retries=0).rewards([[]], "m") == [None]


def test_chunks():
    with pytest.raises(ValueError, match="1300"):
        ingest.chunk_texts(["x"], 1034, 1000)
    with pytest.raises(ValueError, match="larger than the chunk size"):
        ingest.chunk_texts(["x"], 1034, 5)
    with pytest.raises(TypeError):
        ingest.chunk_texts(5, 4096, 50)
    text = "word " * 300
    out = ingest.chunk_texts(text, 4096, 50)
    assert len(out) > 1
    assert all(len(c) <= 260 + 100 + 50 for c in out)
    assert set(" ".join(out).split()) == {"word"}


def element(kind, text=None, page=1, **more):
    return {"type": kind, **({"text": text} if text is not None else {}), **({"prov": [{"page": page}]} if page else {}), **more}


WORDS = lambda n, w="w": " ".join([w] * n)


def test_elements_are_formatted_by_their_kind():
    book = [element("page-header", "no"), element("subtitle-level-1", "Deep Title"), element("meta-data", "META"), element("subtitle-level-1", "Part"), element("title", "Name"), element("paragraph", "1 Intro. Text. More"), element("caption", "cap"), element("footnote", "foot"), element("reference", "ref"), element("equation", "e = 1. x")]
    assert ingest.fold_elements(book, [], 500) == ["# Title: **Deep Title**\n\n## **Part**\n\n# **Name**\n\n**1 Intro** Text. More\n\ne = 1. x"]


def test_a_budget_is_looked_at_before_an_element_is_added():
    a, b, c = WORDS(50, "a"), WORDS(50, "b"), WORDS(5, "c")
    # 65 + 65 tokens reach 100 when c comes: a is a chunk, b goes on, as it alone does not reach it.
    assert ingest.fold_elements([element("paragraph", t) for t in (a, b, c)], [], 100) == [a, f"{b}\n\n{c}"]
    big = WORDS(100, "d")  # 130 tokens: a chunk of its own
    assert ingest.fold_elements([element("paragraph", t) for t in (a, big, c)], [], 100) == [a, big, c]
    assert ingest.fold_elements([element("paragraph", t) for t in (big, c)], [], 100) == [f"{big}\n\n{c}"]
    assert ingest.fold_elements([element("paragraph", t) for t in (a, b)], [], 100) == [f"{a}\n\n{b}"]
    assert ingest.fold_elements([element("paragraph", t) for t in ("x y", "z")], [], 2, count=len) == ["x y\n\nz"]
    # What was emitted before is not emitted last.
    assert ingest.fold_elements([element("paragraph", t) for t in (c, c, big, c)], [], 12) == [c, c, big]


def test_pages_criteria_and_the_end():
    book = [element("paragraph", "a", 1), element("paragraph", "b", 2), element("caption", "c", 3), element("paragraph", "d", 3), element("paragraph", "e", None)]
    assert ingest.fold_elements(book, [], 500, by_page=True) == ["a", "b\n\nd\n\ne"]
    assert ingest.fold_elements(book, [], 500, criteria=lambda t: t in "bd") == ["a", "b", "d\n\ne"]
    for end in ("## References", "see ## Acknowledgements"):
        assert ingest.fold_elements([*book[:1], element("paragraph", end), element("paragraph", "gone")], [], 500) == ["a"]
    assert ingest.fold_elements([element("subtitle-level-1", "References"), element("paragraph", "kept")], [], 500) == ["# Title: **References**\n\nkept"]
    assert ingest.fold_elements([], [], 500) == []


def cells(*rows):
    return {"data": [[{"text": c} for c in r] for r in rows]}


def test_tables_are_ruled_above_and_numbers_stand_right():
    assert ingest.table_text(cells(["a", "b"], ["long", "2"])) == "|------|---|\n| a    | b |\n| long | 2 |"
    assert ingest.table_text(cells(["x", "1"], ["y", "20"])) == "|---|----|\n| x |  1 |\n| y | 20 |"
    assert ingest.table_text(cells(["x", "1"], ["y", "20.25"])) == "|---|-------|\n| x |  1    |\n| y | 20.25 |"
    assert ingest.table_text(cells(["a", "b"])) == ingest.table_text(cells(["a"], ["b"])) == ingest.table_text(None) == ""
    assert ingest.table_text(cells(["a", "b"], ["c", "d"]) | {"text": "cap"}).endswith("| c | d |\nCaption: cap\n")


@pytest.mark.parametrize(("pages", "expected"), [((1, None, 1), 1), ((1, None, 2), 2), ((1, None, None), 1), ((None, None, 3), 3), ((None, None, None), None), ((1, 4, 2), 4)])
def test_a_table_has_the_page_around_it(pages, expected):
    assert ingest.page_of([element("paragraph", "x", p) for p in pages], 1) == expected


def test_folded_documents(spark, tmp_path):
    book = {"main-text": [element("subtitle-level-1", "Title"), element("paragraph", "one two three"), {"type": "page-footer", "text": "no"}, {"type": "table", "$ref": "#/tables/0"}, element("paragraph", "four", 2), element("paragraph", "## References"), element("paragraph", "gone")], "tables": [{"text": "cap", "data": [[{"text": "a"}, {"text": "b"}], [{"text": "1"}, {"text": "2"}]]}]}
    (tmp_path / "x.json").write_text(json.dumps(book, indent=1))
    parsed = files.read_parsed(spark, f"file://{tmp_path}")
    out = [r["text"] for r in ingest.folded(parsed, by_page=True).orderBy("place").collect()]
    assert out == ["# Title: **Title**\n\none two three", "|---|---|\n| a | b |\n| 1 | 2 |\nCaption: cap\n\n\nfour"]
    config = {"document_outline": "o", "domain": "d", "seed_examples": [{"context": "c", "questions_and_answers": [{"question": f"q{k}", "answer": f"a{k}"} for k in range(3)]}] * 2}
    seeds = ingest.seeds_from_parsed(parsed, config, min_tokens=1)
    assert [(r["document_title"], r["example"], r["icl_response_3"]) for r in seeds.orderBy("example").collect()] == [("x", 0, "a2"), ("x", 1, "a2")]
    assert seeds.first()["document"].count("\n") > 5
    assert ingest.seeds_from_parsed(parsed, config, min_tokens=1, count=lambda t: 0).count() == 0
    with pytest.raises(ValueError, match="three"):
        ingest.seed_examples({"seed_examples": [{"context": "c", "questions_and_answers": []}]})


def test_only_long_seed_texts_are_chunked(spark):
    element_ = "struct<type: string, text: string, `$ref`: string, prov: array<struct<page: int>>>"
    rows = [(name, [("paragraph", " ".join(f"{name}{k}" for k in range(n)), None, [(1,)])], []) for name, n in (("short.json", 700), ("long.json", 1500))]
    parsed = spark.createDataFrame(rows, f"file string, elements array<{element_}>, tables array<struct<text: string, data: {files.CELL}>>")
    config = {"document_outline": "o", "domain": "d", "seed_examples": [{"context": "c", "questions_and_answers": [{"question": "q", "answer": "a"}] * 3}]}
    out = ingest.seeds_from_parsed(parsed, config, split_over=1024, words=400)
    counts = {r["document_title"]: r["count"] for r in out.groupBy("document_title").count().collect()}
    assert counts["short"] == 1
    assert counts["long"] > 1


def test_taxonomy(spark, tmp_path):
    k, s = tmp_path / "knowledge" / "x" / "qna.yaml", tmp_path / "compositional_skills" / "y" / "qna.yaml"
    files.write_yaml({"domain": "d", "document": {"repo": "r"}, "document_outline": "o", "seed_examples": [{"context": "c", "questions_and_answers": [{"question": "q", "answer": "a"}] * 3}]}, k)
    files.write_yaml({"task_description": "t", "seed_examples": [{"question": "q", "answer": "a"}]}, s)
    leaves = files.read_taxonomy(spark, str(tmp_path), documents=lambda _: ["some text " * 30])
    knowledge, skills = ingest.leaf_samples(leaves)
    assert knowledge.first()["icl_query_3"] == "q"
    assert skills.first()["taxonomy_path"] == "compositional_skills->y"
    assert files.check_leaf({"seed_examples": [{"question": "q"}]})


def test_recipes(spark, tmp_path):
    rows = [{"id": str(k), "messages": [{"role": "user", "content": "u"}], "metadata": '{"a":1}', "x": k} for k in range(8)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    recipe = mix.Recipe().add(f"file://{tmp_path}/a.jsonl", 0.5).add(f"file://{tmp_path}/a.jsonl")
    recipe.system = "Be kind."
    recipe.save(tmp_path / "r.yaml")
    again = mix.Recipe(tmp_path / "r.yaml")
    out = again.mixed(spark).collect()
    assert len(out) == 12
    assert all([m["role"] for m in r["messages"]] == ["system", "user"] and set(json.loads(r["metadata"])) == {"a", "x"} for r in out)
    again.save_mixed(spark, f"file://{tmp_path}/out")
    assert files.read_folder(spark, f"file://{tmp_path}/out").count() == 12
    assert files.read_folder(spark, f"file://{tmp_path}/none") is None


def test_raft_counts_and_order(spark):
    ctx = [(str(k), f"c{k % 7}", [("user", "Q"), ("assistant", "A")], '{"dataset":"x"}') for k in range(60)]
    df = spark.createDataFrame(ctx, "id string, context string, messages array<struct<role:string,content:string>>, metadata string")
    for r in convert.raft(df, 0.5).collect():
        text, own = r["messages"][0]["content"], f"c{int(r['id']) % 7}"
        docs = [p for p in text.split("\n") if p.startswith("c")]
        assert len(docs) == len(set(docs)) == 4
        assert text.endswith("Q")
        assert r["metadata"] == '{"dataset":"x_raft_p0.5"}'
        assert docs.count(own) <= 1
    alone = convert.raft(df.limit(1), 0.0).first()
    assert "c0" in alone["messages"][0]["content"]


def test_raft_takes_what_stands_ahead_on_the_ring(spark):
    """Against the ring walked in Python, over more runs than one, with copies and few contexts; what rows take is not grouped by row."""
    import hashlib

    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    for n, some in ((700, 311), (40, 64), (40, 4), (10, 2), (5, 1)):
        rows = [(str(k), f"c{k % some}", [("user", "Q"), ("assistant", "A")], "{}") for k in range(n)]
        df = spark.createDataFrame(rows, "id string, context string, messages array<struct<role:string,content:string>>, metadata string")
        ring = sorted({r[1] for r in rows}, key=lambda c: hashlib.md5(c.encode()).hexdigest())
        want = {}
        for i, own, *_ in rows:
            mine, start = number(f"raft|{i}") % 1_000_000 < 400_000, number(f"raft-start|{i}") % len(ring)
            ahead = [ring[(start + k) % len(ring)] for k in range(min(5, len(ring)))]
            picks = [c for c in ahead if c != own][: 3 if mine else 4]
            picks = [*picks, own] if mine or not picks else picks
            want[i] = "\n".join(f"Document:\n{c}\n\n" for c in sorted(picks, key=lambda c: hashlib.md5((i + c).encode()).hexdigest())) + "\n\nQ"
        out = convert.raft(df, 0.4)
        assert {r["id"]: r["messages"][0]["content"] for r in out.collect()} == want, (n, some)
        assert "Aggregate [id#" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_auxiliary_of_documents_that_are_their_own_source(spark):
    rows = [(1, "s", "raw", "summary_detailed"), (2, "x", "x", "summary_detailed"), (3, "x", "y", "summary_detailed"), (4, "z", None, "summary_detailed")]
    df = spark.createDataFrame(rows, "doc_id long, document string, raw_document string, dataset_type string").selectExpr("*", "'d' as domain", "'o' as document_outline")
    asked = {r["messages"][1]["content"]: r["messages"][0]["content"] for r in convert.auxiliary(df, ["doc_id"]).collect()}
    assert asked["s"].startswith("raw\n\n") and asked["x"].startswith("x\n\n") and asked["z"] is None


def test_multiple_choice(spark):
    df = spark.createDataFrame([("Which?\nA) a\nB) b\nC) c\nD) d", "B) b", "s"), ("Which?\nA) a", "A) a", "s"), ("none", "x", "s")], "mmlubench_question string, mmlubench_answer string, domain string")
    out = convert.multiple_choice(df, evaluation=True).collect()
    assert [(r["question"], r["choices"], r["answer"], r["subject"]) for r in out] == [("Which?", ["a", "b", "c", "d"], 1, "s")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"a": "x"}\n{"a": "y"}\n')
    run = lambda: generate_stream(spark, f"file://{tmp_path}/in", "a string", [Step("DuplicateColumns", {"columns_map": {"a": "b"}})], f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    run()
    (tmp_path / "in" / "2.jsonl").write_text('{"a": "z"}\n')
    run()
    assert sorted(r["b"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["x", "y", "z"]


@dataclass(frozen=True)
class Thinker(models.StubBackend):
    """Says the steps of a script by the number of answers before; a step after the script is its last."""

    script: tuple = ()

    def chat(self, messages, ids, model, options):
        k = [sum(m["role"] == "assistant" for m in row) for row in messages]
        return [[self.script[min(i, len(self.script) - 1)]] for i in k]


def step(action, then, sure=0.9, content="c"):
    return json.dumps({"current_action": action, "title": "t", "content": content, "confidence": sure, "next_action": then})


@pytest.mark.parametrize(("script", "expected"), [
    ((step("think", "think"),), None),  # never ends: bounded
    ((step("generate", "terminate", content="x"), step("reflect", "terminate"),), "x"),  # must reflect first
    ((step("think", "generate", 0.2),), None),  # never sure
    (("not json",), None),
    ((step("reflect", "terminate"), step("generate", "terminate", content="y")), "y"),
])
def test_reasoning_is_bounded_and_reflects(spark, script, expected):
    df = spark.createDataFrame([("p",)], "p string")
    assert models.reason(df, "p", "r", Thinker(script=script), max_steps=6).first()["r"] == expected


def test_files(tmp_path):
    files.write_json({"a": 1}, tmp_path / "x" / "a.json")
    assert files.read_json(tmp_path / "x" / "a.json") == {"a": 1}
    files.write_json("raw", tmp_path / "b.txt")
    with pytest.raises(ValueError, match="can't be written"):
        files.write_json(1, tmp_path / "c.json")
    files.evaluation_task("t", "d.jsonl", tmp_path / "t.yaml")
    assert set(files.read_yaml(tmp_path / "t.yaml")) == {"task", "dataset_kwargs", "include", "group"}
    assert files.model_family(None, "/m/Base-8b", {"base": "plain"}, "other") == "plain"
    assert files.model_family(None, "/m/New", {"base": "plain"}, "base") == "plain"
    with pytest.raises(ValueError, match="unknown"):
        files.model_family("none", "/m/x", {}, "base")


def test_catalog_has_sql_for_all():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
