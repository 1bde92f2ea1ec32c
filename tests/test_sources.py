"""Readers of repositories, taxonomies and named sets; the command line against a server; folders and settings."""

import json
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from corpusloom.functions import text
from corpusloom.operators import models
from corpusloom.plans import convert, mix, run
from corpusloom.sources import files
from pyspark.sql import functions as F


def git(folder, *a):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", "-C", str(folder), *a], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    """A repository with two commits of documents, and a clone's folder."""
    source = tmp_path / "source"
    (source / "docs" / "deep").mkdir(parents=True)
    git(tmp_path, "init", "-q", "-b", "main", str(source))
    (source / "docs" / "a.md").write_text("first")
    (source / "docs" / "deep" / "b.MD").write_text("deep")
    (source / "docs" / "c.txt").write_text("no")
    git(source, "add", "-A")
    git(source, "commit", "-q", "-m", "one")
    first = subprocess.run(["git", "-C", str(source), "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()
    (source / "docs" / "a.md").write_text("second")
    git(source, "commit", "-q", "-a", "-m", "two")
    return source, first


def test_documents_of_a_commit_are_fetched_once(repo, tmp_path, monkeypatch):
    source, first = repo
    clones = []
    real = subprocess.run
    monkeypatch.setattr(files.subprocess, "run", lambda a, **k: (clones.append(a) if "clone" in a else None, real(a, **k))[1])
    want = {"repo": str(source), "commit": first, "patterns": ["docs/*.md", "docs/**/*.MD"]}
    assert files.fetch_documents(want, str(tmp_path / "out")) == ["first", "deep"]
    assert files.fetch_documents(want, str(tmp_path / "out")) == ["first", "deep"]
    assert len(clones) == 1
    assert files.fetch_documents({**want, "commit": "main"}, str(tmp_path / "out"))[0] == "second"
    with pytest.raises(ValueError, match="no documents"):
        files.fetch_documents({**want, "patterns": ["*.txt"]}, str(tmp_path / "out"))


LEAF = "seed_examples:\n- question: q\n  answer: a\n"


def test_changed_files_of_a_taxonomy(tmp_path, spark):
    root = tmp_path / "taxonomy"
    for name in ("knowledge/a", "knowledge/b", "compositional_skills/c", "other/d"):
        (root / name).mkdir(parents=True)
        (root / name / "qna.yaml").write_text(LEAF)
    git(tmp_path, "init", "-q", "-b", "main", str(root))
    git(root, "add", "-A")
    git(root, "commit", "-q", "-m", "one")
    git(root, "checkout", "-q", "-b", "mine")
    (root / "knowledge" / "b" / "qna.yaml").write_text(LEAF + "- question: q2\n  answer: a2\n")
    (root / "compositional_skills" / "c" / "qna.yaml").unlink()
    git(root, "commit", "-q", "-a", "-m", "two")
    for name in ("knowledge/new", "other/new"):
        (root / name).mkdir()
        (root / name / "qna.yml").write_text(LEAF)
    assert files.changed_files(str(root), "main") == ["knowledge/b/qna.yaml", "knowledge/new/qna.yml"]
    got = files.read_taxonomy(spark, str(root), "main").collect()
    assert [(r["taxonomy_path"], r["ordinal"]) for r in got] == [("knowledge->b", 0), ("knowledge->b", 1), ("knowledge->new", 0)]


def test_schema_of_taxonomy_files(tmp_path, spark):
    pair = {"question": "q", "answer": "a"}
    knowledge = {"version": 3, "created_by": "me", "domain": "d", "document_outline": "o", "document": {"repo": "r", "commit": "c", "patterns": ["*"]}, "seed_examples": [{"context": "c", "questions_and_answers": [pair] * 3}] * 5}
    skill = {"version": 2, "created_by": "me", "task_description": "t", "seed_examples": [pair] * 5}
    assert files.check_schema(knowledge, "knowledge/x/qna.yaml") == files.check_schema(skill, "compositional_skills/x/qna.yaml") == []
    assert files.check_schema(knowledge, "elsewhere/qna.yaml") == []
    wrong = {**knowledge, "version": "3", "document": {"repo": "r"}, "seed_examples": [{"questions_and_answers": [pair]}] * 4}
    found = files.check_schema({k: v for k, v in wrong.items() if k != "domain"}, "knowledge/x/qna.yaml")
    for part in ("domain is missing", "version is no", "4 of at least 5", "document.commit", "context is missing", "fewer than 3"):
        assert any(part in f for f in found), part
    path = tmp_path / "compositional_skills" / "x" / "qna.yaml"
    files.write_yaml({**skill, "seed_examples": [pair]}, path)
    assert files.read_taxonomy(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError, match="1 of at least 5"):
        files.read_taxonomy(spark, str(tmp_path), strict=True)


def test_resolvers_find_named_sets(spark, monkeypatch):
    monkeypatch.setitem(files.RESOLVERS, "hub", lambda s, name: s.range(3).withColumn("name", F.lit(name)))
    assert files.read_named(spark, "hub:org/set").first()["name"] == "org/set"


def test_all_pairs_are_in_the_report(spark):
    df = spark.range(250).selectExpr("id AS ordinal", "concat('t', id) AS t")
    report = files.side_by_side(df, df.where("ordinal < 240"), "t")
    assert report.count("## ") == 3 * 240
    assert report.index("## 239") > report.index("## 99")


class Server(BaseHTTPRequestHandler):
    """Counts probes and requests; batches only if `batched`."""

    batched, probes, sizes = True, 0, []

    def answer(self, out):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def do_GET(self):
        self.answer({"data": [{"id": "first-model"}, {"id": "second"}]})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        kind = type(self)
        if self.headers["X-Request-Id"] == "probe":
            kind.probes += 1
        else:
            kind.sizes.append(len(body["prompt"]) if isinstance(body["prompt"], list) else 1)
        prompts = body["prompt"] if isinstance(body["prompt"], list) else [body["prompt"]]
        if not kind.batched:
            prompts = prompts[:1]
        self.answer({"choices": [{"text": f"{body['model']} {p}"} for p in prompts for _ in range(body["n"])]})

    def log_message(self, *_):
        pass


@pytest.fixture(params=[True, False])
def server(request):
    kind = type("Own", (Server,), {"batched": request.param, "probes": 0, "sizes": []})
    s = HTTPServer(("127.0.0.1", 0), kind)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", kind
    s.shutdown()


def test_first_model_and_one_probe_a_server(spark, server):
    url, kind = server
    backend = models.HttpBackend(url, rows=3, workers=2)
    df = spark.range(0, 8, 1, 1).selectExpr("id", "concat('p', id) AS p")
    for _ in range(2):
        out = models.evaluate_once(models.complete(df, "p", "c", backend))
        assert {r["id"]: r["c"] for r in out.collect()} == {k: [f"first-model p{k}"] for k in range(8)}
    assert kind.probes == 1
    assert sorted(kind.sizes) == ([2, 2, 3, 3, 3, 3] if kind.batched else [1] * 16)


def test_command_line(spark, server, tmp_path, monkeypatch):
    url, _ = server
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"n": k, "doc": f"d{k}"}) + "\n" for k in range(6)))
    files.write_yaml({"system": "", "introduction": "", "principles": "", "examples": "", "generation": "{{ doc }}", "start_tags": [""], "end_tags": [""]}, tmp_path / "ask.yaml")
    files.write_yaml([{"block_type": "LLMBlock", "block_config": {"block_name": "ask", "config_path": str(tmp_path / "ask.yaml"), "output_cols": ["out"]}}], tmp_path / "flow.yaml")
    try:
        run.main(["--ds_path", f"file://{tmp_path}/in.jsonl", "--save_path", f"file://{tmp_path}/out", "--flow", str(tmp_path / "flow.yaml"), "--endpoint", url, "--bs", "2", "--checkpoint_dir", f"file://{tmp_path}/saved", "--dataset_start_index", "1", "--dataset_end_index", "5", "--work_dir", f"file://{tmp_path}/work"])
    finally:
        spark.conf.unset(models.WORK)
    out = files.read_folder(spark, f"file://{tmp_path}/out")
    assert {(r["n"], r["out"]) for r in out.collect()} == {(k, f"first-model d{k}") for k in range(1, 5)}
    assert (tmp_path / "work").is_dir()


class Session:
    """As much of a session as the choice of a folder looks at."""

    def __init__(self, master, **settings):
        self.sparkContext = self
        self.conf, self.master, self.applicationId = self, master, f"app-{master}"
        self.settings = settings

    def get(self, key, default):
        return self.settings.get(key, default)


def test_no_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            models.work_folder(Session(master))
        assert models.work_folder(Session(master, **{"spark.checkpoint.dir": "hdfs://x/"})) == "hdfs://x"
        assert models.work_folder(Session(master, **{"spark.checkpoint.dir": "hdfs://x/", models.WORK: "s3a://y"})) == "s3a://y"
    folder = models.work_folder(Session("local[4]"))
    assert folder.startswith("file://")
    assert models.work_folder(Session("local[4]")) == folder


def test_metadata_keeps_values_and_replaces_keys(spark):
    rows = [("1", '{"a": {"b": [1, "x", null]}, "s": "q\\"{}", "k": 1}', 5), ("2", None, None), ("3", "{}", 7)]
    df = spark.createDataFrame(rows, "id string, metadata string, k int").withColumn("messages", F.array().cast("array<struct<role:string,content:string>>"))
    got = {r["id"]: json.loads(r["metadata"]) for r in mix.with_metadata(df).collect()}
    assert got == {"1": {"a": {"b": [1, "x", None]}, "s": 'q"{}', "k": 5}, "2": {"k": None}, "3": {"k": 7}}
    for wrong in ("[1]", "text"):
        with pytest.raises(Exception):  # noqa: B017
            mix.with_metadata(spark.createDataFrame([("1", wrong, 5)], "id string, metadata string, k int").withColumn("messages", F.array().cast("array<struct<role:string,content:string>>"))).collect()


def test_training_mix_flags_and_shuffles(spark):
    rows = [(k, f"d{k}", "q?", "a", "dom", f"raw{k}", ("base_document", "summary_detailed")[k % 2], "o") for k in range(20)]
    df = spark.createDataFrame(rows, "n int, document string, question string, response string, domain string, raw_document string, dataset_type string, document_outline string")
    replay = spark.range(500).select(F.col("id").cast("string").alias("id"), F.array(convert.turn("user", F.lit("r"))).alias("messages"))
    out = convert.training_mix(df, ["n"], "on", replay=replay, order=["n"]).collect()
    own = [r for r in out if r["unmask"]]
    assert (len(own), len(out)) == (30, 60)
    assert sum(r["messages"][0]["content"] == "detailed thinking on" for r in own) == 20
    places = [k for k, r in enumerate(out) if r["unmask"]]
    assert places != list(range(30)) and max(places) > 35
    plain = convert.training_mix(df, ["n"], None, unmask=False, order=["n"]).collect()
    assert {r["messages"][0]["role"] for r in plain} == {"pretraining"}
    assert "unmask" not in convert.training_mix(df, ["n"], unmask=None).columns


def test_token_counters_can_be_exchanged(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    assert [r[0] for r in df.select(text.token_count("t", len)).collect()] == [5, None]
    assert [r[0] for r in df.select(text.token_count("t")).collect()][0] == 3


def test_command_line_with_answers_kept_and_filters_first(spark, server, tmp_path):
    url, kind = server
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"n": k, "doc": f"d{k % 3}"}) + "\n" for k in range(12)))
    files.write_yaml({"system": "", "introduction": "", "principles": "", "examples": "", "generation": "{{ doc }}", "start_tags": [""], "end_tags": [""]}, tmp_path / "ask.yaml")
    ask = {"block_type": "LLMBlock", "block_config": {"block_name": "ask", "config_path": str(tmp_path / "ask.yaml"), "output_cols": ["out"]}}
    only = {"block_type": "FilterByValueBlock", "block_config": {"block_name": "only", "filter_column": "doc", "filter_value": ["d0", "d1"], "operation": "operator.eq"}}
    files.write_yaml([ask, only], tmp_path / "flow.yaml")
    try:
        for k in range(2):
            run.main(["--ds_path", f"file://{tmp_path}/in.jsonl", "--save_path", f"file://{tmp_path}/out{k}", "--flow", str(tmp_path / "flow.yaml"), "--endpoint", url, "--answers", f"file://{tmp_path}/answers", "--quarantine", f"file://{tmp_path}/bad", "--rewrite", "--work_dir", f"file://{tmp_path}/work"])
    finally:
        spark.conf.unset(models.WORK)
    out = files.read_folder(spark, f"file://{tmp_path}/out1")
    assert {(r["n"], r["out"]) for r in out.collect()} == {(k, f"first-model d{k % 3}") for k in range(12) if k % 3 < 2}
    assert sum(kind.sizes) == 2  # two texts, however many rows and runs
