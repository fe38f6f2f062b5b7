import json
import logging

import numpy as np
import pytest

from codeatlas import cli, shared
from codeatlas import config as cfg
from codeatlas.functions import embedding as fe
from codeatlas.operators import graph
from codeatlas.plans import index
from codeatlas.streaming.upserts import upsert_stream


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    g()\n\ndef g():\n    pass\n")
    (src / "B.java").write_text("package p;\nclass B {\n  int f(int a) { return f(a); }\n  int f() { return 2; }\n}\n")
    (src / "bad.py").write_text("def broken():\0\n")
    return src


def test_build_search_and_rebuild(spark, tree, tmp_path):
    at = str(tmp_path / "index")
    stats = {r["metric"]: r["value"] for r in index.build(spark, str(tree), at).collect()}
    assert stats == {"total_chunks": 4, "vectors": 3, "nodes": 5, "edges": 5, "total_calls": 2}
    kept = index.table(spark, at, "vectors").filter("file_path like '%B.java'").first()
    assert "return 2" in kept["content"]
    hits = index.search(spark, at, kept["content"], 2).collect()
    assert hits[0]["file_path"].endswith("B.java") and hits[0]["similarity"] > 0.999 and [h["rank"] for h in hits] == [1, 2]
    (tree / "a.py").write_text("def h():\n    pass\n")
    again = {r["metric"]: r["value"] for r in index.build(spark, str(tree), at).collect()}
    assert again["vectors"] == 4  # what is gone from a file stays
    nodes, edges = index.table(spark, at, "nodes"), index.table(spark, at, "edges")
    start = graph.find_by_name(nodes, "B").first()["node_id"]
    assert graph.bfs(nodes, edges, start, 3).count() == 2


def test_unknown_languages_are_kept_whole(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.zig").write_text("const a = 1;")
    index.build(spark, str(tmp_path / "s"), str(tmp_path / "i"), extensions=["zig"])
    assert index.table(spark, str(tmp_path / "i"), "vectors").first()["content"] == "const a = 1;"


def test_stream_of_upserts(spark, tmp_path):
    schema = "file_path string, package_name string, class_name string, method_name string, content string, embedding array<float>, seq long"
    source = str(tmp_path / "in")
    spark.createDataFrame([("f", "", "", "m", "old", [1.0], 1), ("f", "", "", "m", "new", [2.0], 2)], schema).write.parquet(source)
    at = str(tmp_path / "i")
    upsert_stream(spark.readStream.schema(schema).parquet(source), at, str(tmp_path / "c")).awaitTermination()
    assert [r["content"] for r in index.table(spark, at, "vectors").collect()] == ["new"]


def vector_rows(spark, *rows):
    schema = "file_path string, package_name string, class_name string, method_name string, content string, embedding array<float>, seq long"
    return spark.createDataFrame([(f, "", "", "m", c, [1.0], i) for i, (f, c) in enumerate(rows)], schema)


def contents(spark, at):
    return {r["file_path"]: r["content"] for r in index.table(spark, at, "vectors").collect()}


def test_upserts_rewrite_only_the_buckets_they_touch(spark, tree, tmp_path):
    at = str(tmp_path / "i")
    index.build(spark, str(tree), at)
    index.upsert(spark, at, vector_rows(spark, *((f"f{i}", "old") for i in range(200))))
    before = index.folders(spark, at)
    index.upsert(spark, at, vector_rows(spark, ("f7", "first"), ("f7", "last")))
    after = index.folders(spark, at)
    assert after["nodes"] == before["nodes"] and after["edges"] == before["edges"]
    assert len(before["vectors"]) == len(after["vectors"]) == len(set(before["vectors"]) & set(after["vectors"])) + 1
    got = contents(spark, at)
    assert got["f7"] == "last" and [got[f"f{i}"] for i in range(200) if i != 7] == ["old"] * 199
    assert index.upsert(spark, at, vector_rows(spark).limit(0)) == index.version(spark, at) == 3
    versions = [p.name for p in (tmp_path / "i").iterdir() if not p.name.startswith(".")]
    assert sorted(v for v in versions if v.startswith("CURRENT")) == ["CURRENT-2", "CURRENT-3"]
    named = {f.split("/")[0] for n in (2, 3) for fs in index.folders(spark, at, n).values() for f in fs}
    assert {v for v in versions if not v.startswith("CURRENT")} == named


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    """At every step before the pointer's rename, and after it."""
    at = str(tmp_path / "i")
    index.upsert(spark, at, vector_rows(spark, ("f", "old")))

    def die(*_):
        raise KeyboardInterrupt

    for step in ("write", "point"):
        with monkeypatch.context() as m:
            m.setattr(index, step, die)
            with pytest.raises(KeyboardInterrupt):
                index.upsert(spark, at, vector_rows(spark, ("f", "new")))
        assert contents(spark, at) == {"f": "old"}
    with monkeypatch.context() as m:
        m.setattr(index, "clear", die)
        with pytest.raises(KeyboardInterrupt):
            index.upsert(spark, at, vector_rows(spark, ("f", "new")))
    assert contents(spark, at) == {"f": "new"}


def test_of_two_writers_the_second_has_to_run_again(spark, tmp_path):
    at = str(tmp_path / "i")
    index.upsert(spark, at, vector_rows(spark, ("f", "old")))
    seen = index.version(spark, at)
    index.upsert(spark, at, vector_rows(spark, ("g", "other")))
    with pytest.raises(index.Conflict):
        index.publish(spark, at, {"vectors": index.table(spark, at, "vectors").limit(0)}, seen)
    assert contents(spark, at) == {"f": "old", "g": "other"}


def test_cli(spark, tree, tmp_path, capsys):
    home, at = str(tmp_path / "home"), str(tmp_path / "i")
    assert cli.main([], spark) == 0 and cli.main(["semi", "--home", home], spark) == 0
    assert cli.main(["semi", "x", "--home", home, "-i", at], spark) == 1
    assert cli.main(["semi", "build", "--home", home, "-p", str(tree), "-o", at], spark) == 0
    assert cli.main(["semi", "call f", "--home", home, "-i", at, "-l", "1"], spark) == 0
    assert "Top 1 results for 'call f':" in capsys.readouterr().out
    assert cli.main(["graph", "MyClass", "--db-path", str(tmp_path / "none"), "-t", "dfs", "-r", "extends"], spark) == 0
    out = capsys.readouterr().out
    assert "Graph traversal results (2 nodes)" in out and "Total edges: 8" in out
    assert cli.main(["graph", "nobody", "--db-path", at], spark) == 0
    logging.getLogger("codeatlas").setLevel(logging.WARNING)


def test_config_is_written_and_read(tmp_path):
    home = str(tmp_path / "home")
    first = cfg.load(home)
    assert (first.embedding.model, first.embedding.batch_size, first.index_dir, first.top_k) == ("mock", 32, f"{home}/index", 5)
    assert cfg.load(home) == first
    (tmp_path / "home" / "config.yaml").write_text("# own\nembedding:\n  model: 'm'\n  modelName: n\n  embeddingDimension: 2048\n  modelPath: models/x\n  batchSize: 10\nindex:\n  directory: idx\nsearch:\n  topK: 0\n")
    own = cfg.load(home)
    assert own.embedding == cfg.Embedding("m", "n", 2048, f"{home}/models/x", None, 10) and own.index_dir == f"{home}/idx" and own.top_k == 1
    over = cfg.with_options(own, model="http://h", batch_size=-1, dimension=7)
    assert (over.model, over.model_name, over.dimension, over.batch_size) == ("http://h", "n", 7, 10)
    (tmp_path / "home" / "config.yaml").write_text("- not\n- a mapping\n")
    assert cfg.load(home) == cfg.Config.default(home)


def test_mock_vectors():
    v = np.array(fe.create("mock").vector("hello"), np.float32)
    assert len(v) == 768 and abs(np.linalg.norm(v) - 1) < 1e-4
    assert fe.create(None).vector("hello") == fe.create("MOCK").vector("hello") != fe.create("mock").vector("world")


def test_mock_equals_the_jvm_generator(spark):
    jvm = spark.sparkContext._jvm
    for text in ("", "hello", "Grüße \U0001f600", "x" * 500):
        assert jvm.java.util.Objects.hashCode(text) == fe.text_hash(text)
        r = jvm.java.util.Random(fe.text_hash(text))
        want = fe.unit(np.array([r.nextFloat() for _ in range(768)], np.float32) * np.float32(2) - np.float32(1))
        assert np.array_equal(fe.mock_vector(text), want)


def test_model_choice(tmp_path):
    assert [fe.create(m).kind for m in (None, "", " mock ", "http://a", "https://b", "unknown")] == ["mock", "mock", "mock", "http", "http", "mock"]
    assert fe.create("http://a").dimension == 1024 and fe.create("http://a", dimension=8).dimension == 8
    with pytest.raises(FileNotFoundError):
        fe.create("org/model", model_path=str(tmp_path / "none"))
    own = fe.create("org/model", model_path=str(tmp_path), local=lambda path: lambda text: [3.0, 4.0])
    assert own.kind == "local" and [round(x, 6) for x in own.vector("x")] == [0.6, 0.8]


def test_model_files(tmp_path):
    write = lambda name, x: ((tmp_path / name).parent.mkdir(exist_ok=True), (tmp_path / name).write_text(json.dumps(x)))
    assert fe.infer_dimension(str(tmp_path)) == 768 and fe.infer_dimension(str(tmp_path), 5) == 5
    write("1_Pooling/config.json", {"pooling_output_dimension": 12})
    assert fe.infer_dimension(str(tmp_path)) == 12
    write("sentence_transformers_config.json", {"sentence_embedding_dimension": 1536, "pooling_config": {"pooling_mode_cls_token": True, "normalize_embeddings": False}})
    assert fe.infer_dimension(str(tmp_path)) == 1536 and fe.pooling_arguments(str(tmp_path)) == {"pooling": "cls", "normalize": False}
    write("config.json", {"hidden_size": 1024.0, "type_vocab_size": 2})
    assert fe.infer_dimension(str(tmp_path)) == 1024 and fe.has_token_types(str(tmp_path))
    assert fe.preferred_engine(" ", " B ") == "B" and fe.preferred_engine("A", "B") == "A" and fe.preferred_engine(None, None) is None


def test_cut_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    kept, gone = shared.cut(spark.range(3), "kept"), shared.cut(spark.range(4), "gone")
    with shared.scratch(spark):
        assert shared.cut(spark.range(5), "inner").count() == 5
    shared.drop(gone, spark.range(1))
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["kept"] and kept.count() == 3


def onnx_lookup(table):
    """A graph that gives each token its row of table, written byte by byte: fields of the public protobuf schema."""
    varint = lambda x: bytes([x & 127 | 128]) + varint(x >> 7) if x > 127 else bytes([x])
    message = lambda n, b: varint(n << 3 | 2) + varint(len(b)) + b
    number = lambda n, x: varint(n << 3) + varint(x)
    value = lambda name, kind, dims: message(1, name) + message(2, message(1, number(1, kind) + message(2, b"".join(message(1, message(2, d)) for d in dims))))
    tensor = b"".join(number(1, d) for d in table.shape) + number(2, 1) + message(8, b"table") + message(9, table.astype("<f4").tobytes())
    node = message(1, b"table") + message(1, b"input_ids") + message(2, b"out") + message(4, b"Gather")
    ids = message(11, value(b"input_ids", 7, (b"b", b"s"))) + message(11, value(b"attention_mask", 7, (b"b", b"s")))
    graph = message(1, node) + message(2, b"g") + message(5, tensor) + ids + message(12, value(b"out", 1, (b"b", b"s", b"d")))
    return number(1, 8) + message(7, graph) + message(8, number(2, 13))


@pytest.fixture
def local_folder(tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    tokenizer = Tokenizer(WordLevel({"none": 0, "red": 1, "green": 2}, "none"))
    tokenizer.pre_tokenizer = Whitespace()
    at = tmp_path / "model"
    at.mkdir()
    tokenizer.save(str(at / "tokenizer.json"))
    (at / "model.onnx").write_bytes(onnx_lookup(np.array([[0, 0], [3, 0], [1, 4]], np.float32)))
    return at


def test_local_model(spark, tree, tmp_path, local_folder, capsys):
    own = fe.create("org/model", model_path=str(local_folder))
    assert own.kind == "local" and np.allclose(own.vector("red green"), np.array([4, 4]) / np.sqrt(32))
    for flag, want in (("cls_token", [3, 0]), ("max_tokens", [3, 4]), ("weightedmean_tokens", [5, 8]), ("mean_sqrt_len_tokens", [4, 4])):
        (local_folder / "sentence_transformers_config.json").write_text(json.dumps({"pooling_config": {f"pooling_mode_{flag}": True}}))
        assert np.allclose(own.vector("red green"), fe.unit(np.array(want, np.float32))), flag
    rows = fe.embed(spark.createDataFrame([(1, "green"), (2, "red")], "id long, text string"), "text", own).orderBy("id").collect()
    assert np.allclose(rows[1]["embedding"], [1, 0]) and len(rows[0]["embedding"]) == 2
    home, at = str(tmp_path / "home"), str(tmp_path / "i")
    options = ["--home", home, "-m", "org/model", "--model-path", str(local_folder)]
    assert cli.main(["semi", "build", "-p", str(tree), "-o", at, *options], spark) == 0
    assert cli.main(["semi", "red", "-i", at, *options, "--model-loader", "codeatlas.functions.local_model:load"], spark) == 0
    assert "results for 'red'" in capsys.readouterr().out
    logging.getLogger("codeatlas").setLevel(logging.WARNING)


def test_engine_fallback(local_folder, monkeypatch):
    from codeatlas.functions import local_model

    monkeypatch.setenv(local_model.ENGINE_VARIABLE, "NoSuchEngine")
    assert np.allclose(local_model.load(str(local_folder))("red"), [3, 0])
    assert np.allclose(local_model.load(str(local_folder), "cpu")("red"), [3, 0])
    tried = []

    def build(error):
        def of(engine):
            tried.append(engine)
            if engine:
                raise OSError("outer") from error
            return "default"

        return of

    assert [local_model.with_fallback(build(ValueError(m)), "X") for m in ("No PyTorch engine", "Model doesn't support specified engine: X", "Engine PyTorch is not available", "No matching engine")] == ["default"] * 4
    with pytest.raises(OSError, match="outer"):
        local_model.with_fallback(build(ValueError("disk full")), "X")
    assert tried == ["X", None] * 4 + ["X"] and local_model.with_fallback(build(None), None) == "default"


def test_http_service():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], self.headers["Content-Type"], body))
            self.send_response(500 if body["input"] == "fail" else 200)
            self.end_headers()
            self.wfile.write(b"broken" if body["input"] == "fail" else b'{"data": [{"embedding": [3.0, 4.0]}]}')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/embed"
        assert np.allclose(fe.create(url, "m", api_key="k").vector("text"), [0.6, 0.8])
        assert np.allclose(fe.create(url).vector(""), [0.6, 0.8])
        with pytest.raises(OSError, match="code 500: broken"):
            fe.create(url).vector("fail")
    finally:
        server.shutdown()
    kind = "application/json; charset=utf-8"
    assert seen[0] == ("Bearer k", kind, {"model": "m", "input": "text"}) and seen[1][0] is None
