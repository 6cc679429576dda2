import copy
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from embervane import cli
from embervane.errors import ConfigError, EmbervaneError, InvalidInput, JsonError, ModelError, SourceError, TensorError
from embervane.operators import encoder
from embervane.operators.embed import Embedder, vectors
from embervane.options import EmbedOptions
from embervane.plans import index as plan
from embervane.sources import files, model, safetensors
from embervane.sources.store import ChunkStore, shared_folder, upsert
from embervane.streaming import edge

TOKENS = "[PAD] [UNK] [CLS] [SEP] [MASK] hello world rust embedding machine learning semantic search the ##s ##ing a . !".split()
CONFIG = model.ModelConfig(len(TOKENS), 8, 2, 2, 16, 32)
DISTIL = model.ModelConfig(len(TOKENS), 8, 2, 2, 16, 32, model_type="distilbert")
TEXTS = ["hello world", "rust embedding semantic search!", "the machines learning", "", "unknown words here", "hello " * 60]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = str(tmp_path_factory.mktemp("model"))
    model.write_folder(out, CONFIG, TOKENS, model.seeded(CONFIG))
    return out


@pytest.fixture(scope="module")
def embedder(folder):
    return Embedder.load(folder)


def slow_vector(tensors, config, ids, pooling="mean", normalize=True, uniform=False):
    """The encoder in float64 with plain loops, without padding, straight from the named tensors."""
    distil = config.model_type == "distilbert"
    pre = "distilbert." if distil else ""
    w = {k: np.asarray(v, float) for k, v in tensors.items()}
    eps, h, heads = config.layer_norm_eps, config.hidden_size, config.num_attention_heads
    d = h // heads

    def norm(x, name):
        m = sum(x) / h
        var = sum((a - m) ** 2 for a in x) / h
        return np.array([(a - m) / math.sqrt(var + eps) * g + b for a, g, b in zip(x, w[f"{name}.weight"], w[f"{name}.bias"])])

    def linear(x, name):
        return np.array([sum(a * b for a, b in zip(x, row)) + c for row, c in zip(w[f"{name}.weight"], w[f"{name}.bias"])])

    x = []
    for p, i in enumerate(ids):
        e = w[f"{pre}embeddings.word_embeddings.weight"][i] + w[f"{pre}embeddings.position_embeddings.weight"][p]
        if not distil:
            e = e + w["embeddings.token_type_embeddings.weight"][0]
        x.append(norm(e, f"{pre}embeddings.LayerNorm"))
    names = model._DISTIL if distil else model._BERT
    for n in range(config.num_hidden_layers):
        at = {k: f"{pre}{'transformer' if distil else 'encoder'}.layer.{n}.{v}" for k, v in names.items()}
        q, k, v = ([linear(r, at[c]) for r in x] for c in "qkv")
        out = []
        for i in range(len(x)):
            row = np.zeros(h)
            for a in range(heads):
                part = slice(a * d, (a + 1) * d)
                s = [0.0 if uniform else float(q[i][part] @ k[j][part]) / math.sqrt(d) for j in range(len(x))]
                e = [math.exp(y - max(s)) for y in s]
                row[part] = sum(y / sum(e) * v[j][part] for j, y in enumerate(e))
            out.append(norm(x[i] + linear(row, at["o"]), at["attention"]))
        x = []
        for r in out:
            up = np.array([0.5 * y * (1 + math.tanh(0.7978846 * (y + 0.044715 * y**3))) for y in linear(r, at["up"])])
            x.append(norm(r + linear(up, at["down"]), at["output"]))
    pooled = x[0] if pooling == "cls" else sum(x) / len(x)
    return pooled / max(math.sqrt(sum(pooled**2)), 1e-12) if normalize else pooled


@pytest.mark.parametrize("config", [CONFIG, DISTIL])
@pytest.mark.parametrize("pooling,normalize", [("mean", True), ("cls", False)])
def test_kernel_equals_a_plain_loop(config, pooling, normalize):
    tensors = model.seeded(config)
    own = Embedder(config, Embedder.from_bytes(json.dumps({**vars(CONFIG)}).encode(), "\n".join(TOKENS).encode(), safetensors.write(model.seeded(CONFIG))).vocab, safetensors.SafeTensors(safetensors.write(tensors)))
    options = EmbedOptions(16, pooling, normalize)
    got = own.embed(TEXTS, options)
    for text, v in zip(TEXTS, got):
        ids = [own.vocab.cls_id, *own.token_ids(text, 16), own.vocab.sep_id]
        np.testing.assert_allclose(v, slow_vector(tensors, config, ids, pooling, normalize), atol=2e-5)


@pytest.mark.parametrize("scale", [1, 40])
def test_attention_holds_a_few_rows_of_weights(scale, monkeypatch):
    """Whatever the batch, no more than ``CELLS`` weights are held at a time, by the table of powers as by numpy's exp; the first token alone is the same."""
    import tracemalloc

    config = model.ModelConfig(30, 16, 2, 4, 32, 64)
    weights = model.assemble(config, safetensors.SafeTensors(safetensors.write(model.seeded(config))))
    layer = copy.deepcopy(weights.layers[0])
    rng = np.random.default_rng(3)
    x, mask = rng.normal(size=(64, 64, 16)), (np.arange(64)[None, :] < rng.integers(1, 65, 64)[:, None]).astype(int)
    for name in ("q", "q_bias"):
        setattr(layer, name, getattr(layer, name).astype(float) * scale)
    monkeypatch.setattr(encoder, "CELLS", 1 << 13)
    tracemalloc.start()
    got = encoder.attention(x, mask, layer, 4)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 10 * x.nbytes < 64 * 4 * 64 * 64 * 8  # all weights would be more
    split = lambda m, b: (x @ m + b).reshape(64, 64, 4, 4).swapaxes(1, 2)
    q, k, v = split(layer.q, layer.q_bias), split(layer.k, layer.k_bias), split(layer.v, layer.v_bias)
    e = q @ k.swapaxes(2, 3) / 2 + np.where(mask == 0, -1e4, 0)[:, None, None, :]
    e = np.exp(e - e.max(-1, keepdims=True))
    want = (e / e.sum(-1, keepdims=True) @ v).swapaxes(1, 2).reshape(64, 64, 16) @ layer.o + layer.o_bias
    np.testing.assert_allclose(got, want, atol=1e-11)
    np.testing.assert_allclose(encoder.attention(x, mask, layer, 4, first=True), want[:, :1], atol=1e-11)


def test_exp_of_steps():
    z = np.concatenate([np.linspace(-44, 44, 100_001), [0.0, -0.0]])
    np.testing.assert_allclose(encoder.exp_of_steps(z / encoder._UNIT, np.empty_like(z), np.empty_like(z), np.empty(len(z), np.int64)), np.exp(z), rtol=1e-13)


def test_attention_matters(embedder):
    """The comparison above would notice broken attention: with uniform weights the vectors are others."""
    tensors = model.seeded(CONFIG)
    ids = [embedder.vocab.cls_id, *embedder.token_ids(TEXTS[1], 16), embedder.vocab.sep_id]
    assert np.abs(slow_vector(tensors, CONFIG, ids) - slow_vector(tensors, CONFIG, ids, uniform=True)).max() > 1e-3


def test_column_equals_driver(spark, embedder):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])]
    df = embedder.with_embeddings(spark.createDataFrame(rows, "i int, text string"), options=EmbedOptions(16))
    got = {r.i: r.embedding for r in df.collect()}
    assert got[len(TEXTS)] is None
    for i, v in enumerate(embedder.embed(TEXTS, EmbedOptions(16))):
        np.testing.assert_allclose(got[i], v, atol=1e-6)
        assert np.linalg.norm(got[i]) == pytest.approx(1, abs=1e-4)


def test_padding_changes_nothing(embedder):
    ids = np.array([[2, 5, 6, 3]])
    wide = np.pad(ids, ((0, 0), (0, 20)))
    mask = (np.arange(24) < 4).astype(int)[None]
    a = encoder.encode(embedder.weights, CONFIG, ids, np.ones_like(ids))
    b = encoder.encode(embedder.weights, CONFIG, wide, mask)
    np.testing.assert_allclose(a, b[:, :4], atol=2e-6)


def test_options(embedder):
    assert len(embedder.embed([])) == 0 and vectors(embedder, [], EmbedOptions()).shape == (0, 8)
    for n in (0, 1, 33):
        with pytest.raises(InvalidInput):
            embedder.embed(["x"], EmbedOptions(n))
    with pytest.raises(InvalidInput):
        EmbedOptions(pooling="max")
    assert EmbedOptions().with_max_length(5).with_pooling("cls").with_normalize(False) == EmbedOptions(5, "cls", False)
    for bad in (np.zeros((0, 3), int), np.zeros((1, 33), int), np.array([[99]])):
        with pytest.raises(InvalidInput):
            encoder.embed_tokens(embedder.weights, CONFIG, bad)


@pytest.mark.parametrize("dtype,tolerance", [("F32", 0), ("F16", 1e-3), ("BF16", 1e-2)])
def test_safetensors(spark, dtype, tolerance):
    tensors = {"a": np.array([[1.0, -2.5], [3.25, 0.1]], np.float32), "b": np.zeros(0, np.float32)}
    back = safetensors.SafeTensors(safetensors.write(tensors, dtype))
    assert back.names() == ["a", "b"] and back.tensor("b").shape == (0,)
    np.testing.assert_allclose(back.tensor("a"), tensors["a"], rtol=tolerance)
    assert [r.shape for r in back.table(spark).orderBy("name").collect()] == [[2, 2], [0]]


def header(h, body=b""):
    raw = json.dumps(h).encode() if not isinstance(h, bytes) else h
    return struct.pack("<Q", len(raw)) + raw + body


def test_broken_safetensors(tmp_path):
    for raw in (b"abc", struct.pack("<Q", 99) + b"{}", header(b"{x")):
        with pytest.raises(ModelError):
            safetensors.SafeTensors(raw)
    info = {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}
    cases = [(info, b"1234", ModelError), (info | {"dtype": "I64"}, b"12345678", ModelError), (info | {"shape": [3]}, b"12345678", TensorError)]
    for i, body, error in cases:
        with pytest.raises(error):
            safetensors.SafeTensors(header({"__metadata__": {}, "x": i}, body)).tensor("x")
    with pytest.raises(SourceError):
        safetensors.SafeTensors.read(str(tmp_path / "none"))
    path = tmp_path / "m"
    path.write_bytes(safetensors.write({"x": np.ones(3)}))
    assert safetensors.SafeTensors.read(str(path), mapped=True).tensor("x").tolist() == [1, 1, 1]


def test_configs(tmp_path, folder):
    good = {k: v for k, v in vars(CONFIG).items() if v is not None}
    assert model.ModelConfig.parse(json.dumps(good | {"more": 1})) == CONFIG and CONFIG.is_bert and CONFIG.head_dim == 4
    for change in ({"hidden_size": 0}, {"num_attention_heads": 0}, {"num_attention_heads": 3}, {"vocab_size": "x"}):
        with pytest.raises(ConfigError):
            model.ModelConfig.parse(json.dumps(good | change))
    for raw in ("{", "[]"):
        with pytest.raises(JsonError):
            model.ModelConfig.parse(raw)
    with pytest.raises(ConfigError, match=r"config\.json"):
        Embedder.load(str(tmp_path))
    tensors = model.seeded(CONFIG)
    gone = {k: v for k, v in tensors.items() if k != "encoder.layer.1.output.dense.bias"}
    wrong = tensors | {"encoder.layer.0.attention.self.key.weight": np.zeros((8, 7))}
    for bad in (gone, wrong):
        with pytest.raises(ModelError):
            model.assemble(CONFIG, safetensors.SafeTensors(safetensors.write(bad)))
    prefixed = {f"bert.{k}": v for k, v in tensors.items()}
    w = model.assemble(CONFIG, safetensors.SafeTensors(safetensors.write(prefixed)))
    np.testing.assert_array_equal(w.layers[0].q.T, tensors["encoder.layer.0.attention.self.query.weight"])


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "docs"
    made = {"a.txt": "the machine learning. " * 120, "a/b.md": "rust embedding semantic search", "a-b/c.md": "hello world", ".h/f.md": "hidden hello", "_e.txt": "the world", "d e.txt": "hello", "empty.md": "  ", "x.TXT": "no", "y.rs": "no"}
    for name, text in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_files(spark, tree):
    names = [p for _, p in files.list_files(str(tree))]
    assert names == [".h/f.md", "_e.txt", "a/b.md", "a-b/c.md", "a.txt", "d e.txt", "empty.md"]
    assert {r.path for r in files.read_files(spark, str(tree)).collect()} == set(names)
    assert [p for _, p in files.list_files(str(tree), recursive=False)] == ["_e.txt", "a.txt", "d e.txt", "empty.md"]
    assert files.list_files(str(tree / "a.txt"))[0][1] == "a.txt"
    assert {r.path for r in files.read_tree(spark, str(tree)).collect()} == {"a/b.md", "a-b/c.md", "a.txt", "d e.txt", "empty.md"}
    assert {r.path for r in files.read_tree(spark, f"file://{tree}", False).collect()} == {"a.txt", "d e.txt", "empty.md"}
    assert files.is_remote("s3a://bucket/x") and files.is_remote("hdfs://x") and not files.is_remote("/tmp/x") and not files.is_remote("file:///tmp")
    with pytest.raises(SourceError):
        files.list_files(str(tree / "none"))
    with pytest.raises(InvalidInput):
        files.list_files(str(tree / "y.rs"))
    (tree / "bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match=r"bad\.md"):
        files.read_files(spark, str(tree)).collect()


def test_index_and_search(spark, tree, folder, tmp_path, capsys):
    data = str(tmp_path / "store")
    spark_run = lambda *a: cli.run(cli.parser().parse_args(["--data-dir", data, *a]), spark)
    spark_run("init", "--model-dir", folder)
    store = ChunkStore(spark, data)
    with pytest.raises(InvalidInput, match="empty"):
        spark_run("search", "rust")
    assert spark_run("index", str(tree)) == ["indexed 7 chunks"]  # a.txt has two, empty.md none
    lines = spark_run("search", "rust embedding semantic search", "--top-k", "3")
    assert len(lines) == 3 and lines[0].startswith("#0 score=1.0000 path=a/b.md chunk=0 text=rust")
    with pytest.raises(EmbervaneError):
        spark_run("index", str(tree / "none"))
    assert store.count() == 7  # a failure leaves the index
    assert cli.main(["--data-dir", str(tmp_path / "other"), "search", "x"]) == 1 and "error" in capsys.readouterr().err
    assert plan.resolve_model_dir(store, None) == folder
    with pytest.raises(ConfigError):
        plan.validate_model_dir(str(tmp_path))


def test_index_from_any_file_system(spark, tree, folder, tmp_path, monkeypatch):
    """A root with a scheme is listed and read by Spark; the machine's own stands for one."""
    monkeypatch.setattr(plan, "is_remote", lambda root: True)
    store, model = ChunkStore(spark, str(tmp_path / "s")), Embedder.load(folder)
    assert plan.index_directory(spark, f"file://{tree}", store, model) == 5 and {r.path for r in store.chunks().collect()} == {"a.txt", "a/b.md", "a-b/c.md", "d e.txt"}


def test_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert store.get_meta("a") is None and store.count() == 0
    store.set_meta("a", "1")
    store.set_meta("a", "2")
    store.set_meta("b", "3")
    assert store.get_meta("a") == "2" and store.meta().count() == 2
    row = spark.createDataFrame([("p", 0, "t", [1.0])], "path string, chunk_index int, text string, embedding array<double>")
    store.replace_chunks(row)
    store.append_chunks(row)
    assert store.count() == 2
    store.replace_chunks(store.chunks().limit(1))  # reads what it replaces
    assert store.count() == 1
    store.clear_chunks()
    assert store.count() == 0
    old, new = (spark.createDataFrame(x, "key string, value string") for x in ([("a", "1"), ("b", "2")], [("b", "9"), ("c", "3")]))
    assert sorted(map(tuple, upsert(old, new, "key").collect())) == [("a", "1"), ("b", "9"), ("c", "3")]


REQUESTS = [
    (1, "GET", '{"text": "hello"}', 405), (2, "POST", "{no", 400), (3, "POST", '{"text": " "}', 400), (4, "POST", '{"text": 5}', 400),
    (5, "POST", "[]", 400), (6, "POST", None, 400), (7, None, '{"text": "x"}', 405), (8, "POST", '{"text": "hello world"}', 200), (9, "POST", '{"text": "5"}', 200),
]


def test_requests(spark, embedder):
    df = spark.createDataFrame([r[:3] for r in REQUESTS], "id int, method string, body string")
    got = {r.id: r for r in edge.respond(df, embedder).collect()}
    assert {i: r.status for i, r in got.items()} == {r[0]: r[3] for r in REQUESTS}
    assert json.loads(got[2].response) == {"error": "invalid JSON body"} and json.loads(got[8].response)["dim"] == 8


def test_streams(spark, embedder, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([r[:3] for r in REQUESTS], "id int, method string, body string").write.json(source)
    stream = spark.readStream.schema("id int, method string, body string").json(source)
    seen = {}

    def sink(df, batch):
        seen.update({r.id: r.status for r in df.collect()})

    q = edge.serve(stream, embedder, sink, str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert seen == {r[0]: r[3] for r in REQUESTS}
    texts = stream.select("id", F.col("body").alias("text"))
    q = edge.embed_stream(texts, embedder, str(tmp_path / "out"), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(REQUESTS)
