"""Embedding models: a deterministic mock, an HTTP service, and local models by a callable that the caller brings."""

from __future__ import annotations

import http.client
import importlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.shared import share_code

#: Seconds to connect to a service, and to wait for what it sends (fixed values).
CONNECT_TIMEOUT, READ_TIMEOUT = 30, 60
MOCK_DIMENSION, HTTP_DIMENSION, LOCAL_DIMENSION = 768, 1024, 768
#: Constants of the 48-bit linear congruential generator that seeds the mock (fixed values).
MULTIPLIER, INCREMENT, MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1
#: Keys that may hold a model's dimension, in order (fixed values).
DIMENSION_KEYS = (
    "embedding_size", "embedding_dim", "hidden_size", "word_embed_proj_dim", "d_model", "model_dim", "projection_dim",
    "sentence_embedding_dimension", "pooling_output_dimension",
)
#: Flags of a pooling configuration and the mode each means (fixed values).
POOLING = {
    "pooling_mode_mean_tokens": "mean", "pooling_mode_max_tokens": "max", "pooling_mode_cls_token": "cls",
    "pooling_mode_mean_sqrt_len_tokens": "mean_sqrt_len", "pooling_mode_weightedmean_tokens": "weightedmean",
}


def text_hash(text: str) -> int:
    """Signed 32-bit polynomial hash (base 31) of the UTF-16 units."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32)
    powers = np.ones(len(units), np.uint32)
    if len(units) > 1:
        np.cumprod(np.full(len(units) - 1, 31, np.uint32), out=powers[1:], dtype=np.uint32)
    h = int((units * powers[::-1]).sum(dtype=np.uint32))
    return h - (1 << 32) if h >= 1 << 31 else h


def _jumps(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, c, out = 1, 0, []
    for _ in range(n):
        a, c = a * MULTIPLIER & MASK, (c * MULTIPLIER + INCREMENT) & MASK
        out.append((a, c))
    return np.array([x for x, _ in out], np.uint64), np.array([x for _, x in out], np.uint64)


_A, _C = _jumps(MOCK_DIMENSION)


def unit(v: np.ndarray) -> np.ndarray:
    """v over its norm, added up in float32 one after the other; a zero vector stays."""
    n = np.float32(np.sqrt(np.add.accumulate(v * v, dtype=np.float32)[-1])) if len(v) else np.float32(0)
    return v / n if n > 0 else v


def mock_vector(text: str) -> np.ndarray:
    """768 draws of the generator seeded with the text's hash, each in -1 .. 1, as a unit vector."""
    seed = np.uint64((text_hash(text) ^ MULTIPLIER) & MASK)
    state = (_A * seed + _C) & np.uint64(MASK)
    draws = (state >> np.uint64(24)).astype(np.float32) / np.float32(1 << 24)
    return unit(draws * np.float32(2) - np.float32(1))


class _Connection(http.client.HTTPConnection):
    def connect(self) -> None:
        super().connect()
        self.sock.settimeout(READ_TIMEOUT)


class _SecureConnection(http.client.HTTPSConnection):
    def connect(self) -> None:
        super().connect()
        self.sock.settimeout(READ_TIMEOUT)


class _Http(urllib.request.HTTPHandler):
    def http_open(self, request):
        return self.do_open(_Connection, request)


class _Https(urllib.request.HTTPSHandler):
    def https_open(self, request):
        return self.do_open(_SecureConnection, request)


def http_request(url: str, model: str, text: str, api_key: str | None) -> np.ndarray:
    headers = {"Content-Type": "application/json; charset=utf-8"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
    request = urllib.request.Request(url, json.dumps({"model": model, "input": text}).encode(), headers)
    try:
        with urllib.request.build_opener(_Http, _Https).open(request, timeout=CONNECT_TIMEOUT) as answer:
            return unit(np.array(response_vector(json.loads(answer.read())), np.float32))
    except urllib.error.HTTPError as e:
        raise OSError(f"HTTP request failed with code {e.code}: {e.read().decode('utf-8', 'replace')}") from e


def response_vector(answer: dict[str, Any]) -> list[float]:
    """The vector of a service's answer: data[0].embedding, else embedding, else embeddings[0]."""
    data = answer.get("data")
    if data and "embedding" in data[0]:
        return data[0]["embedding"]
    if "embedding" in answer:
        return answer["embedding"]
    if answer.get("embeddings"):
        return answer["embeddings"][0]
    raise ValueError("no embedding in the response")


def payload_vector(payload: Column) -> Column:
    """The same over a column of JSON texts, as array<float>; null where there is none."""
    of = lambda path: F.from_json(F.get_json_object(payload, path), "array<float>")
    return F.coalesce(of("$.data[0].embedding"), of("$.embedding"), of("$.embeddings[0]"))


@dataclass(frozen=True)
class Model:
    """An embedder; `make` runs once a task and returns the function from a text to its vector."""

    name: str
    kind: str
    dimension: int
    make: Callable[[], Callable[[str], np.ndarray]]

    def vector(self, text: str) -> list[float]:
        return [float(x) for x in self.make()(text)]


def loader(name: str) -> Callable[[str], Callable[[str], np.ndarray]]:
    """The loader that `module:function` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def create(model: str | None, model_name: str | None = None, dimension: int | None = None, model_path: str | None = None, api_key: str | None = None, local: Callable[[str], Callable[[str], np.ndarray]] | None = None) -> Model:
    """The mock for no model or `mock`; an HTTP service for a URL; for a model path a local model; else the mock.

    A local model is loaded by `local`, or by `local_model.load` if its folder holds an ONNX graph; the folder must be at the
    same path on all executors.
    """
    model = (model or "").strip() or None
    name = (model_name or "").strip() or model or "mock"
    ident = model or name
    path = (model_path or "").strip()
    mock = Model(name, "mock", MOCK_DIMENSION, lambda: mock_vector)
    if ident.lower() == "mock":
        return mock
    if ident.startswith(("http://", "https://")):
        return Model(name, "http", dimension if dimension is not None else HTTP_DIMENSION, lambda: lambda text: http_request(ident, name, text, api_key))
    if path:
        if not os.path.isdir(path):
            raise FileNotFoundError(f"model path does not exist: {path}")
        if local is None:
            from codeatlas.functions import local_model

            if local_model.graph_in(path) is None:
                raise ValueError("a model without an ONNX graph needs a loader: pass local=")
            local = local_model.load
        return Model(ident, "local", infer_dimension(path, dimension or 0), lambda: (lambda f: lambda text: unit(np.asarray(f(text), np.float32)))(local(path)))
    return mock


def embed(rows: DataFrame, text: str, model: Model, out: str = "embedding") -> DataFrame:
    """rows with the vector of each text (null: empty), by Arrow batches; the model is made once a task."""

    share_code(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model.make()
        for texts in batches:
            yield pd.Series([f(t or "") for t in texts])

    return rows.withColumn(out, vectors(F.col(text)))


def read_json(path: str) -> dict[str, Any] | None:
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else None
    except (OSError, ValueError):
        return None


def _dimension_in(config: dict[str, Any] | None) -> int | None:
    for part in (config, (config or {}).get("pooling_config")):
        for key in DIMENSION_KEYS if isinstance(part, dict) else ():
            value = part.get(key)
            if isinstance(value, (int, float, str)) and not isinstance(value, bool):
                try:
                    return int(value) if isinstance(value, int) else int(np.floor(float(value) + 0.5))
                except ValueError:
                    continue
    return None


def infer_dimension(model_path: str | None, fallback: int = 0) -> int:
    """Dimension from config.json, the sentence-transformers configuration or a pooling module; else the fallback, else 768."""
    if model_path:
        direct = os.path.isfile(model_path) and os.path.basename(model_path) == "config.json"
        names = [model_path] if direct else [os.path.join(model_path, n) for n in ("config.json", "sentence_transformers_config.json")]
        if os.path.isdir(model_path):
            names += [os.path.join(model_path, d, "config.json") for d in sorted(os.listdir(model_path)) if "pooling" in d.lower() and os.path.isdir(os.path.join(model_path, d))]
        for n in names:
            if (found := _dimension_in(read_json(n))) is not None:
                return found
    return fallback if fallback > 0 else LOCAL_DIMENSION


def pooling_arguments(model_path: str) -> dict[str, Any]:
    """pooling and normalize of a sentence-transformers configuration, as far as it has them."""
    config = (read_json(os.path.join(model_path, "sentence_transformers_config.json")) or {}).get("pooling_config")
    if not isinstance(config, dict):
        return {}
    mode = next((name for flag, name in POOLING.items() if config.get(flag)), None)
    return ({"pooling": mode} if mode else {}) | ({"normalize": bool(config["normalize_embeddings"])} if "normalize_embeddings" in config else {})


def has_token_types(model_path: str) -> bool:
    config = read_json(model_path if os.path.isfile(model_path) else os.path.join(model_path, "config.json"))
    value = (config or {}).get("type_vocab_size")
    return isinstance(value, (int, float)) and value > 1


def preferred_engine(setting: str | None, variable: str | None) -> str | None:
    """The engine that a process setting names, else an environment variable; blank means none."""
    return next((x.strip() for x in (setting, variable) if x and x.strip()), None)
