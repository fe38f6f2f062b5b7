"""Local sentence embedders: an ONNX graph and a tokenizer in one folder, run where the texts are."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

import numpy as np

from codeatlas.functions.embedding import has_token_types, pooling_arguments, preferred_engine

LOG = logging.getLogger("codeatlas")
GRAPHS, TOKENIZER = ("model.onnx", os.path.join("onnx", "model.onnx")), "tokenizer.json"
#: Names the engine if nothing else does.
ENGINE_VARIABLE = "CODEATLAS_ENGINE"
#: Texts in an error that say that an engine isn't there (fixed values).
UNSUPPORTED = ("doesn't support specified engine", "no pytorch engine", "engine pytorch is not available", "no matching engine")


def graph_in(path: str) -> str | None:
    return next((g for n in GRAPHS if os.path.isfile(g := os.path.join(path, n))), None)


def is_unsupported(error: BaseException | None) -> bool:
    """Whether an error, or one that caused it, says that its engine isn't there."""
    while error is not None:
        if any(x in str(error).lower() for x in UNSUPPORTED):
            return True
        error = error.__cause__
    return False


def with_fallback(build: Callable[[str | None], object], engine: str | None):
    """build(engine); where that engine isn't there, build(None), the default's choice. Other errors are raised."""
    if engine:
        try:
            return build(engine)
        except Exception as e:
            if not is_unsupported(e):
                raise
            LOG.warning("engine %r isn't available (%s): the default is used", engine, e)
    return build(None)


def pooled(states: np.ndarray, mask: np.ndarray, mode: str) -> np.ndarray:
    """One vector of the states (tokens, dimension) of the tokens in mask, by a pooling mode."""
    m = mask.astype(np.float32)[:, None]
    if mode == "cls":
        return states[0]
    if mode == "max":
        return np.where(m > 0, states, -np.inf).max(axis=0)
    if mode == "weightedmean":
        m = m * np.arange(1, len(m) + 1, dtype=np.float32)[:, None]
    total, n = (states * m).sum(axis=0), max(float(m.sum()), 1e-9)
    return total / (np.sqrt(n) if mode == "mean_sqrt_len" else n)


def load(path: str, engine: str | None = None) -> Callable[[str], np.ndarray]:
    """The function from a text to its vector of the model in a folder, with the pooling and token types that its files ask for (mean if none).

    engine names an execution provider ("cpu" or "CPUExecutionProvider"); if None the environment's variable does.
    """
    import onnxruntime
    from tokenizers import Tokenizer

    graph = graph_in(path)
    if graph is None:
        raise FileNotFoundError(f"no {GRAPHS[0]} in {path}")
    tokenizer, mode, types = Tokenizer.from_file(os.path.join(path, TOKENIZER)), pooling_arguments(path).get("pooling", "mean"), has_token_types(path)

    def build(name: str | None):
        known = onnxruntime.get_available_providers()
        chosen = [p for p in known if name is None or p.lower().removesuffix("executionprovider") == name.lower().removesuffix("executionprovider")]
        if not chosen:
            raise ValueError(f"no matching engine: {name}, of {known}")
        return onnxruntime.InferenceSession(graph, providers=chosen)

    session = with_fallback(build, preferred_engine(engine, os.environ.get(ENGINE_VARIABLE)))
    inputs = {i.name for i in session.get_inputs()}

    def vector(text: str) -> np.ndarray:
        got = tokenizer.encode(text)
        fed = {"input_ids": got.ids, "attention_mask": got.attention_mask, "token_type_ids": got.type_ids if types else [0] * len(got.ids)}
        out = session.run(None, {k: np.array([v], np.int64) for k, v in fed.items() if k in inputs})[0][0]
        return pooled(out, np.array(got.attention_mask), mode) if out.ndim == 2 else out

    return vector
