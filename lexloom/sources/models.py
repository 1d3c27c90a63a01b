"""Clients of language models over HTTP and retrying wrappers; all injectable."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _post(url: str, body: dict, timeout: float, headers: dict | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def ollama(url: str, model: str, temperature: float = 0.0, context: int = 8192, timeout: float = 300.0, schema: dict | None = None):
    """A callable prompt -> text of a local generate endpoint."""

    def ask(prompt: str) -> str:
        body = {"model": model, "prompt": prompt, "stream": False, "think": False, "options": {"temperature": temperature, "num_ctx": context, "num_predict": 4096}}
        reply = _post(f"{url}/api/generate", body | ({"format": schema} if schema else {}), timeout)
        return reply.get("response") or reply.get("thinking") or ""

    return ask


def chatml(prompt: str) -> str:
    """A prompt in ChatML, unless it is already."""
    return prompt if "<|im_start|>" in prompt else f"<|im_start|>user\n{prompt}<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"


def completion(url: str, temperature: float = 0.0, timeout: float = 300.0, schema: dict | None = None):
    """A callable prompt -> text of a completion server with JSON schema support."""

    def ask(prompt: str) -> str:
        body = {"prompt": chatml(prompt), "temperature": temperature, "n_predict": 4096, "stream": False}
        return _post(f"{url}/completion", body | ({"json_schema": schema} if schema else {}), timeout).get("content", "")

    return ask


def chat(url: str, model: str, key: str | None = None, temperature: float = 0.0, timeout: float = 60.0):
    """A callable prompt -> text of a chat completion service."""

    def ask(prompt: str) -> str:
        headers = {"Authorization": f"Bearer {key}"} if key else {}
        reply = _post(f"{url}/chat/completions", {"model": model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}, timeout, headers)
        return reply["choices"][0]["message"]["content"]

    return ask


def retried(model, tries: int = 3, wait: float = 2.0):
    """``model`` with further tries after pauses that double."""

    def ask(prompt: str) -> str:
        for i in range(tries):
            try:
                return model(prompt)
            except Exception:
                if i + 1 == tries:
                    raise
                time.sleep(wait * 2**i)

    return ask


def encoder(load, prefix: str = ""):
    """A pandas UDF text -> vector. ``load`` builds the model, once in each Python worker, as a
    callable of a list of texts; queries pass the instruction ``prefix`` of their model."""
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model([prefix + (t or "") for t in texts])])

    return pandas_udf(encode, "array<double>")


def sparse_weights(chunks, load):
    """(ord, term, w) of (ord, text): ``load`` builds a learned sparse encoder, once in each
    Python worker, as a callable of a list of texts that gives their {term: weight}."""

    def run(batches):
        model = load()
        for pdf in batches:
            rows = [(o, t, float(w)) for o, weights in zip(pdf["ord"], model(pdf["text"].fillna("").tolist())) for t, w in weights.items() if w > 0]
            yield pd.DataFrame(rows, columns=["ord", "term", "w"])

    kind = chunks.schema["ord"].dataType.simpleString()
    return chunks.select("ord", "text").mapInPandas(run, f"ord {kind}, term string, w double")


def pooled_logits(logits):
    """Column of positions x terms: the largest ln(1 + max(0, logit)) of each term."""
    squash = lambda v: F.transform(v, lambda x: F.log1p(F.greatest(F.lit(0.0), x)))
    return F.aggregate(F.slice(logits, 2, F.greatest(F.size(logits) - 1, F.lit(0))), squash(logits[0]), lambda a, v: F.zip_with(a, squash(v), lambda x, y: F.greatest(x, y)))


def timed(action, *args):
    """(result, seconds) of a call that runs a Spark action."""
    began = time.perf_counter()
    result = action(*args)
    return result, time.perf_counter() - began
