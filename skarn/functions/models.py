"""What a model does in the engine, as protocols, with deterministic stand-ins that need no weights."""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile("[a-z0-9]+|[一-鿿]")
_SIGNS = re.compile(r"[A-Za-z0-9]+|\S")


class Encoder(Protocol):
    """Texts to unit vectors. name and revision stamp the tables that hold them."""

    name: str
    revision: str
    width: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    """A question and its context to an answer."""

    def generate(self, question: str, context: str) -> str: ...


class HashEncoder:
    """A unit bag of tokens, each in the slot of its hash."""

    name, revision = "hash-bag", "1"

    def __init__(self, width: int = 32):
        self.width = width

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.width
            for token in _TOKEN.findall(text.lower()):
                v[int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % self.width] += 1
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else [1.0, *v[1:]])
        return out


class ExtractiveGenerator:
    """The sentence of the context that shares most words with the question, cited."""

    def generate(self, question: str, context: str) -> str:
        asked = set(_TOKEN.findall(question.lower()))
        sources = re.split(r"\[参考文档(\d+)\][^\n]*\n", context)
        best = max(((len(asked & set(_TOKEN.findall(s.lower()))), -int(n), s.strip(), n) for n, body in zip(sources[1::2], sources[2::2]) for s in re.split(r"(?<=[.!?。！？])\s*", body) if s.strip()), default=None)
        return f"{best[2]} [参考文档{best[3]}]" if best else ""


def request_tokens(question: str, context: str) -> int:
    """A stand-in for a model's count: a token for each word or number begun, one more for every four further letters, one for each other sign."""
    return sum(1 + (len(x) - 1) // 4 if x.isascii() else 1 for x in _SIGNS.findall(f"{context}\n{question}"))


def encoded(text: Column, make: Callable[[], Encoder], batch: int = 32) -> Column:
    """Vectors of a text column: the encoder is made once in each Python worker, and sees `batch` texts at a time."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in encoder.encode(texts[i : i + batch])], index=s.index)

    return run(text)


# --- a model behind a URL -----------------------------------------------------------------------

#: Sampling options and what each may be.
OPTIONS: dict[str, Callable[[object], bool]] = {
    "temperature": lambda v: _finite(v) and v >= 0,
    "top_p": lambda v: _finite(v) and 0 < v <= 1,
    "repeat_penalty": lambda v: _finite(v) and v > 0,
    "top_k": lambda v: type(v) is int and v > 0,
    "num_ctx": lambda v: type(v) is int and v > 0,
    "num_predict": lambda v: type(v) is int and v > 0,
    "seed": lambda v: type(v) is int,
}


def _finite(v: object) -> bool:
    return type(v) in (int, float) and math.isfinite(v)


def checked_options(options: dict) -> dict:
    if bad := [k for k, v in options.items() if k not in OPTIONS or not OPTIONS[k](v)]:
        raise ValueError(f"sampling options that are unknown or out of range: {', '.join(sorted(bad))}")
    return dict(options)


def error_class(error: BaseException) -> str:
    """What a failed call of a model means for whoever asked: not_found, refused, busy, timeout, unreachable, format, input or model."""
    code = getattr(error, "code", None)
    if isinstance(code, int):
        return {404: "not_found", 400: "refused"}.get(code, "busy")
    if isinstance(error, TimeoutError) or isinstance(getattr(error, "reason", None), TimeoutError):
        return "timeout"
    if isinstance(error, OSError):
        return "unreachable"
    if isinstance(error, json.JSONDecodeError):
        return "format"
    return "input" if isinstance(error, ValueError) else "model"


class ModelError(RuntimeError):
    """A call that failed: its kind, and the text that had come by then."""

    def __init__(self, kind: str, message: str, text: str = ""):
        super().__init__(message)
        self.kind, self.text = kind, text


def post_lines(url: str, payload: dict, timeout: float = 300) -> Iterator[str]:
    """The lines of the answer to a JSON request."""
    body = json.dumps(payload, ensure_ascii=False).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"}, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as response:
        for line in response:
            yield line.decode()


class StreamGenerator:
    """A generator that asks a chat model over NDJSON. post gives the lines of a response and can be replaced."""

    def __init__(self, url: str, model: str, options: dict | None = None, post: Callable[[str, dict], Iterator[str]] = post_lines, show: Callable[[str], None] | None = None):
        self.url, self.model, self.options, self._post, self._show = url.rstrip("/"), model, checked_options(options or {}), post, show
        self.usage: dict = {}

    def generate(self, question: str, context: str) -> str:
        """The whole text; show gets the text so far with each part. A stream without its end is an error that keeps what came."""
        messages = [{"role": "system", "content": context}, {"role": "user", "content": question}]
        payload = {"model": self.model, "stream": True, "options": self.options, "messages": messages}
        text = ""
        try:
            for line in self._post(f"{self.url}/api/chat", payload):
                if not line.strip():
                    continue
                row = json.loads(line)
                if row.get("error"):
                    raise ModelError("model", str(row["error"]), text)
                part = (row.get("message") or {}).get("content", "")
                if not isinstance(part, str):
                    raise ModelError("format", "a part of the answer is no text", text)
                text += part
                if part and self._show:
                    self._show(text)
                if row.get("done") is True:
                    self.usage = {k: row.get(k) for k in ("prompt_eval_count", "eval_count", "done_reason")}
                    return text
            raise ModelError("model", "the stream ended early", text)
        except ModelError:
            raise
        except Exception as e:
            raise ModelError(error_class(e), str(e) or type(e).__name__, text) from e


def model_health(url: str, model: str, get: Callable[[str], str]) -> dict:
    """Whether the service answers, and whether it has the model; get gives the body behind a URL."""
    try:
        names = [m.get("name", "") for m in json.loads(get(f"{url.rstrip('/')}/api/tags"))["models"]]
    except Exception as e:  # noqa: BLE001 - the failure is the report
        return {"service": False, "model": False, "error": error_class(e)}
    return {"service": True, "model": model in names or f"{model}:latest" in names, "error": None}
