"""Extractors that ask a language model over HTTP. Never used unless asked for; a session lives as long as its Python worker."""

from __future__ import annotations

import json
import urllib.request
from functools import cached_property

from ..operators.facts import ENTITY_SCHEMA, FACT_SCHEMA

TIMEOUT = 120
FACT_TOKENS, ENTITY_TOKENS = 2048, 64
REPAIR_TEMPERATURE = 0.3
MODES = ("guided_json", "response_format", "off")


def _post(url: str, body: dict | None, headers: dict, timeout: float) -> dict:
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def _numbered(sentences: list[str]) -> str:
    return "\n".join(f"[{i}] {s}" for i, s in enumerate(sentences))


class _Prompts:
    """What is asked; subclasses say how."""

    def _ask(self, prompt: str, schema: dict, tokens: int, temperature: float) -> str | None:
        raise NotImplementedError

    def facts(self, sentences: list[str]) -> str | None:
        asked = "List the facts in these sentences as JSON objects with entities, relation, sentence_index and confidence.\n\n"
        return self._ask(asked + _numbered(sentences), FACT_SCHEMA, FACT_TOKENS, 0.0)

    def targeted(self, sentences: list[str], src: str, dst: str, goal: str) -> str | None:
        aim = f"Goal: {goal}\n" if goal.strip() else ""
        asked = f"Source: {src}\nTarget: {dst}\n{aim}List the facts that link them, as JSON objects with entities, relation, sentence_index and confidence.\n\n"
        return self._ask(asked + _numbered(sentences), FACT_SCHEMA, FACT_TOKENS, REPAIR_TEMPERATURE)

    def question_entities(self, question: str) -> str | None:
        return self._ask(f"List the named entities of this question as a JSON array of strings.\n\n{question}", ENTITY_SCHEMA, ENTITY_TOKENS, 0.0)


class ChatCompletions(_Prompts):
    """A server with /v1/chat/completions. structured_output: how it is held to a schema."""

    def __init__(
        self, model: str, api_url: str = "http://localhost:8000", api_key: str = "EMPTY", enable_thinking: bool = False,
        structured_output: str = "guided_json", timeout: float = TIMEOUT,
    ):
        if structured_output not in MODES:
            raise ValueError(f"structured_output is one of {', '.join(MODES)}, not {structured_output}")
        self.model, self.api_url, self.api_key = model, api_url.rstrip("/"), api_key
        self.enable_thinking, self.structured_output, self.timeout = enable_thinking, structured_output, timeout

    @property
    def _headers(self) -> dict:
        return {"Authorization": f"Bearer {self.api_key}"}

    @cached_property
    def _available(self) -> bool:
        try:
            listed = _post(f"{self.api_url}/v1/models", None, self._headers, 5)
        except OSError:
            return False
        return any(m.get("id") == self.model for m in listed.get("data", ()))

    def is_available(self) -> bool:
        return self._available

    def body(self, prompt: str, schema: dict, tokens: int, temperature: float) -> dict:
        out = {
            "model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": tokens, "temperature": temperature,
            "chat_template_kwargs": {"enable_thinking": self.enable_thinking},
        }
        if self.structured_output == "guided_json":
            out["guided_json"] = schema
        elif self.structured_output == "response_format":
            out["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "schema": schema}}
        return out

    def _ask(self, prompt: str, schema: dict, tokens: int, temperature: float) -> str | None:
        got = _post(f"{self.api_url}/v1/chat/completions", self.body(prompt, schema, tokens, temperature), self._headers, self.timeout)
        message = got["choices"][0]["message"]
        return message.get("content") or message.get("reasoning_content")


class LocalChat(_Prompts):
    """A server with /api/chat and /api/tags."""

    def __init__(self, model: str, api_url: str = "http://localhost:11434", timeout: float = TIMEOUT):
        self.model, self.api_url, self.timeout = model, api_url.rstrip("/"), timeout

    def is_available(self) -> bool:
        try:
            listed = _post(f"{self.api_url}/api/tags", None, {}, 5)
        except OSError:
            return False
        names = {m.get("name", "") for m in listed.get("models", ())}
        return self.model in names or self.model in {n.split(":")[0] for n in names}

    def body(self, prompt: str, schema: dict, tokens: int, temperature: float) -> dict:
        return {
            "model": self.model, "messages": [{"role": "user", "content": prompt}], "format": schema, "stream": False,
            "options": {"temperature": temperature, "num_predict": tokens},
        }

    def _ask(self, prompt: str, schema: dict, tokens: int, temperature: float) -> str | None:
        return _post(f"{self.api_url}/api/chat", self.body(prompt, schema, tokens, temperature), {}, self.timeout)["message"].get("content")
