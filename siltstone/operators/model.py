"""Asking a model for what a page does not state: providers, retries, repair of answers."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from typing import Protocol


class Provider(Protocol):
    """Answers a prompt with text that should be one JSON object."""

    def answer(self, prompt: str) -> str: ...


class StopAsking(Exception):
    """A quota that no retry helps is spent."""


# What failures say, the most lasting first.
QUOTA = [("daily", ("per day", "perday", "daily")), ("billing", ("billing", "payment")), ("tokens", ("tokens per minute", "token count")), ("requests", ("requests per minute", "per minute")), ("exhausted", ("resource_exhausted", "quota")), ("rate", ("429", "rate limit", "too many requests"))]
TRANSPORT = [("connection", ("refused", "reset", "unreachable", "resolve")), ("timeout", ("timed out", "timeout"))]


def quota_error(message: str) -> str | None:
    """Which quota a failure speaks of, a daily one before all others; null if none."""
    low = message.lower()
    return next((kind for kind, words in QUOTA if any(w in low for w in words)), None)


def transport_error(message: str) -> str:
    low = message.lower()
    return next((kind for kind, words in TRANSPORT if any(w in low for w in words)), "transport")


def ask(provider: Provider, prompt: str, *, retries: int = 2, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The answer as an object; failures are tried again with a linear pause, a spent daily quota stops all."""
    for attempt in range(retries + 1):
        try:
            return json.loads(repaired(provider.answer(prompt)))
        except Exception as e:
            if quota_error(str(e)) == "daily":
                raise StopAsking(str(e)) from e
            if attempt == retries:
                raise
            sleep(pause * (attempt + 1))
    raise AssertionError("unreachable")


def repaired(raw: str) -> str:
    """JSON out of an answer: without fences, trailing commas, and with whatever is open closed."""
    text = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", raw.strip())
    out, stack, quoted, escaped = [], [], False, False
    for c in text:
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            if stack and stack[-1] == c:
                stack.pop()
        out.append(c)
    if quoted:
        out.append('"')
    while out and (out[-1].isspace() or out[-1] == ","):
        out.pop()
    if out and out[-1] == ":":
        out.append("null")
    return "".join(out) + "".join(reversed(stack))


def coerced(value, kind: str):
    """A value as a field of type string, array, integer, number or boolean holds it; null if it can't."""
    if value is None:
        return None
    if kind == "array":
        if isinstance(value, str):
            parts = value.split("\n") if "\n" in value else value.split(",")
            return [p.strip() for p in parts if p.strip()]
        return [coerced(v, "string") for v in value] if isinstance(value, list) else [coerced(value, "string")]
    if kind in ("integer", "number"):
        try:
            return int(float(value)) if kind == "integer" else float(value)
        except (TypeError, ValueError):
            return None
    if kind == "boolean":
        return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "yes", "1")
    if isinstance(value, list):
        return ", ".join(str(coerced(v, "string")) for v in value)
    if isinstance(value, dict):
        if set(value) == {"min", "max"}:
            return f"{value['min']} - {value['max']}"
        return ", ".join(f"{k}: {v}" for k, v in value.items())
    return str(value)


def key_values(value) -> list[dict]:
    """An object, or a list of such pairs already, as a list of key and value; values that are no text as JSON."""
    if isinstance(value, list):
        return value
    return [{"key": k, "value": v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)} for k, v in (value or {}).items()]
