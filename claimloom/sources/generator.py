"""A client for a local text generator behind HTTP; any failure is a null text, never an error."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd

MOST_CHARACTERS = 4000


def parsed(body: bytes) -> str | None:
    """The text in an answer {"message": {"content": JSON with a text under narrative}}; null if it isn't one, is empty or over-long."""
    try:
        text = json.loads(json.loads(body)["message"]["content"])["narrative"]
    except (ValueError, KeyError, TypeError):
        return None
    if not isinstance(text, str) or not text.strip() or len(text) > MOST_CHARACTERS:
        return None
    return text.strip()


def http_generator(url: str, model: str, timeout: float = 20.0) -> Callable[[pd.Series], pd.Series]:
    """A function from prompts to texts for `explain.narratives`, which asks the server at `url` for each."""
    schema = {"type": "object", "properties": {"narrative": {"type": "string"}}, "required": ["narrative"]}

    def one(prompt: str) -> str | None:
        asked = {"model": model, "messages": [{"role": "user", "content": prompt}], "format": schema, "stream": False, "options": {"temperature": 0.1}}
        request = urllib.request.Request(url, json.dumps(asked).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return parsed(answer.read())
        except (OSError, ValueError, urllib.error.URLError):
            return None

    return lambda prompts: prompts.map(one)
