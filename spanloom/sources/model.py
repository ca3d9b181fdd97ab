"""A local model server as the client of model_entities()."""

from __future__ import annotations

import json
from urllib.request import Request, urlopen


class HttpModel:
    """Asks for one answer in JSON, at temperature 0. Whatever goes wrong raises: the caller counts it as a failed attempt."""

    #: Where the server listens, which model it is asked for, seconds for an answer.
    def __init__(self, url: str = "http://127.0.0.1:11434/api/generate", model: str = "qwen2.5:7b-instruct", seconds: float = 120) -> None:
        self.url, self.model, self.seconds = url, model, seconds

    def generate(self, prompt: str) -> str:
        asked = {"model": self.model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": 0}}
        request = Request(self.url, json.dumps(asked).encode(), {"Content-Type": "application/json"}, method="POST")
        with urlopen(request, timeout=self.seconds) as answer:
            return json.loads(answer.read())["response"]
