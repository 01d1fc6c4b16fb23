"""Text generators over clients that may be installed; none is needed by the library."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .synthesis import TextGenerator


@dataclass
class ChatGenerator:
    """A chat endpoint of the common completions shape."""

    client: Any
    model: str
    temperature: float = 0.0

    def generate(self, prompt: str, temperature: float | None = None) -> str:
        answer = self.client.chat.completions.create(model=self.model, temperature=self.temperature if temperature is None else temperature, messages=[{"role": "user", "content": prompt}])
        return answer.choices[0].message.content or ""


@dataclass
class ContentGenerator:
    """A client whose models generate content."""

    client: Any
    model: str
    temperature: float = 0.0

    def generate(self, prompt: str, temperature: float | None = None) -> str:
        return self.client.models.generate_content(model=self.model, contents=prompt, config={"temperature": self.temperature if temperature is None else temperature}).text or ""


def create_generator(provider: str, model: str, api_key: str, base_url: str | None = None, temperature: float = 0.0) -> TextGenerator:
    """A generator for "openai" (and endpoints that answer alike, by base_url) or "google"; the client library must be installed."""
    if provider == "openai":
        try:
            from openai import OpenAI
        except ImportError as e:
            raise RuntimeError("the openai client is not installed") from e
        return ChatGenerator(OpenAI(api_key=api_key, base_url=base_url), model, temperature)
    if provider == "google":
        try:
            from google import genai
        except ImportError as e:
            raise RuntimeError("the google client is not installed") from e
        return ContentGenerator(genai.Client(api_key=api_key), model, temperature)
    raise ValueError(f"no provider {provider!r}")
