"""Captioning backends for pictures and videos, built once per worker."""

from __future__ import annotations

import base64
import json
import os
import urllib.request
from pathlib import PurePosixPath
from typing import Protocol

from tarnfold.config import Config
from tarnfold.errors import ExtractionFailed

# Media types by suffix.
MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".heic": "image/heic", ".heif": "image/heif", ".webp": "image/webp", ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff",
    ".mp4": "video/mp4", ".mov": "video/quicktime", ".avi": "video/x-msvideo", ".webm": "video/webm", ".mkv": "video/x-matroska",
}
# Fixed value: the local backend's own time limit in seconds.
LOCAL_TIMEOUT = 120


def mime(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in MIME:
        raise ExtractionFailed(path, f"unknown media type '{suffix}'")
    return MIME[suffix]


class Captioner(Protocol):
    """Describes a picture or video in words."""

    def caption(self, path: str, data: bytes, file_type: str) -> str: ...


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


class _Remote:
    images_only = True

    def __init__(self, config: Config):
        self.model, self.timeout, self.prompt = config.caption_model, config.vision_timeout, config.vision_prompt

    def caption(self, path: str, data: bytes, file_type: str) -> str:
        if self.images_only and file_type != "image":
            raise ExtractionFailed(path, f"this backend describes pictures only, not {file_type}")
        try:
            text = self.ask(path, mime(path), base64.b64encode(data).decode())
        except ExtractionFailed:
            raise
        except Exception as e:
            raise ExtractionFailed(path, "timeout" if isinstance(e, TimeoutError) else str(e)) from e
        if not text or not text.strip():
            raise ExtractionFailed(path, "empty caption")
        return text.strip()

    def ask(self, path: str, kind: str, data: str) -> str:
        raise NotImplementedError


def _key(name: str, path: str) -> str:
    if not (value := os.environ.get(name)):
        raise ExtractionFailed(path, f"{name} is not set")
    return value


class Gemini(_Remote):
    images_only = False

    def ask(self, path: str, kind: str, data: str) -> str:
        body = {"contents": [{"parts": [{"inline_data": {"mime_type": kind, "data": data}}, {"text": self.prompt}]}]}
        out = _post(f"https://generativelanguage.googleapis.com/v1beta/models/{self.model}:generateContent", body, {"x-goog-api-key": _key("GEMINI_API_KEY", path)}, self.timeout)
        return out["candidates"][0]["content"]["parts"][0]["text"]


class OpenAI(_Remote):
    def ask(self, path: str, kind: str, data: str) -> str:
        content = [{"type": "text", "text": self.prompt}, {"type": "image_url", "image_url": {"url": f"data:{kind};base64,{data}"}}]
        body = {"model": self.model, "max_tokens": 300, "messages": [{"role": "user", "content": content}]}
        out = _post("https://api.openai.com/v1/chat/completions", body, {"Authorization": f"Bearer {_key('OPENAI_API_KEY', path)}"}, self.timeout)
        return out["choices"][0]["message"]["content"]


class Ollama(_Remote):
    def ask(self, path: str, kind: str, data: str) -> str:
        body = {"model": self.model, "prompt": self.prompt, "images": [data], "stream": False}
        return _post("http://localhost:11434/api/generate", body, {}, LOCAL_TIMEOUT)["response"]


_BACKENDS = {"gemini": Gemini, "openai": OpenAI, "ollama": Ollama}


def backend(config: Config) -> Captioner | None:
    """The configured backend; none for ``none`` and, with a warning, for unknown names."""
    if config.vision_backend in ("", "none"):
        return None
    if config.vision_backend not in _BACKENDS:
        import warnings

        warnings.warn(f"unknown vision backend '{config.vision_backend}'", stacklevel=2)
        return None
    return _BACKENDS[config.vision_backend](config)
