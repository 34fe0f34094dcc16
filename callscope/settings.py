"""Settings from the environment, and the limits of requests."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

#: Longest message, URL and repository name of a request, and shortest name (fixed values).
MESSAGE, URL, REPOSITORY, SHORTEST = 10_000, 2_048, 201, 3
_NAME = re.compile(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+")


@dataclass(frozen=True)
class Settings:
    """What a deployment sets: variables of the environment by the upper-case names of the fields, after CALLSCOPE_."""

    root: str = "graphs"
    webhook_secret: str = ""
    embedding_cache: str = ""
    embedding_model: str = "hash"
    dimensions: int = 64

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        found = {f.name: env[f"CALLSCOPE_{f.name.upper()}"] for f in fields(cls) if env.get(f"CALLSCOPE_{f.name.upper()}")}
        return cls(**{k: int(v) if k == "dimensions" else v for k, v in found.items()})


def _text(value: str | None, what: str, most: int, least: int = 1) -> str:
    if not isinstance(value, str) or not least <= len(value) <= most:
        raise ValueError(f"{what} must have {least} to {most} characters")
    if not value.strip():
        raise ValueError(f"{what} must not be blank")
    return value.strip()


def message(value: str | None) -> str:
    """A chat message without white space around it."""
    return _text(value, "the message", MESSAGE)


def url(value: str | None) -> str:
    return _text(value, "the URL", URL)


def repository(value: str | None) -> str:
    """``owner/repository``, without ``.git``."""
    name = _text(value, "the repository", REPOSITORY, SHORTEST).removesuffix(".git")
    if not _NAME.fullmatch(name):
        raise ValueError("the repository must be owner/repository")
    return name
