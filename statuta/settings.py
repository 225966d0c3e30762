"""Settings of a deployment, from the environment or any mapping. Nothing else in the library reads the environment."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

LOCAL_MODEL = "local/offline"


def trimmed_url(url: str | None, default: str = "") -> str:
    """Without blanks around it and without slashes at its end; the default if nothing is left."""
    return (url or "").strip().rstrip("/") or default


def items(text: str | None) -> list[str]:
    """The parts between commas, each as ``trimmed_url``, without empty ones."""
    return [part for part in map(trimmed_url, (text or "").split(",")) if part]


def distinct(values: Iterable[str]) -> list[str]:
    """In order of first appearance, without empty ones."""
    return list(dict.fromkeys(v for v in values if v))


def prefixed(name: str, provider: str) -> str:
    """A model's name with its provider before a slash, once."""
    return name if name.startswith(f"{provider}/") else f"{provider}/{name}"


@dataclass(frozen=True)
class Settings:
    """Where the store is, the models to ask in order (the local one last), and the origins that may call."""

    store: str
    models: tuple[str, ...]
    origins: tuple[str, ...]
    environment: str

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None) -> Settings:
        """STATUTA_STORE, STATUTA_SITE and STATUTA_ORIGINS; STATUTA_KEY_x with STATUTA_MODEL_x adds provider x."""
        env = os.environ if env is None else env
        providers = sorted(name.removeprefix("STATUTA_KEY_") for name, value in env.items() if name.startswith("STATUTA_KEY_") and value.strip())
        models = [prefixed((env.get(f"STATUTA_MODEL_{p}") or "default").strip(), p.lower()) for p in providers]
        site = trimmed_url(env.get("STATUTA_SITE"), "http://localhost:3000")
        near = site.split("//")[-1].split(":")[0] in ("localhost", "127.0.0.1")
        return Settings(trimmed_url(env.get("STATUTA_STORE"), "statuta-store"), (*models, LOCAL_MODEL), tuple(distinct([site, *items(env.get("STATUTA_ORIGINS"))])), "local" if near else "cloud")
