"""Settings: defaults, then a YAML file, then environment variables, then validation.

Variables are named ``WEFTLINE_<SECTION>_<KEY>``; every key can be set.  A boolean is true only for
``true`` in any case; numbers that don't parse are ignored.
"""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

PREFIX = "WEFTLINE_"


class ConfigError(ValueError):
    """A setting that can't hold."""


@dataclass(frozen=True)
class Search:
    base_url: str = "http://localhost:8080"
    default_engines: tuple[str, ...] = ("google", "duckduckgo", "brave")
    default_language: str = "en"
    safe_search: int = 1
    max_results: int = 10
    timeout_s: float = 10.0
    # Engines for each category.
    engine_routes: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "general": ("google", "duckduckgo", "brave"),
            "news": ("google news", "duckduckgo", "bing news"),
            "code": ("github", "stackoverflow", "duckduckgo"),
            "science": ("google scholar", "duckduckgo", "wikipedia"),
        }
    )


@dataclass(frozen=True)
class Detection:
    min_text_length: int = 500
    min_text_ratio: float = 0.05
    max_script_tags: int = 5


@dataclass(frozen=True)
class Policy:
    robots_enabled: bool = True
    robots_ttl_s: int = 3600
    robots_5xx_open: bool = True
    user_agent: str = "weftline"
    domain_mode: str = "blocklist"
    blocklist: tuple[str, ...] = ()
    allowlist: tuple[str, ...] = ()
    rate_limit_enabled: bool = True
    requests_per_minute: int = 10


@dataclass(frozen=True)
class PII:
    enabled: bool = True
    mode: str = "audit"
    language: str = "en"
    score_threshold: float = 0.5
    max_density: float = 5.0
    analyzer_url: str = "builtin"
    timeout_s: float = 10.0
    entities: tuple[str, ...] = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "LOCATION", "US_SSN", "MEDICAL_LICENSE")


@dataclass(frozen=True)
class Injection:
    enabled: bool = False
    mode: str = "audit"
    predict_url: str = "builtin"
    label: str = "INJECTION"
    threshold: float = 0.85
    max_chunk_bytes: int = 1200
    open_mark: str = "<untrusted-content>\n"
    close_mark: str = "\n</untrusted-content>"
    timeout_s: float = 10.0


@dataclass(frozen=True)
class Rerank:
    provider: str = "none"
    endpoint: str = ""
    top_k: int = 5
    timeout_s: float = 10.0


@dataclass(frozen=True)
class Provenance:
    enabled: bool = True
    export_enabled: bool = False
    export_path: str = ""
    batch_size: int = 50
    flush_s: float = 5.0
    ttl_days: int = 90


@dataclass(frozen=True)
class Telemetry:
    enabled: bool = False
    traces_exporter: str = "none"
    metrics_exporter: str = "none"
    sample_rate: float = 1.0


@dataclass(frozen=True)
class Config:
    search: Search = Search()
    detection: Detection = Detection()
    policy: Policy = Policy()
    pii: PII = PII()
    injection: Injection = Injection()
    rerank: Rerank = Rerank()
    provenance: Provenance = Provenance()
    telemetry: Telemetry = Telemetry()
    default_results: int = 5
    max_results: int = 20
    parity: bool = True


def _convert(kind: Any, old: Any, text: str) -> Any:
    if isinstance(old, bool):
        return text.strip().lower() == "true"
    try:
        if isinstance(old, int):
            return int(text)
        if isinstance(old, float):
            return float(text)
    except ValueError:
        return old
    if isinstance(old, tuple):
        return tuple(x.strip() for x in text.split(",") if x.strip())
    return text if isinstance(old, str) else old


def _with(section: Any, values: Mapping[str, Any]) -> Any:
    known = {f.name: getattr(section, f.name) for f in dataclasses.fields(section)}
    change = {k: tuple(v) if isinstance(known[k], tuple) else v for k, v in values.items() if k in known}
    return dataclasses.replace(section, **change)


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Config:
    """Settings from a file (a missing one is fine) and the environment, validated."""
    import yaml

    config = Config()
    if path and os.path.exists(path):
        with open(path) as f:
            data = yaml.safe_load(f) or {}
        parts = {k: _with(getattr(config, k), v) for k, v in data.items() if isinstance(v, dict) and hasattr(config, k)}
        config = dataclasses.replace(config, **parts)
    env = os.environ if env is None else env
    for section in dataclasses.fields(config):
        own = getattr(config, section.name)
        if not dataclasses.is_dataclass(own):
            continue
        change = {f.name: _convert(f.type, getattr(own, f.name), env[key]) for f in dataclasses.fields(own) if (key := f"{PREFIX}{section.name}_{f.name}".upper()) in env}
        config = dataclasses.replace(config, **{section.name: dataclasses.replace(own, **change)})
    validate(config)
    return config


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def validate(c: Config) -> None:
    _require("://" in c.search.base_url, "search.base_url must be an absolute URL")
    _require(c.search.max_results >= 1, "search.max_results must be at least 1")
    _require(c.search.timeout_s > 0, "search.timeout_s must be positive")
    _require(c.policy.domain_mode in ("allowlist", "blocklist"), "policy.domain_mode must be allowlist or blocklist")
    _require(bool(c.policy.user_agent.strip()), "policy.user_agent is required")
    _require(c.policy.robots_ttl_s >= 0, "policy.robots_ttl_s must not be negative")
    _require(not c.policy.rate_limit_enabled or c.policy.requests_per_minute >= 1, "policy.requests_per_minute must be at least 1")
    if c.pii.enabled:
        _require(c.pii.mode in ("audit", "redact", "block"), "pii.mode must be audit, redact or block")
        _require(bool(c.pii.analyzer_url), "pii.analyzer_url is required")
        _require(c.pii.timeout_s > 0, "pii.timeout_s must be positive")
    if c.injection.enabled:
        _require(c.injection.mode in ("audit", "annotate", "block"), "injection.mode must be audit, annotate or block")
        _require(bool(c.injection.predict_url) and bool(c.injection.label), "injection.predict_url and label are required")
        _require(0 <= c.injection.threshold <= 1, "injection.threshold must lie in [0, 1]")
        _require(c.injection.max_chunk_bytes >= 1, "injection.max_chunk_bytes must be at least 1")
        _require(c.injection.timeout_s > 0, "injection.timeout_s must be positive")
    _require(c.rerank.provider in ("kserve", "flashrank", "rankllm", "lexical", "none", ""), "rerank.provider is unknown")
    if c.rerank.provider not in ("none", ""):
        _require(bool(c.rerank.endpoint) and c.rerank.top_k >= 1, "rerank.endpoint and top_k are required")
    if c.telemetry.enabled:
        _require(c.telemetry.traces_exporter in ("otlp", "stdout", "none"), "telemetry.traces_exporter is unknown")
        _require(c.telemetry.metrics_exporter in ("prometheus", "otlp", "stdout", "none"), "telemetry.metrics_exporter is unknown")
        _require(0 <= c.telemetry.sample_rate <= 1, "telemetry.sample_rate must lie in [0, 1]")
    if c.provenance.export_enabled:
        _require(bool(c.provenance.export_path) and c.provenance.batch_size >= 1, "provenance.export_path and batch_size are required")
