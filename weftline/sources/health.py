"""Probes of the services behind the live sources."""

from __future__ import annotations

from collections.abc import Callable, Mapping


def health(probes: Mapping[str, Callable[[], bool]], required: tuple[str, ...] = ("search",)) -> dict:
    """Runs each probe; the whole is degraded only if a required one is down, others are just told.

    A probe that raises counts as down.
    """
    state = {}
    for name, probe in probes.items():
        try:
            state[name] = "up" if probe() else "down"
        except (OSError, ValueError, RuntimeError) as e:
            state[name] = f"down: {e}"
    down = [n for n in required if state.get(n) != "up"]
    return {"status": "degraded" if down else "ok", "code": 503 if down else 200, "services": state}
