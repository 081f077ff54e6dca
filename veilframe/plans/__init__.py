"""Ready-made queries by family, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("detection", "policy", "metrics", "limits", "payloads", "tools", "chat", "ner", "evals", "streams")


def _merged(attr: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        part = getattr(import_module(f"veilframe.plans.{family}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"duplicate query names: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
