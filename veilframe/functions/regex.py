"""Pattern dialect: portable RE2-style syntax to the JVM's."""

from __future__ import annotations

import re


def jvm(pattern: str) -> str:
    """The same language on the JVM: Unicode classes and a strict end anchor.

    ``(?U)`` makes ``\\b \\d \\s \\w`` Unicode-aware (and case folding with ``(?i)`` too); ``$``
    would also match before a final line break, ``\\z`` does not.
    """
    body = pattern[:-1] + r"\z" if pattern.endswith("$") and not pattern.endswith(r"\$") else pattern
    return "(?U)" + body


def check_pattern(rule_id: str, pattern: str) -> None:
    """Offsets are counted between matches, so a pattern must consume something."""
    probe = re.compile(pattern)
    if any(m.start() == m.end() for text in ("", "a 1-b") for m in probe.finditer(text)):
        raise ValueError(f"rule '{rule_id}': pattern must not match the empty string")
