"""Settings from a file of KEY=VALUE lines."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def parse_settings(lines: Iterable[str]) -> dict[str, str]:
    """KEY=VALUE lines as a mapping: blank lines and comments are left out, quotes and a leading export go."""
    out: dict[str, str] = {}
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        if line[:7].lower() == "export ":
            line = line[7:]
        key, _, value = (part.strip() for part in line.partition("="))
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        if key:
            out.setdefault(key, value)
    return out


def settings(lines: Iterable[str], given: Mapping[str, str]) -> dict[str, str]:
    """What is given, and from the file what isn't."""
    return parse_settings(lines) | dict(given)
