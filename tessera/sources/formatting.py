"""How values are shown as text."""

from __future__ import annotations


def cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        text = f"{value:.15g}"
        return text if any(c in text for c in ".en") else text + ".0"
    return str(value)
