"""Arguments of log, blame and diff queries, read on the driver."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

_UNIT_DAYS = {"day": 1, "week": 7}


def date_filter(text: str, now: datetime) -> datetime:
    """A day, an ISO time, yesterday, or `N days|weeks|months|years ago`; a month without that day takes its last."""
    text = text.strip().lower()
    if text == "now":
        return now
    if text == "yesterday":
        return now - timedelta(days=1)
    m = re.fullmatch(r"(\d+) (day|week|month|year)s? ago", text)
    if not m:
        return datetime.fromisoformat(text)
    n, unit = int(m[1]), m[2]
    if unit in _UNIT_DAYS:
        return now - timedelta(days=n * _UNIT_DAYS[unit])
    months = now.year * 12 + now.month - 1 - n * (12 if unit == "year" else 1)
    year, month = divmod(months, 12)
    last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return now.replace(year=year, month=month + 1, day=min(now.day, last))


def line_range(text: str, lines: list[str]) -> tuple[int, int]:
    """First and last line, from 1, of `a,b`, `a,+n` or `/start/,/end/`; raises if they aren't in lines."""
    m = re.fullmatch(r"(\d+),(\+?)(\d+)", text)
    if m:
        first = int(m[1])
        last = first + int(m[3]) - 1 if m[2] else int(m[3])
    else:
        m = re.fullmatch(r"/(.*)/,/(.*)/", text)
        if not m:
            raise ValueError(f"not a range of lines: {text}")
        first = next((i for i, s in enumerate(lines, 1) if re.search(m[1], s)), 0)
        last = next((i for i, s in enumerate(lines[first:], first + 1) if re.search(m[2], s)), 0)
    if not 1 <= first <= last <= len(lines):
        raise ValueError(f"no such lines: {text}")
    return first, last


def revision_range(text: str) -> tuple[list[str], list[str], bool]:
    """(include, exclude, symmetric) of `A..B`, `A...B`, `^A B` or names; an empty side is HEAD."""
    if "..." in text:
        a, b = text.split("...", 1)
        return [a or "HEAD", b or "HEAD"], [], True
    if ".." in text:
        a, b = text.split("..", 1)
        return [b or "HEAD"], [a or "HEAD"], False
    words = text.split()
    return [w for w in words if w[0] != "^"], [w[1:] for w in words if w[0] == "^"], False
