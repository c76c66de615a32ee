"""Points in time: relative (-15m, -1h@h), snapped (@d), absolute (ISO), in UTC."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from tidelog.lang.tokens import SPAN_SECONDS, QueryError

_RELATIVE = re.compile(r"(?P<sign>[+-])(?P<n>\d+)(?P<unit>s|m|h|d|w)(?:@(?P<snap>[smhdw]))?$|@(?P<only>[smhdw])$")


def snap(at: datetime, unit: str) -> datetime:
    """The beginning of the second, minute, hour, day, or week (Monday)."""
    if unit == "w":
        at -= timedelta(days=at.weekday())
        unit = "d"
    keep = {"s": {"microsecond": 0}, "m": {"second": 0, "microsecond": 0}, "h": {"minute": 0, "second": 0, "microsecond": 0}, "d": {"hour": 0, "minute": 0, "second": 0, "microsecond": 0}}
    return at.replace(**keep[unit])


def point(text: str, now: datetime) -> datetime:
    text = text.strip()
    if text == "now":
        return now
    if m := _RELATIVE.fullmatch(text):
        if m["only"]:
            return snap(now, m["only"])
        at = now + timedelta(seconds=int(m["n"]) * SPAN_SECONDS[m["unit"]] * (1 if m["sign"] == "+" else -1))
        return snap(at, m["snap"]) if m["snap"] else at
    try:
        at = datetime.fromisoformat(text.lstrip("@").replace("Z", "+00:00"))
    except ValueError:
        raise QueryError(f"not a point in time: {text!r}") from None
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def bounds(text: str) -> tuple[str, str | None]:
    """The two ends of `a..b`, or of `a` alone."""
    low, dots, high = text.partition("..")
    return low.strip(), high.strip() or "now" if dots else None
