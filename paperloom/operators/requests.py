"""Checked parameters of searches, neighbour lists and atlas feeds. Bad ones are a ValueError that names them."""

from __future__ import annotations

from dataclasses import dataclass

from .search import KNOWN_SOURCES, check_k, clamp

#: The window that stands for all time, in days, and the truth words.
ALL_TIME = 36_500
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")
MOST_POINTS = 1_000_000
FORMATS = ("json", "ndjson")


def _whole(value, name: str) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} is a whole number") from None


@dataclass(frozen=True)
class Search:
    text: str
    days: int
    limit: int
    ef: int
    sources: tuple[str, ...]


def search(body: dict) -> Search:
    """``text`` isn't blank; ``limit`` is moved into 1 to 100 and ``ef_search`` into 10 to 500; of ``sources`` those count that are known and set, all if none is."""
    text = body.get("text", "")
    if not isinstance(text, str) or not text.strip():
        raise ValueError("text is required")
    given = lambda name, default: default if body.get(name) is None else _whole(body[name], name)
    chosen = tuple(s for s in KNOWN_SOURCES if (body.get("sources") or {}).get(s))
    return Search(text.strip(), given("time_window_days", ALL_TIME), clamp(given("limit", 10), 1, 100), clamp(given("ef_search", 50), 10, 500), chosen or KNOWN_SOURCES)


@dataclass(frozen=True)
class Neighbours:
    k: int
    mutual: bool


def neighbours(arguments: dict[str, str]) -> Neighbours:
    """``k`` from 1 to 50, 20 if absent; ``mutual`` one of the truth words."""
    mutual = arguments.get("mutual", "false").strip().lower()
    if mutual not in TRUE + FALSE:
        raise ValueError("mutual is true or false")
    return Neighbours(check_k(_whole(arguments.get("k", "20"), "k")), mutual in TRUE)


@dataclass(frozen=True)
class Atlas:
    viewport: tuple[float, float, float, float] | None
    limit: int
    format: str


def atlas(arguments: dict[str, str]) -> Atlas:
    """``viewport``: four numbers, parted by commas; ``limit`` from 1 to MOST_POINTS; ``format``."""
    limit, form, viewport = _whole(arguments.get("limit", MOST_POINTS), "limit"), arguments.get("format", "json"), None
    if not 1 <= limit <= MOST_POINTS:
        raise ValueError(f"limit is from 1 to {MOST_POINTS}")
    if form not in FORMATS:
        raise ValueError(f"format is {' or '.join(FORMATS)}")
    if arguments.get("viewport"):
        try:
            viewport = tuple(float(v) for v in arguments["viewport"].split(","))
        except ValueError:
            raise ValueError("viewport values are numbers") from None
        if len(viewport) != 4:
            raise ValueError("viewport is x_min,y_min,x_max,y_max")
    return Atlas(viewport, limit, form)
