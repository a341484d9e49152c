"""Numbers and bars for terminal reports."""

from __future__ import annotations

import math

SPARKS = "▁▂▃▄▅▆▇█"
BAR = 30


def number(x: float | None) -> str:
    if x is None:
        return "—"
    if not math.isfinite(x):
        return str(x)
    return f"{int(x):,}" if x == int(x) and abs(x) < 1e15 else f"{x:,.2f}"


def sparkline(counts: list[int]) -> str:
    """One block a count, taller for more; only a count of 0 has the lowest."""
    top = max(counts, default=0)
    steps = len(SPARKS) - 1
    return "".join(SPARKS[max(1, int(c / top * steps)) if c else 0] for c in counts)


def bar(part: float, whole: float, width: int = BAR) -> str:
    n = int(part / whole * width) if whole > 0 else 0
    return "█" * n + "░" * (width - n)


def clip(text: str, width: int, mark: str = "…") -> str:
    return text if len(text) <= width else text[: width - len(mark)] + mark


def title(text: str) -> str:
    return f"# {text}"


def table(heads: list[str], rows: list[list], right: int = 1) -> list[str]:
    """Lines of a table; columns from ``right`` on are set to the right, all under their heads."""
    cells = [[str(x) for x in r] for r in (heads, *rows)]
    wide = [max(len(r[i]) for r in cells) for i in range(len(heads))]
    lines = ["  ".join(f"{x:>{w}}" if i >= right else f"{x:<{w}}" for i, (x, w) in enumerate(zip(r, wide, strict=True))).rstrip() for r in cells]
    return [lines[0], "  ".join("-" * w for w in wide), *lines[1:]]
