"""Date ranges given as text by an operator of the jobs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from snapops.constants import DAY_MS


def parse_instant_ms(text: str) -> int | None:
    """Epoch milliseconds of ``yyyyMMddHHmm`` or ``yyyyMMdd`` in UTC, None for anything else."""
    layout = {12: "%Y%m%d%H%M", 8: "%Y%m%d"}.get(len(text or ""))
    if layout is None or not text.isdigit():
        return None
    try:
        moment = datetime.strptime(text, layout).replace(tzinfo=timezone.utc)
    except ValueError:
        return None
    return int(moment.timestamp()) * 1000


@dataclass(frozen=True)
class DateRange:
    start_ms: int | None
    end_ms: int | None

    @staticmethod
    def parse(text: str | None, as_of_ms: int) -> "DateRange":
        """``start,end``; blank or ``default`` is the day that ends at ``as_of_ms``."""
        if text is None or not text.strip() or text.lower() == "default":
            return DateRange(as_of_ms - DAY_MS, as_of_ms)
        start, end = text.split(",")[:2]
        return DateRange(parse_instant_ms(start), parse_instant_ms(end))
