"""What a stream has done so far, and telling others about it."""

from __future__ import annotations

import json
import logging
import urllib.request
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql.streaming.listener import StreamingQueryListener

log = logging.getLogger(__name__)


@dataclass
class Progress:
    rows: int = 0
    batches: int = 0
    rate: float = 0.0
    errors: deque = field(default_factory=lambda: deque(maxlen=20))

    def percent(self, expected: int) -> float:
        return round(100.0 * min(1.0, self.rows / expected), 1) if expected else 100.0


class ProgressListener(StreamingQueryListener):
    """Adds up rows and batches of all queries of a session; keeps the last errors."""

    def __init__(self) -> None:
        self.progress = Progress()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.progress.rows += event.progress.numInputRows
        self.progress.batches += 1
        self.progress.rate = event.progress.processedRowsPerSecond or 0.0

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.progress.errors.append(event.exception)


def notify(urls: list[str], payload: dict, timeout: float = 5.0) -> dict[str, str | None]:
    """Posts ``payload`` as JSON to each address in turn; (address, what went wrong or None). A failure stops nothing."""
    out: dict[str, str | None] = {}
    for url in urls:
        request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=timeout):
                out[url] = None
        except (OSError, ValueError) as wrong:
            log.warning("%s: %s", url, wrong)
            out[url] = str(wrong)
    return out
