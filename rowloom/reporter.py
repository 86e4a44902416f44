"""What a run says: notes, warnings and errors, to a stream."""

from __future__ import annotations

import os
import sys
from collections import Counter

_PAINT = {"warning": "\033[33m", "error": "\033[31m"}


class Reporter:
    """``quiet``: warnings and errors only. ``stop_on``: kinds of messages after which a run stops at the end of the step."""

    def __init__(self, stream=None, color: bool | None = None, quiet: bool = False, stop_on: tuple[str, ...] = ()):
        self.stream, self.quiet, self.stop_on = stream, quiet, stop_on
        self.color = color
        self.counts: Counter[str] = Counter()

    def say(self, kind: str, text: str) -> None:
        self.counts[kind] += 1
        if self.quiet and kind not in _PAINT:
            return
        out = self.stream or sys.stderr
        color = out.isatty() and "NO_COLOR" not in os.environ if self.color is None else self.color
        for line in (text if kind == "put" else f"{kind.upper()}: {text}").split("\n"):
            print(f"{_PAINT[kind]}{line}\033[0m" if color and kind in _PAINT else line, file=out)

    @property
    def stops(self) -> bool:
        return any(self.counts[k] for k in self.stop_on)

    def summary(self) -> str:
        found = [f"{self.counts[k]} {k}(s)" for k in ("error", "warning") if self.counts[k]]
        return ", ".join(found) or "No errors or warnings."
