"""The recurrence that makes times strictly increasing, row by row or a run of rows at a time."""

from __future__ import annotations

import math
from dataclasses import dataclass

FIRST_STEP = 1e-6  # step assumed before any positive interval was seen


@dataclass
class MonotonicClock:
    """What the time of the next row depends on."""

    source: float | None = None  # time of the last row
    placed: float | None = None  # and what it became
    offset: float = 0.0
    step: float = FIRST_STEP

    def place(self, now: float) -> float:
        """The next row's time: where it stands still or runs back, it and all that follows move on so that
        it comes one last positive step after its predecessor."""
        new = now + self.offset
        if self.placed is not None:
            if now > self.source:
                self.step = now - self.source
            if new <= self.placed:
                new = max(self.placed + self.step, math.nextafter(self.placed, math.inf))
                self.offset = new - now
        self.source, self.placed = now, new
        return new

    def begin_run(self, first: float, last: float, least: float) -> bool:
        """Places the first row of a run of increasing times; and whether its steps, of which
        ``least`` is the smallest, are so wide that rounding can't bring two of its times together."""
        self.place(first)
        return least > 8 * math.ulp(max(abs(first), abs(last)) + abs(self.offset))

    def end_run(self, last: float, step: float) -> None:
        """Moves on to the last row of a run of two rows or more."""
        self.source, self.placed, self.step = last, last + self.offset, step


class Runs(list):
    """Runs of increasing times: [first, last, smallest step, last step, number of the first row]."""

    rows = 0

    def note(self, t: float) -> None:
        self.rows += 1
        if self and t > self[-1][1]:
            run = self[-1]
            step = t - run[1]
            run[1:4] = t, min(run[2], step), step
        else:
            self.append([t, t, math.inf, None, self.rows])
