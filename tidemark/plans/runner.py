"""Repeated cycles of a job: one, or one after another with a pause after each."""

from __future__ import annotations

import time
from collections.abc import Callable

INTERVAL = 20.0


def repeat(cycle: Callable[[int], None], interval: float = INTERVAL, once: bool = True, report: Callable[[int, Exception], None] | None = None, sleep: Callable[[float], None] = time.sleep, most: int | None = None) -> int:
    """Run ``cycle`` (its number) once, or until interrupted or ``most`` cycles are done; returns how many were.

    A failed cycle is reported and the next one comes in its turn; a single cycle's failure raises.
    """
    done = 0
    while True:
        try:
            cycle(done)
        except KeyboardInterrupt:
            return done
        except Exception as e:
            if once or report is None:
                raise
            report(done, e)
        done += 1
        if once or done == most:
            return done
        try:
            sleep(interval)
        except KeyboardInterrupt:
            return done
