"""A polling scheduler: due work is looked for again and again, on the driver, until it is stopped."""

from __future__ import annotations

import logging
from collections.abc import Callable
from threading import Event

EVERY = 10.0


def poll(due: Callable[[], list], run: Callable[[object], None], stop: Event, every: float = EVERY) -> int:
    """Run what is due, then wait ``every`` seconds, until ``stop`` is set; gives how many were run. One that fails is
    logged and doesn't stop the others."""
    done = 0
    while not stop.is_set():
        for one in due():
            if stop.is_set():
                break
            try:
                run(one)
                done += 1
            except Exception:
                logging.getLogger(__name__).exception("scheduled work %r failed", one)
        stop.wait(every)
    return done
