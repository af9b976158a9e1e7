"""Logging of the engine; nothing is set up on import."""

from __future__ import annotations

import logging
import os

NAME, VARIABLE = "tidemark", "TIDEMARK_LOG_LEVEL"


def get_logger(name: str = "") -> logging.Logger:
    """The logger of a part of the engine."""
    return logging.getLogger(f"{NAME}.{name}" if name else NAME)


def setup_logging(level: str | None = None) -> logging.Logger:
    """Write the engine's messages to the standard error, from a level on: the given one, that of
    $TIDEMARK_LOG_LEVEL, or WARNING.  A second call replaces the first one's handler."""
    chosen = (level or os.environ.get(VARIABLE) or "WARNING").upper()
    if chosen not in logging.getLevelNamesMapping():
        raise ValueError(f"{chosen!r} is no level of logging")
    top = get_logger()
    top.handlers = [logging.StreamHandler()]
    top.handlers[0].setFormatter(logging.Formatter("{asctime} {levelname} {name}: {message}", style="{"))
    top.setLevel(chosen)
    top.propagate = False
    return top
