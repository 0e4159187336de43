"""The driver's log: warnings to standard error, everything to a file that rotates."""

from __future__ import annotations

import logging
import os
from logging.handlers import RotatingFileHandler

# The size a log file may have and the number of old ones.
LOG_BYTES, OLD_LOGS = 5 << 20, 3


def configure(folder: str, *, level: int = logging.INFO, name: str = "dissona") -> logging.Logger:
    """The package's logger, with a rotating file in a local folder of the driver; a second call changes nothing but the level."""
    log = logging.getLogger(name)
    log.setLevel(level)
    path = os.path.abspath(os.path.join(folder, f"{name}.log"))
    if not any(getattr(h, "baseFilename", None) == path for h in log.handlers):
        os.makedirs(folder, exist_ok=True)
        form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
        whole, shown = RotatingFileHandler(path, maxBytes=LOG_BYTES, backupCount=OLD_LOGS, encoding="utf-8"), logging.StreamHandler()
        shown.setLevel(logging.WARNING)
        for h in (whole, shown):
            h.setFormatter(form)
            log.addHandler(h)
        log.propagate = False
    return log
