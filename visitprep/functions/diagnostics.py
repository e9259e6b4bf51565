"""Messages: informational ones go to the log when asked for, warnings always show.

Whatever the schema decides is reported at once.  What depends on rows costs a job, so by default such
figures are attached to the returned plan as observations, filled in when the plan runs;
``diagnostics="eager"`` counts and warns right away.
"""

from __future__ import annotations

import logging
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation

from .names import check_choice

log = logging.getLogger("visitprep")
MODES = ("lazy", "eager", "off")
_last: dict[str, Observation] = {}


def inform(verbose: bool, message: str) -> None:
    if verbose:
        log.info(message)


def warn(message: str) -> None:
    warnings.warn(message, UserWarning, stacklevel=3)


def observed(df: DataFrame, operator: str, mode: str, figures: dict[str, Column], tell: Callable[[dict], None]) -> DataFrame:
    """``df`` with aggregate ``figures``; ``tell`` gets them at once in eager mode."""
    check_choice("diagnostics", mode, MODES)
    if mode == "eager":
        tell(df.agg(*[c.alias(k) for k, c in figures.items()]).first().asDict())
    elif mode == "lazy" and not df.isStreaming:
        _last[operator] = Observation()
        return df.observe(_last[operator], *[c.alias(k) for k, c in figures.items()])
    return df


def last_diagnostics(operator: str) -> dict:
    """Figures of an operator's latest lazy run; waits for an action on its result."""
    return dict(_last[operator].get)
