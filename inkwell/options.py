"""Options of a cleaning run, checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CleanOptions:
    """Which stages run, and how.  The defaults clean everything."""

    flatten: bool = True
    comments: bool = True
    macros: bool = True
    bibliography: bool = True
    figures: bool = True
    keep_usepackage: bool = False
    figure_summary_suffix: str = "_summary.txt"
    encoding: str = "utf-8"
    notes: bool = False
    auto_summarize: bool = False
    verbose: bool = False

    def __post_init__(self):
        if not self.figure_summary_suffix:
            raise ValueError("figure_summary_suffix must not be empty")
        "".encode(self.encoding)
