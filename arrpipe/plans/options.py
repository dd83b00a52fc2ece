"""What a batch can be told to do otherwise."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.names import AliasRules


@dataclass(frozen=True)
class Options:
    """Switches of the silver step; the defaults keep every row and match as widely as can be.

    - ``aliases``: what counts as an alias of a company name, the synonym table included.
    - ``all_versions``: every version of an article has a say in its match, else only the current one.
    - ``only_changed``: companies delivered unchanged keep their batch id and time.
    - ``latest_only``: of an article that comes several times in a run only the newest row is current.
    - ``require_id``: articles without an id go to ``silver_quarantine``, once, and no further.
    - ``contiguous``: revenue ranges reach up to the next one.
    """

    aliases: AliasRules = field(default_factory=AliasRules)
    all_versions: bool = True
    only_changed: bool = False
    latest_only: bool = False
    require_id: bool = False
    contiguous: bool = False
