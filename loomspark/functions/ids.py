"""Anchors and composite ids as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.config import Config


def domain_of(anchor: Column) -> Column:
    return F.substring_index(anchor, "-", 1)


def parent_candidate(anchor: Column, config: Config) -> Column:
    """The id that a composite or sub-block id hangs on; null of any other."""
    end = config.subblock_pattern
    return F.when(F.contains(anchor, F.lit(config.separator)), F.substring_index(anchor, config.separator, 1)).when(anchor.rlike(end), F.regexp_replace(anchor, end, ""))


def composite_id(target: Column, role: Column, letter: Column, ordinal: Column, separator: str = "#") -> Column:
    return F.format_string(f"%s{separator}%s-%s%02d", target, role, letter, ordinal)
