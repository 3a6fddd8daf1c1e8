"""Reading progress lines: how many elements a worker says it has finished."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pattern of each dialect; the first group is the number of finished elements.
PATTERNS = {
    "aom": r"^.{19}[^/]*/(\d+) ",
    "vpx": r"^.{19}[^/]*/(\d+) ",
    "rav1e": r"^encoded \s*(\d+)(?:/\S*)?(?:\s|$)",
    "svt-av1": r"^Encoding(?::\s*|\s+frame\s*)(\d+)(?:[/\s]|$)",
    "x264": r"^\s*(?:\[\S*\s+)*(\d+)(?:/\S*)?(?:\s|$)",
    "x265": r"^\s*(?:\[\S*\s+)*(\d+)(?:/\S*)?(?:\s|$)",
}


def without_escapes(line: Column) -> Column:
    """Terminal escape sequences removed: those that begin with a bracket up to their final letter, a bare escape alone."""
    return F.regexp_replace(line, "\x1b(?:\\[[^@-~]*[@-~])?", "")


def finished(kind: Column, line: Column) -> Column:
    """The number of finished elements a line reports in its kind's dialect; null if it reports none."""
    clean = without_escapes(line)
    out = F.lit(None).cast("string")
    for pattern in dict.fromkeys(PATTERNS.values()):
        out = F.when(kind.isin(*(k for k, p in PATTERNS.items() if p == pattern)), F.regexp_extract(clean, pattern, 1)).otherwise(out)
    return F.nullif(out, F.lit("")).try_cast("bigint")
