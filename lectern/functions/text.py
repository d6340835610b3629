"""String helpers as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: White space that Python's ``strip`` removes, as a regular expression class.
SPACE = r"[\x09-\x0D\x1C-\x20\u0085   -     　]"
#: Line ends of Python's ``splitlines``.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]"


#: The characters of ``SPACE``, the usual one first; trimming by them costs less than a pattern does.
SPACES = "".join(chr(i) for i in [32, *range(32), *range(33, 1 << 16)] if re.match(SPACE, chr(i)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def split_lines(c: Column) -> Column:
    """Lines of a text; a line end at the very end makes no further line."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, f"({LINE_END})\\z", ""), LINE_END, -1))


def in_order(c: Column, name: str) -> Column:
    """A severity's rank, whatever its case: errors first, unknown ones last."""
    level = F.lower(c)
    return F.when(level == "error", 0).when(level == "warning", 1).when(level.isin("info", "tip"), 2).otherwise(9).alias(name)


def contrast_ratio(a: list[Column], b: list[Column]) -> Column:
    """Contrast of two colours given as red, green and blue of 0 to 255 (WCAG 2 relative luminance)."""

    def light(rgb: list[Column]) -> Column:
        linear = [F.when(c / 255 <= 0.03928, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))) for c in rgb]
        return F.lit(0.2126) * linear[0] + F.lit(0.7152) * linear[1] + F.lit(0.0722) * linear[2]

    x, y = light(a), light(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def pdf_date(c: Column) -> Column:
    """``D:YYYYMMDDHHmm...`` as a date, with hours and minutes where both are given; other texts stay."""
    part = lambda i: F.regexp_extract(c, r"^D:(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?", i)
    time = F.when((part(4) != "") & (part(5) != ""), F.concat(F.lit(" "), part(4), F.lit(":"), part(5))).otherwise("")
    return F.when(part(1) == "", c).otherwise(F.concat(F.concat_ws("-", part(1), part(2), part(3)), time))
