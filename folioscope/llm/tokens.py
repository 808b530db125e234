"""The token rule all operators of this package share, for the JVM and for Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits in runs of up to 8; any other character that is no blank, tab, CR or LF by itself.
TOKEN = r"[A-Za-z0-9]{1,8}|[^A-Za-z0-9 \t\r\n]"
TOKEN_RE = re.compile(TOKEN)


def token_count(text: str | Column) -> Column:
    """Number of tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def folded(name: str | Column) -> Column:
    """Trim blanks, lower-case, then each blank and hyphen becomes an underscore."""
    return F.translate(F.lower(F.trim(name)), " -", "__")
