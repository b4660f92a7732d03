"""Text templates rendered as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLOT = re.compile(r"\{(\w+)\}")


def render(template: str, **slots: Column | str) -> Column:
    """Fill ``{slot}`` placeholders with columns (or plain strings)."""
    parts = []
    for i, piece in enumerate(_SLOT.split(template)):
        if i % 2:
            value = slots[piece]
            parts.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)
