"""Comparing tables."""

import math


def plain(frame) -> list[tuple]:
    """Rows of a pandas frame as sorted tuples of plain values, columns by name."""
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return "null"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(float(v))
        return str(v)

    cols = sorted(frame.columns)
    return sorted(tuple(one(v) for v in row) for row in frame[cols].itertuples(index=False))
