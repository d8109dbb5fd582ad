"""Line differences between two texts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, functions as F


def line_diff(old: Column, new: Column, context: int = 3) -> Column:
    """(added, removed, lines) of a line diff; no change gives an empty list, a null text counts as empty.

    Lines carry their mark (" ", "+", "-"); at most ``context`` equal lines stand around a change, and "..." where some are left out.
    """

    @F.pandas_udf("added int, removed int, lines array<string>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            left, right = (x or "").split("\n"), (y or "").split("\n")
            out: list[str] = []
            groups = list(difflib.SequenceMatcher(None, left, right, autojunk=False).get_grouped_opcodes(context))
            for n, group in enumerate(groups):
                out += ["..."] if n else []
                for tag, i1, i2, j1, j2 in group:
                    if tag == "equal":
                        out += [" " + s for s in left[i1:i2]]
                    else:
                        out += ["-" + s for s in left[i1:i2]] + ["+" + s for s in right[j1:j2]]
            rows.append((sum(s[0] == "+" for s in out), sum(s[0] == "-" for s in out), out))
        return pd.DataFrame(rows, columns=["added", "removed", "lines"])

    return run(old, new)
