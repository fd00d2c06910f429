"""Fill-in-middle examples cut with an indexable skip list.

A text is a sequence of units: code points, words (with the white space that
follows) or lines. The skip list's base lane has a node per unit; every express
lane keeps about a quarter of the lane below, and each of its links carries two
widths, the units and the code points that it passes over. A descent adds the
widths of the links that do not overshoot a rank, so it reaches the unit rank
exactly and knows the code-point offset there, in O(log n) steps.

The draws come from the SHA-256 of `salt` and the document's id, so a text is
transformed alike in every run and layout. Map-only: a task holds one Arrow
batch and the lanes of one text, about twice its code points in widths.

Defined cases: a null or empty text gives form plain and an empty output; so
does a text that holds a marker (its output is the text itself). A null id is
drawn as an empty one; repeated rows give equal rows; ties of the two cuts give
an empty middle. Very long texts are cut whole. Only the two given columns are
read, so other columns may have any name; an empty table gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlake.llm.common import by_value

by_value(__name__)

MARKERS = ("<P>", "<S>", "<M>")
#: Units other than code points; what no pattern matches joins the unit after it.
UNITS = {"word": r"\s*\S+\s*", "line": r"[^\n]*\n|[^\n]+$"}


class SkipList:
    """Lanes of (units, points) link widths over a sequence of units.

    `lanes[0]` holds every unit; node i of lane k > 0 stands at node
    `below[k][i]` of lane k - 1, and its link reaches the next node of its own
    lane (or the end). The head of each lane stands before the first unit.
    """

    def __init__(self, points: np.ndarray, seed: int = 7, share: int = 64, least: int = 16):
        draws = np.random.default_rng(seed)
        units = np.ones(len(points), np.int32)
        self.lanes, self.below = [(units, points)], [None]
        while len(units) > least:
            kept = np.flatnonzero(np.frombuffer(draws.bytes(len(units)), np.uint8) < share)
            at = np.concatenate(([0], kept[kept > 0]))              # the head, and the nodes drawn for this lane
            units, points = np.add.reduceat(units, at, dtype=np.int64), np.add.reduceat(points, at, dtype=np.int64)
            self.lanes.append((units, points))
            self.below.append(at)

    def offset(self, rank: int) -> int:
        """The code points before unit `rank`, by descending widths."""
        i = unit = point = 0
        for k in range(len(self.lanes) - 1, -1, -1):
            units, points = self.lanes[k]
            while i < len(units) and unit + units[i] <= rank:
                unit, point, i = unit + int(units[i]), point + int(points[i]), i + 1
            if k and i < len(units):
                i = int(self.below[k][i])
            elif k:                                                   # past the last link: the end
                i = len(self.lanes[k - 1][0])
        return point


def unit_widths(text: str, unit: str) -> np.ndarray:
    """Code points of each unit; they sum to the text's length."""
    if unit == "code point":
        return np.ones(len(text), np.int32)
    ends = [m.end() for m in re.finditer(UNITS[unit], text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))                                        # white space alone, or after the last unit
    return np.diff(np.array([0, *ends], np.int64)).astype(np.int32)


def cut(text: str, first: int, second: int, unit: str = "code point") -> tuple[int, int, int]:
    """(units, code points of the prefix, code points to the middle's end) for
    two draws, each taken modulo the number of units plus one."""
    widths = unit_widths(text, unit)
    n = len(widths)
    ranks = sorted((first % (n + 1), second % (n + 1)))
    lanes = SkipList(widths)
    return n, lanes.offset(ranks[0]), lanes.offset(ranks[1])


def check_markers(markers: tuple[str, str, str]) -> None:
    """Raises for markers that could arise where a part meets a marker."""
    if len(set(markers)) < 3 or any(not m or any(m[0] in o[1:] or (o != m and o.startswith(m)) for o in markers) for m in markers):
        raise ValueError("a marker's first character must stand only at the start of markers, and none may start another")


def transform(text: Column, id: Column, *, unit: str = "code point", fim_percent: int = 90, spm_percent: int = 20,
              markers: tuple[str, str, str] = MARKERS, salt: str = "1:") -> Column:
    """STRUCT of n (units), form (plain, psm or spm), prefix_chars,
    middle_chars (null if plain) and output. `fim_percent` of the texts are
    cut, `spm_percent` of those with the suffix first."""
    if unit != "code point" and unit not in UNITS:
        raise ValueError(f"unit is 'code point' or one of {sorted(UNITS)}")
    check_markers(markers)
    p, s, m = markers

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def make(texts: pd.Series, draws: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(texts, draws):
            t = "" if t is None else t
            h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
            if not t or any(x in t for x in markers) or h[2] % 100 >= fim_percent:
                out.append((len(unit_widths(t, unit)), "plain", None, None, t))
                continue
            n, a, b = cut(t, h[0], h[1], unit)
            pre, mid, suf = t[:a], t[a:b], t[b:]
            spm = h[3] % 100 < spm_percent
            out.append((n, "spm" if spm else "psm", a, b - a,
                        s + suf + p + pre + m + mid if spm else p + pre + s + suf + m + mid))
        got = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return got.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
    return make(text, F.sha2(F.concat(F.lit(salt), F.coalesce(id.cast("string"), F.lit(""))), 256))


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text of an output: its parts between the markers, in order.
    A marker cannot arise across a part's end, as its first character stands
    nowhere else in a marker."""
    p, s, m = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substr(F.substring_index(output, second, 1), F.lit(len(first) + 1))
        last = F.substring_index(output, m, -1)
        n = F.length(one) + len(first) + len(second)
        two = F.substr(output, n + 1, F.length(output) - n - len(m) - F.length(last))
        return one, two, last

    pre, suf, mid = parts(p, s)
    suf2, pre2, mid2 = parts(s, p)
    return (F.when(form == "psm", F.concat(pre, mid, suf)).when(form == "spm", F.concat(pre2, mid2, suf2)).otherwise(output))
