"""Exact quantiles, with linear interpolation, of many columns at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a column that an aggregation may hold, and that may reach the driver.
HELD = 20_000
#: Accuracy of the sketches that narrow the range: they are off by a ten-thousandth of the rows at most.
ACCURACY = 10_000


def quantiles(df: DataFrame, columns: dict[str, Column], share: float | dict[str, float], *, held: int | None = None, within: dict[str, tuple[float, float, int]] | None = None) -> dict[str, float | None]:
    """The `share` quantile of each column (or each its own) over its values; None without any.

    Two aggregations over all columns at once.  A sketch gives each column two
    values with the ranks that matter at or between them.  Then values below the
    first and equal to either are counted, and those strictly between, some
    thousandth of the rows, are gathered in order: a frequent value is never among
    them, as it would be one of the two.  Where more than `held` of them are
    expected, a sketch of the values between narrows the range further first.

    within: by column, two values that a kept sketch or sample puts round the
    quantile, and how many values may lie between them.  They spare the first
    aggregation; should they be wrong, the counts show it, and a sketch follows.
    """
    within = within or {}
    held = HELD if held is None else held
    share = share if isinstance(share, dict) else dict.fromkeys(columns, share)
    slack = 2.0 / ACCURACY
    # by column: values, those below the range, those in it, and the range, whose ends may be part of it
    seen: dict[str, tuple[int, int, int]] = {}
    limits: dict[str, tuple] = {n: (low, high) for n, (low, high, _) in within.items()}

    def inside(n: str) -> Column:
        low, high = limits.get(n, (None, None))
        c = columns[n].cast("double")
        return F.when(c.between(low, high), c) if low is not None else c

    def place(n: str) -> float:
        return share[n] * (seen[n][0] - 1)

    def sketched(names: list[str]) -> None:
        """Narrow the ranges of these columns, from the shares of all or of what is inside."""
        asked = {}
        for n in names:
            if n in seen:
                _, below, m = seen[n]
                at = (place(n) - below) / max(1, m - 1)
            else:
                at = share[n]
            asked[n] = F.percentile_approx(inside(n), [min(1.0, max(0.0, at - slack)), min(1.0, max(0.0, at + slack))], ACCURACY).alias(n)
        counts = [F.count(columns[n]).alias(f"{n} count") for n in names if n not in seen]
        got = df.agg(*asked.values(), *counts).first().asDict()
        for n in names:
            if n not in seen:
                seen[n] = (got[f"{n} count"], 0, got[f"{n} count"])
            if got[n] is not None:
                limits[n] = tuple(got[n])

    def counted(names: list[str], gather: bool) -> dict:
        out = []
        for n in names:
            low, high = limits[n]
            c = columns[n].cast("double")
            between = (c > low) & (c < high)
            out += [] if n in seen else [F.count(columns[n]).alias(f"{n} count")]
            out += [F.count_if(c < low).alias(f"{n} less"), F.count_if(c == low).alias(f"{n} low"), F.count_if(c == high).alias(f"{n} high")]
            out.append(F.array_sort(F.collect_list(F.when(between, c))).alias(f"{n} between") if gather else F.count_if(between).alias(f"{n} between"))
        return df.agg(*out).first().asDict() if out else {}

    if set(columns) - set(within):
        sketched([n for n in columns if n not in within])
    result: dict[str, float | None] = dict.fromkeys(columns)
    due = [n for n in columns if n in within or seen[n][0]]
    # values strictly between, where they have been counted
    sizes: dict[str, int] = {}
    while due:
        # a sketch's two ranks lie this far apart, with its error on both sides
        narrow = [n for n in due if sizes.get(n, seen[n][2] * 4 * slack if n in seen else within[n][2]) <= held]
        wide = [n for n in due if n not in narrow]
        got = counted(narrow, True) | counted(wide, False)
        for n in list(due):
            low, high = limits[n]
            if n not in seen:
                seen[n] = (got[f"{n} count"], 0, got[f"{n} count"])
                if not seen[n][0]:
                    due.remove(n)
                    continue
            less, on_low, on_high = (got[f"{n} {x}"] for x in ("less", "low", "high"))
            on_high = 0 if low == high else on_high
            between = got[f"{n} between"]
            size = between if n in wide else len(between)
            first, last = int(place(n)), min(int(place(n)) + 1, seen[n][0] - 1)
            if not less <= first or not last < less + on_low + size + on_high:
                # the sketch was off by more than it promises: ask for a wider range
                limits.pop(n)
                seen[n] = (seen[n][0], 0, seen[n][0])
                slack *= 4
                sketched([n])
                continue
            if n in wide:
                seen[n] = (seen[n][0], less, on_low + size + on_high)
                before = limits[n]
                if size > held:
                    sketched([n])
                # the same range again: its ends are frequent values, and what lies between is all there is
                sizes.pop(n, None)
                if size <= held or limits[n] == before:
                    sizes[n] = 0
                continue
            at = lambda i: low if i < less + on_low else between[i - less - on_low] if i < less + on_low + size else high  # noqa: B023, E731
            rest = place(n) - first
            result[n] = at(first) * (1 - rest) + at(last) * rest if rest else at(first)
            due.remove(n)
    return result
