"""How many optional clauses must match: integers, percentages and conditions."""

from __future__ import annotations

import re

from quarry.errors import IllegalArgument

_NUMBER = re.compile(r"[+-]?\d+")
_PERCENT = re.compile(r"[+-]?\d+%")


def _one(spec: str, total: int) -> int:
    if _PERCENT.fullmatch(spec):
        share = int(spec[:-1]) * total
        part = abs(share) // 100 * (1 if share >= 0 else -1)  # towards zero
        return total + part if spec.startswith("-") else part
    if _NUMBER.fullmatch(spec):
        n = int(spec)
        return total + n if n < 0 else n
    raise IllegalArgument(f"[minimum_should_match] can't read [{spec}]")


def minimum_should_match(spec, total: int, default: int) -> int:
    """Matches that `spec` asks of `total` clauses: at least 0, but possibly more than there are.

    `n<spec` applies beyond n clauses and the last such condition wins; with at
    most the first n, all clauses must match.
    """
    if spec is None:
        return default
    if isinstance(spec, bool) or not isinstance(spec, (int, str)):
        raise IllegalArgument(f"[minimum_should_match] can't read [{spec}]")
    text = str(spec)
    if "<" not in text:
        return max(0, _one(text, total))
    result = total
    for condition in text.split(" "):
        bound, found, rest = condition.partition("<")
        if not found or not _NUMBER.fullmatch(bound) or not rest:
            raise IllegalArgument(f"[minimum_should_match] can't read [{spec}]")
        value = _one(rest, total)
        if total > int(bound):
            result = value
    return max(0, result)
