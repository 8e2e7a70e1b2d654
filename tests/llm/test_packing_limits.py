"""What the capacities of packing do: slack at the query's limits, binding at narrower ones."""

import numpy as np
import pytest

from brindle.llm import packing


def contents(counts, limits):
    """The lengths in each sequence, in the order in which they lie there."""
    length = np.repeat(*np.array(sorted(counts.items())).T)
    number = np.concatenate([np.arange(n) for _, n in sorted(counts.items())])
    sequence, offset = packing.place(length, number, packing.plan(counts, limits))
    found = {}
    for s, _, x in sorted(zip(sequence.tolist(), offset.tolist(), length.tolist())):
        found.setdefault(s, []).append(x)
    return [found[s] for s in sorted(found)]


def longest_first(counts, tokens):
    left, found = dict(counts), []
    while any(left.values()):
        room, mine = tokens, []
        while fit := [x for x, n in left.items() if n and x <= room]:
            mine.append(max(fit))
            left[mine[-1]] -= 1
            room -= mine[-1]
        found.append(mine)
    return found


COUNTS = {4096: 2, 3000: 5, 1500: 7, 900: 11, 130: 40, 17: 60, 1: 300}


def test_only_tokens_bind_at_the_query_limits():
    assert contents(COUNTS, packing.Limits()) == longest_first(COUNTS, packing.CAPACITY)


@pytest.mark.parametrize("limits", [{"pieces": 5}, {"attention": 4096**2, "pieces": 12}])
def test_narrower_limits_bind(limits):
    limits = packing.Limits(**limits)
    found = contents(COUNTS, limits)
    assert sorted(x for s in found for x in s) == sorted(x for x, n in COUNTS.items() for _ in range(n))
    assert all(sum(s) <= limits.tokens and len(s) <= limits.pieces and sum(x * x for x in s) <= limits.attention for s in found)
    assert max(map(len, found)) == limits.pieces and found != longest_first(COUNTS, limits.tokens)


def test_narrower_attention_binds():
    counts = {x: n for x, n in COUNTS.items() if x <= 1500}
    limits = packing.Limits(attention=3_000_000)
    found = contents(counts, limits)
    assert all(sum(x * x for x in s) <= limits.attention for s in found) and found != longest_first(counts, limits.tokens)
