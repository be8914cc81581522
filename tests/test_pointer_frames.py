"""Pointers of many chunks are followed at once, wherever the frames of a partition are cut."""

from __future__ import annotations

import pandas as pd
import pytest

from tendon.operators import jumps


@pytest.mark.parametrize("rows", [1, 3, 4, 7, 100])
def test_chunks_in_one_frame_do_not_mix(rows):
    chunks = [(key, chunk, [(4 * chunk + i, 4 * chunk + i + 1 + (key + i) % 3) for i in range(4)]) for key in range(5) for chunk in range(3)]
    table = [(k, c, n, to, 1) for k, c, own in chunks for n, to in own] + [(k, c, 4 * c + k % 4, -1, 0) for k, c, _ in chunks] + [(9, 0, 2, -1, 0)]  # the last question has no rows
    table = pd.DataFrame(table, columns=["key", "chunk", "n", "next", "__row"]).sort_values(["key", "chunk", "n", "__row"], ignore_index=True)
    frames = [*jumps._frames((table.iloc[at:at + rows] for at in range(0, len(table), rows)), ["key", "chunk"])]
    assert sum(map(len, frames)) == len(table)
    assert sum(len(f[["key", "chunk"]].drop_duplicates()) for f in frames) == len(table[["key", "chunk"]].drop_duplicates())
    found, kept = {}, set()
    for f in frames:
        if not (f["__row"] == 1).any():
            continue
        own, to, place, asked, entries = jumps._inside(f, ["key", "chunk"])
        inside = entries >= 0
        for k, c, e in zip(asked["key"][inside], asked["chunk"][inside], jumps.exits(to, place, entries[inside])):
            found[k, c] = e
        kept |= {(k, n) for k, n, hit in zip(own["key"], own["n"], jumps.reached(place, entries[inside])) if hit}
    want, marks = {}, set()
    for k, c, own in chunks:
        at, leads = 4 * c + k % 4, dict(own)
        while at in leads:
            marks.add((k, at))
            at = leads[at]
        want[k, c] = at
    assert found == want
    assert kept == marks
