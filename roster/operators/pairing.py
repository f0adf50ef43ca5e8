"""Closest-first pairing of two point sets on a line, by passes over sorted arrays.

Used inside Spark tasks by ``calls.match_points``; see there for how the rows are cut.

Rows of one phone and side at one instant are a node, taken in row order. A free node's candidates are the next free nodes
of the other side before and after it, at most ``tolerance`` away, and its best one is that with the smaller key
(distance, voip row, dialler row). Two nodes that are each other's best are a pair, whatever else is made; they stand next to
each other. From there along links of growing keys every second one is a pair too, as long as its ends are nearer to each
other than to what lies beyond the pairs between. A pass makes all these pairs at once and takes their rows out, until
none is left to make.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping

import numpy as np
import pandas as pd

from roster.session import ship

ship(__name__)

VOIP, DIALER = 0, 1
_FAR = np.iinfo(np.int64).max


def _same_instant(run, ts, side, row):
    """Pairs of rows at one instant, first with first, and which rows are left."""
    new = np.ones(len(ts), bool)
    new[1:] = (run[1:] != run[:-1]) | (ts[1:] != ts[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(ts)))
    voip = np.add.reduceat((side == VOIP).astype(np.int64), first)
    equal = np.minimum(voip, size - voip)
    place = np.arange(len(ts)) - np.repeat(first, size)
    rank = place - np.where(side == DIALER, np.repeat(voip, size), 0)
    paired = rank < np.repeat(equal, size)
    # by instant and rank the voip rows and the dialler rows come in the same order
    made = [row[paired & (side == VOIP)], row[paired & (side == DIALER)]]
    return np.stack([*made, np.zeros(len(made[0]), np.int64)], 1), ~paired


def _less(a, b):
    """Which keys (distance, voip row, dialler row) come before others."""
    return (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))


def _every_second(seed, step):
    """Where steps of two lead from a seed: position k if k - 2 is one and ``step[k]``, or if it is a seed."""
    out = np.zeros(len(seed), bool)
    for odd in (0, 1):
        mine, on = seed[odd::2], step[odd::2]
        if len(mine):
            begin = np.maximum.accumulate(np.where(on, 0, np.arange(len(mine))))
            out[odd::2] = mine[begin] & ~on[begin] | mine
    return out


def _candidates(spot, group, kind, first, tolerance: int):
    """For each node the next one of the other side before it: exists, distance, voip row, dialler row. ``first``: each node's first row."""
    n = len(spot)
    places = np.arange(n)
    last = [np.maximum.accumulate(np.where(kind == side, places, -1)) for side in (VOIP, DIALER)]
    other = np.where(kind == VOIP, last[DIALER], last[VOIP])
    at = np.maximum(other, 0)
    distance = np.abs(spot - spot[at])
    exists = (other >= 0) & (group[at] == group) & (distance <= tolerance)
    own, theirs = first, first[at]
    return exists, np.where(exists, distance, _FAR), np.where(kind == VOIP, own, theirs), np.where(kind == VOIP, theirs, own)


def _chosen(before, after, adjacent, one, certain):
    """Links between nodes k and k + 1 that are pairs now, and those of them that are each other's best.

    ``before`` and ``after`` are the candidates of each node, ``adjacent`` links whose ends are candidates of each other, ``one``
    nodes with a single row, ``certain`` links that nothing outside can take away.
    """
    n = len(adjacent)
    key = [k[:-1] for k in after[1:]]
    free = adjacent & certain
    # smaller than the other candidate of the left end, and of the right end
    left_end, right_end = _less(key, [k[:-1] for k in before[1:]]), _less(key, [k[1:] for k in after[1:]])
    best = free & left_end & right_end
    picks = best.copy()
    if n > 2 and best.any():
        d = key[0]
        grows = np.zeros(n, bool)  # grows[k]: links k - 1 and k are there, and the key grows from the one to the other
        falls = np.zeros(n, bool)
        both = adjacent[:-1] & adjacent[1:]
        grows[1:] = both & _less([k[:-1] for k in key], [k[1:] for k in key])
        falls[1:] = both & ~grows[1:]
        right, left = np.zeros(n, bool), np.zeros(n, bool)
        # links k - 2, k - 1, k of growing keys; the node between the first two is used up by the first
        right[2:] = grows[1:-1] & grows[2:] & one[1 : n - 1] & (d[2:] - d[1:-1] < d[:-2])
        left[:-2] = falls[1:-1] & falls[2:] & one[2:n] & (d[:-2] - d[1:-1] < d[2:])
        picks |= _every_second(best, right & free & right_end)
        picks |= _every_second(best[::-1], (left & free & left_end)[::-1])[::-1]
    return picks, best


def pair_rows(run, ts, side, row, tolerance: int, before: int | None = None, after: int | None = None):
    """Pair rows sorted by (run, ts, side, row); rows of different runs have nothing to do with each other.

    Returns (pairs as rows of (voip row, dialer row, distance), positions of rows still undecided). ``before`` and ``after`` are
    the instants of the nearest rows outside that the first and the last run could reach. A pair is made only when no such
    row could be closer; rows that depend on the outside stay undecided.
    """
    zero, left = _same_instant(run, ts, side, row)
    made = [zero]
    at = np.flatnonzero(left)  # positions of the rows still free
    new = np.ones(len(at), bool)
    new[1:] = (run[at][1:] != run[at][:-1]) | (ts[at][1:] != ts[at][:-1])
    head = np.flatnonzero(new)  # first free row of each node, as a place in ``at``
    stop = np.append(head[1:], len(at))
    spot, group, kind = ts[at][head], run[at][head], side[at][head]
    # how near the outside is to each node
    outside = np.full(len(head), _FAR)
    if before is not None:
        first = group == run[0]
        outside[first] = np.minimum(outside[first], spot[first] - before)
    if after is not None:
        last = group == run[-1]
        outside[last] = np.minimum(outside[last], after - spot[last])
    rows = row[at]
    alive = np.arange(len(head))
    while True:
        place, owner, sort = spot[alive], group[alive], kind[alive]
        first = rows[head[alive]]
        before_it = _candidates(place, owner, sort, first, tolerance)
        after_it = [x[::-1] for x in _candidates(place[::-1], owner[::-1], sort[::-1], first[::-1], tolerance)]
        if not before_it[0].any():
            break
        adjacent = after_it[0][:-1] & before_it[0][1:] & (sort[:-1] != sort[1:])
        distance = after_it[1][:-1]
        sizes = stop[alive] - head[alive]
        certain = distance < np.minimum(outside[alive[:-1]], outside[alive[1:]])
        picks, best = _chosen(before_it, after_it, adjacent, sizes == 1, certain)
        k = np.flatnonzero(picks)
        if not len(k):
            break
        # nodes with several rows, nearer to each other than to any other: as many pairs as the smaller one has rows
        near = best[k] & (distance[k] < before_it[1][k]) & (distance[k] < after_it[1][k + 1])
        count = np.where(near, np.minimum(sizes[k], sizes[k + 1]), 1)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        a, b = alive[k], alive[k + 1]
        one, two = rows[np.repeat(head[a], count) + step], rows[np.repeat(head[b], count) + step]
        flip = np.repeat(sort[k] == DIALER, count)
        made.append(np.stack([np.where(flip, two, one), np.where(flip, one, two), np.repeat(distance[k], count)], 1))
        head[a] += count
        head[b] += count
        alive = alive[head[alive] < stop[alive]]
    # what still has a candidate waits for rows outside, and so does what rows outside can reach
    nodes = alive[before_it[0] | after_it[0] | (outside[alive] <= tolerance)]
    count = stop[nodes] - head[nodes]
    rest = np.repeat(head[nodes], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.concatenate(made), at[rest]


def pair_partition(
    batches: Iterator[pd.DataFrame], tolerance: int, edges: Mapping[int, tuple], settled: Collection[tuple]
) -> Iterator[pd.DataFrame]:
    """Pair one partition sorted by (phone, ts, side, row), run by run.

    A run ends at a new phone or at a gap wider than ``tolerance``: no pair crosses it. ``edges`` has, by partition, the
    (phone, ts) of the nearest rows of the partitions before and after, or None. Rows at the instants ``settled`` are left out.
    """
    held: list[pd.DataFrame] = []
    at_start, before, after = True, None, None
    last_phones = {phone for phone, _ in settled}

    def solve(rows: pd.DataFrame, at_end: bool) -> pd.DataFrame:
        nonlocal at_start
        phone, ts, side, row = (rows[c].to_numpy() for c in ("phone", "ts", "side", "row"))
        run = np.concatenate(([0], np.cumsum(_breaks(rows, tolerance))))
        low = before[1] if at_start and before is not None and before[0] == phone[0] else None
        high = after[1] if at_end and after is not None and after[0] == phone[-1] else None
        pairs, left = pair_rows(run, ts, side, row, tolerance, low, high)
        at_start = False
        made = pd.DataFrame(pairs, columns=["voip_row", "dialer_row", "distance"])
        out = pd.concat([made, rows[list(POINT)].iloc[left]], ignore_index=True).reindex(columns=list(OUTPUT))
        return out.astype({c: "Int64" for c in OUTPUT if c != "phone"})

    for batch in batches:
        if batch.empty:
            continue
        before, after = edges[int(batch["part"].iloc[0])]
        if last_phones and (listed := batch["phone"].isin(last_phones)).any():
            there = pd.MultiIndex.from_frame(batch[["phone", "ts"]]).isin(settled)
            batch = batch[~(listed & there)]
            if batch.empty:
                continue
        if held:
            edge = pd.concat([held[-1].iloc[-1:], batch])
            inside = np.flatnonzero(_breaks(edge, tolerance))
        else:
            inside = np.flatnonzero(_breaks(batch, tolerance)) + 1
        if len(inside):
            cut = int(inside[-1])
            ready = pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = [batch.iloc[cut:]]
            if len(ready):
                yield solve(ready, at_end=False)
        else:
            held.append(batch)
    if held:
        yield solve(pd.concat(held, ignore_index=True), at_end=True)


POINT = ("phone", "ts", "side", "row")
OUTPUT = {
    "voip_row": "bigint", "dialer_row": "bigint", "distance": "bigint",
    "phone": "string", "ts": "bigint", "side": "bigint", "row": "bigint",
}


def _breaks(rows: pd.DataFrame, tolerance: int) -> np.ndarray:
    """For each row but the first: does a new run start here?"""
    phone, ts = rows["phone"].to_numpy(), rows["ts"].to_numpy()
    return (phone[1:] != phone[:-1]) | (ts[1:] - ts[:-1] > tolerance)
