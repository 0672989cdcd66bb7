"""A plain planner of the mix, which walks every slot of a round, to compare with."""

import heapq
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa

from quaystone.llm.source_mix import FAR


def one_round(units: Mapping, left: Mapping | None = None) -> dict:
    """Slots of a round by source, by earliest deadline among the released; ties to the longer-waiting, then to the name.
    It ends early when a source has had the blocks it has left."""
    total = sum(units.values())
    releases: dict[int, list] = {}
    done = dict.fromkeys(units, 0)
    slots: dict = {s: [] for s in units}
    releases[0] = list(units)
    ready: list = []
    t = 0
    while t < total:
        for s in releases.pop(t, ()):
            k, u = done[s], units[s]
            heapq.heappush(ready, (-(-(k + 1) * total // u), k * total // u, str(s), s))
        _, _, _, s = heapq.heappop(ready)
        slots[s].append(t)
        done[s] += 1
        if left is not None and done[s] == left[s]:
            break
        if done[s] < units[s]:
            again = max(t + 1, done[s] * total // units[s])
            releases.setdefault(again, []).append(s)
        t += 1
    return slots


def phases(blocks: Mapping, units: Mapping) -> list[dict]:
    """Until all blocks are placed: the sources that still have some, their first block and round, and the first slot."""
    return list(each_phase(blocks, units))


def each_phase(blocks: Mapping, units: Mapping) -> Iterator[dict]:
    """Phases one at a time, as there are as many as sources at most and each names all sources that are left."""
    used, slot = dict.fromkeys(blocks, 0), 0
    while left := {s: u for s, u in units.items() if blocks[s] > used[s]}:
        size = sum(left.values())
        rounds = one_round(left, {s: blocks[s] - used[s] for s in left})
        ends = {}
        for s, u in left.items():
            last = blocks[s] - used[s] - 1
            if len(rounds[s]) > last % u:
                ends[s] = last // u * size + rounds[s][last % u]
        length = min(ends.values()) + 1
        yield {"slot": slot, "size": size, "first": {s: used[s] for s in left}, "rounds": rounds}
        for s, u in left.items():
            used[s] += length // size * u + sum(t < length % size for t in rounds[s])
        slot += length


def block_table(plan: Iterable[dict], blocks: Mapping, units: Mapping) -> pa.Table:
    """Each block's source, number, slot, release and deadline; the plan's slots count from 0."""
    names, columns = [], []
    for p, following in pairwise(chain(plan, [None])):
        live = p["first"]
        size = p["size"]
        for s, first in live.items():
            n = (following["first"].get(s, blocks[s]) if following else blocks[s]) - first
            if not n:
                continue
            u, own = units[s], p["rounds"][s]
            j = range(n)
            names += [s] * n
            columns.append([
                np.arange(first, first + n), np.array([p["slot"] + i // u * size + own[i % u] for i in j], np.int64),
                np.array([min(FAR, p["slot"] + i * size // u) for i in j], np.int64), np.array([min(FAR, p["slot"] - (-(i + 1) * size // u)) for i in j], np.int64),
            ])
    whole = [np.concatenate([c[i] for c in columns]) if columns else np.zeros(0, np.int64) for i in range(4)]
    return pa.table([pa.array(names, pa.string()), *(pa.array(c, pa.int64()) for c in whole)], ["mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline"])
