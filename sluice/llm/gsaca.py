"""Suffix arrays of many short texts at once, by linear grouping.

The construction has two phases. The first sorts suffixes into groups by their
Lyndon prefix: groups are processed in descending order, every member points at
the nearest earlier suffix of a lower group, and the suffixes pointed at move
into new groups right behind their own, ordered by how often they were pointed
at. The second emits the order: from the smallest suffix on, each suffix places
its predecessor, and then the chain of previous-smaller pointers, at the front
of their groups. Nothing is renamed and nothing recurses.

Texts are independent, so both phases advance all texts of a batch in step and
every step is a handful of array operations.
"""

from __future__ import annotations

import numpy as np


def spread(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all ranges laid end to end, and the range each belongs to."""
    which = np.repeat(np.arange(len(start)), length)
    shift = start - np.concatenate([[0], np.cumsum(length)[:-1]])
    return np.arange(len(which)) + shift[which], which


def suffix_arrays(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted suffixes of each text, as positions in ``codes``.

    Text t is ``codes[offsets[t]:offsets[t + 1]]`` and must end in a code that
    is smaller than all others in it and occurs once.
    """
    n, base, size = len(codes), offsets[:-1], np.diff(offsets)
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(base)), size)

    # Groups by first code, as ranges of `order`; `group` is a suffix's range start, `before` the range end is implied.
    order = np.lexsort((codes, text))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first = np.ones(n, bool)
    a, b = order[:-1], order[1:]
    first[1:] = (codes[a] != codes[b]) | (text[a] != text[b])
    starts = np.flatnonzero(first)
    group = np.empty(n + 1, np.int64)
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    group[n] = -1  # what lies before a text
    members = np.zeros(n, np.int64)
    members[starts] = np.diff(np.append(starts, n))

    previous = np.arange(-1, n)
    previous[base] = n
    previous[n] = n
    end = offsets[1:].copy()
    live = np.arange(len(base))
    while len(live):
        low = group[order[end[live] - 1]]
        at, which = spread(low, end[live] - low)
        suffix = order[at]
        floor = low[which]
        # nearest earlier suffix of a lower group; pointers of higher groups, and of this one so far, skip ahead
        open_ = np.arange(len(suffix))
        while len(open_):
            s = suffix[open_]
            p = previous[s]
            ahead = group[p] >= floor[open_]
            open_ = open_[ahead]
            previous[s[ahead]] = previous[p[ahead]]
        target = previous[suffix]
        target = target[target < n]
        if len(target):
            target, times = np.unique(target, return_counts=True)
            of = group[target]
            o = np.lexsort((times, of))
            target, times, of = target[o], times[o], of[o]
            new_old = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            moved = np.diff(np.append(new_old, len(of)))
            old = of[new_old]
            tail = old + members[old] - moved  # where the moved suffixes of each old group begin
            slot, k = spread(tail, moved)
            in_tail = place[target] >= tail[k]
            holes = place[target[~in_tail]]
            stays = np.ones(len(slot), bool)
            stays[place[target[in_tail]] - tail[k[in_tail]] + new_old[k[in_tail]]] = False
            displaced = order[slot[stays]]
            # holes and displaced suffixes agree in number within each old group
            order[holes] = displaced
            place[displaced] = holes
            order[slot] = target
            place[target] = slot
            fresh = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (times[1:] != times[:-1])))
            count = np.diff(np.append(fresh, len(of)))
            members[old] -= moved
            begin = slot[fresh]
            group[target] = np.repeat(begin, count)
            members[begin] = count
        end[live] = low
        live = live[low > base[live]]

    out = np.empty(n, np.int64)
    filled = np.zeros(n, np.int64)
    done = np.zeros(n + 1, bool)
    done[n] = True
    out[base] = offsets[1:] - 1
    done[offsets[1:] - 1] = True
    by_size = np.argsort(-size, kind="stable")
    sizes, bases = size[by_size], base[by_size]
    for i in range(int(sizes[0])):
        here = bases[: np.searchsorted(-sizes, -i, side="left")]
        j = out[here + i]
        j = j[j > here] - 1
        j = j[~done[j]]
        while len(j):
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            done[j] = True
            j = previous[j]
            j = j[~done[j]]
    return out
