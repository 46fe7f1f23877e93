"""Bin completion over a histogram of lengths.

The instance is a table length -> pieces, so its size is bounded by the
capacity however many pieces there are. The search is depth-first: a node
takes the largest open length, enumerates the fillings of the rest of its
sequence and applies one as often as the counters permit. It looks for a
packing into ``goal`` sequences, first the lower bound itself; ``goal`` times the
capacity less the sum of all lengths is the waste that may be spent, every filling
spends its own, and no filling that would overdraw it is entered. A filling is
dominated, and skipped, if pieces left over could stand in for some of its own and leave
less waste or more small pieces. Fillings come by least waste, then by largest
lengths, out of the sums that can be reached with the open lengths, so that the
enumeration has no dead ends.

Best fit decreasing is the incumbent. Nodes are counted, not seconds: the
outcome depends on the histogram alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: ((length, pieces of it), ...) of one sequence, and how many sequences are filled so.
Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[int, Filling]]

#: Nodes of a descent, branches of a node, fillings looked at for a branch, descents for a goal, goals from the lower bound up.
NODES, WIDTH, LOOKS, DESCENTS, GOALS = 4000, 8, 32, 2, 1


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Least sequences: for each k, pieces over capacity - k are alone, and those of k to half fill what the other big ones leave."""
    counts = [histogram.get(s, 0) for s in range(capacity + 1)]
    half, best = capacity // 2, 0
    big = sum(counts[half + 1 :])
    big_sum = sum(s * counts[s] for s in range(half + 1, capacity + 1))
    alone = alone_sum = 0
    small = sum(s * counts[s] for s in range(half + 1))
    for k in range(half + 1):
        if k:
            alone += counts[capacity - k + 1]
            alone_sum += (capacity - k + 1) * counts[capacity - k + 1]
            small -= (k - 1) * counts[k - 1]
        free = (big - alone) * capacity - (big_sum - alone_sum)
        best = max(best, big + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing; sequences that are filled alike are one group."""
    groups: dict[int, list[tuple[int, Filling]]] = {}
    rooms = 0  # bit r: some sequence has room r
    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n > 0:
            fits = rooms >> s
            if fits:
                room = s + (fits & -fits).bit_length() - 1
                bins, fill = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms ^= 1 << room
            else:
                room, bins, fill = capacity, -(-n // (capacity // s)), ()
            each = room // s
            full = min(bins, n // each)
            rest = min(n - full * each, each) if bins > full else 0
            n -= full * each + rest
            for many, k in ((full, each), (int(rest > 0), rest), (bins - full - int(rest > 0), 0)):
                if many and (k or fill):
                    groups.setdefault(room - k * s, []).append((many, (*fill, (s, k)) if k else fill))
                    rooms |= 1 << (room - k * s)
    return [g for room in sorted(groups) for g in groups[room]]


def _reach(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """For each place i, the sums of pieces of sizes[i:] up to ``room``, as bits."""
    within = (1 << (room + 1)) - 1
    out = [1] * (len(sizes) + 1)
    sums = 1
    for i in range(len(sizes) - 1, -1, -1):
        s = sizes[i]
        if sums >> s == within >> s:  # every sum from here on is reached: longer pieces add none
            out[: i + 1] = [sums] * (i + 1)
            break
        left, k = min(counts[s], room // s), 1
        while left:
            k = min(k, left)
            sums |= (sums << (k * s)) & within
            left -= k
            k *= 2
        out[i] = sums
    return out


def _dominated(filling: Filling, counts: list[int], here: int, waste: int) -> bool:
    """Whether a left-over piece fits in as well, or in place of one or two pieces that are not longer."""
    for s, k in filling:
        if counts[s] == k:
            here &= ~(1 << s)
    band = (2 << waste) - 1
    if here & band & ~1:
        return True
    for i, (s, k) in enumerate(filling):
        if (here >> (s + 1)) & (band >> 1):
            return True
        for t, _ in filling[i:]:
            if (s != t or k > 1) and (here >> (s + t)) & band:
                return True
    return False


def fillings(counts: list[int], sizes: list[int], room: int, most: int, looks: int) -> Iterator[tuple[int, Filling]]:
    """(waste, filling) of ``room`` with a waste of ``most`` at the utmost, undominated, out of the first ``looks``; ``sizes`` falls."""
    sizes = [s for s in sizes if s <= room]
    reach = _reach(sizes, counts, room)
    here = sum(1 << s for s in sizes)
    for waste in range(min(most, room) + 1):
        open_: list[tuple[int, int, Filling]] = [(0, room - waste, ())] if reach[0] >> (room - waste) & 1 else []
        while open_:
            i, target, taken = open_.pop()
            if not target:
                looks -= 1
                if not _dominated(taken, counts, here, waste):
                    yield waste, taken
                if looks <= 0:
                    return
                continue
            while i < len(sizes) and sizes[i] > target:
                i += 1
            if i == len(sizes) or not reach[i] >> target & 1:
                continue
            s = sizes[i]
            open_.append((i + 1, target, taken))  # many pieces come out first
            for k in range(1, min(counts[s], target // s) + 1):
                if reach[i + 1] >> (target - k * s) & 1:
                    open_.append((i + 1, target - k * s, (*taken, (s, k))))


def complete(histogram: dict[int, int], capacity: int, goal: int, nodes: int = NODES, width: int = WIDTH, turn: int = 0) -> Plan | None:
    """A packing into ``goal`` sequences, or None if none was found; each ``turn`` but 0 goes through equal wastes in another order."""
    counts = [histogram.get(s, 0) for s in range(capacity + 1)]
    slack = goal * capacity - sum(s * n for s, n in histogram.items())
    if slack < 0:
        return None
    order = random.Random(turn)

    def branches() -> Iterator[tuple[Filling, int, int]]:
        big = max(s for s, n in enumerate(counts) if n)
        counts[big] -= 1
        sizes = [s for s in range(min(big, capacity - big), 0, -1) if counts[s]]
        found = []
        for waste, rest in fillings(counts, sizes, capacity - big, slack, LOOKS * width):
            pieces = dict(rest)
            pieces[big] = pieces.get(big, 0) + 1
            found.append((waste, tuple(sorted(pieces.items(), reverse=True))))
            if len(found) == width:
                break
        counts[big] += 1
        if turn:
            found.sort(key=lambda x: (x[0], order.random()))
        out = []
        for waste, filling in found:
            times = min(counts[s] // k for s, k in filling)
            out.append((filling, min(times, slack // waste) if waste else times, waste))
        if out and out[0][1] > 1:  # the same filling once, if no other leads to the goal
            out.append((out[0][0], 1, out[0][2]))
        return iter(out)

    path: list[tuple[Filling, int, int]] = []
    levels = [branches()]
    while levels:
        step = next(levels[-1], None)
        if step is None:
            levels.pop()
            if path:
                filling, times, waste = path.pop()
                slack += waste * times
                for s, k in filling:
                    counts[s] += k * times
            continue
        filling, times, waste = step
        slack -= waste * times
        for s, k in filling:
            counts[s] -= k * times
        path.append(step)
        nodes -= 1
        if not any(counts):
            return [(times, filling) for filling, times, _ in path]
        if nodes <= 0:
            return None
        levels.append(branches())
    return None


def solve(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> Plan:
    """[(sequences, filling)] for all pieces: best fit's, or fewer sequences if the search finds a packing into them.

    ``nodes`` bounds a descent; an instance needs at least one for each filling
    in its packing, and lengths are at most the capacity, so it grows to twice their number.
    """
    histogram = {s: n for s, n in histogram.items() if n}
    if not histogram:
        return []
    best = best_fit(histogram, capacity)
    made, bound = sum(n for n, _ in best), lower_bound(histogram, capacity)
    for goal in range(bound, min(made, bound + GOALS)):
        for turn in range(DESCENTS if nodes else 0):
            found = complete(histogram, capacity, goal, max(nodes, 2 * len(histogram)), turn=turn)
            if found:
                return found
    return best
