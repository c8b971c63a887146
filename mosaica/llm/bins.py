"""Bin completion by branch and bound over a histogram of piece lengths.

Equal lengths are interchangeable, so a packing is a list of patterns (lengths of one bin, how many bins). Each step takes the
largest length left, enumerates undominated fillings of the room beside it (a filling is dominated when some of its pieces can be
exchanged for one larger piece that is there), least waste first, and applies a filling to as many bins at once as the counts
allow, or to one. A branch is cut when its waste passes what the incumbent - best fit decreasing at the start - leaves. The size of the problem is the number of different lengths, at most the capacity, whatever the number of
documents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2 over all thresholds: no packing has fewer bins."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in sorted({s for s in counts if 2 * s <= capacity}):
        large = sum(n for s, n in counts.items() if s > capacity - k)
        mid = [(s, n) for s, n in counts.items() if capacity - k >= s and 2 * s > capacity]
        small = sum(s * n for s, n in counts.items() if k <= s and 2 * s <= capacity)
        n_mid = sum(n for _, n in mid)
        room = n_mid * capacity - sum(s * n for s, n in mid)
        best = max(best, large + n_mid + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing, with equal bins kept as one."""
    groups: dict[int, list[list]] = {}  # room -> [[pattern, bins]]
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append([pattern, n])

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                per = min(capacity // s, left)
                full, rest = divmod(left, per)
                put(capacity - per * s, (s,) * per, full)
                left = rest
                continue
            room = rooms[i]
            pattern, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            fit = min(room // s, -(-left // n))
            bins = min(n, left // fit)
            if bins < n:
                put(room, pattern, n - bins)
            put(room - fit * s, pattern + (s,) * fit, bins)
            left -= bins * fit
    return [(p, n) for g in groups.values() for p, n in g]


def dominated(chosen: tuple[int, ...], spare: int, free: int) -> bool:
    """Whether one larger piece that is left could take the place of some of the chosen ones (Martello and Toth's criterion).

    ``free`` has a bit for each length that is left besides the chosen pieces. Sums of one piece and of several are bit sets, so all
    subsets are tried at once; a single piece's own length in its own place is no exchange.
    """
    one = several = 0
    for s in chosen:
        several |= (one | several) << s
        one |= 1 << s
    # Several pieces may go for one of just their sum; a single one only for a larger.
    return bool((_smeared(one << 1, spare - 1) | _smeared(several, spare)) & free) if spare else bool(several & free)


def _smeared(bits: int, most: int) -> int:
    """The bits moved up by 0 to ``most``."""
    done = 0
    while done < most:
        step = min(done + 1, most - done)
        bits |= bits << step
        done += step
    return bits


#: So many fillings without waste are choice enough in one place.
_PERFECT = 4


def fillings(counts: dict[int, int], sizes: list[int], room: int, nodes: int) -> tuple[list[tuple[int, ...]], int]:
    """Undominated fillings of ``room``, least waste first, and the search nodes opened: at most ``nodes``. ``sizes`` are the lengths left, ascending.

    The best-fit filling, largest first, is the first to be met, so there always is one. Some fillings without waste end the search.
    """
    if not sizes or room < sizes[0]:
        return [()], 1
    perfect = there = 0
    for s in sizes:
        there |= 1 << s
    found: list[tuple[int, tuple[int, ...]]] = []
    first: tuple[int, ...] | None = None
    left = nodes
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, len(sizes) - 1, ())]  # room, largest length allowed, chosen
    while stack and (left > 0 or not found):
        rest, top, chosen = stack.pop()
        i = min(top, bisect_right(sizes, rest) - 1)
        while i >= 0 and counts[sizes[i]] <= chosen.count(sizes[i]):
            i -= 1
        if i >= 0:
            left -= 1
            stack.append((rest, i - 1, chosen))  # without this length
            stack.append((rest - sizes[i], i, (*chosen, sizes[i])))
            continue
        if first is None:
            first = chosen
        # A leaf that leaves out a piece for which there is room is dominated too: spare reaches it from no piece at all.
        free = there
        for s in set(chosen):
            if counts[s] <= chosen.count(s):
                free ^= 1 << s
        fits = free & ((1 << rest + 1) - 1)
        if not fits and not dominated(chosen, rest, free):
            found.append((rest, chosen))
            perfect += rest == 0
        if left <= 0 or perfect == _PERFECT:
            break
    return [c for _, c in sorted(found)] or [first or ()], nodes - left + 1


def complete(counts: dict[int, int], capacity: int, nodes: int = 2000, effort: int = 60_000) -> list[Pattern]:
    """A packing of all pieces: the best of best fit decreasing and the bin completion search.

    Where best fit meets the lower bound it can't be bettered and is taken. Else each turn of the search goes down once: the largest length
    left gets a filling, which is used for as many bins as there are pieces for, or for one bin only; the next turn takes another filling
    at the latest place that has one. A branch ends when its waste shows that it can't better the incumbent. ``nodes`` bounds the
    search for one bin's fillings, ``effort`` all search nodes (some seconds); both bound time only, as the incumbent is a whole packing at any time.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    size = lambda p: sum(n for _, n in p)
    total = sum(s * n for s, n in counts.items())
    stack: list[tuple[dict[int, int], list[Pattern], int, list[tuple[tuple[int, ...], int]] | None]] = [(counts, [], 0, None)]
    while stack and size(best) > least and effort > 0:
        left, packed, waste, todo = stack.pop()
        left, packed = dict(left), list(packed)
        allowed = (size(best) - 1) * capacity - total
        while left and waste <= allowed and effort > 0:
            if todo is None:
                sizes = sorted(left)
                big = sizes[-1]
                left[big] -= 1
                options, opened = fillings(left, [s for s in sizes if left[s]], capacity - big, nodes)
                effort -= opened
                left[big] += 1
                todo = []
                for o in options:
                    pattern = (big, *o)
                    times = min(left[s] // pattern.count(s) for s in set(pattern))
                    todo += [(pattern, times)] + ([(pattern, 1)] if times > 1 else [])
            (pattern, times), later = todo[0], todo[1:]
            if later:
                stack.append((dict(left), list(packed), waste, later))
            waste += times * (capacity - sum(pattern))
            for s in set(pattern):
                left[s] -= times * pattern.count(s)
                if not left[s]:
                    del left[s]
            packed.append((pattern, times))
            todo = None
        if not left and size(packed) < size(best):
            best = packed
    return best
