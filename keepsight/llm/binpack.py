"""Bin completion over a histogram of lengths.

All documents of a length are alike to a packer, so a corpus of any size is a
histogram of at most `capacity` counts, and a plan is a list of fillings with
the number of times each is used.

The incumbent is best-fit decreasing. While it is above the lower bound,
branch and bound completes one bin after another around the largest document
left: it enumerates undominated fillings of what is left of the bin, fullest
first, uses each as often as the counts allow, and drops a branch whose waste
is above what a better plan may waste.

The search widens: it tries `width` fillings at each node, then twice as many,
until a plan meets the lower bound, nothing is left to widen, or node_limit
nodes are used up; what it used and the gap that is left come with the plan.
Without a node limit every undominated filling is tried each time one or more
of its bins are closed, and the plan is the best there is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

Filling = tuple[int, ...]
#: Nodes that branch and bound may visit in all, and fillings that it first tries at each.
NODE_LIMIT, WIDTH = 5000, 4
#: Documents of a filling up to which dominance is tested; longer ones are all tried.
DOMINANCE = 4


@dataclass
class Plan:
    """Fillings and their numbers, the sequences used, a lower bound of them, and the nodes visited."""

    fillings: list[tuple[Filling, int]]
    bins: int
    bound: int
    nodes: int
    complete: bool

    @property
    def gap(self) -> int:
        """Sequences above the lower bound; 0 means that no plan is better, as does complete."""
        return self.bins - self.bound


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bound that counts documents over half a bin."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in sorted({0, *(n for n in counts if 2 * n <= capacity)}):
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        half = [(n, c) for n, c in counts.items() if capacity - k >= n and 2 * n > capacity]
        free = sum(c for _, c in half) * capacity - sum(n * c for n, c in half)
        small = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing: each document goes to the fullest bin that has room; bins alike are one entry."""
    rooms: list[int] = []  # ascending
    bins: dict[int, list[tuple[Filling, int]]] = {}

    def put(filling: Filling, times: int) -> None:
        room = capacity - sum(filling)
        if room not in bins:
            bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        bins[room].append((filling, times))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                fit = capacity // n
                if left >= fit:
                    put((n,) * fit, left // fit)
                if left % fit:
                    put((n,) * (left % fit), 1)
                break
            room = rooms[at]
            filling, times = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            fit = room // n
            used = min(times, left // fit)
            if used:
                put(filling + (n,) * fit, used)
                if times > used:
                    put(filling, times - used)
                left -= used * fit
            else:
                put(filling + (n,) * left, 1)
                if times > 1:
                    put(filling, times - 1)
                left = 0
    return [x for room in rooms for x in bins[room]]


def dominated(b: Filling, a: Filling) -> bool:
    """Whether b's documents can be dealt into groups that each fit in the place of one of a's. Long fillings count as not dominated."""
    if len(b) > DOMINANCE:
        return False
    places = list(a)

    def deal(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for j, room in enumerate(places):
            if room >= b[i] and room not in tried:
                tried.add(room)
                places[j] -= b[i]
                if deal(i + 1):
                    return True
                places[j] += b[i]
        return False

    return len(b) >= len(a) and sum(b) <= sum(a) and deal(0)


def completions(counts: dict[int, int], room: int, width: int | None = WIDTH) -> tuple[list[Filling], bool]:
    """Undominated fillings of a room, fullest first and large documents first, and whether they are all; at most width of them."""
    sizes = [n for n in sorted(counts, reverse=True) if n <= room and counts[n]]
    mask, reach = (1 << room + 1) - 1, [1]  # reach[k]: sums of the k smallest sizes
    for n in reversed(sizes):
        r = reach[-1]
        for _ in range(min(counts[n], room // n)):
            wider = r | (r << n & mask)
            if wider == r:
                break
            r = wider
        reach.append(r)

    def fillings(target: int, at: int):
        """Fillings of exactly target with documents of sizes[at:], those with more of the large ones first."""
        path: list[tuple[int, int, int, tuple[int, ...]]] = [(target, at, 0, ())]
        while path:
            left, i, _, held = path.pop()
            if not left:
                yield held
                continue
            while i < len(sizes) and sizes[i] > left:
                i += 1
            if i == len(sizes):
                continue
            n = sizes[i]
            for k in range(min(counts[n], left // n) + 1):  # the last pushed comes first
                if reach[len(sizes) - i - 1] >> left - k * n & 1:
                    path.append((left - k * n, i + 1, 0, held + (n,) * k))

    found: list[Filling] = []
    tries = 0
    for target in range(room, -1, -1):
        if not reach[-1] >> target & 1:
            continue
        for x in fillings(target, 0):
            if width is not None and (len(found) >= width or tries >= 4 * width):
                return found, False
            tries += 1
            if not any(dominated(x, y) for y in found):
                found.append(x)
    return found, True


def pack(counts: dict[int, int], capacity: int, node_limit: int | None = NODE_LIMIT, width: int | None = WIDTH) -> Plan:
    """Fillings and how often each is used, so that every document is placed once. node_limit None searches until the plan is the best there is."""
    counts = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    first = best_fit(counts, capacity)
    plan = Plan(first, sum(t for _, t in first), lower_bound(counts, capacity), 0, False)
    plan.complete = plan.gap == 0
    if node_limit is None:
        width = None
    while plan.gap and not plan.complete and (node_limit is None or plan.nodes < node_limit):
        plan.complete = searched(plan, counts, capacity, node_limit, width)
        width = width and width * 2
    return plan


def searched(plan: Plan, counts: dict[int, int], capacity: int, node_limit: int | None, width: int | None) -> bool:
    """One depth-first search, which improves the plan; whether it left out nothing."""
    total, whole = sum(n * c for n, c in counts.items()), True

    def children(left: dict[int, int], waste: int, used: int, path: tuple):
        nonlocal whole
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        tried, all_of = completions(rest, capacity - largest, width)
        whole &= all_of
        for x in tried:
            filling = (largest, *x)
            lost = capacity - sum(filling)
            each = Counter(filling)
            times = min(left[n] // k for n, k in each.items())
            # As often as can be, once, and without a node limit each number between.
            for t in range(times, 0, -1) if width is None else dict.fromkeys((times, 1)):
                if waste + lost * t <= (plan.bins - 1) * capacity - total:
                    after = dict(left)
                    for n, k in each.items():
                        after[n] -= t * k
                        if not after[n]:
                            del after[n]
                    yield after, waste + lost * t, used + t, (path, (filling, t))

    stack = [iter([(counts, 0, 0, None)])]
    while stack and plan.gap:
        if node_limit is not None and plan.nodes >= node_limit:
            return False
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        plan.nodes += 1
        left, waste, used, path = node
        if left:
            if used + lower_bound_quick(left, capacity) < plan.bins:
                stack.append(children(left, waste, used, path))
        elif used < plan.bins:
            plan.bins, plan.fillings = used, []
            while path:
                path, step = path
                plan.fillings.append(step)
    # A search of bounded width tries numbers of a filling only at their ends.
    return not plan.gap or whole and width is None


def lower_bound_quick(counts: dict[int, int], capacity: int) -> int:
    return max(-(-sum(n * c for n, c in counts.items()) // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
