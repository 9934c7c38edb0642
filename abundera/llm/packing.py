"""Filling containers of fixed capacity by bin completion.

Items are spread by a hash over shards of bounded size, so neither a hot source
nor the corpus is ever one task's; every shard is packed by branch and bound:
the largest unpacked item opens a container, all its undominated fillings are
tried in order of waste, a branch ends when its waste can no longer beat the
incumbent, and the incumbent starts as best-fit decreasing.  A shard wastes at
most about one container, so the loss by sharding is below 1 in the number of
containers of a shard.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundera.session import materialize

#: Items of a shard on average.
SHARD_ITEMS = 8192
#: Steps of a shard's search (sizes decided, in all its fillings) for each of its items and beyond that, after which the incumbent stands.
STEPS_AN_ITEM, STEPS = 100, 400_000
#: Most tasks the shards are spread over.
MAX_TASKS = 10_000


class Stock:
    """Available sizes as counts."""

    def __init__(self, sizes: list[int]) -> None:
        self.count = Counter(sizes)
        self.left = len(sizes)

    def take(self, items: tuple[int, ...]) -> None:
        self.left -= len(items)
        for s in items:
            self.count[s] -= 1
            if not self.count[s]:
                del self.count[s]

    def give(self, items: tuple[int, ...]) -> None:
        self.left += len(items)
        for s in items:
            self.count[s] += 1

    def largest(self) -> int:
        return max(self.count)


def smear(bits: int, width: int) -> int:
    """Every bit and the ``width`` places above it."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def sums(size: int, count: int, reach: int, mask: int) -> int:
    """The bit set of sums reachable with up to ``count`` more items of one size."""
    step = 1
    while count:
        use = min(step, count)
        reach |= (reach << (size * use)) & mask
        count -= use
        step *= 2
    return reach


def fillings(stock: Stock, slack: int, most_waste=lambda: 1 << 30, step=lambda: True) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of the slack, least waste first, large items first among equals.

    A filling is dominated if some of its items, or none, can give way to one
    item left out that is as large as they are together or larger, within the
    room: whatever packs the rest without the swap also does with it.  Sums are
    enumerated downwards from the slack to the largest waste that can still
    beat the incumbent; a bit set of the sums that the smaller sizes reach lets
    the enumeration enter only branches that end in the sum, and a branch is
    left as soon as its items are dominated.  Read lazily; ends early where
    ``step`` says that the budget is spent.
    """
    sizes = sorted((s for s in stock.count if s <= slack), reverse=True)
    mask, below = (1 << (slack + 1)) - 1, [1]
    for s in reversed(sizes):
        below.append(sums(s, min(stock.count[s], slack // s), below[-1], mask))
    below.reverse()  # below[i]: what sizes[i:] reach
    upto = [0]
    for s in sizes:
        upto.append(upto[-1] | 1 << s)

    def dominated(one: int, more: int, out: int, room: int) -> bool:
        return bool(smear(more | 1, room) & out or room and smear(one << 1, room - 1) & out)

    def exact(target: int) -> Iterator[tuple[int, ...]]:
        room = slack - target
        stack: list[tuple[int, int, tuple[int, ...], int, int, int]] = [(0, target, (), 0, 0, 0)]
        while stack and step():
            i, rest, chosen, one, more, out = stack.pop()  # bits of: chosen sizes, sums of two or more of them, sizes left out
            if not rest:
                if not dominated(one, more, out | upto[-1] & ~upto[i], room):
                    yield chosen
                continue
            start = i
            while i < len(sizes) and sizes[i] > rest:
                i += 1
            if i == len(sizes):
                continue
            out |= upto[i] & ~upto[start]
            s, n = sizes[i], stock.count[sizes[i]]
            if not below[i] >> rest & 1 or out & ~mask:
                continue
            for k in range(0, min(n, rest // s) + 1):  # the most of the largest size comes off the stack first
                if below[i + 1] >> (rest - k * s) & 1:
                    all_sums = more | one | 1
                    new_more = more
                    for _ in range(k):
                        new_more |= (all_sums & ~1) << s
                        all_sums |= all_sums << s
                    now = out | 1 << s if k < n else out
                    new_one = one | 1 << s if k else one
                    if not dominated(new_one, new_more, now, room):
                        stack.append((i + 1, rest - k * s, chosen + (s,) * k, new_one, new_more, now))

    for target in range(slack, -1, -1):
        if slack - target > most_waste():
            return
        if below[0] >> target & 1:
            yield from exact(target)


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: by total size, and by large items that leave no room for the middle ones."""
    best = -(-sum(sizes) // capacity)
    ordered = sorted(sizes)
    for k in sorted({s for s in ordered if s <= capacity // 2} | {0}):
        large = sum(s > capacity - k for s in ordered)
        upper = [s for s in ordered if capacity / 2 < s <= capacity - k]
        middle = sum(s for s in ordered if k <= s <= capacity / 2)
        best = max(best, large + len(upper) + max(0, -(-(middle - (len(upper) * capacity - sum(upper))) // capacity)))
        if len(ordered) > 2000:  # the total decides long before among so many
            break
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the incumbent."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for s in sorted(sizes, reverse=True):
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(s)
        else:
            at, room = len(bins), capacity
            bins.append([s])
        by_room[room - s].append(at)
        rooms |= 1 << (room - s)
    return bins


def complete(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers for sizes between 1 and ``capacity``: bin completion within a budget of steps."""
    incumbent = best_fit(sizes, capacity)
    total, bound = sum(sizes), lower_bound(sizes, capacity)
    stock, spent, budget = Stock(sizes), 0, STEPS + STEPS_AN_ITEM * len(sizes)
    chosen: list[tuple[int, ...]] = []
    branches: list[tuple[int, Iterator[tuple[int, ...]], int]] = []  # largest item, its fillings, waste before it

    def step() -> bool:
        nonlocal spent
        spent += 1
        return spent <= budget

    def expand(waste: int) -> None:
        first = stock.largest()
        stock.take((first,))
        found = fillings(stock, capacity - first, lambda: (len(incumbent) - 1) * capacity - total - waste, step)
        branches.append((first, found, waste))

    if len(incumbent) > bound:
        expand(0)
    while branches and spent < budget and len(incumbent) > bound:
        first, found, at = branches[-1]
        if len(chosen) == len(branches):  # back from the last filling
            stock.give(chosen.pop())
        f = next(found, None)
        waste = at + capacity - first - sum(f or ())
        if f is None or waste > (len(incumbent) - 1) * capacity - total:  # all further fillings waste more: none beats the incumbent
            branches.pop()
            stock.give((first,))
            continue
        stock.take(f)
        chosen.append(f)
        if not stock.left:
            incumbent = [[b[0], *c] for b, c in zip(branches, chosen)]
        else:
            expand(waste)
    return incumbent


def pack(sizes: DataFrame, row_id: str, size: str, capacity: int) -> DataFrame:
    """``(row id, piece, start, n_tokens, container_id)``: every item in containers of ``capacity``.

    An item larger than the capacity is cut into full pieces and a rest; no
    other item is split.  Items of size 0 or null come out with size 0 and the
    container null.  Repeated items are packed each on its own; an empty table
    gives no rows.
    """
    table = materialize(sizes.select(F.col(row_id).cast("bigint").alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("n")), "sizes")
    shards = max(1, -(-table.count() // SHARD_ITEMS))

    def one(group: pa.Table) -> pa.Table:
        ids, sizes_, shard = group.column("id").to_pylist(), group.column("n").to_pylist(), group.column("shard")[0].as_py()
        base, nxt, rows = shard << 24, 0, []
        waiting: dict[int, list[tuple[int, int, int]]] = {}
        for rid, n in sorted(zip(ids, sizes_)):
            if n <= 0:
                rows.append((rid, 0, 0, 0, None))
                continue
            full, rest = divmod(n, capacity)
            for p in range(full):
                rows.append((rid, p, p * capacity, capacity, base + nxt))
                nxt += 1
            if rest:
                waiting.setdefault(rest, []).append((rid, full, full * capacity))
        for container in complete([s for s, items in waiting.items() for _ in items], capacity):
            for s in container:
                rid, piece, start = waiting[s].pop()
                rows.append((rid, piece, start, s, base + nxt))
            nxt += 1
        cols = list(zip(*rows))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=[row_id, "piece", "start", "n_tokens", "container_id"])

    sharded = table.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).repartition(min(shards, MAX_TASKS), "shard")  # small in bytes, not in work: never put together
    return sharded.groupBy("shard").applyInArrow(one, f"`{row_id}` bigint, piece int, start int, n_tokens int, container_id bigint")
