"""An adaptive context-mixing range coder for token ids, over many lanes at once.

A block's ids are cut into lanes of equal length that are coded in step: at each
step every lane codes its next id with the model as it stands, then the model
learns all of them. So a block has one model, whatever its lanes, and numpy does
a step of all lanes at once.

An id is a path through a tree with 16 branches at a node, in which frequent ids
lie near the root; the block's header holds the depth of each id. At the three
upper levels the branches have probabilities that mix three orders: counts of the node
(order 0), of the node after the id before (order 1) and, at the root, after the
two ids before (order 2). Each context of orders 1 and 2 has a row: the sums of
frequencies before each branch. It begins as the lower order's and with each id
moves towards it, by much at first and by less later; at the root what is coded is
the mean of both rows. Which id of a deeper node it is goes by order 0 alone, in
one step. The rows lie in tables of hashed contexts.

All of it is arithmetic on integers, but for the shares of order 0, which come from
single operations on floats: what one machine writes another reads.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np

#: Bits of the tables of contexts.
TABLE_BITS = 17
#: Branches of a node; bits of their frequencies.
WAYS, FREQUENCY_BITS = 16, 15
#: The state has 64 bits; units of 16 bits leave it. A lane's range is at least 2**40 when it is settled, so that it can be
#: narrowed twice by 15 bits.
TOP, BOT = np.uint64(1 << 48), np.uint64(1 << 40)
LANES, LANE_IDS = 8192, 256
_ONE, _UNIT, _DOWN = np.uint64(1), np.uint64(16), np.uint64(48)
#: Levels whose branches are mixed; ids below are found in one step, by order 0, which is counted anew each REFRESH steps.
LEVELS, REFRESH = 3, 16
#: After so many steps rows learn from one of LEARN_EACH only.
ALL_STEPS, LEARN_EACH = 64, 4
#: A row is two numbers, so that it is read and written in few pieces; nothing is reckoned with them.
_HALF, _ROW = np.complex128, np.dtype("V32")
#: What a row moves towards when a branch comes: all but what the others keep at least.
_AIM = np.tile(np.arange(WAYS, dtype=np.int16), (WAYS, 1))
_AIM[np.triu_indices(WAYS, 1)] += np.int16((1 << FREQUENCY_BITS) - WAYS)
_AIM = _AIM.view(_ROW).ravel()
#: By how many bits the way is shortened, by the ids that the row has learned, in orders 1 and 2; a row's first place has that number.
_SHIFT = [np.repeat(np.array(x, np.int16), WAYS).view(_ROW) for x in ([3, 3, 3, 4, 4, 4, 4, 5], [2, 3, 3, 3, 3, 4])]
#: Multipliers of the hashes of contexts: of the id before, of both ids before, and of the node in either order.
_IDS, _NODES = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))), tuple(map(np.uint64, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)))
_HASHED = np.uint64(64 - TABLE_BITS)


def depths(counts: np.ndarray) -> np.ndarray:
    """How deep each id lies in the best tree for its counts; 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    seen = np.flatnonzero(counts).tolist()
    if len(seen) == 1:
        out[seen] = 1
    heap: list[tuple[int, int]] = [(int(counts[i]), i) for i in seen]
    number = len(counts)
    while len(heap) > 1 and (len(heap) - 1) % (WAYS - 1):
        heap.append((0, number))
        number += 1
    heapq.heapify(heap)
    below: list[tuple[int, ...]] = []
    first = number
    while len(heap) > 1:
        group = [heapq.heappop(heap) for _ in range(WAYS)]
        below.append(tuple(i for _, i in group))
        heapq.heappush(heap, (sum(n for n, _ in group), number))
        number += 1
    deep = np.zeros(number, np.uint8)
    for k in range(len(below) - 1, -1, -1):
        deep[list(below[k])] = deep[first + k] + 1
    out[seen] = np.maximum(deep[seen], out[seen])
    return out


class Tree:
    """The paths of ids of given depths: `path[d]` has for each id 16 times the node at depth d plus the branch, or -1; `child`
    has for that number the next node, or -1 less the id."""

    def __init__(self, depth: np.ndarray):
        ids = np.flatnonzero(depth)
        ids = ids[np.argsort(depth[ids], kind="stable")]
        deep = depth[ids].astype(np.int64)
        self.levels = int(deep[-1]) if len(ids) else 0
        if self.levels > 15:
            raise ValueError("a tree of more than 15 levels")
        # Codes of a depth follow one another; going deeper, what is left of a level is divided by 16.
        code, codes, before = 0, np.zeros(len(ids), np.int64), 0
        for d in range(1, self.levels + 1):
            code <<= 4
            n = int((deep == d).sum())
            codes[before : before + n] = np.arange(code, code + n)
            code, before = code + n, before + n
            if code > 1 << 4 * d:
                raise ValueError("these are no depths of a tree")
        self.path = np.full((self.levels, len(depth)), -1, np.int64)
        self.nodes = 0
        for d in range(self.levels):
            some = deep > d
            prefix = codes[some] >> 4 * (deep[some] - d)
            found, inverse = np.unique(prefix, return_inverse=True)
            branch = codes[some] >> 4 * (deep[some] - d - 1) & 15
            self.path[d, ids[some]] = (self.nodes + inverse) << 4 | branch
            self.nodes += len(found)
        self.child = np.full(max(self.nodes, 1) * WAYS, -1, np.int64)
        for d in range(self.levels):
            last = ids[deep == d + 1]
            self.child[self.path[d, last]] = -1 - last
            more = ids[deep > d + 1]
            if len(more):
                self.child[self.path[d, more]] = self.path[d + 1, more] >> 4


class Model:
    def __init__(self, tree: Tree, lanes: int):
        self.tree = tree
        self.sums = [np.zeros(2 << TABLE_BITS, _HALF) for _ in _SHIFT]
        self.before = np.zeros(lanes, np.uint64)
        self.contexts = (self.before, self.before)
        self.places = np.arange(0, lanes * WAYS, WAYS)
        self.count = np.full(max(tree.nodes, 1) * WAYS, 0.4)
        self.step, self.deep, self.fresh = 0, _Deep(tree), []

    def begin(self) -> None:
        """Before each step: order 0 as the steps before have left it, from time to time."""
        if self.step < REFRESH and self.step & (self.step - 1) == 0 or self.step % REFRESH == 0:
            new = np.bincount(np.concatenate(self.fresh)) if self.fresh else np.zeros(0, np.int64)
            self.fresh = []
            ids = np.flatnonzero(new)
            for path in self.tree.path[:LEVELS]:
                place = path[ids]
                some = place >= 0
                self.count += np.bincount(place[some], new[ids[some]], len(self.count))
            self.deep.refresh(ids, new[ids])
            upto = np.cumsum(self.count.reshape(-1, WAYS), axis=1)
            zero = np.zeros(upto.shape, np.int16)
            zero[:, 1:] = np.floor(upto[:, :-1] / upto[:, -1:] * ((1 << FREQUENCY_BITS) - WAYS)) + np.arange(1, WAYS)
            self.zero = zero.view(_ROW).ravel()

    def look(self, node: np.ndarray | None, live: np.ndarray | None, level: int) -> None:
        """Mixes the rows of a node in each lane (None: the root)."""
        self.rows = []
        for k in range(2 if level == 0 else 1):
            at = self.contexts[k] if live is None else self.contexts[k].take(live)
            if node is not None:
                at = at + node.view(np.uint64) * _NODES[k]
            at = (at >> _HASHED).view(np.int64)
            # One place more, for what comes after the last lane.
            room = np.empty((len(at) + 1) * WAYS, np.int16)
            row = room[:-WAYS]
            self.sums[k].view(_ROW).take(at, out=row.view(_ROW), mode="clip")
            age = row[::WAYS].copy()
            new = np.flatnonzero(age == 0)
            if len(new):
                row.view(_ROW)[new] = self.rows[0][2].view(_ROW).take(new) if k else self.zero.take(node.take(new)) if level else self.zero[0]
            self.rows.append((at, age, row))
        self.lane, self.mixed = self.places[: len(at)], room.view(np.uint16)
        if level == 0:
            self.mixed = np.empty_like(self.mixed)
            np.add(self.rows[0][2].view(np.uint16), row.view(np.uint16), out=self.mixed[:-WAYS])
            self.mixed >>= 1
        self.mixed[::WAYS] = 0

    def part(self, branch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a branch's part of the frequencies begins, and its width."""
        place = self.lane + branch
        begin = self.mixed.take(place)
        place += 1
        # After the last branch comes the next lane's 0, which here is the end.
        width = (self.mixed.take(place) - begin) & np.uint16((1 << FREQUENCY_BITS) - 1)
        return begin.astype(np.uint64), width.astype(np.uint64)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The branch in whose part a frequency lies, in each lane."""
        value = value.astype(np.uint16)
        place = self.lane.copy()
        for half in (8, 4, 2, 1):
            place += (self.mixed.take(place + half) <= value) * half
        return place - self.lane

    def learn(self, branch: np.ndarray) -> None:
        if self.step >= ALL_STEPS and self.step % LEARN_EACH:
            return
        aim = _AIM.take(branch).view(np.int16)
        for sums, shift, (at, age, row) in zip(self.sums, _SHIFT, self.rows):
            way = aim - row
            way >>= shift.take(age).view(np.int16)
            row += way
            row[::WAYS] = np.minimum(age + 1, len(shift) - 1)
            halves = np.empty((len(at), 2), np.int64)
            halves[:, 0] = halves[:, 1] = at
            halves = halves.ravel()
            halves += halves
            halves[1::2] += 1
            sums[halves] = row.view(_HALF)

    def end(self, ids: np.ndarray) -> None:
        self.fresh.append(ids)
        ids = ids.view(np.uint64)
        self.contexts = (ids * _IDS[0], ids * _IDS[1] + self.before * _IDS[2])
        self.before = ids
        self.step += 1


class _Deep:
    """Order 0 of the ids below the upper levels: each has its part of its node's range."""

    def __init__(self, tree: Tree):
        self.node = np.full(tree.path.shape[1], -1, np.int64)
        if tree.levels > LEVELS:
            place = tree.path[LEVELS]
            ids = np.flatnonzero(place >= 0)
            self.ids = ids[np.argsort(place[ids] >> 4, kind="stable")]
            self.node[self.ids] = place[self.ids] >> 4
            self.of = self.node[self.ids]
            self.first = np.flatnonzero(np.diff(self.of, prepend=-1))
            self.rank = np.arange(len(self.ids)) - np.repeat(self.first, np.diff(np.append(self.first, len(self.ids))))
            if self.rank.max() >= 1 << FREQUENCY_BITS - 1:
                raise ValueError("too many ids below one node")
            self.place = np.zeros(len(self.node), np.int64)
            self.place[self.ids] = np.arange(len(self.ids))
            self.count = np.full(len(self.node), 0.4)
        else:
            self.ids = np.zeros(0, np.int64)

    def refresh(self, ids: np.ndarray, more: np.ndarray) -> None:
        if not len(self.ids):
            return
        self.count[ids] += more
        count = self.count[self.ids]
        sizes = np.diff(np.append(self.first, len(self.ids)))
        upto = np.cumsum(count)
        start = np.repeat((upto - count)[self.first], sizes)
        whole = np.repeat(np.add.reduceat(count, self.first), sizes)
        room = (1 << FREQUENCY_BITS) - np.repeat(sizes, sizes)
        self.begin = np.minimum(np.maximum(np.floor((upto - count - start) / whole * room), 0), room) + self.rank
        last = np.append(self.first[1:], len(self.ids)) - 1
        self.stop = np.append(self.begin[1:], 0)
        self.stop[last] = 1 << FREQUENCY_BITS
        self.key = self.of * (1 << FREQUENCY_BITS) + self.begin

    def part(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.place[ids]
        return self.begin[at], self.stop[at]

    def find(self, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, node * (1 << FREQUENCY_BITS) + value, side="right") - 1
        return self.ids[np.maximum(at, 0)]


def lanes_for(n: int) -> tuple[int, int]:
    """(lanes, steps) for n ids; only the last lanes may be partly filled."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    steps = -(-n // lanes)
    return -(-n // steps), steps


class _Coder:
    """The low ends and ranges of all lanes."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 2**64 - 1, np.uint64)

    def narrow(self, some: np.ndarray | None, begin: np.ndarray, width: np.ndarray) -> None:
        """Takes the part of `width` from `begin` on of the ranges of some lanes (None: of all)."""
        if some is None:
            part = self.range >> np.uint64(FREQUENCY_BITS)
            self.low += part * begin
            self.range = part * width
        else:
            part = self.range.take(some) >> np.uint64(FREQUENCY_BITS)
            self.low[some] = self.low.take(some) + part * begin
            self.range[some] = part * width

    def settle(self) -> None:
        """Where ranges are small, units leave; a range that straddles a unit's border is cut there."""
        lanes = np.flatnonzero(self.range < BOT)
        if not len(lanes):
            return
        low, size = self.low.take(lanes), self.range.take(lanes)
        while True:
            apart = np.flatnonzero((low ^ (low + (size - _ONE))) >= TOP)
            if len(apart):
                size[apart] = (~low[apart] + _ONE) & (BOT - _ONE)
            self.pass_unit(lanes, low >> _DOWN)
            low, size = low << _UNIT, size << _UNIT
            self.low[lanes], self.range[lanes] = low, size
            more = np.flatnonzero(size < BOT)
            if not len(more):
                return
            lanes, low, size = lanes.take(more), low.take(more), size.take(more)

    def pass_unit(self, lanes: np.ndarray, units: np.ndarray) -> None:
        raise NotImplementedError


class _Writer(_Coder):
    def __init__(self, lanes: int, steps: int):
        super().__init__(lanes)
        self.units = np.zeros((lanes, steps + 16), np.uint16)
        self.n = np.zeros(lanes, np.int64)

    def pass_unit(self, lanes: np.ndarray, units: np.ndarray) -> None:
        at = self.n.take(lanes)
        if at.max() >= self.units.shape[1]:
            self.units = np.pad(self.units, ((0, 0), (0, self.units.shape[1])))
        self.units.reshape(-1)[lanes * self.units.shape[1] + at] = units
        self.n[lanes] = at + 1

    def finish(self) -> bytes:
        # Ranges are 2**40 or more: in each lie all numbers of some upper half. Lower halves needn't be written.
        code = (self.low + np.uint64((1 << 32) - 1)) & np.uint64((1 << 64) - (1 << 32))
        lanes = np.arange(len(self.low))
        for _ in range(2):
            self.pass_unit(lanes, code >> _DOWN)
            code = code << _UNIT
        kept = np.arange(self.units.shape[1]) < self.n[:, None]
        sizes = zlib.compress(self.n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)
        return len(sizes).to_bytes(4, "little") + sizes + self.units[kept].astype("<u2").tobytes()


class _Reader(_Coder):
    def __init__(self, payload: bytes, lanes: int):
        super().__init__(lanes)
        size = int.from_bytes(payload[:4], "little")
        n = np.frombuffer(zlib.decompress(payload[4 : 4 + size]), np.uint8).reshape(4, lanes).T.copy().view("<u4").ravel().astype(np.int64)
        self.units = np.append(np.frombuffer(payload[4 + size :], "<u2"), np.uint16(0))
        self.next = np.cumsum(n) - n
        self.code = np.zeros(lanes, np.uint64)
        for _ in range(4):
            self.pass_unit(np.arange(lanes), None)

    def value(self, some: np.ndarray | None) -> np.ndarray:
        """Where in their ranges the codes of some lanes (None: of all) lie, in frequencies."""
        if some is None:
            ahead, size = self.code - self.low, self.range
        else:
            ahead, size = self.code.take(some) - self.low.take(some), self.range.take(some)
        return np.minimum(ahead // (size >> np.uint64(FREQUENCY_BITS)), np.uint64((1 << FREQUENCY_BITS) - 1))

    def pass_unit(self, lanes: np.ndarray, units: np.ndarray | None) -> None:
        # After a lane's last unit any others do: its code then lies in the last range with all that may follow.
        at = self.next.take(lanes)
        unit = self.units.take(np.minimum(at, len(self.units) - 1))
        self.code[lanes] = (self.code.take(lanes) << _UNIT) | unit
        self.next[lanes] = at + 1


def encode(ids: np.ndarray, vocabulary: int) -> tuple[int, int, bytes]:
    """(lanes, steps, payload) of a block's ids, all below `vocabulary`."""
    if not len(ids):
        return 0, 0, b""
    lanes, steps = lanes_for(len(ids))
    table = np.full(lanes * steps, ids[-1], np.int64)
    table[: len(ids)] = ids
    deep = depths(np.bincount(ids, minlength=vocabulary))
    header = zlib.compress(deep.tobytes(), 6)
    table = np.ascontiguousarray(table.reshape(lanes, steps).T)
    tree = Tree(deep)
    model, out = Model(tree, lanes), _Writer(lanes, steps)
    for now in table:
        model.begin()
        live = None
        for level in range(min(LEVELS + 1, tree.levels)):
            place = tree.path[level].take(now if live is None else now.take(live))
            if level:
                more = np.flatnonzero(place >= 0)
                live, place = (more if live is None else live.take(more)), place.take(more)
                if not len(live):
                    break
            if level == LEVELS:
                begin, stop = model.deep.part(now.take(live))
                begin, width = begin.astype(np.uint64), (stop - begin).astype(np.uint64)
            else:
                branch = place & 15 if level else place
                model.look(place >> 4 if level else None, live, level)
                begin, width = model.part(branch)
                model.learn(branch)
            out.narrow(live, begin, width)
            if level == 1:
                out.settle()
        out.settle()
        model.end(now)
    return lanes, steps, len(header).to_bytes(4, "little") + header + out.finish()


def decode(n: int, lanes: int, steps: int, payload: bytes, vocabulary: int) -> np.ndarray:
    """The n ids of a block."""
    if not n:
        return np.zeros(0, np.int64)
    size = int.from_bytes(payload[:4], "little")
    tree = Tree(np.frombuffer(zlib.decompress(payload[4 : 4 + size]), np.uint8, vocabulary))
    model, coder = Model(tree, lanes), _Reader(payload[4 + size :], lanes)
    table = np.empty((steps, lanes), np.int64)
    for now in table:
        model.begin()
        live, node = None, None
        for level in range(min(LEVELS + 1, tree.levels)):
            value = coder.value(live)
            if level == LEVELS:
                ids = model.deep.find(node, value.astype(np.float64))
                begin, stop = model.deep.part(ids)
                begin, width = begin.astype(np.uint64), (stop - begin).astype(np.uint64)
                child = -1 - ids
            else:
                model.look(node, live, level)
                branch = model.find(value)
                begin, width = model.part(branch)
                model.learn(branch)
                child = tree.child.take(node << 4 | branch if level else branch)
            coder.narrow(live, begin, width)
            if level == 1:
                coder.settle()
            done = np.flatnonzero(child < 0)
            # A damaged payload may name what no id has (then id 0 stands here); the block's checksum tells.
            now[done if live is None else live.take(done)] = -1 - child.take(done)
            more = np.flatnonzero(child >= 0)
            live, node = (more if live is None else live.take(more)), child.take(more)
            if not len(live):
                break
        coder.settle()
        model.end(now)
    return table.T.ravel()[:n]
