"""Context-mixing range coder for token ids.

Ids are cut into blocks that are coded for themselves. In a block the next id is predicted
from the two ids before it (order 2), from the one before it (order 1) and from how often
each id of the block came so far (order 0). The predictions are mixed by weights that adapt
to how often each was right at its present confidence. The mix gives the id that order 2
names, the one that order 1 names and all ids seen so far by their frequency an interval
each for the range coder. A share of order 0 stands for ids not yet known; these are written
plainly, from the end of the block's code backwards.

Blocks do not depend on each other, so many are coded side by side: every step handles the
n-th id of all blocks with array operations. What was seen is learned a span of steps at a
time, and the intervals of order 0 are renewed ever more seldom. Within a span all
predictions stand, so the encoder, which knows the ids, finds its intervals for a whole span
at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

#: Ids of a block, and blocks that are coded side by side.
BLOCK = 4096
LANES = 2048
#: Ids are below this.
IDS = 1 << 16

_ORDER0, _ORDER1, _ORDER2 = range(3)
_SLOTS1, _SLOTS2 = 10, 11  # table sizes as powers of two
_SURE = 3  # highest confidence
_STEP, _LIMIT = 24, 1 << 11
_SPAN = 64  # most steps between two times of learning
_RENEW = 256  # most steps between two times that order 0 is renewed
_BITS0, _BITS = 12, 12  # intervals of order 0 and of the events are parts of these powers of two
_ALL = _BITS0 + _BITS
# The range coder has 48 bits and gives out words of 16.
_TOP, _LOW = (1 << 48) - 1, 1 << 32


def _spans(steps: int) -> Iterator[tuple[int, int, bool]]:
    """First and last step of each span, and whether order 0 is renewed before it."""
    begin, renew = 0, 0
    while begin < steps:
        due = begin == renew
        if due:
            renew += min(max(begin, 8), _RENEW)
        end = min(begin + _SPAN, renew, steps)
        yield begin, end, due
        begin = end


class _Mix:
    """What the blocks (lanes) have seen so far."""

    def __init__(self, lanes: int):
        self.lanes, self.lane, self.lane16 = lanes, np.arange(lanes), np.arange(lanes) * 16
        # Tables hold the lanes side by side, so what many blocks look up is close together.
        self.table1 = np.zeros(lanes << _SLOTS1, np.int32)  # id * 4 + confidence
        self.table2 = np.zeros(lanes << _SLOTS2, np.int32)
        # Weights of the three events by lane and the confidences of order 2 and order 1; whole numbers.
        first = np.zeros((3, 16), np.float32)
        first[_ORDER0] = 80
        first[_ORDER1, [i for i in range(16) if i % 4]] = 24
        first[_ORDER2, 4:] = 24
        self.weights = np.tile(first, (1, lanes))
        # Order 0: ids are numbered from 1 as they come, 0 stands for all others.
        self.known, self.total = np.zeros(lanes, np.int64), np.zeros(lanes)
        self.id_of = np.zeros((lanes, 1), np.uint16)
        self.count = np.zeros((lanes, 1), np.float32)
        self.given: list[np.ndarray] = []  # lane and number of what order 0 gave since it was renewed
        self.fresh: list[np.ndarray] = []  # lane and id of what it did not know
        self.weigh()

    def weigh(self) -> None:
        """Where the intervals of order 1 and order 2 begin; order 0 has the first."""
        share = self.weights[1:] * (np.float32(1 << _BITS) / self.weights.sum(axis=0))
        one, two = share.astype(np.int32)
        two = (1 << _BITS) - two
        self.begins = two << 16 | two - one

    def renew(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count what order 0 gave and number the new ids. Returns their lanes, ids and numbers."""
        width = self.count.shape[1]
        given, fresh = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.given, self.fresh))
        self.given, self.fresh = [], []
        self.count[:, 0] = 0
        np.add.at(self.count.reshape(-1), given, np.float32(1))
        rest, came = self.count[:, 0].astype(np.float64), self.count.sum(axis=1) - self.total
        keys, times = np.unique(fresh, return_counts=True)
        lane, ids = keys >> 16, keys & 0xFFFF
        number = self.known[lane] + 1 + np.arange(len(lane)) - np.searchsorted(lane, lane)
        self.known += np.bincount(lane, minlength=self.lanes)
        more = int(self.known.max(initial=0)) + 1 - width
        if more > 0:
            self.count, self.id_of = (np.pad(x, ((0, 0), (0, more))) for x in (self.count, self.id_of))
        self.count[lane, number], self.id_of[lane, number] = times, ids
        # The rest counts at the rate at which new ids came since order 0 was last renewed.
        self.total += came
        self.count[:, 0] = np.floor(self.total * rest / np.maximum(came, 1)) + 1
        room = (1 << _BITS0) - 1 - self.known
        share = self.count * (room / (self.total + self.count[:, 0])).astype(np.float32)[:, None]
        size = np.ceil(share, out=share).astype(np.int32)
        size[:, 0] = 0
        size[:, 0] = (1 << _BITS0) - size.sum(axis=1)
        # First part and number of parts of each interval in one integer.
        self.parts = ((np.cumsum(size, axis=1, dtype=np.int32) - size) << 16 | size).ravel()
        self.size, self.row = size, self.lane * size.shape[1]
        return lane, ids, number

    def slots(self) -> np.ndarray:
        """Number whose order 0 interval holds a place, for all lanes and places."""
        lanes, width = self.size.shape
        return np.repeat(np.tile(np.arange(width, dtype=np.uint16), lanes), self.size.ravel())

    def places(self, before2: np.ndarray, before1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the tables hold what followed these ids; in one row or several."""
        mixed = before1 * 40503
        one = (mixed >> 5 & (1 << _SLOTS1) - 1) * self.lanes + self.lane
        return one, (before2 * 30011 + mixed >> 6 & (1 << _SLOTS2) - 1) * self.lanes + self.lane

    def learn(self, ids, event, row, number, new, at1, at2, one, two) -> None:
        """Learn a span: its ids, the events and numbers that gave them, and what was predicted."""
        seen = np.bincount((event * (self.lanes * 16) + row).ravel(), minlength=self.weights.size)
        self.weights += seen.reshape(self.weights.shape) * _STEP
        full = self.weights.sum(axis=0) > _LIMIT
        if full.any():
            self.weights = np.where(full, np.ceil(self.weights * np.float32(0.5)), self.weights)
        self.weigh()
        ids4 = (ids << 2).astype(np.int32)
        for table, at, entry in ((self.table1, at1, one), (self.table2, at2, two)):
            more = np.minimum(entry + 1, ids4 + _SURE)
            less = np.where(entry & 3 > 1, entry - 1, ids4 + 1)
            table[at] = np.where(_right(entry, ids4), more, less)  # of equal places the last one counts
        # Order 0 learns the ids that the higher orders did not give.
        self.given.append((self.row + number)[event == _ORDER0])
        step, lane = new
        self.fresh.append(lane << 16 | ids[step, lane])


def _right(entry: np.ndarray, ids4: np.ndarray) -> np.ndarray:
    """Whether an entry names the id, with some confidence."""
    return (entry - ids4 - 1).view(np.uint32) < _SURE


def _lengths(n: int, block: int) -> np.ndarray:
    return np.minimum(block, n - np.arange(0, n, block))


def _checked(block: int) -> int:
    if block > 1 << _BITS0:
        raise ValueError(f"blocks have {1 << _BITS0} ids at most")
    return block


def encode(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> list[tuple[bytes, int]]:
    """Code and CRC-32 (of the ids as little-endian 32-bit integers) of each block."""
    if len(ids) and int(ids.max()) >= IDS:
        raise ValueError(f"ids must be below {IDS}")
    out = []
    for at in range(0, len(ids), _checked(block) * lanes):
        out += _encode_lanes(ids[at : at + block * lanes], block)
    return out


def _encode_lanes(ids: np.ndarray, block: int) -> list[tuple[bytes, int]]:
    lengths = _lengths(len(ids), block)
    n, steps, short = len(lengths), int(lengths[0]), int(lengths[-1])
    grid = np.zeros((n, steps), np.uint32)
    grid.ravel()[: len(ids)] = ids  # only the last block can be shorter
    # Numbers of order 0 by id and lane, of the ids that there are.
    there = np.zeros(IDS, bool)
    there[ids] = there[0] = True
    place_of = (np.cumsum(there) - 1) * n
    number_of = np.zeros(int(place_of[-1]) + n, np.uint16)
    mix, low, span = _Mix(n), np.zeros(n, np.int64), np.full(n, _TOP, np.int64)
    before, words, plain = np.zeros((2, n), np.int64), [], []

    def put(lane: np.ndarray, word: np.ndarray) -> None:
        words.append((lane.astype(np.int32), word.astype(np.int32)))

    for begin, end, due in _spans(steps):
        if due:
            lane, new, number = mix.renew()
            number_of[place_of[new] + lane] = number
        now = np.concatenate((before, grid[:, begin:end].T))
        before = now[-2:]
        at1, at2 = mix.places(now[:-2], now[1:-1])
        now = now[2:]
        one, two = mix.table1.take(at1), mix.table2.take(at2)
        row = mix.lane16 + ((two & 3) << 2 | one & 3)
        ids4 = (now << 2).astype(np.int32)
        event = np.where(_right(two, ids4), _ORDER2, _right(one, ids4))
        number = number_of.take(place_of.take(now) + mix.lane)
        known = mix.parts.take(mix.row + number)
        begins = mix.begins.take(row)
        begin1 = begins & 0xFFFF
        start, size = begin1 * (known >> 16), begin1 * (known & 0xFFFF)
        at = np.nonzero(event)
        b1, b2, higher = begin1[at], begins[at] >> 16, event[at] == _ORDER2
        start[at] = np.where(higher, b2, b1) << _BITS0
        size[at] = np.where(higher, (1 << _BITS) - b2, b2 - b1) << _BITS0
        step, lane = new = np.nonzero((event | number) == 0)
        inside = (lane < n - 1) | (step + begin < short)
        plain.append((lane[inside], now[step[inside], lane[inside]]))
        for k in range(end - begin):
            m = n if begin + k < short else n - 1
            unit = span[:m] >> _ALL
            low[:m] += unit * start[k, :m]
            np.multiply(unit, size[k, :m], out=span[:m])
            out = np.nonzero(span[:m] < _LOW)[0]
            while len(out):
                part, wide = low[out], span[out] << 16
                put(out, part >> 32)
                low[out], span[out] = (part & _LOW - 1) << 16, wide
                out = out[wide < _LOW]
        mix.learn(now, event, row, number, new, at1, at2, one, two)
    for part in (low >> 32, low >> 16 & 0xFFFF, low & 0xFFFF):
        put(mix.lane, part)
    words, ends = _by_lane(words, n)
    while (carry := words >> 16).any():
        words &= 0xFFFF
        words[:-1] += carry[1:]
    words = words.astype("<u2")
    new, stops = _by_lane(plain, n)
    new = new[::-1].astype("<u2")
    out = []
    for i in range(n):
        code = words[ends[i] : ends[i + 1]].tobytes() + new[len(new) - stops[i + 1] : len(new) - stops[i]].tobytes()
        out.append((code, zlib.crc32(grid[i, : lengths[i]].astype("<u4").tobytes())))
    return out


def _by_lane(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, list[int]]:
    """Values of lane after lane, each in their order, and where those of a lane begin."""
    lane, values = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(lane.astype(np.uint16) if n <= 1 << 16 else lane, kind="stable")
    return values[order], [0, *np.cumsum(np.bincount(lane, minlength=n)).tolist()]


def decode(codes: list[tuple[bytes, int]], n_ids: int, block: int = BLOCK, lanes: int = LANES) -> np.ndarray:
    """The ids of all blocks. A block whose ids do not have its CRC-32 is an error."""
    out = [np.zeros(0, np.uint32)]
    for at in range(0, len(codes), lanes):
        part = codes[at : at + lanes]
        out.append(_decode_lanes(part, min(n_ids - at * block, len(part) * _checked(block)), block))
    return np.concatenate(out)


def _decode_lanes(codes: list[tuple[bytes, int]], n_ids: int, block: int) -> np.ndarray:
    lengths, n = _lengths(n_ids, block), len(codes)
    steps = int(lengths[0])
    words = np.frombuffer(b"".join(c for c, _ in codes) or bytes(2), "<u2").astype(np.int64)
    ends = np.cumsum([len(c) // 2 for c, _ in codes])
    used, tail = np.concatenate(([0], ends[:-1])), ends - 1

    def word(at: np.ndarray) -> np.ndarray:
        return words.take(at, mode="clip")  # a damaged block may ask for more than there is

    mix, span = _Mix(n), np.full(n, _TOP, np.int64)
    value = word(used) << 32 | word(used + 1) << 16 | word(used + 2)
    used += 3
    columns = np.empty((steps, n), np.uint16)
    before2, before1 = np.zeros((2, n), np.int64)
    lane_slots = mix.lane << _BITS0

    # A last block that is shorter goes on with whatever comes; that is cut off.
    for begin, end, due in _spans(steps):
        if due:
            mix.renew()
            slots, id_of = mix.slots(), mix.id_of.ravel()
        shape = (end - begin, n)
        now, at1, at2, row, number = (np.empty(shape, np.int64) for _ in range(5))
        one, two, event = np.empty(shape, np.int32), np.empty(shape, np.int32), np.zeros(shape, np.int64)
        for k in range(end - begin):
            at1[k], at2[k] = one_at, two_at = mix.places(before2, before1)
            one[k], two[k] = named1, named2 = mix.table1.take(one_at), mix.table2.take(two_at)
            row[k] = here = mix.lane16 + ((named2 & 3) << 2 | named1 & 3)
            begins = mix.begins.take(here)
            begin1 = begins & 0xFFFF
            unit = span >> _ALL
            part = unit * begin1
            # In doubles: value is below 2**48, part below 2**36, so the floor of the quotient is exact.
            plain = (value / part).astype(np.int64)
            higher = np.nonzero(plain >= 1 << _BITS0)[0]
            plain[higher] = 0
            plain += lane_slots
            number[k] = nth = slots.take(plain)
            at = mix.row + nth
            ids, known = id_of.take(at).astype(np.int64), mix.parts.take(at)
            start = part * (known >> 16)
            part *= known & 0xFFFF
            rest = nth == 0
            if len(higher):
                b1, b2, unit = begin1[higher], begins[higher] >> 16, unit[higher] << _BITS0
                second = value[higher] >= unit * b2
                event[k, higher] = np.where(second, _ORDER2, _ORDER1)
                ids[higher] = np.where(second, named2[higher], named1[higher]) >> 2
                start[higher] = np.where(second, b2, b1) * unit
                part[higher] = np.maximum(np.where(second, (1 << _BITS) - b2, b2 - b1), 1) * unit  # none only in a damaged block
                rest[higher] = False
            rest = np.nonzero(rest)[0]
            if len(rest):
                at = tail[rest]
                ids[rest], tail[rest] = word(at), at - 1
            now[k] = ids
            before2, before1 = before1, ids
            value -= start
            span = part
            short = np.nonzero(span < _LOW)[0]
            while len(short):
                come, wide = used[short], span[short] << 16
                value[short] = (value[short] << 16 | word(come)) & _TOP
                used[short], span[short] = come + 1, wide
                short = short[wide < _LOW]
        columns[begin:end] = now
        mix.learn(now, event, row, number, np.nonzero((event | number) == 0), at1, at2, one, two)
    grid = np.ascontiguousarray(columns.T).astype("<u4")
    for i, (_, check) in enumerate(codes):
        if zlib.crc32(grid[i, : lengths[i]]) != check:
            raise ValueError(f"block {i} is damaged")
    return grid.reshape(-1)[:n_ids].astype(np.uint32, copy=False)
