"""Token-id files: blocks of ids coded by an adaptive, context-mixing range coder.

A block holds up to ``BLOCK`` ids and is coded from a reset state, so blocks can be decoded alone
and in any order. Three predictions are mixed into one distribution over the vocabulary:

* order 2: the id seen last after the two ids before (hashed slots),
* order 1: the id seen last after the id before,
* order 0: a frequency table, a Zipf prior by merge rank that takes in the block's own counts at
  the positions ``REFRESH``.

A block is cut into lanes of equal length, which are coded in lockstep: a step handles the same
position of all lanes, each with a coder state of its own, and numpy does the work. The lanes share
the block's statistics, which therefore learn from every lane and stay small enough for a cache.
The weight of orders 1 and 2 is their share of hits so far among ids of the same class: how often
either slot was right in a row, and whether both name one id.

All quantities are whole numbers below 2**53 in doubles, or quotients of such rounded down, so
encoder and decoder agree bit by bit. An id's interval lies in the order of ids and is what order 0
gives it, with the weights of the guesses that name it before that.

Block layout, little endian: magic ``RCM2``, ids (u4), documents that begin here (u4), crc32 of the
ids (u4), lanes (u4); per document: id (i8), has an id (u1), its number of ids (u8), where it begins
in the block (u4); words of each lane (u2); the lanes' words (u2), one lane behind the other; crc32
of all that (u4). The last lane is filled up with id 0.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

#: Lanes of a block at most, and ids of a lane at least where there are several.
LANES, LANE = 8192, 512
BLOCK = LANES * LANE
REFRESH = (2, 8, 32, 128)
ID_BITS, SLOTS_BITS = 17, 17
ORDER0_BITS, WEIGHT_BITS = 19, 10
ORDER0, WEIGHT = 1 << ORDER0_BITS, 1 << WEIGHT_BITS
#: Ids that the prior counts for beside those seen.
PRIOR_IDS = 4096
MAGIC = b"RCM2"
HEAD, DOC = struct.Struct("<4sIIII"), struct.Struct("<qBQI")


def prior(vocabulary: int) -> np.ndarray:
    """Frequencies that fall with the rank of an id, at least one each; they fill the order-0 total."""
    f = 1.0 / (np.arange(vocabulary) + 128.0)
    f = np.floor(1 + f / f.sum() * (ORDER0 - vocabulary)).astype(np.int64)
    f[0] += ORDER0 - f.sum()
    return f


def _tables(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each id's interval begins, its width, and the id at each place; f fills the order-0 total."""
    return (np.cumsum(f) - f).astype(np.float64), f.astype(np.float64), np.repeat(np.arange(len(f), dtype=np.uint16 if len(f) <= 1 << 16 else np.int32), f)


@lru_cache(maxsize=2)
def _start(vocabulary: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    f = prior(vocabulary)
    return f, _tables(f)


#: Confidence after a miss and after a hit; 8 marks a slot that nothing has filled yet.
MISS, HIT = (0, 0, 0, 0, 1, 1, 1, 1, 0), (1, 2, 3, 4, 5, 6, 7, 7, 1)
#: A slot holds its level above the id: of order 1 twice the confidence, of order 2 these and 32 times the confidence.
#: The class of an id is the sum of both levels and 1 if both slots name one id.
HIGHER, CLASSES = 512, 1024
AFTER = np.zeros(CLASSES, dtype=np.int32)  # by the level, and 1 for a hit: the slot's next level, in its place
for k in range(9):
    AFTER[2 * k:2 * k + 2] = 2 * MISS[k], 2 * HIT[k]
    AFTER[HIGHER + 32 * k:HIGHER + 32 * k + 2] = HIGHER + 32 * MISS[k], HIGHER + 32 * HIT[k]
AFTER <<= ID_BITS


class Mixer:
    """Predictions and weights of all lanes; encoder and decoder feed it the same ids.

    Arrays of two rows hold order 1 and order 2.
    """

    def __init__(self, lanes: int, vocabulary: int):
        self.lanes, self.vocabulary = lanes, vocabulary
        self.prior, (self.low, self.freq, self.place) = _start(vocabulary)
        self.slots = np.full((1 << ID_BITS) + (1 << SLOTS_BITS), 2 * 8 << ID_BITS, dtype=np.int32)
        self.slots[1 << ID_BITS:] = HIGHER + 32 * 8 << ID_BITS
        self.at = np.zeros((2, lanes), dtype=np.int64)
        self.at[1] = 1 << ID_BITS
        self.before = np.zeros(lanes, dtype=np.uint32)
        self.tally = np.empty((3, CLASSES))  # ids of each class, hits of order 2, hits of order 1 alone
        self.tally[0], self.tally[1:] = 4, 1
        self.every = 16 if lanes >= 256 else 1  # steps from one tally to the next
        self.count = np.zeros(vocabulary, dtype=np.int64)
        self.seen: list[np.ndarray] = []
        self.t = 0
        self._weigh()
        # work space
        self.held, self.guess, self.level = (np.empty((2, lanes), dtype=np.int32) for _ in range(3))
        self.next, self.now = np.empty((2, lanes), dtype=np.int64), np.empty(lanes, dtype=np.int32)
        self.kind, self.same = np.empty(lanes, dtype=np.int64), np.empty(lanes, dtype=bool)
        self.below, self.hit = (np.empty((2, lanes), dtype=bool) for _ in range(2))
        self.w, self.pair = (np.empty((2, lanes)) for _ in range(2))
        self.w0, self.begin, self.width, self.one = (np.empty(lanes) for _ in range(4))
        self.h = np.empty(lanes, dtype=np.uint32)

    def _weigh(self) -> None:
        n, two, one = self.tally
        two = np.minimum(np.floor(two * WEIGHT / n), 1000)
        one = np.minimum(np.floor(one * WEIGHT / n), 1016 - two)
        one[1::2] = 0
        self.weight0, self.weight1, self.weight2 = WEIGHT - two - one, one * ORDER0, two * ORDER0

    def predict(self) -> None:
        held, kind = self.held, self.kind
        held[:] = self.slots[self.at]
        np.bitwise_and(held, (1 << ID_BITS) - 1, out=self.guess)
        np.right_shift(held, ID_BITS, out=self.level)
        np.equal(self.guess[0], self.guess[1], out=self.same)
        np.add(self.level[0], self.level[1], out=kind)
        kind += self.same
        np.take(self.weight0, kind, out=self.w0, mode="clip")
        np.take(self.weight1, kind, out=self.w[0], mode="clip")
        np.take(self.weight2, kind, out=self.w[1], mode="clip")

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the mixture's interval of each id begins, and its width."""
        begin, width, pair = self.begin, self.width, self.pair
        self.now[:] = ids
        np.less(self.guess, self.now, out=self.below)
        np.equal(self.guess, self.now, out=self.hit)
        np.take(self.low, ids, out=begin, mode="clip")
        np.take(self.freq, ids, out=width, mode="clip")
        begin *= self.w0
        width *= self.w0
        np.multiply(self.w, self.below, out=pair)
        begin += pair[0]
        begin += pair[1]
        np.multiply(self.w, self.hit, out=pair)
        width += pair[0]
        width += pair[1]
        return begin, width

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold v, which is used up: without the guesses' weights it is a place of order 0."""
        pair, one = self.pair, self.one
        np.take(self.low, self.guess, out=pair, mode="clip")
        pair *= self.w0  # where the weight of a guess lies
        np.less(self.guess[0], self.guess[1], out=self.same)
        np.multiply(self.w[0], self.same, out=one)
        pair[1] += one
        for k in (1, 0):
            np.subtract(v, pair[k], out=one)
            np.maximum(one, 0.0, out=one)
            np.minimum(one, self.w[k], out=one)
            v -= one
        v /= self.w0
        return self.place.take(v.astype(np.int64), mode="clip").astype(np.int64)

    def update(self, ids: np.ndarray) -> None:
        """Take in the ids that ``interval`` was last asked for."""
        if self.t % self.every == 0:
            self.tally[0] += np.bincount(self.kind, minlength=CLASSES)
            self.tally[1] += np.bincount(self.kind[self.hit[1]], minlength=CLASSES)
            self.tally[2] += np.bincount(self.kind[self.hit[0] & ~self.hit[1]], minlength=CLASSES)
            self._weigh()
        held, h = self.held, self.h
        np.add(self.level, self.hit, out=self.next)
        np.take(AFTER, self.next, out=held, mode="clip")
        held |= self.now
        self.slots[self.at] = held  # of lanes that meet in a slot the last one stays
        self.at[0] = ids
        h[:] = ids
        h *= np.uint32(2654435761)
        h += self.before
        h >>= np.uint32(32 - SLOTS_BITS)
        np.add(h, 1 << ID_BITS, out=self.at[1], dtype=np.int64)
        self.before[:] = ids
        self.before *= np.uint32(2246822519)
        self.t += 1
        if self.t <= REFRESH[-1]:
            self.seen.append(ids)
            if self.t in REFRESH:
                self._refresh()

    def _refresh(self) -> None:
        """The block's counts and the prior, which counts for so many ids, share the order-0 total."""
        self.count += np.bincount(np.concatenate(self.seen), minlength=self.vocabulary)
        self.seen = []
        n = (self.t * self.lanes + PRIOR_IDS) * ORDER0
        f = 1 + (self.count * ORDER0 + self.prior * PRIOR_IDS) * (ORDER0 - self.vocabulary) // n
        f[0] += ORDER0 - f.sum()
        self.low, self.freq, self.place = _tables(f)


#: Coder states: a lane's interval is kept at or above LEAST; below it gives or takes a word of 16 bits.
FULL, LEAST, DIGIT = 2.0**48, 2.0**32, 2.0**16
SHARE, TOP = 2.0 ** -(ORDER0_BITS + WEIGHT_BITS), 2.0 ** (ORDER0_BITS + WEIGHT_BITS) - 1
STATE_WORDS = 3


def _encode(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each lane, and all words; ids: lanes by positions."""
    lanes, steps = ids.shape
    model = Mixer(lanes, vocabulary)
    low, span = np.zeros(lanes), np.full(lanes, FULL)
    r, top, one = np.empty(lanes), np.empty(lanes), np.empty(lanes)
    words, givers = [], []  # upper words in the order of positions, and the lanes that give them
    for now in np.ascontiguousarray(ids.T, dtype=np.int64):
        model.predict()
        begin, width = model.interval(now)
        np.multiply(span, SHARE, out=r)
        np.floor(r, out=r)
        np.multiply(r, begin, out=one)
        low += one
        np.multiply(r, width, out=span)
        model.update(now)
        short = span < LEAST
        np.multiply(low, 1 / LEAST, out=top)
        np.floor(top, out=top)
        few = np.flatnonzero(short)
        words.append(top[few])
        givers.append(few)
        top *= short
        top *= LEAST
        low -= top
        np.multiply(short, DIGIT - 1, out=one)
        one += 1
        low *= one
        span *= one
        few = np.flatnonzero(span < LEAST)
        while len(few):
            own = low[few]
            high = np.floor(own / LEAST)
            words.append(high)
            givers.append(few)
            low[few] = (own - high * LEAST) * DIGIT
            span[few] *= DIGIT
            few = few[span[few] < LEAST]
    for _ in range(STATE_WORDS):  # the rest of the state
        words.append(np.floor(low / LEAST))
        givers.append(np.arange(lanes))
        low = (low - words[-1] * LEAST) * DIGIT
    giver = np.concatenate(givers).astype(np.uint16)
    out = np.concatenate(words).astype(np.int32)[np.argsort(giver, kind="stable")]
    over = np.flatnonzero(out > 0xFFFF)
    while len(over):  # carries; a full word passes one on, a lane's first word gets none beyond its bits
        out[over] &= 0xFFFF
        out[over - 1] += 1
        over = over[out[over - 1] > 0xFFFF] - 1
    return np.bincount(giver, minlength=lanes), out.astype("<u2")


def _decode(counts: np.ndarray, words: np.ndarray, steps: int, vocabulary: int) -> np.ndarray:
    """The ids, lanes by positions."""
    lanes = len(counts)
    model = Mixer(lanes, vocabulary)
    code = np.concatenate([words, np.zeros(1, dtype="<u2")])
    at = np.cumsum(counts, dtype=np.int64) - counts
    gap, span = np.zeros(lanes), np.full(lanes, FULL)  # gap: code less low
    for _ in range(STATE_WORDS):
        gap = gap * DIGIT + code[at]
        at += 1
    out = np.empty((steps, lanes), dtype="<u4")
    r, v, one = np.empty(lanes), np.empty(lanes), np.empty(lanes)
    word, short = np.empty(lanes, dtype="<u2"), np.empty(lanes, dtype=bool)
    for t in range(steps):
        model.predict()
        np.multiply(span, SHARE, out=r)
        np.floor(r, out=r)
        np.divide(gap, r, out=v)
        np.floor(v, out=v)
        np.minimum(v, TOP, out=v)
        ids = model.find(v)
        begin, width = model.interval(ids)
        out[t] = ids
        np.multiply(r, begin, out=one)
        gap -= one
        np.multiply(r, width, out=span)
        model.update(ids)
        np.less(span, LEAST, out=short)
        np.multiply(short, DIGIT - 1, out=one)
        one += 1
        gap *= one
        span *= one
        np.take(code, at, out=word, mode="clip")
        word *= short
        gap += word
        at += short
        few = np.flatnonzero(span < LEAST)
        while len(few):
            gap[few] = gap[few] * DIGIT + code[at[few]]
            span[few] *= DIGIT
            at[few] += 1
            few = few[span[few] < LEAST]
    return out.T


def _shape(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and their length."""
    lanes = min(LANES, max(n // LANE, 1)) if n else 0
    return lanes, -(-n // lanes) if n else 0


def _fits(vocabulary: int) -> None:
    if not 0 < vocabulary <= 1 << ID_BITS:
        raise ValueError(f"a vocabulary of {vocabulary} ids: 1 to {1 << ID_BITS} can be coded")


def encode_blocks(blocks: list[tuple[np.ndarray, list[tuple]]], vocabulary: int) -> list[bytes]:
    """Blocks of (ids, documents that begin there as (id or None, number of ids, place)) to bytes."""
    _fits(vocabulary)
    out = []
    for ids, docs in blocks:
        raw = np.asarray(ids).astype("<u4")
        if len(raw) > BLOCK or len(raw) and int(raw.max()) >= vocabulary:
            raise ValueError("too many ids for a block, or ids outside the vocabulary")
        lanes, steps = _shape(len(raw))
        counts, words = np.zeros(0), np.zeros(0, dtype="<u2")
        if lanes:
            whole = np.zeros(lanes * steps, dtype="<u4")
            whole[:len(raw)] = raw
            counts, words = _encode(whole.reshape(lanes, steps), vocabulary)
        body = HEAD.pack(MAGIC, len(raw), len(docs), zlib.crc32(raw.tobytes()), lanes)
        body += b"".join(DOC.pack(d or 0, d is not None, n, at) for d, n, at in docs) + counts.astype("<u2").tobytes() + words.tobytes()
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


def decode_blocks(data: list[bytes], vocabulary: int) -> list[tuple[np.ndarray, list[tuple]]]:
    """The reverse of ``encode_blocks``; a block whose checksums don't agree raises ValueError."""
    _fits(vocabulary)
    out = []
    for b in data:
        if len(b) < HEAD.size + 4 or zlib.crc32(memoryview(b)[:-4]) != struct.unpack("<I", b[-4:])[0]:
            raise ValueError("damaged block")
        magic, n, n_docs, crc, lanes = HEAD.unpack_from(b)
        if magic != MAGIC or lanes != _shape(n)[0]:
            raise ValueError("not a block of token ids")
        at = HEAD.size + n_docs * DOC.size
        docs = [(d if known else None, k, place) for d, known, k, place in DOC.iter_unpack(b[HEAD.size:at])]
        own = np.zeros(0, dtype="<u4")
        if lanes:
            counts = np.frombuffer(b, "<u2", lanes, at).astype(np.int64)
            words = np.frombuffer(b, "<u2", int(counts.sum()), at + 2 * lanes)
            own = _decode(counts, words, _shape(n)[1], vocabulary).reshape(-1)[:n]
        if zlib.crc32(own.tobytes()) != crc:
            raise ValueError("ids differ from their checksum")
        out.append((own, docs))
    return out
