"""Adaptive context-mixing range coder for token ids, many blocks in step.

A segment of ids is cut into blocks of `BLOCK` ids. Each block starts from the same state, the
segment's header, and has its own code words and checksum, so it decodes alone.
The next id's distribution is a mixture of three:
* order 0: adaptive frequencies of buckets of ids, times the id's share in its bucket. Buckets and
  their first frequencies come from the counts in the header; a block's own counts are added as it goes, older ones fading;
* order 1: all on the id that last followed the id before (hashed);
* order 2: all on the id that last followed the two ids before (hashed).
Weights are learned for each state of the two contexts (how often in a row each was right, whether they agree) from how
often each prediction held in that state. Frequencies and weights change every `CHUNK` ids. All
three add up in one cumulative frequency over ids, so an id takes one step of a range coder: 64 bits, 32-bit words, carries added to the words at the end.

All arithmetic is on integers, so a block decodes alike everywhere. Numpy works on
one id of every block at a time ("lane"); no lane sees another's model. The encoder knows all
ids, so it gets the predictions of a whole block from sorted contexts and steps through the range coder only.

Edge cases: no ids give no blocks; any ids of 32 bits can be coded, up to MOST_IDS different ones in a segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"PSI2"
BLOCK, CHUNK = 8192, 512
#: Bits of: a bucket's cumulative frequency, an id's in its bucket, the weights.
BUCKET_BITS, WITHIN_BITS, WEIGHT_BITS = 11, 11, 6
ORDER0_BITS = BUCKET_BITS + WITHIN_BITS
TOTAL_BITS = ORDER0_BITS + WEIGHT_BITS
HEAVY = 256
MOST_IDS = 1 << 20
SLOTS1, SLOTS2 = 4096, 16384
MOST_SURE = 7
STATES = (MOST_SURE + 1) ** 2 * 2
#: First frequencies count as so many ids; counts are kept in sixteenths and lose a quarter a chunk.
PRIOR_IDS, FINE = 512, 16
#: Lanes planned at once by the encoder, and decoded at once.
PLANNED, DECODED = 64, 1024
_U = np.uint64
_32, _LEAST = _U(32), _U(1 << 32)
ONE = 1 << WEIGHT_BITS


def _first_weights() -> np.ndarray:
    """By state: what the weights start from, in 1/128: for order 1 and order 2."""
    s = np.arange(STATES)
    sure1, sure2, agree = s >> 4, (s >> 1) & 7, s & 1
    second = np.where(sure2 > 0, 128 * sure2 // (sure2 + 1), 0) * np.where(agree, 10, 8) // 10
    first = np.where((sure1 > 0) & (agree == 0), 40 * sure1 // (sure1 + 3), 0) // np.where(sure2 > 0, 5, 1)
    return np.stack([first, second])


_FIRST = _first_weights()


class Alphabet:
    """Ids by rank (commonest first), their buckets and frequencies."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        if len(ids) > MOST_IDS:
            raise ValueError(f"{len(ids)} different ids in a segment; {MOST_IDS} can be coded")
        turn = np.lexsort((ids, -counts))
        self.ids, counts = ids[turn], counts[turn].astype(np.int64)
        every = np.arange(len(ids))
        slot = (np.cumsum(counts) - counts) * HEAVY // max(1, int(counts.sum()))
        new = np.append(True, slot[1:] != slot[:-1])[: len(ids)]
        # a bucket holds at most half as many ids as there are frequencies in it
        new |= (every - every[new][np.cumsum(new) - 1]) % (1 << (WITHIN_BITS - 1)) == 0
        bucket, at = np.cumsum(new) - 1, np.flatnonzero(new)
        self.buckets = len(at)
        mass, members = np.add.reduceat(counts, at), np.diff(np.append(at, len(ids)))
        inside = np.append(0, np.cumsum(counts)[:-1]) - (np.cumsum(mass) - mass)[bucket]
        start = inside * ((1 << WITHIN_BITS) - members[bucket]) // mass[bucket] + every - at[bucket]
        end = np.append(start[1:], 0)
        end[np.append(at[1:], len(ids)) - 1] = 1 << WITHIN_BITS
        #: by rank: bucket, cumulative frequency and frequency in it
        self.packed = bucket << 24 | start << 12 | (end - start)
        #: by bucket and frequency: rank
        self.ranks = np.repeat(every, end - start).astype(np.int32)
        self.prior = np.maximum(1, mass * (PRIOR_IDS * FINE) // mass.sum())

    @staticmethod
    def of(ids: np.ndarray) -> tuple[Alphabet, np.ndarray, bytes]:
        """The alphabet of ids, their ranks and the header that tells it."""
        if int(ids.max()) < 4 * len(ids) + 65536:
            every = np.bincount(ids)
            found = np.flatnonzero(every)
            counts = every[found]
            every[found] = np.arange(len(found))
            place = every[ids]
        else:
            found, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
        made = Alphabet(found, counts)
        rank = np.empty(len(found), np.int64)
        rank[np.searchsorted(found, made.ids)] = np.arange(len(found))
        planes = np.stack([np.diff(found.astype(np.int64), prepend=0), counts]).astype("<u4").view(np.uint8).reshape(2, -1, 4)
        return made, rank[place], zlib.compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes(), 9)

    @staticmethod
    def read(header: bytes) -> Alphabet:
        planes = np.frombuffer(zlib.decompress(header), np.uint8).reshape(2, 4, -1)
        gaps, counts = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)
        return Alphabet(np.cumsum(gaps), counts)


def _frequencies(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Cumulative frequencies of buckets (last axis, one more) from counts and first frequencies. Buckets that a lane doesn't have hold none."""
    m = counts + prior
    cum = np.zeros((*m.shape[:-1], m.shape[-1] + 1), np.int64)
    np.cumsum(m, axis=-1, out=cum[..., 1:])
    own = np.zeros_like(cum)
    np.cumsum(np.broadcast_to(prior > 0, m.shape), axis=-1, out=own[..., 1:])
    return cum * ((1 << BUCKET_BITS) - own[..., -1:]) // cum[..., -1:] + own


def _weights(seen: np.ndarray, held1: np.ndarray, held2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of orders 1 and 2 from how often their predictions held; at least 2 of 64 are left to order 0."""
    n = 16 * seen + 128
    most = ONE - 2
    return most * (16 * held1 + _FIRST[0]) // n, most * (16 * held2 + _FIRST[1]) // n


def _slots(before1: np.ndarray, before2: np.ndarray, out: np.ndarray) -> None:
    """Where the contexts of the ids (ranks) before lie: for order 1, for order 2."""
    h = before1 * 40503
    np.right_shift(h, 4, out=out[0])
    out[0] &= SLOTS1 - 1
    h += before2 * 30011
    np.right_shift(h, 2, out=out[1])
    out[1] &= SLOTS2 - 1


def _order0(packed: np.ndarray, share: np.ndarray, first_id: np.ndarray, base_bucket: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order 0's cumulative frequency and frequency of ids (ranks)."""
    p = packed[x + first_id]
    b = share[(p >> 24) + base_bucket]
    fb = b & 4095
    b >>= 12
    b <<= WITHIN_BITS
    b += fb * (p >> 12 & 4095)
    p &= 4095
    p *= fb
    return b, p


def _followers(slots: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of each lane what last followed its context, and how often in a row; 0, 0 where nothing did."""
    order = np.argsort(slots.astype(np.uint16), axis=1, kind="stable")
    k, f = np.take_along_axis(slots, order, 1), np.take_along_axis(x, order, 1)
    same = k[:, 1:] == k[:, :-1]
    i = np.arange(x.shape[1])
    again = np.zeros(x.shape, bool)
    again[:, 1:] = same & (f[:, 1:] == f[:, :-1])
    run = i - np.maximum.accumulate(np.where(again, 0, i), axis=1) + 1
    guess, sure = np.zeros_like(x), np.zeros_like(x)
    sure[:, 1:] = np.where(same, np.minimum(run[:, :-1], MOST_SURE), 0)
    guess[:, 1:] = np.where(same, f[:, :-1], 0)
    out = np.empty_like(x), np.empty_like(x)
    np.put_along_axis(out[0], order, guess, 1)
    np.put_along_axis(out[1], order, sure, 1)
    return out


def _state(sure1, sure2, agree):
    return (sure1 << 3 | sure2) << 1 | agree


def _plan(a: Alphabet, x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of every id (ranks, lanes as rows) in the mixed cumulative frequency."""
    lanes, t = x.shape
    chunks = -(-t // CHUNK)
    chunk, lane = np.arange(t)[None] // CHUNK, np.arange(lanes)[:, None]
    here = lane * chunks + chunk
    there = np.arange(t)[None] < length[:, None]

    def counted(of: np.ndarray, kinds: int) -> np.ndarray:
        return np.bincount(of[there], minlength=lanes * chunks * kinds).reshape(lanes, chunks, kinds)

    packed = a.packed[x]
    bucket = packed >> 24
    new = counted(here * a.buckets + bucket, a.buckets) * FINE
    counts = np.zeros_like(new)
    for c in range(1, chunks):
        counts[:, c] = (counts[:, c - 1] + new[:, c - 1]) * 3 >> 2
    cum = _frequencies(counts, a.prior).reshape(lanes * chunks, -1)
    low, high = cum[here, bucket], cum[here, bucket + 1]
    fb = high - low
    start = (low << WITHIN_BITS) + fb * ((packed >> 12) & 4095)
    size = fb * (packed & 4095)

    before1, before2 = np.zeros_like(x), np.zeros_like(x)
    before1[:, 1:], before2[:, 2:] = x[:, :-1], x[:, :-2]
    slots = np.empty((2, lanes, t), np.int64)
    _slots(before1, before2, slots)
    guess1, sure1 = _followers(slots[0], x)
    guess2, sure2 = _followers(slots[1], x)
    agree = (guess1 == guess2) & (sure1 > 0) & (sure2 > 0)
    held2 = (guess2 == x) & (sure2 > 0)
    held1 = (guess1 == x) & (sure1 > 0) & ~agree
    state = here * STATES + _state(sure1, sure2, agree)
    sums = []
    for what in (there, held1 & there, held2 & there):
        n = np.bincount(state[what], minlength=lanes * chunks * STATES).reshape(lanes, chunks, STATES)
        sums.append(np.cumsum(n, axis=1) - n)
    w1, w2 = (w.reshape(-1)[state] for w in _weights(*sums))
    w0 = ONE - w1 - w2
    start = w0 * start + (w1 * (guess1 < x) + w2 * (guess2 < x) << ORDER0_BITS)
    size = w0 * size + (w1 * (guess1 == x) + w2 * (guess2 == x) << ORDER0_BITS)
    return np.where(there, start, 0), np.where(there, size, 1 << TOTAL_BITS)


def _code(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all lanes, one lane after another, and how many each has. start, size: steps as rows."""
    t, lanes = start.shape
    low, wide = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    r, shift = np.zeros(lanes, _U), np.zeros(lanes, _U)
    out, full, carry = np.zeros((t + 2, lanes), np.uint32), np.ones((t + 2, lanes), bool), np.zeros((t + 2, lanes), bool)
    for i in range(t):
        np.right_shift(wide, _U(TOTAL_BITS), out=r)
        np.multiply(r, size[i], out=wide)
        np.multiply(r, start[i], out=r)
        np.add(low, r, out=low)
        np.less(low, r, out=carry[i])
        np.less(wide, _LEAST, out=full[i])
        np.right_shift(low, _32, out=r)
        out[i] = r
        np.multiply(full[i], _32, out=shift)
        np.left_shift(low, shift, out=low)
        np.left_shift(wide, shift, out=wide)
    # two more words: a number in what is left, whatever follows it
    last = low + _U((1 << 32) - 1)
    carry[t] = last < low
    out[t] = last >> _32
    counts = full.sum(axis=0)
    words = out.T[full.T].astype(np.int64)
    ends = np.cumsum(counts)
    step, lane = np.nonzero(carry)
    sent = np.cumsum(full, axis=0) - full
    np.add.at(words, (ends - counts)[lane] + sent[step, lane] - 1, 1)
    while len(over := np.flatnonzero(words >> 32)):
        words[over] &= (1 << 32) - 1
        np.add.at(words, over - 1, 1)
    return words.astype("<u4"), counts


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment: magic, count, block length, length of the header, header, words and crc32 of the ids of each block, then the words."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 32:
        raise ValueError("ids must be of 32 bits")
    n = -(-len(ids) // block)
    if not n:
        return MAGIC + struct.pack("<QII", 0, block, 0)
    a, ranks, header = Alphabet.of(ids)
    width = min(block, len(ids))
    padded = np.zeros(n * block, np.int64)
    padded[: len(ids)] = ranks
    padded = padded.reshape(n, block)[:, :width]
    lengths = np.minimum(block, len(ids) - block * np.arange(n))
    start, size = np.empty((width, n), np.uint32), np.empty((width, n), np.uint32)
    for at in range(0, n, PLANNED):
        some = slice(at, at + PLANNED)
        s, z = _plan(a, padded[some], lengths[some])
        start[:, some], size[:, some] = s.T, z.T
    words, counts = _code(start, size)
    raw = ids.astype("<u4").tobytes()
    head = [struct.pack("<II", w, zlib.crc32(raw[4 * k * block : 4 * (k + 1) * block])) for k, w in enumerate(counts.tolist())]
    return MAGIC + struct.pack("<QII", len(ids), block, len(header)) + header + b"".join(head) + words.tobytes()


class Segment:
    """A coded segment, taken apart."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of ids")
        self.total, self.block, size = struct.unpack_from("<QII", data, 4)
        self.n = -(-self.total // self.block)
        at = 20 + size
        self.alphabet = Alphabet.read(data[20:at]) if self.n else None
        head = np.frombuffer(data, "<u4", 2 * self.n, at).reshape(self.n, 2)
        self.sizes, self.crcs = head[:, 0].astype(np.int64), head[:, 1]
        self.words = np.frombuffer(data, "<u4", int(self.sizes.sum()), at + 8 * self.n)

    def finish(self, ranks: np.ndarray) -> np.ndarray:
        ids = self.alphabet.ids[ranks.reshape(-1)[: self.total]]
        raw = ids.astype("<u4").tobytes()
        for k, crc in enumerate(self.crcs.tolist()):
            if zlib.crc32(raw[4 * k * self.block : 4 * (k + 1) * self.block]) != crc:
                raise ValueError(f"block {k} is damaged")
        return ids


def decode(payloads: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(place in payloads, ids) of every segment, in any order, up to DECODED blocks side by side; raises if a block's checksum doesn't hold."""
    held: list[tuple[int, Segment]] = []
    n = 0
    for i, payload in enumerate(payloads):
        s = Segment(payload)
        if not s.n:
            yield i, np.zeros(0, np.int64)
            continue
        if held and n + s.n > DECODED:
            yield from _finished(held)
            held, n = [], 0
        held.append((i, s))
        n += s.n
    if held:
        yield from _finished(held)


def _finished(held: list[tuple[int, Segment]]) -> Iterator[tuple[int, np.ndarray]]:
    ranks, at = _decode([s for _, s in held]), 0
    for i, s in held:
        yield i, s.finish(np.ascontiguousarray(ranks[: min(s.block, s.total), at : at + s.n].T))
        at += s.n


def _decode(segments: list[Segment]) -> np.ndarray:
    """Ranks of ids, steps as rows, the blocks of all segments as columns."""
    blocks = np.array([s.n for s in segments])
    lanes, t = int(blocks.sum()), max(min(s.block, s.total) for s in segments)
    of = np.repeat(np.arange(len(segments)), blocks)
    alphabets = [s.alphabet for s in segments]
    buckets = max(a.buckets for a in alphabets)
    packed = np.concatenate([a.packed for a in alphabets])
    ranks = np.concatenate([a.ranks for a in alphabets])
    first_id = np.append(0, np.cumsum([len(a.ids) for a in alphabets]))[of]
    last_id = np.array([len(a.ids) - 1 for a in alphabets])[of]
    first_rank = np.append(0, np.cumsum([len(a.ranks) for a in alphabets]))[of]
    prior = np.zeros((len(segments), buckets), np.int64)
    for k, a in enumerate(alphabets):
        prior[k, : a.buckets] = a.prior
    prior = prior[of]

    sizes = np.concatenate([s.sizes for s in segments])
    words = np.concatenate([s.words for s in segments]).astype(_U)
    at = np.cumsum(sizes) - sizes + 2
    last_word, last_rank = len(words) - 1, len(ranks) - 1
    gap = words[at - 2] << _32 | words[at - 1]
    wide = np.full(lanes, (1 << 64) - 1, _U)

    # what is alike for both orders has them as two rows
    lane = np.arange(lanes)
    base_slot = np.stack([lane * (SLOTS1 + SLOTS2), lane * (SLOTS1 + SLOTS2) + SLOTS1])
    base_state, base_bucket, base_share = lane * STATES, lane * buckets, lane << BUCKET_BITS
    follower = np.zeros(lanes * (SLOTS1 + SLOTS2), np.int32)
    counts = np.zeros((lanes, buckets), np.int64)
    seen, held1, held2 = (np.zeros((lanes, STATES), np.int64) for _ in range(3))
    before1, before2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    out = np.zeros((t, lanes), np.int64)
    states, hits = np.zeros((CHUNK, lanes), np.int64), np.zeros((CHUNK, 2, lanes), bool)
    slots, w = np.zeros((2, lanes), np.int64), np.zeros((2, lanes), np.int64)
    for i in range(t):
        k = i % CHUNK
        if k == 0:
            if i:
                done = packed[first_id + out[i - CHUNK : i]] >> 24
                counts = (counts + FINE * np.bincount((base_bucket + done).reshape(-1), minlength=lanes * buckets).reshape(lanes, buckets)) * 3 >> 2
                for sums, what in ((seen, slice(None)), (held1, hits[:, 0]), (held2, hits[:, 1])):
                    sums += np.bincount(states[what].reshape(-1), minlength=lanes * STATES).reshape(lanes, STATES)
            cum = _frequencies(counts, prior)
            own = np.diff(cum, axis=1)
            share = (cum[:, :-1] << 12 | own).reshape(-1)
            at_share = np.repeat(np.tile(np.arange(buckets, dtype=np.int16), lanes), own.reshape(-1))
            w1, w2 = _weights(seen, held1, held2)
            weights = (w1 << 8 | w2).reshape(-1)
        _slots(before1, before2, slots)
        slots += base_slot
        entry = follower[slots].astype(np.int64)
        sure, guess = entry & 7, entry >> 3
        sure1, sure2 = sure
        agree = guess[0] == guess[1]
        agree &= np.minimum(sure1, sure2) > 0
        state = _state(sure1, sure2, agree)
        state += base_state
        v = weights[state]
        np.right_shift(v, 8, out=w[0])
        np.bitwise_and(v, 255, out=w[1])
        w0 = ONE - w[0]
        w0 -= w[1]
        w <<= ORDER0_BITS
        r = wide >> _U(TOTAL_BITS)
        v = (gap // r).view(np.int64)
        # where both guesses lie
        start, size = _order0(packed, share, first_id, base_bucket, guess)
        start *= w0
        size *= w0
        size += w
        other = guess[::-1]
        start += w[::-1] * (other < guess)
        size += w[::-1] * (other == guess)
        past = v >= start
        start += size
        over = v >= start
        past ^= over  # now: whether v lies in it
        over = w * over
        v -= over[0]
        v -= over[1]
        # doubles hold these quotients exactly
        z = (v / w0).astype(np.int64)
        z &= (1 << ORDER0_BITS) - 1
        bucket = at_share[base_share + (z >> WITHIN_BITS)].astype(np.int64)
        b = share[base_bucket + bucket]
        z -= b >> 12 << WITHIN_BITS
        z = (z / (b & 4095)).astype(np.int64)
        z += bucket << WITHIN_BITS
        z += first_rank
        x = np.where(past[0], guess[0], np.where(past[1], guess[1], ranks[np.minimum(z, last_rank)]))
        np.minimum(x, last_id, out=x)
        # where the id lies, and on
        start, size = _order0(packed, share, first_id, base_bucket, x)
        start *= w0
        size *= w0
        below, held = w * (guess < x), guess == x
        start += below[0]
        start += below[1]
        below = w * held
        size += below[0]
        size += below[1]
        gap -= r * start.view(_U)
        wide = r * size.view(_U)
        full = wide < _LEAST
        shift = full * _32
        gap <<= shift
        gap |= words[np.minimum(at, last_word)] * full
        wide <<= shift
        at += full
        # learn
        out[i] = x
        states[k] = state
        np.logical_and(held, sure > 0, out=hits[k])
        hits[k, 0] &= ~agree
        sure += 1
        follower[slots] = x << 3 | np.where(held, np.minimum(sure, MOST_SURE), 1)
        before2, before1 = before1, x
    return out
