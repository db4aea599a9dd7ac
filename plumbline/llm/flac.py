"""FLAC streams of 8-bit mono samples, encoded and decoded with numpy across many frames at once.

A stream is ``fLaC``, STREAMINFO (with the MD5 of the samples), a SEEKTABLE, and frames of a fixed block of ``BLOCK``
samples. Each frame holds one subframe of the kind that takes the fewest bits: constant, verbatim, a fixed polynomial
predictor, or a linear predictor of order 8 over the mean of the last samples; residuals are Rice-coded in one partition.

The decoder of such streams reads header and CRC-8, constant, verbatim, fixed and LPC subframes and CRC-16. Frames are
independent, so it decodes a whole batch of them step by step: code word ``i`` of every
frame at once, each frame at its own bit position. ``decode_any`` reads streams of other makers, sample by sample: any block
and sample size, several channels, Rice partitions and escapes.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np

BLOCK = 576
SEEK_EVERY = 1
RATE = 8000
#: Linear predictor of the encoder: the mean of the last eight samples (coefficients 1, shift 3).
MEAN_ORDER, MEAN_SHIFT, MEAN_PRECISION = 8, 3, 3
#: Fixed polynomial predictors of orders 0 to 4; fixed values of the format.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: The largest Rice parameter that four bits can name; 15 is the escape.
MOST_RICE = 14
#: Frames handled at once; bounds memory (about 20 MB of working arrays per thousand frames).
FRAMES = 2048


class CorruptStream(ValueError):
    """A checksum or a reserved bit pattern that does not hold."""


@lru_cache(maxsize=None)
def _crc_table(width: int, polynomial: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        table = (table << 1) ^ np.where(table >> (width - 1) & 1, np.uint32(polynomial), np.uint32(0))
    return table & np.uint32((1 << width) - 1)


def crc(rows: np.ndarray, width: int, polynomial: int) -> np.ndarray:
    """The CRC of each row of right-aligned bytes; leading zeros change nothing, since it starts at 0."""
    table, mask = _crc_table(width, polynomial), np.uint32((1 << width) - 1)
    value = np.zeros(len(rows), np.uint32)
    for column in np.ascontiguousarray(rows.T):
        value = ((value << 8) & mask) ^ table[(value >> (width - 8)) ^ column]
    return value


def crc8(rows: np.ndarray) -> np.ndarray:
    return crc(rows, 8, 0x07)


def crc16(rows: np.ndarray) -> np.ndarray:
    return crc(rows, 16, 0x8005)


def right_aligned(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    width = int((ends - starts).max(initial=1))
    at = np.arange(-width, 0) + ends[:, None]
    return np.where(at >= starts[:, None], data[np.maximum(at, 0)], 0).astype(np.uint8)


def coded_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    head = (0xFF << (7 - more)) & 0xFF | n >> 6 * more
    return bytes([head, *(0x80 | n >> 6 * i & 63 for i in reversed(range(more)))])


@lru_cache(maxsize=1 << 16)
def frame_header(number: int) -> bytes:
    """Fixed block size of 576, rate from STREAMINFO, mono, 8 bits; with its CRC-8."""
    head = b"\xff\xf8\x20\x02" + coded_number(number)
    return head + bytes([int(crc8(np.frombuffer(head, np.uint8)[None])[0])])


def _residuals(samples: np.ndarray, order: int, coefficients: tuple[int, ...], shift: int) -> np.ndarray:
    guess = np.zeros((len(samples), BLOCK - order), np.int32)
    for i, c in enumerate(coefficients, 1):
        guess += c * samples[:, order - i : BLOCK - i]
    return samples[:, order:] - (guess >> shift)


def _best_rice(residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits and parameter of each row's cheapest Rice code, of all parameters from 0 to ``MOST_RICE``.

    The bits saved by one more bit of remainder, ``sum(ceil((f >> k) / 2)) - n``, never grow with ``k``; so the sizes fall and
    then rise, and a walk from near the logarithm of the mean to where both neighbours cost more ends at the least of all.
    """
    folded = (residuals << 1) ^ (residuals >> 31)
    n = folded.shape[1]
    if folded.max(initial=0) < 1 << 16:
        folded = folded.astype(np.uint16)

    def cost(rows: np.ndarray | slice, k: np.ndarray) -> np.ndarray:
        size = (folded[rows] >> np.clip(k, 0, MOST_RICE).astype(folded.dtype)[:, None]).sum(1, dtype=np.int64) + n * (k + 1)
        return np.where((k < 0) | (k > MOST_RICE), np.iinfo(np.int64).max, size)

    k = np.clip(np.log2(np.maximum(folded.sum(1, dtype=np.int64) / n, 1)).astype(np.int64), 0, MOST_RICE)
    less, bits, more = (cost(slice(None), k + d) for d in (-1, 0, 1))
    while len(rows := np.flatnonzero((less < bits) | (more < bits))):
        step = np.where(less[rows] < bits[rows], -1, 1)
        far = cost(rows, k[rows] + 2 * step)
        k[rows] += step
        old = bits[rows]
        bits[rows] = np.where(step < 0, less[rows], more[rows])
        less[rows], more[rows] = np.where(step < 0, far, old), np.where(step < 0, old, far)
    return bits, k


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """The frames of rows of ``BLOCK`` unsigned bytes, each with its number in its stream."""
    signed = samples.astype(np.int32) - 128
    predictors = [(order, FIXED[order], 0, 8 + order) for order in range(5)] + [(MEAN_ORDER, (1,) * MEAN_ORDER, MEAN_SHIFT, 32 + MEAN_ORDER - 1)]
    own, sizes, ks = [], [np.full(len(samples), 8 * BLOCK, np.int64)], [np.zeros(len(samples), np.int32)]
    for order, coefficients, shift, _ in predictors:
        own.append(_residuals(signed, order, coefficients, shift))
        bits, k = _best_rice(own[-1])
        lpc = 9 + MEAN_PRECISION * order if shift else 0
        sizes.append(bits + 8 * order + 10 + lpc)
        ks.append(k.astype(np.int32))
    kind = np.stack(sizes).argmin(0)  # 0: verbatim, else a predictor
    kind[(signed == signed[:, :1]).all(1)] = -1
    out: list[bytes] = [b""] * len(samples)
    for which in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == which)
        if which < 0:
            bodies = [b"\x00" + bytes([(int(x) - 128) & 255]) for x in samples[rows, 0]]
        elif which == 0:
            bodies = [b"\x02" + x.tobytes() for x in (signed[rows] & 255).astype(np.uint8)]
        else:
            order, coefficients, shift, code = predictors[which - 1]
            bodies = _rice_bodies(signed[rows, :order], own[which - 1][rows], ks[which][rows], code, order, coefficients, shift)
        for i, body in zip(rows.tolist(), bodies, strict=True):
            out[i] = frame_header(int(numbers[i])) + body
    flat = np.frombuffer(b"".join(out), np.uint8)
    ends = np.cumsum([len(x) for x in out])
    check = crc16(right_aligned(flat, ends - [len(x) for x in out], ends))
    return [x + int(c).to_bytes(2, "big") for x, c in zip(out, check, strict=True)]


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray | int, width: int) -> None:
    for i in range(width):
        bits[at + i] = (values >> (width - 1 - i)) & 1


def _rice_bodies(warm: np.ndarray, residuals: np.ndarray, k: np.ndarray, code: int, order: int, coefficients: tuple[int, ...], shift: int) -> list[bytes]:
    folded = (residuals << 1) ^ (residuals >> 31)
    quotients = folded >> k[:, None]
    lengths = quotients + 1 + k[:, None]
    fixed = 8 + 8 * order + 10 + (9 + MEAN_PRECISION * order if shift else 0)
    total = fixed + lengths.sum(1)
    size = (total + 7) // 8
    base = (np.cumsum(size) - size) * 8
    bits = np.zeros(int(size.sum()) * 8, np.uint8)
    _put(bits, base, code << 1, 8)
    at = base + 8
    for i in range(order):
        _put(bits, at, warm[:, i] & 255, 8)
        at = at + 8
    if shift:
        _put(bits, at, MEAN_PRECISION - 1, 4)
        _put(bits, at + 4, shift, 5)
        at = at + 9
        for c in coefficients:
            _put(bits, at, c, MEAN_PRECISION)
            at = at + MEAN_PRECISION
    at = at + 6  # coding method 0, partition order 0
    _put(bits, at, k, 4)
    at = at + 4
    ends = at[:, None] + np.cumsum(lengths, axis=1)
    stop = ends - 1 - k[:, None]
    bits[stop.ravel()] = 1
    for j in range(int(k.max(initial=0))):
        has = (k > j)[:, None] & (folded >> j & 1 == 1)
        bits[(ends - 1 - j)[has]] = 1
    packed = np.packbits(bits)
    return [packed[b : b + s].tobytes() for b, s in zip((base // 8).tolist(), size.tolist(), strict=True)]


def stream_head(samples: bytes, frames: list[int]) -> bytes:
    """``fLaC``, STREAMINFO and SEEKTABLE of a stream whose frames have these sizes in bytes."""
    n = len(samples)
    signed = (np.frombuffer(samples, np.uint8) - np.uint8(128)).tobytes()
    info = BLOCK.to_bytes(2, "big") * 2 + min(frames).to_bytes(3, "big") + max(frames).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(signed).digest()
    begin = np.concatenate([[0], np.cumsum(frames)])
    points = b"".join((i * BLOCK).to_bytes(8, "big") + int(begin[i]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for i in range(0, len(frames), SEEK_EVERY))
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, a positive multiple of ``BLOCK`` bytes."""
    counts = [len(p) // BLOCK for p in payloads]
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"a payload is not a positive multiple of {BLOCK} bytes")
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.arange(len(samples)) - np.repeat(np.cumsum(counts) - counts, counts)
    frames: list[bytes] = []
    for i in range(0, len(samples), FRAMES):
        frames += encode_frames(samples[i : i + FRAMES], numbers[i : i + FRAMES])
    out, at = [], 0
    for payload, n in zip(payloads, counts, strict=True):
        own = frames[at : at + n]
        out.append(stream_head(payload, [len(f) for f in own]) + b"".join(own))
        at += n
    return out


class Head(NamedTuple):
    """A stream's metadata: samples, their MD5, seek points (sample, byte after ``begin``, samples), largest frame."""

    samples: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    begin: int
    most: int


def read_head(stream: bytes) -> Head:
    if stream[:4] != b"fLaC":
        raise CorruptStream("no fLaC marker")
    at, last, info, seek = 4, False, b"", []
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            seek = list(struct.iter_unpack(">QQH", body))
        at += 4 + size
    if len(info) != 34 or info[:2] != BLOCK.to_bytes(2, "big"):
        raise CorruptStream("unsupported STREAMINFO")
    return Head(int.from_bytes(info[10:18], "big") & ((1 << 36) - 1), info[18:34], seek, at, int.from_bytes(info[7:10], "big"))


def decode_frames(data: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decode one frame at each byte of ``starts``: samples (unsigned), frame numbers and the bytes where frames end.

    ``most`` bounds a frame's bytes (STREAMINFO has it). Raises ``CorruptStream`` where a checksum doesn't hold.
    """
    starts = np.asarray(starts, np.int64)
    width = most + 16
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    rows = padded[starts[:, None] + np.arange(width)]  # each frame in a row of its own
    flat, at = rows.ravel(), np.arange(len(rows), dtype=np.int64) * width
    if not (rows[:, :4] == np.frombuffer(b"\xff\xf8\x20\x02", np.uint8)).all():
        raise CorruptStream("not a frame of this block size and sample format")
    first = rows[:, 4]
    more = np.select([first < 0x80, first < 0xE0, first < 0xF0, first < 0xF8, first < 0xFC, first < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    numbers = np.where(more == 0, first, first & (0x3F >> more)).astype(np.int64)
    for i in range(1, 7):
        numbers = np.where(i <= more, numbers << 6 | rows[:, 4 + i] & 63, numbers)
    body = at + 5 + more
    if (crc8(right_aligned(flat, at, body)) != flat[body]).any():
        raise CorruptStream("a frame header's CRC-8 does not hold")
    body = body + 1
    kinds = flat[body] >> 1
    samples, ends = np.zeros((len(at), BLOCK), np.int32), body + 1
    for kind in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == kind)
        where = body[own] + 1
        if kind == 0:
            samples[own] = flat[where].astype(np.int8)[:, None]
            ends[own] = where + 1
        elif kind == 1:
            if (where + BLOCK > at[own] + width - 2).any():
                raise CorruptStream("a frame is longer than the stream says")
            samples[own] = flat[where[:, None] + np.arange(BLOCK)].astype(np.int8)
            ends[own] = where + BLOCK
        elif 8 <= kind <= 12 or kind >= 32:
            short = np.arange(len(own), dtype=np.int64) * width
            samples[own], stop = _decode_predicted(rows[own], where - at[own] + short, kind)
            ends[own] = stop - short + at[own]
        else:
            raise CorruptStream(f"reserved subframe type {kind}")
    if (crc16(right_aligned(flat, at, ends)) != (flat[ends].astype(np.uint32) << 8 | flat[ends + 1])).any():
        raise CorruptStream("a frame's CRC-16 does not hold")
    return (samples + 128).astype(np.uint8), numbers, ends - at + starts + 2


def _field(bits: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), np.int32)
    for i in range(width):
        out = out << 1 | bits[at + i]
    return out


def _decode_predicted(rows: np.ndarray, where: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames of one fixed or linear predictor: Rice residuals, then the prediction, sample by sample of all frames.

    ``where`` is the byte in the flattened rows where each subframe's warm-up samples begin; so are the returned ends.
    """
    order = kind - 8 if kind <= 12 else kind - 31
    bits = np.unpackbits(rows.ravel())
    row_end = (np.arange(len(rows), dtype=np.int64) + 1) * rows.shape[1] * 8 - 16
    at = where * 8
    out = np.zeros((BLOCK, len(where)), np.int32)
    for i in range(order):
        out[i] = _field(bits, at, 8).astype(np.uint8).astype(np.int8)
        at = at + 8
    shift = np.zeros(len(where), np.int32)
    weights = np.zeros((order, len(where)), np.int32)
    if kind >= 32:
        precision = _field(bits, at, 4) + 1
        shift = _field(bits, at + 4, 5)
        at = at + 9
        for width in np.unique(precision).tolist():
            own = np.flatnonzero(precision == width)
            for i in range(order):
                value = _field(bits, at[own] + i * width, width)
                weights[i, own] = value - ((value >> (width - 1)) << width)
        at = at + order * precision
    else:
        weights += np.array(FIXED[order], np.int32).reshape(order, 1)
    if _field(bits, at, 6).any():
        raise CorruptStream("a residual coding this decoder does not know")
    k = _field(bits, at + 6, 4).astype(np.int32)
    at = (at + 10).astype(np.int32)
    # For every bit, the place of the next 1 at or after it.
    most = np.int32(len(bits) - 1)
    place = np.where(bits, np.arange(len(bits), dtype=np.int32), most)
    following = np.minimum.accumulate(place[::-1])[::-1]
    quotients, remainders = np.empty((BLOCK - order, len(where)), np.int32), np.empty((BLOCK - order, len(where)), np.int32)
    step = k + np.int32(1)
    for i in range(BLOCK - order):
        one = following[at]
        np.subtract(one, at, out=quotients[i])
        np.add(one, 1, out=remainders[i])
        at = np.minimum(one + step, most)
    if (at > row_end).any():
        raise CorruptStream("a frame's residuals run past its end")
    low = np.zeros_like(remainders)
    for j in range(int(k.max(initial=0))):
        low = np.where(j < k, low << 1 | bits[remainders + j], low)
    folded = quotients << k | low
    residuals = (folded >> 1) ^ -(folded & 1)
    plain = kind >= 32 and bool((weights == 1).all())
    for i in range(order, BLOCK):
        if plain and i > order:  # equal weights: a running sum
            total += out[i - 1] - out[i - 1 - order]
        elif plain:
            total = out[:order].sum(0)
        else:
            total = (weights * out[i - order : i][::-1]).sum(0)
        out[i] = residuals[i - order] + (total >> shift)
    return out.T, (at.astype(np.int64) + 7) // 8


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream, with every checksum verified: CRC-8, CRC-16 and the MD5 of the samples."""
    heads = [read_head(s) for s in streams]
    bodies = [np.frombuffer(s, np.uint8)[h.begin :] for s, h in zip(streams, heads, strict=True)]
    data = np.concatenate(bodies) if bodies else np.zeros(0, np.uint8)
    base = np.cumsum([len(b) for b in bodies]) - [len(b) for b in bodies]
    counts = np.array([h.samples // BLOCK for h in heads], np.int64)
    first = np.cumsum(counts) - counts
    out = np.zeros((int(counts.sum()), BLOCK), np.uint8)
    # Seek points cut streams into runs; the runs' next frames are decoded together.
    runs = []
    for i, h in enumerate(heads):
        points = [(0, 0), *((s // BLOCK, o) for s, o, _ in h.seek if s)]
        stops = [*(f for f, _ in points[1:]), int(counts[i])]
        runs += [(first[i], frame, end, base[i] + offset, h.most) for (frame, offset), end in zip(points, stops, strict=True)]
    table = np.array(runs, np.int64).reshape(-1, 5)
    while len(table):
        ends = []
        for a in range(0, len(table), FRAMES):
            part = table[a : a + FRAMES]
            lo, hi = int(part[:, 3].min()), int(part[:, 3].max() + part[:, 4].max())
            samples, numbers, stop = decode_frames(data[lo:hi], part[:, 3] - lo, int(part[:, 4].max()))
            if (numbers != part[:, 1]).any():
                raise CorruptStream("a frame is out of place")
            out[part[:, 0] + part[:, 1]] = samples
            ends.append(stop + lo)
        table[:, 1] += 1
        table[:, 3] = np.concatenate(ends)
        table = table[table[:, 1] < table[:, 2]]
    payloads = [out[a : a + n].tobytes() for a, n in zip(first.tolist(), counts.tolist(), strict=True)]
    for payload, head in zip(payloads, heads, strict=True):
        if hashlib.md5((np.frombuffer(payload, np.uint8) - np.uint8(128)).tobytes()).digest() != head.md5:
            raise CorruptStream("the MD5 of the samples does not hold")
    return payloads


def decode_from(stream: bytes, sample: int, count: int) -> bytes:
    """``count`` samples from ``sample`` on, decoding from the seek point before it only."""
    head = read_head(stream)
    data = np.frombuffer(stream, np.uint8)[head.begin :]
    frame, at = max(((s // BLOCK, o) for s, o, _ in head.seek if s <= sample), default=(0, 0))
    out, first = [], frame * BLOCK
    while frame * BLOCK < min(sample + count, head.samples):
        samples, _, ends = decode_frames(data, np.array([at]), head.most)
        out.append(samples[0].tobytes())
        at, frame = int(ends[0]), frame + 1
    return b"".join(out)[sample - first : sample - first + count]


class _Bits:
    """Bits of a stream, from a byte on."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at * 8

    def take(self, width: int, signed: bool = False) -> int:
        end = self.at + width
        if end > len(self.data) * 8:
            raise CorruptStream("the stream ends within a frame")
        value = int.from_bytes(self.data[self.at // 8 : (end + 7) // 8], "big") >> (-end % 8) & (1 << width) - 1
        self.at = end
        return value - (1 << width) if signed and width and value >> (width - 1) else value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n

    def byte(self) -> int:
        """The place of the next whole byte, to which the bits move on."""
        self.at += -self.at % 8
        return self.at // 8


def _one_subframe(bits: _Bits, n: int, width: int) -> list[int]:
    bits.take(1)
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
        width -= wasted
    if kind == 0:
        out = [bits.take(width, True)] * n
    elif kind == 1:
        out = [bits.take(width, True) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        out, weights, shift = [bits.take(width, True) for _ in range(order)], FIXED[min(order, 4)], 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.take(5, True)
            weights = [bits.take(precision, True) for _ in range(order)]
        method, parts = bits.take(2), bits.take(4)
        if method > 1:
            raise CorruptStream("a reserved residual coding")
        for part in range(1 << parts):
            k, escape = bits.take(4 + method), (1 << (4 + method)) - 1
            raw = bits.take(5) if k == escape else None
            for _ in range((n >> parts) - (order if part == 0 else 0)):
                if raw is None:
                    folded = bits.unary() << k
                    folded |= bits.take(k)
                    residual = folded >> 1 ^ -(folded & 1)
                else:
                    residual = bits.take(raw, True)
                out.append(residual + (sum(w * x for w, x in zip(weights, reversed(out), strict=False)) >> shift))
    else:
        raise CorruptStream(f"reserved subframe type {kind}")
    return [x << wasted for x in out] if wasted else out


def _checked(data: bytes, width: int, polynomial: int, want: int, what: str) -> None:
    if int(crc(np.frombuffer(data, np.uint8)[None], width, polynomial)[0]) != want:
        raise CorruptStream(f"a frame's {what} does not hold")


def decode_any(stream: bytes) -> tuple[np.ndarray, int, int]:
    """Samples (a row a sample, a column a channel), rate and bits of a sample of any FLAC stream, all checksums verified."""
    if stream[:4] != b"fLaC":
        raise CorruptStream("no fLaC marker")
    at, last, info = 4, False, b""
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        info = stream[at + 4 : at + 4 + size] if kind == 0 else info
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, depth, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    blocks: list[np.ndarray] = []
    while at < len(stream) and (not total or sum(map(len, blocks)) < total):
        bits = _Bits(stream, at)
        if bits.take(15) != 0x7FFC:
            raise CorruptStream("no frame where one should begin")
        bits.take(1)
        size, speed, layout, own, _ = bits.take(4), bits.take(4), bits.take(4), bits.take(3), bits.take(1)
        first = bits.take(8)
        bits.take(8 * (0 if first < 0x80 else 1 if first < 0xE0 else 2 if first < 0xF0 else 3 if first < 0xF8 else 4 if first < 0xFC else 5 if first < 0xFE else 6))
        n = {1: 192, 6: -8, 7: -16}.get(size) or (144 << size if 2 <= size <= 5 else 1 << size)
        n = bits.take(-n) + 1 if n < 0 else n
        bits.take({12: 8, 13: 16, 14: 16}.get(speed, 0))
        _checked(stream[at : bits.at // 8], 8, 0x07, bits.take(8), "header's CRC-8")
        width = {0: depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[own]
        side = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(layout)
        rows = [np.array(_one_subframe(bits, n, width + (side[c] if side else 0)), np.int64) for c in range(2 if side else layout + 1)]
        if layout == 8:
            rows[1] = rows[0] - rows[1]
        elif layout == 9:
            rows[0] = rows[0] + rows[1]
        elif layout == 10:
            middle = rows[0] * 2 + (rows[1] & 1)
            rows = [(middle + rows[1]) >> 1, (middle - rows[1]) >> 1]
        end = bits.byte()
        _checked(stream[at:end], 16, 0x8005, bits.take(16), "CRC-16")
        at = bits.byte()
        blocks.append(np.stack(rows, 1))
    out = np.concatenate(blocks) if blocks else np.zeros((0, channels), np.int64)
    size = (depth + 7) // 8
    raw = np.ascontiguousarray(out.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
    if any(info[18:34]) and hashlib.md5(raw).digest() != info[18:34]:
        raise CorruptStream("the MD5 of the samples does not hold")
    return out, rate, depth
