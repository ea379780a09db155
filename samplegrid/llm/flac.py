"""FLAC media columns: texts' bytes as 8-bit mono samples, stored as FLAC streams and decoded to PCM blocks.

Coding works on many frames at once: one numpy lane is one frame, and every step handles the next sample (or byte) of
all lanes. Streams are standard FLAC: STREAMINFO with the MD5 of the samples, a SEEKTABLE with the sample number and
byte offset of each frame, fixed predictors of order 0 to 4 or linear predictors of order LPC_ORDER, whichever is shorter, one
Rice partition a frame, CRC-8 of each header and CRC-16 of each frame. The decoder also reads other orders, partitions and
escapes, of 8-bit mono streams whose seek table has each frame; other streams give a row with the fault.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplegrid.llm.bpe import slices

FRAME = 1024
RATE = 8000
#: The largest Rice quotient that is written; a frame that would need more is stored verbatim.
QUOTIENT = 24
#: Order of the linear predictors that are written, and bits of a coefficient.
LPC_ORDER, LPC_BITS = 4, 12


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    for _ in range(8):
        out = np.where(out >> np.uint32(bits - 1) & np.uint32(1), out << np.uint32(1) ^ np.uint32(poly), out << np.uint32(1)) & np.uint32((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16).astype(np.uint16)

def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16_lanes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start : start + size] for every lane, the longest lanes first, a byte of all lanes a step."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    crc = np.zeros(len(at), np.uint16)
    longest = int(left.max(initial=0))
    live = np.searchsorted(-left, -np.arange(1, longest + 1), side="right")
    for i in range(longest):
        n = live[i]
        crc[:n] = (crc[:n] << np.uint16(8)) ^ CRC16[(crc[:n] >> np.uint16(8)) ^ data[at[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 128:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1) & 0xFF) | n, *reversed(tail)])


def _read_number(data: np.ndarray, at: int) -> tuple[int, int]:
    first = int(data[at])
    if first < 128:
        return first, at + 1
    more = 8 - (~first & 0xFF).bit_length() - 1
    n = first & (0x3F >> more)
    for k in range(more):
        n = n << 6 | int(data[at + 1 + k]) & 0x3F
    return n, at + 1 + more


def frame_header(number: int, size: int) -> bytes:
    """Fixed block size stream, block size in 16 bits, rate from STREAMINFO, mono, 8 bits a sample."""
    head = b"\xff\xf8" + bytes([0x70, 0x02]) + _number(number) + (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _residuals(x: np.ndarray, size: np.ndarray, order: int) -> np.ndarray:
    """Residuals of the fixed predictor: the order-th difference; x is (lanes, FRAME) int32, zero beyond size."""
    r = x
    for _ in range(order):
        r = np.concatenate([r[:, :1] * 0, r[:, 1:] - r[:, :-1]], 1)
    r = r.copy()
    r[:, :order] = 0
    r[np.arange(x.shape[1]) >= size[:, None]] = 0
    return r


def _put(end: np.ndarray, code: np.ndarray, size: int) -> bytes:
    """A bit string of `size` bytes in which each code of at most 16 bits ends before bit `end`; codes don't overlap."""
    at = end  # 16 bits of padding in front: a code's 16 bits begin at end - 16 + 16
    word, value = at >> 5, code.astype(np.uint64) << (48 - (at & 31)).astype(np.uint64)
    n = size // 4 + 3
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return high.astype(np.uint64).astype(">u4").tobytes()[2 : 2 + size]


def _linear(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, shift, residuals) of a linear predictor for each lane: Levinson's recursion on the autocorrelation."""
    p, lanes = LPC_ORDER, len(x)
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : f.shape[1] - k]) for k in range(p + 1)], 1).astype(np.float64)
    a, error = np.zeros((lanes, p)), r[:, 0] + 1e-9
    for i in range(p):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = 1 << (LPC_BITS - 1)
    shift = (LPC_BITS - 1 - np.frexp(np.maximum(np.abs(a).max(1), 1e-6))[1]).clip(0, 14).astype(np.int32)
    q = np.rint(a * (1 << shift)[:, None]).clip(-top, top - 1).astype(np.int32)
    guess = np.zeros((lanes, x.shape[1] - p), np.int32)
    for j in range(p):
        guess += q[:, j : j + 1] * x[:, p - 1 - j : x.shape[1] - 1 - j]
    out = np.zeros_like(x)
    out[:, p:] = x[:, p:] - (guess >> shift[:, None])
    out[np.arange(x.shape[1]) >= size[:, None]] = 0
    return q, shift, out


def _rice(folded: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Rice parameter by the mean, bits of all codes) of each lane's `count` residuals; zeros beyond them."""
    rice = np.floor(np.log2(np.maximum(folded.sum(1, dtype=np.int64) / np.maximum(count, 1), 1))).astype(np.int64).clip(0, 14)
    return rice, (folded >> rice[:, None].astype(np.int32)).sum(1, dtype=np.int64) + count * (rice + 1)


def encode_frames(x: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """One FLAC frame for each lane, without its CRC-16."""
    lanes = len(x)
    position = np.arange(x.shape[1])
    best = np.full(lanes, np.iinfo(np.int64).max)
    order = np.zeros(lanes, np.int64)
    folded = np.zeros(x.shape, np.int32)
    for p in range(5):
        r = _residuals(x, size, p)
        f = (r << 1) ^ (r >> 31)
        total = f.sum(1, dtype=np.int64)
        better = (total < best) & (size > p)
        best[better], order[better] = total[better], p
        folded[better] = f[better]
    rice, bits = _rice(folded, size - order)
    bits += 8 * order
    coefficients, lpc_shift, r = _linear(x, size)
    f = (r << 1) ^ (r >> 31)
    k, more = _rice(f, size - LPC_ORDER)
    extra = 9 + LPC_BITS * LPC_ORDER
    lpc = (size > LPC_ORDER) & (more + 8 * LPC_ORDER + extra < bits)
    folded[lpc], rice[lpc], order[lpc] = f[lpc], k[lpc], LPC_ORDER
    bits = np.where(lpc, more + 8 * LPC_ORDER + extra, bits)
    shift = rice[:, None].astype(np.int32)
    q = folded >> shift
    verbatim = (q.max(1) > QUOTIENT) | (bits >= 8 * size)
    lpc &= ~verbatim
    # codes: the subframe's type; raw samples of 8 bits; of a linear predictor precision, shift and coefficients; method, partition
    # order and parameter before the first residual; residuals as a unary quotient, a one and k bits
    raw = (position < order[:, None]) | verbatim[:, None]
    one = np.int32(1) << shift
    code = np.where(raw, x & 255, one | (folded & (one - 1)))
    width = np.where(raw, 8, q + 1 + shift)
    inside = position < size[:, None]
    width[~inside] = 0
    between = np.where(verbatim, 0, 10 + extra * lpc)
    room = (8 + between + width.sum(1, dtype=np.int64) + 7) // 8
    begin = np.cumsum(room) - room
    end = (8 * begin + 8)[:, None] + np.cumsum(width, 1, dtype=np.int64) + np.where(raw, 0, between[:, None])
    warm = 8 * (begin + 1 + order)
    kind = np.where(verbatim, 1, np.where(lpc, 31 + LPC_ORDER, 8 + order))
    at_coefficient = warm[lpc][:, None] + 9 + LPC_BITS * np.arange(1, LPC_ORDER + 1)
    packed = _put(
        np.concatenate([8 * begin + 8, (warm + between)[~verbatim], end[inside], warm[lpc] + 9, at_coefficient.reshape(-1)]),
        np.concatenate([kind << 1, rice[~verbatim], code[inside].astype(np.int64), (LPC_BITS - 1) << 5 | lpc_shift[lpc], coefficients[lpc].reshape(-1) & (1 << LPC_BITS) - 1]),
        int(room.sum()),
    )
    frames = []
    for i in range(lanes):
        frames.append(frame_header(int(numbers[i]), int(size[i])) + packed[begin[i] : begin[i] + room[i]])
    return frames


def with_crc16(frames: list[bytes]) -> list[bytes]:
    out = []
    for k in range(0, len(frames), 4096):
        some = frames[k : k + 4096]
        sizes = np.array([len(f) for f in some])
        crc = crc16_lanes(np.frombuffer(b"".join(some), np.uint8), np.cumsum(sizes) - sizes, sizes)
        out += [f + int(c).to_bytes(2, "big") for f, c in zip(some, crc, strict=True)]
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of at least 16 bytes; sample = byte - 128."""
    lengths = np.array([len(p) for p in payloads])
    counts = -(-lengths // FRAME)
    owner = np.repeat(np.arange(len(payloads)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.minimum(FRAME, lengths[owner] - number * FRAME)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    at = (np.cumsum(lengths) - lengths)[owner] + number * FRAME
    frames: list[bytes] = []
    for k in range(0, len(owner), 256):
        s = size[k : k + 256]
        inside = np.arange(FRAME) < s[:, None]
        x = np.zeros(inside.shape, np.int32)
        x[inside] = data[np.repeat(at[k : k + 256] - (np.cumsum(s) - s), s) + np.arange(s.sum())].astype(np.int32) - 128
        frames += encode_frames(x, s, number[k : k + 256])
    frames = with_crc16(frames)
    out, first = [], 0
    for payload, n in zip(payloads, counts.tolist(), strict=True):
        own = frames[first : first + n]
        first += n
        sizes = np.array([len(f) for f in own])
        points, offset = b"", 0
        for i, f in enumerate(own):
            points += (i * FRAME).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(FRAME, len(payload) - i * FRAME).to_bytes(2, "big")
            offset += len(f)
        block = min(FRAME, max(16, len(payload)))
        info = block.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big")
        info += hashlib.md5(bytes(np.frombuffer(payload, np.uint8) ^ np.uint8(128))).digest()
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


def _window(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The 32 bits from each bit position on."""
    at = bit >> 3
    x = words[at]
    return ((x << (bit & 7).astype(np.uint64)) >> np.uint64(32)).astype(np.uint64)


def _zeros(x: np.ndarray) -> np.ndarray:
    """Leading zeros of 32-bit numbers (32 for 0)."""
    return 32 - np.frexp(x.astype(np.float64))[1].astype(np.int64) * (x > 0)


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples as (lanes, longest) int32, sizes) of 8-bit mono frames at data[start:end]; checks both checksums."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(words).view(">u8")[:, 0].astype(np.uint64)
    lanes = len(starts)
    crc = crc16_lanes(data, starts, ends - starts - 2)
    if (crc != data[ends - 2].astype(np.uint16) << np.uint16(8) | data[ends - 1]).any():
        raise ValueError("a frame fails its CRC-16")
    size, bit = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for i, s in enumerate(starts.tolist()):
        if data[s] != 0xFF or data[s + 1] & 0xFE != 0xF8 or data[s + 3] not in (0, 2):
            raise ValueError("not a mono frame of 8-bit samples")
        _, at = _read_number(data, s + 4)
        # the block size by its code, or in one or two bytes after the number; then up to two bytes of the sample rate
        coded, more = int(data[s + 2]) >> 4, {12: 1, 13: 2, 14: 2}.get(int(data[s + 2]) & 15, 0)
        if coded in (6, 7):
            size[i] = int.from_bytes(data[at : at + coded - 5].tobytes(), "big") + 1
            at += coded - 5
        elif coded:
            size[i] = 192 if coded == 1 else 576 << coded - 2 if coded < 6 else 256 << coded - 8
        else:
            raise ValueError("reserved block size")
        if crc8(data[s : at + more].tobytes()) != data[at + more]:
            raise ValueError("a frame fails its CRC-8")
        bit[i] = 8 * (at + more + 1)
    top = (_window(words, bit) >> np.uint64(24)).astype(np.int64)
    kind = top >> 1 & 63
    bit += 8
    # low bits that all samples of the subframe have as zeros are left out: as many as the unary number after the flag
    wasted = np.zeros(lanes, np.int64)
    for i in np.flatnonzero(top & 1):
        wasted[i] = 33 - int(_window(words, bit[i : i + 1])[0]).bit_length()
        if wasted[i] > 7:
            raise ValueError("no bits left in a subframe")
        bit[i] += wasted[i]
    depth = 8 - wasted
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind <= 1)).all():
        raise ValueError("reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    # a constant subframe is one raw sample, a verbatim one has only raw samples
    raw = np.where(kind == 0, 1, np.where(kind == 1, size, order))
    out = np.zeros((lanes, int(size.max(initial=0))), np.int32)
    sample = lambda lane: (_window(words, bit[lane]) >> (32 - depth[lane]).astype(np.uint64)).astype(np.int64)
    lanes_by_raw = np.argsort(-raw, kind="stable")
    for i in range(int(raw.max(initial=0))):
        lane = lanes_by_raw[: np.searchsorted(-raw[lanes_by_raw], -i, side="left")]
        b, n = sample(lane), depth[lane]
        out[lane, i] = np.where(b >> (n - 1), b - (1 << n), b)
        bit[lane] += n
    for i in np.flatnonzero(kind == 0):
        out[i, : size[i]] = out[i, 0]
    coefficients, shift = np.zeros((lanes, int(order.max(initial=0))), np.int64), np.zeros(lanes, np.int64)
    for i, c in enumerate(([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])):
        if len(c) <= coefficients.shape[1]:
            coefficients[fixed & (order == i), : len(c)] = c
    for i in np.flatnonzero(lpc):
        head = int(_window(words, bit[i : i + 1])[0])
        precision, shift[i] = (head >> 28) + 1, head >> 23 & 31
        bit[i] += 9
        for j in range(order[i]):
            c = int(_window(words, bit[i : i + 1])[0]) >> (32 - precision)
            coefficients[i, j] = c - (1 << precision) * (c >> (precision - 1))
            bit[i] += precision
    coded = np.flatnonzero(fixed | lpc)
    head = _window(words, bit[coded])
    method, parts = head >> np.uint64(30), (head >> np.uint64(26)).astype(np.int64) & 15
    if (method > 1).any():
        raise ValueError("reserved residual coding")
    width = np.where(method == 0, 4, 5)
    bit[coded] += 6
    per = size[coded] >> parts
    rice, escape, escaped = np.zeros(len(coded), np.int64), np.full(len(coded), -1), False
    longest = size[coded]
    sequence = np.argsort(-longest, kind="stable")
    coded, width, per, longest, order_c = coded[sequence], width[sequence], per[sequence], longest[sequence], order[coded][sequence]
    pos = bit[coded]
    plain, single = not lpc[coded].any(), not parts.any()
    folded = np.zeros((out.shape[1], len(coded)), np.int32)  # sample by lane, so that a step writes one row
    latest = int(order_c.max(initial=0))
    live = np.searchsorted(-longest, -np.arange(out.shape[1]), side="left")
    for i in range(out.shape[1]):
        n = live[i]
        if not n:
            break
        if i > latest and single:
            new = ()
        else:
            new = np.flatnonzero((i >= order_c[:n]) & ((i % per[:n] == 0) | (i == order_c[:n])))
        if len(new):
            # a partition's parameter; all ones: raw residuals of a stated width
            top = _window(words, pos[new])
            rice[new] = (top >> (32 - width[new]).astype(np.uint64)).astype(np.int64)
            pos[new] += width[new]
            odd = rice[new] == (1 << width[new]) - 1
            escape[new] = np.where(odd, (_window(words, pos[new]) >> np.uint64(27)).astype(np.int64), -1)
            pos[new] += np.where(odd, 5, 0)
            escaped = escaped or bool(odd.any())
        p, k = pos[:n], rice[:n]
        if i >= latest and not escaped:
            # all lanes read one Rice code; a quotient under 32 and its tail lie in one 57-bit window
            w = words[p >> 3] << (p & 7).view(np.uint64)
            x = w >> np.uint64(32)
            if x.all():
                z = 1054 - (x.astype(np.float64).view(np.int64) >> 52)
                tail = (w << (z + 1).view(np.uint64)) >> np.uint64(1) >> (63 - k).view(np.uint64)
                folded[i, :n] = z << k | tail.view(np.int64)
                p += z + k + 1
                continue
        act = i >= order_c[:n]
        x = _window(words, p)
        z = _zeros(x)
        quotient = z.copy()
        for j in np.flatnonzero((z == 32) & act & (escape[:n] < 0)):
            # a long unary run: count on, 32 bits at a time
            at = pos[j] + 32
            while not (y := int(_window(words, np.array([at]))[0])):
                at += 32
            quotient[j] = at - pos[j] + 32 - y.bit_length()
        tail = (_window(words, pos[:n] + quotient + 1) >> (32 - np.minimum(k, 31)).astype(np.uint64)).astype(np.int64)
        f = quotient << k | np.where(k > 0, tail, 0)
        step = quotient + 1 + k
        esc = escape[:n] >= 0
        if esc.any():
            w = np.maximum(escape[:n], 0)
            v = (x >> (32 - np.minimum(w, 31)).astype(np.uint64)).astype(np.int64)
            v = np.where(w > 0, v - ((v >> np.maximum(w - 1, 0)) << w), 0)
            f, step = np.where(esc, (v << 1) ^ (v >> 63), f), np.where(esc, w, step)
        folded[i, :n] = np.where(act, f, 0)
        p += np.where(act, step, 0)
    residual = np.ascontiguousarray(((folded >> 1) ^ -(folded & 1)).T)
    if plain:
        # the p-th differences, summed p times, each time from the warm-up samples' difference on
        for p in range(5):
            lane = np.flatnonzero(order_c == p)
            r, warm = residual[lane].astype(np.int64), out[coded[lane], :p].astype(np.int64)
            for d in reversed(range(p)):
                r[:, d] = np.diff(warm, n=d, axis=1)[:, 0]
                r[:, d:] = np.cumsum(r[:, d:], 1)
            out[coded[lane]] = r
    else:
        for i in range(out.shape[1]):
            lane = np.flatnonzero((i >= order_c) & (i < longest))
            total = np.zeros(len(lane), np.int64)
            own = coded[lane]
            for j in range(coefficients.shape[1]):
                has = order[own] > j
                total[has] += coefficients[own[has], j] * out[own[has], i - 1 - j]
            out[own, i] = (total >> shift[own]) + residual[lane, i]
    return out << wasted[:, None].astype(np.int32), size


def read_stream(stream: bytes) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    """(samples, MD5, sample offsets, byte offsets of frames and of the end) by STREAMINFO and SEEKTABLE."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", b""
    while not last:
        last, kind, n = stream[at] > 127, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = body
        at += 4 + n
    seek = np.frombuffer(points, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
    seek = seek[seek["sample"] != 2**64 - 1]
    return total, md5, seek["sample"].astype(np.int64), np.append(seek["offset"].astype(np.int64) + at, len(stream))


def decode_blocks(streams: list[bytes]) -> list[tuple[np.ndarray, list[bytes]]]:
    """(sample offsets, PCM blocks of sample + 128) of each stream by its seek points, verified by frame checksums and MD5. All
    frames need a seek point."""
    heads = [read_stream(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    starts = np.concatenate([h[3][:-1] + b for h, b in zip(heads, base, strict=False)]) if heads else np.empty(0, np.int64)
    ends = np.concatenate([h[3][1:] + b for h, b in zip(heads, base, strict=False)]) if heads else starts
    blocks: list[bytes] = []
    for k in range(0, len(starts), 4096):
        a, b = starts[k : k + 4096], ends[k : k + 4096]
        x, size = decode_frames(data[a[0] : b[-1]], a - a[0], b - a[0])
        pcm = (x + 128).astype(np.uint8)
        blocks += [pcm[i, : size[i]].tobytes() for i in range(len(size))]
    out, first = [], 0
    for total, md5, seek, _ in heads:
        own = blocks[first : first + len(seek)]
        first += len(seek)
        whole = b"".join(own)
        # a writer may leave the MD5 out (zeros); the frames have their own checksums
        if len(whole) != total or md5 != bytes(16) and hashlib.md5(bytes(np.frombuffer(whole, np.uint8) ^ np.uint8(128))).digest() != md5:
            raise ValueError("a stream fails its MD5")
        if (np.cumsum([0, *map(len, own)])[:-1] != seek).any():
            raise ValueError("a seek point names another sample")
        out.append((seek, own))
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream."""
    return [b"".join(own) for _, own in decode_blocks(streams)]


def read_block(stream: bytes, sample: int) -> tuple[int, bytes]:
    """(offset of its first sample, PCM) of the block that holds a sample: only that frame is decoded."""
    _, _, seek, at = read_stream(stream)
    k = int(np.searchsorted(seek, sample, side="right")) - 1
    x, size = decode_frames(np.frombuffer(stream[at[k] : at[k + 1]], np.uint8), np.array([0]), np.array([at[k + 1] - at[k]]))
    if not 0 <= sample - seek[k] < size[0]:
        raise ValueError("no such sample")
    return int(seek[k]), (x[0, : size[0]] + 128).astype(np.uint8).tobytes()


def payload(text: str | None) -> bytes:
    """The text in UTF-8, with bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode()
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary) for every row of docs(doc_id, text, ...): each whole text as a FLAC stream. Null texts
    are empty; repeated rows and null ids stay; equal texts give equal streams; other columns are not read. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = part.column("text").to_pylist()
                media = encode([payload(t) for t in texts])
                sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def features(x: bytes) -> str:
    """Mean, mean square and sign changes per sample, with 6 digits."""
    s = np.frombuffer(x, np.uint8).astype(np.float64) - 128
    return f"mean={s.mean():.6f};power={np.mean(s * s):.6f};turns={np.mean((s[1:] < 0) != (s[:-1] < 0)):.6f}"


def _read(stored: DataFrame, whole: bool) -> DataFrame:
    """stored with blocks, or with pcm, the blocks put together (whole); feature and fault. No shuffle."""
    stored = stored.drop("pcm" if whole else "blocks", "feature", "fault")

    def tried(stream: bytes | None):
        try:
            return decode_blocks([stream])[0], None
        except (ValueError, IndexError, TypeError) as fault:
            return None, str(fault)

    def in_blocks(found: list) -> pa.Array:
        ends = np.cumsum([0, *(0 if b is None else len(b[1]) for b, _ in found)])
        offsets = pa.array(np.concatenate([np.empty(0, np.int64), *(b[0] for b, _ in found if b is not None)]).astype(np.int64))
        parts = pa.StructArray.from_arrays([offsets, pa.array([x for b, _ in found if b is not None for x in b[1]], pa.binary())], ["sample_offset", "pcm"])
        return pa.ListArray.from_arrays(pa.array([None if b is None else int(e) for e, (b, _) in zip(ends, found, strict=False)] + [int(ends[-1])], pa.int32()), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 4 << 20):
                streams = part.column("media").to_pylist()
                try:
                    found = [(b, None) for b in decode_blocks(streams)]
                except (ValueError, IndexError, TypeError):
                    found = [tried(s) for s in streams]
                joined = [None if b is None else b"".join(b[1]) for b, _ in found]
                marks = pa.array([None if x is None else features(x) for x in joined], pa.string())
                read = pa.array(joined, pa.binary()) if whole else in_blocks(found)
                yield pa.RecordBatch.from_arrays([*part.columns, read, marks, pa.array([f for _, f in found], pa.string())], [*part.schema.names, "pcm" if whole else "blocks", "feature", "fault"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    return stored.mapInArrow(run, f"{fields}, {'pcm binary' if whole else 'blocks array<struct<sample_offset: bigint, pcm: binary>>'}, feature string, fault string")


def blocks(stored: DataFrame) -> DataFrame:
    """stored(media, ...) with blocks array<struct<sample_offset long, pcm binary>>, the decoded and verified PCM blocks in order,
    feature, and fault: null, or why a stream could not be read, with null blocks and feature. Columns of these names are
    replaced; null media is a fault. No shuffle."""
    return _read(stored, False)


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """One row for each PCM block: stored's columns but for media, block, sample_offset, pcm. Streams that can't be read have none."""
    rows = blocks(stored).drop("media", "feature", "fault", "block", "sample_offset", "pcm")
    return rows.select("*", F.posexplode("blocks").alias("block", "b")).select(*[c for c in rows.columns if c != "blocks"], "block", "b.sample_offset", "b.pcm")


def pcm(stored: DataFrame) -> DataFrame:
    """stored(media, ...) with pcm, its whole decoded and verified payload, feature and fault, as blocks() has them; null where a
    stream could not be read."""
    return _read(stored, True)
