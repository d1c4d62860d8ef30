"""FLAC media columns: bytes as 8-bit mono samples, encoded, decoded and verified in Arrow batches.

All frames of a batch are worked on at once: numpy steps from sample to sample across thousands of frames, so neither
the encoder nor the decoder loops over samples of one frame in Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 576
BITS = 8
RATE = 8000
#: Frames worked on together: bounds memory whatever the length of a text.
FRAMES = 6144
#: The encoder works on whole blocks, so fewer at a time stay in cache.
SLICE = 512
_PRECISION, _SHIFT = 10, 8


def _crc_table(poly: int, width: int) -> np.ndarray:
    t, top, mask = np.zeros(256, np.uint32), 1 << (width - 1), (1 << width) - 1
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        t[i] = c
    return t


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_FAR = [_CRC16.astype(np.uint16)]  # _FAR[d][b]: what byte b, d bytes before the end, adds to the CRC-16


def _far(n: int) -> np.ndarray:
    while len(_FAR) < n:
        last = _FAR[-1].astype(np.uint32)
        _FAR.append((((last << 8) & 0xFFFF) ^ _CRC16[last >> 8]).astype(np.uint16))
    return np.stack(_FAR[:n])


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start : start + length] for each frame; the frames lie one after the other."""
    if not len(starts):
        return np.zeros(0, np.uint16)
    table = _far(int(lengths.max()))
    first = np.repeat(starts, lengths)
    where = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bits = table.ravel()[((np.repeat(lengths, lengths) - 1 - where) << 8) + data[first + where]]
    return np.bitwise_xor.reduceat(bits, np.cumsum(lengths) - lengths)


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of the format."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    out = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF << (8 - size)) & 0xFF | (n >> (6 * (size - 1))), *out])


def _head(n: int) -> bytes:
    h = bytes([0xFF, 0xF8, 0x24, 0x02]) + _number(n)  # fixed block size 576, 8 kHz, mono, 8 bits
    c = 0
    for b in h:
        c = int(_CRC8[c ^ b])
    return h + bytes([c])


_HEADS: list[bytes] = []


def head(n: int) -> bytes:
    if n >= 1 << 16:
        return _head(n)
    while len(_HEADS) <= n:
        _HEADS.append(_head(len(_HEADS)))
    return _HEADS[n]


def _predictor(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of the best linear predictor of order 2 for each row."""
    f = x.astype(np.float32)
    r0, r1, r2 = ((f[:, k:] * f[:, : BLOCK - k]).sum(axis=1) for k in range(3))
    d = np.maximum(r0 * r0 - r1 * r1, 1e-3)
    c = np.stack([(r0 * r1 - r1 * r2) / d, (r0 * r2 - r1 * r1) / d], axis=1)
    top = (1 << (_PRECISION - 1)) - 1
    return np.clip(np.rint(c * (1 << _SHIFT)), -top, top).astype(np.int32)


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """One FLAC frame for each row of x (int, rows x BLOCK): constant, verbatim, fixed of order 1 or linear of order 2."""
    n = len(x)
    x = x.astype(np.int32)
    coef = _predictor(x)
    lpc = x[:, 2:] - ((coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> _SHIFT)
    fixed = x[:, 1:] - x[:, :-1]
    use_lpc = np.abs(lpc).sum(axis=1) < np.abs(fixed).sum(axis=1)
    order = np.where(use_lpc, 2, 1)
    res = np.zeros((n, BLOCK), np.int32)  # residuals, right-aligned; the warm-up samples are left out below
    res[:, 2:] = np.where(use_lpc[:, None], lpc, fixed[:, 1:])
    res[:, 1] = np.where(use_lpc, 0, fixed[:, 0])
    u = (res << 1) ^ (res >> 31)
    mean = u.sum(axis=1) / (BLOCK - order)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1.0))), 0, 14).astype(np.int32)
    q = u >> k[:, None]
    size = q + 1 + k[:, None]
    size[:, 0] = 0
    size[use_lpc, 1] = 0
    total = size.sum(axis=1)
    # subframe header, warm-up, predictor, coding method, partition order and Rice parameter
    lead = np.where(use_lpc, 8 + 2 * BITS + 4 + 5 + 2 * _PRECISION + 10, 8 + BITS + 10)
    const = (x == x[:, :1]).all(axis=1)
    plain = ~const & (lead + total >= 8 + BITS * BLOCK)
    rice = ~const & ~plain
    whole = np.where(const, 16, np.where(plain, 8 + BITS * BLOCK, lead + total))
    heads = [head(int(i)) for i in numbers]
    head_len = np.fromiter(map(len, heads), np.int64, n)
    bytes_ = head_len + (whole + 7) // 8
    at = np.cumsum(bytes_ + 2) - (bytes_ + 2)
    n_bytes = int((bytes_ + 2).sum())
    body = (at + head_len) * 8
    ends: list[np.ndarray] = []  # fields of up to 15 bits: where they end and what they hold
    held: list[np.ndarray] = []

    def put(where: np.ndarray, value, width: int) -> None:
        ends.append(where + width)
        held.append(np.broadcast_to(value, where.shape).astype(np.int64))

    raw = (x & 0xFF).astype(np.uint8)
    verbatim = np.flatnonzero(plain)
    for rows, kind in ((np.flatnonzero(const), 0), (verbatim, 1), (np.flatnonzero(rice & ~use_lpc), 9), (np.flatnonzero(rice & use_lpc), 33)):
        if not len(rows):
            continue
        p = body[rows]
        put(p, np.int64(kind << 1), 8)
        if kind == 0:
            put(p + 8, raw[rows, 0], 8)
        elif kind > 1:
            o = 1 if kind == 9 else 2
            for i in range(o):
                put(p + 8 + 8 * i, raw[rows, i], 8)
            p = p + 8 + 8 * o
            if o == 2:
                put(p, np.int64((_PRECISION - 1) << 5 | _SHIFT), 9)
                for i in range(2):
                    put(p + 9 + _PRECISION * i, coef[rows, i] & ((1 << _PRECISION) - 1), _PRECISION)
                p = p + 9 + 2 * _PRECISION
            put(p, k[rows], 10)  # method 0, partition order 0, the parameter
            stop = (p + 10)[:, None] + np.cumsum(size[rows, o:], axis=1, dtype=np.int64)
            one = (1 << k[rows])[:, None]
            ends.append(stop.ravel())
            held.append(((u[rows, o:] & (one - 1)) | one).ravel().astype(np.int64))  # zeros before the 1 are there already
    end = np.concatenate(ends) - 1
    value = np.concatenate(held) << (7 - (end & 7))
    last = end >> 3
    data = np.zeros(n_bytes + 2)
    for i in range(3):  # fields share no bit, so sums are unions
        data += np.bincount(last + (2 - i), weights=(value >> (8 * i)) & 0xFF, minlength=n_bytes + 2)
    data = data[2:].astype(np.uint8)
    data[((body[verbatim] >> 3) + 1)[:, None] + np.arange(BLOCK)] = raw[verbatim]
    for i, h in enumerate(heads):
        data[at[i] : at[i] + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16(data, at, bytes_)
    data[at + bytes_], data[at + bytes_ + 1] = crc >> 8, crc & 0xFF
    return [data[a : a + b + 2].tobytes() for a, b in zip(at, bytes_, strict=True)]


def stream_head(n_samples: int, md5: bytes, sizes: list[int]) -> bytes:
    """Marker, STREAMINFO and a SEEKTABLE with a point for every 64th frame."""
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | (BITS - 1) << 36 | n_samples).to_bytes(8, "big") + md5
    points, at = [], 0
    for i, s in enumerate(sizes):
        if i % 64 == 0:
            points.append((i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + BLOCK.to_bytes(2, "big"))
        at += s
    seek = b"".join(points)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, a positive multiple of BLOCK bytes long; bytes are samples plus 128."""
    counts = [len(p) // BLOCK for p in payloads]
    frames: list[bytes] = []
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16).reshape(-1, BLOCK) - 128
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, int)
    for i in range(0, len(x), SLICE):
        frames += encode_frames(x[i : i + SLICE], numbers[i : i + SLICE])
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        mine = frames[at : at + c]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        out.append(stream_head(len(p), hashlib.md5(signed).digest(), [len(f) for f in mine]) + b"".join(mine))
        at += c
    return out


def _metadata(s: bytes) -> tuple[int, int, bytes]:
    """(where frames begin, samples, md5) of a stream."""
    if s[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, samples, md5, last = 4, 0, b"", False
    while not last:
        last, kind, size = bool(s[at] & 0x80), s[at] & 0x7F, int.from_bytes(s[at + 1 : at + 4], "big")
        if kind == 0:
            v = int.from_bytes(s[at + 14 : at + 22], "big")
            samples, md5 = v & ((1 << 36) - 1), s[at + 22 : at + 38]
            if int.from_bytes(s[at + 4 : at + 6], "big") != BLOCK or (v >> 36 & 31) != BITS - 1 or v >> 41 & 7:
                raise ValueError("only mono streams of 8 bits and blocks of 576 are read here")
        at += 4 + size
    return at, samples, md5


def decode_frames(data: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, length in bytes, 0 where the CRC-16 is wrong) of the frames at starts; headers and CRC-8 must be right."""
    n = len(starts)
    head_len = np.array([len(head(int(i))) for i in numbers])
    for h in np.unique(numbers):
        want = np.frombuffer(head(int(h)), np.uint8)
        if (data[starts[numbers == h][:, None] + np.arange(len(want))] != want).any():
            raise ValueError("bad frame header or CRC-8")
    lo = int(starts.min())
    hi = min(len(data), int(starts.max()) + 16 + BLOCK * 2)
    piece = np.concatenate([data[lo:hi], np.zeros(16, np.uint8)])
    # the 64 bits from each byte on
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(piece, 8)).view(">u8").ravel().astype(np.uint64)

    def get(p: np.ndarray, width: np.ndarray) -> np.ndarray:  # up to 24 bits
        return ((words[p >> 3] << (p & 7).astype(np.uint64)) >> (64 - width).astype(np.uint64)).astype(np.int64)

    def signed(v: np.ndarray, width) -> np.ndarray:
        return v - ((v >> (width - 1)) << width)

    p = (starts - lo + head_len).astype(np.int64) * 8
    kind = get(p, np.full(n, 8))
    p = p + 8
    x = np.zeros((BLOCK, n), np.int32)  # samples first: each step writes one row
    end = np.zeros(n, np.int64)
    for t in np.unique(kind):
        rows = np.flatnonzero(kind == t)
        q, code = p[rows], int(t) >> 1
        eight = np.full(len(rows), 8)
        if code == 0:
            x[:, rows] = signed(get(q, eight), 8)
            end[rows] = q + 8
            continue
        if code == 1:
            x[:, rows] = piece[(q >> 3)[:, None] + np.arange(BLOCK)].view(np.int8).T  # the body begins with a byte
            end[rows] = q + BITS * BLOCK
            continue
        if 8 <= code <= 12:
            order = code - 8
        elif code >= 32:
            order = code - 31
        else:
            raise ValueError("reserved subframe type")
        for i in range(order):
            x[i, rows] = signed(get(q, eight), 8)
            q = q + 8
        fixed = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
        if code >= 32:
            precision = get(q, np.full(len(rows), 4)) + 1
            shift = get(q + 4, np.full(len(rows), 5)).astype(np.int32)
            q = q + 9
            coef = []
            for _ in range(order):
                coef.append(signed(get(q, precision), precision).astype(np.int32))
                q = q + precision
        else:
            shift, coef = np.int32(0), [np.int32(c) for c in fixed[order]]
        method = get(q, np.full(len(rows), 2))
        parts = get(q + 2, np.full(len(rows), 4))
        q = q + 6
        if (method > 1).any():
            raise ValueError("reserved residual coding")
        own = np.zeros((BLOCK, len(rows)), np.int32)
        own[:order] = x[:order, rows]
        wide = 4 + method
        k = np.zeros(len(rows), np.int64)
        length = BLOCK >> parts  # samples of a partition
        many = bool(parts.any())
        for i in range(order, BLOCK):
            if i == order or many:
                new = np.flatnonzero(i % length == 0) if i > order else np.arange(len(rows))
                if len(new):
                    k[new] = get(q[new], wide[new])
                    if (k[new] == (1 << wide[new]) - 1).any():
                        raise ValueError("escaped partitions are not read here")
                    q[new] += wide[new]
                    cut, more = (64 - k).astype(np.uint64), k + 1
                    none = k == 0
                    any_none = bool(none.any())
            w = words[q >> 3] << (q & 7).astype(np.uint64)
            zeros = 1075 - ((w >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)  # before the first 1
            if (zeros + more > 52).any():  # a code too long for one look
                for j in np.flatnonzero(zeros + more > 52):
                    at, zeros[j] = int(q[j]), 0
                    while at >> 3 < len(words) - 1 and not (int(words[at >> 3]) >> (63 - (at & 7))) & 1:
                        at += 1
                    zeros[j] = at - int(q[j])
                    w[j] = words[at >> 3] << np.uint64(at & 7)
                far = zeros + more > 52
                w[~far] <<= (zeros[~far] + 1).astype(np.uint64)
                w[far] <<= np.uint64(1)
            else:
                w <<= (zeros + 1).astype(np.uint64)
            low = (w >> cut).astype(np.int32) if not any_none else np.where(none, 0, (w >> np.minimum(cut, np.uint64(63))).astype(np.int64)).astype(np.int32)
            u = (zeros << k).astype(np.int32) | low
            q += zeros + more
            r = (u >> 1) ^ -(u & 1)
            if order == 1 and code < 32:
                own[i] = own[i - 1] + r
            elif order:
                guess = coef[0] * own[i - 1]
                for j in range(1, order):
                    guess = guess + coef[j] * own[i - 1 - j]
                own[i] = (guess >> shift) + r
            else:
                own[i] = r
        x[:, rows] = own
        end[rows] = q
    lengths = (end + 7) // 8 - (starts - lo)
    crc = crc16(data, starts, lengths)
    tail = starts + lengths
    good = tail + 2 <= len(data)
    good[good] = crc[good] == (data[tail[good]].astype(np.uint16) << 8 | data[tail[good] + 1])
    return x.T, np.where(good, lengths + 2, 0)


def frame_starts(stream: bytes, first: int, n: int) -> list[int]:
    """Where the n frames of a stream seem to begin: each header, with its number and CRC-8, is looked for in turn."""
    out, at = [], first
    for i in range(n):
        at = stream.find(head(i), at)
        if at < 0:
            raise ValueError("a frame is missing")
        out.append(at)
        at += 1
    return out


def _one_by_one(stream: bytes, first: int, n: int) -> tuple[np.ndarray, list[int]]:
    """The frames of one stream in turn: for streams with bytes inside a frame that look like the next header."""
    data, at, out, starts = np.frombuffer(stream, np.uint8), first, [], []
    for i in range(n):
        x, size = decode_frames(data, np.array([at]), np.array([i]))
        if not size[0]:
            raise ValueError("bad frame CRC-16")
        out.append(x)
        starts.append(at)
        at += int(size[0])
    return np.concatenate(out), starts


def decode(streams: list[bytes]) -> list[tuple[bytes, list[int]]]:
    """(payload, byte offsets of its frames) of each stream; frame checksums and the PCM's MD5 are verified."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    starts, numbers, metas, base = [], [], [], 0
    for s in streams:
        first, samples, md5 = _metadata(s)
        mine = frame_starts(s, first, samples // BLOCK)
        metas.append((base, first, mine, md5))
        starts += [base + a for a in mine]
        numbers += range(len(mine))
        base += len(s)
    starts, numbers = np.array(starts, np.int64), np.array(numbers, np.int64)
    x, sizes = np.zeros((len(starts), BLOCK), np.int8), np.zeros(len(starts), np.int64)
    for i in range(0, len(starts), FRAMES):
        try:
            x[i : i + FRAMES], sizes[i : i + FRAMES] = decode_frames(data, starts[i : i + FRAMES], numbers[i : i + FRAMES])
        except ValueError:  # damage, or a start that is none: below each stream is read in turn, and damage raises
            continue
    out, at = [], 0
    for s, (base, first, mine, md5) in zip(streams, metas, strict=True):
        own, size = x[at : at + len(mine)], sizes[at : at + len(mine)]
        at += len(mine)
        if not size.all() or (np.array(mine) + size != np.array([*mine[1:], len(s)])).any():
            own, mine = _one_by_one(s, first, len(mine))
        pcm = own.astype(np.int8).tobytes()
        if hashlib.md5(pcm).digest() != md5:
            raise ValueError("bad MD5 of the samples")
        out.append(((np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes(), mine))
    return out


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text, null as empty, with bytes 255 up to a positive multiple of BLOCK; and its own length."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + b"\xff" * (-len(b) % BLOCK if b else BLOCK), len(b)


def _groups(values: list, weight, most: int = FRAMES * BLOCK) -> Iterator[list]:
    """Runs of values of at most so many bytes, or one value each."""
    run, size = [], 0
    for v in values:
        if run and size + weight(v) > most:
            yield run
            run, size = [], 0
        run.append(v)
        size += weight(v)
    if run:
        yield run


def encode_texts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_bytes and media, the FLAC stream of the padded text. Repeated rows get a row each; null texts are empty."""

    def run(batches):
        for b in batches:
            rows, at = b.column("flac_text"), 0
            for group in _groups([payload(t.as_py()) for t in rows], lambda v: len(v[0])):
                media = encode([p for p, _ in group])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(group)) for k in keys), pa.array([n for _, n in group], pa.int64()), pa.array(media, pa.binary())], names=[*keys, "n_bytes", "media"])
                at += len(group)

    rows = docs.select(*keys, F.col(text).alias("flac_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, n_bytes bigint, media binary".lstrip(", "))


#: What describe() measures, in its order.
FEATURES = ["energy", "crossings", "letters", "digits", "spaces", "high"]
_CLASS = np.zeros((4, 256), bool)
_CLASS[0, [*range(65, 91), *range(97, 123)]] = _CLASS[1, 48:58] = _CLASS[2, [32, *range(9, 14)]] = _CLASS[3, 128:] = True


def describe(pcm: bytes) -> list[float]:
    """Of unsigned 8-bit samples: mean energy about the middle, the share of steps that cross it, and of byte classes."""
    x = np.frombuffer(pcm, np.uint8)
    n = max(len(x), 1)
    count = np.bincount(x, minlength=256)
    energy = count @ (np.arange(256) - 128.0) ** 2 / n
    return [float(energy), np.count_nonzero(np.diff(x >= 128)) / max(len(x) - 1, 1), *(_CLASS @ count / n).tolist()]


def decode_media(media: DataFrame, keys: list[str]) -> DataFrame:
    """keys, blocks and features. blocks: (sample_offset, byte_offset, pcm) of each frame of the column media, verified, in order.

    pcm is unsigned 8-bit. The byte offset leads to a frame without reading those before it. features, an array as in
    FEATURES, describe the samples read back. A damaged stream raises. Null streams give nulls.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("pcm", pa.binary())]))
        for b in batches:
            at = 0
            for group in _groups([m.as_py() for m in b.column("flac_media")], lambda v: len(v or b""), FRAMES * BLOCK * 3 // 4):
                found = iter(decode([m for m in group if m is not None]))
                blocks, features = [], []
                for m in group:
                    p, starts = (None, None) if m is None else next(found)
                    blocks.append(None if m is None else [{"sample_offset": i * BLOCK, "byte_offset": a, "pcm": p[i * BLOCK : (i + 1) * BLOCK]} for i, a in enumerate(starts)])
                    features.append(None if m is None else describe(p))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(group)) for k in keys), pa.array(blocks, kind), pa.array(features, pa.list_(pa.float64()))], names=[*keys, "blocks", "features"])
                at += len(group)

    rows = media.select(*keys, F.col("media").alias("flac_media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, blocks array<struct<sample_offset:bigint,byte_offset:bigint,pcm:binary>>, features array<double>")
