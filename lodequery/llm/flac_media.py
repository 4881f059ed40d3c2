"""FLAC media columns: lossless 8-bit mono streams, written and decoded in Spark tasks.

A payload of bytes is stored as the 8-bit samples ``byte - 128`` of a FLAC stream
of blocks of 512 samples, each with a constant, verbatim, fixed or linear
predictor and Rice-coded residuals. Decoding finds the frames by sync code,
header checksum and frame number, verifies every frame's CRC-16 and the stream's
MD5, decodes the Rice codes of many frames side by side, one codeword of each at
a step, undoes the predictors in the same way, and gives PCM blocks with the
sample offsets at which they can be sought.

Memory is bounded by some thousand frames at a time beside the rows of one Arrow
batch. Null and empty texts are a payload of 64 zero bytes; very long texts are
stored whole; equal texts give equal streams; an empty table gives an empty
result; other columns are left out; repeated rows and ids are rows each for itself,
in no order. A stream that is damaged raises ValueError in :func:`decode_all`; as a
row of a table it has nulls and an ``error`` instead, and keeps no other row from
being read. Streams with more than one channel or other sample sizes, escaped Rice
partitions and variable block sizes are not read, which is such an error too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

BLOCK = 512
PAD = 64
CHUNK_FRAMES = 2048
SEEK_EVERY = 16
LPC_ORDER = 4
LPC_PRECISION = 12
SAMPLE_RATE = 8000

# Fixed values of the format: coefficients of the fixed predictors by order.
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


@lru_cache
def _crc_table(poly: int, width: int) -> np.ndarray:
    c = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        c = np.where(c >> (width - 1) & 1, (c << 1) ^ poly, c << 1) & ((1 << width) - 1)
    return c.astype(np.int32)


def _crc8(data: bytes) -> int:
    t, c = _crc_table(0x07, 8), 0
    for b in data:
        c = int(t[c ^ b])
    return c


def _crc16_all(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many runs of ``data``, a byte of each at a step."""
    t = _crc_table(0x8005, 16)
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], lengths[order]
    crc = np.zeros(len(at), np.int32)
    active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")
    for i, a in enumerate(active):
        c = crc[:a]
        crc[:a] = t[(c >> 8) ^ data[at[:a] + i]] ^ ((c << 8) & 0xFFFF)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF << (8 - size - 1) << 1) & 0xFF & ~(1 << (7 - size)) | n >> (6 * (size - 1)), *tail])


@lru_cache(1 << 16)
def _frame_header(number: int, size: int) -> bytes:
    usual = size == BLOCK
    head = bytes([0xFF, 0xF8, (0x90 if usual else 0x70) | 0x04, 0x02]) + _coded_number(number)
    head += b"" if usual else struct.pack(">H", size - 1)
    return head + bytes([_crc8(head)])


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients and shifts of the rows of ``x``."""
    f, n, p = x.shape[0], x.shape[1], LPC_ORDER
    w = x * np.hanning(n + 2)[1:-1]
    r = np.stack([(w[:, : n - k] * w[:, k:]).sum(1) for k in range(p + 1)], 1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a, err = np.zeros((f, p)), r[:, 0].copy()
    for i in range(p):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        prev = a[:, :i].copy()
        a[:, :i] = prev - k[:, None] * prev[:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-12)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(LPC_PRECISION - 1 - np.ceil(np.log2(top)), 0, 15).astype(np.int32)
    limit = (1 << (LPC_PRECISION - 1)) - 1
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int32)
    return q, shift


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice_k(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameter of each row and the bits that its codes take."""
    if not u.shape[1]:
        return np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
    k = np.clip(np.floor(np.log2(np.maximum(u.mean(1) * 0.69, 1))), 0, 14).astype(np.int32)
    bits = lambda k: (u >> k[:, None]).sum(1) + (1 + k) * u.shape[1]
    more = np.minimum(k + 1, 14)
    a, b = bits(k), bits(more)
    return np.where(b < a, more, k), np.minimum(a, b)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _encode_rows(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of the rows of ``x``, blocks of one size."""
    f, n = x.shape
    tries = [(8, 0, x, None, None)] + [(8 + o, o, np.diff(x, o), None, None) for o in (1, 2)]
    if n > 2 * LPC_ORDER:
        q, shift = _lpc(x.astype(np.float64))
        guess = sum(x[:, LPC_ORDER - 1 - i : n - 1 - i] * q[:, i : i + 1] for i in range(LPC_ORDER)) >> shift[:, None]
        tries.append((32 + LPC_ORDER - 1, LPC_ORDER, x[:, LPC_ORDER:] - guess, q, shift))
    coded = []
    for kind, order, r, q, shift in tries:
        u = _zigzag(r)
        k, size = _rice_k(u)
        coded.append((kind, order, u, k, 8 + 8 * order + 10 + size + (9 + LPC_PRECISION * order if q is not None else 0), q, shift))
    cost = np.stack([c[4] for c in coded] + [np.full(f, 8 + 8 * n)] + [np.where((x == x[:, :1]).all(1), 16, 1 << 40)], 1)
    best = cost.argmin(1)
    headers = [_frame_header(i, n) for i in numbers]
    head = np.array([len(h) for h in headers])
    size = head + (cost[np.arange(f), best] + 7) // 8 + 2
    start = np.concatenate(([0], np.cumsum(size)))
    bits = np.zeros(int(start[-1]) * 8, np.uint8)
    at = (start[:-1] + head) * 8
    for c in range(cost.shape[1]):
        rows = np.flatnonzero(best == c)
        if not len(rows):
            continue
        p = at[rows]
        if c >= len(coded):  # verbatim or constant
            _put(bits, p, np.full(len(rows), 2 if c == len(coded) else 0), 8)
            samples = x[rows] if c == len(coded) else x[rows, :1]
            _put(bits, (p[:, None] + 8 + 8 * np.arange(samples.shape[1])).ravel(), (samples & 0xFF).ravel(), 8)
            continue
        kind, order, u, k, _, q, shift = coded[c]
        u, k = u[rows], k[rows]
        _put(bits, p, np.full(len(rows), kind << 1), 8)
        p = p + 8
        for i in range(order):
            _put(bits, p, x[rows, i] & 0xFF, 8)
            p = p + 8
        if q is not None:
            _put(bits, p, np.full(len(rows), LPC_PRECISION - 1), 4)
            _put(bits, p + 4, shift[rows], 5)
            p = p + 9
            for i in range(order):
                _put(bits, p, q[rows, i] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
                p = p + LPC_PRECISION
        _put(bits, p, k, 10)  # no coding method and partition order bits are set
        p = p + 10
        for kk in np.unique(k):
            own = np.flatnonzero(k == kk)
            v = u[own]
            lead = v >> kk
            ends = np.cumsum(lead + 1 + kk, 1)
            stop = (p[own, None] + ends - 1 - kk).ravel()
            bits[stop] = 1
            _put(bits, stop + 1, (v & ((1 << int(kk)) - 1)).ravel(), int(kk))
    data = np.packbits(bits)
    flat = np.frombuffer(b"".join(headers), np.uint8)
    data[np.repeat(start[:-1] - np.concatenate(([0], np.cumsum(head)[:-1])), head) + np.arange(len(flat))] = flat
    crc = _crc16_all(data, start[:-1], size - 2)
    data[start[1:] - 2], data[start[1:] - 1] = crc >> 8, crc & 0xFF
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload; a payload's length is a multiple of 64 and not 0."""
    where: dict[int, list[tuple[int, int]]] = {}
    for d, p in enumerate(payloads):
        for i in range(0, len(p), BLOCK):
            where.setdefault(min(BLOCK, len(p) - i), []).append((d, i // BLOCK))
    frames: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in payloads]
    for size, places in where.items():
        for c in range(0, len(places), CHUNK_FRAMES):
            own = places[c : c + CHUNK_FRAMES]
            raw = b"".join(payloads[d][i * BLOCK : i * BLOCK + size] for d, i in own)
            x = np.frombuffer(raw, np.uint8).reshape(len(own), size).astype(np.int32) - 128
            for (d, i), frame in zip(own, _encode_rows(x, [i for _, i in own]), strict=True):
                frames[d][i] = frame
    return [_stream(p, f) for p, f in zip(payloads, frames, strict=True)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist()
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big")
    info += hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
    seek = b"".join(struct.pack(">QQH", i * BLOCK, offsets[i], min(BLOCK, len(payload) - i * BLOCK)) for i in range(0, len(frames), SEEK_EVERY))
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def _metadata(media: bytes) -> tuple[int, int, bytes, int]:
    """Block size, samples, MD5 and where the frames begin."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    pos, last, found = 4, False, None
    while not last:
        if pos + 4 > len(media):
            raise ValueError("the metadata is cut off")
        last, kind, size = bool(media[pos] & 0x80), media[pos] & 0x7F, int.from_bytes(media[pos + 1 : pos + 4], "big")
        body = media[pos + 4 : pos + 4 + size]
        if kind == 0:
            low, high = struct.unpack(">HH", body[:4])
            packed = int.from_bytes(body[10:18], "big")
            if low != high or packed >> 41 & 7 or packed >> 36 & 31 != 7:
                raise ValueError("only 8-bit mono streams of a fixed block size are read")
            found = high, packed & ((1 << 36) - 1), body[18:34]
        pos += 4 + size
    if found is None:
        raise ValueError("the stream has no STREAMINFO")
    return *found, pos


def _frames(media: bytes, first: int, block: int, samples: int) -> list[tuple[int, int, int]]:
    """Start, header length and size of each frame, found by sync code, header and number."""
    data = np.frombuffer(media, np.uint8)
    at = first + np.flatnonzero((data[first:-1] == 0xFF) & (data[first + 1 :] == 0xF8))
    out: list[tuple[int, int, int]] = []
    for p in at.tolist():
        i = len(out)
        size = min(block, samples - i * block)
        if size <= 0:
            break
        coded = _coded_number(i)
        code = media[p + 2] >> 4 if p + 2 < len(media) else 0
        extra = {6: 1, 7: 2}.get(code, 0)
        end = p + 4 + len(coded) + extra
        told = 1 + int.from_bytes(media[end - extra : end], "big") if extra else 256 << (code - 8) if code >= 8 else {1: 192}.get(code, 576 << max(0, code - 2))
        if media[p + 4 : p + 4 + len(coded)] != coded or told != size or end >= len(media) or _crc8_cached(media[p:end]) != media[end]:
            continue
        out.append((p, end + 1 - p, size))
    if len(out) * block < samples:
        raise ValueError("a frame is missing")
    return out


@lru_cache(1 << 16)
def _crc8_cached(head: bytes) -> int:
    return _crc8(head)


def _bits_at(data: np.ndarray, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Unsigned fields of up to 16 bits; ``data`` has spare bytes at its end."""
    b = at >> 3
    v = data[b].astype(np.int32) << 8
    v |= data[b + 1]
    v <<= 8
    v |= data[b + 2]
    v >>= (24 - width - (at & 7)).astype(np.int32)
    v &= np.asarray((1 << width) - 1, np.int32)
    return v


def _signed(v: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    return v - ((v >> (width - 1) & 1) << width)


def _decode_frames(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Samples of the frames whose subframes begin at the bits ``at`` of ``data``."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(at)
    kind = _bits_at(data, at, 8) >> 1
    bits = np.unpackbits(data)
    ones = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
    next_one = np.ascontiguousarray(np.minimum.accumulate(ones[::-1])[::-1])
    del bits, ones
    for which in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == which)
        rows = rows[np.argsort(-sizes[rows], kind="stable")]
        for own, x in _decode_alike(data, next_one, rows, at[rows] + 8, which, sizes[rows]):
            for r, samples in zip(own.tolist(), x, strict=True):
                out[r] = samples[: sizes[r]]
    return out


def _decode_alike(data, next_one, rows, p, kind: int, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Samples of subframes of one kind, the longest first; rows of ``x`` are as long as the longest."""
    n = int(sizes[0])
    if kind == 0:
        yield rows, np.repeat(_signed(_bits_at(data, p, 8), 8)[:, None], n, 1)
        return
    if kind == 1:
        yield rows, _signed(_bits_at(data, np.minimum(p[:, None] + 8 * np.arange(n), len(next_one) - 25), 8), 8)
        return
    lpc, order = kind >= 32, kind - 31 if kind >= 32 else kind - 8
    if not (lpc or 0 <= order <= 4):
        raise ValueError("a reserved subframe type")
    f = len(rows)
    x = np.zeros((n, f), np.int32)
    for i in range(order):
        x[i] = _signed(_bits_at(data, p, 8), 8)
        p = p + 8
    coef, shift = np.zeros((order, f), np.int32), np.zeros(f, np.int32)
    if lpc:
        precision, shift = _bits_at(data, p, 4) + 1, _bits_at(data, p + 4, 5).astype(np.int32)
        p = p + 9
        for i in range(order):
            coef[i] = _signed(_bits_at(data, p, precision), precision)
            p = p + precision
    else:
        for i, c in enumerate(FIXED[order]):
            coef[i] = c
    if (_bits_at(data, p, 2) != 0).any():
        raise ValueError("only Rice codes with 4-bit parameters are read")
    parts = _bits_at(data, p + 2, 4)
    p = p + 6
    alike = parts * (1 + n) + np.where(parts > 0, sizes, 0)  # partitions of unequal lengths are not stepped through together
    for key in np.unique(alike).tolist():
        own = np.flatnonzero(alike == key)
        power, long = int(parts[own[0]]), int(sizes[own[0]])
        active = np.searchsorted(-sizes[own], -np.arange(long), side="left")
        pos, res = p[own].astype(np.int32), np.zeros((n, len(own)), np.int32)
        each, done = long >> power, order
        for part in range(1 << power):
            k = _bits_at(data, pos, 4).astype(np.int32)
            if (k == 15).any():
                raise ValueError("escaped partitions are not read")
            pos = pos + 4
            count = each * (part + 1) - done
            begin, stop = np.zeros((count, len(own)), np.int32), np.zeros((count, len(own)), np.int32)
            width = k + 1
            for i in range(count):
                a = active[done + i]
                begin[i, :a] = pos[:a]
                stop[i, :a] = next_one[np.minimum(pos[:a], len(next_one) - 1)]
                np.add(stop[i, :a], width[:a], out=pos[:a])
            if pos.size and int(pos.max()) > len(next_one):
                raise ValueError("the Rice codes run over the end")
            u = (stop - begin) << k
            u |= _bits_at(data, np.minimum(stop + 1, len(next_one) - 25), k)
            np.bitwise_xor(u >> 1, -(u & 1), out=res[done : done + count])
            done += count
        y, c, s = x[:, own], coef[:, own], shift[own]
        y[order:] = res[order:]
        guess, term = np.empty_like(s), np.empty_like(s)
        for i in range(order, long if order else 0):
            a = active[i]
            g, t = guess[:a], term[:a]
            np.multiply(c[0, :a], y[i - 1, :a], out=g)
            for j in range(1, order):
                np.multiply(c[j, :a], y[i - 1 - j, :a], out=t)
                g += t
            g >>= s[:a]
            y[i, :a] += g
        yield rows[own], y.T


def decode_all(medias: list[bytes]) -> list[bytes]:
    """The payload of each stream; verifies every frame's CRC-16 and the MD5."""
    heads = [_metadata(m) for m in medias]
    places: list[tuple[int, int, int, int, int]] = []  # stream, start, end, header, samples
    for d, (m, (block, samples, _, first)) in enumerate(zip(medias, heads, strict=True)):
        frames = _frames(m, first, block, samples)
        ends = [f[0] for f in frames[1:]] + [len(m)]
        places += [(d, p, e, h, n) for (p, h, n), e in zip(frames, ends, strict=True)]
    pcm: list[list[np.ndarray]] = [[] for _ in medias]
    for c in range(0, len(places), CHUNK_FRAMES):
        own = places[c : c + CHUNK_FRAMES]
        data = np.frombuffer(b"".join(medias[d][p:e] for d, p, e, _, _ in own) + bytes(4), np.uint8)
        size = np.array([e - p for _, p, e, _, _ in own])
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        crc = _crc16_all(data, start, size - 2)
        end = start + size
        if (crc != (data[end - 2].astype(np.int32) << 8 | data[end - 1])).any():
            raise ValueError("a frame's checksum is wrong")
        got = _decode_frames(data, (start + np.array([h for *_, h, _ in own])) * 8, np.array([n for *_, n in own]))
        for (d, *_), x in zip(own, got, strict=True):
            pcm[d].append((x + 128).astype(np.uint8))
    out = []
    for x, (_, _, md5, _) in zip(pcm, heads, strict=True):
        payload = np.concatenate(x) if x else np.empty(0, np.uint8)
        if hashlib.md5((payload ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("the stream's MD5 is wrong")
        out.append(payload.tobytes())
    return out


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\0")


def _sliced(values: Iterable, weight: int = 1 << 20) -> Iterator[list]:
    """Runs of values of about ``weight`` bytes."""
    run, held = [], 0
    for v in values:
        run.append(v)
        held += len(v)
        if held >= weight:
            yield run
            run, held = [], 0
    if run:
        yield run


@F.pandas_udf(T.BinaryType())
def _encode_texts(texts: pd.Series) -> pd.Series:
    return pd.Series([m for run in _sliced(map(payload_of, texts)) for m in encode_all(run)], dtype=object)


def _decoded(medias: list[bytes]) -> list[tuple[bytes | None, str | None]]:
    """Payload or error of each stream; where one of them can't be read, each is decoded by itself."""
    try:
        return [(p, None) for p in decode_all(medias)]
    except (ValueError, IndexError, struct.error) as e:
        return [(None, str(e))] if len(medias) == 1 else [x for m in medias for x in _decoded([m])]


PCM = T.ArrayType(
    T.StructType([T.StructField("sample_offset", T.LongType()), T.StructField("pcm", T.BinaryType()), T.StructField("error", T.StringType())])
)


@F.pandas_udf(PCM)
def _decode_blocks(media: pd.Series) -> pd.Series:
    out = []
    for run in _sliced(b"" if m is None else bytes(m) for m in media):
        got = iter(_decoded([m for m in run if m]))
        for m in run:
            p, error = next(got) if m else (b"", None)
            step = BLOCK * SEEK_EVERY
            blocks = [{"sample_offset": i, "pcm": p[i : i + step], "error": None} for i in range(0, len(p or b""), step)]
            out.append(blocks if error is None else [{"sample_offset": None, "pcm": None, "error": error}])
    return pd.Series(out, dtype=object)


def flac_column(text_col: str) -> Column:
    """The FLAC stream of the texts in ``text_col``; never null."""
    return _encode_texts(F.col(text_col))


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The decoded streams as blocks: id, ``sample_offset``, ``pcm``, 8-bit unsigned samples, and ``error``.

    A null or empty stream has no block, a damaged one a row with its error alone.
    """
    return df.select(id_col, F.explode(_decode_blocks(F.col(media_col))).alias("_b")).select(id_col, "_b.*")


FEATURES = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def feature_of(payload: bytes) -> str:
    """Mean, root mean square and zero crossings of the decoded samples, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings}"


@F.pandas_udf(FEATURES)
def _read_back(media: pd.Series) -> pd.DataFrame:
    rows = []
    for run in _sliced(bytes(m) for m in media):
        for m, (p, error) in zip(run, _decoded(run), strict=True):
            of_payload = (None, None, None, None) if p is None else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD:]), feature_of(p))
            rows.append((*of_payload[:3], len(m), hashlib.sha256(m).hexdigest(), of_payload[3], error))
    return pd.DataFrame(rows, columns=FEATURES.names).astype({"payload_bytes": "Int64", "tail_crc32": "Int64"})


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a FLAC stream, read the stream back and describe what was read."""
    stored = df.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), flac_column(text_col).alias("_media"))
    return stored.select(id_col, "n_bytes", _read_back("_media").alias("_read")).select(id_col, "n_bytes", "_read.*")


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


QUERIES = {"op6_flac_media": op6_flac_media}
ORACLES: dict[str, str] = {}
