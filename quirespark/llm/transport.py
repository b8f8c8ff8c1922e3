"""Media columns: MPEG transport streams in a binary column.

``demux`` parses streams of 188-byte packets: finds the packets (again after lost sync), reads
the program tables, checks continuity counters, drops repeated packets, puts elementary
packets together, and returns a row per elementary packet with its time stamps and whether it
is a random-access point. All packets of a chunk of streams are taken apart at once as an
array [packets, 188]. ``mux`` writes such streams; the query uses it to make streams
out of documents, since the tables hold no media.

Defined results: a null or empty stream, or one without valid program tables, gives no row;
bytes that belong to no packet are skipped; packets with the error flag are dropped and count as
lost; data before a stream's first unit start is dropped; a unit with a lost packet or of a length other than
announced is returned with ``complete`` false; equal rows give equal rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, chunks, ranges, record, strings, utf8

SIZE = 188
PMT_PID, VIDEO_PID, AUDIO_PID = 4096, 256, 257
STREAM_TYPES = {VIDEO_PID: 0x1B, AUDIO_PID: 0x0F}
UNIT_BYTES = 2700
KEY_EVERY = 8
TICKS = 3600  # of 90 kHz between units


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + crc32(head).to_bytes(4, "big")


PAT = section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
PMT = section(2, 1, bytes([0xE0 | VIDEO_PID >> 8, VIDEO_PID & 255, 0xF0, 0]) + b"".join(bytes([t, 0xE0 | p >> 8, p & 255, 0xF0, 0]) for p, t in STREAM_TYPES.items()))


def _stamp(v: np.ndarray, mark: int) -> np.ndarray:
    """Five bytes of a 33-bit time stamp, [n, 5]."""
    return np.stack([(mark << 4) | ((v >> 30) & 7) << 1 | 1, (v >> 22) & 255, ((v >> 15) & 127) << 1 | 1, (v >> 7) & 255, (v & 127) << 1 | 1], 1).astype(np.uint8)


def _unstamp(b: np.ndarray) -> np.ndarray:
    b = b.astype(np.int64)
    return ((b[:, 0] >> 1) & 7) << 30 | b[:, 1] << 22 | (b[:, 2] >> 1) << 15 | b[:, 3] << 7 | b[:, 4] >> 1


def mux(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Streams that carry the bytes of each document: units by turns on a video and an audio stream, every eighth video unit a random-access point."""
    size = np.diff(off)
    nu = -(-size // UNIT_BYTES)
    uoff = np.r_[0, np.cumsum(nu)]
    doc = np.repeat(np.arange(len(size)), nu)
    no = np.arange(len(doc)) - uoff[doc]
    start = off[doc] + no * UNIT_BYTES
    data = np.minimum(UNIT_BYTES, off[doc + 1] - start)
    video = no % 2 == 0
    key = video & (no // 2 % KEY_EVERY == 0)
    pts = no // 2 * TICKS + 7200
    head = np.where(video, 19, 14)
    total = head + data
    # Elementary packets: header, then data.
    pos = np.r_[0, np.cumsum(total)]
    es = np.zeros(int(pos[-1]), np.uint8)
    p = pos[:-1]
    es[p + 2] = 1
    es[p + 3] = np.where(video, 0xE0, 0xC0)
    length = total - 6
    es[p + 4], es[p + 5] = length >> 8, length & 255
    es[p + 6] = 0x80
    es[p + 7] = np.where(video, 0xC0, 0x80)
    es[p + 8] = head - 9
    for m, mark, at, value in ((video, 3, 9, pts), (~video, 2, 9, pts), (video, 1, 14, pts - 3600)):
        i = np.flatnonzero(m)
        es[(p[i] + at)[:, None] + np.arange(5)] = _stamp(value[i], mark)
    es[ranges(p + head, data)] = buf[ranges(start, data)]
    # Packets of a unit: the first of a random-access point has the flag and a clock, the last is filled up.
    extra = np.where(key, 8, 0)
    np_unit = -(-(total + extra) // 184)
    short = np_unit * 184 - total - extra  # to be filled up in the last packet
    unit = np.repeat(np.arange(len(doc)), np_unit)
    nth = np.arange(len(unit)) - np.repeat(np.r_[0, np.cumsum(np_unit)[:-1]], np_unit)
    first, last = nth == 0, nth == np_unit[unit] - 1
    adapt = np.where(first, extra[unit], 0) + np.where(last, short[unit], 0)  # bytes of adaptation field, its length byte included
    n_es = len(unit)
    P = np.full((n_es + 2 * len(size), SIZE), 0xFF, np.uint8)
    # Order: tables of a document, then its packets.
    row = np.arange(n_es) + 2 * (doc[unit] + 1)
    before = np.searchsorted(doc[unit], np.arange(len(size)))
    table_row = before + 2 * np.arange(len(size))
    pid = np.where(video[unit], VIDEO_PID, AUDIO_PID)
    group = doc[unit] * 2 + video[unit]
    o = np.argsort(group, kind="stable")
    g = group[o]
    cc = np.empty(n_es, np.int64)
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if n_es else np.empty(0, np.int64)
    cc[o] = np.arange(n_es) - np.repeat(begin, np.diff(np.r_[begin, n_es]))
    P[row, 0] = 0x47
    P[row, 1] = (first.astype(np.int64) << 6) | pid >> 8
    P[row, 2] = pid & 255
    P[row, 3] = np.where(adapt > 0, 0x30, 0x10) | cc % 16
    a = np.flatnonzero(adapt > 0)
    P[row[a], 4] = adapt[a] - 1
    b = a[adapt[a] > 1]
    P[row[b], 5] = 0
    c = np.flatnonzero(first & key[unit])
    P[row[c], 5] = 0x50
    base = pts[unit[c]]
    P[row[c][:, None], 6 + np.arange(6)] = np.stack([base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, base * 0], 1).astype(np.uint8)
    mask = np.zeros(P.shape, bool)
    mask[row] = np.arange(SIZE) >= (4 + adapt)[:, None]
    P[mask] = es
    for i, (pid_, sec) in enumerate(((0, PAT), (PMT_PID, PMT))):
        t = table_row + i
        P[t, :5] = [0x47, 0x40 | pid_ >> 8, pid_ & 255, 0x10, 0]
        P[t[:, None], 5 + np.arange(len(sec))] = np.frombuffer(sec, np.uint8)
    some = size > 0
    keep = np.ones(len(P), bool)
    keep[table_row[~some]] = keep[table_row[~some] + 1] = False
    packets = np.where(some, np.bincount(doc[unit], minlength=len(size)) + 2, 0)
    return P[keep].reshape(-1), np.r_[0, np.cumsum(packets) * SIZE]


def packets(raw: np.ndarray) -> np.ndarray:
    """Offsets of the packets of one stream: sync bytes followed by another a packet later, or by the end."""
    n = len(raw)
    if n % SIZE == 0 and (raw[::SIZE] == 0x47).all():
        return np.arange(0, n, SIZE)
    sync = raw == 0x47
    out, at = [], 0
    candidates = np.flatnonzero(sync)
    while True:
        i = int(np.searchsorted(candidates, at))
        if i == len(candidates) or candidates[i] + SIZE > n:
            return np.array(out, np.int64)
        at = int(candidates[i])
        if at + SIZE < n and not sync[at + SIZE] and not (out and out[-1] == at - SIZE):
            at += 1
            continue
        out.append(at)
        at += SIZE


def _sections(parts: list[tuple[int, bytes]]) -> list[bytes]:
    """Valid sections of a table's packets, given as (unit start, payload)."""
    out, data = [], b""
    for begins, x in parts:
        if begins and x:
            data, x = b"", x[1 + x[0] :] if x[0] < len(x) else b""
        elif not data:
            continue
        data += x
        while len(data) >= 3 and data[0] != 0xFF:
            n = 3 + ((data[1] & 15) << 8 | data[2])
            if len(data) < n:
                break
            if n > 12 - 4 and crc32(data[:n]) == 0:
                out.append(data[:n])
            data = data[n:]
    return out


def programs(parts: dict[int, list[tuple[int, bytes]]], pat: list[tuple[int, bytes]]) -> dict[int, int]:
    """Elementary pid -> stream type, from the tables."""
    maps = set()
    for s in _sections(pat):
        if s[0] == 0:
            for i in range(8, len(s) - 4, 4):
                if s[i] << 8 | s[i + 1]:
                    maps.add((s[i + 2] & 31) << 8 | s[i + 3])
    out = {}
    for pid in sorted(maps):
        for s in _sections(parts.get(pid, [])):
            if s[0] != 2:
                continue
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                out[(s[i + 1] & 31) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    return out


def demux(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Units of all streams: stream, pid, stream_type, unit_no, pts, dts (-1: none), random_access, n_packets, lost_packets, complete, and payload with offsets."""
    at, owner = [], []
    whole = (np.diff(off) % SIZE == 0).all() and len(buf) and (buf[::SIZE] == 0x47).all()
    if whole:
        start = np.arange(0, len(buf), SIZE)
        own = np.repeat(np.arange(len(off) - 1), np.diff(off) // SIZE)
        P = buf.reshape(-1, SIZE)
    else:
        for i in range(len(off) - 1):
            x = packets(buf[off[i] : off[i + 1]])
            at.append(x + off[i])
            owner.append(np.full(len(x), i))
        start = np.concatenate(at) if at else np.empty(0, np.int64)
        own = np.concatenate(owner) if owner else np.empty(0, np.int64)
        P = buf[start[:, None] + np.arange(SIZE)] if len(start) else np.empty((0, SIZE), np.uint8)
    b1, b3 = P[:, 1].astype(np.int64), P[:, 3].astype(np.int64)
    pid = (b1 & 31) << 8 | P[:, 2]
    begins = (b1 & 0x40) != 0
    field, has = (b3 & 0x20) != 0, (b3 & 0x10) != 0
    alen = np.where(field, P[:, 4].astype(np.int64) + 1, 0)
    has &= alen <= 183
    flags = np.where(alen > 1, P[:, 5], 0)
    good = ((b1 & 0x80) == 0) & (pid != 0x1FFF) & has
    body = 4 + alen
    # Tables, stream by stream: few packets.
    known: dict[tuple, dict[int, int]] = {}
    by: dict[int, dict[int, list]] = {}
    table_pids: dict[bytes, set[int]] = {}
    es_type = np.full(len(P), -1, np.int64)
    pat_rows = np.flatnonzero(good & (pid == 0))
    want: dict[int, set[int]] = {}
    for r in pat_rows.tolist():
        by.setdefault(int(own[r]), {}).setdefault(0, []).append((bool(begins[r]), P[r, body[r] :].tobytes()))
    for s, x in by.items():
        k = tuple(x[0])
        if k not in table_pids:
            table_pids[k] = {(c[i + 2] & 31) << 8 | c[i + 3] for c in _sections(x[0]) if c[0] == 0 for i in range(8, len(c) - 4, 4) if c[i] << 8 | c[i + 1]}
        want[s] = table_pids[k]
    pairs = {(s, p) for s, w in want.items() for p in w}
    if pairs:
        code = np.array(sorted(s * 8192 + p for s, p in pairs))
        rows = np.flatnonzero(good & np.isin(own * 8192 + pid, code))
        for r in rows.tolist():
            by[int(own[r])].setdefault(int(pid[r]), []).append((bool(begins[r]), P[r, body[r] :].tobytes()))
    codes, kinds = [], []
    for s, x in by.items():
        k = tuple((p, tuple(v)) for p, v in sorted(x.items()))
        if k not in known:
            known[k] = programs(x, x.get(0, []))
        for p, t in known[k].items():
            codes.append(s * 8192 + p)
            kinds.append(t)
    o = np.argsort(codes) if codes else np.empty(0, np.int64)
    codes, kinds = np.array(codes, np.int64)[o], np.array(kinds, np.int64)[o]
    if len(codes):
        c = own * 8192 + pid
        i = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        es_type = np.where(codes[i] == c, kinds[i], -1)
    # Elementary packets in order of stream and pid.
    e = np.flatnonzero(good & (es_type >= 0))
    e = e[np.argsort(own[e] * 8192 + pid[e], kind="stable")]
    g = own[e] * 8192 + pid[e]
    same = np.r_[False, g[1:] == g[:-1]] if len(e) else np.empty(0, bool)
    cc = b3[e] & 15
    step = np.r_[0, cc[1:] - cc[:-1]] % 16 if len(e) else cc
    twin = np.flatnonzero(same & (step == 0))
    twin = twin[(P[e[twin]] == P[e[twin - 1]]).all(1)]
    dup = np.zeros(len(e), bool)
    dup[twin] = True
    dup[1:] &= ~(dup[:-1] & dup[1:])  # a packet may be sent twice, not more
    lost = np.where(same & ~dup & ((flags[e] & 0x80) == 0), (step - 1) % 16, 0)
    e, g, lost = e[~dup], g[~dup], lost[~dup]
    begin = begins[e]
    unit = np.cumsum(begin) - 1
    new = np.r_[True, g[1:] != g[:-1]] if len(e) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    started = np.zeros(len(e), bool)
    if len(e):
        head = np.flatnonzero(new)
        started = (np.cumsum(begin) - (np.cumsum(begin) - begin)[head][group]) > 0
    e, unit, lost, begin = e[started], unit[started], lost[started], begin[started]
    n_units = int(begin.sum())
    if not n_units:
        z = np.empty(0, np.int64)
        return {k: z for k in ("stream", "pid", "stream_type", "unit_no", "pts", "dts", "random_access", "n_packets", "lost_packets", "complete")} | {"payload": np.empty(0, np.uint8), "offsets": np.zeros(1, np.int64)}
    unit = np.cumsum(begin) - 1
    heads = np.flatnonzero(begin)
    f = e[heads]
    mask = np.arange(SIZE) >= body[e][:, None]
    data = P[e][mask]
    size = np.bincount(unit, SIZE - body[e], minlength=n_units).astype(np.int64)
    pos = np.r_[0, np.cumsum(size)]
    padded = np.r_[data, np.zeros(24, np.uint8)]
    h = padded[pos[:-1][:, None] + np.arange(19)].astype(np.int64)
    ok = (size >= 9) & (h[:, 0] == 0) & (h[:, 1] == 0) & (h[:, 2] == 1)
    announced = h[:, 4] << 8 | h[:, 5]
    pts = np.where(ok & (h[:, 7] >= 0x80) & (size >= 14), _unstamp(h[:, 9:14]), -1)
    dts = np.where(ok & (h[:, 7] >= 0xC0) & (size >= 19), _unstamp(h[:, 14:19]), -1)
    skip = np.where(ok, np.minimum(9 + h[:, 8], size), 0)
    end = np.where(ok & (announced > 0), np.minimum(6 + announced, size), size)
    end = np.maximum(end, skip)
    # What a gap before a unit's first packet took belongs to the unit before it, when there is one.
    lost_unit = np.bincount(np.maximum(unit - begin, 0), lost, minlength=n_units).astype(np.int64)
    complete = ok & (lost_unit == 0) & ((announced == 0) | (size >= 6 + announced))
    gg = own[f] * 8192 + pid[f]
    nb = np.flatnonzero(np.r_[True, gg[1:] != gg[:-1]])
    no = np.arange(n_units) - np.repeat(nb, np.diff(np.r_[nb, n_units]))
    n = end - skip
    return {
        "stream": own[f], "pid": pid[f], "stream_type": es_type[f], "unit_no": no, "pts": pts, "dts": dts, "random_access": (flags[f] & 0x40) != 0,
        "n_packets": np.bincount(unit, minlength=n_units), "lost_packets": lost_unit, "complete": complete,
        "payload": data[ranges(pos[:-1] + skip, n)], "offsets": np.r_[0, np.cumsum(n)],
    }


_OUT = pa.schema([("doc_id", pa.int64()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("unit_no", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("n_packets", pa.int32()), ("lost_packets", pa.int32()), ("complete", pa.bool_()), ("payload", pa.binary())])
_DDL = "doc_id bigint, pid int, stream_type int, unit_no int, pts bigint, dts bigint, random_access boolean, n_packets int, lost_packets int, complete boolean, payload binary"


def units(streams: DataFrame, id_col: str = "doc_id", ts_col: str = "ts") -> DataFrame:
    """A row per elementary packet of the streams in a binary column."""

    def run(batches):
        for rb in chunks(batches, "ts"):
            u = demux(*utf8(rb.column(1)))
            if not len(u["pid"]):
                continue
            pts, dts = (pa.array(u[c], pa.int64(), mask=u[c] < 0) for c in ("pts", "dts"))
            i32 = lambda c: u[c].astype(np.int32)
            yield record(_OUT, rb.column(0).take(pa.array(u["stream"])), i32("pid"), i32("stream_type"), i32("unit_no"), pts, dts, u["random_access"], i32("n_packets"), i32("lost_packets"), u["complete"], strings(u["payload"], u["offsets"], pa.binary()))

    return streams.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(ts_col).cast("binary").alias("ts")).mapInArrow(run, _DDL)


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ts: a transport stream that carries each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ts", pa.binary())])

    def run(batches):
        for rb in chunks(batches):
            ts, off = mux(*utf8(rb.column(1)))
            yield record(schema, rb.column(0), strings(ts, off, pa.binary()))

    return docs.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ts binary")
