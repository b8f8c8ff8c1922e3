import random

import numpy as np
import pyarrow as pa
import pytest

from quirespark.llm import transport
from quirespark.llm.common import utf8


def streams_of(texts):
    ts, off = transport.mux(*utf8(pa.array(texts)))
    return [ts[a:b].tobytes() for a, b in zip(off, off[1:])]


def plain(raw: bytes):
    """A packet-by-packet demultiplexer: (pid, pts, dts, random access, lost, payload) per unit."""
    types, pmts, last, open_, out, prev, twice = {}, set(), {}, {}, [], {}, set()
    start = raw.find(b"\x47")
    for at in range(max(start, 0), len(raw) - 187, 188):
        p = raw[at : at + 188]
        pid, begins, cc = (p[1] & 31) << 8 | p[2], p[1] & 64, p[3] & 15
        if p[1] & 128 or pid == 0x1FFF or not p[3] & 16:
            continue
        body, ra = 4, False
        if p[3] & 32:
            body = 5 + p[4]
            ra = p[4] > 0 and bool(p[5] & 64)
        data = p[body:]
        if pid == 0 and begins:
            s = data[1 + data[0] :]
            for i in range(8, 3 + ((s[1] & 15) << 8 | s[2]) - 4, 4):
                pmts.add((s[i + 2] & 31) << 8 | s[i + 3])
        elif pid in pmts and begins:
            s = data[1 + data[0] :]
            i, end = 12 + ((s[10] & 15) << 8 | s[11]), 3 + ((s[1] & 15) << 8 | s[2]) - 4
            while i < end:
                types[(s[i + 1] & 31) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
        elif pid in types:
            if pid in last and cc == last[pid] and prev[pid] == p and pid not in twice:
                twice.add(pid)
                continue
            twice.discard(pid)
            lost = (cc - last[pid] - 1) % 16 if pid in last else 0
            last[pid], prev[pid] = cc, p
            if pid in open_ and lost:
                open_[pid][4] += lost
            if begins:
                if pid in open_:
                    out.append(open_[pid])
                open_[pid] = [pid, None, None, ra, 0, b""]
            if pid in open_:
                open_[pid][5] += data
    out += open_.values()
    units = []
    for pid, _, _, ra, lost, es in out:
        stamp = lambda b: (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
        n = es[4] << 8 | es[5]
        whole = es[: 6 + n] if n else es
        units.append((pid, stamp(es[9:14]), stamp(es[14:19]) if es[7] & 64 else None, ra, lost, whole[9 + es[8] :], lost == 0 and len(es) >= 6 + n))
    return sorted(units, key=lambda u: (u[0], u[1]))


def demuxed(raws):
    u = transport.demux(*utf8(pa.array(raws, pa.binary())))
    out = [[] for _ in raws]
    for i in range(len(u["pid"])):
        none = lambda v: None if v < 0 else int(v)
        out[u["stream"][i]].append((int(u["pid"][i]), none(u["pts"][i]), none(u["dts"][i]), bool(u["random_access"][i]), int(u["lost_packets"][i]), u["payload"][u["offsets"][i] : u["offsets"][i + 1]].tobytes(), bool(u["complete"][i])))
    return [sorted(x, key=lambda u: (u[0], u[1] if u[1] is not None else -1)) for x in out]


TEXTS = ["", "a", "b" * 2700, "c" * 2701, "Grün " * 4000, "\x47" * 9000]


def test_round_trip_and_a_plain_reader():
    raws = streams_of(TEXTS)
    for t, raw, units in zip(TEXTS, raws, demuxed(raws)):
        assert len(raw) % 188 == 0 and units == plain(raw)
        video, audio = ([u[5] for u in units if u[0] == pid] for pid in (256, 257))
        joined = b"".join(x for pair in zip(video, audio + [b""] * (len(video) - len(audio))) for x in pair)
        assert joined == t.encode() and all(u[6] for u in units)
        assert [u[3] for u in units if u[0] == 256] == [i % 8 == 0 for i in range(len(video))]


@pytest.mark.parametrize("seed", range(8))
def test_damaged_streams_equal_a_plain_reader(seed):
    g = random.Random(seed)
    raw = streams_of(["The text of a stream. " * 3000])[0]
    p = [raw[i : i + 188] for i in range(0, len(raw), 188)]
    for _ in range(6):
        i = g.randrange(3, len(p) - 1)
        kind = g.randrange(3)
        if kind == 0:
            del p[i]
        elif kind == 1:
            p.insert(i, p[i])
        else:
            p.insert(i, b"\x47\x1f\xff\x10" + b"\xff" * 184)
    broken = b"".join(p)
    want = [u for u in plain(broken)]
    got = demuxed([broken])[0]
    assert [u[:3] + u[4:] for u in got if u[6]] == [u[:3] + u[4:] for u in want if u[6]]
    assert len(got) == len(want)


def test_sync_is_found_again():
    raw = streams_of(["x" * 9000])[0]
    clean = demuxed([raw])[0]
    assert demuxed([b"junk\x47junk" + raw])[0] == clean
    got = demuxed([raw[: 188 * 10] + b"\x00" * 77 + raw[188 * 10 :]])[0]
    assert got == clean


def test_no_tables_or_bad_crc_gives_nothing():
    raw = bytearray(streams_of(["x" * 500])[0])
    assert demuxed([bytes(raw[376:])]) == [[]]
    raw[8] ^= 1
    assert demuxed([bytes(raw), b"", b"\x47" * 100]) == [[], [], []]


def test_crc_of_the_standard_check_string():
    assert transport.crc32(b"123456789") == 0x0376E6E7


def test_odd_rows(spark, odd, odd_rows, nothing):
    s = transport.streams(odd)
    assert s.count() == len(odd_rows)
    rows = transport.units(s).collect()
    size = sum(len((t[1] or "").encode()) for t in odd_rows)
    assert sum(len(r.payload) for r in rows) == size and all(r.complete for r in rows)
    assert transport.units(transport.streams(nothing)).count() == 0
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"junk"), (None, bytes(np.zeros(400, np.uint8)))], "doc_id bigint, ts binary")
    assert transport.units(bad).count() == 0
