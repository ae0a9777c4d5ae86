"""Transport streams that others have written: headerless packets, moved maps, duplicates, scrambling."""

import numpy as np

from scrubline.llm import media_ts as M


def packets(pid, data, counter=0, start=True, flags=0, control=0):
    """A PES (or section) as packets of one PID; the first has adaptation flags if given."""
    out = []
    while data or not out:
        field = bytes([7, flags]) + M._clock(900 * len(out)) if flags and not out else b""
        room = M.PACKET - 4 - len(field)
        part, data = data[:room], data[room:]
        pad = room - len(part)
        if pad:
            field = bytes([len(field) + pad - 1]) + (field[1:] or (b"\0" if pad > 1 else b"")) + b"\xff" * max(0, pad - (0 if field else 2))
            field = field[: M.PACKET - 4 - len(part)]
        head = bytes([M.SYNC, (0x40 if start and not out else 0) | pid >> 8, pid & 0xFF, control | (0x30 if field else 0x10) | counter % 16])
        out.append((head + field + part).ljust(M.PACKET, b"\xff"))
        counter += 1
    return out


def table(ident, number, body, pid, counter):
    return [M._table_packet(pid, M._section(ident, number, body), counter)]


def pat(map_pid, counter=0, number=1):
    return table(0, 1, bytes([0, number, 0xE0 | map_pid >> 8, map_pid & 0xFF]), M.PAT_PID, counter)


def pmt(map_pid, streams, counter=0, number=1):
    first = streams[0]
    return table(2, number, bytes([0xE0 | first >> 8, first & 0xFF, 0xF0, 0]) + b"".join(bytes([6, 0xE0 | s >> 8, s & 0xFF, 0xF0, 0]) for s in streams), map_pid, counter)


def pes(data, stream=0xBD, pts=None):
    if stream in M.HEADLESS:
        return b"\0\0\1" + bytes([stream]) + len(data).to_bytes(2, "big") + data
    head = b"\x84\x80\x05" + M._stamp(pts) if pts is not None else b"\x84\x00\x00"
    return b"\0\0\1" + bytes([stream]) + (len(head) + len(data)).to_bytes(2, "big") + head + data


DATA = bytes(range(200))


def test_packets_without_flags():
    s = M.demux(b"".join(pat(0x100) + pmt(0x100, [0x101]) + packets(0x101, pes(DATA, 0xBF)) + packets(0x101, pes(DATA, 0xBE), 2) + packets(0x101, pes(DATA, 0xBD, 77), 4)))
    assert [(u.data, u.pts, u.complete) for u in s.units] == [(DATA, None, True), (b"", None, True), (DATA, 77, True)]


def test_a_map_that_moves():
    a, b = DATA, DATA[::-1]
    data = pat(0x100) + pmt(0x100, [0x101]) + packets(0x101, pes(a)) + pat(0x200, 1) + pmt(0x200, [0x201]) + packets(0x201, pes(b))
    # what still comes under the old PID names a stream that is none any more
    data += pmt(0x100, [0x301], 1) + packets(0x301, pes(b))
    s = M.demux(b"".join(data))
    assert s.programs == {1: 0x200} and sorted(s.streams) == [0x101, 0x201] and s.payloads == {0x101: a, 0x201: b}


def test_a_map_before_its_association():
    s = M.demux(b"".join(pmt(0x100, [0x101]) + packets(0x101, pes(DATA)) + pat(0x100)))
    assert s.payloads == {0x101: DATA}


def test_a_duplicate_counts_once():
    one = packets(0x101, pes(DATA, pts=5), flags=0x50)
    head = pat(0x100) + pmt(0x100, [0x101])
    plain, twice = M.demux(b"".join(head + one)), M.demux(b"".join(head + [one[0], one[0], *one[1:]]))
    assert len(plain.clock) == len(plain.random_access) == 1
    assert (twice.clock, twice.random_access, twice.payload, twice.continuity_errors) == (plain.clock, plain.random_access, DATA, 0)


def test_scrambled_packets_are_not_complete():
    head = pat(0x100) + pmt(0x100, [0x101])
    later = packets(0x101, pes(DATA))
    later[1] = later[1][:3] + bytes([later[1][3] | 0x80]) + later[1][4:]
    s = M.demux(b"".join(head + packets(0x101, pes(DATA), control=0xC0) + packets(0x101, pes(DATA), 2) + [bytes(x[:3]) + bytes([x[3] & 0xF0 | (4 + k)]) + x[4:] for k, x in enumerate(later)]))
    assert [(u.complete, u.scrambled) for u in s.units] == [(False, True), (True, False), (False, True)]
    assert s.units[0].data == b"" and s.units[1].data == DATA


def test_null_packets_have_no_counter():
    null = np.full(M.PACKET, 0xFF, np.uint8)
    null[:4] = M.SYNC, 0x1F, 0xFF, 0x10
    s = M.demux(b"".join(pat(0x100) + pmt(0x100, [0x101]) + [null.tobytes()] * 3 + packets(0x101, pes(DATA))))
    assert s.payload == DATA and s.continuity_errors == 0
