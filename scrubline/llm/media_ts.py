"""Media columns: MPEG transport streams, written and parsed in numpy.

``mux`` stores a payload in packetized elementary streams (one PES per 32,256 payload bytes, each
with a presentation time stamp, a clock reference and a random-access mark) cut into 188-byte
transport packets; the program tables are repeated every ``TABLES_EVERY`` PES.

``demux`` reads transport streams, its own or others': it assembles table sections over any number
of packets, takes every valid version of them (a map counts while the association table names its
PID), checks the continuity counters (a packet without payload is legal, and so is a duplicate, which
counts once), reassembles the elementary packets of every stream of every program by itself, marks
those that lost packets or are scrambled, and gives time stamps, clock references and random-access
points.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

#: Fixed values of the transport stream format.
PACKET, SYNC, STUFF = 188, 0x47, 0xFF
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x0100, 0x0101, 1
PRIVATE_STREAM, STREAM_TYPE = 0xBD, 0x06
NULL_PID, PADDING_STREAM = 0x1FFF, 0xBE
#: Stream ids whose packets have no flags and time stamps: map, padding, private 2, ECM, EMM, DSM-CC, type E, directory.
HEADLESS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)
CLOCK = 90_000
#: The payload unit: payloads are padded to a positive multiple of it.
UNIT = 576
UNITS_PER_PES = 56
#: Ticks from one PES to the next.
TICKS = CLOCK // 25
#: PES between two copies of the program tables.
TABLES_EVERY = 25
_BODY = PACKET - 4
_FIELD = 8  # the adaptation field of a PES's first packet: length, flags, clock reference
_HEADER = 14  # of a PES: start code, stream, length, flags, one time stamp


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter % 16, 0]) + section
    return packet + bytes([STUFF]) * (PACKET - len(packet))


_PAT = _section(0x00, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
_PMT = _section(0x02, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0]))


def _clock(base: int) -> bytes:
    """A program clock reference: 33 bits of base, 6 reserved, 9 of extension."""
    return (base << 15 | 0x7E00).to_bytes(6, "big")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 0xFF, 1 | (pts >> 15 & 0x7F) << 1, pts >> 7 & 0xFF, 1 | (pts & 0x7F) << 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload (a positive multiple of UNIT bytes)."""
    out, step = [], UNIT * UNITS_PER_PES
    counter = 0
    for k, at in enumerate(range(0, len(payload), step)):
        if k % TABLES_EVERY == 0:
            copy = k // TABLES_EVERY
            out += [_table_packet(PAT_PID, _PAT, copy), _table_packet(PMT_PID, _PMT, copy)]
        data = payload[at : at + step]
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(data) + _HEADER - 6).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * TICKS) + data
        # the first packet has the clock and the random-access mark, the last is stuffed; there are four at least
        body = np.frombuffer(pes, np.uint8)
        first = _BODY - _FIELD
        n = 1 + -(-(len(body) - first) // _BODY)
        grid = np.empty((n, PACKET), np.uint8)
        grid[:, 0], grid[:, 1], grid[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        grid[0, 1] |= 0x40
        grid[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        grid[0, 3] |= 0x20
        grid[0, 4:6] = _FIELD - 1, 0x50
        grid[0, 6 : 4 + _FIELD] = np.frombuffer(_clock(k * TICKS), np.uint8)
        grid[0, 4 + _FIELD :] = body[:first]
        rest = body[first:]
        full = (n - 2) * _BODY
        grid[1 : n - 1, 4:] = rest[:full].reshape(n - 2, _BODY)
        tail = rest[full:]
        pad = _BODY - len(tail)
        if pad:
            grid[n - 1, 3] |= 0x20
            grid[n - 1, 4] = pad - 1
            if pad > 1:
                grid[n - 1, 5] = 0
                grid[n - 1, 6 : 4 + pad] = STUFF
        grid[n - 1, 4 + pad :] = tail
        counter += n
        out.append(grid.tobytes())
    return b"".join(out)


@dataclass
class Unit:
    """One elementary packet."""

    pid: int
    pts: int | None
    dts: int | None
    complete: bool  # no packet of it was lost or scrambled, and it is as long as it says
    data: bytes
    scrambled: bool = False  # some of its packets are


@dataclass
class Stream:
    """What a transport stream holds."""

    units: list[Unit]  # by stream, each in order
    clock: list[tuple[int, int]]  # packet number, clock reference in 27 MHz ticks
    random_access: list[int]  # packet numbers
    packets: int
    continuity_errors: int
    bad_sections: int
    programs: dict[int, int]  # program number -> PID of its last map
    streams: dict[int, int]  # PID -> stream type, of all maps

    @property
    def payloads(self) -> dict[int, bytes]:
        """The bytes of every stream, incomplete packets included as far as they go."""
        return {pid: b"".join(u.data for u in self.units if u.pid == pid) for pid in self.streams}

    @property
    def payload(self) -> bytes:
        """The bytes of the first stream."""
        return self.payloads[min(self.streams)] if self.streams else b""

    @property
    def pts(self) -> list[int]:
        return [u.pts for u in self.units if u.pts is not None]


def _payload_start(packet: np.ndarray) -> int:
    """Where a packet's payload starts; beyond its end if there is none or the field is too long."""
    if not packet[3] & 0x10:
        return PACKET
    return 4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0)


def _follow(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the packets of one PID: which carry new payload, and before which of those packets were lost."""
    carries = np.flatnonzero((mine[:, 3] & 0x10) != 0)
    counter = (mine[carries, 3] & 0x0F).astype(np.int16)
    step = np.diff(counter, prepend=counter[:1] - 1) % 16
    field = mine[carries]
    # a packet may be sent twice; all but its clock reference is equal then
    same = np.zeros(len(carries), bool)
    for k in np.flatnonzero(step == 0):
        a, b = mine[carries[k - 1]], mine[carries[k]]
        same[k] = bool((a[_payload_start(a) :] == b[_payload_start(b) :]).all()) if _payload_start(a) == _payload_start(b) else False
    announced = ((field[:, 3] & 0x20) != 0) & (field[:, 4] > 0) & ((field[:, 5] & 0x80) != 0)
    lost = (step != 1) & ~same & ~announced
    return carries[~same], lost[~same]


def _sections(mine: np.ndarray) -> tuple[list[tuple[int, bytes]], int]:
    """(packet of the PID that ends it, section) of those with a right checksum, and how many had a wrong one."""
    found, bad, held = [], 0, b""
    started, at = False, 0

    def take() -> None:
        nonlocal held, bad
        while len(held) >= 3 and held[0] != STUFF:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < size:
                return
            if size >= 12 and not section_crc(held[:size]):
                found.append((at, held[:size]))
            else:
                bad += 1
            held = held[size:]

    rows, lost = _follow(mine)
    for k, gap in zip(rows.tolist(), lost.tolist()):
        packet, at = mine[k], k
        body = packet[_payload_start(packet) :].tobytes()
        if gap:
            held, started = b"", False
        if packet[1] & 0x40 and body:
            if started:
                held += body[1 : 1 + body[0]]
                take()
            held, started = body[1 + body[0] :], True
        elif started:
            held += body
        take()
    return found, bad


def _time(b: np.ndarray) -> int:
    t = b.astype(np.int64)
    return int((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)


def demux(data: bytes) -> Stream:
    """Parses a transport stream; raises ValueError where it is no transport stream or has no valid program table."""
    if not data or len(data) % PACKET:
        raise ValueError("no whole packets")
    grid = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any():
        raise ValueError("sync byte missing")
    total = len(grid)
    numbers = np.flatnonzero((grid[:, 1] & 0x80) == 0)  # packets that are marked as damaged are lost
    grid = grid[numbers]
    pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    assigned: dict[int, list[tuple[int, int]]] = {}  # program -> (packet from which on, PID of its map)
    streams: dict[int, int] = {}
    rows = np.flatnonzero(pid == PAT_PID)
    tables, bad = _sections(grid[rows])
    for k, s in tables:
        if s[0] == 0x00 and s[5] & 1:
            for i in range(8, len(s) - 4, 4):
                if number := s[i] << 8 | s[i + 1]:
                    assigned.setdefault(number, []).append((int(rows[k]), (s[i + 2] & 0x1F) << 8 | s[i + 3]))
    if not assigned:
        raise ValueError("no program association table with a right checksum")

    def maps(number: int, packet: int) -> int | None:
        """The PID of a program's map at a packet; before the first table it is that of the first."""
        have = assigned.get(number, [])
        return next((p for since, p in reversed(have) if since <= packet), have[0][1] if have else None)

    for map_pid in sorted({p for have in assigned.values() for _, p in have}):
        rows = np.flatnonzero(pid == map_pid)
        tables, wrong = _sections(grid[rows])
        bad += wrong
        for k, s in tables:
            if s[0] == 0x02 and s[5] & 1 and maps(s[3] << 8 | s[4], int(rows[k])) == map_pid:
                i = 12 + ((s[10] & 0x0F) << 8 | s[11])
                while i + 5 <= len(s) - 4:
                    streams[(s[i + 1] & 0x1F) << 8 | s[i + 2]] = s[i]
                    i += 5 + ((s[i + 3] & 0x0F) << 8 | s[i + 4])
    programs = {number: have[-1][1] for number, have in assigned.items()}
    fields = np.flatnonzero(((grid[:, 3] & 0x20) != 0) & (grid[:, 4] > 0) & ((grid[:, 5] & 0x50) != 0))
    again = np.zeros(len(grid), bool)  # packets with a clock reference or a random-access mark that were sent before
    for own in np.unique(pid[fields]).tolist():
        rows = np.flatnonzero(pid == own)
        carries = rows[(grid[rows, 3] & 0x10) != 0]
        counter = grid[carries, 3] & 0x0F
        if own != NULL_PID and (counter[1:] == counter[:-1]).any():
            again[np.setdiff1d(carries, rows[_follow(grid[rows])[0]], assume_unique=True)] = True
    units: list[Unit] = []
    clock: list[tuple[int, int]] = []
    access: list[int] = []
    errors = 0
    for k in fields[((grid[fields, 5] & 0x10) != 0) & ~again[fields]].tolist():
        raw = int.from_bytes(grid[k, 6:12].tobytes(), "big")
        clock.append((int(numbers[k]), (raw >> 15) * 300 + (raw & 0x1FF)))
    for stream_pid in sorted(streams):
        rows = np.flatnonzero(pid == stream_pid)
        if not len(rows):
            continue
        mine = grid[rows]
        flags = np.where(((mine[:, 3] & 0x20) != 0) & (mine[:, 4] > 0), mine[:, 5], 0)
        access.extend(numbers[rows[((flags & 0x40) != 0) & ~again[rows]]].tolist())
        used, lost = _follow(mine)
        errors += int(lost.sum())
        mine = mine[used]
        begin = np.minimum(4 + np.where((mine[:, 3] & 0x20) != 0, 1 + mine[:, 4].astype(np.int64), 0), PACKET)
        body = mine[np.arange(PACKET)[None, :] >= begin[:, None]]
        ends = np.cumsum(PACKET - begin)
        heads = np.flatnonzero((mine[:, 1] & 0x40) != 0)  # what comes before the first start belongs to no whole packet
        losses = np.cumsum(lost)
        scrambled = (mine[:, 3] & 0xC0) != 0
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(mine)]):
            pes = body[ends[lo - 1] if lo else 0 : ends[hi - 1]]
            # a loss at the next start may have been the end of this packet, unless its length says otherwise
            whole = losses[hi - 1] == losses[lo]
            hidden = bool(scrambled[lo:hi].any())
            bare = len(pes) >= 6 and int(pes[3]) in HEADLESS
            if scrambled[lo] or len(pes) < (6 if bare else 9) or pes[:3].tobytes() != b"\0\0\1":
                units.append(Unit(stream_pid, None, None, False, b"", hidden))
                continue
            size = int(pes[4]) << 8 | int(pes[5])
            if size:
                whole = whole and len(pes) >= 6 + size
            elif hi < len(mine):
                whole = whole and not lost[hi]
            end = 6 + size if size else len(pes)
            if bare:  # no flags, no time stamps: data follows the length
                data = b"" if pes[3] == PADDING_STREAM else pes[6:end].tobytes()
                units.append(Unit(stream_pid, None, None, bool(whole) and not hidden, data, hidden))
                continue
            stamps = pes[7] >> 6
            pts = _time(pes[9:14]) if stamps & 2 and len(pes) >= 14 else None
            dts = _time(pes[14:19]) if stamps == 3 and len(pes) >= 19 else None
            units.append(Unit(stream_pid, pts, dts, bool(whole) and not hidden, pes[9 + int(pes[8]) : end].tobytes(), hidden))
    return Stream(units, clock, sorted(access), total, errors, bad, programs, streams)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return len(raw), raw + bytes([STUFF]) * (size - len(raw))


def describe(s: Stream) -> str:
    """Equal streams, equal strings: packets, PES, all time stamps and random-access points by checksum, byte statistics."""
    b = np.frombuffer(s.payload, np.uint8)
    sums = [zlib.crc32(np.array(x, "<i8").tobytes()) for x in (s.pts, s.random_access, [t for _, t in s.clock])]
    return f"packets={s.packets};programs={len(s.programs)};streams={len(s.streams)};pes={len(s.units)};pts={sums[0]:08x};access={sums[1]:08x};clock={sums[2]:08x};continuity_errors={s.continuity_errors};mean={b.mean():.4f}"


def store_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary, pts array<long>, random_access array<int>): media as columns."""
    return _run(docs, id_col, text_col, columns=True)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pts, random_access.

    Null text counts as empty; such a row's payload is one unit of bytes 255. A null id stays null,
    repeated rows give repeated rows and equal texts equal values, an empty table gives none; other
    columns are ignored, whatever their names; texts of any length are taken whole, one at a time.
    """
    return _run(docs, id_col, text_col, columns=False)


def _run(docs: DataFrame, id_col: str, text_col: str, columns: bool) -> DataFrame:
    import pyarrow as pa

    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, " + (
        "media binary, pts array<long>, random_access array<int>" if columns else "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<int>"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64()] + ([pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())] if columns else [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())])

    def one(text: str | None) -> list:
        n, payload = padded(text)
        media = mux(payload)
        back = demux(media)
        if columns:
            return [n, media, back.pts, back.random_access]
        p = back.payload
        return [n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(back), back.pts, back.random_access]

    def batches(it):
        for batch in it:
            # media are large: a few hundred rows leave at a time
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [one(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types[1:])]], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, schema)


def op9_media_ts(spark, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
