"""Media columns: payloads stored as MPEG transport streams and read back.

``mux`` writes program tables, elementary packets with presentation times, and random-access points;
``demux`` parses the tables, checks continuity counters, reassembles the elementary packets and gives
the payload with its time and access index. Whole streams are binary columns, one per row.

Defined cases: a null text is empty; an empty payload is padded to 192 bytes; equal texts give equal
streams; broken streams (bad sync, missing tables, lost packets) are reported, not raised.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKET, BODY, BLOCK = 188, 184, 192
PROGRAM_PID, STREAM_PID = 0x1000, 0x100
#: Payload bytes of one elementary packet, ticks of the 90 kHz clock between two, and how many share an access point.
UNIT, TICKS, GROUP = BLOCK * 160, 3003, 8


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program table sections (no reflection, all ones at the start)."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, b"\x00\x01" + (0xE000 | PROGRAM_PID).to_bytes(2, "big"))
_PMT = _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")


def _packet(pid: int, start: bool, counter: int, chunk: bytes, clock: int | None = None) -> bytes:
    room = BODY - len(chunk)
    field = b""
    if room:
        flags = b"" if room == 1 else b"\x00"
        if clock is not None:
            flags = b"\x50" + (clock << 15 | 0x7E00).to_bytes(6, "big")
        field = bytes([room - 1]) + flags + b"\xff" * (room - 1 - len(flags))
    head = bytes([0x47, start << 6 | pid >> 8, pid & 0xFF, (0x30 if room else 0x10) | counter & 15])
    return head + field + chunk


def _time(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def pad(data: bytes) -> bytes:
    """The payload: spaces up to a positive multiple of 192 bytes."""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b" ")


def mux(payload: bytes) -> bytes:
    """One program with one private stream that carries the payload."""
    out, tables, counter = [], 0, 0
    for i, at in enumerate(range(0, len(payload), UNIT)):
        data, access, pts = payload[at : at + UNIT], i % GROUP == 0, i * TICKS % (1 << 33)
        if access:
            out += [_packet(0, True, tables, b"\x00" + _PAT + b"\xff" * (BODY - 1 - len(_PAT))), _packet(PROGRAM_PID, True, tables, b"\x00" + _PMT + b"\xff" * (BODY - 1 - len(_PMT)))]
            tables += 1
        pes = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _time(pts) + data
        first = min(len(pes), BODY - 8 if access else BODY)
        out.append(_packet(STREAM_PID, True, counter, pes[:first], pts if access else None))
        counter += 1
        whole = (len(pes) - first) // BODY
        if whole:
            rows = np.empty((whole, PACKET), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 0xFF
            rows[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            rows[:, 4:] = np.frombuffer(pes, np.uint8, whole * BODY, first).reshape(whole, BODY)
            out.append(rows.tobytes())
            counter += whole
        if rest := pes[first + whole * BODY :]:
            out.append(_packet(STREAM_PID, False, counter, rest))
            counter += 1
    return b"".join(out)


def _table(packets: np.ndarray, pid: int, offset: np.ndarray, pids: np.ndarray) -> bytes | None:
    for i in np.flatnonzero(pids == pid)[:1]:
        row = packets[i].tobytes()[offset[i] :]
        row = row[1 + row[0] :]
        size = 3 + (int.from_bytes(row[1:3], "big") & 0xFFF)
        if size <= len(row) and section_crc(row[:size]) == 0:
            return row[8 : size - 4]
    return None


def demux(stream: bytes) -> dict:
    """payload, the arrays pts, access and sizes (one value per elementary packet), continuity errors, packets."""
    empty = {"payload": b"", "pts": np.zeros(0, np.int64), "access": np.zeros(0, bool), "sizes": np.zeros(0, np.int64), "errors": 0, "packets": len(stream) // PACKET}
    if not stream or len(stream) % PACKET:
        return empty | {"errors": 1}
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != 0x47).any():
        return empty | {"errors": int((rows[:, 0] != 0x47).sum())}
    pids = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    field = (rows[:, 3] & 0x20) > 0
    offset = 4 + np.where(field, rows[:, 4].astype(np.int64) + 1, 0)
    pat = _table(rows, 0, offset, pids)
    pmt = pat and _table(rows, int.from_bytes(pat[2:4], "big") & 0x1FFF, offset, pids)
    if not pmt:
        return empty | {"errors": 1}
    skip = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF)
    mine = pids == int.from_bytes(pmt[skip + 1 : skip + 3], "big") & 0x1FFF
    rows, field, offset = rows[mine], field[mine], offset[mine]
    counter = (rows[:, 3] & 15).astype(np.int64)
    errors = int(((np.diff(counter) & 15) != 1).sum())
    body = rows[np.arange(PACKET) >= offset[:, None]]
    starts = np.flatnonzero(rows[:, 1] & 0x40)
    ends = np.concatenate(([0], np.cumsum(PACKET - offset)))
    at = ends[starts]
    head = body[at[:, None] + np.arange(14)].astype(np.int64)
    errors += int((head[:, :4] != [0, 0, 1, 0xBD]).any(axis=1).sum())
    sizes = (head[:, 4] << 8 | head[:, 5]) - 3 - head[:, 8]
    errors += int((np.diff(np.append(at, len(body))) != sizes + 14).sum())
    pts = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | head[:, 11] >> 1 << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    keep = np.ones(len(body), bool)
    keep[(at[:, None] + np.arange(14)).ravel()] = False
    return {"payload": body[keep].tobytes(), "pts": pts, "access": field[starts] & ((rows[starts, 5] & 0x40) > 0), "sizes": sizes, "errors": errors, "packets": len(pids)}


def _facts(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        m = m or b""
        d = demux(m)
        p, pts, access = d["payload"], d["pts"], d["access"]
        index = hashlib.sha256(np.stack([pts, access, d["sizes"]]).astype("<i8").tobytes()).hexdigest()[:16]
        last = int(pts[-1]) if len(pts) else 0
        feature = f"units={len(pts)};access={int(access.sum())};last_pts={last};errors={d['errors']};index={index}"
        rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, len(pts), int(access.sum()), last, d["errors"], d["packets"]))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])


FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units long, n_access long, last_pts long, continuity_errors long, packets long"


def _index(m: bytes | None) -> list[dict]:
    d = demux(m or b"")
    start = np.cumsum(d["sizes"]) - d["sizes"]
    return [{"unit": i, "pts": int(p), "random_access": bool(a), "start": int(s), "size": int(n)} for i, (p, a, s, n) in enumerate(zip(d["pts"], d["access"], start, d["sizes"], strict=True))]


def to_stream(text: Column) -> Column:
    """Text column to transport stream column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: mux(pad((x or "").encode())))

    return F.pandas_udf(run, "binary")(text)


def stream_facts(media: Column) -> Column:
    """What the stored bytes hold: payload digests, times and access points."""
    return F.pandas_udf(_facts, FACTS)(media)


def stream_units(media: Column) -> Column:
    """The access index of a stream: one struct per elementary packet."""

    def run(streams: pd.Series) -> pd.Series:
        return streams.map(_index)

    return F.pandas_udf(run, "array<struct<unit:int, pts:long, random_access:boolean, start:long, size:long>>")(media)


def store_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the column media with the stored stream."""
    return df.withColumn("media", to_stream(F.col(text)))


def access_units(df: DataFrame, id_col: str, media: str = "media") -> DataFrame:
    """One row per elementary packet: time, random-access flag and place in the payload."""
    return df.select(id_col, F.inline(stream_units(F.col(media))))


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document stored as a transport stream, read back, with its features."""
    from tessera.io import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    facts: Column = stream_facts(F.col("media"))
    read = store_texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), facts.alias("x"))
    return read.select("doc_id", "n_bytes", "x.*")
