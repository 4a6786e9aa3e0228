"""Capture files (pcap) to the packets table.

Files are read in chunks of a fixed number of bytes, so one huge capture is spread over many tasks. A chunk boundary is
found by following a chain of plausible record headers that runs further than any packet is long; each task then checks
that its own records end exactly at the next boundary.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowloom import schema as S

# Layout of the capture format.
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000),
}
FILE_HEADER, RECORD_HEADER, MAX_RECORD = 24, 16, 262144
LINK_HEADER = {1: 14, 101: 0, 113: 16}
EXTENSIONS = 8

CHUNK_BYTES = 64 << 20
BATCH_PACKETS = 100_000


def _open(path: str):
    if path.startswith("file:"):
        return open("/" + path[len("file:"):].lstrip("/"), "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class _Capture:
    """Byte order, time unit and link type of one file, and its records."""

    def __init__(self, handle, length: int):
        self.handle, self.length = handle, length
        head = self._read(0, FILE_HEADER)
        if len(head) < FILE_HEADER or head[:4] not in MAGIC:
            raise ValueError("not a capture file")
        self.order, self.per_us = MAGIC[head[:4]]
        self.link = struct.unpack(self.order + "I", head[20:24])[0] & 0xFFFF
        if self.link not in LINK_HEADER:
            raise ValueError(f"link type {self.link} is not supported")
        self.unpack = struct.Struct(self.order + "IIII").unpack_from
        self.fractions = 1_000_000 * self.per_us

    def _read(self, at: int, size: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(max(0, min(size, self.length - at)))

    def _plausible(self, data: bytes, at: int) -> int | None:
        """Where the next record would start, or None."""
        _, fraction, kept, size = self.unpack(data, at)
        good = fraction < self.fractions and 0 < kept <= MAX_RECORD and kept <= size <= 1 << 20
        return at + RECORD_HEADER + kept if good else None

    def sync(self, at: int) -> int:
        """First provable record start at or after a byte position, or the end of the file.

        Provable is a start from which headers follow each other further than any packet is long, or exactly to the file's end. The
        search begins well before the position: a chain found inside a packet (a capture carried as payload) has joined the
        file's own chain by then. Where a chain breaks, the search goes on behind the break. Both neighbours of a
        boundary call this and so agree on it.
        """
        room = 2 * (MAX_RECORD + RECORD_HEADER)
        begin = max(FILE_HEADER, at - room)
        data = self._read(begin, 2 * room)
        whole = begin + len(data) >= self.length

        def follow(place: int, until: int) -> tuple[int, bool]:
            """(where the chain is at or beyond `until`, or where it breaks; whether it held)."""
            while place < until:
                if place + RECORD_HEADER > len(data):
                    return place, place == len(data) and whole
                following = self._plausible(data, place)
                if following is None:
                    return place, False
                place = following
            return place, True

        search = 0
        while search < len(data):
            last = min(search + MAX_RECORD + RECORD_HEADER + 1, len(data))
            proven = (0,) if begin == FILE_HEADER and search == 0 else (
                s for s in range(search, last) if self._chain_ends_well(follow(s, s + MAX_RECORD + 1), len(data), whole))
            first = next(iter(proven), None)
            if first is None:
                return self.length
            place, held = follow(first, at - begin)
            if held:
                return min(begin + place, self.length)
            search = place + 1
        return self.length

    @staticmethod
    def _chain_ends_well(end: tuple[int, bool], size: int, whole: bool) -> bool:
        place, held = end
        return held and (place <= size or not whole)

    def records(self, start: int, stop: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, int, int]:
        """(bytes, data positions, kept lengths, times in us, exit position, broken records) of records in [start, stop).

        A broken or truncated record is counted, and reading goes on at the next provable record start, whatever the size of the
        file or the chunk.
        """
        data = self._read(start, stop - start + MAX_RECORD + RECORD_HEADER)
        places, kept_sizes, times, at, bad = [], [], [], 0, 0
        while start + at < stop:
            following = self._plausible(data, at) if at + RECORD_HEADER <= len(data) else None
            if following is None or following > len(data):
                bad, at = bad + 1, min(self.sync(start + at + 1), stop) - start
                continue
            seconds, fraction, kept, _ = self.unpack(data, at)
            places.append(at + RECORD_HEADER)
            kept_sizes.append(kept)
            times.append(seconds * 1_000_000 + fraction // self.per_us)
            at = following
        arrays = [np.array(a, dtype=np.int64) for a in (places, kept_sizes, times)]
        return data, *arrays, start + at, bad


def _addresses(octets: np.ndarray) -> list[str]:
    if octets.shape[1] == 4:
        return [f"{a}.{b}.{c}.{d}" for a, b, c, d in octets.tolist()]
    import ipaddress

    return [str(ipaddress.IPv6Address(bytes(row.tolist()))) for row in octets]


def _macs(octets: np.ndarray) -> list[str]:
    return [":".join(f"{b:02x}" for b in row) for row in octets.tolist()]


def _packets(data: bytes, place: np.ndarray, kept: np.ndarray, time: np.ndarray, link: int, offset: int, name: str) -> pd.DataFrame:
    """Header fields of all IP packets of a run of records, gathered by position."""
    raw = np.frombuffer(data, dtype=np.uint8)
    end = place + kept

    def byte(at: np.ndarray) -> np.ndarray:
        return np.where(at < end, raw[np.minimum(at, len(raw) - 1)], 0).astype(np.int64)

    def short(at: np.ndarray) -> np.ndarray:
        return byte(at) * 256 + byte(at + 1)

    def block(at: np.ndarray, size: int) -> np.ndarray:
        return np.stack([byte(at + i) for i in range(size)], axis=1)

    ip = place + LINK_HEADER[link]
    if link == 1:
        ip = np.where(short(place + 12) == 0x8100, ip + 4, ip)
        kind = short(ip - 2)
        is_ip = (kind == 0x0800) | (kind == 0x86DD)
    else:
        is_ip = np.ones(len(place), dtype=bool)
    version = byte(ip) >> 4
    four, six = is_ip & (version == 4) & (end - ip >= 20), is_ip & (version == 6) & (end - ip >= 40)
    protocol, after, later = byte(ip + 6), ip + 40, four & ((short(ip + 6) & 0x1FFF) > 0)
    for _ in range(EXTENSIONS):  # IPv6 headers that stand before the transport header
        part, proof = six & (protocol == 44), six & (protocol == 51)
        more = part | proof | (six & np.isin(protocol, (0, 43, 60, 135)))
        later |= part & ((short(after + 2) >> 3) > 0)
        size = np.where(part, 8, np.where(proof, (byte(after + 1) + 2) * 4, (byte(after + 1) + 1) * 8))
        protocol, after = np.where(more, byte(after), protocol), np.where(more, after + size, after)
    protocol = np.where(four, byte(ip + 9), protocol)
    ip_header = np.where(four, (byte(ip) & 15) * 4, after - ip)
    ip_size = np.where(four, short(ip + 2), short(ip + 4) + 40)
    layer4 = ip + ip_header
    tcp, udp = (protocol == 6) & ~later, (protocol == 17) & ~later  # later fragments carry no transport header
    ports = (tcp | udp) & (layer4 + 4 <= end)
    header = np.where(tcp, (byte(layer4 + 12) >> 4) * 4, np.where(udp, 8, 0))
    keep = four | six
    frame = pd.DataFrame({
        "src_mac": _macs(block(place + 6, 6)) if link == 1 else None,
        "dst_mac": _macs(block(place, 6)) if link == 1 else None,
        "src_port": np.where(ports, short(layer4), 0), "dst_port": np.where(ports, short(layer4 + 2), 0),
        "protocol": protocol, "ip_version": version, "ts": pd.to_datetime(time, unit="us", utc=True),
        "seq": offset + place, "ip_size": ip_size,
        "payload_size": np.maximum(ip_size - ip_header - header, 0),
        "tcp_window": np.where(tcp, short(layer4 + 14), 0), "tcp_flags": np.where(tcp, byte(layer4 + 13), 0),
        "source_file": name,
    })
    for side, at4, at6 in (("src_ip", 12, 8), ("dst_ip", 16, 24)):
        text = np.empty(len(place), dtype=object)
        text[four] = _addresses(block(ip + at4, 4)[four])
        text[six] = _addresses(block(ip + at6, 16)[six])
        frame[side] = text
    return frame[keep][[f.name for f in S.PACKETS.fields]]


def _chunks(spark: SparkSession, path: str | list[str], chunk_bytes: int) -> DataFrame:
    """One row per file and chunk; only names and lengths are listed here."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    if not chunk_bytes:
        return files.select("path", "length", F.lit(0).cast("long").alias("start"), F.col("length").alias("stop"))
    # the last chunk is long enough for a full chain of headers
    last = F.greatest(F.col("length") - 2 * (MAX_RECORD + RECORD_HEADER), F.lit(0).cast("long"))
    cut = files.select("path", "length", last.alias("last"), F.explode(
        F.sequence(F.lit(0).cast("long"), last, F.lit(chunk_bytes).cast("long"))).alias("start"))
    following = F.col("start") + chunk_bytes
    return cut.select("path", "length", "start", F.when(following > F.col("last"), F.col("length")).otherwise(following).alias(
        "stop")).repartition("path", "start")


def _scan(chunks: DataFrame, columns: T.StructType, read) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with _open(row.path) as handle:
                    capture = _Capture(handle, row.length)
                    start, stop = capture.sync(row.start), capture.sync(row.stop) if row.stop < row.length else row.length
                    data, place, kept, time, leave, bad = capture.records(start, stop)
                    if leave != stop:
                        raise ValueError(f"{row.path}: records of {start}..{stop} end at {leave}; read this file with chunk_bytes=0")
                    yield from read(row, capture, start, data, place, kept, time, bad)

    return chunks.mapInPandas(run, columns)


def read_captures(spark: SparkSession, path: str | list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All IP packets of capture files; `seq` is the byte position, so (source_file, seq) is unique and in file order.

    Broken and truncated records are left out and reading goes on behind them. `chunk_bytes=0` reads each file in one task.
    """
    def packets(row, capture, start, data, place, kept, time, bad):
        name = row.path.rsplit("/", 1)[-1]
        for at in range(0, len(place), BATCH_PACKETS):
            part = slice(at, at + BATCH_PACKETS)
            yield _packets(data, place[part], kept[part], time[part], capture.link, start, name)

    return _scan(_chunks(spark, path, chunk_bytes), S.PACKETS, packets)


def capture_quality(spark: SparkSession, path: str | list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Records and broken or truncated records per file."""
    columns = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("records", T.LongType()),
                            T.StructField("truncated", T.LongType())])

    def counts(row, capture, start, data, place, kept, time, bad):
        yield pd.DataFrame({"source_file": [row.path.rsplit("/", 1)[-1]], "records": [len(place)], "truncated": [bad]})

    return _scan(_chunks(spark, path, chunk_bytes), columns, counts).groupBy("source_file").agg(
        F.sum("records").alias("records"), F.sum("truncated").alias("truncated"))
