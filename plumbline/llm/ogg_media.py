"""Ogg media columns: checked pages, packets from lacing values, demultiplexed streams, times from granule positions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

UNIT = 192
PACKET = 10 * UNIT
RATE = 8000
SAMPLES, NOTES = 1, 2
_HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: Texts that are turned into media at a time, so that a batch of very long texts stays small.
ROWS = 256


def page_checksum(page: bytes) -> int:
    """Ogg's CRC (0x04C11DB7, not reflected, from zero) of a page whose checksum field is zero.

    It is zlib's CRC with all bits mirrored: of each byte going in, of the sum coming out.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, seq: int, flags: int, granule: int, lacing: list[int], body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, seq, 0, len(lacing)) + bytes(lacing)
    return head[:22] + page_checksum(head + body).to_bytes(4, "little") + head[26:] + body


def _pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of one logical stream; the first packet, its header, has a page to itself."""
    out, lacing, body, granule, flags = [], [], [], -1, FIRST
    for k, p in enumerate(packets):
        values = [255] * (len(p) // 255) + [len(p) % 255]
        at = 0
        for j, v in enumerate(values):
            if len(lacing) == 255:
                out.append((flags, granule, lacing, b"".join(body)))
                lacing, body, granule, flags = [], [], -1, CONTINUED if j else 0
            lacing.append(v)
            body.append(p[at : at + v])
            at += v
        granule = granules[k]
        if k == 0 or k == len(packets) - 1:
            out.append((flags, granule, lacing, b"".join(body)))
            lacing, body, granule, flags = [], [], -1, 0
    flags, granule, lacing, body = out[-1]
    out[-1] = (flags | LAST, granule, lacing, body)
    return [_page(serial, seq, *x) for seq, x in enumerate(out)]


def mux(payload: bytes, n_bytes: int) -> bytes:
    """A physical stream of two logical ones: 8-bit samples of the payload, and a note with the unpadded length."""
    chunks = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = np.minimum(np.arange(1, len(chunks) + 1) * PACKET, len(payload)).tolist()
    a = _pages(SAMPLES, [b"\x01pcm8" + struct.pack("<I", RATE), *chunks], [0, *ends])
    b = _pages(NOTES, [b"\x02note", struct.pack("<Q", n_bytes)], [0, len(payload)])
    return b"".join([a[0], b[0], *a[1:2], b[1], *a[2:]])


def demux(media: bytes | None) -> tuple[list[tuple[int, int, int, bytes]], int, int]:
    """``packets, pages, bad``: (serial, number, end granule, bytes) of each whole packet.

    A page whose checksum, capture pattern or length is wrong counts as bad: reading goes on at the next capture
    pattern, and a packet that lost a part is left out. The end granule of a packet that isn't the last to end on its
    page follows back from the page's granule position, a sample a byte.
    """
    media = media or b""
    at, pages, bad = 0, 0, 0
    packets: list[tuple[int, int, int, bytes]] = []
    open_: dict[int, list[bytes] | None] = {}
    expected: dict[int, int] = {}
    numbers: dict[int, int] = {}
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) < at + 27:
            bad += 1
            at = media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, _, flags, granule, serial, seq, crc, n = _HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if end > len(media) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        pages += 1
        lost = seq != expected.get(serial, 0)
        expected[serial] = seq + 1
        part = open_.get(serial, []) if not lost else None
        if not flags & CONTINUED:
            part = []
        elif lost:
            part = None
        pos, done = 27 + n, []
        for v in lacing:
            if part is not None:
                part.append(page[pos : pos + v])
            pos += v
            if v < 255:
                if part is not None:
                    done.append(b"".join(part))
                part = []
        open_[serial] = part
        ends = granule - np.concatenate([np.cumsum([len(p) for p in done[:0:-1]])[::-1], [0]]) if done else []
        for p, g in zip(done, ends):
            k = numbers.get(serial, 0)
            numbers[serial] = k + 1
            packets.append((serial, k, int(g) if k else 0, p))
        at = end
    return packets, pages, bad


def to_payload(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8, padded with spaces to a positive multiple of 192, and its own length."""
    raw = text.encode("utf-8") if text else b""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each text stored in an Ogg stream. Null texts count as empty (one unit of spaces)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.iloc[at : at + ROWS]
                payloads = [to_payload(t) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n_bytes": [n for _, n in payloads], "media": [mux(p, n) for p, n in payloads]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, n_bytes long, media binary")


def packets(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each stream: ``id, serial, packet, end_granule, end_seconds, data, bad_pages``.

    A null or empty stream has no row; damaged pages are skipped and counted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, m in zip(b["id"], b["media"]):
                found, _, bad = demux(m)
                rows = [(i, s, k, g, g / RATE, p, bad) for s, k, g, p in found]
                yield pd.DataFrame(rows, columns=["id", "serial", "packet", "end_granule", "end_seconds", "data", "bad_pages"])

    schema = "id long, serial long, packet long, end_granule long, end_seconds double, data binary, bad_pages long"
    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInPandas(run, schema)


def _feature(found: list[tuple[int, int, int, bytes]], pages: int, bad: int, samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    last = max((g for s, _, g, _ in found if s == SAMPLES), default=0)
    crossings = int(np.count_nonzero(np.diff(x >= 128))) if len(x) else 0
    return (
        f"streams={len({s for s, *_ in found})};pages={pages};bad={bad};packets={len(found)};ms={last * 1000 // RATE};"
        f"mean_milli={int(x.sum()) * 1000 // max(len(x), 1)};peak={int(x.max()) if len(x) else 0};square_mean={int((x * x).sum()) // max(len(x), 1)};crossings={crossings}"
    )


def read_media(media: DataFrame) -> DataFrame:
    """``id, n_bytes, media, payload, feature`` from ``id, media``: the samples and length read back, and features.

    ``n_bytes`` is null where the note is lost; a damaged page takes its packets with it, and shows in ``feature``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                rows = []
                for i, m in zip(b["id"].iloc[at : at + ROWS], b["media"].iloc[at : at + ROWS]):
                    found, pages, bad = demux(m)
                    samples = b"".join(p for s, k, _, p in found if s == SAMPLES and k)
                    note = [struct.unpack("<Q", p)[0] for s, k, _, p in found if s == NOTES and k and len(p) == 8]
                    rows.append((i, note[0] if note else None, m, samples, _feature(found, pages, bad, samples)))
                yield pd.DataFrame(rows, columns=["id", "n_bytes", "media", "payload", "feature"])

    return media.select("id", "media").mapInPandas(run, "id long, n_bytes long, media binary, payload binary, feature string")


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents as Ogg media, read back. Null texts count as empty; each row comes out, whatever its id; other columns are left aside."""
    back = read_media(to_media(table(spark, sf_dir, "documents")))
    return back.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
