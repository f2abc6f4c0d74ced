"""Media columns in Ogg: lossless 8-bit samples in one logical stream, their levels in another."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import whole
from quillon.staging import staged

RATE = 8000
PACKET, LEVEL_SPAN = 6000, 48000
SAMPLES, LEVELS = 1, 2
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
HEAD = "<4sBBqIIIB"


def page_crc(page: bytes) -> int:
    """The Ogg checksum (polynomial 04c11db7, most significant bit first, no inversion) by way of zlib's reflected one."""
    reflected = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(REVERSED), "big")


def pages_of(serial: int, packets: Iterable[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one logical stream from packets and their granule positions; each with the granule it ends at.

    The first packet has a page of its own. A page carries 255 lacing values at most; a packet that does not
    fit goes on in the next page. A page in which no packet ends has the granule position -1.
    """
    out: list[tuple[int, bytes]] = []
    lacing: list[int] = []
    body: list[bytes] = []
    state = {"granule": -1, "open": False, "reached": 0}

    def flush(last: bool) -> None:
        flags = (1 if state["open"] else 0) | (2 if not out else 0) | (4 if last else 0)
        data = bytes(lacing) + b"".join(body)
        head = struct.pack(HEAD, b"OggS", 0, flags, state["granule"], serial, len(out), 0, len(lacing))
        crc = page_crc(head + data)
        out.append((state["reached"], head[:22] + struct.pack("<I", crc) + head[26:] + data))
        state["open"] = bool(lacing) and lacing[-1] == 255 and state["pending"]
        lacing.clear()
        body.clear()
        state["granule"] = -1

    packets = list(packets)
    for n, (packet, granule) in enumerate(packets):
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        while values:
            room = 255 - len(lacing)
            take, values = values[:room], values[room:]
            size = sum(take)
            lacing += take
            body.append(packet[at : at + size])
            at += size
            state["pending"] = bool(values)
            if not values:
                state["granule"] = state["reached"] = granule
            if len(lacing) == 255 and not (not values and n == len(packets) - 1):
                flush(False)
        if n == 0 and lacing and len(packets) > 1:
            flush(False)
    flush(True)
    return out


def encode(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """``payload`` as unsigned 8-bit mono samples, with a second stream of the levels of each span, multiplexed by time."""
    samples: list[tuple[bytes, int]] = [(struct.pack("<8sIIQ", b"\x80pcm-u8", 1, rate, n_bytes), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    levels: list[tuple[bytes, int]] = [(struct.pack("<8sII", b"\x80levels", LEVEL_SPAN, rate), 0)]
    for i in range(0, len(payload), LEVEL_SPAN):
        span = np.frombuffer(payload[i : i + LEVEL_SPAN], np.uint8)
        levels.append((struct.pack("<BBQ", span.min(), span.max(), span.sum(dtype=np.int64)), i + len(span)))
    first, *rest = pages_of(SAMPLES, samples)
    second, *more = pages_of(LEVELS, levels)
    ordered = sorted([(g, 0, i, p) for i, (g, p) in enumerate(rest)] + [(g, 1, i, p) for i, (g, p) in enumerate(more)], key=lambda x: x[:3])
    return b"".join([first[1], second[1], *(p for *_, p in ordered)])


def demultiplex(media: bytes) -> dict[int, dict]:
    """Per logical stream: its packets, their granule positions (-1 where a page gives none) and its number of pages.

    Verifies capture patterns, checksums, page order and continuation; ValueError says what is wrong.
    """
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + 27 > len(media):
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEAD, media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(media):
            raise ValueError(f"damaged page at byte {at}")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        s = streams.get(serial)
        if s is None:
            if not flags & 2:
                raise ValueError(f"stream {serial} has no first page")
            s = streams[serial] = {"packets": [], "granules": [], "pages": 0, "part": [], "ended": False}
        if number != s["pages"] or s["ended"] or bool(flags & 1) != bool(s["part"]):
            raise ValueError(f"stream {serial} lacks a page before {number}")
        s["pages"] += 1
        pos = at + 27 + n
        size = 0
        done = []
        for value in lacing:
            size += value
            if value < 255:
                s["part"].append(media[pos : pos + size])
                done.append(b"".join(s["part"]))
                s["part"] = []
                pos += size
                size = 0
        if size or (n and lacing[-1] == 255):
            s["part"].append(media[pos : pos + size])
        s["packets"] += done
        s["granules"] += [-1] * (len(done) - 1) + [granule] * bool(done)
        s["ended"] = bool(flags & 4)
        at = end
    for serial, s in streams.items():
        if s["part"] or not s["ended"]:
            raise ValueError(f"stream {serial} has no last page")
    return streams


def decode(media: bytes) -> dict:
    """Payload, unpadded length, timestamps and features of the stored bytes."""
    streams = demultiplex(media)
    kinds = {s["packets"][0][:8]: s for s in streams.values()}
    samples, levels = kinds.get(b"\x80pcm-u8\0"), kinds.get(b"\x80levels\0"[:8])
    if samples is None or levels is None:
        raise ValueError("a logical stream is missing")
    _, _, rate, n_bytes = struct.unpack("<8sIIQ", samples["packets"][0])
    payload = b"".join(samples["packets"][1:])
    # A page gives the position at its last packet's end; packets before it count back from there.
    position, times = samples["granules"][-1], []
    for packet, granule in zip(reversed(samples["packets"][1:]), reversed(samples["granules"][1:]), strict=True):
        if granule != -1 and granule != position:
            raise ValueError("granule positions do not follow the samples")
        position -= len(packet)
        times.append(position / rate)
    if position != 0:
        raise ValueError("granule positions do not start at zero")
    span = struct.unpack("<8sII", levels["packets"][0])[1]
    wave = np.frombuffer(payload, np.uint8)
    for i, packet in enumerate(levels["packets"][1:]):
        part = wave[i * span : (i + 1) * span]
        if struct.unpack("<BBQ", packet) != (part.min(), part.max(), part.sum(dtype=np.int64)):
            raise ValueError("levels do not match the samples")
    signed = wave.astype(np.int16) - 128
    crossings = int(np.count_nonzero((signed[1:] < 0) != (signed[:-1] < 0)))
    power = int(np.square(signed, dtype=np.int64).sum())
    feature = (
        f"seconds={len(wave) / rate:.6f};last_packet={times[0]:.6f};pages={samples['pages']}+{levels['pages']};"
        f"packets={len(samples['packets'])}+{len(levels['packets'])};low={int(wave.min())};high={int(wave.max())};"
        f"power={power};crossings={crossings}"
    )
    return {"n_bytes": n_bytes, "payload": payload, "times": times[::-1], "feature": feature}


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        at, media, size = 0, [], 0
        for i, text in enumerate(texts):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            media.append(encode(raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)), len(raw)))
            size += len(media[-1])
            if size > 16 << 20 or i == len(texts) - 1:
                yield pa.RecordBatch.from_arrays([ids[at : i + 1], pa.array(media, pa.binary())], ["doc_id", "media"])
                at, media, size = i + 1, [], 0


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: every whole text as UTF-8, padded with zero bytes to a positive multiple of 64, in Ogg.

    Null texts count as empty and give 64 zero samples. Equal texts give equal media. Repeated rows and
    null ids are kept; an empty table gives an empty result; extra columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).mapInArrow(_encoded, f"doc_id {kind}, media binary")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`store`, written into the shared folder: what is read from it are the stored bytes. A very long text is one value."""
    return staged(store(docs, id_col, text_col), "ogg-media", codec="zstd")


MEASURES = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}


def measure(media: bytes | None) -> dict:
    """What reading ``media`` back gives; for null or damaged media only ``error`` and its own size and digest."""
    out: dict = dict.fromkeys(MEASURES)
    if media is None:
        return out | {"error": "null"}
    out |= {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    try:
        got = decode(media)
    except ValueError as e:
        return out | {"error": str(e)}
    payload = got["payload"]
    return out | {"n_bytes": got["n_bytes"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "feature": got["feature"]}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(m.as_py()) for m in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in MEASURES.items())], ["doc_id", *MEASURES])


def read_back(stored: DataFrame) -> DataFrame:
    """Measures of the stored media (columns ``doc_id, media``), from the stored bytes alone; ``error`` is null for sound media."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "media").mapInArrow(
        _measured,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string",
    )
