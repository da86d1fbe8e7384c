"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of the known formats anywhere in a value; for each hit, the format's
validator reads the structure after it (chunk lengths, markers, trailers) and gives the length of the media, or refuses.
A valid hit at byte 0 that spans the value corrects its declared type; valid hits elsewhere are carved as embedded media.

The query stores each payload as 8-bit unsigned PCM samples in a RIFF/WAVE container, whose data chunk holds the payload
byte for byte, sniffs the stored bytes and reads the samples back through the parsed chunk; the feature is the stored type
and format with the samples' mean, level and sign changes.

Defined cases: null text and empty text have the same payload of 64 zero bytes (one positive multiple of 64); a null
value of ``sniff`` has no type and nothing embedded; magic bytes without valid structure count for nothing; hits inside
a carved item are not carved again; equal texts give equal values; a very long text is one value like any other; an
empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.util import ship, table

BLOCK = 64
SAMPLE_RATE = 8000


# ---- validators: (bytes, start) -> length of the media or 0


def _riff(data: bytes, at: int, kind: bytes) -> int:
    if data[at + 8 : at + 12] != kind:
        return 0
    size = struct.unpack_from("<I", data, at + 4)[0] + 8
    end, p, seen = at + size, at + 12, False
    if end > len(data):
        return 0
    while p + 8 <= end:
        n = struct.unpack_from("<I", data, p + 4)[0]
        seen |= data[p : p + 4] in (b"data", b"VP8 ", b"VP8L", b"VP8X")
        p += 8 + n + (n & 1)
    return size if seen and end <= p <= end + 1 else 0


def _wav(data: bytes, at: int) -> int:
    return _riff(data, at, b"WAVE")


def _webp(data: bytes, at: int) -> int:
    return _riff(data, at, b"WEBP")


def _png(data: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, p)
        end = p + 12 + n
        if end > len(data) or struct.unpack_from(">I", data, end - 4)[0] != zlib.crc32(data[p + 4 : end - 4]):
            return 0
        if p == at + 8 and (kind != b"IHDR" or n != 13):
            return 0
        if kind == b"IEND":
            return end - at
        p = end
    return 0


def _gif(data: bytes, at: int) -> int:
    if at + 13 > len(data):
        return 0
    p = at + 13 + (3 * 2 ** ((data[at + 10] & 7) + 1) if data[at + 10] & 0x80 else 0)
    while p < len(data):
        tag = data[p]
        if tag == 0x3B:
            return p + 1 - at
        if tag == 0x21:
            p += 2
        elif tag == 0x2C and p + 10 <= len(data):
            p += 11 + (3 * 2 ** ((data[p + 9] & 7) + 1) if data[p + 9] & 0x80 else 0)
        else:
            return 0
        while p < len(data) and data[p]:
            p += 1 + data[p]
        p += 1
    return 0


def _jpeg(data: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(data) and data[p] == 0xFF:
        marker = data[p + 1]
        if marker == 0xD9:
            return p + 2 - at
        p += 2 + struct.unpack_from(">H", data, p + 2)[0]
        if marker == 0xDA:  # entropy-coded data runs to the next marker that is neither stuffing nor a restart
            while True:
                p = data.find(b"\xff", p)
                if p < 0 or p + 1 >= len(data):
                    return 0
                if data[p + 1] and not 0xD0 <= data[p + 1] <= 0xD7:
                    break
                p += 2
    return p + 2 - at if data[p : p + 2] == b"\xff\xd9" else 0


def _pdf(data: bytes, at: int) -> int:
    after = data.find(b"%PDF-", at + 5)  # a file may have been updated, and has an end mark for each time
    end = data.rfind(b"%%EOF", at, after if after > 0 else len(data))
    return end + 5 - at if end > 0 and data.find(b"startxref", at, end) > 0 else 0


def _gzip(data: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        view = memoryview(data)[at:]
        while view and not d.eof:
            d.decompress(view[: 1 << 16], 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            view = view[1 << 16 :]
    except zlib.error:
        return 0
    return len(data) - at - len(view) - len(d.unused_data) if d.eof else 0


def _zip(data: bytes, at: int) -> int:
    end = data.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return 0
    size, offset, note = struct.unpack_from("<IIH", data, end + 12)
    whole = end + 22 + note <= len(data) and at + offset + size == end
    return end + 22 + note - at if whole and data[end - size : end - size + 4] == b"PK\x01\x02" else 0


#: The formats' published magic bytes.
FORMATS = (
    ("audio/wav", b"RIFF", _wav),
    ("image/webp", b"RIFF", _webp),
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("application/pdf", b"%PDF-", _pdf),
    ("application/gzip", b"\x1f\x8b\x08", _gzip),
    ("application/zip", b"PK\x03\x04", _zip),
)

_automaton = None


def automaton():
    """One automaton over all magic bytes; bytes are looked at as the first 256 code points."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a, by_magic = ahocorasick.Automaton(), {}
        for name, magic, check in FORMATS:
            by_magic.setdefault(magic, []).append((name, check))
        for magic, checks in by_magic.items():
            a.add_word(magic.decode("latin-1"), (len(magic), checks))
        a.make_automaton()
        _automaton = a
    return _automaton


def sniff_bytes(data: bytes | None, declared: str | None = None) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(the corrected type, [(type, start, length) of embedded media])."""
    found: list[tuple[str, int, int]] = []
    kind, inside = declared, 0
    for end, (n, checks) in automaton().iter((data or b"").decode("latin-1")):
        at = end + 1 - n
        if at < inside:
            continue
        for name, check in checks:
            if size := check(data, at):
                if at == 0:
                    kind = name
                    if size >= len(data) - 1:
                        inside = 0  # the value itself: what lies within may be carved
                        break
                else:
                    found.append((name, at, size))
                inside = at + size
                break
    return kind, found


def sniff(df: DataFrame, column: str, declared: str | None = None) -> DataFrame:
    """df with ``media``: a struct of type, and embedded (type, start, length) of a binary column."""
    ship(df.sparkSession)

    @F.pandas_udf("type string, embedded array<struct<type:string,start:long,length:long>>")
    def run(data, said):
        import pandas as pd

        out = [sniff_bytes(d, s) if d is not None else (None, []) for d, s in zip(data, said)]
        return pd.DataFrame({"type": [k for k, _ in out], "embedded": [[{"type": t, "start": s, "length": n} for t, s, n in e] for _, e in out]})

    return df.withColumn("media", run(F.col(column), F.col(declared) if declared else F.lit(None).cast("string")))


# ---- payloads as samples


def wav_of(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """The payload as 8-bit unsigned mono samples; its length is even, so no pad byte is needed."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data) + len(payload), b"WAVE") + fmt + data + payload


def samples_of(stored: bytes) -> tuple[bytes, dict]:
    """The samples and the format of a stored WAVE file, by walking its chunks."""
    p, fmt = 12, {}
    while p + 8 <= len(stored):
        kind, n = struct.unpack_from("<4sI", stored, p)
        if kind == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, p + 8)
            fmt = {"tag": tag, "channels": channels, "rate": rate, "bits": bits}
        elif kind == b"data":
            return stored[p + 8 : p + 8 + n], fmt
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def _payloads(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            raw = (text.as_py() or "").encode("utf-8")
            stored = wav_of(raw + bytes(-len(raw) % BLOCK if raw else BLOCK))
            kind, embedded = sniff_bytes(stored, "application/octet-stream")
            back, fmt = samples_of(stored)
            seconds = len(back) / (fmt["rate"] * fmt["channels"])
            carved = ",".join(f"{t}@{s}+{n}" for t, s, n in embedded)
            wave = np.frombuffer(back, np.uint8).astype(np.int16) - 128
            level = f"mean={wave.sum() / len(wave):.4f};rms={math.sqrt(int((wave * wave).sum()) / len(wave)):.4f};crossings={int(((wave[1:] < 0) != (wave[:-1] < 0)).sum())}"
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{kind};{fmt['channels']}x{fmt['bits']}bit@{fmt['rate']};{seconds:.4f}s;{level};embedded={carved}"))
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_payloads, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
