"""Media columns: payloads in ISO base media containers and what their boxes tell.

A container holds one track of unsigned 8-bit sound samples (``raw `` sample entry). The reader walks the nested boxes,
decodes the sample tables (stts, stsc, stsz, stco/co64, stss) and gives codec, duration and the byte ranges of keyframes
(sync samples). It never decodes, and never needs, the payload itself.

Defined results: a null blob gives nulls in all columns; bytes that aren't a container, or whose boxes are cut short or
contradict each other, give ``error`` with the reason and nulls elsewhere. A null text is stored as an empty one; an
empty one as 64 zero bytes. Equal texts give equal bytes. Rows repeat as often as in the input.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, written

BLOCK = 64
#: Bytes of an access unit (a sample in the container's sense), and how many of them follow a keyframe.
UNIT, KEY_EVERY = 4096, 8
RATE = 8000
#: Boxes whose content is boxes: fixed values of the format.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
FEATURES = "codec string, handler string, timescale long, duration long, n_samples long, payload_offset long, payload_bytes long, keyframes array<struct<start:long,end:long>>, error string"


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``block``."""
    return data + bytes(max(block, -(-len(data) // block) * block) - len(data))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def mux(payload: bytes, unit: int = UNIT, key_every: int = KEY_EVERY, rate: int = RATE) -> bytes:
    """The container of ``payload``: ftyp, moov with the sample tables, mdat with the payload as it is."""
    sizes = [min(unit, len(payload) - i) for i in range(0, len(payload), unit)]
    n, matrix = len(sizes), struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    runs = [(len(sizes) - 1, unit), (1, sizes[-1])] if n > 1 and sizes[-1] != unit else [(n, sizes[0] if n else 0)]
    keys = range(1, n + 1, key_every)

    def moov(at: int) -> bytes:
        entry = _box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, rate << 16))
        stbl = _box(
            b"stbl",
            _full(b"stsd", 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, struct.pack(">I", len(runs)), *(struct.pack(">II", *r) for r in runs)),
            _full(b"stss", 0, struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
            _full(b"stsc", 0, struct.pack(">IIII", 1, 1, n, 1)),
            _full(b"stsz", 0, struct.pack(f">II{n}I", 0, n, *sizes)),
            _full(b"stco", 0, struct.pack(">II", 1, at)),
        )
        dinf = _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1)))
        mdia = _box(
            b"mdia",
            _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, rate, len(payload), 0x55C4, 0)),
            _full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            _box(b"minf", _full(b"smhd", 0, bytes(4)), dinf, stbl),
        )
        tkhd = _full(b"tkhd", 7, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, len(payload), 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = _full(b"mvhd", 0, struct.pack(">IIIIIH10x", 0, 0, rate, len(payload), 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    at = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(at) + _box(b"mdat", payload)


def boxes(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of content, end) of each box, parents first; an explicit stack keeps deep nesting from recursing."""
    todo = [(start, len(data) if end is None else end, path)]
    while todo:
        at, stop, above = todo.pop()
        while at < stop:
            if stop - at < 8:
                raise ValueError("box header cut short")
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1:
                if stop - at < 16:
                    raise ValueError("large box header cut short")
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = stop - at
            if size < head or at + size > stop:
                raise ValueError(f"box {kind!r} leaves its parent")
            yield (*above, kind), at + head, at + size
            if kind in CONTAINERS:
                todo.append((at + size, stop, above))
                todo.append((at + head, at + size, (*above, kind)))
                break
            at += size


def _table(data: bytes, at: int, end: int, width: int) -> np.ndarray:
    n = struct.unpack_from(">I", data, at)[0]
    if at + 4 + 4 * width * n > end:
        raise ValueError("sample table cut short")
    return np.frombuffer(data, ">u4", n * width, at + 4).astype(np.int64).reshape(n, width)


def first_track(data: bytes) -> dict[bytes, tuple[int, int]]:
    """Where the content of the first track's boxes lies, by type; each track is walked by itself."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in boxes(data):
        if b"moof" in path:
            raise ValueError("fragmented: samples are listed outside of moov")
        if path[-1] == b"trak":
            tracks.append({})
        elif b"trak" in path:
            tracks[-1].setdefault(path[-1], (a, b))
    if not tracks:
        raise ValueError("no trak box")
    if missing := [k for k in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz") if k not in tracks[0]]:
        raise ValueError(f"no {missing[0].decode()} box")
    return tracks[0]


def demux(data: bytes | None) -> dict:
    """Columns of FEATURES for the first track of ``data``; memory is bounded by the file's size, whatever its tables claim."""
    out: dict = dict.fromkeys(x.split()[0] for x in FEATURES.split(", "))
    if data is None:
        return out
    try:
        found = first_track(data)
        at = found[b"mdhd"][0]
        out["timescale"], out["duration"] = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
        out["handler"] = data[(h := found[b"hdlr"][0]) + 8 : h + 12].decode("latin-1")
        entry = found[b"stsd"][0] + 8
        out["codec"] = data[entry + 4 : entry + 8].decode("latin-1").strip()
        a, b = found[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, a + 4)
        if not fixed and a + 12 + 4 * n > b:
            raise ValueError("sample sizes cut short")
        # Samples of a fixed size, and the counts of times and chunks, are claims until they are compared with the file.
        if fixed and n * fixed > len(data):
            raise ValueError("samples leave the file")
        if int((t := _table(data, found[b"stts"][0] + 4, found[b"stts"][1], 2))[:, 0].sum()) != n or sum(int(x) * int(y) for x, y in t) != out["duration"]:
            raise ValueError("times and samples differ")
        if b"co64" in found:
            a8, b8 = found[b"co64"]
            if a8 + 8 + 8 * (c := struct.unpack_from(">I", data, a8 + 4)[0]) > b8:
                raise ValueError("sample table cut short")
            chunks = np.frombuffer(data, ">u8", c, a8 + 8)
            if c and int(chunks.max()) > len(data):
                raise ValueError("samples leave the file")
            chunks = chunks.astype(np.int64)
        elif b"stco" in found:
            chunks = _table(data, found[b"stco"][0] + 4, found[b"stco"][1], 1)[:, 0]
        else:
            raise ValueError("no chunk offsets")
        runs = _table(data, found[b"stsc"][0] + 4, found[b"stsc"][1], 3)
        spans = np.diff(np.append(runs[:, 0], len(chunks) + 1))
        if len(runs) and (runs[0, 0] != 1 or (spans < 0).any()) or int((spans * runs[:, 1]).sum()) != n or not len(runs) and len(chunks):
            raise ValueError("chunks and samples differ")
        sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
        each = np.repeat(runs[:, 1], spans) if len(runs) else np.zeros(0, np.int64)
        before = np.cumsum(sizes) - sizes
        some = each > 0
        first = np.concatenate([[0], np.cumsum(each[some])])[:-1]
        starts = np.repeat(chunks[some] - before[first] if n else chunks[:0], each[some]) + before
        if n and int((starts + sizes).max()) > len(data):
            raise ValueError("samples leave the file")
        keys = _table(data, found[b"stss"][0] + 4, found[b"stss"][1], 1)[:, 0] - 1 if b"stss" in found else np.arange(n)
        if len(keys) and not 0 <= keys.min() <= keys.max() < n:
            raise ValueError("keyframe without a sample")
        out["keyframes"] = [{"start": int(s), "end": int(s + z)} for s, z in zip(starts[keys], sizes[keys], strict=True)]
        out |= {"n_samples": n, "payload_offset": int(starts[0]) if n else None, "payload_bytes": int(sizes.sum())}
    except (ValueError, struct.error, IndexError, OverflowError, MemoryError) as e:
        return dict.fromkeys(out) | {"error": str(e) or type(e).__name__}
    return out


def payload(data: bytes) -> bytes:
    """The samples of a container of one chunk, in their order."""
    x = demux(data)
    if x["error"]:
        raise ValueError(x["error"])
    return data[x["payload_offset"] : x["payload_offset"] + x["payload_bytes"]] if x["n_samples"] else b""


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded, in a container."""

    def run(batches):
        for b in slices(batches):
            raw = [(x or "").encode() for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def probe(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with a struct column ``probe`` of FEATURES read from the boxes of ``media_col``."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    @F.pandas_udf(StructType.fromDDL(FEATURES))
    def walk(blobs):
        import pandas as pd

        return pd.DataFrame([demux(None if x is None else bytes(x)) for x in blobs], columns=[x.split()[0] for x in FEATURES.split(", ")]).astype({"error": object})

    return df.withColumn("probe", walk(media_col))


def digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of the stored containers (id, n_bytes, media), computed from the bytes that are read."""

    def run(batches):
        for b in slices(batches, 200):
            cols: list[list] = [[] for _ in range(7)]
            for media in map(pa.BinaryScalar.as_py, b.column(2)):
                x, back = demux(media), payload(media)
                feature = f"codec={x['codec']};handler={x['handler']};timescale={x['timescale']};duration={x['duration']};samples={x['n_samples']};keyframes=" + ",".join(f"{k['start']}-{k['end']}" for k in x["keyframes"])
                for c, v in zip(cols, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, x["duration"] / x["timescale"]), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds"]
    kind = stored.schema[id_col].dataType.simpleString()
    return stored.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double")


def digest_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text in a container, in a table of the shared folder, and returns digests and features of what is read from there."""
    return digests(written(store(df, id_col, text_col), "media"), id_col)
