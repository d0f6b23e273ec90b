"""Media columns: ISO base media containers (operator 1).

``probe`` walks the nested boxes of a container and decodes its sample tables (stsd, stts, stsc, stsz or stz2, stco or
co64, stss) and those of its fragments (trex, tfhd, trun), giving each track's codec, duration, sample count and the
byte ranges of its keyframes. Payload bytes are never decoded; only ``payload`` slices them out. ``mux`` stores a
payload losslessly: one video track of uncompressed 8-bit grey frames of 16 by 12 samples, 192 bytes each, every eighth
a keyframe.

Edge cases: null or empty media gives the error "empty"; truncated or malformed boxes and tables that reach past their
box or the file give an error text and no tracks, before anything of their stated size is allocated; an empty payload is
stored as one frame of blanks; a null text counts as empty; equal texts give equal containers; tracks keep the order of
the file, so there are no ties; repeated rows each give a row; an empty table gives an empty result; columns named
tracks and error are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, text_batches

FRAME, WIDTH, HEIGHT = 192, 16, 12
TIMESCALE, FRAME_TICKS = 24_000, 1000
#: Samples between keyframes, and samples in a chunk.
KEYFRAME_EVERY, CHUNK = 8, 32

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}

TRACK = "struct<track_id:long,handler:string,codec:string,timescale:long,duration:long,samples:long,keyframes:array<struct<start:long,bytes:long>>>"
PROBED = f"tracks array<{TRACK}>, error string"


class Malformed(ValueError):
    pass


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """Type, begin and body range of each box; sizes may be 64-bit (1) or reach to the end (0)."""
    while start < end:
        if end - start < 8:
            raise Malformed("cut off in a box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Malformed("cut off in a box header")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise Malformed(f"box {kind.decode('latin-1')} reaches past its parent")
        yield kind, start, start + head, start + size
        start += size


@dataclass
class Box:
    kind: bytes
    begin: int
    body: memoryview
    parent: bytes
    within: bool  # a track


def walk(data: memoryview) -> Iterator[Box]:
    """All boxes, parents before their children. The boxes that are open are on a stack, so any depth will do."""
    opened = [(b"", False, boxes(data, 0, len(data)))]
    while opened:
        parent, within, rest = opened[-1]
        found = next(rest, None)
        if found is None:
            opened.pop()
            continue
        kind, begin, a, b = found
        yield Box(kind, begin, data[a:b], parent, within)
        if kind in NESTED:
            opened.append((kind, within or (kind == b"trak" and parent == b"moov"), boxes(data, a, b)))


def _fields(form: str, body: memoryview, at: int) -> tuple:
    if at + struct.calcsize(form) > len(body):
        raise Malformed("cut off in a box")
    return struct.unpack_from(form, body, at)


def _array(body: memoryview, at: int, kind: str, n: int) -> np.ndarray:
    """``n`` numbers of a box, which must hold them."""
    if at + n * np.dtype(kind).itemsize > len(body):
        raise Malformed("a table reaches past its box")
    return np.frombuffer(body, kind, n, at).astype(np.int64)


def _table(body: memoryview, kind: str, fields: int = 1) -> np.ndarray:
    """A full box's table: version and flags, a count, then big-endian fields."""
    (n,) = _fields(">I", body, 4)
    out = _array(body, 8, kind, n * fields)
    return out.reshape(-1, fields) if fields > 1 else out


def _sizes(body: memoryview, compact: bool, most: int) -> np.ndarray:
    """Sample sizes. ``most``: bytes of the file, which samples of one size can't be over in all."""
    one, n = _fields(">II", body, 4)
    if not compact:
        if one and n * one > most:
            raise Malformed("samples reach past the end")
        return np.full(n, one, np.int64) if one else _array(body, 12, ">u4", n)
    bits = one & 255
    if bits not in (4, 8, 16):
        raise Malformed(f"sample sizes of {bits} bits")
    if bits == 4:
        packed = _array(body, 12, ">u1", (n + 1) // 2)
        return np.stack([packed >> 4, packed & 15], 1).reshape(-1)[:n]
    return _array(body, 12, f">u{bits // 8}", n)


def sample_offsets(chunks: np.ndarray, runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The place of each sample: chunk offsets, runs of (first chunk, samples per chunk, description), sample sizes."""
    firsts = runs[:, 0]
    if not len(runs) or firsts[0] != 1 or (np.diff(firsts) < 1).any() or firsts[-1] > len(chunks):
        raise Malformed("runs of chunks out of order")
    per = np.repeat(runs[:, 1], np.diff(np.append(firsts, len(chunks) + 1)))
    ends = np.cumsum(per)
    if ends[-1] < len(sizes):
        raise Malformed("chunks hold too few samples")
    chunk = np.searchsorted(ends, np.arange(len(sizes)), "right")
    before = np.cumsum(sizes) - sizes
    return chunks[chunk] + before - before[np.minimum(ends - per, len(sizes) - 1)][chunk]


@dataclass
class Track:
    """What the boxes of one track say. places, sizes: byte ranges of its samples; keys: which of them are keyframes."""

    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    places: list[np.ndarray] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)

    def add(self, places: np.ndarray, sizes: np.ndarray, keys: np.ndarray, end: int) -> None:
        if len(sizes) and (int(places.min()) < 0 or int((places + sizes).max()) > end):
            raise Malformed("samples reach past the end")
        self.places.append(places)
        self.sizes.append(sizes)
        self.keys.append(keys)

    @property
    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        return np.concatenate([none, *self.places]), np.concatenate([none, *self.sizes]), np.concatenate([none.astype(bool), *self.keys])

    def shown(self) -> dict:
        places, sizes, keys = self.ranges
        found = [{"start": a, "bytes": b} for a, b in zip(places[keys].tolist(), sizes[keys].tolist())]
        return {"track_id": self.track_id, "handler": self.handler, "codec": self.codec, "timescale": self.timescale, "duration": min(self.duration, (1 << 63) - 1), "samples": len(sizes), "keyframes": found}


def _track(data: memoryview, found: dict[bytes, memoryview]) -> Track:
    out = Track()
    if (x := found.get(b"tkhd")) is not None:
        (out.track_id,) = _fields(">I", x, 20 if _fields(">B", x, 0)[0] else 12)
    if (x := found.get(b"mdhd")) is not None:
        out.timescale, out.duration = _fields(">IQ", x, 20) if _fields(">B", x, 0)[0] else _fields(">II", x, 12)
    if (x := found.get(b"hdlr")) is not None:
        out.handler = _fields(">4s", x, 8)[0].decode("latin-1")
    if (x := found.get(b"stsd")) is not None and _fields(">I", x, 4)[0]:
        out.codec = _fields(">4s", x, 12)[0].decode("latin-1")
    compact = b"stsz" not in found
    if compact and b"stz2" not in found:
        return out
    sizes = _sizes(found[b"stz2" if compact else b"stsz"], compact, len(data))
    if (x := found.get(b"stts")) is not None and len(sizes):
        out.duration = sum(n * each for n, each in _table(x, ">u4", 2).tolist())
    if len(sizes):
        chunks = _table(found[b"stco"], ">u4") if b"stco" in found else _table(found[b"co64"], ">u8")
        places = sample_offsets(chunks, _table(found[b"stsc"], ">u4", 3), sizes)
        # without a sync table, every sample is a keyframe
        keys = np.ones(len(sizes), bool)
        if (x := found.get(b"stss")) is not None:
            numbers = _table(x, ">u4")
            if len(numbers) and not 1 <= int(numbers.min()) <= int(numbers.max()) <= len(sizes):
                raise Malformed("a sync sample that there is not")
            keys[:] = False
            keys[numbers - 1] = True
        out.add(places, sizes, keys, len(data))
    return out


class _Fragments:
    """Adds the samples of movie fragments to their tracks."""

    def __init__(self, data: memoryview, known: list[Track], defaults: dict[int, tuple[int, int, int]]):
        self.data, self.defaults = data, defaults
        self.of = {t.track_id: t for t in known}
        self.begin(0)

    def begin(self, at: int) -> None:
        """moof: a fragment."""
        self.moof = self.next = at
        self.track: Track | None = None

    def header(self, x: memoryview) -> None:
        """tfhd: the track, and where its data and its samples' properties come from."""
        flags, number = _fields(">II", x, 0)
        self.track, at, got = self.of.get(number), 8, {}
        for flag, form in ((0x1, ">Q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I")):
            if flags & flag:
                (got[flag],) = _fields(form, x, at)
                at += struct.calcsize(form)
        duration, size, sync = self.defaults.get(number, (0, 0, 0))
        self.duration, self.size, self.flags = got.get(0x8, duration), got.get(0x10, size), got.get(0x20, sync)
        # data begin where the header says, at the fragment, or after those of the track before
        self.base = self.at = got[0x1] if 0x1 in got else self.moof if flags & 0x20000 else self.next

    def run(self, x: memoryview) -> None:
        """trun: a run of samples that lie one after another."""
        if self.track is None:
            raise Malformed("a fragment of no track")
        word, n = _fields(">II", x, 0)
        at = 8
        if word & 0x1:
            self.at, at = self.base + _fields(">i", x, at)[0], at + 4
        first = None
        if word & 0x4:
            (first,), at = _fields(">I", x, at), at + 4
        own = [f for f in (0x100, 0x200, 0x400, 0x800) if word & f]
        if not own and n * max(self.size, 1) > len(self.data):
            raise Malformed("samples reach past the end")
        table = _array(x, at, ">u4", n * len(own)).reshape(n, len(own))
        column = lambda flag, else_: table[:, own.index(flag)] if flag in own else np.full(n, else_, np.int64)
        sizes, flags = column(0x200, self.size), column(0x400, self.flags)
        if first is not None and n:
            flags = np.concatenate([[first], flags[1:]])
        places = self.at + np.cumsum(sizes) - sizes
        self.track.add(places, sizes, flags & 0x10000 == 0, len(self.data))
        self.track.duration += int(column(0x100, self.duration).sum())
        self.at = self.next = self.at + int(sizes.sum())


def tracks(media: bytes) -> list[Track]:
    data = memoryview(media)
    own: list[dict[bytes, memoryview]] = []
    later: list[Box] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    for x in walk(data):
        if x.kind == b"trak" and x.parent == b"moov":
            own.append({})
        elif x.within:
            own[-1].setdefault(x.kind, x.body)
        elif x.kind == b"trex" and x.parent == b"mvex":
            number, _, duration, size, flags = _fields(">IIIII", x.body, 4)
            defaults[number] = duration, size, flags
        elif x.kind in (b"moof", b"tfhd", b"trun"):
            later.append(x)
    try:
        out = [_track(data, x) for x in own]
        fragments = _Fragments(data, out, defaults)
        for x in later:
            if x.kind == b"moof":
                fragments.begin(x.begin)
            elif x.kind == b"tfhd":
                fragments.header(x.body)
            else:
                fragments.run(x.body)
    except (struct.error, ValueError, KeyError, IndexError, AttributeError, OverflowError) as e:
        raise Malformed(f"bad sample table: {e}") from e
    return out


def payload(media: bytes, track: Track) -> bytes:
    """The payload of a track: its samples in order."""
    places, sizes, _ = track.ranges
    out = []
    # neighbouring samples are sliced together
    breaks = np.flatnonzero(places[1:] != places[:-1] + sizes[:-1]) + 1
    for i, j in itertools.pairwise([0, *breaks.tolist(), len(places)] if len(places) else []):
        out.append(media[int(places[i]) : int(places[j - 1] + sizes[j - 1])])
    return b"".join(out)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """A container whose samples are the payload's frames; its length must be a positive multiple of FRAME."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError(f"a payload is a positive multiple of {FRAME} bytes")
    duration, chunks = n * FRAME_TICKS, -(-n // CHUNK)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, CHUNK, 1)] if n >= CHUNK else []
    if n % CHUNK:
        runs.append((chunks, n % CHUNK, 1))
    keys = range(1, n + 1, KEYFRAME_EVERY)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        wide = first + len(payload) > 0xFFFFFFFF
        places = first + FRAME * CHUNK * np.arange(chunks)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, FRAME_TICKS)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *x) for x in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
            full(b"stss", struct.pack(">I", len(keys)), np.asarray(keys, ">u4").tobytes()),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration), bytes(16), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, duration, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    long = len(payload) + 8 > 0xFFFFFFFF
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(ftyp) + len(moov(0)) + len(head)
    return b"".join([ftyp, moov(first), head, payload])


def framed(text: str | None) -> bytes:
    """A text's UTF-8 with blanks to a positive multiple of FRAME."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def _shown(track: dict) -> str:
    keys = track["keyframes"]
    ranges = ",".join(f"{k['start']}+{k['bytes']}" for k in keys)
    return f"codec={track['codec']};handler={track['handler']};timescale={track['timescale']};duration={track['duration']};samples={track['samples']};keyframes={len(keys)};ranges={ranges}"


def _store(text: pd.Series) -> pd.Series:
    return pd.Series([mux(framed(x)) for x in text], dtype=object)


def _probe(media: pd.Series) -> pd.DataFrame:
    """tracks and error of each container."""
    rows = []
    for x in media:
        try:
            if not x:
                raise Malformed("empty")
            rows.append(([t.shown() for t in tracks(x)], None))
        except Malformed as e:
            rows.append(([], str(e)))
    return pd.DataFrame(rows, columns=["tracks", "error"])


def _digests(media: pd.Series) -> pd.DataFrame:
    rows = []
    for x in media:
        found = tracks(x)
        body = payload(x, found[0])
        rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(x), hashlib.sha256(x).hexdigest(), "|".join(_shown(t.shown()) for t in found)))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


# Python functions on columns; made when called, as their types need a session
def store_text(text: str) -> Column:
    return F.pandas_udf(_store, "binary")(text)


def probe(media: str) -> Column:
    return F.pandas_udf(_probe, PROBED)(media)


def stored_digests(media: Column) -> Column:
    return F.pandas_udf(_digests, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")(media)


def media_columns(rows: DataFrame, column: str = "media") -> DataFrame:
    """``rows`` with the columns tracks and error in place of the payload."""
    own = [c for c in rows.columns if c not in (column, "tracks", "error")]
    return rows.select(*own, probe(column).alias(f"{P}probed")).select(*own, f"{P}probed.*")


def text_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Texts stored as media, read back from the stored bytes. Both steps run in one pass over each Arrow batch."""
    text_batches(docs.sparkSession)
    out = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), stored_digests(store_text(text)).alias("m"))
    return out.select("doc_id", "n_bytes", "m.*")
