"""Fill-in-middle transformation over seekable compressed frames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_BYTES = 1 << 16  # text that one frame holds, at most
LEVEL = 3  # of compression
BATCH_BYTES = 4 << 20  # compressed text that a task hands on at once

# The control strings, and the shares of 100 that stay plain or take the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SPAN_SHARE, SUFFIX_FIRST = 90, 20

FRAME = "units long, chars long, first long, first_char long, joins boolean, data binary"
FRAMES = f"n long, marked boolean, frames array<struct<{FRAME.replace(' ', ':').replace(',:', ',')}>>"
SPANS = "n long, form string, prefix_chars long, middle_chars long, output array<binary>"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def unit_starts(data: np.ndarray, joins: bool = False) -> np.ndarray:
    """Whether a unit ([A-Za-z]+ or one other character) begins at each byte; with `joins`, letters at the front go on."""
    letter = _LETTER[data]
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    if joins and len(data):
        starts[0] &= ~letter[0]
    return starts


def frames_of(text: bytes, pack: zstandard.ZstdCompressor, size: int) -> tuple[int, list[dict]]:
    """Units of a text and its frames, each compressed on its own and headed by the units and characters before it.

    A frame ends at a character's end. A run of letters may go on into the next frame, which then `joins`:
    it begins no unit there, so frames stay bounded however long a run is.
    """
    out, at, first, first_char, joins = [], 0, 0, 0, False
    while at < len(text):
        stop = min(at + size, len(text))
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        part = text[at:stop]
        data = np.frombuffer(part, np.uint8)
        units, chars = int(unit_starts(data, joins).sum()), int(((data & 0xC0) != 0x80).sum())
        out.append({"units": units, "chars": chars, "first": first, "first_char": first_char, "joins": joins, "data": pack.compress(part)})
        at, first, first_char = stop, first + units, first_char + chars
        joins = bool(_LETTER[part[-1]]) and at < len(text) and bool(_LETTER[text[at]])
    return first, out


def _emit(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for weight, row in rows:
        held.append(row)
        size += weight + 64
        if size > BATCH_BYTES or len(held) == 2048:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows of the batches, one at a time, so that a long text is a Python object only while it is handled."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def to_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per input row: id, n (units), marked (the text holds a control string), frames in order.

    Each frame is an independent zstandard frame with the number of units and characters before it, so a
    unit is found by decompressing one frame. Null texts count as empty and have no frames; repeated rows,
    repeated and null ids are kept as they are; an empty table gives an empty table; further columns of the input are not read.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    frame = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("first", pa.int64()), ("first_char", pa.int64()),
                       ("joins", pa.bool_()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            schema = pa.schema([(id_col, batch.schema[0].type), ("n", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(frame))])

            def rows_of(batch=batch):
                for key, text in _values([batch]):
                    n, frames = frames_of(text, pack, frame_bytes)
                    marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                    yield sum(len(f["data"]) for f in frames), {id_col: key, "n": n, "marked": marked, "frames": frames}

            yield from _emit(rows_of(), schema)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, {FRAMES}")


def draws(seed: int, key: object) -> list[int]:
    """Four 32-bit numbers from the seed and the decimal id (nothing for a null id)."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


class Splice:
    """Output text as a list of zstandard frames: whole input frames are taken over as they are, small parts are gathered."""

    def __init__(self, pack: zstandard.ZstdCompressor, size: int):
        self.pack, self.size, self.frames, self.held = pack, size, [], bytearray()

    def add(self, part: bytes) -> None:
        self.held += part
        if len(self.held) >= self.size:
            self.close()

    def take(self, data: bytes) -> None:
        self.close()
        self.frames.append(data)

    def close(self) -> None:
        if self.held:
            self.frames.append(self.pack.compress(bytes(self.held)))
            self.held = bytearray()


class Seek:
    """Places in a text given as frames. Only the frame that holds a cut is decompressed, and kept until another is."""

    def __init__(self, frames: list[dict], n: int, unpack: zstandard.ZstdDecompressor):
        self.frames, self.n, self.unpack, self.at, self.part = frames, n, unpack, -1, b""

    def text(self, i: int) -> bytes:
        if self.at != i:
            self.at, self.part = i, self.unpack.decompress(self.frames[i]["data"])
        return self.part

    def place(self, unit: int) -> tuple[int, int, int]:
        """Frame, byte in it and character in the text at which a unit begins; the end of the text for unit n."""
        if unit >= self.n:
            last = self.frames[-1]
            return len(self.frames), 0, last["first_char"] + last["chars"]
        low, high = 0, len(self.frames)
        while high - low > 1:  # the last frame with at most `unit` units before it
            mid = (low + high) // 2
            low, high = (mid, high) if self.frames[mid]["first"] <= unit else (low, mid)
        f = self.frames[low]
        data = np.frombuffer(self.text(low), np.uint8)
        byte = int(np.flatnonzero(unit_starts(data, f["joins"]))[unit - f["first"]])
        return low, byte, f["first_char"] + int(((data[:byte] & 0xC0) != 0x80).sum())

    def copy(self, start: tuple[int, int, int], stop: tuple[int, int, int], out: Splice) -> None:
        """The text between two places: frames inside are taken over compressed, cut ones are cut."""
        i, byte = start[0], start[1]
        while (i, byte) < stop[:2]:
            if i < stop[0] and byte == 0 and len(self.frames) > 1 and i != self.at:
                out.take(self.frames[i]["data"])
            else:
                out.add(self.text(i)[byte:stop[1] if i == stop[0] else None])
            i, byte = i + 1, 0


def transform(frames: DataFrame, id_col: str = "doc_id", seed: int = 1, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Fill-in-middle form of each row of `to_frames`: id, n, form, prefix_chars, middle_chars, output.

    output is a list of zstandard frames; joined, they are one zstandard stream of the output text. Two
    draws from the id choose the cuts among n + 1 places between units; a third leaves a tenth of the
    texts plain, a fourth puts the suffix first. Empty texts and texts with a control string stay plain;
    the characters of plain rows are null. A task holds one document's compressed frames and one
    decompressed frame. Ties (equal cuts) give an empty middle. Null ids draw as an empty id; repeated rows give equal outputs.
    """
    kind = frames.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            schema = pa.schema([(id_col, batch.schema[0].type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                                ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary()))])

            def rows_of(batch=batch):
                for key, n, marked, held in _values([batch]):
                    h = draws(seed, key)
                    row = {id_col: key, "n": n, "form": "plain", "prefix_chars": None, "middle_chars": None}
                    if n == 0 or marked or h[2] % 100 >= SPAN_SHARE:
                        row["output"] = [f["data"] for f in held]
                    else:
                        seek, out = Seek(held, n, unpack), Splice(pack, frame_bytes)
                        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                        begin, end = (0, 0, 0), seek.place(n)
                        a, b = seek.place(low), seek.place(high)
                        row["form"] = "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
                        parts = {PREFIX: (begin, a), SUFFIX: (b, end), MIDDLE: (a, b)}
                        order = (SUFFIX, PREFIX, MIDDLE) if row["form"] == "spm" else (PREFIX, SUFFIX, MIDDLE)
                        for mark in order:
                            out.add(mark)
                            seek.copy(*parts[mark], out)
                        out.close()
                        row |= {"prefix_chars": a[2], "middle_chars": b[2] - a[2], "output": out.frames}
                    yield sum(map(len, row["output"])), row

            yield from _emit(rows_of(), schema)

    return frames.select(id_col, "n", "marked", "frames").mapInArrow(run, f"`{id_col}` {kind}, {SPANS}")


def marks(output: list[bytes], unpack: zstandard.ZstdDecompressor) -> dict[bytes, int]:
    """Byte at which each control string stands in the output, reading one frame at a time."""
    found, at, tail = {}, 0, b""
    for data in output:
        part = tail + unpack.decompress(data)
        for mark in (PREFIX, SUFFIX, MIDDLE):
            if mark not in found and (i := part.find(mark)) >= 0:
                found[mark] = at - len(tail) + i
        at += len(part) - len(tail)
        tail = part[-2:]
    found[b""] = at
    return found


def stream(output: list[bytes], spans: list[tuple[int, int]], unpack: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The bytes of each span in turn. Frame sizes come from the frames' own headers, so frames outside are skipped unread."""
    sizes = [zstandard.frame_content_size(data) for data in output]
    for start, stop in spans:
        at = 0
        for data, size in zip(output, sizes):
            if at < stop and at + size > start:
                yield unpack.decompress(data)[max(0, start - at):stop - at]
            at += size


def restored(form: str, output: list[bytes], unpack: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The text before the transformation, in order, from the output and its form alone."""
    if form == "plain":
        for data in output:
            yield unpack.decompress(data)
        return
    at = marks(output, unpack)
    p, s, m, end = at[PREFIX], at[SUFFIX], at[MIDDLE], at[b""]
    prefix = (p + 3, s if form == "psm" else m)
    suffix = (s + 3, m if form == "psm" else p)
    yield from stream(output, [prefix, (m + 3, end), suffix], unpack)


def digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of `transform` with output_sha256 and restored_sha256 in place of the output, streamed frame by frame."""
    kind = spans.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            names = batch.schema.names[:-1]
            shown = []
            for i in range(batch.num_rows):
                output = batch.column(len(names))[i].as_py()
                whole, back = hashlib.sha256(), hashlib.sha256()
                for data in output:
                    whole.update(unpack.decompress(data))
                for part in restored(batch.column(2)[i].as_py(), output, unpack):
                    back.update(part)
                shown.append((whole.hexdigest(), back.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([s[0] for s in shown], pa.string()), pa.array([s[1] for s in shown], pa.string())],
                [*names, "output_sha256", "restored_sha256"])

    schema = f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return spans.select(id_col, "n", "form", "prefix_chars", "middle_chars", "output").mapInArrow(run, schema)


def output_text(output: list[bytes]) -> str:
    """The output of one row as text, for samples and exports."""
    return b"".join(zstandard.ZstdDecompressor().decompress(data) for data in output).decode("utf-8", "replace")
