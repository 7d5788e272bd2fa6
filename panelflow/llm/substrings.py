"""Substring deduplication with difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm import keyed, words

WINDOW = 20  # words of a window
# A perfect difference set. Any two residues modulo PERIOD are shifted onto COVER together by
# some d < PERIOD, so two equal windows hold equal anchors of WINDOW - PERIOD + 1 words at cover positions.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

_COVERED = np.isin(np.arange(PERIOD), COVER)
# what travels: `own` rows go on to the documents unchanged, the others meet their like in a bucket
ANCHORS = "bucket int, low binary, high binary, key binary, pos binary, own boolean"
WINDOWS = "bucket int, h1 binary, h2 binary, key binary, pos binary, own boolean"
MARKS = "block int, key binary, pos binary"


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the text it is in and its number there."""
    own = words.owners(counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return own, np.arange(len(own)) - first[own]


def _send(batches: list[pa.RecordBatch], own: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield b.append_column("own", pa.array([own] * b.num_rows))


def _anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, limit=keyed.BLOCK_BYTES // 2):
                found, counts = words.split(part.column(1))
                h = words.grams(words.hashes(found), ANCHOR)
                own, pos = _places(counts)
                n = len(h)
                at = np.flatnonzero((own[:n] == own[ANCHOR - 1:ANCHOR - 1 + n]) & _COVERED[pos[:n] % PERIOD])
                h, pos = h[at], pos[at].astype(np.uint32)
                key = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[own[at]]
                # an anchor met twice here is known to be repeated; its first place alone travels on
                order = np.argsort(h, kind="stable")
                new = np.append(True, h[order[1:]] != h[order[:-1]]) if len(h) else np.zeros(0, bool)
                size = np.diff(np.append(np.flatnonzero(new), len(h)))
                repeated = np.sort(order[np.repeat(size > 1, size)])
                sent = np.sort(order[new])
                bucket = (h >> np.uint64(40)) % np.uint64(buckets)
                yield from _send([keyed.packed(bucket[sent], {
                    "low": (h[sent] & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                    "high": ((h[sent] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8), "key": key[sent], "pos": pos[sent],
                }, "bucket")], False)
                none = np.zeros(0)
                for b in _send([keyed.packed(keyed.block_of(key[repeated], buckets), {"key": key[repeated], "pos": pos[repeated]}, "bucket")], True):
                    empty = pa.array([b""] * b.num_rows, pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column(0), empty, empty, b.column(1), b.column(2), b.column(3)], ["bucket", "low", "high", "key", "pos", "own"])
    return run


def _marks(key: np.ndarray, pos: np.ndarray, blocks: int) -> pa.Table:
    return pa.Table.from_batches([keyed.packed(keyed.block_of(key, blocks), {"key": key, "pos": pos}, "block")])


def _parts(table: pa.Table, own: bool) -> pa.Table:
    mask = table.column("own").to_numpy()
    return table.filter(pa.array(mask if own else ~mask))


def _repeated_anchors(blocks: int):
    def run(table: pa.Table) -> pa.Table:
        known, met = _parts(table, True), _parts(table, False)
        h = keyed.unpacked(met.column("low"), np.uint32).astype(np.int64) | keyed.unpacked(met.column("high"), np.uint8).astype(np.int64) << 32
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[order[1:]] == h[order[:-1]] if len(h) else same[1:-1]
        hit = order[same[1:] | same[:-1]] if len(h) else order
        key = np.concatenate([keyed.unpacked(known.column("key"), np.int64), keyed.unpacked(met.column("key"), np.int64)[hit]])
        pos = np.concatenate([keyed.unpacked(known.column("pos"), np.uint32), keyed.unpacked(met.column("pos"), np.uint32)[hit]])
        return _marks(key, pos, blocks)
    return run


def _marked(docs: pa.Table, marks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the documents, and of each mark the document (its number) and the position."""
    keys = docs.column("key").to_numpy()
    order = np.argsort(keys)
    return keys, order[np.searchsorted(keys[order], keyed.unpacked(marks.column("key"), np.int64))], keyed.unpacked(marks.column("pos"), np.uint32).astype(np.int64)


def _candidate_windows(buckets: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        empty = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("h1", "h2", "key", "pos")), ("own", pa.bool_())]).empty_table()
        if not docs.num_rows or not marks.num_rows:
            return empty
        _, doc, pos = _marked(docs, marks)
        used, doc = np.unique(doc, return_inverse=True)
        docs = docs.take(pa.array(used)).combine_chunks()
        found, counts = words.split(docs.column("text").chunk(0))
        first = np.concatenate([[0], np.cumsum(counts)])
        own, at_word = _places(counts)
        n = len(own) - WINDOW + 1
        if n <= 0:
            return empty
        anchor = np.zeros(len(own) + 1, np.int32)
        anchor[first[doc] + pos + 1] = 1
        anchor = np.cumsum(anchor)
        # windows inside one text that hold a repeated anchor
        at = np.flatnonzero((own[:n] == own[WINDOW - 1:]) & (anchor[PERIOD:PERIOD + n] > anchor[:n]))
        h = words.hashes(found)
        h1, h2 = words.grams(h, WINDOW, 11)[at], (words.grams(h, WINDOW, 23)[at] >> np.uint64(32)).astype(np.uint32)
        key, pos = docs.column("key").to_numpy()[own[at]], at_word[at].astype(np.uint32)
        first_of, later = _firsts(h1, h2, key, pos)
        sent = keyed.packed((h1[first_of] >> np.uint64(20)) % np.uint64(buckets), {
            "h1": h1[first_of], "h2": h2[first_of], "key": key[first_of], "pos": pos[first_of]}, "bucket")
        out = [*_send([sent], False)]
        for b in _send([keyed.packed(keyed.block_of(key[later], buckets), {"key": key[later], "pos": pos[later]}, "bucket")], True):
            none = pa.array([b""] * b.num_rows, pa.binary())
            out.append(pa.RecordBatch.from_arrays([b.column(0), none, none, b.column(1), b.column(2), b.column(3)], empty.schema.names))
        return pa.Table.from_batches(out) if out else empty
    return run


def _firsts(h1, h2, key, pos) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first window of each content, by key and position, and of all later ones (sorted)."""
    order = np.lexsort((pos, key, h2, h1))
    a, b = h1[order], h2[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(order) else np.zeros(0, bool)
    return np.sort(order[new]), np.sort(order[~new])


def _later_windows(blocks: int):
    def run(table: pa.Table) -> pa.Table:
        known, met = _parts(table, True), _parts(table, False)
        h1, h2, key, pos = (keyed.unpacked(met.column(c), t) for c, t in (("h1", np.uint64), ("h2", np.uint32), ("key", np.int64), ("pos", np.uint32)))
        _, later = _firsts(h1, h2, key, pos)
        return _marks(
            np.concatenate([keyed.unpacked(known.column("key"), np.int64), key[later]]),
            np.concatenate([keyed.unpacked(known.column("pos"), np.uint32), pos[later]]), blocks)
    return run


def _without(id_type: pa.DataType):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        ids, n_words, removed, kept = [], [], [], []
        if docs.num_rows:
            docs = docs.combine_chunks()
            found, counts = words.split(docs.column("text").chunk(0))
            first = np.concatenate([[0], np.cumsum(counts)])
            step = np.zeros(len(found) + 1, np.int64)
            if marks.num_rows:
                _, doc, pos = _marked(docs, marks)
                start = first[doc] + pos
                np.add.at(step, start, 1)
                np.add.at(step, start + WINDOW, -1)
            gone = np.cumsum(step)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            ids, n_words, removed = docs.column("id").chunk(0), counts, np.diff(total[first])
            kept = words.joined(found, counts, ~gone)
        return pa.table({
            "id": pa.array(ids, id_type), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the words left, joined by one space).

    A word is removed if a window of WINDOW words over it has a word sequence that also starts earlier: in
    a smaller id, or in the same text at an earlier word. Windows are judged on the input.

    1. Anchors of ANCHOR words are hashed at cover positions (4 of 13 words). Those that repeat inside a task are
       known there; one of each is sent to a bucket of its hash, where the repeats across tasks show.
    2. Only windows that hold a repeated anchor are extended to their full WINDOW words: 96 bits of their hash go
       to a bucket, where all but the first by (id, position) are later ones. The first of a task stands
       for its task there as well, so a passage that a third of all rows share costs an entry per task.
    3. Places travel back to blocks of documents and the words under later windows go.
    No pairs are formed; the texts are shuffled once, by block, and both passes over blocks use that shuffle. Buckets
    and blocks number total text / BLOCK_BYTES, so what a task holds does not grow with the input.

    Null and empty texts have no words. Rows that repeat an id are ordered by their text's hash, and the
    later one counts as later; rows with null ids come last. An empty table gives an empty table.
    """
    rows, blocks, _ = keyed.with_keys(docs, id_col, text_col)
    met = rows.select("key", "text").mapInArrow(_anchors(blocks), ANCHORS).groupBy("bucket")
    anchors = met.applyInArrow(_repeated_anchors(blocks), MARKS)
    # any integer hash of the key will do, as long as numpy computes the same
    placed = rows.select("key", "id", "text").mapInArrow(_placed(blocks), _typed(rows, "block int, key long, id {}, text string")).groupBy("block")
    windows = placed.cogroup(anchors.groupBy("block")).applyInArrow(_candidate_windows(blocks), WINDOWS)
    later = windows.groupBy("bucket").applyInArrow(_later_windows(blocks), MARKS)
    from pyspark.sql.pandas.types import to_arrow_type

    out = placed.cogroup(later.groupBy("block")).applyInArrow(
        _without(to_arrow_type(rows.schema["id"].dataType)), _typed(rows, "id {}, n_words long, n_removed long, kept string"))
    return out.withColumnRenamed("id", id_col)


def _typed(rows: DataFrame, schema: str) -> str:
    return schema.format(rows.schema["id"].dataType.simpleString())


def _placed(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = keyed.block_of(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *b.columns], ["block", "key", "id", "text"])
    return run
