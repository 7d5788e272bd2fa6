"""N-gram Jaccard join by parity sketches."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm import keyed, words
from panelflow.llm.components import connected
from panelflow.session import key_table, stored

# Members of a signature beyond which it is divided by a second sketch. A member then travels with hundreds of new
# signatures, which costs more than comparing its print with those of some thousand others.
SPLIT_ABOVE = 16_384
MAX_LEVEL = 3  # sketches that divide one signature, at most
HUB_ROUNDS = 1  # further hubs tried before members are compared pair by pair

MET = "bucket int, kind int, sig binary, sig2 binary, a binary, hub binary, n binary, print binary"
EDGES = "kind int, sig binary, a binary, hub binary, n binary, print binary"
_COLUMNS = {"sig": np.uint64, "sig2": np.uint64, "a": np.int64, "hub": np.int64, "n": np.int64, "print": np.uint64}
SKETCH, LOCAL_EDGE, SET, LOCAL_COPY, LARGE = range(5)  # kinds of rows that meet in a bucket
EDGE, CLASS, LEAD, WIDE = range(4)  # kinds of rows that leave it
PRINT_WORDS = 8  # 64-bit words of the fixed-size sketch that filters pairs
PRINT = [f"w{i}" for i in range(PRINT_WORDS)]
WIDE_ABOVE = 64 * PRINT_WORDS  # tokens beyond which a set has a print of its own size too


def _put(df: DataFrame) -> DataFrame:
    """Kept in the shared folder as a table: its size is known to the joins that follow, and small ones read as few tasks."""
    return stored(df, "near")


@dataclass(frozen=True)
class Join:
    """Shingles of `k` words, linked where intersection * den >= union * num."""

    k: int = 5
    num: int = 4
    den: int = 5

    @property
    def wide(self) -> bool:
        """Whether blocks hold many tokens: few may differ, so there are few blocks."""
        return 100 * self.num >= 85 * self.den

    @property
    def weak(self) -> int:
        """A block of fewer tokens says little; see `signatures`. Narrow blocks are weak only if empty."""
        return 2 if self.wide else 1

    def bands(self) -> tuple[list[int], list[int], list[int]]:
        """Lower bounds of the size bands, and per band its number of blocks and of spare blocks.

        Sets of at most b shingles with this similarity differ in at most 2 b (den - num) / (den + num) of
        them. One block more than that must agree; the spare blocks make up for weak ones.
        """
        low, count, spare, at = [], [], [], 1
        while at < 1 << 33:
            nxt = max(at + 1, at * 3 // 2 if self.wide else at * 5 // 4)
            differ = 2 * (nxt - 1) * (self.den - self.num) // (self.den + self.num)
            extra = 1 + (differ + 1) // (10 if self.wide else 5)
            low.append(at)
            count.append(differ + 1 + extra if differ else 0)
            spare.append(extra)
            at = nxt
        return low, count, spare


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending inside a text, and how many it has."""
    found, counts = words.split(texts, lower=True)
    h = words.hashes(found)
    own = words.owners(counts)
    g = words.grams(h, k)
    whole = own[:len(g)] == own[k - 1:k - 1 + len(g)] if len(g) else np.zeros(0, bool)
    g, of = g[whole], own[:len(g)][whole]
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    extra_g, extra_of = [], []
    for n in range(1, k):  # shorter texts: the whole sequence is the one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            extra_g.append(words.grams(h, n, 100 + n)[first[short]])
            extra_of.append(short)
    if extra_g:
        g, of = np.concatenate([g, *extra_g]), np.concatenate([of, *extra_of])
        order = np.argsort(of, kind="stable")
        g, of = g[order], of[order]
    cuts = np.searchsorted(of, np.arange(len(counts) + 1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    return g[new], np.bincount(of[new], minlength=len(counts))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, np.concatenate([[0], np.cumsum(sizes)])[:-1][full])
    return out


def prints(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity sketch of PRINT_WORDS * 64 bits of each set, whose tokens ascend."""
    out = np.zeros(len(sizes) * PRINT_WORDS, np.uint64)
    if len(tokens):
        width = PRINT_WORDS.bit_length() - 1
        place = words.owners(sizes) * PRINT_WORDS + (tokens >> np.uint64(64 - width)).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        bit = np.uint64(1) << (tokens >> np.uint64(58 - width) & np.uint64(63))
        out[place[cut]] = np.bitwise_xor.reduceat(bit, cut)
    return out.reshape(-1, PRINT_WORDS)


def wide_words(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of a wide print: the power of two that gives a set at least one bit a token."""
    return 1 << np.ceil(np.log2(np.maximum(sizes, 128) / 64)).astype(np.int64)


def wide_prints(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches that grow with the sets, whose tokens ascend, one after the other, and where each begins.

    Two unrelated sets differ in about half the bits of a print, so that one of fixed size tells large sets apart no
    longer. A token's word is named by its highest bits: a print of half the words is the XOR of neighbouring ones.
    """
    count = wide_words(sizes)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1], np.uint64)
    if len(tokens):
        own = words.owners(sizes)
        place = first[own] + (tokens >> (64 - np.log2(count)).astype(np.uint64)[own]).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        out[place[cut]] = np.bitwise_xor.reduceat(np.uint64(1) << (tokens & np.uint64(63)), cut)
    return out, first


def signatures(tokens: np.ndarray, sizes: np.ndarray, join: Join, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets given by their tokens (ascending inside a set), and the set each belongs to.

    A set's sketch has a fixed number of blocks per size band. A token belongs to one block and is XORed into it
    as 64 bits, so two sketches differ in at most as many blocks as their sets differ in tokens, and two linked sets have
    more equal blocks than there are spare ones. (One-hot bits would do as well, but a block of two or
    three tokens has then so few values that unrelated sets meet by chance, the more the larger the input.) A pair is
    looked for in the band of its larger set: a set is sketched for its own band and for those its larger
    partners can be in. A signature is a band, a block number and the block's parity word. Weak blocks, of fewer
    than join.weak tokens, are left out unless the set has more of them than spare blocks; of two linked sets,
    either one has not, and then they share a block that is not weak, or both have and all their blocks are there.
    """
    low, count, spare = (np.asarray(x, np.int64) for x in join.bands())
    if seed:
        tokens = words.mixed(tokens, 50 + seed)
        order = np.lexsort((tokens, words.owners(sizes)))
        tokens = tokens[order]
    own_band = np.searchsorted(low, sizes, side="right") - 1
    last_band = np.searchsorted(low, sizes * join.den // join.num, side="right") - 1
    sigs, of = [], []
    step = 0
    while True:
        band = own_band + step
        chosen = np.flatnonzero((sizes > 0) & (band <= last_band) & (count[np.minimum(band, len(low) - 1)] > 0))
        if not len(chosen):
            if not np.any((sizes > 0) & (band < last_band)):
                break
            step += 1
            continue
        picked = np.zeros(len(sizes), bool)
        picked[chosen] = True
        mine = np.repeat(picked, sizes)
        t, own = tokens[mine], np.repeat(np.arange(len(chosen)), sizes[chosen])
        blocks = count[band[chosen]]
        first = np.concatenate([[0], np.cumsum(blocks)])
        place = first[own] + ((t >> np.uint64(32)) * blocks[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        parity = np.zeros(first[-1], np.uint64)
        parity[place[cut]] = np.bitwise_xor.reduceat(words.mixed(t, 29), cut)
        set_of = np.repeat(np.arange(len(chosen)), blocks)
        weak = np.bincount(place, minlength=len(parity)) < join.weak
        irregular = np.bincount(set_of, weak, len(chosen)) > spare[band[chosen]]
        send = ~weak | irregular[set_of]
        number = np.arange(len(parity)) - first[set_of]
        name = words.mixed((band[chosen][set_of].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64), 31 + seed)
        sigs.append(words.mixed(parity ^ name, 37)[send])
        of.append(chosen[set_of[send]])
        step += 1
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(of)


def _rows(bucket: np.ndarray, kind: int, **columns: np.ndarray) -> list[pa.RecordBatch]:
    if not len(bucket):
        return []
    part = keyed.packed(bucket, columns, "bucket")
    empty = pa.array([b""] * part.num_rows, pa.binary())
    return [pa.RecordBatch.from_arrays(
        [part.column(0), pa.array([kind] * part.num_rows, pa.int32()), *(part.column(c) if c in columns else empty for c in _COLUMNS)],
        ["bucket", "kind", *_COLUMNS])]


def _large_rows(key: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, buckets: int) -> list[pa.RecordBatch]:
    """The wide prints of the large ones among the sets, in buckets of their own keys."""
    large = sizes > WIDE_ABOVE
    if not large.any():
        return []
    key, one = key[large], np.arange(np.count_nonzero(large) + 1)
    wide, first = wide_prints(tokens[np.repeat(large, sizes)], sizes[large])
    columns = {"a": keyed.binary(key, one), "n": keyed.binary(sizes[large].astype(np.int64), one), "print": keyed.binary(wide, first)}
    empty = pa.array([b""] * len(key), pa.binary())
    return [pa.RecordBatch.from_arrays(
        [pa.array(keyed.block_of(key, buckets)), pa.array([LARGE] * len(key), pa.int32()), *(columns.get(c, empty) for c in _COLUMNS)],
        ["bucket", "kind", *_COLUMNS])]


def _stars(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (sig, key), whether a row opens its signature, and the place of the opening row."""
    order = np.lexsort((key, sig))
    new = np.append(True, sig[order[1:]] != sig[order[:-1]]) if len(order) else np.zeros(0, bool)
    hub = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    return order, new, hub


def _sketches(join: Join, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, limit=keyed.BLOCK_BYTES // 4):
                key = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                tokens, sizes = shingle_sets(part.column(1), join.k)
                d1, d2 = _sums(words.mixed(tokens, 5), sizes), _sums(words.mixed(tokens, 6), sizes)
                nothing = sizes == 0
                d1[nothing] = words.mixed(key[nothing].astype(np.uint64), 8)  # equal to nothing
                # copies of a set already met here stand behind its smallest key
                order = np.lexsort((key, d2, d1))
                a, b = d1[order], d2[order]
                new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(order) else np.zeros(0, bool)
                rep = np.empty(len(order), np.int64)
                rep[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
                lead = rep == np.arange(len(rep))
                at = (d1 % np.uint64(buckets)).astype(np.int32)
                tokens, kept, number = tokens[np.repeat(lead, sizes)], sizes[lead], sizes.astype(np.int64)
                yield from _rows(at[lead], SET, sig=d1[lead], sig2=d2[lead], a=key[lead], n=number[lead], print=prints(tokens, kept))
                # what need not meet anything goes to a bucket of its own key: a hot set or signature is spread
                yield from _rows(keyed.block_of(key[~lead], buckets), LOCAL_COPY, a=key[~lead], hub=key[rep[~lead]], n=number[~lead])
                sig, of = signatures(tokens, kept, join)
                mine = key[lead][of]
                order, new, hub = _stars(sig, mine)
                # by key inside a bucket: equal keys side by side take little room in a shuffle
                first, rest, hub = order[new], order[~new], hub[~new]
                first, by = first[np.argsort(mine[first], kind="stable")], np.argsort(mine[rest], kind="stable")
                rest, hub = rest[by], hub[by]
                spot = (sig % np.uint64(buckets)).astype(np.int32)
                yield from _rows(spot[first], SKETCH, sig=sig[first], a=mine[first])
                yield from _rows(keyed.block_of(mine[rest], buckets), LOCAL_EDGE, sig=sig[rest], a=mine[rest], hub=mine[hub])
                yield from _large_rows(key[lead], tokens, kept, buckets)
    return run


def _column(table: pa.Table, name: str) -> np.ndarray:
    return keyed.unpacked(table.column(name), _COLUMNS[name])


def _meet(table: pa.Table) -> pa.Table:
    """Edges (sig, a, hub) of the signatures of a bucket, the class (hub) of each set in it, and the prints."""
    kind = table.column("kind").to_numpy()
    part = {k: table.filter(pa.array(kind == k)) for k in (SKETCH, LOCAL_EDGE, SET, LOCAL_COPY, LARGE)}
    sig, a = _column(part[SKETCH], "sig"), _column(part[SKETCH], "a")
    order, new, hub = _stars(sig, a)
    rest = order[~new]
    edge = part[LOCAL_EDGE]
    edges = {
        "sig": np.concatenate([sig[rest], _column(edge, "sig")]), "a": np.concatenate([a[rest], _column(edge, "a")]),
        "hub": np.concatenate([a[hub[~new]], _column(edge, "hub")])}
    d1, d2, key, n = (_column(part[SET], c) for c in ("sig", "sig2", "a", "n"))
    order = np.lexsort((key, d2, d1))
    x, y = d1[order], d2[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(order) else np.zeros(0, bool)
    opens = order[np.flatnonzero(new)]
    lead = key[opens][np.cumsum(new) - 1] if len(order) else key
    copy = part[LOCAL_COPY]
    classes = {
        "a": np.concatenate([key[order], _column(copy, "a")]), "hub": np.concatenate([lead, _column(copy, "hub")]),
        "n": np.concatenate([n[order], _column(copy, "n")])}
    leads = {"a": key[opens], "n": n[opens], "print": _column(part[SET], "print").reshape(-1, PRINT_WORDS)[opens]}
    wide = {c: _column(part[LARGE], c) for c in ("a", "n", "print")}
    rows = [(EDGE, edges), (CLASS, classes), (LEAD, leads), (WIDE, wide)]
    return pa.table({
        "kind": pa.array([k for k, _ in rows], pa.int32()),
        **{c: pa.array([r[c].tobytes() if c in r else b"" for _, r in rows], pa.binary()) for c in ("sig", "a", "hub", "n", "print")}})


def _unpack(edges: DataFrame, kind: int, names: list[str], distinct: bool = False) -> DataFrame:
    """The packed values as rows; with `distinct`, each combination once per packed row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                columns = [np.frombuffer(v or b"", _COLUMNS[c]).view(np.int64) for c, v in zip(names, row)]
                if names[-1] == "print":
                    columns[-1:] = columns[-1].reshape(-1, PRINT_WORDS).T
                if distinct and len(columns[0]):
                    columns = list(np.unique(np.stack(columns), axis=1))
                for at in range(0, len(columns[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at:at + (1 << 16)]) for c in columns], out)
    out = [*names[:-1], *PRINT] if names[-1] == "print" else names
    return edges.filter(F.col("kind") == kind).select(*names).mapInArrow(run, ", ".join(f"{c} long" for c in out))


def _unpack_wide(edges: DataFrame) -> DataFrame:
    """The wide prints of large sets as rows (a, n, wide)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                a, n, wide = (np.frombuffer(v or b"", _COLUMNS[c]) for c, v in zip(names, row))
                cuts = np.concatenate([[0], np.cumsum(wide_words(n))])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), keyed.binary(wide, cuts)], ["a", "n", "wide"])
    names = ["a", "n", "print"]
    return edges.filter(F.col("kind") == WIDE).select(*names).mapInArrow(run, "a long, n long, wide binary")


def _close(pairs: DataFrame, wide: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b), less those of two large sets whose wide prints differ in more bits than linked sets do in tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            for i, (m, n, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)))):
                if x is None or y is None:
                    continue
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                while len(y) > len(x):
                    y = y[::2] ^ y[1::2]
                kept[i] = int(np.bitwise_count(x ^ y).sum()) * (join.den + join.num) <= (m + n) * (join.den - join.num)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(kept)) for c in range(2)], ["a", "b"])

    for x in ("a", "b"):
        pairs = pairs.join(wide.select(F.col("a").alias(x), F.col("n").alias(x + "_n"), F.col("wide").alias(x + "_wide")), x, "left")
    return pairs.select("a", "b", "a_n", "b_n", "a_wide", "b_wide").mapInArrow(run, "a long, b long")


def _token_sets(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch):
                tokens, sizes = shingle_sets(part.column(1), join.k)
                yield pa.RecordBatch.from_arrays([part.column(0), keyed.binary(tokens, np.concatenate([[0], np.cumsum(sizes)]))], ["key", "tokens"])
    return run


def _verify(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) with whether they are linked, by their exact sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) * join.den < max(len(x), len(y)) * join.num:
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                linked[i] = shared * join.den >= (len(both) - shared) * join.num
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["a", "b", "linked"])

    with_a = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a")
    with_b = with_a.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b")
    return with_b.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


def _component(nodes: DataFrame, on: str, parts: DataFrame) -> DataFrame:
    """Adds the component of column `on`; a node without links is its own."""
    renamed = parts.select(F.col("node").alias(on), F.col("component").alias(f"{on}_comp"))
    return nodes.join(renamed, on, "left").withColumn(f"{on}_comp", F.coalesce(f"{on}_comp", on))


def _near_enough(join: Join, x: str, y: str) -> Column:
    """Whether two sets may be linked by their sizes and prints: prints differ in no more bits than sets in tokens."""
    differ = reduce(operator.add, [F.bit_count(F.col(x + w).bitwiseXOR(F.col(y + w))) for w in PRINT])
    return (F.least(x + "n", y + "n") * join.den >= F.greatest(x + "n", y + "n") * join.num) & (
        differ * (join.den + join.num) <= (F.col(x + "n") + F.col(y + "n")) * (join.den - join.num))


def _with_prints(pairs: DataFrame, leads: DataFrame, on: str) -> DataFrame:
    named = leads.select(F.col("a").alias(on), *[F.col(c).alias(f"{on}_{c}") for c in ("n", *PRINT)])
    return pairs.join(named, on)


def _divide(members: DataFrame, sets: DataFrame, join: Join, level: int) -> DataFrame:
    """Members (sig, rep, comp) under signatures that join the old one with those of another sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                runs = [np.frombuffer(v.as_buffer(), np.uint64) for v in part.column(3)]
                sizes = np.fromiter(map(len, runs), np.int64, len(runs))
                new, of = signatures(np.concatenate(runs) if runs else np.zeros(0, np.uint64), sizes, join, level)
                old = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                both = words.mixed(old[of] ^ words.mixed(new, level), 41).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both), part.column(1).take(pa.array(of)), part.column(2).take(pa.array(of))], ["sig", "rep", "comp"])

    held = members.join(sets.select(F.col("key").alias("rep"), "tokens"), "rep")
    return held.select("sig", "rep", "comp", "tokens").mapInArrow(run, "sig long, rep long, comp long").distinct()


def _hub_pairs(members: DataFrame, leads: DataFrame, join: Join, turn: int) -> DataFrame:
    """Pairs of a signature's members with another hub of it, drawn by hash, where they lie in different components."""
    drawn = F.min(F.struct(F.xxhash64("sig", "rep", F.lit(turn)).alias("o"), "rep", "comp")).alias("h")
    hubs = members.groupBy("sig").agg(drawn, F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
    met = members.join(hubs.select("sig", "h"), "sig").filter("comp <> h.comp")
    pairs = met.select(F.least("rep", "h.rep").alias("a"), F.greatest("rep", "h.rep").alias("b")).distinct()
    return _with_prints(_with_prints(pairs, leads, "a"), leads, "b").filter(_near_enough(join, "a_", "b_")).select("a", "b")


def _open_pairs(members: DataFrame, leads: DataFrame, fetch: Callable[[DataFrame], DataFrame], join: Join) -> DataFrame:
    """Pairs of members of one signature that lie in different components so far and may be linked by their prints.

    A signature of more than SPLIT_ABOVE members is first divided by sketches over other bits: members that
    are linked still share a signature, others hardly ever.
    """
    found = None
    for level in range(1, MAX_LEVEL + 1):
        size = members.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        tagged = _put(members.join(size.filter("c0 <> c1").select("sig", "m"), "sig"))
        small = tagged if level == MAX_LEVEL else tagged.filter(F.col("m") <= SPLIT_ABOVE)
        small = _with_prints(small.select("sig", F.col("rep").alias("a"), "comp"), leads, "a")
        other = small.select("sig", *[F.col(c).alias("b" + c[1:]) for c in small.columns if c.startswith("a")], F.col("comp").alias("cb"))
        may = (F.col("a") < F.col("b")) & (F.col("comp") != F.col("cb")) & _near_enough(join, "a_", "b_")
        pairs = small.join(other, (small["sig"] == other["sig"]) & may).select("a", "b").distinct()
        found = pairs if found is None else found.unionByName(pairs)
        large = tagged.filter(F.col("m") > SPLIT_ABOVE).drop("m")
        if level == MAX_LEVEL or large.isEmpty():
            break
        members = _divide(large, fetch(large.select(F.col("rep").alias("key"))), join, level)
    return found.distinct()


def near_classes(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links).

    1. Every text becomes a set of shingle hashes; equal sets form a class, led by its smallest key.
    2. Signatures of the sets' parity sketches meet in buckets. A signature's members are joined to its
       smallest key, first inside a task, then in the bucket, so a signature costs a task one row in its bucket and pairs
       are never all formed. What was joined inside a task travels in buckets of its own keys.
    3. Joined classes whose prints differ in too many bits are not linked: first those of fixed size, then, of large sets, wide
       prints that grow with the set, so that few pairs are left that only share a passage. The others are verified
       with their exact sets, and components of the links taken.
    4. Where a joined pair is not linked and still apart, the members of its signature meet further hubs; those that
       still lie in different components then are verified pair by pair. Then every pair sharing a signature is linked, apart by exact
       comparison or print, or in one component anyway: no link is lost.
    The number of buckets follows the total text.

    Null and empty texts have no shingle and are linked with nothing; texts of fewer than join.k words are one shingle.
    Repeated rows are copies of each other. Rows that repeat an id, or have none, are told apart by a key that sorts
    like the id (nulls last), and component_id is the id of the smallest key. An empty table gives an empty table.
    """
    rows, blocks, plain = keyed.with_keys(docs, id_col, text_col)
    met = rows.select("key", "text").mapInArrow(_sketches(join, blocks), MET)
    packed = stored(met.groupBy("bucket").applyInArrow(_meet, EDGES), "near-edges")

    local = _unpack(packed, CLASS, ["a", "hub", "n"])
    lead = local.select(F.col("a").alias("hub"), F.col("hub").alias("rep"))
    classes = _put(local.join(lead, "hub").select(F.col("a").alias("key"), "rep", "n"))
    leads = _put(_unpack(packed, LEAD, ["a", "n", "print"]))
    wide = _put(_unpack_wide(packed))

    def fetch(keys: DataFrame) -> DataFrame:
        wanted = key_table(keys.distinct(), "near-keys")
        held = rows.select("key", "text").join(wanted, "key", "left_semi")
        return stored(held.mapInArrow(_token_sets(join), "key long, tokens binary"), "near-sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))

    raw = _unpack(packed, EDGE, ["a", "hub"], distinct=True).distinct()
    of = classes.select("key", "rep")
    raw = raw.join(of.select(F.col("key").alias("a"), F.col("rep").alias("ra")), "a").join(
        of.select(F.col("key").alias("hub"), F.col("rep").alias("rh")), "hub").filter("ra <> rh")
    raw = _put(raw.select("a", "hub", F.least("ra", "rh").alias("ra"), F.greatest("ra", "rh").alias("rh")))
    pairs = raw.select(F.col("ra").alias("a"), F.col("rh").alias("b")).distinct()
    printed = _with_prints(_with_prints(pairs, leads, "a"), leads, "b")
    pairs = _put(printed.select("a", "b", _near_enough(join, "a_", "b_").alias("may")))
    likely = _put(_close(pairs.filter("may").select("a", "b"), wide, join))
    sets = fetch(ends(likely))
    links = _put(_verify(likely, sets, join).filter("linked").select("a", "b"))
    parts = _put(connected(links))

    apart = _component(_component(pairs.select("a", "b"), "a", parts), "b", parts).filter("a_comp <> b_comp")
    apart = _put(apart.select(F.col("a").alias("ra"), F.col("b").alias("rh")))
    if not apart.isEmpty():
        # a signature of two members has no pair but the one that was judged
        edges = _unpack(packed, EDGE, ["sig", "a", "hub"])
        edges = edges.join(edges.groupBy("sig").count().filter("count > 1").select("sig"), "sig", "left_semi")
        open_sigs = edges.join(raw.join(apart, ["ra", "rh"], "left_semi").select("a", "hub"), ["a", "hub"], "left_semi").select("sig").distinct()
        kept = edges.join(open_sigs, "sig", "left_semi")
        members = kept.select("sig", F.col("a").alias("key")).unionByName(kept.select("sig", F.col("hub").alias("key"))).distinct()
        members = stored(members.join(of, "key").select("sig", "rep").distinct(), "near-members")

        def grouped() -> DataFrame:
            return _component(members, "rep", parts).select("sig", "rep", F.col("rep_comp").alias("comp"))

        def judge(new: DataFrame) -> None:
            """Verifies new pairs (a, b) and joins what they link."""
            nonlocal links, parts, sets, judged
            new = _put(new.join(judged, ["a", "b"], "left_anti"))
            likely = _put(_close(new, wide, join))
            unread = _put(ends(likely).distinct().join(sets.select("key"), "key", "left_anti"))
            if not unread.isEmpty():
                sets = sets.unionByName(fetch(unread))
            found = _put(_verify(likely, sets, join).filter("linked").select("a", "b"))
            judged = judged.unionByName(new)
            if not found.isEmpty():
                links = links.unionByName(found)
                parts = _put(connected(links))

        judged = pairs.select("a", "b")
        for turn in range(HUB_ROUNDS):
            judge(_hub_pairs(grouped(), leads, join, turn))
        judge(_open_pairs(grouped(), leads, fetch, join))

    named = _component(classes, "rep", parts).select("key", F.col("n").alias("n_shingles"), F.col("rep_comp").alias("component"))
    if plain:
        return named.select(F.col("key").cast(rows.schema["id"].dataType).alias(id_col), "n_shingles", F.col("component").cast(rows.schema["id"].dataType).alias("component_id"))
    ids = rows.select("key", "id")
    return (
        named.join(ids, "key").join(ids.select(F.col("key").alias("component"), F.col("id").alias("component_id")), "component")
        .select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("key").alias("row_key"), F.col("component").alias("component_key"))
    )
