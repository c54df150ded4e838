"""Near-duplicate texts: n-gram Jaccard join by chosen paths.

A text's set holds its shingles of ``SHINGLE`` words (a shorter text: all its
words as one shingle).  Links are pairs of texts with Jaccard similarity of at
least 0.8.

Method.  A run splits the sets on sampled shared tokens: set x chooses token t
where a hash of (run, level, t) is below ``BRANCH / |x|``, and goes into the
bucket of every token it chooses; a pair of similar sets chooses a common one
with probability at least 1 - exp(-0.8 BRANCH).  A bucket of more than
``LIMIT`` sets is split again by the next level's tokens, down to ``LEVELS``
tokens, unless that hardly shrinks it; small buckets are compared by brute
force.  As many runs are made as ``RECALL`` asks for: a pair with a common
bucket that is split needs a common token on up to ``LEVELS`` levels in one
run, so the members of split buckets make ``more_runs`` besides.  Similarities
are exact.

Scale.
* Equal sets are one representative with a weight, so copies are never paired.
* Buckets hold 8-byte keys; a bucket with the same members as another one is
  dropped, and only members of shared buckets send their sets, those of one
  block together and compressed.
* A bucket of more sets than a block holds becomes one bucket for every two
  neighbouring classes of set sizes: similar sets differ by a quarter at most.
* A bucket of many sets is compared as pairs of blocks of bounded size; a pair
  of texts is counted only in the first bucket that both are in.  Blocks do
  not emit pairs: each member sends the weight of its links and one edge of a
  spanning forest, so rows grow with members, not with their square.
* Classes are connected components, by alternating stars.

Defined cases: NULL text is empty; texts without words are one class; repeated
rows are copies; NULL ids count as members and are never a class id unless all
are NULL; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.components import components
from churnscope.llm.storage import keyed, stored
from churnscope.llm.text_arrays import column_bytes, mix, slices, words

SHINGLE = 5
BRANCH = 1.5
RECALL = 0.99999
LEVELS = 3
LIMIT = 8192
BLOCK_SETS = 3072
BLOCK_TOKENS = 1 << 20
SIZE_STEP = 1.26  # over 1 / 0.8, so that rounding parts no similar pair
TOKEN_BYTES = 5  # of a token in the sets that are compared
SLICE_BYTES = 1 << 20
_U = np.uint64


def runs(recall: float = RECALL) -> int:
    """Half of the allowed miss is for pairs without a common first bucket."""
    return math.ceil(math.log((1 - recall) / 2) / (-0.8 * BRANCH))


def more_runs(recall: float = RECALL) -> int:
    """Further runs of the members of split buckets, the other half being for
    pairs that no run keeps together on all levels."""
    kept = (1 - math.exp(-0.8 * BRANCH)) ** LEVELS
    return max(0, math.ceil(math.log((1 - recall) / 2) / math.log1p(-kept)) - runs(recall))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all sets, sorted within each; n+1 offsets)."""
    hashes, ends = words(data, offsets)
    size = np.diff(ends)
    count = np.where(size >= SHINGLE, size - SHINGLE + 1, (size > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(size)), count)
    first = ends[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    token = np.zeros(len(doc), _U)
    padded = np.concatenate((hashes, np.zeros(SHINGLE, _U)))
    for k in range(SHINGLE):
        inside = first + k < ends[1:][doc]
        token = mix(token * _U(0x9E3779B97F4A7C15) + np.where(inside, padded[first + k], _U(k + 1)))
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(np.bincount(doc[keep], minlength=len(size)), out=out[1:])
    return token[keep], out


def pack_set(token: np.ndarray) -> bytes:
    """A set as sorted differences of 40-bit tokens, one after the other.  Two
    of n tokens fall together with probability n^2 / 2^41."""
    short = np.sort(token >> _U(64 - 8 * TOKEN_BYTES))
    return np.diff(short, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def turned(raw: bytes) -> bytes:
    """The same byte plane by byte plane, which is smaller for a set alone."""
    return np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES).T.tobytes()


def unpack_set(raw: bytes, rows: bool) -> np.ndarray:
    parts = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    flat = np.frombuffer(raw, np.uint8)
    parts[:, :TOKEN_BYTES] = flat.reshape(-1, TOKEN_BYTES) if rows else flat.reshape(TOKEN_BYTES, -1).T
    return np.cumsum(parts.view("<u8").ravel(), dtype=_U)


def chosen(token: np.ndarray, offsets: np.ndarray, n_runs: int, first: int = 0) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """[run][level] -> (document, token) pairs that are chosen there, of runs
    from number ``first``."""
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)
    bar = np.minimum(BRANCH / np.maximum(size, 1), 1.0)[doc] * 2.0**32
    out = []
    for run in range(first, first + n_runs):
        levels = []
        for level in range(0, LEVELS, 2):  # a hash gives 32 bits to each of two levels
            h = mix(token ^ mix(np.array([run * 64 + level + 1], _U)))
            for half in (h >> _U(32), h & _U(0xFFFFFFFF)):
                at = np.flatnonzero(half < bar)
                levels.append((doc[at], token[at]))
        out.append(levels[:LEVELS])
    return out


_SETS = "doc_id long, row_key long, k1 long, k2 long, n long, chosen array<array<bigint>>, deeper array<array<int>>"


def _lists(chosen_: list[tuple[np.ndarray, np.ndarray]], n: int, short: bool = False) -> pa.Array:
    """Per document, its tokens of each of some choices; ``short``: their upper
    halves, as two tokens under one name only make a bucket larger."""
    m = len(chosen_)
    cuts = [np.searchsorted(doc, np.arange(n + 1)) for doc, _ in chosen_]
    sizes = np.stack([np.diff(c) for c in cuts], axis=1).ravel()  # by document, then choice
    at = np.concatenate([np.repeat(np.arange(n) * m + k, np.diff(c)) for k, c in enumerate(cuts)])
    values = np.concatenate([token for _, token in chosen_])
    values = (values >> _U(32)).astype(np.uint32).view(np.int32) if short else values.view(np.int64)
    values = values[np.argsort(at, kind="stable")]
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))
    return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * m).astype(np.int32)), inner)


def _describe(n_runs: int, first: int = 0):
    """Identity of each set (two sums over its tokens, size) and the chosen
    tokens: chosen[run] on the first level, deeper[run * (LEVELS - 1) + level]
    on the next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                token, offsets = shingle_sets(*column_bytes(part.column("text")))
                n = part.num_rows
                sums = []
                for values in (token, mix(token ^ _U(0x2545F4914F6CDD1D))):
                    total = np.concatenate((np.zeros(1, _U), np.cumsum(values, dtype=_U)))
                    sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
                picked = chosen(token, offsets, n_runs, first)
                top, deeper = [levels[0] for levels in picked], [some for levels in picked for some in levels[1:]]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("row_key"), pa.array(sums[0]), pa.array(sums[1]), pa.array(np.diff(offsets)),
                        _lists(top, n), _lists(deeper, n, short=True),
                    ],
                    ["doc_id", "row_key", "k1", "k2", "n", "chosen", "deeper"],
                )

    return run


def _shared(level: DataFrame) -> DataFrame:
    """The rows of buckets of several sets, with how many sets and tokens their
    bucket has and two sums over its members."""
    same = Window.partitionBy("bucket")
    rows = level.withColumn("members", F.count(F.lit(1)).over(same)).where("members > 1")
    return rows.select(
        "*", F.sum("n").over(same).alias("tokens"),
        F.bit_xor(F.xxhash64("rep")).over(same).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), F.col("rep"))).over(same).alias("b"),
    )


def _size_bands(level: DataFrame) -> DataFrame:
    """Each bucket as one for every two neighbouring classes of set sizes.  Sizes
    of similar sets differ by a factor of at most 1.25, a class spans a little
    more, so a similar pair meets in a band."""
    size_class = F.floor(F.log("n") / math.log(SIZE_STEP))
    bands = level.select("rep", "n", "run", "bucket", F.explode(F.array(size_class, size_class + 1)).alias("band"))
    return bands.withColumn("bucket", F.xxhash64("bucket", "band")).drop("band")


def _buckets(sets: DataFrame, first: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """(bucket, rep, n, members, tokens): the buckets that are compared, with
    their members, and how many sets and tokens they have; and (rep), the members
    of buckets that were split, if any were.  ``first`` is the first run's number."""
    level = sets.select("rep", "n", F.posexplode("chosen").alias("run", "tokens"))
    level = level.select("rep", "n", "run", F.explode("tokens").alias("token")).select(
        "rep", "n", "run", F.xxhash64(F.col("run") + first, "token").alias("bucket")
    )
    ready, split = [], None
    for depth in range(1, LEVELS + 1):
        level = stored(_shared(level), "path-level")
        if depth == 1:
            wide = (F.col("members") > BLOCK_SETS) | (F.col("tokens") > BLOCK_TOKENS)
            level = level.where(~wide).unionByName(stored(_shared(_size_bands(level.where(wide))), "size-bands"))
        # buckets with the same members: one is enough
        small = level.where(F.col("members") <= LIMIT) if depth < LEVELS else level
        one = small.groupBy("members", "tokens", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket")
        ready.append(small.join(one, "bucket").select("bucket", "rep", "n", "members", "tokens"))
        parents = level.where(F.col("members") > LIMIT)
        if depth == LEVELS or not parents.limit(1).count():
            break
        if depth == 1:  # the members of large buckets take the tokens of their run along
            later = F.slice("deeper", F.col("run") * (LEVELS - 1) + 1, F.lit(LEVELS - 1)).alias("deeper")
            parents = parents.join(sets.select("rep", "deeper"), "rep").select("bucket", "rep", "n", "members", "tokens", later)
        parents = stored(parents, "large-members")
        big = parents.groupBy("bucket").agg(F.first("members").alias("members"))
        child = parents.select("rep", "n", F.col("bucket").alias("parent"), "deeper", F.explode(F.col("deeper")[depth - 1]).alias("token"))
        child = stored(child.withColumn("bucket", F.xxhash64("parent", "token")).drop("token"), "path-children")
        largest = child.groupBy("parent", "bucket").agg(F.count(F.lit(1)).alias("k")).groupBy("parent").agg(F.max("k").alias("k"))
        dense = big.join(largest, big["bucket"] == largest["parent"], "left").where(
            F.coalesce(F.col("k"), F.lit(0)) * 2 > F.col("members")
        ).select("bucket")
        dense = stored(dense, "dense-buckets")
        ready.append(parents.join(dense, "bucket", "left_semi").select("bucket", "rep", "n", "members", "tokens"))
        if split is None:  # members of buckets split deeper are among them
            split = parents.join(dense, "bucket", "left_anti").select("rep").distinct()
        level = child.join(dense.withColumnRenamed("bucket", "parent"), "parent", "left_anti").select("rep", "n", "bucket", "deeper")
    members = ready[0]
    for more in ready[1:]:
        members = members.unionByName(more)
    return members, split


def _shares(members: DataFrame) -> DataFrame:
    """(bucket, rep, rest, rest_blocks, first_blocks): how each bucket is
    compared.

    Buckets are ordered, larger ones first, by a new number of theirs.  Members
    whose first bucket is the same earlier one were compared there; the largest
    such part of a bucket is only compared with the ``rest``.  A bucket without
    a rest adds no pair and goes.  (Two buckets of one size with equal 40-bit
    hashes would become one, which only adds comparisons.)"""
    most = (1 << 23) - 1
    number = F.shiftleft(F.lit(most) - F.least(F.col("members"), F.lit(most)), 40).bitwiseOR(
        F.col("bucket").bitwiseAND(F.lit((1 << 40) - 1))
    )
    first = F.min("bucket").over(Window.partitionBy("rep"))  # of the few buckets of a set
    rows = stored(members.select(number.alias("bucket"), "rep", "n").withColumn("first", first), "ordered-buckets")
    parts = rows.groupBy("bucket", "first").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"))
    largest = parts.where("first <> bucket").groupBy("bucket").agg(F.max(F.struct("k", "t", "first")).alias("largest"))
    whole = parts.groupBy("bucket").agg(F.sum("k").alias("k"), F.sum("t").alias("t"))
    blocks = lambda k, t: F.greatest(F.ceil(k / BLOCK_SETS), F.ceil(t / BLOCK_TOKENS)).cast("int")
    had = lambda c: F.coalesce(F.col(f"largest.{c}"), F.lit(0))
    plan = whole.join(largest, "bucket", "left").where(F.col("k") > had("k")).select(
        "bucket", F.col("largest.first").alias("known"), blocks(F.col("k"), F.col("t")).alias("all_blocks"),
        blocks(F.col("k") - had("k"), F.col("t") - had("t")).alias("rest_blocks"), blocks(had("k"), had("t")).alias("first_blocks"),
    )
    small = F.col("all_blocks") <= 1  # then all members meet in one task
    return rows.join(plan, "bucket").select(
        "bucket", "rep", (small | ~F.col("first").eqNullSafe(F.col("known"))).alias("rest"),
        F.when(small, 1).otherwise(F.col("rest_blocks")).alias("rest_blocks"), F.when(small, 0).otherwise(F.col("first_blocks")).alias("first_blocks"),
    )


_PACK = "bucket long, i int, j int, block int, reps binary, weights binary, sizes binary, n_earlier binary, sets binary"


def _block_pairs(b: dict, mine: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, own block) of the comparisons that a member takes part in.  Blocks
    0.. are the rest's, those after them the largest known part's, which are not
    compared with each other."""
    rest, known = b["rest_blocks"], b["first_blocks"]
    if b["rest"]:
        block = mine % rest
        for other in range(rest + known):
            yield min(block, other), max(block, other), block
    else:
        block = rest + mine % known
        for other in range(rest):
            yield other, block, block


def _pack_members(members: list[tuple[int, int, bytes, np.ndarray]]) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """Identities, weights, set sizes, numbers of earlier buckets, and the sets
    with these buckets.  Members of one bucket share tokens, which compression
    finds among several of them."""
    reps, weights, packed, earlier = zip(*members)
    sizes = np.array([len(p) for p in packed], np.int32) // TOKEN_BYTES
    body = b"".join([*packed, *[e.tobytes() for e in earlier]])
    if len(members) > 1:
        body = pa.compress(body, codec="zstd", asbytes=True)
    n_earlier = np.array([len(e) for e in earlier], np.int32)
    return np.array(reps, np.int64).tobytes(), np.array(weights, np.int64).tobytes(), sizes.tobytes(), n_earlier.tobytes(), body


def _unpack_members(sizes: bytes, n_earlier: bytes, body: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sets and the earlier buckets of a pack's members."""
    size, count = np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(n_earlier, np.int32)
    ends = np.cumsum(size) * TOKEN_BYTES
    if len(size) > 1:
        body = pa.decompress(body, decompressed_size=int(ends[-1] + 8 * count.sum()), codec="zstd", asbytes=True)
    sets = [unpack_set(body[a:b], rows=len(size) > 1) for a, b in zip(ends - size * TOKEN_BYTES, ends)]
    return sets, np.split(np.frombuffer(body[ends[-1] :], np.int64), np.cumsum(count)[:-1])


def _send_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts' sets to the comparisons of their buckets, those of a block in
    one row as far as a task holds them at once."""
    names = [f.split(" ")[0] for f in _PACK.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
    waiting: dict[tuple[int, int], tuple[list, list]] = {}  # (bucket, block): comparisons, members

    def packs() -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for (bucket, block), (pairs, members) in waiting.items():
            pack = _pack_members([(rep, weight, raw if len(members) > 1 else turned(raw), numbers[numbers < bucket]) for rep, weight, raw, numbers in members])
            out += [(bucket, i, j, block, *pack) for i, j in pairs]
            size += len(pairs) * sum(map(len, pack))
            if size > 4 * SLICE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        waiting.clear()

    held = 0
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES // 2):
            token, offsets = shingle_sets(*column_bytes(part.column("text")))
            columns = zip(part.column("rep").to_pylist(), part.column("weight").to_pylist(), part.column("buckets").to_pylist())
            for at, (rep, weight, buckets) in enumerate(columns):
                raw = pack_set(token[offsets[at] : offsets[at + 1]])
                numbers = np.sort(np.array([b["bucket"] for b in buckets], np.int64))
                mine = int(mix(np.array([rep], np.int64).view(_U))[0])
                for b in buckets:
                    pairs = list(_block_pairs(b, mine))
                    key = b["bucket"], pairs[0][2]
                    waiting.setdefault(key, ([(i, j) for i, j, _ in pairs], []))[1].append((rep, weight, raw, numbers))
                held += len(raw) + numbers.nbytes + 256 * len(buckets)
            if held > 8 * SLICE_BYTES:
                yield from packs()
                held = 0
    yield from packs()


def _common(lists: list[np.ndarray], split: int) -> np.ndarray:
    """How many values each list of the first ``split`` shares with each of the
    rest (all with all if split is 0)."""
    owner = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
    values, place, count = np.unique(np.concatenate(lists) if lists else np.zeros(0), return_inverse=True, return_counts=True)
    shared = count > 1
    use = shared[place]
    column = (np.cumsum(shared) - 1)[place[use]]
    owner, width = owner[use], int(shared.sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    a, b = (len(lists), slice(None)) if not split else (split, slice(split, None))
    total = np.zeros((a, len(lists) - split if split else len(lists)), np.float32)
    step = 1024
    cuts = np.searchsorted(column, np.arange(0, width + step, step))
    for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
        dense = np.zeros((len(lists), min(step, width - k * step)), np.float32)
        dense[owner[low:high], column[low:high] - k * step] = 1
        total += dense[:a] @ dense[b].T
    return total


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """(rep, links, to): weight of the links of each member counted here, and
    the smallest member of its component among them."""
    same = group["i"].iloc[0] == group["j"].iloc[0]
    rep, weight = (np.concatenate([np.frombuffer(raw, np.int64) for raw in group[c]]) for c in ("reps", "weights"))
    block = np.repeat(group["block"].to_numpy(), group["reps"].map(len) // 8)
    order = np.lexsort((rep, block))
    order = order[np.diff(rep[order], prepend=~rep[order[:1]]) != 0]  # repeated rows sent theirs twice
    left = 0 if same else int((block[order] == group["i"].iloc[0]).sum())
    nothing = pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
    if len(order) < 2 or (not same and left in (0, len(order))):
        return nothing
    packs = [_unpack_members(*p) for p in zip(group["sizes"], group["n_earlier"], group["sets"])]
    sets, others = ([x for p in packs for x in p[k]] for k in (0, 1))
    sets, others, rep, weight = [sets[k] for k in order], [others[k] for k in order], rep[order], weight[order]
    size = np.array([len(s) for s in sets])
    rows, cols = (slice(None), slice(None)) if same else (slice(0, left), slice(left, None))
    link = _common(sets, left)
    # |a & b| / |a | b| >= 0.8, row by row: the matrix stays small
    link = np.stack([9 * shared.astype(np.int64) >= 4 * (a + size[cols]) for a, shared in zip(size[rows], link)])
    link &= _common(others, left) == 0  # counted in the first common bucket
    if same:
        np.fill_diagonal(link, False)
    if not link.any():
        return nothing
    links, to, most = np.zeros(len(rep), np.int64), rep.copy(), np.iinfo(np.int64).max
    parts = [slice(k, k + 128) for k in range(0, len(link), 128)]  # of the rows: as numbers, the whole matrix is large
    for part in parts:
        links[rows][part] += link[part] @ weight[cols]
        if not same:
            links[cols] += link[part].T @ weight[rows][part]
    while True:
        least = to.copy()
        for part in parts:
            least[rows][part] = np.minimum(least[rows][part], np.where(link[part], to[cols], most).min(axis=1))
            if not same:
                least[cols] = np.minimum(least[cols], np.where(link[part], to[rows][part][:, None], most).min(axis=0))
        if (least == to).all():
            break
        to = least
    use = links > 0
    return pd.DataFrame({"rep": rep[use], "links": links[use], "to": to[use]})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, class_key, class_id, class_size, copies, n_links) per
    row: the class of near duplicates and its smallest id, how many rows have
    the same set, and how many other rows are similar to this one."""
    n_runs = runs()
    own = keyed(docs, id_col, text_col)
    described = stored(own.select("doc_id", "row_key", "text").mapInArrow(_describe(n_runs), _SETS), "shingle-sets")
    key = ["k1", "k2", "n"]
    reps = stored(
        described.groupBy(*key).agg(F.min("row_key").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("least")),
        "set-representatives",
    )
    rows = described.select(F.col("row_key").alias("rep"), "chosen", "deeper").join(reps.where("n > 0").select("rep", "n"), "rep")
    repeated = described.groupBy("row_key").count().where("count > 1").limit(1).count()  # rows that repeat id and text
    if repeated:
        rows = rows.dropDuplicates(["rep"])
    members, split = _buckets(rows)
    if split is not None and (extra := more_runs()):
        split = stored(split.join(reps.select("rep", "n"), "rep"), "split-sets")
        texts = own.join(split.select(F.col("rep").alias("row_key")), "row_key", "left_semi")
        if repeated:
            texts = texts.dropDuplicates(["row_key"])
        again = texts.select("doc_id", "row_key", "text").mapInArrow(_describe(extra, n_runs), _SETS)
        again = stored(again.select(F.col("row_key").alias("rep"), "n", "chosen", "deeper"), "more-runs")
        members = members.unionByName(_buckets(again, n_runs)[0])
    shares = stored(_shares(members), "bucket-shares")
    lists = shares.groupBy("rep").agg(
        F.collect_list(F.struct("bucket", "rest", "rest_blocks", "first_blocks")).alias("buckets")
    ).join(reps.select("rep", "weight"), "rep")
    wanted = own.select(F.col("row_key").alias("rep"), "text").join(lists, "rep")
    compared = stored(
        wanted.mapInArrow(_send_sets, _PACK).groupBy("bucket", "i", "j").applyInPandas(_compare, "rep long, links long, to long"), "links"
    )
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(compared.select(F.col("rep").alias("u"), F.col("to").alias("v")))
    labelled = (
        reps.join(links, "rep", "left")
        .join(roots.select(F.col("u").alias("rep"), "root"), "rep", "left")
        .select(*key, "weight", "least", F.coalesce("root", "rep").alias("class_key"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    labelled = stored(labelled, "set-classes")
    classes = labelled.groupBy("class_key").agg(F.min("least").alias("class_id"), F.sum("weight").alias("class_size"))
    result = labelled.join(classes, "class_key").select(
        *key, "class_key", "class_id", "class_size", F.col("weight").alias("copies"), (F.col("weight") - 1 + F.col("links")).alias("n_links")
    )
    return described.select("doc_id", "row_key", *key).join(result, key).drop(*key)
