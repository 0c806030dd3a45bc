"""N-gram Jaccard join: the links between documents whose shingle sets are alike, and the groups that the links make.

1. A document's shingles are hashed to 64 bits; documents with the same set are one class and go on as one member.
2. A member posts parts of its set. The hash range is cut into a little more parts than two sets that link can differ in shingles, so that
   some part is the same in both; its token is the hash of all the shingles in it, and of two unlike texts hardly any. With the parts ordered
   rare first, by their number of shingles and by a count sketch of a fixed size, a member posts its prefix: one more than a partner can lack.
   Any order that all members agree on gives the same links; what the sketch confuses costs time, not links. The number of parts goes by a range
   of set sizes from one power of two to the next, and a member whose partners may lie in the next range posts there too. One with too few parts
   to be sure shares a token with all such of its range. Below PARTS_FROM percent parts would be single shingles: a member then posts these, rare first.
3. Members that share a posted token are candidates if length, positional and suffix filters leave them a chance, and a
   bitmap filter too: with a parity bit for each of MARKS parts of the hash range, two sets differ in as many shingles at least as their
   bits differ. Filters are conditions of the join itself, but for bitmaps where a member meets one other only, and those of long texts. Each pair is verified once on whole sets.
4. Postings are grouped by token and band of set sizes; bands are so wide that only members of one band, or of two next to each
   other, can be alike. A token that one member posts, or two of sizes too far apart, goes no further than its count.
5. A group of near copies would make candidates by the square of its size, so links are found in rounds. In a star round each
   group pairs its members, and those of the band below, with one of them only; what that links becomes one component. That is all there is to tokens with two postings.
   The second star round has two such hubs for each part of a group whose parity bits agree in a stretch, as members of a wide group seldom link with any one. Star rounds go on while groups are large and new links are found. The last round pairs all members that share one of the other tokens and are still in different components. Each pair of
   candidates is thus verified, or connected by links that were, and no group needs a cap.

Verification routes each pair to the sets of both members; pairs are never collected, and components are found by rounds of
distributed joins. Shingles that many members post are counted with partial sums, and joins on them are split by Spark's skew
handling; no group is gathered in one task. Shingles, sets and ids are compared by 64-bit hashes.

Defined results: null and empty texts, and texts of blanks, have an empty set and link with nothing; with fewer words than a
shingle has, the whole sequence is the one shingle; rows with the same id are documents of their own; null ids are
never the smallest; other columns are ignored, whatever their names; an empty table gives an empty result. A very long text is
hashed in stretches of STRETCH bytes that overlap by a shingle, so that only its set, of 8 bytes a shingle, is held whole (a
single word that is longer than that takes some 30 bytes a byte while it is hashed).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import BLANK_RUN, BLANKS, released, stored, text_groups

if TYPE_CHECKING:
    import pyarrow as pa

#: Counters of the sketch, of one byte each when broadcast.
SKETCH = 1 << 21
#: Blocks in which partial sketches are added up, and levels per doubling of a count.
BLOCKS, LEVELS = 64, 4
#: Least similarity in percent for which members post parts of their sets, and levels by which each further shingle makes a part rarer.
PARTS_FROM, RARER = 75, 8
#: Bits of the bitmap that says which members' sets may be wanted.
BITS = 1 << 26
#: Star rounds at most, and the pairs a posting above which another one is worth it.
STAR_ROUNDS, CROWD = 2, 8
#: Shingles by which a member meets others in a star round but the first.
MEETINGS = 3
#: Bytes that are hashed together.
STRETCH = 1 << 19
#: Parity bits of a set, and of one of more than WIDE_FROM shingles, for which the former are too few.
MARKS, WIDE, WIDE_FROM = 512, 4096, 1000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit of x matters to each bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)
LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BLANK_AT, WORD_AT = re.compile(BLANK_RUN), re.compile("[^\\x20\\x09-\\x0D]+")


class Powers:
    """Powers of BASE and of its inverse, modulo 2 ** 64. Those for one stretch and a shingle are kept."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(self.up):
            return self.up, self.down
        one, most = np.ones(1, np.uint64), max(n, 2 * STRETCH)
        up = np.concatenate([one, np.cumprod(np.full(most - 1, BASE))])
        down = np.concatenate([one, np.cumprod(np.full(most - 1, np.uint64(pow(int(BASE), -1, 1 << 64))))])
        if most <= 2 * STRETCH:
            self.up, self.down = up, down
        return up, down


POWERS = Powers()


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct hashed shingles of each text, in ascending order.

    Texts are hashed together: blanks between words are made one, a running sum of letters times powers gives the polynomial
    hash of any stretch by one subtraction, and a shingle is the stretch from its first word's start to its last one's end.
    """
    raw = [(t or "").encode().lower() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    b = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(b):
        return []
    blank = BLANK[b]
    before = np.concatenate([[True], blank[:-1]])
    keep = ~(blank & before)
    c, blank, before = b[keep], blank[keep], before[keep]
    up, down = POWERS.to(len(c) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[np.where(blank, np.uint8(32), c)] * up[: len(c)])])
    start, end = np.flatnonzero(~blank & before), np.flatnonzero(blank)
    # Kept bytes, and so words, before each text's end.
    last = np.searchsorted(start, np.cumsum(keep)[ends - 1])
    first = np.concatenate([[0], last[:-1]])
    out = []
    for f, n in zip(first, last - first, strict=True):
        k = min(words, n)
        if k == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        s, e = start[f : f + n - k + 1], end[f + k - 1 : f + n]
        out.append(np.unique(mixed((sums[e] - sums[s]) * down[s])))
    return out


def stretches(text: str, words: int, limit: int = STRETCH) -> list[str]:
    """Parts of a text of about limit characters, cut at blanks, that hold each shingle whole: each goes words - 1 words into the next."""
    out, at = [], 0
    while True:
        cut = BLANK_AT.search(text, at + limit)
        if cut is None or not text[cut.start() :].strip(BLANKS):
            return [*out, text[at:]]
        end = cut.start()
        for _ in range(words - 1):
            word = WORD_AT.search(text, end)
            end = word.end() if word else len(text)
        out.append(text[at:end])
        at = cut.start()


def in_groups(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """shingle_sets() of an Arrow array of texts, some at a time, so that what is held beside them stays small."""
    for group in text_groups(texts, STRETCH):
        if len(group) == 1 and len(group[0]) > 2 * STRETCH:
            yield np.unique(np.concatenate([s for part in stretches(group[0], words) for s in shingle_sets([part], words)]))
        else:
            yield from shingle_sets(group, words)


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(20)) % np.uint64(SKETCH)


def prefix_size(n: int, percent: int) -> int:
    """Of n shingles in a common order, so many that a partner of that similarity shares one of them."""
    return n - -(-percent * n // 100) + 1


def signature(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(_doc, _n, _member) of each row, and the partial sketches (_block, _counts) of each task, from one pass over the texts."""

    def run(batches: Iterator):
        import pyarrow as pa

        counts = np.zeros(SKETCH, np.uint32)
        names = ["_doc", "_n", "_member", "_block", "_counts"]
        for b in batches:
            sizes, members = [], []
            for s in in_groups(b.column(1), words):
                np.add.at(counts, bucket(s).astype(np.int64), 1)
                sizes.append(len(s))
                members.append(member(s) if len(s) else None)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(members, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            parts = [packed(level(x)) for x in np.split(counts, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(BLOCKS, id_type), pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.int64()), pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    fed = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    id_type = to_arrow_type(fed.schema["_doc"].dataType)
    both = stored(fed.mapInArrow(run, f"_doc {fed.schema['_doc'].dataType.simpleString()}, _n bigint, _member bigint, _block int, _counts binary"))
    return both.filter(F.col("_block").isNull()).select("_doc", "_n", "_member"), both.filter(F.col("_block").isNotNull()).select("_block", "_counts")


def level(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that grow with their logarithm; 0 for none."""
    return np.ceil(LEVELS * np.log2(counts.astype(np.float64) + 1)).clip(0, 255).astype(np.uint8)


def packed(values: np.ndarray) -> bytes:
    """An array of bytes, compressed, as a small task leaves most counters at nothing."""
    import pyarrow as pa

    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, size: int = SKETCH // BLOCKS) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(raw, size, codec="zstd", asbytes=True), np.uint8)


def bits_of(raw: bytes) -> np.ndarray:
    rows = BITS // 32768 + 2
    return unpacked(raw, rows * 4096).reshape(rows, 4096)


def summed(partial: DataFrame) -> np.ndarray:
    """The levels of the whole corpus' counts: SKETCH bytes, whatever the input."""

    def add(batches: Iterator):
        import pyarrow as pa

        # A task's blocks arrive in order, so one sum is held at a time.
        at, held = None, None
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.exp2(unpacked(raw) / LEVELS) - 1
                if block != at:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(level(held))], pa.binary())], names=["_block", "_counts"])
                    at, held = block, np.zeros(len(x))
                held = held + x
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(level(held))], pa.binary())], names=["_block", "_counts"])

    schema = "_block int, _counts binary"
    # Sums are formed within each of some tasks first, then across them.
    spread = partial.withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(64)))
    once = spread.repartition("_block", "_task").sortWithinPartitions("_block").select("_block", "_counts").mapInArrow(add, schema)
    rows = once.repartition("_block").sortWithinPartitions("_block").mapInArrow(add, schema).collect()
    out = np.zeros((BLOCKS, SKETCH // BLOCKS), np.uint8)
    for r in rows:
        out[r["_block"]] = unpacked(r["_counts"])
    return out.reshape(-1)


def prefixes(docs: DataFrame, sketch, text_col: str, words: int, percent: int) -> DataFrame:
    """(_member, _size, _tokens, _lows, _marks, _wide): the tokens that each member posts, rarest first, and what its filters go by.

    _lows says, for each of them, how many of the member's shingles behind it are in the lower half of the hash range, or once for all parts how many of the set are; _marks holds the set's
    parity bits, and _wide more of them where the set is large. Copies post alike, so one row of each member is kept.
    """

    def make(batches: Iterator):
        import pyarrow as pa

        levels = unpacked(sketch.value, SKETCH)
        for b in batches:
            found = [posted(x, levels, percent) for x in in_groups(b.column(0), words)]
            found = [x for x in found if x]
            yield pa.RecordBatch.from_pydict({"_member": pa.array([x[0] for x in found], pa.int64()), "_size": pa.array([x[1] for x in found], pa.int32()), "_tokens": pa.array([x[2] for x in found], pa.list_(pa.int64())), "_lows": pa.array([x[3] for x in found], pa.list_(pa.int32())), "_marks": pa.array([x[4] for x in found], pa.list_(pa.int64())), "_wide": pa.array([x[5] for x in found], pa.list_(pa.int64()))})

    each = docs.select(F.col(text_col).alias("_text")).mapInArrow(make, "_member bigint, _size int, _tokens array<bigint>, _lows array<int>, _marks array<bigint>, _wide array<bigint>")
    return stored(each.dropDuplicates(["_member"]))


def bitmap(values: DataFrame, column: str) -> bytes:
    """A bitmap of BITS bits, whatever the input, with those of the values (taken modulo BITS) set; in rows of 4096 bytes, as Spark's functions count them.

    It is compressed, as each machine keeps copies of what is broadcast on disk.
    """
    place = F.pmod(column, F.lit(BITS)).cast("long")
    parts = values.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")).collect()
    bits = np.zeros((BITS // 32768 + 2, 4096), np.uint8)
    for r in parts:
        bits[r["_bucket"]] = np.frombuffer(r["_bits"], np.uint8)
    return packed(bits)


def is_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % BITS
    row, bit = np.where(at > 0, (at - 1) // 32768 + 1, 0), np.where(at > 0, (at - 1) % 32768, 0)
    return (bits[row, bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def live_postings(posts: DataFrame, percent: int) -> DataFrame:
    """(_token, _many, _member, _size, _band, _at, _low) of the tokens by which members might meet: those that more than two post (_many), or two of like sizes.

    Most tokens are posted once. Counting them shuffles nothing but tokens and sizes; a bitmap of fixed size then keeps most of the others
    from being shuffled with what the filters need, and a join the rest.
    """
    count = posts.select("_size", F.explode("_tokens").alias("_token")).groupBy("_token").agg(F.count(F.lit(1)).alias("_n"), F.min("_size").cast("long").alias("_lo"), F.max("_size").cast("long").alias("_hi"))
    shared = stored(count.filter((F.col("_n") > 2) | (F.col("_n") == 2) & (100 * F.col("_lo") >= percent * F.col("_hi"))).select("_token", (F.col("_n") > 2).alias("_many")))
    held = posts.sparkSession.sparkContext.broadcast(bitmap(shared, "_token"))

    def spread(batches: Iterator):
        import pyarrow as pa

        bits = bits_of(held.value)
        for b in batches:
            tokens = b.column(2).flatten().to_numpy()
            n = np.diff(b.column(2).offsets.to_numpy())
            keep = is_set(bits, tokens)
            at = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            rows = np.repeat(np.arange(b.num_rows), n)[keep]
            lows = b.column(3).flatten().to_numpy()
            # A part has no place: the whole set stands behind it.
            at, lows = (np.full(len(rows), -1), lows[rows]) if percent >= PARTS_FROM else (at[keep], lows[keep])
            each = [tokens[keep], b.column(0).to_numpy()[rows], b.column(1).to_numpy()[rows], at.astype(np.int32), lows]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, each)), names=["_token", "_member", "_size", "_at", "_low"])

    some = posts.select("_member", "_size", "_tokens", "_lows").mapInArrow(spread, "_token bigint, _member bigint, _size int, _at int, _low int")
    # A little wider than the ratio asked for, so that rounding parts no two sizes that may meet by more than one band.
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    return stored(some.join(shared, "_token").withColumn("_band", F.floor(F.log("_size") / width).cast("int")))


def posted(s: np.ndarray, levels: np.ndarray, percent: int):
    """(member, size, tokens, lows, marks, wide) of a set, or nothing of an empty one."""
    if not len(s):
        return None
    of = levels[bucket(s).astype(np.int64)]
    if percent >= PARTS_FROM:
        tokens, lows = part_tokens(s, of, percent), np.array([np.searchsorted(s, np.uint64(1 << 63))], np.int32)
    else:
        p, order = prefix_size(len(s), percent), np.lexsort((s, of))
        low = (s[order] >> np.uint64(63)) == 0
        tokens, lows = s[order[:p]], (low.sum() - np.cumsum(low[:p])).astype(np.int32)
    return member(s), len(s), tokens.view(np.int64), lows, parity(s, MARKS), parity(s, WIDE) if len(s) > WIDE_FROM else None


def part_tokens(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of the parts that a set posts, given the levels of its shingles; of two sets that link one token is the same.

    With n and m shingles they differ in (100 - percent) / (100 + percent) of n + m at most, and so in so many parts. Of all parts that they
    share take the first in the common order: before it stand no more than that many in either set, so both have posted it. If they share
    none, both have no more parts than that, and post the token of such sets.
    """
    n, out = len(s), []
    g = n.bit_length() - 1
    while percent << g <= 100 * n:  # the least size of the range is not too large for a partner
        top = (2 << g) - 1
        differ = (100 - percent) * (n + min(100 * n // percent, top)) // (100 + percent)
        if differ:  # else only the same set would do
            parts = 6 * ((100 - percent) * 2 * top // (100 + percent) + 1) // 5 + 2
            part = (s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            token = mixed(np.add.reduceat(s, at) + (part[at] + np.uint64((g << 32) + 1)) * BASE)
            rare = np.minimum.reduceat(levels, at).astype(np.int64) - RARER * (np.diff(at, append=n) - 1)
            out.append(token[np.lexsort((token, rare))[: differ + 1]])
            if len(at) <= differ:
                out.append(mixed(np.array([g << 32], np.uint64) * BASE))
        g += 1
    return np.concatenate([np.zeros(0, np.uint64), *out])


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def member(s: np.ndarray) -> int:
    return int.from_bytes(signature(s)[:8], "little", signed=True)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two postings of one token leave their members a chance: by length, by place, and by what stands behind.

    Members that alike have overlap * (100 + percent) >= percent * (sum of sizes). Two that post a shingle (a part stands at -1) share at most what
    stands before the earlier of its places, the shingle, and of what stands behind it the smaller count in each half of the hash range.
    """
    n, m = F.col(f"{a}._size").cast("long"), F.col(f"{b}._size").cast("long")
    i, j, low, down = (F.col(f"{x}.{c}") for c in ("_at", "_low") for x in (a, b))
    behind = F.least(low, down) + F.least(n - i - 1 - low, m - j - 1 - down)
    return (100 * n >= percent * m) & (100 * m >= percent * n) & ((F.least(i, j) + 1 + behind) * (100 + percent) >= percent * (n + m))


def like_bits(a: str, b: str, percent: int) -> Column:
    """Whether the parity bits of two members leave them a chance: alike, they differ in (100 - percent) / (100 + percent) of the sum of their sizes at most."""
    differ = sum((F.bit_count(F.get(f"{a}._marks", F.lit(k)).bitwiseXOR(F.get(f"{b}._marks", F.lit(k)))) for k in range(MARKS // 64)), F.lit(0))
    return differ * (100 + percent) <= (100 - percent) * (F.col(f"{a}._size").cast("long") + F.col(f"{b}._size"))


def whole_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(_member, _set) of the members in wanted (_member), each from the text of one of its documents; a task gives no member twice, but two tasks may.

    A bitmap of fixed size over hashed ids says which documents those may be; only their texts are hashed again.
    """
    one = rows.join(wanted, "_member", "left_semi").groupBy("_member").agg(F.min("_doc").alias("_doc"))
    held = docs.sparkSession.sparkContext.broadcast(bitmap(one.select(F.xxhash64("_doc").alias("_at")), "_at"))

    def make(batches: Iterator):
        import pyarrow as pa

        bits, seen = bits_of(held.value), set()
        for b in batches:
            texts = b.column(1).filter(pa.array(is_set(bits, b.column(0).to_numpy())))
            for i in range(0, len(texts), 500):
                found = []
                for s in in_groups(texts[i : i + 500], words):
                    if len(s) and (m := member(s)) not in seen:
                        if len(seen) < 1 << 18:
                            seen.add(m)
                        found.append((m, s.tobytes()))
                yield pa.RecordBatch.from_pydict({"_member": pa.array([m for m, _ in found], pa.int64()), "_set": pa.array([x for _, x in found], pa.binary())})

    return docs.select(F.xxhash64(id_col).alias("_at"), F.col(text_col).alias("_text")).mapInArrow(make, "_member bigint, _set binary").repartition("_member")


def still_likely(pairs: DataFrame, posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) but those whose bitmaps, or the wide ones of two large sets, differ too much."""
    ends = posts.select("_member", "_size", "_marks", "_wide")
    both = pairs.join(ends.withColumnRenamed("_member", "a").alias("x"), "a").join(ends.withColumnRenamed("_member", "b").alias("y"), "b")
    differ = F.aggregate(F.zip_with("x._wide", "y._wide", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    apart = differ * (100 + percent) > (100 - percent) * (F.col("x._size").cast("long") + F.col("y._size"))
    return both.filter(like_bits("x", "y", percent) & ~F.coalesce(apart, F.lit(False))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets are alike."""
    x, y = sets.select(F.col("_member").alias("a"), F.col("_set").alias("_x")), sets.select(F.col("_member").alias("b"), F.col("_set").alias("_y"))

    def make(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                at = np.searchsorted(t, s)
                common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "_x", "_y").mapInArrow(make, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), root being the smallest node of its component, by alternating large and small stars."""
    least = lambda e: e.groupBy("u").agg(F.min("v").alias("m"))
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        m = least(large)
        spread = large.join(m, "u")
        small = spread.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = stored(small)
        released(e.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def all_stars(e: DataFrame) -> bool:
    """Whether each node of the distinct edges (u, v), v being the smaller, has one edge down and none up, or only edges up: then v is the least node of u's component."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("_down"), F.lit(0).alias("_up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("_down"), F.lit(1).alias("_up")))
    return ends.groupBy("node").agg(F.sum("_down").alias("_down"), F.max("_up").alias("_up")).filter((F.col("_down") + F.col("_up") > 1) & (F.col("_down") > 0)).isEmpty()


def star_pairs(now: DataFrame, rnd: int, posts: DataFrame, percent: int) -> DataFrame:
    """Candidates of a star round: in each group the members, and those of the band below, with one of the group.

    From the second round on, members meet by some of their open shingles only, but two hubs in each of the group's parts too: members whose
    parity bits agree in one stretch. Near copies often do, so that whom they meet there is likely to link, though the group be wide. What
    neither these shingles nor these parts bring together is left to the last round.
    """
    if rnd:
        some = [F.min_by(F.struct("_token", "_at", "_low"), F.xxhash64("_token", F.lit(t))) for t in range(MEETINGS)]
        each = now.groupBy("_member", "_size", "_band", "_root").agg(F.array_distinct(F.array(*some)).alias("_some"))
        marked = each.join(posts.select("_member", "_marks"), "_member")
        # Half as many bits where sets are large, and more of them odd.
        stretch = [F.shiftrightunsigned(F.get("_marks", F.lit(k // 2)), 32 * (k % 2)).bitwiseAND(F.when(F.col("_size") > WIDE_FROM // 5, F.lit(0xFFFF)).otherwise(F.lit(0xFFFFFFFF))) for k in range(MARKS // 32)]
        parts = F.array(F.lit(0).cast("bigint"), *[F.xxhash64(F.lit(k), x) for k, x in enumerate(stretch)])
        now = marked.select("*", F.explode("_some").alias("_one")).select("_member", "_size", "_band", "_root", "_marks", "_one.*", F.explode(parts).alias("_part"))
    else:
        now = now.withColumn("_part", F.lit(0).cast("bigint"))
    one = F.struct("_member", "_size", "_at", "_low", "_root", *["_marks"] * bool(rnd))
    order = F.xxhash64("_root", "_member")
    picks = F.array(F.min_by(one, order), F.max_by(one, order)) if rnd else F.array(F.min_by(one, "_member"))
    picked = now.groupBy("_token", "_band", "_part").agg(F.array_distinct(picks).alias("_hubs")).withColumn("_hub", F.explode("_hubs"))
    hubs = picked.select("_token", "_part", F.explode(F.array("_band", F.col("_band") - 1)).alias("_band"), "_hub.*")
    chance = (F.col("p._root") != F.col("q._root")) & may_link("p", "q", percent)
    return paired(now, hubs, (F.col("p._band") == F.col("q._band")) & (F.col("p._part") == F.col("q._part")), chance & like_bits("p", "q", percent) if rnd else chance)


def open_pairs(now: DataFrame, posts: DataFrame, percent: int) -> DataFrame:
    """Candidates of the last round: all members of one group, or of two next to each other, with different roots."""
    marked = stored(now.join(posts.select("_member", "_marks"), "_member"))
    chance = may_link("p", "q", percent) & like_bits("p", "q", percent)
    same = paired(marked, marked, F.col("p._band") == F.col("q._band"), (F.col("p._root") < F.col("q._root")) & chance)
    near = paired(marked, marked, F.col("p._band") == F.col("q._band") + 1, (F.col("p._root") != F.col("q._root")) & chance)
    return same.unionByName(near).distinct()


def paired(p: DataFrame, q: DataFrame, bands: Column, chance: Column) -> DataFrame:
    met = p.alias("p").join(q.alias("q"), (F.col("p._token") == F.col("q._token")) & bands).filter(chance)
    return met.select(F.least("p._member", "q._member").alias("a"), F.greatest("p._member", "q._member").alias("b")).distinct()


def still_open(live: DataFrame, roots: DataFrame) -> DataFrame:
    """live with _root, of the shingles of more than two postings whose members are not all in one component."""
    rooted = live.filter("_many").join(roots.withColumnRenamed("node", "_member"), "_member", "left").withColumn("_root", F.coalesce("root", "_member")).drop("root")
    open_ = rooted.groupBy("_token").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi")).filter("_lo < _hi").select("_token")
    return stored(rooted.join(open_, "_token", "left_semi"))


def crowded(now: DataFrame) -> bool:
    """Whether the last round would look at more than CROWD pairs a posting."""
    n = F.col("_n")
    total = now.groupBy("_token", "_band").agg(F.count(F.lit(1)).cast("double").alias("_n")).agg(F.sum(n), F.sum(n * (n - 1) / 2)).first()
    return bool(total[0]) and total[1] > CROWD * total[0]


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(_doc, n_shingles, component_id) for each row of docs: component_id is the smallest id that links lead to, its own included.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of distinct shingles of so many words.
    """
    spark = docs.sparkSession
    rows, partial = signed(docs, id_col, text_col, words)
    sketch = spark.sparkContext.broadcast(packed(summed(partial)))
    posts = prefixes(docs, sketch, text_col, words, percent)
    live = live_postings(posts, percent)
    roots = spark.createDataFrame([], "node bigint, root bigint")
    tried = spark.createDataFrame([], "a bigint, b bigint")
    rnd, last, now = 0, False, live.withColumn("_root", F.col("_member"))
    while True:
        released(spark)
        pairs = open_pairs(now, posts, percent) if last else star_pairs(now, rnd, posts, percent)
        if rnd:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(still_likely(pairs, posts, percent))
        tried = tried.unionByName(pairs)
        wanted = pairs.select(F.col("a").alias("_member")).unionByName(pairs.select(F.col("b").alias("_member"))).distinct()
        found = tried.limit(0)
        if not pairs.isEmpty():
            # Both sides of the pairs read the same exchange of sets.
            found = stored(verified(pairs, whole_sets(docs, rows, wanted, id_col, text_col, words), percent).distinct())
        more = not found.isEmpty()
        if more:
            # To the end, as members that still had different roots would meet again in the next round. The components so far are stars.
            roots = stored(components(roots.toDF("a", "b").unionByName(found)))
        if last:
            break
        rnd += 1
        now = still_open(live, roots)
        last = rnd == STAR_ROUNDS or not more or not crowded(now)
    classed = rows.join(roots.withColumnRenamed("node", "_member"), "_member", "left").withColumn("_root", F.coalesce("root", "_member"))
    lowest = classed.filter("_root is not null").groupBy("_root").agg(F.min("_doc").alias("_least"))
    return classed.join(lowest, "_root", "left").select("_doc", F.col("_n").alias("n_shingles"), F.coalesce("_least", "_doc").alias("component_id"))
