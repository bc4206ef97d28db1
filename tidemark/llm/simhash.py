"""Near-duplicates by SimHash, compared in bit-sliced form.

Fingerprints are 64 bits, a majority vote over the XXH64 of word shingles. Equal fingerprints
meet in one row first, so that copies never multiply work. Distinct fingerprints within the radius
agree wholly on some bands of bits (pigeonhole), so each is dealt to one bucket for each choice of
bands; how many bands there are follows from the number of fingerprints, and any number finds every
link. In a bucket, bit planes are stored vertically (one machine word holds one bit of 64
fingerprints); distances to a fingerprint are counted by carry-save bitwise counters, and a block
of words is abandoned as soon as all of its counters exceed the radius. A bucket hands on a
spanning forest and not its pairs. Buckets above ``block`` rows are split into blocks, and each pair
of blocks is a task of its own: whole, and never more than two blocks in memory."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Carried, by_salt, column_bytes, lean, pick, with_least, written
from tidemark.llm.components import components

BITS, SEED = 64, 42
BLOCK = 4096
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
PAIRS = 1 << 15  # machine words of counters worked on at once


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0; fewer than a shingle: the whole sequence is one."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return digest(b" ".join(w), seed)
    join = b" ".join
    h = np.fromiter((digest(join(s), seed) for s in zip(*(w[i:] for i in range(shingle)), strict=False)), np.uint64, len(w) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """The hashes of the distinct shingles, in order; no words: none; fewer than a shingle: the whole sequence is one."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    found = {join(w)} if len(w) <= shingle else set(map(join, zip(*(w[i:] for i in range(shingle)), strict=False)))
    return np.unique(np.fromiter((digest(x, SEED) for x in found), np.uint64, len(found)))


def set_key(h: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    import xxhash

    return xxhash.xxh128_digest(h.tobytes(), SEED)


def wide_fingerprint(h: np.ndarray, words: int) -> bytes:
    """A fingerprint of 64 ``words`` bits over the distinct shingles, each word from its own mix of the shingle's hash."""
    if not len(h):
        return bytes(8 * words)
    out = np.zeros(words, np.uint64)
    for k in range(words):
        m = h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)
        m = (m ^ (m >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        m = (m ^ (m >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        m ^= m >> np.uint64(31)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(m), 1 << 16):
            ones += np.unpackbits(m[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(m), bitorder="little").view(np.uint64)[0]
    return out.tobytes()


def with_fingerprint(df: DataFrame, text: str, out: str = "fp", shingle: int = 4, words: int = 1) -> DataFrame:
    """The table's columns but the text, and the fingerprint: a long of 64 bits, or binary if it is of more words than one, then with ``s``, the key of the set of shingles."""
    import pyarrow as pa

    keep = [c for c in df.columns if c != text]
    schema = df.select(*keep).withColumn(out, F.lit(0).cast("long") if words == 1 else F.lit(b"").cast("binary"))
    schema = (schema if words == 1 else schema.withColumn("s", F.lit(b"").cast("binary"))).schema

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            memory: dict = {}
            found = []
            for t in column_bytes(b, text):
                fp = memory.get(t)
                if fp is None:
                    if words == 1:
                        fp = fingerprint(t, shingle)
                    else:
                        h = shingles(t, shingle)
                        fp = wide_fingerprint(h, words), set_key(h)
                    memory[t] = fp
                found.append(fp)
            made = [pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())] if words == 1 else [pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + made, names=[*keep, out] + ["s"] * (words > 1))

    return df.mapInArrow(lean(run), schema)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes, bits x words, of rows of machine words: bit j of word i of plane k is bit k of row 64 i + j. The tail repeats the last row."""
    n = -(-len(fps) // 64) * 64
    full = np.concatenate([fps, np.repeat(fps[-1:], n - len(fps), axis=0)]) if n > len(fps) else fps
    bits = np.unpackbits(np.ascontiguousarray(full).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")  # rows x bits
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(planes: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``fps``, the positions in ``planes`` within the radius.

    A machine word of a plane holds that bit of 64 fingerprints, so one operation updates 64
    distances; differing bits of three planes go through a carry-save adder into a vertical counter
    that overflows above the radius. Words in which all 64 have overflowed are abandoned."""
    bits, words = planes.shape
    levels = max(2, int(radius).bit_length())
    start = (1 << levels) - 1 - radius  # the top level overflows at radius + 1
    # half of the bits of unlike fingerprints differ: a first look pays when nearly all have overflowed
    first = min(bits, -(-max(12, 9 * radius // 4) // 3) * 3)
    stride = max(6, bits // 24 * 3)
    order = np.argsort(np.abs(planes_balance(planes)), kind="stable")  # the most even planes tell most apart
    own = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")[:, order]
    flips = np.where(own.T.astype(bool), FULL, np.uint64(0))  # bits x rows
    planes = planes[order]
    step = max(1, PAIRS // max(words, 1))
    for at in range(0, len(fps), step):
        for w0 in range(0, words, PAIRS):
            block, flip = planes[:, w0 : w0 + PAIRS], flips[:, at : at + step]
            shape = (flip.shape[1], block.shape[1])
            counter = [np.full(shape, FULL if start >> k & 1 else 0, np.uint64) for k in range(levels)]
            over = np.zeros(shape, np.uint64)
            for k in range(0, first, 3):
                over |= counted(counter, *(block[k + j][None, :] ^ flip[k + j][:, None] if k + j < bits else np.zeros(shape, np.uint64) for j in range(3)))
            q, w = np.nonzero(over != FULL)
            over, counter = over[q, w], [c[q, w] for c in counter]
            for k in range(first, bits, 3):
                if not len(q):
                    break
                over |= counted(counter, *(block[k + j][w] ^ flip[k + j][q] if k + j < bits else np.zeros(len(q), np.uint64) for j in range(3)))
                if (k - first) % stride == 0:
                    left = over != FULL
                    q, w, over, counter = q[left], w[left], over[left], [c[left] for c in counter]
            if len(q):
                rows, bit = np.nonzero((~over[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
                q, found = q[rows] + at, (w[rows] + w0) * 64 + bit
                cuts = np.nonzero(np.diff(q))[0] + 1
                for i, js in zip(q[np.concatenate([[0], cuts])] if len(q) else (), np.split(found, cuts), strict=False):
                    yield int(i), js


def counted(counter: list[np.ndarray], x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Adds three planes of differing bits to the vertical counter; returns where it overflowed."""
    xy = x ^ y
    one, two = xy ^ z, (x & y) | (xy & z)
    for level, c in enumerate(counter):
        counter[level], one = c ^ one, c & one
    for level in range(1, len(counter)):
        c = counter[level]
        counter[level], two = c ^ two, c & two
    return one | two


def planes_balance(planes: np.ndarray) -> np.ndarray:
    """How far each plane is from as many ones as zeros."""
    ones = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    return ones * 2 - planes.shape[1] * 64


class Forest:
    """Union-find over positions; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, others: np.ndarray) -> None:
        roots = self.up[others]
        while True:
            higher = self.up[roots]
            if np.array_equal(higher, roots):
                break
            roots = higher
        every = np.unique(np.append(roots, self.root(i)))
        self.up[every] = every[0]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        up = self.up
        while True:
            higher = up[up]
            if np.array_equal(higher, up):
                break
            up = higher
        below = np.nonzero(up != np.arange(len(up)))[0]
        return below, up[below]


def forest_of(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as rows) of a forest that joins what lies within the radius: inside ``left``, or between left and right."""
    if right is None:
        trees, planes = Forest(len(left)), planes_of(left)
        for i, found in near(planes, left, radius):
            found = found[found < len(left)]
            if len(found) > 1:
                trees.join(i, found)
        a, b = trees.links()
        return left[a], left[b]
    trees, planes, n = Forest(len(left) + len(right)), planes_of(right), len(left)
    for i, found in near(planes, left, radius):
        found = found[found < len(right)]
        if len(found):
            trees.join(i, found + n)
    both = np.concatenate([left, right])
    a, b = trees.links()
    return both[a], both[b]


def bands_for(count: int, radius: int, most: int = 2048) -> tuple[int, int]:
    """(bands, of which so many must agree) so that an even deal leaves about ``most`` rows in a bucket. All choices are exact."""
    for bands in range(radius + 1, radius + 5):
        agree = bands - radius
        if count >> (BITS * agree // bands) <= most:
            return bands, agree
    return radius + 4, 4


def linked(dealt: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` that connect what lies within the radius in a bucket. ``dealt``: choice, bucket, fp (distinct in a bucket).

    A bucket above one block is dealt into blocks by a hash, and each pair of blocks is one group."""
    dealt = written(dealt, "buckets")
    wide = dict(dealt.dtypes)["fp"] == "binary"
    sizes = dealt.groupBy("choice", "bucket").count().where("count > 1")
    spread = sizes.withColumn("blocks", F.ceil(F.col("count") / F.lit(block)).cast("int")).drop("count")
    rows = dealt.join(spread, ["choice", "bucket"]).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    pair = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(own, x) as lo, greatest(own, x) as hi))")
    rows = rows.select("choice", "bucket", "own", "fp", F.explode(pair).alias("pair")).select("choice", "bucket", "pair.lo", "pair.hi", "own", "fp")

    def compare(table):
        import pyarrow as pa

        column = table.column("fp")
        fp = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1) if wide else column.to_numpy().view(np.uint64)[:, None]
        fp = fp[np.lexsort(fp.T[::-1])]
        own, lo, hi = table.column("own").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        if lo == hi:
            a, b = forest_of(fp, None, radius)
        else:
            raw = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1) if wide else column.to_numpy().view(np.uint64)[:, None]
            left, right = raw[own == lo], raw[own == hi]
            a, b = forest_of(left, right, radius) if len(left) and len(right) else (raw[:0], raw[:0])
        if wide:
            return pa.table({"a": pa.array([x.tobytes() for x in a], pa.binary()), "b": pa.array([x.tobytes() for x in b], pa.binary())})
        return pa.table({"a": pa.array(a[:, 0].view(np.int64)), "b": pa.array(b[:, 0].view(np.int64))})

    kind = "binary" if wide else "long"
    return rows.groupBy("choice", "bucket", "lo", "hi").applyInArrow(compare, f"a {kind}, b {kind}")


def links(fps: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Of distinct 64-bit fingerprints (column ``fp``), links that connect all that lie within the radius of each other."""
    bands, agree = bands_for(fps.count(), radius)
    cuts = [BITS * i // bands for i in range(bands + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(bands)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [signed(sum(masks[i] for i in some)) for some in combinations(range(bands), agree)]
    return linked(fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in keys])).alias("choice", "bucket")), radius, block)


def differing_share(similarity: float) -> float:
    """The share of bits in which two sets of that Jaccard similarity (and like size) are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_radius(similarity: float, words: int) -> int:
    """The expected distance of wide fingerprints at a similarity, and three standard deviations."""
    bits, share = 64 * words, differing_share(similarity)
    return int(bits * share + 3 * (bits * share * (1 - share)) ** 0.5)


def keys_for(count: int, bits: int, radius: int, miss: float = 0.005) -> tuple[int, int]:
    """(bits of a key, number of keys) so that a pair at the radius agrees on none of the keys with probability ``miss`` at most.

    Keys grow with the count, so that an even deal leaves some 500 to 1,000 in a bucket at any size; the number of keys with them."""
    length = max(1, int(np.log2(max(count, 2))) - 9)
    agree = float(np.prod([(bits - radius - i) / (bits - i) for i in range(length)]))
    return length, int(np.ceil(np.log(miss) / np.log(1 - agree)))


def key_places(bits: int, length: int, tables: int) -> list[np.ndarray]:
    """The bits of each key; keys may share bits, so they never run out."""
    rng = np.random.default_rng(SEED)
    return [rng.permutation(bits)[:length] for _ in range(tables)]


def wide_links(fps: DataFrame, similarity: float, words: int, miss: float = 0.005, block: int = BLOCK) -> DataFrame:
    """Of distinct wide fingerprints, links between those whose sets may be ``similarity`` alike or more.

    Buckets are keys of a few bits, drawn anew for each key, as many of them as ``keys_for`` says for any number of texts."""
    bits, radius = 64 * words, wide_radius(similarity, words)
    length, tables = keys_for(fps.count(), bits, radius, miss)
    places = key_places(bits, length, tables)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weights = 1 << np.arange(length)
        for b in batches:
            raw = b.column(0).to_pylist()
            some = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1, bitorder="little")
            for k in range(tables):
                key = some[:, places[k]].astype(np.int64) @ weights
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(raw), pa.int32()), pa.array(key), b.column(0)], names=["choice", "bucket", "fp"])

    return linked(fps.select("fp").mapInArrow(lean(run), "choice int, bucket long, fp binary"), radius, block)


def like_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links (in left, and behind it right) that connect the sets with a Jaccard similarity of that or more."""
    other = left if right is None else right
    sizes = np.array([len(x) for x in other])
    values, where = np.unique(np.concatenate(other), return_inverse=True) if sizes.sum() else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(where, kind="stable")
    owners = np.repeat(np.arange(len(other)), sizes)[order]  # by value, the sets that have it
    starts = np.append(np.searchsorted(where[order], np.arange(len(values))), len(owners))
    trees = Forest(len(left) + (0 if right is None else len(right)))
    for i, x in enumerate(left):
        if not len(x) or not len(values):
            continue
        at = np.searchsorted(values, x)
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == x)]
        n = starts[at + 1] - starts[at]
        if not n.sum():
            continue
        places = np.arange(n.sum()) + np.repeat(starts[at] - np.append(0, np.cumsum(n)[:-1]), n)
        both = np.bincount(owners[places], minlength=len(other))
        found = np.nonzero(both >= similarity * (len(x) + sizes - both) - 1e-9)[0]
        if len(found):
            trees.join(i, found if right is None else found + len(left))
    return trees.links()


def alike(suspects: DataFrame, similarity: float, most: int = 256, most_shingles: int = 1 << 22) -> DataFrame:
    """Links ``a``, ``b`` that connect what has that Jaccard similarity or more within a group. ``suspects``: root, s, h (the shingles' hashes).

    A group above a block is dealt into blocks by a hash, and each pair of blocks is a task: whole, and never more than two blocks in memory."""
    size = F.size("h")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(most)), F.ceil(F.sum(size) / F.lit(most_shingles)), F.lit(1)).cast("int")
    spread = suspects.groupBy("root").agg(blocks.alias("blocks"))
    rows = by_salt(suspects, spread, ["root"], ["s"]).withColumn("own", F.pmod(F.xxhash64("s", F.lit(7)), F.col("blocks")).cast("int"))
    pair = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(own, x) as lo, greatest(own, x) as hi))")
    rows = rows.select("root", "own", "s", "h", F.explode(pair).alias("pair")).select("root", "pair.lo", "pair.hi", "own", "s", "h")

    def compare(table):
        import pyarrow as pa

        own, lo, hi = table.column("own").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        keys = table.column("s").to_pylist()
        sets = [x.values.to_numpy().view(np.uint64) for x in table.column("h")]
        left = np.nonzero(own == lo)[0]
        right = None if lo == hi else np.nonzero(own == hi)[0]
        both = left if right is None else np.concatenate([left, right])
        a, b = like_pairs([sets[i] for i in left], None if right is None else [sets[i] for i in right], similarity)
        return pa.table({"a": pa.array([keys[both[i]] for i in a], pa.binary()), "b": pa.array([keys[both[i]] for i in b], pa.binary())})

    return rows.groupBy("root", "lo", "hi").applyInArrow(compare, "a binary, b binary")


def with_shingles(df: DataFrame, text: str, shingle: int) -> DataFrame:
    """The table's columns but the text, and ``h``, the hashes of its distinct shingles."""
    keep = [c for c in df.columns if c != text]
    schema = df.select(*keep).withColumn("h", F.array(F.lit(0).cast("long"))).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sets = [shingles(t, shingle) for t in column_bytes(b, text)]
            cuts = np.append(0, np.cumsum([len(x) for x in sets]))
            h = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [h], names=[*keep, "h"])

    return df.mapInArrow(lean(run), schema)


def classes(docs: DataFrame, doc_id: str, text: str, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Per row its fingerprint (16 hex digits) and the smallest id reachable over links of at most ``radius`` bits.

    Null and empty texts have fingerprint zero and link like any other. A null id takes part and is
    never the smallest; where all ids of a component are null, its id is null. Repeated rows stay
    repeated. An empty table gives an empty one."""
    plain = pick(docs, doc_id, text).toDF("doc_id", "text")
    rows = written(with_fingerprint(plain, "text", "fp", shingle), "fingerprints")
    least = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(least.select("fp"), radius))
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = with_least(named, "root", "least", "component_id").select("fp", "component_id")
    return by_salt(rows, ids, ["fp"], ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str, text: str, shingle: int = 5, similarity: float = 0.8, words: int = 8) -> DataFrame:
    """One row of each near-duplicate class: that with the smallest (id, row hash). All columns stay.

    Classes are the components of links between texts whose sets of ``shingle`` words have a Jaccard similarity of ``similarity`` or
    more. Candidates come from wide fingerprints (64 bits can't tell 0.8 from less); within each group of candidates the sets
    themselves are compared. Rows alike throughout are one document and one
    of them stays. Null ids sort last. Null and empty texts are copies of each other."""
    table = Carried(docs)
    i, t = table.at(doc_id), table.at(text)
    row = [f"_c{k}" for k in range(len(table.names))]
    h, g = F.xxhash64(*row).alias("h"), F.xxhash64(F.lit(7), *row).alias("g")  # 128 bits stand for a row
    plain = table.frame.select(F.col(i).alias("i"), h, g, F.coalesce(t, F.lit("")).alias("_t"))
    rows = written(with_fingerprint(plain, "_t", "fp", shingle, words), "fingerprints")
    rank = F.struct(F.col("i").isNull().alias("n"), "i", "h", "g")
    least = written(rows.groupBy("fp", "s").agg(F.min(rank).alias("least")), "distinct-sets")
    groups = components(wide_links(least.select("fp").distinct(), similarity, words))
    grouped = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("s", "least", F.coalesce("root", "fp").alias("root"))
    several = grouped.groupBy("root").agg(F.count("*").alias("m")).where("m > 1").select("root")
    suspects = written(by_salt(grouped, several, ["root"], ["s"]).select("root", "s", F.col("least.h").alias("_h"), F.col("least.g").alias("_g")), "suspects")
    texts = plain.select(F.col("h").alias("_h"), F.col("g").alias("_g"), "_t").join(suspects, ["_h", "_g"]).dropDuplicates(["_h", "_g"])
    sets = written(with_shingles(texts.select("root", "s", "_t"), "_t", shingle), "suspects")
    roots = components(alike(sets, similarity))
    named = least.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    # the join and the choice among repeated rows go by the same keys: texts are shuffled once
    chosen = table.frame.withColumn("_h", h).withColumn("_g", g).join(kept.select(F.col("h").alias("_h"), F.col("g").alias("_g")), ["_h", "_g"], "left_semi")
    return table.back(chosen.dropDuplicates(["_h", "_g"]))
