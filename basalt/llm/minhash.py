"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import numbered
from .common import Scratch, pick, sealed, small

#: A link at Jaccard 0.8 shares no band with a chance of (1 - 0.8^5)^30 = 7e-6.
BANDS, ROWS = 30, 5
MINIMA = BANDS * ROWS
#: Low bits that a signature keeps of each minimum, and their places in a 64-bit word.
BITS = 4
LANES = 64 // BITS
WORDS = -(-MINIMA // LANES)
LANE_ENDS = int("1" * LANES, 2**BITS)
#: Classes in a block of those that are compared with each other.
BLOCK = 128
#: 64-bit words of a set's bitmap.
MAP_WORDS = 32
#: Standard errors that an estimate may be below the limit.
SLACK = 5.0
#: Followers of a class that are compared with one copy of its text.
FOLLOWERS = 256
#: Blocks of a bucket in a strip; strips meet each other in tasks of their own.
STRIP = 8
#: Fixed random numbers: of each 32-bit order of the shingles a factor (odd) and what is added, a number for each byte (A-Z have those of a-z), and factors that mix.
_random = np.random.default_rng(20)
FACTORS = _random.integers(0, 2**31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)
ADDED = _random.integers(0, 2**32, MINIMA, np.uint32)
BYTES = _random.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + _random.integers(0, 2, 256, np.uint64)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
#: Bytes of a text that are hashed at once, and the powers of a base (and of its inverse) at their places.
WINDOW, BASE = 1 << 13, 0x5851F42D4C957F2D
POWERS, INVERSES = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(WINDOW - 1, x % 2**64, np.uint64)])) for x in (BASE, pow(BASE, -1, 2**64)))
INSIDE = np.array([c not in b" \t\n\v\f\r" for c in range(256)], np.int8)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order.

    A word's hash is the sum of its bytes' numbers times powers of the base, so that those of all words of a window follow from one
    running sum; a word that windows cut is put together again.
    """
    raw, out, cut, length = np.frombuffer(text, np.uint8), [], None, 0
    for at in range(0, len(raw), WINDOW):
        window = raw[at : at + WINDOW]
        edge = np.zeros(len(window) + 2, np.int8)
        edge[1:-1] = INSIDE[window]
        edge = np.diff(edge)
        starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        sums = np.zeros(len(window) + 1, np.uint64)
        np.cumsum(BYTES[window] * POWERS[: len(window)], out=sums[1:])
        own = (sums[ends] - sums[starts]) * INVERSES[starts]
        if cut is not None and len(starts) and starts[0] == 0:
            own[0] = (cut + pow(BASE, length, 2**64) * int(own[0])) % 2**64
            before = length
        else:
            before = 0
            if cut is not None:
                out.append(np.array([cut], np.uint64))
        cut = None
        if at + WINDOW < len(raw) and len(ends) and ends[-1] == len(window):
            cut, length, own = int(own[-1]), int(ends[-1] - starts[-1]) + (before if len(starts) == 1 else 0), own[:-1]
        out.append(own)
    if cut is not None:
        out.append(np.array([cut], np.uint64))
    found = np.concatenate(out) if out else np.empty(0, np.uint64)
    for factor in MIX[:2]:
        found ^= found >> np.uint64(32)
        found *= factor
    return found ^ (found >> np.uint64(29))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted 64-bit fingerprints of a text's distinct shingles of `width` words (of all its words, if fewer; none without words)."""
    hashes = word_hashes(text or b"")
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    last = len(hashes) - width + 1
    mixed = hashes[:last] * MIX[0]
    for i in range(1, width):
        nth = hashes[i : last + i]
        mixed = (mixed ^ (((nth << np.uint64(31)) | (nth >> np.uint64(33))) * MIX[1])) * MIX[0]
        mixed ^= mixed >> np.uint64(32)
    mixed = (mixed + np.uint64(width)) * MIX[2]
    mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each order."""
    high, least = (found >> np.uint64(32)).astype(np.uint32), np.full(MINIMA, 2**32 - 1, np.uint32)
    room = np.empty((min(128, len(high)), MINIMA), np.uint32)
    for i in range(0, len(high), 128):
        some = high[i : i + 128, None]
        values = np.multiply(some, FACTORS, out=room[: len(some)])
        values += ADDED
        np.minimum(least, values.min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band, its number mixed in."""
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX[0]
    for i in range(ROWS):
        out = (out ^ rows[:, i]) * MIX[1]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, mixed first, packed into 64-bit words; unused lanes are 0."""
    lanes = np.zeros(WORDS * LANES, np.uint64)
    lanes[:MINIMA] = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    places = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(lanes.reshape(WORDS, LANES) << places, axis=1).view(np.int64)


def bitmap(found: np.ndarray) -> np.ndarray:
    """A bit for each of MAP_WORDS * 64 parts of the shingle space that holds one of the set's."""
    bits = np.zeros(MAP_WORDS * 64, np.uint8)
    bits[(found & np.uint64(MAP_WORDS * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            sizes, digests, signatures, buckets, maps = [], [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = shingles(text, width)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                least = minima(found)
                signatures.append(packed(least))
                buckets.append(bands(least))
                maps.append(bitmap(found))
            flat = lambda x, n: pa.ListArray.from_arrays(np.arange(0, len(x) * n + 1, n, dtype=np.int32), pa.array(np.concatenate(x) if x else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), flat(signatures, WORDS), flat(buckets, BANDS), flat(maps, MAP_WORDS)],
                ["doc_id", "n_shingles", "digest", "signature", "buckets", "map"],
            )

    return run


def _members(packed: pa.Array) -> dict[str, np.ndarray]:
    inner = packed.flatten()
    wide = {"s": WORDS, "m": MAP_WORDS}
    one = {name: inner.field(name).to_numpy(zero_copy_only=False) for name in ("node", "of", "n")}
    return one | {name: inner.field(name).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, n) for name, n in wide.items()}


def _compared(least: int, lowest: float):
    """Pairs of a block of minor classes with a block of others that nothing rules out; see `near_duplicates`."""

    def run(batches):
        for batch in batches:
            found = [np.empty((0, 2), np.int64)]
            for i in range(batch.num_rows):
                x, y = _members(batch.column("minor").slice(i, 1)), _members(batch.column("others").slice(i, 1))
                meet = (x["of"][:, None] != y["of"]) & ((y["of"] == batch.column("main")[i].as_py()) | (x["node"][:, None] < y["node"]))
                meet &= 100 * np.minimum(x["n"][:, None], y["n"]) >= least * np.maximum(x["n"][:, None], y["n"])
                every = np.argwhere(meet)
                for k in range(0, len(every), 1 << 15):
                    p, q = every[k : k + (1 << 15)].T
                    z = x["s"][p] ^ y["s"][q]
                    z |= z >> np.uint64(2)
                    z |= z >> np.uint64(1)
                    differing = np.bitwise_count(z & np.uint64(LANE_ENDS)).sum(axis=1, dtype=np.int64)
                    near = (1 - differing / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS) >= lowest
                    p, q = p[near], q[near]
                    mine, other = x["m"][p], y["m"][q]
                    common = np.minimum(x["n"][p] - np.bitwise_count(mine & ~other).sum(axis=1, dtype=np.int64), y["n"][q] - np.bitwise_count(other & ~mine).sum(axis=1, dtype=np.int64))
                    fit = (100 + least) * common >= least * (x["n"][p] + y["n"][q])
                    found.append(np.column_stack([x["node"][p[fit]], y["node"][q[fit]]]))
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1, initial=2**63 - 1)), pa.array(pairs.max(axis=1, initial=-(2**63)))], ["a", "b"])

    return run


def _confirm(least: int, width: int):
    """Links of rows (a, b, text) in order: a class's text, where b is null, stands before those of its followers."""

    def run(batches):
        kept = None
        for batch in batches:
            left, right = [], []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = shingles(text, width)
                if b is None:
                    kept = own
                    continue
                common = len(np.intersect1d(kept, own, assume_unique=True))
                if 100 * common >= least * (len(kept) + len(own) - common):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def estimate(a: Column, b: Column) -> Column:
    """Jaccard similarity from two packed signatures: bit counts of the lanes that differ, corrected for chance matches."""
    differing = F.lit(0)
    for i in range(WORDS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(LANE_ENDS)))
    chance = 2.0**-BITS
    return (1 - differing / MINIMA - chance) / (1 - chance)


def only(a: Column, b: Column) -> Column:
    """Bits that only the first of two bitmaps has; its set has as many shingles at least that the other lacks."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(i))))) for i in range(MAP_WORDS)), F.lit(0))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node that is not the least of its component; edges: (a, b).

    Large-star and small-star steps in turn, until all that is left are stars: each node has one
    smaller neighbour, which has none. Each step
    groups by node with map-side minima. A large star that is its own minimum, as a hub mostly is, stays as it is:
    only edges of nodes with a smaller neighbour change, by a join with the written table of these.
    """
    edges = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        lower = scratch.keep(edges.groupBy("a").agg(F.min("b").alias("m")))  # of nodes with a smaller neighbour
        up = edges.join(lower.select(F.col("a").alias("b"), F.col("m").alias("m_b")), "b", "left")
        if up.join(lower, "a").filter("b <> m OR m_b IS NOT NULL").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        large = up.select("a", F.coalesce("m_b", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        before = edges, lower
        edges = scratch.keep(met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(*before)


def _sketches(texts: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    return scratch.keep(texts.mapInArrow(_sketch(width), "doc_id long, n_shingles long, digest binary, signature array<long>, buckets array<long>, map array<long>"))


def _linked(texts: DataFrame, sketch: DataFrame, width: int, least: int, scratch: Scratch, also: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for rows (doc_id, text) with ids that are unique and not null, and their sketches; see `near_duplicates`.

    also: more links (a, b) between ids.
    """
    full = sketch.filter("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("signature").alias("signature"), F.any_value("buckets").alias("buckets"), F.any_value("map").alias("map"))
    classes = scratch.keep(classes)

    members = classes.select("node", F.explode("buckets").alias("bucket"))
    leaders = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("node").alias("many")).filter("many > 1").drop("many")
    leaders = scratch.keep(leaders)
    members = scratch.keep(members.join(leaders, "bucket"))

    deviation = (MINIMA ** -0.5) * ((p := least / 100 + (1 - least / 100) * 2.0**-BITS) * (1 - p)) ** 0.5 / (1 - 2.0**-BITS)
    about = lambda side: classes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("signature").alias(f"{side}_s"), F.col("map").alias(f"{side}_m"))
    like = estimate(F.col("a_s"), F.col("b_s"))
    most = F.least(F.col("a_n") - only(F.col("a_m"), F.col("b_m")), F.col("b_n") - only(F.col("b_m"), F.col("a_m")))  # of common shingles
    fits = (100 * F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n")) & (like >= least / 100 - SLACK * deviation)
    fits &= (100 + least) * most >= least * (F.col("a_n") + F.col("b_n"))

    met = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct().join(about("a"), "a").join(about("b"), "b")
    stars = scratch.keep(met.filter(fits).select("a", "b", like.alias("like")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that are links. Followers of a class are dealt into groups, each of which gets its text once."""
        if pairs.isEmpty():
            return pairs
        many = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.count("b") / FOLLOWERS).alias("groups")))
        dealt = scratch.keep(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("group")))
        firsts = dealt.select("a", "group").distinct().select("a", "group", F.lit(None).cast("long").alias("b"), F.col("a").alias("of"))
        wanted = scratch.keep(firsts.union(dealt.select("a", "group", "b", F.col("b").alias("of"))))
        rows = texts.join(small(wanted), texts["doc_id"] == wanted["of"]).select("a", "group", "b", "text")
        rows = rows.repartition("a", "group").sortWithinPartitions("a", "group", F.col("b").asc_nulls_first())
        out = scratch.keep(rows.select("a", "b", "text").mapInArrow(_confirm(least, width), "a long, b long"))
        scratch.drop(many, dealt, wanted)
        return out

    first = scratch.keep(stars.groupBy("b").agg(F.max_by("a", F.struct("like", -F.col("a"))).alias("a")))
    links = confirmed(first)
    if also is not None:
        node = lambda side: full.select(F.col("doc_id").alias(side), "digest").join(classes.select("digest", "node"), "digest").select(side, F.col("node").alias(f"{side}_node"))
        links = links.union(also.join(node("a"), "a").join(node("b"), "b").select("a_node", "b_node"))
    found = components(links, scratch)

    def labelled(rows: DataFrame, *sides: str) -> DataFrame:
        label = small(found)
        for side in sides:
            rows = rows.join(label.select(F.col("node").alias(side), F.col("component").alias(f"{side}_of")), side, "left").withColumn(f"{side}_of", F.coalesce(f"{side}_of", side))
        return rows

    def extended(links: DataFrame) -> DataFrame:
        """The components so far, joined by links: only the graph of components is gone over anew."""
        if links.isEmpty():
            return found
        new = components(labelled(links, "a", "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")), scratch)
        into = small(new.toDF("component", "into"))
        return scratch.keep(found.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component")).union(new))

    more = labelled(stars.select("a", "b").join(first, ["a", "b"], "left_anti"), "a", "b").filter("a_of <> b_of")
    more = scratch.keep(more.select("a", "b"))
    found = extended(confirmed(more))
    scratch.drop(more, leaders)

    placed = scratch.keep(labelled(members.select("bucket", F.col("node").alias("a")), "a"))
    counted = placed.groupBy("bucket", "a_of").agg(F.count("a").alias("n"))
    split = counted.groupBy("bucket").agg(F.count("n").alias("parts"), F.max_by("a_of", F.struct("n", "a_of")).alias("main"), F.sum("n").alias("total"), (F.sum("n") - F.max("n")).alias("minors")).filter("parts > 1").drop("parts")
    split = scratch.keep(split)
    known = scratch.keep(placed.join(small(split), "bucket").join(about("a"), "a").select("bucket", "main", "total", "minors", "a_of", F.struct(F.col("a").alias("node"), F.col("a_of").alias("of"), F.col("a_n").alias("n"), F.col("a_s").alias("s"), F.col("a_m").alias("m")).alias("x")))

    def blocks(rows: DataFrame, name: str, size: str) -> DataFrame:  # of at most some BLOCK classes
        block = F.pmod(F.xxhash64("x.node"), F.ceil(F.col(size) / BLOCK)).alias("block")
        return rows.groupBy("bucket", "main", "total", "minors", block).agg(F.collect_list("x").alias(name)).withColumn("strip", F.floor(F.col("block") / STRIP))

    strips = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.ceil(F.col(size) / BLOCK) - 1) / STRIP)))
    minor = blocks(known.filter("a_of <> main"), "minor", "minors").select("bucket", "main", "minor", F.col("strip").alias("i"), strips("total").alias("j"))
    others = blocks(known, "others", "total").select("bucket", "others", F.col("strip").alias("j"), strips("minors").alias("i"))
    met = minor.join(others, ["bucket", "i", "j"])
    rest = met.select("main", "minor", "others").mapInArrow(_compared(least, least / 100 - SLACK * deviation), "a long, b long")
    rest = scratch.keep(rest.distinct().join(stars, ["a", "b"], "left_anti"))
    found = extended(confirmed(rest))
    scratch.drop(members, stars, first, placed, split, known, rest)

    nodes = full.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "node"), "digest").join(found, "node", "left")
    linked = nodes.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return linked.union(sketch.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _repeated(ids: DataFrame) -> bool:
    """Whether a doc_id that is not null comes twice."""
    return not ids.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()


def near_duplicates(docs: DataFrame, *, width: int = 5, least: int = 80) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each document row.

    A document's set holds its distinct shingles of `width` words (A-Z lower-cased, words parted by ASCII white
    space; of fewer words, all of them as one; of none, nothing). Documents are linked if 100 * intersection is at least
    `least` * union; component_id is the smallest doc_id reachable, kept
    whether it is the document's own.

    1. Each whole text gets the fingerprint of its set, 150 minima, of them 30 band buckets
       and a signature of 4 bits each. Documents with equal sets are one class from here on.
    2. Buckets with several classes get a leader; each class pairs with the
       leaders of its buckets, not with all others in them. Pairs go on if the
       estimate from the signatures is within 5 standard errors of the limit, and sizes and bitmaps of the
       sets, which bound the intersection from above, allow a link.
    3. Links are confirmed on full shingle sets: first for each class's most similar leader, then for other leaders in another
       component so far. Then, where a bucket still holds several components, its classes outside the
       largest of them are compared with all of the bucket in other components, so that no candidate link
       between components stays untried; pairs that are ruled out are not made. Blocks of both are dealt
       over a grid, and a leader's followers over groups, so that no bucket or leader is one task's.

    What can be missed are links that share no band (7e-6 at the limit) or whose estimate is
    off by more (3e-7). Sets are compared by 64-bit fingerprints of shingles.

    Null and empty texts are linked with nothing. A row without doc_id is linked with nothing, has a null component_id and is kept.
    Rows that share a doc_id are one document with the links of all; each gives a row. (Where there are any, rows are numbered
    in the order of doc_id and the numbers linked.) An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    texts = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketch = _sketches(texts, width, scratch)
    nameless = sketch.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    if not _repeated(sketch):
        linked = _linked(texts, sketch.filter("doc_id IS NOT NULL"), width, least, scratch)
    else:
        rows = scratch.keep(numbered(texts.filter("doc_id IS NOT NULL").withColumn("hash", F.xxhash64("text")), [("doc_id", False), ("hash", False)]))
        by_number = rows.select(F.col("pos").alias("doc_id"), "text")
        first = rows.groupBy("doc_id").agg(F.min("pos").alias("b"))
        also = rows.join(first, "doc_id").select(F.col("pos").alias("a"), "b").filter("a <> b")
        found = _linked(by_number, _sketches(by_number, width, scratch), width, least, scratch, also)
        named = rows.select(F.col("pos"), F.col("doc_id").alias("own"))
        least_of = rows.select(F.col("pos").alias("component_id"), F.col("doc_id").alias("of"))
        linked = found.join(named, found["doc_id"] == named["pos"]).join(least_of, "component_id").select(F.col("own").alias("doc_id"), "n_shingles", F.col("of").alias("component_id"))
    return linked.union(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup_documents(docs: DataFrame, *, width: int = 5, least: int = 80) -> DataFrame:
    """The documents with one row of each component of `near_duplicates`, that of the smallest doc_id; columns as given.

    Here rows that share a doc_id are rows of their own, linked by their texts alone; of one component's rows with the smallest
    doc_id that of the least text hash stays. Rows without doc_id come after all others. (Where there are such rows, all
    are numbered in this order first.) Null and empty texts all stay. An empty table stays one.
    """
    scratch = Scratch(docs.sparkSession)
    plain, names, new = sealed(docs)
    doc_id = F.col(new["doc_id"]).cast("long")
    ids = plain.select(doc_id.alias("doc_id"))
    if not _repeated(ids) and ids.filter("doc_id IS NULL").isEmpty():
        texts = plain.select(doc_id.alias("doc_id"), F.col(new["text"]).alias("text"))
        rows = plain.withColumn("_row", doc_id)
    else:
        order = plain.withColumns({"_last": doc_id.isNull(), "_id": doc_id, "_hash": F.xxhash64(new["text"])})
        rows = scratch.keep(numbered(order, [("_last", False), ("_id", False), ("_hash", False)], "_row", keep=names))
        texts = rows.select(F.col("_row").alias("doc_id"), F.col(new["text"]).alias("text"))
    judged = _linked(texts, _sketches(texts, width, scratch), width, least, scratch)
    gone = small(scratch.keep(judged.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone"))))
    return rows.join(gone, F.col("_row") == F.col("gone"), "left_anti").select(*names).toDF(*docs.columns)
