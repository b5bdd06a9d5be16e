"""SimHash near-dedup by tiled exact comparison.

Different fingerprints are sorted into tiles by the population counts of their parts and by a size bucket. A tile is
compared with itself and with those tiles only whose counts differ by no more than the radius in all: two fingerprints
within the radius can't lie further apart. Within a pair of tiles numpy takes the exclusive-or of all pairs and counts
its bits, and of the links found it keeps as many as hold the same fingerprints together.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.common import fresh, swept, table, written
from siltlog.llm.components import components, salted_join

NAME = "op6_simhash"
#: Stands for a null doc_id where one has to be compared.
NO_ID = -(1 << 63)
#: Fingerprints in a tile; a fuller population class is dealt over several tiles.
TILE = 4096
#: Tiles of a class that meet others in one unit of work, and tasks for each shuffle partition that units are dealt to.
TILES_AT_ONCE, PAIR_TASKS = 16, 2
#: Rows of a tile compared at a time.
BLOCK = 256
#: Shingles whose bits are counted at a time.
CHUNK = 8192


def shingles(text: str | None, words: int) -> list[bytes]:
    """The text's word shingles, repeats included; all words if there are fewer; none for no words."""
    w = (text or "").encode().lower().split()
    if not w:
        return []
    if len(w) <= words:
        return [b" ".join(w)]
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the rows of words h have each bit set, from the highest bit of the first word on."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1)
    whole = len(bits) // 255 * 255  # sums of 255 rows fit into a byte
    counts = bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprint(parts: list[bytes], bits: int = 64, seed: int = 42) -> np.ndarray:
    """bits / 64 words, of which the first is the contract's: a bit is set if it is in over half of the shingles' XXH64.

    Further words count the bits of that hash mixed with their number.
    """
    words = bits // 64
    if not parts:
        return np.zeros(words, np.uint64)
    counts = np.zeros(bits, np.int64)
    step = max(255, CHUNK // words)
    for at in range(0, len(parts), step):
        h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts[at : at + step]), np.uint64)[:, None]
        if words > 1:
            m = h + np.arange(1, words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            m = (m ^ (m >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            m = (m ^ (m >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = np.concatenate([h, m ^ (m >> np.uint64(31))], axis=1)
        counts += _bit_counts(h)
    return np.packbits(2 * counts > len(parts)).view(">u8").astype(np.uint64)


def _hashes(parts: list[bytes]) -> np.ndarray:
    """The different hashes of shingles, in order."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p) for p in parts), np.uint64))


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, seed: int = 42, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (XXH64 of the text), fingerprint (lowercase hex) and size (different shingles) of each whole text; null texts count as empty.

    With `distinct` each different shingle votes once, so that the bits tell of the sets that similarities are taken of,
    and 128 bits of a hash of the set follow the fingerprint: different sets under one fingerprint stay apart.
    """

    def run(batches):
        for batch in batches:
            prints, sizes = [], []
            for t in batch.column(2):
                parts = shingles(t.as_py(), words)
                different = list(dict.fromkeys(parts))
                print_ = fingerprint(different if distinct else parts, bits, seed).astype(">u8").tobytes().hex()
                prints.append(print_ + xxhash.xxh3_128_hexdigest(_hashes(different).tobytes()) if distinct else print_)
                sizes.append(len(different))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.string()), pa.array(sizes, pa.int32())], names=["doc_id", "th", "fingerprint", "size"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fingerprint string, size int")


#: Up to so many shingles the chance that a bit differs is counted out, ties of even counts included; beyond, it is an angle.
COUNTED = 64
#: Pairs at the similarity differ in no more bits than are expected and so many deviations of that.
DEVIATIONS = 6


def _above_half(n: int, extra: int) -> np.ndarray:
    """For k = 0..n - extra of the other shingles with a bit: the chance that over half of all n have it."""
    ways = np.array([math.comb(extra, j) for j in range(extra + 1)], float) / 2.0**extra
    return np.array([ways[max(0, n // 2 + 1 - k) :].sum() for k in range(n - extra + 1)])


def differing(x: int, y: int, shared: int) -> float:
    """The chance that a bit differs between sets of x and y shingles of which `shared` are the same."""
    k = np.array([math.comb(shared, j) for j in range(shared + 1)], float) / 2.0**shared
    a, b = _above_half(x, x - shared), _above_half(y, y - shared)
    return float((k * (a * (1 - b) + b * (1 - a))).sum())


@functools.lru_cache(maxsize=4)
def _counted(similarity: float) -> np.ndarray:
    """The largest chance of a differing bit for sets of x and y shingles, COUNTED at most, as similar as that; -1 if none are."""
    out = np.full((COUNTED + 1, COUNTED + 1), -1.0)
    out[0, 0] = 0
    for x in range(1, COUNTED + 1):
        for y in range(x, COUNTED + 1):
            least = math.ceil(similarity * (x + y) / (1 + similarity) - 1e-9)
            if least <= x:
                out[x, y] = out[y, x] = max(differing(x, y, s) for s in range(least, x + 1))
    return out


@dataclass(frozen=True)
class Near:
    """Which fingerprints link: those of at most `radius` differing bits; or, with a similarity, those whose bits may
    belong to texts whose Jaccard similarity over shingles comes to it: the least number of shingles that two such texts
    share follows from their sizes, the chance that a bit differs from that, and pairs within DEVIATIONS of it are
    candidates. An exact check of the shingles follows."""

    radius: int = 2
    similarity: float = 0.0

    def chance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The largest chance of a differing bit for texts of x and y shingles that link; -1 if none of such sizes do."""
        least = self.similarity * (x + y) / (1 + self.similarity)
        angle = np.arccos(np.minimum(1, least / np.sqrt(np.maximum(x * y, 1)))) / math.pi
        angle = np.where(least <= np.minimum(x, y) + 1e-9, angle, -1)
        few = np.maximum(x, y) <= COUNTED
        at = lambda n: np.where(few, n, 0).astype(np.int64)
        return np.where(few, _counted(self.similarity)[at(x), at(y)], angle)

    def most(self, part, bits: int):
        """Bits that differ at most where each of `bits` differs with the chance `part`."""
        return bits * part + DEVIATIONS * np.sqrt(bits * part * (1 - part))

    def _widest(self) -> float:
        # the angle is widest between texts of one size
        return max(_counted(self.similarity).max(), math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi)

    def widest(self, bits: int) -> int:
        """The radius that no linking fingerprints lie beyond."""
        return math.floor(self.most(self._widest(), bits)) if self.similarity else self.radius

    def hits(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
        few = min(a.shape[1], 4)  # words that decide first
        apart = np.zeros((len(a), len(b)), np.uint16)
        for k in range(few):
            apart += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
        if not self.similarity:
            for k in range(few, a.shape[1]):
                apart += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
            return apart <= self.radius
        hits = apart <= self.most(self._widest(), 64 * few)
        rows, columns = np.nonzero(hits)
        if len(rows):
            part = self.chance(sizes_a[rows].astype(float), sizes_b[columns].astype(float))
            differ = np.bitwise_count(a[rows] ^ b[columns]).sum(axis=1, dtype=np.int64)
            hits[rows, columns] = (part >= 0) & (differ <= self.most(np.maximum(part, 0), 64 * a.shape[1]))
        return hits


def _forest(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Links that hold together what the links between rows of a and rows of b (numbered behind a's) hold together."""
    n = len(a)
    group, links = np.arange(n + len(b)), []
    step = max(8, BLOCK // a.shape[1])
    for at in range(0, n, step):
        hits = near.hits(a[at : at + step], b, sizes_a[at : at + step], sizes_b)
        for row in np.flatnonzero(hits.any(axis=1)):
            to = np.flatnonzero(hits[row]) + n
            own = group[at + row]
            for g, first in zip(*np.unique(group[to], return_index=True), strict=True):
                if g != own:
                    links.append((at + int(row), int(to[first])))
                    group[group == g] = own
    return links


def near_links(prints: DataFrame, bits: int, near: Near) -> DataFrame:
    """(u, v): links between different fingerprints as `near` says, enough of them for the components.

    prints: fingerprint and size, one row for each fingerprint; digits beyond `bits` tell equal fingerprints apart. All
    pairs that can link are compared, whatever the number of fingerprints. Tiles whose population counts lie further
    apart than the radius are skipped: a small radius goes by the counts of four parts of the fingerprint, a wide one by
    classes of the whole count as wide as itself. With a similarity only sizes within its ratio are compared, as others
    can't come to it.
    """
    size_ratio = near.similarity
    radius = near.widest(bits)
    parts = 4 if radius <= 4 and bits <= 64 else 1
    unit = 1 if parts > 1 else radius
    width = bits // parts // 4  # hex digits
    count = lambda i: sum(
        F.bit_count(F.conv(F.substring("fingerprint", i * width + at + 1, min(8, width - at)), 16, 10).cast("long")) for at in range(0, width, 8)
    )
    bucket = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.lit(-math.log(size_ratio)) + 1e-9).cast("int") if size_ratio else F.lit(0)
    keyed = prints.select("fingerprint", "size", *(F.floor(count(i) / unit).cast("int").alias(f"k{i}") for i in range(parts)), bucket.alias("k9"))
    keys = [f"k{i}" for i in range(parts)] + ["k9"]
    # at most (bits / parts / unit + 1) ** parts population classes for each size bucket, of which there are under 200
    # so their table is broadcast: at most 3 MB for 64 bits in four parts
    classes = written(keyed.groupBy(keys).count().select(*keys, F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "classes")
    tiles = written(
        keyed.join(F.broadcast(classes), keys)
        .withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
        .groupBy(*keys, "tile")
        .agg(F.collect_list(F.unhex("fingerprint")).alias("prints"), F.collect_list("size").alias("sizes")),
        "tiles",
    )
    reach = radius // unit
    steps = [d for d in itertools.product(range(-reach, reach + 1), repeat=parts) if sum(map(abs, d)) <= reach]
    steps = [(*d, s) for d in steps for s in ((-1, 0, 1) if size_ratio else (0,))]
    steps = [d for d in steps if d >= (0,) * len(d)]  # one of each pair of opposite steps, and none at all
    move = F.explode(F.array(*(F.struct(*(F.lit(x).alias(k) for x, k in zip(d, keys, strict=True))) for d in steps)))
    moved = lambda df: df.withColumn("step", move).select(*((F.col(k) + F.col(f"step.{k}")).alias(k) for k in keys), *(c for c in df.columns if c not in keys))
    # a class of many tiles is cut into shares, and each share of it meets each share of a class in another unit of work:
    # a tile goes to as many units as there are shares that it meets, not to each tile that it meets
    shares = classes.select(*keys, F.ceil(F.col("tiles") / TILES_AT_ONCE).cast("int").alias("shares"))
    others = moved(shares.withColumnRenamed("shares", "others")).groupBy(*keys).agg(F.max("others").alias("others"))
    shares = F.broadcast(written(shares.join(others, keys), "shares"))  # a narrow row for each class
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = F.floor(F.col("tile") / TILES_AT_ONCE).cast("int")
    unit_of = [*keys, "share_a", "share_b"]
    home = F.concat_ws(",", *keys)
    here = moved(tiles.select(*keys, share.alias("share_a"), home.alias("home"), "tile", "prints", "sizes"))
    here = here.join(shares, keys).withColumn("share_b", each("shares")).drop("shares", "others")
    there = tiles.select(*keys, share.alias("share_b"), home.alias("home"), *(F.col(c).alias(c) for c in ("tile", "prints", "sizes")))
    there = there.join(shares, keys).withColumn("share_a", each("others")).drop("shares", "others")

    def tiles_of(rows: pa.Table) -> list[tuple]:
        """(class, tile, fingerprints, their words, sizes) of the rows."""
        out = []
        for home, tile, prints_, sizes in zip(*(rows.column(c) for c in ("home", "tile", "prints", "sizes")), strict=True):
            raw = prints_.as_py()
            words = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(len(raw), -1)[:, : bits // 64]
            out.append((home.as_py(), tile.as_py(), raw, words, np.array(sizes.as_py(), np.int64)))
        return out

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        u, v = [], []
        others_ = tiles_of(right)
        for home, tile, a, a_words, a_sizes in tiles_of(left):
            for b_home, b_tile, b, b_words, b_sizes in others_:
                if home == b_home and tile > b_tile:
                    continue  # within a class each pair of its tiles once
                both = a + b
                for x, y in _forest(a_words, b_words, a_sizes, b_sizes, near):
                    if both[x] != both[y]:
                        u.append(both[x].hex())
                        v.append(both[y].hex())
        return pa.table({"u": pa.array(u, pa.string()), "v": pa.array(v, pa.string())})

    tasks = PAIR_TASKS * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = [df.repartition(tasks, *unit_of).groupBy(*unit_of) for df in (here, there)]
    return units[0].cogroup(units[1]).applyInArrow(run, "u string, v string")


NEAR = Near()
#: For corpora: five-word shingles, similarity 0.8. 512 bits.
CORPUS = {"words": 5, "bits": 512, "near": Near(similarity=0.8)}
#: Documents, and different shingles of them, of a loose component that are checked exactly with each other at a time;
#: larger components are cut into pairs of such parts.
PART, PART_SHINGLES = 128, 1 << 19
#: Shingles that are counted at a time.
COLUMNS = 4096


def similar_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of each two sets of hashes comes to `similarity`; empty sets are similar to none."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], float)
    owner = np.repeat(np.arange(n), sizes.astype(int))
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]  # shingles of one set only are shared by none
    owner, number = owner[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    shared = np.zeros((n, n))
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        low, high = np.searchsorted(number, [at, at + COLUMNS])
        x = np.zeros((n, COLUMNS), np.float32)
        x[owner[low:high], number[low:high] - at] = 1
        shared += x @ x.T
    return (shared > 0) & (shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-9)


def checked_links(docs: DataFrame, different: DataFrame, loose: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): links between fingerprints of one loose component whose texts' shingles are similar, counted exactly.

    One text of each fingerprint is read again for its shingles. A component of many texts is dealt over parts that
    meet pair by pair, so no task holds more than two parts.
    """
    sized = loose.withColumnRenamed("node", "fingerprint").join(different.select("fingerprint", "of", "size"), "fingerprint")
    parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("size") / PART_SHINGLES)).cast("int")
    members = written(salted_join(sized, sized.groupBy("root").agg(parts.alias("parts")), "root", "fingerprint").drop("size"), "members")
    read = docs.withColumn("of", F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th")))
    texts = read.join(members, "of").select("root", "parts", "fingerprint", "text")

    def hashed(batches):
        for batch in batches:
            sets = [_hashes(shingles(t.as_py(), words)).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["root", "parts", "fingerprint", "hashes"])

    sets = texts.mapInArrow(hashed, "root string, parts int, fingerprint string, hashes binary")
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    tiles = sets.withColumn("part", part).groupBy("root", "parts", "part").agg(F.collect_list("fingerprint").alias("prints"), F.collect_list("hashes").alias("hashes"))
    tiles = written(tiles, "shingles")
    swept(docs.sparkSession)  # the texts were shuffled for it
    here = tiles.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1)))
    there = tiles.select("root", F.col("part").alias("other"), F.col("prints").alias("more_prints"), F.col("hashes").alias("more_hashes"))
    pairs = here.join(there, ["root", "other"]).select("prints", "hashes", F.when(F.col("part") != F.col("other"), F.col("more_prints")).alias("more_prints"), "more_hashes")

    def solve(prints, sets):
        if len(prints) < 2:
            return []
        group = np.arange(len(prints))
        links = []
        near = similar_pairs(sets, similarity)
        for i in range(len(prints)):
            for j in np.flatnonzero(near[i, :i]):
                if group[i] != group[j]:
                    links.append((prints[i], prints[j]))
                    group[group == group[j]] = group[i]
        return links

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for prints, hashes, more_prints, more_hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if more_prints:
                    prints, hashes = prints + more_prints, hashes + more_hashes
                out += solve(prints, [np.frombuffer(h, np.uint64) for h in hashes])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["u", "v"])

    return pairs.mapInArrow(run, "u string, v string")


def simhash_components(docs: DataFrame, words: int = 3, bits: int = 64, near: Near = NEAR, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every row: the smallest doc_id that links reach.

    Null and wordless texts have fingerprint zero, which links like any other. Equal fingerprints are compared once,
    so groups of copies cost nothing. With a similarity that goes for equal sets of shingles, and all links between
    different sets, under one fingerprint too, are checked exactly. A null doc_id is kept, counts for links, but names no component unless it is
    alone there (then null). Repeated rows are kept, rows that share a doc_id link only by their fingerprints. Columns
    besides id and text are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    prints = written(fingerprints(docs, words, bits, seed, distinct=bool(near.similarity)), "prints")
    # with a similarity, texts under one key have equal sets of shingles; else no size is asked for
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th"))
    different = written(prints.groupBy("fingerprint").agg(F.max("size").alias("size"), F.min("doc_id").alias("low"), one.alias("of")), "different")
    roots = components(near_links(different, bits, near))
    if near.similarity:
        roots = components(checked_links(docs, different, roots, words, near.similarity))
    lows = salted_join(roots.withColumnRenamed("node", "fingerprint"), different.select("fingerprint", "low"), "fingerprint", "root")
    lows = lows.groupBy("root").agg(F.min("low").alias("lowest"))
    of = salted_join(roots, lows, "root", "node").select(F.col("node").alias("fingerprint"), "lowest")
    own = written(different.join(of, "fingerprint", "left").select("fingerprint", F.coalesce("lowest", "low").alias("component_id")), "component")
    return salted_join(prints.drop("size", "th"), own, "fingerprint", "doc_id").select("doc_id", F.substring("fingerprint", 1, bits // 4).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component over five-word shingles the document with the smallest doc_id stays.

    Similar means a Jaccard similarity of 0.8 or more, counted exactly where the fingerprints come near it. Columns and kept rows are unchanged. Of
    rows with one doc_id and text one stays; different texts under one doc_id stay or go together. A document without
    doc_id stays if no document with one is similar, once for each text. Texts without words are all alike, so one of
    them stays. An empty table stays empty.
    """
    found = simhash_components(docs, **CORPUS)
    key = fresh(docs.columns, "key")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key)).distinct()
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(kept, key, "left_semi")
    return rows.dropDuplicates([key, "text"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


#: SQL has no XXH64 with a seed; tests hold the result against a brute-force version.
ORACLE_SQL = None
