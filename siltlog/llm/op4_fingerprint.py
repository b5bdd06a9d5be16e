"""Canonical exact digests of documents.

A text is brought to one form (Unicode NFKC, full case folding, runs of white space as one space, none at the ends)
and hashed to 128 bits by two XXH64. Narrow rows are grouped by the hash; only where a hash comes more than once do the
canonical bytes go there, least and greatest of each task, and are compared. A group that holds different ones gets fingerprints that also carry a
SHA-256 of the canonical text. So equal canonical texts have equal fingerprints, and different ones different ones. All
of it is Spark SQL; normalisation and case folding are ICU's, which Spark ships for its collations, called by reflect().
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltlog.llm.common import table, written

NAME = "op4_fingerprint"
#: Ids along which neighbours are found: so many ranges of the sorted ids, each in one task.
RANGES_PER_PARTITION = 4
MOST_RANGES = 10_000
#: Bits of a bitmap of keys: 4 MB.
BITMAP_BITS = 1 << 25


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again (folding can undo it), white space folded; null as empty."""
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    text = F.coalesce(text, F.lit(""))
    # of ASCII, which has as many bytes as characters, all of that changes capitals only
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(nfkc(fold(nfkc(text))))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(x: Column) -> Column:
    """128 bits as 32 hex digits: XXH64 of the text, and of the text with its length before it."""
    return F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(x), F.xxhash64(F.length(x), F.lit("wide"), x))))


def mixed_hashes(texts: DataFrame) -> DataFrame:
    """The wide hashes under which canonical texts lie that aren't byte for byte the same, one row each.

    texts: hash and canonical. Copies meet before the shuffle: of each hash a task passes on its smallest and its
    largest text only.
    """
    groups = texts.groupBy("hash").agg((F.min("canonical") == F.max("canonical")).alias("pure"))
    return groups.where(~F.col("pure")).select("hash")


def repeated(hashes: DataFrame) -> DataFrame:
    """The hashes (hash) that come more than once, one row each."""
    return hashes.groupBy("hash").count().where("count > 1").select("hash")


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """BITMAP_BITS bits as rows of a number and 32,768 of them, set where a key falls."""
    at = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    return written(keys.groupBy(F.floor(at / 32768).alias("_piece")).agg(F.bitmap_construct_agg(at % 32768).alias("_bits")), "bitmap")


def maybe_in(rows: DataFrame, bits: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in the bitmap, and a few others, picked where they lie: a bitmap has BITMAP_BITS bits at most
    and is broadcast, so that long texts aren't shuffled to be joined with the keys."""
    at = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_piece", F.floor(at / 32768)).join(F.broadcast(bits), "_piece")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_piece", "_bits")


def resolved(rows: DataFrame, mixed: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with fingerprints by name, each from a pair of columns, hash and strong: `columns` gives name and prefix.

    A fingerprint is the wide hash, and behind it the SHA-256 of the canonical text where the hash is mixed. Mixed
    hashes are so rare that Spark broadcasts them, by their size.
    """
    for name, prefix in columns.items():
        rows = rows.join(mixed.select(F.col("hash").alias(f"{prefix}hash"), F.lit(True).alias("_mixed")), f"{prefix}hash", "left")
        both = F.concat(f"{prefix}hash", F.lit("-"), f"{prefix}strong")
        rows = rows.withColumn(name, F.when(F.col("_mixed"), both).otherwise(F.col(f"{prefix}hash"))).drop("_mixed")
    return rows


def with_next(docs: DataFrame, columns: list[str], made=lambda rows: rows) -> DataFrame:
    """docs (doc_id, text) with next_<c> for each c of `columns`, from the next row by doc_id; after the last, the first.

    `made` adds columns to rows, before they are shuffled. Rows of one id are in the order of a hash of their text. Rows are dealt to ranges of doc_id whose bounds are quantiles of all ids, and the rows of an id that fills several
    quantiles, or of none, to as many ranges of that hash. The first row of each range also goes to the
    range before it, where it follows the last row. Null ids come first.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    n = min(MOST_RANGES, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 50 * n).alias("b"), F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first() if n > 1 else None
    bounds = seen["b"] or [] if seen else []
    often = Counter(bounds)
    bounds = sorted(often)
    # into how many ranges of th the rows of the first id of a range are dealt; the other ids of the range follow
    shares = [1 + n * (seen["rows"] - seen["ids"]) // max(1, seen["rows"]) if seen else 1, *(often[b] for b in bounds)]
    # the number of bounds at or below the id, found by halving: a literal array is searched at its middle
    placed = docs.withColumn("range", _range_of(F.col("doc_id"), bounds))
    if max(shares) > 1:
        hot = [(i, bounds[i - 1] if i else None, x) for i, x in enumerate(shares) if x > 1]
        part = F.lit(0)
        for i, id_, x in hot:  # at most n of them
            within = F.floor((F.col("th") / float(1 << 64) + 0.5) * x).cast("int")
            of_id = F.col("doc_id").isNull() if id_ is None else F.col("doc_id") == id_
            part = F.when(F.col("range") == i, F.when(of_id, F.least(within, F.lit(x - 1))).otherwise(x)).otherwise(part)
        placed = placed.withColumn("part", part)
    else:
        placed = placed.withColumn("part", F.lit(0))
    at = ["range", "part"]
    firsts = placed.groupBy(*at).agg(F.min(F.struct("doc_id", "th")).alias("first"))
    # at most a row for each range: a window over them all is small
    around = Window.partitionBy(F.lit(0)).orderBy(*at)
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.struct(*at)
    firsts = firsts.select(F.coalesce(F.lag(before).over(around), F.last(before).over(whole)).alias("at"), "first")
    firsts = firsts.select("at.*", F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th"))
    ghosts = docs.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).dropDuplicates(at)
    both = placed.withColumn("ghost", F.lit(0)).unionByName(ghosts.drop("_id", "_th").withColumn("ghost", F.lit(1)))
    along = Window.partitionBy(*at).orderBy("ghost", "doc_id", "th")
    return made(both).withColumns({f"next_{c}": F.lead(c).over(along) for c in columns}).where("ghost = 0").drop("ghost", "th", *at)


def _range_of(x: Column, bounds: list[int], low: int = 0) -> Column:
    if not bounds:
        return F.lit(low)
    middle = len(bounds) // 2
    return F.when(x >= bounds[middle], _range_of(x, bounds[middle + 1 :], low + middle + 1)).otherwise(_range_of(x, bounds[:middle], low))


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null as empty), canonical, its wide hash and its SHA-256 (strong), of every row.

    reflect() counts as not deterministic, so that no optimisation makes a canonical text twice.
    """
    return digested(_read(docs, id_col, text_col).withColumn("canonical", canonical(F.col("text"))))


def _read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def digested(rows: DataFrame, prefix: str = "") -> DataFrame:
    text = F.col(f"{prefix}canonical")
    return rows.withColumns({f"{prefix}hash": wide_hash(text), f"{prefix}strong": F.sha2(text.cast("binary"), 256)})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, canonical and fingerprint of every row; a null text is empty, a null id stays null.

    Repeated rows stay and have equal fingerprints; an empty table gives an empty result; other columns are not read.
    """
    made = written(hashed(docs, id_col, text_col), "canonical")
    often = bitmap(repeated(made.select("hash")), "hash")
    return resolved(made, written(mixed_hashes(maybe_in(made.select("hash", "canonical"), often, "hash")), "mixed"), {"fingerprint": ""}).select("doc_id", "text", "canonical", "fingerprint")


def edited_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, and hash and strong of the text, of the edited text (edited_) and of the next document's text (next_),
    with edited_canonical, of every row of docs (doc_id, text).

    The edited text ends in the beginning of the next document. Null texts are empty; rows of one doc_id follow each
    other by a hash of their text; a single row follows itself.
    """
    made = lambda rows: digested(rows.withColumn("canonical", canonical(F.col("text")))).drop("canonical")
    near = with_next(_read(docs), ["text", "hash", "strong"], made)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    edited = edited.select("doc_id", n.cast("long").alias("n_chars"), "hash", "strong", "next_hash", "next_strong", "edited", canonical(F.col("edited")).alias("edited_canonical"))
    return digested(edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited"), "edited_")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = written(edited_rows(docs), "edited")
    # all texts under a hash that comes more than once, edited ones too, are compared byte by byte
    also = F.col("edited_hash").alias("hash")
    often = bitmap(repeated(rows.select("hash").unionByName(rows.select(also))), "hash")
    # a text is made canonical again only for a document whose hash may be such a one
    ids = bitmap(maybe_in(rows.select("doc_id", "hash"), often, "hash"), "doc_id")
    again = maybe_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "doc_id")
    texts = hashed(again).select("hash", "canonical").unionByName(rows.select(also, F.col("edited_canonical").alias("canonical")))
    mixed = written(mixed_hashes(maybe_in(texts, often, "hash")), "mixed")
    found = resolved(rows, mixed, {"fingerprint": "", "edited_fingerprint": "edited_", "_next": "next_"})
    # digests of different texts have no likeness at all
    like = lambda x: F.when(F.col("fingerprint") == F.col(x), 1.0).otherwise(0.0)
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("_next").alias("near_next"))


#: SQL engines besides Spark have no XXH64 and no NFKC; tests hold the result against a brute-force version.
ORACLE_SQL = None
