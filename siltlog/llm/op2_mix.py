"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source is dealt into shards by a seeded hash of its documents, and every shard is cut into blocks of equally
many words along a seeded order of its documents. The blocks that the mix takes are handed out one by one to the
highest quotients weight / (2k - 1): first among the sources, then among the shards of each source. A shard whose quota
is more than its blocks takes all of them as often as it can, and a seeded choice of the rest once more. Where the
chosen blocks lie follows from their number alone, so what a document gives is the difference of two closed forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltlog.llm.common import fresh, table, written

NAME = "op2_mix"
#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 32
#: Words of a shard at least; and the most shards over all sources, beyond which shards grow with the corpus.
SHARD_WORDS, MOST_SHARDS = 65_536, 1 << 17
SEED = 42


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document(doc_id: Column, text: Column) -> Column:
    """What a document's place goes by: its id, or where it has none a digest of its text, so that such rows spread too."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def hash32(seed: int, *columns: Column) -> Column:
    """32 bits of MD5 of the columns as text, null apart from empty: the same number in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("~")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def apportion(rows: DataFrame, within: list[str], order: list[str], weight: str, seats: str) -> DataFrame:
    """rows with `quota`: `seats` of each group of rows (equal in `within`) handed out to the highest weight / (2k - 1).

    Ties go to the earlier row by the columns of `order`, which must be unique in a group and not null. Rows of no weight get none. Instead of
    all quotients only those near the border are ranked: the divisor lies between total / (seats + n / 2) and
    total / (seats - n / 2) for n rows, so each row's seats are known but for some, about 3n in a group.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    whole = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # sums in one order
    total, n = F.sum(weight).over(whole), F.count(F.lit(1)).over(whole)
    known = rows.withColumn("_total", total).withColumn("_n", n)
    low = F.floor(F.col(weight) * (F.col(seats) - F.col("_n") / 2) / F.col("_total") - 0.5) - 1
    high = F.ceil(F.col(weight) * (F.col(seats) + F.col("_n") / 2) / F.col("_total") + 0.5) + 1
    known = known.withColumn("_low", F.when(F.col("_total") > 0, F.greatest(low, F.lit(0))).otherwise(0).cast("long"))
    known = known.withColumn("_high", F.when(F.col("_total") > 0, high).otherwise(0).cast("long")).withColumn("_free", F.col(seats) - F.sum("_low").over(whole))
    open_ = known.where((F.col("_high") > F.col("_low")) & (F.col(weight) > 0)).withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    ranked = open_.withColumn("_rank", F.row_number().over(group.orderBy((F.col(weight) / (2 * F.col("_k") - 1)).desc(), *order, "_k")))
    keys = [*within, *order]
    won = ranked.where(F.col("_rank") <= F.col("_free")).groupBy(*keys).agg(F.count("*").alias("_won"))
    return known.join(won, keys, "left").withColumn("quota", (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long")).select(*rows.columns, "quota")


def targets(sources: DataFrame) -> DataFrame:
    """id_source, source_size, target: the share of all sizes by weight, capped at MOST_REPEATS times the size.

    What the caps leave over is shared again by weight until no source is above: that is one water level for
    all sources, and those with the least room for their weight are capped first.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy("source_null", "id_source")
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    s = sources.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * MOST_REPEATS).withColumn("room", F.col("cap") / F.col("weight"))
    s = s.withColumn("everything", F.sum("source_size").over(everything) * SHARE)
    by_room = everything.orderBy("room", "source_null", "id_source")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    # the level if all sources with less room are capped and this one and those behind it aren't
    level = (F.col("everything") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", level)
    s = s.withColumn("at", F.row_number().over(by_room))
    flat = F.min(F.when(F.col("level") <= F.col("room"), F.struct("at", "level"))).over(everything)["level"]
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * flat, F.col("cap").cast("double")))).select("id_source", "source_null", "source_size", "target")


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row: the words of it that the mix takes.

    A null text has size 0 and gives nothing; a null source is a source of its own, the last; rows without doc_id or
    repeated rows are documents like others, in the order of equal hashes by id and size. An empty table gives an
    empty result; other columns are not read. Sources and shards are few (at most MOST_SHARDS beyond one for each
    source); no window spans more than one shard's narrow rows. A column `row_col` that numbers the rows settles their
    order where hash, id and size are equal, and comes along, as `row`, with `times`: how often the whole document is
    taken. In the order of their sizes a shard's documents are taken whenever the sum of their taken / size passes a
    whole number, from a seeded start on: a shard's words differ from what it gives by no more than two of its
    longest documents, and each document's times from its own share by less than one. Documents without words come once.
    """
    text, id_ = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    carry = ["row"] if row_col else []
    row = [F.col(row_col).alias("row")] if row_col else []
    read = docs.select(id_.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), document(id_, text).alias("document"), *row)
    read = written(read.withColumns({"source_null": F.col("source").isNull(), "id_source": F.coalesce("source", F.lit(""))}), "sizes")
    by_source = ["source_null", "id_source"]
    sources = targets(read.groupBy(*by_source).agg(F.sum("size").alias("source_size")))
    everything = Window.partitionBy(F.lit(0))
    shard_words = F.greatest(F.lit(SHARD_WORDS), F.ceil(F.sum("source_size").over(everything) / MOST_SHARDS))
    sources = written(sources.withColumn("n_shards", F.ceil(F.col("source_size") / shard_words)), "sources")
    # documents with their shards; the sources' table is small, and Spark broadcasts it if it is below its own limit
    dealt = read.join(sources, by_source).withColumn("id_shard", F.pmod(hash32(seed, F.col("document")), F.greatest("n_shards", F.lit(1))))
    shards = dealt.groupBy(*by_source, "id_shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / block_words))
    blocks = shards.groupBy(*by_source).agg(F.sum("n_blocks").alias("source_blocks"))
    wanted = sources.join(blocks, by_source).withColumn("weight", F.coalesce(F.col("target") * F.col("source_blocks") / F.nullif("source_size", F.lit(0)), F.lit(0.0)))
    in_order = everything.orderBy(*by_source).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = wanted.withColumn("seats", F.round(F.sum("weight").over(in_order)).cast("long"))
    # the null source's id is the empty text too, so its flag takes part in every key
    quotas = apportion(wanted, [], ["source_null", "id_source"], "weight", "seats")
    per_shard = shards.join(quotas.select(*by_source, F.least("quota", MOST_REPEATS * F.col("source_blocks")).alias("seats")), by_source)
    per_shard = apportion(per_shard, by_source, ["id_shard"], "n_blocks", "seats").withColumn("quota", F.least("quota", MOST_REPEATS * F.col("n_blocks")))
    per_shard = per_shard.withColumns({
        "all": F.floor(F.col("quota") / F.greatest("n_blocks", F.lit(1))),
        "extra": F.col("quota") % F.greatest("n_blocks", F.lit(1)),
        "shift": F.pmod(hash32(seed + 1, F.col("id_source"), F.col("id_shard")), F.greatest("n_blocks", F.lit(1))),
    })
    per_shard = written(per_shard.select(*by_source, "id_shard", "shard_size", "n_blocks", "all", "extra", "shift"), "quotas")
    along = Window.partitionBy(*by_source, "id_shard").orderBy("place", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("place", hash32(seed + 2, F.col("document"))).withColumn("end", F.sum("size").over(along))
    placed = placed.join(per_shard, [*by_source, "id_shard"])

    def taken_before(x: Column) -> Column:
        """Words taken of the first x words of a shard: whole rounds, and those blocks of the last round whose share of
        `extra`, counted from `shift` on, passes a whole number."""
        n, size, extra, shift = (F.col(c) for c in ("n_blocks", "shard_size", "extra", "shift"))
        divided = lambda a, b: F.floor(a / b)  # noqa: E731  exact below 2 ** 53
        begin = lambda b: divided(b * size, n)
        passed = lambda b: divided((b + shift) * extra, n)
        block = F.least(divided((x + 1) * n - 1, size), n)  # of word x
        # blocks have floor or ceil of size / n words; the words of the chosen ones are their number's share of all
        whole = divided((passed(block) - passed(F.lit(0))) * size, n)
        part = F.when(passed(block + 1) > passed(block), x - begin(block)).otherwise(0)
        return F.col("all") * x + F.when(extra > 0, whole + part).otherwise(0)

    begin = F.col("end") - F.col("size")
    taken = F.when(F.col("size") > 0, taken_before(F.col("end")) - taken_before(begin)).otherwise(0)
    limited = F.least(F.greatest(taken, F.lit(0)), MOST_REPEATS * F.col("size")).cast("long")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    if not row_col:
        return placed.select(*columns, limited.alias("taken"))
    ordered = Window.partitionBy(*by_source, "id_shard").orderBy("size", "place", "doc_id", "row")
    start = hash32(seed + 3, F.col("id_source"), F.col("id_shard")) / float(1 << 32)
    whole = placed.withColumn("taken", limited).withColumn("part", F.when(F.col("size") > 0, F.col("taken") / F.greatest("size", F.lit(1))).otherwise(0.0))
    whole = whole.withColumn("sum", F.sum("part").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + start)
    # the same number twice, so that what one document is left with the next begins with
    times = F.floor("sum") - F.floor(F.coalesce(F.lag("sum").over(ordered), start))
    return whole.withColumn("times", F.when(F.col("size") > 0, F.least(times, F.lit(MOST_REPEATS))).otherwise(1).cast("int")).select(*columns, "taken", "row", "times")


def materialised(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, whole, as often as the mix takes them; columns unchanged, whatever their names.

    Each row has its own share, also among rows without an id, of one id or repeated: rows are numbered in a written
    table. Documents that the mix takes nothing of go, those without words stay once. An empty table stays empty.
    """
    row, times = (fresh(docs.columns, name) for name in ("row", "times"))
    placed = written(docs.withColumn(row, F.monotonically_increasing_id()), "placed")
    mixed = mix(placed, seed, id_col=id_col, text_col=text_col, source_col=source_col, row_col=row)
    taken = mixed.where("times > 0").select(F.col("row").alias(row), F.col("times").alias(times))
    return placed.join(taken, row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_HASH = "CAST('0x' || substr(md5(concat_ws('|', '{seed}', {of})), 1, 8) AS BIGINT)"
_DOC = "document"

#: The same results, with all quotients ranked one by one.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, ''))) AS document, source IS NULL AS sn, coalesce(source, '') AS sid, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), s0 AS (
  SELECT sn, sid, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sn, sid
), s1 AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY sn, sid) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
    CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM s0
), s2 AS (
  SELECT *, source_size * {MOST_REPEATS} AS cap, row_number() OVER (ORDER BY source_size * {MOST_REPEATS} / w, sn, sid) AS pos FROM s1
), s3 AS (
  SELECT *, (total * {SHARE} - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s2
), s4 AS (
  SELECT *, coalesce(least(CAST(cap AS DOUBLE), w * (SELECT arg_min(level, pos) FROM s3 WHERE level <= cap / w)), CAST(cap AS DOUBLE)) AS target,
    CAST(ceil(source_size / greatest({SHARD_WORDS}, ceil(total / {MOST_SHARDS}))) AS BIGINT) AS n_shards
  FROM s3
), p AS (
  SELECT d.*, s4.source_size, s4.target, {_HASH.format(seed=SEED, of=_DOC)} % greatest(n_shards, 1) AS shard, {_HASH.format(seed=SEED + 2, of=_DOC)} AS place
  FROM d JOIN s4 USING (sn, sid)
), c AS (
  SELECT sn, sid, shard, CAST(sum(size) AS BIGINT) AS shard_size, CAST(ceil(sum(size) / {BLOCK_WORDS}) AS BIGINT) AS n FROM p GROUP BY sn, sid, shard
), b AS (
  SELECT sn, sid, CAST(sum(n) AS BIGINT) AS blocks FROM c GROUP BY sn, sid
), sw AS (
  SELECT sn, sid, blocks, CASE WHEN source_size = 0 THEN 0 ELSE target * blocks / source_size END AS weight FROM s4 JOIN b USING (sn, sid)
), sq AS (
  SELECT sn, sid, count(*) AS quota FROM (
    SELECT sn, sid, row_number() OVER (ORDER BY weight / (2 * k - 1) DESC, sn, sid, k) AS r
    FROM (SELECT *, unnest(generate_series(1, 2 * blocks + 100)) AS k FROM sw WHERE weight > 0)
  ) WHERE r <= (SELECT CAST(round(sum(weight)) AS BIGINT) FROM sw) GROUP BY sn, sid
), cq AS (
  SELECT sn, sid, shard, count(*) AS quota FROM (
    SELECT c.sn, c.sid, c.shard, least(sq.quota, {MOST_REPEATS} * b.blocks) AS seats, row_number() OVER (PARTITION BY c.sn, c.sid ORDER BY c.n / (2 * k - 1) DESC, c.shard, k) AS r
    FROM (SELECT *, unnest(generate_series(1, 2 * n + 100)) AS k FROM c) c JOIN sq USING (sn, sid) JOIN b USING (sn, sid)
  ) WHERE r <= seats GROUP BY sn, sid, shard
), q AS (
  SELECT c.*, least(coalesce(cq.quota, 0), {MOST_REPEATS} * n) // greatest(n, 1) AS rounds, least(coalesce(cq.quota, 0), {MOST_REPEATS} * n) % greatest(n, 1) AS extra,
    {_HASH.format(seed=SEED + 1, of="c.sid, CAST(c.shard AS VARCHAR)")} % greatest(n, 1) AS shift
  FROM c LEFT JOIN cq USING (sn, sid, shard)
), e AS (
  SELECT p.*, sum(size) OVER (PARTITION BY sn, sid, shard ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS stop FROM p
), x AS (
  SELECT e.doc_id, e.size, e.source_size, e.target, e.stop, q.*, unnest([stop, stop - e.size]) AS edge, unnest([1, -1]) AS sign
  FROM e JOIN q ON e.sn = q.sn AND e.sid = q.sid AND e.shard = q.shard
), y AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(((edge + 1) * n - 1) // shard_size, n) END AS block FROM x
), z AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE (block + shift) * extra // n END AS p1, CASE WHEN n = 0 THEN 0 ELSE (block + 1 + shift) * extra // n END AS p2, CASE WHEN n = 0 THEN 0 ELSE shift * extra // n END AS p0 FROM y
)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(least(greatest(sum(CASE WHEN size = 0 THEN 0 ELSE sign * (rounds * edge + CASE WHEN extra > 0 THEN (p1 - p0) * shard_size // n + CASE WHEN p2 > p1 THEN edge - block * shard_size // n ELSE 0 END ELSE 0 END) END), 0), 2 * any_value(size)) AS BIGINT) AS taken
FROM z GROUP BY doc_id, stop, sn, sid, shard
"""
