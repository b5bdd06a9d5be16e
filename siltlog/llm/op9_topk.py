"""Exact top-k inner products over norm-sorted vectors.

Vectors are cut into tiles along descending length, and turned by the singular vectors of all of them, so that the
first coordinates hold most of every length. Blocks of queries meet the tiles in waves, the longest vectors first, so
that every query soon has a score that its answers must reach. A tile is skipped for queries whose length times the
tile's greatest can't reach their score, and within a tile the inner product of the first coordinates plus, by
Cauchy-Schwarz, the product of the rests' lengths bounds the score from above. What is left is scored in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltlog.llm.common import table, written

NAME = "op9_topk"
TILE, QUERY_BLOCK = 2048, 512
SCALE = 1024.0
#: Tiles up to the end of a wave, against those up to its begin.
WAVE = 16
#: Bytes of query blocks, and of tiles, in a unit of work; one block or tile at least.
UNIT_BYTES = 16 << 20
UNITS_PER_PARTITION = 4
#: The part of all squared lengths that the first coordinates must hold.
HEAD_ENERGY = 0.75
#: Integers below this are exact as doubles.
EXACT = float(1 << 53)


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component; vectors that are null, empty or hold null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.coalesce(F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))), F.lit(False)) & (F.size(x) > 0) & F.col(id_col).isNotNull()
    return rows.where(finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of longs, shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows: in doubles where no sum can pass 2 ** 53, else in Python's integers."""
    bound = np.abs(q).max(initial=0).astype(float) * np.abs(c).max(initial=0).astype(float) * max(1, q.shape[1])
    if bound < EXACT:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search_tile(q_ids, q, q_turned, reach, c_ids, c, c_turned, head: int, k: int):
    """The best k of a tile for each query, where they may reach its score: (query index, vec_id, score) arrays."""
    # bounds are doubles: widened by far more than their rounding, so that nothing that reaches the score is lost
    length = np.sqrt((c_turned**2).sum(axis=1))
    q_length = np.sqrt((q_turned**2).sum(axis=1))
    slack = 1e-9 * (q_length * length.max(initial=0)) + 1e-6
    live = np.flatnonzero(q_length * length.max(initial=0) + slack >= reach)
    out: list[tuple] = []
    if len(live):
        rest = np.sqrt((c_turned[:, head:] ** 2).sum(axis=1))
        bound = q_turned[live, :head] @ c_turned[:, :head].T + np.outer(np.sqrt((q_turned[live, head:] ** 2).sum(axis=1)), rest)
        may = bound + slack[live, None] >= reach[live, None]
        columns = np.flatnonzero(may.any(axis=0))
        score = _products(q[live], c[columns])
        ids = c_ids[columns]
        for row, i in enumerate(live.tolist()):
            ok = np.flatnonzero(may[row, columns] & (ids != q_ids[i]))
            if len(ok) > k:  # the k-th best score may be tied
                kth = np.partition(score[row, ok], len(ok) - k)[len(ok) - k]
                ok = ok[score[row, ok] >= kth]
            order = ok[np.lexsort((ids[ok], -score[row, ok]))][:k]
            out.append((np.full(len(order), i), ids[order], score[row, order]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([x[j] for x in out]) for j in range(3))


def needed_tiles(tiles: DataFrame, columns: DataFrame) -> DataFrame:
    """(column, tile, place): which tiles may hold an answer for a query of which column of blocks.

    tiles: tile, place and longest, columns: column and least, the shortest length that a vector must have to reach the
    score of one of its queries. Both are narrow, a row for thousands of vectors; vectors go only where this says so.
    """
    return tiles.join(columns, F.col("longest") >= F.col("least")).select("column", "tile", "place")


def _least(reach: Column, norm: Column) -> Column:
    """The length below which no vector reaches the score: none if the score isn't positive. Widened by more than rounding."""
    return F.when(reach.isNull() | (reach <= 0) | (norm == 0), float("-inf")).otherwise((reach * (1 - 1e-9) - 1e-6) / norm)


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other vectors.

    vectors: vec_id and v, as integer_vectors gives them; is_query is a condition on vec_id. Ties go to the smaller
    vec_id. A query isn't its own candidate, nor are other rows with its id. Repeated rows count once; different vectors
    of one id are different candidates, and share a ranking as queries. Vectors of different lengths are filled
    with zeros. Fewer candidates than k give all of them; no rows give none. Other columns are not read.

    Tiles come in waves along descending length, WAVE times as many in each as in all before it. After a wave every
    query has a higher score to reach, and a tile whose vectors are too short for a whole column of query blocks isn't
    sent there. A unit of work is a column and a slot of tiles, of at most UNIT_BYTES each; units are dealt to
    UNITS_PER_PARTITION times the shuffle partitions at most, and all that is kept of one is the k best of each query.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    vectors = vectors.select("vec_id", "v").distinct()
    vectors = written(vectors.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), "vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def gram(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width).astype(float)
            total += m.T @ m
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i * width + j), pa.array(total[i, j])], names=["at", "x"])

    # width * width / 2 sums over all vectors reach the driver, however many vectors there are
    sums = vectors.select("v").mapInArrow(gram, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    energy = np.zeros(width * width)
    energy[sums.column("at").to_numpy()] = sums.column("x").to_numpy()
    energy = energy.reshape(width, width)
    _, values, turn = np.linalg.svd(energy + np.triu(energy, 1).T)
    head = int(np.searchsorted(np.cumsum(values), HEAD_ENERGY * values.sum())) + 1 if values.sum() > 0 else 1

    counted = vectors.agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q")).first()
    if not counted["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most_parts = UNITS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_tiles, n_blocks = -(-counted["n"] // TILE), -(-counted["q"] // QUERY_BLOCK)
    blocks_per_column = max(1, UNIT_BYTES // (QUERY_BLOCK * width * 8))
    tiles_per_slot = max(1, UNIT_BYTES // (TILE * width * 8))

    def tiles_of(batches):
        ids, rows = [], []
        held = 0
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            rows.append(_matrix(batch.column(1), width))
            held += batch.num_rows
            while held >= TILE:
                all_ids, all_rows = np.concatenate(ids), np.concatenate(rows)
                yield _tile(all_ids[:TILE], all_rows[:TILE])
                ids, rows = [all_ids[TILE:]], [all_rows[TILE:]]
                held -= TILE
        if held:
            yield _tile(np.concatenate(ids), np.concatenate(rows))

    def _tile(ids, rows):
        longest = float(np.sqrt((rows.astype(float) ** 2).sum(axis=1)).max())
        return pa.RecordBatch.from_arrays([pa.array([longest]), pa.array([ids.astype("<i8").tobytes()]), pa.array([rows.astype("<i8").tobytes()])], names=["longest", "ids", "rows"])

    in_order = vectors.repartitionByRange(min(n_tiles, most_parts), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    cut = in_order.select("vec_id", "v").mapInArrow(tiles_of, "longest double, ids binary, rows binary")
    tiles = written(cut.withColumn("tile", F.monotonically_increasing_id()), "tiles")
    # one narrow row for each tile
    places = written(tiles.select("tile", "longest", F.row_number().over(Window.orderBy(F.desc("longest"), "tile")).alias("place")), "places")
    n_tiles = places.count()  # a range of vectors ends with a tile that isn't full
    queries = written(vectors.where(is_query).select("vec_id", "v", "norm", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int").alias("block")), "queries")

    def packed(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                ids, vs, reach, column, slot = (batch.column(names.index(name))[i] for name in ("ids", "vs", "reach", "column", "slot"))
                rows = _matrix(vs.values, width).astype("<i8")
                reach = np.array([-np.inf if x is None else float(x) for x in reach.as_py()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([column.as_py()], pa.int32()), pa.array([slot.as_py()], pa.int32()), pa.array([np.array(ids.as_py(), "<i8").tobytes()]), pa.array([rows.tobytes()]), pa.array([reach.astype("<f8").tobytes()])],
                    names=["column", "slot", "q_ids", "q_rows", "reach"],
                )

    def search(blocks_: pa.Table, tiles_: pa.Table) -> pa.Table:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        words = lambda t, name, i, kind="<i8": np.frombuffer(t.column(name)[i].as_py(), kind)
        asked = [(words(blocks_, "q_ids", i), words(blocks_, "q_rows", i).reshape(-1, width), words(blocks_, "reach", i, "<f8").copy()) for i in range(blocks_.num_rows)]
        turned = [q.astype(float) @ turn.T for _, q, _ in asked]
        for j in np.argsort(-tiles_.column("longest").to_numpy(), kind="stable").tolist():
            c_ids, c = words(tiles_, "ids", j), words(tiles_, "rows", j).reshape(-1, width)
            c_turned = c.astype(float) @ turn.T
            for (q_ids, q, reach), q_turned in zip(asked, turned, strict=True):
                at, ids, score = search_tile(q_ids, q, q_turned, reach, c_ids, c, c_turned, head, k)
                cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    query_id = int(q_ids[at[x]])
                    old_ids, old = best.get(query_id, (np.zeros(0, np.int64),) * 2)
                    all_ids, all_scores = np.concatenate([old_ids, ids[x:y]]), np.concatenate([old, score[x:y]])
                    order = np.lexsort((all_ids, -all_scores))[:k]
                    best[query_id] = all_ids[order], all_scores[order]
                    if len(order) == k:
                        reach[at[x]] = max(reach[at[x]], float(all_scores[order[-1]]))
        found = [(np.full(len(ids), query_id), ids, score) for query_id, (ids, score) in best.items()] or [(np.zeros(0, np.int64),) * 3]
        return pa.table({name: pa.array(np.concatenate([x[i] for x in found])) for i, name in enumerate(("query_id", "vec_id", "score"))})

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    best, done = None, 0
    while done < n_tiles:
        first, done = done, max(1, done * WAVE)
        reached = queries.withColumn("reach", F.lit(None).cast("double"))
        if best is not None:
            reach = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("reach")).withColumnRenamed("query_id", "vec_id")
            reached = queries.join(reach, "vec_id", "left")
        reached = reached.withColumn("column", F.floor(F.col("block") / blocks_per_column).cast("int"))
        columns = reached.groupBy("column").agg(F.min(_least(F.col("reach"), F.col("norm"))).alias("least"))
        wave = places.where((F.col("place") > first) & (F.col("place") <= done))
        pairs = written(needed_tiles(wave, columns), "pairs")
        sent = pairs.count()
        if not sent:
            break  # later tiles are shorter still
        slot_tiles = min(tiles_per_slot, max(1, sent // most_parts))
        slot = F.floor((F.col("place") - first - 1) / slot_tiles).cast("int")
        pairs = pairs.withColumn("slot", slot)
        block = reached.groupBy("column", "block").agg(F.collect_list(F.struct("vec_id", "v", "reach")).alias("all"))
        block = block.select("column", F.col("all.vec_id").alias("ids"), F.col("all.v").alias("vs"), F.col("all.reach").alias("reach"))
        asked = block.join(pairs.select("column", "slot").distinct(), "column").mapInArrow(packed, "column int, slot int, q_ids binary, q_rows binary, reach binary")
        parts = max(1, min(sent, most_parts))
        met = tiles.join(pairs.select("tile", "column", "slot"), "tile").select("column", "slot", "longest", "ids", "rows")
        keys = ["column", "slot"]
        found = asked.repartition(parts, *keys).groupBy(*keys).cogroup(met.repartition(parts, *keys).groupBy(*keys)).applyInArrow(search, schema)
        if best is not None:
            found = found.unionByName(best)
        best = written(ranked(found).drop("rank"), "best")
    return ranked(best).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 100 == 0, 10)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
