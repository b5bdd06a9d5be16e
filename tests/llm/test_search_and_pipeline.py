"""Exact search against brute force, and the pipeline stage by stage."""

import random
import re

import numpy as np

import corpus_pipeline
from siltlog.llm import op1_quality, op2_mix, op6_simhash, op7_secrets, op9_topk

DATA = "/root/testdata/sf0.001"


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_query_equals_brute_force(spark):
    vectors = {r["vec_id"]: np.floor(1024 * np.array(r["embedding"], float)).astype(np.int64) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    assert by_query(op9_topk.query(spark, DATA)) == brute(vectors, [i for i in vectors if i % 100 == 0], 10)


def test_small_tiles_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(op9_topk, "TILE", 16)
    monkeypatch.setattr(op9_topk, "QUERY_BLOCK", 3)
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, 0.5, 2.0, 2.0]) * (1 + i % 5) for _ in range(4)], 1, 2) for i in range(90)]
    rows += [(5, rows[5][1], 1, 2), (91, None, 1, 2), (92, [1.0, None, 1.0, 1.0], 1, 2), (93, [1.0, float("nan"), 0.0, 0.0], 1, 2), (94, [float("inf")] * 4, 1, 2), (95, [], 1, 2), (None, [1.0] * 4, 1, 2), (96, [3.0], 1, 2), (97, [0.0] * 4, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score int")
    vectors = {i: np.pad(np.floor(1024 * np.array(v)).astype(np.int64), (0, 4 - len(v))) for i, v, *_ in rows if i is not None and i not in (91, 92, 93, 94, 95)}
    ints = op9_topk.integer_vectors(df)
    from pyspark.sql import functions as F

    assert by_query(op9_topk.top_k(ints, F.col("vec_id") % 10 == 0, 7)) == brute(vectors, [i for i in vectors if i % 10 == 0], 7)
    assert by_query(op9_topk.top_k(ints.where("vec_id < 3"), F.col("vec_id") == 0, 7)) == brute({i: v for i, v in vectors.items() if i < 3}, [0], 7)
    assert op9_topk.top_k(ints.limit(0), F.col("vec_id") == 0).count() == 0


def test_short_tiles_are_not_sent(spark, monkeypatch):
    from pyspark.sql import functions as F
    from pyspark.sql.classic.dataframe import DataFrame

    for name, value in (("TILE", 16), ("QUERY_BLOCK", 8), ("UNIT_BYTES", 4096), ("WAVE", 4)):
        monkeypatch.setattr(op9_topk, name, value)
    rnd = np.random.default_rng(5)
    vectors = {i: (rnd.normal(size=8) * (4000 if i % 8 == 0 else 40)).astype(np.int64) for i in range(1600)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, v array<long>")
    sent, parts = [], []
    needed, by_hash, by_range = op9_topk.needed_tiles, DataFrame.repartition, DataFrame.repartitionByRange

    def counted(tiles, columns):
        found = needed(tiles, columns)
        sent.append((found.count(), tiles.count() * columns.count()))
        return found

    monkeypatch.setattr(op9_topk, "needed_tiles", counted)
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *c: (parts.append(n), by_hash(self, n, *c))[1])
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, n, *c: (parts.append(n), by_range(self, n, *c))[1])
    assert by_query(op9_topk.top_k(rows, F.col("vec_id") % 10 == 0, 10)) == brute(vectors, [i for i in vectors if i % 10 == 0], 10)
    # the lengths of 7 in 8 vectors are a hundredth of the others': their tiles go to no query with ten long neighbours
    assert sum(a for a, _ in sent) < 0.4 * sum(b for _, b in sent) or sent[-1][0] == 0
    assert max(parts) <= op9_topk.UNITS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_large_components_are_exact(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(0, [3.0e9, 1.0]), (1, [3.0e5, 1.0]), (2, [3.0e5, 2.0])], "vec_id long, embedding array<double>")
    got = by_query(op9_topk.top_k(op9_topk.integer_vectors(big), F.col("vec_id") >= 0, 2))
    ints = {0: (3_072_000_000_000, 1024), 1: (307_200_000, 1024), 2: (307_200_000, 2048)}
    dot = lambda a, b: min((1 << 63) - 1, sum(x * y for x, y in zip(ints[a], ints[b], strict=True)))
    assert got[1] == [(0, dot(1, 0)), (2, dot(1, 2))] and got[0] == [(1, dot(0, 1)), (2, dot(0, 2))]  # both at the end of the range of long: a tie


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "tokens"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = (before, docs)
        assert name == "tokens" or docs.columns == columns
    a, b = kept["quality"]
    model = op1_quality.fit(a, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert b.count() == op1_quality.with_score(a, model).where("score >= 0.7").count() < a.count()
    a, b = kept["near_duplicates"]
    assert {r["doc_id"] for r in b.collect()} == {r["component_id"] for r in op6_simhash.simhash_components(a, **op6_simhash.CORPUS).collect()}
    a, b = kept["secrets"]
    assert a.count() == b.count() and op7_secrets.scan(b).where("size(spans) > 0").count() == 0 < op7_secrets.scan(a).where("size(spans) > 0").count()
    a, b = kept["mixture"]
    assert 0.9 * 1.5 < b.selectExpr("sum(size(split(trim(text), '\\\\s+')))").first()[0] / a.selectExpr("sum(size(split(trim(text), '\\\\s+')))").first()[0] < 1.1 * 1.5
    a, b = kept["tokens"]
    assert a.count() == b.count() and b.selectExpr("sum(n_bytes)").first() == a.selectExpr("sum(octet_length(text))").first()
    assert corpus_pipeline.run(spark, DATA).count() == b.count()


def test_mixture_gives_each_source_its_target(spark):
    rnd = random.Random(11)
    text = lambda: " ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randrange(20, 60)))
    rows = []
    for k in range(900):  # a third without an id, a third sharing ids across sources
        rows.append((None if k % 3 == 0 else k % 30 if k % 3 == 1 else k, text(), "abc"[k * 7 % 10 % 3], k))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k long")
    got = corpus_pipeline.mixture(spark, docs, DATA).collect()
    target = {r["source"]: r["target"] for r in op2_mix.mix(docs).collect()}
    texts, words, times = {k: (i, t, s) for i, t, s, k in rows}, dict.fromkeys("abc", 0), {}
    for r in got:
        assert texts[r["k"]] == (r["doc_id"], r["text"], r["source"])
        words[r["source"]] += len(r["text"].split())
        times[r["k"]] = times.get(r["k"], 0) + 1
    assert max(times.values()) <= 2
    assert all(abs(words[s] - target[s]) < 0.02 * target[s] for s in "abc"), (words, target)
    # rows without an id differ in how often they come
    assert len({times.get(k, 0) for k in range(0, 900, 3) if rows[k][2] == "b"}) > 1


CLASHES = ("row", "row_2", "times", "times_2", "score", "key", "_key", "_id", "_times", "_copy", "_row", "_text", "_quality_score", "at", "hash", "size", "fingerprint", "document", "taken")


def odd_documents(spark):
    """Null ids and texts, repeated rows, ties, an empty and a very long text, and columns named like what stages make."""
    body = "the first word of a plain text and many more words of another kind"
    rows = [(None, None, None), (None, body, "a"), (None, body, "a"), (1, "", "a"), (2, None, "b"), (3, body + " here", "b"), (3, body + " here", "b"), (3, "something else that is not alike at all", "b")]
    rows += [(4, " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000)), "c"), (5, " \t ", "c")]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *(f"{k}{c}" for c in CLASHES)) for k, r in enumerate(rows)], schema)


def test_stages_keep_odd_rows_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(op1_quality, "THRESHOLD", 0.0)
    monkeypatch.setattr(op1_quality.keep_good, "__defaults__", (0.0,))
    docs = odd_documents(spark)
    rows = sorted(map(repr, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), DATA)
        got = stage(spark, docs, DATA)
        assert none.count() == 0 and none.columns == got.columns
        if name == "tokens":
            assert got.count() == len(rows)
            continue
        assert got.columns == docs.columns
        found = got.collect()
        assert set(map(repr, found)) <= set(rows) or name == "secrets"
        if name in ("quality", "secrets"):
            assert len(found) == len(rows)
        if name == "near_duplicates":
            # the wordless rows 1, 2, 5 and the null one are alike; body and body + here are too, and id 3 names that group
            assert sorted((r["doc_id"], (r["text"] or "")[:9]) for r in found) == [(1, ""), (3, "something"), (3, "the first"), (4, "w0x0 w1x1")]
        if name == "mixture":
            words = lambda rs: sum(len((r["text"] or "").split()) for r in rs)
            assert words(found) <= 2 * words(docs.collect())
            # texts without words stay once each, and repeated rows have their own shares
            assert sum(not (r["text"] or "").split() for r in found) == 4


def test_near_copies_of_a_table_equal_brute_force(spark):
    """All pairs of the documents of sf0.01 at 0.8: none is lost, and nothing else goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    white = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def shingles(text):
        w = white.findall(text.translate(lower))
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w)

    sets, by = [shingles(t) for _, t in rows], {}
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    pairs = 0
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in by.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            by[x].append(i)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                pairs += s != sets[j]
                a, b = sorted((root(i), root(j)))
                group[b] = a
    wordless = [i for i, s in enumerate(sets) if not s]
    for i in wordless:
        group[i] = wordless[0]
    assert pairs > 10
    expected = sorted(rows[i][0] for i in range(len(rows)) if root(i) == i)
    assert sorted(r["doc_id"] for r in op6_simhash.one_of_each(docs).collect()) == expected


def brute_kept(rows, least=0.8):
    """Ids that stay when texts of a Jaccard similarity of `least` over five-word shingles are joined, all pairs compared."""

    def shingles(text):
        w = text.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b) - 1e-9 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return sorted({g: min(i for (i, _), h in zip(rows, group, strict=True) if h == g) for g in group}.values())


def test_one_of_each_equals_brute_force(spark):
    rnd = random.Random(12)
    words = lambda n: ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    texts = []
    for _ in range(12):
        body, line = words(rnd.randrange(60, 250)), words(rnd.randrange(5, 19))
        texts += [body + line * k for k in (1, 5, 8)]  # repeated lines
        texts += [body + words(rnd.randrange(60)) for _ in range(3)] + [words(10) + body[: len(body) * 9 // 10]]
        texts += [words(rnd.randrange(20, 100)) + line * 40 for _ in range(3)]  # dominating lines
    for _ in range(150):  # short texts, one word added or changed at an end
        short = words(rnd.randrange(5, 13))
        texts += [short, rnd.choice([short + words(1), words(1) + short, short[:-1] + words(1), short * 2])]
    rows = list(enumerate(" ".join(t) for t in texts))
    kept = op6_simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(rows)
