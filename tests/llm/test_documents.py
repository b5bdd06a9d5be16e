"""Mixing, fingerprints, near copies, secrets, repeats and tokens, against brute force."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from siltlog.llm import components, op2_mix, op4_fingerprint, op6_simhash, op7_secrets, op8_suffix, op10_bpe, repeats

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


def odd_rows(spark):
    rnd = random.Random(1)
    words = lambda n: " ".join(rnd.choice("abcdefghij") * rnd.randrange(1, 6) for _ in range(n))
    same, long_ = words(40), words(9000)
    rows = [(None, None, None), (None, same, "s"), (1, "", "s"), (2, None, None), (3, same, "s"), (3, same, "s"), (3, "other", "t"), (4, same + " tail", "t"), (5, long_, "t"), (6, long_ + " x", None), (7, " \t\n", "s"), (8, "one", "u"), (9, "one two", "u"), (10, "Ａ É ß 🙂 x", "u")]
    rows += [(11 + i, f"{words(30)} {same} {words(30)}", "s") for i in range(12)]
    return spark.createDataFrame([(*r, 1, "c", 0) for r in rows], SCHEMA + ", size long, fingerprint string, taken long"), rows


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]


# mixing


def seats_one_by_one(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_apportionment_equals_handing_out_one_by_one(spark):
    rnd = random.Random(4)
    groups = [[rnd.choice([0.0, 1.0, 2.5, 7.0, 40.0, 300.0]) for _ in range(rnd.randrange(1, 9))] for _ in range(30)]
    seats = [rnd.randrange(0, 60) for _ in groups]
    rows = [(g, i, w, seats[g]) for g, ws in enumerate(groups) for i, w in enumerate(ws)]
    got = op2_mix.apportion(spark.createDataFrame(rows, "g int, i int, w double, s long"), ["g"], ["i"], "w", "s").orderBy("g", "i").collect()
    expected = [q for ws, s in zip(groups, seats, strict=True) for q in (seats_one_by_one(ws, s) if sum(ws) else [0] * len(ws))]
    assert [r["quota"] for r in got] == expected


def filled(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * sum(sizes)
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        left = 0.0
        for i in list(open_):
            target[i] += share[i]
            if target[i] >= 2 * sizes[i]:
                left += target[i] - 2 * sizes[i]
                target[i] = 2.0 * sizes[i]
                open_.remove(i)
    return target


def test_mix(spark):
    docs, rows = odd_rows(spark)
    got = op2_mix.mix(docs).collect()
    assert len(got) == len(rows) and got == op2_mix.mix(docs).collect() or sorted(map(repr, got)) == sorted(map(repr, op2_mix.mix(docs).collect()))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(names, filled([sizes[s] for s in names]), strict=True))
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 64 for s in names)
    assert op2_mix.mix(docs.limit(0)).count() == 0


def test_mix_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(op2_mix, "SHARD_WORDS", 500)
    got = op2_mix.mix(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - x) < 0.03 * t for t, x in by.values())


# fingerprints


def plain(text):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return " ".join(nfkc(nfkc(text or "").casefold()).split())


def test_fingerprint_query_equals_brute_force(spark):
    docs = documents(spark)
    got = sorted(op4_fingerprint.query(spark, DATA).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(docs)
    prints = {}
    for k, (r, (i, text)) in enumerate(zip(got, docs, strict=True)):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (float(plain(edited) == plain(text)), float(plain(after) == plain(text)))
        assert prints.setdefault(plain(text), r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_of_odd_rows(spark):
    docs, rows = odd_rows(spark)
    got = op4_fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows)
    assert {r["canonical"] for r in got} == {plain(t) for _, t, _ in rows}
    assert len({r["fingerprint"] for r in got}) == len({plain(t) for _, t, _ in rows})
    assert op4_fingerprint.fingerprints(docs.limit(0)).count() == 0
    near = op4_fingerprint.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"]).collect()
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    order = sorted(((-1 if i is None else i, t or "") for i, t, _ in rows), key=lambda r: (r[0], signed(r[1])))
    follow = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["next_text"]) for r in near)
    assert sorted((*a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)) == follow


def test_mixed_hashes_are_told_apart(spark):
    df = spark.createDataFrame([("h", "a", "A"), ("h", "b", "B"), ("g", "c", "C"), ("g", "c", "C")], "hash string, canonical string, strong string")
    got = op4_fingerprint.resolved(df, op4_fingerprint.mixed_hashes(df), {"print": ""}).collect()
    assert len({r["print"] for r in got}) == 3 and {r["print"] for r in got if r["hash"] == "g"} == {"g"}


def test_colliding_hashes_of_texts_and_edited_texts(spark, monkeypatch):
    wide = op4_fingerprint.wide_hash
    monkeypatch.setattr(op4_fingerprint, "wide_hash", lambda x: F.substring(wide(x), 1, 1))
    docs = documents(spark)
    prints = {}
    for k, r in enumerate(sorted(op4_fingerprint.query(spark, DATA).collect(), key=lambda r: r["doc_id"])):
        text, after = docs[k][1], docs[(k + 1) % len(docs)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert (r["near_edited"], r["near_next"]) == (float(plain(edited) == plain(text)), float(plain(after) == plain(text)))
        for t, found in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(plain(t), found) == found
    assert len(set(prints.values())) == len(prints)


def test_rows_of_a_hot_id_follow_each_other(spark):
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"text {k}") for k in range(600)]
    got = op4_fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"]).collect()
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], signed(r[1])))
    assert {r["text"]: r["next_text"] for r in got} == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)} and len(got) == 600


def test_texts_are_made_canonical_once(spark):
    plan = op4_fingerprint.edited_rows(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    # three for a text, once each for the rows, for the first rows of ranges and for the edited texts
    assert plan.count("reflect(") <= 9 and op4_fingerprint.edited_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# near copies


def brute_components(prints, ids):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [min((ids[j] for j in range(len(ids)) if group[j] == group[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def brute_print(text, words=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    parts = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_of_odd_rows(spark):
    docs, rows = odd_rows(spark)
    got = op6_simhash.simhash_components(docs).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    expected = brute_components(prints, [i for i, _, _ in rows])
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == sorted(((i, f"{p:016x}", c) for (i, _, _), p, c in zip(rows, prints, expected, strict=True)), key=key)
    assert op6_simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [5, 2048])
def test_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(op6_simhash, "TILE", tile)
    rnd = random.Random(8)
    prints = {rnd.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:
        for _ in range(rnd.randrange(6)):
            p ^= 1 << rnd.randrange(64)
            p ^= 1 << rnd.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    df = spark.createDataFrame([(f"{p:016x}", 1) for p in prints], "fingerprint string, size int")
    roots = {r["node"]: r["root"] for r in components.components(op6_simhash.near_links(df, 64, op6_simhash.NEAR)).collect()}
    expected = brute_components(prints, prints)
    assert [roots.get(f"{p:016x}", f"{p:016x}") for p in prints] == [f"{c:016x}" for c in expected]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (205, 204), (205, 204)]
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert roots == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}, 204: 204, 205: 204}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_near_copy(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(25):
        base = [word() for _ in range(200)]
        rows.append((10 * i, " ".join(base)))
        for k in (1, 2):  # two words changed of 200: 190 of 206 different shingles are shared at least
            copy = list(base)
            for at in rnd.sample(range(200), 2):
                copy[at] = word()
            rows.append((10 * i + k, " ".join(copy)))
        rows.append((10 * i + 5, " ".join(base[:80] + [word() for _ in range(120)])))  # shares a passage only
    kept = op6_simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(10 * i + k for i in range(25) for k in (0, 5))


def new_words(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def kept_ids(spark, rows):
    return sorted(r["doc_id"] for r in op6_simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_near_copies_that_repeat_a_line_more_often(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(12):  # nearly the same different shingles, once and 10 times
        body, line = new_words(rnd, 200), new_words(rnd, 19)
        rows += [(2 * i, " ".join(body + line)), (2 * i + 1, " ".join(body + line * 10))]
    assert kept_ids(spark, rows) == [2 * i for i in range(12)]


def test_different_sets_under_one_fingerprint(spark, monkeypatch):
    rnd = random.Random(6)
    rows = []
    for i in range(6):  # a filler line 40 times between different bodies, as in menus
        line = new_words(rnd, 5)
        rows += [(10 * i + k, " ".join(new_words(rnd, 100) + line * 40)) for k in range(4)]
    assert kept_ids(spark, rows) == [r[0] for r in rows]
    # even where the bits of all texts are the same, sets decide
    monkeypatch.setattr(op6_simhash, "fingerprint", lambda parts, bits=64, seed=42: np.zeros(bits // 64, np.uint64))
    same = new_words(rnd, 100)
    assert kept_ids(spark, [(1, " ".join(same)), (2, " ".join(same + new_words(rnd, 2))), (3, " ".join(new_words(rnd, 101))), (4, " ".join(same * 2))]) == [1, 3]


@pytest.mark.parametrize(("few", "more"), [(4, 5), (8, 10), (12, 15), (63, 64), (70, 87)])
def test_short_texts_stay_candidates(few, more):
    sets = [[b"%d %d" % (i, j) for j in range(more)] for i in range(600)]
    a, b = (np.array([op6_simhash.fingerprint(s[:n], 512) for s in sets]) for n in (few, more))
    hits = op6_simhash.CORPUS["near"].hits(a, b, np.full(600, few), np.full(600, more))
    assert hits.diagonal().all()


def test_chances_of_differing_bits():
    # 4 and 5 shingles: 2 of 4 have the bit, and so has the fifth
    assert op6_simhash.differing(4, 5, 4) == pytest.approx(6 / 16 / 2)
    assert op6_simhash.differing(9, 9, 9) == 0 and op6_simhash.differing(1, 1, 0) == 0.5


# secrets

BASE = [
    (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def base_spans(text):
    return sorted((m.start(), m.end(), k) for k, (p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m))


def scanned(text):
    data = text.encode()
    return op7_secrets.in_code_points(data, op7_secrets.scanner(op7_secrets.RULES).spans(data))


def test_scanner_equals_re():
    rnd = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "abc", "deadbeef", "0123456789abcdef", "AKIA", "AKIAABCDEFGH", "XYZ12345678", "é", "🙂", "-", "_", "g", "\n", "A1B2"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(25)))
        assert [s for s in scanned(text) if s[2] < 3] == base_spans(text), text


def test_added_rules_and_redaction(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    text = f"é {key} ghp_{'Zq' * 20} xoxb-1234567890-abc eyJhbGciOi.eyJzdWIi.abcdefghijk"
    assert [op7_secrets.RULES[k].kind for _, _, k in scanned(text)] == ["pem", "github", "slack", "jwt"]
    assert scanned(text)[0][:2] == (2, 2 + len(key))
    docs = spark.createDataFrame([(1, "x token=abcdefghijklmnop y", "k"), (2, None, "k"), (3, "nothing", None)], "doc_id long, text string, spans string")
    assert [tuple(r) for r in op7_secrets.redact(docs).orderBy("doc_id").collect()] == [(1, "x [assign] y", "k"), (2, None, "k"), (3, "nothing", None)]


def test_secret_query_equals_brute_force(spark):
    docs = dict(documents(spark))
    kinds = op7_secrets.BASE
    for r in op7_secrets.query(spark, DATA).collect():
        spans = base_spans(docs[r["doc_id"]])
        text = ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[2] == k for s in spans) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    odd, rows = odd_rows(spark)
    assert op7_secrets.scan(odd).count() == len(rows) and op7_secrets.scan(odd.limit(0)).count() == 0


# repeats


def test_repeat_groups():
    import numpy as np

    rnd = random.Random(2)
    for k in range(150):
        n, least = rnd.randrange(1, 90), rnd.choice([1, 2, 3, 5, 9, 20])
        s = bytes(rnd.choice(b"ab" if k % 2 else b"abcdef") for _ in range(n))
        s = (s + s[: n // 2] + b"x" + s if k % 3 == 0 else s) + b"\xff"
        valid = np.array([i + least <= len(s) and rnd.random() < 0.8 for i in range(len(s))])
        seen, expected = set(), []
        for i in range(len(s)):
            w = s[i : i + least]
            expected.append(bool(valid[i]) and w in seen)
            if valid[i]:
                seen.add(w)
        assert repeats.later_windows(np.frombuffer(s, np.uint8), valid, least).tolist() == expected


def brute_removed(docs):
    seen, out = set(), []
    for i, text in docs:
        data = (text or "").encode()
        gone, new = bytearray(len(data)), []
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
        del new
    return out


@pytest.mark.parametrize("many", [2, 64])
def test_repeats_equal_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(op8_suffix, "MANY", many)
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randrange(1, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    shared = [words(60) for _ in range(3)]
    docs = [(i, f"{words(rnd.randrange(40))} {rnd.choice(shared)} {words(rnd.randrange(40))}") for i in range(40)]
    docs += [(40, "ab" * 400), (41, "xab" * 100 + words(3)), (42, docs[0][1]), (43, docs[1][1][30:]), (44, ""), (45, None), (46, "short"), (47, "\x00" * 300 + "\x00ÿ")]
    got = op8_suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got] == brute_removed(docs)


def test_repeat_query_equals_brute_force(spark):
    expected = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in brute_removed(documents(spark))]
    got = op8_suffix.query(spark, DATA).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got] == expected


def test_one_bucket_is_held_at_a_time():
    import pyarrow as pa

    made = []

    def batches():
        for bucket in range(50):
            for _ in range(3):
                e = np.zeros(100, op8_suffix.ENTRY)
                e["key"] = bucket
                made.append(bucket)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([op8_suffix.CONTEXT], pa.int32()), pa.array([op8_suffix.packed(e)], pa.binary())], names=["bucket", "kind", "blob"])

    for k, by in enumerate(op8_suffix.by_bucket(batches())):
        assert set(by[op8_suffix.CONTEXT]["key"].tolist()) == {k} and len(by[op8_suffix.CONTEXT]) == 300 and len(made) <= 3 * (k + 1) + 1


def test_repeats_in_odd_rows(spark):
    docs, rows = odd_rows(spark)
    got = op8_suffix.remove_repeats(docs).collect()
    assert len(got) == len(rows) and op8_suffix.remove_repeats(docs.limit(0)).count() == 0
    # the row without an id comes first, and repeated rows fare alike
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0, 0]
    assert len({tuple(r)[1:] for r in got if r["doc_id"] == 3 and r["n_bytes"] > 10}) == 1


def test_texts_of_one_short_hash_without_ids(spark):
    passage = " ".join(f"passage{k:03d}" for k in range(14))
    same_place = [f"{i:07d} {passage}" for i in (6996, 108496)]
    short_and_long = [f"{i:07d}" if i % 2 else f"{i:07d} {passage} {passage[::-1]}" for i in (197475, 206624)]
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)
    for texts in (same_place, short_and_long):
        assert len({signed(t) & 0xFFFFFFFF for t in texts}) == 1
        docs = [(None, t) for t in sorted(texts, key=signed)] + [(1, passage[::-1] + "x")]
        got = op8_suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(x[1:] for x in brute_removed(docs))


def test_window_hashes_are_independent(monkeypatch):
    mixed = lambda x: int(op8_suffix._mix(np.array([x], np.uint64))[0])
    odd, whole = int(op8_suffix._ODD[1]), 1 << 64
    a, b = (5, 77), [123456789]
    b.append((b[0] + (mixed(a[0]) - mixed(a[1])) * pow(odd, -1, whole)) % whole)  # mix(a) + b * odd agree, a and b don't

    def init(self, data):
        n = len(data)
        self.inverse = [np.ones(n, np.uint64)] * 2
        self.sums = [np.zeros(n + 1, np.uint64) for _ in "ab"]
        for s, x in zip(self.sums, (a, b), strict=True):
            s[op8_suffix.LENGTH :] = x

    monkeypatch.setattr(op8_suffix.Hashes, "__init__", init)
    w = op8_suffix.windows_of(np.zeros(op8_suffix.LENGTH + 1, np.uint8), 0, 0, 0, 1)
    assert w["key"][0] != w["key"][1] and w["ctx"][0] != w["ctx"][1]


# tokens


@pytest.fixture(scope="module")
def both():
    path, pattern = op10_bpe.public_vocabulary()
    codec = op10_bpe.codec(path, pattern)
    return codec, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.vocabulary.ranks, special_tokens={})


def test_encoding_equals_tiktoken(both):
    codec, library = both
    rnd = random.Random(1)
    letters = "abcdefgh etaoin  \n\t'sdllvre.,!?0123456789éñüß漢字🙂 \x1c _-/\\ABC\x85 "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    texts += ["a" * n for n in range(0, 200, 7)] + ["".join(rnd.choice("ab") for _ in range(n)) for n in range(0, 400, 13)] + ["<|endoftext|>", " ", "\n", "a b", " a  b "]
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()


def test_prefix_table_appends_and_edits(both):
    codec, _ = both
    rnd = random.Random(9)
    whole = lambda b: op10_bpe.PrefixTable(codec.vocabulary, b).tokens()
    table, text = op10_bpe.PrefixTable(codec.vocabulary), b""
    for _ in range(60):
        more = bytes(rnd.choice(b"etaoinshr") for _ in range(rnd.randrange(5)))
        text += more
        assert table.append(more).tokens() == whole(text)
        a, b = sorted(rnd.randrange(len(text) + 1) for _ in range(2))
        if b - a < 6:
            text = text[:a] + more + text[b:]
            assert table.edit(a, b, more).tokens() == whole(text)


def test_token_query_and_odd_rows(spark, both):
    _, library = both
    docs = dict(documents(spark))
    for r in op10_bpe.query(spark, DATA).collect():
        text = docs[r["doc_id"]]
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    odd, rows = odd_rows(spark)
    got = op10_bpe.encode_decode(odd, *op10_bpe.public_vocabulary()).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t, _ in rows)
    assert op10_bpe.encode_decode(odd.limit(0), *op10_bpe.public_vocabulary()).count() == 0
