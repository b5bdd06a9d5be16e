"""Quality, language and toxicity: held-out accuracy, and texts that have nothing to go by."""

import math
import unicodedata
import zlib

import numpy as np
import pytest
import zstandard

from siltlog.llm import common, op1_quality, op3_language, op5_toxicity

DATA = "/root/testdata/sf0.01"
ODD = [(None, None), (1, ""), (2, None), (3, "\x00퟿ 🙂"), (4, "word " * 60_000), (4, "word " * 60_000), (5, "!!!"), (6, "漢字")]
ODD_SCHEMA = "doc_id long, text string"


def rest(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def with_odd_rows(spark):
    """Rows with every trouble, and columns named like the results."""
    return spark.createDataFrame([(*r, 0.5, "x") for r in ODD], ODD_SCHEMA + ", score double, lang string")


def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_quality_on_held_out_rows(spark):
    truth = labels(spark)
    got = {r["doc_id"]: r for r in op1_quality.query(spark, DATA).collect()}
    assert len(got) == 1000
    assert all(r["held_out"] == (rest(i, 4) == 2) and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    held = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i]["quality"] for i in held]) > 0.93


def test_quality_of_odd_rows(spark):
    model = op1_quality.train([("fine words here", 1), ("BAD!! BAD!! BAD!!", 0)] * 20)
    docs = with_odd_rows(spark).select("doc_id", "text")
    scored = op1_quality.with_score(docs, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if not r["text"]}) == 1
    kept = op1_quality.keep_good(with_odd_rows(spark), model, 0.0)
    assert kept.columns == ["doc_id", "text", "score", "lang"] and kept.count() == len(ODD)
    assert op1_quality.with_score(docs.limit(0), model).count() == 0
    again = op1_quality.with_score(with_odd_rows(spark), model)
    assert again.columns == ["doc_id", "text", "lang", "score"] and {r["score"] for r in again.collect()} == {r["score"] for r in scored}


def test_quality_features_do_not_depend_on_the_batch():
    texts = ["one two two", "", " ", "é🙂 word", "x"]
    model = op1_quality.train([("aa bb", 1), ("cc dd cc", 0), ("aa cc", 1), ("dd dd", 0)])
    alone = [model.scores([t])[0] for t in texts]
    assert np.allclose(model.scores(texts), alone) and len(model.scores([])) == 0


def plain_quality(model, text):
    """The score of a text, feature by feature."""
    mask = (1 << 64) - 1
    bucket = lambda h: (h * 0x9E3779B97F4A7C15 & mask) >> (64 - op1_quality.BUCKETS_LOG2)

    def number(s):
        h = 0
        for c in s:
            h = (h * 0x100000001B3 + ord(c) + 1) & mask
        return h

    found = [bucket((number((text + "\0" * 4)[i : i + n]) + n) & mask) for i in range(len(text)) for n in (3, 4)]
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r\0":
            words += [word] if word else []
            word = ""
        else:
            word += c
    found += [bucket(sum((ord(c) + 1) * pow(0x100000001B3, k, 1 << 64) for k, c in enumerate(w)) & mask) for w in words]
    found += [bucket(1 if a == b else 2) for a, b in zip(words, words[1:])]
    mean = sum(float(model.gains[b]) for b in found) / max(1, len(found))
    return 1 / (1 + math.exp(-(mean + model.bias)))


def test_quality_equals_plain_scoring(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = op1_quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), 300)
    texts = [r["text"] or "" for r in docs.limit(60).collect()] + ["", " ", "é漢字🙂 é漢字🙂", "x", "a\0b c"]
    assert np.allclose(model.scores(texts), [plain_quality(model, t) for t in texts], rtol=1e-9)


def test_labels_of_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(30)] + [(None, "none")], "doc_id long, text string")
    marks = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    got = common.labelled_sample(docs, marks, "quality", 4, 9, 10)
    assert got == [("text 0", 1), ("text 1", 0)]
    longer = spark.createDataFrame([(1, "a" * 50), (2, "b" * 20), (3, "c" * 30)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    for chars, kept in ((100, "abc"), (99, "bc"), (20, "b"), (19, "")):
        assert [t[0] for t, _ in common.labelled_sample(longer, marks, "quality", 4, 9, 10, chars)] == list(kept)


@pytest.mark.parametrize("module", [op1_quality, op5_toxicity])
def test_one_class_or_none(module):
    assert module.train([]).scores(["a"])[0] == pytest.approx(0.5)
    share = module.train([("a", 1)] * 8).scores(["zz"])[0]
    assert share == pytest.approx(0.9)


def test_language_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op3_language.query(spark, DATA).collect()}
    assert len(got) == 1000 and {r["lang_pred"] for r in got.values()} <= set(truth.values()) | {"und"}
    held = [i for i in truth if rest(i, 3) == 1]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.95


def test_language_of_odd_rows(spark):
    learn = spark.createDataFrame([(i, t * 30, lang, "s") for i in range(40) for t, lang in (("the word and this ", "en"), ("le mot et ceci ", "fr"))] + [(99, "x", None, None)], "doc_id long, text string, lang string, source string")
    model = op3_language.fit(learn)
    assert model.languages == ("en", "fr")
    got = {(r["doc_id"], r["best_lang"], r["score"]) for r in op3_language.predict(with_odd_rows(spark), model).where("doc_id in (1, 2, 5) or doc_id is null").collect()}
    assert got == {(None, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0), (5, "und", 0.0)}
    assert model.predict("this word and the word and this the word")[0] == "en" and model.predict("ceci et le mot et le mot et ceci")[0] == "fr"
    assert op3_language.predict(learn.limit(0), model).count() == 0
    assert op3_language.fit(learn.limit(0)).predict("word") == ("und", 0.0, 0.0)


def test_toxicity_on_held_out_rows(spark):
    truth = labels(spark)
    got = {r["doc_id"]: r for r in op5_toxicity.query(spark, DATA).collect()}
    assert len(got) == 1000 and all(r["held_out"] == (rest(i, 5) == 0) and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    held = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i]["toxic"] for i in held]) > 0.93


@pytest.mark.parametrize(("module", "column"), [(op1_quality, "quality"), (op5_toxicity, "toxic")])
def test_both_classes_are_found(spark, module, column):
    """On sf0.1, as sf0.01 holds out six toxic documents only."""
    larger = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    got = [(r["predicted"], truth[r["doc_id"]]) for r in module.query(spark, larger).collect() if r["held_out"] and r["doc_id"] in truth]
    for label in (0, 1):
        assert np.mean([p == label for p, y in got if y == label]) > 0.85


def plain_toxicity(model, text):
    """The score of a text by walking each tree and the calibration's steps."""
    tokens = text.split()
    x = model.lexicon.features(text)
    kinds = [model.lexicon.kind(t) for t in tokens]
    hits = [i for i, k in enumerate(kinds) if k & 3]
    you = [i for i, k in enumerate(kinds) if k & op5_toxicity.YOU]
    n = max(1, len(tokens))
    size = max(1, len(text.encode()))
    signs = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    assert x == pytest.approx([
        sum(k & 1 for k in kinds) / n, sum(k & 1 for k in kinds), sum(k & 2 > 0 for k in kinds) / n, sum(k & 2 > 0 for k in kinds),
        sum(any(abs(i - j) <= op5_toxicity.NEAR for j in you) for i in hits) / n, len(you) / n, sum(k & op5_toxicity.CAPS > 0 for k in kinds) / n,
        sum("A" <= c <= "Z" for c in text) / size, signs / size, text.count("!") / size, sum(k & op5_toxicity.HIDDEN > 0 for k in kinds) / n, math.log1p(len(tokens)),
    ])
    margin = model.base
    for tree in model.trees:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        margin += op5_toxicity.RATE * tree
    low = max([i for i, m in enumerate(model.margins) if m <= margin], default=0)
    high = min([i for i, m in enumerate(model.margins) if m >= margin], default=len(model.margins) - 1)
    a, b = model.margins[low], model.margins[high]
    part = (margin - a) / (b - a) if b > a else 0
    return model.chances[low] + part * (model.chances[high] - model.chances[low])


def test_toxicity_equals_plain_scoring(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = op5_toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), 400)
    texts = [r["text"] or "" for r in docs.limit(200).collect()] + ["", "you IDIOT! 1d1ot", "!?"]
    assert np.allclose(model.scores(texts), [plain_toxicity(model, t) for t in texts], rtol=1e-6, atol=1e-9)


def test_isotonic_fit_is_the_least_squares_one():
    rng = np.random.default_rng(2)
    margin, label = rng.normal(size=60), rng.integers(0, 2, 60)
    got_margin, got = op5_toxicity.isotonic(margin, label)
    y = label[np.argsort(margin)]
    # the greatest of least means: max over beginnings, min over ends
    best = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    for m, b in zip(np.sort(margin), best, strict=True):
        pool = [k for k in range(60) if best[k] == pytest.approx(b)]
        assert np.interp(m, got_margin, got) == pytest.approx((b * len(pool) + 0.02) / (len(pool) + 0.04), abs=1e-6)


def test_toxicity_features_and_calibration(spark):
    lexicon = op5_toxicity.Lexicon(op5_toxicity.INSULTS, frozenset({"vequ"}))
    f = dict(zip(op5_toxicity.NAMES, lexicon.features("You 1d1ot! vequaire HELLO there"), strict=True))
    assert f["lexicon count"] == 1 and f["stem count"] == 1 and f["near second person"] == 0.4 and f["capital words"] == 0.2 and f["obfuscated"] == 0.2
    margins, chances = op5_toxicity.isotonic(np.array([0.0, 1.0, 1.0, 2.0, 3.0]), np.array([0, 1, 0, 0, 1]))
    assert (np.diff(margins) >= 0).all() and (np.diff(chances) >= 0).all()
    model = op5_toxicity.train([("you idiot", 1), ("a fine day", 0)] * 40)
    scored = op5_toxicity.with_score(with_odd_rows(spark), model).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert op5_toxicity.with_score(with_odd_rows(spark).limit(0), model).count() == 0


def test_dictionaries_reach_all_over_texts():
    opening = "permission is hereby granted to any person " * 20
    texts = [opening + " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)) for i in range(40)]
    texts = [op3_language.folded(t).encode() for t in texts]
    made = op3_language.dictionary(texts, 16_000)
    assert len(made) == 16_000 == len(op3_language.dictionary([b" ab ", *texts], 16_000)) and made == op3_language.dictionary(texts, 16_000)
    assert made.count(b"permission is hereby") < 16_000 // 43 // 2  # from their beginnings it would be nothing else
    assert op3_language.dictionary([b" one two "], 100) == b" one two "
    assert op3_language.dictionary([], 100) == b""


def test_languages_are_learned_whatever_the_ids(spark):
    make = lambda lang, k: " ".join(f"{lang}{chr(97 + k % 26)}{chr(97 + (k * j) % 26)}" for j in range(1, 20))
    texts = [(make(lang, k), lang) for lang, n in (("en", 400), ("fr", 400), ("de", 20)) for k in range(n)]
    schema = "doc_id long, text string, lang string"
    learned = next(i for i in range(9) if rest(i, 3) != 1)
    for ids in ([None] * len(texts), [learned] * len(texts), range(len(texts))):
        model = op3_language.fit(spark.createDataFrame([(i, *t) for i, t in zip(ids, texts, strict=True)], schema), 30)
        assert model.languages == ("de", "en", "fr") and model.predict("fraa frab frac")[0] == "fr"
    # a text that most rows repeat counts once
    model = op3_language.fit(spark.createDataFrame([(None, "same text", "en")] * 900 + [(None, f"other {make('en', k)}", "en") for k in range(8)], schema), 9)
    assert model.dictionaries[0].count(b" same text ") == 1 and model.dictionaries[0].count(b" other ") == 8
    many = op3_language.fit(spark.createDataFrame([(k, make(f"{chr(97 + k // 26)}{chr(97 + k % 26)}", k), f"l{k:03d}") for k in range(600) for _ in range(2)], schema))
    assert sum(rest(k, 3) != 1 for k in range(600)) == len(many.languages) > 350


def test_language_query_equals_plain_compression(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = op3_language.fit(docs)
    plain = []
    for d in model.dictionaries:
        raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        plain.append(zstandard.ZstdCompressor(level=op3_language.LEVEL, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in op3_language.query(spark, DATA).collect():
        words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in texts[r["doc_id"]].lower()).split()
        if not any(unicodedata.category(c)[0] == "L" for w in words for c in w):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        data = f" {' '.join(words)} ".encode()
        again = bytes(data[i % len(data)] for i in range(op3_language.AGAIN_BYTES))
        sizes = [len(c.compress(data + again)) for c in plain]
        assert r["lang_pred"] == model.languages[sizes.index(min(sizes))]
