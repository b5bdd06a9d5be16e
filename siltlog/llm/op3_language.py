"""Language identification by compression.

For each language a zstandard compressor is primed with raw content: texts of that language. A text is compressed by
each of them; the language whose compressor needs the fewest bytes is chosen, and the choice is rejected when the next
one needs hardly more.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltlog.llm.common import held_out, table, written

NAME = "op3_language"
#: So many different texts of each language are read for the dictionaries, or all if there are fewer.
TEXTS_PER_LANGUAGE = 120
#: So many times as many pass the first choice, which goes by an estimate of how many there are.
SPARE = 4
#: Bytes of a language's dictionary at most, an equal part from each of its texts.
DICTIONARY_BYTES = 48_000
#: Places of a text that its part comes from, chosen with the seed.
PIECES, SEED = 4, 42
LEVEL = 6
#: The next language must need this much more, as a part of the smallest size, or the choice is rejected.
MARGIN = 0.02
UNKNOWN = "und"
#: Bytes behind every text, of its endless repetition: zstandard stores what it would hardly shrink, under any dictionary
#: alike, and a text that comes again always shrinks. What is repeated costs next to nothing, so the first time decides.
AGAIN_BYTES = 768

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def folded(text: str) -> str:
    """Lower-case words with a space before and behind each: dictionaries and texts are compared in this form."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def pieces(data: bytes, size: int) -> bytes:
    """size bytes of data, or all if it has no more: PIECES of them, each from a seeded place in its own stretch of data."""
    if len(data) <= size:
        return data
    n = max(1, min(PIECES, size))
    out = []
    for k in range(n):
        begin, end = len(data) * k // n, len(data) * (k + 1) // n
        take = size * (k + 1) // n - size * k // n
        at = begin + xxhash.xxh64_intdigest(data, SEED + k) % (end - begin - take + 1) if end - begin > take else begin
        out.append(data[at : at + take])
    return b"".join(out)


def dictionary(parts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """An equal part of every folded text, from places all over it; what short texts leave over goes to the longer ones."""
    left, shares = size, [0] * len(parts)
    for k, i in enumerate(sorted(range(len(parts)), key=lambda i: len(parts[i]))):
        shares[i] = min(len(parts[i]), left // (len(parts) - k))
        left -= shares[i]
    return b"".join(pieces(p, n) for p, n in zip(parts, shares, strict=True))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = LEVEL

    def compressors(self):
        return _compressors(self)

    def sizes(self, text: str) -> list[int]:
        """Bytes that the text needs under each language."""
        data = folded(text).encode()
        data += (data * (AGAIN_BYTES // len(data) + 1))[:AGAIN_BYTES]
        return [len(c.compress(data)) for c in self.compressors()]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); no letters: (und, 0, 0). Of equal sizes the first language in order wins.

        score is the share of the best language if each further byte makes one less likely, softer for long texts
        whose sizes vary more.
        """
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        low = min(sizes)
        best = sizes.index(low)
        others = sizes[:best] + sizes[best + 1 :]
        soft = 2 + 0.01 * low
        score = 1 / (1 + sum(math.exp(-(s - low) / soft) for s in others))
        return self.languages[best], score, (min(others) - low) / low if others else 1.0


@functools.lru_cache(maxsize=2)
def _compressors(model: Model) -> list:
    made = []
    for d in model.dictionaries:
        primed = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=model.level)
        made.append(zstandard.ZstdCompressor(level=model.level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


def fit(docs: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE, size: int = DICTIONARY_BYTES) -> Model:
    """A dictionary of `size` bytes at most for each language, from texts_per_language different texts of it.

    Rows with crc32(doc_id) mod 3 = 1, a null lang or a null or empty text are never learned from. Texts are chosen by
    the least hashes of the text itself, over the whole table, so copies count once and rows without an id like
    others. Any number of languages is learned: what reaches the driver is their dictionaries. Executors hold `size`
    bytes at most of each chosen text, from seeded places all over it.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    read = read.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 3, 1) & (F.length("text") > 0)).select("lang", "text", F.xxhash64("text", F.lit(SEED)).alias("place"))
    # a narrow row for each language; half of all hashes lie below zero
    counts = read.groupBy("lang").agg(F.approx_count_distinct("place").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(SPARE * texts_per_language)) / F.greatest("n", F.lit(1)))
    found = read.join(written(counts, "languages"), "lang").where(F.col("place") / float(1 << 64) + 0.5 <= share)
    found = found.groupBy("lang", "place").agg(F.min("text").alias("text"))  # copies meet here
    by = Window.partitionBy("lang").orderBy("place")
    chosen = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= texts_per_language)

    def cut(batches):
        for batch in batches:
            parts = [pieces(folded(t.as_py()).encode(), size) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], names=["lang", "rank", "part"])

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        return pa.table({"lang": rows.column("lang").slice(0, 1), "dictionary": pa.array([dictionary(rows.column("part").to_pylist(), size)], pa.binary())})

    parts = chosen.select("lang", "rank", "text").mapInArrow(cut, "lang string, rank int, part binary")
    made = parts.groupBy("lang").applyInArrow(joined, "lang string, dictionary binary").toArrow()
    by_name = sorted(zip(made.column("lang").to_pylist(), made.column("dictionary").to_pylist(), strict=True))
    return Model(tuple(lang for lang, _ in by_name), tuple(d for _, d in by_name))


def predict(docs: DataFrame, model: Model, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang (und where the margin is narrow), best_lang, score and margin of each whole text.

    Null texts and texts without a letter are und with score 0. Repeated rows stay, an empty table stays empty, other
    columns are not read. Texts are compressed whole and one by one.
    """

    def run(batches):
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] if x[2] >= margin else UNKNOWN for x in found], pa.string()),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.float64()),
                ],
                names=["doc_id", "lang", "best_lang", "score", "margin"],
            )

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, lang string, best_lang string, score double, margin double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("best_lang").alias("lang_pred"), "score", (F.col("lang") == UNKNOWN).alias("rejected"))


#: SQL has no compressor with a dictionary; tests measure held-out accuracy.
ORACLE_SQL = None
