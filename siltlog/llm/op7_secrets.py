"""Secret scan: all rules in one byte pass.

The rules, read backwards, are joined into one minimal automaton. A pass over the bytes of a text from its end marks,
for every rule, each position where a match starts. Matches are then taken from the left, each at the first mark at or
behind the end of the one before it, and as long as they can be; only those bytes are read again.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.automaton import Automaton, mirrored, parse
from siltlog.llm.common import table

NAME = "op7_secrets"


@dataclass(frozen=True)
class Rule:
    """A match is head, then tail, both as long as they can be; it is reported if its tail has at least `least` bytes.

    The head must be unambiguous: no match of it may be a prefix of another that a tail could still follow.
    """

    kind: str
    head: str
    tail: str
    least: int = 1
    ignore_case: bool = False


#: The first three are the contract's base rules; the others add spans of their own kinds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]+", 12, True),
    Rule("access", "AKIA", "[A-Z0-9]+", 14),
    Rule("hex", "", "[0-9a-f]{16,}", 16),
    Rule("github", "gh[oprsu]_", "[A-Za-z0-9]+", 36),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ", r"[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 8),
    Rule("pem", "-----BEGIN ", "[A-Z ]*PRIVATE KEY-----"),
    Rule("slack", "xox[abprs]-", r"[A-Za-z0-9\-]+", 10),
)
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [(parse(r.head, r.ignore_case), parse(r.tail, r.ignore_case)) for r in rules]
        starts = Automaton([mirrored(("cat", list(t))) for t in trees], anchored=False)
        rows = [m.tolist() for m in starts.moves]
        for row in rows:  # rows of references: a move is a single look-up; entry 256 tells the rules that start here
            row[:] = [rows[s] for s in row]
        for row, bits in zip(rows, starts.accepts.tolist(), strict=True):
            row.append(bits)
        self.states, self.start = len(rows), rows[0]
        self.ahead = [tuple((a.moves.tolist(), a.accepts.tolist(), a.dead) for a in (Automaton([t]) for t in pair)) for pair in trees]

    def marks(self, data: bytes) -> list[tuple[int, int]]:
        """(position, bits of the rules of which a match starts there), from the last to the first."""
        s, found = self.start, []
        for i, b in enumerate(reversed(data)):
            s = s[b]
            if s[256]:
                found.append((i, s[256]))
        last = len(data) - 1
        return [(last - i, bits) for i, bits in found]

    @staticmethod
    def _longest(automaton, data: bytes, at: int) -> int:
        moves, accepts, dead = automaton
        s, end = 0, at if accepts[0] else -1
        for i in range(at, len(data)):
            s = moves[s][data[i]]
            if s == dead:
                break
            if accepts[s]:
                end = i + 1
        return end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, number of the rule) in bytes, ordered by start and then by the rules' order."""
        marks = self.marks(data)
        if not marks:
            return []
        out, free = [], [0] * len(self.rules)
        for at, bits in reversed(marks):
            while bits:
                k = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                if at < free[k]:
                    continue
                head, tail = self.ahead[k]
                middle = self._longest(head, data, at)
                end = self._longest(tail, data, middle) if middle >= 0 else -1
                if end > at:
                    free[k] = end
                    if end - middle >= self.rules[k].least:
                        out.append((at, end, k))
        return sorted(out, key=lambda x: (x[0], x[2]))


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def in_code_points(data: bytes, spans: list) -> list:
    """Byte offsets of spans as code points."""
    if not spans:
        return []
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b]), k) for a, b, k in spans]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans of all rules in each whole text, in code points with exclusive ends.

    A null text counts as empty and has no spans; a null doc_id stays null; repeated rows give repeated results, an
    empty table none; spans of different kinds may overlap and both stay. Other columns are not read. There is no
    shuffle, and memory follows the longest single text.
    """

    def run(batches):
        s = scanner(rules)
        for batch in batches:
            found = []
            for t in batch.column(1):
                data = (t.as_py() or "").encode()
                found.append([{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in in_code_points(data, s.spans(data))])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of a secret in `text` replaced by [kind]; all other columns and all rows stay as they are.

    Overlapping spans are replaced together under the first one's kind. Null texts stay null.
    """
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches):
        s = scanner(rules)
        for batch in batches:
            texts = []
            for t in batch.column(at):
                text = t.as_py()
                data = text.encode() if text else b""
                spans = s.spans(data)
                if spans:
                    out, end = [], 0
                    for a, b, k in spans:
                        if a >= end:
                            out += [data[end:a], f"[{rules[k].kind}]".encode()]
                        end = max(end, b)
                    text = b"".join([*out, data[end:]]).decode()
                texts.append(text)
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def listed(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


#: Spark and DuckDB have no function that tells where the matches of an expression lie in code points; tests hold the
#: scanner against Python's re.
ORACLE_SQL = None
