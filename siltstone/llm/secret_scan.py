"""Secret scanning through a trigram inverted index.

Every rule is a regular expression. From its syntax tree follows a Boolean query over trigrams of folded bytes that any
match must satisfy. Each shard of text gets an inverted index, whose postings are the texts that hold a trigram, for the
trigrams that some query asks about; postings are united and intersected as the queries say, and candidates verified with
the expression itself. A rule without a mandatory trigram scans all texts.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

SHARD_BYTES = 4 << 20
RULES: dict[str, str] = {
    "assigned_secret": r"(?i)(?:api[_-]?key|secret|token|passwd|password)[ \t]*[:=][ \t]*[\"']?[A-Za-z0-9_+/=-]{16,}",
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "hex_digest": r"\b(?:[0-9a-f]{40}|[0-9A-F]{40})\b",
    "json_web_token": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "stripe_key": r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "url_password": r"[A-Za-z][A-Za-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@",
}
ANY = True
MOST = 64


def _both(a, b, op: str):
    """a and b, or a or b, of queries: ANY, a trigram, or (op, queries)."""
    if op == "and":
        if a is ANY or b is ANY:
            return b if a is ANY else a
    elif a is ANY or b is ANY:
        return ANY
    return a if a == b else (op, frozenset([a, b]))


def _exact(op, value) -> set[str] | None:
    """All folded strings that this node matches, or None where they are too many or unknown."""
    if op is C.LITERAL:
        return {chr(value).lower()} if value < 128 else None
    if op is C.AT:
        return {""}
    if op is C.IN:
        found = set()
        for kind, x in value:
            if kind is C.LITERAL and x < 128:
                found.add(chr(x).lower())
            elif kind is C.RANGE and x[1] < 128 and x[1] - x[0] < 16:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 16 else None
    if op is C.SUBPATTERN:
        return _exact_sequence(value[-1])
    if op is C.BRANCH:
        parts = [_exact_sequence(x) for x in value[1]]
        return None if any(p is None for p in parts) or len(set().union(*parts)) > MOST else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = value
        one = _exact_sequence(inner)
        if one is None or high > 4:
            return None
        out, power = set(), {""}
        for k in range(int(high) + 1):
            if k >= low:
                out |= power
            power = {a + b for a in power for b in one}
            if len(power) > MOST or len(out) > MOST:
                return None
        return out
    return None


def _exact_sequence(nodes) -> set[str] | None:
    out = {""}
    for op, value in nodes:
        one = _exact(op, value)
        if one is None or len(out) * len(one) > MOST:
            return None
        out = {a + b for a in out for b in one}
    return out


def _strings_query(strings: set[str]):
    query = None
    for s in sorted(strings):
        one = ANY
        for i in range(len(s) - 2):
            one = _both(one, s[i : i + 3], "and")
        query = one if query is None else _both(query, one, "or")
    return ANY if query is None else query


def trigram_query(pattern: str):
    """The query that every match of pattern satisfies; ANY where none of its trigrams is mandatory."""
    return _sequence_query(P.parse(pattern, re.ASCII))


def _sequence_query(nodes):
    query, run = ANY, {""}
    for op, value in nodes:
        one = _exact(op, value)
        if one is not None and len(run) * len(one) <= MOST:
            run = {a + b for a in run for b in one}
            continue
        query = _both(query, _strings_query(run), "and")
        run = {""} if one is None else one
        if one is None:
            if op is C.SUBPATTERN:
                query = _both(query, _sequence_query(value[-1]), "and")
            elif op is C.BRANCH:
                some = None
                for x in value[1]:
                    q = _sequence_query(x)
                    some = q if some is None else _both(some, q, "or")
                query = _both(query, ANY if some is None else some, "and")
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
                query = _both(query, _sequence_query(value[2]), "and")
    return _both(query, _strings_query(run), "and")


def trigrams(query) -> set[str]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


class TrigramIndex:
    """Postings of the wanted trigrams over a shard of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, wanted: list[str], table: np.ndarray):
        self.n = len(off) - 1
        self.postings = {t: np.zeros(0, np.int64) for t in wanted}
        if len(data) < 3 or not wanted:
            return
        low = K.fold(data).astype(np.int32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(table[code])
        owner = np.searchsorted(off, at, side="right") - 1
        inside = at + 3 <= off[owner + 1]
        at, owner = at[inside], owner[inside]
        pairs = np.unique(code[at].astype(np.int64) * self.n + owner)
        if not len(pairs):
            return
        found, texts = pairs // self.n, pairs % self.n
        cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(found)]):
            self.postings[int(found[a]).to_bytes(3, "big").decode("ascii")] = texts[a:b]

    def texts(self, query) -> np.ndarray:
        """The texts that satisfy the query, ascending."""
        if query is ANY:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        found = sorted((self.texts(q) for q in query[1]), key=len)
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def _findings(docs: DataFrame, rules: dict[str, str] | None) -> DataFrame:
    compiled = {name: re.compile(p, re.ASCII) for name, p in sorted((rules or RULES).items())}
    queries = {name: trigram_query(c.pattern) for name, c in compiled.items()}
    wanted = sorted(set().union(*(trigrams(q) for q in queries.values())))
    codes = np.array([int.from_bytes(t.encode("ascii"), "big") for t in wanted], np.int64)

    def apply(batches):
        table = np.zeros(1 << 24, bool)
        table[codes] = True
        for part in K.slices(batches, "text", SHARD_BYTES):
            column = part.column(1)
            data, off = K.flat(column)
            index = TrigramIndex(data, off, wanted, table)
            rows = []
            for name, query in queries.items():
                for t in index.texts(query).tolist():
                    text = data[off[t] : off[t + 1]].tobytes().decode("utf-8", "replace")
                    for k, m in enumerate(compiled[name].finditer(text)):
                        rows.append((t, name, k, m.start(), m.end(), hashlib.sha256(m.group().encode("utf-8")).hexdigest()))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(c[0])), pa.array(c[1], pa.string()), *(pa.array(x, pa.int32()) for x in c[2:5]), pa.array(c[5], pa.string())], ["doc_id", "rule", "match_no", "start_char", "end_char", "sha256"])

    docs = K.only(docs, "doc_id", "text")
    texts = docs.select(K.integer_id(docs, "doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(apply, "doc_id bigint, rule string, match_no int, start_char int, end_char int, sha256 string")


def scan(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """A row per match of a rule: doc_id, rule, match_no in the text, start_char, end_char, and the match's SHA-256 in its
    place. Matches of a rule don't overlap, those of different rules may. Null and empty texts have none; repeated rows
    give theirs once each; a null doc_id stays null; extra columns are ignored."""
    return _findings(docs, rules)


def report(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """scan() with each match's length in place of its offsets."""
    return scan(docs, rules).select("doc_id", "rule", "match_no", (F.col("end_char") - F.col("start_char")).alias("length"), "sha256")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS rule, CAST(k AS INTEGER) AS match_no, CAST(length(m[k + 1]) AS INTEGER) AS length, sha256(m[k + 1]) AS sha256 FROM (SELECT doc_id, m, unnest(range(len(m))) AS k FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(p)}) AS m FROM documents))"
    for name, p in sorted(RULES.items())
)
