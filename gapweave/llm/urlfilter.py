"""URL filter lists: rules found by their rarest literal token.

A rule ``host/path`` fits its host and all subdomains where the path starts with the
rule's.  Each rule is filed under the literal token that fewest URLs of the table hold;
a URL's own tokens fetch its candidate rules, and only those run their regular
expressions.  The longest rule that fits decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import prepare

#: Rules go to every task; this bounds their number.
MOST_RULES = 1_000_000
_TOKEN = re.compile(r"[0-9A-Za-z]+")
_URL = re.compile(r"\A.*?://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """A rule's text (host/path) and verdict."""

    text: str
    verdict: str

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every URL which fits holds whole; not one that ends the path, as longer tokens fit there too."""
        host, _, path = self.text.partition("/")
        cut = f"{host}/{path}"
        return [m[0].translate(_LOWER) for m in _TOKEN.finditer(cut) if m.end() < len(cut)]

    @property
    def pattern(self) -> str:
        """A regular expression for host and path in a row; neither host holds a slash, so they end together."""
        host, slash, path = self.text.partition("/")
        return r"(?:[^/]*\.)?" + re.escape(host) + (re.escape(f"/{path}") if slash else r"(?:/|\Z)")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    m = _URL.match(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def _tokens(host: str, path: str) -> set[str]:
    return {t.translate(_LOWER) for t in _TOKEN.findall(host + path)}


class Index:
    """Rules by their rarest token, compiled once in each worker; rules without one are always candidates."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        for r in rules:
            rarest = min(r.tokens, key=lambda t: (frequency.get(t, 0), t), default=None)
            (self.always if rarest is None else self.by_token.setdefault(rarest, [])).append(r)
        self.compiled: dict[Rule, re.Pattern] = {}

    def decide(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of equal ones the first by text."""
        best, full = None, host + path
        for r in [*self.always, *(r for t in _tokens(host, path) for r in self.by_token.get(t, ()))]:
            if best is not None and (-len(r.text), r.text) >= (-len(best.text), best.text):
                continue
            if (p := self.compiled.get(r)) is None:
                p = self.compiled[r] = re.compile(r.pattern)
            if p.match(full):
                best = r
        return best


def frequencies(pages: DataFrame, tokens: list[str], url_col: str = "url") -> dict[str, int]:
    """In how many rows each of the rules' tokens occurs; one number a token reaches the driver."""
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    own = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit("[0-9a-z]+"), F.lit(0)))).alias("token"))
    return {r["token"]: r["n"] for r in own.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: id, host, path, rule (null if none fits) and verdict (the rule's, else default).

    Null URLs and those without ``://`` have an empty host and path, which no rule fits.
    Repeated rows stay.  Other columns are not read.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are held by each task")
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    tokens = [t for r in rules for t in r.tokens]
    index = Index(rules, frequencies(rows, tokens, "_url") if tokens else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [parts(u) for u in batch.column("_url").to_pylist()]
            found = [index.decide(*s) for s in split]
            cols = [[s[0] for s in split], [s[1] for s in split], [r and r.text for r in found], [r.verdict if r else default for r in found]]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c, pa.string()) for c in cols)], ["_id", "host", "path", "rule", "verdict"])

    schema = T.StructType([T.StructField("_id", pages.schema[id_col].dataType), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
