"""URL filters as a sort-merge range join.

A host is turned into a key by reversing its labels, each closed by a NUL: `a.example.org` becomes `org\\0example\\0a\\0`.
A rule on a host and its subdomains is then the interval of all keys that start with the rule's own, and such intervals
nest or are disjoint. Urls are range-partitioned and sorted by key; each task sweeps its range once beside the sorted
rules and keeps the stack of the rules whose intervals are open. Of the open rules whose path the url's path starts
with, the longest wins; equal lengths go to the longer host, then to block.

Urls of one hot host are spread over tasks: the range key ends with the path and a hash of the row. Rules of a bounded
number are broadcast; more are taken in further passes of as many, so no table of rules has to fit in a worker.

Rows: a null url or one without `://` has an empty host and path and gets the default verdict; repeated rows are judged
alike; empty tables give empty tables; urls of any length work. Columns of the input named host, path, rule or verdict
are replaced; other columns stay.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rules that are broadcast at once.
MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, line: str) -> Rule:
        """From `allow example.org/news/`."""
        verdict, _, pattern = line.strip().partition(" ")
        host, slash, path = pattern.strip().partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line!r}")
        return cls(verdict, host.lower(), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def key_of(host: str) -> str:
    return "".join(label + "\0" for label in reversed(host.split(".")))


class Sweep:
    """Sorted rules and the stack of those open at the place the sweep has come to."""

    def __init__(self, rules: list[Rule]):
        by_key: dict[str, dict[str, Rule]] = {}
        for rule in rules:
            own = by_key.setdefault(key_of(rule.host), {})
            if rule.path not in own or rule.verdict == "block":
                own[rule.path] = rule
        self.keys = sorted(by_key)
        self.rules = [by_key[k] for k in self.keys]
        self.lengths = [sorted({len(path) for path in own}, reverse=True) for own in self.rules]
        self.next, self.stack, self.at = 0, [], None

    def _seek(self, key: str) -> None:
        """Start of a range: the intervals open before `key` begin at its own label prefixes."""
        self.stack = []
        self.next = bisect_right(self.keys, key)
        for end in (i + 1 for i, c in enumerate(key) if c == "\0"):
            i = bisect_right(self.keys, key[:end]) - 1
            if i >= 0 and self.keys[i] == key[:end]:
                self.stack.append(i)

    def move(self, key: str) -> None:
        """Go on to `key`: close what ended before it, open what starts up to it."""
        if key == self.at:
            return
        if self.at is None or key < self.at:
            self._seek(key)
        else:
            upto = bisect_right(self.keys, key, self.next)
            while self.stack and not key.startswith(self.keys[self.stack[-1]]):
                self.stack.pop()
            if upto - self.next > 64:  # many rules between two urls: only those around the key can be open
                self._seek(key)
            for i in range(self.next, upto):
                if key.startswith(self.keys[i]):
                    self.stack.append(i)
            self.next = upto
        self.at = key

    def best(self, path: str) -> Rule | None:
        """The longest that fits of each open host's rules, one look-up for each length of path that they have."""
        fits = [r for i in self.stack if (r := next((r for n in self.lengths[i] if n <= len(path) and (r := self.rules[i].get(path[:n]))), None))]
        return min(fits, key=lambda r: (-len(r.text), -len(r.host), r.verdict == "allow"), default=None)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    host = F.translate(F.regexp_extract(url, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule (null if none fits) and verdict (the rule's, else `default`)."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(f"`{url_col}`"))
    df = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    df = df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = F.reverse(F.split("host", r"\."))
    df = df.withColumn("__key", F.concat(F.array_join(labels, "\0"), F.lit("\0")))
    spread = [c for c, kind in pages.dtypes if not kind.startswith(("map", "variant")) and c in df.columns]
    df = df.repartitionByRange("__key", "path", F.xxhash64(*[F.col(f"`{c}`") for c in spread])).sortWithinPartitions("__key", "path")
    schema = T.StructType(df.schema.fields)
    for start in range(0, len(rules), MAX_RULES):
        shared = spark.sparkContext.broadcast(rules[start : start + MAX_RULES])

        def sweep(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            state = Sweep(shared.value)
            for batch in batches:
                found, verdicts = [], []
                for key, path, old, verdict in zip(batch["__key"], batch["path"], batch["rule"], batch["verdict"]):
                    state.move(key)
                    rule = state.best(path)
                    if rule is not None and (old is None or _order(rule, verdict, old)):
                        old, verdict = rule.text, rule.verdict
                    found.append(old)
                    verdicts.append(verdict)
                yield batch.assign(rule=pd.Series(found, dtype=object, index=batch.index), verdict=pd.Series(verdicts, dtype=object, index=batch.index))

        df = df.mapInPandas(sweep, schema)
    return df.drop("__key")


def _order(rule: Rule, verdict: str, old: str) -> bool:
    """Whether `rule` beats one of an earlier pass."""
    host = old.partition("/")[0]
    return (-len(rule.text), -len(rule.host), rule.verdict == "allow") < (-len(old), -len(host), verdict == "allow")
