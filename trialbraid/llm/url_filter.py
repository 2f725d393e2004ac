"""URL filters: rules by host and path, and a logistic regression for the rest.

The features are character n-grams of host and path, hashed into a fixed
number of weights. The regression is fitted on a small labelled URL table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbraid.llm.arrowtext import mix

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Weights, lengths of n-grams, labelled URLs at most, rounds and strength of the fit.
DIMENSIONS = 1 << 14
GRAM_LENGTHS = (3, 4, 5)
MAX_LABELLED = 4000
ROUNDS = 200
RATE = 4.0
RIDGE = 1e-4


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path prefix, as in ``example.org/es/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def split_urls(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty without a ``://``."""
    return pages.withColumns(
        {
            "host": F.expr(
                rf"translate(coalesce(regexp_extract(url, r'(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
            ),
            "path": F.expr(r"coalesce(regexp_extract(url, r'(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"),
        }
    )


def with_rule(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        own = (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        fits = own & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each URL, one after another, and the bounds of each URL."""
    # Host and path keep apart through their own end marks.
    raw = [f"\x02{h}\x03{p}\x04".encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths)]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    end = np.repeat(np.cumsum(sizes), sizes)
    in_path = np.zeros(len(data), np.uint64)
    marks = np.flatnonzero(data == 3)
    in_path[marks] = 1
    before = np.cumsum(in_path) - np.repeat(np.cumsum(in_path)[np.cumsum(sizes) - sizes], sizes)
    owner = np.repeat(np.arange(len(raw)), sizes)
    grams, owners = [], []
    for n in GRAM_LENGTHS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        value = np.full(m, n, np.uint64)
        for j in range(n):
            value = value * np.uint64(0x100000001B3) + data[j : j + m]
        value = value * np.uint64(2) + (before[:m] > 0).astype(np.uint64)
        whole = np.arange(m) + n <= end[:m]
        grams.append((mix(value[whole]) % np.uint64(DIMENSIONS)).astype(np.int64))
        owners.append(owner[:m][whole])
    gram = np.concatenate([np.empty(0, np.int64), *grams])
    who = np.concatenate([np.empty(0, np.int64), *owners])
    order = np.argsort(who, kind="stable")
    return gram[order], np.searchsorted(who[order], np.arange(len(raw) + 1))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def block_probability(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        gram, bounds = features(hosts, paths)
        total = np.concatenate([[0.0], np.cumsum(self.weights[gram])])
        n = np.maximum(np.diff(bounds), 1)
        logit = self.bias + (total[bounds[1:]] - total[bounds[:-1]]) / np.sqrt(n)
        return 1 / (1 + np.exp(-logit))


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> UrlModel:
    """Fit on a labelled table (host, path, verdict), at most ``max_rows`` distinct URLs by hash.

    Full gradient steps over the sorted rows: the same table gives the same
    model. Without both verdicts the model always gives the one there is, or allow.
    """
    order = [F.xxhash64("host", "path"), "host", "path", "verdict"]
    rows = labelled.select("host", "path", "verdict").distinct().orderBy(*order).limit(max_rows).collect()
    blocked = np.array([r.verdict == "block" for r in rows], float)
    if len(rows) == 0 or blocked.min() == blocked.max():
        return UrlModel(np.zeros(DIMENSIONS), 20.0 if len(rows) and blocked[0] else -20.0)
    gram, bounds = features([r.host for r in rows], [r.path for r in rows])
    n = np.diff(bounds)
    who, scale = np.repeat(np.arange(len(rows)), n), np.repeat(1 / np.sqrt(n), n)
    # Both verdicts weigh the same.
    weight = np.where(blocked > 0, 0.5 / blocked.sum(), 0.5 / (1 - blocked).sum())
    w, b = np.zeros(DIMENSIONS), 0.0
    for _ in range(ROUNDS):
        logit = b + np.bincount(who, w[gram] * scale, len(rows))
        error = weight * (1 / (1 + np.exp(-logit)) - blocked)
        w -= RATE * (np.bincount(gram, error[who] * scale, DIMENSIONS) + RIDGE * w)
        b -= RATE * error.sum()
    return UrlModel(w, b)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], model: UrlModel) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) of every page.

    A rule decides where one fits, else the model (block from 0.5). A null url
    or one without ``://`` has an empty host and path and is left to the model.
    Repeated rows repeat their result; other columns are not read.
    """
    ready = with_rule(split_urls(pages.select("page_id", "url")), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 5000):
                part = batch.slice(low, 5000)
                p = model.block_probability(part.column("host").to_pylist(), part.column("path").to_pylist())
                verdicts = [
                    r or ("block" if x >= 0.5 else "allow")
                    for r, x in zip(part.column("rule_verdict").to_pylist(), p)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("page_id", "host", "path", "rule")),
                        pa.array(verdicts, pa.string()),
                        pa.array(p),
                    ],
                    names=["page_id", "host", "path", "rule", "verdict", "block_probability"],
                )

    return ready.select("page_id", "host", "path", "rule", "rule_verdict").mapInArrow(
        run,
        "page_id bigint, host string, path string, rule string, verdict string, "
        "block_probability double",
    )
