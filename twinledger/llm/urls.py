"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.llm.common import map_batches, mixed, pick
from twinledger.llm.linear import Rows, fit, sigmoid

#: The rules of the production filter, ``host/path prefix`` to verdict.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}

FEATURES = 1 << 18
LABELLED_ROWS = 4_000
"""Most rows of a labelled URL table that a model is fitted on, chosen by hash."""

NGRAMS = (3, 4, 5)
LONGEST = 4_096
"""Characters of host and of path hashed at once; longer ones go on in pieces that overlap."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://`` or for a null url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits (of equally long ones a blocking one, then by name), or null."""
    order = sorted(rules, key=lambda r: (-len(r), rules[r] != "block", r))
    choice = F.lit(None).cast("string")
    for rule in reversed(order):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        choice = F.when(fits, F.lit(rule)).otherwise(choice)
    return choice


def ngram_features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams; host and path are told apart and their ends marked."""
    found = []
    for kind, text in ((1, f"^{host}$"), (2, f"^{path}$")):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        for n in NGRAMS:
            for start in range(0, max(1, len(codes) - n + 1), LONGEST):
                piece = codes[start : start + LONGEST + n - 1]
                if len(piece) >= n:
                    state = np.full(len(piece) - n + 1, kind * 8 + n, dtype=np.uint64)
                    for i in range(n):
                        state = mixed(state * np.uint64(0x9E3779B97F4A7C15) + piece[i : i + len(state)])
                    found.append(np.unique(state % np.uint64(FEATURES)).astype(np.int32))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


def train(labelled: DataFrame, most: int = LABELLED_ROWS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Fit on a labelled URL table (host, path, blocked); at most ``most`` rows reach the driver."""
    rows = (
        labelled.dropDuplicates(["host", "path"])
        .orderBy(F.xxhash64(F.lit(seed), "host", "path"), "host", "path").limit(most).collect()
    )
    lists = [ngram_features(r["host"], r["path"]) for r in rows]
    labels = np.array([float(r["blocked"]) for r in rows])
    return fit(Rows.of(lists), labels, FEATURES, l1=2e-5, l2=1e-4, steps=120)


def _score(weights: np.ndarray, bias: float):
    weights = weights.astype(np.float32)

    def run(batches):
        for batch in batches:
            scores = [
                float(sigmoid(weights[ngram_features(h.as_py(), p.as_py())].sum() + bias))
                for h, p in zip(batch.column(1), batch.column(2))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, type=pa.float64())],
                names=[*batch.schema.names, "block_score"],
            )

    return run


def url_verdicts(
    pages: DataFrame, rules: dict[str, str] = RULES, labelled: DataFrame | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) per row of ``pages`` (page_id, url).

    The labelled table has (url, blocked). Without one, the urls that a rule decides are the labelled
    table: its hosts, languages and path forms then judge the urls beyond the rules. A url is blocked
    if its rule says so or, without a rule, if its score is 0.5 or more. Null urls and urls without
    ``://`` have an empty host and path and get a score like any other. Hashes of n-grams and 2^18
    weights are all the model there is, so its size is fixed. The one shuffle is the distinct labelled
    urls; scoring is a map over the url column alone.
    """
    base = pick(pages, "page_id", "url")
    host, path = split_url(F.col("url"))
    parsed = base.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    if labelled is None:
        known = parsed.where("rule IS NOT NULL").select("host", "path", (ruled == "block").alias("blocked"))
    else:
        known_host, known_path = split_url(F.col("url"))
        known = pick(labelled, "url", "blocked").select(
            known_host.alias("host"), known_path.alias("path"), F.col("blocked").cast("boolean").alias("blocked")
        ).where("blocked IS NOT NULL")
    weights, bias = train(known)
    scored = parsed.transform(map_batches,
        _score(weights, bias), "page_id long, host string, path string, rule string, block_score double"
    )
    by_score = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce(ruled, by_score).alias("verdict"), "block_score"
    )
