"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The regression is trained by gradient descent from a small labelled URL table that the caller gives (a
default table is built from word lists below); what no rule decides is judged by it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewatch.llm.common import ship_package


@dataclass(frozen=True)
class Rule:
    verdict: str   # allow or block
    host: str      # this host and all its subdomains
    path: str = "/"

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    orders: tuple[int, ...] = (3, 4, 5)


#: Words of the default labelled table (fixed values): trades of junk hosts, subjects of ordinary hosts, and words, endings and
#: paths that go with both.
JUNK_TRADES = ("casino", "slots", "poker", "betting", "jackpot", "viagra", "pharmacy", "pills", "payday", "loans", "replica",
               "escort", "webcam", "porn", "adult", "spam", "popunder", "adserver", "clicktracker", "keygen", "warez", "torrent")
PLAIN_SUBJECTS = ("news", "library", "university", "weather", "recipes", "science", "travel", "history", "garden", "museum", "school",
                  "docs", "health", "music", "forum", "kitchen", "painting", "theater", "nutrition", "river", "village", "studio",
                  "the", "thing", "nation", "other", "there", "people", "house", "world", "street", "market", "letter", "water")
COMPANIONS = ("best", "online", "daily", "super", "north", "city", "open", "live", "old", "my", "real", "central")
ENDINGS = ("com", "org", "net", "info", "io", "example.com", "example.org", "example.net")
URL_PATHS = ("/", "/about", "/en/notes.html", "/wiki/Main", "/search?q=a", "/de/2023/05", "/offer")


def labelled_urls() -> list[tuple[str, int]]:
    """The default table: every trade (1) and subject (0) with every companion word. Give ``train`` a table of your own
    where there is one."""
    out = []
    for label, words in ((1, JUNK_TRADES), (0, PLAIN_SUBJECTS)):
        for i, word in enumerate(words):
            for j, other in enumerate(COMPANIONS):
                host = (f"{other}-{word}", f"{word}{other}", f"www.{other}{word}", word, f"blog.{word}-{other}")[(i + j) % 5]
                out.append((f"https://{host}.{ENDINGS[(i + 3 * j) % len(ENDINGS)]}{URL_PATHS[(i + j) % len(URL_PATHS)]}", label))
    return out


def held_out(table: list[tuple[str, int]], groups: list, folds: int = 5) -> list[tuple[int, float]]:
    """(label, score) of every row by a model that saw no row of its group: rows are dealt to folds by the hash of their
    group (a word, a registered domain), so no group lies on both sides."""
    fold = [zlib.crc32(str(g).encode()) % folds for g in groups]
    out = []
    for f in range(folds):
        model = train([row for row, g in zip(table, fold) if g != f])
        out += [(y, _score(_slots(*split(url), len(model.weights), model.orders), model.weights, model.bias))
                for (url, y), g in zip(table, fold) if g == f]
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Position in ``rules`` of the longest fitting rule (host and path together; the earlier on ties)."""
    found = F.lit(None).cast("int")
    for i, rule in sorted(enumerate(rules), key=lambda x: (len(x[1].name), -x[0])):  # the longest is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def _slots(host: str, path: str, model_size: int, orders) -> np.ndarray:
    out = []
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        seed = zlib.crc32(mark.encode())
        raw = part.encode("utf-8", "replace")
        if len(raw) == len(part):            # one byte per character
            out += [zlib.crc32(raw[i:i + n], seed) for n in orders for i in range(len(raw) - n + 1)]
        else:
            out += [zlib.crc32(part[i:i + n].encode("utf-8", "replace"), seed) for n in orders for i in range(len(part) - n + 1)]
    return np.array(out, np.int64) % model_size


def _score(slots: np.ndarray, weights: np.ndarray, bias: float) -> float:
    z = bias + (weights[slots].sum() / np.sqrt(len(slots)) if len(slots) else 0.0)
    return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def train(table: list[tuple[str, int]], buckets: int = 1 << 16, epochs: int = 30, rate: float = 2.0, decay: float = 1e-5,
          seed: int = 5, orders: tuple[int, ...] = (3, 4, 5)) -> UrlModel:
    """Stochastic gradient descent on the labelled URLs (label 1: block). Without both classes: no weights."""
    weights, bias = np.zeros(buckets), 0.0
    rows = [(_slots(*split(url), buckets, orders), y) for url, y in table]
    if len({y for _, y in rows}) < 2:
        return UrlModel(weights, -1.0, orders)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            slots, y = rows[i]
            step = rate / (1 + epoch / 10) * (y - _score(slots, weights, bias))
            weights *= 1 - decay
            np.add.at(weights, slots, step / np.sqrt(len(slots)))
            bias += step / 10
    return UrlModel(weights.astype(np.float32), float(bias), orders)


def split(url: str) -> tuple[str, str]:
    """Host and path of one URL, as ``host_of`` and ``path_of`` give them."""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = (), model: UrlModel | None = None, threshold: float = 0.5,
          page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, score``.

    ``rule`` is the longest fitting rule or null; ``verdict`` is the rule's, else block where the model's
    score (probability of block) reaches ``threshold``. Null, empty and malformed urls have an empty host and
    path and get the model's verdict on those. Repeated rows are judged alike, null ids stay, an empty
    table gives an empty result, other columns are not read.
    """
    spark = pages.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model or train(labelled_urls()))  # of fixed size

    def score(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([_score(_slots(h, p, len(m.weights), m.orders), m.weights, m.bias)
                         for h, p in zip(hosts.to_pylist(), paths.to_pylist())], pa.float64())
    score.__annotations__ = {"hosts": pa.Array, "paths": pa.Array, "return": pa.Array}
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    names = F.array(*[F.lit(r.name) for r in rules], F.lit(None).cast("string"))
    verdicts = F.array(*[F.lit(r.verdict) for r in rules], F.lit(None).cast("string"))
    at = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.withColumn("at", at).withColumn("score", F.arrow_udf(score, "double")("host", "path"))
    return scored.select("page_id", "host", "path", F.get(names, F.col("at")).alias("rule"),
                         F.coalesce(F.get(verdicts, F.col("at")), F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
                         "score")
