"""URL filter: host and path rules, else logistic regression on hashed character n-grams.

The model is trained on the spot from a small table of labelled URLs, whose
size bounds what the driver holds. Features are the 3- to 5-grams of the host
and of the path, hashed with the part they come from.

Defined results: a null URL, or one without ://, has an empty host and path
and is judged by the model alone, which has no n-gram to go by and allows it; equal URLs get equal
verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules as (verdict, host, path prefix).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

BLOCK_AT = 0.5
BITS = 14
GRAMS = (3, 4, 5)
# General words in the names of unwanted hosts, and of ordinary ones.
UNWANTED = ("casino", "poker", "jackpot", "slots", "roulette", "betting", "bets", "gambling", "lottery", "viagra", "pharmacy", "pills", "steroids", "payday", "loans", "porn", "xxx", "adult", "sexy", "cams", "escort", "dating", "malware", "virus", "crack", "warez", "torrent", "keygen", "spam", "phishing", "adserver", "ads", "popup", "tracker", "tracking", "clicks", "clickbait", "cheap", "discount", "replica", "free", "prizes", "farm", "seo", "traffic")
ORDINARY = ("news", "museum", "library", "garden", "river", "science", "weather", "kitchen", "history", "school", "council", "music", "theatre", "travel", "letters", "journal", "theory", "estate", "reading", "bakery", "street", "mountain", "hospital", "church", "village", "research", "institute", "college", "sports", "football", "cycling", "recipes", "photos", "software", "forum", "wiki", "maps", "books", "paper", "energy", "nature", "birds", "animals", "health", "doctor", "law", "finance", "market", "shop", "home", "design", "studio", "radio", "today", "online", "world", "people", "family", "other", "thing", "father", "brother", "winter", "stories", "nation", "station", "motion", "bridge", "castle", "island", "forest", "valley", "harvest", "autumn", "spring", "summer", "silver", "golden", "copper", "wooden", "stone", "water", "coffee", "cheese", "bread", "honey", "apple", "cherry", "potato", "horse", "eagle", "salmon", "flower", "meadow", "railway", "airport", "bicycle", "engine", "bus", "ferry", "teacher", "student", "lawyer", "painter", "dancer", "singer", "writer", "farmer", "police", "parish", "county", "city", "region", "language", "grammar", "history", "physics", "biology", "chemistry", "astronomy", "mathematics", "philosophy", "gallery", "concert", "festival", "opera", "puzzle", "games", "tennis", "hockey", "skiing", "climbing", "hiking", "camping", "fishing", "sewing", "knitting", "quiet", "bright", "little", "ancient", "modern", "public", "private", "local", "heritage", "society", "union", "trust", "charity", "volunteer")


def labelled_urls() -> list[tuple[str, str, int]]:
    """Host, path and label (1: unwanted) of the training table: names of one and two general words under ordinary domains and paths."""
    ends = ("example.com", "example.org", "example.net")
    paths = ("/en/12", "/de/305/", "/fr/77.html", "/es/940", "/")
    rows = []
    for label, names in ((1, UNWANTED), (0, ORDINARY)):
        pairs = [f"{a}{'-' if k % 2 else ''}{b}" for k, (a, b) in enumerate(zip(names, names[7:] + names[:7], strict=True))]
        for k, name in enumerate((*names, *pairs)):
            rows += [(f"{sub}{name}.{ends[(k + j) % 3]}", paths[(k + j) % 5], label) for j, sub in enumerate(("", "www.", "blog.", "m."))]
    return rows


def features(host: str, path: str) -> np.ndarray:
    """Slots of the distinct n-grams of a host and a path."""
    slots = set()
    for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            slots.update(zlib.crc32(f"{part}{text[i : i + n]}".encode()) & ((1 << BITS) - 1) for i in range(len(text) - n + 1))
    return np.fromiter(slots, np.int64, len(slots))


def train(rows: list[tuple[str, str, int]], epochs: int = 25, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps over the small table, in a fixed order; the rarer label counts more, by the root of the labels' ratio."""
    weights, bias = np.zeros(1 << BITS), 0.0
    known = [(features(h, p), y) for h, p, y in rows]
    unwanted = sum(y for _, y in known)
    weigh = (((len(known) - unwanted) / unwanted) ** 0.5, 1.0) if 0 < unwanted < len(known) else (1.0, 1.0)
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for k in order.permutation(len(known)):
            at, y = known[k]
            z = bias + weights[at].sum() / np.sqrt(max(1, len(at)))
            slope = (1 / (1 + np.exp(-z)) - y) * weigh[1 - y]
            weights[at] -= rate * (slope / np.sqrt(max(1, len(at))) + decay * weights[at])
            bias -= 0.1 * rate * slope
    return weights, bias


def host_of(url: str | Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule (host and path together) that fits, as a struct of text and verdict, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, labelled: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """Each page's id, host, path, rule, verdict, and the model's score where no rule fits."""
    weights, bias = train(labelled_urls() if labelled is None else labelled)
    weights = weights.astype(np.float32)

    @F.arrow_udf("double")
    def score(host: pa.Array, path: pa.Array) -> pa.Array:
        out = []
        for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True):
            if h is None:  # a rule decides
                out.append(None)
                continue
            at = features(h, p)
            out.append(1 / (1 + np.exp(-(bias + weights[at].sum() / np.sqrt(max(1, len(at)))))))
        return pa.array(out, pa.float64())

    split = pages.select(F.col(id_col), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    judged = split.withColumn("_hit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("score", score(F.when(F.col("_hit").isNull(), F.col("host")), "path"))
    verdict = F.coalesce("_hit.verdict", F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", F.col("_hit.rule").alias("rule"), "score", verdict.alias("verdict"))
