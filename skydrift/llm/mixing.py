"""Sources mixed to target shares of all tokens, by entropy balancing.

Of all document rates that give every source its target number of tokens and none more than its
cap, those are taken that stay closest (in relative entropy, a token being the unit) to the
rate all documents would have alike, while the mixture keeps the corpus's shares of languages and its
lengths of documents as far as the sources allow: sources are hard constraints, these are soft
ones (a ridge on their multipliers, so that the dual always has a solution).

The dual is a smooth convex function of one multiplier per source and language and one for the
standardised log length; a document's rate is the common rate tilted by the exponential of its multipliers,
cut at its cap, so that documents of one source differ in rate. Newton steps with backtracking solve it. Value, gradient and Hessian are sums over all
documents that one distributed aggregation per step delivers, grouped by source and language; documents alike in source, language and
length have the same rate and are one weighted row. Rates are then rounded into copies: the whole part
for all, one more for the documents that come first in a salted order of their ids, up to the
document that brings the source nearest to its target.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydrift.operators.skew import running_total
from skydrift.runtime import Durable

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this tokenizer's vocabulary divides a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The public tokenizer at ``path``, read once per process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _LOADED[path] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, lang, n_tokens of whole texts; null texts have none. Of documents without a column lang it is null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    lang = (F.col("lang") if "lang" in documents.columns else F.lit(None)).cast("string").alias("lang")
    return documents.select("doc_id", "source", lang, "text").mapInArrow(count, "doc_id long, source string, lang string, n_tokens long")


def clean_source(c: Column) -> Column:
    """One spelling: small letters, words joined by '_'; blank is null."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s_-]+|[\s_-]+$", ""), r"[\s_-]+", "_")
    return F.when(F.length(s) > 0, s)


def clean_lang(c: Column) -> Column:
    """Two-letter codes in small letters; everything else is 'other'."""
    s = F.lower(F.trim(c))
    return F.when(s.rlike("^[a-z]{2}$"), s).otherwise(F.lit("other"))


@dataclass(frozen=True)
class Target:
    share: float
    cap: float


def feasible_tokens(targets: Mapping[str, Target], tokens: Mapping[str, float], total: float) -> dict[str, float]:
    """Tokens each source can give: its share of the total, or all its cap allows.

    What capped sources fall short of goes to the others in proportion to their shares, so that
    the total is kept as long as any source can give more.
    """
    most = {s: t.cap * tokens.get(s, 0.0) for s, t in targets.items()}
    full: set[str] = set()
    while True:
        free = {s: t.share for s, t in targets.items() if s not in full}
        rest = total - sum(most[s] for s in full)
        weight = sum(free.values())
        want = {s: rest * x / weight if weight else 0.0 for s, x in free.items()}
        over = {s for s, w in want.items() if w >= most[s]}
        if not over:
            return {**{s: most[s] for s in full}, **want}
        full |= over
        if len(full) == len(targets):
            return most


def _lookup(column: str, values: Mapping[str, float], default: float) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(float(v)))])[F.col(column)], F.lit(default))


@dataclass(frozen=True)
class Tilt:
    """Multipliers of the dual; the rate of a document is base * exp of the sum of its own, at most its cap."""

    base: float
    source: Mapping[str, float]
    lang: Mapping[str, float]
    length: float

    def exponent(self) -> Column:
        return _lookup("source", self.source, 0.0) + _lookup("lang", self.lang, 0.0) + F.lit(float(self.length)) * F.col("_z")


def balance(
    cells: DataFrame, sources: Mapping[str, float], langs: Mapping[str, float], base: float, softness: float = 0.02, tolerance: float = 1e-10, steps: int = 60
) -> tuple[Tilt, int]:
    """The tilt that gives each source its tokens, and the Newton steps taken.

    ``cells``: source, lang, _z (standardised log length), _cap, _t (tokens): documents of equal rate together. ``sources``: tokens wanted of each,
    which must be reachable under the caps (a source wanted to its full cap needs no multiplier and belongs outside). ``langs``: tokens wanted of each,
    met as far as possible; the mean of _z is drawn to 0 likewise. The greater ``softness``, the less the soft ones count.
    Each step is one aggregation of ``cells``, which returns a row per source and language.
    """
    names, tongues = sorted(sources), sorted(langs)
    if not names:
        return Tilt(base, {}, {}, 0.0), 0
    n, m = len(names), len(tongues)
    total = sum(sources.values())
    want = np.array([sources[s] for s in names] + [langs[x] for x in tongues] + [0.0])
    soft = np.array([0.0] * n + [softness * max(total, 1.0)] * (m + 1))
    place = {s: k for k, s in enumerate(names)}, {x: n + k for k, x in enumerate(tongues)}

    def tilt(lam: np.ndarray) -> Tilt:
        return Tilt(base, dict(zip(names, map(float, lam[:n]))), dict(zip(tongues, map(float, lam[n : n + m]))), float(lam[-1]))

    def look(lam: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta, top, z = tilt(lam).exponent(), F.log(F.col("_cap") / F.lit(base)), F.col("_z")
        free = F.lit(base) * F.exp(F.least(eta, top))
        mass = F.col("_t") * free
        inner = F.when(eta < top, mass).otherwise(0.0)
        value = F.col("_t") * F.when(eta <= top, free).otherwise(F.col("_cap") * (1 + eta - top))
        rows = cells.groupBy("source", "lang").agg(
            F.sum(value).alias("v"), F.sum(mass).alias("g"), F.sum(mass * z).alias("gz"), F.sum(inner).alias("h"), F.sum(inner * z).alias("hz"), F.sum(inner * z * z).alias("hzz")
        )
        v, g, h = 0.0, np.zeros(n + m + 1), np.zeros((n + m + 1, n + m + 1))
        for r in sorted(rows.collect(), key=lambda r: (r.source, r.lang)):  # a row per source and language
            at = [place[0][r.source], *([place[1][r.lang]] if r.lang in place[1] else [])]
            v += r.v
            for a in at:
                g[a] += r.g
                h[a, -1] += r.hz
                h[-1, a] += r.hz
                for b in at:
                    h[a, b] += r.h
            g[-1] += r.gz
            h[-1, -1] += r.hzz
        return v - float(lam @ want) + 0.5 * float(soft @ (lam * lam)), g - want + soft * lam, h + np.diag(soft)

    lam = np.zeros(n + m + 1)
    v, g, h = look(lam)
    taken = 0
    while taken < steps and np.abs(g).max() > tolerance * max(1.0, total):
        step = np.linalg.solve(h + np.eye(len(h)) * 1e-12 * max(1.0, total), -g)
        step *= min(1.0, 4.0 / max(1e-300, np.abs(step).max()))
        size = 1.0
        while True:
            nv, ng, nh = look(lam + size * step)
            if nv <= v + 1e-4 * size * float(g @ step) + 1e-12 * abs(v) or size < 1e-6:
                break
            size /= 2
        lam, v, g, h = lam + size * step, nv, ng, nh
        taken += 1
    return tilt(lam), taken


def counted_documents(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, lang (one spelling each), n_tokens of documents with an id, written down once for all that follows."""
    counted = count_tokens(documents, tokenizer).where("doc_id is not null")
    return Durable(documents.sparkSession, "tokens").put(counted.select("doc_id", clean_source(F.col("source")).alias("source"), clean_lang(F.col("lang")).alias("lang"), "n_tokens"))


def mixture(documents: DataFrame, targets: DataFrame, total_share: float = 0.5, salt: str = "mix-1", tokenizer: str = TOKENIZER, softness: float = 0.02, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, shares).

    copies: doc_id, source, n_tokens, copies of every document used at least once. shares:
    source, target_share, target_tokens, tokens, share, documents, most_copies, capped (its cap
    keeps the source below its share).

    The total is ``total_share`` of the tokens of all documents. Sources are matched in one
    spelling; documents of other or no source, without an id and without tokens are not used. A
    source that can't reach its share even with every document at its cap gives what it can and
    the others make up the total in proportion. Repeated target rows count once (the one with the
    greatest share); null or negative shares count as zero, a null cap as 1. Nothing to mix gives
    no copies and shares of zero. A row given twice is two documents. ``counted`` is what
    ``counted_documents`` gives, if it is there already.
    """
    spark = documents.sparkSession
    keep = Durable(spark, "mixture")
    counted = counted_documents(documents, tokenizer) if counted is None else counted
    wanted: dict[str, Target] = {}
    rows = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    for r in rows.orderBy("source", "target_share", "max_repeats").collect():  # one row per source
        share = 0.0 if r.target_share is None or math.isnan(r.target_share) else max(0.0, r.target_share)
        wanted[r.source] = Target(share, max(0.0, float(1 if r.max_repeats is None else r.max_repeats)))
    mine = F.col("source").isin(*wanted) if wanted else F.lit(False)
    # one pass: tokens per source wanted and language, and moments of the log length over all tokens
    t, log_n = F.col("n_tokens").cast("double"), F.log(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
    seen = counted.groupBy(F.when(mine, F.col("source")).alias("source"), "lang").agg(F.sum(t).alias("t"), F.sum(t * log_n).alias("l"), F.sum(t * log_n * log_n).alias("q")).collect()
    have: dict[str, float] = {}
    spoken: dict[str, float] = {}
    for r in sorted(seen, key=lambda r: (r.source or "", r.lang)):
        spoken[r.lang] = spoken.get(r.lang, 0.0) + r.t
        if r.source:
            have[r.source] = have.get(r.source, 0.0) + r.t
    corpus = sum(spoken.values())
    mean = sum(r.l for r in seen) / corpus if corpus else 0.0
    spread = math.sqrt(max(sum(r.q for r in seen) / corpus - mean * mean, 0.0)) if corpus else 0.0
    total = total_share * corpus
    goal = feasible_tokens(wanted, have, total)
    capped = {s for s, t in wanted.items() if goal[s] >= t.cap * have.get(s, 0.0) - 1e-9}
    cap = {s: t.cap for s, t in wanted.items()}
    usable = counted.where(mine).where("n_tokens > 0").withColumn("_cap", _lookup("source", cap, 0.0)).withColumn("_z", (log_n - F.lit(mean)) / F.lit(spread if spread > 1e-9 else 1.0))
    free = {s: goal[s] for s in wanted if s not in capped and goal[s] > 0 and have.get(s, 0) > 0}
    base = max(total_share, 1e-9)
    # languages keep their shares of the corpus; what sources at their cap give is given
    given: dict[str, float] = {}
    for r in seen:
        if r.source in capped:
            given[r.lang] = given.get(r.lang, 0.0) + cap[r.source] * r.t
    langs = {x: max(0.0, total * c / corpus - given.get(x, 0.0)) for x, c in spoken.items()} if corpus else {}
    is_free = F.col("source").isin(*free) if free else F.lit(False)
    cells = keep.put(usable.where(is_free).groupBy("source", "lang", "n_tokens", "_z", "_cap").agg(F.sum("n_tokens").cast("double").alias("_t")))
    tilt, _ = balance(cells, free, langs, base, softness)
    flat = {s: (t.cap if s in capped else 0.0) for s, t in wanted.items() if s not in free}
    rate = F.when(is_free, F.least(F.col("_cap"), F.lit(base) * F.exp(tilt.exponent()))).otherwise(_lookup("source", flat, 0.0))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.col("doc_id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    rated = usable.withColumn("_rate", rate).withColumn("_whole", F.floor("_rate"))
    rated = rated.withColumn("_turn", u - (F.col("_rate") - F.col("_whole")))
    base_tokens = {r.source: float(r.t) for r in rated.groupBy("source").agg(F.sum(F.col("_whole") * F.col("n_tokens")).alias("t")).collect()}
    need = {s: goal[s] - base_tokens.get(s, 0.0) for s in free}
    part = running_total(rated.where(F.col("_rate") > F.col("_whole")), ["source"], ["_turn", "doc_id"], "n_tokens")
    more = (F.col("before") + F.col("n_tokens") / 2 <= _lookup("source", need, 0.0)).cast("long")
    copies = keep.put(
        part.select("doc_id", "source", "n_tokens", (F.col("_whole") + more).alias("copies"))
        .unionByName(rated.where(F.col("_rate") == F.col("_whole")).select("doc_id", "source", "n_tokens", F.col("_whole").cast("long").alias("copies")))
        .where("copies > 0")
    )
    used = copies.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    plan = spark.createDataFrame(
        [(s, t.share, float(goal[s]), s in capped and goal[s] < t.share * total - 1e-6) for s, t in sorted(wanted.items())],
        "source string, target_share double, target_tokens double, capped boolean",
    )
    zero = F.lit(0).cast("long")
    joined = plan.join(F.broadcast(used), "source", "left").select(
        "source", "target_share", "target_tokens", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"),
        F.coalesce("most_copies", zero).alias("most_copies"), "capped",
    )
    mixed = float(copies.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0] or 1)
    shares = joined.select("source", "target_share", "target_tokens", "tokens", (F.col("tokens") / F.lit(mixed)).alias("share"), "documents", "most_copies", "capped")
    return copies, shares
