"""Mixing sources to target weights: pivotal dependent rounding with a reduction tree.

A source with target share w gets w * total tokens, so each of its documents is due x = w * total / (tokens of the source)
copies: floor(x) for certain, one more with probability x - floor(x). The pivotal method settles these probabilities:
of two undecided documents, mass (in tokens) is moved at random from one to the other until one probability is 0 or
1, which keeps both the expectation of each and the sum of tokens. This runs in blocks of a source; each block leaves one
undecided document, and these are settled the same way in blocks of blocks, until one document per source is left,
which is drawn. The tokens of a source thus differ from its target by less than one document.

The total is `total_tokens`, or else the largest at which the shares planned are off by at most `tolerance`, as the sum
of what all sources have too much, but no more than all tokens that the target sources hold. A source whose documents,
each used as often as its cap allows, hold less than its share of the total falls short; with tolerance 0 (or
`exact=True`) none does. The shares reached are reported, beside them the largest document of each source, which bounds
what rounding leaves them off by.

Defined results: null texts, texts without tokens and documents of sources without a positive target are not used; a
target source without documents is reported with share 0 and ignored for the total. A source listed twice counts once
(largest share). Draws depend only on seed, source and doc_id.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tokens import VOCABULARY, sized
from quillon.session import settle, wide

BLOCK = 4096


def pivotal(weights: list[float], p: list[float], rng: random.Random) -> int:
    """Settle the probabilities p in place; returns the index of the one left undecided, or -1."""
    at = -1
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if at < 0:
            at = j
            continue
        wi, wj, pi, pj = weights[at], weights[j], p[at], p[j]
        up, down = min((1 - pi) * wi, pj * wj), min(pi * wi, (1 - pj) * wj)
        if rng.random() * (up + down) < down:
            ends_i, d = (1 - pi) * wi <= pj * wj, up
            pi, pj = (1.0, pj - d / wj) if ends_i else (pi + d / wi, 0.0)
        else:
            ends_i, d = pi * wi <= (1 - pj) * wj, down
            pi, pj = (0.0, pj + d / wj) if ends_i else (pi - d / wi, 1.0)
        pi, pj = (round(x) if min(x, 1 - x) < 1e-12 else x for x in (pi, pj))
        p[at], p[j] = pi, pj
        open_ = [i for i in (at, j) if 0 < p[i] < 1]
        at = open_[0] if open_ else -1
    return at


def _settle_block(seed: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        rng = random.Random(f"{seed}/{key[0].as_py()}/{key[1].as_py()}/{last}")
        p = table.column("p").to_pylist()
        left = pivotal(table.column("tokens").to_pylist(), p, rng)
        if left >= 0 and last:
            p[left] = float(rng.random() < p[left])
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return run


def planned_total(sources: list[tuple[float, float]], most: float, tolerance: float) -> float:
    """Largest total up to `most` at which the shares are off by at most the tolerance. sources: (share, tokens if every
    document is used as often as its cap allows)."""

    def off(total: float) -> float:
        got = [min(share * total, cap) for share, cap in sources]
        whole, want = sum(got), sum(share for share, _ in sources)
        return sum(max(0.0, g / whole - share / want) for g, (share, _) in zip(got, sources)) if whole else 0.0

    low, high = min([most, *(cap / share for share, cap in sources)]), most  # nothing is off at the lower end
    if off(high) <= tolerance:
        return high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if off(middle) <= tolerance else (low, middle)
    return low


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, exact: bool = False, tolerance: float = 0.05, seed: int = 5, block: int = BLOCK, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens, copies of every document that is used."""
    spark = documents.sparkSession
    sizes = settle(sized(documents, vocabulary).where("tokens > 0 and source is not null"))
    want = targets.where("target_share > 0 and max_repeats > 0 and source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("held"), F.count("*").alias("docs"))
    plan = settle(have.join(want, "source"))
    total = total_tokens
    if total is None:  # a row per target source reaches the driver
        rows = plan.select("share", F.col("cap") * F.col("held"), "held").collect()
        total = planned_total([(r[0], float(r[1])) for r in rows], float(sum(r[2] for r in rows)), 0.0 if exact else tolerance)
    due = F.least(F.col("cap").cast("double"), F.lit(float(total)) * F.col("share") / F.col("held"))
    plan = plan.select("source", F.floor(due + 1e-12).alias("base"), F.greatest(F.lit(0.0), due - F.floor(due + 1e-12)).alias("p"), F.ceil(F.col("docs") / block).alias("blocks"))
    rows = sizes.join(plan, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    kinds = "doc_id long, source string, tokens long, base long, p double, blocks long, block long"
    cols = [c.split()[0] for c in kinds.split(", ")]
    done = []
    most = plan.agg(F.max("blocks")).first()[0] or 1
    while True:
        last = most == 1
        n = wide(spark, min(most, 100_000))
        rows = settle(rows.select(*cols).repartition(n, "source", "block").groupBy("source", "block").applyInArrow(_settle_block(seed, last), kinds))
        done.append(rows.where("p = 0 or p = 1"))
        if last:
            break
        most = -(-most // block)
        rows = rows.where("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") / block)).withColumn("block", F.pmod("block", F.col("blocks")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "tokens", (F.col("base") + F.col("p")).cast("int").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, documents, most_copies, tokens, largest (tokens of the largest document used,
    more than which rounding can't leave the source off by), actual_share, of every target source."""
    per = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.max("tokens").alias("largest"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    total = per.agg(F.sum("tokens")).first()[0] or 1
    out = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").fillna(0, ["documents", "most_copies", "largest", "tokens"])
    return out.withColumn("actual_share", F.col("tokens") / F.lit(float(total)))
