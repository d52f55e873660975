"""Seeded splits and samples (deterministic given id and seed, exact sizes, disjoint).

Random streams of pandas/scikit-learn cannot be replayed on a cluster; the contract here
is: rows ordered by ``md5('<id>:<seed>')`` then id, cut at exact sizes computed with
integer arithmetic. Rows without id are kept, each placed by the hash of its columns. All cuts go through ``hash_rank_cut`` (no global sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexing import fresh_name, hash_rank, hash_rank_cut

# The ablation seeds of the repeated 5 % samples.
ABLATION_SEEDS = [10350, 11397, 11617, 14694, 16251, 40691, 64969, 82924, 87237]
DEFAULT_SEED = 42
SPLIT_NAMES = ("test", "dev", "train")


def _ceil_pct(total, pct: int):
    """ceil(total * pct / 100) in exact integer arithmetic."""
    return F.floor((total * pct + 99) / 100).cast("bigint")


def split_train_dev_test(df: DataFrame, id_col: str, held_pct: int = 5,
                         seed: int = DEFAULT_SEED, name: str = "split") -> DataFrame:
    """Hold out ceil(held_pct% of N) rows, half of them (rounded up) as test, the rest as
    dev; everything else is train."""
    total = F.col("_total")
    held = _ceil_pct(total, held_pct)
    test = F.floor((held + 1) / 2).cast("bigint")
    part = fresh_name(df, "_part")
    out = hash_rank_cut(df, id_col, seed, [test, held], name=part)
    return out.withColumn(name, F.element_at(F.array(*[F.lit(s) for s in SPLIT_NAMES]), F.col(part) + 1)).drop(part)


def sample_fraction(df: DataFrame, id_col: str, pct: int = 5, seed: int = DEFAULT_SEED,
                    base_total: int | None = None) -> DataFrame:
    """Exactly floor(pct% of N) rows without replacement.

    ``base_total`` lets the count come from another table (the reference takes 5 % of the
    whole corpus but draws the rows from the training part).
    """
    total = F.lit(base_total) if base_total is not None else F.col("_total")
    n = F.floor(total * pct / 100).cast("bigint")
    part = fresh_name(df, "_part")
    return hash_rank_cut(df, id_col, seed, [n], name=part).where(F.col(part) == 0).drop(part)


def sample_fraction_seeds(df: DataFrame, id_col: str, seeds: list[int] | None = None,
                          pct: int = 5) -> DataFrame:
    """One exact-size sample per seed (adds a ``seed`` column)."""
    seeds = seeds or ABLATION_SEEDS
    rep = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    n = F.floor(F.col("_total") * pct / 100).cast("bigint")
    part = fresh_name(df, "_part")
    out = hash_rank_cut(rep, id_col, "seed", [n], group_cols=["seed"], name=part)
    return out.where(F.col(part) == 0).drop(part)


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED, name: str = "pos") -> DataFrame:
    """A seeded permutation: ``name`` is each row's 0-based position."""
    return hash_rank(df, id_col, seed, name)


def union_lines(first: DataFrame, second: DataFrame, shuffle: bool = False,
                seed: int = DEFAULT_SEED, id_col: str = "line_id") -> DataFrame:
    """Union-all of two line tables; with ``shuffle`` add a seeded position ``pos``."""
    both = first.unionByName(second)
    return seeded_shuffle(both, id_col, seed) if shuffle else both
