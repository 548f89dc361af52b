"""Quality rules: base rules on counts, then robust multivariate outliers.

The counts of a text become a vector of transformed statistics. For the rows of each language
and source the minimum covariance determinant estimate is sought by concentration steps: order the
rows by their distance under the present mean and covariance, take the nearest share, and
estimate again from those. A step is one aggregation over all rows: sums by group and narrow
bin of distance, from which the nearest share of each group is put together. Rows whose squared
Mahalanobis distance passes the cutoff are rejected. Groups with few rows are pooled, by
language first, then all together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import few, in_slices, written
from flowgauge.llm.words import SPACE, as_bytes, windows, word_hashes

SYMBOLS = b"#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long"
NAMES = [c.split()[0] for c in COUNTS.split(", ")]
#: Share of a group's rows behind an estimate; fewest rows of a group; concentration steps; bins
#: of squared distance for each doubling; largest squared distance that is kept, which is the
#: 0.99999 quantile of chi-square with 5 degrees of freedom.
SHARE, FEWEST, STEPS, FINE, CUTOFF = 0.6, 60, 5, 64, 30.86
#: Smallest scale of each statistic, added to its spread: what differs less is alike. Each is small
#: enough for its statistic to pass the cutoff alone (repetition within what passes the base rules).
FLOORS = [0.05, 0.1, 0.05, 0.085, 0.08]
P = len(FLOORS)
#: The covariance of the nearest share of normal rows is too small by this factor: SHARE over the
#: chance of chi-square with P + 2 degrees of freedom up to the SHARE quantile of that with P.
CONSISTENT = 1.685
#: Words added to every text in the shares of repetition, as many as the base rules ask for: one
#: repeated line of a short text is not yet repetition.
PRIOR = 50

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\r\x0b\x0c")] if b"\n" in text else ()
    return len(lines) - len(set(lines))


def _repeat_words(hashes: np.ndarray) -> int:
    own = windows(hashes, 3)
    if len(own) < 2:
        return 0
    order = np.sort(own)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return 0
    hit = np.isin(own, again)
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[i : i + len(own)] |= hit
    return int(covered.sum())


def counts(docs: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """``docs`` with the counts of each text, and without the text unless it is to be kept; null has
    no words."""
    kept = [f for f in docs.schema if keep or f.name != text]

    def run(batches):
        for batch in batches:
            for part in in_slices(batch, text):
                texts = as_bytes(part.column(text))
                hashes, bounds = word_hashes(texts)
                data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
                starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64)
                total = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64) if len(texts) else starts
                columns = [
                    np.diff(bounds), total(~SPACE[data] & ((data & 0xC0) != 0x80)), total(_symbol[data]),
                    [_dup_lines(t) for t in texts],
                    [_repeat_words(hashes[bounds[i] : bounds[i + 1]]) for i in range(len(texts))], total(_upper[data])]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), *(pa.array(c, pa.int64()) for c in columns)],
                    [*(f.name for f in kept), *NAMES])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + COUNTS
    return docs.select(*(f.name for f in kept), *([] if keep else [text])).mapInArrow(run, schema)


def statistics() -> Column:
    """The transformed vector: mean word length, and roots of shares, which steadies their spread."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    repeated = lambda a: F.sqrt(F.col(a) / (F.col("n_words") + PRIOR))
    return F.array(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
                   share("n_symbols", "n_words"), repeated("n_dup_lines"), repeated("n_repeat_words"),
                   share("n_upper", "word_chars"))


def pools(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each combination of ``keys`` in ``rows`` the pool that its estimate comes from."""
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n")), "pool-sizes")
    small = sizes.where(F.col("n") < FEWEST)
    wide = small.groupBy(keys[0]).agg(F.sum("n").alias("of"))
    name = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    joined = sizes.join(wide.withColumnRenamed(keys[0], "__k"), F.col(keys[0]).eqNullSafe(F.col("__k")), "left")
    return joined.select(*[F.col(k).alias(f"__{k}") for k in keys], F.when(F.col("n") >= FEWEST, name(*keys)).when(
        F.col("of") >= FEWEST, name(keys[0])).otherwise(F.lit("{}")).alias("pool"))


PARAMETERS = "pool string, mean array<double>, inverse array<double>"


def _start(frame: pd.DataFrame) -> pd.DataFrame:
    """Medians and median deviations of a pool, from counts by statistic and step of 1/256."""
    mean, spread = [], []
    for i in range(P):
        own = frame[frame["i"] == i].sort_values("at")
        at, n = own["at"].to_numpy() / 256, own["n"].to_numpy()
        middle = at[np.searchsorted(np.cumsum(n), n.sum() / 2)]
        away = np.abs(at - middle)
        order = np.argsort(away, kind="stable")
        mean.append(middle)
        spread.append(1.4826 * away[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])
    inverse = np.diag(1 / (np.square(spread) + np.square(FLOORS)))
    return pd.DataFrame({"pool": [frame["pool"].iloc[0]], "mean": [mean], "inverse": [inverse.ravel().tolist()]})


def _concentrate(frame: pd.DataFrame) -> pd.DataFrame:
    """Mean and inverse covariance of a pool's nearest share."""
    frame = frame.sort_values("bin")
    n = np.cumsum(frame["n"].to_numpy())
    own = frame.iloc[: int(np.searchsorted(n, SHARE * n[-1])) + 1]
    held = own["n"].sum()
    mean = np.array([own[f"s{i}"].sum() for i in range(P)]) / held
    cov = np.array([[own[f"s{min(i, j)}{max(i, j)}"].sum() for j in range(P)] for i in range(P)]) / held - np.outer(mean, mean)
    inverse = np.linalg.inv(CONSISTENT * cov + np.diag(np.square(FLOORS)))
    return pd.DataFrame({"pool": [frame["pool"].iloc[0]], "mean": [mean.tolist()], "inverse": [inverse.ravel().tolist()]})


def _distance(x: str = "x", mean: str = "mean", inverse: str = "inverse") -> Column:
    away = [F.col(x)[i] - F.col(mean)[i] for i in range(P)]
    return sum((F.col(inverse)[i * P + j] * away[i] * away[j] for i in range(P) for j in range(P)), F.lit(0.0))


def estimates(rows: DataFrame) -> DataFrame:
    """(pool, mean, inverse) for ``rows`` (pool, x); every row counts in every step."""
    cells = rows.select("pool", F.posexplode("x").alias("i", "v")).groupBy("pool", "i", F.floor(F.col("v") * 256).alias("at"))
    now = written(cells.agg(F.count("*").alias("n")).groupBy("pool").applyInPandas(_start, PARAMETERS), "mcd")
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(P)]
    sums += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"s{i}{j}") for i in range(P) for j in range(i, P)]
    for _ in range(STEPS):
        bins = rows.join(few(now, 20_000), "pool").withColumn(
            "bin", F.floor(F.log2(_distance() + F.lit(1e-9)) * FINE)).groupBy("pool", "bin").agg(F.count("*").alias("n"), *sums)
        now = written(bins.groupBy("pool").applyInPandas(_concentrate, PARAMETERS), "mcd")
    return now


def judged(docs: DataFrame, keys: tuple[str, str] = ("lang", "source"), text: str = "text", keep: bool = False) -> DataFrame:
    """``docs`` (text, lang, source, ...) without text, with its counts, base_failed, distance, kept.

    With ``keep`` the text stays; it is then read and counted a second time, so that texts are not
    written on the way.

    base_failed: fewer than 50 words, or over half of the words in repeated windows of three.
    distance is null for such rows and where even all rows are too few for an estimate; the
    latter are kept. A null text is empty; null languages and sources are values of their own.
    Repeated rows all count and stay. Columns of ``docs`` named like a result are replaced, all
    others stay as they are; names that begin with two underscores are the operator's own.
    """
    results = [*NAMES, "base_failed", "distance", "kept"]
    docs = docs.drop(*[c for c in results if c in docs.columns])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    first = docs.select(*keys, text) if keep else docs
    read = written(counts(first, text).withColumn("base_failed", failed), "quality")
    sound = read.where(~F.col("base_failed")).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *NAMES)
    pool = written(pools(sound, ["k0", "k1"]), "pools")
    same = [F.col(f"k{i}").eqNullSafe(F.col(f"__k{i}")) for i in range(2)]
    rows = written(sound.join(few(pool, 100_000), same).select("pool", statistics().alias("x")), "statistics")
    sizes = rows.groupBy("pool").agg(F.count("*").alias("__n")).where(F.col("__n") >= FEWEST)
    fitted = written(estimates(rows.join(few(written(sizes, "pools"), 100_000), "pool", "left_semi")), "mcd")
    own = written(pool.join(few(fitted, 20_000), "pool").select(
        "__k0", "__k1", F.col("mean").alias("__mean"), F.col("inverse").alias("__inverse")), "pool-estimates")
    if keep:
        read = counts(docs, text, keep=True).withColumn("base_failed", failed)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    full = read.withColumn("__x", statistics()).join(few(own, 20_000), same, "left")
    far = F.when(~F.col("base_failed"), _distance("__x", "__mean", "__inverse"))
    return (full.withColumn("distance", far)
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))
            .drop("__x", "__mean", "__inverse", "__k0", "__k1"))
