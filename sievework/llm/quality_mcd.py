"""Quality rules with robust multivariate outliers.

Statistics of every whole text become a vector of five transformed features. For each language and source the minimum
covariance determinant (MCD) gives a centre and a scatter that junk can't pull: deterministic starts (Hubert, Rousseeuw and
Verdonck, 2012), concentration steps over all rows, one reweighting. A document whose Mahalanobis distance from its group
exceeds the cut is rejected; the distance alone decides. The features are transformed so that it can: each tells of junk
(word length both ways, shares of symbols, repeats, capitals and doubled words, which clean texts hold near zero), length of
the text is none of them, and all are shrunk as if PRIOR_WORDS words of an ordinary text stood in front, so that the noise of
short texts isn't taken for junk.

The steps are Spark aggregations. A concentration step needs the h rows of smallest distance in each group: distances are
counted in fixed logarithmic bins, each bin keeps the moments of its rows, and the bins below the one that holds the h-th
row give the next centre and scatter. So a step is one grouped sum over (group, start, bin), whatever the group's size: no
group is gathered, sampled or sorted, and the only things per group are at most BINS rows of moments.

Groups of fewer than `least` documents that pass the base rule use the estimate of all documents of their language, and where
that has fewer, too, the estimate of the whole corpus. Only in a corpus of less than half as many does the base rule decide alone.

Cases: a null text has no words, so it fails the base rule, as do empty and very short texts; null language or source is a
group value of its own; repeated rows count as often as they stand; ties in distance fall into one bin together; features
that don't vary get the floor in FLOOR, so no scatter is singular; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, columns_only, drop_listed, lookup, map_rows, text_key, written

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_adjacent")
FEATURES = ("f1", "f2", "f3", "f4", "f5")
#: Standard deviations whose squares are added to the variances, so that no scatter is singular where a feature hardly
#: varies: a sixteenth of a word's length, and three words in a hundred; six for repeats, as one line that stands twice is no junk.
FLOOR = (0.25, 0.03, 0.06, 0.03, 0.03)
PRIOR_WORDS, PRIOR_LENGTH = 20, 5
#: The quantile 1 - 1e-6 of chi-square with five degrees of freedom, that of squared distances in a normal sample.
CUT = 35.888
#: Distances are binned at BINS_PER_UNIT per unit of log distance, from 0 to BINS - 1.
BINS, BINS_PER_UNIT = 400, 16
STARTS = 3
WINDOW = 5


class _Hashes(dict):
    """Words to 64-bit hashes, kept for a document."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word) >> 1
        return h


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window which the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(_Hashes().__getitem__, words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(len(words) + 1, np.int64)
    hit = np.union1d(order[1:][same], order[:-1][same])
    starts[hit] += 1
    starts[hit + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(starts[:-1])))


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one text; words are split at ASCII white space only."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = upper + len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated_words(words), lines, upper, letters, sum(map(eq, words, words[1:]))


STATS_DDL = "doc_id long, lang string, source string, text_key long, " + ", ".join(f"{c} long" for c in STATS)
STATS_ARROW = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("text_key", pa.int64()), *((c, pa.int64()) for c in STATS)])


def document_statistics(docs: DataFrame) -> DataFrame:
    rows = columns_only(docs, "doc_id", "lang", "source", "text").withColumn("text_key", text_key(F.col("text")))
    return map_rows(
        rows.select("doc_id", "lang", "source", "text_key", "text"),
        lambda it: ((*row[:4], *statistics(row[4])) for row in it),
        STATS_DDL,
        STATS_ARROW,
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def features() -> dict[str, Column]:
    """The transformed vector: word length on a log scale, and shares."""
    words = F.col("n_words") + PRIOR_WORDS
    letters = F.col("n_letters") + PRIOR_WORDS * PRIOR_LENGTH
    return {
        "f1": F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / words) * 4,
        "f2": F.least(F.col("n_symbols") / words, F.lit(4.0)),
        "f3": F.col("n_dup_lines") / (F.col("n_lines") + 1) * 0.25 + F.col("n_repeat_words") / words,
        "f4": F.col("n_upper") / letters,
        "f5": F.col("n_adjacent") / words,
    }


def _pools(rows: DataFrame, least: int) -> DataFrame:
    """Adds `pool`, the group whose estimate a row uses: its language and source, its language, or all; and `pools`, the
    groups to whose estimates it belongs. Those of languages and of all hold all their rows, and are made where one is used."""
    lang = F.coalesce("lang", F.lit("\x1e"))
    rows = rows.withColumn("fine", F.concat_ws("\x1f", F.lit("s"), lang, F.coalesce("source", F.lit("\x1e"))))
    n = checkpointed(rows.groupBy("fine", F.concat_ws("\x1f", F.lit("l"), lang).alias("wide")).agg(F.count_if(~F.col("base_failed")).alias("n")))
    m = n.groupBy("wide").agg(F.sum("n").alias("m"), (F.min("n") < least).alias("used"))
    total = n.agg(F.sum("n").alias("total"))
    far = m.agg(F.bool_or(F.col("used") & (F.col("m") < least)).alias("far"))
    named = n.join(m, "wide").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(far))
    own, next_, last = F.when(F.col("n") >= least, F.col("fine")), F.when(F.col("m") >= least, F.col("wide")), F.when(F.col("total") >= least // 2, F.lit("all"))
    made = F.array_compact(F.array(own, F.when(F.col("used"), next_), F.when(F.col("far"), last)))
    return lookup(rows, checkpointed(named.select("fine", F.coalesce(own, next_, last, F.lit("none")).alias("pool"), made.alias("pools"))), ["fine"]).drop("fine")


def _distance2(center: str = "center", inverse: str = "inverse") -> Column:
    d = [F.col(f) - F.col(center)[i] for i, f in enumerate(FEATURES)]
    p = len(FEATURES)
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + d[i] * d[j] * F.col(inverse)[i * p + j] * (1 if i == j else 2)
    return total


def _moments(prefix: str = "") -> list[Column]:
    cols = [F.col(prefix + f) for f in FEATURES]
    one = [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    return [F.count("*").alias("n"), *one, *(F.sum(cols[i] * cols[j]).alias(f"q{i}{j}") for i in range(len(cols)) for j in range(i, len(cols)))]


PARAMS_DDL = "pool string, start int, n long, logdet double, center array<double>, inverse array<double>"


def _estimate(n: float, s: np.ndarray, q: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    center = s / n
    cov = (q / n - np.outer(center, center)) * scale + np.diag(np.square(FLOOR))
    cov = np.round((cov + cov.T) / 2, 12)
    return np.round(center, 12), np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _pack(row: pd.Series) -> tuple[float, np.ndarray, np.ndarray]:
    p = len(FEATURES)
    q = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            q[i, j] = q[j, i] = row[f"q{i}{j}"]
    return float(row["n"]), np.array([row[f"s{i}"] for i in range(p)]), q


def _chi_trim(share: float) -> float:
    """How much the scatter of the `share` rows nearest to the centre of a normal sample must grow to estimate the whole's:
    share / P(chi2_{p+2} <= quantile_p(share)), by a fixed Wilson-Hilferty approximation."""
    from statistics import NormalDist

    p, z = len(FEATURES), NormalDist()
    q = p * (1 - 2 / (9 * p) + z.inv_cdf(share) * math.sqrt(2 / (9 * p))) ** 3
    k = p + 2
    inner = z.cdf(((q / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))
    return share / inner


def _concentrate(bins: DataFrame, share: float) -> DataFrame:
    """From moments per (pool, start, bin) to the next centre and scatter per (pool, start)."""
    scale = _chi_trim(share)

    def step(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin")
        need = math.ceil(share * part["n"].sum())
        last = int(np.searchsorted(part["n"].cumsum().to_numpy(), need))
        n, s, q = _pack(part.iloc[: last + 1].sum(numeric_only=True))
        center, inverse, logdet = _estimate(n, s, q, scale)
        first = part.iloc[0]
        return pd.DataFrame({"pool": [first["pool"]], "start": [first["start"]], "n": [int(part["n"].sum())], "logdet": [logdet], "center": [center.tolist()], "inverse": [inverse.ravel().tolist()]})

    return bins.groupBy("pool", "start").applyInPandas(step, PARAMS_DDL)


def _binned(rows: DataFrame, d2: Column) -> DataFrame:
    place = F.floor(F.log(F.greatest(d2, F.lit(0.0)) + 0.01) * (BINS_PER_UNIT / 2) + 40)
    return rows.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).cast("int")).groupBy("pool", "start", "bin").agg(*_moments())


def _starts(rows: DataFrame) -> DataFrame:
    """Three starts for each pool: correlations of tanh scores, spatial signs, and the rows nearest to the medians."""
    quart = rows.groupBy("pool").agg(F.count("*").alias("n"), *(F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"p{f}") for f in FEATURES))
    quart = checkpointed(quart)
    known = lookup(rows, quart.drop("n"), ["pool"])
    floor = dict(zip(FEATURES, FLOOR))
    spread = {f: F.sqrt(F.pow((F.col(f"p{f}")[2] - F.col(f"p{f}")[0]) / 1.349, 2) + floor[f] ** 2) for f in FEATURES}
    z = known.select("pool", *(((F.col(f) - F.col(f"p{f}")[1]) / spread[f]).alias(f) for f in FEATURES))
    norm2 = sum((F.col(f) * F.col(f) for f in FEATURES), F.lit(0.0))
    norm = F.sqrt(norm2 + 1e-6)
    tanh = z.select("pool", F.lit(0).alias("start"), *(F.tanh(f).alias(f) for f in FEATURES))
    sign = z.select("pool", F.lit(1).alias("start"), *((F.col(f) / norm).alias(f) for f in FEATURES))
    near = z.where(norm2 < 2 * len(FEATURES)).select("pool", F.lit(2).alias("start"), *FEATURES)
    sums = tanh.unionByName(sign).unionByName(near).groupBy("pool", "start").agg(*_moments())
    wide = sums.withColumnRenamed("n", "m").join(quart, "pool")
    p = len(FEATURES)

    def first(batches):
        for part in batches:
            out = []
            for _, row in part.iterrows():
                row["n"] = row["m"]
                n, s, q = _pack(row)
                cov = q / n - np.outer(s / n, s / n) + 1e-3 * np.eye(p)
                d = np.sqrt(np.diag(cov))
                corr = cov / np.outer(d, d)
                sd = np.array([math.hypot((row[f"p{f}"][2] - row[f"p{f}"][0]) / 1.349, FLOOR[i]) for i, f in enumerate(FEATURES)])
                scatter = corr * np.outer(sd, sd)
                out.append((row["pool"], int(row["start"]), int(n), float(np.linalg.slogdet(scatter)[1]), [float(row[f"p{f}"][1]) for f in FEATURES], np.linalg.inv(scatter).ravel().tolist()))
            yield pd.DataFrame(out, columns=["pool", "start", "n", "logdet", "center", "inverse"])

    return wide.mapInPandas(first, PARAMS_DDL)


def mcd(rows: DataFrame, share: float = 0.75, steps: int = 4, reweigh_at: float = 16.0) -> DataFrame:
    """(pool, features) to one row per pool: n, center, inverse scatter. rows must be cheap to read again."""
    params = checkpointed(_starts(rows))
    for _ in range(steps):
        params = checkpointed(_concentrate(_binned(lookup(rows, params, ["pool"], "inner"), _distance2()), share))
    best = checkpointed(params.groupBy("pool").agg(F.min_by(F.struct("start", "n", "logdet", "center", "inverse"), F.struct("logdet", "start")).alias("b")).select("pool", "b.*"))
    # One reweighting: the moments of all rows within the inner cut.
    inner = lookup(rows, best, ["pool"], "inner").where(_distance2() <= reweigh_at).groupBy("pool").agg(*_moments())

    def final(batches):
        for part in batches:
            out = [(row["pool"], int(row["n"]), *(lambda e: (e[0].tolist(), e[1].ravel().tolist()))(_estimate(*_pack(row)))) for _, row in part.iterrows()]
            yield pd.DataFrame(out, columns=["pool", "n", "center", "inverse"])

    return checkpointed(inner.mapInPandas(final, "pool string, n long, center array<double>, inverse array<double>"))


def quality(docs: DataFrame, cut: float = CUT, least: int = 100, share: float = 0.75) -> DataFrame:
    """One row per document: its statistics, base_failed, kept, distance2 (null without an estimate) and text_key.

    cut: the squared distance beyond which a document goes.
    """
    stats = written(document_statistics(docs), "quality")
    rows = _pools(stats.withColumns(features()), least)
    fit = mcd(rows.where(~F.col("base_failed")).select(F.explode("pools").alias("pool"), *FEATURES), share)
    judged = lookup(rows, fit.select("pool", "center", "inverse"), ["pool"])
    d2 = F.round(_distance2(), 6)
    rejected = F.coalesce(d2 > cut, F.lit(False))
    return judged.select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), d2.alias("distance2"), "text_key")


def keep_quality(docs: DataFrame, **how) -> DataFrame:
    """The documents that `quality` keeps, with all their columns."""
    return drop_listed(docs, quality(docs, **how).where(~F.col("kept")).select("doc_id", "text_key"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
