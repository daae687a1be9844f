"""Quality rules: base rules, and robust multivariate outliers by language and source.

Statistics come from one Arrow pass over whole texts. Each (lang, source) group gets a minimum-covariance-determinant
(MCD) estimate of its transformed statistic vectors: among halves of the group, that whose (regularised) covariance
has the least determinant. Starts come from random subsets of P + 1 rows of a bounded sample of the group
(SAMPLE_ROWS), improved by concentration steps there; the STARTS best and the medians with MADs then take concentration
steps on the whole group, as distributed aggregates (counts, sums, cross products, mergeable quantile sketches), so that a hot source costs
no task more than others; the start with the least determinant goes on until its determinant no longer falls. The half's
covariance is made consistent by the usual factor, and mean and covariance are taken once more from all rows within the
chi-square quantile REWEIGHT (the reweighted MCD). A document is rejected if its squared Mahalanobis distance passes the
chi-square quantile whose tail is TAIL.

A group of fewer than LEAST_ROWS rows (ten a dimension) has no estimate of its own: its documents are judged by that of their
whole language, or, where that is as small, by that of all documents; `estimate` in the result says which ('source', 'language', 'all').

Defined cases: a null or wordless text has no words and fails the base rules; null lang or source is
a group of its own; an empty table gives no rows; a constant statistic counts by a floor on its
variance; equal rows get equal verdicts, and a distance at the cutoff is kept; a very long text is a step of its own;
other columns are passed through, whatever they are called.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, drop, free_name, maybe_broadcast, settle

SYMBOLS = b"#*$%&|<>"
#: Rows that an estimate needs.
LEAST_ROWS = 60
#: The sample that starts are searched in, the subsets tried there, those improved to the end, and those tried on the whole group.
SAMPLE_ROWS, SUBSETS, BEST, STARTS = 2000, 60, 8, 3
#: Concentration steps of all starts on the whole group, before the best goes on alone.
FIRST_STEPS = 2
#: A log-determinant that falls by less is the end; quantile sketches of large groups are exact to a ten-thousandth of the rows.
TOLERANCE = 1e-3
#: Least standard deviation of each transformed statistic, added to the covariance: what lies below is no finding.
FLOORS = (0.08, 0.03, 0.04, 0.1, 0.1, 0.06)
ALPHA, REWEIGHT = 0.5, 0.975
#: Bytes of an estimate as a row, at about most.
ROW_BYTES = 8 * (len(FLOORS) ** 2 + len(FLOORS)) + 200
#: Share of a normal group beyond the cutoff.
TAIL = 1e-9
P = len(FLOORS)
NAMES = [f"x{i}" for i in range(P)]

STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")]
    + [T.StructField("upper", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))]
)


def stats(texts: list[bytes | None]) -> dict:
    """The base statistics of each text and its vector."""
    out: dict = {f.name: [] for f in STATS}
    for raw in texts:
        raw = raw or b""
        words = raw.split()
        n = len(words)
        solid = raw.translate(None, b" \t\n\r\x0b\x0c")
        text = solid.decode("utf-8", "replace")
        chars = len(text)
        symbols = len(solid) - len(solid.translate(None, SYMBOLS))
        seen, dup, lines = set(), 0, 0
        for line in raw.split(b"\n"):
            if line.strip():
                lines += 1
                dup += line in seen
                seen.add(line)
        repeat = repeated_words(words)
        upper = len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        x = vector(n, chars, symbols, dup, repeat, lines, upper)
        for name, v in zip(out, (n, chars, symbols, dup, repeat, lines, upper, x), strict=True):
            out[name].append(v)
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    grams = [*zip(words, words[1:], words[2:], strict=False)]
    if len(set(grams)) == len(grams):
        return 0
    count = Counter(grams)
    total, until = 0, 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            total += i + 3 - max(until, i)
            until = i + 3
    return total


def vector(n, chars, symbols, dup, repeat, lines, upper) -> list[float]:
    """Log of the word length, and square roots of the shares; the length of a text is no fault and is left out but for its spread of lines."""
    if not n:
        return [0.0] * P
    return [
        math.log(chars / n),
        math.sqrt(symbols / chars),
        math.sqrt(upper / chars),
        math.sqrt(dup / max(1, lines)),
        math.sqrt(repeat / n),
        math.log1p(n / max(1, lines)) / 10,
    ]


def base_failed(n_words, n_repeat):
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


# --- estimates ---------------------------------------------------------------------------


def chi2_tail(x: float, dof: int) -> float:
    """Share of a chi-square variable beyond x, for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


def chi2_quantile(tail: float, dof: int) -> float:
    """The value beyond which `tail` lies."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, dof) > tail else (lo, mid)
    return lo


def consistency(share: float) -> float:
    """What the covariance of the nearest `share` of normal vectors is multiplied by."""
    return share / (1 - chi2_tail(chi2_quantile(1 - share, P), P + 2))


CUTOFF = chi2_quantile(TAIL, P)
NEAR = chi2_quantile(1 - REWEIGHT, P)


def regular(cov: np.ndarray, factor: float) -> tuple[np.ndarray, float]:
    """Inverse and log-determinant of the consistent covariance with its floors."""
    cov = cov * factor + np.diag(np.square(FLOORS))
    return np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def concentrate(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One concentration step: estimate and log-determinant of the half nearest to the estimate given."""
    d = x - mean
    d2 = np.einsum("ij,jk,ik->i", d, inverse, d)
    near = x[d2 <= np.partition(d2, (len(x) - 1) // 2)[(len(x) - 1) // 2]]
    mean = near.mean(0)
    return mean, *regular((near - mean).T @ (near - mean) / len(near), consistency(ALPHA))


def starts(x: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Medians with MADs, and the best estimates that concentration finds from random subsets."""
    middle = np.median(x, 0)
    spread = 1.4826 * np.median(np.abs(x - middle), 0)
    found, rng = [], np.random.default_rng(seed)
    for _ in range(SUBSETS):
        part = x[rng.choice(len(x), min(len(x), P + 1), replace=False)]
        mean = part.mean(0)
        at = mean, *regular((part - mean).T @ (part - mean) / len(part), 1.0)
        for _ in range(2):
            at = concentrate(x, at[0], at[1])
        found.append(at)
    best = []
    for at in sorted(found, key=lambda a: a[2])[:BEST]:
        while (after := concentrate(x, at[0], at[1]))[2] < at[2] - 1e-9:
            at = after
        best.append(at)
    best.sort(key=lambda a: a[2])
    return [(middle, np.diag(1 / (spread**2 + np.square(FLOORS)))), *[(m, i) for m, i, _ in best[:STARTS]]]


def moments(df: DataFrame) -> DataFrame:
    sums = [F.count(F.lit(1)).alias("m")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i in range(P) for j in range(i, P)]
    return df.groupBy("g", "k").agg(*sums)


def estimated(batches, factor: float):
    """Mean, inverse covariance and log-determinant of each row of moments."""
    for pdf in batches:
        out: dict = {"mean": [], "inverse": [], "logdet": []}
        for row in pdf.itertuples(index=False):
            m = max(1, row.m)
            mu = np.array([getattr(row, f"s{i}") for i in range(P)]) / m
            cov = np.zeros((P, P))
            for i in range(P):
                for j in range(i, P):
                    cov[i, j] = cov[j, i] = getattr(row, f"c{i}_{j}") / m - mu[i] * mu[j]
            inverse, logdet = regular(cov, factor)
            for name, v in zip(out, (mu.tolist(), inverse.ravel().tolist(), logdet), strict=True):
                out[name].append(v)
        yield pd.DataFrame({"g": pdf["g"], "k": pdf["k"], **out})


def distance(x: list, mean, inverse):
    """Squared Mahalanobis distance, JVM-side."""
    d = [x[i] - F.element_at(mean, i + 1) for i in range(P)]
    terms = [d[i] * d[j] * F.element_at(inverse, i * P + j + 1) * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


ESTIMATE = "g string, k int, mean array<double>, inverse array<double>, logdet double"


def estimates(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """g, mean, inverse: the reweighted MCD estimate of each group. rows: g, x0 ..; sizes: g, n."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x, g = pdf[NAMES].to_numpy(np.float64), pdf["g"].iloc[0]
        found = starts(x, zlib.crc32(g.encode()))
        return pd.DataFrame({"g": g, "k": range(len(found)), "mean": [m.tolist() for m, _ in found], "inverse": [i.ravel().tolist() for _, i in found], "logdet": np.inf})

    # a row is drawn by its own number, so that copies are drawn one by one
    drawn = rows.join(maybe_broadcast(sizes, 100), "g").where((F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(float(SAMPLE_ROWS << 20)) / F.col("n")))
    now = settle(drawn.select("g", *NAMES).groupBy("g").applyInPandas(search, ESTIMATE), "quality-starts")
    d2 = distance([F.col(n) for n in NAMES], "mean", "inverse").alias("d2")

    def nearer(at: DataFrame) -> DataFrame:
        """A concentration step of every group's starts on the whole group."""
        far = rows.join(maybe_broadcast(at.select("g", "k", "mean", "inverse"), ROW_BYTES), "g").select("g", "k", *NAMES, d2)
        half = settle(far.groupBy("g", "k").agg(F.percentile_approx("d2", ALPHA, 10000).alias("half")), "quality-halves")
        near = far.join(maybe_broadcast(half, 100), ["g", "k"]).where("d2 <= half")
        done = settle(moments(near).mapInPandas(lambda it: estimated(it, consistency(ALPHA)), ESTIMATE), "quality-step")
        drop(half)
        return done

    for _ in range(FIRST_STEPS):
        now, before = nearer(now), now
        drop(before)
    best = now.groupBy("g").agg(F.min(F.struct("logdet", "k", "mean", "inverse")).alias("b"))
    now = settle(best.select("g", F.lit(0).alias("k"), "b.mean", "b.inverse", "b.logdet"), "quality-best")
    done, live = None, now
    while True:
        after = nearer(live)
        both = live.select("g", F.struct("mean", "inverse", "logdet").alias("old")).join(after.select("g", F.struct("mean", "inverse", "logdet").alias("new")), "g")
        both = both.withColumn("falls", F.col("new.logdet") < F.col("old.logdet") - TOLERANCE)
        pick = F.when(F.col("new.logdet") < F.col("old.logdet"), F.col("new")).otherwise(F.col("old"))
        step = settle(both.select("g", F.lit(0).alias("k"), pick.alias("b"), "falls").select("g", "k", "b.*", "falls"), "quality-best")
        ended = step.where("NOT falls").drop("falls")
        done = ended if done is None else done.unionByName(ended)
        drop(after)
        live = step.where("falls").drop("falls")
        if live.isEmpty():
            break
    # the reweighted estimate: all rows within the quantile
    near = rows.join(maybe_broadcast(done.select("g", "k", "mean", "inverse"), ROW_BYTES), "g").select("g", "k", *NAMES, d2).where(F.col("d2") <= NEAR)
    return settle(moments(near).mapInPandas(lambda it: estimated(it, consistency(REWEIGHT)), ESTIMATE), "quality-estimates").select("g", "mean", "inverse")


LEVELS = ("source", "language", "all")


def judge(docs: DataFrame, *, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`keep` columns and a struct `quality`: the statistics, base_failed, the squared distance, whose estimate it is to, and kept."""
    keys = ["g_lang", "g_source"]
    groups = [F.col(f"`{lang}`").cast("string").alias("g_lang"), F.col(f"`{source}`").cast("string").alias("g_source")]
    narrow = annotate(docs.select(F.col(f"`{text}`").alias("text"), *groups), "text", lambda t, _: stats(t), STATS, keys, name="q")
    narrow = narrow.where(~base_failed(F.col("q.n_words"), F.col("q.n_repeat_words")))
    vectors = [F.element_at("q.x", i + 1).alias(f"x{i}") for i in range(P)]
    rows = settle(narrow.select(*keys, *vectors, F.monotonically_increasing_id().alias("row")), "quality-rows")
    # each group's size at its own level and at those that it may be pooled at
    size = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n0")), "quality-sizes")
    by_lang = size.groupBy(F.col("g_lang").alias("l")).agg(F.sum("n0").alias("n1"))
    known = size.join(by_lang, F.col("g_lang").eqNullSafe(F.col("l"))).crossJoin(F.broadcast(size.agg(F.sum("n0").alias("n2"))))  # one row
    known = known.withColumn("level", F.when(F.col("n0") >= LEAST_ROWS, 0).when(F.col("n1") >= LEAST_ROWS, 1).otherwise(2))
    shown = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("null"))
    at_level = F.array(F.concat_ws(" ", F.lit("source"), shown(keys[0]), shown(keys[1])), F.concat_ws(" ", F.lit("language"), shown(keys[0])), F.lit("all"))
    known = known.withColumn("names", at_level).withColumn("g", F.element_at("names", F.col("level") + 1))
    known = settle(known.withColumn("n", F.element_at(F.array("n0", "n1", "n2"), F.col("level") + 1)).select(*keys, "level", "names", "g", "n"), "quality-groups")
    wanted = settle(known.select("g", "n").distinct(), "quality-wanted")
    # a row counts for its group's estimate and for the pooled ones that some group needs
    of = known.select(F.col("g_lang").alias("l"), F.col("g_source").alias("s"), F.explode("names").alias("g")).join(wanted.select("g"), "g", "left_semi")
    each = settle(rows.join(maybe_broadcast(of, 200), F.col("g_lang").eqNullSafe(F.col("l")) & F.col("g_source").eqNullSafe(F.col("s"))).select("g", "row", *NAMES), "quality-vectors")
    made = estimates(each, wanted)
    e = known.join(made, "g").select(F.col("g_lang").alias("__l"), F.col("g_source").alias("__s"), F.col("level").alias("__level"), F.col("mean").alias("__mean"), F.col("inverse").alias("__inverse"))
    e = settle(e, "quality-known")
    drop(rows, each)

    own = free_name("quality", keep)
    marked = docs.withColumns({free_name("g_lang", docs.columns): groups[0], free_name("g_source", docs.columns): groups[1]})
    gl, gs = marked.columns[-2:]
    df = annotate(marked, text, lambda t, _: stats(t), STATS, [*keep, gl, gs], name=own)
    df = df.join(maybe_broadcast(e, ROW_BYTES), F.col(f"`{gl}`").eqNullSafe(F.col("__l")) & F.col(f"`{gs}`").eqNullSafe(F.col("__s")), "left")
    q = lambda n: F.col(f"`{own}`.{n}")
    d2 = distance([q("x")[i] for i in range(P)], "__mean", "__inverse")
    bad = base_failed(q("n_words"), q("n_repeat_words"))
    by = F.when(~bad, F.element_at(F.array(*map(F.lit, LEVELS)), F.col("__level") + 1))
    verdict = F.struct(*[q(f.name).alias(f.name) for f in STATS.fields[:-1]], bad.alias("base_failed"), d2.alias("distance2"), by.alias("estimate"), (~bad & (d2 <= CUTOFF)).alias("kept"))
    return df.select(*[F.col(f"`{c}`") for c in keep], verdict.alias(own))


def reject(docs: DataFrame, **options) -> DataFrame:
    """The documents kept, with their own columns."""
    columns = docs.columns
    df = judge(docs, keep=columns, **options)
    return df.where(F.col(f"`{df.columns[-1]}`.kept")).select(*[F.col(f"`{c}`") for c in columns])


def op3(spark, sf_dir: str) -> DataFrame:
    df = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2", "estimate"]
    return df.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])
