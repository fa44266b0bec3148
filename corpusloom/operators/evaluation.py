"""Statistics of model evaluation on 0/1 results: accuracy, paired and unpaired tests, bootstrap, merging."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def accuracy(df: DataFrame, groups: list[str], correct: str) -> DataFrame:
    p = F.avg(F.col(correct).cast("double"))
    se = F.sqrt(p * (1 - p) / F.count(correct))
    return df.groupBy(*groups).agg(F.count(correct).alias("n"), F.round(p * 100, 4).alias("accuracy"), F.round(se * 100, 4).alias("se"), F.round(se * 196, 4).alias("ci95"))


def discordant(df: DataFrame, a: str, b: str, groups: list[str] | None = None) -> DataFrame:
    """b10, b01 and the corrected statistic of paired results in two columns."""
    only = lambda x, y: F.count_if((F.col(x) == 1) & (F.col(y) == 0))
    out = df.groupBy(*(groups or [])).agg(F.count("*").alias("n"), only(a, b).alias("b10"), only(b, a).alias("b01"))
    total = F.col("b10") + F.col("b01")
    chi = F.when(total > 0, F.pow(F.abs(F.col("b10") - F.col("b01")) - 1, F.lit(2)) / total).otherwise(F.lit(0.0))
    return out.withColumn("chi2", F.round(chi, 6))


def p_of_chi2(chi2: float) -> float:
    """Upper tail for one degree of freedom."""
    return math.erfc(math.sqrt(chi2 / 2))


def mcnemar(b10: int, b01: int) -> float:
    return 1.0 if b10 + b01 == 0 else p_of_chi2((abs(b10 - b01) - 1) ** 2 / (b10 + b01))


def erfc(x: Column, terms: int = 160) -> Column:
    """1 less the error function of x >= 0, from the series with positive terms only; 0 beyond 6.5."""
    start = F.struct(x.alias("term"), x.alias("total"))
    step = lambda a, n: F.struct((a["term"] * 2 * x * x / (2 * n + 3)).alias("term"), (a["total"] + a["term"] * 2 * x * x / (2 * n + 3)).alias("total"))
    series = F.aggregate(F.sequence(F.lit(0), F.lit(terms)), start, step, lambda a: a["total"])
    return F.when(x > 6.5, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series))


def two_sided(z: Column) -> Column:
    """The p-value of a normal statistic."""
    return erfc(F.abs(z) / math.sqrt(2))


def with_p(df: DataFrame, chi2: str = "chi2") -> DataFrame:
    """The p-value of each row's statistic with one degree of freedom."""
    return df.withColumn("p", F.round(erfc(F.sqrt(F.col(chi2) / 2)), 6))


def two_proportions(results: DataFrame, reference: str, model: str = "model", value: str = "value", se: str = "se", task: str = "task") -> DataFrame:
    """z of each model against the reference one on the same task, its p-value, and whether that is under 0.05."""
    ref = results.where(F.col(model) == reference).select(task, F.col(value).alias("ref_value"), F.col(se).alias("ref_se"))
    z = (F.col("ref_value") - F.col(value)) / F.hypot(F.col(se), F.col("ref_se"))
    out = results.where(F.col(model) != reference).join(ref, task).withColumn("p", F.round(two_sided(z), 6))
    return out.withColumn("significant", F.col("p") < 0.05).withColumn("z", F.round(z, 6))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both models' values, x and y, of the items that both have."""
    return a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)


def by_position(df: DataFrame, x: str, y: str, *keep: str) -> DataFrame:
    """at, x and y of two vectors of results, place by place; an error where their lengths differ."""
    same = F.size(x) == F.size(y)
    both = F.when(same, F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).otherwise(F.raise_error(F.concat(F.lit("vectors of different lengths: "), F.size(x).cast("string"), F.lit(" and "), F.size(y).cast("string"))))
    return df.select(*keep, F.posexplode(both).alias("at", "xy")).select(*keep, "at", F.col("xy.x").alias("x"), F.col("xy.y").alias("y"))


def aligned(df: DataFrame, task: str, key: str, model: str) -> DataFrame:
    """Rows whose key every model of the task has."""
    models = df.groupBy(task).agg(F.count_distinct(model).alias("models"))
    have = df.groupBy(task, key).agg(F.count_distinct(model).alias("have"))
    full = have.join(models, task).where("have = models").select(task, key)
    return df.join(full, [task, key], "left_semi")


def bootstrap(df: DataFrame, value: str, rounds: int = 2000, seed: int = 0, groups: list[str] | None = None) -> DataFrame:
    """Percentile interval of the mean of 0/1 values.

    Resampling n such values with replacement draws the number of ones from a binomial distribution, so only n and
    the number of ones of each group are needed; rounds are drawn per group.
    """
    gs = groups or []
    sums = df.groupBy(*gs).agg(F.count(value).alias("n"), F.sum(F.col(value).cast("bigint")).alias("ones"))
    fields = ", ".join([*(f"`{g}` {dict(sums.dtypes)[g]}" for g in gs), "n bigint", "mean double", "low double", "high double"])

    def run(it):
        import numpy as np

        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                draw = np.random.default_rng([seed, r.n, r.ones])
                means = np.sort(draw.binomial(r.n, r.ones / r.n, rounds) / r.n) if r.n else np.zeros(rounds)
                rows.append([*(getattr(r, g) for g in gs), r.n, r.ones / max(r.n, 1), means[int(0.025 * rounds)], means[int(0.975 * rounds)]])
            yield pd.DataFrame(rows, columns=[*gs, "n", "mean", "low", "high"])

    return sums.mapInPandas(run, fields)


def drawn_per_group(sums: DataFrame, groups: list[str], draw: Callable, rounds: int) -> DataFrame:
    """The groups, `value`, and the percentile interval of what draw(row) gives: a value and an array of `rounds` values."""
    fields = ", ".join([*(f"`{g}` {dict(sums.dtypes)[g]}" for g in groups), "n bigint", "value double", "low double", "high double"])

    def run(it):
        import numpy as np

        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                value, drawn = draw(r)
                drawn = np.sort(drawn)
                rows.append([*(getattr(r, g) for g in groups), r.n, value, drawn[int(0.025 * rounds)], drawn[int(0.975 * rounds)]])
            yield pd.DataFrame(rows, columns=[*groups, "n", "value", "low", "high"])

    return sums.mapInPandas(run, fields)


def paired_bootstrap(df: DataFrame, x: str, y: str, rounds: int = 5000, seed: int = 0, groups: list[str] | None = None) -> DataFrame:
    """n, mean difference of paired 0/1 values and its percentile interval.

    A difference is -1, 0 or 1, so resampling n pairs with replacement draws from a multinomial distribution: each group's
    three counts are all that is needed, however many pairs there are.
    """
    d = F.col(x).cast("int") - F.col(y).cast("int")
    sums = df.where(d.isNotNull()).groupBy(*(groups or [])).agg(F.count("*").alias("n"), F.count_if(d == 1).alias("more"), F.count_if(d == -1).alias("less"))

    def draw(r):
        import numpy as np

        if not r.n:
            return 0.0, np.zeros(rounds)
        k = np.random.default_rng([seed, r.n, r.more, r.less]).multinomial(r.n, [r.more / r.n, r.less / r.n, max(0.0, 1 - (r.more + r.less) / r.n)], rounds)
        return (r.more - r.less) / r.n, (k[:, 0] - k[:, 1]) / r.n

    return drawn_per_group(sums, groups or [], draw, rounds)


def ratio_bootstrap(df: DataFrame, numerator: str, denominator: str, groups: list[str] | None = None, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """The ratio of two sums and its percentile interval, where rows are drawn with replacement.

    Each row counts a Poisson number of times in each round, drawn where the row is; what is shuffled are the rounds' two
    sums, as arrays, one for each task and group.
    """
    gs = groups or []
    own = df.select(*gs, F.col(numerator).cast("double").alias("a"), F.col(denominator).cast("double").alias("b")).where("a is not null and b is not null")
    types = dict(own.dtypes)

    def run(it):
        import numpy as np
        from pyspark import TaskContext

        draw, sums = np.random.default_rng([seed, TaskContext.get().partitionId()]), {}
        for pdf in it:
            for key, part in pdf.groupby(gs, dropna=False) if gs else [((), pdf)]:
                own = sums.setdefault(tuple(key) if gs else (), [0, 0.0, 0.0, np.zeros(rounds), np.zeros(rounds)])
                v = part[["a", "b"]].to_numpy()
                own[0], own[1], own[2] = own[0] + len(v), own[1] + v[:, 0].sum(), own[2] + v[:, 1].sum()
                for at in range(0, len(v), 1000):
                    w = draw.poisson(1.0, (rounds, len(v[at : at + 1000])))
                    own[3] += w @ v[at : at + 1000, 0]
                    own[4] += w @ v[at : at + 1000, 1]
        yield pd.DataFrame([[*k, n, a, b, x.tolist(), y.tolist()] for k, (n, a, b, x, y) in sums.items()], columns=[*gs, "n", "a", "b", "x", "y"])

    parts = own.mapInPandas(run, ", ".join([*(f"`{g}` {types[g]}" for g in gs), "n bigint, a double, b double, x array<double>, y array<double>"]))
    rounds_of = parts.select(*gs, F.posexplode(F.arrays_zip("x", "y")).alias("round", "xy")).groupBy(*gs, "round").agg((F.sum("xy.x") / F.sum("xy.y")).alias("drawn"))
    drawn = rounds_of.groupBy(*gs).agg(F.array_sort(F.collect_list("drawn")).alias("drawn"))  # `rounds` numbers for each group
    whole = parts.groupBy(*gs).agg(F.sum("n").alias("n"), (F.sum("a") / F.sum("b")).alias("value"))
    both = whole.join(drawn, gs) if gs else whole.join(drawn)
    return both.select(*gs, "n", "value", F.col("drawn")[int(0.025 * rounds)].alias("low"), F.col("drawn")[int(0.975 * rounds)].alias("high"))


def significant(p: Column, low: Column, high: Column) -> Column:
    return (p < 0.05) & ((low > 0) | (high < 0))


def bits(nll: Column, tokens: Column, size: Column) -> dict[str, Column]:
    """Bits per token, bits per byte, perplexity of summed negative log-likelihoods in nats."""
    return {"bits_per_token": nll / tokens / math.log(2), "bits_per_byte": nll / math.log(2) / size, "perplexity": F.exp(nll / tokens)}


def weighted_nll(windows: DataFrame, keys: list[str], nll: str, targets: str, size: Column) -> DataFrame:
    """targets, nll and its bits per token, per byte and perplexity of each key's windows: a window's mean nll in nats counts
    by its new targets, as each target belongs to the first window that has it. size: bytes of a window's segment, equal
    in all its rows."""
    own = windows.groupBy(*keys).agg(F.sum(targets).cast("long").alias("targets"), F.sum(F.col(nll) * F.col(targets)).alias("nll"), F.max(size).alias("bytes"))
    return own.select(*keys, "targets", F.round(F.col("nll") / F.col("targets"), 6).alias("mean_nll"), *[F.round(c, 6).alias(k) for k, c in bits(F.col("nll"), F.col("targets"), F.col("bytes")).items()])


def latest(df: DataFrame, keys: list[str], date: str, *tie: str) -> DataFrame:
    """The newest row of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(date), *[F.desc(t) for t in tie]))
    return df.withColumn("rank", rank).where("rank = 1").drop("rank")


def window_targets(n: Column, width: int = 2048, stride: int = 1024) -> Column:
    """Windows over n tokens as (begin, end, new targets): each target counts in the first window that has it."""
    begins = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))
    end = lambda b: F.least(b + width, n)
    seen = lambda b: F.when(b == 0, F.lit(0)).otherwise(F.least(b - stride + width, n))
    rows = F.transform(begins, lambda b: F.struct(b.alias("begin"), end(b).alias("end"), (end(b) - seen(b)).alias("targets")))
    return F.filter(rows, lambda x: x["targets"] > 0)


def training_summary(log: DataFrame) -> DataFrame:
    """Totals of skipped and failed iterations, the largest gradient and where, the last loss and its perplexity."""
    last = F.max_by("loss", "iteration")
    return log.agg(
        F.count("*").alias("logged"), F.sum("skipped").alias("skipped"), F.sum("failed").alias("failed"), F.max(F.nanvl("grad_norm", F.lit(None).cast("double"))).alias("max_grad"),
        F.max_by("iteration", F.nanvl("grad_norm", F.lit(None).cast("double"))).alias("max_grad_at"), last.alias("last_loss"), F.round(F.pow(F.lit(2.718281828), last), 6).alias("perplexity"),
    )


def merged_results(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All keys of both tables; where both have a value the newer table's stands."""
    cols = [c for c in old.columns if c != key]
    theirs = new.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return old.join(theirs, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def delta_to(ours: DataFrame, published: DataFrame, key: str, value: str) -> DataFrame:
    """Our value less the published one, for keys in both."""
    return ours.join(F.broadcast(published.select(key, F.col(value).alias("published"))), key).withColumn("delta", F.round(F.col(value) - F.col("published"), 6))
