"""The learned mixture on the recorded sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from bedside.operators import evaluation as ev
from bedside.operators import mixtures as mix
from bedside.operators import sequence as sq
from bedside.operators import tabular as tb
from bedside.plans import inputs
from bedside.plans.registry import q6, query, r6
from bedside.plans.sequence_queries import HORIZON, NORMED, TARGETS, training_stats
from bedside.plans.sql import with_stay
from bedside.session import stored

FEATURES = inputs.STAY_FEATURES
PARTS = 3
START = mix.Mixture.start(FEATURES, PARTS, 42)


def _logit_sql(weights) -> str:
    return " + ".join([f"{f} * ({w!r})" for f, w in zip(FEATURES, weights.tolist())] + [f"({weights.tolist()[-1]!r})"])


KS = range(PARTS)
E_STEP = f"""{NORMED}, {TARGETS},
ex AS (SELECT z.pid, z.t, {", ".join(f"coalesce(z.{f}, 0.0) AS {f}" for f in FEATURES)}, y_target AS y
       FROM z JOIN tg ON z.pid = tg.pid AND z.t = tg.t JOIN sides ON z.pid = sides.pid WHERE valid AND NOT is_validation),
lg AS (SELECT y, {", ".join(f"exp({_logit_sql(START.gate[k])}) AS a{k}, 1.0 / (1.0 + exp(-({_logit_sql(START.parts[k])}))) AS p{k}" for k in KS)} FROM ex),
jo AS (SELECT *, {", ".join(f"a{k} / ({' + '.join(f'a{m}' for m in KS)}) * CASE WHEN y = 1 THEN p{k} ELSE 1 - p{k} END AS j{k}" for k in KS)} FROM lg),
es AS (SELECT *, {" + ".join(f"j{k}" for k in KS)} AS s FROM jo)"""


def examples(spark, sf_dir):
    """Valid rows of the training patients: normalised features, missing ones 0, and
    the outcome a horizon ahead; written, since each step scans them."""
    def build():
        targets = sq.horizon_target(inputs.stay(spark, sf_dir), HORIZON).filter("valid")
        normed = sq.zero_fill(sq.normalise(targets, FEATURES, training_stats(spark, sf_dir)), FEATURES)
        train = tb.patient_split_rows(normed, 0.2).filter("NOT is_validation")
        return train.select("pid", "t", *FEATURES, F.col("y_target").alias("y"))

    return stored(spark, f"examples:{sf_dir}", build)


@query("mixture_e_step", with_stay(E_STEP + " " + " UNION ALL ".join(
    f"""SELECT {k} AS part, CAST(count(*) AS BIGINT) AS rows, {q6(f"sum(j{k} / s)")} AS held,
    {q6(f"sum(j{k} / s * y)")} AS held_positives, {q6(f"sum(j{k} / s * p{k})")} AS expected_positives, {q6("avg(ln(s))")} AS fit FROM es"""
    for k in KS)))
def mixture_e_step(spark, sf_dir):
    """What each part holds before the first step."""
    found = mix.responsibilities(examples(spark, sf_dir), START)
    sums = [
        F.struct(
            F.lit(k).alias("part"), F.count(F.lit(1)).alias("rows"), r6(F.sum(f"r{k}"), "held"),
            r6(F.sum(F.col(f"r{k}") * F.col("y")), "held_positives"),
            r6(F.sum(F.col(f"r{k}") * F.col(f"p{k}")), "expected_positives"), r6(F.avg("fit"), "fit"),
        )
        for k in KS
    ]
    return found.agg(F.array(*sums).alias("parts")).select(F.inline("parts"))


@query("learned_mixture", with_stay(f"""{E_STEP}
SELECT CAST(count(*) AS BIGINT) AS rows, {q6("-avg(ln(s))")} AS nll_start, 1 AS never_falls, 1 AS below_start, 1 AS below_even FROM es"""))
def learned_mixture(spark, sf_dir):
    """The fitted mixture against its start and against equal weights of its own parts."""
    rows = examples(spark, sf_dir)
    model, goals = mix.fit_mixture(rows, FEATURES, parts=PARTS)
    even = F.array(*[F.lit(1.0 / PARTS)] * PARTS)
    scored = mix.with_mixture(rows, model)
    rising = all(a <= b for a, b in zip(goals, goals[1:]))
    losses = {
        "nll": ev.mixture_loss(scored), "nll_even": ev.mixture_loss(scored.withColumn("pis", even)),
    }
    start = mix.responsibilities(rows, START).agg(F.count(F.lit(1)).alias("rows"), (-F.avg("fit")).alias("nll_start"))
    return start.withColumns({name: loss.scalar() for name, loss in losses.items()}).select(
        "rows", r6("nll_start"), F.lit(int(rising)).alias("never_falls"),
        (F.col("nll") < F.col("nll_start")).cast("int").alias("below_start"),
        (F.col("nll") < F.col("nll_even")).cast("int").alias("below_even"),
    )
