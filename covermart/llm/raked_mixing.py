"""Mixing sources to target weights by raking.

Documents are summed into cells, one for each combination of the margins (source, language,
topic); everything but the last step works on cells. Iterative proportional fitting scales the
cells' token weights to the target shares of each margin in turn, until every share is within
`TOLERANCE` of its target. Targets that no weights can meet together, as those of sources of one
language each, leave a gap, which is reported. From the fitted weights and
the tokens at hand follows one sampling probability per cell, calibrated so that the expected
tokens meet the budget although no probability exceeds 1. A hash of the id draws documents.
All steps are DataFrame operations.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covermart.llm import common
from covermart.llm.common import Scratch

#: Target share of a margin's value: its share of the tokens to this power, normalised.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Tokens to sample, as a share of all tokens.
BUDGET = 0.5
#: Rounds at least. The gaps are looked at then, and every so many rounds after.
ROUNDS = 10
#: Raking ends when no share is off its target by more than this part of the target,
TOLERANCE = 1e-4
#: or when the largest gap changes by less than this part of itself at two looks in a row,
STILL = 1e-4
#: or after so many rounds.
MOST_ROUNDS = 2_500
#: Rounds of one plan.
_CUT = 5
#: Up to so many cells are raked by one task; more are dealt out by margin.
TOGETHER = 100_000
_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def topic(text: Column) -> Column:
    """A coarse kind of text: symbols (over 5 % of the characters), short, medium or long."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text)
    symbols = chars - F.char_length(F.translate(text, _SYMBOLS, ""))
    return (
        F.when(symbols * 20 > chars, F.lit("symbols"))
        .when(chars < 1000, F.lit("short"))
        .when(chars < 5000, F.lit("medium"))
        .otherwise(F.lit("long"))
    )


def default_margins() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}


def mix(
    spark: SparkSession,
    docs: DataFrame,
    margins: dict[str, Column] | None = None,
    powers: dict[str, float] | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    seed: int = 0,
    tokens: Column | None = None,
    id_column: str = "doc_id",
) -> tuple[DataFrame, str]:
    """The rows of `docs` with one struct column more, and that column's name.

    The struct holds the margins, tokens, weight (the cell's fitted share of the mixture),
    probability, kept and gap: how far the worst share of any margin stays off its target, as a part
    of the target, the same in all rows. A gap over `TOLERANCE` is also given as a warning.
    `rounds` are raked at least. `targets` gives shares of a margin's values outright (values not named
    get none); other margins follow their power in `powers`, 0.7 if not named. NULL margins are
    the empty value, NULL texts have no tokens. Rows with equal ids share their draw, rows
    without id draw as the empty id. If targets leave fewer tokens than the budget, all of
    those are kept. All columns of `docs` stay as they are; an empty table stays empty.
    """
    margins = margins or default_margins()
    powers, targets = powers or POWERS, targets or {}
    tokens = n_words(F.col("text")) if tokens is None else tokens
    scratch = Scratch(spark, "mixing")
    names = [f"m{i}" for i in range(len(margins))]
    keys = [
        F.coalesce(column.cast("string"), F.lit("")).alias(name)
        for name, column in zip(names, margins.values(), strict=True)
    ]
    cells = scratch.cut(
        "cells", docs.select(*keys, tokens.alias("t")).groupBy(*names).agg(F.sum("t").alias("t"))
    )
    total, n_cells = cells.agg(F.sum("t"), F.count(F.lit(1))).first()
    total = total or 0
    for name, margin in zip(names, margins, strict=True):
        cells = cells.join(_shares(cells, name, targets.get(margin), powers.get(margin, 0.7)), name)
    cells = scratch.cut("shares", cells.withColumn("w", F.col("t") / F.lit(float(max(total, 1)))))
    cells, gap = _raked(scratch, cells, names, list(margins), rounds, n_cells)
    rate = _calibrated(cells, budget * total)
    cells = cells.select(
        *names,
        F.col("w"),
        F.when(F.col("w") <= 0, F.lit(0.0))
        .when(F.lit(rate) * F.col("w") >= F.col("t"), F.lit(1.0))
        .otherwise(F.lit(rate) * F.col("w") / F.col("t"))
        .alias("p"),
    )
    name = "mix"
    while name in docs.columns:
        name += "_"
    own = F.struct(*keys, tokens.alias("tokens")).alias(name)
    drawn = _draw(F.col(common.plain(id_column)), seed)
    rows = docs.select("*", own, drawn.alias(f"{name}_u"))
    of_cell = cells.select(*(F.col(n).alias(f"{name}_{n}") for n in names), F.struct("w", "p").alias(f"{name}_c"))
    same = None
    for n in names:
        term = F.col(f"{name}.{n}") == F.col(f"{name}_{n}")
        same = term if same is None else same & term
    fitted = F.struct(
        *(F.col(f"{name}.{n}").alias(margin) for n, margin in zip(names, margins, strict=True)),
        F.col(f"{name}.tokens").alias("tokens"),
        F.col(f"{name}_c.w").alias("weight"),
        F.col(f"{name}_c.p").alias("probability"),
        (F.col(f"{name}_u") < F.col(f"{name}_c.p")).alias("kept"),
        F.lit(gap).alias("gap"),
    )
    joined = rows.join(of_cell, same)
    return joined.select(*(F.col(common.plain(c)) for c in docs.columns), fitted.alias(name)), name


def _raked(
    scratch: Scratch, cells: DataFrame, names: list[str], margins: list[str], rounds: int, n_cells: int
) -> tuple[DataFrame, float]:
    """The cells with fitted weights, and the largest gap that is left."""
    done, look, still, before = 0, rounds, 0, None
    while True:
        while done < look:
            if n_cells <= TOGETHER:  # one task fits them all without a shuffle per margin
                cells = cells.coalesce(1)
            for _ in range(min(_CUT, look - done)):
                for name in names:
                    held = F.sum("w").over(Window.partitionBy(name))
                    fitted = F.col("w") * F.col(f"g_{name}") / held
                    cells = cells.withColumn("w", F.when(held > 0, fitted).otherwise(F.lit(0.0)))
                done += 1
            cells = scratch.cut(f"after-{done}", cells)
        gaps = _gaps(cells.coalesce(1) if n_cells <= TOGETHER else cells, names)
        gap = max(gaps)
        if gap <= TOLERANCE:
            return cells, gap
        still = still + 1 if before is not None and abs(gap - before) <= STILL * before else 0
        if still == 2 or done >= MOST_ROUNDS:
            told = ", ".join(f"{m} {g:.3g}" for m, g in zip(margins, gaps, strict=True))
            warnings.warn(f"targets not met after {done} rounds; largest relative gaps: {told}", stacklevel=3)
            return cells, gap
        before, look = gap, min(done + ROUNDS, MOST_ROUNDS)


def _gaps(cells: DataFrame, names: list[str]) -> list[float]:
    """By margin, the largest distance of a share from its target, as a part of the target."""
    held = {n: F.sum("w").over(Window.partitionBy(n)) for n in names}
    off = [
        F.when(F.col(f"g_{n}") > 0, F.abs(held[n] / F.col(f"g_{n}") - 1)).alias(f"o_{n}") for n in names
    ]
    worst = cells.select(*off).agg(*(F.max(f"o_{n}") for n in names)).first()
    return [x or 0.0 for x in worst]


def _shares(
    cells: DataFrame, name: str, given: dict[str, float] | None, power: float
) -> DataFrame:
    """(value, target share) of one margin; shares of values at hand add up to 1."""
    values = cells.groupBy(name).agg(F.sum("t").alias("t"))
    if given is None:
        goal = F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(power))).otherwise(0.0)
    else:
        goal = F.lit(0.0)
        for value, share in given.items():
            goal = F.when(F.col(name) == value, F.lit(float(share))).otherwise(goal)
        goal = F.when(F.col("t") > 0, goal).otherwise(F.lit(0.0))
    values = values.select(name, goal.alias("goal"))
    whole = values.agg(F.sum("goal")).first()[0] or 1.0
    return values.select(name, (F.col("goal") / F.lit(whole)).alias(f"g_{name}"))


def _calibrated(cells: DataFrame, wanted: float) -> float:
    """The factor r with sum(min(tokens, r * weight)) = wanted, over the cells with weight."""
    rate = wanted
    full_before = -1
    while True:
        full = (F.lit(rate) * F.col("w") >= F.col("t")) & (F.col("w") > 0)
        n_full, taken, open_ = cells.agg(
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, F.col("t"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)),
        ).first()
        if n_full == full_before or open_ <= 0 or wanted <= taken:
            return rate
        full_before, rate = n_full, (wanted - taken) / open_


def _draw(identity: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mixing_sql(rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """DuckDB SQL for the rows of the query with the default margins and powers."""
    steps, last = [], "cells0"
    for at in range(rounds):
        for margin in POWERS:
            new = f"w{at}_{margin}"
            steps.append(
                f"{new} AS MATERIALIZED (SELECT source, lang, topic, t, g_source, g_lang, g_topic, "
                f"w * g_{margin} / sum(w) OVER (PARTITION BY {margin}) AS w FROM {last})"
            )
            last = new
    goals = ",\n".join(
        f"goal_{m} AS MATERIALIZED (SELECT {m}, pow(sum(t)::DOUBLE, {p}) AS goal FROM cells GROUP BY {m})"
        for m, p in POWERS.items()
    )
    shares = ", ".join(
        f"(SELECT goal FROM goal_{m} x WHERE x.{m} = cells.{m}) / (SELECT sum(goal) FROM goal_{m}) AS g_{m}"
        for m in POWERS
    )
    return rf"""
WITH rows AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE WHEN (length(x) - length(translate(x, '{_SYMBOLS}', ''))) * 20 > length(x) THEN 'symbols'
              WHEN length(x) < 1000 THEN 'short' WHEN length(x) < 5000 THEN 'medium' ELSE 'long' END AS topic,
         len(regexp_extract_all(x, '{_WORD}')) AS tokens,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 16.0 ** 13 AS u
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS x FROM documents)
), cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(tokens) AS t FROM rows GROUP BY ALL
),
{goals},
cells0 AS MATERIALIZED (
  SELECT source, lang, topic, t, {shares}, t / (SELECT sum(t) FROM cells) AS w FROM cells
),
{", ".join(steps)},
ranked AS MATERIALIZED (
  SELECT *, coalesce(sum(t) OVER b, 0) AS taken, sum(w) OVER a AS open_
  FROM {last} WINDOW b AS (ORDER BY t / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     a AS (ORDER BY t / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), rate AS (
  SELECT arg_min(x, t / w) FILTER (WHERE x * w < t) AS r
  FROM (SELECT *, ({budget} * (SELECT sum(t) FROM cells) - taken) / open_ AS x FROM ranked)
)
SELECT doc_id, source, lang, topic, tokens, round(w, 9) AS weight,
       round(least(1.0, r * w / t), 9) AS probability, u < least(1.0, r * w / t) AS kept
FROM rows JOIN {last} USING (source, lang, topic), rate
"""
