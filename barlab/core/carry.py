"""Sequential recurrences over long series, evaluated block-parallel.

``carry_scan`` runs a state machine over each key's rows in order. Every block first runs from the initial
state; a block is then re-run while the end state of its predecessor differs from the start state it used.
State machines that forget their past settle in these ``guesses`` rounds. One that does not goes on with the first unsettled
block of each key, whose start state is final: so B blocks never run more than guesses + 2 times B, and the
outputs once more. Only the small state table is passed between rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.session import cut

Step = Callable[[pd.DataFrame, list[float]], tuple[pd.DataFrame, list[float]]]


def carry_scan(df: DataFrame, key: Sequence[str], block: str, order: Sequence[str], step: Step,
               initial: list[float], schema: str, guesses: int = 2) -> DataFrame:
    """Apply ``step(rows_of_one_block_in_order, state) -> (output_rows, end_state)`` along each key.

    ``schema`` is the DDL of the output rows; state is a fixed-length list of doubles.
    """
    key, order, initial = list(key), list(order), [float(x) for x in initial]
    groups = [*key, block]
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*groups).schema)

    def end_states(pdf: pd.DataFrame) -> pd.DataFrame:
        start = list(pdf["_start"].iloc[0])
        _, end = step(pdf.sort_values(order, ignore_index=True), list(start))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in groups}, "_start": [start], "_end": [list(end)]})

    def outputs(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values(order, ignore_index=True), list(pdf["_start"].iloc[0]))[0]

    start_lit = F.array(*[F.lit(x) for x in initial])
    blocks_per_key = df.select(*groups).distinct().groupBy(*key).count()
    most = blocks_per_key.agg(F.max("count")).first()[0]
    if most in (None, 1):
        return df.withColumn("_start", start_lit).groupBy(*groups).applyInPandas(outputs, schema)

    state_ddl = f"{key_ddl}, _start array<double>, _end array<double>"
    states = cut(df.withColumn("_start", start_lit).groupBy(*groups).applyInPandas(end_states, state_ddl))
    by_key = Window.partitionBy(*key).orderBy(block)
    plain = lambda c: F.transform(c, lambda x: F.when(~F.isnan(x), x)).cast("string")  # NaN and NULL are one state
    stale = ~(plain("_want") == plain("_start"))
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    for n in range(most + guesses + 1):  # each round settles at least one more block per key
        wanted = states.withColumn("_want", F.coalesce(F.lag("_end").over(by_key), start_lit)).withColumn("_redo", stale)
        if n >= guesses:
            wanted = wanted.withColumn("_redo", F.col("_redo") & ~F.coalesce(F.max("_redo").over(before), F.lit(False)))
        wanted = cut(wanted)
        stale_now = wanted.filter("_redo")
        if stale_now.isEmpty():
            break
        redo = df.join(stale_now.select(*groups, F.col("_want").alias("_start")), groups)
        fixed = redo.groupBy(*groups).applyInPandas(end_states, state_ddl)
        states = cut(wanted.filter("NOT _redo").drop("_want", "_redo").unionByName(fixed))
    else:
        raise RuntimeError("carry_scan did not settle; the step function is not deterministic")
    final = df.join(states.select(*groups, "_start"), groups)
    return final.groupBy(*groups).applyInPandas(outputs, schema)
