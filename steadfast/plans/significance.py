"""Paired significance of the drop from the clean to the most severe rewrite."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from steadfast import lexicons as L
from steadfast.operators import paired as P
from steadfast.operators.resample import paired_bootstrap, permutation_test
from steadfast.plans.degradation import restrict


def paired_tests(positives: DataFrame, ids: DataFrame, cell: Sequence[str] = ("condition", "model")) -> DataFrame:
    return P.mcnemar_test(P.paired_outcomes(restrict(positives, ids), cell), cell)


def significance_table(
    positives: DataFrame, ids: DataFrame, cell: Sequence[str] = ("condition", "model"),
    n_boot: int = L.N_BOOTSTRAP, n_perm: int = L.N_PERMUTATIONS, seed=L.SEED,
) -> DataFrame:
    outcomes = P.paired_outcomes(restrict(positives, ids), cell)
    tests = P.mcnemar_test(outcomes, cell)
    drops = paired_bootstrap(outcomes, cell, n=n_boot, seed=seed)
    perms = permutation_test(outcomes, cell, n=n_perm, seed=seed + 1)
    joined = tests.join(drops, list(cell)).join(perms, list(cell))
    return joined.select(
        *cell, "n", "det_sev0", "det_sev1", "effect_drop", "drop_lo", "drop_hi",
        "mcnemar_b_lost", "mcnemar_c_gained", "perm_p_value", "mcnemar_exact_p",
    )
