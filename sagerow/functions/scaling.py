"""Scaling-law and vector column functions (SCA-20/21/23/24)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
SEQ_LEN = 256          # tokens per sequence in the sweep
VAL_FREQ = 1000        # steps between validation points
SELF_COND_EXTRA = 1.0 + 0.33 * 0.25   # extra forward pass on 25% of the data
NORM_EPS = 1e-8
# -----------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def param_count(n_blocks: Column | str, dim: Column | str) -> Column:
    """Non-embedding parameters ``12·n_blocks·dim²`` (SCA-20)."""
    return F.lit(12) * _c(n_blocks).cast("bigint") * _c(dim).cast("bigint") * _c(dim).cast("bigint")


def flops_per_step(
    n_blocks: Column | str, dim: Column | str, batch_size: Column | str, model_type: Column | str, seq_len: int = SEQ_LEN
) -> Column:
    """Training FLOPs per optimiser step (SCA-21); unknown model type is an error."""
    n, d, b, mt = _c(n_blocks).cast("double"), _c(dim).cast("double"), _c(batch_size).cast("double"), _c(model_type)
    base = 6.0 * param_count(n_blocks, dim).cast("double")
    ar = base + n * seq_len * d
    diff = (base + 2.0 * n * seq_len * d) * SELF_COND_EXTRA
    per_token = (
        F.when(mt == "autoregressive", ar)
        .when(mt == "diffusion", diff)
        .otherwise(F.raise_error(F.concat(F.lit("unknown model type: "), F.coalesce(mt, F.lit("NULL")))).cast("double"))
    )
    return per_token * seq_len * b


def l2_normalize(vec: Column | str, eps: float = NORM_EPS) -> Column:
    """``v / (‖v‖₂ + eps)`` on an array column (SCA-23)."""
    v = _c(vec)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / (norm + F.lit(eps)))
