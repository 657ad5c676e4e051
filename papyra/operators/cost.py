"""Costs of model calls, in dollars per million tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published prices (in, out) and the calibration of one real run.
PRICES = (
    ("mistral-large-latest", 0.50, 1.50),
    ("mistral-medium-latest", 1.50, 7.50),
    ("mistral-small-latest", 0.15, 0.60),
    ("ministral-8b-latest", 0.15, 0.15),
    ("ministral-3b-latest", 0.10, 0.10),
)
HIT_RATE, CACHED_PRICE = 0.554, 0.1
TYPICAL_OUTPUT = 31
CACHED_SHARE = (1 - HIT_RATE) + HIT_RATE * CACHED_PRICE


def call_cost(tokens: Column, prompt: int = 137, labels: int = 8775 + 50, pin: float = 0.5, pout: float = 1.5, output: tuple[int, int, int] = (12, TYPICAL_OUTPUT, 48)) -> dict[str, Column]:
    """The 14 measures of one call: parts, and totals with and without cache for the least, typical and most output.

    Only the fixed part is ever cached.
    """
    per = lambda n, price: F.lit(n) / F.lit(1e6) * F.lit(price)
    m = {"prompt_nc": per(prompt, pin), "list_nc": per(labels, pin), "article": tokens / F.lit(1e6) * F.lit(pin)}
    m |= {"prompt_c": m["prompt_nc"] * CACHED_SHARE, "list_c": m["list_nc"] * CACHED_SHARE}
    for name, n in zip(("out_min", "out_typ", "out_max"), output):
        m[name] = per(n, pout)
    for kind in ("nc", "c"):
        fixed = m[f"prompt_{kind}"] + m[f"list_{kind}"] + m["article"]
        for suffix, name in (("_min", "out_min"), ("", "out_typ"), ("_max", "out_max")):
            m[f"total_{kind}{suffix}"] = fixed + m[name]
    return m


def scenario(name: str, calls: Column, fixed: int, reads: int, outputs: int, n: str = "n", tokens: str = "a", pin: float = 0.5, pout: float = 1.5) -> Column:
    """One scenario's calls and least and most cost, as a struct."""
    base = (calls * fixed + reads * F.col(tokens)) / F.lit(1e6) * pin
    least, most = (F.round(base + F.col(n) * (outputs * k) / F.lit(1e6) * pout, 6) for k in (12, 48))
    return F.struct(F.lit(name).alias("scenario"), calls.cast("long").alias("n_calls"), least.alias("cost_min"), most.alias("cost_max"))
