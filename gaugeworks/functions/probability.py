"""Column expressions over probability vectors: softmax, confidence, losses.

Expressions that use a reduction of an array inside a lambda bind it first (``let``), so it is computed once and not for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-9
#: Lower edges of ten equal calibration bins as doubles; 0.3, 0.6 and 0.7 belong to the bin below, the last bin is closed.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    powers = let(F.array_max(logits), lambda m: F.transform(logits, lambda x: F.exp((x - m) / t)))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def logits_of(p: Column, logits: Column | None = None) -> Column:
    """Stored logits, or the logarithms of floored probabilities."""
    own = F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(FLOOR))))
    return own if logits is None else F.coalesce(logits, own)


def at_temperature(p: Column, logits: Column | None, temperature: Column | float) -> Column:
    """p as it is at temperature 1, else the softmax of the tempered logits."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return F.when(t == 1.0, p).otherwise(softmax(logits_of(p, logits), t))


def nll_at(p: Column, label: Column, logits: Column | None, temperature: Column | float) -> Column:
    """Negative log likelihood of label: from the logits where there are any, else from the floored probability (tempered as its logarithm)."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    z = logits_of(p, logits)
    of_logits = let(F.array_max(z), lambda m: F.ln(total(F.transform(z, lambda x: F.exp((x - m) / t)))) - (F.get(z, label) - m) / t)
    plain = -F.ln(F.greatest(F.get(p, label), F.lit(FLOOR)))
    return F.when(logits.isNotNull(), of_logits).when(t == 1.0, plain).otherwise(of_logits) if logits is not None else F.when(t == 1.0, plain).otherwise(of_logits)


def confidence(p: Column) -> Column:
    return F.array_max(p)


def first_argmax(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def brier(p: Column, label: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, k: F.when(k == label, (x - 1) * (x - 1)).otherwise(x * x)), F.lit(0.0), lambda a, x: a + x)


def calibration_bin(conf: Column) -> Column:
    """0 to 9 by EDGES."""
    out = F.lit(0)
    for k, edge in enumerate(EDGES[1:], 1):
        out = F.when(conf >= edge, F.lit(k)).otherwise(out)
    return out


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, k: x * k))


def level_error(p: Column, label: Column) -> Column:
    """Absolute error of the expected level of an ordered question."""
    return F.abs(expected_level(p) - label)


def ranked_score(p: Column, label: Column) -> Column:
    """Ranked probability score: mean squared gap of the cumulative distributions."""
    cumulative = F.transform(p, lambda _, k: total(F.slice(p, F.lit(1), k + 1)))
    gaps = F.transform(cumulative, lambda c, k: F.pow(c - F.when(label <= k, 1.0).otherwise(0.0), F.lit(2)))
    return total(F.slice(gaps, F.lit(1), F.size(p) - 1)) / F.greatest(F.size(p) - 1, F.lit(1))


def choice_confidence(p: Column) -> Column:
    """(greatest - 1/K) / (1 - 1/K) of the normalised vector; 1 for a single option, 0 for no mass."""
    k = F.size(p)
    norm = let(total(p), lambda s: F.when(s > 0, F.array_max(p) / s).otherwise(1.0 / k))
    return F.when(k <= 1, F.lit(1.0)).otherwise((norm - 1.0 / k) / (1.0 - 1.0 / k))


def score_confidence(p: Column) -> Column:
    """1 less the expected distance from the most likely level over its mean for a uniform vector, not below 0."""
    k = F.size(p)
    levels = F.sequence(F.lit(0), k - 1)
    far = total(F.transform(levels, lambda x: F.abs(x - (k - 1) / 2.0))) / k
    mode = first_argmax(p)
    spread = lambda m: let(total(p), lambda s: total(F.zip_with(p, levels, lambda w, x: w / s * F.abs(x - m))))
    of = lambda m: spread(m) / far
    return F.when(k <= 1, F.lit(1.0)).when(total(p) <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - let(mode, of)))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def margin(p: Column) -> Column:
    """The greatest less the second greatest."""
    return let(F.sort_array(p, asc=False), lambda s: F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0)))


def valid_distribution(p: Column) -> Column:
    """All finite and in 0..1, a sum above 0 and within max(1e-5, 0.005 K + 1e-8) of 1."""
    inside = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    s = total(p)
    return inside & (s > 0) & (F.abs(s - 1) <= F.greatest(F.lit(1e-5), 0.005 * F.size(p) + 1e-8))
