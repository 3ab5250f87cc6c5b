"""Scalar column expressions: sample counts, distribution functions, names and tags."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ms_to_samples(ms: Column | str, rate: Column | float, least: int = 1) -> Column:
    """Half-even rounded number of samples in ``ms`` milliseconds, at least ``least``."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.greatest(F.lit(least), F.bround(ms / 1000.0 * rate).cast("int"))


def t_sf(t: Column, df: Column) -> Column:
    """P(T > t) of Student's t for whole degrees of freedom, by the finite trigonometric series; null if df < 1."""
    angle = F.atan(t / F.sqrt(df))
    c2 = F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    first = F.when(odd, F.cos(angle)).otherwise(1.0)
    top = F.when(odd, F.floor((df - 3) / 2)).otherwise(F.floor((df - 2) / 2)).cast("int")
    steps = F.when(top >= 1, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, j: Column) -> Column:
        ratio = F.when(odd, 2.0 * j / (2.0 * j + 1)).otherwise((2.0 * j - 1) / (2.0 * j))
        term = acc["term"] * ratio * c2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), step, lambda a: a["total"])
    inside = F.when(odd, (angle + F.when(df > 1, F.sin(angle) * series).otherwise(0.0)) * (2 / math.pi)).otherwise(F.sin(angle) * series)
    return F.when(df >= 1, (1 - inside) / 2)


def t_sf_sql(t: str, df: str) -> str:
    """The same as an SQL expression."""
    a = f"atan(({t}) / sqrt({df}))"
    odd = f"CASE WHEN {df} > 1 THEN sin({a}) * list_sum([coalesce(list_product([2.0::DOUBLE * i / (2 * i + 1) FOR i IN range(1, j + 1)]), 1) * pow(cos({a}), 2 * j + 1) FOR j IN range(0, (({df} - 3) // 2 + 1)::BIGINT)]) ELSE 0 END"
    even = f"sin({a}) * list_sum([coalesce(list_product([(2.0::DOUBLE * i - 1) / (2 * i) FOR i IN range(1, j + 1)]), 1) * pow(cos({a}), 2 * j) FOR j IN range(0, (({df} - 2) // 2 + 1)::BIGINT)])"
    return f"CASE WHEN {df} < 1 THEN NULL WHEN {df} % 2 = 1 THEN (1 - 2 / pi() * ({a} + {odd})) / 2 ELSE (1 - {even}) / 2 END"


def t_critical(df: int, alpha: float = 0.05) -> float:
    """The upper ``alpha`` point of Student's t for ``df`` whole degrees of freedom, by bisection on the same series."""
    if df < 1:
        return math.inf

    def tail(t: float) -> float:
        angle, odd = math.atan(t / math.sqrt(df)), df % 2
        c2, term = math.cos(angle) ** 2, math.cos(angle) if odd else 1.0
        total = term
        for j in range(1, (df - 3) // 2 + 1 if odd else (df - 2) // 2 + 1):
            term *= c2 * (2 * j / (2 * j + 1) if odd else (2 * j - 1) / (2 * j))
            total += term
        inside = (angle + (math.sin(angle) * total if df > 1 else 0)) * 2 / math.pi if odd else math.sin(angle) * total
        return (1 - inside) / 2

    lo, hi = 0.0, 1.0
    while tail(hi) > alpha:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > alpha else (lo, mid)
    return hi


def grid(x: Column, bits: int = 20) -> Column:
    """The nearest multiple of 2^-bits, the even one of two. Means of short decimals never lie half way between two, and
    means of binary fractions, which may, are exact in any order of their sums."""
    return F.rint(x * float(1 << bits)) / float(1 << bits) + 0.0


def normal_sf(z: Column) -> Column:
    """P(Z > z) of the standard normal by Zelen and Severo's polynomial (absolute error under 7.5e-8)."""
    k = 1 / (1 + 0.2316419 * F.abs(z))
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def sanitise(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def display_name(key: Column, names: dict[str, str]) -> Column:
    """The mapped name, or the key itself."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(table, key), key)


def number_tag(x: Column) -> Column:
    """A number as short text: no trailing zeros, no point for whole values."""
    text = F.format_string("%.6f", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def run_tag(order: Column, win_ms: Column, rate: Column, normalise: Column) -> Column:
    """Identity text of a connectivity run, as order25_win250ms_fs200_demean."""
    return F.concat_ws("_", F.concat(F.lit("order"), order.cast("string")), F.concat(F.lit("win"), number_tag(win_ms), F.lit("ms")), F.concat(F.lit("fs"), number_tag(rate)), F.when(normalise != "none", normalise))


def classifier_tag(name: Column, c: Column) -> Column:
    """svm_0_01 style text: the regularisation with its point as underscore."""
    return F.concat_ws("_", name, F.replace(number_tag(c), F.lit("."), F.lit("_")))


def set_tag(names: Column, limit: int = 60) -> Column:
    """Sorted lower-case names joined by '-'; beyond ``limit`` characters their number and a short hash."""
    text = F.array_join(F.array_sort(F.transform(names, lambda x: F.lower(x))), "-")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.size(names).cast("string"), F.lit("x"), F.substring(F.sha1(text), 1, 8)))


def subject_from_path(path: Column) -> Column:
    """The file name up to its first underscore."""
    return F.regexp_extract(path, r"([^/_]+)[^/]*$", 1)


def parse_combo(text: Column) -> Column:
    """struct(classifier, sw_dur, tuned) of 'clf:sw[:tuned]'; anything else is an error."""
    p = F.split(text, ":")
    good = F.size(p).isin(2, 3) & F.get(p, F.lit(1)).rlike("^[0-9]+$") & ((F.size(p) == 2) | (F.get(p, F.lit(2)) == "tuned"))
    out = F.struct(F.get(p, F.lit(0)).alias("classifier"), F.get(p, F.lit(1)).cast("int").alias("sw_dur"), (F.size(p) == 3).alias("tuned"))
    return F.when(good, out).otherwise(F.raise_error(F.concat(F.lit("not clf:sw[:tuned]: "), text)).cast("struct<classifier:string,sw_dur:int,tuned:boolean>"))


def default_c(classifier: Column, c: Column) -> Column:
    """``c`` where given, else 0.01 for svm, 0.1 for logistic and 1 for others."""
    return F.coalesce(c, F.when(classifier == "svm", 0.01).when(classifier == "logistic", 0.1).otherwise(1.0))


def md5_order(*parts: Column | str) -> Column:
    """Text whose order is a fixed random permutation of the keys."""
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def md5_sign(*parts: Column | str) -> Column:
    """+1 or -1 by the parity of the first hexadecimal digit of the keys' MD5."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(md5_order(*parts), 1, 1))
    return F.when(digit % 2 == 0, 1.0).otherwise(-1.0)
