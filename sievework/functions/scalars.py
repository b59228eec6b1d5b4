"""Scalar rules on columns: casts, flags, rounding, series headers and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A number or null, never an error."""
    return c.try_cast("double")


def coded(c: Column) -> Column:
    """The code of cells like '2.1: text'."""
    return F.trim(F.split(c, ":")[0]).try_cast("double")


def split_code(v: Column) -> Column:
    """a.f as a + f, e.g. 2.1 as 3."""
    a = F.floor(v + 1e-9)
    return a + F.rint((v - a) * 10)


def flag(c: Column) -> Column:
    """Yes, no or unknown: 1 for 1/true/yes, 0 for 0/false/no, null for all else."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("1", "1.0", "true", "yes"), 1).when(t.isin("0", "0.0", "false", "no"), 0)


def trusted(shipped: Column, allowed: list[str], derived: Column) -> Column:
    """The given value if it is one of those allowed, else the derived one."""
    return F.when(shipped.isin(*allowed), shipped).otherwise(derived)


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def is_gold(columns: list[str]) -> Column:
    """All labels known."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"`{c}`").isNotNull()
    return out


def confidence(mean: Column, std: Column, floor: float = 0.15) -> Column:
    """Weight of a cell from how far its sources agree and how decided they are; without values, both count as 0.5."""
    mean, std = F.coalesce(mean, F.lit(0.5)), F.coalesce(std, F.lit(0.5))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    w = 0.5 * clip(1 - 2 * std) + 0.5 * clip(2 * F.abs(mean - 0.5))
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), w))


#: Tokens in series names (fixed values).
FAT_SAT_TOKENS = ("fs", "fatsat", "fat_sat", "stir", "spir", "spair", "tirm", "dixon", "chess", "sat", "supp")
FLUID_TOKENS = ("t2", "stir", "pd", "dess", "spair", "spir", "tirm")
GRADIENT_ECHO_TOKENS = ("gre", "dess", "medic", "flash")


def weighting(tr: Column, te: Column, seq: Column, desc: Column, long_te: float = 60.0, short_tr: float = 800.0) -> Column:
    """Contrast class of a series from its times and names: gradient echo by name first, names where times are missing."""
    seq, desc = F.lower(F.coalesce(seq, F.lit(""))), F.lower(F.coalesce(desc, F.lit("")))
    echo = seq.contains("gr")
    for t in GRADIENT_ECHO_TOKENS:
        echo = echo | desc.contains(t)
    by_name = F.when(desc.contains("t1"), "T1").when(desc.contains("t2"), "T2").when(desc.contains("pd"), "PD").otherwise("unknown")
    return F.when(echo, "GRE").when(tr.isNull() | te.isNull(), by_name).when(tr <= short_tr, "T1").when(te >= long_te, "T2").otherwise("PD")


def cross(iop: Column) -> list[Column]:
    """Normal of the plane of a row direction iop[0..2] and a column direction iop[3..5]."""
    a, b = [iop[i] for i in range(3)], [iop[i + 3] for i in range(3)]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def plane(iop: Column) -> Column:
    """Sagittal, coronal or axial by the largest component of the normal, the first of equals; unknown without six numbers."""
    x, y, z = (F.abs(c) for c in cross(iop))
    kind = F.when((x >= y) & (x >= z), "Sagittal").when(y >= z, "Coronal").otherwise("Axial")
    return F.when(F.size(iop) == 6, kind).otherwise("unknown")


def centre_x(ipp: Column, iop: Column, ps: Column, rows: Column, cols: Column) -> Column:
    """x of a slice's centre in mm; null if anything is missing."""
    return ipp[0] + iop[0] * cols / 2 * ps[1] + iop[3] * rows / 2 * ps[0]


def position(ipp: Column, iop: Column, kind: Column) -> Column:
    """Place of a slice along its normal; sagittal slices along x, others with the normal turned to its larger sign."""
    n = cross(iop)
    dot = sum((ipp[i] * n[i] for i in range(3)), F.lit(0.0))
    lead = F.when(kind == "Coronal", n[1]).otherwise(n[2])
    return F.when(kind == "Sagittal", ipp[0]).otherwise(F.when(lead < 0, -dot).otherwise(dot))


def mask(columns: list[str]) -> Column:
    """Presence of each column as a string of 0 and 1."""
    return F.concat(*(F.when(F.col(f"`{c}`").isNotNull(), "1").otherwise("0") for c in columns))


def version(**fields: Column | str) -> Column:
    """A signature of settings: name=value, in the order given."""
    return F.concat_ws("|", *(F.concat(F.lit(k + "="), v.cast("string") if isinstance(v, Column) else F.lit(str(v))) for k, v in fields.items()))


def classified(c: Column, rules: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """The name of the first pattern that matches."""
    out = F
    for pattern, name in rules:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise(otherwise)
