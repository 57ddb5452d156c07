"""Expressions on array columns: one array per row, ordered by timepoint or position."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _d(x: float) -> Column:
    return F.lit(float(x))


def let(c: Column, body) -> Column:
    """Evaluate ``c`` once and hand it to ``body``; inside a lambda it would run per element."""
    return F.element_at(F.transform(F.array(c), body), 1)


def vsum(a: Column) -> Column:
    return F.aggregate(a, _d(0), lambda s, x: s + F.coalesce(x, _d(0)))


def vcount(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x.isNotNull()))


def vmean(a: Column) -> Column:
    """Mean over the non-null elements; null when there is none."""
    return vsum(a) / F.nullif(vcount(a), F.lit(0))


def vsd(a: Column, ddof: int = 0) -> Column:
    n = vcount(a) - ddof
    ss = let(vmean(a), lambda m: F.aggregate(a, _d(0), lambda s, x: s + F.coalesce((x - m) * (x - m), _d(0))))
    return F.sqrt(ss / F.when(n > 0, n))


def vcenter(a: Column) -> Column:
    return let(vmean(a), lambda m: F.transform(a, lambda x: x - m))


def vzscore(a: Column, ddof: int = 0) -> Column:
    """(x - mean) / sd; nulls for a constant vector."""
    stats = F.struct(vmean(a).alias("m"), F.nullif(vsd(a, ddof), _d(0)).alias("s"))
    return let(stats, lambda z: F.transform(a, lambda x: (x - z["m"]) / z["s"]))


def vbaseline(a: Column) -> Column:
    """Every element minus the first."""
    first = F.element_at(a, 1)
    return F.transform(a, lambda x: x - first)


def vdot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def vpearson(a: Column, b: Column) -> Column:
    """Pearson r of two equally long vectors; null when one is constant."""
    centred = F.struct(vcenter(a).alias("a"), vcenter(b).alias("b"))
    return let(centred, lambda c: vdot(c["a"], c["b"]) / F.nullif(
        F.sqrt(vdot(c["a"], c["a"]) * vdot(c["b"], c["b"])), _d(0)))


def vranks(a: Column) -> Column:
    """Average ranks of the elements, ties sharing the mean rank."""
    return F.transform(a, lambda x: (
        F.size(F.filter(a, lambda y: y < x)) + (F.size(F.filter(a, lambda y: y == x)) + 1) / _d(2)
    ))


def vspearman(a: Column, b: Column) -> Column:
    return vpearson(vranks(a), vranks(b))


def vargmax(a: Column) -> Column:
    """1-based position of the first maximum."""
    return F.array_position(a, F.array_max(a))


def vclip(a: Column, low: Column, high: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(low, F.least(high, x)))


def vminmax(a: Column) -> Column:
    """Scale to 0..1; nulls for a constant vector."""
    ends = F.struct(F.array_min(a).alias("lo"), F.nullif(F.array_max(a) - F.array_min(a), _d(0)).alias("span"))
    return let(ends, lambda z: F.transform(a, lambda x: (x - z["lo"]) / z["span"]))


def vflip_blocks(a: Column, strand: Column, n_bins: int, n_blocks: int) -> Column:
    """Reverse each block of ``n_bins`` elements on ``-`` rows."""
    flipped = F.concat(*[F.reverse(F.slice(a, i * n_bins + 1, n_bins)) for i in range(n_blocks)])
    return F.when(strand == "-", flipped).otherwise(a)


def vlog10_floor(a: Column) -> Column:
    """log10 with everything below 1 (and zero) set to 0."""
    return F.transform(a, lambda x: F.when(x > 1, F.log10(x)).otherwise(_d(0)))


def vframe(a: Column, offset: Column, width: int, pad: float) -> Column:
    """Place a vector in a frame of ``width`` elements, shifted by ``offset``; the rest is ``pad``."""
    positions = F.sequence(F.lit(0), F.lit(width - 1))
    return F.transform(positions, lambda i: F.coalesce(
        F.when((i - offset >= 0) & (i - offset < F.size(a)), F.try_element_at(a, (i - offset + 1).cast("int"))), _d(pad)))


def vflank_normalise(a: Column, n: int = 10) -> Column:
    """Divide by the mean of the first and last ``n`` elements."""
    flank = vmean(F.concat(F.slice(a, 1, n), F.slice(a, -n, n)))
    return let(F.nullif(flank, _d(0)), lambda m: F.transform(a, lambda x: x / m))


def vpick(a: Column, indices: list[int]) -> Column:
    """Elements at the given 0-based indices."""
    return F.array(*[F.try_element_at(a, F.lit(i + 1)) for i in indices])


def vfarthest(a: Column) -> Column:
    """The element farthest from zero, with its sign (the first of equals)."""
    far = F.array_max(F.transform(a, lambda x: F.abs(x)))
    return let(far, lambda m: F.element_at(F.filter(a, lambda x: F.abs(x) == m), 1))


def vsoftmax(a: Column) -> Column:
    e = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(e, lambda v: let(vsum(v), lambda s: F.transform(v, lambda x: x / s)))


def oriented_pair(fwd: Column, rev: Column, half: int) -> tuple[Column, Column, Column]:
    """Mask two strand tracks to the larger score and orient the row, forward hits upstream.

    Returns (forward, reverse, flipped). The track with the larger half decides: a forward
    track heavier downstream, or a reverse track heavier upstream, flips and swaps both.
    """
    f = F.zip_with(fwd, rev, lambda x, y: F.when(x >= y, x).otherwise(_d(0)))
    r = F.zip_with(fwd, rev, lambda x, y: F.when(y >= x, y).otherwise(_d(0)))
    mass = lambda a, start: F.aggregate(F.slice(a, start, half), _d(0), lambda s, x: s + F.greatest(x, _d(0)))
    f_up, f_down = mass(f, 1), mass(f, half + 1)
    r_up, r_down = mass(r, 1), mass(r, half + 1)
    flip = F.when(F.greatest(f_up, f_down) > F.greatest(r_up, r_down), f_up <= f_down).otherwise(r_up > r_down)
    return (F.when(flip, F.reverse(r)).otherwise(f), F.when(flip, F.reverse(f)).otherwise(r), flip)
