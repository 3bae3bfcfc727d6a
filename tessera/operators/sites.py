"""Distances between sites of periodic cells: minimum images, and tests of structures by them."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

_IMAGES = list(itertools.product((-1.0, 0.0, 1.0), repeat=3))


def site_distance(a: Column, b: Column, lattice: Column) -> Column:
    """The least distance between two sites (arrays of three fractions) over their periodic images.

    lattice holds three vectors. The difference is brought within half a cell in each direction, and the images one cell away
    are compared, which is enough for cells that aren't much skewed.
    """
    near = F.zip_with(a, b, lambda x, y: x - y - F.round(x - y))
    images = F.array(*[F.array(*[F.lit(s) for s in shift]) for shift in _IMAGES])

    def long(shift: Column) -> Column:
        f = F.zip_with(near, shift, lambda d, s: d + s)
        parts = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.aggregate(F.zip_with(f, lattice, lambda d, v: d * F.get(v, i)), F.lit(0.0), lambda t, x: t + x))
        return F.aggregate(parts, F.lit(0.0), lambda t, x: t + x * x)

    return F.sqrt(F.array_min(F.transform(images, long)))


def pair_distances(sites: Column, lattice: Column) -> Column:
    """Array of (i, j, distance) for each pair i < j of sites."""
    indexed = F.transform(sites, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    pair = lambda a, b: F.struct(a["i"].alias("i"), b["i"].alias("j"), site_distance(a["s"], b["s"], lattice).alias("distance"))
    return F.flatten(F.transform(indexed, lambda a: F.transform(F.filter(indexed, lambda b: b["i"] > a["i"]), lambda b: pair(a, b))))


def min_site_distance(sites: Column, lattice: Column) -> Column:
    """The least distance of two sites; 0 if two coincide, null with fewer than two."""
    return F.array_min(F.transform(pair_distances(sites, lattice), lambda p: p["distance"]))


def sites_apart(sites: Column, lattice: Column, cutoff: float) -> Column:
    """Whether all sites are at least cutoff apart; true with fewer than two."""
    return F.coalesce(min_site_distance(sites, lattice) >= cutoff, sites.isNull() | (F.size(sites) < 2))


def kinds_apart(sites: Column, kinds: Column, lattice: Column, cutoffs: dict[tuple[str, str], float]) -> Column:
    """Whether every two sites are as far apart as their kinds ask for; pairs of kinds that aren't given ask for nothing."""
    table = F.create_map(*[F.lit(x) for (a, b), d in cutoffs.items() for p, q in {(a, b), (b, a)} for x in (f"{p}\n{q}", float(d))])
    asked = lambda p: F.coalesce(F.try_element_at(table, F.concat(F.get(kinds, p["i"]), F.lit("\n"), F.get(kinds, p["j"]))), F.lit(0.0))
    return F.forall(pair_distances(sites, lattice), lambda p: p["distance"] >= asked(p))


def touching_radii(radii: dict[str, float], packing: float = 1.0) -> dict[tuple[str, str], float]:
    """Cutoffs of kinds whose spheres of given radii may come as close as packing times their sum."""
    names = sorted(radii)
    return {(a, b): packing * (radii[a] + radii[b]) for i, a in enumerate(names) for b in names[i:]}


def sphere_volume(counts: Column, radii: dict[str, float], packing: float = 0.5) -> Column:
    """The volume of a map of kinds to counts, as spheres of given radii that fill a share of it; null with an unknown kind."""
    volume = F.create_map(*[F.lit(x) for k, r in sorted(radii.items()) for x in (k, 4.1887902047863905 * r**3)])
    return F.aggregate(F.transform(F.map_entries(counts), lambda e: e["value"].cast("double") * F.try_element_at(volume, e["key"])), F.lit(0.0), lambda s, x: s + x) / packing
