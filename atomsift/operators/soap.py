"""SOAP power spectrum with Gaussian-type radial functions, as pair sums in Spark.

For a neighbour at r and a Gaussian of width sigma (eta = 1 / (2 sigma^2)) the
overlap with r^l exp(-alpha r^2) Y_lm has the closed form

    (pi / (alpha + eta))^(3/2) (eta / (alpha + eta))^l
        * exp(-alpha eta / (alpha + eta) r^2) * R_lm(r)

with the real solid harmonic R_lm. The expansion is a plain sum over pairs, so
it is computed for batches of pairs, pre-aggregated there, and summed per atom
after one shuffle of the partial sums. Radial functions are orthonormalised by the inverse square root of
their overlap (Bartok, Kondor, Csanyi 2013; Himanen et al. 2020).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import as_lists, as_matrix
from .neighbors import neighbor_pairs

# Decay that fixes the radial exponents and the margin around the cutoff.
DECAY = 1e-3
# Coefficients held at a time where partial sums meet.
DENSE_VALUES = 8_000_000


@dataclass(frozen=True)
class SoapBasis:
    r_cut: float = 6.0
    n_max: int = 4
    l_max: int = 4
    sigma: float = 1.0

    @property
    def reach(self) -> float:
        """Atoms slightly outside r_cut still leak density into it."""
        return self.r_cut + self.sigma * math.sqrt(-2.0 * math.log(DECAY))

    def exponents(self, l: int) -> np.ndarray:
        a = np.linspace(1.0, self.r_cut, self.n_max)
        return -np.log(DECAY / a**l) / a**2

    def mixing(self, l: int) -> np.ndarray:
        """Inverse square root of the radial overlap matrix."""
        alpha = self.exponents(l)
        overlap = 0.5 * math.gamma(l + 1.5) * (alpha[:, None] + alpha[None, :]) ** -(l + 1.5)
        values, vectors = np.linalg.eigh(overlap)
        return vectors @ np.diag(values**-0.5) @ vectors.T

    @property
    def width(self) -> int:
        return self.n_max * (self.l_max + 1) ** 2


def solid_harmonics(r: np.ndarray, l_max: int) -> list[np.ndarray]:
    """Per l an (n, 2l+1) block of orthonormal real solid harmonics r^l Y_lm.

    Built from the recurrences of r^l P_lm in z and r^2, and of
    Re/Im (x + i y)^m.
    """
    x, y, z = r.T
    r2 = x * x + y * y + z * z
    cos, sin = [np.ones_like(x)], [np.zeros_like(x)]
    for _ in range(l_max):
        cos.append(x * cos[-1] - y * sin[-1])
        sin.append(x * sin[-1] + y * cos[-2])
    p = {}
    for m in range(l_max + 1):
        p[m, m] = np.full_like(x, math.prod(range(1, 2 * m, 2)))
        if m < l_max:
            p[m + 1, m] = (2 * m + 1) * z * p[m, m]
        for l in range(m + 2, l_max + 1):
            p[l, m] = ((2 * l - 1) * z * p[l - 1, m] - (l + m - 1) * r2 * p[l - 2, m]) / (l - m)
    out = []
    for l in range(l_max + 1):
        cols = []
        for m in range(-l, l + 1):
            k = abs(m)
            scale = math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - k) / math.factorial(l + k))
            trig = cos[k] if m >= 0 else sin[k]
            cols.append(scale * (math.sqrt(2.0) if m else 1.0) * p[l, k] * trig)
        out.append(np.stack(cols, axis=1))
    return out


def pair_expansion(r: np.ndarray, basis: SoapBasis) -> np.ndarray:
    """(n, width) contributions of neighbours at ``r``, order (l, n, m)."""
    eta = 0.5 / basis.sigma**2
    d2 = (r * r).sum(axis=1)
    blocks = []
    for l, harmonic in enumerate(solid_harmonics(r, basis.l_max)):
        alpha = basis.exponents(l)
        factor = (math.pi / (alpha + eta)) ** 1.5 * (eta / (alpha + eta)) ** l
        radial = (factor * np.exp(-(alpha * eta / (alpha + eta))[None, :] * d2[:, None])) @ basis.mixing(l).T
        blocks.append((radial[:, :, None] * harmonic[:, None, :]).reshape(len(r), -1))
    return np.concatenate(blocks, axis=1)


def _cross_spectrum(c1: np.ndarray, c2: np.ndarray, basis: SoapBasis, same: bool) -> list[np.ndarray]:
    """Invariants of two (n, width) expansions, order (l, n, n')."""
    out, at = [], 0
    for l in range(basis.l_max + 1):
        size = basis.n_max * (2 * l + 1)
        a = c1[:, at : at + size].reshape(-1, basis.n_max, 2 * l + 1)
        b = c2[:, at : at + size].reshape(-1, basis.n_max, 2 * l + 1)
        at += size
        product = math.pi * math.sqrt(8.0 / (2 * l + 1)) * np.einsum("ipm,iqm->ipq", a, b)
        for n in range(basis.n_max):
            for n2 in range(n if same else 0, basis.n_max):
                out.append(product[:, n, n2])
    return out


def power_spectrum(coefficients: np.ndarray, basis: SoapBasis, channels: int) -> np.ndarray:
    """Invariants of (n, channels * width) expansions, channel pairs in order."""
    parts = [coefficients[:, i * basis.width : (i + 1) * basis.width] for i in range(channels)]
    out = []
    for i in range(channels):
        for j in range(i, channels):
            out += _cross_spectrum(parts[i], parts[j], basis, i == j)
    return np.stack(out, axis=1) if out else np.zeros((len(coefficients), 0))


def _pieces(batches, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def soap_descriptors(
    atoms: DataFrame,
    frame: Sequence[str] = ("file_id", "struct_id"),
    species: Sequence[str] | None = None,
    basis: SoapBasis = SoapBasis(),
    compression: str | None = "mu2",
    periodic: bool = True,
) -> DataFrame:
    """..frame, atom_id, x: one descriptor per atom.

    ``compression="mu2"`` sums the density over species; ``None`` or ``"off"``
    keeps one channel per species, which must then be listed.
    """
    if compression not in ("mu2", "off", None):
        raise ValueError(f"unknown compression {compression!r}; expected mu2 or off")
    frame = list(frame)
    per_species = compression != "mu2"
    channels = sorted(species) if per_species else [None]
    if per_species and not channels:
        raise ValueError("species must be listed without compression")
    data = atoms if periodic else atoms.withColumn("pbc", F.array(*[F.lit(False)] * 3))
    pairs = neighbor_pairs(data, frame, basis.reach, keep=["symbol"]).select(
        *frame, F.col("i").alias("atom_id"), F.col("symbol_j").alias("symbol"), "rx", "ry", "rz"
    )
    # The central atom is part of its own environment.
    own = data.select(*frame, "atom_id", "symbol", *[F.lit(0.0).alias(f"r{c}") for c in "xyz"])
    channel = F.lit(0)
    if per_species:
        known = F.array_position(F.array(*[F.lit(s) for s in channels]), F.col("symbol")).cast("int") - 1
        channel = F.coalesce(known, F.lit(-1))
    terms = pairs.unionByName(own).withColumn("channel", channel).drop("symbol")
    keys = [*frame, "atom_id", "channel"]
    fields = {f.name: f.dataType.simpleString() for f in terms.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", c array<double>"

    def expand(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            r = np.stack([batch.column(n).to_numpy() for n in ("rx", "ry", "rz")], axis=1)
            values = pair_expansion(r, basis)
            table = pa.table({k: batch.column(k) for k in keys})
            table = table.append_column("_i", pa.array(np.arange(len(r))))
            first = table.group_by(keys, use_threads=False).aggregate([("_i", "list")])
            members = first.column("_i_list").combine_chunks()
            order = members.flatten().to_numpy()
            starts = members.offsets.to_numpy()[:-1]
            sums = np.add.reduceat(values[order], starts, axis=0)
            columns = [first.column(k).combine_chunks() for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, as_lists(sums)], names=[*keys, "c"])

    partial = terms.mapInArrow(expand, schema)
    count = len(channels)
    owner = [*frame, "atom_id"]
    # Partial sums meet once, as arrays: an atom's rows follow each other and are added up in passing.
    placed = partial.repartition(*owner).sortWithinPartitions(*owner)
    out_schema = ", ".join(f"{k} {fields[k]}" for k in owner) + ", x array<double>"

    def invariants(batches):
        """One row per atom; the last atom of a batch waits for its other rows."""
        open_key, open_sum = None, None
        for batch in _pieces(batches, max(1, DENSE_VALUES // (count * basis.width))):
            columns = [batch.column(k) for k in owner]
            values, channel = as_matrix(batch.column("c")), batch.column("channel").to_numpy()
            fresh = np.zeros(batch.num_rows, dtype=bool)
            fresh[0] = True
            for column in columns:
                numbers = column.dictionary_encode().indices.fill_null(-1).to_numpy()
                fresh[1:] |= numbers[1:] != numbers[:-1]
            starts = np.nonzero(fresh)[0]
            dense = np.zeros((len(starts), count, basis.width))
            listed = channel >= 0  # a species that is not listed adds nothing
            np.add.at(dense, ((np.cumsum(fresh) - 1)[listed], channel[listed]), values[listed])
            dense = dense.reshape(len(starts), -1)
            keys = pa.table([c.take(pa.array(starts)) for c in columns], names=owner)
            first = tuple(c[0].as_py() for c in columns)
            if open_key is not None:
                if first == tuple(c[0].as_py() for c in open_key.columns):
                    dense[0] += open_sum[0]
                else:
                    keys = pa.concat_tables([open_key, keys])
                    dense = np.concatenate([open_sum, dense])
            open_key, open_sum = keys.slice(len(keys) - 1), dense[-1:]
            if len(keys) > 1:
                yield finished(keys.slice(0, len(keys) - 1), dense[:-1])
        if open_key is not None:
            yield finished(open_key, open_sum)

    def finished(keys, sums):
        x = as_lists(power_spectrum(sums, basis, count))
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in keys.columns], x], names=[*owner, "x"])

    return placed.mapInArrow(invariants, out_schema)
