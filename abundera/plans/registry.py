"""Plug-in registry: methods by group and name, registered by decorator or found through entry points."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import metadata

from abundera.operators import batch, impute, lfq, normalize, pibaq, rollup

GROUPS = ("quantification", "imputation", "normalization.run", "normalization.sample", "batch")


class PluginRegistry:
    def __init__(self) -> None:
        self._found: dict[tuple[str, str], Callable] = {}
        self._scanned = False

    def register(self, group: str, name: str) -> Callable[[Callable], Callable]:
        if group not in GROUPS:
            raise ValueError(f"unknown plug-in group {group!r}; known are {', '.join(GROUPS)}")

        def add(fn: Callable) -> Callable:
            self._found[group, name.lower()] = fn
            return fn

        return add

    def _scan(self) -> None:
        """Load entry points of other distributions once, when first asked."""
        if not self._scanned:
            self._scanned = True
            for group in GROUPS:
                for point in metadata.entry_points(group=f"abundera.{group}"):
                    self._found.setdefault((group, point.name.lower()), point.load())

    def names(self, group: str) -> list[str]:
        self._scan()
        return sorted(n for g, n in self._found if g == group)

    def get(self, group: str, name: str) -> Callable:
        self._scan()
        try:
            return self._found[group, name.lower()]
        except KeyError:
            raise ValueError(f"unknown {group} {name!r}; known are {', '.join(self.names(group))}") from None


REGISTRY = PluginRegistry()

# What a roll-up works on: peptide rows or ion rows.
INPUT_LEVEL = {"maxlfq": "ions", "directlfq": "ions", "ratio": "ions", "pibaq": "ions", "spectral_count": "psms"}
for _name, _fn in {
    "sum": rollup.sum_of_peptides, "median": rollup.median_of_peptides, "mean": rollup.mean_of_peptides, "abd": rollup.log2_abundance, "intensity": rollup.sum_of_peptides,
    "peptide_count": rollup.peptide_count, "peptide_count_distinct": rollup.peptide_count_distinct, "maxlfq": lfq.maxlfq, "directlfq": lfq.directlfq, "ratio": rollup.ratio_to_reference, "pibaq": pibaq.allocate, "spectral_count": rollup.spectral_count,
}.items():
    REGISTRY.register("quantification", _name)(_fn)
for _name in ("zero", "constant", "mean", "median", "most_frequent", "mindet", "minprob", "qrilc", "gms", "knn", "seqknn", "bpca", "impseq", "impseqrob", "missforest"):
    REGISTRY.register("imputation", _name)(lambda long, _n=_name, **o: impute.impute(long, _n, **o))
for _name, _fn in normalize.SAMPLE_METHODS.items():
    REGISTRY.register("normalization.sample", _name)(_fn)
for _name in ("median", "mean", "max", "global", "iqr"):
    REGISTRY.register("normalization.run", _name)(lambda ions, _n=_name: normalize.scale_runs(ions, normalize.run_factors(ions, _n)))
REGISTRY.register("normalization.run", "max-min")(normalize.run_max_min)
REGISTRY.register("batch", "combat")(batch.combat_long)
REGISTRY.register("batch", "location-scale")(batch.location_scale)
REGISTRY.register("normalization.run", "none")(lambda ions: ions)


def parse_quant(name: str) -> tuple[str, int | None]:
    """Method name and N: ``top5`` is (topn, 5); a plain name has no N."""
    low = name.strip().lower().replace("-", "_")
    m = re.fullmatch(r"top_?([0-9]+)", low)
    if m:
        n = int(m.group(1))
        if n < 1:
            raise ValueError("top0 keeps nothing")
        return "topn", n
    alias = {"all": "sum", "lfq": "maxlfq", "max_lfq": "maxlfq", "direct_lfq": "directlfq", "counts": "peptide_count", "ibaq": "pibaq", "spectral_counts": "spectral_count"}
    return alias.get(low, low), None


def quantifier(name: str) -> tuple[Callable, str]:
    """The roll-up of a name and the level it works on."""
    method, n = parse_quant(name)
    if method == "topn":
        return (lambda p: rollup.top_n_mean(p, n)), "peptides"
    return REGISTRY.get("quantification", method), INPUT_LEVEL.get(method, "peptides")
