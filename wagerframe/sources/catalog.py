"""Dataset catalog: aliases, variants, default budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Spellings of a dataset variant.
VARIANTS = {
    "default": "default",
    "rebels_only": "rebels_only",
    "rebels": "rebels_only",
    "rebel_cooperate": "rebels_only",
    "rebel": "rebels_only",
    "with_steals": "steals_only",
    "steals_only": "steals_only",
    "steals": "steals_only",
    "steal_only": "steals_only",
    "steal_mixed": "steals_only",
    "combined": "combined",
    "unified": "combined",
}
# Situations evaluated by default, per dataset.
DEFAULT_BUDGETS = {
    "low_stakes_training": 200,
    "low_stakes_validation": 200,
    "low_stakes_training_lin_only": 200,
    "low_stakes_validation_lin_only": 200,
    "medium_stakes_validation": 200,
    "medium_stakes_validation_rebels_only": 200,
    "medium_stakes_validation_steals_only": 500,
    "high_stakes_test": 1000,
    "high_stakes_test_rebels_only": 1000,
    "astronomical_stakes_deployment": 1000,
    "astronomical_stakes_deployment_rebels_only": 1000,
    "steals_test": 1000,
    "gpu_hours_transfer_benchmark": 1000,
    "lives_saved_transfer_benchmark": 1000,
    "money_for_user_transfer_benchmark": 1000,
}


class Catalog:
    """Named tables with optional variants; paths are the caller's."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[tuple[str, str], str] = {}
        self._bases: dict[str, str] = {}

    def add(self, alias: str, path: str, variant: str = "default", base: str | None = None) -> None:
        self._paths[(alias, variant_name(variant))] = path
        self._bases[alias] = base or alias

    def resolve(self, alias: str, variant: str = "default") -> tuple[str, str, str]:
        """``(path, variant, base)`` of a dataset; an unknown variant names the known ones."""
        wanted, base = variant_name(variant), self._bases.get(alias, alias)
        for name in (alias, base):
            if (name, wanted) in self._paths:
                return self._paths[(name, wanted)], wanted, base
        known = sorted(v for a, v in self._paths if a in (alias, base))
        raise ValueError(f"dataset {alias!r} has no variant {wanted!r}; known: {known}")

    def budget(self, alias: str, variant: str = "default") -> int | None:
        """Default number of situations: of the variant where it has its own, else of the dataset, else of its base."""
        base = self._bases.get(alias, alias)
        names = [f"{alias}_{variant_name(variant)}", alias, f"{base}_{variant_name(variant)}", base]
        return next((DEFAULT_BUDGETS[n] for n in names if n in DEFAULT_BUDGETS), None)

    def listing(self) -> DataFrame:
        rows = [(a, v, self._bases[a], p, self.budget(a, v)) for (a, v), p in sorted(self._paths.items())]
        return self.spark.createDataFrame(rows, "alias string, variant string, base string, path string, budget int")

    def row_counts(self) -> dict[str, int]:
        """Rows per parquet dataset, from file footers."""
        return {f"{a}/{v}": self.spark.read.parquet(p).count() for (a, v), p in sorted(self._paths.items())}


def variant_name(name: str) -> str:
    word = str(name).strip().lower()
    if word not in VARIANTS:
        raise ValueError(f"unknown variant {name!r}; choose one of {sorted(VARIANTS)}")
    return VARIANTS[word]


def unique_in_order(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))
