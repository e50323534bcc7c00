"""Record contracts as named conditions, uniqueness and forbidden fields."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Conditions that hold for every alert.
ALERT = {
    "composite key": "account_key RLIKE '^[^|]+[|][^|]+$'", "one rule at least": "n_rules_triggered >= 1", "window in order": "window_start <= window_end", "window closed": "window_end < as_of", "id": "alert_id RLIKE '^A[0-9a-f]+$'",
}
#: Names of ground truth, which no visible table or payload may carry.
FORBIDDEN = {
    "is_laundering", "is_true_positive", "label", "labels", "pattern_id", "pattern_instance_id", "typology_truth", "gt_typology", "ground_truth",
    "label_definition_id", "attempt_id", "attempt_ids", "has_unattributed", "n_laundering_txns", "is_pos", "planted", "laundering_account", "agent_group",
}


def normal_sql(name: str) -> str:
    """A field's name in lower case, its spaces and dashes as underscores, in SQL."""
    return f"translate(lower(trim({name})), ' -', '__')"


def violations(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Rows that break a condition, with the names of what they break; a null condition counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), name) for name, c in contract.items()]))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def forbidden_fields(schema: T.DataType, path: str = "") -> list[str]:
    """Paths of fields whose name, in lower case and with underscores, is forbidden; nested types are walked."""
    if isinstance(schema, T.StructType):
        found = []
        for f in schema.fields:
            at = f"{path}.{f.name}".lstrip(".")
            found += [at] if re.sub("[ -]", "_", f.name.strip().lower()) in FORBIDDEN else []
            found += forbidden_fields(f.dataType, at)
        return found
    if isinstance(schema, T.ArrayType):
        return forbidden_fields(schema.elementType, f"{path}[]")
    if isinstance(schema, T.MapType):
        return forbidden_fields(schema.keyType, f"{path}{{key}}") + forbidden_fields(schema.valueType, f"{path}{{value}}")
    return []


def differences(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys that only one side has, or whose values differ; NaN equals NaN."""
    names = [c for c in a.columns if c not in keys]
    joined = a.alias("a").join(b.alias("b"), keys, "full")
    kinds = dict(a.dtypes)

    def apart(c: str):
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        return ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))) if kinds[c] == "double" else ~x.eqNullSafe(y)

    wrong = F.array_compact(F.array(*[F.when(apart(c), c) for c in names]))
    return joined.select(*keys, wrong.alias("differs")).filter(F.size("differs") > 0)


def stored_integrity(stored: DataFrame, recomputed: DataFrame, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """``n_stats, n_rules``: stored alerts whose statistics, or whose rules, are not those recomputed (or have none)."""
    keys = ["account_key", "window_start"]
    both = stored.select(*keys, *columns, "triggered_rules").alias("a").join(recomputed.select(*keys, *columns, "triggered_rules", F.lit(True).alias("known")).alias("b"), keys, "left")
    apart = [~(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) | F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance, F.lit(False))) for c in columns]
    wrong = F.col("known").isNull()
    for c in apart:
        wrong = wrong | c
    return both.agg(F.count(F.when(wrong, 1)).alias("n_stats"), F.count(F.when(~F.col("a.triggered_rules").eqNullSafe(F.col("b.triggered_rules")), 1)).alias("n_rules"))


def ground_truth_names(source: str) -> list[str]:
    """Names of ground truth that a module's source uses: as names, attributes, arguments, keywords or strings."""
    import ast

    found = set()
    for node in ast.walk(ast.parse(source)):
        names = [getattr(node, "id", None), getattr(node, "attr", None), getattr(node, "arg", None), getattr(node, "value", None) if isinstance(node, ast.Constant) else None]
        found |= {n for n in names if isinstance(n, str) and re.sub("[ -]", "_", n.strip().lower()) in FORBIDDEN}
    return sorted(found)


def evaluation_imports(source: str, packages: tuple[str, ...]) -> list[str]:
    """Modules of ``packages`` that a module's source imports."""
    import ast

    found = set()
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            found |= {node.module or "", *(f"{node.module}.{a.name}" for a in node.names)}
    return sorted(n for n in found if any(n == p or n.startswith(p + ".") for p in packages))
