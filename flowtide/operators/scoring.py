"""Tree-ensemble scoring as Spark expressions, and path attribution of a score."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.columns import round_even
from flowtide.schemas import ATTACK_CLASSES, FLOW_FEATURES, STEP_DOWN, STEP_UP, TOP_CONTRIBUTORS

# A model is read to the driver and compiled, so its size is checked.
MAX_NODES = 20_000
# Attribution steps are whole multiples of this, so equal sums compare as equal.
_STEP = 0.05


@dataclass(frozen=True)
class Leaf:
    probs: tuple[float, ...]
    steps: tuple[int, ...]  # attribution in units of _STEP, one per feature


@dataclass(frozen=True)
class Ensemble:
    """Trees as node rows, compiled on demand to one leaf-number column per tree."""

    trees: tuple[dict, ...]
    features: tuple[str, ...] = tuple(FLOW_FEATURES)
    classes: tuple[str, ...] = tuple(ATTACK_CLASSES)

    @staticmethod
    def from_table(nodes: DataFrame, **names) -> Ensemble:
        rows = nodes.limit(MAX_NODES + 1).collect()
        if len(rows) > MAX_NODES:
            raise ValueError(f"the ensemble has more than {MAX_NODES} nodes")
        return Ensemble.from_rows(rows, **names)

    @staticmethod
    def from_rows(rows: Iterable, **names) -> Ensemble:
        trees: dict[int, dict] = {}
        for r in rows:
            trees.setdefault(r["tree"], {})[r["node"]] = r
        return Ensemble(tuple(trees[t] for t in sorted(trees)), **names)

    def compiled(self, tree: dict) -> tuple[str, list[Leaf]]:
        """(SQL text giving the leaf number from 1, leaves in that order)."""
        leaves: list[Leaf] = []
        up, down = round(STEP_UP / _STEP), round(STEP_DOWN / _STEP)

        def visit(number: int, steps: tuple[int, ...]) -> str:
            node = tree[number]
            if node["probs"] is not None:
                leaves.append(Leaf(tuple(node["probs"]), steps))
                return str(len(leaves))
            at = self.features.index(node["feature"])

            def moved(by: int) -> tuple[int, ...]:
                return (*steps[:at], steps[at] + by, *steps[at + 1 :])

            left = visit(node["left"], moved(down))
            right = visit(node["right"], moved(up))
            return f"if(`{_INPUT}{node['feature']}` <= {_double(node['threshold'])}, {left}, {right})"

        return visit(min(tree), (0,) * len(self.features)), leaves

    @property
    def used(self) -> list[str]:
        """Features that some split reads."""
        read = {n["feature"] for t in self.trees for n in t.values() if n["probs"] is None}
        return [f for f in self.features if f in read]


_INPUT = "_x_"


def _double(value: float) -> str:
    return f"cast('{float(value)!r}' as double)"


def _table(rows: list, cell) -> str:
    """SQL text of a constant array of arrays."""
    return "array(" + ", ".join("array(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


def _leaves(model: Ensemble) -> tuple[list[str], list[list[Leaf]]]:
    compiled = [model.compiled(t) for t in model.trees]
    return [text for text, _ in compiled], [leaves for _, leaves in compiled]


def _constant(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def score(flows: DataFrame, model: Ensemble) -> DataFrame:
    """Add ``probs``, ``predicted`` (first maximum) and ``anomaly_prob`` = 1 - P(first class).

    Trees become nested conditions in generated code; no Python runs per row. Each tree gives a leaf
    number, the leaf gives its class probabilities from a constant table, and those are averaged. The
    leaf numbers stay as columns for the attribution.
    """
    texts, leaves = _leaves(model)
    inputs = flows.withColumns(
        {f"{_INPUT}{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in model.used}
    )
    placed = inputs.withColumns({f"_leaf{i}": F.expr(t) for i, t in enumerate(texts)}).drop(
        *[f"{_INPUT}{f}" for f in model.used]
    )
    tables = [_table([leaf.probs for leaf in table], _double) for table in leaves]
    found = placed.withColumns({f"_p{i}": F.expr(f"element_at({t}, _leaf{i})") for i, t in enumerate(tables)})
    sums = [" + ".join(f"_p{i}[{c}]" for i in range(len(leaves))) for c in range(len(model.classes))]
    mean = ", ".join(f"({s}) / {_double(len(leaves))}" for s in sums)
    scored = found.withColumn("probs", F.expr(f"array({mean})")).drop(*[f"_p{i}" for i in range(len(leaves))])
    return scored.withColumns(
        {
            "predicted": F.element_at(
                _constant(list(model.classes)),
                F.array_position("probs", F.array_max("probs")).cast("int"),
            ),
            "anomaly_prob": F.lit(1.0) - F.col("probs")[0],
        }
    )


def attribute(scored: DataFrame, model: Ensemble, top: int = TOP_CONTRIBUTORS) -> DataFrame:
    """Add ``contributors``: the features with the largest effect along the decision paths.

    Each split passed to the right adds to its feature and each to the left takes away. The path is a
    function of the leaf, so every leaf brings a ready row of effects. Place the alert filter first.
    """
    _, leaves = _leaves(model)
    width = len(model.features)
    rows = [
        F.expr(f"element_at({_table([leaf.steps for leaf in table], str)}, _leaf{i})")
        for i, table in enumerate(leaves)
    ]
    total = F.aggregate(
        F.array(*rows), _constant([0] * width), lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b)
    )
    named = F.zip_with(
        F.zip_with(
            total,
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda steps, i: F.struct(F.abs(steps).alias("size"), i.alias("place"), steps.alias("steps")),
        ),
        _constant(list(model.features)),
        lambda effect, name: F.struct(
            effect["size"].alias("size"), effect["place"].alias("place"), name.alias("feature"),
            (effect["steps"] * F.lit(_STEP) / F.lit(float(len(leaves)))).alias("value"),
        ),
    )
    # Largest effect first; among equals the later feature first.
    ranked = F.slice(F.sort_array(named, asc=False), 1, top)
    picked = F.transform(ranked, lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value")))
    return scored.withColumn("contributors", picked).withColumn(
        "primary_contributing_feature", F.col("contributors")[0]["feature"]
    )


def drop_leaves(scored: DataFrame) -> DataFrame:
    return scored.drop(*[c for c in scored.columns if c.startswith("_leaf")])


def binary_decision(rows: DataFrame, threshold: float = 0.5, prob: str | None = "p", label: str = "prediction") -> DataFrame:
    """Attack decision from a probability column, or from a hard label if there is none."""
    if prob is None:
        attack = F.col(label).cast("int")
        p = F.when(attack == 1, F.lit(1.0)).otherwise(F.lit(0.0))
        confidence = F.lit(1.0)
    else:
        p = F.col(prob)
        attack = (p >= F.lit(float(threshold))).cast("int")
        confidence = F.when(attack == 1, p).otherwise(1.0 - p)
    return rows.withColumns(
        {
            "predicted_label": attack,
            "predicted_class": F.when(attack == 1, "Attack").otherwise("Normal"),
            "confidence": round_even(confidence, 4),
            "probability_attack": round_even(p, 4),
            "probability_normal": round_even(1.0 - p, 4),
            "is_alert": attack == 1,
            "threshold_used": F.lit(float(threshold)),
        }
    )
