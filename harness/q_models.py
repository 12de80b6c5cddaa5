"""Scoring, attribution, evaluation and training queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.columns import round_even
from flowtide.operators import evaluation as ev
from flowtide.operators import scoring, training
from flowtide.operators.cleaning import Preprocessor
from flowtide.plans.fit import TREE, fit_baselines
from flowtide.schemas import ATTACK_CLASSES
from flowtide.session import materialise, shared_folder
from flowtide.sources import models as model_io
from harness import views as V
from harness.registry import query
from harness.sql import on_labelled, on_scores, rnd, unit_value

_NAMES = [c.lower() for c in ATTACK_CLASSES]
ID = ["flow_id", "start_us"]


def scored(spark, sf):
    return scoring.score(V.records(spark, sf), V.model())


def class_probs(df):
    return df.select(*ID, *[round_even(F.col("probs")[i], 6).alias(f"p_{n}") for i, n in enumerate(_NAMES)])


_PROBS = on_scores(f"select flow_id, start_us, {', '.join(f'{rnd(f'p_{n}', 6)} as p_{n}' for n in _NAMES)} from sc")


@query("ensemble_score", _PROBS)
def _score(spark, sf):
    return class_probs(scored(spark, sf))


@query("model_manifest_io", _PROBS)
def _manifest(spark, sf):
    path = model_io.save_manifest(spark, V.manifest_rows())
    return class_probs(scoring.score(V.records(spark, sf), model_io.load_manifest(spark, path)))


@query("predict_class", on_scores("select flow_id, start_us, predicted from sc"))
def _predict(spark, sf):
    return scored(spark, sf).select(*ID, "predicted")


@query("anomaly_prob", on_scores(f"select flow_id, start_us, {rnd('anomaly_prob', 6)} as anomaly_prob from sc"))
def _anomaly(spark, sf):
    return scored(spark, sf).select(*ID, round_even(F.col("anomaly_prob"), 6).alias("anomaly_prob"))


@query("path_attribution", on_scores(f"""
select flow_id, start_us, x.feature as feature, {rnd(unit_value('x.units'), 6)} as value
from (select flow_id, start_us, unnest(effects) as x from sc) where x.units <> 0"""))
def _attribution(spark, sf):
    every = scoring.attribute(scored(spark, sf), V.model(), top=36)
    return every.select(*ID, F.inline("contributors")).filter("value <> 0").withColumn("value", round_even(F.col("value"), 6))


@query("top_contributors", on_scores("select flow_id, start_us, " + ", ".join(
    f"effects[{i}].feature as feature_{i}, {rnd(unit_value(f'effects[{i}].units'), 6)} as value_{i}" for i in (1, 2, 3)
) + " from sc"))
def _top(spark, sf):
    best = scoring.attribute(scored(spark, sf), V.model())
    cells = [
        c for i in (0, 1, 2)
        for c in (F.col("contributors")[i]["feature"].alias(f"feature_{i + 1}"),
                  round_even(F.col("contributors")[i]["value"], 6).alias(f"value_{i + 1}"))
    ]
    return best.select(*ID, *cells)


@query("binary_score", on_labelled(f"""
select id, (p >= 0.5::double)::integer as predicted_label, case when p >= 0.5::double then 'Attack' else 'Normal' end as predicted_class,
  {rnd("case when p >= 0.5::double then p else 1.0::double - p end", 4)} as confidence, {rnd("p", 4)} as probability_attack,
  {rnd("1.0::double - p", 4)} as probability_normal, p >= 0.5::double as is_alert, 0.5::double as threshold_used from lf"""))
def _binary(spark, sf):
    return scoring.binary_decision(V.scores(spark, sf)).select(
        "id", "predicted_label", "predicted_class", "confidence", "probability_attack", "probability_normal", "is_alert", "threshold_used"
    )


def _metrics_sql(p: str) -> str:
    return f"""
m as (select count(*) filter (label = 0 and {p} < 0.5::double) as tn, count(*) filter (label = 0 and {p} >= 0.5::double) as fp,
  count(*) filter (label = 1 and {p} < 0.5::double) as fn, count(*) filter (label = 1 and {p} >= 0.5::double) as tp, count(*) as n from lf)"""


_RATES = """tn, fp, fn, tp, n as total_samples, (tp + tn)::double / n as accuracy,
  coalesce(tp::double / nullif(tp + fp, 0), 0) as precision, coalesce(tp::double / nullif(tp + fn, 0), 0) as recall,
  coalesce((2 * tp)::double / nullif(2 * tp + fp + fn, 0), 0) as f1_score,
  coalesce(fp::double / nullif(fp + tn, 0), 0) as false_positive_rate, coalesce(fn::double / nullif(fn + tp, 0), 0) as false_negative_rate,
  0.5::double as threshold_used"""


@query("binary_metrics", on_labelled(f"select {_RATES} from m", (_metrics_sql("p"),)))
def _metrics(spark, sf):
    return ev.binary_metrics(V.scores(spark, sf))


@query("roc_auc", on_labelled("""
select sum(pos * (2 * below + neg))::double / (2.0::double * sum(pos) * sum(neg)) as roc_auc, sum(pos) as positives, sum(neg) as negatives
from (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below
  from (select p, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from lf group by p))"""))
def _auc(spark, sf):
    return ev.roc_auc(V.scores(spark, sf))


_OTHER = "case when p >= 0.6::double then attack_cat when p >= 0.3::double then 'Generic' else 'Normal' end"


@query("multiclass_metrics", on_labelled(f"""
select avg((attack_cat = c)::integer) as accuracy, avg(((attack_cat = 'Normal') = (c = 'Normal'))::integer) as binary_accuracy
from (select *, {_OTHER} as c from lf)"""))
def _multiclass(spark, sf):
    rows = V.scores(spark, sf).withColumn("c", F.expr(_OTHER.replace("::double", "D")))
    return ev.multiclass_metrics(rows, F.col("attack_cat"), F.col("c"))


@query("champion", on_labelled("""
select case when tree >= logistic then 'tree' else 'logistic' end as champion, greatest(tree, logistic) as f1_score from (
  select 2.0::double * count(*) filter (label = 1 and p >= 0.5::double) / (count(*) filter (label = 1) + count(*) filter (p >= 0.5::double)) as tree,
    2.0::double * count(*) filter (label = 1 and 1.0::double - p >= 0.5::double)
      / (count(*) filter (label = 1) + count(*) filter (1.0::double - p >= 0.5::double)) as logistic from lf)"""))
def _champion(spark, sf):
    rows = V.scores(spark, sf).withColumn("q", 1.0 - F.col("p"))
    return ev.champion({"tree": ev.binary_metrics(rows), "logistic": ev.binary_metrics(rows, "q")}, tie="tree")


@query("train_val_split", on_labelled("""
select id, case when ('0x' || substr(md5(id::varchar), 1, 8))::bigint % 100 < 80 then 'train' else 'validation' end as split from lf"""))
def _split(spark, sf):
    return ev.train_val_split(V.labelled_flows(spark, sf)).select("id", "split")


@query("sample_per_class", on_labelled("""
select id, label, attack_cat from lf qualify row_number() over (partition by label order by id) <= 3"""))
def _sample(spark, sf):
    return ev.sample_per_class(V.labelled_flows(spark, sf)).select("id", "label", "attack_cat")


def matrices(spark, sf, keep_test: bool = True):
    """(prepared training rows, prepared test rows, preprocessor). The rows are stored: fits and figures read them many times.

    Test rows that are read only once need not be (``keep_test``).
    """
    train, test = (V.labelled_flows(spark, sf, s) for s in ("train", "test"))
    prep = Preprocessor.fit(train)
    keep = ["id", "label", "attack_cat"]
    train, test = (prep.vectors(rows, keep) for rows in (train, test))
    return materialise(train, "matrix"), materialise(test, "matrix") if keep_test else test, prep


def evaluated(model, test):
    return ev.binary_metrics(model.transform(test).withColumn("p", vector_to_array("probability")[1]))


_SIZES = "count(*) filter (in_train) as n_train, count(*) filter (not in_train) as n_test, count(*) filter (not in_train and label = 1) as positives"


def tested(model, test) -> DataFrame:
    """One row: sizes by the confusion counts, and whether the model beats the more frequent class."""
    scored = model.transform(test).select("label", vector_to_array("probability").alias("p"))
    said = F.col("p")[1] >= 0.5
    one = scored.agg(
        *[F.count_if(c).alias(n) for n, c in (
            ("tp", said & (F.col("label") == 1)), ("fp", said & (F.col("label") == 0)),
            ("tn", ~said & (F.col("label") == 0)), ("fn", ~said & (F.col("label") == 1)))],
        F.bool_and((F.col("p")[0] + F.col("p")[1] - 1 < 1e-9) & F.col("p")[1].between(0, 1)).alias("probabilities"),
    )
    return one.select(
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n_test"), (F.col("tp") + F.col("fn")).alias("positives"), "probabilities",
        (F.col("tp") + F.col("tn") >= F.greatest(F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp"))).alias("beats_majority"),
    )


def stationary(model, rows: DataFrame, c: float = 1.0) -> DataFrame:
    """Whether the gradient of the penalised mean loss vanishes at a logistic model: what only the optimum has. One row.

    rows: (features, label), and weight if the fit was weighted.
    """
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    scored = model.transform(rows).select(vector_to_array("features").alias("x"), (weight * (vector_to_array("probability")[1] - F.col("label"))).alias("e"), weight.alias("w"))
    size = len(model.coefficients)
    sums = scored.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum("e").alias("g"), *[F.sum(F.col("x")[k] * F.col("e")).alias(f"g{k}") for k in range(size)])
    slopes = [F.abs(F.col(f"g{k}") / F.col("w") + F.lit(float(b)) / (F.lit(c) * F.col("n"))) for k, b in enumerate(model.coefficients)]
    return sums.select((F.greatest(F.abs(F.col("g") / F.col("w")), *slopes) < 1e-3).alias("stationary"))


@query("train_logreg", on_labelled(f"""
select {_SIZES}, true as probabilities, true as beats_majority, true as stationary, true as balanced_stationary from lf"""))
def _logreg(spark, sf):
    """Both fits, plain and with class weights, are where their gradients vanish; the plain one is tested."""
    train, test, _ = matrices(spark, sf, keep_test=False)
    plain, weighted = training.train_logistics(train, [False, True])
    parts = [
        tested(plain, test), stationary(plain, train),
        stationary(weighted, training.class_weights(train)).withColumnRenamed("stationary", "balanced_stationary"),
    ]
    return reduce(DataFrame.crossJoin, parts, train.agg(F.count(F.lit(1)).alias("n_train")))  # one row each


def shape(nodes: DataFrame) -> DataFrame:
    """One row about exported trees: their number, and whether each is a whole binary tree with shares that sum to one in its leaves."""
    leaf = F.col("probs").isNotNull()
    per = nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(leaf).alias("leaves"),
        F.bool_and(~leaf | (F.abs(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9)).alias("shares"),
        F.bool_and(leaf | ((F.col("left") > F.col("node")) & (F.col("right") > F.col("left")))).alias("below"),
    )
    return per.agg(F.count(F.lit(1)).alias("trees"), F.bool_and((F.col("n") == 2 * F.col("leaves") - 1) & F.col("shares") & F.col("below")).alias("whole"))


def walked(spark, nodes: DataFrame, model, rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose probabilities by the exported trees differ from the fitted model's by more than rounding; one row."""
    classes = tuple(str(k) for k in range(model.numClasses))
    ensemble = scoring.Ensemble.from_table(nodes, features=tuple(names), classes=classes)
    scored = model.transform(rows).select(vector_to_array("probability").alias("p"), vector_to_array("features").alias("x"))
    columns = scored.select("p", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    apart = F.exists(F.zip_with("p", "probs", lambda a, b: F.abs(a - b)), lambda d: F.coalesce(d > 1e-9, F.lit(True)))
    return scoring.score(columns, ensemble).agg(F.count_if(apart).alias("mismatches"))


@query("train_tree", on_labelled(f"""
select {_SIZES}, true as probabilities, true as beats_majority, 1 as trees, true as whole, 0 as mismatches, true as deep_enough, true as large_enough from lf"""))
def _tree(spark, sf):
    """The tree keeps to its depth and leaf size, and its exported nodes score like the fitted model."""
    train, test, prep = matrices(spark, sf)
    model = training.train_tree(train)
    names = [f"f{i}" for i in range(len(prep.names))]
    nodes = materialise(training.export_ensemble(spark, model, names), "nodes")
    leaves = model.transform(train).groupBy("rawPrediction").count()  # leaves of equal counts are one group
    limits = leaves.agg((F.min("count") >= 10).alias("large_enough")).withColumn("deep_enough", F.lit(0 < model.depth <= 10))
    parts = [tested(model, test), shape(nodes), walked(spark, nodes, model, test, names), limits]
    return reduce(DataFrame.crossJoin, parts, train.agg(F.count(F.lit(1)).alias("n_train")))  # one row each


@query("train_ensemble", on_labelled("""
select count(*) filter (not in_train) as n_test, 15 as trees, true as whole, 0 as mismatches, true as deep_enough, true as beats_majority from lf"""))
def _ensemble(spark, sf):
    """Fit, export to node rows, and score the test rows with the compiled expressions: as the fitted model does."""
    train, test, prep = matrices(spark, sf)
    indexed = train.withColumn("class_index", training.class_index("attack_cat"))
    forest = training.train_ensemble(indexed)
    names = [f"f{i}" for i in range(len(prep.names))]
    nodes = materialise(training.export_ensemble(spark, forest, names), "nodes")
    said = forest.transform(test.withColumn("class_index", training.class_index("attack_cat")))
    right = said.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("prediction") == F.col("class_index")).alias("hits"))
    most = test.groupBy("attack_cat").count().agg(F.max("count").alias("most"))
    depth = max(t.depth for t in forest.trees)
    one = right.crossJoin(most).select("n_test", (F.col("hits") >= F.col("most")).alias("beats_majority"), F.lit(0 < depth <= 5).alias("deep_enough"))
    return reduce(DataFrame.crossJoin, [shape(nodes), walked(spark, nodes, forest, test, names)], one)  # one row each


_BUNDLE = on_labelled("select count(*) as n_test, 0 as mismatches, true as same_statistics from lf where not in_train")


@query("model_bundle_io", _BUNDLE)
@query("pipeline_bundle_io", _BUNDLE)
def _bundle(spark, sf):
    """Fit, save and load: the loaded pair of preprocessor and model scores raw rows like the pair that was saved."""
    train, test, prep = matrices(spark, sf)
    model = training.train_tree(train)
    loaded = model_io.load_bundle(spark, model_io.save_bundle(spark, prep, model, "DecisionTreeClassifier"))
    raw = V.labelled_flows(spark, sf, "test")
    before = model.transform(test).select("id", F.col("probability").alias("p"))
    after = loaded.model.transform(loaded.preprocessor.vectors(raw, ["id"])).select("id", F.col("probability").alias("q"))
    both = before.join(after, "id", "full")
    return both.agg(
        F.count(F.lit(1)).alias("n_test"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("mismatches")
    ).withColumn("same_statistics", F.lit(loaded.preprocessor == prep))


@query("champion_fitted", on_labelled("""
select true as by_f1, true as above_chance, 2 as candidates, count(*) filter (not in_train) as n_test from lf"""))
def _champion_fitted(spark, sf):
    """Two fitted and stored classifiers: the champion has the greater F1 of both on the test rows, the tree on a draw."""
    train, test = (V.labelled_flows(spark, sf, s) for s in ("train", "test"))
    fitted = fit_baselines(train, test, f"{shared_folder(spark)}/flowtide/baselines-{uuid.uuid4().hex}")
    f1 = {name: m["f1_score"] for name, m in fitted.metrics.items()}
    best = max(f1, key=lambda name: (f1[name], name == TREE))
    return test.agg(F.count(F.lit(1)).alias("n_test")).select(
        "n_test", F.lit(fitted.champion == best).alias("by_f1"), F.lit(len(f1)).alias("candidates"),
        F.lit(all(m["roc_auc"] > 0.5 for m in fitted.metrics.values())).alias("above_chance"),
    )
