"""Tree ensembles fitted on cells: the rows of one bin of every feature (and one class) as one weighted row.

Spark's trees know a row by its bins alone: at most ``maxBins`` a feature, between split candidates that are drawn
once before the first tree.  So rows that share all bins (and the class) take the same way through every tree, and
their sums decide the splits:

- boosted trees: the rows of a cell have the same residual in every round, or (regression) their residuals differ from
  those of their mean label by a constant, so one row with their number as weight gives the same trees;
- forests of classes: a bootstrap draws each row Poisson(1) times, hence the n rows of a cell Poisson(n) times
  together.  n is taken apart into its digits to base 16, each drawn at its own rate.

Split candidates, growing and drawing are Spark's own (``RandomForest.findSplits``, ``GBTClassifier``,
``RandomForest.runBagged``), and every row is in a cell.  A forest of a regression weighs each label by its own draws, so
it stays with the rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a fit from which cells are counted, and how many rows a cell must hold on average to be worth it.
CELL_ROWS = 1_000_000
ROWS_A_CELL = 2
#: Cells that a task of a fit holds: the passes are short, and a task costs some milliseconds.
CELLS_A_TASK = 100_000
BASE_BITS = 4


def on_cells(est) -> bool:
    """Whether ``est`` can be fitted on cells."""
    return isinstance(est, (GBTClassifier, GBTRegressor, RandomForestClassifier))


class Cells:
    """The cells of ``rows`` (columns ``features`` and ``label``) under the split candidates that Spark draws for ``forest``."""

    def __init__(self, forest, rows: DataFrame, n_classes: int):
        self.jvm, self.jsc = rows.sparkSession._jvm, rows.sparkSession.sparkContext._jsc
        self.gateway, self.n_classes = rows.sparkSession.sparkContext._gateway, n_classes
        instances = self._instances(forest, rows)
        old, algo = forest._java_obj, self.jvm.org.apache.spark.mllib.tree.configuration.Algo
        self.strategy = old.getOldStrategy(self.jvm.PythonUtils.toScalaMap({}), n_classes,
                                           algo.Classification() if n_classes else algo.Regression(), old.getOldImpurity())
        self.strategy.setBootstrap(True)
        impl = self.jvm.org.apache.spark.ml.tree.impl
        self.metadata = impl.DecisionTreeMetadata.buildMetadata(instances, self.strategy, forest.getNumTrees(),
                                                                forest.getFeatureSubsetStrategy())
        finder = getattr(getattr(impl, "RandomForest$"), "MODULE$")
        self.splits = finder.findSplits(instances, self.metadata, forest.getSeed())
        self.edges = [[s.threshold() for s in of] for of in self.splits]
        self.bins = [f"b{i}" for i in range(len(self.edges))]
        count = F.count(F.lit(1)).alias("n")
        binned = self._binned(rows)
        self.rows = (binned.groupBy(*self.bins, "label").agg(count) if n_classes
                     else binned.groupBy(*self.bins).agg(F.avg("label").alias("label"), count)).persist()
        self.n, self.n_rows = self.rows.agg(F.count(F.lit(1)), F.sum("n")).first()

    def _instances(self, est, rows: DataFrame):
        est._transfer_params_to_java()
        util = getattr(getattr(self.jvm.org.apache.spark.ml.util, "DatasetUtils$"), "MODULE$")
        return util.extractInstances(est._java_obj, rows._jdf, self.jvm.scala.Option.empty())

    def _binned(self, rows: DataFrame) -> DataFrame:
        """Bin of each feature: a row goes left of a candidate if its value is at most the threshold."""
        z = rows.select("label", vector_to_array("features").alias("z"))
        z = z.select("label", *[F.col("z")[i].alias(f"x{i}") for i in range(len(self.edges))])
        cut = [i for i, e in enumerate(self.edges) if e]
        if cut:
            z = Bucketizer(inputCols=[f"x{i}" for i in cut], outputCols=[f"b{i}" for i in cut], splitsArray=[
                [-math.inf, *[math.nextafter(t, math.inf) for t in self.edges[i]], math.inf] for i in cut]).transform(z)
        return z.select("label", *[(F.col(f"b{i}") if e else F.lit(0)).cast("int").alias(f"b{i}") for i, e in enumerate(self.edges)])

    def unpersist(self) -> None:
        self.rows.unpersist(blocking=False)

    def _array(self, kind, values):
        out = self.gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def fit(self, est):
        return self.forest(est) if isinstance(est, RandomForestClassifier) else self.boosted(est)

    def boosted(self, est):
        """``est`` (boosted trees of two classes or a regression) fitted on the cells, as a model of the features."""
        d = self.rows.select("label", F.col("n").cast("double").alias("weight"),
                             array_to_vector(F.array(*[F.col(b).cast("double") for b in self.bins])).alias("features"))
        d = d.coalesce(math.ceil(self.n / CELLS_A_TASK))
        # bins are numbers 0, 1, ...: as many are allowed as make Spark look at every cell for them
        most = max(est.getMaxBins(), math.isqrt(self.n) + 2)
        by_bin = est.copy().setWeightCol("weight").setMaxBins(most).fit(d)  # its Java model lives as long as this
        model = by_bin._java_obj
        tree = self.jvm.org.apache.spark.ml.tree
        one = self.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel

        def node(x):
            if x.subtreeDepth() == 0:
                return x
            i = x.split().featureIndex()
            at = tree.ContinuousSplit(i, self.edges[i][int(x.split().threshold())])
            return tree.InternalNode(x.prediction(), x.impurity(), x.gain(), node(x.leftChild()), node(x.rightChild()), at,
                                     x.impurityStats())
        trees = self._array(one, [one(t.uid(), node(t.rootNode()), len(self.edges)) for t in model.trees()])
        if isinstance(est, GBTClassifier):
            old = self.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
                model.uid(), trees, model.treeWeights(), len(self.edges), 2)
            return est._copyValues(GBTClassificationModel(old))
        old = self.jvm.org.apache.spark.ml.regression.GBTRegressionModel(model.uid(), trees, model.treeWeights(), len(self.edges))
        return est._copyValues(GBTRegressionModel(old))

    def forest(self, est):
        """``est`` (a forest of classes) fitted on the cells: n rows are drawn Poisson(n) times for each tree."""
        impl = self.jvm.org.apache.spark.ml.tree.impl
        # a value of each bin: its upper candidate, and one above the last
        inside = [F.array(*[F.lit(t) for t in [*e, max(e[-1] + 1.0, math.nextafter(e[-1], math.inf)) if e else 0.0]])
                  for e in self.edges]
        d = self.rows.select("label", "n", array_to_vector(F.array(*[v[F.col(b)] for v, b in zip(inside, self.bins)])).alias("features"))
        at = range(0, self.rows.agg(F.max("n")).first()[0].bit_length(), BASE_BITS)
        digits = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"shiftright(n, {k}) & {2 ** BASE_BITS - 1}").alias("times"))
                           for k in at])
        d = d.withColumn("d", F.explode(digits)).select("label", "features", "d.*").where("times > 0")
        drawn, once = [], getattr(impl.BaggedPoint, "convertToBaggedRDD$default$5")()
        for i, r in enumerate(d.groupBy("k", "times").count().orderBy("k", "times").collect()):
            part = d.where((F.col("k") == r["k"]) & (F.col("times") == r["times"])).coalesce(math.ceil(2 * r["count"] / CELLS_A_TASK))
            points = impl.TreePoint.convertToTreeRDD(self._instances(est, part), self.splits, self.metadata)
            drawn.append(impl.BaggedPoint.convertToBaggedRDD(points, float(r["times"] << r["k"]), est.getNumTrees(), True, once,
                                                             est.getSeed() + 1_000_003 * i))
        bagged = reduce(lambda a, b: a.union(b), drawn)
        bagged = bagged.persist(self.jvm.org.apache.spark.storage.StorageLevel.MEMORY_AND_DISK())
        none, candidates = self.jvm.scala.Option.empty(), self.jsc.broadcast(self.splits)
        try:
            grown = impl.RandomForest.runBagged(bagged, self.metadata, candidates, self.strategy, est.getNumTrees(),
                                                est.getFeatureSubsetStrategy(), est.getSeed(), none, True, none,
                                                getattr(impl.RandomForest, "runBagged$default$11")())
        finally:
            bagged.unpersist(False)
            candidates.destroy()
        kind = self.jvm.org.apache.spark.ml.classification
        trees = self._array(kind.DecisionTreeClassificationModel, list(grown))
        old = kind.RandomForestClassificationModel(est.uid, trees, len(self.edges), self.n_classes)
        return est._copyValues(RandomForestClassificationModel(old))
