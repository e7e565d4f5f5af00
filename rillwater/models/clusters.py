"""Groups of stations with similar basins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwater.operators.cleaning import existing
from rillwater.operators.ordering import first_per_key
from rillwater.operators.scaling import standardize
from rillwater.plans.keep import cached


def station_clusters(basins: DataFrame, k: int, features: Sequence[str],
                     station: str = "station_code", seed: int = 42) -> DataFrame:
    """(station, cluster_id) by k-means on standardised, complete basin rows.

    Cluster numbers follow the sorted centres, so they do not depend on the order
    in which the algorithm finds them.
    """
    features = existing(basins, features)
    one = first_per_key(basins.select(station, *features), [station], features)
    # One row per station, read by every iteration.
    complete = cached(one.dropna(subset=features))
    if complete.isEmpty():
        raise ValueError("no station has all basin features")
    scaled = standardize(complete, features)
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(scaled)
    model = KMeans(k=k, seed=seed, initMode="k-means||").fit(vectors)
    order = sorted(range(len(model.clusterCenters())),
                   key=lambda i: tuple(model.clusterCenters()[i]))
    number = F.lit(None).cast("int")
    for new, old in enumerate(order):
        number = F.when(F.col("prediction") == old, F.lit(new)).otherwise(number)
    return model.transform(vectors).select(station, number.alias("cluster_id"))
