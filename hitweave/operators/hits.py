"""Hit tables: cleaning, numbering, scaling, the size guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.functions.scalars import cylindrical, finite, pseudorapidity, scaled
from hitweave.operators.numbering import row_numbers
from hitweave.schema import GNN_COLUMNS, StageSpec

MIN_HITS = 3


def clean(hits: DataFrame, columns: list[str]) -> DataFrame:
    """Casts to float and puts 0 for NaN, infinities and nulls."""
    return hits.withColumns({c: finite(F.col(c).cast("float")) for c in columns})


def numbered(hits: DataFrame, *order: str) -> DataFrame:
    """hit_id from 0 in each event, in the given total order."""
    return row_numbers(hits, ["event_id"], list(order), "hit_id")


def large_enough(hits: DataFrame, least: int = MIN_HITS) -> DataFrame:
    """Hits of the events that have at least so many."""
    kept = hits.groupBy("event_id").count().where(F.col("count") >= least).select("event_id")
    return hits.join(kept, "event_id", "left_semi")


def stage_input(hits: DataFrame, spec: StageSpec, *keep: str) -> DataFrame:
    """The keys, kept columns and each feature divided by its scale, in the spec's order."""
    return hits.select("event_id", "hit_id", *keep, *(scaled(F.col(f).cast("double"), s).alias(f) for f, s in zip(spec.features, spec.scales, strict=True)))


def region_override(scaled_hits: DataFrame, columns: list[str] = GNN_COLUMNS, regions: tuple[int, ...] = (2, 6)) -> DataFrame:
    """Where `region` is one of `regions`, the first four GNN columns are repeated three times."""
    if "region" not in scaled_hits.columns:
        return scaled_hits
    return scaled_hits.withColumns({c: F.when(F.col("region").isin(*regions), F.col(columns[i % 4])).otherwise(F.col(c)) for i, c in enumerate(columns)})


def cluster_coordinates(scaled_hits: DataFrame, scales: dict[str, float], cluster: int = 1) -> DataFrame:
    """Adds the cluster's r, phi and eta from its scaled x, y, z; they are not scaled again."""
    x, y, z = (F.col(f"cluster_{c}_{cluster}") * scales[f"cluster_{c}_{cluster}"] for c in "xyz")
    parts: dict[str, Column] = cylindrical(x, y, z)
    return scaled_hits.withColumns({f"cluster_{k}_{cluster}": parts[k] for k in ("r", "phi", "eta")})


def pixel_gnn_input(hits: DataFrame) -> DataFrame:
    """The twelve columns of the graph network from raw pixel hits, which have one cluster.

    r, phi and z are scaled; the cluster's cylindrical coordinates are not, and stand
    in for those of the second cluster too.
    """
    at = lambda c: F.col(c).cast("double")
    own = {"r": at("r") / 1000.0, "phi": at("phi") / 3.15, "z": at("z") / 1000.0, "eta": pseudorapidity(at("r"), at("z"))}
    parts = cylindrical(at("cluster_x_1"), at("cluster_y_1"), at("cluster_z_1"))
    columns = {**own, **{f"cluster_{k}_{i}": parts[k] for i in (1, 2) for k in ("r", "phi", "z", "eta")}}
    return hits.select("event_id", "hit_id", *(columns[c].alias(c) for c in GNN_COLUMNS))
