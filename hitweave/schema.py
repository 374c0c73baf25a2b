"""The fixed input schemas and the settings of the three served pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import FloatType, LongType, StructField, StructType

# Column names in model order.
HIT_COLUMNS = [
    "r", "phi", "z", "cluster_x_1", "cluster_y_1", "cluster_z_1", "cluster_x_2", "cluster_y_2", "cluster_z_2", "count_1", "charge_count_1",
    "loc_eta_1", "loc_phi_1", "localDir0_1", "localDir1_1", "localDir2_1", "lengthDir0_1", "lengthDir1_1", "lengthDir2_1", "glob_eta_1", "glob_phi_1",
    "eta_angle_1", "phi_angle_1", "count_2", "charge_count_2", "loc_eta_2", "loc_phi_2", "localDir0_2", "localDir1_2", "localDir2_2", "lengthDir0_2",
    "lengthDir1_2", "lengthDir2_2", "glob_eta_2", "glob_phi_2", "eta_angle_2", "phi_angle_2", "eta", "cluster_r_1", "cluster_phi_1", "cluster_eta_1",
    "cluster_r_2", "cluster_phi_2", "cluster_eta_2",
]
PIXEL_COLUMNS = [
    "r", "phi", "z", "cluster_x_1", "cluster_y_1", "cluster_z_1", "charge_count_1", "count_1", "loc_eta_1", "loc_phi_1", "glob_eta_1", "glob_phi_1",
    "localDir0_1", "localDir1_1", "localDir2_1",
]
GNN_COLUMNS = [
    "r", "phi", "z", "eta", "cluster_r_1", "cluster_phi_1", "cluster_z_1", "cluster_eta_1", "cluster_r_2", "cluster_phi_2", "cluster_z_2",
    "cluster_eta_2",
]
# Scales of the stage inputs.
EMBEDDING_SCALES = [1000, 3.14, 1000, 1000, 1000, 1000, 1000, 1000, 1000, 1, 1, 3.14, 3.14, 1, 1, 1, 1, 1, 1, 3.14, 3.14, 3.14, 3.14, 1, 1, 3.14, 3.14, 1, 1, 1, 1, 1, 1, 3.14, 3.14, 3.14, 3.14]
GNN_SCALES = [1000.0, 3.14159265359, 1000.0, 1.0, 1000.0, 3.14159265359, 1000.0, 1.0, 1000.0, 3.14159265359, 1000.0, 1.0]
PIXEL_SCALES = [300, 3.15, 3000, 300, 300, 3000, 30, 20, -2, 1.5, 2, 3.15, 1, 1, 1]


def hits_schema(columns=HIT_COLUMNS) -> StructType:
    return StructType([StructField("event_id", LongType()), StructField("hit_id", LongType()), *(StructField(c, FloatType()) for c in columns)])


@dataclass(frozen=True)
class StageSpec:
    """Input columns of a model and what each is divided by."""

    features: tuple[str, ...]
    scales: tuple[float, ...]

    def __post_init__(self):
        if len(self.features) != len(self.scales):
            raise ValueError(f"{len(self.features)} features but {len(self.scales)} scales")
        if 0 in self.scales:
            raise ValueError("a scale is zero")

    @classmethod
    def parse(cls, features: str, scales: str) -> StageSpec:
        """From comma-separated names and numbers."""
        return cls(tuple(x.strip() for x in features.split(",")), tuple(float(x) for x in scales.split(",")))


@dataclass(frozen=True)
class PipelineConfig:
    """Cuts and choices of a pipeline."""

    r_max: float
    k_max: int
    filter_cut: float
    cc_cut: float = 0.01
    walk_min: float = 0.1
    walk_max: float = 0.6
    embedding: StageSpec = StageSpec(tuple(HIT_COLUMNS[:37]), tuple(EMBEDDING_SCALES))
    gnn: StageSpec = StageSpec(tuple(GNN_COLUMNS), tuple(GNN_SCALES))
    two_embeddings: bool = False
    cluster_gnn: bool = False
    strict_filter: bool = False
    clean: bool = True
    scaled_radius: bool = False
    break_ties: bool = True
    walk: str = "lookback"
    allow_node_reuse: bool = False
    sort_tracks: bool = True


PIXEL = StageSpec(tuple(PIXEL_COLUMNS), tuple(PIXEL_SCALES))
PRESETS = {
    "pixel_v1": PipelineConfig(0.1, 300, 0.2, embedding=PIXEL, gnn=PIXEL, strict_filter=True, clean=False, scaled_radius=True, break_ties=False, walk="road", sort_tracks=False),
    "pixel": PipelineConfig(0.11, 300, 0.2, embedding=PIXEL, gnn=PIXEL, clean=False, scaled_radius=True, break_ties=False, walk="longest", allow_node_reuse=True, sort_tracks=False),
    "pixel_v2": PipelineConfig(0.11, 300, 0.2, embedding=PIXEL, cluster_gnn=True, clean=False, scaled_radius=True, break_ties=False, walk="longest", allow_node_reuse=True, sort_tracks=False),
    "metric_v1": PipelineConfig(0.12, 1000, 0.05, clean=False, break_ties=False, walk="road", sort_tracks=False),
    "metric_v2": PipelineConfig(0.12, 1000, 0.05, walk="longest"),
    "metric_v3": PipelineConfig(0.12, 1000, 0.05, walk="level"),
    "metric_v4": PipelineConfig(0.12, 1000, 0.05),
    "double_v1": PipelineConfig(0.14, 1000, 0.05, two_embeddings=True),
    "double_v3": PipelineConfig(0.14, 1000, 0.01, two_embeddings=True),
    "double_v3_dp": PipelineConfig(0.14, 1000, 0.01, two_embeddings=True, walk="dp"),
}
