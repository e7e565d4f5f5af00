"""Column roles, experiment settings and the fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# These must equal the values the monitoring programme uses.

# Texts that mean "no value" in laboratory sheets.
NULL_SENTINELS = ("N/D", "s/d", "S/D", "-", " ", "")

# Station-code prefixes and their basin; the first matching line wins.
BASIN_PREFIXES = (
    ("MO", "Arroyo Molino"),
    ("AMO", "Arroyo Molino"),
    ("LR", "Arroyo Molino"),
    ("P", "Arroyo Pantanoso"),
    ("LP", "Arroyo Las Piedras"),
    ("M", "Arroyo Miguelete"),
    ("MN", "Arroyo Carrasco"),
    ("TO", "Arroyo Carrasco"),
    ("CDCH", "Arroyo Carrasco"),
    ("CDCN", "Arroyo Carrasco"),
    ("CA", "Arroyo Carrasco"),
    ("99", "Sin Clasificar"),
    ("999", "Sin Clasificar"),
)
OTHER_BASIN = "Otras Cuencas"

# Stations without basin attributes of their own: (station, station it copies).
INHERITED_STATIONS = (
    ("AMO0", "MO1"),
    ("AMO1", "MO1"),
    ("AMO2", "MO1"),
    ("LR1", "MO1"),
    ("LR2", "MO1"),
    ("LR3", "MO1"),
)

# Feature groups.
WATER_FEATURES = (
    "temp_cent", "ph_field", "conductivity", "dissolve_oxygen_field", "dbo", "dqo",
    "amonio_field", "total_p", "total_n", "ssv", "sst", "total_s", "per_oxida",
    "tensoactivo", "nh3", "plomo", "cromo", "isca",
)
RAIN_FEATURES = ("precipitacion_promedio_mm", "prec_acum_3d", "prec_acum_7d", "prec_media_7d")
BASIN_FEATURES = (
    "basin_area_a", "mean_slope_of_the_basin_degrees", "drainage_density_dd",
    "time_of_concentration_-_kirpich_tc", "main_channel_sinuosity", "ruggedness_number_rn",
)
SEASONAL_FEATURES = ("seasonal_sin", "seasonal_cos")
TEMP_FEATURES = ("temp_ambiente_promedio", "temp_media_3d", "temp_media_7d", "temp_media_14d")
SOLAR_FEATURES = ("horas_sol",)

# Metric columns of a fold result, in report order.
SCORE_COLUMNS = ("R2_log", "RMSE_log", "PBIAS_log", "NSE_log")
TIME_COLUMN = "training_time_secs"

# Label of results that do not belong to a cluster.
GENERAL_LABEL = "General"
CLUSTER_LABEL = "Por Cluster"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Roles:
    """Which column plays which part in a sample table."""

    station: str = "station_code"
    basin: str = "basin"
    date: str = "date"
    target: str = "coliformes_fecales"
    features: tuple[str, ...] = WATER_FEATURES
    # Columns that, with date and station, put samples in one defined order.
    sample_key: tuple[str, ...] = ()

    @property
    def metadata(self) -> tuple[str, str, str]:
        return (self.station, self.basin, self.date)

    @property
    def sample_order(self) -> tuple[str, ...]:
        return (self.date, self.station, *self.sample_key)


@dataclass(frozen=True)
class RobustFilterParams:
    min_samples_target: int
    completeness_global: float
    completeness_station: float
    k_min_features: int


@dataclass(frozen=True)
class Experiment:
    """One modelling run: what to fit, on which rows, and how to judge it."""

    id: str
    model_name: str
    feature_set: tuple[str, ...]
    hyperparameters: dict = field(default_factory=dict)
    search: str | None = None  # None | "grid" | "random"
    param_grid: dict = field(default_factory=dict)
    search_space: dict = field(default_factory=dict)
    n_trials: int = 50
    time_series_splits: int = 5
    min_station_samples: int = 0
    n_clusters: int | None = None
    cluster_features: tuple[str, ...] = BASIN_FEATURES
    min_rows: int = 20
    original_id: str | None = None
    validation_strategy: str = "time_series_cv"

    @property
    def base_id(self) -> str:
        return self.original_id or self.id

    def for_cluster(self, cluster_id: int) -> "Experiment":
        return replace(self, id=f"{self.id}_cluster{cluster_id}", original_id=self.base_id,
                       n_clusters=None)

    def as_validation(self, best: dict) -> "Experiment":
        return replace(self, id=f"{self.id}_VALIDATION", original_id=f"{self.base_id}_VALIDATION",
                       hyperparameters=dict(best), search=None, param_grid={}, search_space={})
