"""The operators under the names that users of linear-referencing libraries know."""
import json

from pyspark.sql import DataFrame, SparkSession

from .functions.mappings import get_lanes, hsd_to_side, lane_to_side, link_category, route_change, route_description, rurality, surf_id, surf_type  # noqa: F401
from .functions.stats import deteriorate, first, last, most_common, q75, q90, q95  # noqa: F401
from .functions.steps import as_metres, fixed_steps, linspace_steps  # noqa: F401
from .operators.homogeneous import best_bisection as optimal_bisections  # noqa: F401
from .operators.homogeneous import cumulative_p, cumulative_q, mcv, shs  # noqa: F401
from .operators.merge import backend, on_intervals, on_slk_intervals  # noqa: F401
from .operators.reshape import cway_to_side, get_segments, interval_merge, lane_side_split, lane_to_col, lane_to_row, make_segments, segments_of_intervals, stretch, wide_lanes_to_row  # noqa: F401
from .operators.segments import check_disjoint, check_linear_index, check_monotonic, check_no_reversed, cross_sections, cross_sections_normalised, longest_overlap, overlay, segment_ids, split_to_max_length  # noqa: F401
from .performance import configure_performance_logger  # noqa: F401
from .sources.arcgis import ArcGISDataSource

on_slk_intervals_auto = on_slk_intervals_optimized = on_slk_intervals_fallback = on_slk_intervals_legacy = on_slk_intervals
segment_ids_to_maximize_spatial_heterogeneity, segment_ids_to_minimize_coefficient_of_variation = shs, mcv
split_rows_by_segmentation, split_rows_by_category_to_max_segment_length = overlay, split_to_max_length
check_no_reversed_segments, check_monotonically_increasing_segments = check_no_reversed, check_monotonic
check_linear_index_is_ordered_and_disjoint = check_disjoint


def segment_by_categories_and_slk_discontinuities(data: DataFrame, categories: list[str], measure_slk, out: str = "segment_id") -> DataFrame:
    return segment_ids(data, categories, measure_slk, None, out)


def segment_by_categories_and_slk_true_discontinuities(data: DataFrame, categories: list[str], measure_slk, measure_true, out: str = "segment_id") -> DataFrame:
    return segment_ids(data, categories, measure_slk, measure_true, out)


def fetch_road_network_info(spark: SparkSession, url: str, chunk_limit: int = 1000, query_params: dict | None = None, additional_params: dict | None = None, request_timeout: float = 30.0, columns: list[str] | None = None, **kwargs) -> DataFrame:
    """The network table of an ArcGIS layer, read by offset ranges in parallel; columns (["*"] for all) override outFields.

    Turns on Spark's filter pushdown for Python sources, so that filters narrow the requests.
    """
    spark.dataSource.register(ArcGISDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"url": url, "chunk_limit": chunk_limit, "request_timeout": request_timeout, "additional_params": json.dumps((additional_params or {}) | kwargs)}
    if query_params is not None:
        options["query_params"] = json.dumps(query_params)
    if columns:
        options["columns"] = ",".join(columns)
    return spark.read.format("arcgis").options(**options).load()
