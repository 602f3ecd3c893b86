import re

from spanline import names


def test_names_resolve():
    for n in ("on_slk_intervals_auto", "split_rows_by_segmentation", "segment_by_categories_and_slk_discontinuities", "fetch_road_network_info", "segment_ids_to_maximize_spatial_heterogeneity"):
        assert callable(getattr(names, n)) and re.fullmatch(r"\w+", n)
    assert names.backend() == "spark"
