"""Lookup columns; unknown keys give null."""
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain: lane codes, surfaces, pavements, regions, routes.
LANES = ["L1", "L2", "L3", "L4", "L5", "L6", "R1", "R2", "R3", "R4", "R5", "LL1", "LL2", "LL3", "LR1", "LR2", "LR3", "RL1", "RL2", "RL3", "RR1", "RR2", "RR3", "LO", "RO", "L", "R"]
LANE_LABELS = ["Left lane 1", "Left lane 2", "Left lane 3", "Left lane 4", "Left lane 5", "Left lane 6", "Right lane 1", "Right lane 2", "Right lane 3", "Right lane 4", "Right lane 5", "Left carriageway, left turn pocket 1", "Left carriageway, left turn pocket 2", "Left carriageway, left turn pocket 3", "Left carriageway, right turn pocket 1", "Left carriageway, right turn pocket 2", "Left carriageway, right turn pocket 3", "Right carriageway, left turn pocket 1", "Right carriageway, left turn pocket 2", "Right carriageway, left turn pocket 3", "Right carriageway, right turn pocket 1", "Right carriageway, right turn pocket 2", "Right carriageway, right turn pocket 3", "Left overtaking lane", "Right overtaking lane", "Left shoulder", "Right shoulder"]
DTIMS = [1, 3, 5, 7, 9, 11, 2, 4, 6, 8, 10, 21, 23, 25, 31, 33, 35, 22, 24, 26, 32, 34, 36, 41, 42, 51, 52]
SURFACE_NAMES = {1: "Asphalt Dense Graded", 2: "Asphalt Intersection Mix", 3: "Asphalt Open Graded", 4: "Concrete", 5: "Paving", 6: "Primer Seal", 7: "Rubberised Seal", 8: "Slurry Seal", 9: "Single Seal", 10: "Two Coat Seal", 11: "Asphalt Stone Mastic", 12: "Asphalt Open Graded on Dense Graded", 13: "Asphalt Gap Graded Rubberised (GGAR)"}
SURFACES = {
    "full": ["Asphalt Dense Graded", "Asphalt Intersection Mix", "Asphalt Open Graded", "Concrete", "Paving", "Primer Seal", "Rubberised Seal", "Single Seal", "Slurry Seal", "Two Coat Seal", "Asphalt Stone Mastic", "Asphalt Open Graded on Dense Graded", "Asphalt Gap Graded Rubberised (GGAR)"],
    "short": ["DGA", "IMA", "OGA", "Concrete", "Paving", "Primer Seal", "Rubberised Seal", "Single Seal", "Slurry Seal", "Two Coat Seal", "SMA", "OGA on DGA", "GGAR"],
    "asphalt": ["DGA", "IMA", "OGA", "Other", "Other", "Seal", "Seal", "Seal", "Seal", "Seal", "SMA", "OGA on DGA", "GGAR"],
    "grouped": ["Asphalt", "Asphalt", "Asphalt", "Other", "Other", "Seal", "Seal", "Seal", "Seal", "Seal", "Asphalt", "Asphalt", "Asphalt"],
    "group_id": [1, 1, 1, 2, 2, 3, 3, 3, 3, 3, 1, 1, 1],
}
PAVEMENTS = {0: "Unknown", 1: "Sand Clay", 2: "Gravel", 3: "Crushed Rock", 4: "Sand", 5: "Clay", 6: "Concrete", 7: "Limestone", 8: "Recycled Material", 9: "HCT", 10: "Asphalt", 11: "Ferricrete"}
REGIONS = {1: "Great Southern", 2: "South West", 5: "Goldfields - Esperance", 6: "Kimberley", 7: "Metropolitan", 8: "Wheatbelt", 11: "Pilbara", 14: "Mid West-Gascoyne"}
OLD_ROUTES = [1.1, 2.1, 3.1, 2.2, 5.1, 6.1, 7.1, 8.1, 9.1, 10.1, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0, 18.0, 19.0, 20.0, 21.0, 22.0, 23.0, 24.0]
ROUTE_LABELS = ["Perth to Adelaide", " Perth to Darwin", " Perth to Bunbury", "Perth to Port Hedland", " Perth to Albany", " Bunbury to Albany", "Geraldton to Esperance", " Perth to Esperance", "Bunbury to Augusta", "Albany to Esperance", "Bindoon (H006) to Dongara (H004) ", "Manjimup to Albany", "Nanutarra to GNH", "Paraburdoo to GNH", "Derby to GNH", "Newman to Port Hedland", "Albany to Lake Grace", "Perth to Merredin ", "Bunbury to Lake King", "Minilya (NWCH) to Exmouth", "Byford to Coalfields Hwy", "Busselton to SWH via Pembeton", "Donnybrook (SWH) to Kojonup (Aly Hwy)", "Roe Hwy to Toodyay"]
LINK_CATEGORIES = {"MI": "M", "MFF": "M", "AW": "A", "AW+": "A", "BW": "B", "BW+": "B", "CW": "C", "DW": "D"}


def lookup(x: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])[x]


def get_lanes(x: Column, current: str, new: str) -> Column:
    sides = {"xsp": LANES, "lane": LANES, "description": LANE_LABELS, "dtims": DTIMS}
    if current not in sides or new not in sides:
        raise ValueError("current and new must be xsp, lane, description or dtims")
    return lookup(x, dict(zip(sides[current], sides[new])))


def lane_to_side(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, "^([LR])", 1), F.lit(""))


def hsd_to_side(x: Column) -> Column:
    return lookup(x, {"L": "L", "R": "R", "l": "L", "r": "R"})


def surf_type(x: Column, to: str = "short") -> Column:
    if to not in SURFACES:
        raise ValueError(f"to must be one of {sorted(SURFACES)}")
    return lookup(x.cast("int"), dict(zip(range(1, 14), SURFACES[to])))


def surf_id(x: Column, to: str = "short") -> Column:
    """Id of a surface name; of names that several ids share, the last id."""
    return lookup(x, dict(zip(SURFACES[to], range(1, 14))))


def surface_name(x: Column) -> Column:
    return lookup(x.cast("int"), SURFACE_NAMES)


def surface_number(x: Column) -> Column:
    return lookup(x, {v: k for k, v in SURFACE_NAMES.items()})


def pavement_name(x: Column) -> Column:
    return lookup(x.cast("int"), PAVEMENTS)


def pavement_id(x: Column) -> Column:
    return lookup(x, {v: k for k, v in PAVEMENTS.items()})


def region_name(x: Column) -> Column:
    return lookup(x.cast("int"), REGIONS)


def region_number(x: Column) -> Column:
    return lookup(x, {v: k for k, v in REGIONS.items()})


def route_change(x: Column, method: str = "new") -> Column:
    new = {o: k + 1 for k, o in enumerate(OLD_ROUTES)}
    return lookup(x, new if method == "new" else {v: k for k, v in new.items()})


def route_description(x: Column, format: str = "new") -> Column:
    return lookup(x, dict(zip(range(1, 25) if format == "new" else OLD_ROUTES, ROUTE_LABELS)))


def link_category(x: Column) -> Column:
    return lookup(x, LINK_CATEGORIES)


def rurality(region: Column, road: Column, slk: Column) -> Column:
    """Rural outside the metropolitan stretches of the named roads, as evidently meant."""
    far = F.lit(False)
    for r, km in (("H005", 48.5), ("H052", 12.22), ("H001", 35.5), ("H009", 18.54)):
        far = far | ((road == r) & (slk >= km))
    return F.when(((region == 7) & road.isin("M045", "H006", "M026", "M010")) | far, "Rural").otherwise("Metro")
