"""Code books and other fixed values."""

from __future__ import annotations

from pyspark.sql import Column

# ---- Fixed values: land-cover codes, 0 means missing, any other code is "Other".
CROP_BY_CODE = {1: "Corn", 2: "Cotton", 3: "Rice", 5: "Soybeans", 92: "Fish Culture"}
MISSING_CODE = 0
OTHER_CROP = "Other"

# ---- Fixed values: crops that carry a monthly profile and take part in modelling.
MODEL_CROPS = ("Rice", "Fish Culture", "Soybeans", "Corn", "Cotton")

# ---- Fixed values: crops whose predictions are averaged for cells of class "Other".
OTHER_VARIANTS = ("Rice", "Corn", "Cotton", "Soybeans")

# ---- Fixed values: crop coefficient by crop.
CROP_COEFFICIENT = {
    "Corn": 1.2,
    "Cotton": 1.2,
    "Rice": 1.2,
    "Soybeans": 1.15,
    "Fish Culture": 0.0,
    "Peanuts": 1.15,
    "Other": 1.0,
}

# ---- Fixed values: most water a crop can use in a year, in feet.
YEARLY_LIMIT = {"Rice": 8.0, "Fish Culture": 10.0, "Soybeans": 5.0, "Corn": 5.0, "Cotton": 5.0}

# ---- Fixed values: substring of a reported crop -> crop, tried in this order.
CROP_BY_SUBSTRING = {
    "fish": "Fish Culture",
    "duck": "Fish Culture",
    "flood": "Fish Culture",
    "wild": "Fish Culture",
    "rice": "Rice",
    "corn": "Corn",
    "cotton": "Cotton",
    "soybeans": "Soybeans",
}

# ---- Fixed values: infiltration rate (mm/h) by soil group, dual groups fold onto 1..4.
INFILTRATION_BY_GROUP = {1: 7.62, 2: 5.715, 3: 2.54, 4: 0.635, -9999: 4.1275}

# ---- Fixed values: mean monthly use by crop, January to December, None = no use recorded.
MONTHLY_PROFILE = {
    "Corn": [None, None, None, 1e-10, 0.480943768, 2.935120885, 2.959187198, 1.81353687, 0.285195862, None, None, None],
    "Cotton": [None, None, None, 1e-10, 0.147144869, 0.106776469, 2.048001153, 1.889042786, 1.1928, None, None, None],
    "Rice": [None, None, None, 1e-10, 2.634713034, 6.896929037, 7.547371072, 8.337695059, 3.684132039, None, None, None],
    "Soybeans": [None, None, None, 1.81364e-06, 9.30566e-07, 1.136553566, 3.515970684, 3.381447538, 2.018117186, None, None, None],
}

# ---- Fixed values: growing season, and the one crop reported all year round.
GROWING_MONTHS = (4, 5, 6, 7, 8, 9)
YEAR_ROUND_CROP = "Fish Culture"

# ---- Fixed values: evapotranspiration products that get a crop-relative column.
ET_PRODUCTS = ("SSEBop", "MOD16", "PT-JPL", "SIMS", "OpenET", "EEMETRIC")

# ---- Fixed values: unit conversions.
FEET_TO_MM = 304.8
INCH_TO_MM = 25.4
MM_TO_M3_PER_HECTARE_CELL = 10.0
MM_PER_KM2_TO_COMPARISON = 2.471 * 4.047

# ---- Fixed values: nodata sentinel of written grids, and the smallest 1 km sum kept.
NODATA = -32767.0
COARSE_MINIMUM = 0.5

# ---- Fixed values: land-cover correction. Pond classes become aquaculture; rice and
# aquaculture are kept even where the irrigation mask is empty.
POND_CODES = (111, 83)
AQUACULTURE_CODE = 92
ALWAYS_IRRIGATED_CODES = (3, 92)

# ---- Fixed values: remote products as (dataset, collection, band, reducer, scale, collection from April 2015).
REMOTE_PRODUCTS = [
    ("MOD16", "MODIS/006/MOD16A2", "ET", "sum", 0.1, None),
    ("SM_IDAHO", "IDAHO_EPSCOR/TERRACLIMATE", "soil", "first", 0.1, None),
    ("SMOS_SMAP", "NASA_USDA/HSL/soil_moisture", "ssm", "last_minus_first", 1.0, "NASA_USDA/HSL/SMAP10KM_soil_moisture"),
    ("DROUGHT", "GRIDMET/DROUGHT", "pdsi", "mean", 1.0, None),
    ("PPT", "OREGONSTATE/PRISM/AN81m", "ppt", "sum", 1.0, None),
    ("TMIN", "OREGONSTATE/PRISM/AN81m", "tmin", "median", 1.0, None),
    ("TMAX", "OREGONSTATE/PRISM/AN81m", "tmax", "median", 1.0, None),
    ("WS", "IDAHO_EPSCOR/TERRACLIMATE", "vs", "mean", 0.01, None),
    ("RO", "IDAHO_EPSCOR/TERRACLIMATE", "ro", "sum", 1.0, None),
    ("DEF_SMAP", "NASA_USDA/HSL/soil_moisture", "ssm", "et_minus_soil", 1.0, "NASA_USDA/HSL/SMAP10KM_soil_moisture"),
    ("DEF", "IDAHO_EPSCOR/TERRACLIMATE", "def", "sum", 0.1, None),
    ("VPD", "IDAHO_EPSCOR/GRIDMET", "vpd", "sum", 1.0, None),
    ("SPH", "IDAHO_EPSCOR/GRIDMET", "sph", "mean", 1.0, None),
    ("NDWI", "LANDSAT/LC08/C01/T1_8DAY_NDWI", "NDWI", "mean", 1.0, None),
    ("NDVI", "LANDSAT/LC08/C01/T1_8DAY_NDVI", "NDVI", "mean", 1.0, None),
]

# ---- Fixed values: the products a deficit is made from (evapotranspiration, soil moisture), and the
# first month of the later collections.
DEFICIT_SOURCES = {"DEF_SMAP": ("MOD16", "SMOS_SMAP")}
LATER_COLLECTION_FROM = (2015, 4)

# ---- Fixed values: products that are not fetched remotely, as (dataset, family, temporal).
LOCAL_PRODUCTS = [
    ("SSEBop", "et", "monthly"),
    ("OpenET", "et", "monthly"),
    ("ppt", "climate", "monthly"),
    ("tmin", "climate", "monthly"),
    ("tmax", "climate", "monthly"),
    ("tmean", "climate", "monthly"),
    ("CDL", "land_cover", "yearly"),
    ("SWB_HSG", "soil_water", "static"),
    ("SWB_AWC", "soil_water", "static"),
    ("SWB_MRD", "soil_water", "yearly"),
    ("SWB_SSM", "soil_water", "yearly"),
    ("SWB_ET", "soil_water", "daily"),
    ("SWB_PPT", "soil_water", "daily"),
    ("SWB_INT", "soil_water", "daily"),
    ("SWB_IRR", "soil_water", "daily"),
    ("SWB_INF", "soil_water", "daily"),
    ("SWB_RINF", "soil_water", "daily"),
    ("SWB_RO", "soil_water", "daily"),
    ("SWB_SS", "soil_water", "daily"),
]

# ---- Fixed values: soil-water products averaged (not summed) over a month.
DAILY_MEAN_PRODUCTS = ("SWB_RO", "SWB_SS")

# ---- Fixed values: product used in place of another before its first year.
FALLBACK_PRODUCTS = {"OpenET": ("SSEBop", 2016)}


def temporal_kind(dataset: str) -> str:
    """How a product's cells are keyed once composited: static, yearly or monthly."""
    kinds = {name: kind for name, _, kind in LOCAL_PRODUCTS}
    kind = kinds.get(dataset, "monthly")
    return "monthly" if kind == "daily" else kind


def known_products() -> tuple[str, ...]:
    return tuple(p[0] for p in REMOTE_PRODUCTS) + tuple(p[0] for p in LOCAL_PRODUCTS)


def in_later_collection(year: Column, month: Column) -> Column:
    """Whether a month's own date falls to the later collections."""
    first_year, first_month = LATER_COLLECTION_FROM
    return (year > first_year) | ((year == first_year) & (month >= first_month))
