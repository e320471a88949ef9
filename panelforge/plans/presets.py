"""Column roles and fixed recodes of the three workloads.

Fixed values: the names, tokens and codes below belong to the input files and must stay as
they are for the results to match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelforge.functions.recode import replace_tokens
from panelforge.functions.scalars import band_bounds
from panelforge.operators.columns import product
from panelforge.operators.impute import FillPolicy

# ------------------------------------------------------------------- vehicle sales records

# Dirty token -> clean value.
LEVEL_TOKENS = {"-": 6}
FUEL_TOKENS = {"-": 1}
POWER_TOKENS = {"81/70": 81}
TORQUE_TOKENS = {"155/140": 155, "-": 73}
PASSENGER_TOKENS = {"4-5": 5, "5-7": 7, "6-7": 7, "5-8": 8, "6-8": 8, "7-8": 8}
GEAR_TOKENS = {"8;7": 7, "5;4": 5}
GEARBOX_TOKENS = {"AT;DCT": "AT", "MT;AT": "MT"}

# Price band -> ordinal code.
PRICE_LEVEL_CODES = {
    "5WL": 1,
    "5-8W": 2,
    "8-10W": 3,
    "10-15W": 4,
    "15-20W": 5,
    "20-25W": 6,
    "25-35W": 7,
    "35-50W": 8,
    "50-75W": 9,
}

# The column roles of the sales file.
VEHICLE_KEYS = ["sale_date", "class_id"]
VEHICLE_TARGET = "sale_quantity"
VEHICLE_CATEGORIES = [
    "brand_id", "type_id", "level_id", "department_id", "TR", "gearbox_type", "if_charging",
    "driven_type_id", "fuel_type_id", "newenergy_type_id", "emission_standards_id", "if_MPV_id",
    "if_luxurious_id",
]
VEHICLE_MEASURES = [
    "compartment", "displacement", "power", "cylinder_number", "engine_torque", "car_length",
    "car_width", "car_height", "total_quality", "equipment_quality", "rated_passenger",
    "wheelbase", "front_track", "rear_track",
]
VEHICLE_CLEANING = {
    "level_id": (LEVEL_TOKENS, "int"),
    "fuel_type_id": (FUEL_TOKENS, "int"),
    "power": (POWER_TOKENS, "double"),
    "engine_torque": (TORQUE_TOKENS, "double"),
    "rated_passenger": (PASSENGER_TOKENS, "int"),
    "TR": (GEAR_TOKENS, "int"),
    "gearbox_type": (GEARBOX_TOKENS, "string"),
}


def clean_vehicle_columns(df: DataFrame) -> DataFrame:
    """Apply the token fixes to whichever of those columns the table has."""
    return df.withColumns(
        {
            c: replace_tokens(c, tokens, kind)
            for c, (tokens, kind) in VEHICLE_CLEANING.items()
            if c in df.columns
        }
    )


def add_price_bounds(df: DataFrame, band: str = "price_level") -> DataFrame:
    return df.withColumns({f"{band}_{n}": c for n, c in band_bounds(band).items()})


def add_car_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("car_volume", product("car_length", "car_width", "car_height", scale=1e6))


# ------------------------------------------------------------------------- medical claims

# Column names of the claims files.
CLAIMS_VISIT, CLAIMS_PERSON, CLAIMS_VENUE = "顺序号", "个人编码", "医院编码"
CLAIMS_DAY, CLAIMS_TEXT = "交易时间", "出院诊断病种名称"
CLAIMS_SPECIAL, CLAIMS_REGISTRATION = "门特", "挂号"
FEE_DAY, FEE_PRICE, FEE_QUANTITY = "费用发生时间", "单价", "数量"
FEE_CODE, FEE_FORM = "三目统计项目", "剂型"

# The column ranges and columns left out of the claims features.
CLAIMS_DROP_RANGES = [
    ("手术费自费金额", "手术费申报金额"),
    ("床位费拒付金额", "床位费申报金额"),
    ("医用材料费拒付金额", "成分输血申报金额"),
    ("其它拒付金额", "起付线标准金额"),
    ("补助审批金额", "家床起付线剩余"),
]
CLAIMS_DROP_COLUMNS = [
    "医疗救助个人按比例负担金额",
    "最高限额以上金额",
    "公务员医疗补助基金支付金额",
    "城乡救助补助金额",
]

# Ratio name -> (numerator, denominator), both sums per person.
CLAIMS_RATIOS = {
    "药品费申报比例": ("药品费申报金额", "药品费发生金额"),
    "中草药费申报比例": ("中草药费发生金额", "药品费发生金额"),
    "中成药费申报比例": ("中成药费发生金额", "药品费发生金额"),
    "贵重药品申报比例": ("贵重药品发生金额", "药品费发生金额"),
    "药品自费比例": ("药品费自费金额", "药品费发生金额"),
    "贵重检查费申报比例": ("贵重检查费金额", "检查费发生金额"),
    "检查费自费申报比例": ("检查费自费金额", "检查费发生金额"),
    "检查费申报比例": ("检查费申报金额", "检查费发生金额"),
    "治疗费申报比例": ("治疗费申报金额", "治疗费发生金额"),
    "治疗费自费比例": ("治疗费自费金额", "治疗费发生金额"),
    "药品费审批比例": ("药品费申报金额", "本次审批金额"),
    "检查费审批比例": ("检查费申报金额", "本次审批金额"),
    "治疗费审批比例": ("治疗费申报金额", "本次审批金额"),
    "中草药费审批比例": ("中草药费发生金额", "本次审批金额"),
    "中成药费审批比例": ("中成药费发生金额", "本次审批金额"),
}
CLAIMS_TOTAL = "总消费"
CLAIMS_TOTAL_OF = [
    "药品费发生金额", "检查费发生金额", "治疗费发生金额", "手术费发生金额", "医用材料发生金额",
    "其它发生金额",
]
CLAIMS_SHARES = {
    "自负金额总消费比例": "起付标准以上自负比例金额",
    "非账户支付总消费比例": "非账户支付金额",
}
CLAIMS_FUND = "基本医疗保险统筹基金支付金额"
CLAIMS_ACCOUNT, CLAIMS_OFF_ACCOUNT = "基本医疗保险个人账户支付金额", "非账户支付金额"
CLAIMS_PAID, CLAIMS_OFF_FUND = "总支付金额", "非统筹金额支付率"
CLAIMS_CELL_MEASURES = [
    "药品费发生金额", "检查费发生金额", "治疗费发生金额", "其它发生金额", "贵重药品发生金额",
    "中成药费发生金额", "起付标准以上自负比例金额", "基本医疗保险统筹基金支付金额",
    "可用账户报销金额", "非账户支付金额", "本次审批金额",
]
CLAIMS_GAP_MEAN, CLAIMS_GAP_STD = "交易平均周期", "交易间隔方差"

# --------------------------------------------------------------------------- house prices

# How each house column is filled.
HOUSE_NONE = [
    "PoolQC", "MiscFeature", "Alley", "Fence", "FireplaceQu", "GarageType", "GarageFinish",
    "GarageQual", "GarageCond", "BsmtQual", "BsmtCond", "BsmtExposure", "BsmtFinType1",
    "BsmtFinType2", "MasVnrType", "MSSubClass",
]
HOUSE_ZERO = [
    "GarageYrBlt", "GarageArea", "GarageCars", "BsmtFinSF1", "BsmtFinSF2", "BsmtUnfSF",
    "TotalBsmtSF", "BsmtFullBath", "BsmtHalfBath", "MasVnrArea",
]
HOUSE_MODE = ["MSZoning", "Electrical", "KitchenQual", "Exterior1st", "Exterior2nd", "SaleType"]
HOUSE_POLICY = FillPolicy(
    constant={**{c: "None" for c in HOUSE_NONE}, **{c: 0 for c in HOUSE_ZERO}, "Functional": "Typ"},
    mode=HOUSE_MODE,
    group_median={"LotFrontage": "Neighborhood"},
    drop=["Utilities"],
)

# House columns that are categories although they hold numbers.
HOUSE_AS_TEXT = ["MSSubClass", "OverallCond", "YrSold", "MoSold"]

# House columns coded by the sorted place of their value.
HOUSE_CODED = [
    "FireplaceQu", "BsmtQual", "BsmtCond", "GarageQual", "GarageCond", "ExterQual", "ExterCond",
    "HeatingQC", "PoolQC", "KitchenQual", "BsmtFinType1", "BsmtFinType2", "Functional", "Fence",
    "BsmtExposure", "GarageFinish", "LandSlope", "LotShape", "PavedDrive", "Street", "Alley",
    "CentralAir", "MSSubClass", "OverallCond", "YrSold", "MoSold",
]
HOUSE_TOTAL_AREA = ["TotalBsmtSF", "1stFlrSF", "2ndFlrSF"]
HOUSE_TARGET = "SalePrice"
HOUSE_OUTLIER_AREA, HOUSE_OUTLIER_PRICE = 4000, 300000
BLEND_WEIGHTS = (0.70, 0.15, 0.15)

# Settings of ``KernelRidge`` for vehicles.
VEHICLE_KERNEL = {"alpha": 359.38136, "degree": 1.1288, "coef0": 12.9155}

# Settings of ``second_order_boosting`` and ``leaf_wise_boosting`` for vehicles and houses.
VEHICLE_SECOND_ORDER = {
    "trees": 2200, "rate": 0.0373, "depth": 3, "row_share": 0.71268, "feature_share": 1.0, "min_curvature": 1.05,
    "min_gain": 13.895, "l1": 0.37276, "l2": 1.63789, "seed": 7,
}
VEHICLE_LEAF_WISE = {
    "trees": 800, "rate": 0.33598, "leaves": 5, "bins": 55, "row_share": 0.8, "bagging_interval": 5, "feature_share": 1.0,
    "leaf_rows": 6, "min_curvature": 11.0, "seed": 9,
}
HOUSE_SECOND_ORDER = {
    "trees": 2200, "rate": 0.05, "depth": 3, "row_share": 0.5213, "feature_share": 0.4603, "min_curvature": 1.7817,
    "min_gain": 0.0468, "l1": 0.4640, "l2": 0.8571, "seed": 7,
}
HOUSE_LEAF_WISE = {
    "trees": 720, "rate": 0.05, "leaves": 5, "bins": 55, "row_share": 0.8, "bagging_interval": 5, "feature_share": 0.2319,
    "leaf_rows": 6, "min_curvature": 11.0, "seed": 9,
}
