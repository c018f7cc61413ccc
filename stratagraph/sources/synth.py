"""The demonstration network: species, towers and measures in zones, with weights drawn by hash.

Draws are hash-uniform by id, so a row is the same whatever the partitioning; formulas and sizes are
what results depend on, not the draws. The literals are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratagraph.functions.columns import uniform

SEASONS = ["spring", "summer", "autumn", "winter"]
#: id, Chinese name, danger rank, conservation status, abundance, presence in spring, summer, autumn, winter, habitat
SPECIES = [
    ("black_necked_crane", "黑颈鹤", 0.95, "VU", 80, [0.3, 0.9, 0.5, 0.1], "wetland"), ("golden_eagle", "金雕", 0.85, "NT", 40, [0.8, 0.7, 0.9, 0.6], "mountain"),
    ("saker_falcon", "猎隼", 0.80, "EN", 35, [0.9, 0.6, 0.8, 0.3], "grassland"), ("bar_headed_goose", "斑头雁", 0.60, "LC", 300, [0.4, 0.8, 0.3, 0.0], "wetland"),
    ("ruddy_shelduck", "赤麻鸭", 0.40, "LC", 500, [0.5, 0.7, 0.4, 0.1], "wetland"), ("upland_buzzard", "大鵟", 0.65, "NT", 120, [0.7, 0.9, 0.6, 0.8], "grassland"),
    ("common_kestrel", "红隼", 0.50, "LC", 200, [0.8, 0.7, 0.7, 0.5], "grassland"), ("black_kite", "黑鸢", 0.70, "LC", 150, [0.8, 0.9, 0.5, 0.2], "mountain"),
    ("great_crested_grebe", "凤头鸊鷉", 0.35, "LC", 80, [0.6, 0.9, 0.5, 0.1], "wetland"), ("white_eared_pheasant", "白马鸡", 0.75, "VU", 50, [0.7, 0.8, 0.7, 0.6], "mountain"),
    ("lammergeier", "胡兀鹫", 0.90, "NT", 25, [0.6, 0.7, 0.8, 0.7], "mountain"), ("himalayan_vulture", "高山兀鹫", 0.85, "NT", 30, [0.7, 0.8, 0.7, 0.5], "mountain"),
    ("brown_headed_gull", "棕头鸥", 0.45, "LC", 400, [0.6, 0.8, 0.4, 0.0], "wetland"), ("eurasian_spoonbill", "白琵鹭", 0.55, "NT", 60, [0.5, 0.7, 0.4, 0.0], "wetland"),
    ("demoiselle_crane", "蓑羽鹤", 0.60, "NT", 100, [0.3, 0.8, 0.4, 0.0], "grassland"),
]
#: id, Chinese name, type, effect
MEASURE_TYPES = [
    ("acoustic_deterrent", "声波驱鸟器", "deterrent", 0.6), ("visual_deterrent", "视觉驱鸟器", "deterrent", 0.5), ("ultrasonic_deterrent", "超声波驱鸟器", "deterrent", 0.7), ("laser_deterrent", "激光驱鸟器", "deterrent", 0.65),
    ("decoy_predator", "仿生天敌模型", "deterrent", 0.4), ("insulation_cover", "绝缘防护罩", "physical_barrier", 0.95), ("perch_diverter", "栖鸟挡板", "physical_barrier", 0.85),
    ("attractant_pond", "诱导水域", "attractant", 0.5), ("attractant_feeding", "诱导食源", "attractant", 0.45), ("attractant_nest", "人工巢区", "attractant", 0.4),
]
#: zone, habitat
ZONES = [("zone_A", "wetland"), ("zone_B", "grassland"), ("zone_C", "mountain"), ("zone_D", "wetland")]


@dataclass
class Dataset:
    """Node tables of the three layers and the rules that write edges between them."""

    birds: DataFrame
    towers: DataFrame
    measures: DataFrame
    rules: DataFrame

    @property
    def nodes(self) -> DataFrame:
        rows = [t.select(F.lit(p).alias("layer"), F.col("node")) for p, t in (("b", self.birds), ("t", self.towers), ("m", self.measures))]
        return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("idx", F.row_number().over(W.partitionBy("layer").orderBy("node")) - 1)


def noise(seed: int, *keys: str, low: float = 0.0, high: float = 1.0) -> Column:
    return low + (high - low) * uniform(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)))


def bird_layer(spark: SparkSession) -> DataFrame:
    names = F.array(*map(F.lit, SEASONS))
    return spark.createDataFrame(SPECIES, "id string, name_cn string, danger double, conservation string, abundance int, p array<double>, habitat string").withColumn("presence", F.map_from_arrays(names, "p")).drop("p").withColumn("node", F.concat(F.lit("b:"), "id"))


def tower_layer(spark: SparkSession, n: int = 30) -> DataFrame:
    """Towers dealt to zones in turn, with a voltage."""
    zones = spark.createDataFrame([(i, *z) for i, z in enumerate(ZONES)], "z int, zone string, habitat string")
    t = spark.range(n).withColumn("z", (F.col("id") % len(ZONES)).cast("int")).join(zones, "z")
    volts = F.element_at(F.array(F.lit(110), F.lit(220), F.lit(500)), (1 + F.floor(noise(42, "id") * 3)).cast("int"))
    return t.select(F.format_string("t:tower_%03d", "id").alias("node"), "zone", "habitat", volts.alias("voltage"), noise(43, "id", low=0.3).alias("importance"))


def measure_layer(spark: SparkSession, n: int = 18) -> DataFrame:
    """Measures of each type in turn, placed in zones in turn."""
    types = spark.createDataFrame([(i, *m) for i, m in enumerate(MEASURE_TYPES)], "k int, type_id string, name_cn string, type string, effect double")
    zone = F.element_at(F.array(*[F.lit(z) for z, _ in ZONES]), (F.col("id") % len(ZONES) + 1).cast("int"))
    m = spark.range(n).withColumn("k", (F.col("id") % len(MEASURE_TYPES)).cast("int")).join(types, "k")
    return m.select(F.format_string("m:measure_%03d", "id").alias("node"), "type", (F.col("effect") * noise(123, "id", low=0.8)).alias("effect"), zone.alias("zone"))


def generate(spark: SparkSession, n_towers: int = 30, n_measures: int = 18, inter_weight: float = 0.5) -> Dataset:
    """All layers and edge rules ``season, a, b, w, prio``; edges without positive weight are left out."""
    b, t, m = bird_layer(spark), tower_layer(spark, n_towers), measure_layer(spark, n_measures)
    season = F.explode(F.array(*map(F.lit, SEASONS))).alias("season")
    c = F.col
    x, y = b.alias("x"), b.alias("y")
    same = F.when(c("x.habitat") == c("y.habitat"), 0.7).otherwise(0.2)
    score = F.round(same * (1 - 0.3 * F.abs(c("x.danger") - c("y.danger"))), 3)
    bb = x.join(y, c("x.node") < c("y.node")).select(c("x.node").alias("a"), c("y.node").alias("b"), score.alias("s"), c("x.presence").alias("p1"), c("y.presence").alias("p2"), season)
    bb = bb.select("season", "a", "b", F.round(c("s") * F.sqrt(c("p1")[c("season")] * c("p2")[c("season")]), 3).alias("w"), F.lit(1).alias("prio"))
    chain = W.partitionBy("zone").orderBy("node")
    tt = t.select(c("node").alias("a"), F.lead("node").over(chain).alias("b"), F.round((c("voltage") + F.lead("voltage").over(chain)) / 2 / 500, 3).alias("w"), F.lit(2).alias("prio")).where("b IS NOT NULL")
    ends = t.groupBy("zone").agg(F.min_by("node", "node").alias("first"), F.max_by("node", "node").alias("last"), F.max_by("voltage", "node").alias("v2"), F.min_by("voltage", "node").alias("v1"))
    over = ends.alias("x").join(ends.alias("y"), c("x.zone") < c("y.zone")).select(c("x.last").alias("a"), c("y.first").alias("b"), F.round((c("x.v2") + c("y.v1")) / 2 / 500, 3).alias("w"), F.lit(2).alias("prio")).where(noise(42, "a", "b") < 0.4)
    mx, my = m.alias("x"), m.alias("y")
    mm = mx.join(my, (c("x.node") < c("y.node")) & ((c("x.zone") == c("y.zone")) | (c("x.type") == c("y.type")))).select(c("x.node").alias("a"), c("y.node").alias("b"), F.when(c("x.zone") == c("y.zone"), 0.6).otherwise(0.4).alias("w"), F.lit(3).alias("prio"))
    bt = b.select("node", "danger", "presence", c("habitat").alias("h")).crossJoin(t.select(c("node").alias("b"), "habitat")).select("*", season)
    match = F.when(c("h") == c("habitat"), 0.6).otherwise(0.2)
    bt = bt.select("season", c("node").alias("a"), "b", (inter_weight * F.round(F.least(c("danger") * c("presence")[c("season")] * match + noise(99, "node", "b", "season", low=-0.1, high=0.1), F.lit(1.0)), 3)).alias("w"), F.lit(4).alias("prio"))
    bm = b.select("node", "danger", "presence", "habitat").crossJoin(m.select(c("node").alias("b"), "type", "effect"))
    lure = c("effect") * F.when(c("habitat") == "wetland", 0.7).otherwise(0.4) * c("presence")["summer"]
    works = F.when(c("type") == "attractant", lure).otherwise(c("effect") * c("danger") * noise(100, "node", "b", low=0.5)) + noise(101, "node", "b", low=-0.05, high=0.05)
    effect = bm.select(c("node").alias("a"), "b", (inter_weight * F.round(F.least(works, F.lit(1.0)), 3)).alias("w"), F.lit(5).alias("prio"))
    signed = F.when(c("type") == "deterrent", -c("effect") * c("danger")).otherwise(0.3 * c("effect")) + noise(102, "node", "b", low=-0.1, high=0.1)
    impact = bm.select(c("node").alias("a"), "b", (inter_weight * F.abs(F.round(signed, 3))).alias("w"), F.lit(7).alias("prio"))
    tm = t.join(m.select("zone", c("node").alias("b")), "zone").select(c("node").alias("a"), "b", F.lit(0.4 * inter_weight).alias("w"), F.lit(6).alias("prio"))
    static = tt.unionByName(over).unionByName(mm).unionByName(effect).unionByName(tm).unionByName(impact).select("*", season)
    return Dataset(b, t, m, bb.unionByName(bt).unionByName(static.select("season", "a", "b", "w", "prio")).where("w > 0"))


#: Yearly faults from 2017 on and base weights of the quarters; fixed values.
ANNUAL = {"treated": [9, 9, 8, 5, 4, 3, 0, 0], "control": [7, 8, 7, 4, 4, 4, 1, 0]}
QUARTER_WEIGHTS = [1.2, 1.8, 0.8, 1.0]
N_QUARTERS = 29


def fault_series(spark: SparkSession) -> DataFrame:
    """``series, t, period, y``: quarterly faults, the yearly counts shared out by weight and rounded; 29 quarters from 2017."""
    annual = spark.createDataFrame([(s, i, n) for s, years in ANNUAL.items() for i, n in enumerate(years)], "series string, year int, n int")
    w = [x / sum(QUARTER_WEIGHTS) for x in QUARTER_WEIGHTS]
    rows = annual.crossJoin(spark.createDataFrame(list(enumerate(w)), "q int, w double"))
    rows = rows.withColumn("w", F.greatest(F.lit(0.0), F.col("w") + noise(42, "series", "year", "q", low=-0.1, high=0.1)))
    y = F.round(F.col("n") * F.col("w") / F.sum("w").over(W.partitionBy("series", "year"))).cast("int")
    rows = rows.withColumn("y", y).withColumn("t", F.col("year") * 4 + F.col("q")).where(F.col("t") < N_QUARTERS)
    return rows.select("series", "t", F.format_string("%d-Q%d", F.col("year") + 2017, F.col("q") + 1).alias("period"), "y")
