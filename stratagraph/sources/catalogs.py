"""The bird and power-line domain as tables: catalogs, the temporal knowledge graph built from them, and its hierarchies.

The literals below are fixed values: results are compared with counts that depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions.columns import overlaps

FIRST_YEAR, N_YEARS = 2017, 8

#: id, Chinese name, protection class, residency, habitat, body size, taxon, note
BIRDS = [
    ("Gr_nigricollis", "黑颈鹤", "I", "summer_visitor", "wetland", "large", "Gruiformes", None),
    ("Aq_chrysaetos", "金雕", "I", "resident", "mountain", "large", "Accipitriformes", None),
    ("Fa_cherrug", "猎隼", "I", "summer_visitor", "grassland", "medium", "Falconiformes", None),
    ("Bu_hemilasius", "大鵟", "II", "summer_visitor", "grassland", "medium", "Accipitriformes", "主要冲突物种，塔顶筑巢"),
    ("Fa_tinnunculus", "红隼", "II", "resident", "grassland", "small", "Falconiformes", None),
    ("Mi_migrans", "黑鸢", "II", "summer_visitor", "mountain", "medium", "Accipitriformes", "集群活动,一次调查>35只"),
    ("Gy_himalayensis", "高山兀鹫", "II", "resident", "mountain", "large", "Accipitriformes", None),
    ("Co_corax", "渡鸦", "unprotected", "resident", "grassland", "medium", "Passeriformes", None),
    ("Pi_pica", "喜鹊", "unprotected", "resident", "grassland", "small", "Passeriformes", None),
    ("An_noctua", "纵纹腹小鸮", "II", "resident", "grassland", "small", "Strigiformes", None),
    ("An_anser", "斑头雁", "unprotected", "summer_visitor", "wetland", "medium", "Anseriformes", None),
    ("Ta_ferruginea", "赤麻鸭", "unprotected", "summer_visitor", "wetland", "medium", "Anseriformes", None),
    ("Aq_nipalensis", "草原雕", "II", "summer_visitor", "grassland", "large", "Accipitriformes", None),
    ("St_ciconia", "东方白鹳", "I", "passage_migrant", "wetland", "large", "Ciconiiformes", None),
    ("Pl_leucorodia", "白琵鹭", "II", "summer_visitor", "wetland", "medium", "Pelecaniformes", None),
    ("An_formosa", "花脸鸭", "II", "passage_migrant", "wetland", "small", "Anseriformes", None),
    ("Ch_dubius", "金眶鸻", "unprotected", "summer_visitor", "wetland", "small", "Charadriiformes", None),
    ("La_brunnicephalus", "棕头鸥", "unprotected", "summer_visitor", "wetland", "small", "Charadriiformes", None),
    ("An_crecca", "绿翅鸭", "unprotected", "passage_migrant", "wetland", "small", "Anseriformes", None),
    ("Gr_grus", "灰鹤", "II", "passage_migrant", "wetland", "large", "Gruiformes", None),
]
#: id, Chinese name, voltage, poles, length in km, nest rate, artificial nests, activity
LINES = [
    ("line_ruozhen", "若真线", 110, 179, 68.9, 0.514, None, None), ("line_ruotang", "若唐线", 110, None, None, None, None, None),
    ("line_anmai", "安麦线", 110, None, None, None, None, None), ("line_aji", "阿吉线", 35, 260, 77.618, None, None, None),
    ("line_heishang", "黑上线", 10, None, None, None, 5, 3), ("line_heize", "黑泽线", 10, None, None, None, 5, 1),
    ("line_heimai", "黑麦线", 10, None, None, None, 5, 5), ("line_ruoa", "若阿线", 10, None, None, None, 9, 5),
    ("line_ehu", "俄湖线", 10, None, None, None, 3, 1), ("line_manqiong", "曼穷线", 10, None, None, None, None, None), ("line_manka", "曼卡线", 10, None, None, None, None, None),
]
#: id, Chinese name, type, target
MEASURES = [
    ("anti_bird_baffle", "防鸟绝缘挡板", "physical_barrier", "droppings_flashover"), ("artificial_nest", "仿生人工鸟巢", "attractant", "nest_shorting"),
    ("smart_deterrent", "智能驱鸟装置", "deterrent", "perching"), ("hd_video", "高清视频监测", "monitoring", "behavior_tracking"),
    ("dynamic_spikes", "动态防鸟刺", "physical_barrier", "perching"), ("rotating_deterrent", "旋转驱鸟器", "deterrent", "perching"),
    ("insulation_sleeve", "绝缘护套", "physical_barrier", "body_shorting"), ("acoustic_deterrent", "声波驱鸟器", "deterrent", "flocking"),
]
#: band, lowest and highest elevation
BANDS = [("elev_low", 1500, 2800), ("elev_mid", 2800, 3600), ("elev_high", 3600, 4500), ("elev_alpine", 4500, 5600)]
#: bird, lowest and highest elevation
RANGES = [
    ("Gr_nigricollis", 2800, 4500), ("Aq_chrysaetos", 3200, 5000), ("Fa_cherrug", 3400, 4500), ("Bu_hemilasius", 3500, 4800), ("Fa_tinnunculus", 2800, 4300), ("Mi_migrans", 2100, 4300),
    ("Gy_himalayensis", 2200, 5100), ("Aq_nipalensis", 3000, 4800), ("St_ciconia", 2000, 3500), ("An_anser", 3000, 4500), ("Gr_grus", 2500, 4000),
]
#: bird, abundance in spring, summer, autumn, winter
TIERS = [
    ("Gr_nigricollis", [3, 2, 2, 1]), ("Bu_hemilasius", [3, 4, 3, 1]), ("Fa_tinnunculus", [2, 2, 2, 2]), ("Mi_migrans", [3, 4, 2, 1]), ("Gy_himalayensis", [2, 3, 3, 2]), ("Aq_chrysaetos", [2, 2, 2, 2]),
    ("Fa_cherrug", [3, 3, 2, 1]), ("An_anser", [2, 3, 2, 1]), ("Ta_ferruginea", [2, 3, 2, 1]), ("An_crecca", [1, 1, 2, 3]), ("An_formosa", [1, 1, 2, 3]), ("Co_corax", [2, 2, 2, 2]), ("Pi_pica", [2, 2, 2, 2]),
]
KV110 = ["line_ruozhen", "line_ruotang", "line_anmai"]
KV10 = ["line_heishang", "line_heize", "line_heimai", "line_ruoa", "line_ehu", "line_manqiong", "line_manka"]
FLYWAYS = ["flyway_central_asian_indian", "flyway_east_asian_australasian"]
#: Groups that hold every year: heads, relation, tails.
YEARLY = [
    (["Bu_hemilasius", "Fa_tinnunculus", "Mi_migrans", "Co_corax", "Pi_pica", "Fa_cherrug"], "nests_on", ["line_ruozhen", "line_ruotang", "line_heishang", "line_heimai", "line_ruoa"]),
    (["Bu_hemilasius", "Fa_tinnunculus", "Mi_migrans", "Co_corax", "Pi_pica", "Fa_cherrug"], "threatens", ["line_ruozhen", "line_ruotang", "line_heishang", "line_heimai", "line_ruoa"]),
    (["Bu_hemilasius", "Fa_tinnunculus", "Mi_migrans", "Co_corax", "Pi_pica", "Fa_cherrug"], "causes", ["fault_nest_shorting"]),
    (["Bu_hemilasius", "Mi_migrans", "Co_corax", "Pi_pica", "Fa_tinnunculus", "Aq_nipalensis"], "causes", ["fault_droppings_flashover"]),
    (["Gr_nigricollis", "An_anser", "Gr_grus", "St_ciconia", "An_formosa", "An_crecca", "Ch_dubius"], "threatens", ["line_ruozhen", "line_aji"]),
]
LARGE = ["Gr_nigricollis", "Aq_chrysaetos", "Gy_himalayensis", "St_ciconia", "Gr_grus"]
#: Groups with an interval: heads, relation, tails, begin, end (years from 2017; none: undated, open).
DATED = [
    (["Fa_cherrug"], "competes_with", ["Bu_hemilasius"], 7, 7), (["Bu_hemilasius"], "competes_with", ["Fa_tinnunculus"], None, None), (["Mi_migrans"], "competes_with", ["Bu_hemilasius"], None, None),
    (["dynamic_spikes"], "deployed_on", KV110, 3, None), (["smart_deterrent"], "deployed_on", ["line_ruozhen"], 3, 6), (["hd_video"], "deployed_on", ["line_ruozhen"], 3, None),
    (["anti_bird_baffle", "artificial_nest", "smart_deterrent", "hd_video", "dynamic_spikes"], "deployed_on", KV110, 6, None),
    (["artificial_nest"], "deployed_on", KV10, 6, None), (["insulation_sleeve"], "deployed_on", ["line_heishang", "line_ruoa", "line_heimai"], 6, None),
    (["anti_bird_baffle", "smart_deterrent", "dynamic_spikes"], "mitigates", ["fault_droppings_flashover"], None, None), (["artificial_nest", "dynamic_spikes"], "mitigates", ["fault_nest_shorting"], None, None), (["insulation_sleeve"], "mitigates", ["fault_body_shorting"], None, None),
    (["Bu_hemilasius"], "occupies_nest", ["line_ruozhen"], 6, 7), (["Fa_cherrug"], "occupies_nest", ["line_ruozhen"], 7, 7),
    *[(["line_ruozhen", "line_ruotang"], "has_fault", ["fault_droppings_flashover"], y, y) for y in (0, 1, 2)],
    *[(["line_ruozhen"], "has_fault", ["fault_droppings_flashover", "fault_nest_shorting"], y, y) for y in (3, 4, 5)],
    (["line_heishang", "line_heimai"], "has_fault", ["fault_body_shorting"], 3, 4),
    (["line_aji", "line_ruozhen"], "near_habitat", ["hab_wetland_marsh"], None, None), (["line_ruozhen", "line_heize", "line_ruoa"], "near_habitat", ["hab_alpine_meadow"], None, None),
    (["hab_alpine_meadow"], "supports", ["Bu_hemilasius", "Fa_tinnunculus", "Mi_migrans"], None, None), (["hab_wetland_marsh"], "supports", ["Gr_nigricollis", "An_anser", "Gr_grus"], None, None),
]
#: Undated groups of the enrichment: heads, relation, tails.
ADDED = [
    ([*KV110, *KV10, "line_aji"], "at_elevation", ["elev_mid"]),
    (["An_anser", "Ta_ferruginea", "An_formosa", "An_crecca", "Ch_dubius", "La_brunnicephalus", "Pl_leucorodia"], "occupies_elevation", ["elev_mid", "elev_low"]),
    (["reg_zoige"], "on_flyway", FLYWAYS + FLYWAYS), (["reg_zoige"], "is_migration_corridor", ["corridor_sichuan_tibet"]),
    (["hab_wetland_marsh"], "has_congregation_risk", ["risk_high"]), (["line_aji", "line_ruozhen", "line_ruotang"], "has_wetland_congestion_risk", ["risk_high"]),
    (["Aq_chrysaetos", "Gy_himalayensis", "Fa_cherrug", "Bu_hemilasius", "Mi_migrans", "Aq_nipalensis"], "has_flight_behavior", ["behavior_soaring"]),
    (["Aq_chrysaetos", "Gy_himalayensis", "Fa_cherrug", "Bu_hemilasius", "Mi_migrans", "Aq_nipalensis", "Gr_nigricollis"], "has_collision_risk_factor", ["risk_high_wingspan"]),
    (["Gr_nigricollis"], "peak_season", ["season_Spring"]), (["Gr_nigricollis"], "is_flagship_species", ["reg_zoige"]),
    (KV110, "has_collision_risk", ["risk_110kV_high"]), (["line_aji"], "has_collision_risk", ["risk_35kV_moderate"]), (KV10, "has_collision_risk", ["risk_10kV_low"]),
]
#: Trees: parent and its children.
SPATIAL = [
    ("root_spatial", ["landscape_qinghai_tibet"]), ("landscape_qinghai_tibet", ["ecoregion_zoige_wetland"]),
    ("ecoregion_zoige_wetland", ["hab_alpine_meadow", "hab_wetland_marsh", "hab_alpine_shrub", "hab_river_lake", "hab_bare_rock", "hab_settlement"]),
    ("hab_wetland_marsh", ["line_aji", "line_ruozhen", "line_ruotang", "Gr_nigricollis", "An_anser", "Ta_ferruginea", "St_ciconia", "Gr_grus", "Pl_leucorodia", "Ch_dubius", "La_brunnicephalus", "An_formosa", "An_crecca"]),
    ("hab_alpine_meadow", ["line_anmai", *KV10, "Bu_hemilasius", "Fa_tinnunculus", "Aq_nipalensis", "Co_corax", "Pi_pica", "An_noctua", "Fa_cherrug"]),
    ("hab_alpine_shrub", ["Aq_chrysaetos", "Gy_himalayensis", "Mi_migrans"]),
]
TAXONOMIC = [
    ("root_taxonomic", [f"order_{x}" for x in ("Accipitriformes", "Falconiformes", "Gruiformes", "Anseriformes", "Charadriiformes", "Pelecaniformes", "Ciconiiformes", "Strigiformes", "Passeriformes")]),
    ("order_Accipitriformes", ["fam_Accipitridae"]), ("order_Falconiformes", ["fam_Falconidae"]), ("order_Gruiformes", ["fam_Gruidae"]), ("order_Anseriformes", ["fam_Anatidae"]),
    ("order_Charadriiformes", ["fam_Scolopacidae", "fam_Laridae", "fam_Charadriidae"]), ("order_Pelecaniformes", ["fam_Threskiornithidae"]), ("order_Ciconiiformes", ["fam_Ciconiidae"]), ("order_Strigiformes", ["fam_Strigidae"]), ("order_Passeriformes", ["fam_Corvidae"]),
    ("fam_Accipitridae", ["Bu_hemilasius", "Aq_chrysaetos", "Aq_nipalensis", "Gy_himalayensis", "Mi_migrans"]), ("fam_Falconidae", ["Fa_cherrug", "Fa_tinnunculus"]), ("fam_Gruidae", ["Gr_nigricollis", "Gr_grus"]),
    ("fam_Anatidae", ["An_anser", "Ta_ferruginea", "An_formosa", "An_crecca"]), ("fam_Charadriidae", ["Ch_dubius"]), ("fam_Laridae", ["La_brunnicephalus"]), ("fam_Threskiornithidae", ["Pl_leucorodia"]),
    ("fam_Ciconiidae", ["St_ciconia"]), ("fam_Strigidae", ["An_noctua"]), ("fam_Corvidae", ["Co_corax", "Pi_pica"]),
]
TROPHIC = [
    ("root_trophic", ["level_producer"]), ("level_producer", ["level_primary_cons", "level_insect"]), ("level_insect", ["level_secondary_cons", "trophic_amphibians"]),
    ("level_primary_cons", ["level_apex_predator", "Gr_nigricollis", "Gr_grus", "St_ciconia", "Pl_leucorodia", "An_anser", "Ta_ferruginea", "An_formosa", "An_crecca", "Ch_dubius", "La_brunnicephalus"]),
    ("level_secondary_cons", ["level_apex_predator", "Co_corax", "Pi_pica"]), ("trophic_amphibians", ["level_apex_predator"]),
    ("level_apex_predator", ["Bu_hemilasius", "Fa_cherrug", "Fa_tinnunculus", "Aq_chrysaetos", "Gy_himalayensis", "Mi_migrans", "Aq_nipalensis", "An_noctua"]),
]


def birds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BIRDS, "id string, name_cn string, class string, residency string, habitat string, body_size string, taxon string, note string")


def lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINES, "id string, name_cn string, voltage int, poles int, length_km double, nest_rate double, artificial_nests int, activity int")


def measures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEASURES, "id string, name_cn string, type string, target string")


def _facts(df: DataFrame, h, r: str, t, tb=None, te=None) -> DataFrame:
    whole = lambda x: F.lit(x).cast("int") if x is None or isinstance(x, int) else x.cast("int")
    return df.select(h.alias("h"), F.lit(r).alias("r"), t.alias("t"), whole(tb).alias("tb"), whole(te).alias("te"))


def _groups(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Groups of heads, a relation and tails, every head with every tail."""
    table = spark.createDataFrame([(*r[:3], *(r[3:] or (None, None))) for r in rows], "hs array<string>, r string, ts array<string>, tb int, te int")
    return table.select(F.explode("hs").alias("h"), "r", "ts", "tb", "te").select("h", "r", F.explode("ts").alias("t"), "tb", "te")


def _every_year(df: DataFrame) -> DataFrame:
    y = F.explode(F.sequence(F.lit(0), F.lit(N_YEARS - 1)))
    return df.select("h", "r", "t", y.alias("tb")).withColumn("te", F.col("tb"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def base_facts(spark: SparkSession) -> DataFrame:
    """``h, r, t, tb, te``: attributes, yearly presence and threats, deployments, faults and habitats."""
    b, li, m = birds(spark), lines(spark), measures(spark)
    c, pre = F.col, lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    region = F.lit("reg_zoige")
    present = b.select(c("id").alias("h"), F.when(c("residency") == "passage_migrant", "migrates_through").otherwise("present_in").alias("r"), region.alias("t"))
    shorting = b.where(c("id").isin(LARGE) & c("residency").isin("resident", "summer_visitor")).select(c("id").alias("h"), F.lit("causes").alias("r"), F.lit("fault_body_shorting").alias("t"))
    return _union([
        _facts(b, c("id"), "has_residency", pre("res_", "residency")), _facts(b, c("id"), "inhabits", F.concat(F.lit("hab_"), F.coalesce("habitat", F.lit("unknown")))),
        _facts(b.where("body_size IS NOT NULL"), c("id"), "has_body_size", pre("size_", "body_size")), _facts(b.where(c("class").isin("I", "II")), c("id"), "has_protection", pre("prot_", "class")),
        _facts(li, c("id"), "has_voltage", pre("volt_", "voltage")), _facts(li, c("id"), "located_in", region),
        _facts(m, c("id"), "targets_fault", pre("fault_", "target")), _facts(m, c("id"), "has_type", pre("meas_type_", "type")),
        _every_year(present), _every_year(shorting), _every_year(_groups(spark, YEARLY)), _groups(spark, DATED),
    ])


def enrichment(spark: SparkSession) -> DataFrame:
    """Elevation, seasons, flyways and risks from the literature, all undated."""
    bands = spark.createDataFrame(BANDS, "band string, lo int, hi int")
    ranges = spark.createDataFrame(RANGES, "id string, lo int, hi int")
    tiers = spark.createDataFrame(TIERS, "id string, tiers array<int>").select("id", F.posexplode("tiers").alias("i", "tier")).where("tier >= 3")
    c, val = F.col, lambda x: F.concat(F.lit("val_"), F.col(x).cast("string"))
    met = ranges.alias("x").join(bands.alias("y"), overlaps(c("x.lo"), c("x.hi"), c("y.lo"), c("y.hi")))
    season = F.element_at(F.array(*[F.lit(f"season_{s}") for s in ("Spring", "Summer", "Autumn", "Winter")]), c("i") + 1)
    return _union([
        _facts(bands, c("band"), "elev_range_lo", val("lo")), _facts(bands, c("band"), "elev_range_hi", val("hi")),
        _facts(ranges, c("id"), "has_elev_min", val("lo")), _facts(ranges, c("id"), "has_elev_max", val("hi")),
        _facts(met, c("x.id"), "occupies_elevation", c("y.band")), _facts(tiers, c("id"), "peak_season", season), _groups(spark, ADDED),
    ])


def enriched_facts(spark: SparkSession) -> DataFrame:
    return base_facts(spark).unionByName(enrichment(spark))


def hierarchies(spark: SparkSession) -> DataFrame:
    """``hierarchy, parent, child`` of the spatial and taxonomic trees and the trophic graph."""
    rows = [(name, p, kids) for name, tree in (("spatial", SPATIAL), ("taxonomic", TAXONOMIC), ("trophic", TROPHIC)) for p, kids in tree]
    return spark.createDataFrame(rows, "hierarchy string, parent string, kids array<string>").select("hierarchy", "parent", F.explode("kids").alias("child"))
