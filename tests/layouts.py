"""A small layout that several tests resolve cells by."""

from pyspark.sql import functions as F

POSITIONS = [
    ("T1", "y", 0, "0010", "mA", {}), ("T1", "y", 1, "0020", "mB", {}), ("T1", "y", 2, "0030", None, {"RFL": "A"}),
    ("T1", "x", 0, "0010", None, {"SEG": "BUILDING"}), ("T1", "x", 1, "0020", "mX", {"SEG": "MACHINERY"}), ("T1", "z", 0, "0001", None, {"REG": "ASIA", "SEG": "x0"}), ("T1", "z", 1, "0002", None, {"REG": "EUROPE"}),
    ("T2", "y", 0, "0010", "mA", {"RFL": "N"}), ("T2", "x", 0, "0010", None, {"SEG": "BUILDING"}),
]


def positions(spark):
    return spark.createDataFrame(POSITIONS, "tbl string, axis string, ord int, code string, concept string, dims map<string,string>").withColumn("open_dim", F.lit(None).cast("string"))
