"""Tiny hand-written symbol tables in raw form (model domain names, variable attributes),
holding the edge rows every test set needs (unmapped class, class without '-', li-ion storage,
vintages 2020 and 2050+, base-year storage, report classes with digits, unmapped and
intra-area trade, zero capacity with a factor, missing hydrogen, absent optional symbol)."""

from wattlens.sources.symbols import FrameSymbols

D = 1.396161885


def capacity_symbols(spark, scenario=None):
    def df(data, schema):
        out = spark.createDataFrame(data, schema)
        if scenario is not None:
            from pyspark.sql import functions as F
            out = out.withColumn("scenario", F.lit(scenario))
        return out

    var5 = "i string, v string, r string, t int, level double, marginal double, lower double, upper double, scale double"
    frames = {
        "cal_r": spark.createDataFrame([("PGE", ""), ("SCE", "")], "r string, element_text string"),
        "XC": df([("pvft-a", "2020", "PGE", 2020, 1.0, 0.0, 0.0, 9.0, 1.0),
                  ("pvft-b", "2050+", "SCE", 2020, 2.0, 0.0, 0.0, 9.0, 1.0),
                  ("wind-x", "2020", "PGE", 2025, 3.0, 0.0, 0.0, 9.0, 1.0),
                  ("zzzz-1", "2020", "PGE", 2020, 9.0, 0.0, 0.0, 9.0, 1.0),
                  ("nggt", "2020", "Oregon", 2020, 4.0, 0.0, 0.0, 9.0, 1.0),
                  ("pvft-a", "2020", "Oregon", 2020, 5.0, 0.0, 0.0, 9.0, 1.0)], var5),
        "IX": df([("pvft-a", "2020", "PGE", 2025, 1.0, 0.0, 0.0, 9.0, 1.0),
                  ("pvft-b", "2025", "PGE", 2025, 2.0, 0.0, 0.0, 9.0, 1.0),
                  ("nucl-1", "2025", "SCE", 2030, 4.0, 0.0, 0.0, 9.0, 1.0)], var5),
        "GC": df([("li-ion", "PGE", 2020, 1.0), ("li-ion", "Oregon", 2020, 2.0)], "j string, r string, t int, level double"),
        "GR": df([("li-ion", "PGE", 2020, 4.0)], "j string, r string, t int, level double"),
        "IGC": df([("li-ion", "PGE", 2020, 1.0), ("li-ion", "PGE", 2025, 2.0)], "j string, r string, t int, level double"),
        "IGR": df([("li-ion", "SCE", 2030, 8.0)], "j string, r string, t int, level double"),
        "capcost": df([("pvft-a", "2020", "PGE", 10.0), ("pvft-a", "2025", "PGE", 20.0),
                       ("pvft-a", "2025", "SCE", 40.0), ("pvft-a", "2050+", "PGE", 50.0),
                       ("wind-a", "2025", "Oregon", 99.0), ("zzzz", "2025", "PGE", 7.0)],
                      "i string, v string, r string, value double"),
        "fomcost": df([("pvft-a", "2020", "PGE", 1.0), ("pvft-a", "2050+", "PGE", 3.0)],
                      "i string, v string, r string, value double"),
        "icost": df([("pvft-a", "2025", "PGE", "gas", 2030, -1.0), ("pvft-a", "2025", "SCE", "gas", 2035, -3.0)],
                    "i string, v string, r string, f string, t int, value double"),
        "icg": df([("li-ion", 2020, "PGE", 1.0), ("li-ion", 2025, "Oregon", 3.0), ("other", 2025, "PGE", 100.0)],
                  "j string, t int, r string, value double"),
        "irg": df([("li-ion", 2025, "Oregon", 5.0)], "j string, t int, r string, value double"),
        "CO2_ELEC": df([("PGE", 2020, 0.001), ("SCE", 2020, 0.002), ("Oregon", 2020, 0.004), ("PGE", 2025, 0.003)],
                       "r string, t int, level double"),
        "gencaprpt": df([("CA", "xwnd12", 2020, "TWh", 1.0), ("CA", "xwnd3", 2020, "TWh", 2.0),
                         ("CA", "h2", 2020, "TWh", 5.0), ("CA", "h2cc3", 2020, "TWh", 6.0),
                         ("CA", "peakload", 2020, "gw", 7.0), ("CA", "stor", 2020, "GW", 3.0),
                         ("CA", "nuca", 2030, "gw", 2.0)],
                        "uni_0 string, grc_1 string, t_2 int, uni_3 string, value double"),
    }
    return FrameSymbols(spark, frames)


def hourly_symbols(spark):
    frames = {
        "cal_r": spark.createDataFrame([("PGE",), ("SCE",)], "r string"),
        "hrep": spark.createDataFrame([(2025, 1, "s1"), (2025, 2, "s1"), (2025, 3, "s2"), (2025, 3, "s2")],
                                      "t int, h int, s string"),
        "XC": spark.createDataFrame([("pvft-a", "2020", "PGE", 2025, 2.0), ("wind-a", "2020", "PGE", 2025, 0.0),
                                     ("pvft-a", "2020", "Oregon", 2025, 50.0), ("wnos-a", "2020", "PGE", 2025, 1.0)],
                                    "i string, v string, r string, t int, level double"),
        "vrsc_8760": spark.createDataFrame([("pvft-a", "2020", "PGE", 2025, 1, 0.5), ("pvft-a", "2020", "PGE", 2025, 2, 0.3),
                                            ("wind-a", "2020", "PGE", 2025, 1, 0.8),
                                            ("pvft-a", "2020", "Oregon", 2025, 1, 0.9),
                                            ("wnos-a", "2020", "PGE", 2025, 3, 0.2)],
                                           "uni string, v string, r string, t int, h int, value double"),
        "vrsc_100": spark.createDataFrame([("pvft-a", "2020", "PGE", 2025, "s1", 0.4), ("wind-a", "2020", "PGE", 2025, "s2", 0.6),
                                           ("wnos-a", "2020", "PGE", 2025, "s2", 0.1)],
                                          "uni string, v string, r string, t int, s string, value double"),
        "load_8760": spark.createDataFrame([("PGE", 2025, 1, 10.0), ("SCE", 2025, 1, 5.0), ("Oregon", 2025, 1, 100.0),
                                            ("PGE", 2025, 2, 3.0), ("PGE", 2025, 3, 20.0)],
                                           "r string, t int, h int, value double"),
        "load_100": spark.createDataFrame([("PGE", 2025, "s1", 12.0), ("PGE", 2025, "s2", 30.0)],
                                          "r string, t int, s string, value double"),
        "dspsrpt_r": spark.createDataFrame([("demand", "s1", "PGE", "h2prod_ht", 2025, 1.0),
                                            ("demand", "s1", "PGE", "other", 2025, 50.0),
                                            ("supply", "s1", "PGE", "h2prod_ht", 2025, 60.0)],
                                           "uni_0 string, s_1 string, r_2 string, uni_3 string, t_4 int, value double"),
    }
    return FrameSymbols(spark, frames)


def dispatch_symbols(spark):
    frames = {
        "cal_r": spark.createDataFrame([("PGE",), ("SCE",)], "r string"),
        "hrep": spark.createDataFrame([(2025, 1, "s1"), (2025, 2, "s1"), (2025, 3, "s2")], "t int, h int, s string"),
        "X": spark.createDataFrame([("pvft-a", "2020", "PGE", 2025, "s1", 2.0), ("wind-a", "2020", "SCE", 2025, "s1", 3.0),
                                    ("nucl-1", "2020", "PGE", 2025, "s1", 1.0), ("clcl-1", "2020", "PGE", 2025, "s1", 9.0),
                                    ("pvft-a", "2020", "Oregon", 2025, "s1", 70.0)],
                                   "i string, v string, r string, t int, s string, level double"),
        "G": spark.createDataFrame([("li-ion", "PGE", 2025, "s1", 0.5)], "j string, r string, t int, s string, level double"),
        "GD": spark.createDataFrame([("li-ion", "PGE", 2025, "s1", 0.7)], "j string, r string, t int, s string, level double"),
        "E": spark.createDataFrame([("s1", "PGE", "Oregon", 2025, 1.0), ("s1", "SCE", "PGE", 2025, 2.0),
                                    ("s1", "Mexico", "PGE", 2025, 4.0), ("s1", "Oregon", "SCE", 2025, 8.0)],
                                   "s_0 string, r_1 string, r_2 string, t_3 int, level double"),
    }
    return FrameSymbols(spark, frames)
