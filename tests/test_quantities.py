from pyspark.sql import functions as F

from weftline.operators import quantities as Q

HEIGHTS = {
    "172 cm": 1720, "1,72 m": 1720, "1m72": 1720, "5'8\"": 1727, "5 ft 8 in": 1727, "5-10": 1778, "five foot seven": 1702, "six feet": 1829, "5'10½\"": 1791, "67 in": 1702, "1720 mm": 1720, "6'": 1829,
    "170 cm (5'7\")": 1700, "5 ft 7 in / 171 cm": 1702, "ca. 165 cm": 1650, "147,5 cm": 1475, "tall": None, "": None, None: None, "n/a": None,
}
WEIGHTS = {"55 kg": 55000, "55,5 kg": 55500, "120 lbs": 54431, "120#": 54431, "9 st 4 lb": 58967, "9 stone 4": 58967, "55000 g": 55000, "approx 120 lb": 54431, "43 kg / 95 lb": 43000, "average": None}
SETS = {
    "90-60-90": {"bust": 900, "waist": 600, "hips": 900}, "34D-24-36": {"bust": 864, "waist": 610, "hips": 914}, "34DD": {"band": 864}, "75 B": {"band": 750}, "85(E)": {"band": 850}, "NoneNone-23-35": {"waist": 584, "hips": 889}, "?-24-36": {"waist": 610, "hips": 914},
    "100G-56-": {"bust": 1000, "waist": 560}, "bust 32 in, waist 56 cm, hips 33 in": {"bust": 813, "waist": 560, "hips": 838}, "B36 W24,5 H36": {"bust": 914, "waist": 622, "hips": 914}, "1000-560-1020mm": {"bust": 1000, "waist": 560, "hips": 1020},
    "34\" 24\" 35\"": {"bust": 864, "waist": 610, "hips": 889}, "90 x 60 x 90": {"bust": 900, "waist": 600, "hips": 900}, "90–60–90 (cm)": {"bust": 900, "waist": 600, "hips": 900}, "??-??-??": {}, "not listed": {}, "": {},
}


def test_heights_and_weights(spark):
    for cases, parse in ((HEIGHTS, Q.height_mm), (WEIGHTS, Q.weight_g)):
        fixed, bare = parse(F.col("t"))
        df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", Q._half_up(fixed).alias("v"), bare.alias("b"))
        assert {r.t: r.v for r in df.collect()} == cases


def test_body_sizes(spark):
    factor = {"mm": 1, "cm": 10, "in": 25.4}
    df = spark.createDataFrame([(t,) for t in SETS], "t string").select("t", Q.body_sizes(F.col("t")).alias("x"))
    for r in df.collect():
        got = {p.part: int(float(p.number) * factor[p.unit or ("cm" if p.number > 50 else "in")] + 0.5) for p in r.x or []}
        assert got == SETS[r.t], r.t


def test_calibration_finds_units_of_sources(spark):
    rows = []
    for k in range(60):
        size = 1500 + 7 * k
        rows += [(k, "anchor", f"e{k}", "height", float(size), None), (100 + k, "inches", f"e{k}", "height", None, size / 25.4), (200 + k, "metres", f"e{k}", "height", None, size / 1000), (300 + k, "far", f"f{k}", "height", None, float(size / 10))]
        # a source without links to the anchor, but to one that is calibrated
        rows.append((400 + k, "metres", f"f{k}", "height", None, size / 1000))
    df = spark.createDataFrame(rows, "row_id bigint, source string, entity string, part string, fixed double, bare double")
    df = df.withColumn("fixed", F.col("fixed").cast(Q.DEC)).withColumn("bare", F.col("bare").cast(Q.DEC))
    got = {(r.source, r.unit) for r in Q.calibrate(df, {"height": Q.MM}).collect()}
    assert got == {("inches", "in"), ("metres", "m"), ("far", "cm")}
    out = {r.row_id: r.amount for r in Q.convert_sizes(df, {"height": Q.MM}).collect()}
    assert len(out) == len(rows) and all(abs(out[k] - out[100 + k]) <= 1 and abs(out[300 + k] - out[k]) <= 1 for k in range(60))


def test_empty_and_nulls(spark):
    schema = "row_id bigint, source string, entity string, part string, fixed decimal(18,6), bare decimal(18,6)"
    none = spark.createDataFrame([], schema)
    assert Q.convert_sizes(none, {"height": Q.MM}).collect() == []
    nulls = spark.createDataFrame([(1, None, None, "height", None, None)], schema)
    assert Q.convert_sizes(nulls, {"height": Q.MM}).collect() == []
