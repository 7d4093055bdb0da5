"""Counts, crosstabs with completed domains, melt, top-k, and the treatment-effect golden (eight rows of the
reference's saved effect table, rebuilt from the derived stage sizes 2,934 and 1,553)."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import tables as TB
from cohortlens.operators.effects import positive_effects, treatment_effects
from tests.conftest import rows


@pytest.fixture(scope="module")
def patients(spark):
    data = [
        ("Male", "I", "Alive", 30), ("Male", "III", "Deceased", 41), ("Female", "III", "Alive", 41),
        ("Female", "IV", "Deceased", 50), ("Male", "II", "Alive", 30), (None, "IV", "Alive", 60),
        ("Female", None, "Deceased", 70), ("Male", "IV", "Deceased", 41),
    ]
    return spark.createDataFrame(data, "g string, s string, st string, age int")


def test_crosstab_completes_rows_and_columns(spark, patients):
    ct = TB.crosstab(patients, ["g"], "st", ["Alive", "Deceased", "Dead"], row_domain={"g": ["Male", "Female", "Other"]})
    got = {r["g"]: (r["Alive"], r["Deceased"], r["Dead"]) for r in ct.collect()}
    assert got == {"Male": (2, 2, 0), "Female": (1, 2, 0), "Other": (0, 0, 0)}  # NULL gender dropped (N9)


def test_stratified_regex_strata_overlap(spark, patients):  # Q1
    ct = TB.stratified_crosstab(patients, "s", ["I", "IV"], "g", ["Male", "Female"], "st", ["Alive", "Deceased"],
                                match="regex")
    got = {(r["stratum"], r["g"]): (r["Alive"], r["Deceased"]) for r in ct.collect()}
    # 'I' as a regex matches I, II, III and IV rows
    assert got[("I", "Male")] == (2, 2) and got[("I", "Female")] == (1, 1)
    assert got[("IV", "Male")] == (0, 1) and got[("IV", "Female")] == (0, 1)


def test_value_counts_share_and_order(spark, patients):
    vc = TB.value_counts(patients, "st", normalize=True).collect()
    assert [r["value"] for r in vc] == ["Alive", "Deceased"]  # 4 each: ties broken by value
    assert sum(r["share"] for r in vc) == pytest.approx(1.0)
    top = TB.top_values(patients, "age", 2).collect()
    assert [(r["value"], r["count"]) for r in top] == [(41, 3), (30, 2)]
    assert top[0]["percent"] == pytest.approx(37.5)


def test_binned_crosstab_uses_bins_only_above_ten_distinct(spark):
    few = spark.createDataFrame([(i % 5, "A" if i % 2 else "B") for i in range(20)], "x int, st string")
    out = TB.binned_crosstab(few, "x", "st", ["A", "B"])
    assert out.count() == 5 and set(r["label"] for r in out.collect()) == {"0.0", "1.0", "2.0", "3.0", "4.0"}
    many = spark.createDataFrame([(float(v), "A") for v in list(range(13)) + [15, 20]], "x double, st string")
    out = TB.binned_crosstab(many, "x", "st", ["A"])
    assert [r["A"] for r in out.orderBy("bin").collect()] == [5, 4, 4, 1, 1]


def test_completed_counts_and_melt_and_prevalence(spark, patients):
    cc = TB.completed_counts(patients, "age", "g", ["Male", "Female"], "st", ["Alive", "Deceased"])
    assert cc.count() == 5 * 2
    flags = patients.select("s", F.when(F.col("st") == "Deceased", 1).otherwise(0).alias("Received_x"),
                            F.lit(1).alias("Received_y"))
    m = {(r["s"], r["variable"]): r["mean"] for r in TB.melt_means(flags, ["s"], ["Received_x", "Received_y"],
                                                                      strip="Received_").collect()}
    assert m[("IV", "x")] == pytest.approx(2 / 3) and m[("IV", "y")] == 1.0
    prev = dict(rows(TB.prevalence(flags, {"x": "Received_x", "y": "Received_y"}), "name", "percent"))
    assert prev == {"x": 50.0, "y": 100.0}


def test_group_mean_ci(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double")
    r = {x["k"]: x for x in TB.group_mean_ci(df, ["k"], "v").collect()}
    assert r["a"]["mean"] == 2.0 and r["a"]["n"] == 2 and r["a"]["sd"] == pytest.approx(2 ** 0.5)
    assert r["b"]["ci_lower"] is None


# The saved effect table of the reference (stage, treatment, treated n, treated and control mortality).
GOLDEN = [
    (3, "Radiation", 585, 0.5162393162393163, 0.4891443167305236, -0.027094999508792683),
    (3, "Chemotherapy", 603, 0.47761194029850745, 0.49892749892749894, 0.021315558628991482),
    (3, "Targeted Therapy", 570, 0.48596491228070177, 0.4966159052453469, 0.010650992964645112),
    (3, "Surgery", 569, 0.5061511423550088, 0.4917547568710359, -0.014396385483972873),
    (4, "Radiation", 321, 0.49221183800623053, 0.4878246753246753, -0.004387162681555201),
    (4, "Chemotherapy", 325, 0.5046153846153846, 0.48452768729641693, -0.020087697318967646),
    (4, "Targeted Therapy", 311, 0.48231511254019294, 0.49033816425120774, 0.008023051711014806),
    (4, "Surgery", 294, 0.45918367346938777, 0.49563145353455124, 0.03644778006516347),
]
SIZES = {3: 2934, 4: 1553}


def _golden_patients(spark):
    """Patients whose per-treatment marginals reproduce every golden row (flags may overlap arbitrarily)."""
    parts = []
    for stage, size in SIZES.items():
        spec = [g for g in GOLDEN if g[0] == stage]
        deaths = {round(g[3] * g[2]) + round(g[4] * (size - g[2])) for g in spec}
        assert len(deaths) == 1
        d = deaths.pop()
        i = F.col("id")
        cols = [F.lit(stage).alias("stage"), (i < d).cast("int").alias("dead")]
        for _, name, n1, mt, _, _ in spec:
            d1 = round(mt * n1)
            flag = ((i < d1) | ((i >= d) & (i < d + n1 - d1))).cast("int")
            cols.append(flag.alias(name))
        parts.append(spark.range(size).select(*cols))
    return parts[0].unionByName(parts[1])


def test_effects_golden(spark):
    pts = _golden_patients(spark)
    names = ["Radiation", "Chemotherapy", "Targeted Therapy", "Surgery"]
    eff = treatment_effects(pts, ["stage"], {n: f"`{n}`" for n in names}, "dead")
    got = {(r["stage"], r["treatment"]): r for r in eff.collect()}
    assert len(got) == 8
    for stage, name, n1, mt, mc, e in GOLDEN:
        r = got[(stage, name)]
        assert r["sample_size"] == n1
        assert r["mortality_treatment"] == pytest.approx(mt, abs=1e-12)
        assert r["mortality_control"] == pytest.approx(mc, abs=1e-12)
        assert r["efficacy"] == pytest.approx(e, abs=1e-12)
    pos = positive_effects(eff).collect()
    assert {(r["stage"], r["treatment"]) for r in pos} == {(s, n) for s, n, *_, e in GOLDEN if e > 0}


def test_effects_min_arm_rule(spark):
    df = spark.range(30).select((F.col("id") < 5).cast("int").alias("t"), (F.col("id") % 2).alias("y"),
                                F.lit("s").alias("k"))
    assert treatment_effects(df, ["k"], {"t": "t"}, "y").count() == 0  # treated arm has 5 ≤ 10 rows


def test_prepare_cohort_follows_study_rules(spark):
    from cohortlens.operators.cohort import prepare_cohort

    data = [
        (60, 3.5, "III", "Radiation, Chemotherapy", 6, 10, "Deceased", "A,B", "Yes"),
        (50, 2.0, "IV", None, 4, 0, None, None, "No"),
        (40, 1.0, "II", "Surgery", 1, 1, "Alive", "None", "Yes"),
        (70, 4.0, None, "Surgery", 2, 2, "Alive", "A", "Maybe"),
    ]
    schema = ("Age int, TumorSize double, CancerStage string, TreatmentType string, ChemotherapySessions int, "
              "RadiationSessions int, SurvivalStatus string, Comorbidities string, Metastasis string")
    out = {r["Age"]: r for r in prepare_cohort(spark.createDataFrame(data, schema)).collect()}
    assert set(out) == {60, 50}  # stage filter III/IV; NULL stage dropped by isin
    a, b = out[60], out[50]
    assert (a["stage_code"], a["advanced"], a["Received_Radiation"], a["Received_Chemotherapy"]) == (3, 1, 1, 1)
    assert (a["chemo_intensity"], a["radiation_intensity"], a["comorbidity_count"], a["metastasis"]) == (6, 10, 2, 1)
    assert a["outcome"] == 1 and b["outcome"] == 0  # NULL status counts as alive (N3)
    assert (b["Received_Surgery"], b["chemo_intensity"], b["comorbidity_count"], b["metastasis"]) == (0, 0, 0, 0)


def test_stratified_shares_regex(spark, patients):
    out = {(r["stratum"], r["value"]): (r["count"], r["share"]) for r in
           TB.stratified_shares(patients, "s", ["I", "IV"], "st", ["Alive", "Deceased"], match="regex").collect()}
    # 'I' as a regex selects all seven staged rows: 4 alive, 3 deceased
    assert out[("I", "Alive")] == (4, pytest.approx(4 / 7)) and out[("I", "Deceased")] == (3, pytest.approx(3 / 7))
    assert out[("IV", "Alive")] == (1, pytest.approx(1 / 3)) and out[("IV", "Deceased")][0] == 2


@pytest.mark.parametrize("k", [1, 10, 11, 500])
def test_more_distinct_than_is_exact_at_the_threshold(spark, k):
    df = spark.range(5000).select((F.col("id") % k).alias("x"))
    assert TB.more_distinct_than(df, "x", 10) is (k > 10)


def test_crosstab_never_drops_values_silently(spark):
    df = spark.createDataFrame([("a", "X"), ("a", "Z"), ("b", "Y"), ("b", None)], "r string, c string")
    with pytest.raises(Exception, match="outside"):
        TB.crosstab(df, ["r"], "c", ["X", "Y"]).collect()
    other = {r["r"]: (r["X"], r["Y"], r["other"]) for r in TB.crosstab(df, ["r"], "c", ["X", "Y"], unlisted="other").collect()}
    assert other == {"a": (1, 0, 1), "b": (0, 1, 0)}
    dropped = TB.crosstab(df, ["r"], "c", ["X", "Y"], unlisted="drop", row_domain={"r": ["a", "q"]})
    assert {(r["r"], r["X"], r["Y"]) for r in dropped.collect()} == {("a", 1, 0), ("q", 0, 0)}


def test_top_values_leave_missing_values_out_but_count_them(spark):
    df = spark.createDataFrame([(None,)] * 5 + [("a",)] * 3 + [("b",)] * 2, "v string")
    assert [(r["value"], r["percent"]) for r in TB.top_values(df, "v", 2).collect()] == [("a", 30.0), ("b", 20.0)]
