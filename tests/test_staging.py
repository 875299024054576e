import pytest
from pyspark.sql import functions as F

from gaugespark.functions import texts
from gaugespark.operators import staging

CT = "\nStaging CT chest and abdomen: "
#: Report and its t, n, m, involved, examined, deposits.
REPORTS = [
    ("Growth reaches the subserosa. Lymph nodes: 2/19 positive. No tumor deposits." + CT + "No distant disease.", ("T3", "N1b", "M0", 2, 19, 0)),
    ("Perforation of the tumor is seen. Cancer in 0 of 21 lymph nodes. Tumor deposits: 3." + CT + "Enlarged para-aortic nodes, metastatic; no other disease.", ("T4a", "N1c", "M1a", 0, 21, 3)),
    ("Cancer invades the bladder. Nine of 20 lymph nodes positive (9/20). Tumor deposits: none." + CT + "Liver and adrenal metastases.", ("T4b", "N2b", "M1b", 9, 20, 0)),
    ("Carcinoma in situ; no invasion of the submucosa. Lymph nodes negative (0/14). Deposits: absent." + CT + "Omental caking.", ("Tis", "N0", "M1c", 0, 14, 0)),
    ("It grows into, but not through, the muscularis propria. Lymph nodes: 1 of 16 involved.\nOne tumor deposit (1)." + CT + "Unremarkable.", ("T2", "N1a", "M0", 1, 16, 1)),
    ("The tumor is adherent to the bladder but grows through the muscularis propria only.", ("T3", None, None, None, None, None)),
    ("It is adherent to and invades the uterus.", ("T4b", None, None, None, None, None)),
    ("Submucosa is reached. One of twelve nodes with isolated tumor cells.", ("T1", "N0", None, 0, 12, None)),
    ("Three of 14 nodes are involved.", (None, "N1b", None, 3, 14, None)),
    ("Lymph nodes: 15 examined, five involved.", (None, "N2a", None, 5, 15, None)),
    ("No perforation. It does not extend beyond the submucosa.", ("T1", None, None, None, None, None)),
    ("Invades the muscularis propria, without involvement of the serosa. Margins free at the serosa.", ("T2", None, None, None, None, None)),
    ("The serosa is intact; the subserosa is involved. Size 3.5 cm.", ("T3", None, None, None, None, None)),
    ("Specimen: colon and bladder\nGrowth into the submucosa.", ("T1", None, None, None, None, None)),
    ("A non-regional node is positive. Of the regional nodes none of 12 is involved.", (None, "N0", "M1a", 0, 12, None)),
    ("Nodes: none involved." + CT + "liver lesions; no lung nodules. Bones are clear.", (None, "N0", "M1a", 0, None, None)),
    (CT + "No liver, lung or bone lesions.", (None, None, "M0", None, None, None)),
    (CT + "Liver cyst.", (None, None, "M0", None, None, None)),
    ("Lymph nodes: see addendum.", (None,) * 6),
    ("", (None,) * 6),
    (None, (None,) * 6),
]


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPORTS)], "id int, report string")
    return {r.id: (r.t, r.n, r.m, r.involved, r.examined, r.deposits) for r in staging.read_reports(df, "id", "report").collect()}


@pytest.mark.parametrize("i", range(len(REPORTS)))
def test_report(read, i):
    assert read[i] == REPORTS[i][1]


def test_equal_reports_are_read_once(spark):
    """The expression stands over distinct texts, and each report gets what its text says."""
    df = spark.range(40).selectExpr("id", "concat('Three of 14 nodes are involved. Size ', id % 2, '.') AS report")
    read = staging.read_reports(df, "id", "report")
    assert "aggregate(" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.n, r.involved, r.examined) for r in read.collect()} == {("N1b", 3, 14)} and read.count() == 40


def test_words_are_looked_up_in_short_maps(spark):
    """All words of the vocabulary have their own token, and a number too long for one has none."""
    words = [w for w, _ in staging._entries() if w.isalpha()]
    got = spark.createDataFrame([(" ".join(words) + " 1234567890 123456789 zz",)], "t string").select(staging.tokens(F.col("t")).alias("x")).first().x
    assert [tuple(x) for x in got[:-2]] == [t for w, t in staging._entries() if w.isalpha()]
    assert [tuple(x) for x in got[-2:]] == [("number", 123456789, ""), ("line", 0, "")]


def test_runs_of_words_split_their_text_once(spark):
    df = spark.createDataFrame([("a b c d",), ("a b",), ("",), (None,)], "t string")
    read = df.select(texts.word_runs(texts.words(F.col("t")), 3).alias("r"))
    assert [r.r for r in read.collect()] == [["a b c", "b c d"], [], [], []]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
