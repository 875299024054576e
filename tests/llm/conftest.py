import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, class string, bucket int, size string, label string, _id int, h1 int, path string, host string, shard string"
BASE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def row(doc_id, text, source="s0"):
    return (doc_id, text, "en", source, len(text or ""), "k", "i", "c", 1, "s", "l", 1, 1, "p", "h", "x")


#: Nulls, empty texts, white space, repeated rows, equal texts, ties, long texts.
ROWS = [
    row(1, BASE + "\nShared line of text here\nEnd one"),
    row(2, BASE + "\nShared line of text here\nEnd two"),
    row(3, BASE.lower() + "\n  shared LINE of text here \t\nEnd one"),
    row(4, None, None),
    row(5, "", "s1"),
    row(6, " \n\t\n ", "s1"),
    row(7, "word", "s2"),
    row(8, "Word", "s2"),
    row(9, "word word", "ä"),
    row(10, "Éa é Ünï " * 40, "ä"),
    row(10, "Éa é Ünï " * 40, "ä"),
    row(11, "x" * 3000, "s1"),
    row(12, "tail " * 9000, "s0"),
    row(13, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nmit licenses mit license", "s2"),
    row(14, "This work is licensed under the GNU General Public License, version 3.", None),
    row(15, "cc by cc by\nthe license, Apache!\nApache\nLicense", "s1"),
    row(None, BASE, "s0"),
    row(None, None, "s0"),
    row(20, "\n".join(f"line number {i} of twenty" for i in range(20)), "s3"),
    row(21, "\n".join(f"line number {i} of twenty" for i in range(19)) + "\nother", "s3"),
    row(22, "\n".join(f"line number {i} of twenty" for i in range(20)), "s3"),
]


@pytest.fixture(scope="session")
def edge_rows():
    return ROWS


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
