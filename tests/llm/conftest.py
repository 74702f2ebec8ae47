import pytest

TEXTS = [
    None,
    "",
    "  \n\t ",
    "one",
    "The quick brown fox, it's naïve; don't! " * 12,
    "The quick brown fox, it's naïve; don't! " * 12,
    "x▁y \t\n é ﬁ 漢字 😀 <|endoftext|> <s> <0x41>  a  ",
    "A" * 5000 + " " + "b" * 3000,
    " ".join(f"word{i}" for i in range(3000)),
    " ".join(f"word{i}" for i in range(2990)) + " other end",
    "a | b | c &&& ### " * 40,
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, a repeated row, and columns whose names clash with results."""
    rows = [(at, text, "en", f"s{at % 3}" if at else None, 0, 9, "x") for at, text in enumerate(TEXTS)]
    rows += [rows[4], (None, TEXTS[4], None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, score string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (8, 1, None), (10, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents whose other columns have names that the stages make up themselves."""
    names = "_of _epochs _last _copies _copy _ratios _rules _gone _again _id _node _component _key _score others key copies copy of node c0".split()
    rows = [(at, text, f"s{at % 3}", *[at * 100 + n for n in range(len(names))]) for at, text in enumerate(TEXTS)]
    rows += [rows[4], rows[8]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{name}` long" for name in names))
