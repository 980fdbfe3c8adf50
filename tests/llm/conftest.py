import pytest

LONG = "lorem ipsum dolor sit amet " * 9000 + "x" * 70000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, ties, repeated rows and clashing columns."""
    rows = [
        (1, "Alpha beta gamma delta", "en", "src0"), (2, "Alpha  beta\tgamma delta", "en", "src0"),
        (3, "alpha beta gamma delta", "en", "src1"), (4, None, "fr", "src1"), (5, "", None, "src2"),
        (6, " \t\n\x0b\f\r ", "de", None), (7, LONG, "en", "src0"), (8, LONG, "en", "src0"),
        (9, "un mot", "fr", "src4"), (9, "un mot", "fr", "src4"), (None, "un mot", "fr", "src4"),
        (10, "Ünï çödé ▁mark  two\x1c😀 \U0001f9ff <s> 0x41", "es", "src5"), (11, "a", "es", "src5"),
        (12, None, None, None)]
    extra = [(*r, len(r[1] or ""), "clash", "clash", 0.5, "clash", "clash", True) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, "
                                 "_id string, _text string, score double, _doc string, epoch string, kept boolean")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (3, 1, 1), (3, 0, 0), (4, None, None), (None, 1, 1), (9, 0, 1)],
        "doc_id long, quality int, toxic int")
