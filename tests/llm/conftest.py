import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward shape, and extra columns whose names clash with the operators' own."""
    long_ = " ".join(f"w{i % 997}x{i}" for i in range(6000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here to there", "en"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here to there", "en"),
        (3, None, None),
        (4, "", "en"),
        (5, " \t\n ", None),
        (6, "wort für wort größer Straße über alle Maßen", "de"),
        (7, long_, "en"),
        (8, long_ + " end", "en"),
        (8, "repeated id with other text", "en"),
        (9, "a", "en"),
        (10, "!!! *** 123 ###", None),
        (None, "no id at all but with some words in it", "en"),
        (11, "日本語のテキスト 🎉 mixed with ascii", "ja"),
        (12, "prefix " + long_[:400] + " suffix", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7, 8, 9) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, block int, id int, range int")


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.where("false")
