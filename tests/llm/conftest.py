"""A small documents table with the awkward cases every operator must take."""

import pytest

WORDS = "the cat sat on a mat and then it ran off to see who was there"
AWKWARD = [
    (1, f"{WORDS}. {WORDS}!", "en", "s0"),
    (2, f"{WORDS}. {WORDS}!", "en", "s0"),
    (3, None, "en", "s1"),
    (4, "", None, "s1"),
    (5, "  two  blanks\n\nand <|endoftext|> lines \t", "en", None),
    (6, "café “quoted” 日本語 😀 naïve", "fr", "s2"),
    (7, "word " * 3000, "en", "s2"),
    (None, "no id here, mail bob@example.com", "en", "s2"),
    (8, "repeated row with the same id", "en", "s3"),
    (8, "repeated row with the same id", "en", "s3"),
    (9, "x" * 5000, "de", "s3"),
    (10, "12345 67890 ...", "de", "s3"),
    (11, " \t", "de", "s3"),
    (12, "\n word", "de", "s3"),
    (13, "½ ² Ⅷ", "de", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def save(spark, tmp_path_factory):
    """Writes rows as a documents table; returns the folder."""

    def put(rows):
        folder = str(tmp_path_factory.mktemp("sf"))
        rows = [(*r, len(r[1] or "")) for r in rows]
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
        return folder

    return put


@pytest.fixture(scope="session")
def awkward(save):
    return save(AWKWARD)


@pytest.fixture(scope="session")
def empty(save):
    return save([])
