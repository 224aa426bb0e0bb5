import re

import public_tokenizers
import pytest

LONG = " ".join(f"word{i % 977} thé" for i in range(20_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


@pytest.fixture
def tokenizer_path():
    return public_tokenizers.path


@pytest.fixture
def awkward(spark):
    """Documents with nulls, empty and very long texts, repeated rows and columns that operators use inside."""
    texts = [
        (0, "The cat sat on the mat and looked at the dog for a while."),
        (1, "The cat sat on the mat and looked at the dog for a while."),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, LONG),
        (6, "x"),
        (7, f"Before it. {PASSAGE.upper()}, after it"),
        (7, f"Before it. {PASSAGE.upper()}, after it"),
        (None, "a row without an id, but with some words in it"),
        (None, None),
        (8, "12345 67890 !!! ???"),
        (9, "naïve\u2581 façade  two  spaces \x00 \ud7ff 😀 <|endoftext|> </s>"),
    ]
    rows = [(i, t, "en", "s", "k", b"n", 1, 2.0, "p", [1], 3) for i, t in texts]
    schema = (
        "doc_id long, text string, lang string, source string, key string, node binary, n_words int, score double, "
        "lang_pred string, ids array<int>, slot int"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def none_at_all(awkward):
    return awkward.filter("false")
