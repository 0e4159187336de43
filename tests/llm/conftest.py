import random

import numpy as np
import pytest

WORDS = "alpha beta gamma delta one two three the of and to in on été naïve straße".split()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with names that operators use."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    base = prose(120)
    rows = [(1, base, "en"), (1, base, "en"), (2, base + " tail", None), (3, None, "en"), (4, "", "fr"), (None, prose(60), "fr"), (None, None, None), (5, prose(6000), "fr"), (6, "x", "en"), (7, " \n\t ", "en"), (-9, "123 456", None)]
    return spark.createDataFrame([(*r, "s", len(r[1] or ""), "k", 1, 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, score double")


@pytest.fixture(scope="session")
def library():
    """The tokenizer as its file has it, with nothing set."""
    from tokenizers import Tokenizer

    from dissona.llm.tokens import default_path

    return lambda text, read=Tokenizer.from_file(default_path()): np.array(read.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
