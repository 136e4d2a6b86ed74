import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, size int, component_id string, takes string, s string, n_tokens string"
LONG = " ".join(f"word{i} and{i % 7}" for i in range(30_000))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every awkward case: nulls anywhere, empty, blank and very long texts, repeated rows, ids and texts, and columns whose names operators use."""
    texts = [None, "", "   \n\t", "one", "two words", LONG, LONG + " x", "Ünïcödé ß 漢字 😀 é ́", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", "A B C D E F G H I J K L M N O P", "it's don't 're <|endoftext|> 12 \x1c x  y"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "x", None, 7, "c", None, "s", "n") for i, t in enumerate(texts)]
    rows += [rows[3], rows[8], (8, "another text under the same id", None, "s1", 1, *rows[0][5:]), (None, "no id at all", None, None, None, *rows[0][5:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
