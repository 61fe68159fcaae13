import random
import re

import pytest

import flowsift.llm.queries as registered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(n, seed):
    pick = random.Random(seed)
    return " ".join(pick.choice(["the", "wide", "river", "of", "stone", "runs", "past", "old", "mill", "and", "house"]) + str(pick.randrange(40)) for _ in range(n))


ODD_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "One two",
    "a b c d e f a b c d e",
    "x\n\nx\n x\nx",
    "w " * 30_000,
    "longwordwithoutanyend" * 4_000,
    "é ö 中文 😀 x́  � ​ İ Σ",
    "<|endoftext|> and <|startoftext|>",
    prose(200, 1),
    prose(200, 1) + " end",
    prose(200, 2),
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd texts, each once more with null columns, with repeated rows, a null id and columns whose names clash."""
    rows = [(i, t, "en", "host", 0) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100 + i, t, None, None, None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "some text", "en", "host", 9), (3, "one", "en", "host", 0), (3, "one", "en", "host", 0)]
    clash = ", ".join(f"`{c}` string" for c in ("shard", "ids", "fp", "row", "words", "kept", "host", "_host", "_digest", "spans", "digit", "part"))
    table = [(*r, *[f"x{k}" for k in range(12)]) for r in rows]
    return spark.createDataFrame(table, f"{SCHEMA}, {clash}").repartition(3)


@pytest.fixture(scope="session")
def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return registered.documents(spark, sf_dir)
