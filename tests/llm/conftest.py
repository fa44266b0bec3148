import random

import pytest

SYLLABLES = "an be con da el for ga hi in jo ka lo mi no or pa que ra si to un va wo xe yu ze".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 3))) for _ in range(n))


PASSAGE = prose(999, 90)
#: Nulls, empty and blank texts, copies, near copies, repeated passages, repeated rows, one long text, odd characters.
ROWS = [
    (1, prose(1, 120)), (2, prose(1, 120)), (3, prose(1, 119) + " changed"), (4, prose(4, 60) + " " + PASSAGE + " " + prose(5, 60)), (5, PASSAGE + "\n" + prose(6, 80)), (6, None), (7, ""), (8, " \n\t "),
    (9, "one"), (9, "one"), (10, "un dos"), (11, prose(7, 30) + " <|endoftext|> <|im_end|> \\ <|x"), (None, prose(8, 40)), (12, "ñandú Ünïcode 日本語 🙂 " * 30), (13, ("same line here\n" * 40)), (14, prose(9, 6000)), (15, "a" * 1500), (16, PASSAGE.upper()),
]


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with extra columns whose names clash with those of operators, in different case too."""
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), "x", 1.5, b"z") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double, TEXT_ binary").repartition(3)


@pytest.fixture(scope="session")
def wide(documents):
    """The same rows where other columns' names differ from the needed ones in case only, or are an operator's own."""
    own = "Text DOC_ID Doc_id f h r z u own part size shard row_key label bucket raw n fingerprint component_id n_tokens sequence_id predicted held_out kept_text".split()
    return documents.selectExpr("doc_id", "text", *[f"'x' as {c}" for c in own])


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")


@pytest.fixture(scope="session")
def corpus(spark):
    """Labelled documents: toxic ones have insults, bad ones symbols or loops."""
    docs, labels = [], []
    for i in range(240):
        toxic, bad = i % 4 == 0, i % 3 == 0
        words = prose(5000 + i, 70).split()
        if toxic:
            for k in (10, 30, 50):
                words[k] = random.Random(i + k).choice(["stupidest", "wretched", "worthless"])
        text = " ".join(w + "###" for w in words) if bad and i % 2 else " ".join(["loop", "loop", "back"] * 30) if bad and not toxic else " ".join(words)
        docs.append((i, text))
        labels.append((i, int(not (bad and (i % 2 or not toxic))), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
