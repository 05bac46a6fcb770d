import random

import pytest

SF = "/root/testdata/sf0.001"
#: Names that operators use inside.
EXTRA = ["spans", "fp", "score", "keep", "rank", "u", "size", "text_key", "rejected", "words", "host", "kept", "ids", "target"]


def edge_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    passage = " ".join(rng.choice(words) for _ in range(150))
    return [
        (1, "Hello world, all rights reserved. token = 'abcDEF123456' end", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, long, "fr", "b"),
        (5, "Hello world, all rights reserved. token = 'abcDEF123456' end", "en", None),
        (1, "Hello world, all rights reserved. token = 'abcDEF123456' end", "en", "a"),
        (None, "no id here cc by cc by 0123456789abcdef0123456789abcdef", "fr", "c"),
        (6, " \n\t \x0b", "de", "b"),
        (7, "12345 !!! #$% \n12345 !!! #$% \n12345 !!! #$% ", "es", "b"),
        (8, "start " + passage + " stop", "de", "c"),
        (9, "begin " + passage + " finish " + passage, "de", "c"),
        (10, "ab " * 700, "en", "a"),
        (11, passage + " <|endoftext|> AKIA" + "A" * 20 + " 漢字🙂 ünï", "es", "d"),
        (12, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "en", "d"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(*r, len(r[1]) if r[1] is not None else None, *[f"x{k}" for k in range(len(EXTRA))]) for r in edge_rows()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
