"""Small tables with all that can be odd about them."""

from __future__ import annotations

import random

WORDS = "the of and to in is that for with this be on as at by from are was it an river stone cloud winter garden paper music silver mountain village engine bottle".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) if r.random() < 0.6 else r.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in text.split(" "))


#: columns beyond those of documents, whose names operators may use inside
EXTRA = ", key string, gone bigint, fp bigint, tile bigint, unit string, s bigint"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, extra=False, first=0):
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts, first)]
    schema = SCHEMA
    if extra:
        rows = [(*r, "k", 1, 2, 3, "u", 4) for r in rows]
        schema += EXTRA
    return spark.createDataFrame(rows, schema)


ODD = [None, "", " \n\t ", "one", "x" * 200_000, "the " * 20_000, "ünïcödé 你好 🌟"]
