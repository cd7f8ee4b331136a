"""Small document tables that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h int, size int, `group` string, fp string"


def text_of(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def documents(seed=0, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append([i, text_of(rng, rng.choice([3, 25, 60, 150])), "en", rng.choice(["a", "b", "b", "ß", None]), 1, 1, 1, "g", "x"])
    rows[3][1] = None
    rows[4][1] = ""
    rows[5][1] = " \n\t "
    rows[6][1] = rows[7][1] = rows[8][1] = text_of(rng, 80)
    rows[9][1] = rows[6][1] + " tail"
    rows[10][1] = "a line\nof text\na line\n a line\n\n\n" * 12
    rows[11][1] = text_of(rng, 20_000)
    rows[12][1] = "one two three four five six seven eight " * 9
    rows[13][1] = "Grüße ### \x85 $$ <b>   ok"
    rows[14][1] = rows[15][1] = "MiXed CASE Ünï words here"
    rows.append(list(rows[20]))
    return [tuple(r) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
