"""Small tables with every awkward row: nulls, empty and blank texts, a very long one, copies."""

import random

WORDS = "the of and to in is on with from that this which was are an or by for".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, part string, node int"


def sentence(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing"]) + str(rng.randrange(9)) * (rng.random() < 0.2) for _ in range(n))


def rows():
    base = sentence(1, 60)
    texts = [None, "", " \n\t ", "one", base, base, base.upper(), base + " more", sentence(2, 40), "!!! ... ###",
             "mail a.b@c.example.org or +1 (555) 555-0100 at 10.0.0.1, card 4111 1111 1111 1111.", sentence(3, 20_000), "😀 é ß 日本語 x"]
    made = [(i, t, "en" if i % 3 else None, "s", len(t or ""), 7, "p", 1) for i, t in enumerate(texts)]
    made += [made[4], made[4], (None, "an id is missing here", "en", None, None, None, None, None)]
    return made


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def parquet(spark, tmp_path, name, df):
    path = f"{tmp_path}/{name}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)
