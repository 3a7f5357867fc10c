"""A small table with what goes wrong: nulls, empty and long texts, repeated rows, ties, and columns with clashing names."""

import random

WORDS = "the of and that is river stone morning paper garden über naïve façade señor 日本 語 data engine plan".split()
DDL = "`TEXT` string, doc_id long, text string, digest string, id long, `row` int, source string, n_chars long, lang string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    passage = sentence(rng, 20)
    out = []
    for i in range(n):
        text = sentence(rng, rng.randrange(1, 60))
        if i % 5 == 0:
            text += "\n" + passage + "\n" + sentence(rng, 5)
        if i % 4 == 0:
            text = "  COMMON Line \t\n" + text
        out.append((i, text))
    base = out[7][1] + " " + sentence(rng, 80)
    out += [(100 + i, base.replace(base.split()[3 * i + 5], "changed", 1)) for i in range(6)]
    out += [(200 + i, base if i % 2 else base.upper()) for i in range(4)]
    out += [(300, None), (301, ""), (302, ""), (303, "\n\n"), (304, " "), (305, "😀 é　x\x1c\ta  b"), (306, "word " * 5000), (307, "same"), (307, "same"), (308, sentence(rng, 4000))]
    return [("x", i, t, "d", 1, 2, f"src{i % 3}" if i % 3 else None, len(t or ""), "en") for i, t in out]


def table(spark, given=None):
    return spark.createDataFrame(rows() if given is None else given, DDL)


def texts(given=None):
    return [(r[1], r[2] or "") for r in (rows() if given is None else given)]


def sorted_rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
