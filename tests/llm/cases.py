"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, pos int, keep_id string, fp string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards boil black quartz in a very large kettle tonight".split()


def rows(seed: int = 3):
    r = random.Random(seed)
    long = " ".join(r.choice(PROSE) for _ in range(30_000))
    texts = [None, "", "   \n\t ", "one", "one two", "One  two", PROSE and " ".join(PROSE), " ".join(PROSE) + ".", "\n".join(PROSE), " ".join(PROSE[:14]) + " and then something else entirely happened to us", long, "é ü ñ 日本 🙂 ß", "123 456", "x" * 5000]
    out = [(i, t, "en" if i % 2 else None, "src%d" % (i % 3) if i % 5 else None, None if t is None else len(t), 1, 2, "a", "b") for i, t in enumerate(texts)]
    out += [out[6], out[6][:0] + (40, *out[6][1:]), (None, "no id at all here", "en", None, 3, 1, 2, "a", "b"), (None, None, None, None, None, None, None, None, None)]
    out += [(100 + i, " ".join(r.choice(PROSE) for _ in range(60)), "en", "src1", 3, 1, 2, "a", "b") for i in range(12)]
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
