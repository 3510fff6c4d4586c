"""Small documents with everything that can go wrong, and brute-force helpers."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns, named like columns the operators use themselves.
EXTRA = ["row", "block", "size", "draw", "copies", "score", "bits", "hash", "hits", "n_words", "host", "position", "held_out", "n_chars"]


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + (".\n" if rng.random() < 0.08 else "") for _ in range(n))


def rows(seed=7):
    rng = random.Random(seed)
    base = [prose(rng, 120) for _ in range(12)]
    shared = prose(rng, 60)
    out = [(i, t, f"src{i % 3}") for i, t in enumerate(base)]
    out += [(20 + i, base[0], "src0") for i in range(15)]  # copies
    out += [(40 + i, base[1].replace("w1", f"x{i}", 1), None) for i in range(6)]  # near copies
    out += [(50 + i, prose(rng, 20) + " " + shared + " " + prose(rng, 25), "src1") for i in range(6)]  # a shared passage
    out += [
        (60, None, "src0"), (61, "", "src2"), (62, " \n\t ", None), (63, "one", "src1"), (64, "ÄÖ ü x y", "Ω"),
        (None, base[2], "src2"), (None, None, None), (None, prose(rng, 40), "src0"),
        (70, prose(rng, 20_000, 5_000), "src1"), (71, "same " * 300, "src1"), (72, "a\nb c\nb c\n\n \nB c\nb c", "src2"),
        (73, prose(rng, 30), "src0"), (73, prose(rng, 30), "src0"),  # one id, two texts
        (74, base[3], "src1"), (74, base[3], "src1"),  # a repeated row
        (75, "ABC Def ghi JKL", "src9"), (76, "abc def GHI jkl", "src9"), (77, "x" * 50_000, "src9"),
    ]
    return out


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in EXTRA]
)


def documents(spark, found=None):
    found = rows() if found is None else found
    return spark.createDataFrame([(i, t, "en", s, *[j for j, _ in enumerate(EXTRA)]) for i, t, s in found], SCHEMA).repartition(5)


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
