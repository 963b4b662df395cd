"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

from pyspark.sql import types as T

WORDS = "the of and in a to it is Über straße ñandú d'été x1 foo, bar. BAZ qux# lorem ipsum dolor sit amet 東京 🙂".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + (rnd.choice(WORDS) if rnd.random() < 0.4 else "") for _ in range(n))


def docs(seed=0, n=60):
    rnd = random.Random(seed)
    base = prose(rnd, 300)
    out = [(-5, None), (-4, ""), (-3, "   \n\t \n"), (-2, "one two"), (-1, "one two"), (2**40, "Ein Wort zweí J̌ <|endoftext|> don't O'Neil's it'll 12345")]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = prose(rnd, rnd.randint(1, 120))
        elif kind == 1:
            w = base.split()
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(["zig", "zag"])
            t = " ".join(w)
        elif kind == 2:
            t = "\n".join(rnd.choice(["Home | About", " home | about\t", "Share this", "", prose(rnd, 5)]) for _ in range(rnd.randint(1, 12)))
        elif kind == 3:
            at = rnd.randrange(200)
            t = prose(rnd, 30) + " " + " ".join(base.split()[at : at + rnd.randint(20, 90)]) + "\n" + prose(rnd, 20)
        elif kind == 4:
            t = prose(rnd, 20) + f""" password = "{'a' * rnd.randint(3, 9)}" Secret=token:abcdefg API_KEY:'x.y=zz/9' AKIA{'Q7' * rnd.randint(4, 10)} {'0af3' * rnd.randint(5, 9)}z """ + prose(rnd, 10)
        else:
            t = " ".join([rnd.choice(["again", "and"]), "more"] * rnd.randint(10, 60))
        out.append((i, t))
    out.append((n, base))
    out.append((n + 1, base.upper()))
    out.append((n + 2, prose(rnd, 3000) + " " + base + " " + base))
    return out


SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("k", T.StringType()), ("th", T.LongType()), ("n", T.StringType()), ("w", T.LongType()), ("s", T.DoubleType()))])


def frame(spark, rows):
    """The rows as documents, with columns whose names clash with those inside operators."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", 1, None, 7, 0.5) for i, t in rows], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def same(found, wanted):
    assert found == sorted(wanted, key=repr)
