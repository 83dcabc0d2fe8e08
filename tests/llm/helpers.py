"""Small document tables with every awkward row, and plain versions to compare with."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators might use themselves.
    T.StructField("n_words", T.StringType()), T.StructField("id", T.StringType()), T.StructField("size", T.StringType()), T.StructField("shard", T.StringType()),
    T.StructField("__gw_part", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("rep_a", T.StringType()), T.StructField("h", T.StringType())])
WORDS = "the of and a in to it is was that river stone cloud amber quiet seven north field paper light winter glass".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + (r.choice("xyz") if r.random() < 0.2 else "") for _ in range(n))


def rows(seed=1):
    r = random.Random(seed)
    out = [(0, None), (1, ""), (2, " \t\n\r\x0b\x0c "), (3, "one two three"), (4, "ONE two three"), (5, "only four words here"), (6, sentence(r, 30000)), (7, "\n".join(["same line again"] * 9)), (8, "a a a a a a a a a a a a"), (9, "é漢字 🤖 ｗide ß " * 9)]
    base = sentence(r, 120)
    for k in range(10, 20):
        words = base.split()
        for _ in range(k - 10):
            words[r.randrange(len(words))] = r.choice(WORDS) + "q"
        out.append((k, " ".join(words)))
    out += [(20, base), (21, base.upper()), (22, base.replace(" ", "  \n"))]
    out += [(k, "\n".join(sentence(r, r.randint(3, 60)) for _ in range(r.randint(1, 6)))) for k in range(23, 60)]
    out += [(60, sentence(r, 40)), (None, sentence(r, 50)), (None, None)]
    full = [(i, t, ["en", "de", None][k % 3], [f"s{k % 4}", "s0", None][k % 3], None if t is None else len(t), "w", "i", "z", "q", "p", "x", "a", "h") for k, (i, t) in enumerate(out)]
    return full + [full[30], full[30], full[0]]  # repeated rows


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def components(items):
    """items: (id, text) -> {position: smallest id}, all pairs."""
    sets = [shingles(t) for _, t in items]
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(items))], [len(s) for s in sets]


def repeated_words(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})


def key(x):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in x)
