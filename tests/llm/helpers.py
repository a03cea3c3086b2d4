"""Plain versions of what the operators compute, for comparison on small inputs."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, start string, id string, size string, place string, bucket string, shard string, slot string, row_number long, target double, n long, t string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, width):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def groups(texts, width):
    """Component of each id by comparing all pairs; texts is a list of (id, text)."""
    parent = {i: i for i, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t, width)) for i, t in texts]
    for k, (a, s) in enumerate(sets):
        for b, t in sets[k + 1 :]:
            common = len(s & t)
            if s and t and 100 * common >= 80 * (len(s) + len(t) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in texts}


def prose(rng, n):
    return [rng.choice(("lo", "mi", "ra", "ten", "sul", "ver", "da", "que")) + rng.choice(("n", "s", "ta", "rio", "vel", "m")) + rng.choice(("", "a", "e", "is", "or")) for _ in range(n)]


def edited(rng, base, share):
    out = list(base)
    for k in rng.sample(range(len(out)), int(share * len(out))):
        out[k] = "x" + str(rng.randrange(10**9))
    return out


def rows(spark, pairs, sources=("a",)):
    """Documents with extra columns whose names clash with what operators use inside."""
    data = [(i, t, "en", sources[k % len(sources)], None if t is None else len(t), "x", None, "s", "p", "b", "keep", "o", 9, 0.5, 7, "t") for k, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(data, DOCS)


def odd_texts():
    """Null, empty, blank, one word, ties, a very long text and one very long word."""
    rng = random.Random(5)
    long = " ".join(prose(rng, 60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, "Two words"), (7, long), (8, "é" * 100_000), (9, "tail " * 300)]
