"""A small corpus with every awkward case, and the plain ways to judge it."""

import random

KIND = "doc_id long, text string, lang string, source string, n_chars long, h long, at string, `to` string, key string, kept string, rows string, taken string, cls int, `left` string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=1):
    """(doc_id, text, source): copies, near copies, shared passages, repeats within a text, empty, null, one very long."""
    rng = random.Random(seed)
    passage, other = words(rng, 80), words(rng, 60)
    base = [words(rng, rng.randint(1, 150)) for _ in range(40)]
    texts = list(base)
    texts += [base[3]] * 6 + [base[7] + "\t \n" + passage, passage + " " + base[9], words(rng, 10) + "\n" + passage + " " + words(rng, 5)]
    texts += [other + " " + passage, other + " x " + passage, passage, passage + " " + other]
    texts += [" ".join(base[k].split()[:-1] + ["changed"]) for k in range(8)]
    texts += ["", None, " \n\t", "one", "one two", "One TWO", "a" * 900, "ab " * 400, "Ärger über Öl — naïve café " * 12, "\x00\x1c odd\x85space\u3000wide " * 9, "100 % <|im_start|> <|endoftext|> it's"]
    texts += [words(rng, 3000) + " " + passage + " " + words(rng, 3000), None, ""]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3 + 1, texts[k], "big" if i % 3 else f"s{i % 4}") for i, k in enumerate(order)]


def frame(spark, rows=None, extra=()):
    """The corpus as documents, with columns whose names clash with ones used inside."""
    rows = corpus() if rows is None else rows
    made = [(i, t, "en", s, None if t is None else len(t), 7, "a", "b", "c", "d", "e", "f", 1, "g") for i, t, s in rows]
    return spark.createDataFrame(made + list(extra), KIND).repartition(3)


def odd_rows():
    """A row of nulls, one without an id, and one row twice."""
    nothing = (None,) * 14
    return [nothing, (None, "a text without any id " * 9, None, None, None, *nothing[5:]), *[(100001, "said twice, " * 30, None, None, None, *nothing[5:])] * 2]


class Union:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def find(self, k):
        while self.up[k] != k:
            k = self.up[k]
        return k

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
