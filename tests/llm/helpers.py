import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, vocabulary=400, seed=0):
    base = random.Random(seed)
    some = ["".join(base.choices("abcdefghijklmnop", k=base.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(r.choices(some, k=n))
