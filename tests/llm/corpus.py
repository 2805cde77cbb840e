"""Small made-up tables with the odd cases that every operator must bear."""

import random

WORDS = "ledger table value row column metric period total share cost asset margin growth revenue unit scale header cell".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", str(rng.randint(0, 99))]) for _ in range(n))


def documents(seed=1):
    """(doc_id, text, source): copies, near copies, shared passages, blank and null texts, repeated rows, a long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 90)) for _ in range(12)]
    passage = prose(rng, 40)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for i in range(12, 18):
        words = base[i - 12].split()
        words[rng.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words), "s0"))
    rows += [(18, base[3], "s1"), (19, base[3].upper(), None), (20, f"{prose(rng, 50)}\n{passage}", "s2"), (21, f"{passage}\n{prose(rng, 60)}", "s2")]
    rows += [(22, "", "s0"), (23, None, "s0"), (24, " \n\t ", None), (25, "one two", "s1"), (26, "One  two", "s1"), (27, "aaaa " * 200, "s0"), (28, "é€😀 " * 90 + passage, "s0")]
    rows += [(29, prose(rng, 6000), "s1"), (30, base[5], "s2"), (30, base[5], "s2"), (None, base[6], "s0")]
    rows += [(40 + i, f"Common Line \nown line {i}\n\ncommon line\n{prose(rng, 12)}", "s1") for i in range(12)]
    return rows


def frame(spark, rows, extra=True):
    """With columns beyond the contract, whose names clash with results."""
    schema = "doc_id long, text string, source string"
    df = spark.createDataFrame(rows, schema)
    if not extra:
        return df
    for name in ("n_lines", "size", "n", "component_id", "bucket", "th"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df
