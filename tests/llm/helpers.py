"""Small tables for the edges that every operator must bear."""

import re

SPACES = r"[^\x20\x09-\x0D]+"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()

#: Extra columns whose names operators use inside themselves.
CLASHING = ["row", "id", "size", "hash", "salt", "norm", "draw", "slice", "rank", "text_hash", "fingerprint", "score", "predicted", "y", "rated_id", "drop_id", "drop_hash", "plan_source", "copies", "host", "page", "keep_id", "start", "group", "shard"]


def words(text):
    return re.findall(SPACES, text or "")


def prose(seed, n):
    """n words, reproducible."""
    out, state = [], seed * 7919 + 13
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state >> 16 & 15] + WORDS[state >> 8 & 7])
    return " ".join(out)


def edge_texts():
    """(doc_id, text): nulls, empties, repeats, ties, one very long text and odd characters."""
    long = prose(1, 20_000)
    return [
        (5, "one two three"), (6, "one  two\tthree"), (7, "onetwothree"), (8, None), (9, ""), (10, " \n\t "), (5, "one two three"), (None, "one two three"), (None, None),
        (11, long), (12, long + " end"), (13, "é ☃ 𝄞 \u00a0x"), (14, "x" * 70_000), (15, prose(2, 60)), (16, prose(2, 60)), (17, prose(2, 60) + " more"), (18, "A\x0bB\x0cC\rD"), (19, "\x00 null byte"),
    ]


def edge_docs(spark, clashing=True):
    rows = [(d, t, None if (d or 0) % 5 == 0 else f"s{(d or 0) % 3}", *["clash"] * (len(CLASHING) if clashing else 0)) for d, t in edge_texts()]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{c}` string" for c in CLASHING if clashing)]))
