"""Small tables for the corpus operators."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names operators use themselves
CLASH = {"id": "'x'", "size": "1", "score": "0.5", "row": "7", "copy": "9", "key": "'k'", "rate": "2", "lang_pred": "'q'", "_row": "3"}


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, near copies, shared passages."""
    long = prose(1, 30_000)
    base = prose(2, 120).split()
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (20, 60, 90)]
    shared = prose(3, 60)
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \t\n ", "en", "b", 3), (4, "one", "de", None, 3), (5, "12 34", "en", "a", 5),
        (6, long, "en", "a", len(long)), (7, long, None, "b", None), (None, prose(4, 50), "en", "a", None), (8, "A b C", "fr", "c", 5),
        (9, "a B c", "fr", "c", 5), (10, " ".join(base), "en", "a", 1), *((11 + i, x, "en", "a", 1) for i, x in enumerate(near)),
        (20, f"{prose(5, 30)} {shared} {prose(6, 30)}", "en", "a", 1), (21, f"{shared} {prose(7, 10)}", "en", "b", 1), (22, "x " * 300, "en", "b", 600),
    ]
    return [*rows, rows[10], rows[3]]  # repeated rows


def clashing(docs):
    return docs.selectExpr("*", *[f"{v} AS {k}" for k, v in CLASH.items()])
