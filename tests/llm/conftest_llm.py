"""The rows that the tests of this folder share."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return.
CLASHES = "n_tokens long, key string, at string, w string, h string, _row long, score double, rep long, v string, bands string, h1 long"


def phrase(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeilmnorstu") for _ in range(draw.randint(2, 7))) for _ in range(words))


def odd_rows() -> list[tuple]:
    shared, long = phrase(1, 70), phrase(2, 30_000)
    base = phrase(3, 200).split()
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "two Words",
        "ÉCOLE naïve Straße 日本語 ñandú   x",
        "no end. " * 40,
        "!!! ??? ... 123",
        shared,
        phrase(4, 30) + " " + shared + " " + phrase(5, 30),
        phrase(6, 10) + " " + shared.upper(),
        shared + "\n" + shared,
        long,
        "x" * 60_000,
        " ".join(base),
        " ".join(base),
        " ".join(base[:100] + ["CHANGED"] + base[101:]),
        " ".join(base[:50] + ["other"] + base[51:150] + ["more"] + base[151:]),
        "same line\n" + phrase(7, 20),
        "<|endoftext|> and </s> <unk> ▁▁ a  b   c ",
    ]
    rows = [(3 * k, t, ["en", "de", None][k % 3], f"s{k % 4}", None) for k, t in enumerate(texts)]
    rows += [rows[9], rows[9], (3 * 9, "another text of the same id", "en", None, 1), (None, shared, "en", "s1", 2), (None, None, None, None, None)]
    rows += [(200 + k, f"same line\n{phrase(100 + k, 25)}\n\nsame line", "en", f"site{k}", 5) for k in range(12)]
    return rows


def ids(rows: list[tuple]) -> list:
    return sorted((r[0] is None, r[0] or 0) for r in rows)
