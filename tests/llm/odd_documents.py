"""Documents with every oddity an operator has to stand."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, key string, row long, "
          "band int, hash long, n long, size long, root long, ranges string, spans string, `a.b` int")
WORDS = "the of and ation er in on that ther enti anin ouwh stion ingre hend loser oftion reti".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(words):
        out.append(rng.choice(WORDS) + rng.choice(WORDS) * rng.randint(0, 1))
        if i % 12 == 11:
            out[-1] += ".\n" if i % 24 == 23 else "."
    return " ".join(out)


def rows(texts):
    """Rows from (doc_id, text, lang, source); all columns after them carry clashing names."""
    return [(i, t, lang, source, None if t is None else len(t), 7, "k", 1, 2, 3, 4, 5, 6, "r", "s", 9)
            for i, t, lang, source in texts]


def odd_texts():
    base = prose(1, 120)
    return [
        (1, base, "en", "a"),
        (1, base, "en", "a"),  # a repeated row
        (2, base, "en", "b"),  # a copy
        (3, base.replace("the", "teh", 1), None, None),
        (None, base, "en", "a"),
        (None, None, None, None),
        (4, None, "en", "a"),
        (5, "", "en", "a"),
        (6, " \t\n ", "en", ""),
        (7, "x", "fr", "b"),
        (8, "é" * 5000 + " " + "z" * 200_000, "fr", "b"),  # very long, two words
        (9, prose(2, 60_000), "en", "a"),  # very long
        (10, "12345 678 !!! ...", "en", "c"),
        (11, "mail bob@example.org or +1 (456) 555-2186, not 1.2.3.4.5", "en", "c"),
        (12, prose(3, 80), "en", "c"),
        (12, prose(4, 80), "en", "c"),  # an id twice, with different texts
        (-5, prose(5, 80), "de", "\U0001f600"),
    ]


def odd_frame(frame):
    return frame(rows(odd_texts()), SCHEMA)


def empty_frame(frame):
    return frame([], SCHEMA)
