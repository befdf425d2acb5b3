"""A small corpus with the cases that every operator must take: nulls, empty and very long texts, ties, repeated rows, odd names."""

from __future__ import annotations

import random

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or".split(), "fr": "le de ai eu ou an ré è que tion ment".split(), "de": "ch ei sch en er ung ß ö ver lich".split()}


def prose(rng: random.Random, lang: str, words: int) -> str:
    out = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    for k in range(0, words, 9):
        out[k] = out[k].capitalize()
        if k:
            out[k - 1] += rng.choice([".", ".\n", ","])
    return " ".join(out)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score string, base string, spans string, terms string, i string, a string, hit_items string, component string, h string"


def corpus_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[tuple[str | None, str | None]] = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        texts.append((prose(rng, lang, rng.choice([1, 3, 5, 40, 120])), lang))
    big = prose(rng, "en", 20_000)
    near = texts[3][0].split(" ") if len(texts[3][0]) > 400 else prose(rng, "en", 120).split(" ")
    texts += [(None, "en"), ("", "fr"), ("   \n\t ", None), ("12 34 !!", "de"), (big, "en"), (big.replace("a", "A"), "en"), ("x" * 50_000, None)]
    texts += [(" ".join(near), "en"), (" ".join(near[:-1]), "en"), ("  ".join(near).upper(), "en"), ("é" * 30 + " ß \x00 \x1f 日本語 😀", None)]
    texts += [texts[5]] * 4
    rows = [(k, t, l, f"src{k % 3}", None if t is None else len(t), *["z"] * 10) for k, (t, l) in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, texts[5][0], "en", None, None, *[None] * 10)]
