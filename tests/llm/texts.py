"""Texts that are hard on tokenizers and scanners."""

import random

HARD = [
    None,
    "",
    " ",
    "  ",
    "\n",
    "a",
    " a",
    "a ",
    "a  b   c",
    "a\n b",
    "a \nb",
    "a\n \nb\n\n c \n",
    "it's we'll 's 't x'S they're",
    "don’t 12345 3.14 ½ ² ٣ Ⅷ",
    "tab\there \t x\r\n y\x0b\x0cz",
    "nbsp x   y z 　 q w   e",
    "\x1c x \x1f y\x85 z \x85",
    "é ́x Å 각",
    "ΑΣ ΑΣΑ İstanbul ǅ ﬁ",
    "日本語 テキスト 한국어 עברית",
    "😀 👩‍👩‍👧 \U0001f1e9\U0001f1ea",
    "<|endoftext|> <|startoftext|>x",
    "nul\x00 \x00 y",
    "x" * 5000,
    "ab " * 20000,
    " " * 3000 + "z",
]


def fuzzed(n, seed=7):
    rng = random.Random(seed)
    alphabet = "ab Z'st\n\t 1é.,! 　中😀ß-_" + " " * 6
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]
