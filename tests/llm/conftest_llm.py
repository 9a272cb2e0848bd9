"""Invented texts."""

import random
import re

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BLANK_ENDED = re.compile(r"[^\x20\x09-\x0D]+")


def invented(seed: int, words: int, vocabulary: int = 400) -> str:
    """Sentences of invented words, in lines."""
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "tu", "sel", "mo", "na", "ple", "dor", "vi"]
    word = lambda: "".join(syllables[(n // 10**i) % 10] for i, n in [(k, rng.randrange(vocabulary)) for k in range(3)])
    lines, line = [], []
    for _ in range(words):
        line.append(word())
        if len(line) > 7 and rng.random() < 0.3:
            lines.append(" ".join(line).capitalize() + ".")
            line = []
    if line:
        lines.append(" ".join(line) + ".")
    return "\n".join(lines)


def changed(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return "".join(f"x{rng.randrange(999)}" if w.strip() and rng.random() < share else w for w in re.split(r"(\s+)", text))
