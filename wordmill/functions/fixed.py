"""Fixed values shared by the text functions."""

from __future__ import annotations

import string
import sys
import unicodedata

# The eight CJK ideograph blocks whose characters stand alone as tokens.
CJK_RANGES = [
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F),
    (0x2B820, 0x2CEAF),
    (0xF900, 0xFAFF),
    (0x2F800, 0x2FA1F),
]

# Names of the special word pieces.
UNK, SEP, PAD, CLS, MASK = "[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]"
SPECIAL_PIECES = [CLS, SEP, PAD, UNK, MASK]

# Label ids of the ternary sentiment task.
NEGATIVE, POSITIVE, NEUTRAL = 0, 1, 2
STAR_LABELS = {1: NEGATIVE, 2: NEGATIVE, 3: NEUTRAL, 4: POSITIVE, 5: POSITIVE}
NEUTRAL_STAR_LABELS = {3: NEUTRAL}
GOLD_LABELS = {"negative": NEGATIVE, "positive": POSITIVE, "neutral": NEUTRAL}
TREE_LABELS = {"0": NEGATIVE, "1": NEGATIVE, "2": NEUTRAL, "3": POSITIVE, "4": POSITIVE}
NEUTRAL_TREE_LABELS = {"2": NEUTRAL}

# Text columns and label column of every known task.
TASK_FIELDS = {
    "wiki-text": ("text", None),
    "sst3": ("text", None),
    "cola": ("sentence", None),
    "mnli": ("premise", "hypothesis"),
    "snli": ("premise", "hypothesis"),
    "mrpc": ("sentence1", "sentence2"),
    "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"),
    "rte": ("sentence1", "sentence2"),
    "sst2": ("sentence", None),
    "stsb": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"),
    "conll2003": ("tokens", None),
    "en_ewt": ("tokens", None),
}
TAG_COLUMNS = {"conll2003": "ner_tags", "en_ewt": "upos"}

# Metrics reported for every benchmark task.
TASK_METRICS = {
    "cola": ["matthews_correlation"],
    "mnli": ["accuracy"],
    "mnli_mismatched": ["accuracy"],
    "mnli_matched": ["accuracy"],
    "mnli-mm": ["accuracy"],
    "mrpc": ["accuracy", "f1"],
    "qnli": ["accuracy"],
    "qqp": ["accuracy", "f1"],
    "rte": ["accuracy"],
    "sst2": ["accuracy"],
    "stsb": ["pearson", "spearmanr"],
    "wnli": ["accuracy"],
    "hans": ["accuracy"],
}

# Header of the evaluation results table.
RESULT_COLUMNS = [
    "glue_task", "split", "model", "learning_rate", "tokenizer", "midtuning", "galactic_shift",
    "reinit_embedding", "reverse_order", "random_order", "token_swap", "word_swap",
    "word_swap_frequency", "metrics", "performance",
]

# Character classes, in the regular expression dialect of the JVM. Classes that list
# their ASCII members one by one are tested by bitmap, which is several times faster than ranges; the
# wide Unicode classes are therefore guarded by "not a plain letter, digit or space".
ASCII_PUNCT = "".join("\\" + c for c in string.punctuation)
ASCII_CONTROL = "".join(rf"\x{i:02X}" for i in [*range(0x20), 0x7F] if chr(i) not in "\t\n\r")
PLAIN = string.ascii_letters + string.digits + " "
PUNCT_CHARS = r"\p{P}$+<=>^`|~"
SPACE_CHARS = r"\p{Z}\t\n\r"
CJK_CHARS = "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in CJK_RANGES)


def guarded(members: str) -> str:
    """Character class of ``members`` that are no plain ASCII letter, digit or space."""
    return f"[[^{PLAIN}]&&[{members}]]"


CONTROL_CLASS = guarded(r"\x{FFFD}[\p{C}&&[^\t\n\r]]")
PUNCT_CLASS = guarded(PUNCT_CHARS)
MARK_CLASS = guarded(r"\p{Mn}")
# Superset (by range) of the characters whose decomposition has several base characters.
LONG_FOLD_CLASS = r"[\x{9CB}-\x{1BFF}\x{AC00}-\x{D7A3}\x{11000}-\x{1D1FF}]"

# Hangul syllables decompose by rule: lead, vowel, optional tail.
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
HANGUL_LEADS = "".join(map(chr, range(0x1100, 0x1113)))
HANGUL_VOWELS = "".join(map(chr, range(0x1161, 0x1176)))
HANGUL_TAILS = "".join(map(chr, range(0x11A8, 0x11C3)))


def decomposition_tables() -> tuple[str, str, dict[str, str]]:
    """Canonical decomposition without non-spacing marks, as a translate pair and a long-form dict.

    Hangul is left out, it follows the rule above.
    """
    source, target, longer = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if HANGUL_FIRST <= point <= HANGUL_LAST or 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        full = unicodedata.normalize("NFD", char)
        if full == char:
            continue
        base = "".join(c for c in full if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
        elif len(base) > 1:
            longer[char] = base
    return "".join(source), "".join(target), longer


FOLD_FROM, FOLD_TO, FOLD_LONG = decomposition_tables()
