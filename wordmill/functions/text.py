"""Text normalisation and tokenisation as column expressions (no Python in the row path)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordmill.functions import fixed
from wordmill.functions.hashing import hash_int, hash_key


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_present(text: Column | str) -> Column:
    """Neither null, nor blank, nor the literal word None."""
    col = as_column(text)
    none = col.contains("None") & col.rlike(r"\A[\s\p{Z}]*None[\s\p{Z}]*\z")
    return F.coalesce(col.rlike(r"[^\s\p{Z}]") & ~none, F.lit(False))


def has_items(items: Column | str) -> Column:
    """The same test for an array of tokens."""
    return F.coalesce(F.size(as_column(items)) > 0, F.lit(False))


def clean_text(text: Column | str) -> Column:
    """Drop control and replacement characters, turn every whitespace character into a space."""
    kept = F.regexp_replace(as_column(text), fixed.CONTROL_CLASS, "")
    return F.regexp_replace(kept, r"[\p{Zs}\t\n\r]", " ")


def space_cjk(text: Column | str) -> Column:
    """Put a space on both sides of every CJK ideograph."""
    return F.regexp_replace(as_column(text), f"([{fixed.CJK_CHARS}])", " $1 ")


def strip_accents(text: Column | str, raw: Column | None = None) -> Column:
    """Canonical decomposition without the non-spacing marks.

    One translate call covers the characters with a one-character base; the few others (Hangul and
    some compound signs) are spelled out character by character, only in texts that contain one.
    ``raw`` is the plain column behind ``text``: testing it keeps ``text`` evaluated once.
    """
    col = as_column(text)
    seen = col if raw is None else raw
    single = F.translate(col, fixed.FOLD_FROM, fixed.FOLD_TO)

    def spelled_out(char: Column) -> Column:
        index = F.ascii(char) - F.lit(fixed.HANGUL_FIRST)
        tail = index % 28
        jamo = F.concat(
            F.substring(F.lit(fixed.HANGUL_LEADS), F.floor(index / 588).cast("int") + 1, F.lit(1)),
            F.substring(
                F.lit(fixed.HANGUL_VOWELS), F.floor((index % 588) / 28).cast("int") + 1, F.lit(1)
            ),
            F.when(tail == 0, "").otherwise(
                F.substring(F.lit(fixed.HANGUL_TAILS), tail.cast("int"), F.lit(1))
            ),
        )
        hangul = char.between(chr(fixed.HANGUL_FIRST), chr(fixed.HANGUL_LAST))
        longer = F.create_map(*[F.lit(x) for pair in fixed.FOLD_LONG.items() for x in pair])
        return F.when(hangul, jamo).otherwise(F.coalesce(F.element_at(longer, char), char))

    spelled = F.when(
        seen.rlike(fixed.LONG_FOLD_CLASS),
        F.array_join(F.transform(F.split(single, ""), spelled_out), ""),
    ).otherwise(single)
    return F.regexp_replace(spelled, fixed.MARK_CLASS + "+", "")


def fold(
    text: Column | str, lower: bool = True, strip: bool | None = None, raw: Column | None = None
) -> Column:
    """Lower-case and strip accents; ``strip=None`` follows ``lower``."""
    col = as_column(text)
    seen = col if raw is None else raw
    if lower:
        col = F.lower(col)
    if strip or (strip is None and lower):
        col = F.when(is_ascii(seen), col).otherwise(strip_accents(col, seen))
    return col


def split_punct(text: Column | str) -> Column:
    """Put a space on both sides of every punctuation character."""
    return F.regexp_replace(as_column(text), fixed.PUNCT_CLASS, " $0 ")


def basic_tokens(
    text: Column | str,
    never_split: Iterable[str] = (),
    lower: bool = True,
    strip: bool | None = None,
    cjk: bool = True,
) -> Column:
    """Array of lower-cased, accent-free words, with punctuation and ideographs on their own.

    Cleaning and folding run over the whole text, then one extraction pass yields the tokens. Texts
    that are pure ASCII (checked by length, not by pattern) skip the Unicode passes.
    """
    col = as_column(text)
    keep = list(never_split)
    if keep:
        return _tokens_with_exceptions(col, keep, lower, strip, cjk)
    plain = F.regexp_replace(col, f"[{fixed.ASCII_CONTROL}]+", "")
    ascii_tokens = F.regexp_extract_all(
        F.lower(plain) if lower else plain,
        F.lit(rf"[^ \t\n\r{fixed.ASCII_PUNCT}]++|[{fixed.ASCII_PUNCT}]"),
        F.lit(0),
    )
    cleaned = F.regexp_replace(col, fixed.CONTROL_CLASS + "+", "")
    alone = fixed.guarded(fixed.PUNCT_CHARS + (fixed.CJK_CHARS if cjk else ""))
    spaced = F.regexp_replace(_folded_unicode(cleaned, col, lower, strip), alone, " $0 ")
    words = F.split(F.regexp_replace(spaced, fixed.guarded(fixed.SPACE_CHARS), " "), " ")
    return F.when(is_ascii(col), ascii_tokens).otherwise(F.array_remove(words, ""))


def _folded_unicode(text: Column, raw: Column, lower: bool, strip: bool | None) -> Column:
    col = F.lower(text) if lower else text
    return strip_accents(col, raw) if strip or (strip is None and lower) else col


def _tokens_with_exceptions(
    col: Column, keep: list[str], lower: bool, strip: bool | None, cjk: bool
) -> Column:
    """Word by word: the words in ``keep`` pass through unfolded and unsplit."""
    cleaned = clean_text(col)
    words = _split_space(space_cjk(cleaned) if cjk else cleaned)
    kept = F.array(*[F.lit(k) for k in keep])

    def pieces(word: Column) -> Column:
        folded = fold(word, lower, strip)
        split = F.when(F.array_contains(kept, folded), F.array(folded)).otherwise(
            _split_space(split_punct(folded))
        )
        return F.when(F.array_contains(kept, word), F.array(word)).otherwise(split)

    return F.flatten(F.transform(words, pieces))


def _split_space(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{fixed.SPACE_CHARS}]+"), F.lit(0))


def join_pieces(tokens: Column | str) -> Column:
    """Text of a token array: joined by spaces, word-piece continuations glued, trimmed."""
    return F.trim(F.replace(F.array_join(as_column(tokens), " "), F.lit(" ##"), F.lit("")))


def pair_text(first: Column | str, second: Column | str) -> Column:
    """Both texts around a separator word; an absent text counts as empty."""
    a = F.when(is_present(first), as_column(first)).otherwise("")
    b = F.when(is_present(second), as_column(second)).otherwise("")
    return F.concat(a, F.lit(f" {fixed.SEP} "), b)


def has_digit(text: Column | str) -> Column:
    return as_column(text).rlike(r"\p{Nd}")


def is_ascii(text: Column | str) -> Column:
    """True when every character is ASCII: byte and character lengths agree."""
    col = as_column(text)
    return F.octet_length(col) == F.char_length(col)


def utf8_length(text: Column | str) -> Column:
    return F.octet_length(as_column(text))


def vocab_filter(token: Column | str, token_id: Column | str, min_id: int = 1997) -> Column:
    """Word pieces fit for embedding comparisons: ASCII, no digit, not reserved, past the first ids."""
    tok = as_column(token)
    return (
        (as_column(token_id) >= min_id) & is_ascii(tok) & ~tok.contains("[unused") & ~has_digit(tok)
    )


def norm_lev(first: Column | str, second: Column | str) -> Column:
    """Edit distance over the longer length; two empty words are 0 apart."""
    a, b = as_column(first), as_column(second)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def reverse_words(text: Column | str) -> Column:
    """Words (split on single spaces, empty ones kept) in reverse order."""
    return F.array_join(F.reverse(F.split(as_column(text), " ")), " ")


def shuffled(items: Column, key: Column | str, seed: int | str) -> Column:
    """Array in a seeded random order that depends on the row key and each position only."""
    tagged = F.transform(
        items,
        lambda item, pos: F.struct(hash_key(seed, key, pos).alias("h"), pos.alias("p"), item.alias("v")),
    )
    return F.transform(F.array_sort(tagged), lambda item: item["v"])


def shuffle_words(text: Column | str, key: Column | str, seed: int | str) -> Column:
    """Words (split on single spaces) in a seeded random order."""
    return F.array_join(shuffled(F.split(as_column(text), " "), as_column(key), seed), " ")


def scramble_window(tokens: Column | str, key: Column | str, proportion: float, seed: int | str) -> Column:
    """Shuffle one contiguous window of ``int(n * proportion)`` tokens at a seeded random start."""
    arr = as_column(tokens)
    width = F.floor(F.size(arr) * F.lit(float(proportion))).cast("int")
    start = (hash_int(f"{seed}|start", key) % (F.size(arr) - width + 1)).cast("int")
    head = F.slice(arr, F.lit(1), start)
    middle = F.slice(arr, start + 1, width)
    tail = F.slice(arr, start + width + 1, F.size(arr) - start - width)
    return F.concat(head, shuffled(middle, as_column(key), seed), tail)


def letter_counts(token: Column | str) -> dict[str, Column]:
    """One count per ASCII letter, lower case first; the second case is marked by its column name."""
    tok = as_column(token)
    lower = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    return {
        (f"n_{ch}" if ch.islower() else f"n_upper_{ch.lower()}"): (
            F.char_length(tok) - F.char_length(F.replace(tok, F.lit(ch), F.lit("")))
        )
        for ch in lower + [c.upper() for c in lower]
    }


def argmax(scores: Column | str) -> Column:
    """0-based position of the first largest score."""
    arr = as_column(scores)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


