"""Token-count estimates. The services that a pipeline imitates each use their own; each has its own name here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(text) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text) -> Column:
    """White-space separated words."""
    return F.filter(F.split(_text(text), r"\s+"), lambda w: w != "")


def word_count(text) -> Column:
    return F.size(words(text))


def _whole(x: Column) -> Column:
    return F.floor(x).cast("int")


def chunk_tokens(text) -> Column:
    """For chunk sizes: 1.33 a word below 1000 characters, else the mean of 1.3 a word and a quarter a character.

    At most half the characters, but no less than the words (and 1); 0 for an empty text."""
    t, n = _text(text), word_count(text)
    chars = F.length(t)
    guess = F.when(chars < 1000, n * F.lit(1.33)).otherwise((n * F.lit(1.3) + chars / F.lit(4.0)) / 2)
    return F.when(chars == 0, 0).otherwise(F.greatest(F.lit(1), n, F.least(_whole(guess), _whole(chars / 2))))


def prompt_tokens(text) -> Column:
    """For prompts: 1.3 a word and 5 % more, cut to whole numbers at each step."""
    return _whole(_whole(word_count(text) * F.lit(1.3)) * F.lit(1.05))


def context_tokens(text) -> Column:
    """For retrieved context, on the safe side: 1.8 a word, then 15 %, then 10 % more; at least 10."""
    return F.greatest(F.lit(10), _whole(_whole(_whole(word_count(text) * F.lit(1.8)) * F.lit(1.15)) * F.lit(1.10)))


def clean_tokens(text) -> Column:
    return _whole((word_count(text) * F.lit(1.3) + F.length(_text(text)) / F.lit(4.0)) / 2)


def punctuated_tokens(text) -> Column:
    """1.3 a word and a half for each mark that is neither word character nor space; at least 1."""
    return F.greatest(F.lit(1), _whole(word_count(text) * F.lit(1.3) + F.regexp_count(_text(text), F.lit(r"[^\p{L}\p{N}_\s]")) * F.lit(0.5)))


def truncated(text, max_tokens: int, suffix: str = "...") -> Column:
    """About max_tokens, four characters each, back to the last space."""
    t, limit = _text(text), max_tokens * 4
    head = F.substring(t, 1, limit - len(suffix))
    back = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(back, F.lit(suffix)))


def completion_budget(tokens: Column, window: int = 8192, safety: int = 100) -> Column:
    return F.greatest(F.lit(0), F.lit(window - safety) - tokens)


def fits(tokens: Column, completion: int = 1000, window: int = 8192) -> Column:
    return tokens + completion <= window


def cost(tokens: Column, per_thousand: float = 0.002) -> Column:
    return F.round(tokens / 1000 * per_thousand, 6)


def keep_words(text, n: int, where: str = "end") -> Column:
    """At most n words: the end cut off, the start cut off, or the middle (a third stays in front)."""
    w = words(text)
    size = F.size(w)
    if where == "start":
        kept = F.array_join(F.slice(w, F.greatest(F.lit(1), size - n + 1), n), " ")
    elif where == "middle":
        front = n // 3
        kept = F.concat(F.array_join(F.slice(w, 1, front), " "), F.lit(" [...] "), F.array_join(F.slice(w, F.greatest(F.lit(1), size - (n - front) + 1), n - front), " "))
    else:
        kept = F.array_join(F.slice(w, 1, n), " ")
    return F.when(size <= n, _text(text)).otherwise(kept)


def windows(ids: Column, size: int, overlap: int = 0) -> Column:
    """Windows of an array of ids; the last one ends where the ids end."""
    stride = size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ids) - 1), F.lit(stride)), lambda i: (i == 0) | (i + overlap < F.size(ids)))
    return F.when(F.size(ids) == 0, F.array().cast("array<array<int>>")).otherwise(F.transform(starts, lambda i: F.slice(ids, i + 1, size)))


def token_stats(text) -> dict[str, Column]:
    """Estimated tokens with characters, words, and their ratios (0 for an empty text)."""
    t, n, w = _text(text), chunk_tokens(text), word_count(text)
    return {
        "tokens": n, "chars": F.length(t), "words": w,
        "chars_per_token": F.when(n > 0, F.round(F.length(t) / n, 6)).otherwise(0.0), "tokens_per_word": F.when(w > 0, F.round(n / w, 6)).otherwise(0.0),
    }


def message_tokens(content, role) -> Column:
    """A chat message's prompt tokens: content, role, and 5 for its frame."""
    return prompt_tokens(content) + prompt_tokens(role) + 5
