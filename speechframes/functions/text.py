"""Text helpers: white space, echo removal, and restoring a transcript's own spacing."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Sequence
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_ECHO = 8
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(text: Column | str) -> Column:
    """Without white space of any kind on both sides."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def borders(pattern: Sequence[str]) -> list[int]:
    """Of each beginning of the pattern the longest shorter beginning that also ends it."""
    out, k = [0] * len(pattern), 0
    for i in range(1, len(pattern)):
        while k and pattern[i] != pattern[k]:
            k = out[k - 1]
        k += pattern[i] == pattern[k]
        out[i] = k
    return out


def overlap(left: Sequence[str], right: Sequence[str]) -> int:
    """Length of the longest end of left that is a beginning of right, in linear time; '' equals nothing."""
    fall, k = borders(right), 0
    for symbol in left[max(0, len(left) - len(right)) :]:
        while k and (k == len(right) or right[k] != symbol):
            k = fall[k - 1]
        if symbol and right and k < len(right) and right[k] == symbol:
            k += 1
        elif not symbol:
            k = 0
    return k


def merge_echo(committed: str | None, hypothesis: str | None) -> str:
    """The committed text continued by the hypothesis, without what the hypothesis repeats of its end.

    The longest repeat of eight or more characters counts, in any case; failing
    that, the longest run of words that agree in letters and digits.
    """
    said, new = (committed or "").strip(), (hypothesis or "").strip()
    if not (said and new):
        return said + new
    echo = overlap([c.casefold() for c in said[-len(new) :]], [c.casefold() for c in new])
    if echo >= LEAST_ECHO:
        return (said + new[echo:]).strip()
    old_words, new_words = said.split(), new.split()
    plain = lambda words: ["".join(filter(str.isalnum, w.casefold())) for w in words]
    again = overlap(plain(old_words[-len(new_words) :]), plain(new_words))
    return " ".join([*old_words, *new_words[again:]]) if again else f"{said} {new}"


def novel_text(committed: str | None, hypothesis: str | None) -> str:
    """What the hypothesis adds to the committed text."""
    return added(committed, merge_echo(committed, hypothesis))


def added(committed: str | None, whole: str) -> str:
    """What a merged text has beyond the committed one; all of it where the committed text was respaced."""
    return whole.removeprefix((committed or "").strip()).strip()


def merge_tail(tail: str, hypothesis: str | None, longest: int) -> tuple[str, str, int]:
    """(what the hypothesis adds, the new tail, characters added) where only the end of the committed text is kept.

    White space counts as single blanks. A tail of at most 2 * ``longest``
    characters, cut at a blank, holds all that a hypothesis of up to ``longest``
    characters can repeat; a longer one may repeat more than is looked for.
    """
    whole = merge_echo(tail, " ".join((hypothesis or "").split()))
    more, kept = len(whole) - len(tail), whole[-2 * longest :]
    if len(kept) < len(whole) and " " in kept and whole[-2 * longest - 1] != " ":
        kept = kept[kept.index(" ") + 1 :]  # not from the middle of a word
    return added(tail, whole), kept.lstrip(), more


def context_tail(text: str, n: int) -> str:
    return text[-n:] if n > 0 else ""


class _Letters(dict):
    """For str.translate: letters and digits in lower case, one for one; all else goes."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = c.lower()[0] if unicodedata.category(c)[0] in "LN" else None
        return self[code]


LETTERS = _Letters()


def clipped(words: Iterable[tuple[float | None, float | None, str | None]], duration: float | None) -> list[tuple[float, float, str]]:
    """Words (start_s, end_s, text) inside the audio; blank and empty ones go, and those without finite times."""
    most = math.inf if duration is None or math.isnan(duration) else duration
    inside = lambda x: min(max(x, 0.0), most)
    good = [(inside(s), inside(e), w) for s, e, w in words if w and w.strip() and s is not None and e is not None and math.isfinite(s) and math.isfinite(e)]
    return [w for w in good if w[1] > w[0]]


def restored(transcript: str | None, duration: float | None, words: Iterable[tuple[float | None, float | None, str | None]]) -> tuple[list[tuple[float, float, str | None]], str | None]:
    """Words with the transcript's own text, or the reason against them.

    Each word is looked up by its letters from where the last one ended, and
    reaches up to the next word; without a transcript words have no text.
    """
    kept = clipped(words, duration)
    if any(b[0] < a[0] for a, b in pairwise(kept)):
        return [], "nonmonotonic"
    if not kept:
        return [], "empty"
    needles = [w[2].translate(LETTERS) for w in kept]
    if transcript is None:
        return ([], "mismatch") if "" in needles else ([(s, e, None) for s, e, _ in kept], None)
    plain, at, begins = transcript.translate(LETTERS), 0, []
    spots = [i for i, c in enumerate(transcript) if LETTERS[ord(c)] is not None]
    for needle in needles:
        found = plain.find(needle, at) if needle else -1
        if found < 0:
            return [], "mismatch"
        begins.append(spots[found])
        at = found + len(needle)
    cuts = [0, *begins[1:], len(transcript)]
    return [(s, e, transcript[cuts[i] : cuts[i + 1]]) for i, (s, e, _) in enumerate(kept)], None


def tagged_runs(text: Column, words: Column, start: Column, tolerance: float = 0.02) -> Column:
    """Runs of words with one speaker tag, and whether the words do not fit the text: (at, last, wrong, runs)."""
    run = "array<struct<begin:int,start:double,stop:double,speaker:int>>"
    first = F.struct(F.lit(1).alias("at"), start.cast("double").alias("last"), F.lit(False).alias("wrong"), F.array().cast(run).alias("runs"))

    def step(state: Column, w: Column) -> Column:
        token = strip(w["text"])
        s, e, tag = w["start_s"].cast("double"), w["end_s"].cast("double"), w["speaker"].cast("int")
        found = F.when(F.coalesce(token, F.lit("")) != "", F.position(token, text, state["at"])).otherwise(0)
        between = strip(F.substr(text, state["at"], F.greatest(found - state["at"], F.lit(0)))) == ""
        fits = (found > 0) & between & (s >= state["last"] - tolerance) & (e >= s) & (e < float("inf")) & tag.between(0, 4)
        before = F.get(state["runs"], F.size(state["runs"]) - 1)
        made = lambda begin, begun, stop: F.array(F.struct(begin.alias("begin"), begun.alias("start"), stop.alias("stop"), tag.alias("speaker")))
        longer = F.concat(F.slice(state["runs"], 1, F.greatest(F.size(state["runs"]) - 1, F.lit(0))), made(before["begin"], before["start"], F.greatest(before["stop"], e)))
        head = F.when(F.size(state["runs"]) == 0, 1).otherwise(found)
        runs = F.when(F.coalesce(before["speaker"] == tag, F.lit(False)), longer).otherwise(F.concat(state["runs"], made(head, s, e)))
        return F.struct((found + F.length(token)).alias("at"), s.alias("last"), (state["wrong"] | ~F.coalesce(fits, F.lit(False))).alias("wrong"), runs.cast(run).alias("runs"))

    return F.aggregate(words, first, step)
