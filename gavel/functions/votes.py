"""Judge votes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, py_strip

# --- fixed values: token spellings that count as an A or a B vote -------------------
A_TOKENS = ["A", " A", "\nA", "_A"]
B_TOKENS = ["B", " B", "\nB", "_B"]
LOGPROB_TIE = 0.1
PROB_TIE = 1e-8
ARGMAX_FALLBACK = 3
# --- end of fixed values ------------------------------------------------------------


def _best(m: Column, tokens: list[str]) -> Column:
    hits = F.filter(F.map_entries(m), lambda e: e["key"].isin(tokens) | py_strip(e["key"]).isin(tokens))
    return F.array_max(F.transform(hits, lambda e: e["value"].cast("double")))


def logprob_vote(top_logprobs) -> Column:
    """struct(predicted, is_tie) from a token -> logprob map.

    neither letter -> (A, tie); one letter -> that letter; both -> the larger
    (equal values give B), tie when the difference is below 0.1.
    """
    m = col_(top_logprobs)
    a, b = _best(m, A_TOKENS), _best(m, B_TOKENS)
    pred = (F.when(a.isNull() & b.isNull(), "A").when(a.isNull(), "B").when(b.isNull(), "A")
             .when(a > b, "A").otherwise("B"))
    tie = (F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False)
            .otherwise(F.abs(a - b) < LOGPROB_TIE))
    return F.struct(pred.alias("predicted"), tie.alias("is_tie"))


def stored_or_computed(stored_choice, stored_tie, computed: Column) -> Column:
    """A stored prediction (both fields present) wins over recomputation."""
    has = col_(stored_choice).isNotNull() & col_(stored_tie).isNotNull()
    return F.when(has, F.struct(col_(stored_choice).alias("predicted"), col_(stored_tie).alias("is_tie"))).otherwise(computed)


def first_element(c) -> Column:
    """First element of a list column (null when empty)."""
    return F.try_element_at(col_(c), F.lit(1))


def prob_vote(p_a, p_b) -> Column:
    """Tie if |pA - pB| < 1e-8 -> (A, tie); else the larger; failure -> (A, not tie)."""
    a, b = col_(p_a).cast("double"), col_(p_b).cast("double")
    failed = a.isNull() | b.isNull()
    tie = ~failed & (F.abs(a - b) < PROB_TIE)
    pred = F.when(failed | tie, "A").when(a > b, "A").otherwise("B")
    return F.struct(pred.alias("predicted"), F.coalesce(tie, F.lit(False)).alias("is_tie"))


def argmax_score(probs) -> Column:
    """1-based position of the first maximum of a score-probability array; failure -> 3."""
    p = col_(probs)
    pos = F.array_position(p, F.array_max(p))
    return F.coalesce(F.when(pos > 0, pos.cast("int")), F.lit(ARGMAX_FALLBACK))


def edited_side(flag) -> Column:
    """Letter of the edited text from the position flag."""
    return F.when(col_(flag), "B").otherwise("A")


def verdict_matches(verdict, letter) -> Column:
    """Stripped verdict equals the expected letter."""
    return py_strip(col_(verdict)) == col_(letter)


def correct_flag(pred, true, tie=None) -> Column:
    """Prediction equals truth (and, in the tie-aware variant, is not a tie)."""
    ok = col_(pred) == col_(true)
    return ok & ~col_(tie) if tie is not None else ok


def compare_scores(new, old) -> Column:
    """'better' / 'worse' / 'equal' from two scores (equal is the default)."""
    return F.when(col_(new) > col_(old), "better").when(col_(new) < col_(old), "worse").otherwise("equal")


def vote_points(response, swapped, tie_words=("equal", "tie"), winner_tag: bool = True) -> Column:
    """struct(corr, trans) points from one reply.

    Unswapped prompts show (translation, correction) as (A, B); swapped ones show
    (correction, translation). 'a'/'b' give a point to that side, tie words half each,
    other text nothing. With ``winner_tag`` a ``<winner>`` tag's text is used when present.
    """
    r = col_(response)
    if winner_tag:
        tag = F.regexp_extract(r, "(?is)<winner>(.*?)</winner>", 1)
        has = F.regexp_like(r, F.lit("(?is)<winner>.*?</winner>"))
        r = F.when(has, tag).otherwise(r)
    r = F.lower(py_strip(r))
    sw = col_(swapped)
    corr = (F.when((r == "b") & ~sw, 1.0).when((r == "a") & sw, 1.0).when(r.isin(*tie_words), 0.5).otherwise(0.0))
    trans = (F.when((r == "a") & ~sw, 1.0).when((r == "b") & sw, 1.0).when(r.isin(*tie_words), 0.5).otherwise(0.0))
    return F.struct(corr.alias("corr"), trans.alias("trans"))
