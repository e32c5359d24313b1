"""Words, word windows, templates and report labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of Unicode white space. ``(?U)`` widens ``\s`` beyond ASCII; the four
# separator controls are white space to ``str.split`` but not to Java.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    """Split on Unicode white space, without empty strings (as ``str.split()``)."""
    return F.array_remove(F.split(text, _BLANKS), "")


def check_window(size: int, overlap: int) -> int:
    """Return the stride; an overlap that never advances is an error."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError(f"need 0 <= overlap < size, got size={size}, overlap={overlap}")
    return size - overlap


def word_windows(tokens: Column, size: int = 200, overlap: int = 50, drop_contained_tail: bool = False) -> Column:
    """Overlapping windows as ``array<struct<n_words, text>>``, in text order.

    A window starts at every multiple of the stride that is below the word
    count, so the last one may lie wholly inside its predecessor; such a tail
    adds no words and ``drop_contained_tail`` leaves it out.
    """
    stride = check_window(size, overlap)
    n = F.size(tokens)
    # The last start that still adds words the window before it lacks.
    stop = F.greatest(F.lit(0), n - 1 - overlap) if drop_contained_tail else n - 1
    starts = F.when(n > 0, F.sequence(F.lit(0), stop, F.lit(stride)))
    return F.transform(
        starts,
        lambda at: F.struct(
            F.least(n - at, F.lit(size)).alias("n_words"),
            F.array_join(F.slice(tokens, at + 1, size), " ").alias("text"),
        ),
    )


def render(template: str, slots: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` slots of a template known on the driver.

    The template is cut once into literal pieces and the result is one
    ``concat``, so a value that itself contains ``{name}`` is left alone.
    An unknown slot raises ``KeyError``; a NULL value renders as ''.
    """
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(F.coalesce(slots[name].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def template_pieces(template: Column, names: Iterable[str]) -> Column:
    """A template that is a column, cut from left to right into doubled braces, ``{name}`` slots and literals."""
    return F.regexp_extract_all(template, F.lit(rf"\{{\{{|\}}\}}|\{{(?:{'|'.join(names)})\}}|[^{{}}]+|[{{}}]"), F.lit(0))


def fill_pieces(pieces: Column, slots: Mapping[str, Column]) -> Column:
    """Put values into the slots of :func:`template_pieces`, in a single pass; doubled braces are braces."""

    def fill(piece: Column) -> Column:
        chain = F.when(piece == "{{", "{").when(piece == "}}", "}")
        for name, value in slots.items():
            chain = chain.when(piece == "{" + name + "}", F.coalesce(value.cast("string"), F.lit("")))
        return chain.otherwise(piece)

    return F.array_join(F.transform(pieces, fill), "")


def render_each(template: Column, slots: Mapping[str, Column]) -> Column:
    """Fill slots of a template that differs by row, by the rules of :func:`render`; a brace that opens no slot stays."""
    return fill_pieces(template_pieces(template, slots), slots)


def relabel(question: Column, names: Mapping[str, str]) -> Column:
    """Replace listed question keys by a display name."""
    if not names:
        return question
    chain = F
    for key, shown in names.items():
        chain = chain.when(question == key, shown)
    return chain.otherwise(question)


def question_label(question: Column, prompt: Column) -> Column:
    """``KEY - prompt`` with the key in upper case."""
    return F.concat(F.upper(question), F.lit(" - "), prompt)
