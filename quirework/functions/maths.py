"""Mathematical signs and fonts: predicates, and LaTeX for single characters."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks of arrows, operators, technical signs, Greek, letterlike signs and styled letters.
SYMBOL = r"[\x{0370}-\x{03FF}\x{2100}-\x{214F}\x{2190}-\x{23FF}\x{27C0}-\x{27EF}\x{2900}-\x{297F}\x{2A00}-\x{2AFF}\x{1D400}-\x{1D7FF}]"
FONT = r"(?:CM(?:MI|SY|EX|BSY)|MS[AB]M|EU[FS]M|RSFS|[TP]X(?:MI|SY|EX)|MATH(?!EMATICA))"
FILLER = r"^[0-9+=/()\[\]|,.'<>!*^_:;-]+$"


def is_symbol(text: Column) -> Column:
    return text.rlike(SYMBOL)


def is_font(name: Column) -> Column:
    """Fonts of formulas, by what their names have in common."""
    return F.upper(name).rlike(FONT)


def word_role(text: Column, in_math_font: Column) -> Column:
    """``seed`` for a word with mathematics, ``connector`` for digits and signs alone, else ``prose``."""
    return F.when(in_math_font | is_symbol(text), "seed").when(text.rlike(FILLER), "connector").otherwise("prose")


def unstyle(c: str) -> str:
    """The plain letter or digit of a styled one."""
    return unicodedata.normalize("NFKC", c) if "\U0001d400" <= c <= "\U0001d7ff" else c


_NAMED = dict(
    zip(
        "±×÷·∗⋆∘∙≤≥≠≡≈∼≃∝≪≫∈∉∋⊂⊆⊃⊇∪∩∅∀∃¬∧∨⊕⊗⊥∥∞∂∇∑∏∐∫∬∮√→←↔⇒⇐⇔↦↑↓…⋯⋮⋱′†‡ℓℏℜℑℵ∠△⟨⟩⌈⌉⌊⌋‖∣⋃⋂≺≻⪯⪰⊤⊢⊨∖≜",
        "pm times div cdot ast star circ bullet leq geq neq equiv approx sim simeq propto ll gg in notin ni subset subseteq supset supseteq cup cap emptyset forall exists neg wedge vee oplus otimes perp parallel infty partial nabla sum prod coprod int iint oint sqrt rightarrow leftarrow leftrightarrow Rightarrow Leftarrow Leftrightarrow mapsto uparrow downarrow ldots cdots vdots ddots prime dagger ddagger ell hbar Re Im aleph angle triangle langle rangle lceil rceil lfloor rfloor Vert mid bigcup bigcap prec succ preceq succeq top vdash models setminus triangleq".split(),
        strict=True,
    )
)
_VARIANTS = {"ϵ": "epsilon", "ϑ": "vartheta", "ϕ": "varphi", "ϖ": "varpi", "ϱ": "varrho", "ς": "varsigma", "ϰ": "varkappa", "ϴ": "Theta", "µ": "mu"}
_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΧο", "ABEZHIKMNOPTXo", strict=True))
_DIRECT = {"−": "-", "‐": "-", "–": "-", "∕": "/", "ℝ": r"\mathbb{R}", "ℕ": r"\mathbb{N}", "ℤ": r"\mathbb{Z}", "ℚ": r"\mathbb{Q}", "ℂ": r"\mathbb{C}", "{": r"\{", "}": r"\}", "#": r"\#", "%": r"\%", "&": r"\&", "_": r"\_", "$": r"\$"}


@cache
def latex_of(c: str) -> str | None:
    """LaTeX of a character, null where there is none; ASCII letters and digits are themselves."""
    if c in _DIRECT:
        return _DIRECT[c]
    if c in _NAMED:
        return "\\" + _NAMED[c]
    if c in _VARIANTS:
        return "\\" + _VARIANTS[c]
    if c in _LATIN:
        return _LATIN[c]
    if "Α" <= c <= "ω":
        case, _, rest = unicodedata.name(c, "").removeprefix("GREEK ").partition(" LETTER ")
        if rest.isalpha():
            return "\\" + ({"LAMDA": "lambda"}.get(rest, rest.lower()) if case == "SMALL" else {"LAMDA": "Lambda"}.get(rest, rest.title()))
    if c.isascii() and c.isalnum():
        return c
    plain = unstyle(c)
    return latex_of(plain) if plain != c and len(plain) == 1 else None


def latex_map(characters: str) -> Column:
    """A literal map from characters to LaTeX, for use within plans."""
    known = {c: t for c in characters if (t := latex_of(c)) is not None}
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
