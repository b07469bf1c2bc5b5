"""Whether a text denies something outright or under a condition: a fold over the clauses of its sentences.

A text becomes a short string of marks, by expressions that each pass over it once: ends of sentences, paragraphs and items, dashes, brackets,
denials, words that begin conditions, words that may stand between a denial and its condition, and one mark for any run of other words.  A fold over the
marks carries a state: the depth of brackets, the depths at which a leading condition holds, what has come since the clause began, the last denial and
what has followed it.  So a text costs as much as it is long, whatever it says.

A condition leads if its marker begins a clause, and holds for denials of its sentence at its depth of brackets.  It trails if it follows the denial
directly (behind "applies", "is crossed", a comma, a dash, "to" and a complement, or words such as "depending on"), or opens a bracket behind it.
A denial that no condition holds for is outright.  Null texts deny nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.text import let

# Marks stand in the first places of the private use area; characters of it in a text are blanks.
STOP, SOFT, PARAGRAPH, ITEM, DASH, DENIAL, MARKER, INTRO, AND, BUT, YET, EMPHASIS, APPLIES, CROSSED, BETWEEN, TO, ARTICLE, WORDS = (chr(0xE000 + k) for k in range(18))
# What may close a sentence and open the next one, openers and verbs that tell whether letters with full stops end one, and the words of conditions.
MARKS = f"{chr(0xE000)}-{chr(0xE0FF)}"
_CLOSED = r"[\"'”’)*_~]*+"
_OPENING = r"(?:>[>\s]*)?(?:(?:[-+*]|\d+[.)])\s+)?(?:\[[ xX]\]\s+)?(?:[*_~]{1,2})?[\"'“‘(]*"
_OPENERS = r"(?:A|An|If|It|No|The|There|This|That|We|When|Whether|Unless)\b"
_GOES_ON = r"[A-Z][\w'-]*(?:\s+[\w'-]+){0,5}\s+(?:is|are|was|were|has|have|had|does|do|did|can|could|may|might|must|should|will|would)\b[^.?!\n]*(?:,|\bthen\b|:|--|—)"
#: Expressions in the order in which they are put in place, with the mark that takes the place of what they match.  Only classes of characters repeat without
#: a bound, never groups, whose every turn would take a frame of the stack.
STEPS = (
    (f"[{MARKS}]", " "),
    # letters with full stops, which no new sentence follows
    (rf"\b(?:[A-Za-z]\.){{2,20}}(?=\s+(?!{_OPENING}{_OPENERS}){_OPENING}{_GOES_ON})", "w"),
    (rf"[!?](?={_CLOSED}(?:\s|$))|\.(?={_CLOSED}\s+(?:{_OPENING}[A-Z]|$))", STOP),
    (r"[.?!](?=[\"'”’)]*(?:\s|$))", SOFT),
    (r"\n\s*\n", PARAGRAPH),
    (r"\n(?=[ \t]*(?:>|(?:[-+*]|\d+[.)])\s))", ITEM),
    # what opens an item or a quotation says nothing
    (rf"((?:^|[\n{PARAGRAPH}{ITEM}{STOP}])[ \t]*)(?:>[> \t]*)?(?:(?:[-+*]|\d+[.)])[ \t]+)?(?:\[[ xX]\][ \t]+)?", "$1"),
    (r"--+|—", DASH),
)
WORD_STEPS = (
    (r"\b(?:(?:it\s+)?depends?|depending(?:\s+directly|\s+entirely)?|based|contingent)\s+(?:on|upon)\b|\bsubject\s+to\b", INTRO),
    (r"\b(?:if|when|whether|unless)\b", MARKER), (r"\b(?:and|or)\b", AND), (r"\bbut\b", BUT), (r"\b(?:however|yet)\b", YET), (r"\b(?:only|even|especially)\b", EMPHASIS),
    (r"\bapplies\b", APPLIES), (r"\bis\s+crossed\b", CROSSED), (r"\bbetween\b", BETWEEN), (r"\bto\b", TO), (r"\b(?:the|a|an|word|label)\b", ARTICLE),
)
#: Words that the steps above look at; the others only have to be there.
_TOLD_APART = "it|depends?|depending|directly|entirely|based|contingent|on|upon|subject|to|if|when|whether|unless|and|or|but|however|yet|only|even|especially|applies|is|crossed|between|the|an?|word|label"
#: Any other word becomes one letter, and what stands between two of these goes, so that the steps above pass over short texts.
SHORT_STEPS = ((rf"(?iu)\b(?!(?:{_TOLD_APART})\b)[\p{{L}}\p{{N}}]+", "w"), (rf"(?<=\bw)[^{MARKS};:,()\p{{L}}\p{{N}}]+(?=w\b)", ""))
#: Deepest bracket that is told apart.
DEEPEST = 60
# What has come since the clause began: nothing, a conjunction, a word of emphasis or an introduction, other words.
_FRESH, _JOINED, _LED, _STALE = range(4)
# What has come since the last denial: it is settled, nothing, its predicate, "between", a comma, a word that a marker must follow, "to", words behind it, an article behind these.
_NONE, _BARE, _SAID, _WITHIN, _COMMA, _INTRODUCED, _TOWARDS, _TOLD, _NAMED = range(9)


def marks(text: Column, denials: tuple[str, ...]) -> Column:
    """The string of marks of a text; ``denials`` are expressions without regard to case."""
    text = reduce(lambda t, s: F.regexp_replace(t, *s), STEPS, text)
    # a denial may span words, but no end of a sentence
    text = F.regexp_replace(text, "(?iu)" + "|".join(f"(?:{d})" for d in denials), DENIAL)
    text = reduce(lambda t, s: F.regexp_replace(t, *s), SHORT_STEPS, text)
    text = reduce(lambda t, s: F.regexp_replace(t, "(?iu)" + s[0], s[1]), WORD_STEPS, text)
    # of all that is left, only whether there were words
    text = F.regexp_replace(text, rf"[^{MARKS};:,()\p{{L}}\p{{N}}]+", "")
    return F.regexp_replace(text, r"[\p{L}\p{N}]+", WORDS)


def _case(*branches: tuple[Column, object], otherwise) -> Column:
    first, *rest = branches
    return reduce(lambda c, b: c.when(*b), rest, F.when(*first)).otherwise(otherwise)


def _step(s: Column, c: Column) -> Column:
    among = lambda *m: c.isin(*m)
    bit = lambda d: F.call_function("shiftleft", F.lit(1).cast("long"), d)
    ends = among(STOP, ";", PARAGRAPH, ITEM)
    # a dash is an end unless it brings in the denial, or what follows it begins a condition
    cut_lead = (s.dash == 1) & (c != DENIAL)
    cut_denial = ((s.dash == 1) & ~among(EMPHASIS, MARKER)) | ((s.dash == 2) & (c != MARKER))
    leaves = (c == ")") & (s.at > s.depth - 1)
    elsewhere = (c == DENIAL) & (s.at != s.depth)
    release = ends | cut_denial | among(BUT, YET) | leaves | elsewhere
    lead = F.when(ends | cut_lead, F.lit(0).cast("long")).otherwise(s.lead)
    # a step's parts are made once and named, as an expression inside of a fold is worked out again wherever it stands
    begun = F.struct(lead.alias("lead"), release.alias("release"), F.when(release, _NONE).otherwise(s.last).alias("last"), F.when(release, 0).otherwise(s.held).alias("held"), ends.alias("ends"))
    return let(begun, lambda x: _continued(s, c, x))


def _continued(s: Column, c: Column, x: Column) -> Column:
    among = lambda *m: c.isin(*m)
    bit = lambda d: F.call_function("shiftleft", F.lit(1).cast("long"), d)
    lead, last, held = x["lead"], x["last"], x["held"]
    held_by_lead = (c == DENIAL) & (lead.bitwiseAND(bit(s.depth)) != 0)
    by_bracket = (c == MARKER) & s.gate & (held > 0)
    trails = (c == MARKER) & last.isin(_BARE, _SAID, _COMMA, _INTRODUCED, _TOLD)
    direct, telling = last.isin(_BARE, _SAID, _COMMA), last.isin(_TOWARDS, _TOLD, _NAMED)
    now = _case(
        (c == DENIAL, F.when(held_by_lead, _NONE).otherwise(_BARE)), ((last == _NONE) | among(MARKER, "(", ")", ":"), _NONE), ((c == CROSSED) & last.isin(_BARE, _WITHIN), _SAID), ((c == APPLIES) & (last == _BARE), _SAID),
        ((c == BETWEEN) & (last == _BARE), _WITHIN), ((last == _WITHIN) & ~among(SOFT, DASH), _WITHIN), ((c == ",") & last.isin(_BARE, _SAID), _COMMA), ((c == DASH) & (last.isin(_BARE, _SAID) | telling), last),
        (direct & among(EMPHASIS, INTRO), _INTRODUCED), (direct & (c == TO), _TOWARDS), (telling & (c == ARTICLE), _NAMED), (telling & (c == AND) & (s.previous == ","), _NONE), (telling & (c != SOFT), _TOLD), otherwise=_NONE,
    )
    told = F.struct(now.alias("now"), held_by_lead.alias("by_lead"), by_bracket.alias("by_bracket"), trails.alias("trails"))
    return let(told, lambda t: _ended(s, c, x, t))


def _ended(s: Column, c: Column, x: Column, t: Column) -> Column:
    among = lambda *m: c.isin(*m)
    bit = lambda d: F.call_function("shiftleft", F.lit(1).cast("long"), d)
    lead, last, held, release, ends = (x[k] for k in ("lead", "last", "held", "release", "ends"))
    now, held_by_lead, by_bracket, trails = (t[k] for k in ("now", "by_lead", "by_bracket", "trails"))
    given_up = (last != _NONE) & ((now == _NONE) | (c == DENIAL)) & ~trails
    fresh = _case(
        (ends | among(":", DASH), _FRESH), (among("(", ")"), s.fresh), (among(AND, BUT) & (s.fresh == _FRESH), _JOINED), ((c == EMPHASIS) & s.fresh.isin(_FRESH, _JOINED), _LED),
        ((c == INTRO) & (s.fresh == _FRESH), _LED), otherwise=_STALE,
    )
    return F.struct(
        _case((c == "(", F.least(s.depth + 1, F.lit(DEEPEST))), (c == ")", F.greatest(s.depth - 1, F.lit(0))), (c == PARAGRAPH, 0), otherwise=s.depth).alias("depth"),
        _case(((c == MARKER) & (s.fresh != _STALE), lead.bitwiseOR(bit(s.depth))), (c == ")", lead.bitwiseAND(bit(s.depth) - 1)), otherwise=lead).alias("lead"),
        fresh.alias("fresh"), _case((c == DASH, 1), ((c == EMPHASIS) & (s.dash == 1), 2), otherwise=0).alias("dash"),
        now.alias("last"), F.when(c == DENIAL, s.depth).otherwise(s.at).alias("at"), F.when(by_bracket, 0).otherwise(held + given_up.cast("int")).alias("held"),
        _case((c == "(", ((s.last != _NONE) | (s.held > 0)) & ~release & (s.depth == s.at)), (c == EMPHASIS, s.gate), otherwise=False).alias("gate"), c.alias("previous"),
        (s.conditional | held_by_lead | by_bracket | trails).alias("conditional"), (s.outright | (release & ((s.last != _NONE) | (s.held > 0)))).alias("outright"),
    )


def denied(text: Column, denials: tuple[str, ...], begun: Column | None = None) -> Column:
    """(outright, conditional): whether ``text`` has a denial of either kind; ``begun`` is true at least of all texts that have one, if that is known."""
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).cast("long").alias("lead"), F.lit(_FRESH).alias("fresh"), F.lit(0).alias("dash"), F.lit(_NONE).alias("last"), F.lit(0).alias("at"), F.lit(0).alias("held"),
        F.lit(False).alias("gate"), F.lit("").alias("previous"), F.lit(False).alias("conditional"), F.lit(False).alias("outright"),
    )
    read = F.aggregate(
        F.split(marks(text, denials), ""), start, _step,
        lambda s: F.struct((s.outright | (s.last != _NONE) | (s.held > 0)).alias("outright"), s.conditional.alias("conditional")),
    )
    # most texts have no denial, and are neither marked nor read
    nothing = F.struct(F.lit(False).alias("outright"), F.lit(False).alias("conditional"))
    begun = text.rlike("(?iu)" + "|".join(f"(?:{d})" for d in denials)) if begun is None else begun
    return F.when(begun, read).otherwise(nothing)
