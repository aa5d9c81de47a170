"""Text expressions. Java's and Python's rules differ for case and word characters; these give Python's results for the letters that occur in text."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.probability import let

#: English stop words of the retrieval index.
STOP_WORDS = tuple("a an and are as at be but by for from had has have he her his i if in into is it its not of on or our she that the their them then there these they this to was we were what when which who will with you your".split())


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose case fold is another one, and those whose fold is several, from Python's own rule."""
    pairs = [(chr(c), chr(c).casefold()) for c in range(0x80, 0x1E944) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)]
    return {a: b for a, b in pairs if len(b) == 1}, {a: b for a, b in pairs if len(b) > 1}


#: A character over U+00FF, or the micro sign (whose fold is one).
_WIDE = "[^\\x00-\u00b4\u00b6-\u00ff]"


def _lowered(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def casefold(text: Column) -> Column:
    """Python's casefold. Where a text has no character over U+00FF (and no micro sign), lower case with sharp s as ss is the same, and quick."""
    one, several = _folds()
    whole = F.translate(F.translate(text, "".join(one), "".join(one.values())), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # folds of several characters: one class test, then only the texts that have such a character go through it character by character
    folds = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(whole, ""), lambda c: F.coalesce(F.try_element_at(folds, c), c)), "")
    whole = F.when(whole.rlike(f"[{''.join(several)}]"), spelled).otherwise(whole)
    return F.when(text.rlike(_WIDE), whole).otherwise(_lowered(text))


#: White space that Python parts words at.
WHITE = "[\\x09-\\x0d\\x1c-\\x20\\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

#: Those up to U+00FF but the space, each named, since Java's classes look single characters up and try ranges one by one; runs of them and of spaces, other than one space.
_NARROW = "\\x09\\x0a\\x0b\\x0c\\x0d\\x1c\\x1d\\x1e\\x1f\\x85\\xa0"
_NARROW_RUNS = f"[{_NARROW}][{_NARROW}\\x20]*+|\\x20[{_NARROW}\\x20]++"


def normalised(text: Column) -> Column:
    """Case-folded, runs of white space as one space, trimmed. Where a text has no character over U+00FF, only its runs that are not one space already are replaced, which is quick."""
    whole = F.trim(F.regexp_replace(casefold(text), WHITE, " "))
    return F.when(text.rlike(_WIDE), whole).otherwise(F.trim(F.regexp_replace(_lowered(text), _NARROW_RUNS, " ")))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def word_list(text: Column) -> Column:
    """Case-folded runs of letters, digits and underscores, of any script."""
    return F.regexp_extract_all(casefold(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def grams(words: Column, size: int) -> Column:
    """Distinct runs of size words, joined by spaces; none where there are fewer words. words is bound once, not computed for each run."""
    some = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda k: F.array_join(F.slice(w, k, F.lit(size)), " "))
    return let(words, lambda w: F.when(F.size(w) >= size, F.array_distinct(some(w))).otherwise(F.array().cast("array<string>")))


def gram_hashes(words: Column, size: int) -> Column:
    """Distinct 64-bit hashes of runs of size words; none where there are fewer words. A word is hashed once, a run is a hash of its words' hashes."""
    some = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda k: F.xxhash64(*[F.get(h, k + j) for j in range(size)]))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= size, F.array_distinct(some(h))).otherwise(F.array().cast("array<bigint>")))


def masked_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[0-9]+", "#")


def lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def clean_html(text: Column) -> Column:
    """Tags to spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def cut_at_word(text: Column, limit: int) -> Column:
    """At most limit characters, cut at the last space, then an ellipsis; shorter texts as they are."""
    head = F.left(text, F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*\z", ""), F.lit(" …")))


def line_safe(text: Column) -> Column:
    """No character besides the line feed that Python's splitlines breaks on."""
    return ~text.rlike("[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")


def last_number(text: Column) -> Column:
    """The last number of a text, without $, % and commas; null where there is none."""
    plain = F.regexp_replace(text, r"[$%,]", "")
    return F.try_element_at(F.regexp_extract_all(plain, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), F.lit(-1)).cast("double")


def choice_letter(text: Column) -> Column:
    """The letter A to D that a text names as its answer: after 'answer is', else in parentheses, else the last single one; null where none."""
    found = [F.regexp_extract(text, p, 1) for p in (r"(?i)answer\s*(?:is|:)\s*\(?([A-D])\b", r"\(([A-D])\)")]
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b([A-D])\b"), F.lit(1)), F.lit(-1))
    return F.coalesce(*[F.when(x != "", F.upper(x)) for x in found], last)


#: First words of change subjects by class; words that an object may follow; objects that make a change one of tests or of documentation.
COMMIT_WORDS = {
    "feature": tuple("add adds added adding implement implements implemented create creates created introduce introduces introduced support supports allow allows enable enables feat feature".split()),
    "fix": tuple("fix fixes fixed fixing correct corrects corrected resolve resolves resolved repair repairs solve solves bugfix hotfix".split()),
    "remove": tuple("remove removes removed removing delete deletes deleted drop drops dropped".split()),
    "change": tuple("refactor refactors refactored refactoring rename renames renamed move moves moved simplify simplifies clean cleans cleanup restructure reorganize reorganise extract rewrite replace replaces change changes changed update updates updated modify modifies tweak tweaks adjust switch convert use bump upgrade improve improves perf style".split()),
    "docs": tuple("document documents documented docs doc".split()),
    "test": tuple("test tests testing".split()),
    "revert": tuple("revert reverts reverted".split()),
}
OBJECT_SKIP = tuple("a an the more some missing new basic initial extra additional unit simple better few and for to".split())
DOC_OBJECTS = tuple("doc docs documentation docstring docstrings readme comment comments changelog javadoc jsdoc license copyright".split())
TEST_OBJECTS = tuple("test tests testcase testcases unittest unittests spec specs coverage".split())


def commit_type(subject: Column) -> Column:
    """The class of a change by its prefix ('fix(x):') or first word; null where that has none. Of features and changes, the object may make it one of tests or documentation."""
    s = F.lower(F.trim(subject))
    prefix = r"^([a-z]+)(\([^)]*\))?!?:"
    head = F.regexp_extract(s, prefix, 1)
    words = lambda x: F.regexp_extract_all(x, F.lit("([a-z]+)"), F.lit(1))
    first = F.when(head != "", head).when(s.rlike("^[\"'`]?[a-z]"), F.get(words(s), F.lit(0)))
    rest = F.when(head != "", words(F.regexp_replace(s, prefix, ""))).otherwise(F.slice(words(s), 2, F.greatest(F.size(words(s)), F.lit(1))))
    kind = F.lit(None).cast("string")
    for name, known in COMMIT_WORDS.items():
        kind = F.when(first.isin(*known), name).otherwise(kind)
    object_ = F.get(F.filter(rest, lambda w: ~w.isin(*OBJECT_SKIP)), F.lit(0))
    refined = F.when(object_.isin(*TEST_OBJECTS), "test").when(object_.isin(*DOC_OBJECTS), "docs").otherwise(kind)
    return F.when(kind.isin("feature", "change"), refined).otherwise(kind)


def roman(n: Column) -> Column:
    """Roman numerals of 1 to 3999: a digit's numeral by its place."""
    ones = "|I|II|III|IV|V|VI|VII|VIII|IX".split("|")
    places = [[x.translate(str.maketrans("IVX", t)) for x in ones] for t in ("M??", "CDM", "XLC", "IVX")]
    return F.concat(*[F.get(F.array(*map(F.lit, digits)), (F.floor(n / 10**p) % 10).cast("int")) for p, digits in zip((3, 2, 1, 0), places)])


def money(cents: Column) -> Column:
    """$1,234.05 from cents."""
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.floor(F.abs(cents) / 100), 0), F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def dates(text: Column) -> Column:
    """Distinct ISO dates in order of appearance."""
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), F.lit(1)), lambda d: F.try_to_date(d))), lambda d: d.isNotNull())


def date_facts(text: Column) -> Column:
    """'a to b: n days' of each pair of dates in order; empty below two."""
    pair = lambda x, y: F.concat(x.cast("string"), F.lit(" to "), y.cast("string"), F.lit(": "), F.abs(F.datediff(y, x)).cast("string"), F.lit(" days"))
    pairs = lambda d: F.flatten(F.transform(d, lambda x, i: F.transform(F.slice(d, i + 2, F.size(d)), lambda y: pair(x, y))))
    return let(dates(text), lambda d: F.when(F.size(d) >= 2, F.array_join(pairs(d), "; ")).otherwise(""))


def neutral_tokens(text: Column) -> Column:
    """Control tokens <|name|> as <name>, so that a tokenizer takes them as text."""
    return F.regexp_replace(text, r"<\|([A-Za-z0-9_]+)\|>", "<$1>")


def fitting_prefix(text: Column, budget: Column | int, parts_at: str = "\n\n") -> Column:
    """The longest run of whole paragraphs from the start with at most ``budget`` words; null where the first is already too long, or for no text. Words do not reach over a paragraph's end, so counts add up and one pass finds the cut."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    parts = F.split(text, parts_at)
    words = F.transform(parts, lambda p: F.regexp_count(p, F.lit(r"[^\x20\x09-\x0D]+")))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    step = lambda a, w: F.when(a["open"] & (a["used"] + w <= budget), F.struct((a["used"] + w).alias("used"), (a["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(a["used"].alias("used"), a["n"].alias("n"), F.lit(False).alias("open")))
    n = F.aggregate(words, start, step, lambda a: a["n"])
    return let(n, lambda k: F.when(k > 0, F.array_join(F.slice(parts, F.lit(1), k), parts_at)))
