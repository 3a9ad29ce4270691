"""Text analysis as column expressions: character filters, tokenisers, token filters and analysers.

A tokeniser takes a string column and gives array<string>; a token filter takes and gives array<string>. A position is
an index in the final array, as a dropped token leaves no hole. All of it runs in the JVM; only stemmers with long rule
tables run in Python, on distinct terms (see ``stemming``). A null text gives no tokens (a null or an empty array).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokens = Callable[[Column], Column]


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once; named within a lambda, it would be computed again for each element."""
    return F.get(F.transform(F.array(value), fn), 0)


# --- fixed values ---
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
ARTICLES = "l m t qu n s j d c jusqu quoiqu lorsqu puisqu".split()
# --- end of fixed values ---


# character filters


def strip_html(text: Column) -> Column:
    """Each tag and each entity becomes a space; script and style text stays."""
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]*>?", " "), r"&[A-Za-z0-9_]*;", " ")


def map_characters(text: Column, mapping: dict[str, str]) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), mapping.items(), text)


def replace_pattern(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, pattern, by)


# tokenisers


def by_pattern(pattern: str) -> Tokens:
    """Each non-empty match is a token."""
    return lambda text: F.filter(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda t: t != "")


words = by_pattern(r"[\p{L}\p{Nd}]+")
letters = by_pattern(r"\p{L}+")
whitespace = by_pattern(r"\S+")
icu_words = by_pattern(r"[\p{L}\p{N}\p{M}]+(?:['’_-][\p{L}\p{N}\p{M}]+)*")
url_email = by_pattern(
    r"https?://[^\s<>\"]+|www\.[^\s<>\"]+|[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+|[#@][\p{L}\p{N}_]+|[\p{L}\p{N}\p{M}]+(?:['’_-][\p{L}\p{N}\p{M}]+)*"
)


def keyword(text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(text))


def _grams(word: Column, lo: int, hi: int, starts: Column) -> Column:
    sizes = F.array(*[F.lit(n) for n in range(lo, hi + 1)])
    at = F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda n: i + n - 1 <= F.length(word)), lambda n: F.substr(word, i, n)))
    return F.flatten(at)


def _positions(word: Column) -> Column:
    return F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))


def _grams_of_characters(text: Column, lo: int, hi: int, starts: Column) -> Column:
    """The same of a text of any length: it is cut into characters once, as a place in a string is found by counting."""
    sizes = F.array(*[F.lit(n) for n in range(lo, hi + 1)])

    def out(chars: Column) -> Column:
        return F.flatten(F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda n: i + n - 1 <= F.size(chars)), lambda n: F.array_join(F.slice(chars, i, n), ""))))

    return once(F.split(text, ""), out)


def ngrams(lo: int, hi: int, split: bool = False) -> Tokens:
    """For each start, the grams of lo to hi characters; of each word by itself if split. To count them, see ``gram_pieces``."""

    def one(word: Column) -> Column:
        return once(word, lambda w: _grams_of_characters(w, lo, hi, _positions(w)))

    return (lambda text: F.flatten(F.transform(whitespace(text), one))) if split else one


def gram_pieces(hi: int) -> Tokens:
    """Pieces of a text, a word or part of one mostly, each with the characters behind it that grams of up to hi reach.

    Each is a structure of the piece and the number of places in it where grams begin, so every gram of the text begins
    in one piece. A piece is short even if a text has no spaces.
    """
    ahead = max(hi - 1, 1)
    parts = by_pattern(rf"(?s).{{{ahead}}}\S{{0,16}}\s?|.+")  # only the last has fewer than `ahead` characters

    def out(cut: Column) -> Column:
        behind = lambda i: F.left(F.coalesce(F.get(cut, i + 1), F.lit("")), F.lit(hi - 1))
        return F.transform(cut, lambda c, i: F.struct(F.concat(c, behind(i)).alias("piece"), F.length(c).alias("starts")))

    return lambda text: once(parts(text), out)


def piece_grams(piece: Column, starts: Column, lo: int, hi: int) -> Column:
    """The grams that begin in a piece."""
    return _grams_of_characters(piece, lo, hi, F.sequence(F.lit(1), starts))


def edge_ngrams(lo: int, hi: int) -> Tokens:
    """Prefixes of each word."""
    return lambda text: F.flatten(F.transform(whitespace(text), lambda w: _grams(w, lo, hi, F.array(F.lit(1)))))


def path_tree(reverse: bool = False, lowercase: bool = False) -> Tokens:
    """Cumulative paths from the root (or suffixes to the leaf) of a path with / or \\ between its parts."""

    def tokens(text: Column) -> Column:
        source = F.lower(text) if lowercase else text
        parts = F.filter(F.split(F.regexp_replace(source, r"\\", "/"), "/"), lambda p: p != "")
        n = F.size(parts)
        ends = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        if reverse:
            return F.transform(ends, lambda i: F.array_join(F.slice(parts, i, n), "/"))
        return F.transform(ends, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))

    return tokens


def cjk_bigrams(text: Column) -> Column:
    """Overlapping pairs within a run of ideographs or kana, a single one alone; other runs as words."""
    cjk = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
    runs = F.regexp_extract_all(text, F.lit(rf"({cjk}+|(?:(?!{cjk})[\p{{L}}\p{{Nd}}])+)"), F.lit(1))

    def one(run: Column) -> Column:
        return F.when(run.rlike(f"^{cjk}{{2,}}$"), _grams(run, 2, 2, _positions(run))).otherwise(F.array(run))

    return F.flatten(F.transform(runs, one))


# token filters


def each(fn: Callable[[Column], Column]) -> Tokens:
    return lambda tokens: F.transform(tokens, fn)


def reverse_characters(token: Column) -> Column:
    """Characters as a reader sees them in reverse: what belongs to one (marks, the parts of a syllable) keeps its order."""
    characters = F.regexp_extract_all(token, F.lit(r"(\X)"), F.lit(1))
    ascii_only = F.octet_length(token) == F.length(token)
    return F.when(ascii_only, F.reverse(token)).otherwise(F.array_join(F.reverse(characters), ""))


lowercase = each(F.lower)
reverse = each(reverse_characters)


def stop(stop_words: Sequence[str] = STOP_WORDS) -> Tokens:
    known = sorted(set(stop_words))
    return lambda tokens: F.filter(tokens, lambda t: ~F.lower(t).isin(*known))


def keep(kept: Sequence[str]) -> Tokens:
    return lambda tokens: F.filter(tokens, lambda t: t.isin(*kept))


def length_between(lo: int, hi: int) -> Tokens:
    return lambda tokens: F.filter(tokens, lambda t: F.length(t).between(lo, hi))


def truncate(n: int) -> Tokens:
    return each(lambda t: F.left(t, F.lit(n)))


def limit(n: int) -> Tokens:
    return lambda tokens: F.slice(tokens, 1, n)


def token_type(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{Nd}+$"), "number").otherwise("word")


def of_type(types: Sequence[str], kept: bool = True) -> Tokens:
    return lambda tokens: F.filter(tokens, lambda t: token_type(t).isin(*types) if kept else ~token_type(t).isin(*types))


@cache
def _marks() -> tuple[str, str]:
    """From Unicode's decompositions: the letters that carry marks and their plain ones, then the marks themselves."""
    marked, plain, marks = [], [], []
    for c in map(chr, range(0x80, 0x10000)):
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        parts = unicodedata.normalize("NFD", c)
        bare = unicodedata.normalize("NFC", "".join(p for p in parts if unicodedata.category(p) != "Mn"))
        if bare != c and len(bare) == 1 and len(parts) > 1:
            marked.append(c)
            plain.append(bare)
    return "".join(marked + marks), "".join(plain)


def without_marks(text: Column) -> Column:
    """Letters without their marks, whatever the script; a mark that stands by itself goes too."""
    return F.translate(text, *_marks())


fold_accents = each(without_marks)


def decimal_digits(tokens: Column) -> Column:
    """Digits of the common scripts as ASCII."""
    blocks = [0x660, 0x6F0, 0x966, 0x9E6, 0xE50, 0xFF10]
    return F.transform(tokens, lambda t: F.translate(t, "".join(chr(b + i) for b in blocks for i in range(10)), "0123456789" * len(blocks)))


def replace_in_tokens(pattern: str, by: str) -> Tokens:
    return each(lambda t: F.regexp_replace(t, pattern, by))


def _classic(t: Column) -> Column:
    bare = F.regexp_replace(t, r"(?:['’][sS]|['’])$", "")
    return F.when(bare.rlike(r"^(?:\p{L}\.)+\p{L}?$") & (F.length(bare) >= 2), F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)


classic = each(_classic)


def elision(articles: Sequence[str] = ARTICLES) -> Tokens:
    return replace_in_tokens(rf"^(?i:{'|'.join(articles)})['’](?=.)", "")


def word_delimiter(
    case_change: bool = True,
    numerics: bool = True,
    possessive: bool = True,
    original: bool = False,
    catenate_all: bool = False,
    word_parts: bool = True,
    number_parts: bool = True,
    catenate_words: bool = False,
    catenate_numbers: bool = False,
) -> Tokens:
    """Split tokens at punctuation, case changes and between letters and digits.

    In this order: the parts, all word parts as one, all number parts as one, all parts as one, the token itself. A token
    of which nothing would remain stays.
    """
    case = r"\p{Lu}?\p{Ll}+|\p{Lu}+(?!\p{Ll})|\p{Lo}+" if case_change else r"\p{L}+"
    part = rf"{case}|\p{{Nd}}+" if numerics else (rf"{case}|\p{{Nd}}+" if case_change else r"[\p{L}\p{Nd}]+")

    def one(t: Column) -> Column:
        none = F.array().cast("array<string>")
        bare = F.regexp_replace(t, r"['’][sS]?$", "") if possessive else t
        parts = F.regexp_extract_all(bare, F.lit(f"({part})"), F.lit(1))
        number = lambda x: x.rlike(r"^\p{Nd}+$")
        joined = lambda xs, least: F.when(F.size(xs) >= least, F.array(F.array_join(xs, ""))).otherwise(none)
        kept = parts if word_parts and number_parts else F.filter(parts, lambda x: number(x) if number_parts else ~number(x) if word_parts else F.lit(False))
        out = [kept]
        if catenate_words:
            out.append(joined(F.filter(parts, lambda x: ~number(x)), 2))
        if catenate_numbers:
            out.append(joined(F.filter(parts, number), 2))
        if catenate_all:
            out.append(joined(parts, 2))
        if original:
            out.append(F.when((F.size(parts) != 1) | (F.element_at(parts, 1) != t), F.array(t)).otherwise(none))
        made = F.concat(*out)
        return F.when(F.size(made) > 0, made).otherwise(F.array(t)) if not (word_parts and number_parts) else made

    return lambda tokens: F.flatten(F.transform(tokens, one))


def rejoin_hyphenated(tokens: Column) -> Column:
    """'foo-' before 'bar' becomes 'foobar'."""

    def step(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.regexp_replace(last, "-$", ""), t)))
        return F.when((F.size(acc) > 0) & F.coalesce(F.get(acc, F.size(acc) - 1).endswith("-"), F.lit(False)), joined).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def shingles(lo: int = 2, hi: int = 2, unigrams: bool = True, sep: str = " ") -> Tokens:
    """All tokens first, then the shingles of each size. To count them, see ``windows``."""

    def of_size(tokens: Column, n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), sep))

    def out(tokens: Column) -> Column:
        parts = [tokens] if unigrams else []
        for n in range(lo, hi + 1):
            parts.append(of_size(tokens, n))
        return F.concat(*parts)

    return lambda tokens: once(tokens, out)


def windows(n: int, sep: str = " ") -> Tokens:
    """Each token with the n - 1 behind it, fewer at the end. Their beginnings are all shingles of up to n tokens."""

    def out(tokens: Column) -> Column:
        return F.transform(tokens, lambda t, i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), sep))

    return lambda tokens: once(tokens, out)


def common_grams(common: Sequence[str], sep: str = "_") -> Tokens:
    """Before a common word that another follows, their pair."""

    def out(tokens: Column) -> Column:
        known = F.array(*[F.lit(w) for w in common])

        def one(t: Column, i: Column) -> Column:
            after = F.get(tokens, i + 1)
            both = F.array_contains(known, t) & F.coalesce(F.array_contains(known, after), F.lit(False))
            return F.when(both, F.array(F.concat(t, F.lit(sep), after), t)).otherwise(F.array(t))

        return F.flatten(F.transform(tokens, one))

    return out


def synonyms(mapping: dict[str, Sequence[str]]) -> Tokens:
    """Tokens as they are, then the replacements of those that have any.

    A key may be several words; at each place the longest key counts, and its words begin no other one.
    """
    longest = max((len(k.split()) for k in mapping), default=1)

    def out(tokens: Column) -> Column:
        table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(" ".join(k.split())), F.array(*[F.lit(s) for s in v]))])
        if longest == 1:
            found = F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull())
            return F.concat(tokens, F.flatten(found))

        def match(i: Column) -> Column:
            """The longest key at a place, as its length and replacements; null if there is none."""
            options = []
            for n in range(longest, 0, -1):
                phrase = F.when(i + n <= F.size(tokens), F.array_join(F.slice(tokens, i + 1, F.lit(n)), " "))
                values = F.try_element_at(table, phrase)
                options.append(F.when(values.isNotNull(), F.struct(F.lit(n).alias("n"), values.alias("values"))))
            return F.coalesce(*options)

        places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
        hits = F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), match(i).alias("m"))), lambda h: h["m"].isNotNull())
        start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("made"))

        def step(acc: Column, h: Column) -> Column:
            taken = F.struct((h["i"] + h["m"]["n"]).alias("free"), F.concat(acc["made"], h["m"]["values"]).alias("made"))
            return F.when(h["i"] >= acc["free"], taken).otherwise(acc)

        return F.concat(tokens, F.aggregate(hits, start, step, lambda acc: acc["made"]))

    return out


def each_but(kept: Sequence[str], fn: Callable[[Column], Column]) -> Tokens:
    """A word function on all tokens but the marked ones, which stay as they are."""
    return each(lambda t: F.when(t.isin(*kept), t).otherwise(fn(t)))


def unique(tokens: Column) -> Column:
    """Each token once, where it first stands."""
    return F.array_distinct(tokens)


def suffix_stemmer(
    steps: Sequence[Sequence[tuple[str, str]]], guard: int, fold: dict[str, str] | None = None, drop_last: str = "", drop_above: int = 2, shortest: int = 3
) -> Callable[[Column], Column]:
    """In each step the first ending that leaves at least ``guard`` letters is replaced. Words up to ``shortest`` letters stay.

    Of two endings that can fit one word the longer stands first in every table, so a reluctant prefix finds the first.
    Each step is a chain of replacements of one value; an ending that has been replaced is marked, so that no other
    rule of its step fits.
    """
    for rules in steps:
        endings = [a for a, _ in rules]
        if any(b.endswith(a) and a != b for i, a in enumerate(endings) for b in endings[i + 1 :]):
            raise ValueError("a longer ending stands behind a shorter one that it ends with")

    def stem(word: Column) -> Column:
        out = map_characters(word, fold) if fold else word
        for rules in steps:
            changed = [(a, b) for a, b in rules if b]
            for a, b in changed:
                out = F.regexp_replace(out, f"^(.{{{guard},}}){a}$", f"$1\u0001{b}")
            out = F.regexp_replace(out, f"^([^\u0001]{{{guard},}}?)(?:{'|'.join(a for a, b in rules if not b)})$", "$1")
            if changed:
                out = F.translate(out, "\u0001", "")
        if drop_last:
            out = F.regexp_replace(out, f"^(.{{{drop_above},}}){drop_last}$", "$1")
        return F.when(F.length(word) <= shortest, word).otherwise(out)

    return stem


def ending_rules(text: str) -> list[tuple[str, str]]:
    return [(a, b) for a, _, b in (w.partition("=") for w in text.split())]


# --- fixed values: endings by language, in the order they are tried; a=b replaces a by b ---
FRENCH = [
    ending_rules("issements issement ements ement ations ation euses euse eurs eur ités ité ives ive ifs if aux=al"),
    ending_rules("issent issons issez irent eront erons erez ent ons ez er es"),
]
GERMAN = [
    ending_rules("erungen erung ungen ung heiten heits heit keiten keit schaften schaft ismus isten ist"),
    ending_rules("lichen liche licher lichem liches lich ischen ische ischer ischem isches isch igen ige iger igem iges ig"),
    ending_rules("test etet est tet et te nd"),
    ending_rules("innen erns ern ens ers en em es er e s"),
]
# --- end of fixed values ---
stem_french = suffix_stemmer(FRENCH, guard=2, drop_last="e")
stem_german = suffix_stemmer(GERMAN, guard=3, fold={"ä": "a", "ö": "o", "ü": "u", "ß": "ss"})


# analysers


def analyser(tokeniser: Tokens, *filters: Tokens) -> Tokens:
    """A tokeniser and the filters that follow it."""
    return lambda text: reduce(lambda c, f: f(c), filters, tokeniser(text))


standard = analyser(words, lowercase, stop())
simple = analyser(letters, lowercase)
ANALYSERS: dict[str, Tokens] = {
    "standard": standard,
    "simple": simple,
    "whitespace": whitespace,
    "keyword": keyword,
    "icu": analyser(icu_words, lowercase, stop()),
    "cjk": cjk_bigrams,
}
